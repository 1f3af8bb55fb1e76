"""Content hashes and stable identities."""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import bound_batches
from .text import casefold

#: Fixed value: name space of segment identities.
SEGMENT_NAMESPACE = "cbd3960d2c2d52e8b4de5f37e8e9dc75"


def json_string(text: Column) -> Column:
    """A JSON string literal for texts without control characters other than those with short escapes."""
    body = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        body = F.replace(body, F.lit(raw), F.lit(f"\\{short}"))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_array(*items: Column) -> Column:
    """A compact JSON array of ready items, null for null items."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(i, F.lit("null")) for i in items]), F.lit("]"))


def uuid5_hex(namespace_hex: str, name: Column) -> Column:
    """UUIDv5 of a name, as 32 hex digits, without Python."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def stable_segment_id(index_id: Column, document_id: Column, parent_id: Column, position: Column, content_hash: Column) -> Column:
    """identity of a segment version; equal inputs give equal ids on every retry."""
    name = json_array(json_string(index_id), json_string(document_id), json_string(parent_id), position.cast("string"), json_string(content_hash))
    return uuid5_hex(SEGMENT_NAMESPACE, name)


def normalised_json(value):
    """the value with LF and NFC in every string and key; rejects what JSON can't hold."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is not finite")
        return value
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n"))
    if isinstance(value, dict):
        pairs = [(normalised_json(k), normalised_json(v)) for k, v in value.items() if isinstance(k, str)]
        out = dict(pairs)
        if len(pairs) != len(value) or len(out) != len(pairs):
            raise ValueError("a key is no string, or two keys are equal once normalised")
        return out
    if isinstance(value, (list, tuple)):
        return [normalised_json(x) for x in value]
    raise TypeError(f"{type(value).__name__} is no JSON value")


def canonical_json(value) -> str:
    """sorted, compact, without NaN."""
    return json.dumps(normalised_json(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: canonical_json(json.loads(t)), na_action="ignore")


@F.pandas_udf(StringType())
def _json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json, na_action="ignore")


#: Texts with such characters need NFC or escapes that json_string lacks.
_UNUSUAL = r"[^\t\n\r\x{8}\x{c}\x{20}-\x{2ff}]"


def canonical_string(text: Column) -> Column:
    """F5 for one text: a JSON string with LF and NFC; only unusual texts pass through Arrow, in small batches."""
    bound_batches(SparkSession.active())
    unusual = text.rlike(_UNUSUAL)
    return F.when(unusual, _json(F.when(unusual, text))).otherwise(json_string(F.regexp_replace(text, "\r\n?", "\n")))


def canonical_metadata(json_text: Column) -> Column:
    """F5 over a column of JSON texts."""
    return _canonical(json_text)


def content_hash(content: Column, metadata_json: Column) -> Column:
    """SHA-256 of the canonical content and metadata; only the metadata and unusual contents pass through Python."""
    whole = F.concat(F.lit('{"content":'), F.coalesce(canonical_string(content), F.lit("null")), F.lit(',"source_metadata":'), canonical_metadata(metadata_json), F.lit("}"))
    return F.sha2(whole, 256)


def config_hash(sorted_json: Column) -> Column:
    """F8: SHA-256 of a sorted, compact, ASCII-escaped JSON text."""
    return F.sha2(sorted_json, 256)


def extraction_fingerprint(signature: Column, model: Column, most_chars: int, content: Column) -> Column:
    """SHA-256 of the JSON array [signature, model, limit, content] with spaces after commas."""
    items = F.concat_ws(", ", json_string(signature), json_string(model), F.lit(str(most_chars)), json_string(content))
    return F.sha2(F.concat(F.lit("["), items, F.lit("]")), 256)


def entity_id(index_id: Column, name: Column, folded: bool = False) -> Column:
    """SHA-256 of index, NUL and the case-folded name (folded: the name is so already)."""
    return F.sha2(F.concat(index_id, F.lit("\0"), name if folded else casefold(name)), 256)


def flatten_attributes(attributes: Column) -> Column:
    """a map as an array of "key: value"."""
    return F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
