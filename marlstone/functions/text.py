"""Scalar text functions as Spark expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import bound_batches

#: CJK ideographs that form words of their own.
CJK = (
    r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}"
    r"\x{2b820}-\x{2ceaf}\x{2ceb0}-\x{2ebef}\x{2ebf0}-\x{2ee5f}\x{2f800}-\x{2fa1f}\x{30000}-\x{3134f}\x{31350}-\x{323af}\x{323b0}-\x{3347f}"
)
_LETTER = rf"[\p{{L}}\p{{N}}&&[^{CJK}]]"
TOKEN = rf"[{CJK}]+|{_LETTER}+(?:[._-]{_LETTER}+)*"


def normalise_newlines(text: Column) -> Column:
    """S3: CRLF and CR to LF, NUL dropped."""
    return F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\0"), F.lit(""))


def is_blank(text: Column) -> Column:
    """no visible character."""
    return ~text.rlike(r"(?U)[^\s\x{1c}-\x{1f}]")


def strip(text: Column) -> Column:
    """without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def tokens(text: Column) -> Column:
    """F2: CJK runs and words with inner dots, dashes and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_identifier(token: Column) -> Column:
    """ASCII with at least one letter and one digit."""
    return token.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & token.rlike("[A-Za-z]") & token.rlike("[0-9]")


def normalise_token(token: Column) -> Column:
    """identifiers in capitals, other words in small letters."""
    return F.when(is_identifier(token), F.upper(token)).otherwise(F.lower(token))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


#: Some character from U+0300 on: texts without any are in NFC as they are.
BEYOND_LATIN = r"[^\x{0}-\x{2ff}]"


def nfc(text: Column) -> Column:
    """Unicode NFC; small Arrow batches, as Spark has no such function, of the texts that may need it."""
    bound_batches(SparkSession.active())
    may = text.rlike(BEYOND_LATIN)
    return F.when(may, _nfc(F.when(may, text))).otherwise(text)


def normalise_content(text: Column) -> Column:
    """LF line ends and NFC."""
    return nfc(F.regexp_replace(text, "\r\n?", "\n"))


def casefold(text: Column) -> Column:
    """full case folding; Arrow batches, as lower() differs for some letters."""
    return _casefold(text)


def safe_collection(name: Column) -> Column:
    """kb_ and the name with [0-9A-Za-z_] kept, 255 at most."""
    return F.substring(F.concat(F.lit("kb_"), F.regexp_replace(name, "[^0-9A-Za-z_]", "_")), 1, 255)


def safe_filename(name: Column) -> Column:
    """F16: the last path part with word characters, dots, dashes and spaces kept, trimmed, 180 at most."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w. -]", "_"), r"^[. ]+|[. ]+$", "")
    return F.substring(F.when(kept == "", "file").otherwise(kept), 1, 180)


def normalise_ocr(text: Column) -> Column:
    """control and format characters dropped but for line ends and tabs, white space folded."""
    return strip(F.regexp_replace(F.regexp_replace(normalise_newlines(text), r"[\p{C}&&[^\n\t]]", ""), r"(?U)\s+", " "))


def suffix(filename: Column) -> Column:
    """lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(filename, r"[^./\\](\.[^./\\]*)$", 1))


def pdf_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, lines joined, hyphens at line ends closed."""
    raw = F.split(normalise_newlines(text), r"\n[ \t]*\n")

    def joined(paragraph: Column) -> Column:
        lines = F.filter(F.transform(F.split(paragraph, "\n"), strip), lambda x: x != "")
        text = F.aggregate(lines, F.lit(""), lambda a, b: F.when(a == "", b).when(F.endswith(a, F.lit("-")), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b)))
        return strip(F.regexp_replace(text, r"[ \t]+", " "))

    return F.filter(F.transform(raw, joined), lambda x: x != "")


def categories(value: Column) -> Column:
    """trimmed parts of a comma list, empty ones dropped."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def minutes(value: Column) -> Column:
    """the whole number before the minute sign, else null."""
    return F.when(F.contains(value, F.lit("分钟")), F.split_part(value, F.lit("分钟"), F.lit(1)).try_cast("int"))


def total_minutes(prep: Column, cook: Column) -> Column:
    """sum of two times in minutes, null unless both are."""
    return minutes(prep) + minutes(cook)


def difficulty_level(name: Column) -> Column:
    """1 to 5 stars, else 0."""
    table = F.create_map(*[F.lit(x) for k, s in enumerate(("一星", "二星", "三星", "四星", "五星"), 1) for x in (s, k)])
    return F.coalesce(table[name], F.lit(0))


def embedding_text(name: Column, *others: Column) -> Column:
    """name and other parts with spaces; null without a name."""
    return F.concat(name, *[F.concat(F.lit(" "), F.coalesce(x, F.lit(""))) for x in others])


def progress(start: int, end: int, current: Column, total: Column) -> Column:
    """start plus the whole share of the way to end."""
    return (F.lit(start) + F.floor(F.lit(end - start) * current / total)).cast("long")


def batch_numbers(df: DataFrame, order: str, size: int) -> DataFrame:
    """fixed-size batches by row number; numbered over range partitions, so no task takes all rows.

    The ranges are written once: counts and numbers must see the same ones, whatever adaptive execution makes of a plan.
    """
    from ..streaming.ingest import shared_folder

    spark, path = df.sparkSession, shared_folder(df.sparkSession, "batches")
    parted = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    parted.write.parquet(path)
    ranged = spark.read.schema(parted.schema).parquet(path)
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.__p") < F.col("a.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    numbered = ranged.withColumn("__r", local).join(F.broadcast(before), "__p")
    return numbered.withColumn("batch", F.floor((F.col("__r") + F.col("__before")) / size).cast("long")).select(*df.columns, "batch")


def projected_records(length: Column, most: int, overlap: int) -> Column:
    """bound on the segments of a text."""
    step = max(1, (most - overlap + 1) // 2)
    return F.when(length <= most, 1).otherwise(1 + F.floor((length - most + step - 1) / step)).cast("long")
