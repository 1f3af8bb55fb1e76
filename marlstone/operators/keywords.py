"""Keyword extraction and the inverted index."""

from __future__ import annotations

import importlib.util
import logging
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CJK, tokens
from ..shipping import bound_batches, ship_package

#: Words that are no keywords, and the bonus of identifiers.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with",
    "的", "了", "和", "是", "在", "有", "与", "及", "对", "为", "已", "将", "把", "被", "从", "到", "等", "属于", "需要",
)
IDENTIFIER_BONUS = 2
LONGEST = 255
DOCUMENT_LIMIT, QUERY_LIMIT = 15, 100
#: ASCII with at least one letter and one digit, as `functions.text.is_identifier`.
_IDENTIFIER = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])[A-Za-z0-9][A-Za-z0-9._-]*")
_STOPPED = frozenset(STOPWORDS)


def installed_cutter() -> Callable[[], Callable[[str], Iterable[str]]] | None:
    """Opens the dictionary cutter of CJK runs, once a task; None where its library isn't installed."""
    return _jieba if importlib.util.find_spec("jieba") else None


def _jieba() -> Callable[[str], Iterable[str]]:
    import jieba

    jieba.setLogLevel(logging.WARNING)
    own = jieba.Tokenizer()
    return lambda run: own.cut(run, HMM=False)


def cut_cjk(text: Column, open_cutter: Callable[[], Callable[[str], Iterable[str]]]) -> Column:
    """Text with a space between the dictionary words of its CJK runs; null stays null.

    Texts without such runs never leave the JVM's side of the plan as more than a null; the cutter sees whole runs only.
    """
    ship_package(SparkSession.active())
    bound_batches(SparkSession.active())
    runs = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "]+")

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter = open_cutter()
        for texts in parts:
            yield texts.map(lambda t: runs.sub(lambda m: " ".join(cutter(m[0])), t), na_action="ignore")

    has = text.rlike(f"[{CJK}]")
    return F.when(has, cut(F.when(has, text))).otherwise(text)


def leading_terms(found: Iterable[str], limit: int) -> list[str]:
    """A8/O8 for one text's tokens: the leading terms by frequency plus bonus, then by term; each distinct token is looked at once."""
    ranks: dict[str, int] = {}
    named: set[str] = set()
    for token, n in Counter(found).items():
        if _IDENTIFIER.fullmatch(token):
            term = token.upper()
            named.add(term)
        else:
            term = token.lower()
        ranks[term] = ranks.get(term, 0) + n
    order = ((-n - (IDENTIFIER_BONUS if t in named else 0), t) for t, n in ranks.items() if t not in _STOPPED and len(t) <= LONGEST)
    return [t for _, t in nsmallest(limit, order)]


def ranked_terms(text: Column, limit: int = DOCUMENT_LIMIT, open_cutter: Callable | None = None) -> Column:
    """The leading terms by frequency plus bonus, then by term; one row's own work, no shuffle.

    Spark cuts the tokens, Arrow batches count them. CJK runs are cut by open_cutter (installed_cutter() if none is given); without any, a run is one term.
    The counting is declared non-deterministic so that a filter on the keywords is not evaluated with a second count.
    """
    spark = SparkSession.active()
    ship_package(spark)
    bound_batches(spark)
    open_cutter = open_cutter or installed_cutter()
    if open_cutter:
        text = cut_cjk(text, open_cutter)

    @F.pandas_udf("array<string>")
    def leading(texts: pd.Series) -> pd.Series:
        return pd.Series([leading_terms(t.split("\n"), limit) if isinstance(t, str) and t else [] for t in texts], dtype="object")

    # no token holds a line end
    return leading.asNondeterministic()(F.array_join(tokens(text), "\n"))


def inverted_index(segments: DataFrame) -> DataFrame:
    """Term, id of every segment's keywords; written by term it answers overlap queries by an equi-join."""
    return segments.select("id", F.explode("keywords").alias("term"))


def overlap_candidates(index: DataFrame, query_terms: Column) -> DataFrame:
    """Id and number of distinct query terms of the segments that share at least one."""
    return index.where(F.array_contains(query_terms, F.col("term"))).groupBy("id").agg(F.countDistinct("term").alias("shared"))
