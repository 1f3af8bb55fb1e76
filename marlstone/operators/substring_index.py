"""P2 by an index: case-insensitive substring search through stored trigrams, then the exact pattern.

The trigrams of each row's texts, in small letters, are the keywords of a `keyword_index`. A pattern's literal stretches (between
the wildcards % and _, a backslash takes the next character as it is) give trigrams that every match must have: only blocks that hold all
of them are read, rows that lack one fall out, and ILIKE decides on the few that are left. A pattern without a stretch of
three characters has no trigrams; it scans the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword_index import KeywordIndex, build as build_keywords
from .keyword_index import _overlaps

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in small letters; none where it is null or shorter."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))), F.array().cast("array<string>"))


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that every text like %pattern% has."""
    stretches, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            stretches[-1] += pattern[at]
        elif c in "%_":
            stretches.append("")
        else:
            stretches[-1] += c
        at += 1
    low = [s.lower() for s in stretches]
    return list(dict.fromkeys(s[k : k + GRAM] for s in low for k in range(len(s) - GRAM + 1)))


def build(rows: DataFrame, columns: tuple[str, ...], path: str) -> KeywordIndex:
    """Write the trigrams of the columns of rows (id and them) below path."""
    # a small file may hold very many rows in one split: they are dealt out before the trigrams are cut
    rows = rows.select("id", *columns).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id")
    return build_keywords(rows.select("id", F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns]))).alias("keywords")), path)


def candidates(index: KeywordIndex, rows: DataFrame, pattern: str) -> DataFrame:
    """The rows that may match: those with all trigrams of the pattern, or all rows where it has none."""
    wanted = pattern_grams(pattern)
    if not wanted:
        return rows
    mine = index.rows(rows.sparkSession, wanted)
    whole = mine.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("block")
    ids = _overlaps(mine.join(whole, "block", "left_semi")).where(F.col("shared") == len(wanted)).select("id")
    return rows.join(ids, "id", "left_semi")


def search(index: KeywordIndex, rows: DataFrame, columns: tuple[str, ...], pattern: str) -> DataFrame:
    """Rows with a column like %pattern% in any case."""
    fits = F.lit(False)
    for c in columns:
        fits = fits | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return candidates(index, rows, pattern).where(fits)
