"""A stored keyword index with block bounds, so that a question reads the postings of its own terms and of promising blocks.

Segments are dealt by id hash into blocks of some `SPAN` segments. A posting row holds one term's ids in one block; rows are
stored by term bucket, sorted by term, so the folders and row groups of other terms are not opened. A segment shares at
most as many terms with a question as its block has posting rows for them: that is the block's bound, and it needs no
ids. `best_overlaps` takes blocks from the highest bound down until no bound left exceeds the largest overlap found, then
reads the ids of those blocks alone that may hold an overlap of `share` of it. The result equals that of a whole scan.

A term of any frequency is spread over the blocks, so no row or task holds a whole posting list. The bounds reach the driver as a
histogram (a row for each number of terms). Segments without keywords or with null ones are not in the index; repeated ids count once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 128
BUCKETS = 64
#: Blocks of the first round of the search for the largest overlap; each later round takes four times as many.
FIRST_BLOCKS = 64


@dataclass(frozen=True)
class KeywordIndex:
    path: str
    blocks: int
    postings: str

    def rows(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """term, block, ids of the terms: their buckets' folders alone."""
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        return spark.read.schema(self.postings).parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("term", "block", "ids")

    def block(self, ids: Column) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(self.blocks)).cast("int")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def build(segments: DataFrame, path: str) -> KeywordIndex:
    """Write the index of segments (id, keywords) below path."""
    blocks = max(1, -(-segments.count() // SPAN))
    kind = segments.schema["id"].dataType.simpleString()
    index = KeywordIndex(path, blocks, f"bucket int, term string, block int, ids array<{kind}>")
    pairs = segments.select("id", F.explode("keywords").alias("term")).where(F.col("term").isNotNull() & F.col("id").isNotNull())
    rows = pairs.groupBy("term", index.block(F.col("id")).alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = rows.select(_bucket(F.col("term")), "term", "block", "ids").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    segments.sparkSession.createDataFrame([(blocks, index.postings)], "blocks int, postings string").coalesce(1).write.parquet(f"{path}/model")
    return index


def load(spark: SparkSession, path: str) -> KeywordIndex:
    """The index that `build` wrote."""
    row = spark.read.parquet(f"{path}/model").first()
    return KeywordIndex(path, row["blocks"], row["postings"])


def _overlaps(rows: DataFrame) -> DataFrame:
    """id, shared: number of posting rows of each id."""
    return rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("shared"))


def _scored(shared: DataFrame, terms: list[str]) -> DataFrame:
    return shared.select("id", (F.col("shared") / F.lit(max(1, len(terms)))).alias("score"))


def best_overlaps(spark: SparkSession, index: KeywordIndex, terms: list[str], share: float) -> DataFrame:
    """id, score of every segment with at least share of the largest overlap; score: shared terms over terms, as `retrieval.keyword_hits`."""
    terms = list(dict.fromkeys(t for t in terms if t is not None))
    mine = index.rows(spark, terms)
    bounds = mine.groupBy("block").agg(F.count("*").alias("bound"))
    levels = sorted(((r["bound"], r["n"]) for r in bounds.groupBy("bound").agg(F.count("*").alias("n")).collect()), reverse=True)

    def of(level: int) -> DataFrame:
        return _overlaps(mine.join(bounds.where(F.col("bound") >= level), "block", "left_semi"))

    largest, at, room = 0, 0, FIRST_BLOCKS
    while at < len(levels) and levels[at][0] > largest:
        taken = levels[at][1]
        at += 1
        while at < len(levels) and levels[at][0] > largest and taken + levels[at][1] <= room:
            taken += levels[at][1]
            at += 1
        largest = of(levels[at - 1][0]).agg(F.coalesce(F.max("shared"), F.lit(0))).first()[0]
        room *= 4
    # a tiny slack keeps overlaps that equal the share but for rounding; the caller's threshold decides
    least = max(1, math.ceil(share * largest - 1e-9))
    return _scored(of(least).where(F.col("shared") >= least), terms)


def overlaps_of(index: KeywordIndex, terms: list[str], ids: DataFrame) -> DataFrame:
    """id, score of the given ids (few: those of a vector search) that share a term: their blocks alone are read."""
    terms = list(dict.fromkeys(t for t in terms if t is not None))
    asked = ids.select("id", index.block(F.col("id")).alias("block"))
    rows = index.rows(ids.sparkSession, terms).join(asked.select("block").distinct(), "block", "left_semi")
    return _scored(_overlaps(rows).join(asked.select("id"), "id", "left_semi"), terms)


def keyword_recall(spark: SparkSession, index: KeywordIndex, terms: list[str], mode: str, threshold: float, keyword_weight: float, semantic: DataFrame | None = None) -> DataFrame:
    """Keyword hits that suffice for `retrieval.fuse`: all whose keyword score alone can reach the threshold, and those of the vector hits.

    Fused scores divide by the largest overlap, so `share` is the threshold itself, or in hybrid mode the threshold over the keyword weight.
    """
    if mode != "hybrid":
        return best_overlaps(spark, index, terms, max(0.0, threshold))
    share = min(1.0, max(0.0, threshold / keyword_weight)) if keyword_weight > 0 else 1.0
    hits = best_overlaps(spark, index, terms, share)
    return hits if semantic is None else hits.unionByName(overlaps_of(index, terms, semantic)).dropDuplicates(["id"])
