"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, token ids.

Every stage works on all that its predecessor kept and gets its input from Parquet. Rows are told apart by
id and text: with a null doc_id, or one that other texts share, they are judged by their text alone, a null-id
copy or leak goes like any other, and of rows that repeat both id and text one stays (rows without words
fail the quality rules). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from marlstone.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    measured = quality_rules.measure(docs)
    cutoffs = quality_rules.calibrate(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).where("kept").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return ngram_join.drop_near_duplicates(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and whether the ids decode to its text."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "text"), decoded=True)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_tokens", encode_tokens),
]

#: SQL can express neither the learnt cutoffs nor the token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
