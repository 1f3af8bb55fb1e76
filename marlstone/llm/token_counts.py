"""Token counts through a digest cache.

A cache is a Parquet folder of (digest, tokenizer, n_tokens): the SHA-256 of the normalised
content and that of the tokenizer's file. Counting joins the documents' digests with the
cache, encodes one text for each digest that it lacks, appends these counts to the cache,
and joins again. Texts are shuffled once, after copies are combined on the map side;
afterwards only digests move. Spark commits appends as whole files, so a lost
executor leaves no half-written counts, and two writers at most store a count twice.

Defined cases: null text is the empty text (0 tokens); repeated rows give repeated results;
texts are counted whole, with the library's default treatment of special strings.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .common import scratch_dir

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Bytes of text handed to the library at once.
BATCH_BYTES = 2_000_000

_COUNTERS: dict = {}


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    """A function from texts to counts, with the library that the file belongs to."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _COUNTERS[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _COUNTERS[path]


def normalised(text_col: str):
    """The content that is digested and counted: null as the empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """digest, tokenizer, n_tokens of rows (digest, content)."""
    ship_package(misses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts, counts, start, size = batch.column("content").to_pylist(), [], 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_BYTES or k + 1 == len(texts):
                    counts += count(texts[start : k + 1])
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=CACHE_SCHEMA.names)

    return misses.select("digest", "content").mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark, cache_dir: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty where there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache_dir: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes, n_tokens of every row; new counts are appended to cache_dir.

    Without cache_dir a fresh cache in the shared scratch folder is used.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    cache_dir = cache_dir or scratch_dir(spark, "token-counts")
    content = normalised(text_col)
    digested = docs.select(*keep, content.alias("content"), F.unhex(F.sha2(content, 256)).alias("digest"))
    # one text a digest, combined before the shuffle
    distinct = digested.select("digest", "content").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache_dir, version), "digest", "left_anti")
    encode_misses(misses, path, version).write.mode("append").parquet(cache_dir)
    rows = digested.select(*keep, "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return rows.join(read_cache(spark, cache_dir, version), "digest").select(*keep, "n_bytes", "n_tokens")
