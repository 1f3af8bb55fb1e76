"""Work and memory that must not grow faster than the input."""

import pytest
from marlstone import catalog
from marlstone.functions import identity, text
from marlstone.operators import cjk_words, keywords, segmentation
from marlstone.sources import files
from pyspark.sql import functions as F

from .conftest import DATA


@pytest.fixture
def wide_batches(spark):
    """The session's default Arrow batches of 10,000 rows and 64 MB."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    for name in names:
        spark.conf.unset(name)
    yield lambda: [int(spark.conf.get(n).rstrip("b")) for n in names]
    for name in names:
        spark.conf.unset(name)


def plan(df, step="executedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_keywords_are_counted_once_a_row(spark, wide_batches):
    rows = spark.createDataFrame([(1, "Graph graph a001 A001 the"), (2, ""), (3, None)], "id long, t string")
    kept = rows.select("id", F.array_join(keywords.ranked_terms(F.col("t")), ",").alias("k")).where("k <> ''")
    assert plan(kept).count("ArrowEvalPython") == 1
    assert [tuple(r) for r in kept.collect()] == [(1, "A001,graph")]
    assert wide_batches()[0] <= 1_000 and wide_batches()[1] <= 8 << 20


def test_rank_trace_reads_the_stored_index(spark):
    trace = catalog.QUERIES["w3_o3_rank_trace"](spark, DATA)
    assert "regexp_extract_all" not in plan(trace, "optimizedPlan")


def test_a_worker_holds_one_word_graph(spark):
    cutter = cjk_words.dictionary_cutter(spark.createDataFrame([("天地", 9), ("人", 3)], "word string, n long"))
    assert cutter() is cutter() and cutter()("人天地人") == ["人", "天地", "人"]


ODD = ["plain \"x\" \\ \n\t\b\f\r\nend\r", "é\r", "\x00\x01\x1f\x7f\x85", "é中 ", "", None]


def test_hashes_of_odd_texts_and_small_batches(spark, wide_batches):
    import hashlib

    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    got = {r.id: r.h for r in rows.select("id", identity.content_hash(F.col("t"), F.lit('{"b": 1, "a": "é"}')).alias("h")).collect()}
    assert got == {i: hashlib.sha256(identity.canonical_json({"content": t, "source_metadata": {"b": 1, "a": "é"}}).encode()).hexdigest() for i, t in enumerate(ODD)}
    assert wide_batches()[0] <= 1_000 and wide_batches()[1] <= 8 << 20


def test_normalised_texts_and_small_batches(spark, wide_batches):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    got = {r.id: r.n for r in rows.select("id", text.normalise_content(F.col("t")).alias("n")).collect()}
    assert got == {i: identity.normalised_json(t) for i, t in enumerate(ODD)}
    assert wide_batches()[0] <= 1_000 and wide_batches()[1] <= 8 << 20


def test_parsed_files_pass_in_arrow_batches(spark, wide_batches, monkeypatch):
    monkeypatch.setattr(files, "BATCH_ROWS", 2)
    rows = spark.createDataFrame([(1, "a.txt", b"x\n\ny\n\nz"), (2, "b.exe", b""), (3, "c.md", b"# T\n\np"), (4, None, None)], "id long, name string, content binary").coalesce(1)
    parsed = files.parse_files(rows, "id", "name")
    assert "MapInArrow" in plan(parsed)
    got = [(r.document_id, r.ord, r.text, r.error) for r in parsed.collect()]
    assert got == [("1", 0, "x", None), ("1", 1, "y", None), ("1", 2, "z", None), ("2", None, None, "UNSUPPORTED_FILE_TYPE"), ("3", 0, "T", None), ("3", 1, "p", None), ("4", None, None, "UNSUPPORTED_FILE_TYPE")]
    assert wide_batches()[0] <= 1_000


def test_segments_pass_in_small_batches(spark, wide_batches):
    rows = spark.createDataFrame([("a", "text", [(0, "paragraph", "x" * 30, "{}")])], "document_id string, source_type string, blocks array<struct<ord int, kind string, text string, meta string>>")
    found = segmentation.segment_documents(rows, segmentation.Config(max_length=20, overlap=0))
    assert "".join(r.content for r in found.orderBy("position").collect()) == "x" * 30
    assert wide_batches()[0] <= 1_000


def test_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from marlstone import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    rows = spark.range(950).selectExpr("id", "id % 400 AS k").coalesce(1)
    assert dealing.dealt(rows, "k").rdd.getNumPartitions() == 10 and sorted(r.id for r in dealing.dealt(rows, "k").collect()) == list(range(950))
    assert dealing.dealt(rows.limit(100), "k").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["p14_candidate_violations", "j8_legacy_segments", "j21_a13_d3_latest_revision", "p9_row_groups", "a21_m6_publish_decisions", "d3_revision_history"])
def test_tasks_of_large_tables_follow_their_rows(spark, duck, monkeypatch, name):
    """lineitem is dealt out by its number of rows, and the results stay."""
    from marlstone import dealing

    from .conftest import same_rows

    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(dealing, "TASK_ROWS", rows // 5)
    found = catalog.QUERIES[name](spark, DATA)
    assert "RepartitionByExpression" in plan(found, "optimizedPlan")
    same_rows(found, duck.sql(catalog.ORACLE_SQL[name]))


def test_trigrams_are_cut_after_rows_are_dealt(spark, monkeypatch):
    from marlstone.operators import substring_index

    seen = []
    monkeypatch.setattr(substring_index, "build_keywords", lambda rows, path: seen.append(rows))
    substring_index.build(spark.range(100).selectExpr("id", "cast(id AS string) AS name").coalesce(1), ("name",), "unused")
    assert seen[0].rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
