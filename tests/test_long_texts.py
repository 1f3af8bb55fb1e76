import random

import pytest
from marlstone.operators import long_texts as L
from marlstone.operators.segmentation import Block, Config, SegmentationError, segment
from pyspark.sql import functions as F

BIG = (10**9, 10**9, 10**12, 10**15)


def random_text(seed, n):
    """Words, blank stretches, long runs without a boundary, characters of one to four bytes."""
    r = random.Random(seed)
    out, size = [], 0
    while size < n:
        piece = r.choice([lambda: "word ", lambda: "é", lambda: "\n\n", lambda: "\n", lambda: "。", lambda: "a. B", lambda: "𝔘" * r.randint(1, 90), lambda: " \t　" * r.randint(1, 40), lambda: "x" * r.randint(1, 200), lambda: "||", lambda: "\x1c\x85"])()
        out.append(piece)
        size += len(piece)
    return "".join(out)


def expected(texts, config):
    rows = []
    for k, text in texts:
        found, _ = segment([Block(text or "")], config, budgets=BIG)
        rows += [(k, s["position"], s["content"]) for s in found]
    return sorted(rows)


@pytest.mark.parametrize("config", [Config(max_length=50, overlap=10), Config(max_length=41, overlap=0, separator="||"), Config(max_length=30, overlap=29, separator=None), Config(max_length=1, overlap=0)])
def test_equals_the_sequential_cuts(spark, config):
    texts = [(k, random_text(k, 40 * k)) for k in range(40)]
    texts += [(100, None), (101, ""), (102, " \n" * 300), (103, "z" * 1000), (104, "y" * 64), (105, "y" * 65), (106, " " * 64 + "end"), (107, "\n\n" * 100 + "w")]
    table = spark.createDataFrame(texts, "document_id long, text string").withColumn("content", F.lit("other"))
    rows = L.cut_texts(table, config, stretch=64).collect()
    assert sorted((r.document_id, r.position, r.content) for r in rows) == expected(texts, config)
    whole = dict(texts)
    assert all(whole[r.document_id][r.start : r.end] == r.content for r in rows)


@pytest.mark.parametrize("seed", range(20))
def test_cut_function_of_every_place(seed):
    """Each place of a text, not only those that are reached."""
    text, config = random_text(seed, 400), Config(max_length=37, overlap=seed % 5)
    cuts = L.cuts_of(text, len(text), config, len(text))
    for at in range(len(text)):
        start, end = next(L.Cutter(config.separator).ranges(text[at:], config.max_length, config.overlap))
        assert (start, end + at) == (0, cuts.ends[at]) and cuts.shown[at] == bool(text[at : at + end].strip())


def test_one_text_takes_several_tasks(spark):
    text = random_text(5, 3_000_000)
    table = spark.createDataFrame([("a", text)], "document_id string, text string")
    found = L.cut_texts(table, Config()).cache()
    assert sorted((r.document_id, r.position, r.content) for r in found.select("document_id", "position", "content").collect()) == expected([("a", text)], Config())
    parts = L._dealt(table.withColumn("n", F.length("text").cast("long")), L.STRETCH, 1024).repartition(4, "document_id", "k")
    assert parts.select(F.spark_partition_id()).distinct().count() == 4
    found.unpersist()


def test_empty_table_and_refused_settings(spark):
    none = spark.createDataFrame([], "document_id long, text string")
    assert L.cut_texts(none, Config()).collect() == []
    with pytest.raises(SegmentationError):
        L.cut_texts(none, Config(mode="parent_child"))
    with pytest.raises(SegmentationError):
        L.cut_texts(none, Config(), stretch=1000)
