import random
import re

import pytest
from marlstone.operators import keyword_index as K
from marlstone.operators import retrieval as R
from pyspark.sql import functions as F


def segments(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"s{k}", rng.sample(words, rng.randint(0, 8)) + (["common"] if k % 2 else [])) for k in range(n)]
    rows += [("best", [f"w{k}" for k in range(12)]), ("none", None), ("empty", []), ("s1", rows[1][1])]
    return spark.createDataFrame(rows, "id string, keywords array<string>")


TERMS = [f"w{k}" for k in range(12)] + ["common", "absent", "w3"]


def exact(segs, terms):
    return {r.id: round(r.score, 12) for r in R.keyword_hits(segs.where("keywords IS NOT NULL"), list(dict.fromkeys(terms))).dropDuplicates(["id"]).collect()}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_equals_the_scan_at_every_share(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(K, "SPAN", 16)
    monkeypatch.setattr(K, "FIRST_BLOCKS", 2)
    segs = segments(spark, 400)
    index = K.load(spark, K.build(segs, f"{tmp_path}/index").path)
    scores = exact(segs, TERMS)
    got = {r.id: round(r.score, 12) for r in K.best_overlaps(spark, index, TERMS, share).collect()}
    assert got == {i: s for i, s in scores.items() if s >= share * max(scores.values()) - 1e-9} and "best" in got


def test_reads_only_the_terms_folders_and_promising_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SPAN", 4)
    index = K.build(segments(spark, 400), f"{tmp_path}/index")
    plan = index.rows(spark, ["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"bucket#\d+ IN \(", plan) and "PushedFilters: [In(term, [w1,w2])]" in plan
    rows = index.rows(spark, TERMS)
    bounds = rows.groupBy("block").agg(F.count("*").alias("n"))
    assert bounds.where("n >= 10").count() < bounds.count() / 2


def test_given_ids_unknown_terms_and_an_empty_index(spark, tmp_path):
    segs = segments(spark, 100)
    index = K.build(segs, f"{tmp_path}/index")
    ids = spark.createDataFrame([("best",), ("s1",), ("none",), ("unknown",)], "id string")
    scores = exact(segs, TERMS)
    assert {r.id: round(r.score, 12) for r in K.overlaps_of(index, TERMS, ids).collect()} == {i: scores[i] for i in ("best", "s1") if i in scores}
    assert K.best_overlaps(spark, index, ["absent"], 0.3).count() == 0 == K.best_overlaps(spark, index, [], 0.3).count()
    empty = K.build(segs.limit(0), f"{tmp_path}/none")
    assert K.best_overlaps(spark, empty, TERMS, 0.3).count() == 0


def test_hybrid_recall_suffices_for_fusion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SPAN", 16)
    segs = segments(spark, 300).dropDuplicates(["id"])
    index = K.build(segs, f"{tmp_path}/index")
    semantic = spark.createDataFrame([(f"s{k}", 0.4 + k / 1000) for k in range(0, 40, 2)], "id string, score double")
    options = R.Options("hybrid", 5, 0.25)
    whole = R.fuse(semantic, R.keyword_hits(segs, list(dict.fromkeys(TERMS))), None, segs.select("id"), options)
    some = R.fuse(semantic, K.keyword_recall(spark, index, TERMS, "hybrid", 0.25, 0.3, semantic), None, segs.select("id"), options)
    rows = lambda df: sorted((r.id, round(r.score, 12), r.match_type) for r in df.collect())
    assert rows(some) == rows(whole) and len(rows(whole)) > 20
