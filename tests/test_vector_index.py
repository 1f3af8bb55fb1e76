import os

import numpy as np
import pytest
from marlstone.operators import retrieval as R
from marlstone.operators import vector_index as V
from pyspark.sql import functions as F

from .conftest import DATA


def search_both(spark, tmp_path, rows, queries, k=10, **options):
    index = V.build(V.fit(rows), rows, f"{tmp_path}/index")
    found = V.search(index, rows, queries, k, **options).collect()
    exact = R.top_k_per_query(rows, queries, k).collect()
    return index, found, exact


def recall(found, exact):
    pairs = {(r.query_id, r.id) for r in found}
    return sum((r.query_id, r.id) in pairs for r in exact) / len(exact)


def clustered(spark, n, dims=16, centres=60, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    data = middle[rng.integers(centres, size=n)] + 0.25 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "id long, embedding array<double>")


def test_recall_on_the_whole_table(spark, tmp_path):
    e = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    _, found, exact = search_both(spark, tmp_path, rows, queries)
    assert recall(found, exact) >= 0.95
    scores = {(r.query_id, r.id): r.score for r in exact}
    assert all(r.score == scores[r.query_id, r.id] for r in found if (r.query_id, r.id) in scores)


def test_clustered_vectors_are_found_in_few_lists(spark, tmp_path):
    rows = clustered(spark, 6_000)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index, found, exact = search_both(spark, tmp_path, rows, queries)
    assert recall(found, exact) >= 0.95
    sizes = {r["list"]: r.n for r in spark.read.parquet(f"{tmp_path}/index/blocks").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect()}
    assert sum(sizes.values()) == 6_000
    units = index.units(np.array([r.vector for r in queries.collect()]))
    read = index.visited(units) @ np.array([sizes.get(k, 0) for k in range(len(index.centroids))])
    assert read.mean() < 600


def test_persisted_and_appended(spark, tmp_path):
    rows = clustered(spark, 800)
    index = V.build(V.fit(rows.where("id < 700")), rows.where("id < 700"), f"{tmp_path}/index")
    again = V.load(spark, f"{tmp_path}/index")
    assert np.array_equal(again.centroids, index.centroids) and again.visits == index.visits
    V.append(again, rows.where("id >= 700"))
    queries = rows.where("id >= 790").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    best = V.search(again, rows, queries, 1).collect()
    assert sorted((r.query_id, r.id) for r in best) == [(k, k) for k in range(790, 800)] and os.path.isdir(f"{tmp_path}/index/blocks")


def test_small_groups_and_early_hand_over_change_nothing(spark, monkeypatch, tmp_path):
    rows = clustered(spark, 500)
    queries = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = V.build(V.fit(rows), rows, f"{tmp_path}/index")
    first = sorted(map(tuple, V.search(index, rows, queries, 5).collect()))
    monkeypatch.setattr(V, "GROUP_QUERIES", 7)
    assert sorted(map(tuple, V.search(index, rows, queries, 5).collect())) == first


def test_nulls_zeros_repeats_empty_and_wrong_sizes(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    index, found, _ = search_both(spark, tmp_path, rows, queries, 5)
    assert [(r.id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 9] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert {r.score for r in found if r.query_id == 8} == {0.0}
    assert V.search(index, rows, queries.limit(0), 5).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        V.search(index, rows, spark.createDataFrame([(1, [1.0])], queries.schema), 5).count()
    empty = V.build(V.fit(rows.limit(0)), rows.limit(0), f"{tmp_path}/none")
    assert V.search(empty, rows.limit(0), queries.where("false"), 5).count() == 0
