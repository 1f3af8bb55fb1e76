from marlstone.operators import mentions as M
from pyspark.sql import functions as F

ENTITIES = [(1, "Ada"), (2, "ada lovelace"), (3, "Lovelace"), (4, "x"), (5, None), (6, "ADA"), (7, "žluťoučký"), (8, "a.b"), (9, "London"), (10, "")]
TEXTS = [(1, "Ada Lovelace in LONDON"), (2, "nothing"), (3, None), (4, ""), (5, "ŽLUŤOUČKÝ a.b axb"), (5, "canada"), (6, "x")]


def expected():
    return sorted({(k, e) for k, t in TEXTS for e, n in ENTITIES if t and n and len(n) >= 2 and n.lower() in t.lower()})


def run(spark):
    texts, entities = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(ENTITIES, "entity_id long, name string")
    return texts, entities, M.mentions(texts, entities)


def test_equals_contains_and_has_no_cross_join(spark):
    _, _, found = run(spark)
    assert sorted(map(tuple, found.collect())) == expected()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_CHARACTERS", 8)
    _, _, found = run(spark)
    assert sorted(map(tuple, found.collect())) == expected()


def test_empty_tables(spark):
    texts, entities, _ = run(spark)
    assert M.mentions(texts, entities.limit(0)).count() == 0 == M.mentions(texts.limit(0), entities).count()
    assert M.mentions(texts, entities.where(F.lit(False))).columns == ["id", "entity_id"]
