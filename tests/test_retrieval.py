import hashlib
import json
import uuid

import pytest
from marlstone.functions import identity, text
from marlstone.operators import keywords, providers, retrieval
from marlstone.operators.retrieval import Options
from pyspark.sql import functions as F


def terms(spark, value, limit):
    return spark.createDataFrame([(value,)], "t string").select(keywords.ranked_terms(F.col("t"), limit).alias("k")).first().k


@pytest.mark.parametrize(
    "value, limit, expected",
    [
        ("Graph graph GRAPH; a001 A001, b-02 B-02. SHIPPING shipping!", 4, ["A001", "B-02", "graph", "shipping"]),
        ("zeta beta alpha", 15, ["alpha", "beta", "zeta"]),
        ("invoice invoice graph retrieval", 15, ["invoice", "graph", "retrieval"]),
        ("delta gamma beta alpha", 2, ["alpha", "beta"]),
        ("X" * 256 + " bounded bounded", 5, ["bounded"]),
        ("the of and", 5, []), ("", 5, []), (None, 5, []), ("订单A001 发货", 5, ["A001", "发货", "订单"]),
    ],
)
def test_keywords(spark, value, limit, expected):
    assert terms(spark, value, limit) == expected


def tables(spark, segments):
    segs = spark.createDataFrame([(s[0], 1, 1, 1, s[1], s[2], s[3], s[4], s[5], False) for s in segments], "id string, document_id long, dataset_id long, dataset_index_id long, parent_id string, content string, keywords array<string>, index_type string, status string, deleted boolean")
    docs = spark.createDataFrame([(1, 1, "d", True, False, False)], "id long, dataset_id long, name string, enabled boolean, archived boolean, deleted boolean")
    return segs, docs, spark.createDataFrame([(1, 1, "active", False)], "id long, dataset_id long, status string, deleted boolean"), spark.createDataFrame([(1, False)], "id long, deleted boolean")


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, score double")


def test_hybrid_fusion(spark):
    t = tables(spark, [("seg1", None, "a", ["graph"], "general", "completed"), ("seg2", None, "b", ["graph"], "general", "completed")])
    vectors = hits(spark, ("seg1", 0.9), ("seg2", 0.1))
    got = retrieval.retrieve(*t, Options("hybrid", 5, 0.5), vectors, ["graph"]).collect()
    assert [(r.id, r.match_type, r.score) for r in got] == [("seg1", "hybrid", 1.0)]
    got = retrieval.retrieve(*t, Options("hybrid", 5, 0.0), vectors, ["graph"]).collect()
    assert [r.score for r in got] == [1.0, 0.377778]


def test_one_result_a_parent(spark):
    rows = [("p1", None, "parent one", None, "parent", "completed"), ("p2", None, "parent two", None, "parent", "indexing")]
    rows += [(f"child{k}", p, f"c{k}", [], "child", "completed") for k, p in ((1, "p1"), (2, "p1"), (3, "p2"), (4, "p2"))]
    t = tables(spark, rows)
    vectors = hits(spark, ("child1", 0.9), ("child2", 0.8), ("child3", 0.7), ("child4", 0.6))
    got = retrieval.retrieve(*t, Options("vector", 3, 0.1), vectors).collect()
    assert [(r.id, r.content) for r in got] == [("child1", "parent one"), ("child3", "c3"), ("child4", "c4")]
    assert [r.id for r in retrieval.retrieve(*t, Options("vector", 1, 0.1), vectors).collect()] == ["child1"]


def test_hidden_documents_still_scale_scores(spark):
    t = list(tables(spark, [("a", None, "a", [], "general", "completed"), ("b", None, "b", [], "general", "completed")]))
    t[0] = t[0].withColumn("document_id", F.when(F.col("id") == "a", 2).otherwise(1))
    got = retrieval.retrieve(*t, Options("hybrid", 5, 0.0), hits(spark, ("a", 0.8), ("b", 0.4))).collect()
    assert [(r.id, r.score) for r in got] == [("b", 0.35)]


def test_rerank_needs_every_score(spark):
    rows = hits(spark, ("a", 0.9), ("b", 0.8), ("c", 0.8))
    ranks = lambda r: [(x.id, x.after_rank) for x in retrieval.ranked(rows, r).orderBy("before_rank").collect()]
    assert ranks(None) == [("a", 1), ("b", 2), ("c", 3)] == ranks(hits(spark, ("c", 9.0)))
    assert ranks(hits(spark, ("a", 1.0), ("b", 2.0), ("c", 2.0))) == [("a", 3), ("b", 1), ("c", 2)]
    candidates = rows.withColumns({"content": F.col("id"), "before_rank": F.lit(1)})
    assert providers.rerank_scores(lambda q, t: [1.0], "q", candidates) is None

    def down(q, t):
        raise OSError

    assert providers.rerank_scores(down, "q", candidates) is None and providers.rerank_scores(lambda q, t: [3, 2, 1], "q", candidates).count() == 3


def test_vector_hits(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0, 0.0])], "id long, embedding array<float>")
    got = retrieval.vector_hits(v, [2.0, 0.0], 4).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 1.0), (5, 1.0), (4, 0.707107), (2, 0.0)]
    plan = retrieval.vector_hits(v, [2.0, 0.0], 4)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan


def test_identities(spark):
    row = spark.createDataFrame([('a"b\\c\nd', "p", 3, "h")], "d string, p string, n int, h string")
    got = row.select(identity.stable_segment_id(F.lit("i"), F.col("d"), F.lit(None).cast("string"), F.col("n"), F.col("h")).alias("x")).first().x
    name = json.dumps(["i", 'a"b\\c\nd', None, 3, "h"], ensure_ascii=False, separators=(",", ":"))
    assert got == uuid.uuid5(uuid.UUID(identity.SEGMENT_NAMESPACE), name).hex
    pair = spark.createDataFrame([("é\r\n", '{"b":1,"a":"\\r"}'), ("é\n", '{"a":"\\n","b":1}')], "c string, m string")
    hashes = {r[0] for r in pair.select(identity.content_hash(F.col("c"), F.col("m"))).collect()}
    assert hashes == {hashlib.sha256('{"content":"é\n","source_metadata":{"a":"\n","b":1}}'.replace("\n", "\\n").encode()).hexdigest()}
    for bad in (float("nan"), {1: 2}, {"é": 1, "é": 2}, object()):
        with pytest.raises((ValueError, TypeError)):
            identity.canonical_json(bad)
    folded = spark.createDataFrame([("Straße",)], "n string").select(identity.entity_id(F.lit("i"), F.col("n"))).first()[0]
    assert folded == hashlib.sha256("i\0strasse".encode()).hexdigest()


def test_text_functions(spark):
    df = spark.createDataFrame([("　 \x1f", "a/b\\c d?.TXT"), (" x\x1c", "..")], "a string, b string")
    got = df.select(text.is_blank(F.col("a")).alias("blank"), text.strip(F.col("a")).alias("s"), text.safe_filename(F.col("b")).alias("f"), text.suffix(F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, "", "c d_.TXT", ".txt"), (False, "x", "file", "")]


def test_embedding_client():
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise providers.ProviderError(503)
        if len(texts) > 2:
            raise providers.ProviderError(413)
        return [[float(len(t))] for t in texts]

    waits = []
    assert providers.embed_batch(provider, ["a", "bb", "ccc", "dddd"], waits.append) == [[1.0], [2.0], [3.0], [4.0]] and waits == [0.1]
    for answer in ([[1.0]], [[1.0], [1.0, 2.0]], [[float("nan")], [1.0]]):
        with pytest.raises(ValueError):
            providers.embed_batch(lambda t, a=answer: a, ["x", "y"])
    with pytest.raises(providers.ProviderError):
        providers.embed_batch(lambda t: (_ for _ in ()).throw(providers.ProviderError(400)), ["x"])
    with pytest.raises(ValueError):
        providers.vector_backend("other")
    assert providers.query_vector(lambda q: [[1.0, 2.0]], "q") == [1.0, 2.0]


def test_top_k_keeps_k_rows_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])], "id long, embedding array<double>").repartition(3)
    queries = vectors.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector")
    pairs = vectors.join(queries).selectExpr("query_id", "id", "embedding", "vector").select("query_id", "id", retrieval.clamp(F.coalesce(retrieval.cosine("embedding", "vector"), F.lit(0.0))).alias("score")).collect()
    expected = {(q, r.id, n, r.score) for q in (0, 20, 40, 60) for n, r in enumerate(sorted((p for p in pairs if p.query_id == q), key=lambda p: (-p.score, p.id))[:4], 1)}
    assert {(r.query_id, r.id, r["rank"], r.score) for r in retrieval.top_k_per_query(vectors, queries, 4).collect()} == expected


def test_every_20th_row_is_a_query_and_all_rows_are_numbered(spark):
    from marlstone import catalog

    from .conftest import DATA

    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    top = catalog.QUERIES["o1_top_k_every_20th"](spark, DATA)
    assert {r.query_id for r in top.select("query_id").distinct().collect()} == {r.vec_id for r in e.where("vec_id % 20 = 0").collect()}
    assert catalog.QUERIES["s22_t6_references_all"](spark, DATA).count() == e.count()


def test_dictionary_words_of_cjk_runs(spark):
    def open_cutter():
        words = ("知识", "图谱", "检索")

        def cut(run):
            at = 0
            while at < len(run):
                word = next((w for w in words if run.startswith(w, at)), run[at])
                yield word
                at += len(word)

        return cut

    rows = spark.createDataFrame([(1, "知识图谱检索abc知识 X-1"), (2, "plain words"), (3, None), (4, "")], "id long, t string")
    got = {r.id: r.k for r in rows.select("id", keywords.ranked_terms(F.col("t"), 10, open_cutter).alias("k")).collect()}
    assert got == {1: ["X-1", "知识", "abc", "图谱", "检索"], 2: ["plain", "words"], 3: [], 4: []}
