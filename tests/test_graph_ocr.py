from marlstone.operators import graph as G
from marlstone.operators import ocr as O

LINE = "doc long, page long, ord long, text string, confidence double, box array<array<double>>"


def box(top, bottom):
    return [[0.0, top], [9.0, bottom]]


def test_ocr_page(spark):
    lines = spark.createDataFrame([(1, 1, 0, "第一行", 0.98, box(0.0, 10.0)), (1, 1, 1, "第二行", 0.96, box(12.0, 22.0)), (1, 1, 2, "噪声!!!", 0.2, None), (1, 1, 3, "...！", 0.9, None), (1, 1, 4, " \x07 ", 0.9, None), (1, 1, 5, "far", 0.9, box(60.0, 70.0))], LINE)
    kept = O.kept_lines(lines, lines.limit(0))
    got = [(r.paragraph, r.text, r.confidence, r.boxes) for r in O.paragraphs(kept).orderBy("paragraph").collect()]
    assert got == [(0, "第一行 第二行", 0.97, 2), (1, "far", 0.9, 1)]


def test_furniture(spark):
    rows = [(1, p, k, t, 0.9, box(*b)) for p in (1, 2) for k, t, b in ((0, "Head", (0.0, 8.0)), (1, f"body {p}", (40.0, 50.0)), (2, "Head", (60.0, 64.0)))]
    lines = spark.createDataFrame(rows, LINE)
    heights = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0)], "doc long, page long, height double")
    repeated = O.repeated_furniture(lines, heights)
    assert sorted(map(tuple, repeated.collect())) == [(1, 1, "Head"), (1, 2, "Head")]
    assert [r.text for r in O.kept_lines(lines, repeated).orderBy("page", "ord").collect()] == ["body 1", "body 2"]


def test_adapter_and_warnings(spark):
    raw = spark.createDataFrame([(1, 1, 0, "a", 1.7, None), (1, 1, 1, "b", float("nan"), None), (1, 1, 2, None, 0.5, None), (1, 1, 3, "c", -1.0, [[float("inf"), 1.0]])], LINE)
    assert [(r.text, r.confidence) for r in O.adapt_lines(raw).collect()] == [("a", 1.0)]
    w = spark.createDataFrame([("d", k, "W", None) for k in range(4)] + [("d", 9, "WARNINGS_TRUNCATED", 5), ("e", 0, "W", None)], "doc string, ord long, code string, omitted long")
    assert [(r.doc, r.code, r.omitted) for r in O.bounded_warnings(w, 3).orderBy("doc", "ord").collect()] == [("d", "W", None), ("d", "W", None), ("d", "WARNINGS_TRUNCATED", 7), ("e", "W", None)]


def test_extraction_and_search(spark):
    entity = "struct<name:string,type:string,attributes:map<string,string>>"
    payload = spark.createDataFrame(
        [("s", "Die STRASSE in Rom", [("Straße", "place", {" a ": " 1 ", "b": ""}), ("Rom", "city", None), ("Rom", "again", None), ("Paris", "city", None), ("in", " ", None)], [("Straße", "Rom", "in"), ("Rom", "Paris", "to"), ("Straße", "Rom", " in ")])],
        f"segment_id string, text string, entities array<{entity}>, relations array<struct<source:string,target:string,type:string>>",
    )
    e = G.grounded_entities(payload)
    assert [(r.name, r.type) for r in e.orderBy("ord").collect()] == [("Straße", "place"), ("Rom", "city")]
    assert [tuple(x) for x in e.orderBy("ord").first().attributes] == [("a", "1")]
    assert [tuple(r) for r in G.valid_relations(payload, e).collect()] == [("s", "Straße", "Rom", "in")]


def test_graph_updates(spark):
    mention = lambda *rows: spark.createDataFrame(list(rows), "segment_id string, entity_id string")
    none = spark.createDataFrame([], "segment_id string, source_id string, target_id string, type string")
    entities = spark.createDataFrame([("e1", "A", "t"), ("e2", "B", "t")], "entity_id string, name string, type string")
    old = {"segments": mention(("s1", "e1")).select("segment_id"), "mentions": mention(("s1", "e1"), ("s1", "e2")), "related": none, "entities": entities}
    new = {"segments": old["segments"], "mentions": mention(("s1", "e2"), ("s1", "e3")), "related": none, "entities": spark.createDataFrame([("e2", "B2", "t"), ("e3", "C", "t")], entities.schema)}
    out = G.upsert_facts(old, new)
    assert sorted((r.entity_id, r.name) for r in out["entities"].collect()) == [("e2", "B2"), ("e3", "C")] and out["mentions"].count() == 2
    hops = G.graph_hits(spark.createDataFrame([("a",)], "entity_id string"), spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "d")], "source_id string, target_id string"), mention(("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("1", "b")))
    assert sorted((r.id, r.score) for r in hops.collect()) == [("1", 1.0), ("2", 1.0), ("3", 1.0)]
