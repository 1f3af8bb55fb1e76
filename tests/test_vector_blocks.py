import numpy as np
import pyarrow as pa
from marlstone.operators import retrieval
from marlstone.operators import vector_blocks as B


def pack(rows, size=7, kind=pa.int64()):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["id", "v"])
    return [B.Side(b.column(0)[0].values, b.column(1)[0].as_py(), b.column(2)[0].as_buffer()) for b in B.packed([batch], size)]


def score(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    dot, n, m = 0.0, 0.0, 0.0
    for x, y in zip(a, b):
        dot, n, m = dot + x * y, n + y * y, m + x * x
    over = float(np.sqrt(n) * np.sqrt(m))
    return 0.0 if over == 0 else float(max(0.0, min(1.0, dot / over)))


def test_a_task_keeps_k_rows_a_query_and_equals_brute_force():
    rng = np.random.default_rng(3)
    rows = [(f"r{i:04d}", rng.normal(size=9).tolist()) for i in range(300)]
    rows += [(f"copy{i:02d}", rows[5][1]) for i in range(40)] + [("none", None), ("hole", [1.0, None]), ("zero", [0.0] * 9), ("short", [1.0, 2.0])]
    queries = [r for i, r in enumerate(rows) if i % 20 == 0 or i > 338]
    found = {}
    for q in pack(queries, 11, pa.string()):
        best = B.Leading(q, 6, pa.string())
        for side in pack(rows, 64, pa.string()):
            best.show(side)
            assert best.best.num_rows <= 6 * len(q.ids)
        for batch in best.rows():
            for r in batch.to_pylist():
                found.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for name, v in queries:
        assert found[name] == sorted(((i, score(v, w)) for i, w in rows), key=lambda x: (-x[1], x[0]))[:6]


def test_search_holds_packed_blocks_not_rows(spark):
    """Every pair of blocks is one row of the product, however many vectors and queries there are."""
    rows = spark.range(4000).selectExpr("id", "array(cast(id % 7 AS double), cast(id % 11 AS double), cast(1 AS double)) AS embedding").coalesce(1)
    queries = rows.where("id % 500 = 0").selectExpr("id AS query_id", "embedding AS vector")
    top = retrieval.top_k_per_query(rows, queries, 3)
    assert "MapInArrow" in top._jdf.queryExecution().optimizedPlan().toString()
    assert {r["count"] for r in top.groupBy("query_id").count().collect()} == {3}
