from datetime import datetime

from marlstone.operators import jobs as J
from marlstone.operators import rollups as R
from marlstone.operators import versioning as V
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def kb(spark, datasets, docs=(), segments=(), indexes=(), jobs=()):
    return (
        spark.createDataFrame([(d, False) for d in datasets] + [("gone", True)], "id string, deleted boolean"),
        spark.createDataFrame([(i, d, s, e, a, x) for i, d, s, e, a, x in docs], "id string, dataset_id string, indexing_status string, enabled boolean, archived boolean, deleted boolean"),
        spark.createDataFrame(list(segments), "id string, document_id string, dataset_id string, dataset_index_id string, status string, embedding_status string, deleted boolean"),
        spark.createDataFrame(list(indexes), "id string, dataset_id string, status string, deleted boolean"),
        spark.createDataFrame(list(jobs), "id string, dataset_id string, status string, created_at timestamp"),
    )


def test_stats_of_five_datasets(spark):
    docs = [("d1", "waiting", "waiting", True, False, False), ("d2", "busy", "embedding", True, False, False), ("d3", "failed", "error", True, False, False), ("d4", "ready", "completed", True, False, False)]
    tables = kb(spark, ["empty", "waiting", "busy", "failed", "ready"], docs, [("s", "d4", "ready", None, "completed", "not_required", False)])
    assert R.stats(R.summaries(*tables)).first().asDict() == {"total": 5, "ready": 1, "indexing": 1, "draft": 2, "failed": 1, "documents": 4, "chunks": 1}
    assert set(R.stats(R.summaries(*kb(spark, [])).limit(0)).first()) == {0}


def test_usable_chunks(spark):
    docs = [("live", "k", "completed", True, False, False), ("off", "k", "completed", False, False, False), ("old", "k", "completed", True, True, False), ("gone", "k", "completed", True, False, True), ("raw", "k", "waiting", True, False, False)]
    rows = [(f"{d}-{i}", d, "k", i, "completed", "completed", False) for d in ("live", "off", "old", "gone", "raw") for i in (None, "act", "new")]
    rows += [("x", "live", "k", "act", "indexing", "completed", False), ("y", "live", "k", "act", "completed", "waiting", False), ("z", "live", "k", "act", "completed", "completed", True)]
    tables = kb(spark, ["k"], docs, rows, [("act", "k", "active", False), ("new", "k", "building", False)])
    row = R.summaries(*tables).first()
    assert (row.document_count, row.chunk_count, row.status) == (4, 3, "ready")


def test_only_the_latest_job_fails_a_dataset(spark):
    day = lambda k: datetime(2024, 1, k)
    jobs = [("1", "a", "failed", day(1)), ("2", "a", "completed", day(2)), ("1", "b", "completed", day(1)), ("2", "b", "partial_success", day(2)), ("1", "c", "queued", day(1)), ("2", "c", "failed", day(1))]
    got = {r.dataset_id: r.status for r in R.summaries(*kb(spark, ["a", "b", "c"], jobs=jobs)).collect()}
    assert got == {"a": "draft", "b": "failed", "c": "indexing"}


def publish(spark, statuses, segments, technique="economy"):
    jobs = spark.createDataFrame([("j", technique)], "id string, technique string")
    rows = spark.createDataFrame([("j", f"d{k}", s) for k, s in enumerate(statuses)], "job_id string, document_id string, status string")
    segs = spark.createDataFrame([("j", d, s, t, e) for d, s, t, e in segments], "job_id string, document_id string, status string, index_type string, embedding_status string")
    return V.publish_decisions(jobs, rows, segs).first().decision


def test_publish_decisions(spark):
    ready = [("d0", "indexing", "general", "not_required"), ("d1", "indexing", "general", "not_required")]
    assert publish(spark, ["completed", "completed"], ready) == "publish"
    assert publish(spark, ["completed", "running"], ready) == "wait" == publish(spark, [], [])
    assert publish(spark, ["completed", "failed"], ready) == "failed" and publish(spark, ["cancelled", "cancelled"], []) == "cancelled"
    assert publish(spark, ["completed", "completed"], ready[:1]) == "invalid" == publish(spark, ["completed", "completed"], ready, "high_quality")
    nested = [("d0", "indexing", "parent", "not_required"), ("d0", "indexing", "child", "completed")]
    assert publish(spark, ["completed"], nested, "high_quality") == "publish"


def test_switch_and_increment(spark):
    indexes = spark.createDataFrame([("old", "k", "active", False), ("new", "k", "building", False), ("other", "m", "active", False)], "id string, dataset_id string, status string, deleted boolean")
    after = V.switch_indexes(indexes, indexes.where("id = 'new'").select("id", "dataset_id"))
    assert {r.id: r.status for r in after.collect()} == {"old": "retired", "new": "active", "other": "active"} and V.active_index_violations(after).count() == 0
    segs = spark.createDataFrame([("a", "d", "completed", 1, False), ("b", "d", "indexing", 2, False), ("c", "e", "completed", 1, False), ("x", "d", "indexing", 3, False)], "id string, document_id string, status string, job_id long, deleted boolean")
    docs = segs.where("id = 'a'").select("document_id")
    once = V.publish_increment(segs, 2, docs)
    assert {r.id: (r.status, r.deleted) for r in once.collect()} == {"a": ("completed", True), "b": ("completed", False), "c": ("completed", False), "x": ("indexing", False)}


def test_upsert_and_keywords(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, seq long")
    assert sorted(map(tuple, V.upsert(old, new).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    segs = spark.createDataFrame([(1, "general", "indexing", None), (2, "parent", "indexing", None), (3, "child", "completed", ["o"]), (4, "child", "indexing", ["o"])], "id long, index_type string, status string, keywords array<string>")
    updates = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"]), (4, ["x" * 256])], "id long, keywords array<string>")
    assert {r.id: r.keywords for r in V.update_keywords(segs, updates).collect()} == {1: ["a"], 2: None, 3: ["o"], 4: ["o"]}


def test_revision_rules(spark):
    rows = [("ok", 0, "p", "x", "parent", None), ("ok", 1, "c", "x", "child", "p"), ("late", 0, "c", "x", "child", "p"), ("late", 1, "p", "x", "parent", None), ("mix", 0, "g", "x", "general", None), ("mix", 1, "p", " ", "parent", None), ("dup", 0, "a", "x", "general", None), ("dup", 1, "a", "x", "general", "a")]
    items = spark.createDataFrame(rows, "document_id string, ord int, id string, content string, index_type string, parent_id string")
    got = {(r.document_id, r.rule) for r in V.revision_violations(items).collect()}
    assert got == {("late", "child_without_parent"), ("mix", "mixed_types"), ("mix", "blank_content"), ("mix", "parent_without_child"), ("dup", "duplicate_id"), ("dup", "parent_on_other")}


def rows(spark, *values):
    return spark.createDataFrame([(*v, "x", 0) for v in values], "id long, document_id long, status string, attempts int, due_at timestamp, lease_expires_at timestamp, worker_id string, error_code string, stage string, progress int")


def test_lease_life_cycle(spark):
    now, early, late = F.lit("2024-01-01 12:00:00").cast("timestamp"), datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 13)
    table = rows(spark, (1, 1, "pending", 0, None, None, None, None), (2, 1, "retry_wait", 1, late, None, None, None), (3, 1, "running", 1, None, early, "a", None), (4, 1, "running", 1, None, late, "a", None), (5, 9, "queued", 0, early, None, None, None), (6, 1, "completed", 1, early, early, "a", None))
    live = spark.createDataFrame([(1,)], "id long")
    taken = J.claim(table, live, now, "w")
    assert {r.id for r in taken.where("worker_id = 'w' and status = 'running'").collect()} == {1, 3}
    failed = {r.id: (r.status, r.due_at) for r in J.fail(taken, "w", now, "E").collect()}
    assert failed[1] == ("retry_wait", datetime(2024, 1, 1, 12, 0, 30)) and failed[3] == ("retry_wait", datetime(2024, 1, 1, 12, 2)) and failed[4][0] == "running"
    assert J.fail(taken, "w", now, "E", retryable=False).where("status = 'failed'").count() == 2
    assert {r.id: r.status for r in J.recover(table, now).collect()} == {3: "retry_wait"}
    back = {r.id: (r.status, r.attempts) for r in J.release(taken, "w", now).collect()}
    assert back[1] == ("pending", 0) and back[3] == ("pending", 1)
    beats = spark.createDataFrame([(1, "w", "parse", 40), (3, "other", "parse", 40)], "id long, worker_id string, stage string, progress int")
    ahead = {r.id: (r.stage, r.progress) for r in J.heartbeat(taken, beats, now).collect()}
    assert ahead[1] == ("parse", 40) and ahead[3] == ("x", 0)
    once = J.heartbeat(taken, beats, now)
    assert J.heartbeat(once, beats.withColumns({"progress": F.lit(10), "stage": F.lit("split")}), now).where("id = 1").first().stage == "parse" and J.heartbeat(once, beats.withColumn("progress", F.lit(10)), now).where("id = 1").first().progress == 40


def test_plans_push_filters_and_avoid_python(spark):
    import marlstone.plans.model as M
    from .conftest import DATA

    plan = R.summaries(M.datasets(spark, DATA), M.documents(spark, DATA), M.segments(spark, DATA), M.indexes(spark, DATA), M.jobs(spark, DATA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "PushedFilters: [IsNotNull" in plan
