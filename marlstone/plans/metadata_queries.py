"""Queries over the metadata tables, each with an independent SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dealing import dealt
from ..operators import jobs as J
from ..operators import rollups as R
from ..operators import versioning as V
from . import model as M

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query and its oracle; sql may use the CTEs of the model."""

    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {M.MODEL_SQL} {sql}"
        return f

    return add


NOW = "TIMESTAMP '2000-06-01 00:00:00'"


def now():
    return F.lit("2000-06-01 00:00:00").cast("timestamp")


SUMMARY_SQL = """, dc AS (
  SELECT dataset_id, count(id) AS n, max(CASE WHEN enabled AND NOT archived AND indexing_status = 'indexing' THEN 1 ELSE 0 END) AS busy,
    max(CASE WHEN enabled AND NOT archived AND indexing_status = 'failed' THEN 1 ELSE 0 END) AS bad FROM docs WHERE NOT deleted GROUP BY 1),
sc AS (
  SELECT s.dataset_id, count(*) AS n FROM segments s JOIN docs d ON d.id = s.document_id AND d.dataset_id = s.dataset_id
  LEFT JOIN indexes i ON i.id = s.dataset_index_id AND i.dataset_id = s.dataset_id
  WHERE NOT s.deleted AND s.status = 'completed' AND s.embedding_status IN ('completed', 'not_required') AND NOT d.deleted AND d.enabled AND NOT d.archived
    AND ((s.dataset_index_id IS NULL AND d.indexing_status = 'completed') OR (i.status = 'active' AND NOT i.deleted)) GROUP BY 1),
rj AS (SELECT dataset_id, status, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id DESC) AS rank FROM jobs),
jc AS (SELECT dataset_id, max(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS busy,
    max(CASE WHEN rank = 1 AND status IN ('failed', 'partial_success') THEN 1 ELSE 0 END) AS bad FROM rj GROUP BY 1),
summary AS (
  SELECT x.id AS dataset_id, coalesce(dc.n, 0) AS document_count, coalesce(sc.n, 0) AS chunk_count,
    CASE WHEN dc.busy = 1 OR jc.busy = 1 THEN 'indexing' WHEN coalesce(sc.n, 0) > 0 THEN 'ready' WHEN dc.bad = 1 OR jc.bad = 1 THEN 'failed' ELSE 'draft' END AS status
  FROM datasets x LEFT JOIN dc ON dc.dataset_id = x.id LEFT JOIN sc ON sc.dataset_id = x.id LEFT JOIN jc ON jc.dataset_id = x.id WHERE NOT x.deleted)
"""


def _summary(spark, sf) -> DataFrame:
    return R.summaries(M.datasets(spark, sf), M.documents(spark, sf), M.segments(spark, sf), M.indexes(spark, sf), M.jobs(spark, sf))


@query("a1_document_counts", SUMMARY_SQL + "SELECT dataset_id, n AS document_count, busy AS processing, bad AS failed FROM dc")
def a1(spark, sf):
    return R.document_counts(M.documents(spark, sf))


@query("a2_j5_chunk_counts", SUMMARY_SQL + "SELECT dataset_id, n AS chunk_count FROM sc")
def a2(spark, sf):
    return R.chunk_counts(M.segments(spark, sf), M.documents(spark, sf), M.indexes(spark, sf))


@query("a3_w1_job_flags", SUMMARY_SQL + "SELECT dataset_id, busy AS processing, bad AS failed FROM jc")
def a3(spark, sf):
    return R.job_flags(M.jobs(spark, sf))


@query("a4_j6_summaries", SUMMARY_SQL + "SELECT * FROM summary")
def a4(spark, sf):
    return _summary(spark, sf)


@query("a5_stats", SUMMARY_SQL + """SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'indexing') AS indexing,
  count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(document_count), 0) AS BIGINT) AS documents,
  CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM summary""")
def a5(spark, sf):
    return R.stats(_summary(spark, sf))


@query("a6_job_summary", """SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS processed,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  CASE WHEN bool_and(status = 'completed') THEN 100 ELSE CAST(floor(avg(progress)) AS BIGINT) END AS progress,
  CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status IN ('pending', 'retry_wait')) THEN 'queued' WHEN bool_and(status = 'completed') THEN 'completed'
    WHEN bool_or(status = 'failed') AND bool_or(status = 'completed') THEN 'partial_success' WHEN bool_or(status = 'failed') THEN 'failed'
    WHEN bool_and(status = 'cancelled') THEN 'cancelled' END AS status,
  first(stage ORDER BY id, document_id, stage) FILTER (status = 'running') AS stage FROM job_documents GROUP BY job_id""")
def a6(spark, sf):
    return R.job_summary(M.job_documents(spark, sf))


@query("a7_terminal_status", """SELECT job_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_and(status = 'cancelled') THEN 'cancelled'
  WHEN bool_or(status = 'completed') THEN 'partial_success' ELSE 'failed' END AS status FROM job_documents GROUP BY job_id
  HAVING bool_and(status IN ('completed', 'failed', 'cancelled'))""")
def a7(spark, sf):
    grouped = M.job_documents(spark, sf).groupBy("job_id").agg(R.terminal_status().alias("status"), F.every(F.col("status").isin("completed", "failed", "cancelled")).alias("over"))
    return grouped.where("over").select("job_id", "status")


@query("a12_next_position", "SELECT dataset_id, coalesce(max(position) FILTER (NOT deleted), 0) + 1 AS next_position FROM docs GROUP BY 1")
def a12(spark, sf):
    return R.next_position(M.documents(spark, sf))


@query("a14_paged_count", SUMMARY_SQL + """SELECT count(*) AS total FROM datasets JOIN summary ON id = dataset_id WHERE permission IN ('team', 'all_team_members')
  AND status = 'ready' AND (name ILIKE '%00_1%' OR description ILIKE '%hold%' OR dataset_type ILIKE '%hold%')""")
def a14(spark, sf):
    rows = M.datasets(spark, sf).withColumn("created_at", F.col("id"))
    found = rows.where(R.visible("team") & R.matches("hold"))
    wide = rows.where(R.visible("team") & F.col("name").ilike("%00_1%"))
    both = found.unionByName(wide).dropDuplicates(["id"])
    return both.join(_summary(spark, sf), both["id"] == F.col("dataset_id")).where("status = 'ready'").agg(F.count("*").alias("total"))


@query("o5_p2_p3_dataset_page", SUMMARY_SQL + """SELECT id, name, permission, document_count, chunk_count, status FROM datasets JOIN summary ON id = dataset_id
  WHERE permission IN ('private', 'only_me') AND (name ILIKE '%build%' OR description ILIKE '%build%' OR dataset_type ILIKE '%build%')
  ORDER BY updated DESC NULLS LAST, id DESC, id LIMIT 20 OFFSET 20""")
def o5(spark, sf):
    rows = M.datasets(spark, sf).withColumn("created_at", F.col("id"))
    page, _ = R.dataset_page(rows, _summary(spark, sf), 2, 20, visibility="private", q="build")
    return page.select("id", "name", "permission", "document_count", "chunk_count", "status")


@query("o6_document_page", "SELECT id, name, position FROM docs WHERE dataset_id = 7 AND NOT deleted ORDER BY position, id LIMIT 5 OFFSET 5")
def o6(spark, sf):
    return R.document_page(M.documents(spark, sf), 7, 2, 5).select("id", "name", "position")


@query("o7_job_page", "SELECT id, status, created_at FROM jobs WHERE dataset_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10")
def o7(spark, sf):
    return R.job_page(M.jobs(spark, sf), 7, 10).select("id", "status", "created_at")


@query("p2_substring_search", "SELECT id, name FROM datasets WHERE name ILIKE '%00_1%' OR description ILIKE '%00_1%' OR dataset_type ILIKE '%00_1%'")
def p2(spark, sf):
    return M.datasets(spark, sf).where(R.matches("00_1")).select("id", "name")


@query("p2_indexed_search", "SELECT id, name FROM datasets WHERE name ILIKE '%r#000_01%' OR description ILIKE '%r#000_01%' OR dataset_type ILIKE '%r#000_01%'")
def p2_indexed(spark, sf):
    """The same search through trigrams, for a pattern long enough to have some."""
    from ..operators import substring_index as X
    from ..streaming.ingest import shared_folder

    rows, columns = M.datasets(spark, sf).select("id", "name", "description", "dataset_type"), ("name", "description", "dataset_type")
    index = X.build(rows, columns, shared_folder(spark, "trigrams"))
    return X.search(index, rows, columns, "r#000_01").select("id", "name")


@query("p3_visibility", "SELECT id, permission FROM datasets WHERE permission IN ('public', 'all_members')")
def p3(spark, sf):
    return M.datasets(spark, sf).where(R.visible("public")).select("id", "permission")


@query("p1_visible_segments", """SELECT s.id, s.document_id, s.position FROM segments s JOIN docs d ON d.id = s.document_id JOIN datasets x ON x.id = d.dataset_id
  JOIN indexes i ON i.id = s.dataset_index_id WHERE NOT s.deleted AND s.status = 'completed' AND NOT d.deleted AND d.enabled AND NOT d.archived AND NOT x.deleted
  AND i.status = 'active' AND NOT i.deleted""")
def p1(spark, sf):
    from ..operators.retrieval import visible_segments

    return visible_segments(M.segments(spark, sf), M.documents(spark, sf), M.indexes(spark, sf), M.datasets(spark, sf)).select("id", "document_id", "position")


@query("p16_activation_ready", """SELECT s.id, s.document_id, CASE WHEN technique = 'economy' OR index_type = 'parent' THEN s.status = 'indexing' AND embedding_status = 'not_required'
  ELSE s.status = 'indexing' AND embedding_status = 'completed' END AS ready FROM segments s JOIN datasets x ON x.id = s.dataset_id""")
def p16(spark, sf):
    s = M.segments(spark, sf).join(M.datasets(spark, sf).select(F.col("id").alias("dataset_id"), "technique"), "dataset_id")
    return s.select("id", "document_id", V.ready_for_activation(F.col("technique"), F.col("status"), F.col("index_type"), F.col("embedding_status")).alias("ready"))


@query("p17_indexable", """SELECT x.id AS dataset_id, count(*) AS n FROM segments s JOIN datasets x ON x.id = s.dataset_id
  WHERE technique = 'economy' OR s.dataset_id % 3 = 0 OR index_type = 'child' GROUP BY 1""")
def p17(spark, sf):
    s = M.segments(spark, sf).join(M.datasets(spark, sf).select(F.col("id").alias("dataset_id"), "technique"), "dataset_id")
    mode = F.when(F.col("dataset_id") % 3 == 0, "general").otherwise("parent_child")
    return s.where(V.indexable(F.col("technique"), mode, F.col("index_type"))).groupBy("dataset_id").agg(F.count("*").alias("n"))


@query("p18_flatten_revision", """SELECT s.id, s.document_id, CASE WHEN technique = 'economy' THEN 'general' ELSE index_type END AS index_type,
  CASE WHEN technique <> 'economy' THEN parent_id END AS parent_id FROM segments s JOIN datasets x ON x.id = s.dataset_id""")
def p18(spark, sf):
    s = M.segments(spark, sf).join(M.datasets(spark, sf).select(F.col("id").alias("dataset_id"), "technique"), "dataset_id")
    flat = V.flatten_revision(F.col("technique"), F.col("index_type"), F.col("parent_id"))
    return s.select("id", "document_id", flat.alias("f")).select("id", "document_id", "f.index_type", "f.parent_id")


@query("p19_option_merge", """SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'vector' END, CASE WHEN c_custkey % 5 = 0 THEN 'graph' END, 'hybrid') AS mode,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS BIGINT) END, CASE WHEN c_custkey % 6 = 0 THEN 9 END, 5) AS top_k,
  coalesce(CASE WHEN c_custkey % 7 = 0 THEN false END, CASE WHEN c_custkey % 2 = 0 THEN true END, false) AS rerank_enabled FROM customer""")
def p19(spark, sf):
    from ..operators.retrieval import merge_options

    k = F.col("c_custkey")
    request = F.struct(F.when(k % 3 == 0, "vector").alias("mode"), F.when(k % 4 == 0, k).alias("top_k"), F.when(k % 7 == 0, False).alias("rerank_enabled"))
    saved = F.struct(F.when(k % 5 == 0, "graph").alias("mode"), F.when(k % 6 == 0, F.lit(9).cast("long")).alias("top_k"), F.when(k % 2 == 0, True).alias("rerank_enabled"))
    merged = merge_options(request, saved, ("mode", "top_k", "rerank_enabled"))
    return M.read(spark, sf, "customer").select(k.alias("id"), *[merged[n].alias(n) for n in ("mode", "top_k", "rerank_enabled")])


@query("p20_display_status", """SELECT id, CASE WHEN permission IN ('private', 'only_me') THEN 'private' WHEN permission IN ('team', 'all_team_members') THEN 'team' ELSE 'public' END AS visibility FROM datasets""")
def p20(spark, sf):
    shown = F.lit(None)
    for name, own in R.VISIBILITY.items():
        shown = F.when(F.col("permission").isin(*own), name).otherwise(shown)
    return M.datasets(spark, sf).select("id", shown.alias("visibility"))


@query("j8_legacy_segments", """, act AS (SELECT * FROM indexes WHERE status = 'active' AND NOT deleted)
  SELECT id, document_id, position, status FROM segments WHERE dataset_index_id IN (SELECT id FROM act)
  OR (dataset_index_id IS NULL AND dataset_id NOT IN (SELECT dataset_id FROM act))""")
def j8(spark, sf):
    return R.legacy_visible(M.segments(spark, sf), M.indexes(spark, sf), M.segment_tasks(spark, sf))


@query("j9_unpublished_jobs", "SELECT id, status FROM jobs j WHERE EXISTS (SELECT 1 FROM segments s WHERE s.document_id = j.id AND NOT s.deleted AND s.status = 'indexing')")
def j9(spark, sf):
    return R.has_unpublished(M.jobs(spark, sf), M.segments(spark, sf)).select("id", "status")


@query("j20_cancellation", """SELECT r.id, coalesce(j.status = 'cancelled', true) OR coalesce(x.deleted, true) OR coalesce(d.deleted, true) AS cancelled FROM job_documents r
  LEFT JOIN jobs j ON j.id = r.job_id LEFT JOIN datasets x ON x.id = j.dataset_id LEFT JOIN docs d ON d.id = r.document_id""")
def j20(spark, sf):
    return J.cancelled_rows(M.job_documents(spark, sf), M.jobs(spark, sf), M.datasets(spark, sf), M.documents(spark, sf))


def _revisions(spark, sf):
    s = M.segments(spark, sf).groupBy("document_id", F.col("position").alias("version")).agg(F.max("id").alias("id"))
    return s


@query("j21_a13_d3_latest_revision", """SELECT document_id, max(id) AS revision_id, max(position) AS version FROM segments GROUP BY 1""")
def j21(spark, sf):
    return V.latest_revision(_revisions(spark, sf))


@query("j22_u5_request_order", """, asked AS (SELECT unnest([42, 7, 42, 19, 7, 3]) AS id, generate_subscripts([42, 7, 42, 19, 7, 3], 1) AS pos),
  first AS (SELECT id, min(pos) AS pos FROM asked GROUP BY 1)
  SELECT row_number() OVER (ORDER BY pos) AS ord, f.id, name FROM first f LEFT JOIN docs USING (id)""")
def j22(spark, sf):
    from ..operators.retrieval import request_order

    return request_order([42, 7, 42, 19, 7, 3], M.documents(spark, sf)).select("ord", "id", "name")


@query("a20_vector_count", "SELECT label, count(*) AS vectors FROM embeddings GROUP BY 1")
def a20(spark, sf):
    return M.read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))


@query("a15_dimension_check", "SELECT count(DISTINCT len(embedding)) = 1 AS equal, CAST(min(len(embedding)) AS BIGINT) AS dimension FROM embeddings")
def a15(spark, sf):
    return M.read(spark, sf, "embeddings").agg((F.countDistinct(F.size("embedding")) == 1).alias("equal"), F.min(F.size("embedding")).cast("long").alias("dimension"))


@query("a21_m6_publish_decisions", """, k AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'economy' ELSE 'high_quality' END AS technique FROM orders),
  r AS (SELECT l_orderkey AS job_id, l_linenumber AS document_id, CASE WHEN l_suppkey % 40 = 0 THEN 'failed' WHEN l_suppkey % 41 = 0 THEN 'running' ELSE 'completed' END AS status FROM lineitem),
  s AS (SELECT l_orderkey AS job_id, l_linenumber AS document_id, 'indexing' AS status, CASE WHEN o_custkey % 2 = 0 OR l_partkey % 50 = 0 THEN 'not_required' ELSE 'completed' END AS embedding_status,
      'general' AS index_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 20 > 0),
  d AS (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'running') AS open, count(*) FILTER (status = 'failed') AS bad, count(DISTINCT document_id) AS wanted FROM r GROUP BY 1),
  c AS (SELECT s.job_id, count(DISTINCT s.document_id) AS found, count(*) FILTER (embedding_status <> CASE WHEN technique = 'economy' THEN 'not_required' ELSE 'completed' END) AS unready
    FROM s JOIN k ON k.id = s.job_id GROUP BY 1)
  SELECT k.id AS job_id, CASE WHEN n IS NULL OR open > 0 THEN 'wait' WHEN bad > 0 THEN 'failed' WHEN coalesce(found, 0) <> wanted OR coalesce(unready, 1) > 0 THEN 'invalid' ELSE 'publish' END AS decision
  FROM k LEFT JOIN d ON d.job_id = k.id LEFT JOIN c ON c.job_id = k.id""")
def m6(spark, sf):
    o, l = M.read(spark, sf, "orders"), M.read(spark, sf, "lineitem")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "economy").otherwise("high_quality").alias("technique"))
    key = (F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("document_id"))
    rows = l.select(*key, F.when(F.col("l_suppkey") % 40 == 0, "failed").when(F.col("l_suppkey") % 41 == 0, "running").otherwise("completed").alias("status"))
    staged = dealt(l, "l_orderkey").where(F.col("l_partkey") % 20 > 0).join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        *key, F.lit("indexing").alias("status"), F.when((F.col("o_custkey") % 2 == 0) | (F.col("l_partkey") % 50 == 0), "not_required").otherwise("completed").alias("embedding_status"), F.lit("general").alias("index_type")
    )
    return V.publish_decisions(jobs, rows, staged, tasks=1)


@query("m6_switch_indexes", """, t AS (SELECT c_custkey * 10 + 2 AS id, c_custkey AS dataset_id FROM customer WHERE c_custkey % 3 = 0)
  SELECT i.id, i.dataset_id, CASE WHEN i.id IN (SELECT id FROM t) THEN 'active' WHEN i.status = 'active' AND NOT i.deleted AND i.dataset_id IN (SELECT dataset_id FROM t) THEN 'retired' ELSE i.status END AS status FROM indexes i""")
def m6_switch(spark, sf):
    target = M.read(spark, sf, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") * 10 + 2).alias("id"), F.col("c_custkey").alias("dataset_id"))
    return V.switch_indexes(M.indexes(spark, sf), target).select("id", "dataset_id", "status")


@query("m7_incremental_publish", """, t AS (SELECT id AS document_id FROM docs WHERE id % 10 = 0),
  s AS (SELECT *, CASE WHEN position % 2 = 0 THEN 5 ELSE 4 END AS job_id FROM segments)
  SELECT id, document_id, deleted OR (document_id IN (SELECT document_id FROM t) AND status = 'completed') AS deleted,
    CASE WHEN NOT deleted AND document_id IN (SELECT document_id FROM t) AND status = 'indexing' AND job_id = 5 THEN 'completed' ELSE status END AS status FROM s""")
def m7(spark, sf):
    s = M.segments(spark, sf).withColumn("job_id", F.when(F.col("position") % 2 == 0, 5).otherwise(4))
    touched = M.documents(spark, sf).where("id % 10 = 0").select(F.col("id").alias("document_id"))
    return V.publish_increment(s, 5, touched).select("id", "document_id", "deleted", "status")


@query("m1_u4_stage_missing", "SELECT l_orderkey AS id, l_partkey AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def m1(spark, sf):
    known = M.read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("part"))
    return V.stage_segments(known, M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part")), same="part")[0]


@query("m1_stage_conflicts", "SELECT l_orderkey AS id, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND l_partkey <> o_custkey")
def m1_conflicts(spark, sf):
    known = M.read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("part"))
    return V.stage_segments(known, M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part")), same="part")[1]


@query("m2_vector_upsert", """, inc AS (SELECT vec_id + 100 AS id, label + 50 AS label, vec_id AS seq FROM embeddings WHERE vec_id % 2 = 0)
  SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM inc) UNION ALL SELECT id, label FROM inc""")
def m2(spark, sf):
    e = M.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    incoming = e.where("id % 2 = 0").select((F.col("id") + 100).alias("id"), (F.col("label") + 50).alias("label"), F.col("id").alias("seq"))
    stale = incoming.select("id", (F.col("label") * 0).alias("label"), (F.col("seq") - 1000).alias("seq"))
    return V.upsert(e, incoming.unionAll(stale))


@query("m3_vector_delete", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)")
def m3(spark, sf):
    e = M.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return V.delete_keys(e, M.read(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("m5_mark_embedded", """SELECT id, document_id, CASE WHEN embedding_status = 'waiting' AND id % 3 = 0 THEN 'completed' ELSE embedding_status END AS embedding_status FROM segments""")
def m5(spark, sf):
    s = M.segments(spark, sf)
    return V.mark_embedded(s, s.where("id % 3 = 0").select("id")).select("id", "document_id", "embedding_status")


@query("m8_soft_delete", "SELECT id, deleted OR dataset_id % 7 = 0 AS deleted FROM docs")
def m8(spark, sf):
    gone = M.datasets(spark, sf).where("id % 7 = 0").select(F.col("id").alias("dataset_id"))
    return V.soft_delete(M.documents(spark, sf), gone, "dataset_id").select("id", "deleted")


@query("m9_o10_cleanup", """, g AS (SELECT id AS document_id FROM docs WHERE deleted), c AS (SELECT document_id, count(*) AS n FROM segments WHERE NOT deleted GROUP BY 1),
  w AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_suppkey % 4 = 0)
  SELECT document_id, document_id IN (SELECT document_id FROM w) AS waits, coalesce(n, 0) AS segments,
    NOT (document_id IN (SELECT document_id FROM w)) AND coalesce(n, 0) = 0 AS complete FROM g LEFT JOIN c USING (document_id)""")
def m9(spark, sf):
    gone = M.documents(spark, sf).where("deleted").select(F.col("id").alias("document_id"))
    running = M.read(spark, sf, "lineitem").where("l_suppkey % 4 = 0").select(F.col("l_orderkey").alias("document_id"))
    out = V.cleanup_ready(gone, running, segments=M.segments(spark, sf).where("not deleted"))
    return out.withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))


@query("o10_cleanup_scan", "SELECT id, CASE WHEN id % 3 > 0 THEN position END AS last_attempt FROM docs WHERE deleted ORDER BY last_attempt NULLS FIRST, created_at, id LIMIT 100")
def o10(spark, sf):
    rows = M.documents(spark, sf).where("deleted").withColumn("last_attempt", F.when(F.col("id") % 3 > 0, F.col("position")))
    return rows.orderBy(F.col("last_attempt").asc_nulls_first(), "created_at", "id").limit(100).select("id", "last_attempt")


@query("m11_governance", """SELECT id, CASE WHEN id % 4 = 0 THEN coalesce(CASE WHEN id % 8 = 0 THEN 1 END, position) WHEN id % 4 = 1 THEN NULL ELSE CASE WHEN id % 8 = 0 THEN 1 END END AS disabled_at,
  CASE WHEN id % 4 = 2 THEN coalesce(CASE WHEN id % 6 = 0 THEN 2 END, position) WHEN id % 4 = 3 THEN NULL ELSE CASE WHEN id % 6 = 0 THEN 2 END END AS archived_at,
  CASE id % 4 WHEN 1 THEN true WHEN 0 THEN false ELSE enabled END AS enabled, CASE id % 4 WHEN 2 THEN true WHEN 3 THEN false ELSE archived END AS archived FROM docs""")
def m11(spark, sf):
    k = F.col("id")
    rows = M.documents(spark, sf).select("id", "position", "enabled", "archived", F.when(k % 8 == 0, F.lit(1).cast("long")).alias("disabled_at"), F.when(k % 6 == 0, F.lit(2).cast("long")).alias("archived_at"))
    actions = rows.select("id", F.element_at(F.array(*map(F.lit, ("disable", "enable", "archive", "unarchive"))), (k % 4 + 1).cast("int")).alias("action"), F.col("position").alias("at"))
    return V.governance(rows, actions).drop("position")


@query("m12_first_duplicates", """SELECT dataset_id, name, digest, arg_min(id, position * 1000000000 + id) AS first_id, count(*) AS copies FROM docs WHERE NOT deleted GROUP BY 1, 2, 3""")
def m12(spark, sf):
    return V.first_duplicates(M.documents(spark, sf))


@query("m13_rule_reuse", """SELECT d.id, d.dataset_id, d.digest AS config_hash, (SELECT min(r.id) FROM docs r WHERE r.enabled AND r.dataset_id = d.dataset_id AND r.digest = d.digest) AS rule_id FROM docs d""")
def m13(spark, sf):
    d = M.documents(spark, sf).select("id", "dataset_id", F.col("digest").alias("config_hash"), "enabled")
    return V.rule_reuse(d.select("id", "dataset_id", "config_hash"), d)


@query("m14_rebuild_plan", "SELECT dataset_id, id AS document_id, row_number() OVER (PARTITION BY dataset_id ORDER BY position, id) AS ord FROM docs WHERE NOT deleted AND enabled AND NOT archived")
def m14(spark, sf):
    return V.rebuild_plan(M.documents(spark, sf))


def _leases(spark, sf):
    return M.job_documents(spark, sf).withColumns({"worker_id": F.when(F.col("id") % 2 == 0, "w0").otherwise("w1"), "lease_expires_at": F.when(F.col("id") % 5 > 0, F.col("due_at")), "error_code": F.lit(None).cast("string")})


@query("m15_claim", f"""SELECT r.id, r.document_id, CASE WHEN ok THEN 'running' ELSE status END AS status, CASE WHEN ok THEN attempts + 1 ELSE attempts END AS attempts FROM (
  SELECT *, ((status IN ('pending', 'retry_wait') AND due_at <= {NOW}) OR (status = 'running' AND (id % 5 = 0 OR due_at <= {NOW})))
    AND document_id IN (SELECT id FROM docs WHERE NOT deleted) AS ok FROM job_documents) r""")
def m15(spark, sf):
    live = M.documents(spark, sf).where("not deleted")
    return J.claim(_leases(spark, sf), live, now(), "w9").select("id", "document_id", "status", F.col("attempts").cast("long").alias("attempts"))


@query("m15_fail_retry", f"""SELECT id, document_id, CASE WHEN own AND attempts < 3 THEN 'retry_wait' WHEN own THEN 'failed' ELSE status END AS status,
  CASE WHEN own AND attempts < 3 THEN {NOW} + to_seconds(CASE WHEN attempts <= 1 THEN 30 WHEN attempts = 2 THEN 120 ELSE 600 END) WHEN own THEN {NOW} ELSE due_at END AS due_at
  FROM (SELECT *, status = 'running' AND id % 2 = 0 AS own FROM job_documents)""")
def m15_fail(spark, sf):
    return J.fail(_leases(spark, sf), "w0", now(), "X").select("id", "document_id", "status", "due_at")


@query("m16_yield", "SELECT id, document_id, CASE WHEN own THEN 'pending' ELSE status END AS status, CASE WHEN own THEN greatest(0, attempts - 1) ELSE attempts END AS attempts FROM (SELECT *, status = 'running' AND id % 2 = 0 AS own FROM job_documents)")
def m16(spark, sf):
    return J.release(_leases(spark, sf), "w0", now()).select("id", "document_id", "status", F.col("attempts").cast("long").alias("attempts"))


@query("m17_heartbeat", """SELECT id, document_id, CASE WHEN own AND id % 120 >= progress THEN 'validate' ELSE stage END AS stage, CASE WHEN own THEN greatest(progress, least(100, id % 120)) ELSE progress END AS progress
  FROM (SELECT *, status = 'running' AND id % 2 = 0 AS own FROM job_documents)""")
def m17(spark, sf):
    rows = _leases(spark, sf)
    beats = rows.select("id", F.lit("w0").alias("worker_id"), F.lit("validate").alias("stage"), (F.col("id") % 120).alias("progress")).distinct()
    return J.heartbeat(rows, beats, now()).select("id", "document_id", "stage", "progress")


@query("m17_stage_status", """SELECT id, document_id, CASE stage WHEN 'download' THEN 'downloading' WHEN 'parse' THEN 'parsing' WHEN 'split' THEN 'splitting' ELSE 'indexing' END AS indexing_status FROM job_documents""")
def m17_stage(spark, sf):
    return M.job_documents(spark, sf).select("id", "document_id", J.document_status_of_stage(F.col("stage"), F.lit("?")).alias("indexing_status"))


@query("m18_o9_recover", f"""SELECT id, CASE WHEN attempts < 3 THEN 'retry_wait' ELSE 'failed' END AS status, CASE WHEN attempts >= 3 THEN 'WORKER_LEASE_EXPIRED' END AS error_code FROM (
  SELECT DISTINCT id, attempts, due_at FROM job_documents WHERE status = 'running' AND id % 5 > 0 AND due_at <= {NOW} ORDER BY due_at, id LIMIT 100)""")
def m18(spark, sf):
    rows = _leases(spark, sf).where("status = 'running'").dropDuplicates(["id", "attempts", "due_at"])
    return J.recover(rows, now())


@query("m19_dispatch", f"SELECT id, 'queued' AS status FROM (SELECT DISTINCT id, due_at FROM job_documents WHERE status IN ('pending', 'retry_wait') AND due_at <= {NOW} ORDER BY due_at, id LIMIT 100)")
def m19(spark, sf):
    rows = _leases(spark, sf).where(F.col("status").isin("pending", "retry_wait")).dropDuplicates(["id", "due_at"])
    return J.dispatch(rows, now())


@query("m20_cancel_retry", """SELECT j.id, CASE WHEN status IN ('completed', 'failed', 'partial_success', 'cancelled') THEN 'terminal' ELSE 'requested' END AS cancel,
  CASE WHEN status = 'running' THEN 'active' WHEN coalesce(n, 0) = 0 THEN 'nothing_to_retry' ELSE 'retried' END AS retry FROM jobs j
  LEFT JOIN (SELECT job_id, count(*) AS n FROM job_documents WHERE status IN ('failed', 'retry_wait') GROUP BY 1) ON job_id = j.id""")
def m20(spark, sf):
    n = M.job_documents(spark, sf).where(F.col("status").isin("failed", "retry_wait")).groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"))
    joined = M.jobs(spark, sf).join(n, "id", "left")
    return joined.select("id", J.cancel_outcome(F.col("status")).alias("cancel"), J.retry_outcome(F.col("status"), F.coalesce("n", F.lit(0))).alias("retry"))


@query("m20_retry_rows", "SELECT id, document_id, CASE WHEN job_id % 2 = 0 AND status IN ('failed', 'retry_wait') THEN 'pending' ELSE status END AS status FROM job_documents")
def m20_rows(spark, sf):
    named = M.jobs(spark, sf).where("id % 2 = 0").select(F.col("id").alias("job_id"))
    return J.retry(M.job_documents(spark, sf), named).select("id", "document_id", "status")


@query("m21_create_revision", """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 8 = coalesce(v, 0) THEN 'created' ELSE 'conflict' END AS outcome, CASE WHEN o_orderkey % 8 = coalesce(v, 0) THEN coalesce(v, 0) + 1 END AS version
  FROM orders LEFT JOIN (SELECT document_id, max(position) AS v FROM segments GROUP BY 1) ON document_id = o_orderkey""")
def m21(spark, sf):
    asked = M.read(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 8).alias("base_version"))
    return V.create_revision(_revisions(spark, sf), asked)


@query("m22_d7_prepared", "SELECT id, document_id, l_comment IS NOT NULL AS prepared FROM (SELECT id, document_id, CASE WHEN id % 3 = 0 THEN '' END AS l_comment FROM job_documents)")
def m22(spark, sf):
    return M.job_documents(spark, sf).select("id", "document_id", J.prepared(F.when(F.col("id") % 3 == 0, "")).alias("prepared"))


@query("m23_target_dimension", "SELECT label, CAST(min(len(embedding)) AS BIGINT) AS dimension, count(DISTINCT len(embedding)) > 1 AS mismatch FROM embeddings GROUP BY 1")
def m23(spark, sf):
    n = F.size("embedding")
    return M.read(spark, sf, "embeddings").groupBy("label").agg(F.min(n).cast("long").alias("dimension"), (F.countDistinct(n) > 1).alias("mismatch"))


@query("p13_revision_violations", """, i AS (SELECT document_id, id, position AS ord, index_type, parent_id FROM segments),
  p AS (SELECT document_id, id, min(ord) AS ord, arg_min(index_type, ord) AS t FROM i GROUP BY 1, 2)
  SELECT DISTINCT document_id, rule FROM (
    SELECT document_id, 'duplicate_id' AS rule FROM i GROUP BY document_id, id HAVING count(DISTINCT ord) > 1
    UNION ALL SELECT i.document_id, 'child_without_parent' FROM i LEFT JOIN p ON p.document_id = i.document_id AND p.id = i.parent_id WHERE index_type = 'child' AND NOT coalesce(p.t = 'parent' AND p.ord < i.ord, false)
    UNION ALL SELECT document_id, 'mixed_types' FROM i GROUP BY 1 HAVING bool_or(index_type = 'general') AND bool_or(index_type <> 'general')
    UNION ALL SELECT document_id, 'parent_without_child' FROM i GROUP BY 1 HAVING bool_or(index_type = 'parent') AND NOT bool_or(index_type = 'child'))""")
def p13(spark, sf):
    return V.revision_violations(M.segments(spark, sf).withColumn("ord", F.col("position")))


@query("p14_candidate_violations", """SELECT DISTINCT document_id, rule FROM (
    SELECT document_id, 'duplicate_local_id' AS rule FROM segments GROUP BY document_id, position HAVING count(*) > 1
    UNION ALL SELECT document_id, 'duplicate_id' FROM segments GROUP BY document_id, id HAVING count(*) > 1
    UNION ALL SELECT s.document_id, 'missing_parent' FROM segments s WHERE index_type = 'child' AND NOT EXISTS (
      SELECT 1 FROM segments q WHERE q.document_id = s.document_id AND q.index_type = 'parent' AND q.position = s.parent_id % 10))""")
def p14(spark, sf):
    s = M.segments(spark, sf).withColumns({"local_id": F.col("position"), "parent_local_id": F.col("parent_id") % 10})
    return V.candidate_violations(s)


@query("p15_d11_vector_validation", """SELECT vec_id, len(embedding) > 0 AND len(embedding) <= 32768 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND vec_id >= 0 AS valid FROM embeddings""")
def p15(spark, sf):
    from ..functions.vectors import valid_vector

    return M.read(spark, sf, "embeddings").select("vec_id", (valid_vector(F.col("embedding")) & (F.col("vec_id") >= 0)).alias("valid"))


@query("d1_activate_document", "SELECT id, document_id, CASE WHEN document_id % 5 = 0 AND dataset_index_id % 10 = 2 AND status = 'indexing' AND NOT deleted THEN 'completed' ELSE status END AS status FROM segments")
def d1(spark, sf):
    hit = (F.col("document_id") % 5 == 0) & (F.col("dataset_index_id") % 10 == 2) & (F.col("status") == "indexing") & ~F.col("deleted")
    return M.segments(spark, sf).select("id", "document_id", F.when(hit, "completed").otherwise(F.col("status")).alias("status"))


@query("d2_unmatched_scope", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def d2(spark, sf):
    asked = M.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return V.unmatched_scope(asked, M.read(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id")))


@query("d3_revision_history", "SELECT s.document_id, s.position AS version, max(s.id) AS id FROM segments s JOIN docs d ON d.id = s.document_id WHERE NOT d.deleted GROUP BY 1, 2")
def d3(spark, sf):
    live = M.documents(spark, sf).where("not deleted").select(F.col("id").alias("document_id"))
    return _revisions(spark, sf).join(live, "document_id", "left_semi")


@query("d4_point_lookups", "SELECT id, name, dataset_id FROM docs WHERE dataset_id = 42 AND NOT deleted AND id IN (SELECT id FROM docs WHERE enabled)")
def d4(spark, sf):
    return M.documents(spark, sf).where("dataset_id = 42 and not deleted and enabled").select("id", "name", "dataset_id")


@query("d5_needs_rebuild", """SELECT id, technique IS DISTINCT FROM 'economy' OR updated IS DISTINCT FROM CASE WHEN id % 3 > 0 THEN id % 10 END OR description IS DISTINCT FROM 'BUILDING' AS rebuild FROM datasets""")
def d5(spark, sf):
    old = {"technique": F.col("technique"), "model": F.col("updated"), "category": F.col("description")}
    new = {"technique": F.lit("economy"), "model": F.when(F.col("id") % 3 > 0, F.col("id") % 10), "category": F.lit("BUILDING")}
    return M.datasets(spark, sf).select("id", V.needs_rebuild(old, new).alias("rebuild"))


@query("d6_finish", "SELECT id, document_id, CASE WHEN own THEN 'completed' ELSE status END AS status, CASE WHEN own THEN 100 ELSE progress END AS progress FROM (SELECT *, status = 'running' AND id % 2 = 0 AND id % 3 = 0 AS own FROM job_documents)")
def d6(spark, sf):
    rows = _leases(spark, sf)
    return J.finish(rows, "w0", rows.where("id % 3 = 0").select("id")).select("id", "document_id", "status", F.col("progress").cast("long").alias("progress"))


@query("d8_d9_execution_context", """SELECT r.id, r.job_id, r.document_id, d.name AS document_name, j.dataset_id, x.technique, i.id AS index_id FROM job_documents r JOIN jobs j ON j.id = r.job_id
  JOIN docs d ON d.id = r.document_id AND NOT d.deleted JOIN datasets x ON x.id = j.dataset_id AND NOT x.deleted LEFT JOIN indexes i ON i.dataset_id = j.dataset_id AND i.status = 'active' AND NOT i.deleted""")
def d8(spark, sf):
    return V.execution_context(M.job_documents(spark, sf), M.jobs(spark, sf), M.documents(spark, sf), M.indexes(spark, sf), M.datasets(spark, sf))


@query("d16_d17_governance_reads", "SELECT d.id, d.name, d.dataset_id FROM docs d JOIN datasets x ON x.id = d.dataset_id WHERE NOT x.deleted AND NOT d.deleted")
def d16(spark, sf):
    gate = M.datasets(spark, sf).where("not deleted").select(F.col("id").alias("dataset_id"))
    return M.documents(spark, sf).where("not deleted").join(gate, "dataset_id", "left_semi").select("id", "name", "dataset_id")


@query("d26_touched_deleted", "SELECT DISTINCT document_id FROM job_documents WHERE status IN ('completed', 'failed', 'cancelled') AND document_id IN (SELECT id FROM docs WHERE deleted)")
def d26(spark, sf):
    return J.touched_deleted(M.job_documents(spark, sf), M.documents(spark, sf))


@query("f27_f31_progress_maths", """SELECT l_orderkey AS id, l_linenumber AS n, CAST(15 + ((85 - 15) * l_partkey // 2000) AS BIGINT) AS progress,
  CASE WHEN l_partkey <= 100 THEN 1 ELSE 1 + (l_partkey - 100 + 39) // 40 END AS projected FROM lineitem""")
def f27(spark, sf):
    from ..functions.text import progress, projected_records

    return M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), progress(15, 85, F.col("l_partkey"), F.lit(2000)).alias("progress"), projected_records(F.col("l_partkey"), 100, 20).alias("projected"))


@query("f28_batches", "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM embeddings")
def f28(spark, sf):
    from ..functions.text import batch_numbers

    return batch_numbers(M.read(spark, sf, "embeddings").select("vec_id"), "vec_id", 64)


@query("f29_date_arithmetic", "SELECT id, document_id, due_at + to_seconds(CASE WHEN attempts <= 1 THEN 30 WHEN attempts = 2 THEN 120 ELSE 600 END) AS lease FROM job_documents")
def f29(spark, sf):
    return M.job_documents(spark, sf).select("id", "document_id", J.seconds_after(F.col("due_at"), J.retry_delay(F.col("attempts"))).alias("lease"))
