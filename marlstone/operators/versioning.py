"""Staging, publishing and deleting of index versions as pure functions over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dealing import dealt, tasks_for
from .rollups import terminal_status


def stage_segments(existing: DataFrame, incoming: DataFrame, key: str = "id", same: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """M1/U4: incoming rows to append, and conflicts (known id, other content)."""
    known = existing.select(key, F.col(same).alias("__known"))
    missing = incoming.join(known, key, "left_anti")
    conflicts = incoming.join(known, key).where(~F.col(same).eqNullSafe(F.col("__known"))).select(*incoming.columns)
    return missing, conflicts


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """M2: incoming rows replace those of the same key; of several incoming ones the last by order wins.

    Both sides are cut to max_by aggregates, combined on the map side, before the union.
    """
    fields = [c for c in existing.columns if c != key]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in fields])
    return existing.join(last, key, "left_anti").unionByName(last)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """M3: rows without those of the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def update_keywords(segments: DataFrame, updates: DataFrame, most: int = 100, longest: int = 255) -> DataFrame:
    """M4: new keywords for ready general and child segments, if at most 100 terms of at most 255 code points."""
    valid = updates.where((F.size("keywords") <= most) & F.forall("keywords", lambda k: F.length(k) <= longest)).select("id", F.col("keywords").alias("__k"))
    ready = F.col("index_type").isin("general", "child") & (F.col("status") == "indexing")
    return segments.join(valid, "id", "left").withColumn("keywords", F.when(ready, F.coalesce("__k", "keywords")).otherwise(F.col("keywords"))).drop("__k")


def mark_embedded(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """M5: waiting segments of the ids are completed."""
    named = segments.join(ids.select("id", F.lit(True).alias("__n")).distinct(), "id", "left")
    hit = F.coalesce("__n", F.lit(False)) & (F.col("embedding_status") == "waiting")
    return named.withColumn("embedding_status", F.when(hit, "completed").otherwise(F.col("embedding_status"))).drop("__n")


def ready_for_activation(technique: Column, status: Column, index_type: Column, embedding_status: Column) -> Column:
    """Staged, and embedded as its technique asks."""
    plain = (technique == "economy") | (index_type == "parent")
    return (status == "indexing") & (embedding_status == F.when(plain, "not_required").otherwise("completed"))


def indexable(technique: Column, mode: Column, index_type: Column) -> Column:
    """All segments, but only children of parent-child ones."""
    return (technique == "economy") | (mode == "general") | (index_type == "child")


def flatten_revision(technique: Column, index_type: Column, parent_id: Column) -> Column:
    """Economy turns parents and children into general segments without parents."""
    flat = technique == "economy"
    return F.struct(F.when(flat, "general").otherwise(index_type).alias("index_type"), F.when(~flat, parent_id).alias("parent_id"))


def publish_decisions(jobs: DataFrame, job_documents: DataFrame, segments: DataFrame, tasks: int | None = None) -> DataFrame:
    """Decision for each job's full build: wait, fail or publish.

    jobs: id, technique; segments: job_id, document_id, status, index_type, embedding_status. Publish
    needs every document terminal, none failed or cancelled, a staged segment for each, and all ready.
    tasks: 1 for segments that are dealt by job.
    """
    job_tasks = tasks_for(job_documents)
    job_documents, segments = dealt(job_documents, "job_id", tasks=job_tasks), dealt(segments, "job_id", tasks=tasks)
    docs = job_documents.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("status").isin("completed", "failed", "cancelled")).alias("open"), F.count_if(F.col("status").isin("failed", "cancelled")).alias("bad"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.countDistinct("document_id").alias("wanted"), terminal_status().alias("terminal"),
    )
    staged = segments.join(jobs.select(F.col("id").alias("job_id"), "technique"), "job_id")
    unready = ~ready_for_activation(F.col("technique"), F.col("status"), F.col("index_type"), F.col("embedding_status"))
    # pairs are matched by grouping: a join by both keys would deal the rows anew
    pairs = staged.select("job_id", "document_id", F.lit(False).alias("asked"), F.coalesce(unready, F.lit(False)).alias("unready")).unionAll(job_documents.select("job_id", "document_id", F.lit(True), F.lit(False)))
    pairs = dealt(pairs.where(F.col("document_id").isNotNull()), "job_id", tasks=2 * job_tasks)
    matched = pairs.groupBy("job_id", "document_id").agg(F.bool_or("asked").alias("asked"), F.count_if(~F.col("asked")).alias("staged"), F.count_if("unready").alias("unready")).where("asked AND staged > 0")
    checked = matched.groupBy("job_id").agg(F.count("*").alias("found"), F.sum("unready").alias("unready"))
    joined = jobs.select(F.col("id").alias("job_id")).join(docs, "job_id", "left").join(checked, "job_id", "left")
    decision = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "wait").when(F.col("open") > 0, "wait").when(F.col("cancelled") == F.col("n"), "cancelled").when(F.col("bad") > 0, "failed")
        .when((F.coalesce("found", F.lit(0)) != F.col("wanted")) | (F.coalesce("unready", F.lit(1)) > 0), "invalid").otherwise("publish")
    )
    return joined.select("job_id", decision.alias("decision"))


def switch_indexes(indexes: DataFrame, targets: DataFrame) -> DataFrame:
    """M6: targets (id, dataset_id) become active, the datasets' other active indexes retire."""
    chosen = targets.select("id", F.lit(True).alias("__target")).distinct()
    owners = targets.select("dataset_id", F.lit(True).alias("__owner")).distinct()
    joined = indexes.join(chosen, "id", "left").join(owners, "dataset_id", "left")
    status = F.when(F.col("__target"), "active").when(F.col("__owner") & (F.col("status") == "active") & ~F.col("deleted"), "retired").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*indexes.columns)


def active_index_violations(indexes: DataFrame) -> DataFrame:
    """Datasets with more than one active index: must be empty after a switch."""
    return indexes.where((F.col("status") == "active") & ~F.col("deleted")).groupBy("dataset_id").agg(F.count("*").alias("active")).where("active > 1")


def publish_increment(segments: DataFrame, job_id, document_ids: DataFrame) -> DataFrame:
    """M7: the job's staged segments are completed; earlier completed ones of its documents are deleted."""
    named = segments.join(document_ids.select("document_id", F.lit(True).alias("__n")).distinct(), "document_id", "left")
    own = F.coalesce("__n", F.lit(False)) & ~F.col("deleted")
    staged = own & (F.col("status") == "indexing") & (F.col("job_id") == job_id)
    out = named.withColumns({"deleted": F.when(own & (F.col("status") == "completed"), True).otherwise(F.col("deleted")), "status": F.when(staged, "completed").otherwise(F.col("status"))})
    return out.select(*segments.columns)


def soft_delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """M8: tombstones on the rows of the keys."""
    named = rows.join(keys.select(key, F.lit(True).alias("__n")).distinct(), key, "left")
    return named.withColumn("deleted", F.col("deleted") | F.coalesce("__n", F.lit(False))).select(*rows.columns)


def cleanup_ready(deleted_documents: DataFrame, running: DataFrame, **stores: DataFrame) -> DataFrame:
    """Deleted documents, whether cleanup must wait for a run, and whether every store has lost them."""
    out = deleted_documents.join(running.select("document_id", F.lit(True).alias("waits")).distinct(), "document_id", "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
    left = F.lit(0)
    for name, store in stores.items():
        out = out.join(store.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
        left = left + F.coalesce(name, F.lit(0))
    return out.withColumn("complete", ~F.col("waits") & (left == 0))


def first_duplicates(docs: DataFrame) -> DataFrame:
    """For each dataset, name and digest, the first live document by position and id, and its copies' number."""
    return docs.where(~F.col("deleted")).groupBy("dataset_id", "name", "digest").agg(F.min(F.struct("position", "id"))["id"].alias("first_id"), F.count("*").alias("copies"))


def rule_reuse(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The enabled rule with the request's dataset and hash, the least id of several, or null for a new one."""
    known = rules.where("enabled").groupBy("dataset_id", "config_hash").agg(F.min("id").alias("rule_id"))
    return requests.join(known, ["dataset_id", "config_hash"], "left")


def rebuild_plan(docs: DataFrame) -> DataFrame:
    """Documents that a rebuild takes, numbered by position and id within their dataset."""
    order = F.row_number().over(Window.partitionBy("dataset_id").orderBy("position", "id"))
    return docs.where(~F.col("deleted") & F.col("enabled") & ~F.col("archived")).select("dataset_id", F.col("id").alias("document_id"), order.cast("long").alias("ord"))


def governance(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """Enable, disable, archive and unarchive; the first disabled_at and archived_at stay. actions: id, action, at."""
    joined = docs.join(actions.select("id", "action", "at"), "id", "left")
    a = F.col("action")
    return joined.withColumns({
        "disabled_at": F.when(a == "disable", F.coalesce("disabled_at", "at")).when(a == "enable", F.lit(None)).otherwise(F.col("disabled_at")),
        "archived_at": F.when(a == "archive", F.coalesce("archived_at", "at")).when(a == "unarchive", F.lit(None)).otherwise(F.col("archived_at")),
        "enabled": F.when(a == "enable", True).when(a == "disable", False).otherwise(F.col("enabled")),
        "archived": F.when(a == "archive", True).when(a == "unarchive", False).otherwise(F.col("archived")),
    }).select(*docs.columns)


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Id and version of each document's last revision."""
    return revisions.groupBy("document_id").agg(F.max_by("id", "version").alias("revision_id"), F.max("version").alias("version"))


def create_revision(revisions: DataFrame, request: DataFrame) -> DataFrame:
    """Next version of each request (document_id, base_version), or conflict if its base is not the last."""
    joined = request.join(latest_revision(revisions), "document_id", "left").withColumn("latest", F.coalesce("version", F.lit(0)))
    ok = F.col("base_version") == F.col("latest")
    return joined.select("document_id", F.when(ok, "created").otherwise("conflict").alias("outcome"), F.when(ok, F.col("latest") + 1).alias("version"))


def revision_violations(items: DataFrame) -> DataFrame:
    """document_id, rule for every broken rule. items: document_id, ord, id, content, index_type, parent_id."""
    w = Window.partitionBy("document_id", "id")
    numbered = items.select("*", F.count("*").over(w).alias("uses"), F.min("ord").over(w).alias("first"))
    blank = ~F.col("content").rlike(r"(?U)[^\s\x{1c}-\x{1f}]")
    parents = items.groupBy("document_id", F.col("id").alias("parent_id")).agg(F.min("ord").alias("p_ord"), F.min_by("index_type", "ord").alias("p_type"))
    joined = numbered.join(parents, ["document_id", "parent_id"], "left")
    orphan = (F.col("index_type") == "child") & ~F.coalesce((F.col("p_type") == "parent") & (F.col("p_ord") < F.col("ord")), F.lit(False))
    rules = F.array_compact(F.array(
        F.when((F.col("uses") > 1) & (F.col("ord") > F.col("first")), "duplicate_id"), F.when(blank, "blank_content"), F.when(~F.col("index_type").isin("general", "parent", "child"), "bad_type"),
        F.when(orphan, "child_without_parent"), F.when((F.col("index_type") != "child") & F.col("parent_id").isNotNull(), "parent_on_other"),
    ))
    by_row = joined.select("document_id", F.explode(rules).alias("rule"))
    kinds = items.groupBy("document_id").agg(F.collect_set("index_type").alias("t"))
    has = lambda x: F.array_contains("t", x)
    by_document = kinds.select("document_id", F.explode(F.array_compact(F.array(F.when(has("general") & (F.size("t") > 1), "mixed_types"), F.when(has("parent") & ~has("child"), "parent_without_child")))).alias("rule"))
    return by_row.unionAll(by_document).distinct()


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Repeated local ids, repeated derived ids, and children without their parent."""
    repeated = lambda c, rule: candidates.groupBy("document_id", c).count().where("count > 1").select("document_id", F.lit(rule).alias("rule"))
    parents = candidates.where(F.col("index_type") == "parent").select("document_id", F.col("local_id").alias("parent_local_id"))
    orphans = candidates.where(F.col("index_type") == "child").join(parents, ["document_id", "parent_local_id"], "left_anti").select("document_id", F.lit("missing_parent").alias("rule"))
    return repeated("local_id", "duplicate_local_id").unionAll(repeated("id", "duplicate_id")).unionAll(orphans).distinct()


def unmatched_scope(requested: DataFrame, matched: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids without a matching row: must be empty for a mutation to go on."""
    return requested.select(key).distinct().join(matched.select(key), key, "left_anti")


def needs_rebuild(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Technique, model or category changed, nulls being equal."""
    changed = F.lit(False)
    for name in ("technique", "model", "category"):
        changed = changed | ~old[name].eqNullSafe(new[name])
    return changed


def execution_context(job_documents: DataFrame, jobs: DataFrame, docs: DataFrame, indexes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Job-document with its job, live document, index and dataset, where all but the index exist."""
    j = jobs.select(F.col("id").alias("job_id"), "dataset_id")
    d = docs.where(~F.col("deleted")).select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    s = datasets.where(~F.col("deleted")).select(F.col("id").alias("dataset_id"), "technique")
    i = indexes.where((F.col("status") == "active") & ~F.col("deleted")).select("dataset_id", F.col("id").alias("index_id"))
    return job_documents.join(j, "job_id").join(d, "document_id").join(s, "dataset_id").join(i, "dataset_id", "left").select("id", "job_id", "document_id", "document_name", "dataset_id", "technique", "index_id")
