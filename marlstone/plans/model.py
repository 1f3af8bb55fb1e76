"""The knowledge-base tables as views over the driver's tables, in Spark and in SQL.

customer stands for datasets, orders for documents, indexing jobs and jobs' targets, lineitem for
segments and job-documents. The same rules are stated twice, as DataFrame expressions and as the CTEs of
MODEL_SQL, so that every oracle starts from an independent statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dealing import dealt, tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the segments, which are at most the rows of lineitem."""
    return tasks_for(read(spark, sf_dir, "lineitem"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    permission = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "only_me").when(F.col("c_mktsegment") == "BUILDING", "private")
        .when(F.col("c_mktsegment") == "FURNITURE", "team").when(F.col("c_mktsegment") == "HOUSEHOLD", "all_team_members").otherwise("public")
    )
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.concat(F.lit("kb"), F.col("c_nationkey")).alias("dataset_type"),
        permission.alias("permission"), (F.col("c_acctbal") < -800).alias("deleted"), F.when(F.col("c_custkey") % 2 == 0, "economy").otherwise("high_quality").alias("technique"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 10).alias("updated"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when((F.col("o_orderstatus") == "O") & (k % 5 == 0), "indexing")
        .when(F.col("o_orderstatus") == "O", "waiting").otherwise("failed")
    )
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("dataset_id"), F.concat(F.lit("doc-"), k % 97, F.lit(".txt")).alias("name"), (k % 50).alias("position"), status.alias("indexing_status"),
        (F.col("o_orderpriority") != "5-LOW").alias("enabled"), (k % 11 == 0).alias("archived"), (k % 17 == 0).alias("deleted"), F.col("o_orderdate").alias("created_at"), (k % 13).alias("digest"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, docs = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = l.join(docs, l["l_orderkey"] == docs["o_orderkey"])
    child = (F.col("l_linenumber") > 1) & (F.col("l_partkey") % 2 == 0)
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.col("o_custkey").alias("dataset_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_custkey") * 10 + F.col("l_suppkey") % 3).cast("long").alias("dataset_index_id"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("indexing").alias("status"),
        F.when(F.col("l_returnflag") == "R", "waiting").when(F.col("l_returnflag") == "A", "completed").otherwise("not_required").alias("embedding_status"),
        (F.col("l_quantity") > 48).alias("deleted"), F.col("l_linenumber").cast("long").alias("position"), F.when(child, F.col("l_orderkey") * 10 + 1).alias("parent_id"),
        F.when(child, "child").when(F.col("l_linenumber") == 1, "parent").otherwise("general").alias("index_type"), F.concat(F.lit("part "), F.col("l_partkey")).alias("content"),
    )


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("dataset_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return rows.select((F.col("dataset_id") * 10 + F.col("k")).alias("id"), "dataset_id", F.when(F.col("k") == 1, "active").otherwise("building").alias("status"), (F.col("dataset_id") % 19 == 0).alias("deleted"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.element_at(F.create_map(*[F.lit(x) for pair in (("1-URGENT", "running"), ("2-HIGH", "completed"), ("3-MEDIUM", "failed"), ("4-NOT SPECIFIED", "partial_success"), ("5-LOW", "cancelled")) for x in pair]), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    status = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "completed").when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_suppkey") % 4 == 0, "running").when(F.col("l_suppkey") % 4 == 1, "retry_wait").when(F.col("l_suppkey") % 4 == 2, "pending").otherwise("cancelled")
    )
    stages = F.array(*map(F.lit, ("download", "parse", "split", "stage", "vector-upsert")))
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("document_id"), status.alias("status"),
        F.least(F.lit(100), F.col("l_quantity").cast("int") * 2).cast("long").alias("progress"), F.element_at(stages, (F.col("l_partkey") % 5 + 1).cast("int")).alias("stage"),
        (F.col("l_linenumber") % 4).cast("long").alias("attempts"), F.col("l_shipdate").alias("due_at"),
    )


MODEL_SQL = """
datasets AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description, 'kb' || c_nationkey AS dataset_type,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'only_me' WHEN 'BUILDING' THEN 'private' WHEN 'FURNITURE' THEN 'team'
      WHEN 'HOUSEHOLD' THEN 'all_team_members' ELSE 'public' END AS permission,
    c_acctbal < -800 AS deleted, CASE WHEN c_custkey % 2 = 0 THEN 'economy' ELSE 'high_quality' END AS technique,
    CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 END AS updated
  FROM customer),
docs AS (
  SELECT o_orderkey AS id, o_custkey AS dataset_id, 'doc-' || (o_orderkey % 97) || '.txt' AS name, o_orderkey % 50 AS position,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'indexing'
      WHEN o_orderstatus = 'O' THEN 'waiting' ELSE 'failed' END AS indexing_status,
    o_orderpriority <> '5-LOW' AS enabled, o_orderkey % 11 = 0 AS archived, o_orderkey % 17 = 0 AS deleted, o_orderdate AS created_at,
    o_orderkey % 13 AS digest
  FROM orders),
segments AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, o_custkey AS dataset_id,
    CASE WHEN l_suppkey % 3 <> 0 THEN o_custkey * 10 + l_suppkey % 3 END AS dataset_index_id,
    CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'indexing' END AS status,
    CASE l_returnflag WHEN 'R' THEN 'waiting' WHEN 'A' THEN 'completed' ELSE 'not_required' END AS embedding_status,
    l_quantity > 48 AS deleted, CAST(l_linenumber AS BIGINT) AS position,
    CASE WHEN l_linenumber > 1 AND l_partkey % 2 = 0 THEN l_orderkey * 10 + 1 END AS parent_id,
    CASE WHEN l_linenumber > 1 AND l_partkey % 2 = 0 THEN 'child' WHEN l_linenumber = 1 THEN 'parent' ELSE 'general' END AS index_type,
    'part ' || l_partkey AS content
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
indexes AS (
  SELECT c_custkey * 10 + k AS id, c_custkey AS dataset_id, CASE k WHEN 1 THEN 'active' ELSE 'building' END AS status, c_custkey % 19 = 0 AS deleted
  FROM customer CROSS JOIN (VALUES (1), (2)) v(k)),
jobs AS (
  SELECT o_orderkey AS id, o_custkey AS dataset_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'completed'
      WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'partial_success' ELSE 'cancelled' END AS status, o_orderdate AS created_at
  FROM orders),
job_documents AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id, l_partkey AS document_id,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_suppkey % 4 = 0 THEN 'running'
      WHEN l_suppkey % 4 = 1 THEN 'retry_wait' WHEN l_suppkey % 4 = 2 THEN 'pending' ELSE 'cancelled' END AS status,
    CAST(least(100, CAST(l_quantity AS INT) * 2) AS BIGINT) AS progress,
    CASE l_partkey % 5 WHEN 0 THEN 'download' WHEN 1 THEN 'parse' WHEN 2 THEN 'split' WHEN 3 THEN 'stage' ELSE 'vector-upsert' END AS stage,
    CAST(l_linenumber % 4 AS BIGINT) AS attempts, l_shipdate AS due_at
  FROM lineitem)
"""
