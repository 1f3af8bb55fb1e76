"""Retrieval: visibility, recall, fusion, ranking, parent context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp, cosine, doubles, result_score
from ..shipping import bound_batches, ship_package
from .keyword_index import KeywordIndex, keyword_recall
from .vector_blocks import leading, packed

DEFAULTS = {"mode": "hybrid", "top_k": 5, "score_threshold": 0.3, "semantic_weight": 0.7, "keyword_weight": 0.3, "rerank_enabled": False}


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    top_k: int = 5
    score_threshold: float = 0.3
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3


def merge_options(request: Column, saved: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """The request's value, else the saved one, else the default; false is a value, null is none."""
    return {n: F.coalesce(request[n], saved[n], F.lit(DEFAULTS[n])) for n in names}


def active_indexes(indexes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Live active indexes of live datasets."""
    live = datasets.where(~F.col("deleted")).select(F.col("id").alias("dataset_id"))
    return indexes.where((F.col("status") == "active") & ~F.col("deleted")).join(live, "dataset_id", "left_semi")


def visible_segments(segments: DataFrame, documents: DataFrame, indexes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Completed live segments of active indexes, of documents that are live, enabled and not archived."""
    shown = documents.where(~F.col("deleted") & F.col("enabled") & ~F.col("archived")).select(F.col("id").alias("document_id"), "dataset_id")
    index = active_indexes(indexes, datasets).select(F.col("id").alias("dataset_index_id"))
    docs = shown.join(datasets.where(~F.col("deleted")).select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select("document_id")
    return segments.where(~F.col("deleted") & (F.col("status") == "completed")).join(index, "dataset_index_id", "left_semi").join(docs, "document_id", "left_semi")


def vector_hits(vectors: DataFrame, query: list[float], limit: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Exact top-k by cosine, clamped to [0, 1], ties by id. A constant query needs no join; only k rows a task leave it."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("id"), clamp(F.coalesce(cosine(F.col(vector_col), q), F.lit(0.0))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


#: Rows of a packed block of vectors or queries.
BLOCK = 1024


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """O1 for a table of queries (query_id, vector) of any size: blocks of vectors meet blocks of queries, and k rows a query leave each task.

    The product of both sides' partitions is the whole exact search; a task holds one pair of blocks and the k rows found so far.
    """
    ship_package(vectors.sparkSession)
    bound_batches(vectors.sparkSession)
    size, parts = BLOCK, vectors.sparkSession.sparkContext.defaultParallelism

    def blocks(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        rows = rows.select(F.col(id_col).alias("id"), doubles(vector_col).alias("v"))
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(lambda batches: packed(batches, size), f"ids array<{kind}>, dims int, cells binary").repartition(parts)

    asked = blocks(queries, "query_id", "vector").select(F.monotonically_increasing_id().alias("b"), F.col("ids").alias("query_ids"), F.col("dims").alias("query_dims"), F.col("cells").alias("query_cells"))
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(blocks(vectors, "id", "embedding"))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    kept = pairs.mapInArrow(lambda batches: leading(batches, k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_hits(segments: DataFrame, query_terms: list[str]) -> DataFrame:
    """Shared distinct terms over query terms, for every segment that shares one."""
    q = F.array(*[F.lit(t) for t in query_terms]).cast("array<string>")
    shared = F.size(F.array_intersect(F.col("keywords"), q))
    return segments.select("id", (shared / F.lit(max(1, len(query_terms)))).alias("score")).where(F.col("score") > 0)


def candidate_ids(*hits: DataFrame) -> DataFrame:
    """Distinct ids of all sources."""
    out = hits[0].select("id")
    for h in hits[1:]:
        out = out.unionAll(h.select("id"))
    return out.distinct()


def fuse(semantic: DataFrame | None, keyword: DataFrame | None, graph: DataFrame | None, visible: DataFrame, options: Options) -> DataFrame:
    """Id, score, match_type of visible candidates at or above the threshold.

    Maxima are taken over all hits, before visibility, and a maximum of zero counts as one.
    """
    spark = visible.sparkSession
    none = spark.createDataFrame([], visible.select(F.col("id"), F.lit(0.0).alias("score")).schema)
    s, k, g = (none if h is None else h.select("id", "score") for h in (semantic, keyword, graph))
    most = lambda h, name: h.agg(F.coalesce(F.nullif(F.max("score"), F.lit(0.0)), F.lit(1.0)).alias(name))
    joined = s.withColumnRenamed("score", "s").join(k.withColumnRenamed("score", "k"), "id", "full_outer").join(g.withColumnRenamed("score", "g"), "id", "full_outer")
    joined = joined.join(visible.select("id"), "id", "left_semi").join(F.broadcast(most(s, "ms")), F.lit(True)).join(F.broadcast(most(k, "mk")), F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kw = zero("k") / F.col("mk")
    if options.mode == "graph":
        score, match = zero("g"), F.lit("graph")
    elif options.mode == "vector":
        score, match = zero("s"), F.lit("vector")
    elif options.mode == "full_text":
        score, match = kw, F.lit("keyword")
    else:
        sem = zero("s") / F.col("ms")
        score = options.semantic_weight * sem + options.keyword_weight * kw
        match = F.when((sem != 0) & (kw != 0), "hybrid").when(sem != 0, "vector").otherwise("keyword")
    return joined.select("id", score.alias("score"), match.alias("match_type")).where(F.col("score") >= options.score_threshold)


def ranked(candidates: DataFrame, rerank: DataFrame | None = None) -> DataFrame:
    """before_rank by score and id; after_rank by the reranker's scores, if it scored every candidate.

    Candidates are few (top-k recall and threshold), so one window holds them.
    """
    by_score = Window.orderBy(F.desc("score"), "id")
    out = candidates.withColumn("before_rank", F.row_number().over(by_score))
    if rerank is None:
        return out.withColumn("after_rank", F.col("before_rank"))
    whole = Window.partitionBy()
    scored = out.join(rerank.select("id", F.col("score").alias("__r")), "id", "left").withColumn("__all", F.count("__r").over(whole) == F.count(F.lit(1)).over(whole))
    order = Window.orderBy(F.when(F.col("__all"), -F.col("__r")), "before_rank")
    return scored.withColumn("after_rank", F.row_number().over(order)).drop("__r", "__all")


def with_context(ranked_rows: DataFrame, segments: DataFrame, top_k: int) -> DataFrame:
    """The first hit of each context, with its parent's content where a completed parent exists."""
    fields = ("dataset_id", "dataset_index_id")
    parents = segments.where(~F.col("deleted") & (F.col("status") == "completed") & (F.col("index_type") == "parent") & F.col("content").isNotNull()).select(F.col("id").alias("parent_id"), *fields, F.lit(True).alias("__parent"))
    rows = ranked_rows.join(segments.select("id", "document_id", "parent_id", *fields), "id").join(parents, ["parent_id", *fields], "left")
    context = F.when(F.col("__parent"), F.col("parent_id")).otherwise(F.col("id"))
    first = F.row_number().over(Window.partitionBy("context_id").orderBy("after_rank"))
    best = rows.withColumn("context_id", context).withColumn("__first", first).where(F.col("__first") == 1)
    # contents are whole texts: only those of the top_k contexts are joined
    shown = F.broadcast(best.orderBy("after_rank").limit(top_k)).join(segments.select(F.col("id").alias("context_id"), "content"), "context_id")
    return shown.select("id", "document_id", "parent_id", "content", result_score(F.col("score")).alias("score"), "match_type", "after_rank").orderBy("after_rank")


def retrieve(segments: DataFrame, documents: DataFrame, indexes: DataFrame, datasets: DataFrame, options: Options, semantic: DataFrame | None = None, query_terms: list[str] | None = None, graph: DataFrame | None = None, rerank: DataFrame | None = None, keyword_index: KeywordIndex | None = None) -> DataFrame:
    """The whole read query, as one plan; keyword_index: the index of the live segments, else their keywords are scanned."""
    keyword = None
    if query_terms and options.mode in ("full_text", "hybrid"):
        if keyword_index is None:
            keyword = keyword_hits(segments.where(~F.col("deleted") & (F.col("status") == "completed")), query_terms)
        else:
            keyword = keyword_recall(segments.sparkSession, keyword_index, query_terms, options.mode, options.score_threshold, options.keyword_weight, semantic)
    visible = visible_segments(segments, documents, indexes, datasets)
    return with_context(ranked(fuse(semantic, keyword, graph, visible, options), rerank), segments, options.top_k)


def request_order(ids: list, rows: DataFrame) -> DataFrame:
    """Rows in the order of the first mention of each id; a missing id gives nulls."""
    spark = SparkSession.active()
    asked = spark.range(1).select(F.posexplode(F.array_distinct(F.array(*map(F.lit, ids)))).alias("p", "id"))
    return asked.select((F.col("p") + 1).cast("long").alias("ord"), F.col("id").cast(rows.schema["id"].dataType)).join(rows, "id", "left").orderBy("ord")


def capped_preview(rows: DataFrame, most: int) -> DataFrame:
    """The first rows by document order and position, with the full total and whether it was cut."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("ord", "position").limit(most).join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total") > most)


def referenced(results: DataFrame) -> DataFrame:
    """Results numbered for emission one by one."""
    return results.withColumn("reference", F.row_number().over(Window.orderBy("after_rank")).cast("long"))


def referenced_all(results: DataFrame, ranges: int = 256) -> DataFrame:
    """S22 for a whole table with a numeric after_rank: rows are numbered within ranges of it, beside the counts of the ranges before."""
    edges = results.approxQuantile("after_rank", [k / ranges for k in range(1, ranges)], 0.001)
    place = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(edges))]).cast("array<double>"), lambda x: F.col("after_rank") > x))
    placed = results.withColumn("__range", place)
    # at most as many rows as ranges
    before = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy("after_rank"))
    return placed.withColumn("__within", within).join(F.broadcast(before), "__range").withColumn("reference", (F.col("__within") + F.col("__before")).cast("long")).drop("__range", "__within", "__before")
