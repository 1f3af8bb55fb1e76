"""Entity graph and static property graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, categories, strip

#: Bounds of an extraction.
MOST_ENTITIES, MOST_RELATIONS, MOST_ATTRIBUTES = 100, 200, 20
LONGEST_NAME, LONGEST_TYPE, LONGEST_RELATION, LONGEST_KEY, LONGEST_VALUE = 200, 80, 100, 80, 500


def grounded_entities(payloads: DataFrame) -> DataFrame:
    """P10: segment_id, name, type, attributes of entities that the text mentions; the first of equal names.

    payloads: segment_id, text, entities array<struct<name,type,attributes map>>.
    """
    at = payloads.select("segment_id", casefold(F.col("text")).alias("__text"), F.posexplode(F.slice("entities", 1, MOST_ENTITIES)).alias("ord", "e"))
    named = at.select("segment_id", "__text", "ord", strip(F.col("e.name")).alias("name"), strip(F.col("e.type")).alias("type"), F.col("e.attributes").alias("a"))
    sized = named.where(F.length("name").between(1, LONGEST_NAME) & F.length("type").between(1, LONGEST_TYPE))
    found = sized.where(F.contains(F.col("__text"), casefold(F.col("name"))))
    pairs = F.filter(F.transform(F.map_entries("a"), lambda x: F.struct(strip(x["key"]).alias("key"), strip(x["value"]).alias("value"))), lambda x: (x["key"] != "") & (x["value"] != ""))
    cut = F.slice(F.transform(pairs, lambda x: F.struct(F.substring(x["key"], F.lit(1), F.lit(LONGEST_KEY)).alias("key"), F.substring(x["value"], F.lit(1), F.lit(LONGEST_VALUE)).alias("value"))), 1, MOST_ATTRIBUTES)
    first = F.row_number().over(Window.partitionBy("segment_id", "name").orderBy("ord"))
    return found.withColumn("__first", first).where(F.col("__first") == 1).select("segment_id", "ord", "name", "type", cut.alias("attributes"))


def valid_relations(payloads: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct segment_id, source, target, type whose ends are kept entities. payloads: segment_id, relations."""
    at = payloads.select("segment_id", F.explode(F.slice("relations", 1, MOST_RELATIONS)).alias("r"))
    named = at.select("segment_id", strip(F.col("r.source")).alias("source"), strip(F.col("r.target")).alias("target"), strip(F.col("r.type")).alias("type"))
    for end in ("source", "target"):
        named = named.join(entities.select("segment_id", F.col("name").alias(end)), ["segment_id", end], "left_semi")
    return named.where(F.length("type").between(1, LONGEST_RELATION)).select("segment_id", "source", "target", "type").distinct()


def mentioned_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities of two letters or more whose name the query contains in any case."""
    return entities.where((F.length("name") >= 2) & F.contains(F.lower(F.lit(query)), F.lower("name")))


def graph_hits(seeds: DataFrame, related: DataFrame, mentions: DataFrame, limit: int | None = None) -> DataFrame:
    """Segments that mention a seed or an entity one undirected step from it, score 1; ordered by id before a limit.

    seeds: entity_id; related: source_id, target_id; mentions: segment_id, entity_id.
    """
    s = seeds.select("entity_id").distinct()
    ahead = related.join(s, related["source_id"] == s["entity_id"], "left_semi").select(F.col("target_id").alias("entity_id"))
    back = related.join(s, related["target_id"] == s["entity_id"], "left_semi").select(F.col("source_id").alias("entity_id"))
    reached = s.unionAll(ahead).unionAll(back).distinct()
    found = mentions.join(reached, "entity_id", "left_semi").select(F.col("segment_id").alias("id")).distinct().withColumn("score", F.lit(1.0))
    return found if limit is None else found.orderBy("id").limit(limit)


def remaining_extractions(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments whose id and fingerprint are not recorded yet."""
    return segments.join(done.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def orphan_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that no segment mentions."""
    return entities.join(mentions.select("entity_id"), "entity_id", "left_anti")


def exclusive_entities(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Entities that only the given documents mention. mentions: entity_id, document_id; no self-join needed."""
    named = mentions.join(documents.select("document_id", F.lit(True).alias("__own")).distinct(), "document_id", "left")
    own = F.coalesce("__own", F.lit(False))
    return named.groupBy("entity_id").agg(F.every(own).alias("only")).where("only").select("entity_id")


def upsert_facts(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A segment's old mentions and relations give way to its new ones; entities take the last value; orphans go.

    Tables: segments(segment_id), mentions(segment_id, entity_id), related(segment_id, source_id, target_id, type), entities(entity_id, name, type).
    """
    touched = new["segments"].select("segment_id").distinct()
    out = {t: old[t].join(touched, "segment_id", "left_anti").unionByName(new[t]).distinct() for t in ("segments", "mentions", "related")}
    entities = old["entities"].join(new["entities"].select("entity_id"), "entity_id", "left_anti").unionByName(new["entities"].dropDuplicates(["entity_id"]))
    out["entities"] = entities.join(out["mentions"].select("entity_id"), "entity_id", "left_semi")
    return out


def duplicate_ids(nodes: DataFrame, key: str) -> DataFrame:
    """Ids that break uniqueness: must be empty."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


# --- static property graph --------------------------------------------------------------------------------

#: Where ids of instances begin (compared as text), and relationship codes.
INSTANCE_IDS = "200000000"
EDGE_TYPES = {"801000001": "REQUIRES", "801000003": "CONTAINS_STEP", "801000004": "BELONGS_TO_CATEGORY", "801000005": "HAS_DIFFICULTY_LEVEL"}


def load_nodes(rows: DataFrame) -> DataFrame:
    """Named nodes with their kind, numbers tried, and whether they have synonyms. rows: text columns."""
    hierarchy = F.col("nodeId") < INSTANCE_IDS
    synonyms = F.coalesce((F.col("synonyms") != "") & (F.col("synonyms") != "[]"), F.lit(False))
    return rows.where(F.col("nodeId").isNotNull() & F.col("name").isNotNull()).select("*", hierarchy.alias("is_hierarchy"), synonyms.alias("has_synonyms"))


def load_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of known types between known nodes, with the step order as a number."""
    kind = F.create_map(*[F.lit(x) for pair in EDGE_TYPES.items() for x in pair])[F.col("relationshipType")]
    ids = nodes.select("nodeId")
    typed = rows.withColumn("type", kind).where(F.col("type").isNotNull())
    for end in ("startNodeId", "endNodeId"):
        typed = typed.join(ids.withColumnRenamed("nodeId", end), end, "left_semi")
    return typed.withColumn("step_order", F.col("step_order").try_cast("double"))


def category_edges(nodes: DataFrame) -> DataFrame:
    """Node, category for every part of its category list."""
    return nodes.select("nodeId", F.explode(categories(F.col("category"))).alias("category")).distinct()


def pairs_with_equal(nodes: DataFrame, key: str, limit: int = 1000, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of different nodes with an equal value, both ways, the first `limit` by value and ids.

    Only the first limit + 2 nodes of a value can appear among the first `limit` pairs, so each value is
    cut to them before the self-join; the order, which the source leaves open, makes this exact.
    """
    keys = [key, *also]
    ranked = nodes.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("nodeId"))).where(F.col("__r") <= limit + 2)
    a = ranked.select(*keys, F.col("nodeId").alias("a"))
    b = ranked.select(*keys, F.col("nodeId").alias("b"))
    return a.join(b, keys).where("a <> b").orderBy(*keys, "a", "b").limit(limit)


def next_steps(steps: DataFrame) -> DataFrame:
    """A, b of consecutive step numbers within a recipe. steps: recipe, nodeId, step."""
    later = steps.select("recipe", F.col("nodeId").alias("b"), (F.col("step") - 1).alias("step"))
    return steps.select("recipe", F.col("nodeId").alias("a"), "step").join(later, ["recipe", "step"]).select("recipe", "a", "b")


def difficulty_edges(recipes: DataFrame, levels: DataFrame) -> DataFrame:
    """Recipe and level where the level equals the recipe's whole difficulty."""
    return recipes.withColumn("level", F.col("difficulty").cast("int")).join(levels, "level")


def label_histogram(nodes: DataFrame, excluded: tuple[str, ...] = ("Category", "ConceptType")) -> DataFrame:
    """Nodes of each label."""
    return nodes.where(~F.col("label").isin(*excluded)).groupBy("label").agg(F.count("*").alias("n")) if excluded else nodes.groupBy("label").agg(F.count("*").alias("n"))


def edge_histogram(edges: DataFrame) -> DataFrame:
    """Edges of each type."""
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def degree(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Edges that leave each node, zero for none. The count comes before the join."""
    n = edges.groupBy("nodeId").agg(F.count("*").alias(name))
    return nodes.select("nodeId").join(n, "nodeId", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def concept_types(nodes: DataFrame) -> Column | DataFrame:
    """Distinct concept types that aren't empty."""
    return nodes.where(F.coalesce(F.col("conceptType"), F.lit("")) != "").select("conceptType").distinct()
