"""J10 for tables: which entities does each text name? One pass of an automaton over each text, no cross join.

The distinct names, in small letters, are cut into shards of at most `SHARD_CHARACTERS` (a longer name is a shard of its own). A round
broadcasts one shard; each task builds an Aho-Corasick automaton of it and runs every text through once, which finds all
names that the text contains, overlapping ones too. So memory is bounded whatever the number of names, and the passes over the texts
are its total size over the shard's. Names then meet their entities in an equi-join, so a name that many entities bear costs
its rows alone.

As in the one-question form a name has at least two characters, and case is ignored by small letters on both sides. Null texts and names
match nothing; a text without mentions has no row; repeated texts and entities count once by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_CHARACTERS = 5_000_000
SHORTEST = 2


def _finder(shared):
    """Rows row key, text to row key, name: each name of the shard that the text contains, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            keys, names = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = sorted({name for _, name in automaton.iter(text)}) if text else []
                keys += [k] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(names, pa.string())], ["row", "name"])

    return run


def mentions(texts: DataFrame, entities: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of texts but text_col, and entity_id: every entity (entity_id, name) whose name the text contains."""
    spark = texts.sparkSession
    names = entities.select(F.lower("name").alias("name")).where(F.length("name") >= SHORTEST).distinct()
    size = names.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    shards = max(1, -(-2 * size // SHARD_CHARACTERS))  # hashed shards: half full on average
    sharded = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    keys = [c for c in texts.columns if c != text_col]
    rows = texts.where(F.col(text_col).isNotNull()).select(F.struct(*keys).alias("row"), F.lower(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = None
    for shard in range(shards):
        words = [r["name"] for r in sharded.where(F.col("shard") == shard).select("name").collect()]
        if words:
            hits = rows.mapInArrow(_finder(spark.sparkContext.broadcast(words)), f"row {kind}, name string")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return texts.select(*keys).join(entities.select("entity_id").limit(0), F.lit(True))
    named = entities.select("entity_id", F.lower("name").alias("name"))
    return found.join(named, "name").select("row.*", "entity_id").distinct()
