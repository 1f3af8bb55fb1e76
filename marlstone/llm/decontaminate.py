"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A seed is a fixed mask laid over an item: words at the mask's offsets count, those between are ignored. An item of n words
may lose s = n less the needed matches to substitutions. Its masks are combs:

* one tooth class: offsets 0, b, 2b, ... with b = s + 1, laid at 0 to b - 1. The b placements share no word, so s
  substitutions leave one of them whole.
* two tooth classes, for up to PAIRED substitutions where that gives more words: b = s + 2, offsets 0, d, b, b + d, 2b, ... for each d
  below b, laid at 0 to b - 1 - d. These are all pairs of the b residue classes; s substitutions leave two classes, so one pair, whole.

The number of teeth is that of the shortest items with the same s, and TEETH at most, so items of all lengths share
few masks. Every position of every document is hashed under every mask in use and joined with the items' seeds. Each hit fixes a
diagonal (document offset minus item offset); along it the whole item is compared with the
document, word by word, and the pair is reported when enough words agree. So every
alignment with enough agreeing words is found, whatever the item's length, down to one
word.

The benchmark side is broadcast only after its size is checked; beyond the bound
seeds alone are shuffled (a very common seed is split by adaptive execution). The texts that have hits are joined back to them,
no others are shuffled. Defined cases: null or empty texts have no hits; a document's end counts
as substitutions of the words beyond it; at least one word must agree; rows repeated in either
table give one row for each distinct (doc_id, item_id), the best alignment of all texts of that id; a null id is an id;
empty tables give an empty result; texts are used whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, text_key

#: Teeth of a mask's class at most, and substitutions up to which masks take two classes.
TEETH, PAIRED = 4, 4
#: Words that the masks of one pass over the texts read.
LOADS = 56
#: A seed of the benchmark side takes about 40 bytes and a word 8; up to this many words, so fewer seeds, are broadcast.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each as 64 bits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def needed(n: int, min_match: float) -> int:
    """Words of an item of n words that must agree."""
    return max(1, math.ceil(min_match * n))


def masks(n: int, min_match: float) -> list[tuple[tuple[int, ...], int]]:
    """(offsets, placements) of the masks of an item of n words; a mask is laid at 0 to placements - 1."""
    lost = n - needed(n, min_match)
    shortest = n
    while shortest > 1 and (shortest - 1) - needed(shortest - 1, min_match) == lost:
        shortest -= 1
    teeth = lambda b: min(TEETH, shortest // b)
    one, two = lost + 1, lost + 2
    if 1 <= lost <= PAIRED and 2 * teeth(two) > teeth(one):
        return [(tuple(k * two + x for k in range(teeth(two)) for x in (0, d)), two - d) for d in range(1, two)]
    return [(tuple(k * one for k in range(teeth(one))), one)]


def _seed(offsets: tuple[int, ...], words: list[Column]) -> Column:
    """64-bit hash of the words at a mask's offsets, and of the mask."""
    return F.xxhash64(F.lit(zlib.crc32(",".join(map(str, offsets)).encode())), *words)


def _placed(offsets: tuple[int, ...], count: int) -> Column:
    """The mask's seeds (j, seed) at item positions 0 to count - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.struct(j.alias("j"), _seed(offsets, [F.get("h", j + p) for p in offsets]).alias("seed")))


def _needed(n: Column, min_match: float) -> Column:
    """`needed` as an expression."""
    return F.greatest(F.lit(1), F.ceil(F.lit(min_match) * n)).cast("int")


def _item_seeds(items: DataFrame, lengths: dict[int, list]) -> DataFrame:
    """seed, item_id, item_key, j, item_words: one row for each placed mask of each item."""
    by_mask: dict[tuple, list[int]] = {}
    for n, placed in lengths.items():
        for mask in placed:
            by_mask.setdefault(mask, []).append(n)
    n, none = F.size("h"), F.array().cast("array<struct<j:int,seed:bigint>>")
    laid = [F.when(n.isin(fits), _placed(offsets, count)).otherwise(none) for (offsets, count), fits in by_mask.items()]
    at = items.select("item_id", "item_key", n.alias("item_words"), F.explode(F.flatten(F.array(*laid)) if laid else none).alias("s"))
    return at.select("s.seed", "item_id", "item_key", "s.j", "item_words")


def _seeded(df: DataFrame, shapes: list[tuple[int, ...]], *keep: str) -> list[DataFrame]:
    """keep, i, seed: in all parts together a row for each mask and position. Masks of LOADS words together take one pass over the texts, as the compiled code of more is slow."""
    groups, room = [[]], LOADS
    for shape in shapes:
        if groups[-1] and len(shape) > room:
            groups.append([])
            room = LOADS
        groups[-1].append(shape)
        room -= len(shape)
    at = df.select(*keep, "h", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))).alias("i"))
    word = lambda p: F.get("h", F.col("i") + p)
    return [at.select(*keep, "i", F.explode(F.array(*[_seed(x, [word(p) for p in x]) for x in group])).alias("seed")) for group in groups]


_ROW = ["doc_id", "key", "key2"]


def _matches(docs: DataFrame, benchmark: DataFrame, min_match: float, text_col: str) -> DataFrame:
    """doc_id, key, key2 (the text's), item_id, item_words, doc_offset, matched_words of every alignment with enough agreeing words."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).withColumn("item_key", F.xxhash64("h"))
    items = materialize(items.dropDuplicates(["item_id", "item_key"]), "benchmark-words")
    # one row for each length in words that an item has
    lengths = {r["n"]: masks(r["n"], min_match) for r in items.select(F.size("h").alias("n")).where("n > 0").distinct().collect()}
    keys = materialize(_item_seeds(items, lengths), "benchmark-seeds")
    shapes = sorted({offsets for placed in lengths.values() for offsets, _ in placed}) or [(0,)]
    bodies = items.select("item_id", "item_key", F.col("h").alias("item_h"))
    key, key2 = text_key(F.col(text_col))
    worded = docs.select("doc_id", key.alias("key"), key2.alias("key2"), word_hashes(F.col(text_col)).alias("h"))
    diagonal = (F.col("i") - F.col("j")).alias("diagonal")
    small = items.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    # each part meets the seeds before the parts are put together: few rows come through
    parts = [p.join(F.broadcast(keys) if small else keys, "seed").select(*_ROW, "item_id", "item_key", "item_words", diagonal) for p in _seeded(worded, shapes, *_ROW)]
    hits = materialize(reduce(DataFrame.unionAll, parts).distinct(), "benchmark-hits")
    bodies = F.broadcast(bodies) if small else bodies
    of = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"]) & (a["key2"] == b["key2"])
    hit_rows = broadcast_if_small(hits.select(*_ROW).distinct())
    texts = worded.join(hit_rows, of(worded, hit_rows), "left_semi").dropDuplicates(_ROW)
    hits = hits.join(texts, of(hits, texts)).select(*[hits[c] for c in hits.columns], texts["h"])
    # the item's stretch of the document, cut at the document's ends
    stretch = F.slice("h", F.greatest(F.lit(1), F.col("diagonal") + 1), F.col("item_words") + F.least(F.lit(0), F.col("diagonal")))
    aligned = hits.select(*_ROW, "item_id", "item_key", "item_words", "diagonal", stretch.alias("stretch")).join(bodies, ["item_id", "item_key"])
    skipped = F.greatest(F.lit(0), -F.col("diagonal"))
    agree = F.zip_with("stretch", F.slice("item_h", skipped + 1, F.size("stretch")), lambda a, b: a.eqNullSafe(b))
    scored = aligned.select(*_ROW, "item_id", "item_words", F.col("diagonal").alias("doc_offset"), F.size(F.filter(agree, lambda x: x)).alias("matched_words"))
    return scored.where(F.col("matched_words") >= _needed(F.col("item_words"), min_match))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: float = 0.8, text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched_words, item_words, doc_offset of the best alignment of each leaking pair."""
    scored = _matches(docs, benchmark, min_match, text_col)
    best = F.max_by(F.struct("matched_words", "item_words", "doc_offset"), F.struct("matched_words", -F.col("doc_offset")))
    found = scored.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("matched_words", "item_words", "doc_offset")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item: judged by their text alone, whatever their doc_id."""
    leaks = materialize(_matches(docs, benchmark, min_match, text_col).select(F.col("key").alias("k"), F.col("key2").alias("k2")).distinct(), "benchmark-leaks")
    leaks = broadcast_if_small(leaks)
    key, key2 = text_key(F.col(text_col))
    return docs.join(leaks, (key == leaks["k"]) & (key2 == leaks["k2"]), "left_anti")
