"""Exact n-gram Jaccard self-join by vertical partitioning.

Every text becomes a set of 64-bit shingles in one global order: rare shingles first, then
by hash. Equal sets form a class, and classes are joined:

1. Sets. Digest, size and an XOR sketch of every document; shingles frequent in any chunk of
   documents (the partition argument: a share of all shingles is reached in some chunk).
   At most 1 / FREQUENT_SHARE shingles can be frequent, which bounds what is broadcast.
2. Prefixes. Linked sets share a shingle of their prefixes, so prefix postings are shuffled
   by shingle, the buckets of very frequent ones dealt to several tasks. Small buckets give all
   their pairs; in large ones each class is paired with the leader of its size band and the
   bands beside it (near copies link to their original), and leaders of one bucket's
   parts with each other.
3. Verification. Pairs pass length, position and sketch bounds, which lose no link. The sets of
   classes still in play are cut into FRAGMENTS fragments of the global order (two of its rare
   part, two of its frequent part); partial overlaps are counted fragment by fragment and summed by pair.
4. Components of the found links. In the large buckets that still hold several components, every
   class outside the bucket's main component is compared with all others of other components, under the same bounds
   (sketches travel with the postings, buckets are dealt in blocks of BLOCK classes). A first round verifies the
   best partner of each class alone; a second one, with the components known then, every
   pair left. Pairs inside a component change nothing, so the components are those of all links.

Defined cases: null or empty texts, and texts without words, have an empty set and are their own
component; texts of fewer words than a shingle are one shingle; repeated rows are
equal sets; a null doc_id is kept and never represents a class that has other members; extra columns
are ignored; an empty table gives an empty result. Texts are used whole, whatever their length. Two different
sets with equal 64-bit digests would be noticed by the other half of the digest and the join repeats under another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import bound_batches, broadcast_if_small, discard, materialize, releasing, text_key
from .components import connected_components

#: A shingle is frequent when it makes up this share of all shingles.
FREQUENT_SHARE = 2e-6
CHUNK_SHINGLES, CHUNK_LEAST = 2_000_000, 4
#: Buckets of up to so many classes give all their pairs.
SMALL_BUCKET = 6
#: Half of the fragments cut the rare part of the order, half the frequent part.
FRAGMENTS = 4
#: An XOR sketch has a power of two of 64-bit words: so many at least, and one for so many shingles at least.
SKETCH_LEAST, SKETCH_SHINGLES = 8, 96
BLOOM_WORDS = 1 << 18
#: Postings of a frequent shingle are dealt to a task for so many documents; classes of a large bucket are compared in blocks.
SALT_ROWS, BLOCK = 2_000, 4_096

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_WORDS: dict[bytes, int] = {}


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORDS
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 100_000:
            known.clear()
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:  # the whole sequence as one shingle, apart from all longer ones
        odd = _MIX[np.arange(len(h)) % len(_MIX)]
        return _finish(np.array([len(h)], np.uint64) + (h * odd).sum(keepdims=True))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * (_MIX[k % len(_MIX)] + np.uint64(2 * (k // len(_MIX))))
    return np.unique(_finish(total))


def _digest(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16, key=bytes([seed])).digest()
    return tuple(np.frombuffer(d, np.int64).tolist())


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each bit: two sketches differ in at most as many bits as the sets in shingles."""
    words = SKETCH_LEAST
    while words * SKETCH_SHINGLES < len(shingles):
        words *= 2
    # the lowest bits choose the word, so that a longer sketch folds to a shorter one word by word
    at = (shingles >> np.uint64(7)).astype(np.int64)
    parity = np.bincount((at & (words - 1)) * 64 + ((at >> 32) & 63), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """(doc_id, key, key2) and text of every row."""
    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "key2")), strict=True))
        for k, text in enumerate(batch.column("text")):
            yield ids[k], text.as_py()


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's 128-bit key, and the text, null as empty."""
    key, key2 = text_key(F.col(text_col))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), key2.alias("key2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _sets(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """A row for each document (kind 0), and for each shingle frequent in a chunk (kind 1: shingle c, count n)."""
    names = ["kind", "doc_id", "key", "key2", "n", "c", "c2", "sketch"]
    kinds = [pa.int8(), *[pa.int64()] * 6, pa.list_(pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chunk: list[np.ndarray] = []
        classes: set[int] = set()
        size = 0

        def frequent() -> list[tuple]:
            if not chunk:
                return []
            values, counts = np.unique(np.concatenate(chunk), return_counts=True)
            often = counts >= max(CHUNK_LEAST, FREQUENT_SHARE * size)
            return [(1, None, None, None, c, v, None, None) for v, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

        for row, text in _texts(batches):
            s = shingle_set(text, width)
            if not len(s):
                out.append((0, *row, 0, None, None, None))
            else:
                c, c2 = _digest(s, seed)
                out.append((0, *row, len(s), c, c2, _sketch(s).tolist()))
                if c not in classes:  # copies within the chunk count once
                    classes.add(c)
                    chunk.append(s)
                    size += len(s)
            if size >= CHUNK_SHINGLES:
                out += frequent()
                chunk, size = [], 0
                classes.clear()
            if len(out) >= 5000:
                yield batch(out)
                out = []
        out += frequent()
        if out:
            yield batch(out)

    return rows.mapInArrow(releasing(run), "kind byte, doc_id long, key long, key2 long, n long, c long, c2 long, sketch array<long>")


def _need(n, percent: int):
    """Least overlap that a set of n shingles has with a linked one."""
    return -(-percent * n // 100)


def _packed(rare: int, n: int, places: np.ndarray) -> np.ndarray:
    """k: level of the share of rare shingles (0 none, 7 half or more), size and position, in 3, 30 and 30 bits.

    A Spark string has less than 2^31 bytes, so a set has less than 2^30 shingles.
    """
    level = 0 if not rare else max(1, 8 - (n // rare).bit_length())
    return (np.int64(level) << np.int64(60)) | (np.int64(n) << np.int64(30)) | places.astype(np.int64)


def _size(k):
    return (k >> 30) & ((1 << 30) - 1)


def _place(k):
    return k & ((1 << 30) - 1)


def _known(values: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values stand in the sorted array often, and where."""
    if not len(often):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
    return often[at] == values, at


def _postings(rows: DataFrame, shared, width: int, seed: int, percent: int) -> DataFrame:
    """s (shingle), z (part of a very frequent shingle's bucket, else 0), k (packed), c (class) of every prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, salts = shared.value
        parts: list[tuple] = []
        seen: set[int] = set()
        size = 0
        for text in (x.as_py() for batch in batches for x in batch.column("text")):
            s = shingle_set(text, width)
            n = len(s)
            if n:
                c = _digest(s, seed)[0]
                if c not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
                    heavy, at = _known(s, often)
                    ordered, rare = np.concatenate([s[~heavy], s[heavy]]), int(n - heavy.sum())
                    p = n - _need(n, percent) + 1
                    z = np.zeros(p, np.int32)
                    if p > rare and len(often):
                        parted = salts[at[heavy][: p - rare]]
                        z[rare:] = np.where(parted > 1, 1 + (c & 0x7FFFFFFF) % parted, 0)
                    parts.append((ordered[:p].view(np.int64), z, _packed(rare, n, np.arange(p)), np.full(p, c, np.int64)))
                    size += p
            if size >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["s", "z", "k", "c"])
                parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["s", "z", "k", "c"])

    return rows.select("text").mapInArrow(releasing(run), "s long, z int, k long, c long")


def _possible(n, i, m, j, percent: int, first: bool = True):
    """Whether sets of n and m shingles that share the shingle at positions i and j can be linked.

    first: the shingle is taken for their first common one. A linked pair that has an earlier one passes
    in that one's bucket, so generating pairs by this bound loses none.
    """
    overlap = -(-percent * (n + m) // (100 + percent))
    reach = 1 + np.minimum(n - i - 1, m - j - 1) + (0 if first else np.minimum(i, j))
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (reach >= overlap)


#: Kinds of candidate rows.
PAIR, POSTING, LEADER = 0, 1, 2
_FOUND = ["kind", "s", "k", "x", "y", "nx", "ny"]
_FOUND_SCHEMA = "kind byte, s long, k long, x long, y long, nx long, ny long"


def _ordered(x, y, nx, ny) -> np.ndarray:
    """Pairs with the lesser class first, each once."""
    swap = x > y
    return np.unique(np.stack([np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)], axis=1), axis=0)


def _pair_batch(x, y, nx, ny) -> pa.RecordBatch:
    table = _ordered(x, y, nx, ny)
    nulls = pa.nulls(len(table), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(table), PAIR, np.int8)), nulls, nulls, *(pa.array(np.ascontiguousarray(table[:, q])) for q in range(4))], names=_FOUND)


def _bucket_rows(kind: int, s, k, c) -> pa.RecordBatch:
    nulls = pa.nulls(len(s), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), kind, np.int8)), pa.array(s), pa.array(k), pa.array(c), nulls, nulls, nulls], names=_FOUND)


def _numpy(column: pa.Array) -> np.ndarray:
    """A column as numpy; lists as an object array of arrays."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.fromiter(np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]), object, len(column))


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """First places of the runs of equal keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Columns sorted by the first `keys` ones, cut so that runs stay whole: (columns, run starts, continues).

    Runs of more than `most` rows come in pieces of more than that; continues marks the pieces after the first.
    """
    held: list[np.ndarray] | None = None
    continues = False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [_numpy(batch.column(c)) for c in columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        starts = _starts(now[:keys])
        last = starts[-1]
        if last:
            # the held rows may be what is left of a run that came in pieces
            yield [x[:last] for x in now], starts[:-1], continues
            continues = False
        held = [x[last:].copy() for x in now]
        if len(held[0]) > most:
            yield held, np.array([0]), continues
            # one row stays to tell whether the run goes on
            held, continues = [x[-1:] for x in held], True
    if held is not None and len(held[0]):
        yield held, np.array([0]), continues


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    """Size bands: linked sizes lie in one band or two neighbours."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of small buckets, pairs with leaders in large ones, and the postings and leaders of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict[int, tuple[int, int, int]] = {}
        for columns, _, continues in _runs(batches, ["s", "z", "k", "c"], 2, 100_000):
            if not continues:
                leaders = {}
            # a class stands once in a run
            s, z, k, c = (x[_starts(columns)] for x in columns)
            starts = _starts([s, z])
            ends = np.append(starts[1:], len(s))
            sizes, n, i = ends - starts, _size(k), _place(k)
            found: list[tuple] = []
            kept: list[tuple] = []
            heads: list[tuple] = []
            # parts of one bucket and pieces of one run are large whatever their own size
            large = (sizes > SMALL_BUCKET) | (z[starts] > 0)
            large[0] |= continues
            small = ~large & (sizes >= 2)
            # all pairs of small buckets, by distance within the bucket
            if small.any():
                of = np.repeat(np.where(small, ends, 0), sizes)
                for step in range(1, int(sizes[small].max())):
                    a = np.flatnonzero(np.arange(len(s)) + step < of)
                    b = a + step
                    ok = _possible(n[a], i[a], n[b], i[b], percent)
                    a, b = a[ok], b[ok]
                    found.append((c[a], c[b], n[a], n[b]))
            for r in np.flatnonzero(large):
                lo, hi = starts[r], ends[r]
                if r or not continues:
                    leaders = {}
                band = _band(n[lo:hi], percent)
                order, firsts = np.unique(band, return_index=True)
                for b, f in zip(order.tolist(), (lo + firsts).tolist(), strict=True):
                    if b not in leaders:
                        leaders[b] = (int(c[f]), int(n[f]), int(i[f]))
                        if z[f] > 0:
                            heads.append((s[f], k[f], c[f]))
                for b in order.tolist():
                    own = lo + np.flatnonzero(band == b)
                    for other in (b - 1, b, b + 1):
                        if other in leaders:
                            lc, ln, li = leaders[other]
                            ok = own[_possible(n[own], i[own], ln, li, percent, first=False) & (c[own] != lc)]
                            found.append((c[ok], np.full(len(ok), lc), n[ok], np.full(len(ok), ln)))
                kept.append((s[lo:hi], k[lo:hi], c[lo:hi]))
            if kept:
                yield _bucket_rows(POSTING, *(np.concatenate(x) for x in zip(*kept, strict=True)))
            if heads:
                yield _bucket_rows(LEADER, *(np.array(x, np.int64) for x in zip(*heads, strict=True)))
            found = [f for f in found if len(f[0])]
            if found:
                yield _pair_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    dealt = postings.repartition("s", "z").sortWithinPartitions("s", "z", "k", "c")
    return dealt.mapInArrow(releasing(run), _FOUND_SCHEMA)


def _popcounts(sketches: np.ndarray) -> list[np.ndarray]:
    """For each power of two of words, the sketches folded to it (rows of shorter ones are zero)."""
    width = np.array([len(x) for x in sketches])
    words, out = SKETCH_LEAST, []
    while words <= width.max(initial=SKETCH_LEAST):
        rows = np.zeros((len(sketches), words), np.int64)
        for w in np.unique(width[width >= words]).tolist():
            at = np.flatnonzero(width == w)
            rows[at] = np.bitwise_xor.reduce(np.concatenate(sketches[at]).reshape(len(at), w // words, words), axis=1)
        out.append(rows)
        words *= 2
    return out


def _near(buckets: DataFrame, sketches: DataFrame, percent: int, best: bool) -> DataFrame:
    """x, y, nx, ny, score: pairs of different components within large buckets (s, k, c, root) that all bounds allow.

    A bucket's classes outside its main component are compared with all of its classes. The bucket is
    cut into blocks; those classes visit every block and the block's own rows are held, so a task
    holds one block, whatever the bucket's size. best: only the nearest partner that a class has in a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "b", "away", "k", "c", "root", "own", "main", "sketch"]
        home: tuple | None = None
        for columns, starts, continues in _runs(batches, names, 2, 4 * BLOCK):
            found: list[tuple] = []
            for r, (lo, hi) in enumerate(zip(starts, np.append(starts[1:], len(columns[0])), strict=True)):
                k, c, root, own, main, sketch = (x[lo:hi] for x in columns[3:])
                n, i = _size(k), _place(k)
                if r or not continues:
                    # by size: the partners of a class lie in one stretch
                    rows = np.flatnonzero(own)
                    rows = rows[np.argsort(n[rows], kind="stable")]
                    home = (n[rows], i[rows], c[rows], root[rows], main[rows], sketch[rows])
                hn, hi_, hc, hroot, hmain, hsketch = home
                probes = np.flatnonzero(~main)
                probes = probes[np.argsort(n[probes], kind="stable")]
                if not len(hn) or not len(probes):
                    continue
                folded = None
                tile = max(1, 200_000 // len(hn))
                for t in range(0, len(probes), tile):
                    p = probes[t : t + tile]
                    first, last = np.searchsorted(hn, -(-percent * n[p[0]] // 100)), np.searchsorted(hn, 100 * n[p[-1]] // percent, "right")
                    if first == last:
                        continue
                    ok = _possible(n[p][:, None], i[p][:, None], hn[None, first:last], hi_[None, first:last], percent)
                    ok &= root[p][:, None] != hroot[None, first:last]
                    if not best:  # two classes outside the main component meet in both their blocks
                        ok &= hmain[None, first:last] | (c[p][:, None] < hc[None, first:last])
                    a, b = np.nonzero(ok)
                    if not len(a):
                        continue
                    a, b = p[a], b + first
                    if folded is None:
                        folded = _popcounts(np.concatenate([sketch, hsketch]))
                        width = np.array([len(x) for x in sketch]), np.array([len(x) for x in hsketch])
                    words = np.minimum(width[0][a], width[1][b])
                    differ = np.zeros(len(a), np.int64)
                    for q, rows in enumerate(folded):
                        at = np.flatnonzero(words == SKETCH_LEAST << q)
                        for u in range(0, len(at), 20_000):
                            v = at[u : u + 20_000]
                            differ[v] = np.bitwise_count((rows[a[v]] ^ rows[len(sketch) + b[v]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                    size = n[a] + hn[b]
                    ok = (100 + percent) * differ <= (100 - percent) * size
                    a, b, score = a[ok], b[ok], (differ[ok] << 20) // size[ok]
                    if best and len(a):
                        order = np.lexsort((hc[b], score, a))
                        order = order[_starts([a[order]])]
                        a, b, score = a[order], b[order], score[order]
                    if len(a):
                        found.append((c[a], hc[b], n[a], hn[b], score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["x", "y", "nx", "ny", "score"])

    rooted = buckets.groupBy("s", "root").agg(F.count("*").alias("m"))
    mixed = rooted.groupBy("s").agg(F.sum("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = buckets.join(mixed, "s").select("s", "k", "c", "root", (F.col("root") == F.col("most")).alias("main"), F.pmod(F.xxhash64("c"), blocks).cast("int").alias("at"), blocks.alias("blocks"))
    visits = F.when(F.col("main"), F.array("at")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("s", "k", "c", "root", "main", "at", F.explode(visits).alias("b")).withColumn("own", F.col("at") == F.col("b"))
    dealt = dealt.join(sketches, "c").select("s", "b", (~F.col("own")).alias("away"), "k", "c", "root", "own", "main", "sketch")
    return dealt.repartition("s", "b").sortWithinPartitions("s", "b", "away").mapInArrow(releasing(run), "x long, y long, nx long, ny long, score long")


def _differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded to meet the shorter one."""
    words = F.least(F.size(a), F.size(b))

    def folded(s: Column) -> Column:
        whole = F.size(s) == words
        word = lambda w: F.aggregate(F.sequence(w, F.size(s) - 1, words), F.lit(0).cast("long"), lambda out, at: out.bitwiseXOR(F.get(s, at)))
        return F.when(whole, s).otherwise(F.transform(F.sequence(F.lit(0), words - 1), word))

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)


def _screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, nx, ny) whose sketches allow a link."""
    kept = pairs.join(sketches.select(F.col("c").alias("x"), F.col("sketch").alias("sx")), "x").join(sketches.select(F.col("c").alias("y"), F.col("sketch").alias("sy")), "y")
    return kept.where((100 + percent) * _differing(F.col("sx"), F.col("sy")) <= (100 - percent) * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny")


def _verified(kept: DataFrame, reps: DataFrame, rows: DataFrame, shared, width: int, seed: int, percent: int) -> DataFrame:
    """Links x, y among written pairs (x, y, nx, ny), with partial overlaps summed over fragments."""
    spark = rows.sparkSession
    involved = kept.select(F.col("x").alias("c")).unionAll(kept.select(F.col("y").alias("c"))).distinct()
    involved = materialize(involved.join(reps.select("c", "doc_id"), "c"), "near-classes")
    # a Bloom filter of fixed size over their documents tells which texts to cut again; the join below is exact
    key = F.coalesce(F.xxhash64("doc_id"), F.lit(0).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    words = involved.groupBy(F.pmod(F.shiftrightunsigned(key, 6), F.lit(BLOOM_WORDS)).alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    bloom = np.zeros(BLOOM_WORDS, np.int64)
    for w in words:
        bloom[w["w"]] = w["bits"]
    filtered = spark.sparkContext.broadcast(bloom.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (often, _), out, size = filtered.value, shared.value, [], 0
        for batch in batches:
            keys = batch.column("bit").to_numpy().view(np.uint64)
            hit = (bits[(keys >> np.uint64(6)) % np.uint64(BLOOM_WORDS)] >> (keys & np.uint64(63))) & np.uint64(1)
            ids, texts = batch.column("doc_id"), batch.column("text")
            for k in np.flatnonzero(hit).tolist():
                s = shingle_set(texts[k].as_py(), width)
                if not len(s):
                    continue
                c = _digest(s, seed)[0]
                heavy = _known(s, often)[0]
                half = FRAGMENTS // 2
                cuts = np.array([f * (1 << 64) // half for f in range(1, half)], np.uint64)
                for g, part in enumerate((s[~heavy], s[heavy])):
                    for f, piece in enumerate(np.split(part, np.searchsorted(part, cuts))):
                        if len(piece):
                            out.append((ids[k].as_py(), c, g * half + f, piece.view(np.int64)))
                            size += len(piece)
                if size > 200_000:
                    yield _fragment_batch(out)
                    out, size = [], 0
        if out:
            yield _fragment_batch(out)

    cut = rows.select("doc_id", "text", key.alias("bit")).mapInArrow(releasing(run), "id long, k long, f byte, part array<long>")
    parts = cut.join(involved, (cut["k"] == involved["c"]) & cut["id"].eqNullSafe(involved["doc_id"])).select("c", "f", "part")
    parts = materialize(parts, "near-fragments")
    left = kept.join(parts.select(F.col("c").alias("x"), "f", F.col("part").alias("px")), "x")
    both = left.join(parts.select(F.col("c").alias("y"), "f", F.col("part").alias("py")), ["y", "f"])
    partial = both.select("x", "y", "nx", "ny", "f", F.size(F.array_intersect("px", "py")).alias("o"))
    # a document that stands in the table twice gives each of its fragments twice
    once = partial.groupBy("x", "y", "nx", "ny", "f").agg(F.max("o").alias("o"))
    summed = once.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("o"))
    links = materialize(summed.where(100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y"), "ngram-links")
    discard(involved, parts)
    return links


def _fragment_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int8(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([o[q] for o in out], t) for q, t in enumerate(kinds)], names=["id", "k", "f", "part"])


def _members(links: list[DataFrame]) -> DataFrame:
    """c, root of every linked class."""
    every = links[0]
    for more in links[1:]:
        every = every.unionAll(more)
    return materialize(connected_components(every), "ngram-members").withColumnRenamed("node", "c")


def _rooted(df: DataFrame, members: DataFrame) -> DataFrame:
    """df with the root of each class c; a class without links is its own root."""
    return df.join(members, "c", "left").select(*df.columns, F.coalesce("root", "c").alias("root"))


def _placed(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, key2, n, c, root of every document with words, and doc_id of every one without."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    rows = _rows(docs, id_col, text_col)
    sets = materialize(_sets(rows, width, seed), "ngram-sets")
    own = sets.where("kind = 0")
    reps = own.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.min("c2").alias("lo"), F.max("c2").alias("hi"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "ngram-classes")
    if reps.where("lo <> hi").limit(1).count():
        if seed > 200:
            raise ValueError("set digests collide under every seed")
        return _placed(docs, percent, width, id_col, text_col, seed + 1)
    sketches = reps.select("c", "sketch")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = sets.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= max(CHUNK_LEAST, FREQUENT_SHARE * total)).select("c", "n")
    # at most 1 / FREQUENT_SHARE values
    frequent = sorted((r["c"] & ((1 << 64) - 1), r["n"]) for r in often.collect())
    values, counts = np.array([v for v, _ in frequent], np.uint64), np.array([n for _, n in frequent], np.int64)
    shared = spark.sparkContext.broadcast((values, 1 + counts // SALT_ROWS))
    found = materialize(_candidates(_postings(rows, shared, width, seed, percent), percent), "ngram-candidates")
    # the leaders of the parts of one bucket meet each other
    heads = found.where(F.col("kind") == LEADER).select("s", F.lit(0).alias("z"), "k", F.col("x").alias("c"))
    pairs = found.unionAll(_candidates(heads, percent)).where(F.col("kind") == PAIR).select("x", "y", "nx", "ny").distinct()
    near = materialize(_screened(pairs, sketches, percent), "near-pairs")
    links = [_verified(near, reps, rows, shared, width, seed, percent)]
    discard(near)
    members = _members(links)
    buckets = found.where(F.col("kind") == POSTING).select("s", "k", F.col("x").alias("c"))
    least, most, at_x = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("x") < F.col("y")
    sizes = [F.when(at_x, F.col("nx")).otherwise(F.col("ny")).alias("nx"), F.when(at_x, F.col("ny")).otherwise(F.col("nx")).alias("ny")]
    for best in (True, False):
        near = _near(_rooted(buckets, members), sketches, percent, best)
        if best:
            partner = F.min_by(F.struct("y", "nx", "ny"), F.struct("score", "y"))
            near = near.groupBy("x").agg(partner.alias("p")).select("x", "p.*")
        near = materialize(near.select(least, most, *sizes).distinct(), "near-pairs")
        if near.limit(1).count():
            links.append(_verified(near, reps, rows, shared, width, seed, percent))
            discard(members)
            members = _members(links)
        discard(near)
    discard(found, *links)
    return _rooted(own.where("n > 0").select("doc_id", "key", "key2", "n", "c"), members), own.where("n = 0").select("doc_id")


def ngram_components(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link at a Jaccard similarity of percent / 100."""
    placed, wordless = _placed(docs, percent, width, id_col, text_col)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionAll(wordless.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (null ids last), then of the least text key.

    Rows are told apart by id and text, so null ids and ids that repeat with other texts are judged by
    their text; of rows that repeat both, one stays. Rows without words all stay.
    """
    placed, _ = _placed(docs, percent, width, id_col, text_col)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2")
    rows = placed.groupBy("root", name.alias("row")).agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    judged = materialize(rows.join(first, "root").select(F.col("row.doc_id").alias("i"), F.col("row.key").alias("k"), F.col("row.key2").alias("k2"), "n", (F.col("row") != F.col("first")).alias("lost")).where("lost or n > 1"), "near-losers")
    key, key2 = text_key(F.col(text_col))
    of = lambda other: F.col(id_col).cast("long").eqNullSafe(other["i"]) & (key == other["k"]) & (key2 == other["k2"])
    losers, again = broadcast_if_small(judged.where("lost").select("i", "k", "k2")), judged.where("not lost").select("i", "k", "k2")
    kept = docs.join(losers, of(losers), "left_anti")
    if not again.limit(1).count():
        return kept
    again = broadcast_if_small(again)
    return kept.join(again, of(again), "left_anti").unionAll(kept.join(again, of(again), "left_semi").dropDuplicates([id_col, text_col]))
