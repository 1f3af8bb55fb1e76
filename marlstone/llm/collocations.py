"""Phrase collocation mining by contiguous pattern growth.

Words are lower-cased (A-Z), pieces end at `.,;:!?` and line ends, and everything is counted for each language by itself.

1. Every word is counted, then every pair of adjacent frequent words under a 64-bit key (combined chunk-wise before the
   shuffle). The frequent words, and then pairs, fill Bloom filters of BLOOM_WORDS 64-bit words: fixed in size, without
   false negatives; what they let through beside is counted exactly later and falls out there.
2. Occurrence pointers: each position whose pair passes the filter, with the words that follow it, cut where a pair
   fails (no longer phrase can be frequent there). Equal ones are collapsed into one row with a count, first by chunk,
   then by a shuffle on the whole row, which no frequent word can skew.
3. The rows are dealt by their two-word prefix, sorted, and one task grows a prefix to the right, depth first, over its
   rows alone; a branch ends where the support does. A prefix with more than HOT_WINDOWS distinct rows is replaced by its
   three-word extensions, each a task's prefix of its own, and its partial supports are summed.
4. Cuts, scores and the phrases inside longer ones are equi-joins on the phrase; the first of each language are ranked by
   salted parts first. Arithmetic is in decimals, so products may pass 64 bits.

Memory: a chunk of CHUNK_BYTES bytes of text (or one longer document), and the rows of one prefix. Defined cases: null text is
empty; a null language is `und`; repeated rows count each; equal scores and counts are ranked by the phrase's UTF-8 bytes;
an empty table gives an empty result; texts are used whole, however long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import bound_batches, broadcast_if_small, materialize, releasing

CHUNK_BYTES = 4_000_000
LONGEST = 4
#: 64-bit words of the filters of frequent words and pairs (16 MB each).
BLOOM_WORDS = 1 << 21
#: Distinct occurrence rows of a two-word prefix beyond which its extensions become prefixes.
HOT_WINDOWS = 50_000
#: Parts of a language that are ranked before the language is.
SALTS = 64
UNKNOWN = "und"
#: Fixed values of the task: ends of a piece, and white space inside it.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0x0A if c in _ENDS else 0x20 if c == 0x09 else c for c in range(256))
#: Stands between pieces; the byte occurs in no UTF-8 text.
_BREAK = b"\xff"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """lang, word numbers in order (0 between pieces), the words by number, for stretches of documents of one language."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> tuple[str, np.ndarray, list[bytes]]:
        data = b"\n".join(held.pop(lang)).lower().translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ")
        del sizes[lang]
        coded = pa.array([_BREAK, *data.split(), _BREAK], pa.binary()).dictionary_encode()
        return lang, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py() or "", text.as_py()
            if text:
                held.setdefault(lang, []).append(text := text.encode())
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= CHUNK_BYTES:
                    yield cut(lang)
        if len(held) > 8 and sum(sizes.values()) >= CHUNK_BYTES:
            for lang in list(held):
                yield cut(lang)
    for lang in list(held):
        yield cut(lang)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of 64-bit keys (order matters)."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a << np.uint64(6)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(6)) % np.uint64(BLOOM_WORDS), keys & np.uint64(63)


def _passes(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    w, b = _bits(keys)
    return ((bloom[w] >> b) & np.uint64(1)) == 1


def _keys(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pairs(lang: str, ids: np.ndarray, words: list[bytes], bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of adjacent words that both pass, number of each one's pair, and key and count by number."""
    keys = _keys(lang, words)
    good = _passes(bloom, keys)
    good[0] = False
    good = good[ids]
    at = np.flatnonzero(good[:-1] & good[1:])
    distinct, number, counts = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True, return_counts=True)
    return at, number, _mixed(keys[distinct // len(words)], keys[distinct % len(words)]), counts


@releasing
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, words in _chunks(batches):
        counts = np.bincount(ids, minlength=len(words))[1:]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])


@releasing
def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
        keys = np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words, strict=True)), np.uint64, len(words))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _broadcast_filter(keys: DataFrame):
    """The Bloom filter of a column of keys; at most BLOOM_WORDS rows of two numbers reach the driver."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("key", F.lit(64)).cast("int"))
    found = keys.groupBy(F.pmod(F.shiftrightunsigned("key", 6), F.lit(BLOOM_WORDS)).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    filled = np.zeros(BLOOM_WORDS, np.int64)
    filled[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(filled.view(np.uint64))


def _windows_of(lang: str, ids: np.ndarray, words: list[bytes], word_bloom: np.ndarray, bloom: np.ndarray) -> pa.RecordBatch:
    """lang, phrase, n: the distinct stretches of up to LONGEST words that start at a frequent pair, and end where one fails."""
    at, number, keys, _ = _pairs(lang, ids, words, word_bloom)
    good = np.zeros(len(ids) + LONGEST, bool)
    good[at] = _passes(bloom, keys)[number]
    start = np.flatnonzero(good)
    wide = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
    third = np.where(good[start + 1], wide[start + 2], 0)
    fourth = np.where(good[start + 1] & good[start + 2], wide[start + 3], 0)
    heads, head = np.unique(wide[start] * len(words) + wide[start + 1], return_inverse=True)
    tails, tail = np.unique(third * len(words) + fourth, return_inverse=True)
    rows, counts = np.unique(head * max(1, len(tails)) + tail, return_counts=True)
    first = [words[a] + b" " + words[c] for a, c in zip((heads // len(words)).tolist(), (heads % len(words)).tolist(), strict=True)]
    rest = [(b" " + words[a] if a else b"") + (b" " + words[c] if c else b"") for a, c in zip((tails // len(words)).tolist(), (tails % len(words)).tolist(), strict=True)]
    phrases = [first[h] + rest[t] for h, t in zip((rows // max(1, len(tails))).tolist(), (rows % max(1, len(tails))).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])


def grow(rows: list[tuple[list[str], int]], depth: int, min_count: int) -> Iterator[tuple[str, int]]:
    """Phrases of more than depth words that begin with the common first depth words of rows, with their supports, depth first."""
    projected: dict[str, list[tuple[list[str], int]]] = {}
    for row in rows:
        if len(row[0]) > depth:
            projected.setdefault(row[0][depth], []).append(row)
    for longer in projected.values():
        support = sum(n for _, n in longer)
        if support >= min_count:
            yield " ".join(longer[0][0][: depth + 1]), support
            if depth + 1 < LONGEST:
                yield from grow(longer, depth + 1, min_count)


def _grow_all(min_count: int):
    """Rows lang, prefix, phrase, n, sorted by lang and prefix, to frequent phrases; a prefix's rows are held, nothing else."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def ended() -> None:
            if rows:
                lang, prefix = now
                depth = prefix.count(" ") + 1
                # the prefix itself; the supports of a hot one's parts are summed later
                support = sum(n for _, n in rows)
                out.extend((lang, " ".join(rows[0][0][:k]), support) for k in range(2, depth + 1))
                out.extend((lang, phrase, n) for phrase, n in grow(rows, depth, min_count))
                rows.clear()

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for lang, prefix, phrase, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (lang, prefix) != now:
                    ended()
                    now = lang, prefix
                rows.append((phrase.split(" "), n))
            if len(out) > 50_000:
                yield flushed()
        ended()
        yield flushed()

    return run


_PHRASES = "lang string, phrase string, n long"


def _first(k: int | str) -> Column:
    """The first k words of column phrase."""
    return F.expr(f"substring_index(phrase, ' ', {k})")


def frequent_phrases(docs: DataFrame, min_count: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases), both lang, phrase, n: every word, and every phrase of 2 to LONGEST words with at least min_count occurrences."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    words = materialize(texts.mapInArrow(_count_words, _PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")
    frequent = F.col("n") >= min_count
    by_word = _broadcast_filter(words.where(frequent).select("lang", "phrase").mapInArrow(_word_keys, "key long"))

    @releasing
    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, known in _chunks(batches):
            _, _, keys, counts = _pairs(lang, ids, known, by_word.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    counted = texts.mapInArrow(count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    by_pair = _broadcast_filter(materialize(counted.where(frequent).select("key"), "phrase-pairs"))

    @releasing
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, known in _chunks(batches):
            yield _windows_of(lang, ids, known, by_word.value, by_pair.value)

    windows = texts.mapInArrow(project, _PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    windows = materialize(windows.select("*", _first(2).alias("prefix")), "phrase-windows")
    hot = broadcast_if_small(windows.groupBy("lang", "prefix").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_WINDOWS))
    dealt = windows.join(hot, ["lang", "prefix"], "left").select("lang", F.when(F.col("rows").isNotNull(), _first(3)).otherwise(F.col("prefix")).alias("prefix"), "phrase", "n")
    tasks = dealt.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    grown = tasks.mapInArrow(_grow_all(min_count), _PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words, materialize(grown.where(frequent), "phrases")


def collocations(docs: DataFrame, min_count: int = 30, per_lang: int = 2_000, contained: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by the score of their weakest cut.

    score = floor(2000000 * a / (l + r)) with a the phrase's count and l, r those of its parts; a phrase that lies
    inside a longer one of at least contained % of its count is left out.
    """
    words, phrases = frequent_phrases(docs, min_count, text_col, lang_col)
    length = F.size(F.split("phrase", " "))
    known = words.where(F.col("n") >= min_count).unionByName(phrases)
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("*", _first("k").alias("left"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    side = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(18, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    weakest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("w")
    best = scored.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "w.*")
    # for each longer phrase its inner phrases of at least two words; the largest longer count is all that matters
    inner = phrases.where(length > 2).select("lang", "n", F.split("phrase", " ").alias("p"))
    spans = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> array_join(slice(p, i, m), ' '))))")
    covered = inner.select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    free = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(contained) * wide("a")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return _ranked(free, per_lang).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(df: DataFrame, per_lang: int) -> DataFrame:
    """The first per_lang rows of each language with their rank, found in SALTS parts first."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = df.withColumn("part", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return parts.drop("part").withColumn("rank", rank).where(F.col("rank") <= per_lang)
