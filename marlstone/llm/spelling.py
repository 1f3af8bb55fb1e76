"""Spelling variant grouping by tries and distance-one Levenshtein automata.

1. Every letter run of every document is counted, chunk-wise first. The known slips of the task (one letter lost by a rule
   on document id and run) are applied while counting.
2. The words, sorted, are cut into shards of at most SHARD_WORDS words and SHARD_LETTERS letters; each becomes a compact
   trie: arrays of edges by (node, letter), with counts at its ends.
3. Shards are broadcast in rounds of at most ROUND_BYTES, whatever the number of words; in each round, tasks take the
   words batch by batch and intersect each word's distance-one automaton with every shard, depth first: a state is (word,
   node, letters read, edits made), an edit-free state spawns the three kinds of edit, a state with its edit made follows
   single edges, and blocks of states wait on a stack. Ends that accept are the neighbours.
4. Neighbour counts and the best form are reduced by word over the rounds. Roots follow the forms by pointer doubling:
   a form's count is at least twice the word's, so there are no circles and few rounds.

Work is that of the words times the part of the tries within one edit; no pairs of words are formed but neighbours. Letters
are below U+0100, so one byte stands for each and byte order is code-point order. Defined cases: null texts have no words; a
null id is written as an empty text in the slip rule; repeated rows count each; equal counts go to the smallest word; an
empty table gives an empty result; texts are used whole and words may have any length; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import bound_batches, materialize, releasing

#: Fixed values of the task: letters (A-Z are lower-cased before), and the rule of the slips.
_RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 97
SHARD_WORDS = 50_000
SHARD_LETTERS = 1_000_000
#: Bytes of tries broadcast at a time (a shard has some 40 bytes a letter, so 40 MB, at most).
ROUND_BYTES = 64_000_000
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Words that are intersected together, and automaton states in a block.
BLOCK_WORDS = 2_048
BLOCK_STATES = 65_536


def runs_of(doc_id: str | None, text: str | None, shortest: int) -> Counter:
    """Words of at least shortest letters of a document, after slips, with their counts."""
    found, start = Counter(), zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in Counter(_RUN.findall((text or "").encode().lower().decode())).items():
        if len(run) >= shortest:
            h = zlib.crc32(run.encode(), start)
            if h % SLIP == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                found[run] += n
    return found


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, text_col: str = "text") -> DataFrame:
    """word, n: the words of at least shortest letters and least occurrences."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(runs_of(doc_id.as_py(), text.as_py(), shortest))
                if len(held) > HELD_WORDS:
                    yield flushed()
        yield flushed()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """Sorted words as arrays: edges by node and letter, word number at each end (-1 elsewhere)."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        parents, letters, ends, path, before = [], [], [-1], [0], b""
        for number, word in enumerate(words):
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for letter in word[shared:]:
                parents.append(path[-1])
                letters.append(letter)
                path.append(len(ends))
                ends.append(-1)
            ends[path[-1]] = number
            before = word
        keys = np.array(parents, np.int64) * 256 + np.array(letters, np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], order + 1
        self.start = np.searchsorted(self.keys, np.arange(len(ends) + 1, dtype=np.int64) * 256)
        self.ends, self.words, self.counts = np.array(ends, np.int64), words, np.array(counts, np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an edge of the letter, and where those lead."""
        key = node * 256 + letter
        at = np.searchsorted(self.keys, key)
        found = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == key)
        return found, self.child[at[found]]


def neighbours(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and of words of the trie at distance one from them, each pair once."""
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    buffer = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
    pairs = [np.zeros(0, np.int64)]

    def follow(w: np.ndarray, node: np.ndarray, i: np.ndarray) -> None:
        """States whose edit is made: single edges to the end."""
        while len(w):
            ended = i == size[w]
            number = trie.ends[node[ended]]
            accepted = number >= 0
            pairs.append(w[ended][accepted] * len(trie.words) + number[accepted])
            w, node, i = w[~ended], node[~ended], i[~ended]
            found, node = trie.step(node, buffer[begin[w] + i])
            w, i = w[found], i[found] + 1

    if not len(trie.keys):
        return pairs[0], pairs[0]
    everyone = np.arange(len(words), dtype=np.int64)
    stack = [(everyone, np.zeros_like(everyone), np.zeros_like(everyone))]
    while stack:
        w, node, i = stack.pop()
        if len(w) > BLOCK_STATES // 64:
            half = len(w) // 2
            stack += [(w[:half], node[:half], i[:half]), (w[half:], node[half:], i[half:])]
            continue
        inside = i < size[w]
        letter = np.where(inside, buffer[begin[w] + i], -1)
        fan = trie.start[node + 1] - trie.start[node]
        at = np.repeat(np.arange(len(w)), fan)
        edge = np.arange(len(at)) - np.repeat(np.cumsum(fan) - fan, fan) + trie.start[node[at]]
        other = trie.keys[edge] % 256 != letter[at]
        at, child = at[other], trie.child[edge[other]]
        swap = inside[at]
        # a letter lost from the word, put into it, or replaced; in a run of one letter at the run's end alone
        lost = inside & (buffer[begin[w] + np.minimum(i + 1, size[w])] != letter) | (i + 1 == size[w])
        follow(
            np.concatenate([w[lost], w[at], w[at[swap]]]),
            np.concatenate([node[lost], child, child[swap]]),
            np.concatenate([i[lost] + 1, i[at], i[at[swap]] + 1]),
        )
        w, node, i = w[inside], node[inside], i[inside]
        found, node = trie.step(node, letter[inside])
        if len(found):
            stack.append((w[found], node, i[found] + 1))
    both = np.unique(np.concatenate(pairs))
    return both // len(trie.words), both % len(trie.words)


@releasing
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows word, n to rows first, bytes, trie."""
    words, counts, letters = [], [], 0

    def cut() -> pa.RecordBatch:
        trie = pickle.dumps(Trie(words, counts), 5)
        return pa.RecordBatch.from_arrays([pa.array([words[0].decode("latin-1")]), pa.array([len(trie)], pa.int64()), pa.array([trie], pa.binary())], ["first", "bytes", "trie"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and (len(words) >= SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                yield cut()
                words, counts, letters = [], [], 0
            words.append(word.encode("latin-1"))
            counts.append(n)
            letters += len(word)
    if words:
        yield cut()


_NEAR = "word string, n_near long, form_n long, form string"


def _intersect(shared):
    """Rows word, n to their neighbours in the broadcast tries: number, and count and word of the best."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [pickle.loads(x) for x in shared.value]
        for batch in batches:
            given = batch.column(0).to_pylist()
            for at in range(0, len(given), BLOCK_WORDS):
                names = given[at : at + BLOCK_WORDS]
                words = [x.encode("latin-1") for x in names]
                near = np.zeros(len(words), np.int64)
                best: list[tuple[int, bytes]] = [(0, b"")] * len(words)
                for trie in tries:
                    w, number = neighbours(trie, words)
                    if not len(w):
                        continue
                    near += np.bincount(w, minlength=len(words))
                    order = np.lexsort((number, -trie.counts[number], w))
                    first = order[np.concatenate([[True], w[order][1:] != w[order][:-1]])]
                    for k, m in zip(w[first].tolist(), number[first].tolist(), strict=True):
                        count, name = int(trie.counts[m]), trie.words[m]
                        if count > best[k][0] or count == best[k][0] and name < best[k][1]:
                            best[k] = count, name
                hit = np.flatnonzero(near).tolist()
                columns = [[names[k] for k in hit], near[hit], [best[k][0] for k in hit], [best[k][1].decode("latin-1") for k in hit]]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "n_near", "form_n", "form"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form (the best neighbour, whatever its count) of each word (word, n) that has a neighbour."""
    spark = words.sparkSession
    total = words.count()
    sorted_words = words.repartitionByRange(max(1, -(-total // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = materialize(sorted_words.mapInArrow(_build, "first string, bytes long, trie binary"), "spelling-tries")
    rounds, room = [[]], ROUND_BYTES
    for row in shards.select("first", "bytes").orderBy("first").collect():  # one short row a shard
        if rounds[-1] and row["bytes"] > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(row["first"])
        room -= row["bytes"]
    found = []
    # words near in order end in other tasks: rare and frequent first letters cost the same everywhere
    dealt = words.repartition(max(1, spark.sparkContext.defaultParallelism, -(-total // (4 * SHARD_WORDS))), F.xxhash64("word"))
    for firsts in rounds:
        shared = spark.sparkContext.broadcast([r["trie"] for r in shards.where(F.col("first").isin(firsts)).select("trie").collect()])
        found.append(materialize(dealt.select("word").mapInArrow(_intersect(shared), _NEAR), "spelling-near"))
        shared.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), "form")).alias("b")
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.form_n", "b.form")


def _roots(forms: DataFrame, highest: int) -> DataFrame:
    """word, root from word, form; counts double along forms, which bounds the rounds of doubling."""
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, highest.bit_length()).bit_length()):
        following = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = materialize(known.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return known


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; form and form_n are null where no near word has ratio times the count."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    words = materialize(word_counts(docs, shortest, least, text_col), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= F.lit(ratio) * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    near = materialize(near, "spelling-forms")
    highest = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(near.where(F.col("form").isNotNull()).select("word", "form"), highest)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
