"""Language-model scoring by a weighted backoff automaton.

The model: n-grams of the training documents with interpolated absolute discounting over an add-one unigram base,
    p(w) = (c(w) + 1) / (N + V + 1),
    p(w | h) = max(c(hw) - D, 0) / C(h) + D * T(h) / C(h) * p(w | h'),
where h' is h without its first word, C(h) counts h as a context, T(h) counts the distinct words seen behind it, and D is
n1 / (n1 + 2 n2) of its order. Texts begin in the context of a start mark and end with an end token. A history is a state,
a seen n-gram an arc, and the factor of an unseen one the weight of the state's failure arc.

The automaton grows with the corpus, so it is never whole in one place:

1. Documents are packed into chunks of some CHUNK_BYTES and stored as word numbers, with 64-bit keys of the words.
2. For each order, from the highest down, every chunk sends the keys of its distinct n-grams, with their training counts
   there, to buckets by key; a bucket adds up all counts and answers each chunk. One chunk that holds an n-gram is told that it
   owns it, so that distinct followers are counted once; what a chunk knows about contexts goes along with its
   request of the next lower order. An n-gram counts once a chunk, so frequent ones do not gather in a task.
3. Each chunk now has every state, arc and failure arc that its texts can reach, with weights of the whole corpus. It
   builds them and runs each text through once, from left to right, carrying the state.

Memory: a chunk (or one longer document), and a bucket, whose number follows the chunks'. n-grams are told apart by 64-bit
keys. Defined cases: null text is empty (its end token is scored); a null id is an empty text in the fold rule, so training;
repeated rows count and are scored each; without training documents N = V = 0; an empty table gives an empty result; texts
are used whole, however long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .common import bound_batches, materialize, releasing

CHUNK_BYTES = 4_000_000
#: Word numbers of the marks.
START, END = 0, 1
_MARKS = [xxhash.xxh64_intdigest(b"start", 1), xxhash.xxh64_intdigest(b"end", 1)]
#: Discount where an order has no n-grams seen once, or none seen twice.
DISCOUNT = 0.5


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, held, text to chunks: ids, held, sizes (words of each text), words (keys), tokens (word numbers)."""
    first, made, ids, held, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

    def cut(kind: pa.DataType) -> pa.RecordBatch:
        split = [t.lower().split() for t in texts]
        coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        keys = np.array([*_MARKS, *map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist())], np.uint64)
        row = [first + made], [ids], [held], [[len(w) for w in split]], [keys.tobytes()], [_packed(coded.indices.to_numpy().astype(np.int32) + 2)]
        kinds = pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["chunk", "ids", "held", "sizes", "words", "tokens"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc_id, out, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            ids.append(doc_id.as_py())
            held.append(out.as_py())
            texts.append(data)
            size += len(data) + 50
            if size >= CHUNK_BYTES:
                yield cut(kind)
                made, ids, held, texts, size = made + 1, [], [], [], 0
    if ids:
        yield cut(kind)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each value among the distinct ones, those in order, and a place of each."""
    order = np.argsort(values)
    ordered = values[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(values)]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(heads) - 1
    return number, ordered[heads], order[heads]


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from those of its beginning and its last word."""
    mixed = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


class Chunk:
    """A chunk's texts as one row of word numbers, and its n-grams of every order up to the highest."""

    def __init__(self, row: dict, order: int) -> None:
        self.ids, self.held, self.order = row["ids"], np.array(row["held"], bool), order
        sizes = np.array(row["sizes"], np.int64)
        self.lengths = sizes + 2
        self.begin = np.cumsum(self.lengths) - self.lengths
        words = np.frombuffer(row["words"], np.uint64)
        self.width = len(words)
        self.t = np.empty(int(self.lengths.sum()), np.int64)
        inner = np.ones(len(self.t), bool)
        inner[self.begin] = inner[self.begin + self.lengths - 1] = False
        self.t[inner] = _unpacked(row["tokens"], np.int32)
        self.t[self.begin], self.t[self.begin + self.lengths - 1] = START, END
        place = np.arange(len(self.t)) - np.repeat(self.begin, self.lengths)
        trained = ~np.repeat(self.held, self.lengths)
        #: By order from 1: keys; number of the n-gram that ends at each place (-1: none); a place of each; training count in the chunk.
        self.keys, self.at, self.where, self.counts = [None], [None], [None], [None]
        for n in range(1, order + 1):
            valid = np.flatnonzero(place >= n - 1)
            if n == 1:
                keys, number, some = words, self.t, np.empty(len(words), np.int64)
                some[self.t] = valid
            else:
                number, distinct, some = _numbered(self.at[n - 1][valid - 1] * self.width + self.t[valid])
                some = valid[some]
                keys = _mixed(self.keys[n - 1][distinct // self.width], words[distinct % self.width])
            at = np.full(len(self.t), -1, np.int64)
            at[valid] = number
            counted = valid[trained[valid] & (place[valid] > 0)]
            self.keys.append(keys)
            self.at.append(at)
            self.where.append(some)
            self.counts.append(np.bincount(at[counted], minlength=len(keys)))

    def contexts(self, n: int) -> np.ndarray:
        """Numbers, in order n - 1, of what stands before the last word of each n-gram."""
        return self.at[n - 1][self.where[n] - 1]

    def request(self, n: int, above: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Training count, count as context and owned followers of the chunk's n-grams; above: totals and ownership in order n + 1."""
        stats = np.zeros((3, len(self.keys[n])), np.int64)
        stats[0] = self.counts[n]
        if above is not None:
            before = self.contexts(n + 1)
            np.add.at(stats[1], before, self.counts[n + 1])
            np.add.at(stats[2], before, above[1].astype(np.int64))
        return stats

    def gathered(self, answers: list[tuple[int, bytes, bytes]], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Totals (3 rows) and ownership by n-gram from the answers (bucket, totals, owned) of order n."""
        totals, owned = np.zeros((3, len(self.keys[n])), np.int64), np.zeros(len(self.keys[n]), bool)
        bucket = self.keys[n] % np.uint64(buckets)
        places = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[places], np.arange(buckets + 1, dtype=np.uint64))
        for b, data, own in answers:
            spot = places[edges[b] : edges[b + 1]]
            totals[:, spot] = _unpacked(data, np.int64).reshape(3, -1)
            owned[spot] = np.unpackbits(np.frombuffer(own, np.uint8), count=len(spot)).astype(bool)
        return totals, owned


_REQUEST = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("stats", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("owned", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])
_REQUEST_SQL = "bucket int, chunk long, keys binary, stats binary"
_ANSWER_SQL = "chunk long, bucket int, totals binary, owned binary, tokens long, types long, once long, twice long"


def _requests(name: int, chunk: Chunk, n: int, buckets: int, above) -> list[tuple]:
    stats, bucket = chunk.request(n, above), chunk.keys[n] % np.uint64(buckets)
    places = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[places], np.arange(buckets + 1, dtype=np.uint64))
    return [(int(b), name, chunk.keys[n][s].tobytes(), _packed(stats[:, s])) for b in np.flatnonzero(np.diff(edges)) for s in [places[edges[b] : edges[b + 1]]]]


def _answer(asked: pa.Table) -> pa.Table:
    """All requests of a bucket to the answers, and one row (chunk -1) of the bucket's own counts."""
    keys = [np.frombuffer(x, np.uint64) for x in asked.column("keys").to_pylist()]
    stats = np.concatenate([_unpacked(x, np.int64).reshape(3, -1) for x in asked.column("stats").to_pylist()], axis=1)
    every = np.concatenate(keys)
    order = np.argsort(every)
    heads = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    totals = np.add.reduceat(stats[:, order], heads, axis=1)
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(every))))
    trained = order[stats[0][order] > 0]
    owner = trained[np.concatenate([[True], number[trained][1:] != number[trained][:-1]])] if len(trained) else trained
    owned = np.zeros(len(number), bool)
    owned[owner] = True
    b, out, edge = asked.column("bucket")[0].as_py(), [], 0
    for name, k in zip(asked.column("chunk").to_pylist(), keys, strict=True):
        mine = slice(edge, edge + len(k))
        edge += len(k)
        out.append((name, b, _packed(totals[:, number[mine]]), np.packbits(owned[mine]).tobytes(), None, None, None, None))
    n = totals[0]
    out.append((-1, b, b"", b"", int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum())))
    return _table(_ANSWER, out)


def _answers(table: pa.Table) -> list[tuple[int, bytes, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("bucket", "totals", "owned")), strict=True))


class Automaton:
    """States are the chunk's n-grams below the highest order and a root; every weight is a log10 of the whole corpus's model."""

    def __init__(self, chunk: Chunk, totals: list, tokens: int, types: int, discounts: list[float]) -> None:
        self.width = chunk.width
        first = np.cumsum([0, 1, *(len(chunk.keys[k]) for k in range(1, chunk.order))])
        state = lambda k, number: first[k] + number if k else np.zeros_like(number)
        p = (totals[1][0] + 1) / (tokens + types + 1)
        words = chunk.t[chunk.where[1]]
        # the root has an arc for every word
        root, onward = np.zeros(chunk.width), np.zeros(chunk.width, np.int64)
        root[words] = np.log10(p)
        if chunk.order > 1:
            onward[words] = state(1, np.arange(len(words)))
        arcs, weights, targets, fails, fallbacks = [], [], [], [np.zeros(1)], [np.zeros(1, np.int64)]
        for k in range(1, chunk.order + 1):
            place = chunk.where[k]
            if k > 1:
                before = chunk.contexts(k)
                c, followers = totals[k - 1][1][before], totals[k - 1][2][before]
                base = p[chunk.at[k - 1][place]]
                p = np.where(c > 0, np.maximum(totals[k][0] - discounts[k], 0) / np.maximum(c, 1) + discounts[k] * followers / np.maximum(c, 1) * base, base)
                known = totals[k][0] > 0
                target = state(k, np.arange(len(place))) if k < chunk.order else state(k - 1, chunk.at[k - 1][place])
                arcs.append((state(k - 1, before) * self.width + chunk.t[place])[known])
                weights.append(np.log10(p[known]))
                targets.append(target[known])
            if k < chunk.order:
                c, followers = totals[k][1], totals[k][2]
                fails.append(np.where(c > 0, np.log10(np.where(c > 0, discounts[k + 1] * followers, 1) / np.maximum(c, 1)), 0.0))
                fallbacks.append(state(k - 1, chunk.at[k - 1][place]) if k > 1 else np.zeros(len(place), np.int64))
        flat = lambda parts: np.concatenate(parts).tolist() if parts else []
        self.weights, self.targets, self.fails, self.fallbacks = flat(weights), flat(targets), flat(fails), flat(fallbacks)
        self.arcs = dict(zip(flat(arcs), range(len(self.weights)), strict=True))
        self.root, self.onward = root.tolist(), onward.tolist()
        self.initial = int(state(1, chunk.at[1][chunk.begin[:1]])[0]) if chunk.order > 1 else 0

    def score(self, words: list[int]) -> float:
        """log10 probability of a text, its end token last; state 0 is the root."""
        total, state, width, find = 0.0, self.initial, self.width, self.arcs.get
        weights, targets, fails, fallbacks, root, onward = self.weights, self.targets, self.fails, self.fallbacks, self.root, self.onward
        for w in words:
            while state:
                arc = find(state * width + w)
                if arc is not None:
                    total += weights[arc]
                    state = targets[arc]
                    break
                total += fails[state]
                state = fallbacks[state]
            else:
                total += root[w]
                state = onward[w]
        return total


def score_documents(docs: DataFrame, held_out: Column, order: int = 2, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; held_out: condition of those not learnt from."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType
    chunk_schema = T.StructType().add("chunk", "long").add("ids", T.ArrayType(kind)).add("held", T.ArrayType(T.BooleanType())).add("sizes", T.ArrayType(T.IntegerType())).add("words", "binary").add("tokens", "binary")
    given = docs.select("doc_id", held_out.alias("held"), F.col(text_col).alias("text"))
    encoded = materialize(given.mapInArrow(releasing(_encode), chunk_schema), "lm-chunks")
    buckets = max(1, encoded.count())
    by_chunk = encoded.groupBy("chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _table(_REQUEST, _requests(row["chunk"], Chunk(row, order), order, buckets, None)).to_batches()

    def ask_below(n: int):
        def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
            row = rows.to_pylist()[0]
            chunk = Chunk(row, n + 1)
            return _table(_REQUEST, _requests(row["chunk"], chunk, n, buckets, chunk.gathered(_answers(answers), n + 1, buckets)))

        return run

    found: list[DataFrame] = [None] * (order + 1)
    counts: list = [None] * (order + 1)
    for n in range(order, 0, -1):
        if n == order:
            asked = encoded.mapInArrow(releasing(ask), _REQUEST_SQL)
        else:
            asked = by_chunk.cogroup(found[n + 1].groupBy("chunk")).applyInArrow(ask_below(n), _REQUEST_SQL)
        answered = materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER_SQL), f"lm-order-{n}")
        own = answered.where(F.col("chunk") < 0)
        counts[n] = own.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice")]).first()
        found[n] = answered.where(F.col("chunk") >= 0).select("chunk", "bucket", "totals", "owned")
    tokens, types = counts[1][0], counts[1][1]
    discounts = [0.0, 0.0] + [c[2] / (c[2] + 2 * c[3]) if c[2] and c[3] else DISCOUNT for c in counts[2:]]
    answers = found[1].withColumn("n", F.lit(1))
    for n in range(2, order + 1):
        answers = answers.unionByName(found[n].withColumn("n", F.lit(n)))

    def score(rows: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(rows.to_pylist()[0], order)
        orders = replies.column("n").to_numpy()
        totals = [None] + [chunk.gathered(_answers(replies.filter(pa.array(orders == n))), n, buckets)[0] for n in range(1, order + 1)]
        model = Automaton(chunk, totals, tokens, types, discounts)
        c = totals[1][0][chunk.at[1]]
        single, known = np.log10((c + 1) / (tokens + types + 1)), c > 0
        out, flat = [], chunk.t.tolist()
        for k, (b, size) in enumerate(zip(chunk.begin.tolist(), chunk.lengths.tolist(), strict=True)):
            span = slice(b + 1, b + size)
            out.append((chunk.ids[k], bool(chunk.held[k]), size - 1, int(known[span].sum()), tokens, float(single[span].sum()), model.score(flat[span])))
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (rows.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return _table(pa.schema(list(zip(names, kinds, strict=True))), out)

    schema = T.StructType().add("doc_id", kind).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
