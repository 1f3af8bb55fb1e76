"""Byte-level BPE by a pair occurrence index.

The distinct words of a bounded chunk of a partition are laid out as one symbol array.
Every adjacent pair that has a rank maps to the arrays of all its positions; active ranks are
taken from a heap in ascending order, all positions of the pair are merged at once, and the
arrays of the pairs that this creates are updated. Positions made stale by earlier merges fail a check of
their symbols and are skipped. Words never merge across each other, so this equals merging
each word on its own.

Defined cases: null text is the empty text and gives no ids; texts are encoded whole; the
strings of special tokens inside texts become their ids; letters and numbers are those of the
installed tokenizers library's Unicode; decoding joins the tokens' bytes
and reads them as UTF-8, with U+FFFD for broken sequences; null ids decode to the empty
text. Other columns pass only if named in keep.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from .common import bound_batches, fresh, releasing

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose words are gathered before their distinct ones are encoded together.
CHUNK_CHARS = 1_000_000
#: Words remembered between chunks; beyond it the memory is emptied.
CACHE_WORDS = 250_000


def byte_alphabet() -> dict[str, int]:
    """Printable character of byte-level vocabularies -> byte, by the usual rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def newer_characters() -> str:
    """Letters and numbers of the regex library that the tokenizers library, by an older Unicode, takes for neither.

    Looked for among the code points that Python's own tables, older still, don't know.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    out = ""
    for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        chars = regex.findall(kind, unknown)
        joined = {start for _, (start, end) in cut("".join(f"{lead}{c}\n" for c in chars)) if end - start == 2}
        out += "".join(c for k, c in enumerate(chars) if 3 * k not in joined)
    return out


class PairIndexBPE:
    """Encoder and decoder for one vocabulary file (the .json of the tokenizers library)."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        to_byte, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.first = np.full(256, -1, np.int64)
        for c, b in to_byte.items():
            self.first[b] = vocab[c]
        self.first[255] = -1
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: rank -> left, right and new symbol; the sorted pairs and their ranks
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        pairs = np.fromiter((a << 32 | b for a, b, _ in self.merges), np.int64, len(self.merges))
        self.pairs, self.rank_of = np.unique(pairs, return_index=True)
        self.piece_size = np.fromiter(map(len, pieces), np.int64, size)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.plain_words = regex.compile(PATTERN).findall
        self.newer = frozenset(newer_characters())
        newer = f"[{''.join(sorted(self.newer))}]" if self.newer else "(?!)"
        careful = PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{newer})+")
        for kind in (r"\p{L}", r"\p{N}"):
            careful = careful.replace(f" ?{kind}+", f" ?(?:(?!{newer}){kind})+")
        self.careful_words = regex.compile(careful).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.index = {w: k for k, w in enumerate(self.special)}
        self.ids = array("i", self.special.values())
        self.starts = array("q", range(len(self.special)))
        self.sizes = array("q", [1] * len(self.special))

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of symbols have a rank, and the ranks of those."""
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        return known, self.rank_of[at[known]]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and each word's number of ids, by the pair occurrence index over all of them."""
        # 0xFF is no byte of UTF-8; its symbol -1 ends a word, and one stands before the first
        symbols = self.first[np.frombuffer(b"\xff" + b"".join(w.encode() + b"\xff" for w in words), np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            known, ranks = self._ranked(left, right)
            if not len(ranks):
                return
            at, order = at[known], np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, lo, hi in zip(ranks[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if rank in places:
                    places[rank].append(at[lo:hi])
                else:
                    places[rank] = [at[lo:hi]]
                    heapq.heappush(active, rank)

        at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        if len(self.pairs):
            add(at, symbols[at], symbols[at + 1])
        while active:
            rank = heapq.heappop(active)
            lists = places.pop(rank)
            a, b, new = self.merges[rank]
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            q = after[p]
            there = (symbols[p] == a) & (symbols[q] == b)
            p, q = p[there], q[there]
            if a == b and len(p) > 1:  # of positions that overlap in a row, every second one stays
                k = np.arange(len(p))
                head = np.concatenate([[True], q[:-1] != p[1:]])
                free = (k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0
                p, q = p[free], q[free]
            if not len(p):
                continue
            symbols[p], symbols[q] = new, -2  # q is gone
            right = after[p] = after[q]
            before[right] = p
            left = before[p]
            one, two = symbols[left], symbols[right]
            ok, ok2 = one >= 0, two >= 0
            mid = symbols[p]
            add(np.concatenate([left[ok], p[ok2]]), np.concatenate([one[ok], mid[ok2]]), np.concatenate([mid[ok], two[ok2]]))
        kept = np.flatnonzero(symbols >= 0)
        return symbols[kept].astype(np.int32), np.diff(np.searchsorted(kept, np.flatnonzero(symbols == -1)))

    def words(self, text: str) -> list[str]:
        """Words of a text as the tokenizers library cuts them."""
        return self.plain_words(text) if text.isascii() or self.newer.isdisjoint(text) else self.careful_words(text)

    def pretokens(self, text: str) -> list[str]:
        if not self.split:
            return self.words(text)
        parts = self.split(text)
        if len(parts) == 1:
            return self.words(text)
        return [w for part in parts for w in ((part,) if part in self.special else self.words(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        split = [self.pretokens(t) for t in texts]
        index = self.index
        fresh = list(set(chain.from_iterable(split)).difference(index))
        ids, sizes = self.merge(fresh)
        index.update(zip(fresh, range(len(self.starts), len(self.starts) + len(fresh)), strict=True))
        self.starts.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = np.frombuffer(self.sizes, np.int64)[at].copy() if len(at) else np.zeros(0, np.int64)
        starts = np.frombuffer(self.starts, np.int64)[at].copy() if len(at) else sizes
        flat = _gather(np.array(self.ids, np.int32), starts, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(ends)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        sizes = self.piece_size[flat]
        data = _gather(self.piece_bytes, self.piece_start[flat], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each run, one after the other."""
    if not len(sizes):
        return values[:0]
    offsets = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)]


_LOADED: dict[str, PairIndexBPE] = {}


def coder(path: str) -> PairIndexBPE:
    """The coder of a vocabulary file, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def _chunks(batch: pa.RecordBatch, column: str, cost) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_CHARS each; a longer single value is a slice of its own."""
    start = size = 0
    for k, v in enumerate(cost(batch.column(column))):
        if size and size + v > CHUNK_CHARS:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += v
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    kind = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(kind(column), 0).to_pylist()


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep, ids (array of int) and, if asked for, decoded (the text that the ids give)."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    given = fresh("text", docs.select(*keep))
    fields = [docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in _chunks(batch, given, _lengths):
                flat, counts = bpe.encode(part.column(given).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
                columns = [part.column(c) for c in keep] + [ids]
                if decoded:
                    columns.append(pa.array(bpe.decode(flat, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    text = F.coalesce(F.col(text_col), F.lit("")).alias(given)
    return docs.select(*keep, text).mapInArrow(releasing(run), T.StructType(fields))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text: what the ids decode to."""
    ship_package(encoded.sparkSession)
    fields = [encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in _chunks(batch, "__ids", _lengths):
                lists = part.column("__ids")
                flat = np.asarray(lists.flatten(), np.int64)
                texts = bpe.decode(flat, np.array(_lengths(lists), np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[f.name for f in fields])

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids")
    return encoded.select(*keep, ids).mapInArrow(releasing(run), T.StructType(fields))
