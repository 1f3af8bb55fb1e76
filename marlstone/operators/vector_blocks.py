"""O1, exact and for many queries: vectors packed into blocks, and the leading rows of each block of queries.

A product of matrices finds the rows that can be among a query's first k; only these are scored again, dimension by dimension as the
expressions of `functions.vectors` do, and ranked by that score. The scores of the product serve as a bound alone, with `SLACK` for their rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds the difference between a cosine by a product of matrices and one by a running sum.
SLACK = 1e-9
#: Pairs that are scored again at a time.
PAIRS = 1 << 18


def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """ids, dims, cells of (id, array<double>): at most size rows of one dimension; a null vector, or one with a null in it, has dimension 0."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        cells, starts, dims = flat.to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths, lengths.copy()
        if flat.null_count:
            dims[np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for at in range(0, len(rows), size):
                own = rows[at : at + size]
                block = cells[starts[own][:, None] + np.arange(d)].astype(np.float64)
                taken = ids.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), taken), pa.array([int(d)], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["ids", "dims", "cells"])


class Side:
    """One packed block: ids, cells and norms."""

    def __init__(self, ids: pa.Array, dims: int, cells: bytes) -> None:
        self.ids, self.cells = ids, np.frombuffer(cells).reshape(len(ids), dims)
        self.norms = np.sqrt(_running(self.cells, self.cells))


def _running(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first dimension on."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _clamped(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines within [0, 1]; 0 where a norm is 0, 1 for NaN, which Spark orders last."""
    score = np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)
    return np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0))


class Leading:
    """The first k rows of each query of a block, by score and id, over all blocks of vectors that were shown."""

    def __init__(self, queries: Side, k: int, kind: pa.DataType) -> None:
        self.queries, self.k, self.n = queries, k, len(queries.ids)
        self.best = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], kind)})
        self.floor = np.full(self.n, -np.inf)

    def show(self, rows: Side) -> None:
        q, k = self.queries, self.k
        if q.cells.shape[1] == rows.cells.shape[1]:
            with np.errstate(all="ignore"):
                near = _clamped(q.cells @ rows.cells.T, q.norms[:, None] * rows.norms)
        else:
            near = np.zeros((self.n, len(rows.ids)))
        hit = near >= self.floor[:, None] - SLACK
        if len(rows.ids) > k and np.count_nonzero(hit) > 4 * k * self.n:
            hit &= near >= np.partition(near, len(rows.ids) - k, axis=1)[:, len(rows.ids) - k, None] - SLACK
        at, of = np.nonzero(hit)
        for start in range(0, len(at), PAIRS):
            self._take(rows, at[start : start + PAIRS], of[start : start + PAIRS])

    def _take(self, rows: Side, at: np.ndarray, of: np.ndarray) -> None:
        q = self.queries
        if q.cells.shape[1] == rows.cells.shape[1]:
            with np.errstate(all="ignore"):
                score = _clamped(_running(q.cells[at], rows.cells[of]), rows.norms[of] * q.norms[at])
        else:
            score = np.zeros(len(at))
        found = pa.table({"q": pa.array(at, pa.int64()), "score": pa.array(score), "id": rows.ids.take(pa.array(of))}, schema=self.best.schema)
        both = pa.concat_tables([self.best, found])
        both = both.take(pc.sort_indices(both, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        own = both["q"].to_numpy()
        place = np.arange(len(own)) - np.searchsorted(own, own)
        last = place == self.k - 1
        self.floor[own[last]] = both["score"].to_numpy()[last]
        self.best = both.filter(pa.array(place < self.k)).combine_chunks()

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids = self.queries.ids.take(self.best["q"].combine_chunks())
        yield from pa.table({"query_id": ids, "id": self.best["id"], "score": self.best["score"]}).to_batches()


def leading(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id, score of pairs of packed blocks (b, query_ids, query_dims, query_cells, ids, dims, cells); pairs of one block of queries follow each other."""
    seen, best = None, None
    for batch in batches:
        b, query_ids, query_dims, query_cells, ids, dims, cells = batch.columns
        for r in range(batch.num_rows):
            if b[r].as_py() != seen:
                if best is not None:
                    yield from best.rows()
                seen, best = b[r].as_py(), Leading(Side(query_ids[r].values, query_dims[r].as_py(), query_cells[r].as_buffer()), k, ids.type.value_type)
            best.show(Side(ids[r].values, dims[r].as_py(), cells[r].as_buffer()))
    if best is not None:
        yield from best.rows()
