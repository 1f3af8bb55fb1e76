"""O1 by an index: inverted lists with product-quantised residuals, re-scored by exact cosine.

`fit` learns unit centroids (spherical k-means) and a codebook for each group of dimensions of the residuals, on a bounded sample of rows: the
SAMPLE rows with the smallest id hashes. It also measures, on the sample's own neighbours, how many lists a query must
visit for the wanted recall: few where vectors cluster, nearly all where they don't (then the codes, a sixteenth of the
vectors' size, are what is saved). `build` assigns every row to a list and writes blocks of codes by list, so that
a search opens the folders of the lists it visits alone; `append` adds rows to them.

`search` takes a table of queries. Queries of a list travel in groups; a group meets the blocks of every list that one of
them visits, block scores come from decoded codes by one matrix product, and a task keeps each query's best candidates so
far. The best `rescored` candidates of each query are joined with the vectors, which gives the exact cosine of the exact
search. Lists of any size are split by adaptive execution: a block is a row, and no task needs a whole list.

Null vectors and vectors of length zero score 0, as in the exact search (`retrieval.top_k_per_query`, which stays the
reference); vectors of another dimension are an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp, cosine
from ..shipping import ship_package

#: Rows that centroids, codebooks and the number of visited lists are learnt from, at most.
SAMPLE = 20_000
#: Lists at most, and dimensions that share a code byte.
MOST_LISTS, CODED = 4_096, 4
BLOCK_ROWS = 4_096
GROUP_QUERIES = 128
#: Candidates a task keeps for the groups it has met before it passes them on.
HELD_CANDIDATES = 1_000_000
RECALL = 0.98
_BLOCKS = "list int, ids array<long>, codes binary"
#: Candidates of a query that are re-scored, at least, where the caller names no number.
LEAST_RESCORED = 100


@dataclass
class VectorIndex:
    """What `fit` learnt, and where `build` wrote the blocks."""

    centroids: np.ndarray
    codebooks: np.ndarray
    visits: int
    path: str = ""

    def units(self, rows: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def lists(self, units: np.ndarray) -> np.ndarray:
        return np.argmax(units @ self.centroids.T, axis=1)

    def visited(self, units: np.ndarray) -> np.ndarray:
        """Whether each row (query) visits each list."""
        near = np.argpartition(-(units @ self.centroids.T), min(self.visits, len(self.centroids)) - 1, axis=1)[:, : self.visits]
        out = np.zeros((len(units), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def encode(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (units - self.centroids[lists]).reshape(len(units), len(self.codebooks), -1)
        return np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, number: int) -> np.ndarray:
        rest = self.codebooks[np.arange(len(self.codebooks)), codes]
        return self.centroids[number] + rest.reshape(len(codes), -1)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, unit: bool, rounds: int = 12) -> np.ndarray:
    """k-means from k of the rows; an empty cluster keeps its centre."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        number = np.argmax(rows @ centres.T, axis=1) if unit else _nearest(rows, centres)
        sums, counts = np.zeros_like(centres), np.bincount(number, minlength=len(centres))
        np.add.at(sums, number, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if unit:
            size = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.divide(centres, size, out=centres, where=size > 0)
    return centres


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column; null vectors and null elements are zeros."""
    rows = np.zeros((len(column), dims), np.float64)
    for k, value in enumerate(column.to_pylist()):
        if value is not None:
            if len(value) != dims:
                raise ValueError(f"a vector has {len(value)} dimensions, the index {dims}")
            rows[k] = [0.0 if x is None else x for x in value]
    return rows


def fit(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None, seed: int = 7, neighbours: int = 10) -> VectorIndex:
    """Centroids, codebooks and visits from a bounded sample."""
    kept = vectors.where(F.col(vector_col).isNotNull())
    total = kept.count()
    sample = kept.select(vector_col, F.xxhash64(id_col).alias("__h")).orderBy("__h").limit(SAMPLE).toPandas()[vector_col]
    rng = np.random.default_rng(seed)
    rows = np.array(sample.tolist(), np.float64) if len(sample) else np.zeros((1, CODED))
    index = VectorIndex(rows, rows, 1)
    units = index.units(rows)
    k = min(len(units), lists or min(MOST_LISTS, max(1, round(total**0.5))))
    index.centroids = _means(units, k, rng, True)
    number = index.lists(units)
    dims = units.shape[1]
    parts = dims // CODED if dims % CODED == 0 else dims
    rest = (units - index.centroids[number]).reshape(len(units), parts, -1)
    index.codebooks = np.stack([_means(rest[:, m], min(256, len(units)), rng, False) for m in range(parts)])
    # the rank of the list that holds each of the sample's own nearest neighbours
    asked = units[rng.permutation(len(units))[:200]]
    near = np.argsort(-(asked @ units.T), axis=1, kind="stable")[:, 1 : neighbours + 1]
    order = np.argsort(np.argsort(-(asked @ index.centroids.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, number[near], axis=1).ravel()) if near.size else np.zeros(1, int)
    index.visits = int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))) - 1)]) + 1
    return index


def _blocks(index: VectorIndex, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """list, ids, codes: blocks of rows of one list."""
    ship_package(vectors.sparkSession)
    shared, dims = vectors.sparkSession.sparkContext.broadcast(index), index.centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            units = at.units(_matrix(batch.column(1), dims))
            number = at.lists(units)
            codes = at.encode(units, number)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        count = 0

        def cut(number: int) -> pa.RecordBatch:
            ids, codes = held.pop(number)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(codes)], pa.binary())], ["list", "ids", "codes"])

        for batch in batches:
            for number, row, code in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, codes = held.setdefault(number, ([], []))
                ids.append(row)
                codes.append(code)
                count += 1
                if len(ids) == BLOCK_ROWS:
                    count -= BLOCK_ROWS
                    yield cut(number)
            if count > 64 * BLOCK_ROWS:
                for number in list(held):
                    yield cut(number)
                count = 0
        for number in list(held):
            yield cut(number)

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(assign, "list int, id long, code binary").hint("rebalance", "list").mapInArrow(pack, _BLOCKS)


def build(index: VectorIndex, vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
    """Write the blocks of every row below path, with what was learnt, and give the index bound to them."""
    _blocks(index, vectors, id_col, vector_col).write.partitionBy("list").parquet(f"{path}/blocks")
    model = [(index.centroids.tobytes(), json.dumps(index.centroids.shape), index.codebooks.tobytes(), json.dumps(index.codebooks.shape), index.visits)]
    vectors.sparkSession.createDataFrame(model, "centroids binary, centroid_shape string, codebooks binary, codebook_shape string, visits int").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(index.centroids, index.codebooks, index.visits, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index that `build` wrote."""
    m = spark.read.parquet(f"{path}/model").first()
    array = lambda data, shape: np.frombuffer(data).reshape(json.loads(shape))
    return VectorIndex(array(m["centroids"], m["centroid_shape"]), array(m["codebooks"], m["codebook_shape"]), m["visits"], path)


def append(index: VectorIndex, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Add rows to the lists; centroids and codebooks stay."""
    _blocks(index, vectors, id_col, vector_col).write.mode("append").partitionBy("list").parquet(f"{index.path}/blocks")


def candidates(index: VectorIndex, queries: DataFrame, count: int) -> DataFrame:
    """query_id, id: the best count rows of each query (query_id, vector) by decoded codes, among the lists it visits."""
    spark = queries.sparkSession
    ship_package(spark)
    dims = index.centroids.shape[1]
    shared = spark.sparkContext.broadcast(index)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            units = at.units(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([pa.array(at.lists(units).astype(np.int32)), batch.column(0), pa.array([u.astype(np.float32).tobytes() for u in units], pa.binary())], ["home", "query_id", "unit"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            ids, units = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for start in range(0, len(order), GROUP_QUERIES):
                some = order[start : start + GROUP_QUERIES].tolist()
                block = b"".join(units[k] for k in some)
                lists = np.flatnonzero(at.visited(np.frombuffer(block, np.float32).reshape(-1, dims).astype(np.float64)).any(axis=0))
                columns = [lists.astype(np.int32)], [[ids[k] for k in some]], [block]
                kinds = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lists", "query_ids", "units"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = shared.value, {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for asked, best in held.values():
                kept = [(q, x, s) for q, (ids, scores) in zip(asked, best, strict=True) for x, s in zip(ids.tolist(), scores.tolist(), strict=True)]
                columns = list(zip(*kept, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "near"])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row["query_ids"])
                asked = np.frombuffer(row["units"], np.float32).reshape(-1, dims).astype(np.float64)
                if key not in held:
                    held[key] = row["query_ids"], [(np.zeros(0, np.int64), np.zeros(0))] * len(key)
                best = held[key][1]
                ids = np.array(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                visiting = np.flatnonzero(at.visited(asked)[:, row["list"]])
                scores = asked[visiting] @ at.decode(codes, row["list"]).T
                for q, mine in zip(visiting.tolist(), scores, strict=True):
                    names, values = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], mine])
                    if len(names) > count:
                        top = np.argpartition(-values, count - 1)[:count]
                        names, values = names[top], values[top]
                    size += len(names) - len(best[q][0])
                    best[q] = names, values
                if size > HELD_CANDIDATES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v"))
    homes = asked.mapInArrow(near, "home int, query_id long, unit binary")
    groups = homes.hint("rebalance", "home").mapInArrow(group, "lists array<int>, query_ids array<long>, units binary")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{index.path}/blocks")
    met = groups.select(F.explode("lists").alias("list"), "query_ids", "units").join(blocks, "list")
    scored = met.mapInArrow(score, "query_id long, id long, near double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
    return scored.withColumn("__rank", rank).where(F.col("__rank") <= count).select("query_id", "id")


def search(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, rescored: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the best k rows of each query by exact cosine among its candidates; ties by id."""
    found = candidates(index, queries, rescored or max(LEAST_RESCORED, 10 * k))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("q"))
    scored = found.join(rows, "id").join(asked, "query_id").select("query_id", "id", clamp(F.coalesce(cosine("v", "q"), F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
