"""Nearest neighbours by largest inner product, by products of whole blocks.

Vectors are packed, ``TILE_VECTORS`` a row at most, queries ``TILE_QUERIES`` a row, and each block of queries meets each
block of vectors: of that pair one matrix product in single precision estimates all inner products, with a bound on
their error that holds whatever the order of the sums. Only pairs whose estimate comes within that bound of the query's
k-th score so far are scored exactly, on the original vectors in double precision, so the result is exact.

A task takes some blocks of queries through a chunk of the blocks of vectors and passes on the k best of each query, so
no vector is shuffled for the search: the packed tables are read as they were written, and there are few chunks.

Of equal vectors in a block only those of least vec_id stay that can be among the k best. Vectors that are null, empty,
zero, or hold null or non-finite components take no part, nor do rows without vec_id. Rows that repeat id and vector
count once; an id with several vectors is several rows. Only vectors of the query's length are its candidates. Ties go to
the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, written

TILE_QUERIES, TILE_VECTORS = 4096, 16384
#: Bytes of the vectors of a block, at most (one vector at least).
BLOCK_BYTES = 4 << 20
#: Queries that one product takes.
STEP = 256
#: Blocks of vectors that a task takes, about; no more chunks than ``CHUNKS`` if fewer do.
CHUNK_BLOCKS, CHUNKS = 128, 8
_PACKED = "dim int, ids binary, vecs binary"
_FOUND = "query_id long, vec_id long, score double"


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, summed in the order of the components."""
    out = np.zeros(len(q))
    for i in range(queries.shape[1]):
        out += queries[q, i].astype(np.float64) * rows[at, i].astype(np.float64)
    return out


def least_copies(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The places, by id, of the rows less those that ``most`` equal rows of a lesser id precede."""
    names = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, names))
    first = np.flatnonzero(np.append(True, np.diff(names[order]) != 0))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[nth < most])


def lengths(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(1).astype(np.float64)
    return most * np.sqrt(((rows.astype(np.float64) / most[:, None]) ** 2).sum(1))


class Search:
    """The k best so far of the rows of one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.norm = lengths(queries)
        self.unit = (queries / self.norm[:, None]).astype(np.float32)
        self.score = np.full((len(ids), k), -np.inf)
        self.near = np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        norm = lengths(rows).max()
        unit = (rows / norm).astype(np.float32).T
        # of products of vectors no longer than 1: their rounding, and that of each term and sum, twice over
        slack = (rows.shape[1] + 8) * 2.0**-23
        for lo in range(0, len(self.ids), STEP):
            hi = min(lo + STEP, len(self.ids))
            about = self.unit[lo:hi] @ unit
            floor = self.score[lo:hi, -1] / self.norm[lo:hi] / norm - slack
            new = np.flatnonzero(np.isneginf(floor))
            if len(new) and len(ids) > self.k + 1:  # the query itself may be one of them
                floor[new] = np.partition(about[new], len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1] - 2 * slack
            spots = np.flatnonzero(about >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
            for part in np.array_split(spots, -(-len(spots) // (1 << 20)) or 1):
                self._add(lo + part // len(ids), part % len(ids), ids, rows)

    def _add(self, q: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = np.flatnonzero(self.ids[q] == ids[at])
        if len(own):
            other = np.ones(len(q), bool)
            other[own] = (self.queries[q[own]] != rows[at[own]]).any(1)
            q, at = q[other], at[other]
        score = exact(self.queries, rows, q, at)
        good = score >= self.score[q, -1]
        q, near, score = q[good], ids[at[good]], score[good]
        if not len(q):
            return
        some = np.unique(q)
        held_q, held = np.repeat(some, self.k), ~np.isneginf(self.score[some]).ravel()
        q, near, score = np.append(held_q[held], q), np.append(self.near[some].ravel()[held], near), np.append(self.score[some].ravel()[held], score)
        order = np.lexsort((near, -score, q))
        q, near, score = q[order], near[order], score[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        best = nth < self.k
        self.near[q[best], nth[best]], self.score[q[best], nth[best]] = near[best], score[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, nth = np.nonzero(~np.isneginf(self.score))
        return self.ids[q], self.near[q, nth], self.score[q, nth]


def _packing(most: int, single: bool, copies: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, v) as blocks of one length of vectors each; of equal vectors ``copies`` stay."""
    kind = np.float32 if single else np.float64

    def block(dim: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        own, x = np.concatenate(ids), np.ascontiguousarray(np.concatenate(rows))
        if copies:
            kept = least_copies(own, x, copies)
            own, x = own[kept], x[kept]
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [own.tobytes()], "vecs": [x.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            begin = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                fit = max(1, min(most, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)))
                while len(own):
                    take, own = np.split(own, [fit - held.get(dim, 0)])
                    x = flat[begin[take][:, None] + np.arange(dim)].astype(kind) + kind(0)  # no negative zeros
                    parts = open_.setdefault(dim, ([], []))
                    parts[0].append(ids[take])
                    parts[1].append(x)
                    held[dim] = held.get(dim, 0) + len(take)
                    if held[dim] == fit:
                        yield block(dim, *open_.pop(dim))
                        del held[dim]
        for dim, parts in open_.items():
            yield block(dim, *parts)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k nearest of each query among all other rows of ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(sound).distinct()
    few = min(8, partitions(spark))
    tasks = lambda df, most: max(few, -(-df.count() // most))
    blocks = written(rows.coalesce(tasks(vectors, TILE_VECTORS)).mapInArrow(_packing(TILE_VECTORS, single, k + 1), _PACKED), "vectors")
    asked = written(rows.filter(is_query).coalesce(tasks(vectors.filter(is_query), TILE_QUERIES)).mapInArrow(_packing(TILE_QUERIES, single, None), _PACKED), "queries")
    lines, n = asked.count(), blocks.count()
    if not lines:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chunks = min(n, max(-(-n // CHUNK_BLOCKS), min(CHUNKS, -(-partitions(spark) // lines))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[bytes, int], Search] = {}
        for batch in batches:
            names, width, a, x, b, y = batch.columns
            for r in range(batch.num_rows):
                matrix = lambda c, dim=width[r].as_py(): np.frombuffer(c[r].as_buffer(), np.float32 if single else np.float64).reshape(-1, dim)
                name = names[r].as_py()
                if name not in states:
                    states[name] = Search(np.frombuffer(a[r].as_buffer(), np.int64).copy(), matrix(x).copy(), k)
                states[name].meet(np.frombuffer(b[r].as_buffer(), np.int64), matrix(y))
        for state in states.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in state.found()], ["query_id", "vec_id", "score"])

    left = blocks.select(F.col("dim").alias("d"), F.col("ids").alias("b"), F.col("vecs").alias("y")).coalesce(chunks)
    right = asked.select(F.monotonically_increasing_id().alias("name"), "dim", F.col("ids").alias("a"), F.col("vecs").alias("x")).repartition(lines, "name")
    # lengths are compared so that all pairs of blocks are met where the vectors are: a join on them would gather these
    met = left.hint("shuffle_replicate_nl").join(right.hint("shuffle_replicate_nl"), F.least("d", "dim") == F.greatest("d", "dim"))
    pairs = met.select("name", "dim", "a", "x", "b", "y").mapInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
