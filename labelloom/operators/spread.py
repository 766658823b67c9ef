"""Training whose examples stay spread: they are packed into blocks once, and each step of a minimiser is a pass over them.

Many labels are minimised side by side. Each runs the code of the kernel on the driver, holding vectors of its weights'
size, and a pass over the blocks answers what all labels ask next. No task and no driver holds all examples or features.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK = 1 << 18  # entries a block, unless one example has more
TASK = 1 << 22  # entries a task of a pass
WEIGHTS = 1 << 19  # weights of the labels that are trained side by side
CELLS = 1 << 20  # pairs of example and label that a task works on at once
PARTIAL_BYTES = 32 << 20  # sums of tasks, in all, that the driver adds up itself

_SCHEMA = "n_rows int, dense boolean, row binary, column binary, value binary, positive_row binary, positive binary, chosen_row binary, chosen binary"
_KINDS = ("example", "feature", "label", "chosen")


class Rows:
    """Rows of a sparse matrix: products with it and with its transpose."""

    def __init__(self, index: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, n_columns: int):
        self.index, self.column, self.value, self.shape = index, column, value, (n_rows, n_columns)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * w[self.column], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.index], self.shape[1])

    def back_squared(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value**2 * v[self.index], self.shape[1])


def packed_blocks(features: DataFrame, labels: DataFrame, examples: DataFrame, shortlist: DataFrame | None, n_entries: int, n_columns: int) -> DataFrame:
    """Examples with their features, labels and shortlists as arrays, some hundred thousand entries a row, in the shared folder."""
    spark = features.sparkSession
    zero = lambda t: F.lit(0).cast(t)
    tables = [(examples, zero("long"), zero("double")), (features, F.col("feature_id"), F.col("value")), (labels, F.col("label_id"), zero("double"))]
    if shortlist is not None:
        tables.append((shortlist, F.col("label_id"), zero("double")))
    rows = None
    for kind, (table, key, value) in enumerate(tables):
        one = table.select(F.col("example_id").cast("long").alias("example_id"), F.lit(kind).alias("kind"), key.cast("long").alias("key"), value.cast("double").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // TASK))

    def block(e: np.ndarray, kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch | None:
        every = np.unique(e[kind == 0])
        if not len(every):
            return None
        at = np.minimum(np.searchsorted(every, e), len(every) - 1)
        known = every[at] == e
        own = [known & (kind == k) for k in range(len(_KINDS))]
        row, column, value = at[own[1]].astype(np.int32), key[own[1]].astype(np.int32), value[own[1]]
        dense = len(value) == len(every) * n_columns and bool((column.reshape(len(every), -1) == np.arange(n_columns)).all())
        arrays = [np.zeros(0, np.int32) if dense else row, np.zeros(0, np.int32) if dense else column, value, at[own[2]].astype(np.int32), key[own[2]], at[own[3]].astype(np.int32), key[own[3]]]
        return pa.record_batch([pa.array([len(every)], pa.int32()), pa.array([dense])] + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= BLOCK:
                e, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(e, e[-1]))  # the last example may go on
                if cut and (made := block(e[:cut], *(x[:cut] for x in rest))):
                    yield made
                held, size = [[x[cut:] for x in (e, *rest)]], len(e) - cut
        if size and (made := block(*(np.concatenate(x) for x in zip(*held, strict=True)))):
            yield made

    dealt = rows.repartition(parts, "example_id").sortWithinPartitions("example_id", "kind", "key")
    return written(dealt.mapInArrow(pack, _SCHEMA), "packed")


def answers_together(jobs: list[Callable[[Callable], Any]], answer: Callable[[list[tuple]], list]) -> list:
    """The results of jobs that run side by side and may ask: as soon as all that go on wait, ``answer`` gets all their questions at once."""
    said: queue.Queue = queue.Queue()
    replies = [queue.Queue() for _ in jobs]

    def run(i: int) -> None:
        def ask(question: tuple) -> Any:
            said.put(("asks", i, question))
            if isinstance(got := replies[i].get(), BaseException):
                raise got
            return got

        try:
            said.put(("ended", i, jobs[i](ask)))
        except BaseException as e:  # noqa: BLE001  told to the caller
            said.put(("failed", i, e))

    for i in range(len(jobs)):
        threading.Thread(target=run, args=(i,), daemon=True).start()
    results, waiting, left, failed = [None] * len(jobs), [], len(jobs), None
    while left:
        what, i, x = said.get()
        if what == "asks":
            waiting.append((i, x))
        else:
            left -= 1
            results[i] = x
            failed = x if what == "failed" else failed
        if waiting and len(waiting) == left:
            try:
                found = [failed] * left if failed else answer([q for _, q in waiting])
            except BaseException as e:  # noqa: BLE001  so that no thread waits for ever
                failed, found = e, [e] * left
            for (j, _), one in zip(waiting, found, strict=True):
                replies[j].put(one)
            waiting = []
    if failed:
        raise failed
    return results


class Spread:
    """``Linear`` for a label whose examples are spread: the same values, asked of a pass over the blocks."""

    def __init__(self, label: int, ask: Callable[[tuple], np.ndarray], strength: float | np.ndarray, n_columns: int, ignore_last: bool, penalty: Callable):
        self.label, self.ask, self.penalty, self.n = label, ask, penalty, n_columns
        self.strength = np.broadcast_to(np.asarray(strength, np.float64), (n_columns,)).copy()
        if ignore_last:
            self.strength[-1] = 0
        self.at: np.ndarray | None = None

    def _seen(self, w: np.ndarray) -> np.ndarray:
        """Loss, its gradient and the diagonal of its Hessian, without the penalty: of these weights a pass tells them once."""
        if self.at is None or not np.array_equal(self.at, w):
            self.found, self.at = self.ask(("slopes", self.label, w, None)), w.copy()
        return self.found

    def value(self, w: np.ndarray) -> float:
        return float(self._seen(w)[0] + (self.strength * self.penalty(w)[0]).sum())

    def slopes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        found, (_, down, bend) = self._seen(w), self.penalty(w)
        ridge = self.strength * bend
        return found[1 : 1 + self.n] + self.strength * down, found[1 + self.n :] + ridge, lambda d: self.ask(("product", self.label, w, d)) + ridge * d

    def line(self, w: np.ndarray, d: np.ndarray) -> Callable[[float], float]:
        return lambda t: self.value(w + t * d)


class _Chunk:
    """Some rows of a block, for several labels at once."""

    def __init__(self, row: dict, first: int, end: int, n_columns: int):
        value = np.frombuffer(row["value"], np.float64)
        self.dense = row["dense"]
        if self.dense:
            self.x = value.reshape(-1, n_columns)[first:end]
        else:
            index = np.frombuffer(row["row"], np.int32)
            a, b = np.searchsorted(index, [first, end])
            self.x = Rows(index[a:b] - first, np.frombuffer(row["column"], np.int32)[a:b], value[a:b], end - first, n_columns)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w.T if self.dense else np.stack([self.x.dot(v) for v in w], axis=1)

    def back(self, t: np.ndarray) -> np.ndarray:
        return t.T @ self.x if self.dense else np.stack([self.x.back(v) for v in t.T])

    def back_squared(self, t: np.ndarray) -> np.ndarray:
        return t.T @ (self.x * self.x) if self.dense else np.stack([self.x.back_squared(v) for v in t.T])


def _marks(row: dict, name: str, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in ``own`` of a block's pairs of example and label."""
    at, label = np.frombuffer(row[f"{name}_row"], np.int32), np.frombuffer(row[name], np.int64)
    place = np.minimum(np.searchsorted(own, label), len(own) - 1)
    there = own[place] == label
    return at[there], place[there]


def passes(blocks: DataFrame, own: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_columns: int, loss: Callable, listed: bool) -> Callable[[list[tuple]], list]:
    """Answers questions about the labels ``own`` (ascending) by a pass over the blocks.

    Of ("slopes", place of a label, weights, None): loss, gradient and the diagonal of the Hessian, one after the other; of
    ("product", place, weights, direction): the Hessian's product; of ("counts", place, None, None): positives, examples.
    """
    spark, parts = blocks.sparkSession, blocks.rdd.getNumPartitions()
    sizes = {"slopes": 1 + 2 * n_columns, "product": n_columns, "counts": 2}

    def answer(questions: list[tuple]) -> list:
        sets = {}
        for kind in sizes:
            which = [i for i, q in enumerate(questions) if q[0] == kind]
            if which:
                stack = lambda k: None if questions[which[0]][k] is None else np.stack([questions[i][k] for i in which])  # noqa: B023, E731
                sets[kind] = (which, np.array([questions[i][1] for i in which]), stack(2), stack(3))
        sent = spark.sparkContext.broadcast({k: v[1:] for k, v in sets.items()})
        total = {k: (len(v[0]), sizes[k]) for k, v in sets.items()}
        length = sum(n * size for n, size in total.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            sums = {k: np.zeros(s) for k, s in total.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    (at, label), (at_c, label_c) = _marks(row, "positive", own), _marks(row, "chosen", own)
                    most = max(1, CELLS // max(s[0] for s in total.values()))
                    for first in range(0, row["n_rows"], most):
                        end = min(first + most, row["n_rows"])
                        chunk = _Chunk(row, first, end, n_columns)
                        for kind, (which, w, d) in asked.items():
                            column = np.full(len(own), -1)
                            column[which] = np.arange(len(which))

                            def spots(at: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                                inside = (at >= first) & (at < end) & (column[label] >= 0)  # noqa: B023
                                return at[inside] - first, column[label[inside]]  # noqa: B023

                            y = np.full((end - first, len(which)), -1.0)
                            y[spots(at, label)] = 1
                            counts = np.ones_like(y)
                            if listed:
                                counts[:] = 0
                                counts[spots(at_c, label_c)] = 1
                            if kind == "counts":
                                sums[kind] += np.stack([((y > 0) * counts).sum(0), counts.sum(0)], axis=1)
                                continue
                            cost = np.where(y > 0, pos[which], neg[which]) * counts
                            value, slope, curve = loss(y * chunk.dot(w))
                            if kind == "slopes":
                                sums[kind] += np.hstack([(cost * value).sum(0)[:, None], chunk.back(cost * y * slope), chunk.back_squared(cost * curve)])
                            else:
                                sums[kind] += chunk.back(cost * curve * chunk.dot(d))
            yield pa.record_batch([pa.array([np.concatenate([s.ravel() for s in sums.values()]).tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(length)
            for batch in batches:
                for one in batch.column(0):
                    whole += np.frombuffer(one.as_buffer(), np.float64)
            yield pa.record_batch([pa.array([whole.tobytes()], pa.binary())], names=["sums"])

        partial = blocks.mapInArrow(run, "sums binary")
        if parts * length * 8 > PARTIAL_BYTES:
            partial = partial.repartition(max(1, round(parts**0.5))).mapInArrow(add, "sums binary")
        whole = np.zeros(length)
        for r in partial.collect():
            whole += np.frombuffer(r["sums"], np.float64)
        sent.destroy()
        found, at = [None] * len(questions), 0
        for kind, (n, size) in total.items():
            for j, i in enumerate(sets[kind][0]):
                found[i] = whole[at + j * size : at + (j + 1) * size]
            at += n * size
        return found

    return answer
