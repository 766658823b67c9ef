"""Helpers shared by the corpus operators: the shared folder, written tables, batches of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir, written  # noqa: F401  the operators take them from here


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action are removed as it ends, not when the driver collects its garbage.

    Only for actions whose own result is all that is read later, such as tables that are written.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; then what the task has freed goes back to the system, as the worker stays for other tasks."""
    yield from batches
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: less memory at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def kept_rows(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows for whose texts ``keep`` says so, in their own partitions, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.bool_()))

    return docs.mapInArrow(lambda batches: released(run(batches)), docs.schema)


def text_blocks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, str]]:
    """Consecutive texts as ``(first, end, code points, starts, joined)``, about ``most`` code points each.

    ``starts`` has ``end - first + 1`` offsets. A longer text comes alone and whole; null is empty.
    """
    i, n = 0, len(texts)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + len(texts[j] or "") <= most):
            total += len(texts[j] or "")
            j += 1
        part = [t or "" for t in texts[i:j]]
        joined = "".join(part)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(t) for t in part], out=starts[1:])
        yield i, j, points, starts, joined
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = []
        for b in (BASE, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]``, the same wherever the span stands."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class HashTable:
    """Open addressing over 64-bit keys with 32-bit values, filled and read in whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        self.size += len(keys)
        if self.size > (1 << self.bits) * 0.7:
            raise ValueError("the table is full")
        slot, left = self._slot(keys), np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(left):
            at = slot[left]
            free = self.values[at] < 0
            spot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[spot], self.values[spot] = keys[who], values[who]
            done = np.zeros(len(keys), bool)
            done[who] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + (self.values[slot[left]] >= 0)) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where a key isn't there."""
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        mask = (1 << self.bits) - 1
        while len(wrong):
            at = (slot[wrong] + 1) & mask
            slot[wrong] = at
            got = self.values[at]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[at] != keys[wrong])]
        return out
