"""Packing of token streams into windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every shorter document, is an
item. Items go, longest first, into the open window with the least room that still holds them, found by a segment tree
indexed by remaining capacity. As lengths are bounded by the window, windows with equal histories are handled as one
run, and the plan for any number of items follows from their counts by length: its size depends on the window only.
An item's place then follows from its length and its rank among the items of that length.

Null text is empty; an empty document is its end token alone. Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import parts_of, released, written
from .byte_bpe import encoded

PIECE = "doc_id {key}, start long, length long, {payload}, doc_tokens long, part long, nth long"


class CapacityTree:
    """Which remaining capacities have open windows; the least one that is no less than a need, in O(log n)."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, room: int, there: bool) -> None:
        at = self.base + room
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least open capacity >= need, or -1."""
        at = self.base + need
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


def plan_windows(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Places for ``counts[s]`` items of each length s: rows (length, first rank, items, first window, items a window, offset), by length and rank."""
    tree, runs, rows, windows = CapacityTree(capacity), {}, [], 0
    for size in range(capacity, 0, -1):
        left, rank = int(counts[size]), 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, first, n = capacity, windows, -(-left // (capacity // size))
                windows += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // size
            whole = min(n, left // each)
            todo = [(first, whole, each)] if whole else []
            rest = left - whole * each
            if whole < n and rest:
                todo.append((first + whole, 1, rest))
            used = 0
            for at, many, items in todo:
                rows.append((size, rank, many * items, at, items, capacity - room))
                rank += many * items
                left -= many * items
                used += many
                after = room - items * size
                if after:
                    if not runs.setdefault(after, []):
                        tree.set(after, True)
                    runs[after].append((at, many))
            if used < n:
                if not runs.setdefault(room, []):
                    tree.set(room, True)
                runs[room].append((first + used, n - used))
    return np.array(rows, np.int64).reshape(-1, 6)


def cut_documents(df: DataFrame, tokenizer: str, capacity: int, end_id: int, payload: str) -> DataFrame:
    """The pieces of each document, with the partition that made them and their number among its pieces of that length."""
    kind = "ids array<int>" if payload == "ids" else "ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in parts_of(batches):
            rows = []
            for i, ids in encoded(batch.column(1).to_pylist(), tokenizer):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()) if payload != "ids" else piece.astype(np.int32), len(ids), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            long = lambda x: pa.array(np.array(x, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(long(columns[0])), long(columns[1]), long(columns[2]), pa.array(columns[3], pa.list_(pa.int32())) if payload == "ids" else long(columns[3]), *map(long, columns[4:])], ["doc_id", "start", "length", kind.split()[0], "doc_tokens", "part", "nth"])

    return df.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), PIECE.format(key=df.schema["doc_id"].dataType.simpleString(), payload=kind))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, payload: str = "ids") -> DataFrame:
    """Packs the documents ``(doc_id, text)`` into windows of ``capacity`` tokens.

    One row a piece: doc_id, start (its document's ids before it), length, ids (or with ``payload='crc32'`` their
    ids_crc32), doc_tokens, sequence_id and offset there, without gaps from 0. ``end_id`` ends each document. Only the
    counts by length, ``capacity`` numbers, reach the driver; the pieces stay in their partitions.
    """
    if payload not in ("ids", "crc32"):
        raise ValueError(payload)
    pieces = written(cut_documents(df, tokenizer, capacity, end_id, payload), "pieces")
    counts = written(pieces.groupBy("part", "length").count(), "counts")
    totals = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        totals[row["length"]] = row["n"]
    plan = plan_windows(totals, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shift = np.int64(1) << np.int64(44)
    first = plan[:, 0] * shift + plan[:, 1]
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("part", "base")
    names = ["doc_id", "start", "length", "ids" if payload == "ids" else "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in (2, 5))
            row = plan[np.searchsorted(first, length * shift + nth, side="right") - 1]
            at = nth - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema)
    return ranked.select(*names, "nth").mapInArrow(place, fields + ", sequence_id long, offset long")
