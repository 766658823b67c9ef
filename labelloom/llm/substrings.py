"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every ``length`` bytes of text name an anchor in them: the ``GRAM`` bytes of least hash, the leftmost of equal ones. Equal
strings have equal anchors at equal distances, so the suffixes that begin at strings of one anchor form a suffix bucket
that can be sorted by itself, without the rest of the text. The steps:

1. Texts are cut into blocks of about ``BLOCK_BYTES``, compressed, in their own partitions.
2. Of each block, every anchor's hash is counted once; hashes of a single document end here.
3. For the others the bytes around the anchor go, once a block for equal bytes, to their suffix bucket.
4. A task takes one bucket at a time. At the columns of a difference cover modulo 13 it ranks all suffixes of the bucket,
   right to left; a suffix elsewhere is sorted by the few bytes to the next cover column and by the rank there, so ties
   of any length cost one comparison of numbers. Neighbours that agree in ``length`` bytes form a group, whose smallest
   document comes back to each block for which it matters.
5. Each block marks and removes what an earlier document holds.

An anchor of very many documents is handled string by string: inside a shared passage equal strings meet once a block,
and where texts differ around it the strings go to different buckets. Memory is that of a block or a bucket.

Null text is empty; texts shorter than ``length`` are kept. Matches never cross documents, and a string that repeats
only within its document is kept. Rows that share a doc_id don't remove each other's text; a null doc_id counts as the
largest. Other columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mixed, partitions, release, released, span_hashes, written

GRAM = 18
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 1 << 18
#: Documents that an anchor may have before its strings are handled one by one.
FREQUENT = 2000
COVER_PERIOD, COVER = 13, (0, 1, 3, 9)
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 1 << 16
#: Anchors whose bytes are taken at a time.
ANCHORS = 1 << 13
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LAST = np.iinfo(np.int64).max


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit words, as differences, their bytes by significance."""
    steps = np.diff(x, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def open_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(expand(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def expand(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts ``data[starts[i]:starts[i + 1]]``: each anchor's position and hash, and the first and end of the strings that name it (their starts)."""
    span, n = length - GRAM + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    at = np.arange(n - GRAM + 1)
    hashed = span_hashes(_BYTES[data], at, at + GRAM)
    bits = np.uint64(max(1, int(n).bit_length()))
    cells = (hashed >> bits << bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        cells = np.minimum(cells[:-width], cells[width:])
        width *= 2
    if width < span:
        rest = span - width
        cells = np.minimum(cells[:-rest], cells[rest:])
    inside = np.zeros(n - length + 1, bool)
    size = np.diff(starts)
    for a, b in zip(starts[:-1][size >= length].tolist(), starts[1:][size >= length].tolist(), strict=True):
        inside[a : b - length + 1] = True
    begin = np.flatnonzero(inside)
    owner = (cells[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else none
    position, first = owner[new], begin[new]
    return position, hashed[position], first, begin[np.append(new[1:], len(owner)) - 1] + 1 if len(new) else none


def sliced(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors``, some whole texts at a time."""
    out, i = [], 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES, side="right")) - 1)
        p, h, a, b = anchors(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], length)
        out.append((p + starts[i], h, a + starts[i], b + starts[i]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def surroundings(data: np.ndarray, position: np.ndarray, first: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each anchor's strings, each byte at its column relative to the anchor, zero elsewhere; and the columns of the first string and past the last."""
    span = length - GRAM + 1
    width = span - 1 + length
    origin = position - (span - 1)
    rows = np.zeros((len(position), width), np.uint8)
    for i in range(0, len(position), ANCHORS):
        some = slice(i, i + ANCHORS)
        grid = origin[some, None] + np.arange(width)
        held = (grid >= first[some, None]) & (grid < (end[some] - 1 + length)[:, None])
        rows[some] = np.where(held, data[np.clip(grid, 0, max(0, len(data) - 1))], 0)
    return rows, (first - origin).astype(np.uint8), (end - origin).astype(np.uint8)


def string_by_string(rows: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each string in a row of its own: the row it comes from, bytes, and columns."""
    many = (high.astype(np.int64) - low).astype(np.int64)
    source = np.repeat(np.arange(len(rows)), many)
    column = low.astype(np.int64)[source] + np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
    grid = np.arange(rows.shape[1])
    held = (grid >= column[:, None]) & (grid < column[:, None] + length)
    return source, np.where(held, rows[source], 0).astype(np.uint8), column.astype(np.uint8), (column + 1).astype(np.uint8)


def row_hashes(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = low.astype(np.uint64) * np.uint64(257) + high
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    for word in padded.view("<u8").T:
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + word)
    return out


def described(data: np.ndarray, starts: np.ndarray, length: int, keys: np.ndarray, frequent: np.ndarray) -> tuple:
    """The strings of a block's anchors among ``keys`` (sorted): bucket key, name, bytes, columns, anchor position and row's text number.

    ``frequent`` marks the keys whose strings are taken one by one.
    """
    position, hashed, first, end = sliced(data, starts, length)
    at = np.searchsorted(keys, hashed).clip(0, max(0, len(keys) - 1))
    mine = keys[at] == hashed if len(keys) else np.zeros(len(hashed), bool)
    position, hashed, first, end, many = position[mine], hashed[mine], first[mine], end[mine], frequent[at[mine]] if len(keys) else np.zeros(0, bool)
    rows, low, high = surroundings(data, position, first, end, length)
    source, own, a, b = string_by_string(rows[many], low[many], high[many], length)
    where = np.append(position[~many], position[many][source])
    rows, low, high = np.concatenate([rows[~many], own]), np.append(low[~many], a), np.append(high[~many], b)
    names = row_hashes(rows, low, high)
    # a bucket holds all strings of an anchor, or, of a frequent one, all equal strings
    key = np.append(hashed[~many], names[int((~many).sum()) :])
    return key, names, rows, low, high, where, np.searchsorted(starts, where, side="right") - 1


def cover_ranks(rows: np.ndarray, group: np.ndarray) -> dict[int, np.ndarray]:
    """The rank, among suffixes of all rows of its group that begin at that column, of each row's suffix at each column of the cover."""
    n, width = rows.shape
    ranks: dict[int, np.ndarray] = {}
    after, following = np.zeros(n, np.int64), width
    for column in [c for c in range(width - 1, -1, -1) if c % COVER_PERIOD in COVER]:
        order, new = _sorted(rows, group, after, column, following)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks[column], after, following = rank, rank, column
    return ranks


def _words(rows: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """Columns a to b as big-endian words of up to 8 bytes."""
    out = []
    for i in range(a, b, 8):
        word = np.zeros(len(rows), np.uint64)
        for j in range(i, min(b, i + 8)):
            word = word << np.uint64(8) | rows[:, j]
        out.append(word)
    return out


def _sorted(rows: np.ndarray, group: np.ndarray, rank: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, the bytes of columns a to b, rank; and where in it a value differs from the one before."""
    words = _words(rows, a, b)
    order = np.lexsort((rank, *reversed(words), group))
    new = np.zeros(len(order), bool)
    for x in (group, *words, rank):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return order, new


def least_documents(rows: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, document: np.ndarray, length: int) -> np.ndarray:
    """For each row and column the smallest document of the group's rows that have a string there, the same as this row's; -1 where the row has none."""
    columns = rows.shape[1] - length + 1
    out = np.full((len(rows), columns), -1, np.int64)
    ranks = cover_ranks(rows, group)
    cover = np.array(sorted(ranks))
    for column in range(columns):
        own = np.flatnonzero((low <= column) & (column < high))
        if not len(own):
            continue
        at = int(np.searchsorted(cover, column))
        to = int(cover[at]) if at < len(cover) else rows.shape[1]
        order, _ = _sorted(rows[own, column:to], group[own], ranks[to][own] if at < len(cover) else np.zeros(len(own), np.int64), 0, to - column)
        own = own[order]
        text = rows[own, column : column + length]
        new = np.append(True, (text[1:] != text[:-1]).any(1) | (group[own][1:] != group[own][:-1]))
        start = np.flatnonzero(new)
        out[own, column] = np.minimum.reduceat(document[own], start)[np.cumsum(new) - 1]
    return out


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """``(block, size, texts, starts, ids, rest)``: some rows each; rest has all other columns."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.utf8_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # in characters: near enough
            ends = np.cumsum(size)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
                part = batch.slice(i, j - i)
                texts = [(t or "").encode() for t in part.column(0).to_pylist()]
                starts = np.cumsum([0, *map(len, texts)])
                ids = part.column(1).cast(pa.int64()).fill_null(_LAST).to_numpy()
                rest = pa.RecordBatch.from_arrays(part.columns[2:], [f"c{k}" for k in range(len(others))])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                packed = zstandard.ZstdCompressor(level=3)
                yield pa.RecordBatch.from_pydict({"block": [number], "size": [int(starts[-1])], "texts": [packed.compress(b"".join(texts))], "starts": [squeeze(starts)], "ids": [squeeze(ids)], "rest": [packed.compress(sink.getvalue().to_pybytes())]})
                number += 1
                i = j

    picked = docs.select(F.col(text).cast("string"), F.col("doc_id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    return written(picked.mapInArrow(lambda batches: released(run(batches)), "block long, size long, texts binary, starts binary, ids binary, rest binary"), "blocks")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return expand(row["texts"], np.uint8), expand(row["starts"], np.int64), expand(row["ids"], np.int64)


def _dealt(keys: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket of the keys, then key, and the buckets met with their bounds in it."""
    bucket = (mixed(keys) % np.uint64(many)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    met, first = np.unique(bucket[order], return_index=True)
    return order, met, np.append(first, len(order))


def repeated_anchors(blocked: DataFrame, length: int, buckets: int, frequent: int) -> DataFrame:
    """``(block, keys, frequent)``: hashes of the block's anchors that two documents or more have."""

    def keys_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        position, hashed, _, _ = sliced(data, starts, length)
        return hashed, np.searchsorted(starts, position, side="right") - 1

    return repeated_keys(blocked, keys_of, buckets, frequent)


def repeated_keys(blocked: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: int, frequent: int) -> DataFrame:
    """``(block, keys, frequent)``: of the keys that ``keys_of`` finds in the texts of a block, with their texts' numbers, those of two texts or more; ``frequent`` marks those of more than so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            data, starts, _ = _opened(row)
            hashed, text = keys_of(data, starts)
            order = np.lexsort((text, hashed))
            hashed, text = hashed[order], text[order]
            once = np.append(True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])) if len(hashed) else np.zeros(0, bool)
            keys, counts = np.unique(hashed[once], return_counts=True)
            order, met, bounds = _dealt(keys, buckets)
            keys, counts = keys[order], np.minimum(counts[order], 65535).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"bucket": met, "block": np.full(len(met), row["block"]), "keys": [pack_sorted(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], "counts": [squeeze(counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    def meet(group: pa.Table) -> pa.Table:
        blocks_, keys, counts = [], [], []
        for row in group.to_pylist():
            keys.append(open_sorted(row["keys"]))
            counts.append(expand(row["counts"], np.uint16))
            blocks_.append(np.full(len(keys[-1]), row["block"]))
        block, key, n = np.concatenate(blocks_), np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, block, n = key[order], block[order], n[order]
        new = np.append(True, key[1:] != key[:-1])
        total = np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]
        key, block, total = key[total > 1], block[total > 1], total[total > 1]
        order = np.lexsort((key, block))
        key, block, total = key[order], block[order], total[order]
        met, first = np.unique(block, return_index=True)
        bounds = np.append(first, len(block))
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        release()
        return pa.table({"block": pa.array(met, pa.int64()), "keys": pa.array([pack_sorted(key[a:b]) for a, b in spans], pa.binary()), "frequent": pa.array([squeeze(total[a:b] > frequent) for a, b in spans], pa.binary())})

    counted = blocked.select("block", "texts", "starts", "ids").mapInArrow(lambda batches: released(count(batches)), "bucket long, block long, keys binary, counts binary")
    return counted.groupBy("bucket").applyInArrow(meet, "block long, keys binary, frequent binary")


_SENT = "bucket long, block long, frequent binary, bytes binary, low binary, high binary, least binary, most binary"


def bucketed_strings(blocked: DataFrame, repeated: DataFrame, length: int, buckets: int) -> DataFrame:
    """The strings of repeated anchors, once a block for equal ones, dealt to their suffix buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {x.split()[0]: [] for x in _SENT.split(", ")}
        rows = right.to_pylist()
        for row in left.to_pylist() if rows else []:
            data, starts, ids = _opened(row)
            keys = np.concatenate([open_sorted(r["keys"]) for r in rows])
            many = np.concatenate([expand(r["frequent"], bool) for r in rows])
            order = np.argsort(keys)
            key, names, grid, low, high, _, text = described(data, starts, length, keys[order], many[order])
            alone = key == names  # of a frequent anchor
            if not len(key):
                continue
            order = np.argsort(names, kind="stable")
            start = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
            least, most = np.minimum.reduceat(ids[text[order]], start), np.maximum.reduceat(ids[text[order]], start)
            one = order[start]
            dealt, met, bounds = _dealt(key[one], buckets)
            pick = one[dealt]
            columns = {"frequent": alone[pick], "bytes": grid[pick], "low": low[pick], "high": high[pick], "least": least[dealt], "most": most[dealt]}
            for bucket, a, b in zip(met.tolist(), bounds[:-1], bounds[1:], strict=True):
                out["bucket"].append(bucket)
                out["block"].append(row["block"])
                for name, x in columns.items():
                    out[name].append(squeeze(x[a:b]))
        release()
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})

    return blocked.select("block", "texts", "starts", "ids").groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(run, _SENT)


def sorted_buckets(sent: DataFrame, length: int) -> DataFrame:
    """``(block, names, low, high, least)``: for strings by the names of their rows the smallest document, over runs of columns."""
    span = length - GRAM + 1
    width = span - 1 + length

    def run(group: pa.Table) -> pa.Table:
        parts: dict[str, list] = {k: [] for k in ("block", "frequent", "bytes", "low", "high", "least", "most")}
        for row in group.to_pylist():
            for k, kind in (("frequent", bool), ("bytes", np.uint8), ("low", np.uint8), ("high", np.uint8), ("least", np.int64), ("most", np.int64)):
                parts[k].append(expand(row[k], kind))
            parts["block"].append(np.full(len(parts["low"][-1]), row["block"]))
        block, alone, low, high, least, most = (np.concatenate(parts[k]) for k in ("block", "frequent", "low", "high", "least", "most"))
        grid = np.concatenate(parts["bytes"]).reshape(-1, width)
        name = row_hashes(grid, low, high)
        anchor = np.ascontiguousarray(grid[:, span - 1 : span - 1 + GRAM])
        key = np.where(alone, name, row_hashes(anchor, low * 0, high * 0))
        order = np.lexsort((name, key))
        found = []
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        i = 0
        while i < len(order):  # whole groups of about so many rows
            j = int(np.searchsorted(edges, i + BUCKET_ROWS))
            j = int(edges[j]) if j < len(edges) else len(order)
            rows = order[i:j]
            i = j
            new = np.append(True, (name[rows][1:] != name[rows][:-1]) | (key[rows][1:] != key[rows][:-1]))
            start, own = np.flatnonzero(new), np.cumsum(new) - 1
            one = rows[start]
            group_of = np.cumsum(np.append(True, key[one][1:] != key[one][:-1]))
            document = np.minimum.reduceat(least[rows], start)
            table = least_documents(grid[one], group_of, low[one], high[one], document, length)[own]
            matters = (table >= 0) & (table < most[rows][:, None])
            begins = matters.copy()
            begins[:, 1:] &= ~(matters[:, :-1] & (table[:, 1:] == table[:, :-1]))
            ends = matters.copy()
            ends[:, :-1] &= ~(matters[:, 1:] & (table[:, 1:] == table[:, :-1]))
            r, a = np.nonzero(begins)
            b = np.nonzero(ends)[1] + 1
            found.append((block[rows][r], name[rows][r], a.astype(np.uint8), b.astype(np.uint8), table[r, a]))
        block, name, a, b, least = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(block, kind="stable")
        met, first = np.unique(block[order], return_index=True)
        spans = list(zip(first, np.append(first[1:], len(order)), strict=True))
        pack = lambda x: pa.array([squeeze(x[order[i:j]]) for i, j in spans], pa.binary())
        release()
        return pa.table({"block": pa.array(met, pa.int64()), "names": pack(name), "low": pack(a), "high": pack(b), "least": pack(least)})

    return sent.groupBy("bucket").applyInArrow(run, "block long, names binary, low binary, high binary, least binary")


def marked(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, keys: np.ndarray, frequent: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a block an earlier document holds."""
    _, own, _, _, _, position, text = described(data, starts, length, keys, frequent)
    order = np.argsort(names, kind="stable")
    names, low, high, least = names[order], low[order].astype(np.int64), high[order].astype(np.int64), least[order]
    a, b = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
    row = np.repeat(np.arange(len(own)), b - a)
    run = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(row))
    hit = least[run] < ids[text[row]]
    row, run = row[hit], run[hit]
    origin = position[row] - (length - GRAM)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, origin + low[run], 1)
    np.add.at(change, origin + high[run] - 1 + length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the bytes covered by ``length``-byte strings that a document of smaller doc_id holds.

    Adds kept (what is left, as bytes), n_bytes, n_removed and n_spans (runs removed); ``text`` is what is left as
    text, without characters that lost a byte. Columns of these names are replaced.
    """
    if not GRAM < length <= 128 + GRAM:
        raise ValueError("the length must be over that of an anchor and leave its columns in a byte")
    added = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    docs = docs.drop(*added)
    others = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    blocked = blocks(docs, text)
    total = blocked.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), int(total // BUCKET_BYTES))
    repeated = written(repeated_anchors(blocked, length, buckets, frequent), "anchors")
    sent = bucketed_strings(blocked, repeated, length, buckets)
    # rows of both kinds of answer, by block
    answers = sorted_buckets(sent, length).select("block", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("frequent"), "names", "low", "high", "least")
    told = answers.unionByName(repeated, allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        keys = np.concatenate([open_sorted(r["keys"]) for r in rows if r["keys"] is not None] or [np.zeros(0, np.uint64)])
        many = np.concatenate([expand(r["frequent"], bool) for r in rows if r["keys"] is not None] or [np.zeros(0, bool)])
        order = np.argsort(keys)
        runs = [[expand(r[c], kind) for r in rows if r["names"] is not None] for c, kind in (("names", np.uint64), ("low", np.uint8), ("high", np.uint8), ("least", np.int64))]
        out = []
        for row in left.to_pylist():
            data, starts, ids = _opened(row)
            gone = np.zeros(len(data), bool)
            if runs[0]:
                gone = marked(data, starts, ids, *(np.concatenate(x) for x in runs), keys[order], many[order], length)
            kept, sums = [], np.zeros((3, len(ids)), np.int64)
            for i in range(len(ids)):
                cut = gone[starts[i] : starts[i + 1]]
                kept.append(data[starts[i] : starts[i + 1]][~cut].tobytes())
                sums[:, i] = len(cut), cut.sum(), (cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all()
            for name, x in (("text", pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())), ("kept", pa.array(kept, pa.binary())), *zip(("n_bytes", "n_removed", "n_spans"), map(pa.array, sums), strict=True)):
                rest = rest.append_column(name, x)
            out.append(rest)
        release()
        return pa.concat_tables(out)

    result = blocked.drop("size").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"{kinds}, text string, " + ", ".join(f"{k} {v}" for k, v in added.items()))
    return result.select(*(F.col("text").alias(text) if c == text else F.col(f"c{others.index(c)}").alias(c) for c in docs.columns), *added)
