"""Byte-level BPE: text to ids and back.

Each piece of text (a match of the split pattern) is merged over a segment tree. Its leaves are byte positions;
a leaf holds the rank of the pair that starts there, and every inner node the least (rank, position) below it, so
the root names the leftmost pair of least rank. A merge changes three leaves (the pair, the byte range it swallows
and the live neighbour to the left) and their paths to the root: O(log n) each. Trees of equal width are worked on
together as arrays, and merged pieces are remembered in a bounded table.

Null text is empty; an empty text has no ids. Any other text decodes to exactly its UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import HashTable, mixed, span_hashes, text_blocks

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pieces longer than this are merged afresh each time.
KEPT_POINTS = 48
#: Entries of the table of merged pieces, after which it is emptied.
KEPT_PIECES = 600_000
#: Pieces of more bytes than this merge at many places in a step.
LONG = 256
#: Letters that are encoded, and cells of trees that are merged, at a time.
LETTERS, CELLS = 1 << 18, 1 << 17
_NONE = np.int64(1) << np.int64(60)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, as the split pattern sees it."""
    import regex

    points = np.append(np.arange(0xD800), np.arange(0xE000, 0x110000)).astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            a, b = m.span()
            shift = np.arange(a, b)
            out[np.where(shift >= 0xD800, shift + 0x800, shift)] = kind
    return out


@lru_cache(1)
def point_values() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_points(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which the pieces of the texts begin, then the end.

    The same pieces as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`` finds in
    each text alone.
    """
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # of a text
    first[starts] = True
    run = np.empty(n, bool)  # of equal classes
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    cut = run.copy()
    space = points == 32
    # a space before letters, numbers or others belongs to them
    joins = np.zeros(n, bool)
    joins[1:] = run[1:] & (kind[1:] != SPACE) & ~first[1:n] & space[:-1]
    at = np.flatnonzero(joins)
    cut[at] = False
    cut[at - 1] = True
    # the last of several blanks before something else stands alone, or went with it
    alone = np.zeros(n, bool)
    alone[1:] = run[1:] & (kind[1:] != SPACE) & ~first[1:n] & (kind[:-1] == SPACE)
    cut[np.flatnonzero(alone) - 1] = True
    # contractions
    quote = np.flatnonzero((points[:-1] == 39) & run[:-1] & ~joins[:-1] & run[1:] & (kind[1:] == LETTER) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        end_of = np.searchsorted(starts, quote, side="right")
        room = starts[end_of] - quote
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (room >= 3) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        held = quote[one | two]
        long = np.where(one[one | two], 2, 3)
        cut[held + 1] = False
        after = held + long
        after = after[after < n]
        cut[after] = True
    return np.append(np.flatnonzero(cut), n)


class Vocabulary:
    """Ids, their bytes, and the rank and result of each pair of ids that merges."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray, words: list[bytes], whole: dict[bytes, int] | None):
        self.byte_ids, self.whole, self.ranks, self.merged = byte_ids, whole, ranks.astype(np.int64), merged.astype(np.int64)
        self.table = HashTable(max(10, int(len(pairs)).bit_length() + 1))
        self.table.add(pairs, np.arange(len(pairs), dtype=np.int32))
        # ids that no pair of a lower rank takes up: once one is made, all others of its rank come before what it makes possible
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        least = np.full(len(words), _NONE, np.int64)
        np.minimum.at(least, left, self.ranks)
        np.minimum.at(least, right, self.ranks)
        self.settled = np.zeros(int(self.ranks.max(initial=0)) + 1, bool)
        self.settled[self.ranks] = True
        self.settled[self.ranks[least[self.merged] <= self.ranks]] = False
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.append(0, np.cumsum(self.lengths))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of base64 tokens and ranks; a piece that is itself a token is taken whole."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        keys, merged = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        merged = np.array(merged, np.int64)
        return cls(np.array([ranks[bytes([i])] for i in range(256)], np.int64), np.array(keys, np.uint64), merged, merged, words, ranks)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A file of the tokenizers library: a vocabulary and merges in order of rank."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        words = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            words[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        keys, merged = [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] << 32 | vocab[b])
            merged.append(vocab[a + b])
        return cls(np.array([vocab[letters[i]] for i in range(256)], np.int64), np.array(keys, np.uint64), np.arange(len(keys)), np.array(merged, np.int64), words, None)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; the rank of a pair that doesn't merge is ``_NONE``."""
        at = self.table.find((left << 32 | right).astype(np.uint64))
        known = at >= 0
        return np.where(known, self.ranks[at], _NONE), np.where(known, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.offsets[ids] - (ends - size), size)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


def merge_trees(vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges each row of ``ids`` (rows of a power of two, of which ``sizes`` count); the ids left, row by row, and how many each row has."""
    m, w = ids.shape
    shift = np.int64(w.bit_length())
    low = (np.int64(1) << shift) - 1
    ids = ids.astype(np.int64).ravel()
    column = np.tile(np.arange(w), m)
    following, before = column + 1, column - 1
    ends = sizes.astype(np.int64)
    leaf = np.full(m * w, _NONE, np.int64)
    result = np.full(m * w, -1, np.int64)
    live = np.flatnonzero(column < np.repeat(ends, w) - 1)
    rank, to = vocabulary.pair(ids[live], ids[live + 1])
    leaf[live], result[live] = np.where(rank == _NONE, _NONE, rank << shift | column[live]), to
    levels = [leaf]
    while len(levels[-1]) > m:
        levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
    alive = column < np.repeat(ends, w)

    def update(at: np.ndarray) -> None:
        for below, level in zip(levels, levels[1:], strict=False):
            at = at >> 1
            level[at] = np.minimum(below[2 * at], below[2 * at + 1])

    def pair_at(at: np.ndarray, right: np.ndarray) -> None:
        rank, to = vocabulary.pair(ids[at], ids[right])
        leaf[at], result[at] = np.where(rank == _NONE, _NONE, rank << shift | column[at]), to

    def all_least(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The first place of least rank of each row, and where the rank is settled all others, but those whose left id the one before takes."""
        rank = levels[-1][rows] >> shift
        settled = vocabulary.settled[rank]
        nodes, rank = rows[settled], rank[settled]
        for level in levels[-2::-1]:
            nodes, rank = np.repeat(nodes * 2, 2), np.repeat(rank, 2)
            nodes[1::2] += 1
            own = level[nodes] >> shift == rank
            nodes, rank = nodes[own], rank[own]
        joined = np.append(False, nodes[:-1] // w * w + following[nodes[:-1]] == nodes[1:])
        nth = np.arange(len(nodes))
        since = nth - np.maximum.accumulate(np.where(joined, 0, nth))  # of a chain of places, each other one
        return np.sort(np.append(first[~settled], nodes[since % 2 == 0]))

    rows = np.flatnonzero(levels[-1] < _NONE)
    while len(rows):
        at = rows * w + (levels[-1][rows] & low)
        if w > LONG and vocabulary.settled[levels[-1][rows] >> shift].any():
            at = all_least(rows, at)
        base = at // w * w
        gone = base + following[at]
        ids[at] = result[at]
        alive[gone] = False
        leaf[gone] = _NONE
        after = following[gone]
        following[at] = after
        more = after < ends[at // w]
        before[(base + after)[more]] = column[at[more]]
        leaf[at[~more]] = _NONE
        pair_at(at[more], (base + after)[more])
        left = before[at] >= 0
        prior = (base + before[at])[left]
        pair_at(prior, at[left])
        update(gone)
        update(at)
        update(prior)
        rows = rows[levels[-1][rows] < _NONE]
    return ids[alive], alive.reshape(m, w).sum(1)


class Encoder:
    """Texts to ids, with a bounded memory of merged pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known = HashTable((KEPT_PIECES * 2).bit_length())
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(KEPT_PIECES + 1, np.int64)
        self.count = np.zeros(KEPT_PIECES + 1, np.int64)

    def _merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte spans, concatenated, and their counts."""
        vocabulary, n = self.vocabulary, len(starts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = np.ones(n, bool)
        if vocabulary.whole is not None:
            buffer, get = raw.tobytes(), vocabulary.whole.get
            ids = np.fromiter((get(buffer[a:b], -1) for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)), np.int64, n)
            left = ids < 0
            found.append((np.flatnonzero(~left), ids[~left], np.ones(int((~left).sum()), np.int64)))
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for w in np.unique(width[left]).tolist():
            own = np.flatnonzero(left & (width == w))
            step = max(1, CELLS // w)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                grid = starts[part][:, None] + np.arange(w)
                inside = np.arange(w) < sizes[part][:, None]
                ids = vocabulary.byte_ids[raw[np.where(inside, grid, 0)]]
                out, counts = merge_trees(vocabulary, ids, sizes[part])
                found.append((part, out, counts))
        counts = np.zeros(n, np.int64)
        for part, _, c in found:
            counts[part] = c
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for part, ids, c in found:
            out[_spread(begin[part], c)] = ids
        return out, counts

    def _keep(self, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        first = self.known.size
        if self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.int32))
        self.flat[self.used : self.used + len(ids)] = ids
        own = slice(first, first + len(counts))
        self.start[own] = self.used + np.cumsum(counts) - counts
        self.count[own] = counts
        self.used += len(ids)
        self.known.add(hashes, np.arange(first, first + len(counts), dtype=np.int32))

    def encode(self, points: np.ndarray, starts: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, concatenated, and the offset of each text's first id, then the end."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        cuts = split_points(points, starts)
        a, b = cuts[:-1], cuts[1:]
        raw = np.frombuffer(joined.encode(), np.uint8)
        where = None  # byte offsets of code points
        if len(raw) != n:
            where = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=where[1:])
        hashes = span_hashes(point_values()[points], a, b)
        at = self.known.find(hashes)
        at[b - a > KEPT_POINTS] = -1
        fresh = np.flatnonzero(at < 0)
        extra = np.zeros(0, np.int32)
        extra_start = extra_count = np.zeros(0, np.int64)
        if len(fresh):
            long = b[fresh] - a[fresh] > KEPT_POINTS
            _, one = np.unique(hashes[fresh[~long]], return_index=True)
            one = fresh[~long][one]
            if self.known.size + len(one) > KEPT_PIECES:
                self.clear()
                at[:] = -1
                fresh = np.arange(len(a))
                long = b - a > KEPT_POINTS
                _, one = np.unique(hashes[~long], return_index=True)
                one = fresh[~long][one]
            todo = np.concatenate([one, fresh[long]])
            lo, hi = (a[todo], b[todo]) if where is None else (where[a[todo]], where[b[todo]])
            ids, counts = self._merge(raw, lo, hi - lo)
            if len(one) > KEPT_PIECES:  # more pieces than the table holds, in one very long text
                order = np.argsort(hashes[one])
                place = order[np.searchsorted(hashes[one], hashes, sorter=order).clip(0, len(one) - 1)]
                place[fresh[long]] = len(one) + np.arange(int(long.sum()))
                begin = np.cumsum(counts) - counts
                return self._gather(ids, begin[place], counts[place], a, starts)
            cut = int(counts[: len(one)].sum())
            self._keep(ids[:cut], counts[: len(one)], hashes[one])
            extra, extra_count = ids[cut:], counts[len(one) :]
            extra_start = np.cumsum(extra_count) - extra_count
            at = self.known.find(hashes)
            longs = fresh[long]
            begin, size = self.start[at], self.count[at]
            begin[longs], size[longs] = self.used + extra_start, extra_count
            flat = np.append(self.flat[: self.used], extra) if len(extra) else self.flat
            return self._gather(flat, begin, size, a, starts)
        return self._gather(self.flat, self.start[at], self.count[at], a, starts)

    @staticmethod
    def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.append(0, np.cumsum(size))
        return flat[_spread(begin, size)], total[np.searchsorted(a, starts)]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a file and process."""
    return Encoder(Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path))


def encoded(texts: list[str | None], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """``(position, ids)`` of each text."""
    own = encoder(path)
    for first, end, points, starts, joined in text_blocks(texts, LETTERS):
        ids, at = own.encode(points, starts, joined)
        for i in range(first, end):
            yield i, ids[at[i - first] : at[i - first + 1]]


def encode_documents(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` of each row, in the rows' own partitions. Null text has no ids, as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x for _, x in encoded(batch.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(key, bytes)`` of each row's ids; null ids give no bytes. An id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            out = [vocabulary.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["k", "bytes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"k {kind}, bytes binary").withColumnRenamed("k", key)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text of ``documents``; per row the number of ids and digests of ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha: Callable[[bytes], str] = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            vocabulary = encoder(path).vocabulary
            for _, ids in encoded(batch.column(1).to_pylist(), path):
                n.append(len(ids))
                a.append(sha(ids.astype("<u4").tobytes()))
                b.append(sha(vocabulary.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
