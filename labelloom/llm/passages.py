"""Near-duplicate passages by compact windows.

A passage is ``MIN_WORDS`` words or more; its tokens are its five-word shingles. Under each of ``HASHES`` hash functions
the node of the Cartesian tree over a text's token hashes whose subtree spans at least a passage is a compact window:
all subsequences within it that hold the node's token have that token's hash as their signature. There are about two
such windows a passage length and function, so they stand for all subsequences. Windows of different texts with one
signature are joined on it, each text with the first of all blocks and the first of its own, and then, of the texts that
verified pairs don't connect, each with each; pairs of texts in which the windows of at least ``AGREEING`` functions meet
are candidates. Of the latter only texts count whose tokens that other components hold too lie dense enough for a
passage: a text that shares but a shorter line or two is left out before it is paired, and no passage can be lost by
that. Their stretches of common tokens (four of five or more) in the one text are held against those in the
other, and all stand as passages whose exact Jaccard similarity is ``percent`` / 100 or more; one that falls short is
cut at its widest gap and its parts are tried again.

Texts that are equal are one, which the smallest doc_id stands for. Null and short texts have no passages; words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Rows without doc_id are linked
with nothing. Pairs of texts that others connect already are tried only where one is the first of the signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mixed, partitions, shuffles_released, span_hashes, written
from .components import components
from .substrings import BUCKET_BYTES, _dealt, _opened, blocks, expand, open_sorted, pack_sorted, repeated_keys, squeeze

WORDS, MIN_WORDS, HASHES, AGREEING = 5, 50, 6, 3
#: Signatures of up to so many texts pair these in SQL; longer lists go block by block.
SHORT_LIST = 64
BLOCK = 4096
#: Bytes and tokens of whole texts that are worked on at a time: their arrays stay in a processor's cache.
PART_BYTES, PART_TOKENS = 1 << 17, 1 << 16
#: Bits of a token's hash that are left out where tokens are looked for in other texts: a false match only keeps a text.
_CUT = np.uint64(20)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SEEDS = mixed(np.arange(1, 65, dtype=np.uint64))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    return np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1])), np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1


def tokens(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, and the offset of each text's first, then the end; some whole texts at a time."""
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    out, counts, i = [], [], 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART_BYTES, side="right")) - 1)
        part, own = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        begin, end = word_bounds(part, own)
        low = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        word = span_hashes(_BYTES[low], begin, end)
        n = max(0, len(word) - words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += word[k : k + n] * factors[k]
        at = np.searchsorted(begin, own)
        inside = np.zeros(n, bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            inside[a : max(a, b - words + 1)] = True
            counts.append(max(0, b - a - words + 1))
        out.append(mixed(total[inside]))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(counts)).astype(np.int64)


def roots(hashed: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Positions of the Cartesian tree nodes that span ``least`` tokens or more of their text: the leftmost minima of so many neighbours."""
    if len(hashed) < least:
        return np.zeros(0, np.int64)
    bits = np.uint64(int(len(hashed)).bit_length())
    cells = hashed >> bits
    cells <<= bits
    cells |= np.arange(len(hashed), dtype=np.uint64)
    width = 1
    while 2 * width <= least:
        cells = np.minimum(cells[:-width], cells[width:])
        width *= 2
    if width < least:
        cells = np.minimum(cells[: -(least - width)], cells[least - width :])
    change = np.zeros(len(cells) + 1, np.int8)
    size = np.diff(at)
    long = size >= least
    np.add.at(change, at[:-1][long], 1)
    np.add.at(change, at[1:][long] - least + 1, -1)
    cells = cells[np.cumsum(change[:-1], dtype=np.int8) > 0]
    # from window to window the leftmost minimum never goes back, so equal ones are neighbours
    new = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
    return (cells[new] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def extents(hashed: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each node's subtree: up to a smaller hash on either side (on the left also an equal one) or the text's edge."""
    text = np.searchsorted(at, node, side="right") - 1
    low, high, value = at[text], at[text + 1], hashed[node]
    levels = [hashed]
    while 2 << (len(levels) - 1) <= int(np.diff(at).max(initial=1)):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    left, right = node.copy(), node + 1
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        go = (left - step >= low) & (level[np.clip(left - step, 0, len(level) - 1)] > value)
        left[go] -= step
        go = (right + step <= high) & (level[np.clip(right, 0, len(level) - 1)] >= value)
        right[go] += step
    return left, right - 1


def compact_windows(hashes: np.ndarray, at: np.ndarray, function: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each window under a function, and its node's position."""
    keys, nodes, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART_TOKENS, side="right")) - 1)
        own = mixed(hashes[at[i] : at[j]] ^ _SEEDS[function])
        node = roots(own, at[i : j + 1] - at[i], least)
        keys.append(mixed(own[node] ^ _SEEDS[-1 - function]))
        nodes.append(node + at[i])
        i = j
    return np.concatenate(keys), np.concatenate(nodes)


def stretches(common: np.ndarray, least: int) -> list[tuple[int, int]]:
    """All maximal stretches of most common tokens (+1 common, -4 not) that have ``least`` tokens or more, by the method of Ruzzo and Tompa."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], common.view(np.int8), [0]])))
    begins, ends = edge[::2].tolist(), edge[1::2].tolist()
    out, open_ = [], []  # open: begin, end, total before, total after
    total = last = lowest = 0
    for begin, end in zip(begins, ends, strict=True):
        total -= 4 * (begin - last)
        last = end
        if total <= lowest:  # none of those before can be joined any more
            lowest = total
            out += open_
            open_ = []
        now = (begin, end, total, total + end - begin)
        total = now[3]
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][2] >= now[2]:
                k -= 1
            if k < 0 or open_[k][3] >= now[3]:
                open_.append(now)
                break
            now = (open_[k][0], now[1], open_[k][2], now[3])
            del open_[k:]
    return [(x[0], x[1]) for x in out + open_ if x[1] - x[0] >= least]


def _widest_gap(common: np.ndarray) -> tuple[int, int, int]:
    """Length, begin and end of the longest stretch without a common token, of equal ones that nearest the middle; length 0 if there is none."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~common).view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return 0, 0, 0
    k = np.lexsort((np.abs(begin + end - len(common)), begin - end))[0]
    return int(end[k] - begin[k]), int(begin[k]), int(end[k])


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in ``b``: of short arrays sooner told than by ``np.isin``."""
    if not len(b):
        return np.zeros(len(a), bool)
    b = np.sort(b)
    return b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a


def shared_passages(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Stretches of ``a`` and of ``b`` that stand as passages, with their similarity.

    A stretch of the one is held against all stretches of the other with its tokens until the two fit. Two that fit but
    are unlike are cut at the widest gap, and both parts tried again.
    """
    short = least * percent // 100
    out, left = [], [(0, len(a), 0, len(b), False)]
    while left:
        lo, hi, x, y, fit = left.pop()
        one, two = a[lo:hi], b[x:y]
        if not fit:
            for i, j in stretches(within(one, two), short):
                for k, m in stretches(within(two, one[i:j]), short):
                    same = (i, j, k, m) == (0, hi - lo, 0, y - x)
                    left.append((lo + i, lo + j, x + k, x + m, same))
            continue
        if max(hi - lo, y - x) < least:
            continue
        first, second = np.unique(one), np.unique(two)
        both = len(np.intersect1d(first, second, assume_unique=True))
        union = len(first) + len(second) - both
        if 100 * both >= percent * union:
            out.append((lo, hi, x, y, both / union))
            continue
        (n, i, j), (m, k, h) = _widest_gap(within(one, two)), _widest_gap(within(two, one))
        left += [(lo, lo + i, x, y, False), (lo + j, hi, x, y, False)] if n >= m else [(lo, hi, x, x + k, False), (lo, hi, x + h, y, False)]
    return sorted(set(out))


def _kept(df: DataFrame, name: str) -> DataFrame:
    with shuffles_released(df.sparkSession):
        return written(df, name)


def near_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, functions: int = HASHES, agreeing: int = AGREEING) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text) with a doc_id: doc_id, n_passages, component_id, and passages.

    passages: begin and end in words, the other document with its begin and end, and the similarity, for the earlier
    documents a text was tried with, several where they share several; component_id is the smallest doc_id reached over such links (and equal texts).
    """
    least = min_words - WORDS + 1
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = rows.select("doc_id", F.xxhash64("text").alias("a"), F.crc32(F.encode("text", "UTF-8")).alias("b"), F.octet_length("text").alias("n"))
    texts = _kept(named.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")), "texts")
    members = _kept(named.join(texts, ["a", "b", "n"]).select("doc_id", "rep", "n"), "members")
    only = rows.join(members.filter("doc_id = rep AND n > 0").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    with shuffles_released(docs.sparkSession):
        blocked = blocks(only, "text")
    total = blocked.agg(F.sum("size")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), int(total // BUCKET_BYTES))

    def keys_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = tokens(data, starts)
        found = [compact_windows(hashes, at, f, least) for f in range(functions)]
        node = np.concatenate([x[1] for x in found])
        return np.concatenate([x[0] for x in found]), np.searchsorted(at, node, side="right") - 1

    repeated = _kept(repeated_keys(blocked, keys_of, buckets, 1 << 60), "signatures")

    def window_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each text's repeated signatures, once each, with the first text of the block that has them."""
        out = []
        got = right.to_pylist()
        known = np.sort(np.concatenate([open_sorted(r["keys"]) for r in got])) if got else np.zeros(0, np.uint64)
        for row in left.to_pylist() if len(known) else []:
            data, starts, ids = _opened(row)
            hashes, at = tokens(data, starts)
            for f in range(functions):
                key, node = compact_windows(hashes, at, f, least)
                mine = known[np.searchsorted(known, key).clip(0, len(known) - 1)] == key
                key, doc = key[mine], ids[np.searchsorted(at, node[mine], side="right") - 1]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                one = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
                key, doc = key[one], doc[one]
                new = np.append(True, key[1:] != key[:-1]) if len(key) else one
                first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
                out.append(pa.table({"key": key.view(np.int64), "f": np.full(len(key), f, np.int32), "doc": doc, "near": doc[first]}))
        return pa.concat_tables(out) if out else pa.schema(_WINDOW).empty_table()

    windows = _kept(blocked.select("block", "texts", "starts", "ids").groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(window_rows, "key long, f int, doc long, near long"), "windows")
    first = _kept(windows.groupBy("key").agg(F.min("doc").alias("near"), F.count("*").alias("n")).filter("n > 1"), "first")
    local = windows.filter("near <> doc").select("f", "doc", "near")
    wide = windows.select("key", "f", "doc").join(first.select("key", "near"), "key").filter("near < doc").select(local.columns)
    pairs = local.unionByName(wide).distinct().groupBy("doc", "near").agg(F.count_distinct("f").alias("functions"))
    pairs = _kept(pairs.filter(F.col("functions") >= agreeing).drop("functions"), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer((t or "").encode(), np.uint8) for t in batch.column(c).to_pylist()] for c in (2, 3))
            sizes = np.cumsum([0, *(len(x) for x in one + two)])
            hashes, at = tokens(np.concatenate([*one, *two]) if sizes[-1] else np.zeros(0, np.uint8), sizes)
            n, out, row = batch.num_rows, [], []
            for i in range(n):
                got = shared_passages(hashes[at[i] : at[i + 1]], hashes[at[n + i] : at[n + i + 1]], least, percent)
                out += [(begin, end + WORDS - 1, x, y + WORDS - 1, similarity) for begin, end, x, y, similarity in got]
                row += [i] * len(got)
            columns = list(zip(*out, strict=True)) or [()] * 5
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.float64())], ["doc", "near", "begin", "end", "near_begin", "near_end", "similarity"])

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The passages that the texts (doc_id, text) of the pairs (doc, near) share."""
        wanted = pairs.select(F.col("doc").alias("doc_id")).unionByName(pairs.select(F.col("near").alias("doc_id"))).distinct()
        held = _kept(texts.join(wanted, "doc_id"), "held")
        joined = pairs.join(held.select(F.col("doc_id").alias("doc"), F.col("text").alias("x")), "doc").join(held.select(F.col("doc_id").alias("near"), F.col("text").alias("y")), "near")
        return joined.select("doc", "near", "x", "y").mapInArrow(verify, _LINK_SQL)

    edges = lambda links: links.select(F.col("doc").alias("u"), F.col("near").alias("v"))
    links = _kept(verified(pairs, only), "links")
    rooted = _rooted(windows, first, components(edges(links)))
    able = _kept(_able(blocked, rooted, buckets, least, percent), "able")
    more, met = _apart(rooted.join(able.select("doc", "strong"), "doc"), able.select("doc", "spans", "tokens"), agreeing, least, percent)
    more = _kept(more.join(pairs, ["doc", "near"], "left_anti"), "pairs")
    links = links.unionByName(verified(more, able.select(F.col("doc").alias("doc_id"), "text"))).unionByName(met.join(pairs.unionByName(more), ["doc", "near"], "left_anti"))
    links = _kept(links, "links")
    root = components(edges(links)).select(F.col("node").alias("rep"), "root")
    listed = links.groupBy(F.col("doc").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("begin", "end", F.col("near").alias("other"), "near_begin", "near_end", "similarity"))).alias("passages"))
    kind = listed.schema["passages"].dataType
    found = members.join(root, "rep", "left").join(listed, "rep", "left").select("doc_id", "rep", "root", "passages")
    unnamed = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("rep"), F.col("doc_id").alias("root"), F.lit(None).cast(kind).alias("passages"))
    passages = F.coalesce("passages", F.array().cast(kind))
    return found.unionByName(unnamed).select("doc_id", F.size(passages).alias("n_passages"), F.coalesce("root", "rep").alias("component_id"), passages.alias("passages"))


def _rooted(windows: DataFrame, first: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, f, doc, root) of the signatures that texts of different components have."""
    rooted = windows.select("key", "f", "doc").join(first.select("key"), "key").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    unlike = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return _kept(rooted.join(unlike, "key"), "rooted")


def _able(blocked: DataFrame, rooted: DataFrame, buckets: int, least: int, percent: int) -> DataFrame:
    """(doc, strong, spans, tokens, text) of the texts that can share a passage with one of another component.

    The tokens that two texts share are all among those that texts of several components hold. So a stretch of common
    tokens lies in a stretch of such tokens, and one of the two texts has one of ``least`` tokens: it is ``strong``. spans
    are begins and ends of the stretches, tokens what they hold.
    """
    short = least * percent // 100

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids = expand(row["ids"], np.int64)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(ids), row["block"]), "doc": ids})

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each token of the asked texts of a block, dealt by its hash, with a component that holds it; ``several`` do."""
        out: dict[str, list] = {"bucket": [], "block": [], "keys": [], "roots": [], "several": []}
        asked = right.sort_by("doc")
        docs, roots = asked.column("doc").to_numpy(), asked.column("root").to_numpy()
        for row in left.to_pylist() if len(docs) else []:
            data, starts, ids = _opened(row)
            hashes, at = tokens(data, starts)
            spot = np.searchsorted(docs, ids).clip(0, len(docs) - 1)
            mine = np.repeat(docs[spot] == ids, np.diff(at))
            key, root = hashes[mine] >> _CUT, np.repeat(roots[spot], np.diff(at))[mine]
            if not len(key):
                continue
            order = np.argsort(key)
            key, root = key[order], root[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, low, high = key[new], np.minimum.reduceat(root, new), np.maximum.reduceat(root, new)
            order, met, bounds = _dealt(key, buckets)
            key, low, several = key[order], low[order], (low != high)[order]
            for bucket, a, b in zip(met.tolist(), bounds[:-1], bounds[1:], strict=True):
                for name, value in zip(out, (bucket, row["block"], pack_sorted(key[a:b]), _planes(low[a:b]), squeeze(several[a:b])), strict=True):
                    out[name].append(value)
        return pa.table(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("roots", pa.binary()), ("several", pa.binary())]))

    def meet(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        key = [open_sorted(r["keys"]) for r in rows]
        block = np.repeat([r["block"] for r in rows], [len(k) for k in key])
        key, root, several = np.concatenate(key), np.concatenate([_unplaned(r["roots"]) for r in rows]), np.concatenate([expand(r["several"], bool) for r in rows])
        order = np.argsort(key)
        key, root, several, block = key[order], root[order], several[order], block[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = (np.minimum.reduceat(root, new) < np.maximum.reduceat(root, new)) | np.logical_or.reduceat(several, new)
        shared = np.repeat(shared, np.diff(np.append(new, len(key))))
        key, block = key[shared], block[shared]
        order = np.lexsort((key, block))
        key, block = key[order], block[order]
        met, begin = np.unique(block, return_index=True)
        ends = np.append(begin[1:], len(key))
        return pa.table({"block": pa.array(met, pa.int64()), "keys": pa.array([pack_sorted(key[a:b]) for a, b in zip(begin, ends, strict=True)], pa.binary())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        got = right.to_pylist()
        known = np.sort(np.concatenate([open_sorted(r["keys"]) for r in got])) if got else np.zeros(0, np.uint64)
        for row in left.to_pylist() if len(known) else []:
            data, starts, ids = _opened(row)
            hashes, at = tokens(data, starts)
            key = hashes >> _CUT
            common = known[np.searchsorted(known, key).clip(0, len(known) - 1)] == key
            for i in np.flatnonzero(np.add.reduceat(np.append(common, False), at[:-1]) * (np.diff(at) > 0) >= short).tolist():
                found = sorted(stretches(common[at[i] : at[i + 1]], short))
                if found:
                    held = np.concatenate([hashes[at[i] + a : at[i] + b] for a, b in found])
                    out.append((int(ids[i]), max(b - a for a, b in found) >= least, [x for span in found for x in span], held.tobytes(), data[starts[i] : starts[i + 1]].tobytes().decode()))
        doc, strong, spans, held, text = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({"doc": pa.array(doc, pa.int64()), "strong": pa.array(strong, pa.bool_()), "spans": pa.array(spans, pa.list_(pa.int32())), "tokens": pa.array(held, pa.binary()), "text": pa.array(text, pa.string())})

    asked = rooted.select("doc", "root").distinct()
    placed = blocked.select("block", "ids").mapInArrow(place, "block long, doc long").join(asked, "doc")
    texts = blocked.select("block", "texts", "starts", "ids").groupBy("block")
    counted = texts.cogroup(placed.groupBy("block")).applyInArrow(count, "bucket long, block long, keys binary, roots binary, several binary")
    shared = _kept(counted.groupBy("bucket").applyInArrow(meet, "block long, keys binary"), "shared")
    able = texts.cogroup(shared.groupBy("block")).applyInArrow(run, "doc long, strong boolean, spans array<int>, tokens binary, text string")
    return able.join(asked.select("doc"), "doc", "left_semi")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, their bytes by significance."""
    return squeeze(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(expand(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def laid_out(spans: list[int], held: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a text's stretches with their positions; gaps are of tokens that no other text has, long enough never to be bridged."""
    values, places, done = [], [], 0
    for k, (begin, end) in enumerate(zip(spans[::2], spans[1::2], strict=True)):
        if k:
            gap = min(begin - spans[2 * k - 1], len(held) // 4 + 1)
            values.append((name << 32) + done + np.arange(gap))
            places.append(spans[2 * k - 1] + np.arange(gap))
        values.append(held[done : done + end - begin].view(np.int64))
        places.append(np.arange(begin, end))
        done += end - begin
    return np.concatenate(values).view(np.uint64), np.concatenate(places)


def _apart(rooted: DataFrame, stretched: DataFrame, agreeing: int, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components, one of them strong, in which the signatures of ``agreeing`` functions or more meet.

    First the pairs (doc, near) with a signature of at most ``SHORT_LIST`` texts, met in SQL. Those that have but longer
    ones are met in the rarest that they share, block by block, only of texts with longer lists of enough other functions;
    their stretches (doc, spans, tokens) are held against each other there, and their passages are the second table.
    """
    unlike = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("strong").alias("any"), F.count("*").alias("n")).filter("low < high AND any").select("key", "n")
    rooted = _kept(rooted.join(unlike, "key"), "rooted")
    short, long = rooted.filter(F.col("n") <= SHORT_LIST), rooted.filter(F.col("n") > SHORT_LIST)
    held = _kept(long.groupBy("doc").agg(F.collect_list(F.struct("f", "n", "key")).alias("listed")), "listed")

    x, y = short.alias("x"), short.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") > F.col("y.doc")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.strong") | F.col("y.strong")))
    met = met.groupBy(F.col("x.doc").alias("doc"), F.col("y.doc").alias("near")).agg(F.collect_set("x.f").alias("fs"))
    met = met.join(held.withColumnRenamed("listed", "a"), "doc", "left").join(held.select(F.col("doc").alias("near"), F.col("listed").alias("b")), "near", "left")
    both = F.coalesce(F.transform(F.array_intersect("a", "b"), lambda v: v["f"]), F.array().cast("array<int>"))
    met = met.filter(F.size(F.array_union("fs", both)) >= agreeing).select("doc", "near")

    longer = F.filter("listed", lambda v: (v["f"] != F.col("f")) & (F.struct(v["n"], v["key"]) > F.struct("n", "key")))
    dealt = long.join(held, "doc").filter(F.size(F.array_distinct(F.transform(longer, lambda v: v["f"]))) >= agreeing - 1)
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "size")
    blocks_ = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = dealt.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc"), blocks_).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "root", "strong", F.transform("listed", lambda v: v["f"]).alias("fs"), F.transform("listed", lambda v: v["key"]).alias("keys"), F.transform("listed", lambda v: v["n"]).alias("ns")).join(stretched, "doc")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        here, i, j = (x.as_py() for x in key)
        ids, roots, block, strong = (group.column(c).to_numpy() for c in ("doc", "root", "block", "strong"))
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        spots: dict[int, dict[int, list[int]]] = {}
        sizes: dict[int, int] = {}
        for r, (fs, keys, ns) in enumerate(zip(*(group.column(c).to_pylist() for c in ("fs", "keys", "ns")), strict=True)):
            sizes.update(zip(keys, ns, strict=True))
            for f, k in zip(fs, keys, strict=True):
                spots.setdefault(f, {}).setdefault(k, []).append(r)
        place = np.empty(len(ids), np.int64)
        place[columns] = np.arange(len(columns))
        row_place = np.empty(len(ids), np.int64)
        row_place[rows] = np.arange(len(rows))
        functions = np.zeros((len(rows), len(columns)), np.uint8)
        # pairs of a component, without a strong text, twice in the block, or met in a rarer signature
        elsewhere = (roots[rows][:, None] == roots[columns]) | ~(strong[rows][:, None] | strong[columns])
        if i == j:
            elsewhere |= ids[rows][:, None] < ids[columns]
        for own in spots.values():
            meet = np.zeros(functions.shape, bool)
            for k, there in ((k, np.array(x)) for k, x in own.items() if len(x) > 1):
                where = np.ix_(row_place[there[block[there] == i]], place[there[block[there] == j]])
                meet[where] = True
                if (sizes[k], k) < (sizes[here], here):
                    elsewhere[where] = True
            functions += meet
        a, b = np.nonzero((functions >= agreeing) & ~elsewhere)
        a, b = rows[a], columns[b]
        swap = ids[a] < ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        spans, tokens_, out = group.column("spans"), group.column("tokens"), []
        opened: dict[int, tuple[np.ndarray, int, np.ndarray, np.ndarray]] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            for z in (x, y):
                if z not in opened:
                    held = np.frombuffer(tokens_[z].as_py(), np.uint64)
                    own = np.unique(held)
                    # a passage has so many different tokens at least
                    opened[z] = own, max(1, least - len(held) + len(own)), *laid_out(spans[z].as_py(), held, z)
            (first, n, one, p), (second, m, two, q) = opened[x], opened[y]
            both = np.concatenate([first, second])
            both.sort()
            if 100 * np.count_nonzero(both[1:] == both[:-1]) < percent * min(n, m):
                continue
            for lo, hi, begin, end, similarity in shared_passages(one, two, least, percent):
                out.append((int(ids[x]), int(ids[y]), int(p[lo]), int(p[hi - 1]) + WORDS, int(q[begin]), int(q[end - 1]) + WORDS, similarity))
        columns_ = list(zip(*out, strict=True)) or [()] * 7
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_LINK, columns_, strict=True)}, _LINK)

    return met.distinct(), dealt.groupBy("key", "i", "j").applyInArrow(run, _LINK_SQL)


_LINK = pa.schema([("doc", pa.int64()), ("near", pa.int64()), *((c, pa.int32()) for c in ("begin", "end", "near_begin", "near_end")), ("similarity", pa.float64())])
_LINK_SQL = "doc long, near long, begin int, end int, near_begin int, near_end int, similarity double"
_WINDOW = [("key", pa.int64()), ("f", pa.int32()), ("doc", pa.int64()), ("near", pa.int64())]
