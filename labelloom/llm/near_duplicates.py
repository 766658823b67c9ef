"""Near-duplicate documents by bottom-k sketches.

One hash function maps a document's word shingles to 64 bits; the ``SKETCH`` least values are its sketch. Documents with
equal sets are one class, which its smallest doc_id stands for. Sets as similar as asked share at least ``shared()``
values of their sketches but for a chance below 1e-8, so each sketch is listed only under its rarest values, as many as
any such pair must meet in; a frequent value lists only documents made of little else. Each class is first tried with
the most similar of its lists' smallest members. Lists that the links found so far don't make one component stay open;
in these, pairs of different components are counted in blocks of the list, each pair in the first list that both are in:
what is compared is the ``WIDE`` least values, which for most documents are the whole set. Only pairs whose similarity,
estimated on the union of these, comes within the slack of the one asked for leave the block, and are verified on the
full sets of their texts; verified links give the components. All lists go this way, whatever their length.

Sets count as equal, and shingles as the same, by hashes: 128 bits and the size for a set, 64 bits for a shingle.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than a shingle is one shingle; without
words (or null) its set is empty and it is linked with nothing, as is a row without doc_id. Rows with one doc_id are one
node: a link of either counts, however different they are. Repeated rows are one class; ties can't arise, as every pair
similar enough is a link. Columns other than doc_id and text aren't read. A text is held whole in one task, with about
40 bytes a letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mixed, partitions, parts_of, release, released, span_hashes, text_blocks, written
from .byte_bpe import point_values
from .components import components, forest_roots

SKETCH = 48
#: Values of the longer sketch that pairs in open lists are compared by.
WIDE = 256
#: Members of a list that meet in one task, on either side.
BLOCK = 2048
#: What an estimate may fall short by: on the longer sketch six standard deviations at a similarity of 0.8, a chance of
#: 2e-8; on the short one, which only chooses whom a class is tried with first, five.
SLACK, WIDE_SLACK = 0.29, 0.15
#: Of a comparison of whole sets, by 32 bits a value.
WHOLE_SLACK = 0.01
#: Letters whose shingles are made at a time.
LETTERS = 1 << 18
#: Rows of open lists that one task gets, about.
TASK_ROWS = 8192


def shared(sizes, k: int = SKETCH):
    """Values that the sketches of a similar pair have in common at least (chance of fewer at 0.8: below 1e-8); works on columns and numbers."""
    return (sizes * 21) // k if isinstance(sizes, int) else F.greatest(F.lit(1), F.floor(sizes * 21 / k)).cast("int")


def shingles(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for first, end, points, starts, _ in text_blocks(texts, LETTERS):
        blank = np.ones(len(points) + 2, bool)
        blank[1:-1] = (points == 32) | ((points >= 9) & (points <= 13))
        edge = np.zeros(len(points) + 1, bool)
        edge[starts] = True
        begin = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
        stop = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
        low = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
        word = span_hashes(point_values()[low], begin, stop)
        total = np.full(max(0, len(word) - words + 1), words, np.uint64)
        for j in range(words):
            total += word[j : j + len(total)] * factors[j]
        total = mixed(total)
        at = np.searchsorted(begin, starts).tolist()
        for i in range(end - first):
            a, b = at[i], at[i + 1]
            if b - a >= words:
                yield np.unique(total[a : b - words + 1])
            elif b > a:
                yield mixed(np.array([(word[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def sketches(docs: DataFrame, words: int, k: int = SKETCH) -> DataFrame:
    """``(doc_id, n, a, b, sketch)``: set size, a 128-bit name of the set, its k least values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            n, a, b, least = [], [], [], []
            for x in shingles(batch.column(1).to_pylist(), words):
                n.append(len(x))
                a.append(x.sum(dtype=np.uint64))
                b.append(mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                least.append(x[:k].view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(a), signed(b), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "n", "a", "b", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, a long, b long, sketch array<long>")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def _estimated(x: str, y: str, k: int):
    """The similarity estimated on the union of two sketches, as a column. Values are unsigned, stored signed: the order is shifted for all alike."""
    order = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(order(F.array_union(x, y))), 1, k)
    return F.size(F.array_intersect(union, order(F.array_intersect(x, y)))) / F.size(union)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept. Links need ``percent`` / 100 of similarity, at least 0.8."""
    if not 80 <= percent <= 100:
        raise ValueError("the sketches are sized for a similarity of 0.8 or more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    node = F.struct("rep", "a").alias("node")  # a class: its smallest doc_id, which other sets may share, and half its name
    all_rows = written(sketches(docs, words, k), "sketches")
    full = all_rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")), "classes")
    members = written(full.select("doc_id", "n", "a", "b").join(classes.drop("sketch"), ["a", "b", "n"]).select("doc_id", "n", node), "members")
    reps = classes.select(node, "n", "sketch")

    # inverted lists, of each sketch's rarest values only
    counts = written(reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "values")
    common = reps.select("node", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value")).join(counts, "value")
    of = Window.partitionBy("node")
    ranked = common.withColumn("nth", F.row_number().over(of.orderBy("df", "value"))).withColumn("rare", F.col("held") - F.count("*").over(of))
    lists = written(ranked.filter(F.col("nth") + F.col("rare") <= F.col("held") - shared(F.col("held"), k) + 1).select("value", "node", "n"), "lists")
    firsts = written(lists.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("p")).filter("size > 1").select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "firsts")
    lists = written(lists.join(firsts, "value"), "lists")
    listed = lists.select(F.col("node.rep").alias("doc_id")).distinct()
    texts = written(_wide(docs.select("doc_id", "text").join(listed, "doc_id", "left_semi").dropDuplicates(), words, wide), "texts").withColumn("node", F.struct("rep", "a"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that the full sets confirm."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts_of(batches, 64):
                sets = list(shingles(batch.column(2).to_pylist() + batch.column(3).to_pylist(), words))
                good = [similar(x, y, percent) for x, y in zip(sets[: batch.num_rows], sets[batch.num_rows :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])

        joined = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
        return joined.select("u", "v", "x", "y").mapInArrow(lambda batches: released(run(batches)), f"u struct<rep: {kind}, a: bigint>, v struct<rep: {kind}, a: bigint>")

    # each with the most similar of its lists' first members
    close = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent
    pairs = lists.filter((F.col("node") != F.col("pivot")) & close).select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    pairs = pairs.join(reps.select(F.col("node").alias("u"), F.col("sketch").alias("x")), "u").join(reps.select(F.col("node").alias("v"), F.col("sketch").alias("y")), "v")
    stars = pairs.withColumn("similarity", _estimated("x", "y", k)).filter(F.col("similarity") >= percent / 100 - SLACK)
    best = written(stars.groupBy("v").agg(F.max_by("u", F.struct("similarity", "u")).alias("u")).select("u", "v"), "stars")
    links = written(verified(best), "links")

    # what may still link two components
    trees = forest_roots(links)
    rooted = lists.select("value", "node", "n").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    more = written(_open_pairs(rooted, texts.select("node", "prints"), percent, wide, block).join(best, ["u", "v"], "left_anti"), "pairs")
    own = members.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u < w").select("doc_id", "u")
    same = members.join(own, "doc_id").filter("u < node").select("u", F.col("node").alias("v"))
    # only links between trees are left to follow
    links = written(verified(more).unionByName(same), "links")
    for end in ("u", "v"):
        links = links.join(trees.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    tops = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = members.join(trees, "node", "left").withColumn("root", F.coalesce("root", "node")).join(tops, "root", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", "root")["rep"].alias("component_id"))
    alone = all_rows.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) less all but one document of each group, the one of smallest doc_id.

    Rows without doc_id stay; of rows that share one, one stays.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    kept = near_duplicates(known, words, percent).filter("kept").select("doc_id")
    return known.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter(F.col("doc_id").isNull()))


def _wide(docs: DataFrame, words: int, wide: int) -> DataFrame:
    """``(rep, a, prints, text)`` of each row (doc_id, text): prints, of the ``wide`` least values, hold the upper 32 bits, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            a, prints = [], []
            for x in shingles(batch.column(1).to_pylist(), words):
                a.append(x.sum(dtype=np.uint64))
                prints.append((x[:wide] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), batch.column(1)], ["rep", "a", "prints", "text"])

    return docs.mapInArrow(lambda batches: released(run(batches)), f"rep {docs.schema['doc_id'].dataType.simpleString()}, a bigint, prints binary, text string")


def _open_pairs(rows: DataFrame, prints: DataFrame, percent: int, wide: int, block: int) -> DataFrame:
    """The pairs (u, v), u the less, of different components in a list (value, node, n, root) that may be similar enough.

    A list's largest component is its core; the others meet each other and the core, block by block, and the core's
    members never each other. The table ``prints`` has the longer sketches of the nodes.
    """
    spark = rows.sparkSession
    per = rows.groupBy("value", "root").agg(F.count("*").alias("m")).groupBy("value").agg(F.sum("m").alias("size"), F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"))
    open_ = written(per.filter("roots > 1").select("value", "size", F.col("top.root").alias("core"), (F.col("size") - F.col("top.m")).alias("others")), "open")
    one = F.col("size") <= block
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    held = rows.join(open_, "value").withColumn("outer", F.when(one, 1).otherwise(blocks(F.col("others")))).withColumn("inner", F.when(one, 0).otherwise(blocks(F.col("size") - F.col("others"))))
    inside = ~one & (F.col("root") == F.col("core"))
    own = F.when(inside, F.col("outer") + F.pmod(F.xxhash64("node"), F.greatest("inner", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))).cast("int")
    listed = held.groupBy("node").agg(F.collect_set("value").alias("listed"))
    held = held.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1))))
    held = held.select("node", "value", "n", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(listed, "node").join(prints, "node")
    tasks = max(partitions(spark), int((open_.agg(F.sum("size")).first()[0] or 0) // TASK_ROWS))
    held = held.withColumn("task", F.pmod(F.xxhash64("value", "i", "j"), F.lit(tasks)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        roots = _numbers(group.column("root"))
        value, i, j, of, n = (group.column(c).to_numpy() for c in ("value", "i", "j", "block", "n"))
        order = np.lexsort((of, j, i, value))
        edges = np.flatnonzero(np.diff(value[order]) | np.diff(i[order]) | np.diff(j[order])) + 1
        us, vs = [], []
        for part in np.split(order, edges):
            if len(part) > 1:
                found = _met(roots[part], of[part], n[part], group.column("listed").take(pa.array(part)).to_pylist(), group.column("prints").take(pa.array(part)).to_pylist(), int(value[part[0]]), percent, wide)
                us += part[found[0]].tolist()
                vs += part[found[1]].tolist()
        nodes = group.column("node")
        release()
        return pa.table({"u": nodes.take(pa.array(us, pa.int64())), "v": nodes.take(pa.array(vs, pa.int64()))})

    kind = rows.schema["node"].dataType.simpleString()
    pairs = held.groupBy("task").applyInArrow(run, f"u {kind}, v {kind}")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _numbers(nodes: pa.ChunkedArray) -> np.ndarray:
    """The same number for the same node."""
    first = pc.dictionary_encode(pc.struct_field(nodes.combine_chunks(), [0])).indices.to_numpy(zero_copy_only=False)
    both = np.stack([first.astype(np.int64), pc.struct_field(nodes.combine_chunks(), [1]).to_numpy(zero_copy_only=False)], 1)
    return np.unique(both, axis=0, return_inverse=True)[1].reshape(-1)


def _met(roots: np.ndarray, block: np.ndarray, n: np.ndarray, listed: list[list[int]], prints: list[bytes], value: int, percent: int, wide: int) -> tuple[list[int], list[int]]:
    """The pairs of rows, in two blocks of the list ``value`` or all in one, that differ in root and may be similar; none that a lesser list has too."""
    m, two = len(roots), block[0] != block[-1]
    sets = [np.frombuffer(x, "<u4") for x in prints]
    whole = n <= wide
    last = np.array([x[-1] for x in sets], np.uint32)
    before: dict[int, list[int]] = {}
    for r, own in enumerate(listed):
        for x in own:
            if x < value:
                before.setdefault(x, []).append(r)
    shared_lists = {x: np.array(r) for x, r in before.items() if len(r) > 1}
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    by_value = np.argsort(flat, kind="stable")
    flat, row = flat[by_value], row[by_value]
    us, vs = [], []
    for r in range(m - 1):
        left = roots[r + 1 :] != roots[r]
        if two:
            left &= block[r + 1 :] != block[r]
        left &= (np.minimum(n[r + 1 :], n[r]) * 100 >= np.maximum(n[r + 1 :], n[r]) * percent)
        if not left.any():
            continue
        left = np.concatenate([np.zeros(r + 1, bool), left])
        for x in listed[r]:
            if x < value and x in shared_lists:
                left[shared_lists[x]] = False
        at = np.flatnonzero(left)
        if not len(at):
            continue
        lo, hi = np.searchsorted(flat, sets[r], "left"), np.searchsorted(flat, sets[r], "right")
        spots = np.arange(int((hi - lo).sum())) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        both = np.bincount(row[spots], minlength=m)[at]
        entire = whole[at] & whole[r]
        good = entire & (both >= (percent / 100 - WHOLE_SLACK) * (n[at] + n[r] - both))
        floor = percent / 100 - WIDE_SLACK
        for c in np.flatnonzero(~entire & (both >= floor * wide)).tolist():
            q = at[c]
            top = min((last[y] for y in (r, q) if not whole[y]))
            union = np.searchsorted(sets[r], top, "right") + np.searchsorted(sets[q], top, "right") - both[c]
            good[c] = both[c] >= floor * union
        us += [r] * int(good.sum())
        vs += at[good].tolist()
    return us, vs
