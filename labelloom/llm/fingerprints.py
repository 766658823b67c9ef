"""Document fingerprints by winnowing, in DataFrame functions alone.

Each run of ``GRAM`` bytes has a rolling hash: the bytes' own hashes, each shifted one further than the next, are added
without carry, so moving on by a byte is a shift, the old byte out and the new one in. Of every ``WINDOW`` neighbouring
hashes the least is selected, the rightmost of equal ones, and kept with its position. Two texts that share
``GRAM + WINDOW - 1`` bytes select a common hash there.

Texts are cut into stretches and these into blocks of ``BLOCK`` windows, a row each, overlapping by a window and a gram,
so the work takes the memory of a block, however long the text. In a block each place is a column, and so generated
code: hashes are made from their neighbours over 1, 3 and 12 bytes, minima over ``_STEP`` hashes and over as many of
these as make up the window. A hash of 54 bits and its place in the block are one long, the hash above, the place below
and falling from left to right, so the least long of a window is its selection.

A text shorter than a gram is one gram, one with fewer grams than a window is one window; null and empty texts have an
empty fingerprint. The likeness of two fingerprints is the Jaccard similarity of their hashes, 1 for two empty ones.
Repeated rows are fingerprinted each; rows that share a doc_id follow one another by text. doc_id is a whole number or
null, null first; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions

GRAM, WINDOW, BLOCK = 12, 32, 112
#: Windows of a stretch of whole blocks, which a text is cut into first.
STRETCH = 80 * BLOCK
#: Bytes of a block's windows, and of the stretch in which a cut changes what is selected, on either side.
SPAN = BLOCK + WINDOW + GRAM - 2
REACH = WINDOW + GRAM - 1
NEAR = REACH + WINDOW - 2
#: Text of a range of documents that one task orders.
RANGE_BYTES = 128 << 20
_BITS, _STEP = 10, 4
_PLACE = (1 << _BITS) - 1
CELLS = "array<struct<h: bigint, p: int>>"


def _pieces(raw: Column, part: Column | int, start: Column | int = 0, windows: int = STRETCH) -> Column:
    """A binary cut every ``windows`` windows: ``part``, the position of the first byte (counted from ``start``), the bytes; one if it is empty."""
    part = F.lit(part) if isinstance(part, int) else part
    last = F.floor((F.greatest(F.octet_length(raw) - REACH, F.lit(0))) / windows).cast("int")
    cut = lambda r, b: F.struct(part.alias("part"), (b * windows + start).cast("int").alias("off"), F.substring(r, b * windows + 1, F.lit(windows + REACH - 1)).alias("raw"))
    return F.transform(F.array(raw), lambda r: F.transform(F.sequence(F.lit(0), last), lambda b: cut(r, b)))[0]


def _selected(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """``stretches`` (the keys, part, off, raw) as rows of blocks, with ``cells`` in place of raw: the selected longs of a block, from left to right."""
    blocks = stretches.select(*keys, F.inline(_pieces(F.col("raw"), F.col("part"), F.col("off"), BLOCK)))
    kept = [*keys, "part", "off", "_size", "_short"]
    # a column a place: so many columns are made by generated code, split into small methods, which lambdas over arrays are not
    layer = lambda df, tag, n, of: df.selectExpr(*kept, *(f"{of(i)} as {tag}{i}" for i in range(n)))
    joined = lambda tag, i, step, n, by: " ^ ".join(f"shiftleft({tag}{i + step * j}, {by * (n - 1 - j)})" if j < n - 1 else f"{tag}{i + step * j}" for j in range(n))
    least = lambda tag, i, step, n: f"least({', '.join(f'{tag}{i + step * j}' for j in range(n))})"
    cell = lambda h, i: f"((({h}) & {~_PLACE}L) | {_PLACE - i}L)"
    # the grams that a first window lacks if it is the only one, of a short text
    gram = lambda i: cell(joined("_u", i, 3, 4, 3), i) if not 0 < i < WINDOW else f"if(_size < {i + GRAM}, {(1 << 63) - 1}L, {cell(joined('_u', i, 3, 4, 3), i)})"

    rows = blocks.select(*keys, "part", "off", "raw", F.octet_length("raw").alias("_size"), F.when(F.octet_length("raw") < GRAM, F.xxhash64("raw")).otherwise(F.lit(0)).alias("_short"))
    rows = layer(rows, "_b", SPAN, lambda i: f"xxhash64(substring(raw, {i + 1}, 1))")
    rows = layer(rows, "_u", SPAN - 2, lambda i: joined("_b", i, 1, 3, 1))
    rows = layer(rows, "_g", BLOCK + WINDOW - 1, gram)
    rows = layer(rows, "_n", BLOCK + WINDOW - _STEP, lambda i: least("_g", i, 1, _STEP))
    rows = layer(rows, "_w", BLOCK, lambda i: least("_n", i, _STEP, WINDOW // _STEP))
    all_ = f"array({', '.join(f'_w{i}' for i in range(BLOCK))})"
    found = f"""case when _size >= {GRAM} then array_distinct(slice({all_}, 1, greatest(1, _size - {REACH - 1})))
        when _size > 0 then array({cell("_short", 0)}) else cast(array() as array<bigint>) end as cells"""
    return rows.selectExpr(*keys, "part", "off", found)


def _gathered(pieces: str, part: int) -> Column:
    """The cells of a part's blocks in order, with hash and position; a selection that two blocks share counts once."""
    own = F.sort_array(F.filter(pieces, lambda x: x["part"] == part))
    place = lambda c, off: (F.lit(_PLACE) - c.bitwiseAND(F.lit(_PLACE)).cast("int") + off).cast("int")
    placed = F.flatten(F.transform(own, lambda x: F.transform(x["cells"], lambda c: F.struct(F.shiftright(c, _BITS).alias("h"), place(c, x["off"]).alias("p")))))
    return F.transform(F.array(placed), lambda all_: F.filter(all_, lambda c, i: (i == 0) | (F.get(all_, i - 1)["p"] != c["p"])))[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, cells)`` of the distinct rows of ``docs`` (doc_id, text): the selected hashes with their positions in bytes."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = own.select("doc_id", F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("name"), _pieces(F.col("text").cast("binary"), 0).alias("pieces"))
    keys = ["doc_id", "n_bytes", "name"]
    found = _selected(rows.select(*keys, F.inline("pieces")), keys).groupBy(*keys).agg(F.collect_set(F.struct("part", "off", "cells")).alias("pieces"))
    return found.select("doc_id", "n_bytes", _gathered("pieces", 0).alias("cells"))


def fingerprint(cells: Column) -> Column:
    """The fingerprint as a string: ``hash:position`` of each selection, positions in bytes from 0."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["h"].bitwiseAND(F.lit((1 << (64 - _BITS)) - 1))), F.lit(":"), c["p"].cast("string"))), " ")


def hashes(cells: Column) -> Column:
    return F.array_distinct(F.transform(cells, lambda c: c["h"]))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def shared_passages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions at which two tables of (doc_id, cells) select a common hash: doc_a, at_a, doc_b, at_b."""
    rows = lambda df, tag: df.select(F.col("doc_id").alias(f"doc_{tag}"), F.explode("cells").alias("cell")).select(f"doc_{tag}", F.col("cell.h").alias("hash"), F.col("cell.p").alias(f"at_{tag}"))
    return rows(left, "a").join(rows(right, "b"), "hash").select("doc_a", "at_a", "doc_b", "at_b")


def in_ranges(docs: DataFrame, order: str, text: str) -> DataFrame:
    """``docs`` with ``_to`` and ``_late``: rows by ranges of ``order``, about ``RANGE_BYTES`` of ``text`` each, in groups ``_to``.

    The first row of each range is also sent, as a guest (``_late`` 1, for the last range 2), to the group before; the
    first of all comes after the last. What is gathered on the driver is a number a range.
    """
    spark = docs.sparkSession
    least = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    n = max(partitions(spark), int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // RANGE_BYTES))
    bounds = docs.agg(F.percentile_approx(F.col(order).cast("long"), [i / n for i in range(1, n)] or [0.5], max(100_000, 10 * n))).first()[0]
    bounds = sorted(set(bounds or []))
    group = F.lit(0)
    if bounds:  # a binary search: bounds below the row's value
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
        held = F.array(*map(F.lit, bounds))
        group = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) < F.col(order)), at + s).otherwise(at))
    rows = docs.withColumn("_group", group)
    firsts = sorted((r["_group"], r["least"]) for r in rows.groupBy("_group").agg(F.min(least).alias("least")).collect())
    before = [(firsts[i][1], firsts[i - 1][0], int(i == 0)) for i in range(len(firsts))]
    guests = F.broadcast(spark.createDataFrame(before, "_least long, _before int, _last int"))  # a row a range
    rows = rows.join(guests, least == F.col("_least"), "left")
    own = F.struct(F.col("_group").alias("_to"), F.lit(0).alias("_late"))
    guest = F.struct(F.col("_before").alias("_to"), (F.lit(1) + F.col("_last")).alias("_late"))
    return rows.select(*docs.columns, F.inline(F.when(F.col("_least").isNotNull(), F.array(own, guest)).otherwise(F.array(own))))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text and of the next one's, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by the first as many of the next text. Its
    fingerprint is put together from those of both: a selection stands where all windows over it are of one text, and
    only around the seam and at the end, where some are not, are blocks worked on anew.
    """
    own = in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    order = Window.partitionBy("_to").orderBy("_late", "doc_id", "text")
    rows = own.select("*", F.lead("text").over(order).alias("after"), F.row_number().over(order).alias("_row")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)).withColumn("edited", F.concat("head", F.substring(F.coalesce("after", F.lit("")), F.lit(1), half)))
    raw, a, n = F.col("edited").cast("binary"), F.octet_length("head"), F.octet_length("edited")
    seam, end = F.greatest(F.lit(0), a - NEAR), F.greatest(F.lit(0), n - NEAR)
    parts = [_pieces(F.col("text").cast("binary"), 0), _pieces(F.substring(raw, seam + 1, F.lit(2 * NEAR)), 1, seam), _pieces(F.substring(raw, end + 1, F.lit(NEAR)), 2, end)]
    keys = ["_to", "_row", "_late", "doc_id", "n_chars", "edited_sha256", "a", "n"]
    blocks = rows.select("_to", "_row", "_late", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), a.alias("a"), n.alias("n"), F.when(F.col("_late") > 0, parts[0]).otherwise(F.concat(*parts)).alias("pieces"))
    blocks = blocks.select(*keys, F.inline("pieces"))  # the texts end before their blocks become rows
    found = _selected(blocks, keys).groupBy(*keys).agg(F.collect_list(F.struct("part", "off", "cells")).alias("pieces"))
    found = found.select(*keys, _gathered("pieces", 0).alias("cells"), _gathered("pieces", 1).alias("seam"), _gathered("pieces", 2).alias("end"))
    found = found.withColumn("next", F.coalesce(F.lead("cells").over(Window.partitionBy("_to").orderBy("_row")), F.array().cast(CELLS))).filter("_late = 0")

    # whose windows all lie before the seam, or some across it, or all behind it, or some at the end
    first, last = F.col("a") - REACH, F.col("n") - REACH
    moved = F.transform("next", lambda c: F.struct(c["h"].alias("h"), (c["p"] + F.col("a")).alias("p")))
    behind = F.col("a") + WINDOW - 1
    edited = F.concat(
        F.filter("cells", lambda c: c["p"] <= first),
        F.filter("seam", lambda c: (c["p"] > first) & (c["p"] < behind)),
        F.filter(moved, lambda c: (c["p"] >= behind) & (c["p"] <= last)),
        F.filter("end", lambda c: (c["p"] > last) & (c["p"] >= behind)),
    )
    found = found.withColumn("edited", edited)
    found = found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("cells")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), hashes(F.col("cells")).alias("h"), hashes(F.col("edited")).alias("e"), hashes(F.col("next")).alias("x"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("h"), F.col("e")).alias("near_edited"), likeness(F.col("h"), F.col("x")).alias("near_next"))
