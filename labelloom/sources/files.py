"""Readers and writers of data sets, models and predictions."""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import formats


@dataclass(frozen=True)
class Dataset:
    """features (example_id, feature_id, value), labels (example_id, label_id), examples (example_id), meta: one row of n_examples, n_features, n_labels."""

    features: DataFrame
    labels: DataFrame
    examples: DataFrame
    meta: DataFrame


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """``(number, line)`` of the data lines in file order, from 0, without moving any: a line's number is its block's offset plus its place there.

    With ``blank`` all lines count, also those that hold no data.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = (lines if blank else lines.filter(formats.is_data(F.col("line")))).withColumn("id", F.monotonically_increasing_id())
    per = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row a block
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(per.select("file", "block", "first", before.alias("before")), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("number"), "line")


def _header(lines: DataFrame, fields: int) -> list[int]:
    row = lines.filter("number = 0").select(formats.parse_header(F.col("line"), fields).alias("h")).first()
    if row is None:
        raise ValueError("the file has no header")
    return list(row["h"])


def _body(lines: DataFrame, key: str) -> DataFrame:
    """The lines after the header, numbered from 0 as ``key``.

    The header is blanked as well as filtered: what parses a line may be moved below the filter, and would refuse it.
    """
    own = F.when(F.col("number") > 0, F.col("line")).otherwise("")
    return lines.select((F.col("number") - 1).alias(key), own.alias("line")).filter(F.col(key) >= 0)


def read_xmc(spark: SparkSession, path: str, one_based: bool = False) -> Dataset:
    """Text with a header ``examples features labels`` and lines ``l1,l2 f:v f:v``. Counts and ids are checked; a label that repeats in a line counts once."""
    lines = numbered_lines(spark, path)
    n, f, y = _header(lines, 3)
    shift = int(one_based)
    body = _body(lines, "example_id")
    if (found := body.count()) != n:
        raise ValueError(f"{found} examples; the header has {n}")
    head = formats.label_part(F.col("line"))
    rest = F.col("line").substr(F.char_length(head) + 1, F.char_length("line"))
    labels = body.select("example_id", F.explode(F.array_distinct(formats.parse_labels(head))).alias("label_id")).withColumn("label_id", F.col("label_id") - shift)
    entries = body.select("example_id", F.explode(formats.parse_pairs(rest)).alias("x")).select("example_id", (F.col("x.index") - shift).alias("feature_id"), "x.value")
    return Dataset(formats.bounded(entries, "feature_id", F.lit(f)), formats.bounded(labels, "label_id", F.lit(y)), body.select("example_id"), spark.createDataFrame([(n, f, y)], "n_examples long, n_features long, n_labels long"))


def label_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``(label_id, n)`` of an XMC file, without reading its features."""
    body = _body(numbered_lines(spark, path), "example_id")
    return body.select(F.explode(formats.parse_labels(formats.label_part(F.col("line")))).alias("label_id")).groupBy("label_id").agg(F.count("*").alias("n"))


def write_lines(rows: DataFrame, key: str, path: str, header: str | None = None) -> None:
    """Lines in order of the key, as text parts in that order, the header first."""
    if header is not None:
        rows = rows.unionByName(rows.sparkSession.createDataFrame([(-1, header)], f"{key} long, line string"))
    rows.repartitionByRange(key).sortWithinPartitions(key).select("line").write.text(path)


def write_xmc(data: Dataset, path: str, digits: int = 4) -> None:
    n, f, y = data.meta.first()
    write_lines(formats.xmc_lines(data.features, data.labels, data.examples, digits), "example_id", path, f"{n} {f} {y}")


def read_dense_text(spark: SparkSession, path: str) -> DataFrame:
    """A header ``rows columns`` and a row of numbers a line: (example_id, feature_id, value)."""
    lines = numbered_lines(spark, path)
    rows, columns = _header(lines, 2)
    body = _body(lines, "example_id").select("example_id", formats.parse_floats(F.col("line")).alias("v"))
    if body.count() != rows or body.filter(F.size("v") != columns).limit(1).count():
        raise ValueError(f"the body isn't {rows} rows of {columns} numbers")
    return body.select("example_id", F.posexplode("v").alias("feature_id", "value")).withColumn("feature_id", F.col("feature_id").cast("bigint"))


def read_binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A header ``rows columns`` and lines of ``column:1``: (row, column)."""
    lines = numbered_lines(spark, path)
    _, columns = _header(lines, 2)
    cells = _body(lines, "row").select("row", F.explode(formats.parse_pairs(F.col("line"))).alias("x"))
    one = formats.checked(F.col("x.value") == 1, F.col("x.index"), "a value that isn't 1", F.col("x.value").cast("string"))
    return formats.bounded(cells.select("row", one.alias("column")), "column", F.lit(columns))


def read_slice(spark: SparkSession, features: str, labels: str) -> Dataset:
    """Dense features, as text or npy, and a binary label matrix of as many rows."""
    x = read_npy(spark, features) if features.endswith(".npy") else read_dense_text(spark, features)
    rows, n_labels = _header(numbered_lines(spark, labels), 2)
    y = read_binary_matrix(spark, labels).toDF("example_id", "label_id")
    n, f = x.agg(F.max("example_id") + 1, F.max("feature_id") + 1).first()
    if rows != n:
        raise ValueError(f"{n} rows of features, {rows} of labels")
    return Dataset(x, y, spark.range(n).toDF("example_id"), spark.createDataFrame([(n, f, n_labels)], "n_examples long, n_features long, n_labels long"))


# -- npy ------------------------------------------------------------------------------------------------------------
def npy_header(raw: bytes) -> tuple[int, tuple[int, ...]]:
    """Offset of the data and the shape; only row-major 32-bit floats are taken."""
    if raw[:6] != b"\x93NUMPY" or raw[6] not in (1, 2, 3):
        raise ValueError("not an npy file")
    size, at = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    about = ast.literal_eval(raw[at : at + size].decode("utf-8" if raw[6] == 3 else "latin1"))
    if about["descr"] != "<f4" or about["fortran_order"]:
        raise ValueError(f"unsupported npy layout {about}")
    return at + size, tuple(about["shape"])


def npy_head(rows: int, columns: int) -> bytes:
    """A version 3 header, padded so that the data begin at a multiple of 64."""
    text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {columns}), }}"
    text += " " * (-(len(text) + 13) % 64) + "\n"
    return b"\x93NUMPY\x03\x00" + struct.pack("<I", len(text)) + text.encode()


def read_npy(spark: SparkSession, path: str, rows_a_task: int = 100_000) -> DataFrame:
    """(example_id, feature_id, value); each task reads its own rows of the file."""
    fs, local = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(local) as f:
        offset, (rows, columns) = npy_header(f.read(4096))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, local = pafs.FileSystem.from_uri(path)
        for begin in (b for batch in batches for b in batch["id"]):
            n = min(rows_a_task, rows - begin)
            with fs.open_input_file(local) as f:
                f.seek(offset + begin * columns * 4)
                data = np.frombuffer(f.read(n * columns * 4), "<f4")
            yield pd.DataFrame({"example_id": np.repeat(np.arange(begin, begin + n), columns), "feature_id": np.tile(np.arange(columns), n), "value": data.astype(np.float64)})

    starts = spark.range(0, rows, rows_a_task, max(1, -(-rows // rows_a_task)))
    return starts.mapInPandas(run, "example_id long, feature_id long, value double")


def write_npy(rows: DataFrame, path: str, n_rows: int, n_columns: int) -> None:
    """Dense rows (id, values), streamed to one file in order of id."""
    fs, local = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(local) as f:
        f.write(npy_head(n_rows, n_columns))
        for row in rows.orderBy("id").toLocalIterator():
            f.write(np.asarray(row["values"], "<f4").tobytes())


# -- models ---------------------------------------------------------------------------------------------------------
def _ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First label and end of each part of a model that has been written, in order."""
    try:
        rows = spark.read.text(f"{path}/ranges").collect()  # a row a part
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r["first"], r["end"]) for r in (json.loads(x["value"]) for x in rows))


def write_weights(weights: DataFrame, path: str, n_labels: int, n_features: int, bucket: int = 4096, culling: float = 0.0, first: int = 0, count: int | None = None) -> None:
    """A model's part, weights (label_id, feature_id, w) of the labels [first, first + count), by label bucket; by default all labels.

    A part that is written again replaces itself, so a run can be repeated. A part that overlaps another one, reaches
    beyond the labels or holds weights of labels outside it is refused, as is one of a model of another shape.
    """
    spark, end = weights.sparkSession, n_labels if count is None else first + count
    if not 0 <= first < end <= n_labels:
        raise ValueError(f"labels {first} to {end} of {n_labels}")
    about = {"num-features": n_features, "num-labels": n_labels, "bucket": bucket}
    there = _ranges(spark, path)
    if there and json.loads(spark.read.text(f"{path}/meta").first()[0]) != about:
        raise ValueError("the model there has another shape")
    for a, b in there:
        if (a, b) != (first, end) and a < end and first < b:
            raise ValueError(f"labels {first} to {end} overlap {a} to {b}, which are there")
    inside = formats.checked(F.col("label_id").between(first, end - 1), F.col("label_id"), "a label outside its part", F.col("label_id").cast("string"))
    inside_too = formats.checked(F.col("feature_id").between(0, n_features - 1), F.col("feature_id"), "a feature that the model doesn't have", F.col("feature_id").cast("string"))
    own = weights.select(inside.alias("label_id"), inside_too.alias("feature_id"), "w").filter(F.abs("w") > culling).withColumn("label_bucket", F.floor(F.col("label_id") / bucket))
    own.repartition("label_bucket").write.mode("overwrite").partitionBy("label_bucket").parquet(f"{path}/weights/part={first}")
    for name, value in (("meta", about), (f"ranges/part={first}", {"first": first, "end": end})):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def missing_labels(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The stretches (first, end) of labels that no part of a model holds; none when it is whole."""
    n, at, out = json.loads(spark.read.text(f"{path}/meta").first()[0])["num-labels"], 0, []
    for first, end in [*_ranges(spark, path), (n, n)]:
        if first > at:
            out.append((at, first))
        at = max(at, end)
    return out


def read_weights(spark: SparkSession, path: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """Weights of labels [first, end): only their buckets are read. A model that lacks some of these labels is an error."""
    about = json.loads(spark.read.text(f"{path}/meta").first()[0])
    low, high = first or 0, about["num-labels"] if end is None else end
    if gaps := [(max(a, low), min(b, high)) for a, b in missing_labels(spark, path) if a < high and low < b]:
        raise ValueError(f"labels that were not written: {gaps}")
    out, bucket = spark.read.schema("label_id long, feature_id long, w double, part long, label_bucket long").parquet(f"{path}/weights"), about["bucket"]
    if first is not None:
        out = out.filter((F.col("label_id") >= first) & (F.col("label_bucket") >= first // bucket))
    if end is not None:
        out = out.filter((F.col("label_id") < end) & (F.col("label_bucket") <= (end - 1) // bucket))
    return out.select("label_id", "feature_id", "w")


def read_model_index(spark: SparkSession, path: str) -> DataFrame:
    """Shards (first, count, file, format) of a JSON model index."""
    about = spark.read.option("multiLine", True).json(path)
    return about.select(F.explode("files").alias("x")).select("x.first", "x.count", "x.file", F.col("x.`weight-format`").alias("format"))


def read_weight_lines(spark: SparkSession, path: str, first_label: int = 0, sparse: bool = False, n_features: int | None = None) -> DataFrame:
    """Text weights, a line a label (empty lines count): dense numbers or index:value pairs. Zeros are dropped.

    Of several files, in order of their names, one goes on where the other ends.
    """
    lines = numbered_lines(spark, path, blank=True).select((F.col("number") + first_label).alias("label_id"), "line")
    if sparse:
        cells = lines.select("label_id", F.explode(formats.parse_pairs(F.col("line"))).alias("x")).select("label_id", F.col("x.index").alias("feature_id"), F.col("x.value").alias("w"))
        return formats.bounded(cells, "feature_id", F.lit(n_features)) if n_features is not None else cells
    cells = lines.select("label_id", F.posexplode(formats.parse_floats(F.col("line"))).alias("feature_id", "w"))
    return cells.withColumn("feature_id", F.col("feature_id").cast("bigint")).filter("w <> 0")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A header ``examples k`` and k pairs ``label:score`` a line: (example_id, rk, label_id, score)."""
    lines = numbered_lines(spark, path)
    _, k = _header(lines, 2)
    body = _body(lines, "example_id").withColumn("p", formats.parse_pairs(F.col("line")))
    body = body.withColumn("p", formats.checked((F.col("example_id") < 0) | (F.size("p") == k), F.col("p"), f"not {k} predictions", F.col("line")))
    return body.select("example_id", F.posexplode("p").alias("rk", "x")).select("example_id", F.col("rk").cast("bigint").alias("rk"), F.col("x.index").alias("label_id"), F.col("x.value").alias("score"))


def write_predictions(topk: DataFrame, path: str, n_examples: int, k: int, digits: int = 6) -> None:
    write_lines(formats.topk_lines(topk, digits), "example_id", path, f"{n_examples} {k}")


def read_label_weights(spark: SparkSession, positive: str | None, negative: str | None) -> DataFrame:
    """(label_id, pos, neg) of files with a number a label, as text (blanks or line ends between them) or an npy vector; 1 without a file."""

    def numbers(path: str, name: str) -> DataFrame:
        if path.endswith(".npy"):
            cells = read_npy(spark, path)  # one row or one column
            return cells.select(F.greatest("example_id", "feature_id").alias("label_id"), F.col("value").alias(name))
        lines = numbered_lines(spark, path, blank=True).select("number", formats.parse_floats(F.col("line")).alias("v"))
        before = F.coalesce(F.sum(F.size("v")).over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a number a label
        return lines.select(before.alias("b"), "v").select("b", F.posexplode("v").alias("at", name)).select((F.col("b") + F.col("at")).alias("label_id"), name)

    found = [numbers(path, name) if path else None for path, name in ((positive, "pos"), (negative, "neg"))]
    if found[0] is None and found[1] is None:
        raise ValueError("neither file is given")
    both = found[0] if found[1] is None else found[1] if found[0] is None else found[0].join(found[1], "label_id", "full")
    columns = [F.coalesce(n, F.lit(1.0)).alias(n) if n in both.columns else F.lit(1.0).alias(n) for n in ("pos", "neg")]
    return both.select("label_id", *columns)


def write_dense_predictions(scores: DataFrame, path: str, n_examples: int, n_labels: int, digits: int = 6) -> None:
    """A header ``examples labels`` and a line of all labels' scores for each example, 0 where ``scores`` (example_id, label_id, score) has none."""
    rows = scores.groupBy("example_id").agg(F.map_from_entries(F.collect_list(F.struct("label_id", "score"))).alias("m"))
    every = scores.sparkSession.range(n_examples).toDF("example_id").join(rows, "example_id", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: formats.number(F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)), digits)), " ")
    write_lines(every.select("example_id", line.alias("line")), "example_id", path, f"{n_examples} {n_labels}")


def labelled_only(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and truth without the examples that have no label."""
    return pred.join(truth.select("example_id").distinct(), "example_id", "left_semi"), truth
