"""Lines of the text formats, parsed and made by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_LABELS = r"^\+?\d+(,\s*\+?\d+)*$"
_PAIRS = rf"^(\s*\d+:\s*{_NUMBER})*\s*$"


def checked(good: Column, value: Column, message: str, line: Column) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), line)))


def is_data(line: Column) -> Column:
    """Not blank and not a comment."""
    return (F.trim(line) != "") & ~line.startswith("#")


def label_part(line: Column) -> Column:
    """What stands before the first blank; empty if the line starts with one."""
    return F.regexp_extract(line, r"^((?:[^\s,:]*,\s*)*[^\s,:]*)(?=\s|$)", 1)


def parse_labels(text: Column) -> Column:
    """Ids of a comma list; blanks after a comma and a leading + are allowed. Anything else is an error."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)")), lambda x: x.cast("bigint"))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(checked(text.rlike(_LABELS), found, "not a list of labels", text))


def parse_pairs(text: Column) -> Column:
    """``index:value`` pairs as an array of structs. A blank may follow the colon, none may precede it."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d+:\s*{_NUMBER})"))
    made = F.transform(found, lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("index"), F.trim(F.split(x, ":")[1]).cast("double").alias("value")))
    return checked(text.rlike(_PAIRS), made, "not a list of index:value pairs", text)


def count_entries(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(":"), F.lit("")))


def parse_header(line: Column, fields: int) -> Column:
    """``fields`` positive integers and nothing else, as an array."""
    good = line.rlike(r"^\s*" + r"\s+".join([r"0*[1-9]\d*"] * fields) + r"\s*$")
    return checked(good, F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.cast("bigint")), "not a header", line)


def parse_floats(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def bounded(entries: DataFrame, column: str, bound: Column) -> DataFrame:
    """Entries with ids below the bound; an id beyond is an error, zeros go, and NaN is one too."""
    ok = (F.col(column) >= 0) & (F.col(column) < bound)
    out = entries.withColumn(column, checked(ok, F.col(column), f"{column} out of range", F.col(column).cast("string")))
    if "value" in entries.columns:
        out = out.withColumn("value", checked(~F.isnan("value"), F.col("value"), "NaN", F.lit(""))).filter("value <> 0")
    return out


def number(value: Column, digits: int) -> Column:
    """Fixed notation."""
    return F.format_string(f"%.{digits}f", value)


def xmc_lines(features: DataFrame, labels: DataFrame, examples: DataFrame, digits: int = 4) -> DataFrame:
    """``(example_id, line)``: labels, ascending, then index:value pairs."""
    f = features.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("f"))
    y = labels.groupBy("example_id").agg(F.sort_array(F.collect_set("label_id")).alias("y"))
    joined = examples.select("example_id").join(f, "example_id", "left").join(y, "example_id", "left")
    pairs = F.array_join(F.transform("f", lambda x: F.concat(x["feature_id"].cast("string"), F.lit(":"), number(x["value"], digits))), " ")
    head = F.array_join(F.transform("y", lambda x: x.cast("string")), ",")
    return joined.select("example_id", F.concat(F.coalesce(head, F.lit("")), F.lit(" "), F.coalesce(pairs, F.lit(""))).alias("line"))


def topk_lines(topk: DataFrame, digits: int = 6) -> DataFrame:
    """``(example_id, line)`` of ``label:score`` pairs in rank order."""
    rows = topk.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rk", "label_id", "score"))).alias("t"))
    return rows.select("example_id", F.array_join(F.transform("t", lambda x: F.concat(x["label_id"].cast("string"), F.lit(":"), number(x["score"], digits))), " ").alias("line"))


def sparse_weight_lines(weights: DataFrame, threshold: float = 0.0, digits: int = 6) -> DataFrame:
    """``(label_id, line)`` of the entries larger than the threshold; labels without any have an empty line."""
    big = F.when(F.abs("w") > threshold, F.struct("feature_id", "w"))
    rows = weights.groupBy("label_id").agg(F.array_sort(F.collect_list(big)).alias("t"))
    return rows.select("label_id", F.array_join(F.transform("t", lambda x: F.concat(x["feature_id"].cast("string"), F.lit(":"), number(x["w"], digits))), " ").alias("line"))


def dense_weight_lines(weights: DataFrame, columns: DataFrame, digits: int = 6) -> DataFrame:
    """``(label_id, line)`` with a number for every feature of ``columns``."""
    grid = weights.select("label_id").distinct().crossJoin(columns.select("feature_id")).join(weights, ["label_id", "feature_id"], "left")
    rows = grid.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("t"))
    return rows.select("label_id", F.array_join(F.transform("t", lambda x: number(x["w"], digits)), " ").alias("line"))
