"""Run statistics as aggregations; every one is mergeable."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counter(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).cast("bigint").alias("total"))


def basic(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_squared"), F.avg(v).alias("mean"))


def tagged(df: DataFrame, value: str, tag: str, max_tag: int, logarithm: bool = False) -> DataFrame:
    """Moments by tag, with tags over ``max_tag`` counted there, and mean and deviation for plots."""
    v = F.log(value) if logarithm else F.col(value)
    out = df.select(F.least(F.col(tag), F.lit(max_tag)).cast("bigint").alias("tag"), v.alias("v")).groupBy("tag").agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_squared"))
    mean = F.col("sum") / F.col("count")
    return out.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.lit(0.0), F.col("sum_squared") / F.col("count") - mean * mean))})


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """0 below, 1 to ``bins`` inside, ``bins`` + 1 from ``high`` on."""
    return F.when(value < low, 0).when(value >= high, bins + 1).otherwise(F.floor((value - low) / (high - low) * bins) + 1).cast("bigint")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, logarithm: bool = False, by: str | None = None) -> DataFrame:
    """(bin, centre, count), and by tag if given; logarithmic bins take the absolute value, with 0 below all."""
    import math

    v = F.col(value)
    if logarithm:
        a = F.abs(v)
        spot = F.when(a > 0, bin_of(F.log(F.when(a > 0, a).otherwise(1.0)), math.log(low), math.log(high), bins)).otherwise(0).cast("bigint")
        centre = F.exp(F.lit(math.log(low)) + (F.col("bin") - 0.5) * ((math.log(high) - math.log(low)) / bins))
    else:
        spot, centre = bin_of(v, low, high, bins), F.lit(low) + (F.col("bin") - 0.5) * ((high - low) / bins)
    keys = ["tag"] if by else []
    rows = df.select(*([F.col(by).alias("tag")] if by else []), spot.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    return rows.select(*keys, "bin", F.when(F.col("bin").between(1, bins), centre).alias("centre"), "count")


def full(df: DataFrame, value: str, by: str) -> DataFrame:
    """All values, sorted, by key."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("values"))


def norms(features: DataFrame) -> DataFrame:
    """L1, L2, squared L2 and largest absolute value of each example's vector."""
    v = F.col("value")
    return features.groupBy("example_id").agg(F.sum(F.abs(v)).alias("l1"), F.sqrt(F.sum(v * v)).alias("l2"), F.sum(v * v).alias("l2_squared"), F.max(F.abs(v)).alias("l_inf"))


def collect(df: DataFrame, config: dict[str, dict] | str) -> dict[str, DataFrame]:
    """Statistics by name from a configuration, as a dictionary or its JSON: {name: {"type": ..., further arguments}}.

    ``Multi`` holds several; ``VectorReduction`` takes a norm of each example's vector first, and its ``targets`` sum up
    that, as their ``value``.
    """
    if isinstance(config, str):
        config = json.loads(config)
    kinds = {"Counter": counter, "Basic": basic, "Tagged": tagged, "LinHist": histogram, "LogHist": lambda *a, **k: histogram(*a, logarithm=True, **k), "TagLinHist": histogram, "TagLogHist": lambda *a, **k: histogram(*a, logarithm=True, **k), "Full": full}
    out = {}
    for name, given in config.items():
        if given["type"] == "Multi":
            out |= {f"{name}.{k}": v for k, v in collect(df, {str(i): x for i, x in enumerate(given["stats"])}).items()}
        elif given["type"] == "VectorReduction":
            reduced = norms(df).withColumnRenamed(given["reduction"], "value")
            out |= {f"{name}.{k}": v for k, v in collect(reduced, {str(i): {"value": "value"} | x for i, x in enumerate(given["targets"])}).items()}
        else:
            out[name] = kinds[given["type"]](df, **{k: v for k, v in given.items() if k != "type"})
    return out


def json_lines(results: dict[str, DataFrame], units: dict[str, str] | None = None) -> DataFrame:
    """(name, line): each row of each statistic as JSON, with its name and unit, to be written as text."""
    rows = [df.select(F.lit(name).alias("name"), F.to_json(F.struct(F.lit(name).alias("stat"), F.lit((units or {}).get(name, "")).alias("unit"), *df.columns)).alias("line")) for name, df in results.items()]
    return reduce(DataFrame.unionByName, rows)
