"""Starting weights, as tables (label_id, feature_id, w)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import steady_sum
from .transforms import mean_feature, one_row


def constant(universe: DataFrame, columns: DataFrame, value: float = 0.0) -> DataFrame:
    return universe.select("label_id").crossJoin(columns.select("feature_id")).withColumn("w", F.lit(value))


def negative_mean(universe: DataFrame, features: DataFrame, meta: DataFrame) -> DataFrame:
    return universe.select("label_id").crossJoin(mean_feature(features, meta)).select("label_id", "feature_id", (-F.col("mean")).alias("w"))


def bias_only(universe: DataFrame, meta: DataFrame, value: float = -1.0) -> DataFrame:
    """Zero but for the last column; zeros aren't stored."""
    return one_row(universe.select("label_id"), meta.select("n_features")).select("label_id", (F.col("n_features") - 1).alias("feature_id"), F.lit(value).alias("w"))


def positive_means(features: DataFrame, labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label_id").agg(F.count("*").alias("n_pos"))
    sums = features.join(labels, "example_id").groupBy("label_id", "feature_id").agg(steady_sum(F.col("value")).alias("s"))
    return sums.join(sizes, "label_id").select("label_id", "feature_id", "n_pos", (F.col("s") / F.col("n_pos")).alias("mu"))


def mean_separating(features: DataFrame, labels: DataFrame, meta: DataFrame, pos: float = 1.0, neg: float = -2.0) -> DataFrame:
    """w = u mu+ + v mu, so that the label's mean scores ``pos`` and the overall mean its share of ``pos`` and ``neg``.

    Where the two means don't span a plane, u = 0 and v = -1. Labels with the same positive vectors get the same weights,
    so a ranking ties them.
    """
    overall, own = mean_feature(features, meta), positive_means(features, labels)
    mu, mean, eps = F.col("mu"), F.col("mean"), 1.1920929e-07
    joined = own.join(overall, "feature_id")
    dots = joined.groupBy("label_id", "n_pos").agg(steady_sum(mu * mu).alias("pp"), steady_sum(mu * mean).alias("pa"))
    row = one_row(one_row(dots, overall.agg(steady_sum(mean * mean).alias("aa"))), meta.select("n_examples"))
    pp, pa, aa = F.col("pp"), F.col("pa"), F.col("aa")
    row = row.withColumn("d", pa * pa - pp * aa).withColumn("f", F.col("n_pos") / F.col("n_examples") * (pos - neg) + neg)
    flat = (F.abs(pa) < eps) | (F.abs(F.col("d")) < eps)
    row = row.withColumn("u", F.when(flat, 0.0).otherwise((F.col("f") * pa - pos * aa) / F.when(flat, 1.0).otherwise(F.col("d"))))
    row = row.withColumn("v", F.when(flat, -1.0).otherwise((pos - F.col("u") * pp) / F.when(flat, 1.0).otherwise(pa)))
    grid = row.select("label_id", "u", "v").crossJoin(overall)
    return grid.join(own.select("label_id", "feature_id", "mu"), ["label_id", "feature_id"], "left").select("label_id", "feature_id", (F.col("u") * F.coalesce("mu", F.lit(0.0)) + F.col("v") * mean).alias("w"))


def single_positive(features: DataFrame, labels: DataFrame, meta: DataFrame, pos: float = 1.0, neg: float = -2.0, ridge: float = 0.01) -> DataFrame:
    """For labels of one positive example x: w = a mean + b x, from the 2 by 2 ridge Gram system."""
    one = labels.groupBy("label_id").agg(F.count("*").alias("n"), F.min("example_id").alias("example_id")).filter("n = 1").drop("n")
    mean = mean_feature(features, meta)
    x = features.join(one, "example_id").select("label_id", "feature_id", "value")
    dots = x.join(mean, "feature_id").groupBy("label_id").agg(F.sum(F.col("value") * F.col("value")).alias("xx"), F.sum(F.col("value") * F.col("mean")).alias("xm"))
    row = one_row(one_row(dots, mean.agg(F.sum(F.col("mean") * F.col("mean")).alias("mm"))), meta.select("n_examples"))
    f = 1 / F.col("n_examples") * (pos - neg) + neg
    det = (F.col("mm") + ridge) * (F.col("xx") + ridge) - F.col("xm") * F.col("xm")
    row = row.select("label_id", ((f * (F.col("xx") + ridge) - pos * F.col("xm")) / det).alias("a"), ((pos * (F.col("mm") + ridge) - f * F.col("xm")) / det).alias("b"))
    return row.crossJoin(mean).join(x, ["label_id", "feature_id"], "left").select("label_id", "feature_id", (F.col("a") * F.col("mean") + F.col("b") * F.coalesce("value", F.lit(0.0))).alias("w"))


def multi_positive(features: DataFrame, labels: DataFrame, meta: DataFrame, universe: DataFrame, max_pos: int, pos: float = 1.0, neg: float = -2.0, ridge: float = 0.01) -> DataFrame:
    """Labels of at most ``max_pos`` positive examples x_i: w = a_0 (mean - sum x_i / N) + sum a_i x_i, from the ridge Gram system of these vectors with targets ``neg`` and ``pos``.

    All other labels get mean-separating weights.
    """
    sizes = universe.select("label_id").join(labels.groupBy("label_id").agg(F.count("*").alias("n_pos")), "label_id", "left").fillna(0, ["n_pos"])
    few = labels.join(sizes.filter(F.col("n_pos") <= max_pos), "label_id", "left_semi").select("label_id", "example_id")
    many = labels.join(sizes.filter(F.col("n_pos") > max_pos), "label_id", "left_semi")
    mean = mean_feature(features, meta)
    x = features.join(few, "example_id").select("label_id", "example_id", "feature_id", "value")
    y = x.select("label_id", F.col("example_id").alias("other"), "feature_id", F.col("value").alias("value2"))
    pairs = x.join(y, ["label_id", "feature_id"]).groupBy("label_id", "example_id", "other").agg(F.sum(F.col("value") * F.col("value2")).alias("dot"))
    means = x.join(mean, "feature_id").groupBy("label_id", "example_id").agg(F.sum(F.col("value") * F.col("mean")).alias("dot"))
    means = few.join(means, ["label_id", "example_id"], "left").select("label_id", "example_id", F.lit(None).cast("bigint").alias("other"), F.coalesce("dot", F.lit(0.0)).alias("dot"))
    empty = sizes.filter("n_pos = 0").select("label_id", F.lit(None).cast("bigint").alias("example_id"), F.lit(None).cast("bigint").alias("other"), F.lit(0.0).alias("dot"))
    row = one_row(one_row(pairs.unionByName(means).unionByName(empty), mean.agg(F.sum(F.col("mean") * F.col("mean")).alias("mm"))), meta.select("n_examples"))

    def solve(group: pa.Table) -> pa.Table:
        got = group.to_pylist()
        ids = sorted({r["example_id"] for r in got if r["example_id"] is not None})
        at, k, n = {e: i for i, e in enumerate(ids)}, len(ids), got[0]["n_examples"]
        dots, xm = np.zeros((k, k)), np.zeros(k)
        for r in got:
            if r["other"] is not None:
                dots[at[r["example_id"]], at[r["other"]]] = r["dot"]
            elif r["example_id"] is not None:
                xm[at[r["example_id"]]] = r["dot"]
        # as the reference does: of the positives' products with each other only the squares count for the negatives'
        gram = np.empty((k + 1, k + 1))
        gram[0, 0] = got[0]["mm"] + np.trace(dots) / n / n - 2 * xm.sum() / n
        gram[0, 1:] = gram[1:, 0] = xm - dots.sum(0) / n
        gram[1:, 1:] = dots
        a = np.linalg.solve(gram + ridge * np.eye(k + 1), np.array([neg] + [pos] * k))
        return pa.table({"label_id": pa.array([got[0]["label_id"]] * (k + 1), pa.int64()), "example_id": pa.array([None, *ids], pa.int64()), "a": pa.array([a[0], *(a[1:] - a[0] / n)])})

    factors = row.groupBy("label_id").applyInArrow(solve, "label_id long, example_id long, a double")
    common = factors.filter("example_id is null").select("label_id", "a").crossJoin(mean).select("label_id", "feature_id", (F.col("a") * F.col("mean")).alias("w"))
    own = factors.join(x, ["label_id", "example_id"]).select("label_id", "feature_id", (F.col("a") * F.col("value")).alias("w"))
    solved = common.unionByName(own).groupBy("label_id", "feature_id").agg(F.sum("w").alias("w"))
    return solved.unionByName(mean_separating(features, many, meta, pos, neg))


def stacked(dense: DataFrame, sparse: DataFrame, dense_width: int) -> DataFrame:
    """Head from one table, tail from another."""
    return dense.unionByName(sparse.withColumn("feature_id", F.col("feature_id") + dense_width))


def pretrained(universe: DataFrame, weights: DataFrame, bias: DataFrame | None = None, bias_column: int | None = None) -> DataFrame:
    """Saved weights of the labels asked for, with biases (label_id, w) as a last column if given."""
    out = weights.join(universe.select("label_id"), "label_id", "left_semi").select("label_id", "feature_id", "w")
    if bias is None:
        return out
    return out.unionByName(bias.join(universe.select("label_id"), "label_id", "left_semi").select("label_id", F.lit(bias_column).cast("bigint").alias("feature_id"), "w"))
