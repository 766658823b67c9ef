"""Loss, gradient and curvature of one-vs-all linear objectives at a given weight table, as aggregations.

``M`` tables hold margins: (label_id, example_id, y, score, c), one row a pair that counts, with y = 1 or -1 and cost c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import LOSSES, PENALTIES
from .scoring import score
from .transforms import one_row


def margins(features: DataFrame, labels: DataFrame, weights: DataFrame, examples: DataFrame, costs: DataFrame) -> DataFrame:
    """Scores of all examples for the labels of ``costs`` (label_id, pos, neg): as many rows as the objective has terms."""
    grid = examples.select("example_id").crossJoin(costs)
    own = labels.select("example_id", "label_id", F.lit(1).alias("there"))
    rows = grid.join(score(features, weights), ["example_id", "label_id"], "left").join(own, ["example_id", "label_id"], "left")
    y = F.when(F.col("there").isNull(), -1.0).otherwise(1.0)
    return rows.select("label_id", "example_id", y.alias("y"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("there").isNull(), F.col("neg")).otherwise(F.col("pos")).alias("c"))


def update_costs(margin: DataFrame, costs: DataFrame) -> DataFrame:
    """Margins with costs from another table (label_id, pos, neg)."""
    return margin.drop("c").join(costs, "label_id").select("label_id", "example_id", "y", "score", F.when(F.col("y") > 0, F.col("pos")).otherwise(F.col("neg")).alias("c"))


def penalty(weights: DataFrame, kind: str = "l2", strength: float = 1.0, ignore: int | None = None) -> DataFrame:
    """``(label_id, penalty)``; feature ``ignore`` (the bias) is free."""
    own = weights if ignore is None else weights.filter(F.col("feature_id") != ignore)
    return own.groupBy("label_id").agg((strength * F.sum(PENALTIES[kind](F.col("w"))[0])).alias("penalty"))


def loss_value(margin: DataFrame, weights: DataFrame, loss: str = "squared-hinge", kind: str = "l2", strength: float = 1.0, ignore: int | None = None) -> DataFrame:
    """``(label_id, loss)``: costs times margin losses, plus the penalty."""
    value = LOSSES[loss](F.col("y") * F.col("score"))[0]
    sums = margin.groupBy("label_id").agg(F.sum(F.col("c") * value).alias("loss"))
    return sums.join(penalty(weights, kind, strength, ignore), "label_id", "left").select("label_id", (F.col("loss") + F.coalesce("penalty", F.lit(0.0))).alias("loss"))


def active(margin: DataFrame) -> DataFrame:
    """The pairs within the hinge's margin; others add nothing to its loss or slopes."""
    return margin.filter(1 - F.col("y") * F.col("score") > 0)


def gradient(features: DataFrame, margin: DataFrame, weights: DataFrame, loss: str = "squared-hinge", kind: str = "l2", strength: float = 1.0, ignore: int | None = None) -> DataFrame:
    """``(label_id, feature_id, g, h)``: gradient and diagonal of the Hessian in one pass. Pairs without slope or curvature are dropped first."""
    _, slope, curve = LOSSES[loss](F.col("y") * F.col("score"))
    terms = margin.select("label_id", "example_id", (F.col("c") * F.col("y") * slope).alias("d"), (F.col("c") * curve).alias("q")).filter("d <> 0 OR q <> 0")
    sums = features.join(terms, "example_id").groupBy("label_id", "feature_id").agg(F.sum(F.col("d") * F.col("value")).alias("d"), F.sum(F.col("q") * F.col("value") * F.col("value")).alias("q"))
    w = F.coalesce("w", F.lit(0.0))
    _, s, c = PENALTIES[kind](w)
    free = F.lit(False) if ignore is None else F.col("feature_id") == ignore
    joined = sums.join(weights, ["label_id", "feature_id"], "full")
    return joined.select("label_id", "feature_id", (F.coalesce("d", F.lit(0.0)) + F.when(free, 0.0).otherwise(strength * s)).alias("g"), (F.coalesce("q", F.lit(0.0)) + F.when(free, 0.0).otherwise(strength * c)).alias("h"))


def gradient_at_zero(features: DataFrame, labels: DataFrame, costs: DataFrame, loss: str = "squared-hinge") -> DataFrame:
    """The gradient with all weights 0, from two column sums: of all examples and of each label's own. No pair of example and label is formed but the true ones."""
    slope = LOSSES[loss](F.lit(0.0))[1]
    every = features.groupBy("feature_id").agg(F.sum("value").alias("total"))
    own = features.join(labels, "example_id").groupBy("label_id", "feature_id").agg(F.sum("value").alias("positive"))
    rows = every.crossJoin(costs).join(own, ["label_id", "feature_id"], "left")
    p = F.coalesce("positive", F.lit(0.0))
    return rows.select("label_id", "feature_id", (slope * (F.col("pos") * p - F.col("neg") * (F.col("total") - p))).alias("g"))


def hessian_times(features: DataFrame, margin: DataFrame, direction: DataFrame, loss: str = "squared-hinge", strength: float = 1.0) -> DataFrame:
    """``(label_id, feature_id, hd)`` for a direction (label_id, feature_id, w), with the squared penalty."""
    curve = LOSSES[loss](F.col("y") * F.col("score"))[2]
    terms = margin.select("label_id", "example_id", (F.col("c") * curve).alias("q")).filter("q <> 0")
    terms = terms.join(score(features, direction).withColumnRenamed("score", "xd"), ["label_id", "example_id"]).select("label_id", "example_id", (F.col("q") * F.col("xd")).alias("t"))
    sums = features.join(terms, "example_id").groupBy("label_id", "feature_id").agg(F.sum(F.col("t") * F.col("value")).alias("hd"))
    return sums.join(direction, ["label_id", "feature_id"], "full").select("label_id", "feature_id", (F.coalesce("hd", F.lit(0.0)) + strength * F.coalesce("w", F.lit(0.0))).alias("hd"))


def line_values(margin: DataFrame, along: DataFrame, steps: list[float], loss: str = "squared-hinge") -> DataFrame:
    """``(label_id, t, loss)`` of the data term at w + t d, from cached products: ``along`` is (label_id, example_id, xd)."""
    rows = margin.join(along, ["label_id", "example_id"], "left").withColumn("t", F.explode(F.array(*map(F.lit, steps))))
    moved = F.col("y") * (F.col("score") + F.col("t") * F.coalesce("xd", F.lit(0.0)))
    return rows.groupBy("label_id", "t").agg(F.sum(F.col("c") * LOSSES[loss](moved)[0]).alias("loss"))


def armijo(values: DataFrame, start: DataFrame, slope: DataFrame, eta: float = 0.01) -> DataFrame:
    """The largest step t of ``values`` (label_id, t, loss) with loss <= start + eta t slope; 0 if none."""
    rows = values.join(start.select("label_id", F.col("loss").alias("f0")), "label_id").join(slope, "label_id")
    good = F.col("loss") <= F.col("f0") + eta * F.col("t") * F.col("slope")
    return rows.groupBy("label_id").agg(F.coalesce(F.max(F.when(good, F.col("t"))), F.lit(0.0)).alias("step"))


def block_penalty(weights: DataFrame, dense_width: int, dense_strength: float, sparse_strength: float) -> DataFrame:
    """Penalty and slopes of a dense block and the sparse one behind it, each s w^2 without a half: (label_id, feature_id, value, slope, curve)."""
    s = F.when(F.col("feature_id") < dense_width, dense_strength).otherwise(sparse_strength)
    return weights.select("label_id", "feature_id", (s * F.col("w") * F.col("w")).alias("value"), (2 * s * F.col("w")).alias("slope"), (2 * s).alias("curve"))


def scaled_tolerance(counts: DataFrame, meta: DataFrame, eps: float = 0.01) -> DataFrame:
    """Stopping tolerance by label: eps max(min(pos, neg), 1) / N."""
    return one_row(counts, meta.select("n_examples")).select("label_id", (eps * F.greatest(F.least("n_pos", "n_neg"), F.lit(1)) / F.col("n_examples")).alias("eps"))
