"""Scores, rankings and their merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steady_sum


def score(features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(example_id, label_id, score)`` of the pairs with a common feature; all others score 0. Labels of equal weights tie."""
    pairs = features.join(weights, "feature_id")
    return pairs.groupBy("example_id", "label_id").agg(steady_sum(F.col("value") * F.col("w")).alias("score"))


CELLS = 1 << 21  # pairs of example and label that a task fills in


def full_scores(scores: DataFrame, examples: DataFrame, universe: DataFrame) -> DataFrame:
    """A score for every example and label: as many rows as the result asks for.

    Examples and the scores there are are dealt by example, and its zeros made there: none of them is shuffled.
    """
    spark = scores.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), examples.count() * universe.count() // CELLS)
    every = examples.select("example_id", F.lit(None).cast("long").alias("label_id"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("_copy"))
    dealt = every.unionByName(scores.select("example_id", F.col("label_id").cast("long").alias("label_id"), F.col("score").cast("double").alias("score"), F.lit(0).alias("_copy"))).repartition(tasks, "example_id")
    labels = universe.agg(F.collect_list(F.col("label_id").cast("long")).alias("_labels"))
    filled = dealt.crossJoin(F.broadcast(labels)).select("example_id", F.explode(F.when(F.col("_copy") > 0, F.col("_labels")).otherwise(F.array("label_id"))).alias("label_id"), "score", "_copy")
    merged = filled.groupBy("example_id", "label_id").agg(F.max("score").alias("score"), F.sum("_copy").alias("_copy")).filter("_copy > 0")
    several = F.when(F.col("_copy") > 1, F.array_repeat(F.lit(1), F.col("_copy").cast("int"))).otherwise(F.array(F.lit(1)))  # rows that share an example
    return merged.select("example_id", "label_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(several).alias("_copy")).drop("_copy")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """``(example_id, rk, label_id, score)``, rk from 0; ties go to the smaller label."""
    by = Window.partitionBy("example_id").orderBy(F.desc("score"), "label_id")
    return scores.withColumn("rk", F.row_number().over(by)).filter(F.col("rk") <= k).select("example_id", (F.col("rk") - 1).cast("bigint").alias("rk"), "label_id", "score")


def padded_top_k(scores: DataFrame, examples: DataFrame, universe: DataFrame, k: int) -> DataFrame:
    """The same, where pairs without a score count as 0, without a row for each pair.

    An example's first k are among its k best scores above 0, the k smallest labels that it has no score for, and its
    other scores. Of these labels, all stand among the first k + (number of its scores) ones.
    """
    by = Window.partitionBy("example_id").orderBy(F.desc("score"), "label_id")
    best = scores.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).drop("nth")
    few = scores.groupBy("example_id").agg(F.count(F.when(F.col("score") > 0, 1)).alias("above"), F.count("*").alias("all"))
    needy = examples.select("example_id").join(few, "example_id", "left").filter(F.coalesce("above", F.lit(0)) < k)
    most = (needy.agg(F.max("all")).first()[0] or 0) + k  # no example needs more labels than that
    ranked = universe.select("label_id").orderBy("label_id").limit(most).select("label_id", F.row_number().over(Window.orderBy("label_id")).alias("nth"))
    wanted = needy.select("example_id", F.explode(F.sequence(F.lit(1), (F.coalesce("all", F.lit(0)) + k).cast("int"))).alias("nth"))
    zeros = wanted.join(ranked, "nth").select("example_id", "label_id").join(scores.select("example_id", "label_id"), ["example_id", "label_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(zeros), k)


def merge_top_k(tables: list[DataFrame], k: int) -> DataFrame:
    """The first k over the rankings of several model parts."""
    return top_k(reduce(DataFrame.unionByName, [t.select("example_id", "label_id", "score") for t in tables]), k)


def threshold_confusion(scores: DataFrame, labels: DataFrame, meta: DataFrame, threshold: float = 0.0) -> DataFrame:
    """TP, FP, TN, FN over all pairs at a threshold, by counts: only scored pairs and true ones are looked at."""
    hit = scores.filter(F.col("score") > threshold)
    joined = hit.join(labels.select("example_id", "label_id", F.lit(1).alias("true")), ["example_id", "label_id"], "left")
    counts = joined.agg(F.count("true").alias("tp"), (F.count("*") - F.count("true")).alias("fp"))
    row = counts.crossJoin(labels.agg(F.count("*").alias("p"))).crossJoin(meta)
    return row.select("tp", "fp", (F.col("n_examples") * F.col("n_labels") - F.col("p") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def report(confusion: DataFrame) -> DataFrame:
    """Percentages with two digits, cut as integers are: accuracy, precision, recall, f1."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    cut = lambda a, b: F.when(b == 0, F.lit(None)).otherwise(F.floor(10000 * a / F.when(b == 0, 1).otherwise(b))) / 100.0
    return confusion.select(cut(tp + tn, tp + fp + tn + fn).alias("accuracy"), cut(tp, tp + fp).alias("precision"), cut(tp, tp + fn).alias("recall"), cut(tp, tp + F.floor((fp + fn) / 2)).alias("f1"))
