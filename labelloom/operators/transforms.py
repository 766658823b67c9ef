"""Feature transforms. ``F`` tables are (example_id, feature_id, value), one row a stored entry."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import steady_sum


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(row.limit(1)))


def numbered(rows: DataFrame, high: str, low: str, name: str, parts: int = 1024) -> DataFrame:
    """``rows`` with their number by (high, low), from 0, as ``name``; ``low`` is a whole number, distinct for each ``high``.

    Rows are ranked within a value of ``high`` and one of ``parts`` stretches of ``low``, on top of the counts of the
    stretches before, so neither a frequent value nor all rows meet in one task.
    """
    edges = rows.agg(F.min(low).alias("_low"), F.max(low).alias("_top"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_top") - F.col("_low") + 1) / parts))
    dealt = one_row(rows, edges).withColumn("_part", F.floor((F.col(low) - F.col("_low")) / width)).drop("_low", "_top")
    before = F.coalesce(F.sum("_n").over(Window.orderBy(high, "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = dealt.groupBy(high, "_part").agg(F.count("*").alias("_n")).select(high, "_part", before.alias("_before"))  # a row a stretch
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(high, "_part").orderBy(low)))
    return ranked.join(per, [high, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_nth") - 1).alias(name))


def augment_bias(features: DataFrame, examples: DataFrame, meta: DataFrame, bias: float = 1.0) -> DataFrame:
    """Appends column n_features with a constant, for every example."""
    column = one_row(examples.select("example_id"), meta.select("n_features")).select("example_id", F.col("n_features").alias("feature_id"), F.lit(bias).alias("value"))
    return features.unionByName(column)


def normalize(features: DataFrame) -> DataFrame:
    """Rows to unit length; zero rows stay."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("example_id")))
    return features.withColumn("norm", norm).select("example_id", "feature_id", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.col("value")).alias("value"))


def mean_feature(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Column sums over the number of all rows."""
    return one_row(features.groupBy("feature_id").agg(steady_sum(F.col("value")).alias("total")), meta).select("feature_id", (F.col("total") / F.col("n_examples")).alias("mean"))


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_id").agg(F.count("*").alias("df"))


def frequency_order(features: DataFrame) -> DataFrame:
    """``(feature_id, new_id)``: columns by ascending count of stored entries, ties by id."""
    return numbered(feature_counts(features), "df", "feature_id", "new_id").select("feature_id", "new_id")


def reorder(table: DataFrame, order: DataFrame) -> DataFrame:
    """Any table with feature_id (features or weights), renumbered."""
    return table.join(order, "feature_id").withColumn("feature_id", F.col("new_id")).drop("new_id")


def transform_values(features: DataFrame, kind: str) -> DataFrame:
    """Elementwise on stored entries."""
    v = F.col("value")
    made = {"identity": v, "log-one-plus": F.log1p(v), "one-plus-log": 1 + F.log(v), "sqrt": F.sqrt(v)}
    return features.withColumn("value", made[kind])


HASH_PRIME = 2147483647


def hash_coefficients(repeats: int, seed: int = 42) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, 1 << 20), draw.randrange(0, 1 << 20)) for _ in range(repeats)]


def hash_features(features: DataFrame, buckets: int, repeats: int = 32, seed: int = 42) -> DataFrame:
    """Sums values into ``buckets`` under each of ``repeats`` hash functions; only positive sums are kept."""
    spots = F.array(*(((F.col("feature_id") * a + b) % HASH_PRIME % buckets + j * buckets).cast("bigint") for j, (a, b) in enumerate(hash_coefficients(repeats, seed))))
    dealt = features.select("example_id", F.explode(spots).alias("feature_id"), "value")
    return dealt.groupBy("example_id", "feature_id").agg(F.sum("value").alias("value")).filter("value > 0")


def shortlist(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows listed in ``chosen`` (label_id, example_id, pos), renumbered by pos for each label."""
    return features.join(chosen, "example_id").select("label_id", F.col("pos").alias("example_id"), "feature_id", "value")


def tf_idf(features: DataFrame, counts: DataFrame | None, meta: DataFrame, whole: bool = True) -> DataFrame:
    """(1 + ln tf) ln(N / df), rows to unit length. ``whole``: N / df is cut to an integer, an unknown df counts as 1; else tf is rounded and zeros drop.

    Without ``counts`` the features have a column df.
    """
    joined = one_row(features if counts is None else features.join(counts, "feature_id", "left"), meta)
    if whole:
        idf = F.log(F.floor(F.col("n_examples") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))).cast("double"))
        tf = F.col("value")
    else:
        idf = F.log(F.col("n_examples") / F.col("df"))
        tf = F.rint("value")
        joined = joined.filter(tf > 0)
    return normalize(joined.select("example_id", "feature_id", ((1 + F.log(tf)) * idf).alias("value")))


def join_blocks(dense: DataFrame, sparse: DataFrame, dense_width: int) -> DataFrame:
    """Dense columns first, sparse ones behind them."""
    return dense.unionByName(sparse.withColumn("feature_id", F.col("feature_id") + dense_width))


def select_labels(labels: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Labels of [start, end), renumbered from 0; a negative end means all."""
    own = labels.filter(F.col("label_id") >= start)
    return (own.filter(F.col("label_id") < end) if end >= 0 else own).withColumn("label_id", F.col("label_id") - start)


def density(features: DataFrame, meta: DataFrame, counted: bool = False) -> DataFrame:
    """``counted``: the table has a row a column, with its number of entries df, in place of a row an entry."""
    nnz = features.agg((F.coalesce(F.sum("df"), F.lit(0)) if counted else F.count("*")).cast("bigint").alias("nnz"))
    return one_row(nnz, meta).select(F.col("n_examples").alias("rows"), F.col("n_features").alias("columns"), "nnz", (100.0 * F.col("nnz") / (F.col("n_examples") * F.col("n_features"))).alias("percent"))


def preprocess(features: DataFrame, examples: DataFrame, meta: DataFrame, buckets: int = 0, repeats: int = 32, kind: str = "identity", unit: bool = False, bias: float | None = None) -> DataFrame:
    """Hashing, transform, normalisation, bias: always in this order."""
    if buckets:
        features = hash_features(features, buckets, repeats)
        meta = meta.withColumn("n_features", F.lit(buckets * repeats).cast("bigint"))
    features = transform_values(features, kind)
    if unit:
        features = normalize(features)
    return features if bias is None else augment_bias(features, examples, meta, bias)
