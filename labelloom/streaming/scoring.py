"""Scoring of examples as they arrive, against a fixed weight table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(packed: DataFrame, weights: DataFrame) -> DataFrame:
    """``(example_id, label_id, score)`` of a stream of rows (example_id, indices, values): a stream-static join, then one aggregation a batch in ``foreachBatch``."""
    entries = packed.select("example_id", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("example_id", F.col("x.indices").alias("feature_id"), F.col("x.values").alias("value"))
    return entries.join(weights, "feature_id").select("example_id", "label_id", (F.col("value") * F.col("w")).alias("part"))


def summed(batch: DataFrame) -> DataFrame:
    return batch.groupBy("example_id", "label_id").agg(F.sum("part").alias("score"))
