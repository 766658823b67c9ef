"""Connected components of an edge list, by stars of growing reach, and roots of a forest, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _starred(pairs: DataFrame, name: str) -> DataFrame:
    """Each row's u with the least of u and its neighbours. The minima are written, so a hub's rows can be split in the join."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("least")), name)
    return pairs.join(least, "u").withColumn("m", F.least("u", "least"))


def _flat(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then the v are the roots. True of an empty table."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.agg(F.max((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (u, v) that isn't its component's least; root is that least node.

    Alternates large stars (larger neighbours move to the least of the neighbourhood) and small stars (so do smaller
    ones), each linear in the edges, until all hang on roots: a number of rounds logarithmic in the nodes.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not _flat(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), "edges")
        small = _starred(large, "small")
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def forest_roots(parents: DataFrame) -> DataFrame:
    """``(node, root)`` for each v of ``parents`` (u, v), in which each v stands once, with a lesser u.

    The way up doubles with each round, so there are as many as the logarithm of the deepest one; root is the least node.
    """
    now = written(parents.select(F.col("v").alias("node"), F.col("u").alias("root")), "roots")
    while True:
        further = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        moved = written(moved, "roots")
        now = moved.select("node", "root")
        if not moved.agg(F.max("went")).first()[0]:
            return now
