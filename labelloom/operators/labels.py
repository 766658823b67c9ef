"""Label statistics, propensities and cost weights. ``Y`` tables are (example_id, label_id) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import adapted, propensity
from .transforms import numbered, one_row


def label_counts(labels: DataFrame, universe: DataFrame, meta: DataFrame) -> DataFrame:
    """``(label_id, n_pos, n_neg)`` of every label of ``universe`` (label_id)."""
    counts = labels.groupBy("label_id").agg(F.count("*").alias("n"))
    joined = one_row(universe.select("label_id").join(counts, "label_id", "left"), meta.select("n_examples"))
    return joined.select("label_id", F.coalesce("n", F.lit(0)).alias("n_pos"), (F.col("n_examples") - F.coalesce("n", F.lit(0))).alias("n_neg"))


def instance_labels(labels: DataFrame) -> DataFrame:
    """Labels by example: ``(example_id, labels)``, ascending."""
    return labels.groupBy("example_id").agg(F.sort_array(F.collect_set("label_id")).alias("labels"))


def signed_vector(labels: DataFrame, examples: DataFrame, label: int) -> DataFrame:
    """``(example_id, y)``: 1 where the label is present, else -1."""
    own = labels.filter(F.col("label_id") == label).select("example_id", F.lit(1).alias("there"))
    return examples.select("example_id").join(own, "example_id", "left").select("example_id", F.when(F.col("there").isNull(), -1).otherwise(1).alias("y"))


def summary(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Scalars of the label distribution: (name, value)."""
    row = one_row(counts.agg(F.count("*").alias("labels"), F.max("n_pos").alias("most"), F.min("n_pos").alias("least")), meta.select("n_examples"))
    total = F.col("n_examples").cast("double")
    values = {"num-labels": F.col("labels"), "num-instances": F.col("n_examples"), "most-frequent": F.col("most"), "least-frequent": F.col("least"), "intra-IR-min": total / F.greatest(F.lit(1), "most"), "intra-IR-max": total / F.greatest(F.lit(1), "least"), "inter-IR": F.col("most") / F.greatest(F.lit(1), "least")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()))).alias("x")).select("x.*")


def coverage(counts: DataFrame, step: int = 10) -> DataFrame:
    """How many of the most frequent labels cover each target percentage of all positives: (target, labels, percent).

    At most one target is met at a label. Labels of equal counts are one run, so what is put in order is the distinct counts.
    """
    runs = counts.filter("n_pos > 0").groupBy("n_pos").agg(F.count("*").alias("many"))
    by = Window.orderBy(F.desc("n_pos")).rowsBetween(Window.unboundedPreceding, -1)  # over distinct counts only
    runs = runs.select("n_pos", "many", F.coalesce(F.sum("many").over(by), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("many") * F.col("n_pos")).over(by), F.lit(0)).alias("mass"))
    totals = counts.agg(F.sum("n_pos").alias("total"), F.count("*").alias("n_labels"))
    targets = F.explode(F.sequence(F.lit(step), F.lit(100 - step), F.lit(step))).alias("target")
    met = one_row(runs, totals).select("*", targets)
    hundredth = F.floor(F.col("total") / 100)
    need = F.ceil((F.col("target") * hundredth - F.col("mass")) / F.col("n_pos"))
    met = met.withColumn("need", F.greatest(need, F.lit(1))).filter("need <= many").groupBy("target", "n_labels").agg(F.min(F.col("before") + F.col("need") - 1).alias("at"))
    # a label meets one target: targets met at one label move on by one each
    moved = met.withColumn("place", F.row_number().over(Window.orderBy("target")))  # a row a target
    moved = moved.withColumn("at", F.max(F.col("at") - F.col("place")).over(Window.orderBy("target").rowsBetween(Window.unboundedPreceding, 0)) + F.col("place"))
    return moved.filter(F.col("at") < F.col("n_labels")).select("target", F.col("at").alias("labels"), (100.0 * F.col("at") / F.col("n_labels")).alias("percent"))


LCG = (1103515245, 12345, 1 << 31)


def obesity(counts: DataFrame, draws: int = 10000, seed: int = 1) -> DataFrame:
    """Percentage of draws of four labels (with replacement, sorted by count) whose outer counts sum to more than the inner.

    Draws are by a documented generator: x -> (1103515245 x + 12345) mod 2^31 applied to 4 i + j + seed, twice.
    """
    ranked = numbered(counts.select("label_id", "n_pos"), "n_pos", "label_id", "rank").select("n_pos", "rank")
    total = counts.agg(F.count("*").alias("n_labels"))
    a, c, m = LCG
    turn = lambda x: (x * a + c) % m
    index = one_row(counts.sparkSession.range(draws * 4), total).select((F.col("id") / 4).cast("bigint").alias("draw"), (turn(turn(F.col("id") + seed)).cast("bigint") % F.col("n_labels")).alias("rank"))
    drawn = index.join(ranked, "rank").groupBy("draw").agg(F.sort_array(F.collect_list("n_pos")).alias("v"))
    return drawn.agg((100.0 * F.avg((F.col("v")[0] + F.col("v")[3] > F.col("v")[1] + F.col("v")[2]).cast("double"))).alias("obesity"))


def propensities(counts: DataFrame, meta: DataFrame, a: float = 0.55, b: float = 1.5) -> DataFrame:
    return one_row(counts, meta.select("n_examples")).select("label_id", propensity(F.col("n_pos"), F.col("n_examples"), a, b).alias("p"))


def base_rates(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Estimates by frequency and with a uniform prior: (label_id, frequency, beta)."""
    n = F.col("n_examples")
    return one_row(counts, meta.select("n_examples")).select("label_id", (F.col("n_pos") / n).alias("frequency"), ((F.col("n_pos") + 1) / (n + 1)).alias("beta"))


def split_propensities(train: DataFrame, test: DataFrame, n_train: DataFrame, n_test: DataFrame, mode: str = "individual", a: float = 0.55, b: float = 1.5) -> DataFrame:
    """``(label_id, p_train, p_test)`` from two tables of (label_id, n).

    individual: each from its own; legacy: both with the size of train; joint: both from the sums; frequency and beta:
    the joint propensity adapted to each table's base rate.
    """
    rows = one_row(one_row(train.select("label_id", F.col("n").alias("a")).join(test.select("label_id", F.col("n").alias("b")), "label_id", "full"), n_train.toDF("n_train")), n_test.toDF("n_test"))
    rows = rows.select("label_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in "ab"), "n_train", "n_test")
    x, y, n, m = F.col("a"), F.col("b"), F.col("n_train"), F.col("n_test")
    whole = propensity(x + y, n + m, a, b)
    if mode == "individual":
        p, q = propensity(x, n, a, b), propensity(y, m, a, b)
    elif mode == "legacy":
        p, q = propensity(x, n, a, b), propensity(y, n, a, b)
    elif mode == "joint":
        p = q = whole
    else:
        rate = (lambda k, total: k / total) if mode == "frequency" else lambda k, total: (k + 1) / (total + 1)
        both = rate(x + y, n + m)
        p, q = adapted(whole, both, rate(x, n)), adapted(whole, both, rate(y, m))
    return rows.select("label_id", p.alias("p_train"), q.alias("p_test"))


def cost_weights(p: DataFrame, mode: str, pos: float = 1.0, neg: float = 1.0) -> DataFrame:
    """``(label_id, pos, neg)`` from propensities (label_id, p): constant, 2pm1 (2 / p - 1, 1) or p2mp (1, p / (2 - p))."""
    if pos < 0 or neg < 0:
        raise ValueError("weights must not be negative")
    made = {"constant": (F.lit(pos), F.lit(neg)), "2pm1": (2 / F.col("p") - 1, F.lit(1.0)), "p2mp": (F.lit(1.0), F.col("p") / (2 - F.col("p")))}[mode]
    return p.select("label_id", made[0].cast("double").alias("pos"), made[1].cast("double").alias("neg"))


def custom_weights(universe: DataFrame, given: DataFrame) -> DataFrame:
    """Weights from a table (label_id, pos, neg); 1 where it has none."""
    return universe.select("label_id").join(given, "label_id", "left").select("label_id", F.coalesce("pos", F.lit(1.0)).alias("pos"), F.coalesce("neg", F.lit(1.0)).alias("neg"))
