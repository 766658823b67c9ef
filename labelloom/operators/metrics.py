"""Ranking and confusion metrics. ``pred`` tables are (example_id, rk, label_id) with rk from 0, ``truth`` (example_id, label_id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_div
from .transforms import one_row


def marked(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with ``correct`` 0 or 1."""
    own = truth.select("example_id", "label_id", F.lit(1).alias("t"))
    return pred.join(own, ["example_id", "label_id"], "left").select("example_id", "rk", "label_id", F.coalesce("t", F.lit(0)).alias("correct"))


def _gain(rk: Column) -> Column:
    return 1 / F.log(rk + 2.0)


def instance_metrics(pred: DataFrame, truth: DataFrame, meta: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Means over all examples: (k, name, value) for InstanceP, InstanceDCG, InstancenDCG and Abd. An example without labels has nDCG 0."""
    hits = marked(pred, truth)
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n"), F.col("k")) - 1), F.lit(0.0), lambda s, i: s + 1 / F.log(i + 2.0))
    size = truth.groupBy("example_id").agg(F.count("*").alias("n"))
    rows = hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rk < k")
    per = rows.groupBy("example_id", "k").agg(F.sum("correct").alias("hits"), F.sum(F.when(F.col("correct") == 1, _gain(F.col("rk"))).otherwise(0.0)).alias("dcg"))
    per = per.join(size, "example_id", "left").withColumn("ideal", F.when(F.col("n") > 0, ideal))
    sums = per.groupBy("k").agg(F.sum("hits").alias("h"), F.sum("dcg").alias("d"), F.sum(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("nd"), F.count(F.when(F.col("hits") > 0, 1)).alias("a"))
    n = F.col("n_examples")
    values = {"InstanceP": F.col("h") / (F.col("k") * n), "InstanceDCG": F.col("d") / n, "InstancenDCG": F.col("nd") / n, "Abd": F.col("a") / n}
    return one_row(sums, meta.select("n_examples")).select("k", F.explode(F.array(*(F.struct(F.lit(x).alias("name"), v.alias("value")) for x, v in values.items()))).alias("x")).select("k", "x.*")


def confusion_at_k(pred: DataFrame, truth: DataFrame, universe: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """``(label_id, tp, fp, fn, tn)`` of every label at rank k; a true label outside the first k is a miss."""
    hits = marked(pred.filter(F.col("rk") < k), truth)
    per = hits.groupBy("label_id").agg(F.sum("correct").alias("tp"), F.sum(1 - F.col("correct")).alias("fp"))
    positives = truth.groupBy("label_id").agg(F.count("*").alias("p"))
    rows = one_row(universe.select("label_id").join(per, "label_id", "left").join(positives, "label_id", "left"), meta.select("n_examples"))
    tp, fp, p = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "p"))
    return rows.select("label_id", tp.alias("tp"), fp.alias("fp"), (p - tp).alias("fn"), (F.col("n_examples") - fp - p).alias("tn"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    total, beta = tp + fp + fn + tn, 1.0
    tpr, tnr = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    ppv, npv = safe_div(tp, tp + fp), safe_div(tn, tn + fn)
    fpr, fnr, fdr, fomr = safe_div(fp, fp + tn), safe_div(fn, fn + tp), safe_div(fp, fp + tp), safe_div(fn, fn + tn)
    plus, minus = safe_div(tpr, fpr), safe_div(fnr, tnr)
    f = (1 + beta**2) * tp
    return {
        "P": ppv, "R": tpr, "F1": safe_div(f, f + beta**2 * fn + fp), "ACC": safe_div(tp + tn, total), "BA": (tpr + tnr) / 2, "SPC": tnr, "BM": tpr + tnr - 1, "MK": ppv + npv - 1,
        "FM": F.sqrt(ppv * tpr), "NPV": npv, "MCC": F.sqrt(tpr * tnr * ppv * npv) - F.sqrt(fnr * fpr * fomr * fdr), "LR+": plus, "LR-": minus, "DOR": safe_div(plus, minus),
        "PREV": safe_div(tp + fn, total), "FDR": fdr, "FOR": fomr, "FNR": fnr, "FPR": fpr,
    }


#: Rates of the default report.
SUITE = ("P", "R", "F1", "ACC", "BA", "SPC", "BM", "MK", "FM", "NPV", "MCC", "LR+", "LR-", "DOR")
#: Rates that the reports name; others are there for callers.
RATES = ("P", "R", "F1", "ACC", "BA", "SPC", "BM", "MK", "FM", "NPV", "MCC", "LR+", "LR-", "DOR", "PREV", "FDR", "FOR", "FNR", "FPR")


def reduce_confusion(confusion: DataFrame, how: str, rates: Callable[[Column, Column, Column, Column], dict[str, Column]] = _rates) -> DataFrame:
    """(name, value): micro rates of the summed matrix or macro means of each label's; ``rates`` may be one's own. A rate that is infinite for a label makes the mean so."""
    cells = ("tp", "fp", "fn", "tn")
    if how == "micro":
        rows = confusion.agg(*(F.sum(c).alias(c) for c in cells))
        own = rates(*(F.col(c).cast("double") for c in cells))
        values = rows.select(*(v.alias(k) for k, v in own.items()))
    else:
        own = rates(*(F.col(c).cast("double") for c in cells))
        values = confusion.select(*(v.alias(k) for k, v in own.items())).agg(*(F.avg(f"`{k}`").alias(k) for k in own))
    label = {"micro": "Micro", "macro": "Macro"}[how]
    return values.select(F.explode(F.array(*(F.struct(F.lit(label + k).alias("name"), F.col(f"`{k}`").alias("value")) for k in own))).alias("x")).select("x.*")


def micro_fractions(confusion: DataFrame) -> DataFrame:
    """MicroTP, MicroFP, MicroTN, MicroFN as fractions of all decisions."""
    cells = ("tp", "fp", "tn", "fn")
    row = confusion.agg(*(F.sum(c).cast("double").alias(c) for c in cells))
    total = reduce(Column.__add__, (F.col(c) for c in cells))
    return row.select(F.explode(F.array(*(F.struct(F.lit("Micro" + c.upper()).alias("name"), (F.col(c) / total).alias("value")) for c in cells))).alias("x")).select("x.*")


def coverage_at_k(confusion: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Share of labels whose recall is over the threshold."""
    recall = safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return confusion.agg(F.avg((recall > threshold).cast("double")).alias("coverage"))


def suite(pred: DataFrame, truth: DataFrame, universe: DataFrame, meta: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, name, value): at each k the instance metrics, all rates of ``SUITE`` micro and macro, the summed matrix, coverage.

    The predictions are held against the truth once; the matrices of all k are one table, of ``ks`` rows a label.
    """
    hits = marked(pred.filter(F.col("rk") < max(ks)), truth).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rk < k")
    per = hits.groupBy("k", "label_id").agg(F.sum("correct").alias("tp"), F.sum(1 - F.col("correct")).alias("fp"))
    positives = truth.groupBy("label_id").agg(F.count("*").alias("p"))
    grid = universe.select("label_id").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    rows = one_row(grid.join(per, ["k", "label_id"], "left").join(positives, "label_id", "left"), meta.select("n_examples"))
    tp, fp, p = (F.coalesce(c, F.lit(0)).cast("double") for c in ("tp", "fp", "p"))
    cells = rows.select("k", tp.alias("tp"), fp.alias("fp"), (p - tp).alias("fn"), (F.col("n_examples") - fp - p).alias("tn"))
    names = ("tp", "fp", "fn", "tn")
    own = {n: v for n, v in _rates(*(F.col(c) for c in names)).items() if n in SUITE}
    summed = _rates(*(F.sum(c) for c in names))
    total = reduce(Column.__add__, (F.sum(c) for c in names))
    values = {f"Macro{n}": F.avg(v) for n, v in own.items()} | {f"Micro{n}": summed[n] for n in SUITE} | {f"Micro{c.upper()}": F.sum(c) / total for c in names}
    values["Cov"] = F.avg((safe_div(F.col("tp"), F.col("tp") + F.col("fn")) > 0).cast("double"))
    made = cells.groupBy("k").agg(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items())).alias("x"))
    return made.select("k", F.inline("x")).unionByName(instance_metrics(pred, truth, meta, ks))


def _cumulative(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy("example_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)))


def labelled_metrics(pred: DataFrame, truth: DataFrame, inverse: DataFrame, top: int = 5) -> DataFrame:
    """(name, k, value) in percent over examples that have labels: P, nDCG, PSP, PSnDCG at 1 to ``top``.

    ``inverse`` (label_id, inv): inverse propensities. The propensity-scored ones are ratios of sums. nDCG discounts by the
    natural logarithm, PSnDCG by the binary one.
    """
    known = truth.select("example_id").distinct()
    hits = marked(pred.filter(F.col("rk") < top).join(known, "example_id", "left_semi"), truth).join(inverse, "label_id", "left")
    ln, two = _gain(F.col("rk")), 1 / F.log2(F.col("rk") + 2.0)
    gain = F.when(F.col("correct") == 1, F.coalesce("inv", F.lit(0.0))).otherwise(0.0)
    rows = hits.select("example_id", "rk", F.col("correct").cast("double").alias("h"), (F.col("correct") * ln).alias("d"), gain.alias("s"), (gain * two).alias("sd"))
    for c in ("h", "d", "s", "sd"):
        rows = _cumulative(rows, F.col(c), f"c_{c}")
    # the best order of each example's true labels
    ranked = truth.join(inverse, "label_id", "left").select("example_id", F.coalesce("inv", F.lit(0.0)).alias("inv"), "label_id")
    ranked = ranked.withColumn("rk", (F.row_number().over(Window.partitionBy("example_id").orderBy(F.desc("inv"), "label_id")) - 1).cast("bigint")).filter(F.col("rk") < top)
    sizes = ranked.groupBy("example_id").agg(F.count("*").alias("n"))
    grid = known.join(sizes, "example_id").withColumn("rk", F.explode(F.sequence(F.lit(0), F.lit(top - 1)).cast("array<bigint>")))
    best = grid.join(ranked.select("example_id", "rk", "inv"), ["example_id", "rk"], "left")
    best = best.select("example_id", "rk", F.when(F.col("inv").isNotNull(), ln).otherwise(0.0).alias("bd"), F.coalesce("inv", F.lit(0.0)).alias("bs"), (F.coalesce("inv", F.lit(0.0)) * two).alias("bsd"))
    for c in ("bd", "bs", "bsd"):
        best = _cumulative(best, F.col(c), f"c_{c}")
    sums = best.join(rows, ["example_id", "rk"], "left").groupBy("rk").agg(
        F.sum("c_h").alias("h"), F.sum(F.coalesce(F.col("c_d"), F.lit(0.0)) / F.col("c_bd")).alias("nd"), F.count("*").alias("n"),
        *(F.sum(c).alias(c) for c in ("c_s", "c_bs", "c_sd", "c_bsd")),
    )
    k = F.col("rk") + 1
    values = {"P": F.col("h") / (F.col("n") * k), "nDCG": F.col("nd") / F.col("n"), "PSP": F.col("c_s") / F.col("c_bs"), "PSnDCG": F.col("c_sd") / F.col("c_bsd")}
    return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), k.alias("k"), (100 * v).alias("value")) for x, v in values.items()))).alias("x")).select("x.*")
