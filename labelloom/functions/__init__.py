"""Column functions: margin losses, penalties, propensities, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """num / den; 0 where num is 0 (even 0/0), infinite where only den is 0."""
    return F.when(num == 0, F.lit(0.0)).when(den == 0, F.when(num > 0, float("inf")).otherwise(float("-inf"))).otherwise(num / F.when(den == 0, F.lit(1.0)).otherwise(den))


def steady_sum(x: Column) -> Column:
    """The sum, for terms of usual sizes the same to the last bit whatever the order of rows.

    Groups of equal terms have equal sums then, as the weights of two labels with equal positives must. Terms are cut at
    multiples of 2**-20 and 2**-44: the sums of both parts are exact below 2**33 and for 2**30 terms, and what is left is
    too small to change the last bit but by a rare chance. Terms of 2**31 or more are summed as usual.
    """
    near = F.abs(x) < 2.0**31  # neither infinite nor NaN
    cut = lambda v, digits: (v + 1.5 * 2.0 ** (52 - digits)) - 1.5 * 2.0 ** (52 - digits)
    high = F.when(near, cut(x, 20)).otherwise(x)
    rest = F.when(near, x - cut(x, 20)).otherwise(0.0)
    return F.sum(high) + (F.sum(cut(rest, 44)) + F.sum(rest - cut(rest, 44)))


# -- margin losses: value, slope, curvature at margin m ------------------------------------------------------------
def squared_hinge(m: Column) -> tuple[Column, Column, Column]:
    v = F.greatest(F.lit(0.0), 1 - m)
    return v * v, -2 * v, F.when(m < 1, 2.0).otherwise(0.0)


def huber_hinge(m: Column, eps: float = 1.0) -> tuple[Column, Column, Column]:
    v = F.greatest(F.lit(0.0), 1 - m)
    far = v > eps
    return (
        F.when(far, v - eps / 2).otherwise(v * v / (2 * eps)),
        F.when(far, -1.0).otherwise(-v / eps),
        F.when(far, 1 / F.greatest(v, F.lit(eps))).when(v > 0, 1 / eps).otherwise(0.0),
    )


def logistic(m: Column) -> tuple[Column, Column, Column]:
    e = F.exp(-F.abs(m))  # never overflows
    value = F.greatest(F.lit(0.0), -m) + F.log1p(e)
    down = F.when(m >= 0, e / (1 + e)).otherwise(1 / (1 + e))  # 1 / (1 + exp(m))
    return value, -down, down * (1 - down)


LOSSES = {"squared-hinge": squared_hinge, "logistic": logistic, "huber-hinge": lambda m: huber_hinge(m, 1.0), "hinge": lambda m: huber_hinge(m, 0.1)}


# -- pointwise penalties: value, slope, curvature at weight w -------------------------------------------------------
def l2(w: Column) -> tuple[Column, Column, Column]:
    return w * w / 2, w, F.lit(1.0)


def huber(w: Column, eps: float) -> tuple[Column, Column, Column]:
    a = F.abs(w)
    far = a > eps
    return F.when(far, a - eps / 2).otherwise(w * w / (2 * eps)), F.when(far, F.signum(w)).otherwise(w / eps), F.when(far, 1 / F.greatest(a, F.lit(eps))).otherwise(0.5 / eps)


def elastic(w: Column, eps: float, share: float) -> tuple[Column, Column, Column]:
    """``share`` of squared penalty, the rest Huber."""
    h, q = huber(w, eps), l2(w)
    return tuple((1 - share) * a + share * b for a, b in zip(h, q, strict=True))


PENALTIES = {
    "l2": l2,
    "l1": lambda w: huber(w, 0.01),
    "l1-relaxed": lambda w: huber(w, 0.1),
    "huber": lambda w: huber(w, 1.0),
    "elastic-50-50": lambda w: elastic(w, 0.1, 0.5),
    "elastic-90-10": lambda w: elastic(w, 0.1, 0.9),
}


# -- propensities ---------------------------------------------------------------------------------------------------
def propensity(n: Column, total: Column, a: float = 0.55, b: float = 1.5) -> Column:
    """The chance that a true label of ``n`` of ``total`` examples was recorded."""
    c = (F.log(total) - 1) * (b + 1) ** a
    return 1 / (1 + c * F.exp(-a * F.log(n + b)))


def adapted(p: Column, missing: Column, marginal: Column) -> Column:
    """A propensity adapted from one base rate to another."""
    return marginal * (1 - missing) / (p * (marginal - missing) + missing * (1 - marginal)) * p
