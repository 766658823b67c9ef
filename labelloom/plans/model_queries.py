"""Queries around models: starting weights, objectives, training, scoring, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import initial, metrics, objective, scoring, training
from ..operators import labels as lab
from ..operators import transforms as tr
from ..sources import formats
from ..sources.files import Dataset
from . import datasets as ds
from .datasets import EMB, ORD
from .registry import query
from .table_queries import _COUNTS, _jain, _sql, rounded

# -- starting weights -----------------------------------------------------------------------------------------------
MSI = """,
mean as (select feature_id, sum(value) / any_value(n_examples) as mean from emb_f, emb_m group by 1),
sizes as (select label_id, count(*) as n_pos from emb_y group by 1),
mus as (select label_id, feature_id, any_value(n_pos) as n_pos, sum(value) / any_value(n_pos) as mu from emb_f join emb_y using (example_id) join sizes using (label_id) group by 1, 2),
dots as (select label_id, any_value(n_pos) as n_pos, sum(mu * mu) as pp, sum(mu * mean) as pa, (select sum(mean * mean) from mean) as aa from mus join mean using (feature_id) group by 1),
uvd as (select *, pa * pa - pp * aa as d, n_pos / n_examples::double * 3.0 - 2.0 as f from dots, emb_m),
uv0 as (select *, case when abs(pa) < 1.1920929e-07 or abs(d) < 1.1920929e-07 then 0 else (f * pa - aa) / d end as u from uvd),
uv as (select label_id, u, case when abs(pa) < 1.1920929e-07 or abs(d) < 1.1920929e-07 then -1 else (1 - u * pp) / pa end as v from uv0),
w as (select uv.label_id, mean.feature_id, u * coalesce(mu, 0) + v * mean as w from uv cross join mean left join mus on mus.label_id = uv.label_id and mus.feature_id = mean.feature_id)"""
SCORES = MSI + """,
scores as (select example_id, label_id, sum(value * w) as score from emb_f join w using (feature_id) group by 1, 2),
top as (select * from (select example_id, row_number() over (partition by example_id order by score desc, label_id) - 1 as rk, label_id, score from scores) where rk < 5)"""


def _model(spark: SparkSession, sf: str) -> tuple[Dataset, DataFrame]:
    d = ds.embeddings(spark, sf)
    return d, initial.mean_separating(d.features, d.labels, d.meta)


@query("ini_04_mean_separating", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w"))
def ini_04(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_model(spark, sf)[1], "w")


@query("ini_01_zero", _sql(EMB, "select label_id, feature_id, 0.0::double as w from emb_l, (select unnest(range(0, 64))::bigint as feature_id)"))
def ini_01(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    return initial.constant(ds.universe(d), ds.columns(d))


@query("ini_02_negative_mean", _sql(EMB, "select label_id, feature_id, round(-m, 6) as w from emb_l, (select feature_id, sum(value) / any_value(n_examples) as m from emb_f, emb_m group by 1)"))
def ini_02(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    return rounded(initial.negative_mean(ds.universe(d), d.features, d.meta), "w")


@query("ini_03_bias", _sql(EMB, "select label_id, n_features - 1 as feature_id, -1.0::double as w from emb_l, emb_m"))
def ini_03(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    return initial.bias_only(ds.universe(d), d.meta)


@query("ini_05_single_positive", _sql(EMB + ", one as (select example_id as label_id, example_id from emb_x), mean as (select feature_id, sum(value) / any_value(n_examples) as mean from emb_f, emb_m group by 1), x as (select label_id, feature_id, value from emb_f join one using (example_id)), g as (select label_id, sum(value * value) + 0.01 as xx, sum(value * mean) as xm, (select sum(mean * mean) from mean) + 0.01 as mm, 1 / any_value(n_examples)::double * 3.0 - 2.0 as f from x join mean using (feature_id), emb_m group by 1)", "select label_id, feature_id, round((f * xx - xm) / (mm * xx - xm * xm) * mean + (mm - f * xm) / (mm * xx - xm * xm) * value, 6) as w from g join x using (label_id) join mean using (feature_id)"))
def ini_05(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is the one positive of a label of its own."""
    d = ds.embeddings(spark, sf)
    labels = d.examples.select("example_id", F.col("example_id").alias("label_id"))
    return rounded(initial.single_positive(d.features, labels, d.meta), "w")


@query("ini_05_multi_positive", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w"))
def ini_05_multi(spark: SparkSession, sf: str) -> DataFrame:
    """All labels; those of the tables have more positives than the limit. The tests hold smaller ones against a dense solution."""
    d = ds.embeddings(spark, sf)
    return rounded(initial.multi_positive(d.features, d.labels, d.meta, ds.universe(d), 1), "w")


@query("ini_07_pretrained", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w where label_id >= 3 and label_id < 6"))
def ini_07(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(initial.pretrained(ds.universe(d).filter("label_id between 3 and 5"), w), "w")


@query("ini_08_weights_and_bias", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w union all select label_id, 64, -0.5::double from emb_l"))
def ini_08(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(initial.pretrained(ds.universe(d), w, ds.universe(d).withColumn("w", F.lit(-0.5)), 64), "w")


@query("ini_09_stacked", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w union all select label_id, feature_id + 64, round(w, 6) from w where feature_id < 3"))
def ini_09(spark: SparkSession, sf: str) -> DataFrame:
    _, w = _model(spark, sf)
    return rounded(initial.stacked(w, w.filter("feature_id < 3"), 64), "w")


# -- objective ------------------------------------------------------------------------------------------------------
_PHI = {
    "squared-hinge": ("pow(greatest(0, 1 - m), 2)", "-2 * greatest(0, 1 - m)", "case when m < 1 then 2 else 0 end"),
    "huber-hinge": ("case when 1 - m > 1 then 1 - m - 0.5 else pow(greatest(0, 1 - m), 2) / 2 end", "case when 1 - m > 1 then -1 else -greatest(0, 1 - m) end", "case when 1 - m > 1 then 1 / (1 - m) when m < 1 then 1 else 0 end"),
    "hinge": ("case when 1 - m > 0.1 then 1 - m - 0.05 else pow(greatest(0, 1 - m), 2) / 0.2 end", "case when 1 - m > 0.1 then -1 else -greatest(0, 1 - m) / 0.1 end", "case when 1 - m > 0.1 then 1 / (1 - m) when m < 1 then 10 else 0 end"),
    "logistic": ("greatest(0, -m) + ln(1 + exp(-abs(m)))", "-1 / (1 + exp(m))", "exp(-abs(m)) / pow(1 + exp(-abs(m)), 2)"),
}
# costs: propensity up-weighting by the label's share
_MARGINS = SCORES + f""",
cost as (select label_id, 2 / ({_jain('n_pos', 'n_examples')}) - 1 as pos, 1.0 as neg from sizes, emb_m),
margin as (select s.label_id, s.example_id, case when y.label_id is null then -1.0 else 1.0 end as y, score, case when y.label_id is null then neg else pos end as c, (case when y.label_id is null then -1.0 else 1.0 end) * score as m
    from scores s join cost using (label_id) left join emb_y y on y.example_id = s.example_id and y.label_id = s.label_id)"""


def _margins(spark: SparkSession, sf: str) -> tuple[Dataset, DataFrame, DataFrame]:
    d, w = _model(spark, sf)
    counts = lab.label_counts(d.labels, ds.universe(d), d.meta)
    costs = lab.cost_weights(lab.propensities(counts, d.meta), "2pm1")
    return d, w, objective.margins(d.features, d.labels, w, d.examples, costs)


for _loss, (_value, _slope, _curve) in _PHI.items():
    _name = _loss.replace("-", "_")
    query(f"obj_04_loss_{_name}", _sql(EMB + _MARGINS, f"select label_id, round(sum(c * ({_value})) + (select sum(w * w) / 2 from w where w.label_id = margin.label_id), 5) as loss from margin group by label_id"))(
        lambda spark, sf, loss=_loss: (lambda d, w, m: rounded(objective.loss_value(m, w, loss), "loss", digits=5))(*_margins(spark, sf))
    )
    query(f"obj_05_gradient_{_name}", _sql(EMB + _MARGINS + f", t as (select label_id, example_id, c * y * ({_slope}) as d, c * ({_curve}) as q from margin)", "select label_id, feature_id, round(sum(d * value) + any_value(w), 5) as g, round(sum(q * value * value) + 1, 5) as h from emb_f join t using (example_id) join w using (label_id, feature_id) group by 1, 2"))(
        lambda spark, sf, loss=_loss: (lambda d, w, m: rounded(objective.gradient(d.features, m, w, loss), "g", "h", digits=5))(*_margins(spark, sf))
    )


@query("obj_06_gradient_at_zero", _sql(EMB + _MARGINS, "select label_id, feature_id, round(sum(-2 * c * y * value), 5) as g from emb_f join margin using (example_id) group by 1, 2"))
def obj_06(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    costs = lab.cost_weights(lab.propensities(lab.label_counts(d.labels, ds.universe(d), d.meta), d.meta), "2pm1")
    return rounded(objective.gradient_at_zero(d.features, d.labels, costs), "g", digits=5)


@query("obj_07_hessian_times", _sql(EMB + _MARGINS + ", t as (select label_id, example_id, c * (case when m < 1 then 2 else 0 end) * score as t from margin)", "select label_id, feature_id, round(sum(t * value) + any_value(w), 5) as hd from emb_f join t using (example_id) join w using (label_id, feature_id) group by 1, 2"))
def obj_07(spark: SparkSession, sf: str) -> DataFrame:
    d, w, m = _margins(spark, sf)
    return rounded(objective.hessian_times(d.features, m, w), "hd", digits=5)


_STEPS = [1.0, 0.5, 0.25, 0.125]


@query("obj_10_line_values", _sql(EMB + _MARGINS, "select label_id, t::double as t, round(sum(c * pow(greatest(0, 1 - y * (score - t * score)), 2)), 5) as loss from margin, (select unnest([1.0, 0.5, 0.25, 0.125]) as t) group by 1, 2"))
def obj_10(spark: SparkSession, sf: str) -> DataFrame:
    _, _, m = _margins(spark, sf)
    along = m.select("label_id", "example_id", (-F.col("score")).alias("xd"))
    return rounded(objective.line_values(m, along, _STEPS), "loss", digits=5)


@query("obj_11_active_set", _sql(EMB + _MARGINS, "select label_id, count(*) as n from margin where 1 - m > 0 group by 1"))
def obj_11(spark: SparkSession, sf: str) -> DataFrame:
    return objective.active(_margins(spark, sf)[2]).groupBy("label_id").agg(F.count("*").alias("n"))


@query("obj_12_update_costs", _sql(EMB + _MARGINS, "select label_id, sum(case when y > 0 then label_id + 2.0 else 0.5 end)::double as total from margin group by 1"))
def obj_12(spark: SparkSession, sf: str) -> DataFrame:
    d, _, m = _margins(spark, sf)
    costs = ds.universe(d).select("label_id", (F.col("label_id") + 2.0).alias("pos"), F.lit(0.5).alias("neg"))
    return objective.update_costs(m, costs).groupBy("label_id").agg(F.sum("c").alias("total"))


@query("obj_13_block_penalty", _sql(EMB + MSI, "select label_id, feature_id, round(s * w * w, 6) as value, round(2 * s * w, 6) as slope, (2 * s)::double as curve from (select *, case when feature_id < 32 then 0.5 else 2.0 end as s from w)"))
def obj_13(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(objective.block_penalty(_model(spark, sf)[1], 32, 0.5, 2.0), "value", "slope")


_HUBER = lambda e: f"case when abs(w) > {e} then abs(w) - {e} / 2 else w * w / (2 * {e}) end"
for _kind, _text in {"l2": "w * w / 2", "l1": _HUBER("0.01::double"), "l1-relaxed": _HUBER("0.1::double"), "huber": _HUBER("1.0::double"), "elastic-50-50": f"0.5 * ({_HUBER('0.1::double')}) + 0.5 * w * w / 2", "elastic-90-10": f"(1 - 0.9::double) * ({_HUBER('0.1::double')}) + 0.9::double * w * w / 2"}.items():
    query(f"reg_{_kind.replace('-', '_')}", _sql(EMB + MSI, f"select label_id, round(2 * sum({_text}), 5) as penalty from w where feature_id <> 63 group by 1"))(
        lambda spark, sf, kind=_kind: rounded(objective.penalty(_model(spark, sf)[1], kind, 2.0, 63), "penalty", digits=5)
    )


@query("sol_03_armijo", _sql(EMB + _MARGINS + """,
f as (select label_id, sum(c * pow(greatest(0, 1 - m), 2)) as f0, sum(c * y * (-2 * greatest(0, 1 - m)) * -score) as slope from margin group by 1),
v as (select label_id, t, sum(c * pow(greatest(0, 1 - y * (score - t * score)), 2)) as loss from margin, (select unnest([1.0, 0.5, 0.25, 0.125]) as t) group by 1, 2)""", "select label_id, coalesce(max(case when loss <= f0 + 0.01 * t * slope then t end), 0)::double as step from v join f using (label_id) group by 1"))
def sol_03(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import LOSSES

    _, _, m = _margins(spark, sf)
    along = m.select("label_id", "example_id", (-F.col("score")).alias("xd"))
    value, slope, _ = LOSSES["squared-hinge"](F.col("y") * F.col("score"))
    base = m.groupBy("label_id").agg(F.sum(F.col("c") * value).alias("loss"), F.sum(F.col("c") * F.col("y") * slope * -F.col("score")).alias("slope"))
    return objective.armijo(objective.line_values(m, along, _STEPS), base.select("label_id", "loss"), base.select("label_id", "slope"))


@query("trn_01_scaled_tolerance", _sql(ORD + _COUNTS, "select label_id, round(0.01 * greatest(least(n_pos, n_neg), 1) / total, 9)::double as eps from n"))
def trn_01(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.orders(spark, sf)
    return rounded(objective.scaled_tolerance(lab.label_counts(d.labels, ds.universe(d), d.meta), d.meta), "eps", digits=9)


# -- training -------------------------------------------------------------------------------------------------------
def _certificate(d: Dataset, result: DataFrame, costs: DataFrame, tolerance: float, strength: float = 1.0, loss: str = "squared-hinge", kind: str = "l2") -> DataFrame:
    """Whether the relational gradient at the trained weights is as small as asked for, against that at zero, by label."""
    w = training.weights_of(result)
    m = objective.margins(d.features, d.labels, w, d.examples, costs)
    length = lambda g: g.groupBy("label_id").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("g"))
    now = length(objective.gradient(d.features, m, w, loss, kind, strength))
    zero = length(objective.gradient_at_zero(d.features, d.labels, costs, loss)).withColumnRenamed("g", "g0")
    return result.select("label_id", "n_pos").join(now, "label_id").join(zero, "label_id").select("label_id", "n_pos", (F.col("g") <= tolerance * F.col("g0")).alias("converged"))


def _ones(d: Dataset) -> DataFrame:
    return ds.universe(d).select("label_id", F.lit(1.0).alias("pos"), F.lit(1.0).alias("neg"))


_CONVERGED = _sql(EMB, "select label_id, count(*) as n_pos, true as converged from emb_y group by 1")


@query("sol_01_newton", _CONVERGED)
def sol_01(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    result = training.train(d.features, d.labels, ds.universe(d), d.examples, 64, _ones(d), training.Options(eps=0.001, scale_eps=False)).persist()
    return _certificate(d, result, _ones(d), 0.01)


for _loss in ("logistic", "huber-hinge", "hinge"):
    query(f"sol_01_newton_{_loss.replace('-', '_')}", _CONVERGED)(
        lambda spark, sf, loss=_loss: (lambda d: _certificate(d, training.train(d.features, d.labels, ds.universe(d), d.examples, 64, _ones(d), training.Options(eps=0.001, scale_eps=False, loss=loss)).persist(), _ones(d), 0.01, loss=loss))(ds.embeddings(spark, sf))
    )
for _kind in ("huber", "elastic-50-50", "elastic-90-10"):
    query(f"sol_01_newton_{_kind.replace('-', '_')}_penalty", _CONVERGED)(
        lambda spark, sf, kind=_kind: (lambda d: _certificate(d, training.train(d.features, d.labels, ds.universe(d), d.examples, 64, _ones(d), training.Options(eps=0.001, scale_eps=False, penalty=kind)).persist(), _ones(d), 0.01, kind=kind))(ds.embeddings(spark, sf))
    )


@query("sol_04_unchanged", _sql(EMB + _MARGINS + ", one as (select label_id, sum(pow(greatest(0, 1 - m), 2)) as data from margin group by 1)", "select label_id, round(data + (select sum(w * w) / 2 from w where w.label_id = one.label_id), 4) as loss, 0 as steps from one"))
def sol_04(spark: SparkSession, sf: str) -> DataFrame:
    """The optimiser that does nothing tells the loss of the weights it is given."""
    d, w = _model(spark, sf)
    result = training.train(d.features, d.labels, ds.universe(d), d.examples, 64, _ones(d), training.Options(optimise=False), start=w)
    return rounded(result.select("label_id", "loss", "steps"), "loss", digits=4)


@query("trn_03_weighted_msi_start", _CONVERGED)
def trn_03(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    costs = lab.cost_weights(lab.propensities(lab.label_counts(d.labels, ds.universe(d), d.meta), d.meta), "2pm1")
    result = training.train(d.features, d.labels, ds.universe(d), d.examples, 64, costs, training.Options(eps=0.001, scale_eps=False), start=w).persist()
    return _certificate(d, result, costs, 0.01)


@query("trn_04_resumed_buckets", _sql(EMB, "select label_id, count(*) as n_pos from emb_y group by 1"))
def trn_04(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    run = lambda u: training.train(d.features, d.labels, u, d.examples, 64, _ones(d)).select("label_id", "n_pos")
    first = run(ds.universe(d).filter("label_id < 4"))
    return first.unionByName(run(training.remaining(ds.universe(d), ds.universe(d).filter("label_id < 4"))))


@query("trn_05_cascade_shortlist", _sql(EMB, "select label_id, count(*) as n_pos, true as converged from emb_y group by 1"))
def trn_05(spark: SparkSession, sf: str) -> DataFrame:
    """Two blocks with strengths of their own, on each label's shortlist; the relational gradient over the shortlist tells whether it ended well."""
    d = ds.embeddings(spark, sf)
    both = tr.join_blocks(d.features, d.examples.select("example_id", (F.col("example_id") % 7).alias("feature_id"), F.lit(1.0).alias("value")), 64)
    chosen = d.labels.select("label_id", "example_id").unionByName(ds.universe(d).crossJoin(d.examples).filter("(example_id + label_id) % 3 = 0").select("label_id", "example_id")).distinct()
    # each block's penalty is s w^2 without a half, so twice the strength of the kernel's
    result = training.train(both, d.labels, ds.universe(d), d.examples, 71, _ones(d), training.Options(eps=0.001, scale_eps=False, strength=1.0, tail=64, tail_strength=4.0), shortlist=chosen).persist()
    w = training.weights_of(result)
    m = objective.margins(both, d.labels, w, d.examples, _ones(d)).join(chosen, ["label_id", "example_id"], "left_semi")
    data = objective.gradient(both, m, w, strength=0.0).join(objective.block_penalty(w, 64, 0.5, 2.0).select("label_id", "feature_id", "slope"), ["label_id", "feature_id"], "left").withColumn("g", F.col("g") + F.coalesce("slope", F.lit(0.0)))
    at_zero = objective.gradient(both, m.withColumn("score", F.lit(0.0)), w.filter("false"), strength=0.0)
    length = lambda g, name: g.groupBy("label_id").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias(name))
    both_ = result.select("label_id", "n_pos").join(length(data, "g"), "label_id").join(length(at_zero, "g0"), "label_id")
    return both_.select("label_id", "n_pos", (F.col("g") <= 0.01 * F.col("g0")).alias("converged"))


@query("ini_06_all_negative_start", _sql(EMB, "select label_id, true as ended from emb_l"))
def ini_06(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.embeddings(spark, sf)
    u = ds.universe(d)
    base = training.weights_of(training.train(d.features, d.labels.filter("false"), u.filter("label_id = 0"), d.examples, 64, _ones(d)))
    start = u.crossJoin(base.select("feature_id", "w"))
    return training.train(d.features, d.labels, u, d.examples, 64, _ones(d), start=start).select("label_id", (F.col("loss") <= F.col("loss_start")).alias("ended"))


@query("pst_02_culling", _sql(EMB + MSI, "select label_id, feature_id, round(w, 6) as w from w where abs(w) > 0.05"))
def pst_02(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.cull(_model(spark, sf)[1], 0.05), "w")


@query("pst_03_sparsify_grid", _sql(EMB + MSI + """,
g as (select unnest([0.0, 0.01, 0.05, 0.2]) as cutoff),
s as (select cutoff, label_id, example_id, sum(case when abs(w) >= cutoff then value * w else 0 end) as score from emb_f join w using (feature_id), g group by 1, 2, 3),
l as (select cutoff, s.label_id, sum(pow(greatest(0, 1 - (case when y.label_id is null then -1 else 1 end) * score), 2)) + (select sum(case when abs(w) >= s.cutoff then w * w / 2 else 0 end) from w where w.label_id = s.label_id) as loss from s left join emb_y y on y.example_id = s.example_id and y.label_id = s.label_id group by 1, 2)""", "select l.label_id, max(cutoff)::double as cutoff from l join (select label_id, loss as base from l where cutoff = 0) using (label_id) where loss <= 1.05 * base + 1e-5 group by 1"))
def pst_03(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    w = w.persist()
    loss = lambda x: objective.loss_value(objective.margins(d.features, d.labels, x, d.examples, _ones(d)), x)
    return training.cutoff_grid(loss, w, [0.0, 0.01, 0.05, 0.2], 0.05)


@query("pst_04_reorder", _sql(EMB + MSI, "select label_id, 63 - feature_id as feature_id, round(w, 6) as w from w"))
def pst_04(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(tr.reorder(w, ds.columns(d).withColumn("new_id", 63 - F.col("feature_id"))).select("label_id", "feature_id", "w"), "w")


@query("pst_05_cull_then_reorder", _sql(EMB + MSI, "select label_id, 63 - feature_id as feature_id, round(w, 6) as w from w where abs(w) > 0.05"))
def pst_05(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(tr.reorder(training.cull(w, 0.05), ds.columns(d).withColumn("new_id", 63 - F.col("feature_id"))).select("label_id", "feature_id", "w"), "w")


@query("snk_03_sparse_weight_lines", _sql(EMB + MSI, "select label_id, coalesce(string_agg(feature_id || ':' || printf('%.4f', w), ' ' order by feature_id) filter (where abs(w) > 0.05), '') as line from w group by 1"))
def snk_03(spark: SparkSession, sf: str) -> DataFrame:
    return formats.sparse_weight_lines(_model(spark, sf)[1], 0.05, 4)


@query("snk_02_dense_weight_lines", _sql(EMB + MSI, "select label_id, string_agg(printf('%.4f', w), ' ' order by feature_id) as line from w group by 1"))
def snk_02(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return formats.dense_weight_lines(w, ds.columns(d), 4)


@query("src_14_label_range", _sql(EMB + MSI, "select label_id, count(*) as n from w where label_id >= 2 and label_id < 7 group by 1"))
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf)[1].filter("label_id >= 2 and label_id < 7").groupBy("label_id").agg(F.count("*").alias("n"))


# -- scoring --------------------------------------------------------------------------------------------------------
def _top(spark: SparkSession, sf: str, k: int = 5) -> tuple[Dataset, DataFrame]:
    d, w = _model(spark, sf)
    return d, scoring.top_k(scoring.score(d.features, w), k)


@query("flagship_msi_top5", _sql(EMB + SCORES, "select example_id, rk, label_id, round(score, 6) as score from top"))
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_top(spark, sf)[1], "score")


@query("jn_03_scores", _sql(EMB + SCORES, "select example_id, label_id, round(score, 6) as score from scores"))
def jn_03(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(scoring.score(d.features, w), "score")


@query("jn_04_one_label", _sql(EMB + SCORES, "select example_id, round(score, 6) as score from scores where label_id = 4"))
def jn_04(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return rounded(scoring.score(d.features, w.filter("label_id = 4")).select("example_id", "score"), "score")


# a sparse model of the orders: a label has weights for a seventh of the brands, so many pairs have no score
_SPARSE = ", v as (select label_id, feature_id, 1.0::double / (1 + label_id) - feature_id / 50.0::double as w from ord_l, (select feature_id from ord_b) where (label_id + feature_id) % 7 = 0), part as (select example_id, label_id, sum(value * w) as score from ord_f join v using (feature_id) group by 1, 2), every as (select x.example_id, l.label_id, coalesce(score, 0) as score from ord_x x cross join ord_l l left join part using (example_id, label_id))"


def _sparse(spark: SparkSession, sf: str) -> tuple[Dataset, DataFrame]:
    d = ds.orders(spark, sf)
    w = ds.universe(d).crossJoin(ds.columns(d)).filter((F.col("label_id") + F.col("feature_id")) % 7 == 0)
    return d, scoring.score(d.features, w.select("label_id", "feature_id", (1.0 / (1 + F.col("label_id")) - F.col("feature_id") / 50.0).alias("w")))


@query("top_02_full_scores", _sql(ORD + _SPARSE, "select example_id, label_id, round(score, 5) as score from every"))
def top_02(spark: SparkSession, sf: str) -> DataFrame:
    d, part = _sparse(spark, sf)
    return rounded(scoring.full_scores(part, d.examples, ds.universe(d)), "score", digits=5)


@query("top_03_padded_top_k", _sql(ORD + _SPARSE, "select example_id, rk, label_id, round(score, 5) as score from (select *, row_number() over (partition by example_id order by score desc, label_id) - 1 as rk from every) where rk < 3"))
def top_03(spark: SparkSession, sf: str) -> DataFrame:
    d, part = _sparse(spark, sf)
    return rounded(scoring.padded_top_k(part, d.examples, ds.universe(d), 3), "score", digits=5)


@query("top_06_merged_parts", _sql(EMB + SCORES, "select example_id, rk, label_id, round(score, 6) as score from top where rk < 3"))
def top_06(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    parts = [scoring.top_k(scoring.score(d.features, w.filter(f"label_id % 2 = {i}")), 3) for i in (0, 1)]
    return rounded(scoring.merge_top_k(parts, 3), "score")


_CONF = SCORES + ", c as (select count(*) filter (where score > 0 and y.label_id is not null) as tp, count(*) filter (where score > 0 and y.label_id is null) as fp, count(*) filter (where score <= 0 and y.label_id is null) as tn, count(*) filter (where score <= 0 and y.label_id is not null) as fn from scores s left join emb_y y on y.example_id = s.example_id and y.label_id = s.label_id)"


@query("top_04_threshold_confusion", _sql(EMB + _CONF, "select * from c"))
def top_04(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return scoring.threshold_confusion(scoring.score(d.features, w), d.labels, d.meta)


@query("top_05_report", _sql(EMB + _CONF, "select ((10000 * (tp + tn)) // (tp + fp + tn + fn) / 100.0)::double as accuracy, ((10000 * tp) // (tp + fp) / 100.0)::double as precision, ((10000 * tp) // (tp + fn) / 100.0)::double as recall, ((10000 * tp) // (tp + (fp + fn) // 2) / 100.0)::double as f1 from c"))
def top_05(spark: SparkSession, sf: str) -> DataFrame:
    d, w = _model(spark, sf)
    return scoring.report(scoring.threshold_confusion(scoring.score(d.features, w), d.labels, d.meta)).select(*(F.col(c).cast("double").alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("snk_07_prediction_lines", _sql(EMB + SCORES, "select example_id, string_agg(label_id || ':' || printf('%.4f', score), ' ' order by rk) as line from top group by 1"))
def snk_07(spark: SparkSession, sf: str) -> DataFrame:
    return formats.topk_lines(_top(spark, sf)[1], 4)


# -- metrics --------------------------------------------------------------------------------------------------------
_HITS = SCORES + ", hits as (select t.*, case when y.label_id is null then 0 else 1 end as correct from top t left join emb_y y using (example_id, label_id)), size as (select example_id, count(*) as n from emb_y group by 1)"


@query("jn_05_marked", _sql(EMB + _HITS, "select example_id, rk, label_id, correct from hits"))
def jn_05(spark: SparkSession, sf: str) -> DataFrame:
    d, top = _top(spark, sf)
    return metrics.marked(top, d.labels)


@query("jn_13_missed", _sql(EMB + _HITS, "select example_id, label_id from emb_y where not exists (select 1 from top where top.example_id = emb_y.example_id and top.label_id = emb_y.label_id)"))
def jn_13(spark: SparkSession, sf: str) -> DataFrame:
    d, top = _top(spark, sf)
    return d.labels.join(top, ["example_id", "label_id"], "left_anti")


@query("met_01_04_instance", _sql(EMB + _HITS + """,
per as (select k, example_id, sum(correct) as h, sum(case when correct = 1 then 1 / ln(rk + 2) else 0 end) as d, (select sum(1 / ln(i + 2)) from range(0, 5) r(i) where i < least(k, (select n from size where size.example_id = hits.example_id))) as ideal from hits, (select unnest([1, 3, 5]) as k) where rk < k group by 1, 2),
s as (select k, sum(h) as h, sum(d) as d, sum(coalesce(d / ideal, 0)) as nd, count(*) filter (where h > 0) as a, (select n_examples from emb_m) as n from per group by 1)""", "select k, unnest(['InstanceP', 'InstanceDCG', 'InstancenDCG', 'Abd']) as name, round(unnest([h / (k * n)::double, d / n, nd / n, a / n::double]), 6) as value from s"))
def met_01(spark: SparkSession, sf: str) -> DataFrame:
    d, top = _top(spark, sf)
    return rounded(metrics.instance_metrics(top, d.labels, d.meta), "value")


_LABEL_CM = _HITS + """,
pos as (select label_id, count(*) as p from emb_y group by 1),
own as (select label_id, sum(correct) as tp, sum(1 - correct) as fp from hits where rk < 3 group by 1),
cm as (select l.label_id, coalesce(tp, 0)::bigint as tp, coalesce(fp, 0)::bigint as fp, (coalesce(p, 0) - coalesce(tp, 0))::bigint as fn, (n_examples - coalesce(fp, 0) - coalesce(p, 0))::bigint as tn from emb_l l left join own using (label_id) left join pos using (label_id), emb_m)"""


def _confusion(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    d, top = _top(spark, sf)
    return metrics.confusion_at_k(top, d.labels, ds.universe(d), d.meta, k)


@query("met_06_confusion", _sql(EMB + _LABEL_CM, "select * from cm"))
def met_06(spark: SparkSession, sf: str) -> DataFrame:
    return _confusion(spark, sf)


@query("met_05_coverage", _sql(EMB + _LABEL_CM, "select round(avg(case when tp > 0 then 1.0 else 0.0 end), 6)::double as coverage from cm"))
def met_05(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.coverage_at_k(_confusion(spark, sf)), "coverage")


@query("met_08_micro_fractions", _sql(EMB + _LABEL_CM + ", s as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(tn)::double as tn, sum(fn)::double as fn from cm)", "select unnest(['MicroTP', 'MicroFP', 'MicroTN', 'MicroFN']) as name, round(unnest([tp, fp, tn, fn]) / (tp + fp + tn + fn), 6) as value from s"))
def met_08(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.micro_fractions(_confusion(spark, sf)), "value")


def _div(a: str, b: str) -> str:
    return f"(case when ({a}) = 0 then 0 when ({b}) = 0 then case when ({a}) > 0 then 'inf'::double else '-inf'::double end else ({a}) / ({b}) end)"


_TPR, _TNR, _PPV, _NPV = _div("tp", "tp + fn"), _div("tn", "tn + fp"), _div("tp", "tp + fp"), _div("tn", "tn + fn")
_FPR, _FNR, _FDR, _FOR = _div("fp", "fp + tn"), _div("fn", "fn + tp"), _div("fp", "fp + tp"), _div("fn", "fn + tn")
_LRP, _LRM = _div(_TPR, _FPR), _div(_FNR, _TNR)
_FORMULAS = {
    "P": _PPV, "R": _TPR, "F1": _div("2 * tp", "2 * tp + fn + fp"), "ACC": _div("tp + tn", "tp + fp + fn + tn"), "BA": f"({_TPR} + {_TNR}) / 2", "SPC": _TNR, "BM": f"{_TPR} + {_TNR} - 1", "MK": f"{_PPV} + {_NPV} - 1",
    "FM": f"sqrt({_PPV} * {_TPR})", "NPV": _NPV, "MCC": f"sqrt({_TPR} * {_TNR} * {_PPV} * {_NPV}) - sqrt({_FNR} * {_FPR} * {_FOR} * {_FDR})", "LR+": _LRP, "LR-": _LRM, "DOR": _div(_LRP, _LRM),
    "PREV": _div("tp + fn", "tp + fp + fn + tn"), "FDR": _FDR, "FOR": _FOR, "FNR": _FNR, "FPR": _FPR,
}
_IDS = dict(zip(("P", "R", "F1", "ACC", "BA", "SPC", "BM", "MK", "FM", "NPV", "MCC", "LR+", "LR-", "DOR"), range(9, 23), strict=True))
_CELLS = {"micro": "(select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn, sum(tn)::double as tn from cm)", "macro": "(select tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn from cm)"}
for _how, _from in _CELLS.items():
    _all = " union all ".join(f"select '{_how.capitalize()}{n}' as name, round({'avg' if _how == 'macro' else ''}({t}), 6) as value from {_from}" for n, t in _FORMULAS.items())
    query(f"met_07_{_how}_rates", _sql(EMB + _LABEL_CM, _all))(lambda spark, sf, how=_how: rounded(metrics.reduce_confusion(_confusion(spark, sf), how), "value"))
for _rate, _number in _IDS.items():
    _clean = _rate.lower().replace("+", "_plus").replace("-", "_minus")
    query(f"met_{_number:02d}_{_clean}", _sql(EMB + _LABEL_CM, " union all ".join(f"select '{h.capitalize()}{_rate}' as name, round({'avg' if h == 'macro' else ''}({_FORMULAS[_rate]}), 6) as value from {f}" for h, f in _CELLS.items())))(
        lambda spark, sf, rate=_rate: (lambda c: rounded(metrics.reduce_confusion(c, "micro", lambda *x: {rate: metrics._rates(*x)[rate]}).unionByName(metrics.reduce_confusion(c, "macro", lambda *x: {rate: metrics._rates(*x)[rate]})), "value"))(_confusion(spark, sf))
    )
_REST = ("PREV", "FDR", "FOR", "FNR", "FPR", "R", "SPC", "P", "NPV", "LR+", "LR-")
query("met_23_other_rates", _sql(EMB + _LABEL_CM, " union all ".join(f"select '{h.capitalize()}{r}' as name, round({'avg' if h == 'macro' else ''}({_FORMULAS[r]}), 6)::double as value from {f}" for h, f in _CELLS.items() for r in _REST)))(
    lambda spark, sf: (lambda c, own: rounded(metrics.reduce_confusion(c, "micro", own).unionByName(metrics.reduce_confusion(c, "macro", own)), "value"))(_confusion(spark, sf), lambda *x: {r: metrics._rates(*x)[r] for r in _REST})
)


# -- metrics over labelled examples, on the multi-label orders ---------------------------------------------------------
# the most frequent labels, in an order turned by the example's key, stand for predictions
_LABELLED = _COUNTS + f""",
inv as (select label_id, 1 / ({_jain('n_pos', 'total')}) as inv from n),
pred as (select * from (select x.example_id, label_id, row_number() over (partition by x.example_id order by (label_id * 7 + x.example_id) % 41, label_id) - 1 as rk from ord_x x, ord_l) where rk < 5),
h as (select p.example_id, rk, case when y.label_id is null then 0 else 1 end as c, coalesce(inv, 0) as inv from pred p join inv using (label_id) left join (select distinct * from ord_y) y using (example_id, label_id)),
ch as (select example_id, rk, sum(c) over w as h, sum(c / ln(rk + 2)) over w as d, sum(c * inv) over w as s, sum(c * inv / log2(rk + 2)) over w as sd from h window w as (partition by example_id order by rk)),
best as (select example_id, inv, row_number() over (partition by example_id order by inv desc, label_id) - 1 as rk from (select distinct * from ord_y) join inv using (label_id)),
grid as (select example_id, unnest(range(0, 5)) as rk from (select distinct example_id from ord_y)),
cb as (select example_id, rk, sum(case when inv is null then 0 else 1 / ln(rk + 2) end) over w as d, sum(coalesce(inv, 0)) over w as s, sum(coalesce(inv, 0) / log2(rk + 2)) over w as sd from grid left join best using (example_id, rk) window w as (partition by example_id order by rk)),
sums as (select rk + 1 as k, sum(h) as h, sum(ch.d / cb.d) as nd, count(*) as n, sum(ch.s) as s, sum(cb.s) as bs, sum(ch.sd) as sd, sum(cb.sd) as bsd from cb join ch using (example_id, rk) group by 1)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = ds.orders(spark, sf)
    counts = lab.label_counts(d.labels, ds.universe(d), d.meta)
    inverse = lab.propensities(counts, d.meta).select("label_id", (1 / F.col("p")).alias("inv"))
    # each example's order is made in its row: only its first five labels become rows
    every = ds.universe(d).agg(F.collect_list("label_id").alias("labels"))
    order = F.array_sort(F.transform("labels", lambda x: F.struct(((x * 7 + F.col("example_id")) % 41).alias("key"), x.alias("label_id"))))
    pred = d.examples.crossJoin(F.broadcast(every)).select("example_id", F.posexplode(F.slice(order, 1, 5)).alias("rk", "x")).select("example_id", F.col("rk").cast("bigint").alias("rk"), "x.label_id")
    return metrics.labelled_metrics(pred, d.labels, inverse)


_VALUES = {"P": "h / (n * k)::double", "nDCG": "nd / n", "PSP": "s / bs", "PSnDCG": "sd / bsd"}
query("met_29_evaluation", _sql(ORD + _LABELLED, " union all ".join(f"select '{n}' as name, k, round(100 * ({t}), 6) as value from sums where k in (1, 3, 5)" for n, t in _VALUES.items())))(
    lambda spark, sf: rounded(_labelled(spark, sf).filter("k in (1, 3, 5)"), "value")
)
for _number, _name in zip(range(25, 29), _VALUES, strict=True):
    query(f"met_{_number}_{_name.lower()}", _sql(ORD + _LABELLED, f"select '{_name}' as name, k, round(100 * ({_VALUES[_name]}), 6) as value from sums"))(
        lambda spark, sf, name=_name: rounded(_labelled(spark, sf).filter(F.col("name") == name), "value")
    )


_SUITE = ("P", "R", "F1", "ACC", "BA", "SPC", "BM", "MK", "FM", "NPV", "MCC", "LR+", "LR-", "DOR")
_SUITE_CM = _HITS + """,
pos as (select label_id, count(*) as p from emb_y group by 1),
ks as (select unnest([1, 3, 5]) as k),
own as (select k, label_id, sum(correct) as tp, sum(1 - correct) as fp from hits, ks where rk < k group by 1, 2),
cm as (select ks.k, l.label_id, coalesce(tp, 0)::double as tp, coalesce(fp, 0)::double as fp, (coalesce(p, 0) - coalesce(tp, 0))::double as fn, (n_examples - coalesce(fp, 0) - coalesce(p, 0))::double as tn from emb_l l cross join ks left join own using (k, label_id) left join pos using (label_id), emb_m),
whole as (select k, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from cm group by 1),
per as (select k, example_id, sum(correct) as h, sum(case when correct = 1 then 1 / ln(rk + 2) else 0 end) as d, (select sum(1 / ln(i + 2)) from range(0, 5) r(i) where i < least(k, (select n from size where size.example_id = hits.example_id))) as ideal from hits, ks where rk < k group by 1, 2),
s as (select k, sum(h) as h, sum(d) as d, sum(coalesce(d / ideal, 0)) as nd, count(*) filter (where h > 0) as a, (select n_examples from emb_m) as n from per group by 1)"""
_SUITE_SQL = " union all ".join(
    [f"select k, 'Micro{n}' as name, round({_FORMULAS[n]}, 6)::double as value from whole" for n in _SUITE]
    + [f"select k, 'Macro{n}', round(avg({_FORMULAS[n]}), 6)::double from cm group by 1" for n in _SUITE]
    + [f"select k, 'Micro{c.upper()}', round({c} / (tp + fp + fn + tn), 6)::double from whole" for c in ("tp", "fp", "tn", "fn")]
    + ["select k, 'Cov', round(avg(case when tp > 0 then 1.0 else 0.0 end), 6)::double from cm group by 1"]
    + ["select k, unnest(['InstanceP', 'InstanceDCG', 'InstancenDCG', 'Abd']), round(unnest([h / (k * n)::double, d / n, nd / n, a / n::double]), 6)::double from s"]
)


def _suite(spark: SparkSession, sf: str) -> DataFrame:
    d, top = _top(spark, sf)
    return metrics.suite(top, d.labels, ds.universe(d), d.meta)


query("met_30_suite", _sql(EMB + _SUITE_CM, _SUITE_SQL))(lambda spark, sf: rounded(_suite(spark, sf), "value"))


@query("snk_10_sorted_metrics", _sql(EMB + _SUITE_CM, f"select cast(row_number() over (order by name, k) as integer) as line, name, k, value from ({_SUITE_SQL})"))
def snk_10(spark: SparkSession, sf: str) -> DataFrame:
    """The suite in the order in which it is written: a fixed number of rows, whatever the data."""
    from pyspark.sql import Window

    rows = rounded(_suite(spark, sf), "value")
    return rows.select(F.row_number().over(Window.orderBy("name", "k")).alias("line"), "name", "k", "value")
