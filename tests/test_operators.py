"""Golden values and identities of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom import functions as fn
from labelloom.operators import initial, metrics, objective, scoring, spread, stats, training
from labelloom.operators import labels as lab
from labelloom.operators import transforms as tr


def entries(spark, rows, names="example_id long, feature_id long, value double"):
    return spark.createDataFrame(rows, names)


def test_propensity_golden(spark):
    df = spark.createDataFrame([(1,), (25,)], "n long").select("n", fn.propensity(F.col("n"), F.lit(50)).alias("p"))
    got = {r.n: r.p for r in df.collect()}
    assert got[1] == pytest.approx(0.25562221863533147, rel=1e-9)
    assert got[25] == pytest.approx(0.5571545100089221, rel=1e-9)
    p = spark.createDataFrame([(0, got[1])], "label_id long, p double")
    assert lab.cost_weights(p, "2pm1").first()["pos"] == pytest.approx(2 / got[1] - 1)
    with pytest.raises(ValueError):
        lab.cost_weights(p, "constant", -1)


def test_bias_and_order(spark):
    f = entries(spark, [(3, 2, 2.0), (1, 3, -1.0), (2, 2, 2.0), (1, 2, 2.0), (2, 3, 4.0), (2, 0, -4.0)])
    order = tr.frequency_order(f.unionByName(entries(spark, [])))
    got = {(r.example_id, r.feature_id): r.value for r in tr.reorder(f, order).collect()}
    # column 1 has no entry and isn't numbered: 0, 3 and 2 become 0, 1 and 2
    assert got == {(3, 2): 2.0, (1, 1): -1.0, (2, 2): 2.0, (1, 2): 2.0, (2, 1): 4.0, (2, 0): -4.0}
    meta = spark.createDataFrame([(5, 5, 1)], "n_examples long, n_features long, n_labels long")
    out = tr.augment_bias(f, spark.range(5).toDF("example_id"), meta)
    assert out.filter("feature_id = 5").count() == 5 and out.count() == 11


def test_squared_hinge_golden(spark):
    f = entries(spark, [(0, 3, 1.0), (1, 0, 2.0), (2, 1, 1.0), (2, 2, 1.0)])
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 0.0), (0, 3, -1.0), (0, 4, 2.0)], "label_id long, feature_id long, w double")
    y = spark.createDataFrame([(1, 0)], "example_id long, label_id long")
    costs = spark.createDataFrame([(0, 1.0, 3.0)], "label_id long, pos double, neg double")
    m = objective.margins(f, y, w, spark.range(3).toDF("example_id"), costs)
    assert objective.loss_value(m, w).first()["loss"] == pytest.approx(9 * 3 + 5)
    g = {r.feature_id: r.g for r in objective.gradient(f, m, w).collect()}
    assert [g[i] for i in range(5)] == pytest.approx([1, 18 + 2, 18 + 0, -1, 2])
    # along a line: the cached products give the same value as moved weights
    d = w.withColumn("w", F.col("w") * 0.5 + 1)
    along = scoring.score(f, d).withColumnRenamed("score", "xd")
    t = 0.3
    moved = w.join(d.withColumnRenamed("w", "d"), ["label_id", "feature_id"]).select("label_id", "feature_id", (F.col("w") + t * F.col("d")).alias("w"))
    direct = objective.loss_value(objective.margins(f, y, moved, spark.range(3).toDF("example_id"), costs), moved, strength=0.0).first()["loss"]
    assert objective.line_values(m, along, [t]).first()["loss"] == pytest.approx(direct)


@pytest.mark.parametrize(("kind", "w", "value"), [("l2", [1, 2, -3, 0], 7), ("huber", [1, 5, -3, 0], 7.5)])
def test_penalties(spark, kind, w, value):
    table = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(w)], "label_id long, feature_id long, w double")
    assert objective.penalty(table, kind).first()["penalty"] == pytest.approx(value)


@pytest.mark.parametrize("loss", fn.LOSSES)
def test_slopes_by_differences(spark, loss):
    e = 1e-5
    rows = spark.createDataFrame([(x / 7,) for x in range(-20, 21)], "m double")
    value, slope, _ = fn.LOSSES[loss](F.col("m"))
    up, down = fn.LOSSES[loss](F.col("m") + e)[0], fn.LOSSES[loss](F.col("m") - e)[0]
    worst = rows.select(F.max(F.abs((up - down) / (2 * e) - slope)).alias("x")).first()["x"]
    assert worst < 1e-3
    assert rows.select(F.min(value).alias("x")).first()["x"] >= 0


def test_block_penalty(spark):
    w = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 2, -1, 0, 1, 2, 5])], "label_id long, feature_id long, w double")
    out = objective.block_penalty(w, 3, 1.0, 1.0)
    assert out.agg(F.sum("value")).first()[0] == 36


@pytest.mark.parametrize(("d", "step"), [(1, 0.0), (-1, 1.0), (-8, 0.125)])
def test_line_search(d, step):
    f = lambda t: (1 * t * d + 1) ** 2
    assert training.line_search(f, 2.0 * d, 1.0)[0] == step


def test_conjugate_gradient():
    rng = np.random.default_rng(1)
    m = rng.standard_normal((5, 5))
    a, b = m @ m.T + np.eye(5), rng.standard_normal(5)
    s, _ = training.conjugate_gradient(lambda x: a @ x, b, np.diag(a), eps=1e-12)
    assert np.linalg.norm(a @ s + b) < 0.1 * np.linalg.norm(b)


def test_newton_quadratic():
    rng = np.random.default_rng(2)
    m = rng.standard_normal((4, 4))
    a, b = m.T @ m + np.eye(4), np.array([1.0, 2.0, 0.0, -2.0])

    class Quadratic:
        def value(self, w):
            return float(w @ a @ w + b @ w)

        def slopes(self, w):
            return 2 * a @ w + b, 2 * np.diag(a), lambda d: 2 * a @ d

        def line(self, w, d):
            return lambda t: self.value(w + t * d)

    w, how = training.newton(Quadratic(), np.zeros(4), training.Options(eps=1e-6))
    assert how["outcome"] == "SUCCESS" and np.allclose(w, -np.linalg.solve(a, b) / 2, atol=1e-4)


def test_sparsify_keeps_the_loss():
    rng = np.random.default_rng(3)
    n, f = 60, 8
    x = rng.standard_normal((n, f))
    row, col = np.nonzero(x)
    o = training.Linear(training.Rows(row, col, x[row, col], n, f), np.where(x[:, 0] > 0, 1.0, -1.0), np.ones(n), 1.0)
    w, _ = training.newton(o, np.zeros(f))
    thin = training.sparsified(o, w, 0.05)
    assert (thin != 0).sum() <= (w != 0).sum() and o.value(thin) <= 1.05 * o.value(w) + 1e-5


def test_running_precision(spark):
    cases = [((2, 4, 6), (1, 4, 8, 12)), ((3, 1, 2), (2, 3)), ((1, 2, 3), (4, 5, 6)), ((1, 2, 3), ()), ((3, 2, 1), (1, 2, 3))]
    for n, (p, a) in zip(range(1, 6), ((1 / 3, 1.0), (3 / 6, 1.0), (3 / 9, 2 / 3), (3 / 12, 2 / 4), (6 / 15, 3 / 5)), strict=True):
        pred = spark.createDataFrame([(i, k, x) for i, (r, _) in enumerate(cases[:n]) for k, x in enumerate(r)], "example_id long, rk long, label_id long")
        truth = spark.createDataFrame([(i, x) for i, (_, t) in enumerate(cases[:n]) for x in t], "example_id long, label_id long")
        meta = spark.createDataFrame([(n, 1, 20)], "n_examples long, n_features long, n_labels long")
        got = {r.name: r.value for r in metrics.instance_metrics(pred, truth, meta, (3,)).collect()}
        assert got["InstanceP"] == pytest.approx(p) and got["Abd"] == pytest.approx(a)


def test_safe_div(spark):
    row = spark.range(1).select(fn.safe_div(F.lit(0.0), F.lit(0.0)).alias("a"), fn.safe_div(F.lit(1.0), F.lit(0.0)).alias("b"), fn.safe_div(F.lit(1.0), F.lit(4.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, None, 0.25)


def test_padded_equals_full(spark):
    rng = np.random.default_rng(4)
    scores = spark.createDataFrame([(int(i), int(j), float(rng.integers(-2, 3))) for i in range(12) for j in rng.choice(9, rng.integers(0, 6), replace=False)], "example_id long, label_id long, score double").filter("score <> 0")
    x, u = spark.range(12).toDF("example_id"), spark.range(9).toDF("label_id")
    want = sorted(map(tuple, scoring.top_k(scoring.full_scores(scores, x, u), 4).collect()))
    assert sorted(map(tuple, scoring.padded_top_k(scores, x, u, 4).collect())) == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.99,), (10.0,), (4.0,)], "v double")
    got = {r.bin: r["count"] for r in stats.histogram(df, "v", 0.0, 10.0, 5).collect()}
    assert got == {0: 1, 1: 1, 5: 1, 6: 1, 3: 1}


def test_shards(spark):
    s = spark.createDataFrame([(1, 4)], "first long, count long")
    meets = lambda a, b: training.overlapping(s, a, b).count() > 0
    assert meets(4, 6) and meets(0, 2) and not meets(5, 7) and not meets(0, 1)
    assert [tuple(r) for r in training.missing_ranges(s, 6).collect()] == [(0, 1), (5, 6)]


def test_mean_separating_means(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 4)) + 1
    f = entries(spark, [(i, j, float(x[i, j])) for i in range(30) for j in range(4)])
    y = spark.createDataFrame([(i, 0) for i in range(7)], "example_id long, label_id long")
    meta = spark.createDataFrame([(30, 4, 1)], "n_examples long, n_features long, n_labels long")
    w = {r.feature_id: r.w for r in initial.mean_separating(f, y, meta).collect()}
    v = np.array([w[j] for j in range(4)])
    assert x[:7].mean(0) @ v == pytest.approx(1) and x.mean(0) @ v == pytest.approx(7 / 30 * 3 - 2)


def test_multi_positive(spark):
    rng = np.random.default_rng(6)
    n, width, held = 30, 5, {0: [], 1: [4], 2: [4, 9], 3: [1, 2, 29], 4: list(range(7))}
    x = rng.standard_normal((n, width)) + 0.5
    x[29] = 0  # an example without features
    f = entries(spark, [(i, j, float(x[i, j])) for i in range(29) for j in range(width)])
    y = spark.createDataFrame([(i, label) for label, ids in held.items() for i in ids], "example_id long, label_id long")
    meta = spark.createDataFrame([(n, width, len(held))], "n_examples long, n_features long, n_labels long")
    got = {}
    for r in initial.multi_positive(f, y, meta, spark.range(len(held)).toDF("label_id"), 3).collect():
        assert got.setdefault((r.label_id, r.feature_id), r.w) == r.w
    assert len(got) == len(held) * width
    w = np.array([[got[label, j] for j in range(width)] for label in held])
    mean = x.mean(0)
    for label in range(4):
        own = x[held[label]]
        k = len(own)
        gram = np.zeros((k + 1, k + 1))
        gram[1:, 1:] = own @ own.T
        gram[0, 0] = mean @ mean + sum(v @ v / n**2 - 2 * (v @ mean) / n for v in own)
        gram[0, 1:] = gram[1:, 0] = own @ (mean - own.sum(0) / n)
        a = np.linalg.solve(gram + 0.01 * np.eye(k + 1), [-2.0] + [1.0] * k)
        assert w[label] == pytest.approx(a[0] * (mean - own.sum(0) / n) + a[1:] @ own)
    want = {r.feature_id: r.w for r in initial.mean_separating(f, y.filter("label_id = 4"), meta).collect()}
    assert w[4] == pytest.approx([want[j] for j in range(width)])


def test_obesity_bounds(spark):
    counts = spark.createDataFrame([(i, int(1000 / (i + 1) ** 2)) for i in range(40)], "label_id long, n_pos long")
    assert 50 < lab.obesity(counts).first()[0] <= 100
    assert math.isclose(lab.obesity(spark.createDataFrame([(0, 5)], "label_id long, n_pos long")).first()[0], 0)


@pytest.mark.parametrize("loss", sorted(training.MARGIN_LOSSES))
@pytest.mark.parametrize("penalty", sorted(training.WEIGHT_PENALTIES))
def test_every_loss_and_penalty_trains(loss, penalty):
    rng = np.random.default_rng(4)
    n, f = 80, 7
    x = rng.standard_normal((n, f))
    y = np.where(x @ rng.standard_normal(f) + 0.3 * rng.standard_normal(n) > 0, 1.0, -1.0)
    row, col = np.nonzero(x)
    o = training.Linear(training.Rows(row, col, x[row, col], n, f), y, rng.uniform(0.5, 2, n), np.linspace(0.5, 2, f), True, loss, penalty)
    w, h = rng.standard_normal(f) / 3, 1e-6
    g, diagonal, product = o.slopes(w)
    for i in range(f):
        step = np.zeros(f)
        step[i] = h
        assert abs((o.value(w + step) - o.value(w - step)) / (2 * h) - g[i]) < 1e-4 * (1 + abs(g[i]))
        assert abs(product(step)[i] / h - diagonal[i]) < 1e-6 * (1 + diagonal[i])
    assert o.strength[-1] == 0
    best, how = training.newton(o, np.zeros(f), training.Options(eps=1e-3))
    assert how["loss"] < o.value(np.zeros(f)) and all(o.value(best + 0.01 * rng.standard_normal(f)) > how["loss"] - 1e-3 for _ in range(50))
    assert training.unchanged(o, w)[1]["loss"] == o.value(w)


@pytest.mark.parametrize("loss", sorted(training.MARGIN_LOSSES))
def test_kernel_losses_are_the_columns(spark, loss):
    from labelloom.functions import LOSSES

    m = np.round(np.linspace(-3, 3, 61), 3)
    want = [tuple(r) for r in spark.createDataFrame([(float(x),) for x in m], "m double").select(*LOSSES[loss](F.col("m"))).collect()]
    assert np.allclose(np.array(training.MARGIN_LOSSES[loss](m)).T, np.array(want, float))


@pytest.mark.parametrize("penalty", sorted(training.WEIGHT_PENALTIES))
def test_kernel_penalties_are_the_columns(spark, penalty):
    from labelloom.functions import PENALTIES

    w = np.round(np.linspace(-2, 2, 41), 3)
    want = [tuple(r) for r in spark.createDataFrame([(float(x),) for x in w], "w double").select(*PENALTIES[penalty](F.col("w"))).collect()]
    assert np.allclose(np.array(training.WEIGHT_PENALTIES[penalty](w)).T, np.array(want, float))


def test_streams_of_the_minimiser(spark):
    d = [(i, j, float((i * 7 + j * 3) % 5) - 2) for i in range(12) for j in range(3)]
    features = spark.createDataFrame(d, "example_id long, feature_id long, value double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "example_id long, label_id long")
    ids = spark.range(2).toDF("label_id")
    result = training.train(features, labels, ids, spark.range(12).toDF("example_id"), 3, ids.selectExpr("label_id", "1.0d as pos", "1.0d as neg"), training.Options(eps=1e-4, scale_eps=False)).persist()
    ends = {r.label_id: r for r in result.collect()}
    rows = training.streams(result).collect()
    for label, r in ends.items():
        own = [x for x in rows if x.label_id == label]
        assert {x.label_freq for x in own} == {6} and {x.iteration for x in own if x.stream == "grad"} == set(range(len(r.trace)))
        assert [x.value for x in own if x.stream == "loss" and x.iteration == 0] == [r.loss_start] and [x.value for x in own if x.stream == "result.loss"] == [r.loss]
    found = stats.collect(training.streams(result).filter("stream = 'grad'"), '{"all": {"type": "Basic", "value": "value"}, "by": {"type": "Tagged", "value": "value", "tag": "iteration", "max_tag": 3}}')
    lines = stats.json_lines(found, {"all": "1"}).collect()
    assert {r.name for r in lines} == {"all", "by"} and any('"unit":"1"' in r.line and '"count"' in r.line for r in lines)
    norms = stats.collect(features, {"l": {"type": "VectorReduction", "reduction": "l2", "targets": [{"type": "Basic"}]}})
    assert norms["l.0"].first()["count"] == 12


def test_stream_of_examples(spark, tmp_path):
    from labelloom.streaming import scoring as streamed

    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, -1.0)], "label_id long, feature_id long, w double").persist()
    rows = [(1, [0, 1], [1.0, 2.0]), (2, [1], [3.0]), (3, [], []), (4, [9], [1.0])]
    spark.createDataFrame(rows, "example_id long, indices array<bigint>, values array<double>").repartition(2).write.parquet(f"{tmp_path}/in")
    packed = spark.readStream.schema("example_id long, indices array<bigint>, values array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write = lambda batch, _: streamed.summed(batch).write.mode("append").parquet(f"{tmp_path}/out")
    streamed.score_stream(packed, weights).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 0, 5.0), (1, 1, -2.0), (2, 0, 6.0), (2, 1, -3.0)]


def test_labels_of_equal_positives_tie(spark):
    """Copies of vectors under labels of their own: a ranking puts the smaller of the tied labels first."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    copies = [(300 * c + i, i, c) for c in range(6) for i in range(300)]
    rng.shuffle(copies)
    features = entries(spark, [(int(e), f, float(x[i, f])) for e, i, _ in copies for f in rng.permutation(8).tolist()]).repartition(7)
    labels = spark.createDataFrame([(int(e), int(10 * c + i % 2)) for e, i, c in copies], "example_id long, label_id long").repartition(5)
    meta = spark.createDataFrame([(1800, 8, 52)], "n_examples long, n_features long, n_labels long")
    w = initial.mean_separating(features, labels, meta)
    top = scoring.top_k(scoring.score(features, w), 12).collect()
    for first in (0, 6):
        ranks = {(r.example_id, r.rk - first): r.label_id for r in top if first <= r.rk < first + 6}
        assert all(label // 10 == rk for (_, rk), label in ranks.items())


def test_steady_sum_of_odd_terms(spark):
    rows = [(0, 1e300), (0, -1e300), (0, 2.5), (1, float("inf")), (1, 1.0), (2, float("nan")), (2, 1.0), (3, None), (4, None), (4, -0.1), (5, 1e-300), (6, 0.1), (6, 0.2), (6, -0.3)]
    got = dict(spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(fn.steady_sum(F.col("x")).alias("s")).collect())
    assert (got[0], got[1], got[3], got[4], got[5]) == (2.5, math.inf, None, -0.1, 1e-300) and math.isnan(got[2])
    assert got[6] == pytest.approx(0.0, abs=1e-16)


@pytest.mark.parametrize("case", ["dense", "sparse", "shortlist"])
def test_training_spread_is_training_by_kernel(spark, monkeypatch, case):
    """Features beyond the broadcast's size are trained by passes over blocks, with the same results."""
    rng = np.random.default_rng(5)
    n, f = 90, 5
    x = rng.normal(size=(n, f)) * (1 if case == "dense" else rng.random((n, f)) < 0.4)
    features = entries(spark, [(100 + 3 * i, j, float(x[i, j])) for i in range(n) for j in range(f) if x[i, j]])
    examples = spark.createDataFrame([(100 + 3 * i,) for i in range(n)], "example_id long")
    labels = spark.createDataFrame([(100 + 3 * i, 2 * k) for i in range(n) for k in range(3) if x[i, k] > 0.3], "example_id long, label_id long")
    ids = spark.createDataFrame([(0,), (2,), (4,), (9,)], "label_id long")  # the last one has no positive
    costs = ids.selectExpr("label_id", "1.0d + label_id as pos", "0.5d as neg")
    start = spark.createDataFrame([(2, 1, 0.5), (4, 0, -0.25)], "label_id long, feature_id long, w double")
    chosen = ids.crossJoin(examples).filter("(example_id + label_id) % 4 < 3") if case == "shortlist" else None
    for o in (training.Options(eps=1e-6, scale_eps=False), training.Options(loss="logistic", penalty="elastic-50-50", tail=3, tail_strength=2.0, sparsify=0.01), training.Options(optimise=False, ignore_last=True)):
        run = lambda: {r.label_id: r for r in training.train(features, labels, ids, examples, f, costs, o, start, chosen).collect()}  # noqa: B023, E731
        monkeypatch.setattr(training, "BROADCAST_BYTES", 1 << 20)
        want = run()
        monkeypatch.setattr(training, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(training, "packed", None)  # the features aren't taken to the driver
        monkeypatch.setattr(training, "WEIGHTS", 2 * f)
        monkeypatch.setattr(spread, "BLOCK", 40)
        monkeypatch.setattr(spread, "CELLS", 20)
        got = run()
        monkeypatch.undo()
        assert sorted(got) == sorted(want) == [0, 2, 4, 9]
        for k, r in want.items():
            assert (got[k].n_pos, got[k].outcome, got[k].steps, got[k].feature_ids, len(got[k].trace)) == (r.n_pos, r.outcome, r.steps, r.feature_ids, len(r.trace))
            assert np.allclose(got[k].weights, r.weights, 1e-6, 1e-9) and np.allclose([got[k].loss, got[k].grad, got[k].loss_start], [r.loss, r.grad, r.loss_start], 1e-6, 1e-6)


def test_spread_training_fails_aloud(spark):
    def answer(questions):
        raise ValueError("lost")

    with pytest.raises(ValueError, match="lost"):
        spread.answers_together([lambda ask: ask((1,)), lambda ask: 2], answer)


def test_full_scores_shuffle_no_zeros(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 10)
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 2, -0.25), (3, 1, float("nan")), (9, 1, 4.0)], "example_id long, label_id long, score double")
    examples = spark.createDataFrame([(1,), (2,), (3,), (3,)], "example_id long")  # two rows share an example; 9 isn't one of them
    out = scoring.full_scores(scores, examples, spark.range(3).toDF("label_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.example_id, r.label_id, str(r.score)) for r in out.collect())
    assert got == sorted([(1, 0, "0.5"), (1, 1, "0.0"), (1, 2, "-0.25"), (2, 0, "0.0"), (2, 1, "0.0"), (2, 2, "0.0")] + 2 * [(3, 0, "0.0"), (3, 1, "nan"), (3, 2, "0.0")])
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(example_id" in plan
