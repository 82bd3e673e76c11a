"""Scoring head vs NumPy, formatting, evaluation metrics, cost model goldens,
early stop vs a plain loop, runtime report."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import metrics as M
from kiln.operators import efficiency, evaluation, runtime, scoring


def test_head_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 16))
    p = scoring.init_head(16, 8, 1, seed=3)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "id long, features array<double>")
    got = {r.id: r.score for r in scoring.score(df, p).collect()}
    want = scoring.head_forward(x, p)
    assert np.allclose([got[i] for i in range(50)], want, atol=1e-12)


def test_erf_against_the_math_library():
    x = np.concatenate([np.linspace(-7, 7, 20011), [0.0, -0.0, 1e-300, 6.0, 1e9, -np.inf, np.inf]])
    assert np.abs(scoring._erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-15
    assert math.isnan(scoring._erf(np.array([np.nan]))[0])


def test_head_by_hand(spark):
    """Two inputs, one hidden unit pair, one output, worked out on paper: the
    layer norm of (3, 1) and of (1, 3) is (1, -1) and (-1, 1) up to its epsilon."""
    p = {"w1": np.eye(2), "b1": np.zeros(2), "g1": np.ones(2), "s1": np.zeros(2),
         "w2": np.eye(2), "b2": np.zeros(2), "g2": np.ones(2), "s2": np.zeros(2),
         "w3": np.array([[1.0], [10.0]]), "b3": np.array([0.5])}
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, [1.0, 3.0]), (3, None)], "id long, features array<double>")
    got = {r.id: r.score for r in scoring.score(df, p).collect()}
    high, low = 0.8413447, -0.1586553                     # GELU of 1 and of -1
    assert got[1] == pytest.approx(0.5 + high + 10 * low, abs=1e-3)
    assert got[2] == pytest.approx(0.5 + low + 10 * high, abs=1e-3)
    assert got[3] is None or math.isnan(got[3])


def test_head_param_count_with_norms():
    p = scoring.init_head(1664, 512, 1)
    # linear weights + biases + two layer norms (gain and shift)
    assert scoring.head_param_count(p) == (1664 * 512 + 512) + 2 * 512 + (512 * 256 + 256) + 2 * 256 + (256 + 1)
    assert scoring.head_param_count(p) == 985601


def test_gate_and_fuse(spark):
    df = spark.createDataFrame([([1.0, -2.0], [3.0], True), ([1.0, 2.0], [4.0], False)],
                               "image_vec array<float>, text_vec array<float>, has_images boolean")
    r = df.select(scoring.fuse(scoring.gate_image_features(), F.col("text_vec")).alias("f")).collect()
    assert r[0].f == [1.0, -2.0, 3.0] and r[1].f[:2] == [0.0, 0.0]


def test_clamp_and_submission_format(spark):
    df = spark.createDataFrame([("a", 2.125), ("b", 2.675), ("c", 4.375), ("d", 7.0), ("e", -1.0), ("f", float("nan"))],
                               "item_id string, score double")
    c = {r.item_id: r.s for r in df.select("item_id", M.clamp_score("score").alias("s")).collect()}
    assert c["d"] == 5.0 and c["e"] == 1.0 and math.isnan(c["f"])
    sub = {r.item_id: r for r in scoring.submission(df.filter("item_id <> 'f'"), 985601, 1826418560.0).collect()}
    assert sub["a"].score == "2.12" and sub["b"].score == "2.67" and sub["c"].score == "4.38"
    assert sub["a"].params == "1.0" and sub["a"].flops == "1.8"
    s = scoring.submission_summary(df.filter("item_id <> 'f'"), 2.5).first()
    assert s.n == 5 and s.min_score == 1.0 and s.max_score == 5.0 and s.seconds_per_row == 0.5
    empty = scoring.submission_summary(df.filter("false"), 2.5).first()
    assert empty.n == 0 and empty.seconds_per_row == 0.0


def test_pearson_degenerate(spark):
    sch = "run_id long, prediction double, label double"
    one = spark.createDataFrame([(1, 1.0, 2.0)], sch)
    const = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], sch)
    for df in (one, const):
        assert df.groupBy("run_id").agg(evaluation.pearson().alias("p")).first().p == 0.0
    empty = spark.createDataFrame([], sch).agg(evaluation.pearson_safe().alias("p")).first()
    assert empty.p == 0.0
    x = np.arange(10.0)
    y = x ** 2
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], sch)
    r = df.groupBy("run_id").agg(*evaluation.regression_metrics()).first()
    assert r.plcc == pytest.approx(np.corrcoef(x, y)[0, 1])
    d = x - y
    assert r.mae == pytest.approx(np.abs(d).mean()) and r.rmse == pytest.approx(math.sqrt((d * d).mean()))
    assert r.loss == pytest.approx(np.where(np.abs(d) < 1, 0.5 * d * d, np.abs(d) - 0.5).mean())
    assert r.std_pred == pytest.approx(np.std(x))


def py_best_stop(vals, patience):
    best, since, best_epoch = float("-inf"), 0, None
    for e, v in enumerate(vals, 1):
        if v > best:
            best, since, best_epoch = v, 0, e
        else:
            since += 1
        if since >= patience:
            return best_epoch, e
    return best_epoch, None


def test_best_and_stop_matches_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for run in range(25):
        vals = list(np.round(rng.normal(size=rng.integers(1, 12)), 1))
        for e, v in enumerate(vals, 1):
            rows.append((run, e, float(v)))
        for p in (1, 2):
            want[(run, p)] = py_best_stop(vals, p)
    h = spark.createDataFrame(rows, "run_id long, epoch int, val_plcc double")
    for p in (1, 2):
        got = {r.run_id: (r.best_epoch, r.stop_epoch) for r in evaluation.best_and_stop(h, patience=p).collect()}
        assert got == {run: want[(run, p)] for run in range(25)}


def test_best_and_stop_with_nan_epochs_matches_loop(spark):
    rng = np.random.default_rng(11)
    rows, want, best_val = [], {}, {}
    for run in range(40):
        vals = [float("nan") if rng.random() < 0.25 else float(np.round(rng.normal(), 1))
                for _ in range(rng.integers(1, 14))]
        for e, v in enumerate(vals, 1):
            rows.append((run, e, v))
        for p in (1, 2, 3):
            want[(run, p)] = py_best_stop(vals, p)
            be = want[(run, p)][0]
            best_val[(run, p)] = None if be is None else vals[be - 1]
    h = spark.createDataFrame(rows, "run_id long, epoch int, val_plcc double")
    for p in (1, 2, 3):
        got = {r.run_id: r for r in evaluation.best_and_stop(h, patience=p).collect()}
        assert {k: (r.best_epoch, r.stop_epoch) for k, r in got.items()} == {run: want[(run, p)] for run in range(40)}
        assert {k: r.best_val_plcc for k, r in got.items()} == {run: best_val[(run, p)] for run in range(40)}


def test_cost_goldens(spark):
    r = spark.range(1).select(
        M.transformer_block_flops(128, 384, 4).alias("e2"),
        M.image_branch_flops(224, 224).alias("e3a"), M.image_branch_flops(448, 224).alias("e3b"),
        M.model_flops(128).alias("e4a"), M.model_flops(256).alias("e4b"),
        M.model_flops(128, with_images=False).alias("e4c"),
        M.efficiency_factor(F.lit(1.0)).alias("e6a"), M.efficiency_factor(F.lit(math.exp(-2))).alias("e6b"),
        M.efficiency_factor(F.lit(math.e)).alias("e6c"), M.efficiency_factor(F.lit(0.0)).alias("e6d"),
        M.ces_score(F.lit(-0.3), F.lit(0.5)).alias("e7")).first()
    assert r.e2 == 239075328 and r.e3a == 390e6 and r.e3b == 780e6
    assert r.e4a == 1826418560 and r.e4b == 3411865472 and r.e4c == 1826418560 - 390e6
    assert r.e6a == 1.0 and r.e6b == pytest.approx(1.10) and r.e6c == pytest.approx(1 / 3) and r.e6d == pytest.approx(1.10)
    assert r.e7 == 0.0


def test_parameter_totals_and_report(spark):
    m = spark.createDataFrame([("h", "w1", [1664, 512], True), ("h", "b1", [512], True), ("h", "g", [512], False)],
                              "model string, name string, shape array<bigint>, trainable boolean")
    t = efficiency.parameter_totals(m).first()
    assert (t.total_params, t.trainable_params, t.frozen_params) == (1664 * 512 + 1024, 1664 * 512 + 512, 512)
    rep = efficiency.efficiency_report(m.sparkSession.createDataFrame(
        [("a", 10 ** 9, 20e9, None), ("b", 10 ** 8, 2e9, 0.5)], "model string, total_params long, flops double, plcc double"))
    r = {x.model: x for x in rep.collect()}
    assert r["a"].resource_cost == 1.0 and r["a"].ces is None
    assert r["b"].resource_cost == pytest.approx(0.1) and r["b"].ces == pytest.approx(0.5 * min(1 + 0.05 * math.log(10), 1.1))


def _timings(spark, n_batches, run=1, device="cuda:0", tokens=10):
    rows = []
    t = 0
    for b in range(n_batches):
        rows.append((run, b, device, t, t + 1000, 4, tokens, 1048576 * (b + 1), 2097152))
        t += 2000
    return spark.createDataFrame(rows, "run_id long, batch_idx long, device string, start_us long, end_us long, "
                                       "batch_size long, tokens long, alloc_bytes long, reserved_bytes long")


def test_runtime_report(spark):
    r = runtime.runtime_report(_timings(spark, 12), warmup=5, cap=4).first()
    assert r.measured_batches == 4 and r.num_samples == 16 and r.num_input_tokens == 40
    assert r.model_seconds == pytest.approx(0.004) and r.end_to_end_seconds == pytest.approx(0.007)
    assert r.peak_alloc_mib == 9.0 and r.peak_reserved_mib == 2.0
    cpu = runtime.runtime_report(_timings(spark, 8, device="cpu", tokens=0), warmup=5).first()
    assert cpu.peak_alloc_mib is None and cpu.latency_ms_per_token is None and cpu.throughput_tokens_per_sec is None
    with pytest.raises(Exception, match="No batches were measured"):
        runtime.runtime_report(_timings(spark, 3), warmup=5, fail_on_empty=True).collect()


def test_robust_fit(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 4))
    y = X @ np.array([1.0, -2.0, 0.5, 0.0]) + 3 + rng.normal(scale=0.05, size=400)
    y[:10] += 50   # outliers
    df = spark.createDataFrame([(int(i % 2), X[i].tolist(), float(y[i]), 1.0) for i in range(400)],
                               "g long, features array<double>, label double, weight double")
    model = scoring.fit_robust(df, max_iter=100)
    assert np.allclose(model.coefficients.toArray(), [1.0, -2.0, 0.5, 0.0], atol=0.1)
    per = {r.g: r for r in scoring.fit_per_group(df, "g").collect()}
    for g in (0, 1):
        assert np.allclose(per[g].coef, [1.0, -2.0, 0.5, 0.0], atol=0.05) and per[g].intercept == pytest.approx(3, abs=0.05)
        assert per[g].n == 200 and per[g].converged and per[g].grad_norm <= 1e-6


def test_fit_gradient_is_the_losss(spark):
    """The reported optimum beats its neighbours, and its slope measured by
    differences of the loss is nil; too few steps are not called converged."""
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(300, 3)), rng.uniform(0.1, 2, 300)
    y = x @ np.array([2.0, 0.0, -1.0]) + 1 + rng.standard_t(1.5, 300)
    rows = [(None if i % 2 else "g", x[i].tolist(), float(y[i]), float(w[i])) for i in range(300)] + [("g", None, 1.0, 1.0), ("g", [0.0] * 3, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, features array<double>, label double, weight double").repartition(5)
    for r in scoring.fit_per_group(df, "g", tol=1e-7).collect():
        k = np.array([(r.g is None) == bool(i % 2) for i in range(300)])
        beta = np.array([*r.coef, r.intercept])

        def loss(b):
            d = np.abs(np.hstack([x[k], np.ones((150, 1))]) @ b - y[k])
            return (w[k] * np.where(d < 1, 0.5 * d * d, d - 0.5)).sum() / w[k].sum()
        slope = [(loss(beta + 1e-5 * e) - loss(beta - 1e-5 * e)) / 2e-5 for e in np.eye(4)]
        assert np.abs(slope).max() < 1e-6 and r.grad_norm <= 1e-7 and r.converged and r.n == 150
    hasty = scoring.fit_per_group(df, "g", tol=1e-12, max_iter=1).collect()
    assert len(hasty) == 2 and not any(r.converged for r in hasty) and {r.iterations for r in hasty} == {1}
    assert scoring.fit_per_group(df.limit(0), "g").count() == 0
