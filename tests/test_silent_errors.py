"""Inputs that once gave a wrong answer without an error."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import metrics
from kiln.operators import splits
from kiln.session import scratch_path
from kiln.sources import csv as csv_src
from kiln.sources import images


def test_missing_score_stays_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (9.0,), (-1.0,)], "s double")
    got = [r[0] for r in df.select(metrics.clamp_score("s")).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [5.0, 1.0]


def test_undefined_correlation_scores_zero(spark):
    df = spark.createDataFrame([(float("nan"), 0.5), (0.5, 1.0), (-0.5, 1.0)], "r double, c double")
    assert [r[0] for r in df.select(metrics.ces_score("r", "c")).collect()] == [0.0, 0.5, 0.0]


def test_csv_columns_by_name(spark, tmpdir_path):
    path = f"{tmpdir_path}/in.csv"
    with open(path, "w") as f:
        f.write("title,extra,parent_asin\nMyTitle,x,A1\n,y,A2\n")
    schema = T.StructType([T.StructField("parent_asin", T.StringType()), T.StructField("title", T.StringType())])
    assert [tuple(r) for r in csv_src.read_csv_keep_empty(spark, path, schema).collect()] == [("A1", "MyTitle"), ("A2", "")]
    assert [tuple(r) for r in csv_src.read_csv_default_na(spark, path, schema).collect()] == [("A1", "MyTitle"), ("A2", None)]
    with pytest.raises(ValueError, match="brand"):
        csv_src.read_csv_keep_empty(spark, path, T.StructType([T.StructField("brand", T.StringType())]))


def test_image_names_with_plus_and_blank(spark, tmpdir_path):
    for name in ("a+b.png", "c d.png"):
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(b"not an image")
    for root in (tmpdir_path, f"file://{tmpdir_path}"):
        assert sorted(r.path for r in images.read_image_dir(spark, root).collect()) == ["a+b.png", "c d.png"]


def test_strata_without_held_out_rows_are_allowed(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 9), ("c", 100)], f"{splits.STRATUM} string, __c long")
    got = {r[0]: (r.q_train, r.q_val) for r in splits.split_quotas(counts).collect()}
    assert got["a"] == (2, 0) and sum(q for q, _ in got.values()) == 88


def test_nan_rating_is_its_own_stratum(spark):
    df = spark.createDataFrame([(i, float("nan") if i < 3 else 4.0) for i in range(60)], "item_id long, average_rating double")
    got = {r[0] for r in splits.rare_strata(df, threshold=50).filter(F.col("item_id") < 3).select(splits.STRATUM).collect()}
    assert got == {"nan"}


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_runs_without_batches_or_samples_do_not_stop_the_others(spark, tmpdir_path):
    import os

    from kiln.config import RuntimeConfig
    from kiln.operators import runtime
    from kiln.plans import benchmark
    rows = [(r, b, "cuda:0" if r == 1 else "cpu", b * 1000, b * 1000 + 500, 0 if r == 3 else 4, 8, 1 << 20, 1 << 20)
            for r, n in ((1, 8), (2, 3), (3, 8)) for b in range(n)]
    t = spark.createDataFrame(rows, "run_id long, batch_idx int, device string, start_us long, end_us long, batch_size int, tokens int, "
                                    "alloc_bytes long, reserved_bytes long")
    got = {r.run_id: r for r in runtime.checked_report(t, warmup=5).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "no measured batch", 3: "no sample"}
    assert got[1].num_samples == 12 and got[1].peak_alloc_mib == 1.0 and got[3].latency_ms_per_sample is None
    plain = {r.run_id: r for r in runtime.runtime_report(t, warmup=5).collect()}
    assert set(plain) == {1, 3} and plain[1].latency_ms_per_sample == got[1].latency_ms_per_sample
    assert {r.run_id for r in runtime.rejected_runs(runtime.checked_report(t, 5)).collect()} == {2, 3}
    counts = benchmark.report_good_runs(t, os.path.join(tmpdir_path, "rep"), RuntimeConfig(warmup_batches=5))
    assert counts == {"runs": 3, "rejected": 2}
    with pytest.raises(Exception, match="No batches were measured"):
        runtime.runtime_report(t.filter("run_id <> 2"), 5, fail_on_empty=True).collect()


def test_every_input_row_reaches_the_submission(spark, tmpdir_path):
    import os

    from kiln.operators import scoring
    from kiln.plans import inference
    path, folder = os.path.join(tmpdir_path, "in.csv"), os.path.join(tmpdir_path, "imgs")
    os.makedirs(folder)
    with open(path, "w") as f:
        f.write("parent_asin,main_category,title,features,description,image_paths\nA1,c,NA,f,d,\nA2,c,t,f,d,\nA2,c,u,f,d,\n")
    vec = spark.createDataFrame([("A2", [0.1] * 4, [0.2] * 4)], "item_id string, image_vec array<float>, text_vec array<float>")
    sub, summary = inference.generate_submission(spark, path, folder, vec, scoring.init_head(8, 8, 1), 1e9)
    assert sorted((r.item_id, r.score is None) for r in sub.collect()) == [("A1", True), ("A2", False), ("A2", False)]
    assert summary.first().n == 3 and summary.first().seconds_per_row > 0


def test_the_training_path_reads_the_na_tokens(spark):
    from kiln.sources.csv import default_na
    df = spark.createDataFrame([("NA", "x", 1.0), ("", "None", None)], "title string, text string, n double")
    assert [tuple(r) for r in default_na(df).collect()] == [(None, "x", 1.0), (None, None, None)]


def test_groups_without_a_fit_keep_their_rows(spark):
    from kiln.operators import scoring
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "g long, features array<double>")
    fits = spark.createDataFrame([(1, [3.0], 0.5)], "g long, coef array<double>, intercept double")
    assert {r.g: r.prediction for r in scoring.predict_per_group(df, fits, "g").collect()} == {1: 3.5, 2: None}
