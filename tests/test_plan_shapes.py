"""Plan checks: JVM-only operators have no Python node, scans read only the
columns they need, the sampling plan has no single-partition exchange on the
big side; and the SQL functions equal the Column functions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from kiln.functions.sql import register_sql_functions
from kiln.functions.text import clean_text, format_details, product_text, scrub, strip
from kiln.sources.fixtures import view

from .conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


JVM_ONLY = ["N1_field_defaults", "N2_features_text", "N3_description_text", "N4_image_urls", "N5_video_urls",
            "N7_scrub", "C1_quotes", "C2_urls", "C3_tags", "C4_whitespace", "C_clean_text", "V1_smooth_l1",
            "V2_loss_mae_rmse", "V7_history", "V8_V9_best_stop_p1", "E1_param_totals", "E4_dataset_flops",
            "E8_report", "R5_rates", "R7_peak_memory", "T4_vocabulary", "I4_valid_size"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_node(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p


def test_column_pruning_reaches_scan(spark):
    p = plan(E.queries()["E2_block_flops"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_sampling_big_side_not_single_partition(spark):
    p = plan(E.queries()["P1_sample"](spark, SF001))
    assert "SinglePartition" not in p
    assert "BroadcastHashJoin" in p


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    t = view(spark, "texts", SF001)
    r = t.select(F.expr("kiln_clean_text(t)").alias("a"), clean_text("t").alias("b"),
                 F.expr("kiln_scrub(t)").alias("c"), scrub("t").alias("d"),
                 F.expr("kiln_strip(t)").alias("e"), strip("t").alias("f"),
                 F.expr("kiln_is_missing(substr(t, 1, 0))").alias("g"))
    assert r.filter("a <> b or c <> d or e <> f or not g").count() == 0
    raw = view(spark, "raw", SF001).select("details", "main_category", "title")
    r2 = raw.select(F.expr("kiln_format_details(details)").alias("a"), format_details("details").alias("b"))
    assert r2.filter("not (a <=> b)").count() == 0
    df = spark.createDataFrame([("m", "t", "", None, "d")], "main_category string, title string, features string, "
                               "description string, details string")
    assert df.select(F.expr("kiln_product_text(main_category, title, features, description, details)")).first()[0] == \
        df.select(product_text()).first()[0]


@pytest.mark.parametrize("name", ["W2_weights", "A1_category_counts", "A2_rating_counts"])
def test_scalars_are_subqueries_not_cross_joins(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_staged_sampling_and_split_match_unstaged(spark):
    from kiln.operators import sampling, splits
    from kiln.plans import catalog as C
    k = C.normalize.relabel_category(C.kept(spark, SF001))
    a = sampling.sample_per_group(k, "category", "item_id", 0.2, 12, 42, stage=True).select("item_id")
    b = sampling.sample_per_group(k, "category", "item_id", 0.2, 12, 42, stage=False).select("item_id")
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    kept = C.kept(spark, SF001)
    s1 = splits.rare_stratified_split(kept, "average_rating", 24, seed=42, stage=True).select("item_id", "split")
    s2 = splits.rare_stratified_split(kept, "average_rating", 24, seed=42, stage=False).select("item_id", "split")
    assert s1.count() == s2.count() == kept.count() and s1.exceptAll(s2).count() == 0


@pytest.mark.parametrize("name", ["P1_sample", "P3_P4_split", "P5_split_sizes", "W1_mean_log_count", "W2_weights",
                                  "A1_category_counts", "T1_product_text"])
def test_no_text_column_is_staged(spark, monkeypatch, name):
    from kiln.operators import joins
    staged = []

    def watch(df, what):
        staged.append(df.columns)
        return real(df, what)
    real = joins.stage_parquet
    monkeypatch.setattr(joins, "stage_parquet", watch)
    E.queries()[name](spark, SF001).count()
    narrow = {"item_id", "category", "average_rating", "rating_number"}
    assert staged and all(set(cols) <= narrow for cols in staged), staged


def test_vocabulary_ids_need_no_single_task(spark):
    p = plan(E.queries()["T4_vocabulary"](spark, SF001))
    assert "TakeOrderedAndProject" not in p
    assert all("__pid" in line and "cnt#" not in line.split("windowspecdefinition")[1] for line in p.splitlines() if "windowspecdefinition" in line)


def test_partition_filters_reach_the_scan_through_the_keep_filter(spark, tmpdir_path):
    import os

    from pyspark.sql import functions as F

    from kiln.operators import filters, normalize
    from kiln.plans import catalog
    raw = catalog.raw(spark, SF001)
    path = os.path.join(tmpdir_path, "by-category")
    raw.write.partitionBy("category").parquet(path)
    src = spark.read.parquet(path)
    one = src.select("category").first()[0]
    kept = filters.filter_records(normalize.normalize_records(src, hi_res="hi_res", large="large", videos="videos"))
    got = kept.filter(F.col("category") == one)
    plan = got._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().split("\n") if "FileScan" in line]
    found = got._jdf.queryExecution().sparkPlan().toString()
    assert scans and f"= {one})" in found[found.index("PartitionFilters"):][:200]
    assert sorted(r.item_id for r in got.collect()) == sorted(r.item_id for r in kept.collect() if r.category == one)
