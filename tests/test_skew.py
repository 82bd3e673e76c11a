"""Joins and summaries under hot keys."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import images, skew


def test_summary_counts_never_exceed_the_true_ones():
    rng = random.Random(2)
    keys = [rng.choice("abc") if rng.random() < 0.5 else f"k{rng.randrange(2000)}" for _ in range(20_000)]
    true, got = Counter(keys), {}
    for i in range(0, len(keys), 700):
        got = skew.merged(got, Counter(keys[i:i + 700]), 40)
        assert len(got) <= 40
    assert all(n <= true[k] for k, n in got.items())
    assert all(got[k] >= true[k] - len(keys) / 40 for k in "abc")


@pytest.fixture()
def hot(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # A third of the rows share one URL, a third have none, the rest differ.
    yield spark.range(0, 30_000, 1, 6).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("u"), F.col("id")))).alias("candidates"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def landed(spark):
    return spark.range(20_000).select(F.concat(F.lit("u"), F.col("id")).alias("origin"), F.lit(20).alias("width"), F.lit(20).alias("height")).unionByName(
        spark.createDataFrame([("hot", 20, 20), ("hot", 30, 30), ("small", 5, 50)], "origin string, width int, height int"))


@pytest.mark.parametrize("k", [1, None])
def test_no_task_gets_the_hot_url(spark, hot, k):
    out = images.attach_images(hot, landed(spark), k=k)
    rows = out.select("item_id", "images", "has_images", F.spark_partition_id().alias("part")).collect()
    assert len(rows) == 30_000
    for r in rows:
        want = ["hot"] if r.item_id % 3 == 0 else [] if r.item_id % 3 == 1 or r.item_id >= 20_000 else [f"u{r.item_id}"]
        assert (r.images, r.has_images) == (want, bool(want))
    sizes = list(Counter(r.part for r in rows).values())
    assert max(sizes) <= 2 * np.median(sizes)


def test_heavy_keys(spark, hot):
    one = hot.select(F.get("candidates", 0).alias("url"))
    assert skew.heavy_keys(one, "url") == ["hot"]
    assert skew.heavy_keys(one.limit(0), "url") == []
    assert skew.heavy_keys(one.filter("url IS NULL"), "url") == []


def test_rows_of_equal_id_stay_apart(spark):
    rows = spark.createDataFrame([(1, ["u1", "u2"]), (1, ["u2", "x"]), (1, ["u2", "x"]), (2, None), (None, ["small", "u3"])], "item_id long, candidates array<string>")
    got = sorted(((r.item_id, r.images) for r in images.attach_images(rows, landed(spark), k=2).collect()), key=repr)
    assert got == sorted([(1, ["u1", "u2"]), (1, ["u2"]), (1, ["u2"]), (2, []), (None, ["u3"])], key=repr)
