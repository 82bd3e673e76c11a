"""Sampling and split invariants, skew-safe ranking vs brute force, and
partition-count mutation (same result under 1, 7 and 64 partitions)."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.operators import sampling, splits
from kiln.operators.ranking import HASH, cut_positions, seeded_hash


def skewed(spark, n=6000):
    # Group "hot" holds most rows, the rest are spread over small groups.
    return spark.range(n).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 13).cast("string")))
        .alias("category"),
        (F.lit(1.0) + (F.col("id") * 37 % 41) / 10).alias("average_rating"))


def brute_sample(df, frac, min_samples, seed):
    w = Window.partitionBy("category").orderBy(seeded_hash(seed, "item_id"), "item_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("category"))
    t = F.least(n, F.greatest(F.floor(n.cast("double") * frac).cast("long"), F.lit(min_samples)))
    return df.withColumn("rn", F.row_number().over(w)).withColumn("t", t).filter("rn <= t").select("item_id")


def ids(df):
    return sorted(r[0] for r in df.select("item_id").collect())


def test_sample_target_double_arithmetic(spark):
    r = spark.range(1).select(sampling.sample_target(F.lit(100).cast("long"), 0.29, 10).alias("t")).first()
    assert r.t == 28


@pytest.mark.parametrize("frac,min_samples", [(0.2, 50), (0.01, 400), (0.5, 1)])
def test_sample_matches_brute_force_on_skew(spark, frac, min_samples):
    df = skewed(spark)
    got = ids(sampling.sample_per_group(df, "category", "item_id", frac, min_samples, 42))
    want = ids(brute_sample(df, frac, min_samples, 42))
    assert got == want


def test_sample_sizes_and_none(spark):
    df = skewed(spark)
    s = sampling.sample_per_group(df, frac=0.2, min_samples=50, seed=7)
    sizes = {r.category: r.n for r in s.groupBy("category").agg(F.count("*").alias("n")).collect()}
    totals = {r.category: r.n for r in df.groupBy("category").agg(F.count("*").alias("n")).collect()}
    for g, n in totals.items():
        assert sizes[g] == min(n, max(int(n * 0.2), 50))
    assert sampling.sample_per_group(df, frac=None).count() == df.count()


def test_partition_mutation(spark):
    df = skewed(spark, 3000)
    outs = []
    for p in (1, 7, 64):
        outs.append(ids(sampling.sample_per_group(df.repartition(p), frac=0.1, min_samples=20, seed=3)))
    assert outs[0] == outs[1] == outs[2]


def test_cut_positions_two_cuts(spark):
    df = skewed(spark, 4000).withColumn(HASH, seeded_hash(9, "item_id"))
    quotas = df.groupBy("category").agg(F.count("*").alias("n")).select(
        "category", F.floor(F.col("n") * 0.5).cast("long").alias("q1"), F.floor(F.col("n") * 0.8).cast("long").alias("q2"))
    got = {r["item_id"]: r["__rank_slot"] for r in cut_positions(df, ["category"], quotas, ["q1", "q2"], "item_id")
           .select("item_id", "__rank_slot").collect()}
    w = Window.partitionBy("category").orderBy(HASH, "item_id")
    b = df.withColumn("rn", F.row_number().over(w)).join(quotas, "category")
    want = {r.item_id: (0 if r.rn <= r.q1 else 1 if r.rn <= r.q2 else 2) for r in b.collect()}
    assert got == want


def test_zero_quota(spark):
    df = skewed(spark, 500).withColumn(HASH, seeded_hash(1, "item_id"))
    quotas = df.select("category").distinct().withColumn("q", F.lit(0).cast("long"))
    out = cut_positions(df, ["category"], quotas, ["q"], "item_id")
    assert out.filter("__rank_slot = 0").count() == 0
    assert out.count() == 500


def test_rare_strata(spark):
    df = skewed(spark, 2000)
    s = splits.rare_strata(df, "average_rating", 48)
    counts = {r.average_rating: r.n for r in df.groupBy("average_rating").agg(F.count("*").alias("n")).collect()}
    for r in s.select("average_rating", "strat_label").distinct().collect():
        assert r.strat_label == ("RARE" if counts[r.average_rating] <= 48 else str(r.average_rating))


def test_stratified_split_invariants(spark):
    df = splits.rare_strata(skewed(spark, 3000), "average_rating", 40)
    out = splits.stratified_split(df, seed=42).cache()
    n = out.count()
    assert n == 3000 and out.select("item_id").distinct().count() == n        # disjoint and complete
    sizes = {r.split: r.n for r in splits.split_sizes(out).collect()}
    n_test = math.ceil(0.2 * n)
    assert sizes["train"] == n - n_test
    assert sizes["val"] == n_test - math.ceil(0.5 * n_test)
    assert sizes["test"] == math.ceil(0.5 * n_test)
    # Per-stratum train share within one row of proportional.
    per = out.groupBy("strat_label").agg(F.count("*").alias("c"), F.count_if(F.col("split") == "train").alias("t"))
    for r in per.collect():
        assert abs(r.t - r.c * (n - n_test) / n) < 1.0
    again = splits.stratified_split(df.repartition(13), seed=42)
    assert sorted(map(tuple, again.select("item_id", "split").collect())) == \
        sorted(map(tuple, out.select("item_id", "split").collect()))


def test_single_member_stratum_rejected(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "item_id long, strat_label string")
    with pytest.raises(Exception, match="least populated"):
        splits.stratified_split(df).collect()


def test_shuffle_rows_index(spark):
    from kiln.operators.indexing import with_row_index
    df = skewed(spark, 1000).withColumn("split", F.lit("train"))
    s = splits.shuffle_rows(df, epoch=2)
    idx = with_row_index(s, ["shuffle_key", "item_id"], "row_ord", num_partitions=5)
    rows = idx.select("row_ord", "shuffle_key").collect()
    assert sorted(r.row_ord for r in rows) == list(range(1000))
    by_ord = [r.shuffle_key for r in sorted(rows, key=lambda r: r.row_ord)]
    assert by_ord == sorted(by_ord)


def test_one_pass_split_equals_two_step(spark):
    df = skewed(spark, 3000).withColumn(
        "average_rating", F.when(F.col("item_id") % 97 == 0, F.lit(None)).otherwise(F.col("average_rating")))
    a = splits.stratified_split(splits.rare_strata(df, "average_rating", 40), seed=5)
    b = splits.rare_stratified_split(df, "average_rating", 40, seed=5)
    key = ["item_id", "strat_label", "split"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    assert b.filter("strat_label = 'nan'").count() == df.filter("average_rating is null").count()


@pytest.mark.parametrize("quota", [1, 4, 7, 9, 10])
def test_cut_among_rows_of_equal_id(spark, quota):
    """Three rows of each of three ids and one without an id: the quota is met
    exactly and whole ids go in hash order, the missing id first."""
    rows = [(i, "g", f"t{j}") for i in ("a", "b", "c") for j in range(3)] + [(None, "g", "t0")]
    df = spark.createDataFrame(rows, "item_id string, category string, title string")
    counts = {}
    for parts in (1, 5):
        got = sampling.sample_per_group(df.repartition(parts), frac=0.0, min_samples=quota, seed=1).collect()
        assert len(got) == quota and None in {r.item_id for r in got}
        counts[parts] = sorted((r.item_id or "", r.title) for r in got)
    assert counts[1] == counts[5]
    whole = [i for i in ("a", "b", "c") if sum(k == i for k, _ in counts[1]) == 3]
    part = [i for i in ("a", "b", "c") if 0 < sum(k == i for k, _ in counts[1]) < 3]
    assert len(whole) == (quota - 1) // 3 and len(part) == (1 if (quota - 1) % 3 else 0)
