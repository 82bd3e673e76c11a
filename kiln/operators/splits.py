"""Rare-value strata and stratified train/validation/test splits.

Sizes follow the usual stratified shuffle split: ``n_test = ceil(test_size*n)``,
``n_train = n - n_test``; per-stratum training quotas are the floors of the
proportional shares plus one for the largest remainders (ties by stratum
label). Inside a stratum rows are taken in seeded hash order, so the split is
disjoint, complete and independent of partitioning. A stratum with a single
row is rejected, as the library splitter does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.joins import bounded_broadcast, materialize, staged_keys
from kiln.operators.ranking import BUCKET, HASH, cut_positions, group_histogram, seeded_hash

STRATUM = "strat_label"


def rare_strata(df: DataFrame, value_col: str = "average_rating", threshold: int = 50,
                out_col: str = STRATUM) -> DataFrame:
    """Values seen at most ``threshold`` times become ``RARE``; others
    keep their string form. The value-count table is checked before it is
    broadcast."""
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("__vc"))
    counts = bounded_broadcast(_strata_map(counts, value_col, threshold, out_col))
    return _attach_strata(df, counts, value_col)


def _strata_map(counts: DataFrame, value_col: str, threshold: int, out_col: str) -> DataFrame:
    """value -> stratum label; a missing value keeps its own label ``nan``
    (it is never counted as rare), like a string cast of NaN."""
    missing = F.col(value_col).isNull() | F.isnan(F.col(value_col).cast("double"))
    label = (F.when(missing, F.lit("nan"))
             .when(F.col("__vc") <= threshold, F.lit("RARE"))
             .otherwise(F.col(value_col).cast("string")))
    return counts.select(value_col, label.alias(out_col))


def _attach_strata(df: DataFrame, mapping: DataFrame, value_col: str) -> DataFrame:
    m = mapping.withColumnRenamed(value_col, "__v")
    return df.join(m, df[value_col].eqNullSafe(m["__v"]), "left").drop("__v")


def _largest_remainder(counts: DataFrame, total_col: str, draws_col: str, label: str,
                       out_col: str) -> DataFrame:
    """Integer quotas summing to ``draws`` per stratum count ``__c``:
    floor of share, leftovers to the largest remainders (ties by label)."""
    prod = F.col("__c") * F.col(draws_col)
    w_all = Window.partitionBy(F.lit(0))
    w_rank = Window.partitionBy(F.lit(0)).orderBy(
        F.desc(prod % F.col(total_col)), F.col(label))
    return (counts
            .withColumn("__fl", F.floor(prod / F.col(total_col)).cast("long"))
            .withColumn("__need", F.col(draws_col) - F.sum("__fl").over(w_all))
            .withColumn(out_col, F.col("__fl") + F.when(F.row_number().over(w_rank) <= F.col("__need"), 1)
                        .otherwise(0))
            .drop("__fl", "__need"))


def split_quotas(strata_counts: DataFrame, label: str = STRATUM, test_size: float = 0.2,
                 second_test_size: float = 0.5) -> DataFrame:
    """Per-stratum ``q_train`` and ``q_val`` (test is the rest) for the
    two-step split. Input: ``label``, ``__c``. The strata table is small (one
    row per stratum); the windows over it run on one partition by design."""
    w_all = Window.partitionBy(F.lit(0))
    c = strata_counts.withColumn("__n", F.sum("__c").over(w_all))
    c = c.withColumn("__chk", F.assert_true(
        F.min("__c").over(w_all) >= 2,
        F.lit("The least populated stratum has only 1 member; every stratum needs at least 2.")))
    c = c.withColumn("__n_train", F.col("__n") - F.ceil(F.col("__n") * F.lit(float(test_size))).cast("long"))
    c = _largest_remainder(c, "__n", "__n_train", label, "q_train")
    # Second split over the held-out part, stratified the same way.
    t = (c.withColumn("__c", F.col("__c") - F.col("q_train"))
         .withColumn("__t", F.sum("__c").over(w_all)))
    t = t.withColumn("__chk2", F.assert_true(
        (F.col("__t") == 0) | (F.min(F.when(F.col("__c") > 0, F.col("__c"))).over(w_all) >= 2),
        F.lit("The least populated stratum of the held-out part has only 1 member.")))
    t = t.withColumn("__n_val", F.col("__t") - F.ceil(F.col("__t") * F.lit(float(second_test_size))).cast("long"))
    t = _largest_remainder(t, "__t", "__n_val", label, "q_val")
    # assert_true yields null when it holds; folding it into the quotas keeps
    # the checks in every plan that reads them (a separate column could be
    # pruned away).
    return t.select(label, F.coalesce(F.col("__chk").cast("long"), F.col("q_train")).alias("q_train"),
                    F.coalesce(F.col("__chk2").cast("long"), F.col("q_val")).alias("q_val"))


def stratified_split(df: DataFrame, label: str = STRATUM, id_col: str = "item_id", seed: int = 42,
                     test_size: float = 0.2) -> DataFrame:
    """P3 + P4: add ``split`` in {train, val, test} (80/10/10 by default)."""
    h = df.withColumn(HASH, seeded_hash(seed, id_col))

    def quotas(counts):
        q = split_quotas(counts, label, test_size)
        return q.select(label, F.col("q_train").alias("__q1"), (F.col("q_train") + F.col("q_val")).alias("__q2"))
    ranked = cut_positions(h, [label], quotas, ["__q1", "__q2"], id_col)
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")),
                         F.col("__rank_slot") + 1)
    return ranked.withColumn("split", split).drop("__rank_slot", HASH)


def rare_stratified_split(df: DataFrame, value_col: str = "average_rating", threshold: int = 50,
                          id_col: str = "item_id", seed: int = 42, test_size: float = 0.2,
                          label: str = STRATUM, stage: bool = True, keep: list[str] | None = None) -> DataFrame:
    """P2 + P3 + P4 with one pass for counting: a histogram per (value,
    hash bucket) gives the value counts (for the rare merge) and, re-keyed
    through the small value -> stratum map, the per-stratum histogram the
    cut positions need. Same result as ``stratified_split(rare_strata(..))``.
    ``stage`` and ``keep`` as in ``sample_per_group``: only (value, id) and the
    kept columns are written."""
    rows, narrow = staged_keys(df, [value_col, id_col], stage, keep, "split-input")
    keys = narrow.withColumn(HASH, seeded_hash(seed, id_col))
    vhist = materialize(group_histogram(keys, [value_col]))
    counts = vhist.groupBy(value_col).agg(F.sum("__n").alias("__vc"))
    # A small aggregation of the checkpointed histogram: measured, not
    # checkpointed again.
    mapping = bounded_broadcast(_strata_map(counts, value_col, threshold, label), materialized=True)
    m = mapping.withColumnRenamed(value_col, "__v")
    # Re-keyed from the checkpointed value histogram (small), so no new pass.
    shist = (vhist.join(m, vhist[value_col].eqNullSafe(m["__v"]), "inner")
             .groupBy(label, BUCKET).agg(F.sum("__n").alias("__n")))
    rows = _attach_strata(rows.withColumn(HASH, seeded_hash(seed, id_col)), mapping, value_col)

    def quotas(c):
        q = split_quotas(c, label, test_size)
        return q.select(label, F.col("q_train").alias("__q1"), (F.col("q_train") + F.col("q_val")).alias("__q2"))
    ranked = cut_positions(rows, [label], quotas, ["__q1", "__q2"], id_col, hist=shist,
                           narrow=_attach_strata(keys, mapping, value_col))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("__rank_slot") + 1)
    return ranked.withColumn("split", split).drop("__rank_slot", HASH)


def split_sizes(split_df: DataFrame) -> DataFrame:
    """P5: rows per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def epoch_order(df: DataFrame, epoch, id_col: str = "item_id", seed: int = 42) -> Column:
    """Seeded per-epoch shuffle key ``md5('<seed>:<epoch>:<id>')``."""
    return seeded_hash(seed, F.lit(epoch) if not isinstance(epoch, Column) else epoch, id_col)


def shuffle_rows(df: DataFrame, epoch: int, id_col: str = "item_id", seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """``row_ord`` = seeded shuffle position for training rows; other
    splits keep their id order. The global order is a range-partitioned sort
    (no single-partition window)."""
    key = F.when(F.col(split_col) == "train", epoch_order(df, epoch, id_col, seed))
    return df.withColumn("shuffle_key", key)
