"""Evaluation aggregates over prediction tables, epoch history, best epoch
and early stop (V1-V9). All metrics for many runs come from one grouped
aggregation (partial aggregation, no collect of predictions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.metrics import smooth_l1
from kiln.operators.scans import running_agg


def _col(c, where: Column | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if where is None else F.when(where, c)


def pearson(x="prediction", y="label", where: Column | None = None) -> Column:
    """V3: Pearson correlation; 0.0 with fewer than two rows or a constant
    side (``corr`` itself would divide by zero under ANSI). All aggregates here
    take ``where``, the rows that they are about."""
    x, y = _col(x, where), _col(y, where)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    ok = (F.count(x) >= 2) & (sx > 0) & (sy > 0)
    return F.when(ok, F.covar_pop(x, y) / (sx * sy)).otherwise(F.lit(0.0))


def pearson_safe(x="prediction", y="label") -> Column:
    """V4: as V3, and NaN becomes 0.0."""
    r = pearson(x, y)
    return F.when(F.isnan(r), F.lit(0.0)).otherwise(r)


def regression_metrics(x="prediction", y="label", prefix: str = "", where: Column | None = None) -> list[Column]:
    """V2 + V3 + V5: mean smooth-L1 loss, MAE, RMSE (0 with no rows),
    correlation and population standard deviations."""
    d = _col(F.col(x) - F.col(y), where)
    n = F.count(_col(F.lit(1), where))
    return [
        F.coalesce(F.avg(_col(smooth_l1(x, y), where)), F.lit(0.0)).alias(f"{prefix}loss"),
        F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias(f"{prefix}mae"),
        F.sqrt(F.coalesce(F.sum(d * d) / F.greatest(n, F.lit(1)), F.lit(0.0))).alias(f"{prefix}rmse"),
        pearson(x, y, where).alias(f"{prefix}plcc"),
        F.coalesce(F.stddev_pop(_col(x, where)), F.lit(0.0)).alias(f"{prefix}std_pred"),
        F.coalesce(F.stddev_pop(_col(y, where)), F.lit(0.0)).alias(f"{prefix}std_label"),
    ]


def weighted_loss(x="prediction", y="label", w="weight", where: Column | None = None) -> Column:
    """V6: ``sum(w · loss) / count`` (divided by the row count, not the
    weight sum)."""
    return F.sum(_col(F.col(w) * smooth_l1(x, y), where)) / F.nullif(F.count(_col(F.lit(1), where)), F.lit(0))


def evaluate(df: DataFrame, keys=("run_id",)) -> DataFrame:
    """V2-V5 per key."""
    return df.groupBy(*keys).agg(*regression_metrics())


def epoch_history(preds: DataFrame, lr: DataFrame | Column | None = None) -> DataFrame:
    """V7: one row per (run, epoch) that has training and validation rows:
    training loss (weighted), correlation and spreads over the training rows;
    loss, correlation, MAE, RMSE and spreads over the validation rows; ``lr`` is
    passed through when given, as a table or as an expression over run and epoch.

    Both splits are read in one scan and one grouping: every aggregate has its
    split as condition, and all of them combine map-side."""
    train, val = (F.col("split") == s for s in ("train", "val"))
    keys = ["run_id", "epoch"]
    h = (preds.filter(train | val).groupBy(*keys)
         .agg(weighted_loss(where=train).alias("train_loss"), pearson(where=train).alias("train_plcc"),
              F.stddev_pop(_col("prediction", train)).alias("train_std_pred"),
              F.stddev_pop(_col("label", train)).alias("train_std_label"),
              *regression_metrics(prefix="val_", where=val),
              F.count(_col(F.lit(1), train)).alias("__train"), F.count(_col(F.lit(1), val)).alias("__val"))
         .filter((F.col("__train") > 0) & (F.col("__val") > 0)).drop("__train", "__val"))
    if isinstance(lr, Column):
        return h.withColumn("lr", lr)
    return h if lr is None else h.join(lr, keys, "left")


def best_and_stop(history: DataFrame, metric: str = "val_plcc", patience: int = 1) -> DataFrame:
    """V8 + V9 per run: an epoch improves when its metric is strictly above
    every earlier epoch's (a NaN epoch never improves and never becomes the
    best); training stops at the first epoch that is ``patience`` or more
    epochs past the last improvement. Reports the stop epoch (null when
    never reached) and the best epoch and value up to it.

    Improvements are strict, so the last improving epoch up to epoch ``e`` is
    the earliest epoch that reached the running best. One running maximum of
    ``(metric, -epoch)`` therefore gives both the best value and the last
    improvement. It is a blocked scan (``scans.running_agg``), so a run with
    very many epochs is not sorted in one task. One grouped aggregation then
    reads the scan state at the stop epoch, or at the last epoch when the run
    never stops; there is no join back to the epochs."""
    m = F.col(metric)
    valid = F.when(~F.isnan(m), m)
    key = F.when(valid.isNotNull(), F.struct(valid.alias("v"), (-F.col("epoch")).alias("ne")))
    h = running_agg(history, ["run_id"], "epoch", key, "max", "__run")
    last_imp = -F.col("__run.ne")
    since = F.col("epoch") - F.coalesce(last_imp, F.lit(0))
    state = F.struct(F.col("epoch").alias("e"), last_imp.alias("b"), F.col("__run.v").alias("v"))
    g = h.groupBy("run_id").agg(
        F.min_by(state, F.when(since >= patience, F.col("epoch"))).alias("__stop"),
        F.max_by(state, F.col("epoch")).alias("__last"))
    at = F.coalesce(F.col("__stop"), F.col("__last"))
    best_epoch = at["b"]
    return g.select("run_id", best_epoch.alias("best_epoch"),
                    F.when(best_epoch.isNotNull(), at["v"]).alias(f"best_{metric}"),
                    F.col("__stop")["e"].alias("stop_epoch"))
