"""Sample weights and label defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WEIGHT = 5.0


def mean_log_count(df: DataFrame, count_col: str = "rating_number", split_col: str | None = "split",
                   split_value: str = "train") -> DataFrame:
    """One-row mean of ``log1p(count)`` (null as 0) over the training rows."""
    x = df if split_col is None else df.filter(F.col(split_col) == split_value)
    return x.agg(F.avg(F.log1p(F.coalesce(F.col(count_col).cast("double"), F.lit(0.0)))).alias("mean_log_count"))


def add_weights(df: DataFrame, mean_df: DataFrame, count_col: str = "rating_number",
                out: str = "weight") -> DataFrame:
    """``min(log1p(count) / mean, 5)``; all ones when the mean is not
    positive. The one-row mean enters as a scalar subquery: Spark runs it
    once as its own job and ships the value, so no join is planned."""
    m = mean_df.select("mean_log_count").scalar()
    raw = F.log1p(F.coalesce(F.col(count_col).cast("double"), F.lit(0.0)))
    w = F.when(m > 0, raw / m).otherwise(F.lit(1.0))
    return df.withColumn(out, F.least(w, F.lit(MAX_WEIGHT)))


def label_defaults(df: DataFrame, label_col: str = "average_rating", count_col: str = "rating_number") -> DataFrame:
    """Label 0.0 when the rating column is absent; count 0.0 when null
    or absent."""
    label = F.col(label_col).cast("double") if label_col in df.columns else F.lit(0.0)
    cnt = F.coalesce(F.col(count_col).cast("double"), F.lit(0.0)) if count_col in df.columns else F.lit(0.0)
    return df.withColumn("label", label).withColumn(count_col, cnt)
