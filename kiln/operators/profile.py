"""Profiling aggregates of the prepared table (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, count_name: str = "count") -> DataFrame:
    """A1/A2: non-null value counts with percentage of the non-null total,
    ordered by count descending then value. The total is a scalar subquery
    over the (small) grouped counts; Spark reuses the counts' shuffle for it."""
    x = df.filter(F.col(col).isNotNull())
    counts = x.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    total = counts.agg(F.sum(count_name)).scalar()
    return (counts.withColumn("percentage", F.col(count_name) * F.lit(100.0) / total)
            .orderBy(F.desc(count_name), F.col(col)))


def column_profile(df: DataFrame) -> DataFrame:
    """A3: one row per column -- position, name, non-null count, type --
    from one aggregation pass."""
    agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                              F.col(f"c{i}").cast("long").alias("non_null"),
                              F.lit(f.dataType.simpleString()).alias("dtype"))
                     for i, f in enumerate(df.schema.fields)])
    return agg.select(F.inline(rows))


def first_row(df: DataFrame, order_col: str) -> DataFrame:
    """A4: the first row by ``order_col``, transposed to (position, column,
    value as string). Top-1 via a global ``min`` over a struct (partial
    aggregate, no global sort)."""
    cols = [c for c in df.columns]
    rec = df.select(F.min(F.struct(F.col(order_col), *[F.col(f"`{c}`").alias(f"v{i}")
                                                       for i, c in enumerate(cols)])).alias("r"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                              F.col(f"r.v{i}").cast("string").alias("value"))
                     for i, c in enumerate(cols)])
    return rec.filter(F.col("r").isNotNull()).select(F.inline(rows))
