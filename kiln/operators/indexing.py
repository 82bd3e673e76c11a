"""Distributed dense row index in a global order (no single-task window).

The frame is range-partitioned and sorted on the order keys, checkpointed so
every later pass sees the same partitioning, then each row's index is its
partition's offset (a running count over the per-partition counts -- one row
per partition, so broadcasting it is size-safe) plus its position inside the
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.joins import materialize

_POS_BITS = 33


def with_row_index(df: DataFrame, order_cols, out: str = "row_idx",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order_cols`` order.
    The order keys must be unique for the index to be deterministic."""
    order_cols = list(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("__mid", F.monotonically_increasing_id()))
    s = materialize(s)
    pid = F.shiftright(F.col("__mid"), _POS_BITS)
    counts = s.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")
    pos = F.col("__mid") - F.shiftleft(F.col("__pid"), _POS_BITS)
    return (s.withColumn("__pid", pid).join(F.broadcast(offsets), "__pid")
            .withColumn(out, (F.col("__off") + pos).cast("long"))
            .drop("__pid", "__off", "__mid"))
