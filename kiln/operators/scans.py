"""Per-group row numbers and running aggregates that stay balanced when one
group holds a large share of all rows.

A window ``partition by g order by o`` sends every row of a group to one
task, so a group holding a third of the table is sorted by a single core.
The two operators here split such a group:

* ``group_row_number``: range-partition on ``(g, o)`` -- the sampled range
  bounds cut a hot group into many partitions -- sort inside partitions and
  checkpoint, so positions are fixed. A per-(partition, group) count table
  (at most partitions + groups rows) gives each piece's offset through a
  window over that small table, broadcast under a checked row bound.
* ``running_agg``: a running max or sum over an integer order key, as a
  blocked scan: a partial aggregate per (g, block) of ``block`` consecutive
  keys, a window over the small block table for everything before a block,
  and a window per (g, block) -- at most ``block`` rows -- inside it.

Both equal the plain window results (checked in tests by brute force).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.joins import bounded_broadcast, materialize

_POS_BITS = 33
BLOCK = 4096


def group_row_number(df: DataFrame, group_cols, order_cols, out: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based ``row_number() over (partition by group_cols
    order by order_cols)``. ``order_cols`` must be unique within a group."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = group_cols + order_cols
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("__mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("__mid"), _POS_BITS)
    pieces = (s.groupBy(pid.alias("__pid"), *group_cols)
              .agg(F.count(F.lit(1)).alias("__cnt"), F.min("__mid").alias("__first")))
    w = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # The piece table has at most partitions + groups rows. It is counted
    # and broadcast under the row bound: planned statically, so the big side
    # is never shuffled; beyond the bound the join shuffles on (partition,
    # group), which still spreads a hot group.
    offsets = bounded_broadcast(pieces.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0)))
                                .drop("__cnt"))
    j = s.withColumn("__pid", pid).join(offsets, ["__pid", *group_cols], "inner")
    return (j.withColumn(out, (F.col("__off") + F.col("__mid") - F.col("__first") + 1).cast("long"))
            .drop("__pid", "__off", "__first", "__mid"))


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "max":
        return F.greatest(a, b)           # skips nulls
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running_agg(df: DataFrame, group_cols, index_col: str, value: Column, fn: str = "max",
                out: str = "running", inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Add ``out`` = ``fn(value) over (partition by group_cols order by
    index_col rows between unbounded preceding and current row)`` (or ``and
    1 preceding`` when not ``inclusive``). ``fn`` is ``max`` (nulls
    skipped; null when nothing precedes) or ``sum`` (0 when nothing
    precedes). ``index_col`` is an integer, unique within a group."""
    group_cols = list(group_cols)
    agg = F.max if fn == "max" else F.sum
    blk = F.floor(F.col(index_col) / F.lit(block)).cast("long")
    x = df.withColumn("__v", value).withColumn("__blk", blk)
    per_block = x.groupBy(*group_cols, "__blk").agg(agg("__v").alias("__bv"))
    wb = Window.partitionBy(*group_cols).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select(*group_cols, "__blk", agg("__bv").over(wb).alias("__pre"))
    end = 0 if inclusive else -1
    wi = Window.partitionBy(*group_cols, "__blk").orderBy(index_col).rowsBetween(Window.unboundedPreceding, end)
    inside = x.withColumn("__in", agg("__v").over(wi))
    r = inside.join(before, [*group_cols, "__blk"], "inner").withColumn(out, _combine(fn, F.col("__pre"), F.col("__in")))
    if fn == "sum":
        r = r.withColumn(out, F.col(out).cast(df.select(value.alias("__t")).schema["__t"].dataType))
    return r.drop("__v", "__blk", "__pre", "__in")
