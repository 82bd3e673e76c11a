"""Seeded, partition-independent "first q rows of each group" selection
that stays balanced when one group holds a large share of all rows.

Rows are ordered inside a group by ``md5('<seed>:<id>')`` then ``id``, the
same order a SQL engine gets from ``row_number() over (partition by g order by
md5(..), id)``. A plain window would sort a hot group in a single task, so
instead:

1. the first five hex digits of the hash define 2^20 buckets; a partial
   aggregate counts rows per (group, bucket) -- a histogram, bounded by
   groups x 2^20 rows whatever the input size;
2. a window over the histogram (per group, <= 2^20 rows) gives each bucket's
   cumulative count, which locates the bucket holding every cut position;
3. only the rows inside boundary buckets (about n_group / 2^20 each) are
   ranked exactly with a window, on (group, hash, id) alone, which gives the
   (hash, id) of the last row inside every cut;
4. every row is classified by comparing its (hash, id) with the cuts of its
   group: a broadcast join and an expression, so the wide rows are neither
   shuffled nor written, and Catalyst prunes what the result does not use.

The counting passes read the group, id and hash columns only (``narrow``).
The histogram and the cuts are checkpointed; the cuts are broadcast only under
a row bound (see ``bounded_broadcast``). A missing id ranks first in its group.
Rows with the same group and id are interchangeable; where a cut falls among
them, these rows alone (no others) are ranked by content.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.joins import bounded_broadcast, materialize

HASH = "__h"
BUCKET = "__b"
BUCKET_HEX_DIGITS = 5


def seeded_hash(seed, *parts) -> Column:
    """Lower-case hex md5 of ``'<seed>:<part>:...'`` (parts cast to string)."""
    items = [F.lit(str(seed))]
    for p in parts:
        items += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*items))


def bucket_of(h: Column) -> Column:
    return F.coalesce(F.conv(F.substring(h, 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"), F.lit(-1))


def group_histogram(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows per (group, hash bucket); ``df`` must carry ``__h``."""
    return df.groupBy(*groups, bucket_of(F.col(HASH)).alias(BUCKET)).agg(F.count(F.lit(1)).alias("__n"))


def cut_keys(narrow: DataFrame, groups: list[str], quotas: DataFrame | Callable[[DataFrame], DataFrame],
             cuts: list[str], order_col: str, hist: DataFrame | None = None) -> DataFrame:
    """One row per group of ``quotas``: for cut ``i`` the struct ``__k{i}`` =
    (hash, id) of the last row inside it (null when the cut is empty),
    ``__w{i}`` = how many rows with that hash and id are inside, and ``__t{i}``
    = how many there are."""
    if hist is None:
        hist = materialize(group_histogram(narrow, groups))
    if callable(quotas):
        quotas = quotas(hist.groupBy(*groups).agg(F.sum("__n").alias("__c")))
    w = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("__cum", F.sum("__n").over(w)).withColumn("__before", F.col("__cum") - F.col("__n"))
    # Boundary buckets: (group, bucket) with the rank, inside the bucket, of
    # the last row of every cut that ends there.
    q = [F.when((F.col("__before") < F.col(c)) & (F.col(c) <= F.col("__cum")), F.col(c) - F.col("__before"))
         for c in cuts]
    edges = (cum.join(quotas, groups, "inner").select(*groups, BUCKET, *[x.alias(f"__q{i}") for i, x in enumerate(q)])
             .filter(reduce(lambda a, b: a | b, [F.col(f"__q{i}").isNotNull() for i in range(len(cuts))])))
    edges = bounded_broadcast(edges)
    rows = (narrow.select(*groups, F.col(order_col).alias("__o"), HASH).withColumn(BUCKET, bucket_of(F.col(HASH)))
            .join(edges, [*groups, BUCKET], "inner"))
    in_bucket = Window.partitionBy(*groups, BUCKET).orderBy(HASH, "__o")
    same = Window.partitionBy(*groups, BUCKET, HASH, "__o")
    rows = (rows.withColumn("__rn", F.row_number().over(in_bucket)).withColumn("__first", F.rank().over(in_bucket))
            .withColumn("__same", F.count(F.lit(1)).over(same)))
    at = [F.col("__rn") == F.col(f"__q{i}") for i in range(len(cuts))]
    key = F.struct(F.col(HASH).alias("h"), F.col("__o").alias("o"))
    found = rows.groupBy(*groups).agg(*[
        a for i in range(len(cuts)) for a in (
            F.max(F.when(at[i], key)).alias(f"__k{i}"),
            F.max(F.when(at[i], F.col("__rn") - F.col("__first") + 1)).alias(f"__w{i}"),
            F.max(F.when(at[i], F.col("__same"))).alias(f"__t{i}"))])
    return quotas.select(*groups).join(found, groups, "left")


def cut_positions(df: DataFrame, groups: list[str], quotas: DataFrame | Callable[[DataFrame], DataFrame],
                  cuts: list[str], order_col: str, hist: DataFrame | None = None,
                  narrow: DataFrame | None = None) -> DataFrame:
    """Classify every row of ``df`` against per-group cut positions.

    ``df`` carries ``__h`` (hash hex) and ``order_col`` (tie break).
    ``quotas`` has ``groups`` + one integer column per name in ``cuts``
    (non-decreasing), or is a function from per-group row counts
    (``groups`` + ``__c``) to such a table -- the counts then come from the
    histogram, with no extra pass over ``df``. Output: ``df`` +
    ``__rank_slot`` = number of cuts the row's rank is beyond (0 = within
    the first cut). A precomputed, materialised ``hist`` (``groups`` +
    ``__b`` + ``__n``) may be passed to save the histogram pass, and a table
    of the same rows that is cheaper to read (``groups``, ``order_col``,
    ``__h``) as ``narrow``.
    """
    n = range(len(cuts))
    # Checkpointed once; broadcast only under the row bound.
    bounds = bounded_broadcast(cut_keys(df if narrow is None else narrow, groups, quotas, cuts, order_col, hist))
    inside = [F.col(f"__w{i}") < F.col(f"__t{i}") for i in n]
    divided = bounds.filter(reduce(lambda a, b: a | b, inside)).limit(1).count() > 0

    key = F.struct(F.col(HASH).alias("h"), F.col(order_col).alias("o"))
    x = df.join(bounds, groups, "left")
    drop = [f"__{k}{i}" for i in n for k in "kwt"]

    def slot(at_cut):
        return reduce(lambda a, b: a + b, [
            F.when(F.col(f"__k{i}").isNull() | (key > F.col(f"__k{i}")), 1)
            .when(key == F.col(f"__k{i}"), at_cut(i)).otherwise(0) for i in n])
    if not divided:
        return x.withColumn("__rank_slot", slot(lambda i: F.lit(0))).drop(*drop)
    among = reduce(lambda a, b: a | b, [F.coalesce(inside[i] & (key == F.col(f"__k{i}")), F.lit(False)) for i in n])
    plain = x.filter(~among).withColumn("__rank_slot", slot(lambda i: F.lit(0)))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    w = Window.partitionBy(*groups, HASH, order_col).orderBy(content)
    tied = x.filter(among).withColumn("__rn", F.row_number().over(w)).withColumn(
        "__rank_slot", slot(lambda i: F.when(F.col("__rn") > F.col(f"__w{i}"), 1).otherwise(0)))
    return plain.unionByName(tied.drop("__rn")).drop(*drop)
