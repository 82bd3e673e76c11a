"""Left joins against a table of unique keys, safe under hot and null keys.

A mergeable heavy-hitter summary (counters of the most frequent keys; what does
not fit lowers all counters alike) finds keys held by a given share of the
rows. Its counts never exceed the true ones, so a key it reports is confirmed.
At most ``2 / share`` keys can be, which bounds what is sent along: those keys'
partners are broadcast, and their rows and rows with a null key are dealt
evenly instead of by key. All other keys join by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1 / 200          # keys held by this share of the rows are heavy
DEAL = 4096              # ways rows without a partner in the shuffle are dealt


def merged(counts: dict, more: dict, capacity: int) -> dict:
    """Sum of two summaries, cut back to ``capacity`` counters: the largest
    count that does not fit is taken off every counter."""
    for k, n in more.items():
        counts[k] = counts.get(k, 0) + n
    if len(counts) <= capacity:
        return counts
    off = sorted(counts.values(), reverse=True)[capacity]
    return {k: n - off for k, n in counts.items() if n > off}


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list:
    """Non-null values of the string column ``key`` that surely hold at least
    half of ``share`` of the rows, among them every one that holds ``share``.
    One pass; a task sends at most ``4 / share`` counters."""
    capacity = int(np.ceil(4 / share))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        rows = 0
        for b in batches:
            rows += b.num_rows
            got = pc.value_counts(b.column(0).drop_null())
            counts = merged(counts, dict(zip(got.field("values").to_pylist(), got.field("counts").to_pylist())), capacity)
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), rows], pa.int64())], names=["key", "n"])

    summary = df.select(F.col(key).cast("string").alias("key")).mapInArrow(summarise, "key string, n long")
    # A null key carries the number of rows; sums of lower bounds are lower bounds.
    per = summary.groupBy("key").agg(F.sum("n").alias("n"))
    top = per.orderBy(F.desc("n"), F.desc_nulls_first("key")).limit(capacity + 1).collect()
    total = sum(r["n"] for r in top if r["key"] is None)
    return sorted(r["key"] for r in top if r["key"] is not None and r["n"] >= max(2, share / 2 * total))


def lookup_join(df: DataFrame, side: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """``df`` left-joined with ``side``, which has one row per non-null value of
    the string column ``key``; its other columns must not be in ``df``. Rows
    keep their columns, null keys find nothing."""
    added = [c for c in side.columns if c != key]
    heavy = heavy_keys(df, key, share)
    spread_out = F.col(key).isNull() | F.col(key).isin(heavy) if heavy else F.col(key).isNull()
    # Null and heavy rows get keys that no partner has, dealt by their content:
    # a row recomputed after a lost executor goes the same way again.
    content = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*content), F.lit(DEAL)).cast("string")
    left = df.withColumn("lk_key", F.when(spread_out, F.concat(F.lit("s"), salt)).otherwise(F.concat(F.lit("k"), F.col(key))))
    right = side.select(F.concat(F.lit("k"), F.col(key)).alias("lk_side"), F.struct(*added).alias("lk_found"))
    out = left.join(right, F.col("lk_key") == F.col("lk_side"), "left")
    found = F.col("lk_found")
    if heavy:
        few = side.filter(F.col(key).isin(heavy)).select(F.col(key).alias("lk_heavy"), F.struct(*added).alias("lk_more"))
        out = out.join(F.broadcast(few), F.col(key) == F.col("lk_heavy"), "left")
        found = F.coalesce(found, F.col("lk_more"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[found[c].alias(c) for c in added])
