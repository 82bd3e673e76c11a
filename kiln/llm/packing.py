"""Conflict-constrained best-fit packing of texts into fixed-size sequences.

Texts are measured in UTF-8 bytes (one byte token each). A text longer than
the capacity is cut into full sequences of its own and one remainder; the
remainders and short texts are the pieces to pack. Two pieces of one source or
of one duplicate cluster never share a bin.

Pieces are dealt by id hash into shards of about ``SHARD_PIECES`` rows (only
id, size, source and cluster travel, not the text), so the shard count grows
with the data and a hot source is spread over all shards. Within a shard,
largest piece first, the bins are kept in order of their residual; each bin
carries a bitmap of its sources and one of its clusters. The search starts at
the successor of the piece's size and goes on to the next larger residual
until a compatible bin is found, which is therefore the tightest one; without
one a bin is opened. No bin is closed and no candidate skipped.

Defined results: null and empty texts have no bytes and are not packed; null
sources and null clusters conflict with nothing. Equal sizes go in order of
id, then cluster; repeated rows are packed each. Empty table: no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import ascii_lower, staged

CAPACITY = 8192
SHARD_PIECES = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, placed in the given order."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []          # (residual, bin), ascending
    bins: list[list[int]] = []                 # source bitmap, cluster bitmap
    out = []
    for size, src, clu in zip(sizes, sources, clusters):
        s = 0 if src is None else 1 << source_bit.setdefault(src, len(source_bit))
        c = 0 if clu is None else 1 << cluster_bit.setdefault(clu, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = bins[order[at][1]]
            if not (b[0] & s or b[1] & c):
                break
            at += 1
        if at < len(order):
            residual, k = order.pop(at)
        else:
            residual, k = capacity, len(bins)
            bins.append([0, 0])
        bins[k][0] |= s
        bins[k][1] |= c
        if residual > size:
            insort(order, (residual - size, k))
        out.append((k, capacity - residual))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per packed piece: shard, bin, id, piece, text_start, n_bytes,
    bin_offset. ``cluster``: the duplicate cluster of a document (default: the
    class of equal texts after lower-casing A-Z, as in exact dedup). Whole sequences cut from long texts are bins of their
    own in shard -1, numbered within their document (``bin`` = piece)."""
    cluster = F.md5(ascii_lower(F.col(text_col)).cast("binary")) if cluster is None else cluster
    rows = staged(docs.select(F.col(id_col).alias("pk_id"), F.octet_length(text_col).cast("bigint").alias("size"),
                              F.col(source_col).cast("string").alias("pk_source"), cluster.cast("string").alias("pk_cluster"))
                  .filter("size > 0"), "pack-pieces")
    id_type = rows.schema["pk_id"].dataType.simpleString()
    full = F.floor(F.col("size") / capacity)
    whole = (rows.filter(F.col("size") >= capacity).select("pk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
             .select(F.lit(-1).cast("bigint").alias("shard"), F.col("piece").alias("bin"), "pk_id", "piece",
                     (F.col("piece") * capacity).alias("text_start"), F.lit(capacity).cast("bigint").alias("n_bytes"),
                     F.lit(0).cast("bigint").alias("bin_offset")))
    left = rows.withColumn("piece", full).withColumn("n_bytes", F.col("size") % capacity).filter("n_bytes > 0")
    shards = max(1, -(-left.count() // shard_pieces))
    left = left.withColumn("shard", F.pmod(F.xxhash64("pk_id", "pk_cluster"), F.lit(shards)).cast("bigint"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_bytes", "descending"), ("pk_id", "ascending"), ("pk_cluster", "ascending")])
        place = best_fit(table.column("n_bytes").to_pylist(), table.column("pk_source").to_pylist(),
                         table.column("pk_cluster").to_pylist(), capacity)
        start = pa.compute.multiply(table.column("piece"), capacity)
        return pa.table({"shard": table.column("shard"), "bin": pa.array([p[0] for p in place], pa.int64()), "pk_id": table.column("pk_id"),
                         "piece": table.column("piece"), "text_start": start, "n_bytes": table.column("n_bytes"),
                         "bin_offset": pa.array([p[1] for p in place], pa.int64())})

    packed = left.select("shard", "pk_id", "piece", "n_bytes", "pk_source", "pk_cluster").groupBy("shard").applyInArrow(
        run, f"shard long, bin long, pk_id {id_type}, piece long, text_start long, n_bytes long, bin_offset long")
    return packed.unionByName(whole).withColumnRenamed("pk_id", id_col)
