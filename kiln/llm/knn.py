"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are quantised to integers, floor(scale * x). A bounded, hash-chosen set
of ``PIVOTS`` query vectors cuts the queries into groups (nearest pivot). From
summaries (group radius r; for each group the k+1 best lower bounds
p.x - r|x| over all data) follows a score every query of the group is sure to
reach; by Cauchy-Schwarz a data vector can only matter to the group if
p.x + r|x| reaches it, and only then is it sent there. Each group is solved
locally, in blocks of queries against splits of the data, and the local
winners are merged per query. All bounds are exact, so is the result.

Defined results: null vectors and vectors with null or non-finite components
take no part; vectors of different length are compared as if padded by zeros;
rows with a null id take no part. Ties go to the smaller id. Repeated rows of
one id are candidates once each, and never of a query with the same id. A
query with fewer candidates than k returns all. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.helpers import staged

PIVOTS = 16
QUERY_BLOCK, DATA_SPLIT = 1024, 16_384     # rows per side of a local problem
SCALE = 64


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(kn_id, v): integer vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("bigint").alias("kn_id"), v.alias("d"), bad.alias("bad"))
            .filter("kn_id IS NOT NULL AND d IS NOT NULL AND NOT bad")
            .select("kn_id", F.transform("d", lambda x: F.floor(x * scale).cast("bigint")).alias("v")))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(np.asarray(col.offsets))
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[row, at] = np.asarray(col.flatten())
    return out


def _local_top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, id, score) of the k best of ``x`` for every row of ``q``."""
    outs = []
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ x.T                        # exact: integers below 2^53
        own = qid[a:a + 256][:, None] == xid[None, :]
        s[own] = -np.inf
        m = min(k, s.shape[1])
        kth = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        r, c = np.nonzero((s >= kth[:, None]) & ~own)
        o = np.lexsort((xid[c], -s[r, c], r))
        r, c = r[o], c[o]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        outs.append((qid[a:a + 256][r[keep]], xid[c[keep]], s[r[keep], c[keep]].astype(np.int64)))
    return tuple(np.concatenate(z) for z in zip(*outs)) if outs else tuple(np.zeros(0, np.int64) for _ in range(3))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best others."""
    spark = vectors.sparkSession
    out_type = "query_id long, rank int, vec_id long, score long"
    data = staged(quantised(vectors, id_col, vec_col, scale), "knn-vectors")
    queries = data.filter(is_query)
    stats = data.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    picked = queries.orderBy(F.xxhash64("kn_id"), "kn_id").limit(n_pivots).collect()
    if not picked:
        return spark.createDataFrame([], out_type)
    dim = max(1, stats["dim"])
    pivots = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        pivots[i, :len(r["v"])] = r["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), dim)
            d = ((m * m).sum(1)[:, None] - 2 * m @ pivots.T + (pivots * pivots).sum(1)[None, :])
            g = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("kn_id"), b.column("v"), pa.array(g.astype(np.int32)),
                                              pa.array(np.linalg.norm(m - pivots[g], axis=1))], names=["kn_id", "v", "g", "dist"])

    grouped = staged(queries.mapInArrow(assign, "kn_id long, v array<long>, g int, dist double"), "knn-queries")
    summary = {r["g"]: (r["r"], r["n"]) for r in grouped.groupBy("g").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect()}
    radius = np.array([summary.get(g, (0.0, 0))[0] for g in range(len(pivots))]) * (1 + 1e-9) + 1e-6
    used = np.array(sorted(summary))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(pivots), k + 1), -np.inf)
        for b in batches:
            m = _matrix(b.column("v"), dim)
            low = (m @ pivots.T - np.linalg.norm(m, axis=1)[:, None] * radius[None, :]).T
            best = -np.sort(-np.concatenate([best, low], axis=1), axis=1)[:, :k + 1]
        g = np.repeat(np.arange(len(pivots), dtype=np.int32), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(best.ravel())], names=["g", "low"])

    w = Window.partitionBy("g").orderBy(F.desc("low"))
    bounds = (data.mapInArrow(lower, "g int, low double").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
              .groupBy("g").agg(F.min("low").alias("low"), F.count("*").alias("c")).collect())
    sure = np.full(len(pivots), -np.inf)
    for r in bounds:
        if r["c"] > k:
            sure[r["g"]] = r["low"] - 1e-6

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), dim)
            up = m @ pivots.T + np.linalg.norm(m, axis=1)[:, None] * radius[None, :]
            r, c = np.nonzero(up[:, used] >= sure[used][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(used[c].astype(np.int32)), b.column("kn_id").take(pa.array(r)), b.column("v").take(pa.array(r))],
                                             names=["g", "kn_id", "v"])

    splits = max(1, -(-stats["n"] // DATA_SPLIT))
    blocks = F.create_map(*[x for g, (_, n) in summary.items() for x in (F.lit(g), F.lit(max(1, -(-n // QUERY_BLOCK))))])
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = (grouped.select("g", "kn_id", "v", F.pmod(F.xxhash64("kn_id"), blocks[F.col("g")]).cast("int").alias("qb"))
         .select("*", every(F.lit(splits)).alias("ds")))
    x = (data.mapInArrow(route, "g int, kn_id long, v array<long>")
         .withColumn("ds", F.pmod(F.xxhash64("kn_id", F.lit("split")), F.lit(splits)).cast("int"))
         .select("*", every(blocks[F.col("g")]).alias("qb")))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, xi, s = _local_top(_matrix(left.column("v"), dim), np.asarray(left.column("kn_id")),
                               _matrix(right.column("v"), dim), np.asarray(right.column("kn_id")), k)
        return pa.table({"query_id": pa.array(qi, pa.int64()), "vec_id": pa.array(xi, pa.int64()), "score": pa.array(s, pa.int64())})

    key = ["g", "qb", "ds"]
    local = (q.select(*key, "kn_id", "v").groupBy(*key).cogroup(x.select(*key, "kn_id", "v").groupBy(*key))
             .applyInArrow(solve, "query_id long, vec_id long, score long"))
    wq = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
