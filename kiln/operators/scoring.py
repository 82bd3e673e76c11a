"""Batch scoring over stored feature vectors (M1-M7).

The regression head (linear -> layer norm -> GELU, twice, then linear;
dropout off at inference) runs as NumPy over Arrow batches with the weights
broadcast once per executor. Everything around it -- gating, fusion,
clamping, formatting, summaries -- is Catalyst expressions.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.metrics import clamp_score
from kiln.operators.joins import bounded_broadcast, materialize


def gate_image_features(img="image_vec", flag="has_images") -> Column:
    """M1: image vector times the 0/1 image flag."""
    f = F.col(flag).cast("float") if isinstance(flag, str) else flag
    return F.transform(F.col(img), lambda x: x * f)


def fuse(img: Column, txt: Column) -> Column:
    """M2: concatenate image and text vectors."""
    return F.concat(img, txt)


def init_head(in_dim: int, hidden_dim: int = 512, num_outputs: int = 1, seed: int = 0) -> dict:
    """Seeded head weights (uniform fan-in init, unit norms)."""
    rng = np.random.default_rng(seed)
    b = hidden_dim // 2

    def lin(i, o):
        k = 1.0 / math.sqrt(i)
        return rng.uniform(-k, k, (i, o)), rng.uniform(-k, k, o)

    w1, b1 = lin(in_dim, hidden_dim)
    w2, b2 = lin(hidden_dim, b)
    w3, b3 = lin(b, num_outputs)
    return {"w1": w1, "b1": b1, "g1": np.ones(hidden_dim), "s1": np.zeros(hidden_dim),
            "w2": w2, "b2": b2, "g2": np.ones(b), "s2": np.zeros(b), "w3": w3, "b3": b3}


def head_param_count(p: dict) -> int:
    return int(sum(v.size for v in p.values()))


_ERF_STEP = 128                                           # nodes per unit; erf is 1 beyond 6
_ERF_NODES = np.arange(6 * _ERF_STEP + 1) / _ERF_STEP
_ERF_AT = np.array([math.erf(v) for v in _ERF_NODES])
_ERF_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_ERF_NODES ** 2)


def _erf(x: np.ndarray) -> np.ndarray:
    """erf as whole-array arithmetic: a Taylor polynomial of degree five about
    the nearest node of a grid of step 1/128, where the next term is below
    1e-15. NaN stays NaN."""
    a = np.minimum(np.abs(x), 6.0)
    i = np.rint(np.where(np.isnan(a), 0.0, a) * _ERF_STEP).astype(np.int64)
    c = _ERF_NODES[i]
    d = a - c
    q = c * c
    # Derivatives of erf beyond the first are its slope times Hermite polynomials.
    poly = d * (1 + d * (-c + d * ((4 * q - 2) / 6 + d * (c * (12 - 8 * q) / 24 + d * ((16 * q - 48) * q + 12) / 120))))
    return np.copysign(_ERF_AT[i] + _ERF_SLOPE[i] * poly, x)


def _layer_norm(x, g, s, eps=1e-5):
    mu = x.mean(axis=1, keepdims=True)
    var = x.var(axis=1, keepdims=True)
    return (x - mu) / np.sqrt(var + eps) * g + s


def _gelu(x):
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)))


def head_forward(x: np.ndarray, p: dict) -> np.ndarray:
    """NumPy reference of the head; also the golden for tests."""
    h = _gelu(_layer_norm(x @ p["w1"] + p["b1"], p["g1"], p["s1"]))
    h = _gelu(_layer_norm(h @ p["w2"] + p["b2"], p["g2"], p["s2"]))
    return (h @ p["w3"] + p["b3"])[:, 0]


def score(df: DataFrame, params: dict, feat_col: str = "features", id_cols=("id",),
          out: str = "score") -> DataFrame:
    """M3: score every row's fused vector with the head; a row without one gets a null score. Weights travel as a
    broadcast variable; each Arrow batch is one matrix product chain."""
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast(params)
    id_cols = list(id_cols)

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = bw.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            have = pdf[feat_col].notna().to_numpy()
            s = np.full(len(pdf), np.nan)                     # null without features
            if have.any():
                s[have] = head_forward(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[feat_col][have]]), p)
            res = pdf[id_cols].copy()
            res[out] = s
            yield res

    fields = [df.schema[c] for c in id_cols] + [T.StructField(out, T.DoubleType())]
    return df.select(*id_cols, feat_col).mapInPandas(fn, T.StructType(fields))


def submission(scored: DataFrame, params_total: int, flops: float, id_col: str = "item_id",
               score_col: str = "score") -> DataFrame:
    """M4 + M5: clamp to [1, 5]; score printed with two decimals (rounded
    half-even on the float32 value, as Python prints it), parameters in
    millions and cost in GFLOPs with one decimal, constant per run. A null score
    stays null."""
    s = clamp_score(F.col(score_col).cast("float").cast("double"))
    return scored.select(
        F.col(id_col).cast("string").alias("item_id"),
        F.when(s.isNotNull(), F.format_string("%.2f", F.bround(s, 2))).alias("score"),
        F.lit(f"{params_total / 1e6:.1f}").alias("params"),
        F.lit(f"{flops / 1e9:.1f}").alias("flops"))


def submission_summary(scored: DataFrame, elapsed_seconds: float | Column = 0.0,
                       score_col: str = "score") -> DataFrame:
    """M6: count, min and max clamped score, seconds per row (0 when empty)."""
    s = clamp_score(F.col(score_col))
    el = elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds))
    n = F.count(F.lit(1))
    return scored.agg(n.cast("long").alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
                      F.when(n > 0, el / n).otherwise(F.lit(0.0)).alias("seconds_per_row"))


def fit_robust(df: DataFrame, feat_col: str = "features", label_col: str = "label",
               weight_col: str | None = "weight", max_iter: int = 50, epsilon: float = 1.35):
    """M7: weighted robust (Huber) linear regression over frozen features
    with MLlib. Its loss is Huber with a jointly fitted scale, not smooth-L1;
    judge it by the evaluation metrics on held-out rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    x = df.withColumn("__v", array_to_vector(F.col(feat_col)))
    lr = LinearRegression(featuresCol="__v", labelCol=label_col, loss="huber", epsilon=epsilon,
                          maxIter=max_iter, regParam=0.0)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(x)


def _packed(n_coef: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n_coef)


def _partial_sums(df: DataFrame, group_col: str, feat_col: str, label_col: str, weight_col: str) -> DataFrame:
    """Per task and group, with residuals r under the coefficients ``beta`` of
    the row (none at first): [n, sum w, X'WX as a packed triangle, X'Wy, sum of
    w psi(r) x], W the reweighted weights and psi the loss's slope; the last
    coefficient is the intercept. ``task`` deals the rows for the next level."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for b in batches:
            code = b.column(group_col).dictionary_encode()
            group = np.asarray(pc.fill_null(code.indices, -1))
            feats = b.column(feat_col)
            size = np.diff(np.asarray(feats.offsets))
            if not b.num_rows:
                continue
            x = np.asarray(feats.flatten().cast(pa.float64())).reshape(b.num_rows, -1) if (size == size[0]).all() else None
            if x is None:
                raise ValueError("feature vectors differ in length")
            x = np.hstack([x, np.ones((len(x), 1))])
            y, w = (np.asarray(b.column(c).cast(pa.float64())) for c in (label_col, weight_col))
            beta = b.column("beta")
            have = np.asarray(beta.is_valid())
            r = np.zeros(len(x))
            if have.any():
                r[have] = np.einsum("ij,ij->i", x[have], np.asarray(beta.flatten()).reshape(-1, x.shape[1])) - y[have]
            psi = np.clip(r, -1.0, 1.0)
            irls = w / np.maximum(1.0, np.abs(r))
            up = _packed(x.shape[1])
            for g in np.unique(group).tolist():
                k = group == g
                xw = x[k] * irls[k][:, None]
                v = np.concatenate([[k.sum(), w[k].sum()], (xw.T @ x[k])[up], xw.T @ y[k], x[k].T @ (w[k] * psi[k])])
                name = code.dictionary[g].as_py() if g >= 0 else None
                acc[name] = acc[name] + v if name in acc else v
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc), kind), pa.array(list(acc.values()), pa.list_(pa.float64()))], names=[group_col, "sums"])

    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(df.schema[group_col].dataType)
    schema = T.StructType([df.schema[group_col], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return df.select(group_col, feat_col, label_col, weight_col, "beta").mapInArrow(fn, schema).withColumn("task", F.spark_partition_id() % TREE)


def _sum_arrays(table: pa.Table) -> np.ndarray:
    return np.sum([np.asarray(v.values) for v in table["sums"].combine_chunks()], axis=0)


TREE = 64        # tasks' sums are added in this many parts per group, then the parts


def fit_per_group(df: DataFrame, group_col: str, feat_col: str = "features", label_col: str = "label",
                  weight_col: str = "weight", tol: float = 1e-6, max_iter: int = 200) -> DataFrame:
    """M7 per group: weighted smooth-L1 (beta 1) linear fit per group by
    iteratively reweighted least squares until the gradient of the mean loss is
    at most ``tol`` in norm. Output, one row per group: ``group_col, n, coef,
    intercept, grad_norm, iterations, converged``.

    Reweighting minimises a quadratic that touches the loss from above, so the
    loss never rises and no step needs a search; the gradient that proves
    convergence is summed in the same pass as the next step's normal equations.
    The input is checkpointed once. A pass joins every row with its group's
    coefficients (size-checked broadcast), sums packed triangles per task and
    group, then in two levels, ``TREE`` parts per group first, so no task sees a
    sum per task of a group, and solves each group's small system on the
    executors. Only the largest gradient and a count reach the driver. Rows
    with a null feature, label or weight take no part."""
    data = materialize(df.select(group_col, feat_col, label_col, weight_col).dropna(subset=[feat_col, label_col, weight_col]))
    g_type = df.schema[group_col].dataType.simpleString()
    schema = f"`{group_col}` {g_type}, n long, beta array<double>, grad double"

    def part(table: pa.Table) -> pa.Table:
        return pa.table({group_col: table[group_col].slice(0, 1), "sums": pa.array([_sum_arrays(table)], pa.list_(pa.float64()))})

    def solve(table: pa.Table) -> pa.Table:
        v = _sum_arrays(table)
        # 2 + k (k + 1) / 2 + 2 k entries
        k = int(round((-5 + math.sqrt(25 + 8 * (len(v) - 2))) / 2))
        m = np.zeros((k, k))
        tri = k * (k + 1) // 2
        m[_packed(k)] = v[2:2 + tri]
        m = m + np.triu(m, 1).T
        beta = np.linalg.lstsq(m, v[2 + tri:2 + tri + k], rcond=None)[0]
        grad = float(np.linalg.norm(v[2 + tri + k:]) / v[1]) if v[1] > 0 else 0.0
        return pa.table({group_col: table[group_col].slice(0, 1), "n": pa.array([int(v[0])]), "beta": pa.array([beta], pa.list_(pa.float64())), "grad": pa.array([grad])})

    betas, step = None, 0
    while True:
        if betas is None:
            x = data.withColumn("beta", F.lit(None).cast("array<double>"))
        else:
            known = bounded_broadcast(betas.select(F.col(group_col).alias("of_group"), "beta"), materialized=True)
            x = data.join(known, F.col(group_col).eqNullSafe(F.col("of_group")), "left").drop("of_group")
        sums = (_partial_sums(x, group_col, feat_col, label_col, weight_col).groupBy(group_col, "task").applyInArrow(
            part, f"`{group_col}` {g_type}, sums array<double>").groupBy(group_col).applyInArrow(solve, schema))
        new = materialize(sums)
        if betas is not None:
            worst = new.agg(F.max("grad")).first()[0]
            if worst is None or worst <= tol or step >= max_iter:
                break
        betas, step = new, step + 1
    proof = new.select(F.col(group_col).alias("of_group"), F.col("grad").alias("grad_norm"))
    k = F.size("beta")
    return (betas.join(proof, F.col(group_col).eqNullSafe(F.col("of_group")))
            .select(group_col, "n", F.slice("beta", 1, k - 1).alias("coef"), F.element_at("beta", -1).alias("intercept"), "grad_norm",
                    F.lit(step).alias("iterations"), (F.col("grad_norm") <= tol).alias("converged")))


def predict_per_group(df: DataFrame, fits: DataFrame, group_col: str, feat_col: str = "features",
                      out: str = "prediction", materialized: bool = False) -> DataFrame:
    """Apply per-group linear fits (``group_col, coef, intercept``) as a
    column expression. The fit table has one row per group; it is
    checkpointed and broadcast under a row bound, else shuffle-joined.
    Rows of groups without a fit stay, with a null prediction."""
    f = bounded_broadcast(fits.select(group_col, F.col("coef").alias("__coef"),
                                      F.col("intercept").alias("__icpt")), materialized=materialized)
    dot = F.aggregate(F.zip_with(F.col(feat_col), F.col("__coef"), lambda a, b: a.cast("double") * b),
                      F.lit(0.0), lambda acc, v: acc + v)
    return df.join(f, group_col, "left").withColumn(out, dot + F.col("__icpt")).drop("__coef", "__icpt")
