"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed from byte-class counts and word
ids; the trees are complete binary trees flattened into arrays (feature and
threshold per inner node, value per leaf), so scoring walks all documents and
trees of a batch with a few numpy gathers per level.

Fit: on the driver, from at most about ``MAX_FIT_ROWS`` labelled rows (hash
sample); their statistics are computed by Spark, only numbers are collected.

Defined results: null and empty texts have all-zero statistics and are scored
like any other; without labelled rows, or with one class only, every score is
the class rate (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import buffers, held_out_of, labelled_sample, slices

MAX_FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF = 80, 4, 64, 0.15, 20
THRESHOLD = 0.3

STATS = ["log_bytes", "log_words", "mean_word", "max_word", "upper", "digit", "punct", "symbol", "bang", "space", "newline",
         "non_ascii", "distinct_words", "repeat_next", "repeat_second", "duplicate_lines", "words_per_line", "symbol_words", "top_word"]

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 "!", 7 blank, 8 newline, 9 non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
for _ch in ".,;:?'\"()-":
    _CLASS[ord(_ch)] = 4
for _ch in "#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[ord(_ch)] = 5
_CLASS[ord("!")], _CLASS[32], _CLASS[9], _CLASS[10] = 6, 7, 7, 8


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def _distinct(ids: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, count of the most frequent id) per row."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    keys, counts = np.unique(row * max(size, 1) + ids, return_counts=True)
    r = keys // max(size, 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r, counts)
    return np.bincount(r, minlength=n), top


def doc_stats(col: pa.Array) -> np.ndarray:
    """(rows, len(STATS)) float64 statistics of whole texts."""
    raw, off = buffers(col)
    n = len(off) - 1
    size = np.diff(off)
    cls = _CLASS[raw]
    per = [_sums(cls == k, off) for k in range(10)]
    text = pc.fill_null(col, "")
    words = pc.ascii_split_whitespace(text)
    woff = np.asarray(words.offsets).astype(np.int64)
    flat = words.flatten()
    woff = woff - woff[0]
    enc = flat.dictionary_encode()
    wid = np.asarray(enc.indices).astype(np.int64)
    lens_u = np.asarray(pc.binary_length(enc.dictionary)).astype(np.int64)
    wlen = lens_u[wid] if len(wid) else np.zeros(0, np.int64)
    sym_u = np.asarray(pc.match_substring_regex(enc.dictionary, r"[#$%&*!]{2}")).astype(bool)
    nw = np.diff(woff)
    row = np.repeat(np.arange(n), nw)
    same1 = np.zeros(len(wid), bool)
    same2 = np.zeros(len(wid), bool)
    if len(wid) > 1:
        same1[1:] = (wid[1:] == wid[:-1]) & (row[1:] == row[:-1])
    if len(wid) > 2:
        same2[2:] = (wid[2:] == wid[:-2]) & (row[2:] == row[:-2])
    uniq, top = _distinct(wid, woff, len(lens_u))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, wlen)
    lines = pc.split_pattern(text, "\n")
    loff = np.asarray(lines.offsets).astype(np.int64)
    lenc = lines.flatten().dictionary_encode()
    loff = loff - loff[0]
    luniq, _ = _distinct(np.asarray(lenc.indices).astype(np.int64), loff, len(lenc.dictionary))
    nl = np.diff(loff)
    b, w, ln = np.maximum(size, 1), np.maximum(nw, 1), np.maximum(nl, 1)
    letters = np.maximum(per[1] + per[2] + per[9], 1)
    out = np.stack([np.log1p(size), np.log1p(nw), _sums(wlen, woff) / w, longest, per[2] / letters, per[3] / b, per[4] / b, per[5] / b,
                    per[6] / b, per[7] / b, per[8] / b, per[9] / b, uniq / w, _sums(same1, woff) / w, _sums(same2, woff) / w,
                    1 - luniq / ln, nw / ln, _sums(sym_u[wid] if len(wid) else wid, woff) / w, top / w], axis=1)
    out[size == 0] = 0.0
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE, min_leaf: int = MIN_LEAF, reg: float = 1.0) -> dict:
    """Flattened model: base score, feature/threshold (trees, inner nodes),
    value (trees, leaves). Logistic loss, gain from gradient histograms."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    p = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))))
    model = {"base": base, "depth": depth, "feature": np.zeros((trees, inner), np.int32),
             "threshold": np.full((trees, inner), np.inf), "value": np.zeros((trees, leaves))}
    if len(y) < 2 * min_leaf or p in (0.0, 1.0):
        return model
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    score = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)                       # heap index of inner nodes
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-6)
            where_f, where_c = np.zeros(width, np.int64), np.full(width, -1)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = local * bins + binned[:, j]
                gs = np.bincount(k, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(k, h, width * bins).reshape(width, bins).cumsum(1)
                cs = np.bincount(k, minlength=width * bins).reshape(width, bins).cumsum(1)
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + reg) + (gt - gs)**2 / (ht - hs + reg) - gt**2 / (ht + reg)
                gain[(cs < min_leaf) | (ct - cs < min_leaf)] = -1
                gain[:, len(cuts[j]):] = -1
                c = gain.argmax(1)
                val = gain[np.arange(width), c]
                up = val > best
                best[up], where_f[up], where_c[up] = val[up], j, c[up]
            thr = np.array([cuts[f][c] if c >= 0 else np.inf for f, c in zip(where_f, where_c)])
            model["feature"][t, first:first + width] = where_f
            model["threshold"][t, first:first + width] = thr
            node = 2 * node + 1 + (x[np.arange(n), where_f[local]] > thr[local])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        model["value"][t] = -rate * gs / (hs + reg)
        score += model["value"][t][leaf]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1; documents x trees walk level by level."""
    n, trees = len(x), len(model["feature"])
    rows, ts = np.arange(n)[:, None], np.arange(trees)[None, :]
    node = np.zeros((n, trees), np.int64)
    for _ in range(model["depth"]):
        node = 2 * node + 1 + (x[rows, model["feature"][ts, node]] > model["threshold"][ts, node])
    leaf = node - ((1 << model["depth"]) - 1)
    return 1 / (1 + np.exp(-(model["base"] + model["value"][ts, leaf].sum(1))))


def _stat_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = doc_stats(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_key"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_key", "label", "x"])
    key = rows.schema["doc_key"].dataType.simpleString()
    return rows.select("doc_key", "text", "label").mapInArrow(run, f"doc_key {key}, label int, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int], target: str = "quality",
                id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> dict:
    rows = _stat_rows(labelled_sample(docs, labels, target, held_out, id_col, text_col, max_rows)).collect()
    rows.sort(key=lambda r: (str(r["doc_key"]), r["x"]))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(STATS))
    return fit_trees(x, np.array([r["label"] for r in rows], dtype=np.float64))


def score_quality(docs: DataFrame, model: dict, held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id",
                  text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(model, doc_stats(b.column(1))))], names=[id_col, "score"])

    kind = src.schema[0].dataType.simpleString()
    out = src.mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out_of(id_col, held_out).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
