"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word enters as a word vector (learned for words seen in training) next
to a character vector (mean of hashed character-trigram vectors, so inflected
and unseen words are read by their letters). A forward and a backward GRU run
over windows of ``WINDOW`` words, every window overlapping the next by half;
attention pools each window into one logit, and a document scores as its most
toxic window. All windows of every whole text are scored.

Training is plain numpy (Adam) on the driver, on at most about
``MAX_FIT_ROWS`` labelled rows (hash sample); a document's label is given to
its highest-scoring windows (log-sum-exp over windows).

Defined results: null and empty texts form one empty window and score the
network's answer to it; without labelled rows every score is 0.5; with one
class only, that class's rate. Repeated rows give equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import buffers, held_out_of, labelled_sample, mix64, slices

MAX_FIT_ROWS = 4_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_BUCKETS = 1 << 13
MAX_VOCAB = 20_000
STEPS, BATCH_DOCS, RATE, SEED = 190, 64, 0.01, 7
THRESHOLD = 0.3
_STRIP = ".,;:!?\"'()[]#$%&*-"


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word ids, row offsets, distinct words) of lower-cased whole texts;
    ids index the distinct words. Edge punctuation is dropped."""
    low = pc.utf8_lower(pc.fill_null(col, ""))
    ls = pc.ascii_split_whitespace(low)
    off = np.asarray(ls.offsets).astype(np.int64)
    enc = ls.flatten().dictionary_encode()
    return np.asarray(enc.indices).astype(np.int64), off - off[0], pc.utf8_trim(enc.dictionary, characters=_STRIP)


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte-trigram buckets, offsets) of each word, padded by a space
    on both sides; empty words have none."""
    padded = pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise(" ", words, " ", "")) if len(words) else words
    raw, off = buffers(padded)
    n = np.maximum(np.diff(off) - 2, 0)
    toff = np.concatenate([[0], np.cumsum(n)])
    if toff[-1] == 0:
        return np.zeros(0, np.int64), toff
    at = np.arange(toff[-1]) - np.repeat(toff[:-1], n) + np.repeat(off[:-1], n)
    r = raw.astype(np.uint64)
    h = mix64((r[at] << np.uint64(16)) | (r[at + 1] << np.uint64(8)) | r[at + 2])
    return (h & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64), toff


def mean_rows(table: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean of ``table[ids]`` per offset range (zeros for empty ranges)."""
    n = np.diff(off)
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(table[ids], off[:-1][full], axis=0) / n[full, None]
    return out


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word count, row) of every overlapping window; a row
    without words has one empty window."""
    n = np.diff(off)
    per = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = off[:-1][row] + k * STRIDE
    return first, np.clip(off[1:][row] - first, 0, WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and the forward / backward passes over padded windows."""

    def __init__(self, vocab: dict[str, int], seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocab = vocab
        self.p = {"word": (rng.standard_normal((len(vocab) + 1, WORD_DIM)) * 0.1).astype(np.float32),
                  "char": (rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.3).astype(np.float32),
                  "attn": init(2 * h, h), "attn_v": init(h, 1)[:, 0], "out": init(2 * h, 1)[:, 0], "bias": np.array([-1.0], np.float32)}
        self.p["word"][0] = 0
        for s in "fb":
            self.p |= {f"wx_{s}": init(d, 3 * h), f"wh_{s}": init(h, 3 * h), f"b_{s}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, word ids, trigram ids, trigram offsets) of distinct words."""
        wid = np.fromiter((self.vocab.get(w, 0) for w in words.to_pylist()), np.int64, len(words))
        tid, toff = trigrams(words)
        return np.concatenate([self.p["word"][wid], mean_rows(self.p["char"], tid, toff)], axis=1), wid, tid, toff

    def _gru(self, s: str, proj: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H); ``proj`` holds x Wx + b of each distinct
        word, ``idx`` (T, B) the word at each step, ``mask`` (T, B) its use."""
        t_max, b = idx.shape
        h = np.zeros((b, HIDDEN), np.float32)
        out = np.empty((t_max, b, HIDDEN), np.float32)
        wh = self.p[f"wh_{s}"]
        for t in (range(t_max) if s == "f" else range(t_max - 1, -1, -1)):
            x = proj[idx[t]]
            zr = _sigmoid(x[:, :2 * HIDDEN] + h @ wh[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ wh[:, 2 * HIDDEN:])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = out[t] = new
        return out

    def forward(self, vectors: np.ndarray, idx: np.ndarray, mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logit of every window (B,)."""
        keep = {"f": [], "b": []} if cache is not None else {"f": None, "b": None}
        hs = [self._gru(s, vectors @ self.p[f"wx_{s}"] + self.p[f"b_{s}"], idx, mask, keep[s]) for s in "fb"]
        h = np.concatenate(hs, axis=2)
        u = np.tanh(h @ self.p["attn"])
        e = np.where(mask > 0, u @ self.p["attn_v"], -1e9)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0) * (mask.sum(0) > 0)
        pooled = np.einsum("tb,tbh->bh", a, h)
        if cache is not None:
            cache |= {"keep": keep, "h": h, "u": u, "a": a, "pooled": pooled, "idx": idx, "mask": mask, "vectors": vectors}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, dlogit: np.ndarray, c: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the distinct word vectors."""
        p, g = self.p, {}
        g["out"], g["bias"] = c["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dpool, c["h"])
        dh = c["a"][:, :, None] * dpool
        de = c["a"] * (da - (c["a"] * da).sum(0))
        du = de[:, :, None] * p["attn_v"] * (1 - c["u"] ** 2)
        g["attn_v"] = np.einsum("tb,tbh->h", de, c["u"])
        g["attn"] = np.einsum("tbi,tbj->ij", c["h"], du)
        dh = dh + du @ p["attn"].T
        dvec = np.zeros_like(c["vectors"])
        hd = HIDDEN
        for k, s in enumerate("fb"):
            wh, carry = p[f"wh_{s}"], 0.0
            gwh, dproj = np.zeros_like(wh), np.zeros((len(c["vectors"]), 3 * hd), np.float32)
            for t, h, z, r, cand in reversed(c["keep"][s]):
                d = dh[t, :, k * hd:(k + 1) * hd] + carry
                m = c["mask"][t][:, None]
                dc = d * m * z * (1 - cand**2)
                dz = d * m * (cand - h) * z * (1 - z)
                drh = dc @ wh[:, 2 * hd:].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                carry = d * (1 - m * z) + drh * r + dzr @ wh[:, :2 * hd].T
                gwh[:, :2 * hd] += h.T @ dzr
                gwh[:, 2 * hd:] += (r * h).T @ dc
                np.add.at(dproj, c["idx"][t], np.concatenate([dzr, dc], axis=1))
            g[f"wh_{s}"], g[f"b_{s}"], g[f"wx_{s}"] = gwh, dproj.sum(0), c["vectors"].T @ dproj
            dvec += dproj @ p[f"wx_{s}"].T
        return g, dvec


def padded(first: np.ndarray, count: np.ndarray, ids: np.ndarray, t_max: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) word ids and mask of windows, padded with word 0."""
    t = np.arange(t_max)[:, None]
    mask = t < count[None, :]
    at = np.where(mask, first[None, :] + t, 0)
    idx = ids[at] if len(ids) else np.zeros(at.shape, np.int64)
    return idx, mask.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network | float:
    """Fit the network in about ``steps`` batches, whole passes over the rows;
    the class rate alone when a class is missing."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    ids, off, words = words_of(pa.array(texts, pa.string()))
    pairs = np.unique(np.repeat(np.arange(len(y)), np.diff(off)) * len(words) + ids)
    row, word = pairs // len(words), pairs % len(words)
    names = words.to_pylist()
    df: dict[str, np.ndarray] = {}
    pos, neg = np.bincount(word, y[row], len(words)), np.bincount(word, 1 - y[row], len(words))
    for w, a, b in zip(names, pos, neg):
        df[w] = df.get(w, 0) + np.array([a, b])
    seen = sorted((w for w, c in df.items() if c.sum() >= 3 and w), key=lambda w: (-df[w].sum(), w))[:MAX_VOCAB]
    net = Network({w: i + 1 for i, w in enumerate(seen)}, seed)
    rate = y.mean()
    for w, i in net.vocab.items():        # start from the word's smoothed log odds
        a, b = df[w]
        net.p["word"][i, 0] = np.clip(np.log((a + rate) / (b + 1 - rate)) - np.log(rate / (1 - rate)), -4, 4) / 2
    rng = np.random.default_rng(seed)
    first, count, wrow = windows(off)
    start = np.searchsorted(wrow, np.arange(len(y) + 1))
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, epochs = 0, max(2, -(-steps * BATCH_DOCS // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH_DOCS):
            docs = order[at:at + BATCH_DOCS]
            win = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
            idx, mask = padded(first[win], count[win], ids, max(1, int(count[win].max())))
            used, local = np.unique(idx, return_inverse=True)
            local = local.reshape(idx.shape)
            vec, wid, tid, toff = net.inputs(words.take(pa.array(used)))
            cache: dict = {}
            logit = net.forward(vec, local, mask, cache)
            top = np.full(len(docs), -np.inf, np.float32)
            np.maximum.at(top, of, logit)
            e = np.exp(2 * (logit - top[of]))
            share = e / np.bincount(of, e, len(docs))[of]
            prob = _sigmoid(top)
            dlogit = (share * (prob - y[docs])[of] / len(docs)).astype(np.float32)
            g, dvec = net.backward(dlogit, cache)
            step += 1
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], wid, dvec[:, :WORD_DIM])
            g["word"][0] = 0
            n = np.diff(toff)
            g["char"] = np.zeros_like(net.p["char"])
            np.add.at(g["char"], tid, np.repeat(dvec[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0))
            lr = RATE * (0.3 if epoch >= 0.66 * epochs else 1.0)
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return net


def score_texts(net: Network | float, col: pa.Array) -> np.ndarray:
    """Score (0..1) of each whole text: its highest window."""
    if isinstance(net, float):
        return np.full(len(col), net)
    ids, off, words = words_of(col)
    first, count, row = windows(off)
    best = np.full(len(col), -np.inf, np.float32)
    vec = net.inputs(words)[0] if len(words) else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
    for a in range(0, len(first), 8192):
        s = slice(a, a + 8192)
        idx, mask = padded(first[s], count[s], ids, WINDOW)
        np.maximum.at(best, row[s], net.forward(vec, idx, mask))
    return _sigmoid(best.astype(np.float64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int], target: str = "toxic",
                 id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Network | float:
    rows = labelled_sample(docs, labels, target, held_out, id_col, text_col, max_rows).collect()
    rows.sort(key=lambda r: (str(r["doc_key"]), r["text"]))
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def score_toxicity(docs: DataFrame, net: Network | float, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(net, b.column(1)))], names=[id_col, "score"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, score double").select(
        id_col, held_out_of(id_col, held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
