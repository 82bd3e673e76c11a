"""Product quantisation with nearest entries found by sliced bitmasks.

Vectors become integers, floor(scale * x), and are cut into ``parts`` equal
consecutive parts, each with a codebook of up to ``entries`` entries. All
sums, distances and means are integers, so results do not depend on order.

Nearest entry: per coordinate the entries are sorted, and prefix masks hold the
set of the first i entries as bits. An entry picked from the sorted
neighbours gives an initial radius; the entries within the radius of a
coordinate are a range of its sorted list, the XOR of two prefix masks. The
masks of all coordinates ANDed hold every entry that can be as near, and only
those get their exact distance (least distance, then least index).

A round is one narrow pass: tasks send per (part, entry) sums and counts, at
most parts * entries rows each, added up by Spark; the codebooks (parts *
entries * part length integers) are the only thing that passes the driver.

Defined results: vectors null or with a null or non-finite component are
dropped. Vectors of different length are padded by zeros to a common multiple
of ``parts``. Codebooks start from the smallest distinct ids (of rows with
equal id the least vector), fewer if there are fewer; rows with a null id start
one only if there is no other id, but are coded like any other, as repeated rows are. Components beyond
+-``LIMIT`` after scaling are an error: their distances have no 64-bit value.
Equal labels, null as one of them, add up in ``label_error``. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import staged
from kiln.operators.joins import bounded_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27
ROWS = 8192            # rows worked on at once
SALT = 64              # ways a label's rows are dealt if labels are too many to broadcast


class Codebook:
    """The entries of one part, prepared for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, dim = entries.shape
        self.words = -(-k // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order
        self.sorted = np.take_along_axis(entries, order, axis=0)
        # prefix[d, i]: bits of the first i entries by coordinate d
        self.prefix = np.zeros((dim, k + 1, self.words), np.uint64)
        for d in range(dim):
            for i in range(k):
                self.prefix[d, i + 1] = self.prefix[d, i]
                e = int(order[i, d])
                self.prefix[d, i + 1, e // 64] |= np.uint64(1 << (e % 64))
        spread = self.sorted[-1] - self.sorted[0] if k else np.zeros(dim)
        self.guides = np.argsort(-spread, kind="stable")[:3]       # coordinates that give the initial radius

    def _distance(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = x - self.entries[e]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``."""
        n, dim = x.shape
        k = len(self.entries)
        if dim == 0:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = None
        for d in self.guides:
            at = np.searchsorted(self.sorted[:, d], x[:, d])
            for near in (at - 1, at):
                got = self._distance(x, self.order[np.clip(near, 0, k - 1), d])
                best = got if best is None else np.minimum(best, got)
        radius = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
        mask = np.full((n, self.words), np.uint64(2**64 - 1))
        for d in range(dim):
            lo = np.searchsorted(self.sorted[:, d], x[:, d] - radius, side="left")
            hi = np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            mask &= self.prefix[d, hi] ^ self.prefix[d, lo]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        dist = self._distance(x[row], entry)
        first = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(dist, first)
        hit = np.flatnonzero(dist == least[row])                   # ascending entries within a row
        one = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[one], least


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(id, v, label): integer vectors that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    whole = F.transform("d", lambda x: F.when(F.abs(x) * scale < LIMIT, F.floor(x * scale).cast("bigint")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond +-{LIMIT}")).cast("bigint")))
    return (df.select(F.col(f"`{id_col}`").alias("id"), v.alias("d"), bad.alias("bad"), label.alias("label"))
            .filter("d IS NOT NULL AND NOT bad").select("id", whole.cast("array<int>").alias("v"), "label"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    n = np.diff(np.asarray(col.offsets))
    out = np.zeros((len(col), width), np.int64)
    row = np.repeat(np.arange(len(col)), n)
    out[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(col.flatten())
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One integer matrix (entries x part length) per part, learned from all
    rows of (id, v). Empty if there are no rows."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    first = vectors.groupBy("id").agg(F.min("v").alias("v"))
    start = first.filter("id IS NOT NULL").orderBy("id").limit(entries).collect() or first.collect()    # the latter: the null id alone
    if not start:
        return []
    size = max(0, -(-longest // parts))
    whole = np.zeros((len(start), size * parts), np.int64)
    for i, r in enumerate(start):
        whole[i, :len(r["v"])] = r["v"]
    books = [whole[:, p * size:(p + 1) * size] for p in range(parts)]
    for _ in range(rounds):
        now = [Codebook(b) for b in books]

        def sums(batches: Iterator[pa.RecordBatch], now: list[Codebook] = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, len(start), size), np.int64)
            count = np.zeros((parts, len(start)), np.int64)
            for b in _pieces(batches):
                x = _matrix(b.column("v"), size * parts)
                for p in range(parts):
                    part = x[:, p * size:(p + 1) * size]
                    code, _ = now[p].nearest(part)
                    np.add.at(total[p], code, part)
                    count[p] += np.bincount(code, minlength=len(start))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                 pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

        added = (vectors.select("v").mapInArrow(sums, "p int, e int, n long, s array<long>")
                 .select("p", "e", "n", F.posexplode_outer("s").alias("d", "x"))
                 .groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
        books = [b.copy() for b in books]
        for r in added:
            if r["d"] is not None:
                books[r["p"]][r["e"], r["d"]] = r["x"] // r["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code array<int>, error) of every row of (id, v, label)."""
    size, parts = books[0].shape[1], len(books)
    ready = [Codebook(b) for b in books]
    src = vectors.select("id", "label", "v")
    schema = f"id {src.schema['id'].dataType.simpleString()}, label {src.schema['label'].dataType.simpleString()}, code array<int>, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x = _matrix(b.column("v"), size * parts)
            got = [ready[p].nearest(x[:, p * size:(p + 1) * size]) for p in range(parts)]
            code = np.stack([c for c, _ in got], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(code.ravel())),
                 pa.array(sum(e for _, e in got))], names=["id", "label", "code", "error"])

    return src.mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code", result: str = "approx", scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that each code stands for; null gives null."""
    flat = [F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b]) for b in books]
    at = [F.get(flat[p], F.col(f"`{code_col}`")[p]) for p in range(len(books))]
    return codes.withColumn(result, F.when(F.col(f"`{code_col}`").isNotNull(), F.concat(*at)))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error), codebooks); ``label_error`` is
    the error summed over the rows of equal label."""
    data = staged(integer_vectors(df, id_col, vec_col, label_col, scale), "pq-vectors")
    books = fit_codebooks(data, parts, entries, rounds)
    if not books:
        return data.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error")), books
    coded = staged(encode(data, books), "pq-codes")
    per = coded.groupBy("label").agg(F.sum("error").cast("bigint").alias("label_error")).withColumnRenamed("label", "of_label")
    # Past the broadcast bound a hot label's rows are dealt over SALT tasks.
    small = bounded_broadcast(per.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    out = (coded.withColumn("salt", F.pmod(F.xxhash64("id", "error"), F.lit(SALT)).cast("int"))
           .join(small, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))))
    return out.select("id", "label", "code", "error", "label_error"), books
