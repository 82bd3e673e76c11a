"""Removal of long repeated substrings: every byte covered by a ``LENGTH``-byte
string that also starts anywhere else is removed.

A difference-cover scheme on names. A classic cover samples fixed positions
(two of every three for triples); here the sample is chosen by content, so that
any two equal strings are sampled at the same offsets: the sample of start p is
the position of the least hash among p .. p+COVER-1.

1. *Sort sampled names.* The string of LENGTH-COVER+1 bytes at each sample is
   named by a rolling hash; samples whose name occurs once are discarded, since
   none of the starts they stand for can repeat.
2. *Recurse on names.* Surviving samples are named again with their whole
   context (all bytes of all strings they stand for). Equal contexts settle all
   their starts at once; a name with a single context needs no more work.
3. *Merge the remaining suffixes.* Where one sample name has several contexts,
   the starts between the samples are named by their own LENGTH bytes, once per
   distinct context, and sorted.
4. *Compare adjacent prefixes.* A start whose neighbour in that order has the
   same name repeats.

Repeated starts become byte spans per distinct text, and the remaining bytes
are hashed (and returned as text by ``remove_repeats``).

Defined results: null and empty texts have no bytes; texts under LENGTH bytes
lose nothing unless covered within themselves, which needs LENGTH+1 bytes.
Exact copies of LENGTH bytes or more lose everything, in every copy. Repeated
rows and null ids are rows like any other. Text order and ids do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.helpers import bloom_split, buffers, mix64, numbered, quoted, slices, staged, unused

LENGTH, COVER, SEED_BYTES = 400, 128, 12
SLICE = 1 << 18

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Names of byte ranges of one buffer by two polynomial hashes mod 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray):
        x = _TABLE[raw]
        self.sums = []
        for base in _BASES:
            pw, ip = self.powers(base, len(raw) + 1)
            p = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(x * pw[:len(raw)], out=p[1:])
            self.sums.append((p, ip))

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._powers.get(base)
        if got is None or len(got[0]) < n:
            m = max(n, SLICE + (1 << 18))
            pw, ip = np.full(m, base, np.uint64), np.full(m, pow(base, -1, 1 << 64), np.uint64)
            pw[0] = ip[0] = 1
            got = np.multiply.accumulate(pw), np.multiply.accumulate(ip)
            if m <= 1 << 23:
                cls._powers[base] = got
        return got

    def name(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        p, ip = self.sums[which]
        return mix64((p[stop] - p[start]) * ip[start])

    def grams(self, n: int) -> np.ndarray:
        p, ip = self.sums[0]
        return mix64((p[n:] - p[:-n]) * ip[:len(p) - n])


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values."""
    m = len(h) - w + 1
    a = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    a[:len(h)] = h
    a = a.reshape(-1, w)
    pre = np.minimum.accumulate(a, axis=1).ravel()
    suf = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:m], pre[w - 1:w - 1 + m])


def samples(raw: np.ndarray, off: np.ndarray, length: int, cover: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, core name, context name) of every sample of the texts
    laid out in ``raw`` by ``off``; lo..hi are the starts it stands for."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(raw) < length:
        return none
    roll = Rolling(raw)
    g = roll.grams(SEED_BYTES)
    best = _sliding_min((g & ~np.uint64(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64), cover) & np.uint64(0xFFFFFFFF)
    size = np.diff(off)
    n = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[:-1], n)
    if not len(p):
        return none
    a = best[p].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    lo, hi, a, row = p[new], p[np.concatenate([new[1:] - 1, [len(p) - 1]])], a[new], row[new]
    core = roll.name(a, a + (length - cover + 1))
    ctx = mix64(roll.name(lo, hi + length) + (a - lo).astype(np.uint64) * np.uint64(_BASES[0]) + (hi - lo).astype(np.uint64))
    base = off[:-1][row]
    return row, lo - base, hi - base, core.view(np.int64), ctx.view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of whole texts, a very long text cut into overlapping pieces of
    bounded size (starts are local, so a cut loses none): batch, bytes,
    offsets, position of the first byte in its text."""
    for b in slices(batches, "text", SLICE):
        raw, off = buffers(b.column("text"))
        if b.num_rows > 1 or len(raw) <= 4 * SLICE:
            yield b, raw, off, 0
            continue
        for s in range(0, max(1, len(raw) - length + 1), 4 * SLICE):
            part = raw[s:s + 4 * SLICE + length - 1]
            yield b, part, np.array([0, len(part)]), s


def _sample_rows(texts: DataFrame, length: int, cover: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, off, at in _pieces(batches, length):
            row, lo, hi, core, ctx = samples(raw, off, length, cover)
            yield pa.RecordBatch.from_arrays(
                [b.column("th").take(pa.array(row)), pa.array(lo + at, pa.int64()), pa.array(hi + at, pa.int64()), pa.array(core), pa.array(ctx)],
                names=["th", "lo", "hi", "core", "ctx"])
    return texts.mapInArrow(run, "th binary, lo long, hi long, core long, ctx long")


def _window_rows(texts: DataFrame, length: int) -> DataFrame:
    """Names of the starts of each listed range: texts (th, d, text, ranges)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            raw, off = buffers(b.column("text"))
            roll = Rolling(raw)
            r = b.column("ranges")
            n = np.diff(np.asarray(r.offsets))
            f = r.flatten()
            lo, hi = np.asarray(f.field("lo")), np.asarray(f.field("hi"))
            w = np.asarray(f.field("w").cast(pa.int8()))
            row = np.repeat(np.arange(b.num_rows), n)
            k = hi - lo + 1
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
            at = pos + np.repeat(off[:-1][row], k)
            k1, k2 = roll.name(at, at + length).view(np.int64), (roll.name(at, at + length, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), b.column("d").take(pa.array(np.repeat(row, k))), pa.array(np.where(np.repeat(w, k) > 0, -1, pos))],
                names=["k1", "k2", "d", "pos"])
    return texts.mapInArrow(run, "k1 long, k2 int, d long, pos long")


def _spans(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [start, stop) from ranges of repeated starts."""
    order = np.argsort(lo, kind="stable")
    s, e = lo[order], np.maximum.accumulate(hi[order] + length)
    first = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(first)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]


def repeated_spans(texts: DataFrame, length: int = LENGTH, cover: int = COVER) -> DataFrame:
    """texts (th, text; th a hash of the text) -> (th, starts, stops): the
    maximal removed byte runs of every distinct text that loses bytes."""
    names = staged(_sample_rows(texts.filter(F.octet_length("text") >= length).select("th", "text"), length, cover), "sd-samples")
    again = staged(names.groupBy("core").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
                   .filter("n > 1").select("core", (F.col("c0") != F.col("c1")).alias("open")), "sd-names")
    live = staged(bloom_split(names, "core", again)[0].join(again, "core"), "sd-live")
    ctx = staged(live.groupBy("core", "ctx", "open").agg(F.count("*").alias("n"), F.min(F.struct("th", "lo", "hi")).alias("o")), "sd-contexts")
    # Starts settled by equal contexts.
    equal = (live.drop("open").join(ctx.filter("n > 1").select("core", "ctx"), ["core", "ctx"]).select("th", "lo", "hi").distinct())
    # Remaining starts, once per distinct context; w marks those settled above.
    todo = (ctx.filter("open").select("o.th", "o.lo", "o.hi", (F.col("n") > 1).alias("w"))
            .groupBy("th").agg(F.collect_list(F.struct("lo", "hi", "w")).alias("ranges")))     # bounded by the text's own length
    todo = staged(todo, "sd-open")
    some = (bloom_split(texts.select("th", "text"), "th", todo.select("th"))[0]
            .join(todo, "th").dropDuplicates(["th"]).select("th", F.xxhash64("th").alias("d"), "text", "ranges"))
    w = Window.partitionBy("k1", "k2").orderBy("k1")
    same = staged(_window_rows(some, length)
                  .withColumn("prev", F.lag(F.lit(1)).over(w)).withColumn("next", F.lead(F.lit(1)).over(w))
                  .filter("pos >= 0 AND (prev IS NOT NULL OR next IS NOT NULL)")
                  .groupBy("d", F.floor(F.col("pos") / 32).alias("blk")).agg(
                      F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 32).cast("int"))).alias("bits")), "sd-starts")
    owner = todo.select("th", F.xxhash64("th").alias("d"))
    rest = same.join(owner, "d").select("th", (F.col("blk") * 32).alias("lo"), F.col("bits").alias("hi"), F.lit(True).alias("mask"))
    ranges = equal.withColumn("mask", F.lit(False)).unionByName(rest)
    per = ranges.groupBy("th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.collect_list("mask").alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stops = [], []
            for lo, hi, mask in zip(b.column("lo"), b.column("hi"), b.column("mask")):
                lo, hi = np.asarray(lo.values), np.asarray(hi.values)
                m = np.asarray(mask.values.cast(pa.int8())) > 0
                bit = (hi[m][:, None] >> np.arange(32)) & 1
                p = (lo[m][:, None] + np.arange(32))[bit > 0]
                s, e = _spans(np.concatenate([lo[~m], p]), np.concatenate([hi[~m], p]), length)
                starts.append(s)
                stops.append(e)
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))],
                                             names=["th", "starts", "stops"])

    return staged(per.mapInArrow(run, "th binary, starts array<long>, stops array<long>"), "sd-spans")


def text_key(text_col: str):
    t = F.coalesce(F.col(text_col), F.lit(""))
    return F.unhex(F.md5(t.cast("binary")))


def _kept(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in zip(starts, stops):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def _cut_rows(rows: DataFrame, keep: list[str], result: str, schema: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cut = [_kept(t.encode(), s, e) for t, s, e in
                   zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("stops").to_pylist())]
            val = [hashlib.sha256(c).hexdigest() for c in cut] if digest else [c.decode("utf-8", "ignore") for c in cut]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(val, pa.string())], names=[*keep, result])
    return rows.select(*keep, "text", "starts", "stops").mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 cover: int = COVER) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    src = docs.select(F.col(id_col).alias("sd_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("th"))
    spans = repeated_spans(src, length, cover)
    gone = F.aggregate(F.zip_with("starts", "stops", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    spans = spans.withColumn("n_removed", gone).withColumn("n_spans", F.size("starts").cast("bigint"))
    texts = bloom_split(src.select("th", "text"), "th", spans.select("th"))[0].join(spans, "th").filter(F.octet_length("text") > F.col("n_removed"))
    sha = staged(_cut_rows(texts, ["th"], "cut_sha", "th binary, cut_sha string", True).distinct(), "sd-cut")
    base = staged(src.select("sd_id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("full_sha")), "sd-base")
    found = staged(spans.select("th", "n_removed", "n_spans").join(sha, "th", "left"), "sd-found")
    empty = hashlib.sha256(b"").hexdigest()
    return base.join(found, "th", "left").select(
        F.col("sd_id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.col("full_sha")).otherwise(F.coalesce("cut_sha", F.lit(empty))).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, cover: int = COVER) -> DataFrame:
    """The documents with repeated bytes removed from ``text_col``; all columns
    stay, rows left without text are dropped. A character cut in two by a span
    edge is dropped whole, so the text stays valid UTF-8. Untouched texts
    (null ones too) stay as they are."""
    key, starts, stops = unused(docs, "sd_text_key", "sd_starts", "sd_stops")
    keyed = docs.withColumn(key, text_key(text_col))
    spans = repeated_spans(keyed.select(F.col(key).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length, cover)
    maybe, never = bloom_split(keyed, key, spans.select(F.col("th").alias(key)))
    joined = maybe.join(spans.withColumnsRenamed({"th": key, "starts": starts, "stops": stops}), key, "left")
    schema = docs.schema
    cols = docs.columns
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{at}"):
            out = [t if s is None else _kept(t.encode(), s, e).decode("utf-8", "ignore") for t, s, e in
                   zip(b.column(at).to_pylist(), b.column(starts).to_pylist(), b.column(stops).to_pylist())]
            keep = [not (s is not None and t == "") for t, s in zip(out, b.column(starts).to_pylist())]
            new = pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(cols))], names=cols)
            yield new.filter(pa.array(keep))

    return joined.select(*numbered(cols), starts, stops).mapInArrow(run, schema).union(never.select(*quoted(cols)))
