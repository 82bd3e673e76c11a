"""Near-duplicate components by bottom-k sketches of one hash function.

Each document's set holds the 64-bit hashes of its distinct ``shingle``-word
shingles. Its bottom-k sketch is the ``SKETCH`` smallest values.

1. Equal sets (128-bit set hash and size) form one class; the smallest id
   stands for it from here on.
2. Inverted lists: every run of ``RUN`` neighbouring values among the
   ``INDEXED`` smallest is a key. Two sets with similarity s share the union's
   next value with probability s, so they miss a common run of 3 in 48 values
   with probability under 1e-9 at s = 0.85 and 1e-7 at 0.8. From 80 % on, sets that
   both fit in the sketch always share a run, but for five values against four of
   them (4/5): the odd one in the middle leaves runs of two. Sets of up to ``SMALL``
   values therefore list their runs of two as well. Sets that share only a few common
   passages rarely share a run.
   A document all but ``percent`` of whose values occur in no other listed
   document cannot be linked and leaves; documents of up to ``PROBE`` values are
   tested on all of them, longer ones on a hash sample with a six-sigma margin.
3. Overlaps without all pairs of a list: of lists with the same members one
   stays, long lists with the same first pivot become one; short lists give their pairs; a long
   list compares all members with a few pivots (the members of least hash, so
   that lists of the same family choose the same ones; four times as many in each
   round). The union-sketch estimate keeps members near a pivot (``NEAR``);
   those very near it (``CORE``) leave the list, as everything linked to them
   is near that pivot too, by the triangle inequality of the Jaccard distance.
   The rest of the list goes round again until it is short, empty or small
   enough to be compared whole on full sets. As estimates stand for similarities
   here, a partner may miss a member that left (README, op10 recall).
4. Every pivot's family is compared on full sets in blocks of bounded size, also
   if no member is near enough to leave the list. Each block task emits a spanning
   forest of its exact links, not the pairs. A link of the pivot has an estimate
   under ``NEAR`` with probability under 1e-17 (0.8) or 1e-22 (0.85).
5. Star contraction joins the links into components.

Defined results: null and word-less texts have an empty set, are linked with
nothing and stay; rows with a null id take no part and stay (component null).
Fewer words than ``shingle``: the whole sequence is the one shingle. Rows
repeated under one id are one document. Components are the exact transitive
closure, so the result does not depend on order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.components import connected_components
from kiln.llm.helpers import bloom_split, mix64, quoted, slices, staged, unstage

SKETCH, INDEXED, RUN = 64, 48, 3
SMALL = 5                 # sets of up to this many values are listed under their runs of two too
SHORT_LIST, SHORT_LATER = 16, 128  # lists up to this many members give all their pairs: first round, later rounds
NEAR, CORE = 0.3, 0.6     # estimated similarity to the pivot: family / leaves the list
MAX_PIVOTS, PIVOT_GROWTH = 64, 4   # pivots of a long list: 1, 4, 16, then 64 a round
PROBE = 256               # values of a document whose occurrence elsewhere is counted
BLOCK_LIST, BLOCK_LIST_VALUES = 1024, 1_600_000   # what is left of a list after the first round, if no larger, is compared whole
BLOCK, BLOCK_VALUES = 2048, 400_000   # documents and set values per side of a block comparison (about 3 MB)
TEXT_SLICE = 1 << 20      # bytes of text shingled at once
STRIP, SLICE_VALUES = 256, 1024       # rows and values of a block comparison worked on at once

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(col: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text. Words are maximal
    runs of bytes outside blank and 0x09-0x0D, with A-Z lower-cased."""
    ls = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(col, "")))
    off = np.asarray(ls.offsets).astype(np.int64)
    enc = ls.flatten().dictionary_encode()
    off -= off[0]
    names = enc.dictionary.to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    if len(names) == 0:
        return [np.zeros(0, np.uint64)] * len(col)
    w = h[np.asarray(enc.indices)]
    real = np.fromiter((bool(n) for n in names), bool, len(names))[np.asarray(enc.indices)]
    if not real.all():                       # blanks at the edges give empty words
        off = np.concatenate([[0], np.cumsum(real)])[off]
        w = w[real]
    def roll(x: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(x) - n + 1)
        acc = np.zeros(m, np.uint64)
        for i in range(n):
            acc = mix64(acc * _B + x[i:i + m] + _A)
        return acc
    rolled = roll(w, shingle)
    out = []
    for lo, hi in zip(off[:-1], off[1:]):
        n = hi - lo
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < shingle:
            out.append(mix64(roll(w[lo:hi], int(n)) + np.uint64(n)))
        else:
            out.append(np.unique(rolled[lo:hi - shingle + 1]))
    return out


def run_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the neighbouring runs among the indexed smallest values, runs of
    two of a small set included; a set shorter than one run is its own key."""
    s = values[:INDEXED]
    if len(s) == 0:
        return np.zeros(0, np.int64)
    out = []
    for r in {min(RUN, len(s)), 2} if 2 <= len(s) <= SMALL else {min(RUN, len(s))}:
        m = len(s) - r + 1
        acc = np.full(m, r, np.uint64)
        for i in range(r):
            acc = mix64(acc * _B + s[i:i + m] + _A)
        out.append(acc)
    return np.concatenate(out).astype(np.int64)


def _sketch_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """nd_id, n, h1, h2, sketch (bytes), keys."""
    kind = docs.schema["nd_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_SLICE):
            sets = shingle_sets(b.column("text"), shingle)
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("nd_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.fromiter((xxhash.xxh3_64_intdigest(r) for r in raw), np.uint64, len(raw)).astype(np.int64)),
                pa.array(np.fromiter((xxhash.xxh64_intdigest(r, 7) for r in raw), np.uint64, len(raw)).astype(np.int64)),
                pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()),
                pa.array([run_keys(s) for s in sets], pa.list_(pa.int64()))],
                names=["nd_id", "n", "h1", "h2", "sketch", "keys"])

    return docs.mapInArrow(run, f"nd_id {kind}, n long, h1 long, h2 long, sketch binary, keys array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, full set) of the documents in ``ids``. A blocked Bloom filter of
    the ids, of bounded size, thins the texts before the exact semi-join."""
    thin, _ = bloom_split(docs, "nd_id", ids)
    kind = docs.schema["nd_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_SLICE):
            yield pa.RecordBatch.from_arrays(
                [b.column("nd_id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), shingle)], pa.binary())],
                names=["nd_id", "members"])

    return thin.join(ids, "nd_id", "left_semi").mapInArrow(run, f"nd_id {kind}, members binary")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """Ids (and set sizes) whose share of values found in other listed documents allows a
    link. A document asks about the values below PROBE / n of the hash range
    and answers with somewhat more, so every possible partner (at least
    percent / 100 as large) answers all that is asked."""
    kind = sets.schema["nd_id"].dataType.simpleString()
    p = percent / 100

    def below(share: float) -> np.uint64:
        return np.uint64(min(2**64 - 1, int(2.0**64 * min(1.0, share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "members"):
            row, vals, asks, need, size = [], [], [], [], []
            for k, m in enumerate(b.column("members").to_pylist()):
                v = np.frombuffer(m, np.uint64)
                n = len(v)
                tell = v[:np.searchsorted(v, below(PROBE / p / n), side="right")]
                ask = int(np.searchsorted(tell, below(PROBE / n), side="right"))
                row.append(np.full(len(tell), k))
                vals.append(tell.astype(np.int64))
                asks.append(np.arange(len(tell)) < ask)
                need.append(np.full(len(tell), ask * (p if n <= PROBE else p - 6 * (p * (1 - p) / max(ask, 1)) ** 0.5)))
                size.append(np.full(len(tell), n))
            yield pa.RecordBatch.from_arrays(
                [b.column("nd_id").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(vals)),
                 pa.array(np.concatenate(asks)), pa.array(np.concatenate(need)), pa.array(np.concatenate(size))],
                names=["nd_id", "v", "ask", "need", "n"])

    told = staged(sets.mapInArrow(run, f"nd_id {kind}, v long, ask boolean, need double, n long"), "nd-values")
    common = told.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").select("v")
    out = staged(told.filter("ask").join(common, "v", "left_semi").groupBy("nd_id")
                 .agg(F.count("*").alias("c"), F.max("need").alias("need"), F.max("n").alias("n")).filter("c >= need - 1e-6").select("nd_id", "n"),
                 "nd-candidates")
    unstage(told)
    return out


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity estimated from the bottom of the union of two sketches
    (exact when both sketches hold their whole sets)."""
    whole = len(a) < SKETCH and len(b) < SKETCH
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    if not whole:
        counts = counts[:SKETCH]
    return float((counts == 2).sum() / max(1, len(counts)))


def _estimates(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(p, x, n of x, est) of candidate pairs with est >= NEAR."""
    sp = sketches.select(F.col("nd_id").alias("p"), F.col("sketch").alias("sp"))
    sx = sketches.select(F.col("nd_id").alias("x"), "n", F.col("sketch").alias("sx"))
    kind = sketches.schema["nd_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            est = np.array([union_estimate(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64))
                            for u, v in zip(b.column("sp").to_pylist(), b.column("sx").to_pylist())], dtype=np.float64)
            out = pa.RecordBatch.from_arrays([b.column("p"), b.column("x"), b.column("n"), pa.array(est)], names=["p", "x", "n", "est"])
            yield out.filter(pa.array(est >= NEAR))

    return pairs.join(sx, "x").join(sp, "p").select("p", "x", "n", "sp", "sx").mapInArrow(run, f"p {kind}, x {kind}, n long, est double")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Component label of every set within one block comparison: sets i in
    ``left`` and j in ``right`` are linked if 100 |i & j| >= percent |i | j|.
    Intersections are counted by matrix products over slices of the values
    that at least two of the sets hold, a strip of rows at a time; beside one
    count per pair of a left and a right set, only strips are held."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    vals, inv = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    inv, n_vals = inv.astype(np.int32), len(vals)
    del vals
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    shared = np.bincount(inv, minlength=n_vals) > 1
    keep = shared[inv]
    inv, row = (np.cumsum(shared, dtype=np.int32) - 1)[inv[keep]], row[keep]
    order = np.argsort(inv, kind="stable")
    inv, row = inv[order], row[order]
    del keep, order
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    inter = np.zeros((len(rows), len(cols)), np.float32)   # counts below 2^24 are exact
    for lo in range(0, int(shared.sum()), SLICE_VALUES):
        a, b = np.searchsorted(inv, [lo, lo + SLICE_VALUES])
        m = np.zeros((n, SLICE_VALUES), np.float32)
        m[row[a:b], inv[a:b] - lo] = 1
        other = m[cols].T
        for r in range(0, len(rows), STRIP):
            inter[r:r + STRIP] += m[rows[r:r + STRIP]] @ other
    label = np.arange(n)
    while True:                                             # least label of all linked sets, until nothing changes
        before = label.copy()
        for r in range(0, len(rows), STRIP):
            k = rows[r:r + STRIP]
            hit = inter[r:r + STRIP]
            linked = ((100.0 + percent) * hit >= percent * (size[k][:, None] + size[cols][None, :])) & (hit > 0)
            least = np.minimum(label[k], np.where(linked, label[cols][None, :], n).min(axis=1, initial=n))
            label[k] = least
            label[cols] = np.minimum(label[cols], np.where(linked, least[:, None], n).min(axis=0, initial=n))
        if (label == before).all():
            return label


def _family_links(near: DataFrame, sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Exact links (a, b) inside the pivots' families ``near`` (p, x, est): the
    pivot and its core members against the whole family, however low the estimates.

    A small family is one task. Of a larger one, core members (the pivot among
    them) and the others are cut into blocks of their own; every core block
    meets every block, and blocks of others do not meet each other."""
    def blocks(of):
        n, values = F.count(F.when(of, F.lit(1))), F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
        return F.greatest(F.ceil(n / BLOCK), F.ceil(values / BLOCK_VALUES)).cast("int")

    core = F.col("est") >= CORE
    sized = near.groupBy("p").agg(blocks(F.lit(True)).alias("nb"), F.greatest(blocks(core), F.lit(1)).alias("nc"), blocks(~core).alias("no"))
    stats = sized.select("p", F.when(F.col("nb") <= 1, F.lit(1)).otherwise(F.col("nc")).alias("nc"),
                         F.when(F.col("nb") <= 1, F.lit(0)).otherwise(F.col("no")).alias("no"))
    fam = (near.select("p", "x", core.alias("core")).unionByName(stats.select("p", F.col("p").alias("x"), F.lit(True).alias("core")))
           .join(stats, "p"))
    own = F.when(F.col("core") | (F.col("no") == 0), F.pmod(F.xxhash64("x"), F.col("nc"))).otherwise(
        F.col("nc") + F.pmod(F.xxhash64("x"), F.greatest("no", F.lit(1)))).cast("int")
    met = F.when(F.col("core"), F.sequence(F.lit(0), F.col("nc") + F.col("no") - 1)).otherwise(F.sequence(F.lit(0), F.col("nc") - 1))
    fam = fam.select("p", "x", own.alias("blk"), "core", F.explode(met).alias("o")).select(
        "p", "x", "blk", "core", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    rows = fam.join(sets.withColumnRenamed("nd_id", "x"), "x")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("x").to_pylist()
        vals = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        blk = np.asarray(table.column("blk"))
        is_core = np.asarray(table.column("core").combine_chunks().cast(pa.int8())).astype(bool)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        label = block_links(vals, (blk == i) & is_core, blk == j, percent)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array([ids[k] for k in moved], table.column("x").type),
                         "b": pa.array([ids[label[k]] for k in moved], table.column("x").type)})

    return (rows.select("p", "i", "j", "x", "blk", "core", "members").groupBy("p", "i", "j")
            .applyInArrow(run, f"a {id_type}, b {id_type}"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
               percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Documents are
    linked if 100 |A & B| >= percent |A | B|."""
    src = docs.select(F.col(id_col).alias("nd_id"), F.col(text_col).alias("text"))
    rows = staged(_sketch_rows(src, shingle), "nd-sketches")
    known = rows.filter("n > 0 AND nd_id IS NOT NULL")
    id_type = rows.schema["nd_id"].dataType.simpleString()

    classes = staged(known.groupBy("h1", "h2", "n").agg(F.min("nd_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"),
                     "nd-classes")
    members = staged(known.select("nd_id", "h1", "h2", "n").join(classes.drop("copies"), ["h1", "h2", "n"])
                     .filter("nd_id <> rep").select("nd_id", "rep").distinct(), "nd-copies")
    post = staged(known.select("nd_id", "keys").join(members.select("nd_id"), "nd_id", "left_anti")
                  .select(F.explode("keys").alias("key"), "nd_id"), "nd-postings")
    lists = post.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    left = listed = staged(post.join(lists, "key").distinct(), "nd-lists")
    unstage(post)

    first = staged(left.select("nd_id").distinct(), "nd-candidates")
    sets = staged(_full_sets(src, first, shingle), "nd-candidate-sets")
    cand = _linkable(sets, percent)
    unstage(first)
    sketches = staged(known.select("nd_id", "n", "sketch").join(cand.select("nd_id"), "nd_id", "left_semi"), "nd-candidate-sketches")
    left = left.join(cand, "nd_id")

    links, pivots, used = None, 1, [listed, cand, sets, sketches, classes]
    while True:
        # Lists with the same members give the same pairs: one of them stays.
        sizes = left.groupBy("key").agg(
            F.count("*").alias("m"), F.sum("n").alias("values"), F.min("nd_id").alias("head"), F.bit_xor(F.xxhash64("nd_id")).alias("x1"),
            F.bit_xor(F.xxhash64("nd_id", F.lit("list"))).alias("x2")).filter("m > 1")
        way = (F.when((F.lit(pivots) > 1) & (F.col("m") <= BLOCK_LIST) & (F.col("values") <= BLOCK_LIST_VALUES), "block")
               .when(F.col("m") <= (SHORT_LIST if pivots == 1 else SHORT_LATER), "short").otherwise("long"))
        sizes = staged(sizes.groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.max("values").alias("values"), F.max("head").alias("head"))
                       .select("key", "head", way.alias("way")), "nd-sizes")
        any_block, any_short, any_long = sizes.agg(*(F.max(F.col("way") == x) for x in ("block", "short", "long"))).first()
        if not (any_block or any_short or any_long):
            break
        cur = staged(left.join(sizes, "key"), "nd-lists")
        used += [sizes, cur]
        families, pairs = [], []
        if any_block:
            families.append(cur.filter("way = 'block' AND nd_id <> head")
                            .select(F.col("head").alias("p"), F.col("nd_id").alias("x"), "n", F.lit(1.0).alias("est")).distinct())
        if any_short:
            short = cur.filter("way = 'short'").select("key", "nd_id")
            pairs.append(short.withColumnRenamed("nd_id", "p").join(short.withColumnRenamed("nd_id", "x"), "key").filter("p < x").select("p", "x"))
        if any_long:
            long = cur.filter("way = 'long'").select("key", "nd_id", "n")
            w = Window.partitionBy("key").orderBy(F.xxhash64("nd_id", F.lit("pivot")), "nd_id")
            heads = staged(long.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pivots)
                           .select("key", F.col("nd_id").alias("p")), "nd-pivots")
            tested = long.withColumnRenamed("nd_id", "x").join(heads, "key").filter("p <> x")
            if pivots == 1:        # lists with the same pivot become one
                tested = tested.select(F.col("p").cast("string").alias("key"), "x", "n", "p").distinct()
                heads = heads.select(F.col("p").cast("string").alias("key"), "p").distinct()
            tested = staged(tested, "nd-tested")   # read twice below
            used.append(tested)
            if pivots == 1:
                long = tested.select("key", F.col("x").alias("nd_id"), "n")
            pairs.append(tested.select("p", "x"))
        if pairs:
            near = staged(_estimates(reduce(DataFrame.union, pairs).distinct(), sketches), "nd-near")
            families.append(near)
            used.append(near)
        found = staged(_family_links(reduce(DataFrame.union, families), sets, percent, id_type).distinct(), "nd-links")
        links = found if links is None else links.union(found)
        used.append(found)
        if not any_long:
            break
        done = (tested.join(near.filter(F.col("est") >= CORE).select("p", "x"), ["p", "x"], "left_semi").select("key", "x")
                .union(heads.select("key", F.col("p").alias("x"))).distinct())
        left = staged(long.join(done.withColumnRenamed("x", "nd_id"), ["key", "nd_id"], "left_anti"), "nd-lists")
        used.append(left)
        pivots = min(MAX_PIVOTS, PIVOT_GROWTH * pivots)

    if links is None:
        comp = members.select(F.col("nd_id").alias("node"), F.col("nd_id").alias("component")).limit(0)
    else:
        comp = staged(connected_components(links, "nd-components"), "nd-components")
    unstage(*used)
    base = rows.select("nd_id", "n").join(members, "nd_id", "left").withColumn("node", F.coalesce("rep", "nd_id"))
    out = base.join(comp, "node", "left")
    component = F.coalesce("component", "node")
    return out.select(F.col("nd_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("nd_id").isNull() | (F.col("nd_id") == component)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one (the smallest id) of each component;
    all columns stay, and rows with a null id."""
    gone = staged(near_dedup(docs, id_col, text_col, shingle, percent).filter(~F.col("kept")).select(F.col(id_col)).distinct(), "nd-dropped")
    maybe, never = bloom_split(docs, id_col, gone)
    cols = quoted(docs.columns)
    return maybe.join(gone, id_col, "left_anti").select(*cols).unionByName(never.select(*cols))
