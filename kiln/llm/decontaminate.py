"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of a-z, 0-9 and characters above U+007F, after lower-casing A-Z
only. A window is ``window`` consecutive words of an item; an item of fewer
words (but not none) is one window as a whole.

1. Items are dealt into shards of about ``SHARD_BYTES`` of text by hash (equal
   rows once); a task per shard builds the suffix automaton of all its items
   and sends it on as arrays.
2. ``PASS_SHARDS`` automata at most are broadcast at a time, so what is sent is
   bounded; further ones take another pass over the documents, which carries
   the words hit so far as a bitmap. No shuffle touches the documents.
3. A task cuts its texts into lanes of ``LANE`` words, each with the
   ``window - 1`` words before it, and walks all lanes through the automaton in
   step. The state holds the longest suffix read that occurs in an item: a
   length of ``window`` or more is an occurrence, short items are found on the
   state or on its suffix links.

``decontaminate`` cuts the hit spans out of the texts (length limit) and drops
documents of which more than ``max_coverage`` is hit (coverage limit).

Defined results: null and empty texts, and texts without a word, have no words
and no hit. Items null, empty or without a word are not looked for. Equal item
ids count once; an item with a null id hits words but is not listed. Repeated
documents give repeated, equal results. No items: nothing is hit. Further
columns of any name are ignored here and kept by ``decontaminate``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from kiln.llm.helpers import buffers, slices, staged

WINDOW = 10
SHARD_BYTES = 1 << 20
PASS_SHARDS = 8
LANE = 64
PIECE = 4 << 20

# Byte -> lower-cased word byte, 0 for bytes between words. Bytes from 0x80 on
# belong to characters above U+007F, all of which are word characters.
_FOLD = np.zeros(256, np.uint8)
for _a, _b, _to in ((0x30, 0x3A, 0x30), (0x41, 0x5B, 0x61), (0x61, 0x7B, 0x61), (0x80, 0x100, 0x80)):
    _FOLD[_a:_b] = np.arange(_b - _a, dtype=np.uint8) + np.uint8(_to)


def split_words(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their first bytes, number of words before each text bound)."""
    low = _FOLD[raw]
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(raw)]
    begin[at] |= inside[at]
    start = np.flatnonzero(begin)
    # A word ends before the next byte that is outside or begins another word.
    size = np.zeros(0, np.int64)
    if len(start):
        size = np.add.reduceat(inside, start, dtype=np.int64)
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    return words, start, np.searchsorted(start, off)


def _cuts(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that begin between words."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + PIECE)
        while b < n:
            out = np.flatnonzero(_FOLD[raw[b:b + 65_536]] == 0)
            if len(out):
                b += int(out[0])
                break
            b = min(n, b + 65_536)
        yield a, b
        a = b


class Automaton:
    """Suffix automaton of a list of word sequences, as flat arrays."""

    def __init__(self, arrays: dict):
        self.vocab = pa.Array.from_buffers(pa.binary(), len(arrays["vocab_off"]) - 1,
                                           [None, pa.py_buffer(arrays["vocab_off"]), pa.py_buffer(arrays["vocab"])])
        self.ids = arrays["ids"]
        for name in ("link", "maxlen", "root", "slot_key", "slot_to", "win", "mark", "above", "item_off", "items"):
            setattr(self, name, arrays[name])
        self.shift = np.uint64(64 - int(len(self.slot_key)).bit_length() + 1)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is no transition."""
        key = state.astype(np.int64) * len(self.vocab) + word
        mask = len(self.slot_key) - 1
        slot = (((key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        got = self.slot_key[slot]
        to = np.where(got == key, self.slot_to[slot], -1)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            got = self.slot_key[slot[open_]]
            same = got == key[open_]
            to[open_[same]] = self.slot_to[slot[open_[same]]]
            open_ = open_[~same & (got >= 0)]
        return to

    def longest(self, ids: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, length) of the longest match that ends at each word, exact
        up to ``window`` words. Texts are ``first[i]:first[i + 1]``."""
        out_state, out_len = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        n = np.diff(first)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        new = first[:-1][text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        begin = np.maximum(first[:-1][text], new - (window - 1))
        end = np.minimum(first[1:][text], new + LANE)
        order = np.argsort(begin - end, kind="stable")           # longest lanes first
        new, begin, end = new[order], begin[order], end[order]
        span = end - begin
        state, length = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        for t in range(int(span[0]) if len(span) else 0):
            live = int(np.searchsorted(-span, -t, side="left"))    # lanes longer than t
            at = begin[:live] + t
            word = ids[at]
            s, k = state[:live], length[:live]
            k[word < 0] = 0
            s[word < 0] = 0
            todo = np.flatnonzero(word >= 0)
            while len(todo):
                here, w = s[todo], word[todo]
                top = here == 0
                s[todo[top]] = self.root[w[top]]
                k[todo[top]] = 1
                todo, here, w = todo[~top], here[~top], w[~top]
                to = self.step(here, w)
                ok = to >= 0
                s[todo[ok]] = to[ok]
                k[todo[ok]] += 1
                todo, here = todo[~ok], here[~ok]
                s[todo] = self.link[here]
                k[todo] = self.maxlen[self.link[here]]
            fresh = at >= new[:live]
            out_state[at[fresh]], out_len[at[fresh]] = s[fresh], k[fresh]
        return out_state, out_len

    def scan(self, words: pa.Array, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words hit, texts, item numbers): the last two are the distinct
        pairs of a text and an item with a window in it."""
        ids = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.vocab), -1), dtype=np.int64)
        state, length = self.longest(ids, first, window)
        whole = (self.mark[state] > 0) & (length == self.maxlen[state])
        short = np.where(whole, state, self.above[state])        # the longest short item that ends here, or -1
        cover = np.where(length >= window, window, np.where(short >= 0, self.maxlen[short], 0))
        end = np.flatnonzero(cover)
        edge = np.zeros(len(ids) + 1, np.int32)
        np.add.at(edge, end - cover[end] + 1, 1)
        np.add.at(edge, end + 1, -1)
        text = np.searchsorted(first, end, side="right") - 1
        long_ = length[end] >= window
        pairs = [np.unique(text[long_] * len(self.link) + self.win[state[end[long_]]])]
        at, text = short[end], text
        while True:
            text, at = text[at >= 0], at[at >= 0]
            if not len(at):
                break
            pairs.append(np.unique(text * len(self.link) + at))
            text, at = pairs[-1] // len(self.link), self.above[pairs[-1] % len(self.link)]
        pair = np.unique(np.concatenate(pairs))
        text, at = pair // len(self.link), pair % len(self.link)
        n = self.item_off[at + 1] - self.item_off[at]
        item = self.items[np.repeat(self.item_off[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        got = np.unique(np.repeat(text, n) * max(1, len(self.ids)) + item)
        return np.cumsum(edge[:-1]) > 0, got // max(1, len(self.ids)), got % max(1, len(self.ids))


def _grow(sequences: list[np.ndarray]) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the states; online
    construction that starts again at the root for every sequence."""
    to: list[dict] = [{}]
    link, longest = [-1], [0]

    def branch(p: int, w: int, q: int) -> int:
        """The state of the suffixes of p's longest string followed by w."""
        if longest[q] == longest[p] + 1:
            return q
        c = len(to)
        to.append(dict(to[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = c
        while p >= 0 and to[p].get(w) == q:
            to[p][w] = c
            p = link[p]
        return c

    for seq in sequences:
        last = 0
        for w in seq.tolist():
            if w in to[last]:
                last = branch(last, w, to[last][w])
                continue
            cur = len(to)
            to.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and w not in to[p]:
                to[p][w] = cur
                p = link[p]
            if p >= 0:
                link[cur] = branch(p, w, to[p][w])
            last = cur
    return to, link, longest


def build(ids: list[str | None], texts: pa.Array, window: int) -> dict:
    """The automaton's arrays for items of one shard."""
    raw, off = buffers(texts)
    words, _, first = split_words(raw, off)
    coded = words.dictionary_encode()
    vocab = coded.dictionary
    code = np.asarray(coded.indices, dtype=np.int64)
    seqs = [code[a:b] for a, b in zip(first[:-1], first[1:])]
    to, link, longest = _grow(seqs)
    n_words, n = len(vocab), len(to)
    link[0] = 0
    link_a, max_a = np.array(link, np.int32), np.array(longest, np.int32)
    root = np.zeros(n_words, np.int32)
    root[list(to[0])] = list(to[0].values())
    key = np.array([s * n_words + w for s in range(1, n) for w in to[s]], np.int64)
    val = np.array([q for s in range(1, n) for q in to[s].values()], np.int32)
    size = 1 << max(4, (4 * len(key)).bit_length())
    slot_key, slot_to = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    slot = (((key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    left = np.arange(len(key))
    while len(left):
        free = left[slot_key[slot[left]] < 0]
        _, one = np.unique(slot[free], return_index=True)
        put = free[one]
        slot_key[slot[put]], slot_to[slot[put]] = key[put], val[put]
        left = np.setdiff1d(left, put, assume_unique=True)
        slot[left] = (slot[left] + 1) & (size - 1)
    a = {"link": link_a, "maxlen": max_a, "root": root, "slot_key": slot_key, "slot_to": slot_to,
         "vocab": np.frombuffer(b"".join(vocab.to_pylist()), np.uint8),
         "vocab_off": np.cumsum([0, *map(len, vocab.to_pylist())]).astype(np.int32),
         "win": np.full(n, -1, np.int32), "mark": np.zeros(n, np.uint8), "above": np.full(n, -1, np.int32),
         "item_off": np.zeros(n + 1, np.int64), "items": np.zeros(0, np.int64)}
    known = sorted({i for i in ids if i is not None})
    a["ids"] = known
    number = {i: k for k, i in enumerate(known)}
    auto = Automaton(a)
    state, length = auto.longest(code, first, window)
    size_of = np.diff(first)
    short = np.flatnonzero((size_of > 0) & (size_of < window))
    a["mark"][state[first[1:][short] - 1]] = 1
    win, mark, above = a["win"], a["mark"], a["above"]
    for s in np.argsort(max_a, kind="stable")[1:].tolist():         # a link is shorter than its state
        up = link_a[s]
        above[s] = up if mark[up] else above[up]
        if max_a[s] >= window:
            win[s] = s if max_a[up] < window else win[up]
    # The items of each window state and of each whole short item.
    item = np.repeat([number.get(i, -1) for i in ids], size_of).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    full = np.flatnonzero((length >= window) & (item >= 0))
    ends = first[1:][short] - 1
    ends = ends[item[ends] >= 0]
    many = max(1, len(known))
    pair = np.unique(np.concatenate([win[state[full]].astype(np.int64) * many + item[full], state[ends].astype(np.int64) * many + item[ends]]))
    a["items"] = pair % many
    np.cumsum(np.bincount(pair // many, minlength=n), out=a["item_off"][1:])
    return a


def automata(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, automaton): one row per shard of the distinct items."""
    rows = (items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
            .filter("text IS NOT NULL").distinct())
    total = rows.agg(F.sum(F.octet_length("text")).cast("bigint")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)).cast("int"))

    def solve(table: pa.Table) -> pa.Table:
        a = build(table["item"].to_pylist(), table["text"].combine_chunks(), window)
        a["ids"] = np.array([i.encode() for i in a["ids"]], object)
        lens = np.array([len(i) for i in a["ids"]], np.int64)
        a["ids"], a["ids_len"] = np.frombuffer(b"".join(a["ids"]), np.uint8), lens
        buf = io.BytesIO()
        np.savez(buf, **a)
        return pa.table({"shard": table["shard"].slice(0, 1).cast(pa.int32()), "automaton": pa.array([buf.getvalue()], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(solve, "shard int, automaton binary")


def load(packed: bytes) -> Automaton:
    z = dict(np.load(io.BytesIO(packed)))
    ends = np.cumsum(z["ids_len"])
    raw = z["ids"].tobytes()
    z["ids"] = [raw[e - n:e].decode() for e, n in zip(ends.tolist(), z["ids_len"].tolist())]
    return Automaton(z)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of True."""
    d = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


def scan_documents(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", cut: bool = False) -> DataFrame:
    """(row, n_words, n_hit, items, rest): ``row`` is a struct of the columns
    ``keep``, ``items`` the sorted ids of items with a window in the text,
    ``rest`` the text without the hit spans (null unless ``cut``)."""
    spark = docs.sparkSession
    shards = staged(automata(items, window, item_id_col, item_text_col), "item-automata")
    numbers = sorted(r["shard"] for r in shards.select("shard").collect())
    passes = [numbers[i:i + PASS_SHARDS] for i in range(0, len(numbers), PASS_SHARDS)] or [[]]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    row = src.schema["row"]
    carry = StructType([row, StructField("text", StringType()), StructField("hit", BinaryType()), StructField("items", ArrayType(StringType()))])
    final = StructType([row, StructField("n_words", LongType()), StructField("n_hit", LongType()),
                        StructField("items", ArrayType(StringType())), StructField("rest", StringType())])

    def work(packed, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            autos = [load(p) for p in packed.value]
            for b in slices(batches, "text"):
                raw, off = buffers(b.column("text"))
                parts = [(split_words(raw[x:y], np.clip(off, x, y) - x), x) for x, y in _cuts(raw, off)]
                start = np.concatenate([np.zeros(0, np.int64), *[s + x for (_, s, _), x in parts]])
                words = pa.concat_arrays([w for (w, _, _), _ in parts]) if parts else pa.array([], pa.binary())
                first = np.searchsorted(start, off)
                hit = np.zeros(len(words), bool)
                before = b.column("hit")
                for i in np.flatnonzero(np.asarray(before.is_valid())).tolist():
                    hit[first[i]:first[i + 1]] = np.unpackbits(np.frombuffer(before[i].as_buffer(), np.uint8), count=int(first[i + 1] - first[i])).astype(bool)
                found: dict[int, set] = {}
                for a in autos:
                    new, text, item = a.scan(words, first, window)
                    hit |= new
                    for t, i in zip(text.tolist(), item.tolist()):
                        found.setdefault(t, set()).add(a.ids[i])
                lists = [sorted(found.get(t, set()).union(old)) if t in found or old else [] for t, old in enumerate(b.column("items").to_pylist())]
                col = {"row": b.column("row"), "items": pa.array(lists, pa.list_(pa.string()))}
                if last:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    col["n_words"], col["n_hit"] = pa.array(np.diff(first).astype(np.int64)), pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64))
                    rest = [None] * b.num_rows
                    if cut:
                        size = np.asarray(pc.binary_length(words), dtype=np.int64)
                        rest = b.column("text").to_pylist()
                        for i in np.flatnonzero(total[first[1:]] > total[first[:-1]]).tolist():
                            a, z = _runs(hit[first[i]:first[i + 1]])
                            a, z = a + first[i], z + first[i]
                            keep = np.ones(off[i + 1] - off[i] + 1, np.int8)
                            edge = np.zeros(len(keep), np.int8)
                            edge[start[a] - off[i]] += 1
                            edge[start[z] + size[z] - off[i]] -= 1
                            keep = np.cumsum(edge[:-1]) == 0
                            rest[i] = raw[off[i]:off[i + 1]][keep].tobytes().decode()
                    col["rest"] = pa.array(rest, pa.string())
                    names = final.names
                else:
                    col["text"] = b.column("text")
                    col["hit"] = pa.array([np.packbits(hit[x:y]).tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())
                    names = carry.names
                yield pa.RecordBatch.from_arrays([col[c] for c in names], names=names)
        return run

    for k, shard_list in enumerate(passes):
        got = shards.filter(F.col("shard").isin(shard_list)).orderBy("shard").collect() if shard_list else []
        sent = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in got])
        last = k == len(passes) - 1
        src = src.mapInArrow(work(sent, last), final if last else carry)
        if not last:
            src = staged(src, "leak-pass")
    return src


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the spans that hold windows of items, and without the
    documents of which more than ``max_coverage`` of the words are hit."""
    others = [c for c in docs.columns if c != text_col]
    src = docs if others else docs.withColumn("row_tag", F.lit(0))
    found = scan_documents(src, items, others or ["row_tag"], window, text_col, item_id_col, item_text_col, cut=True)
    kept = found.filter(F.col("n_hit") <= F.lit(float(max_coverage)) * F.col("n_words"))
    return kept.select(*[(F.col("rest") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256 (of the
    sorted item ids, comma-joined), contaminated."""
    found = scan_documents(docs, items, [id_col], window, text_col, item_id_col, item_text_col)
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
