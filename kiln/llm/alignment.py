"""Alignment of two tokenizers over the same bytes by pointer jumping.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE with byte fallback; both
see a space and the text, without special tokens. Their tokens tile the same
bytes. Every token points to the farthest-right token of the other side that it
overlaps; a B token that ends together with the A token there points to itself.
Doubling the pointers until nothing changes brings every token to the terminal
token of its component, which labels its group. A-B token occurrences that
overlap are links.

Texts are cut into units before a space that follows a visible character
(``_unit_bounds``). Neither tokenizer merges across such a place: A's
pre-tokenizer always begins a new word there, and no piece of B holds a space
after another character (checked when B is loaded). So the units of a slice are
dictionary-encoded and only distinct ones are tokenized and aligned, all of
them at once.

``pair_counts`` counts links of an id pair over the corpus (summed per slice
before the shuffle). ``align`` then goes over the texts again with the counts
as sorted arrays, ``PAIR_BLOCK`` pairs at most at a time: what is broadcast is
bounded, and more pairs take another pass over the texts.

Defined results: texts null or empty, and texts that a tokenizer does not give
back byte for byte, have no tokens: zeros and an empty digest, and they add no
links. Long texts are worked off in runs of units. Repeated rows and rows with
a null id count and are answered like any other. No rows: no rows. Further
columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import binary_buffers, buffers, slices, staged

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 2 << 20            # bytes of text worked on at once
RUN = 1 << 14              # bytes of units encoded at once
PAIR_BLOCK = 2_000_000     # pair counts broadcast at once


@dataclass
class Tokenizers:
    """Both vocabularies as they are sent to the tasks."""
    a_json: str
    b_model: bytes
    loaded: object = None

    def open(self) -> _Pair:
        """The loaded tokenizers, once per Python worker."""
        if self.loaded is None:
            self.loaded = _Pair(self)
        return self.loaded


def load_tokenizers(a_path: str = A_PATH, b_path: str = B_PATH) -> Tokenizers:
    """Read both files (on the driver; tasks get their content)."""
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        return Tokenizers(a_json, f.read())


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1
    characters stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(hidden)}


# Fixed value: how the byte-level pre-tokenizer cuts words.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_level_engine(a_json: str, ranks: dict[bytes, int]) -> Callable[[list[str]], np.ndarray]:
    """Texts -> all their ids. If the file's merges make ids in ascending order,
    merging by rank is the same as merging by list, and the faster engine takes
    the file's vocabulary as ranks; else the file's own library runs."""
    spec = json.loads(a_json)
    vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
             and not spec["model"].get("ignore_merges") and all(x < y for x, y in zip(made, made[1:])) and len(ranks) == len(made) + 256)
    if plain:
        import tiktoken
        engine = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: np.concatenate([np.zeros(0, np.uint32), *[engine.encode_to_numpy(t, disallowed_special=()) for t in texts]])
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    slow = Tokenizer.from_str(a_json)
    slow.encode_special_tokens = True
    return lambda texts: np.array([i for e in slow.encode_batch(texts, add_special_tokens=False) for i in e.ids], np.int64)


class _Pair:
    """Loaded tokenizers, and the bytes of their tokens."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        alphabet = _byte_alphabet()
        spec = json.loads(files.a_json)
        spelled = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
        self.encode_a = _byte_level_engine(files.a_json, {v: k for k, v in spelled.items()})
        a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b_model)
        b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} joins words: texts can't be cut into units")
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.n_b = len(b_bytes)
        self.bytes = [pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())]
        self.size = [np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes)]
        self.digits = [np.array([str(i).encode() for i in range(len(t))], "S12") for t in (a_bytes, b_bytes)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [self.encode_a(texts).astype(np.int64), np.array([i for x in b for i in x], np.int64)]

    def _gives_back(self, ids: list[np.ndarray], raw: np.ndarray) -> bool:
        return all(np.array_equal(buffers_of(t.take(pa.array(i))), raw) for t, i in zip(self.bytes, ids))

    def tokens(self, raw: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """([A ids, B ids], which units come back byte for byte) of the units
        that end at ``ends``; the others have no ids. Units are encoded in runs
        of about ``RUN`` bytes that end after a visible character or alone."""
        start = np.concatenate([[0], ends[:-1]])
        loose = ~_visible_before(raw, ends)
        closes = np.flatnonzero(loose | (ends // RUN != start // RUN)) + 1
        runs = _merged(closes, np.array([0, len(ends)]))
        spans = [(int(start[i]), int(ends[j - 1])) for i, j in zip(runs[:-1], runs[1:])]
        ids = self._encode([raw[x:y].tobytes().decode() for x, y in spans])
        ok = np.ones(len(ends), bool)
        if not self._gives_back(ids, raw):
            parts = []
            for (x, y), i, j in zip(spans, runs[:-1], runs[1:]):
                own = self._encode([raw[x:y].tobytes().decode()])
                if self._gives_back(own, raw[x:y]):
                    parts.append(own)
                    continue
                for u in range(i, j):
                    unit = raw[start[u]:ends[u]]
                    own = self._encode([unit.tobytes().decode()])
                    ok[u] = self._gives_back(own, unit)
                    if ok[u]:
                        parts.append(own)
            ids = [np.concatenate([np.zeros(0, np.int64), *[p[side] for p in parts]]) for side in (0, 1)]
        return ids, ok

    def table(self, units: pa.Array, spell: bool) -> dict:
        """Per unit: token, group and link counts, ok, the id pairs of its
        links and (with ``spell``) its groups as text, each with ``;``."""
        raw, bound = binary_buffers(units)
        n = len(units)
        (a, b), ok = self.tokens(raw, bound[1:])
        a_end, b_end = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        unit_end = np.cumsum(np.diff(bound) * ok)
        a_unit, b_unit = np.searchsorted(unit_end, a_end), np.searchsorted(unit_end, b_end)
        a_group, b_group = groups_of(a_end, b_end)
        la, lb = links_of(a_end, b_end)
        n_links = np.bincount(a_unit[la], minlength=n)
        closing = b_group == np.arange(len(b))
        out = {"ok": ok, "n_a": np.bincount(a_unit, minlength=n), "n_b": np.bincount(b_unit, minlength=n),
               "n_groups": np.bincount(b_unit[closing], minlength=n), "n_links": n_links,
               "first": np.concatenate([[0], np.cumsum(n_links)]), "pair": a[la] * self.n_b + b[lb]}
        if spell:
            out["text"] = self._spelled(a, b, a_group, b_group, closing, out["n_a"] + out["n_b"])
        return out

    def _spelled(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, closing: np.ndarray, per_unit: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3;`` per unit, all at once: tokens go to their
        place in the output, digits and the sign after them into one buffer."""
        term = np.flatnonzero(closing)
        ga, gb = np.searchsorted(term, a_group), np.searchsorted(term, b_group)       # group numbers
        a_upto = np.searchsorted(ga, np.arange(len(term)), side="right")              # A tokens up to and with a group
        b_before = np.searchsorted(gb, np.arange(len(term)), side="left")
        at_a, at_b = np.arange(len(a)) + b_before[ga], np.arange(len(b)) + a_upto[gb]
        word = np.empty(len(a) + len(b), "S12")
        word[at_a], word[at_b] = self.digits[0][a], self.digits[1][b]
        sign = np.full(len(word), ord(","), np.uint8)
        sign[at_a[a_upto - 1]] = ord("|")
        sign[at_b[term]] = ord(";")
        chars = np.zeros((len(word), 13), np.uint8)
        chars[:, :12] = word.view(np.uint8).reshape(-1, 12)
        length = (chars != 0).sum(1)
        chars[np.arange(len(word)), length] = sign
        ends = np.concatenate([[0], np.cumsum(length + 1)])[np.concatenate([[0], np.cumsum(per_unit)])]
        return pa.Array.from_buffers(pa.binary(), len(per_unit), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chars[chars != 0])])


def buffers_of(col: pa.Array) -> np.ndarray:
    return binary_buffers(col)[0]


def _visible_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a visible ASCII character, or a two-byte character from U+00C0
    on (none of which is white space), ends right before each place."""
    last, lead = raw[at - 1], raw[np.maximum(at - 2, 0)]
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF) & (at > 1))


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct values of two ascending arrays, ascending."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _unit_bounds(raw: np.ndarray) -> np.ndarray:
    """Places of spaces that end a unit: they follow a visible character."""
    at = np.flatnonzero(raw == 0x20)
    at = at[at > 0]
    return at[_visible_before(raw, at)]


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group label (index of its terminal B token) of every A and B token, by
    pointer jumping. The ends are byte offsets, ascending, of tokens that tile
    the same bytes."""
    n_a = len(a_end)
    if n_a == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to_b = np.searchsorted(b_end, a_end, side="left")        # the B token that holds A's last byte
    to_a = np.searchsorted(a_end, b_end, side="left")        # the A token that holds B's last byte
    own = np.arange(len(b_end)) + n_a
    point = np.concatenate([to_b + n_a, np.where(a_end[to_a] == b_end, own, to_a)])
    while True:
        further = point[point]
        if np.array_equal(further, point):
            break
        point = further
    return point[:n_a] - n_a, point[n_a:] - n_a


def links_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlaps: one for each stretch between
    neighbouring ends of either side."""
    end = _merged(a_end, b_end)
    return np.searchsorted(a_end, end, side="left"), np.searchsorted(b_end, end, side="left")


def _runs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Iterator]]:
    """Slices of rows, each with its runs of units (``_coded``): one run, or
    several if the slice is a single long text."""
    for b in slices(batches, text, SLICE):
        raw, off = buffers(b.column(text))
        size = np.diff(off)
        # A space before every text that is not empty.
        full = size > 0
        shift = np.cumsum(full)
        wide = np.full(len(raw) + int(shift[-1]), 0x20, np.uint8)
        wide[np.arange(len(raw)) + np.repeat(shift, size)] = raw
        bound = off + np.concatenate([[0], shift])
        yield b, _coded(wide, bound)


def _coded(raw: np.ndarray, bound: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(distinct units, code of each unit, number of units before each text
    bound) of runs of about 2 * ``SLICE`` bytes."""
    inner = _unit_bounds(raw)
    inner = inner[~np.isin(inner + 1, bound)]       # B takes no lone space: one at a text's end stays with the unit before
    cut = _merged(inner, bound)
    cut = cut[cut < len(raw)]
    at, n = 0, len(raw)
    while at < len(cut):
        stop = max(at + 1, int(np.searchsorted(cut, cut[at] + 2 * SLICE, side="right")))
        lo, hi = int(cut[at]), int(cut[stop]) if stop < len(cut) else n
        ends = np.concatenate([cut[at:stop], [hi]]) - lo
        units = pa.Array.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[lo:hi]))])
        coded = units.dictionary_encode()
        first = np.clip(np.searchsorted(cut, bound) - at, 0, stop - at)
        yield coded.dictionary, np.asarray(coded.indices, dtype=np.int64), first
        at = stop


def _add(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def pair_counts(docs: DataFrame, files: Tokenizers, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n): corpus-wide links of each id pair."""
    sent = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sent.value.open()
        for b, runs in _runs(batches, "text"):
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, code, first in runs:
                t = pair.table(words, spell=False)
                bad = _add(~t["ok"][code], first)
                if b.num_rows == 1 and bad[0]:           # of a long text in several runs nothing counts then
                    keys, counts = keys[:1], counts[:1]
                    break
                keys.append(t["pair"])
                counts.append(np.repeat(np.bincount(code[np.repeat(bad == 0, np.diff(first))], minlength=len(t["ok"])), t["n_links"]))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
            key, n = key[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array((key // pair.n_b).astype(np.int32)), pa.array((key % pair.n_b).astype(np.int32)), pa.array(n)],
                                             names=["a_id", "b_id", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "a_id int, b_id int, n long")
    return rows.groupBy("a_id", "b_id").agg(F.sum("n").cast("bigint").alias("n"))


def best_pairs(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: whether n is the highest of its B id. A B id
    has at most one row per A id, so its group is bounded by A's vocabulary."""
    top = counts.groupBy(F.col("b_id").alias("top_b")).agg(F.max("n").alias("top"))
    return counts.join(top, F.col("b_id") == F.col("top_b")).select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, files: Tokenizers, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          pair_block: int = PAIR_BLOCK) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256. ``counts`` is the staged result of
    ``best_pairs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(files)
    total = counts.count()
    blocks = max(1, -(-total // pair_block))
    src = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    kind = src.schema["row_id"].dataType.simpleString()
    carry = f"row_id {kind}, text string, n_best long, count_sum long"
    final = f"row_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def work(table, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = sent.value.open()
            key, count, best = table.value
            for b, runs in _runs(batches, "text"):
                rows = b.num_rows
                out = {c: np.zeros(rows, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
                bad = np.zeros(rows, np.int64)
                digest = [None] * rows
                for words, code, first in runs:
                    t = pair.table(words, spell=last)
                    at = np.minimum(np.searchsorted(key, t["pair"]), max(0, len(key) - 1))
                    hit = key[at] == t["pair"] if len(key) else np.zeros(len(t["pair"]), bool)
                    t["n_best"] = _add(hit & best[at] if len(key) else hit, t["first"])
                    t["count_sum"] = _add(np.where(hit, count[at], 0) if len(key) else hit, t["first"])
                    bad += _add(~t["ok"][code], first)
                    for c in out:
                        out[c] += _add(t[c][code], first)
                    if last:
                        raw, at = binary_buffers(t["text"].take(pa.array(code)))
                        for i in np.flatnonzero(np.diff(first)).tolist():
                            part = raw[at[first[i]]:at[first[i + 1]]]
                            if digest[i] is None:
                                digest[i] = hashlib.sha256(part[:-1])
                            else:                       # a further run of a long text
                                digest[i].update(b";")
                                digest[i].update(part[:-1])
                for c in out:
                    out[c][bad > 0] = 0
                    if c in ("n_best", "count_sum"):
                        out[c] += np.asarray(b.column(c))
                cols = {c: pa.array(v) for c, v in out.items()} | {"row_id": b.column("row_id")}
                names = ["row_id", "text", "n_best", "count_sum"]
                if last:
                    cols["groups_sha256"] = pa.array([d.hexdigest() if d is not None and not x else "" for d, x in zip(digest, bad.tolist())], pa.string())
                    names = ["row_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                else:
                    cols["text"] = b.column("text")
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)
        return run

    for k in range(blocks):
        part = counts.filter(F.pmod(F.xxhash64("a_id", "b_id"), F.lit(blocks)) == k) if blocks > 1 else counts
        got = part.toArrow()
        n_b = _b_size(files)
        key = np.asarray(got["a_id"], dtype=np.int64) * n_b + np.asarray(got["b_id"], dtype=np.int64)
        order = np.argsort(key)
        table = spark.sparkContext.broadcast((key[order], np.asarray(got["n"])[order], np.asarray(got["best"])[order]))
        src = src.mapInArrow(work(table, k == blocks - 1), final if k == blocks - 1 else carry)
        if k < blocks - 1:
            src = staged(src, "align-pass")
    return src.withColumnRenamed("row_id", id_col)


def _b_size(files: Tokenizers) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=files.b_model).vocab_size()


def align_tokenizers(docs: DataFrame, files: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                     pair_block: int = PAIR_BLOCK) -> DataFrame:
    """``align`` against the counts of the same documents."""
    counts = staged(best_pairs(staged(pair_counts(docs, files, text_col), "link-counts")), "link-best")
    return align(docs, files, counts, id_col, text_col, pair_block)
