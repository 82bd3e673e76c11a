"""SentencePiece segmentations sampled without replacement, and decoding.

The pieces of a SentencePiece model span a lattice over the text (blanks as
U+2581, one put in front; characters without a piece fall back to byte
pieces). A merge-ordered model carries ranks, not probabilities, so a piece
weighs -log(rank + 2.7); a segmentation's weight is the sum over its pieces.

Gumbel top-k: every segmentation's log probability, perturbed by a Gumbel
variable, ranks it; the k best are k distinct samples without replacement.
They are found top-down by an A-star search: a partial segmentation stands for
all its completions (their mass comes from the backward pass of the lattice),
its perturbed maximum is drawn first and bounds those of its parts. The best
open node is expanded until it is a whole segmentation, k times. ``log
inclusion`` is the log probability of having been sampled given the (k+1)-th
perturbed value. All draws are counter-based hashes of the row key.

No piece crosses from a non-blank to a blank, so texts fall into units
(blanks, then non-blanks) whose lattices are independent; distinct units are
compiled once per slice of texts.

Defined results: null counts as empty; an empty text is the one piece of the
leading blank; a text with fewer than k segmentations gives what it has. Rows
of one key and text give equal samples; null keys share one stream.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import binary_buffers, buffers, mix64, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
BLANK = "▁"
_LITERAL = "\udc81"            # stands for a U+2581 of the text itself; cannot occur in valid text
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_SPLIT = re.compile(f"[^{BLANK}]{BLANK}")
REACH = 38.0                 # largest excess of a Gumbel drawn from uniforms of 54 bits
AHEAD = 512                  # steps of a path drawn at once
SLICE = 4 << 20              # bytes of text worked on at a time


def load_pieces(path: str = MODEL) -> dict:
    """{"pieces": {string: (id, weight)}, "bytes": first byte id, "weight":
    weight of a byte, "text": {id: bytes}} of a model with byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, text, first_byte, rank = {}, {}, None, 0
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            first_byte = i if first_byte is None else first_byte
            text[i] = bytes([i - first_byte])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text[i] = p.replace(BLANK, " ").encode()
            if not _SPLIT.search(p):
                pieces[p] = (i, -math.log(rank + 2.7))
            rank += 1
    return {"pieces": pieces, "bytes": first_byte, "weight": -math.log(rank + 2.7), "text": text}


def units(text: str) -> list[str]:
    if BLANK in text:
        text = text.replace(BLANK, _LITERAL)
    return _UNITS.findall(BLANK + text.replace(" ", BLANK))


def coded_units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all texts at once: (bytes with a blank put before every
    text, bounds of the texts in them, distinct units one after another, their
    numbers of characters, number of each unit's distinct one, number of units
    before each text bound)."""
    raw, off = buffers(col)
    n = len(col)
    wide = np.full(len(raw) + n, 0x20, np.uint8)
    wide[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = raw
    ends = off + np.arange(n + 1)
    begins = wide == 0x20
    begins[1:] &= wide[:-1] != 0x20
    begins[ends[:-1]] = True
    cut = np.concatenate([np.flatnonzero(begins), [len(wide)]])
    coded = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(wide)]).dictionary_encode()
    words, first = binary_buffers(coded.dictionary)
    size = np.add.reduceat((words & 0xC0) != 0x80, first[:-1], dtype=np.int64) if len(first) > 1 else np.zeros(0, np.int64)
    joined = words.tobytes().decode().replace(BLANK, _LITERAL).replace(" ", BLANK)
    return wide, ends, joined, size, np.asarray(coded.indices, dtype=np.int64), np.searchsorted(cut, ends)


def decode(ids: list[int], model: dict) -> str:
    """Text of piece ids: joined bytes, without the leading blank."""
    t = model["text"]
    return b"".join([t[i] for i in ids])[1:].decode("utf-8", "replace")


_B = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """Compiles units: for every position its outgoing pieces with the
    probability of taking them (weights times backward mass). All positions of
    all units are worked on together, one numpy pass per piece length and one
    per distance to the unit's end."""

    def __init__(self, model: dict):
        self.byte0, self.byte_w = model["bytes"], model["weight"]
        names = list(model["pieces"])
        self.longest = max(map(len, names))
        ids = np.array([model["pieces"][p][0] for p in names], np.int64)
        weights = np.array([model["pieces"][p][1] for p in names])
        self.alive = np.zeros(1 << 22, bool)      # by the high bits of a hash: some piece may begin like this
        h = self._hashes(names)
        # Two-choice table: a piece sits in the slot of its high bits, or if
        # that is taken in the sorted rest.
        slot = (h >> np.uint64(44)).astype(np.int64)
        _, at = np.unique(slot, return_index=True)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[slot[at]] = at
        rest = np.setdiff1d(np.arange(len(h)), at)
        self.rest = rest[np.argsort(h[rest])]
        self.hashes, self.ids, self.weights = h, ids, weights
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.spelled: dict[int, int] = {}
        self.spellings: list[list[int]] = []

    def _hashes(self, names: list[str]) -> np.ndarray:
        size = np.array([len(x) for x in names])
        code = mix64(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        first, h = np.cumsum(size) - size, np.zeros(len(names), np.uint64)
        for i in range(int(size.max())):
            on = size > i
            h[on] = h[on] * _B + code[first[on] + i]
            self.alive[mix64(h[on]) >> np.uint64(42)] = True
        return mix64(h)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 without one."""
        k = self.slots[(key >> np.uint64(44)).astype(np.int64)]
        k[self.hashes[k] != key] = -2
        k[k == -1] = -2
        if len(self.rest):
            miss = np.flatnonzero(k == -2)
            r = self.hashes[self.rest]
            taken = miss[self.slots[(key[miss] >> np.uint64(44)).astype(np.int64)] >= 0]     # only a used slot can have pushed one out
            j = np.minimum(np.searchsorted(r, key[taken]), len(r) - 1)
            good = r[j] == key[taken]
            k[taken[good]] = self.rest[j[good]]
        return np.where(k < 0, -1, k)

    def _spelling(self, c: int) -> int:
        if c not in self.spelled:
            raw = BLANK.encode() if chr(c) == _LITERAL else chr(c).encode("utf-8", "replace")
            self.spelled[c] = len(self.spellings)
            self.spellings.append([self.byte0 + b for b in raw])
        return self.spelled[c]

    def spell(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the byte spellings written out, and the moved offsets."""
        sizes = np.array([1, *map(len, self.spellings)])
        n = np.where(ids >= 0, 1, sizes[np.maximum(-ids, 0)])
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.repeat(ids, n)
        low = np.flatnonzero(out < 0)
        if len(low):
            flat = np.concatenate(self.spellings)
            begin = np.cumsum(sizes[1:]) - sizes[1:]
            within = low - np.repeat(ends[:-1], n)[low]
            out[low] = flat[begin[-1 - out[low]] + within]
        return out, ends[off]

    def table(self, joined: str, size: np.ndarray) -> dict:
        """Edge arrays over all positions (states) of the distinct units, given
        one after another with their numbers of characters; longest
        piece first; ``first`` is each unit's first state, target -1 its end; an
        id below 0 is a byte spelling."""
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(size)
        first = stop - size
        left = np.repeat(stop, size) - np.arange(len(chars))          # characters to the unit's end
        code = mix64(chars.astype(np.uint64) + np.uint64(1))
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        src, length, ids, weight = [], [], [], []
        for n in range(1, self.longest + 1):
            on = left[at] >= n
            at, h = at[on], h[on] * _B + code[at[on] + n - 1]
            if not len(at):
                break
            key = mix64(h)
            on = self.alive[key >> np.uint64(42)]
            if n == 1:
                single = np.zeros(len(chars), bool)      # characters that are pieces
            at, h, key = at[on], h[on], key[on]
            k = self._find(key)
            hit = k >= 0
            src.append(at[hit])
            ids.append(self.ids[k[hit]])
            weight.append(self.weights[k[hit]])
            length.append(np.full(int(hit.sum()), n))
            if n == 1:
                single[at[hit]] = True
                miss = np.flatnonzero(~single)
            if n == 1 and len(miss):
                u, inv = np.unique(chars[miss], return_inverse=True)
                spell = np.array([self._spelling(int(c)) for c in u])
                src.append(miss)
                ids.append(-1 - spell[inv])
                weight.append(self.byte_w * np.array([len(self.spellings[x]) for x in spell])[inv])
                length.append(np.ones(len(miss), np.int64))
        src, length, ids, weight = (np.concatenate(x[::-1]) for x in (src, length, ids, weight))
        order = np.argsort(src, kind="stable")
        src, length, ids, weight = src[order], length[order], ids[order], weight[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(chars)))])
        # Backward mass, all positions at one distance from their end at a time.
        beta = np.zeros(len(chars) + 1)
        ends = length == left[src]
        target = np.where(ends, len(chars), src + length)
        by = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[by], np.arange(1, int(left.max()) + 2)) if len(left) else []
        for d in range(len(cut) - 1):
            pos = by[cut[d]:cut[d + 1]]
            n = start[pos + 1] - start[pos]
            off = np.cumsum(n) - n
            e = np.arange(n.sum()) - np.repeat(off, n) + np.repeat(start[pos], n)
            v = weight[e] + beta[target[e]]
            top = np.maximum.reduceat(v, off)
            beta[pos] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n)), off))
        logp = np.minimum(weight + beta[target] - beta[src], 0.0)
        pr = np.exp(logp)
        cum = np.cumsum(pr)
        cum -= np.repeat(cum[start[:-1]] - pr[start[:-1]], np.diff(start))
        return {"first": first, "start": start, "logp": logp, "cum": cum, "to": np.where(ends, -1, src + length), "id": ids, "rest": _rest(logp)}


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mix64(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _draw(x: int) -> float:
    """``_uniform`` of one number."""
    x &= 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53 + 2.0**-54


def sample_paths(t: dict, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges of all paths one after another, offsets): one path per state,
    each piece drawn with its probability."""
    live, cur, sd = np.arange(len(state)), state, seed
    steps, taken = [], np.zeros(len(state), np.int64)
    k = 0
    while len(live):
        e = t["start"][cur].copy()
        last = t["start"][cur + 1] - 1
        open_ = np.flatnonzero(e < last)
        u = _uniform(sd[open_] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
        while len(open_):
            more = u > t["cum"][e[open_]]
            open_, u = open_[more], u[more]
            e[open_] += 1
            more = e[open_] < last[open_]
            open_, u = open_[more], u[more]
        steps.append((live, e))
        taken[live] += 1
        cur = t["to"][e]
        on = cur >= 0
        live, cur, sd = live[on], cur[on], sd[on]
        k += 1
    off = np.concatenate([[0], np.cumsum(taken)])
    out = np.empty(off[-1], np.int64)
    for k, (who, e) in enumerate(steps):
        out[off[who] + k] = e
    return out, off


def _truncated(mass: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel with log mass ``mass`` conditioned to lie below ``bound``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


def _truncated_one(mass: float, bound: float, u: float) -> float:
    a, b = -bound, math.log(-math.log(u)) - mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b)))) if a != b else -(a + math.log(2))


def _rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - p); -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        r = np.log(-np.expm1(logp))
    return np.where(logp > -1e-12, -np.inf, r)


def top_samples(t: dict, edges: list[np.ndarray], offs: list[np.ndarray], lo: int, hi: int, seed: int, k: int) -> list[tuple]:
    """k samples without replacement of the document made of units lo..hi:
    (edges, log probability, perturbed value), and the (k+1)-th value.
    ``edges[j]`` / ``offs[j]`` hold the j-th independent draw of every unit."""
    def draw(tag: int) -> float:
        return _draw(seed + 0x632BE59BD9B4E019 * (tag + 1))

    def opened(path: np.ndarray, from_step: int, bound: float, tag: int) -> dict:
        """A path with the perturbed maxima of the branches off its steps. The
        uniforms are at most 1 - 2^-54, so no Gumbel exceeds its mass by more
        than ``REACH``: steps whose prefix lies further below the best branch
        cannot win and are not drawn."""
        n = len(path)
        base = (seed + 0x632BE59BD9B4E019 * (tag + 1)) & (2**64 - 1)
        lp = t["logp"][path]
        before = np.cumsum(lp) - lp
        g = np.full(n, -np.inf)
        drawn, stop = from_step, min(n, from_step + 64)
        while True:
            if stop > drawn:                             # each step is drawn once, at least AHEAD of them together
                to = min(n, max(stop, from_step + AHEAD))
                u = _uniform(np.uint64(base) + np.arange(drawn - from_step, to - from_step, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
                g[drawn:to] = _truncated(before[drawn:to] + t["rest"][path[drawn:to]], bound, u)
                drawn = to
            if stop == n or before[stop - 1] + REACH < g[:stop].max(initial=-np.inf):
                break
            stop = min(n, 2 * stop)
        return {"path": path, "before": before, "g": g[:stop], "used": {}, "log": float(lp.sum())}

    g0 = float(-math.log(-math.log(draw(0))))
    nodes = [opened(edges[0][offs[0][lo]:offs[0][hi]], 0, g0, 1)]
    out = [(nodes[0]["path"], nodes[0]["log"], g0)]
    best = [int(nodes[0]["g"].argmax())]
    while True:
        who = max(range(len(nodes)), key=lambda j: nodes[j]["g"][best[j]])
        node, i = nodes[who], best[who]
        value = float(node["g"][i])
        if len(out) == k or value == -math.inf:
            return [*out, (None, 0.0, value)]
        # Expand: another piece at step i, then fresh draws to the end.
        state = int(np.searchsorted(t["start"], node["path"][i], side="right") - 1)
        tried = node["used"].setdefault(i, [int(node["path"][i])])
        all_e = np.arange(t["start"][state], t["start"][state + 1])
        p = np.exp(t["logp"][all_e])
        p[np.array(tried) - all_e[0]] = 0
        c = np.cumsum(p)
        tag = 10 * len(out)
        u = draw(tag)
        alt = int(all_e[min(len(all_e) - 1, int(np.searchsorted(c, u * c[-1])))])
        tried.append(alt)
        left = 1.0 - float(np.exp(t["logp"][tried]).sum())
        more = len(tried) < len(all_e) and left > 1e-12
        node["g"][i] = _truncated_one(node["before"][i] + math.log(left), value, draw(tag + 1)) if more else -math.inf
        best[who] = int(node["g"].argmax())
        s = np.array([t["to"][alt]])
        tail = sample_paths(t, s, np.array([(seed + 0x2545F4914F6CDD1D * (tag + 3)) & (2**64 - 1)], np.uint64))[0] if s[0] >= 0 else np.zeros(0, np.int64)
        # The unit that step i falls into: units end where an edge leads to -1.
        unit = lo + int((t["to"][node["path"][:i]] < 0).sum())
        j = len(out)
        path = np.concatenate([node["path"][:i], [alt], tail, edges[j][offs[j][unit + 1]:offs[j][hi]]])
        new = opened(path, i + 1, value, tag + 2)
        nodes.append(new)
        best.append(int(new["g"].argmax()) if len(path) else 0)
        out.append((path, new["log"], value))


def log_inclusion(log_prob: float, kappa: float) -> float:
    if kappa == -math.inf:
        return 0.0
    x = log_prob - kappa
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700))))


def sample_encode(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = 0,
                  verify: bool = False) -> DataFrame:
    """Up to k rows per document: id, sample (from 1), ids, log_prob,
    perturbed, log_inclusion, and with ``verify`` round_trip: whether decoding
    gives the text back."""
    src = docs.select(F.col(id_col).alias("sg_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["sg_id"].dataType.simpleString()

    def gives_back(ids: np.ndarray, off: np.ndarray, raw: np.ndarray, ends: np.ndarray, docs: tuple) -> list[bool]:
        """Whether the bytes of each sample's pieces are its text's."""
        spelled, first = binary_buffers(piece_bytes.take(pa.array(ids)))
        at = first[off]
        return [np.array_equal(spelled[x:y], raw[ends[d]:ends[d + 1]]) for x, y, d in zip(at[:-1], at[1:], docs)]

    piece_bytes = pa.array([model["text"].get(i) for i in range(max(model["text"]) + 1)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(model)
        for b in slices(batches, "text", SLICE):
            keys = b.column("sg_id").to_pylist()
            raw, ends, words, size, uid, bound = coded_units(b.column("text"))
            t = lat.table(words, size)
            state = t["first"][uid]
            rs = np.array([xxhash.xxh3_64_intdigest(repr(key), seed=seed) for key in keys], np.uint64)
            n = np.diff(bound)
            place = np.arange(len(uid)) - np.repeat(bound[:-1], n)
            sd = np.concatenate([mix64(np.repeat(rs, n) + mix64(place.astype(np.uint64) * np.uint64(k) + np.uint64(j))) for j in range(k)])
            e, o = sample_paths(t, np.tile(state, k), sd)
            cut = np.arange(k + 1) * len(uid)
            edges = [e[o[x]:o[y]] for x, y in zip(cut[:-1], cut[1:])]
            offs = [o[x:y + 1] - o[x] for x, y in zip(cut[:-1], cut[1:])]
            rows: list[tuple] = []
            paths = []
            for d in range(len(keys)):
                got = top_samples(t, edges, offs, bound[d], bound[d + 1], int(rs[d]), k)
                for s, (path, lp, g) in enumerate(got[:-1]):
                    rows.append((d, s + 1, lp, g, log_inclusion(lp, got[-1][2])))
                    paths.append(path)
            ids, off = lat.spell(t["id"][np.concatenate(paths)], np.cumsum([0, *map(len, paths)]))
            c = list(zip(*rows))
            same = gives_back(ids, off, raw, ends, c[0]) if verify else [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("sg_id").take(pa.array(c[0])), pa.array(c[1], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))),
                 pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(same, pa.bool_())],
                names=["sg_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"])

    out = src.mapInArrow(run, f"sg_id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean")
    return (out if verify else out.drop("round_trip")).withColumnRenamed("sg_id", id_col)


def decode_rows(encoded: DataFrame, model: dict, ids_col: str = "ids", result: str = "text") -> DataFrame:
    """``encoded`` with the decoded text of its piece ids; null ids give null."""
    schema = encoded.withColumn(result, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if i is None else decode(i, model) for i in b.column(ids_col).to_pylist()]
            cols = {c: b.column(c) for c in b.schema.names} | {result: pa.array(text, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], names=schema.names)

    return encoded.mapInArrow(run, schema)
