"""Decontamination, vector codes and tokenizer alignment against brute force,
with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kiln.llm import alignment, decontaminate, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---------------------------------------------------------------- decontamination

def leaks_by_hand(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leak_rows():
    rng = random.Random(5)
    say = lambda n, k=6: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(k, say(rng.randrange(8, 40))) for k in range(60)]              # a tiny alphabet: many shared contexts
    items += [(100, "one short ITEM"), (101, "short item"), (102, "item"), (103, "x item y"), (104, None), (105, ""), (106, "... --- !"),
              (0, items[0][1]), (107, items[1][1]), (None, "nobody owns this one"), (108, "É été 東京 ß1"),
              (109, "a a a a a a a a a a a a"), (110, " ".join(f"w{i}" for i in range(300)))]
    docs = [(k, say(rng.randrange(0, 300))) for k in range(80)]
    docs += [(200, None), (201, ""), (202, " .,;\x00"), (203, "One, short;item"), (204, "an item"), (205, "É été 東京 ß1"), (206, "é été 東京 ß1"),
             (207, "nobody OWNS this-one"), (208, "a " * 40), (208, "a " * 40), (None, "x item y"),
             (209, " ".join(f"w{i}" for i in range(40, 180)) + " end"), (210, " ".join(f"w{i}" for i in range(100, 109))),
             (211, "z" * 200_000 + " one short item " + "q " * 100_000)]
    return docs, items


DOC = "doc_id long, text string, n_words int, items string, row int, hit string"     # further columns with clashing names


def doc_frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in docs], DOC)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, shard string")


def test_leaks_match_brute_force(spark, leak_rows):
    docs, items = leak_rows
    got = sorted((tuple(r) for r in decontaminate.leaks(doc_frame(spark, docs), item_frame(spark, items)).collect()), key=repr)
    assert got == leaks_by_hand(docs, items)


def test_leaks_over_many_shards_and_passes(spark, leak_rows, monkeypatch):
    docs, items = leak_rows
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 500)
    monkeypatch.setattr(decontaminate, "PASS_SHARDS", 2)
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    monkeypatch.setattr(decontaminate, "LANE", 7)
    got = sorted((tuple(r) for r in decontaminate.leaks(doc_frame(spark, docs), item_frame(spark, items), window=6).collect()), key=repr)
    assert got == leaks_by_hand(docs, items, 6)


def test_leaks_of_empty_tables(spark, leak_rows):
    docs, items = leak_rows
    none = hashlib.sha256(b"").hexdigest()
    assert decontaminate.leaks(doc_frame(spark, []), item_frame(spark, items)).count() == 0
    for few in ([], [(1, None), (2, "")]):
        rows = decontaminate.leaks(doc_frame(spark, docs), item_frame(spark, few)).collect()
        assert len(rows) == len(docs)
        assert {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == {(0, 0, none, False)}


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"Before it: {item.title()}, after."), (2, item), (3, "clean text"), (4, None),
            (5, "pad " * 20 + "É " + item + " 東京"), (5, "pad " * 20 + "É " + item + " 東京")]
    out = decontaminate.decontaminate(doc_frame(spark, docs), item_frame(spark, [(9, item)]), max_coverage=0.8)
    assert out.columns == doc_frame(spark, []).columns
    got = sorted(((r.doc_id, r.text, r.hit) for r in out.collect()), key=repr)
    assert got == [(1, "Before it: , after.", "y"), (3, "clean text", "y"), (4, None, "y")] + [(5, "pad " * 20 + "É  東京", "y")] * 2
    bare = decontaminate.decontaminate(doc_frame(spark, docs).select("text"), item_frame(spark, [(9, item)]))
    assert bare.columns == ["text"] and bare.count() == 4            # document 1 is covered by more than half


# ---------------------------------------------------------------- vector codes

def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], c) for i, v, c in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (size * parts - len(v)), c) for i, v, c in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[v[p * size:(p + 1) * size] for v in start] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in start]
            for _, v, _ in kept:
                x = v[p * size:(p + 1) * size]
                held[near(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out, per = [], Counter()
    for i, v, c in kept:
        got = [near(v[p * size:(p + 1) * size], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), c])
        per[c] += out[-1][2]
    return sorted(([i, code, e, per[c]] for i, code, e, c in out), key=repr), ",".join(str(x) for b in books for e in b for x in e)


def codes_by_operator(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, 1, "s") for i, v, c in rows], "vec_id long, embedding array<float>, label int, id int, salt string")
    out, books = vector_codes.compress(df, **kw)
    got = sorted(([r.id, "".join(f"{k:02x}" for k in r.code), r.error, r.label_error] for r in out.collect()), key=repr)
    return got, ",".join(str(x) for b in books for x in b.ravel().tolist())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    f = lambda *s: [float(x) for x in np.float32(rng.normal(size=s).round(2))]
    rows = [(i, f(24), None if i % 7 == 0 else i % 3) for i in range(120)]
    rows += [(200 + i, rows[5][1], 1) for i in range(60)]                       # one vector held by a third of the rows
    rows += [(300, None, 0), (301, [1.0, None] * 12, 0), (302, [float("nan")] * 24, 0), (303, [float("inf")] * 24, 0), (304, [], 2),
             (305, f(5), 2), (None, f(24), None), (3, rows[3][1], 0), (-4, [0.5] * 24, None), (-4, [0.25] * 24, None), (306, [-0.0] * 24, 1)]
    return rows


def test_codes_match_brute_force(spark, vectors):
    assert codes_by_operator(spark, vectors) == codes_by_hand(vectors)


def test_codes_with_many_entries_and_shuffled_labels(spark, vectors, monkeypatch):
    import kiln.operators.joins as joins
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(vector_codes, "bounded_broadcast", lambda df: joins.bounded_broadcast(df, max_rows=0))
    assert codes_by_operator(spark, vectors, parts=3, entries=70, rounds=2) == codes_by_hand(vectors, 3, 70, 2)


def test_codes_of_small_tables(spark, vectors):
    for rows in ([], [(1, None, 0)], vectors[:3], [(2, [], None)], [(None, [1.0, 2.0], 3)] * 2):
        got = codes_by_operator(spark, rows)
        if rows and rows[0][0] is None:
            assert got[0] == [[None, "00" * 8, 0, 0]] * 2
        else:
            assert got == codes_by_hand(rows)


def test_codes_decode_and_refuse_huge_components(spark, vectors):
    df = spark.createDataFrame([(i, v, 0) for i, v, _ in vectors[:40]], "vec_id long, embedding array<float>, label int")
    out, books = vector_codes.compress(df)
    exact = {i: np.floor(np.array(v, float) * 4096) for i, v, _ in vectors[:40]}
    for r in vector_codes.decode(out, books).collect():
        assert r.error == int(((exact[r.id] - np.array(r.approx) * 4096) ** 2).sum())
    big = spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(big)


# ---------------------------------------------------------------- alignment

def align_by_hand(docs):
    from tokenizers import Tokenizer
    import sentencepiece
    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown}
    alphabet |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    links, out = [], []
    for _, text in docs:
        full = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != full or b"".join(bb) != full:
            ia = ib = []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, own, i, j, x, y = [], [], 0, 0, 0, 0
        while ia and i < len(ia):
            own.append((ia[i], ib[j]))
            if ea[i] == eb[j]:
                groups.append(",".join(map(str, ia[x:i + 1])) + "|" + ",".join(map(str, ib[y:j + 1])))
                i, j = i + 1, j + 1
                x, y = i, j
            elif ea[i] < eb[j]:
                i += 1
            else:
                j += 1
        links.append(own)
        out.append((len(ia), len(ib), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""))
    count = Counter(p for own in links for p in own)
    top = {}
    for (_, q), n in count.items():
        top[q] = max(n, top.get(q, 0))
    return sorted(((d[0], *o[:4], sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), o[4])
                   for d, o, own in zip(docs, out, links)), key=repr)


AWKWARD = [(900, None), (901, ""), (902, " "), (903, "   \n\t "), (904, "a  b   c "), (905, " lead"), (906, "x\n \n  y\r\n z"), (907, "é à ß b 　c"),
           (908, "東京 タワー"), (909, "<s> </s> <|endoftext|> <0x0A> <unk>"), (910, "low ▁ line"), (911, "nul \x00 byte\x85 x"), (912, "😀 👍🏽 ok"),
           (913, "it's we'll  can't 12345 3.14"), (914, "word " * 5000), (914, "word " * 5000), (None, "no id"), (915, "x" * 30_000), (916, "é ñ ü ж д́ й"),
           (917, "ab " * 20_000 + "▁" + " cd" * 1000), (918, "A-B_C/D http://e.org/?q=%20")]


@pytest.fixture(scope="module")
def texts(spark):
    from tests.conftest import SF001
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows] + AWKWARD


def text_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_a int, row_id string, n_best int")


@pytest.mark.parametrize("slice_bytes,pair_block,parts", [(1 << 20, 2_000_000, 3), (700, 3_000, 2)])
def test_alignment_matches_brute_force(spark, texts, monkeypatch, slice_bytes, pair_block, parts):
    monkeypatch.setattr(alignment, "SLICE", slice_bytes)
    df = text_frame(spark, texts).repartition(parts)
    got = alignment.align_tokenizers(df, alignment.load_tokenizers(), pair_block=pair_block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == align_by_hand(texts)


def test_alignment_of_empty_tables(spark):
    files = alignment.load_tokenizers()
    assert alignment.align_tokenizers(text_frame(spark, []), files).count() == 0
    rows = alignment.align_tokenizers(text_frame(spark, [(1, None), (2, "")]), files).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pointer_jumping_on_random_tilings():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ends = [np.union1d(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), [n]) for _ in "ab"]
        common = np.intersect1d(*ends)
        ga, gb = alignment.groups_of(*ends)
        want = np.searchsorted(ends[1], common)
        assert ga.tolist() == want[np.searchsorted(common, ends[0])].tolist()
        assert gb.tolist() == want[np.searchsorted(common, ends[1])].tolist()
        la, lb = alignment.links_of(*ends)
        spans = [list(zip([0, *e[:-1].tolist()], e.tolist())) for e in ends]
        brute = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(la.tolist(), lb.tolist())) == brute
