"""Deduplication operators against brute force, with awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kiln.llm import exact_dedup, near_dedup, queries, suffix_dedup
from kiln.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept boolean, n long, score double"   # extra columns with clashing names
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, False, 7, 0.5) for i, t in rows], SCHEMA)


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]


AWKWARD = [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "one"), (1004, "one two"), (1005, "É à ß"), (1006, "é à ß"),
           (1007, "ONE Two"), (1008, "\x0bone\x0ctwo "), (1009, "x" * 3000)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out, base = list(AWKWARD), words(rng, 120)
    for i in range(60):                                   # one family of near copies, mutated at growing rates
        w = list(base)
        for _ in range(i // 6):
            w[rng.randrange(len(w))] = "m" + str(rng.randrange(10**6))
        out.append((i, " ".join(w)))
    for i in range(60, 100):
        out.append((i, " ".join(words(rng, rng.randrange(1, 200)))))
    passage = " ".join(words(rng, 130))
    for i in range(100, 130):                              # a common passage in otherwise different texts
        out.append((i, " ".join(words(rng, 60)) + " " + passage + " " + " ".join(words(rng, rng.randrange(90)))))
    out += [(200, "Same Text"), (201, "same text"), (202, "SAME TEXT"), (203, "ab " * 400), (204, "ab " * 400)]
    return out


def test_exact_dedup_matches_grouping(spark, rows):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_null_ids_and_repeats(spark):
    df = frame(spark, [(None, "a"), (5, "A"), (5, "a"), (None, "b"), (None, "B"), (9, "c")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 2, True), (None, None, 2, True),
                          (9, 9, 1, True)], key=str)
    assert sorted(r.text.lower() for r in exact_dedup.drop_copies(df).collect()) == ["a", "b", "c"]
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_exact_dedup_smallest(spark):
    df = frame(spark, [(3, "a"), (1, "a"), (2, "a")])
    assert {r.keep_id for r in exact_dedup.exact_dedup(df, keep="smallest").collect()} == {1}


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    return sets, comp


@pytest.mark.parametrize("n,percent,short,lists", [(3, 85, 16, "blocks"), (5, 80, 2, "pivots"), (5, 80, 2, "blocks"), (3, 85, 2, "pairs")])
def test_near_dedup_matches_brute_force(spark, rows, monkeypatch, n, percent, short, lists):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)    # 2: every list goes through pivots
    if lists == "pivots":
        monkeypatch.setattr(near_dedup, "SHORT_LATER", short)
        monkeypatch.setattr(near_dedup, "BLOCK_LIST", 0)
    elif lists == "pairs":
        monkeypatch.setattr(near_dedup, "BLOCK_LIST_VALUES", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)            # families span several blocks
    sets, comp = brute_components(rows, n, percent)
    got = near_dedup.near_dedup(frame(spark, rows), shingle=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in comp.items()}
    assert len(got) == len(rows) and max(Counter(comp.values()).values()) > 5


def test_near_dedup_nine_words_against_eight(spark):
    rng, rows, seen = random.Random(11), [], set()
    while len(seen) < 10:                                   # first or last word gone, its shingle at every rank of the hash order
        w, first = words(rng, 9), rng.random() < 0.5
        five, four = near_dedup.shingle_sets(pa.array([" ".join(w), " ".join(w[1:] if first else w[:-1])]), 5)
        case = (first, int(np.flatnonzero(~np.isin(five, four))[0]))
        if case not in seen:
            seen.add(case)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[1:] if first else w[:-1]))]
    got = near_dedup.near_dedup(frame(spark, rows), shingle=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("short", [16, 1])                  # 1: the pair's lists go through a pivot
def test_near_dedup_link_of_low_estimate(spark, monkeypatch, short):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    w = [f"w{i}" for i in range(200)]
    h = near_dedup.shingle_sets(pa.array(w), 1)
    w.sort(key=lambda x: int(h[int(x[1:])][0]))
    gone = set(w[36:64] + w[188:])                          # 28 of the 64 least values, 40 of 200
    rows = [(1, " ".join(w)), (2, " ".join(x for x in w if x not in gone))]
    a, b = near_dedup.shingle_sets(pa.array([t for _, t in rows]), 1)
    assert len(b) / len(a) == 0.8 and near_dedup.union_estimate(a[:64], b[:64]) < near_dedup.CORE
    got = near_dedup.near_dedup(frame(spark, rows), shingle=1, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_near_dedup_null_id_stays(spark):
    df = frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(df, shingle=3).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 2, False), (2, 2, True), (2, 2, True)], key=str)
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_copies(df).collect()) == ["2", "2", "None"]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(400 + i, 401 + i) for i in range(40)]
    comp = {}
    for a, b in edges:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in comp.items() if k in touched}


def brute_spans(rows, length):
    raw = {i: (t or "").encode() for i, t in enumerate(t for _, t in rows)}
    count = Counter(b[p:p + length] for b in raw.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        cov = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                cov[p:p + length] = True
        out[i] = (len(b), int(cov.sum()), int((cov & ~np.concatenate([[False], cov[:-1]])).sum()) if len(b) else 0,
                  bytes(np.frombuffer(b, np.uint8)[~cov]))
    return out


@pytest.mark.parametrize("length,cover", [(400, 128), (90, 40)])
def test_suffix_dedup_matches_brute_force(spark, rows, length, cover):
    want = brute_spans(rows, length)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows), length=length, cover=cover).collect()}
    for k, (i, _) in enumerate(rows):
        n, removed, spans, kept = want[k]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (n, removed, spans), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_query_on_planted_passages(spark, tmp_path):
    """Of passages over 50 words, those from 400 bytes on go in every copy; shorter ones stay, and n_bytes is the input size."""
    rng = random.Random(5)
    long, short = " ".join(words(rng, 110)), " ".join(words(rng, 60))
    assert len(long) > 400 > len(short)
    planted = {i: (long if i < 8 else short if i < 16 else "") for i in range(24)}
    rows = [(i, (f"{' '.join(words(rng, 50 + i))} {p} " + " ".join(words(rng, 600)))[:2000]) for i, p in planted.items()]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    want = brute_spans(rows, 400)
    for i, p in planted.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == want[i][:3]
        assert got[i].n_bytes == 2000 and got[i].changed == (p == long) and got[i].n_removed >= len(long) * (p == long)
        assert got[i].kept_sha256 == hashlib.sha256(want[i][3]).hexdigest()


def test_remove_repeats_keeps_valid_text(spark, rows):
    want = brute_spans(rows, 90)
    df = frame(spark, rows)
    got = suffix_dedup.remove_repeats(df, length=90, cover=40)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    for k, (i, t) in enumerate(rows):
        if want[k][1] == 0:
            assert texts[i] == t
        elif want[k][3].decode("utf-8", "ignore"):
            assert texts[i] == want[k][3].decode("utf-8", "ignore")
        else:
            assert i not in texts


def test_long_text_is_cut_without_loss(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(9000))
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], names=["th", "text"])
    starts = Counter()
    for _, raw, off, at in suffix_dedup._pieces(iter([batch]), 100):
        for lo, hi in zip(*suffix_dedup.samples(raw, off, 100, 40)[1:3]):
            starts.update(range(lo + at, hi + at + 1))
    assert starts == Counter(range(9000 - 100 + 1))


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, exact_dedup.drop_copies, near_dedup.near_dedup, near_dedup.drop_near_copies,
                                 suffix_dedup.suffix_dedup, suffix_dedup.remove_repeats])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []
