"""Language ID, classifiers, URL rules, packing, search and segmentation."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kiln.llm import knn, language_id, packing, quality, segmentation, toxicity, url_filter
from kiln.llm.helpers import held_out_of, read, slices
from kiln.llm.queries import QUERIES, URL_RULES

from ..conftest import SF001, SF01

ODD = [None, "", "   ", "123 !!", "a", "é", "x" * 5000, "\n\n"]
SCHEMA = "doc_id long, text string, lang string, score double, label int"


def odd_docs(spark, n=0):
    return spark.createDataFrame([(None if i == 3 else i, t, None, 0.1, 1) for i, t in enumerate(ODD * 2)][:n or None], SCHEMA)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF01).join(read(spark, SF01, "documents"), "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_language_odd_rows(spark):
    docs = read(spark, SF01, "documents")
    model = language_id.fit_dictionaries(docs, ~held_out_of("doc_id", (4, 2)))
    rows = language_id.language_id(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) * 2
    for r, t in zip(rows, ODD * 2):
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or not r.accepted)
    assert language_id.fit_dictionaries(docs.limit(0), F.lit(True)) == {}
    assert [r.lang_pred for r in language_id.language_id(odd_docs(spark, 5), {}).collect()] == ["und"] * 5
    assert language_id.language_id(odd_docs(spark).limit(0), model).count() == 0


def test_language_by_direct_sizes(spark):
    """Every row's answer from the compressed sizes themselves, ties included."""
    docs = read(spark, SF001, "documents").select("doc_id", "text", F.col("lang").alias("Score"), "lang")
    model = language_id.fit_dictionaries(docs, F.lit(True))
    langs, enc = list(model), language_id.encoders(model)
    got = {r.doc_id: r for r in language_id.language_id(docs, model, keep=["doc_id", "Score"]).collect()}
    assert len(got) == docs.count() and set(next(iter(got.values())).asDict()) == {"doc_id", "lang_pred", "score", "accepted"}
    accepted = {r.doc_id: r for r in language_id.accepted_rows(docs, model).collect()}
    for r in docs.collect():
        raw = r.text.lower().encode()
        parts = [raw[i:i + language_id.BLOCK] for i in range(0, len(raw), language_id.BLOCK)]
        sizes = {lang: sum(map(len, map(e.compress, parts))) for lang, e in zip(langs, enc)}
        best = min(sizes.values())
        assert got[r.doc_id].lang_pred == min(x for x in langs if sizes[x] == best)
        assert sum(v == best for v in sizes.values()) == 1 or not got[r.doc_id].accepted
        assert (r.doc_id in accepted) == got[r.doc_id].accepted
        assert r.doc_id not in accepted or accepted[r.doc_id] == r


def test_more_than_64_languages(spark):
    def text(k):
        rng = random.Random(k)
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(25))
    rows = [(k * 2 + j, text(k), f"l{k:03d}") for k in range(90) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_dictionaries(docs, F.lit(True))
    assert list(model) == [f"l{k:03d}" for k in range(90)]
    small = language_id.fit_dictionaries(docs, F.lit(True), max_docs=90)
    assert list(small) == list(model) and all(len(small[x]) <= 300 for x in small)
    for r in language_id.language_id(docs, model, keep=["lang"]).collect():
        assert r.lang_pred == r.lang


def test_bounded_fraction_at_every_size(spark):
    from kiln.llm.helpers import bounded_fraction
    df = spark.range(200_000)
    for total, want in ((1000, 200_000), (8_000_000, 100), (400_000_000, 2)):
        n = bounded_fraction(df, "id", 4000, total).count()
        assert n == want if total == 1000 else want * 0.4 <= n <= want * 3 + 4
    assert bounded_fraction(spark.range(10), "id", 4000, 4 * 10 ** 14).count() <= 10


@pytest.mark.parametrize("name,target,held", [("op6_toxicity", "toxic", 0.7), ("op8_quality", "quality", 0.9)])
def test_classifier_held_out(spark, name, target, held):
    got = (QUERIES[name](spark, SF01).join(read(spark, SF01, "labels"), "doc_id").filter("held_out")
           .select("score", "predicted", F.col(target).alias("y")).collect())
    s, y = np.array([r.score for r in got]), np.array([r.y for r in got])
    assert ((s >= 0) & (s <= 1)).all() and all(r.predicted == int(r.score >= 0.3) for r in got)
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > held


@pytest.mark.parametrize("mod,score", [(toxicity, toxicity.score_texts), (quality, lambda m, c: quality.predict(m, quality.doc_stats(c)))])
def test_scores_do_not_depend_on_batches(mod, score):
    rng = random.Random(2)
    texts = [*ODD, *[" ".join(rng.choice(["good", "bad", "word", "x!"]) for _ in range(rng.randrange(1, 120))) for _ in range(60)]]
    y = np.array([int("bad bad" in (t or "")) for t in texts])
    if mod is toxicity:
        model = toxicity.train([t or "" for t in texts], y, steps=2)
    else:
        model = quality.fit_trees(quality.doc_stats(pa.array(texts, pa.string())), y.astype(float))
    whole = score(model, pa.array(texts, pa.string()))
    alone = np.concatenate([score(model, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5) and whole[0] == pytest.approx(whole[1])


def test_gru_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network({"a": 1, "b": 2})
    vec = rng.standard_normal((5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    idx, mask = rng.integers(0, 5, (6, 3)), np.ones((6, 3))
    mask[4:, 1] = 0
    def loss():
        return float((net.forward(vec, idx, mask) * np.array([1.0, -2.0, 0.5])).sum())
    cache = {}
    net.forward(vec, idx, mask, cache)
    g, dvec = net.backward(np.array([1.0, -2.0, 0.5]), cache)
    for name in ("wx_f", "wh_b", "attn", "attn_v", "out", "b_f"):
        at = (0,) * net.p[name].ndim
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_single_class_and_no_labels():
    assert toxicity.train(["a", "b"], np.array([1, 1])) == 1.0 and toxicity.train([], np.array([])) == 0.5
    m = quality.fit_trees(np.zeros((0, len(quality.STATS))), np.zeros(0))
    assert quality.predict(m, quality.doc_stats(pa.array(["x", None]))).tolist() == [0.5, 0.5]


def test_url_rules_odd_rows(spark):
    urls = [None, "", "no scheme net/", "http://A.NET/x", "http://net", "http://net/", "http://xnet/", "https://example.net/en/1?x", "https://m.example.net/en",
            "http://example.com/de/1#f", "http://a.org/fr/", "http://org/fr", "http://a.b.c.org/fr/x", "x://y://z.net/", "http://u@h.net:80/", "http:///net/"]
    pages = spark.createDataFrame([(i // 2, u, "h", "v", "p") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, verdict string, path string")
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS r(host, path, verdict)")
    want = Counter()
    listed = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for i, u in enumerate(urls * 2):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        want[(i // 2, host, path, rule, verdict)] += 1
    assert Counter(tuple(r) for r in url_filter.url_filter(pages, rules).collect()) == want
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_hosts_of_many_labels(spark):
    import time
    host = "a." * 40_000 + "net"
    pages = spark.createDataFrame([(1, f"http://{host}/x"), (2, f"http://{host}"), (3, f"http://{host}x/x")], "page_id long, url string")
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS r(host, path, verdict)")
    t0 = time.perf_counter()
    assert {r.page_id: r.rule for r in url_filter.url_filter(pages, rules).collect()} == {1: "net/", 2: None, 3: None}
    assert time.perf_counter() - t0 < 30


def test_copies_in_other_case_share_no_bin(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["Abc", "aBC", "ABC", "abd"])], "doc_id long, text string, source string")
    where = {r.doc_id: (r.shard, r.bin) for r in packing.pack(docs, capacity=100).collect()}
    assert len({where[i] for i in range(3)}) == 3


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(4)
    items = sorted(((rng.randrange(1, 100), rng.choice("aaabc"), rng.randrange(30)) for _ in range(300)), reverse=True)
    got = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 100)
    bins = defaultdict(list)
    for (size, src, clu), (b, off) in zip(items, got):
        ok = [(100 - sum(x[0] for x in v), k) for k, v in bins.items()
              if 100 - sum(x[0] for x in v) >= size and all(x[1] != src and x[2] != clu for x in v)]
        assert b == (min(ok)[1] if ok else len(bins)) and off == sum(x[0] for x in bins[b])
        bins[b].append((size, src, clu))


def test_packing_keeps_every_byte_and_conflict(spark):
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, (t, s) in enumerate(
        [(None, "a"), ("", "a"), ("x" * 250, "a"), ("y" * 100, None), ("z" * 30, "a"), ("z" * 30, "b"), ("q" * 70, "c"), ("é" * 20, None)] * 9)],
        "doc_id long, text string, source string, bin long, piece long")
    rows = packing.pack(docs, capacity=100, shard_pieces=10).collect()
    size = Counter()
    bins = defaultdict(list)
    info = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    for r in rows:
        size[r.doc_id] += r.n_bytes
        if r.shard >= 0:
            bins[(r.shard, r.bin)].append(r)
    assert all(size[i] == len((t or "").encode()) for i, (t, _) in info.items())
    for v in bins.values():
        src = [info[r.doc_id][1] for r in v if info[r.doc_id][1] is not None]
        assert len(src) == len(set(src)) and sum(r.n_bytes for r in v) <= 100 and len({info[r.doc_id][0] for r in v}) == len(v)
    assert packing.pack(docs.limit(0)).count() == 0


def test_top_k_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vecs = [[float(x) for x in rng.normal(size=6)] for _ in range(300)]
    vecs[5], vecs[7], vecs[9], vecs[11], vecs[20], vecs[40] = None, [0.1, None], [float("nan")] * 6, [float("inf")] * 6, [], [0.5, 0.5]
    rows = [(i, v, 1, 2) for i, v in enumerate(vecs)] + [(None, [1.0] * 6, 0, 0)] + [(300 + i, vecs[1], 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int")
    good = {i: [math.floor(64 * x) for x in v] for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], good[x])), x) for x in good if x != q)[:20]
            want |= {(q, k + 1): (x, -v) for k, (v, x) in enumerate(s)}
    for n in (1, 4):
        got = knn.top_k(df, F.col("kn_id") % 20 == 0, n_pivots=n).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    few = knn.top_k(df.filter("vec_id < 3"), F.col("kn_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert knn.top_k(df.limit(0), F.lit(True)).collect() == []


@pytest.fixture(scope="module")
def model():
    return segmentation.load_pieces()


def test_segmentations_round_trip(spark, model):
    texts = [*ODD, "a ▁ b", "tab\tand  two blanks", " lead", "日本語 ☃ \U0001f600", "x" * 300]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, sample int")
    enc = segmentation.sample_encode(df, model, k=3, verify=True)
    rows = enc.collect()
    assert all(r.round_trip for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        v = sorted(by[i], key=lambda r: r["sample"])
        assert len({tuple(r.ids) for r in v}) == len(v) and [r["sample"] for r in v] == list(range(1, len(v) + 1))
        assert [r.perturbed for r in v] == sorted((r.perturbed for r in v), reverse=True)
    assert len(by[1]) == 1 and len(by[8]) == 3
    dec = segmentation.decode_rows(enc.select("doc_id", "ids"), model).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in dec)
    again = segmentation.sample_encode(df.repartition(5), model, k=3).collect()
    assert {(r.doc_id, r["sample"], tuple(r.ids)) for r in rows} == {(r.doc_id, r["sample"], tuple(r.ids)) for r in again}


def test_samples_follow_the_lattice(model):
    """First and second draws of 6,000 seeds against the enumerated lattice,
    and unbiased inverse-inclusion weights."""
    def walk(u, i=0):
        if i == len(u):
            yield (), 0.0
        for j in range(i + 1, len(u) + 1):
            v = model["pieces"].get(u[i:j])
            if v:
                yield from (((v[0], *ids), v[1] + w) for ids, w in walk(u, j))
    us = segmentation.units("the cat")
    every = [(a + b, x + y) for (a, x), (b, y) in itertools.product(*map(walk, us))]
    z = np.logaddexp.reduce([w for _, w in every])
    p = {a: math.exp(w - z) for a, w in every}
    t = segmentation.Lattices(model).table("".join(us), np.array([len(u) for u in us]))
    state, n, total = t["first"][np.arange(2)], 6000, 0.0
    first, second = Counter(), Counter()
    for s in range(n):
        seed = int(segmentation.mix64(np.array([s], np.uint64))[0])
        draws = [segmentation.sample_paths(t, state, segmentation.mix64(np.uint64(seed) + np.array([2 + j, 40 + j], np.uint64))) for j in range(2)]
        got = segmentation.top_samples(t, [d[0] for d in draws], [d[1] for d in draws], 0, 2, seed, 2)
        a, b = (tuple(t["id"][g[0]].tolist()) for g in got[:2])
        first[a] += 1
        second[b] += 1
        total += sum(math.exp(g[1] - segmentation.log_inclusion(g[1], got[2][2])) for g in got[:2])
    for a in sorted(p, key=p.get, reverse=True)[:3]:
        assert first[a] / n == pytest.approx(p[a], abs=0.025)
        assert second[a] / n == pytest.approx(sum(p[x] * p[a] / (1 - p[x]) for x in p if x != a), abs=0.025)
    assert total / n == pytest.approx(1.0, abs=0.03)


def test_slices_cover_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (1, 50, 3, 3, 200, 0)] + [None])], names=["text"])
    got = [x.as_py() for s in slices(iter([b]), "text", 40) for x in s.column(0)]
    assert got == b.column(0).to_pylist()


def test_op7_draws_every_branch_once(monkeypatch):
    """No step of an opened path takes a second Gumbel while its stop moves on."""
    import pyarrow as pa
    lat = segmentation.Lattices(segmentation.load_pieces())
    _, _, words, size, uid, bound = segmentation.coded_units(pa.array(["another thing reads whole " * 30]))
    t = lat.table(words, size)
    drawn = [segmentation.sample_paths(t, t["first"][uid], np.arange(len(uid), dtype=np.uint64) + np.uint64(j)) for j in (1, 1000)]
    seen = []
    truncated = segmentation._truncated
    monkeypatch.setattr(segmentation, "_truncated", lambda m, b, u: seen.append(len(u)) or truncated(m, b, u))
    got = segmentation.top_samples(t, [e for e, _ in drawn], [o for _, o in drawn], int(bound[0]), int(bound[1]), 5, 2)
    assert len(got) == 3 and 64 < len(got[0][0])
    assert sum(seen) <= sum(len(path) for path, _, _ in got[:-1])
