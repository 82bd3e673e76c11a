"""Tokens, batches, weights, image references, image files and rasters."""

import os
import re
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from kiln.config import END_ID, PAD_ID, START_ID, UNK_ID
from kiln.operators import images, text_features, weights
from kiln.sources.images import join_images, read_image_dir

from .conftest import SF001


def docs(spark):
    rows = [(1, "The cat sat. The cat ran!"), (2, "A dog, the dog."), (3, ""), (4, "zebra " * 300)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_vocabulary_and_encode(spark):
    d = docs(spark)
    v = text_features.build_vocabulary(d, "text", min_count=2)
    vocab = {r.token: r.token_id for r in v.collect()}
    assert vocab["zebra"] == 4                      # most frequent first
    assert min(vocab.values()) == 4 and "sat" not in vocab
    enc = {r.item_id: r.input_ids for r in text_features.encode(d, v, max_length=8).collect()}
    assert enc[3] == [START_ID, END_ID]
    assert len(enc[4]) == 8 and enc[4][0] == START_ID and enc[4][-1] == END_ID
    assert enc[1][0] == START_ID and UNK_ID in enc[1]  # "sat"/"ran" unknown
    the = vocab["the"]
    assert enc[1][1] == the


def test_uncapped_vocabulary_and_lookup_in_blocks(spark):
    d = docs(spark).unionByName(docs(spark).limit(1)).unionByName(spark.createDataFrame([(9, None), (9, "a b c")], "item_id long, text string"))
    v = text_features.build_vocabulary(d, "text")
    words = {}
    for (t,) in d.select("text").collect():
        for w in re.findall(r"[a-z]+|[.,!]", (t or "").lower()):
            words[w] = words.get(w, 0) + 1
    order = sorted(words, key=lambda w: (-words[w], w))
    assert {r.token: (r.cnt, r.token_id) for r in v.collect()} == {w: (words[w], 4 + i) for i, w in enumerate(order)}
    assert sorted(r.token_id for r in text_features.build_vocabulary(d, "text", cap=7).collect()) == [4, 5, 6]
    want = sorted((i, [START_ID, *[4 + order.index(w) for w in re.findall(r"[a-z]+|[.,!]", (t or "").lower())][:254], END_ID])
                  for i, t in d.collect())
    for block in (1_000_000, 3):
        got = text_features.with_token_ids(d, v, "text", 256, "input_ids", block=block)
        assert got.columns == ["item_id", "text", "input_ids"]
        assert sorted((r.item_id, r.input_ids) for r in got.collect()) == want            # rows of equal id stay apart
    few = text_features.with_token_ids(d, v.filter("cnt > 100000"), "text", 8)
    assert {x for r in few.collect() for x in r.input_ids} <= {START_ID, UNK_ID, END_ID}


def test_no_exchange_above_the_token_arrays(spark):
    d = docs(spark)
    v = text_features.build_vocabulary(d, "text")
    plan = text_features.with_token_ids(d, v)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_a_large_vocabulary_stages_the_rows_once_and_no_text(spark, monkeypatch):
    rows = [(i % 4, " ".join(f"w{chr(97 + (i * j) % 23)} only{chr(97 + i)} all" for j in range(i))) for i in range(12)] + [(0, None), (0, "new")]
    d = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    v = text_features.build_vocabulary(d.filter("text <> 'new'"), "text")
    staged = []
    kept = text_features.stage_parquet
    monkeypatch.setattr(text_features, "stage_parquet", lambda df, name: staged.append(df.columns + df.schema["row"].dataType.names) or kept(df, name))
    want = sorted(map(tuple, text_features.encode(d, v).collect()))
    assert not staged
    for block in (1, 2, 5):
        staged.clear()
        got = text_features.with_token_ids(d, v, block=block, keep=["item_id"])
        assert sorted(map(tuple, got.collect())) == want
        assert staged == [["row", "ids", "rare", "rid", "item_id"]]      # one stage for any number of blocks


def test_batches_and_counts(spark):
    d = spark.range(70).select(F.col("id").alias("item_id"),
                               F.array_repeat(F.lit(7), (F.col("id") % 5 + 1).cast("int")).alias("input_ids"))
    idx = text_features.batch_index(d, ["item_id"], 32)
    b = text_features.assemble_batches(idx, "item_id", "input_ids", extra=()).orderBy("batch_id").collect()
    assert [len(r.item_ids) for r in b] == [32, 32, 6]
    assert b[0].item_ids == list(range(32))
    for r in b:
        L = max(len(x) for x in r.input_ids)
        assert all(len(x) == L for x in r.input_ids)
        assert all(len(m) == L for m in r.attention_mask)
        for ids, m in zip(r.input_ids, r.attention_mask):
            assert sum(m) == sum(1 for t in ids if t != PAD_ID)
    c = text_features.token_counts(text_features.assemble_batches(idx, extra=())).orderBy("batch_id").collect()
    assert c[2].samples == 6 and c[2].tokens == sum((i % 5 + 1) for i in range(64, 70))


def test_weights_bounds(spark):
    df = spark.createDataFrame([(i, float(i * 100), "train" if i % 2 else "val") for i in range(20)] + [(99, None, "train")],
                               "item_id long, rating_number double, split string")
    m = weights.mean_log_count(df)
    w = weights.add_weights(df, m).collect()
    assert all(0.0 <= r.weight <= 5.0 for r in w)
    zero = spark.createDataFrame([(1, 0.0, "train")], "item_id long, rating_number double, split string")
    assert weights.add_weights(zero, weights.mean_log_count(zero)).first().weight == 1.0
    d = weights.label_defaults(spark.createDataFrame([(1, None)], "item_id long, rating_number double"))
    r = d.first()
    assert r.label == 0.0 and r.rating_number == 0.0


def test_candidates(spark):
    df = spark.createDataFrame([("h1 | h2", "l1", " a.png ; ;b.png;c.png"), (None, "", None), ("", "l1 | l2", "  ")],
                               "images_hi_res string, images_large string, image_paths string")
    r = df.select(images.candidate_urls(k=3).alias("c"), images.candidate_paths(k=2).alias("p")).collect()
    assert r[0].c == ["h1", "h2", "l1"] and r[0].p == ["a.png", "b.png"]
    assert r[1].c == [] and r[1].p == []
    assert r[2].c == ["l1", "l2"] and r[2].p == []


def _png(path, w, h, channels, fill):
    color = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\x00" + bytes(fill * w) for _ in range(h))

    def chunk(tag, data):
        c = struct.pack(">I", len(data)) + tag + data
        return c + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + \
        chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(png)


def test_image_dir_and_rasters(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "imgs")
    os.makedirs(os.path.join(root, "sub"))
    _png(os.path.join(root, "rgb.png"), 12, 11, 3, [10, 20, 30])
    _png(os.path.join(root, "tall.png"), 9, 20, 3, [1, 2, 3])
    _png(os.path.join(root, "sub", "grey.png"), 16, 16, 1, [128])
    _png(os.path.join(root, "rgba.png"), 16, 16, 4, [200, 100, 50, 255])
    with open(os.path.join(root, "broken.png"), "wb") as f:
        f.write(b"not an image")
    imgs = read_image_dir(spark, root)
    paths = {r.path: (r.width, r.height, r.image is not None) for r in imgs.collect()}
    assert paths["rgb.png"] == (12, 11, True)
    assert paths["sub/grey.png"] == (16, 16, True)
    assert paths["broken.png"][2] is False
    rows = spark.createDataFrame([(1, "rgb.png"), (2, "tall.png"), (3, "sub/grey.png"), (4, "rgba.png"),
                                  (5, "broken.png"), (6, "missing.png")], "item_id long, image_path string")
    joined = join_images(rows, imgs)
    t = {r.item_id: np.array(r.pixel_values) for r in images.image_tensors(joined, size=8).collect()}
    mean, std = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    black = ((0 - mean) / std)
    for k in (2, 5, 6):        # too narrow, undecodable, missing -> black raster
        assert np.allclose(t[k].reshape(3, 8, 8)[:, 0, 0], black, atol=1e-5)
    assert np.allclose(t[1].reshape(3, 8, 8)[:, 3, 3], (np.array([10, 20, 30]) / 255 - mean) / std, atol=1e-5)
    assert np.allclose(t[3].reshape(3, 8, 8)[:, 0, 0], (128 / 255 - mean) / std, atol=1e-5)
    assert np.allclose(t[4].reshape(3, 8, 8)[:, 0, 0], (np.array([200, 100, 50]) / 255 - mean) / std, atol=1e-5)


def test_attach_images(spark):
    rows = spark.createDataFrame([(1, "a | b", "c"), (2, None, "d"), (3, None, None)],
                                 "item_id long, images_hi_res string, images_large string")
    table = spark.createDataFrame([("a", 5, 50), ("b", 50, 50), ("d", 10, 10)], "origin string, width int, height int")
    for fast in (None, 1):
        k1 = images.attach_images(rows.withColumn("candidates", images.candidate_urls(k=1)), table, k=fast)
        got = {r.item_id: (r.images, r.has_images) for r in k1.collect()}
        assert got == {1: ([], False), 2: (["d"], True), 3: ([], False)}   # broken first URL not replaced
    dup = table.unionByName(table)
    k1 = images.attach_images(rows.withColumn("candidates", images.candidate_urls(k=1)), dup, k=1)
    assert k1.count() == 3
    k2 = images.attach_images(rows.withColumn("candidates", images.candidate_urls(k=2)), table)
    assert {r.item_id: r.images for r in k2.collect()}[1] == ["b"]


def grey(rows):
    """A stack of one grey image as RGB."""
    return np.repeat(np.array(rows, np.uint8)[None, :, :, None], 3, axis=3)


def test_resize_goldens():
    # Enlarging 2 -> 4: outputs lie 1/4 and 3/4 of a source step in, edges repeat.
    assert images.resize(grey([[0, 100]] * 2), 4)[0, 0].tolist() == [[0, 25, 75, 100]] * 4
    assert images.resize(grey([[0, 0], [100, 100]]), 4)[0, 2].tolist() == [[0] * 4, [25] * 4, [75] * 4, [100] * 4]
    # Shrinking 4 -> 2: the triangle is two source steps wide: (3 2 1) / 7 shaped weights
    # 0.75 0.75 0.25 of 1.75 around centre 1, and mirrored around centre 3.
    assert images.resize(grey([[0, 0, 100, 200]] * 4), 2)[0, 0].tolist() == [[14, 129]] * 2
    # Rounded to 8 bits between the passes: 129 / 1.75 = 73.7, where 128.57 / 1.75 = 73.5 -> 73 without.
    assert images.resize(grey([[0, 0, 100, 200], [0] * 4, [0, 0, 100, 200], [0] * 4]), 2)[0, 1].tolist() == [[8, 74], [6, 55]]
    # Shrinking one side and enlarging the other.
    assert images.resize(grey([[10, 30]] * 8), 4)[0, 0].tolist() == [[10, 15, 25, 30]] * 4
    # Same size: unchanged.
    x = np.arange(48, dtype=np.uint8).reshape(1, 4, 4, 3)
    assert (images.resize(x, 4) == x.transpose(0, 3, 1, 2)).all()


def test_resize_properties(monkeypatch):
    rng = np.random.default_rng(0)
    for h, w, s in ((300, 17, 24), (25, 500, 30), (31, 33, 32)):
        x = rng.integers(0, 256, (3, h, w, 3), dtype=np.uint8)
        whole = images.resize(x, s)
        assert whole.shape == (3, 3, s, s)
        assert (whole[1] == images.resize(x[1:2], s)[0]).all()                    # a stack equals its images
        assert (images.resize(x[:, ::-1, ::-1], s) == whole[:, :, ::-1, ::-1]).all()   # symmetric
        assert (images.resize(np.full((1, h, w, 3), 77, np.uint8), s) == 77).all()
        monkeypatch.setattr(images, "RESIZE_PIXELS", 100)
        assert (images.resize(x, s) == whole).all()                               # strips of rows
        monkeypatch.undo()
        # Shrinking averages: no output leaves the mean by much on noise, unlike point sampling.
        if h > 5 * s and w <= s:
            assert whole.std() < x.std()


def test_raster_query_layouts(spark):
    """The query's input has every layout: grey, BGR, BGRA, too small,
    missing, larger than the target."""
    from kiln.plans import catalog as C
    imgs = [r.image for r in C._vector_images(spark, SF001).collect()]
    assert {(i.nChannels if i else None) for i in imgs} == {None, 1, 3, 4}
    assert any(i and i.width > 224 and i.height > 224 for i in imgs)
    assert any(i and i.width < 224 < i.height for i in imgs) and any(i and i.width < 10 for i in imgs)
    assert all(len(i.data) == i.width * i.height * i.nChannels for i in imgs if i)
