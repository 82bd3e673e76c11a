"""End-to-end jobs and the streaming wiring on small written inputs."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from kiln.config import PrepareConfig, SplitConfig, TrainConfig
from kiln.operators import scoring, text_features
from kiln.plans import benchmark, inference, prepare, training
from kiln.sources.fixtures import view
from kiln.streaming import prepare_stream

from .conftest import SF01


def _records(n=400):
    out = []
    for i in range(n):
        out.append({"item_id": f"p{i}", "category": ["Books", "Software", "Toys"][i % 3],
                    "main_category": "x", "title": f"Title number {i}\twith tab",
                    "average_rating": 1.0 + (i % 9) / 2, "rating_number": i,
                    "features": ["feature a|b", None, ""], "description": [" long description text here "],
                    "images": {"hi_res": [f"h{i}.png"], "large": None}, "videos": {"url": None},
                    "details": json.dumps({"Brand": f"B;{i}", "n": i})})
    return out


def test_prepare_profile_train(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    with open(os.path.join(src, "part.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in _records()))
    recs = spark.read.schema(prepare_stream.STREAM_SCHEMA).json(src)
    cfg = PrepareConfig(frac=0.5, min_samples=10, seed=42)
    cleaned = prepare.prepare_catalogue(spark, recs, os.path.join(tmpdir_path, "stages"), cfg,
                                        csv_path=os.path.join(tmpdir_path, "cleaned_csv"))
    assert cleaned.count() == 199       # 400 records, every 3rd category sampled to half
    sizes = {r.category: r.n for r in cleaned.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"Books": 67, "Software": 66, "Toys": 66}
    prof = prepare.profile_catalogue(cleaned)
    assert {r.main_category for r in prof["categories"].collect()} == {"Books", "Software", "Toys"}
    assert prof["columns"].count() == len(cleaned.columns)
    table = training.training_table(cleaned, None, SplitConfig(rare_threshold=10), TrainConfig())
    assert {r.split for r in table.select("split").distinct().collect()} == {"train", "val", "test"}
    vocab = text_features.build_vocabulary(table, "question", 2)
    b = training.epoch_batches(table, vocab, epoch=1)
    n_train = table.filter("split = 'train'").count()
    assert sum(len(r.item_ids) for r in b.collect()) == n_train


def test_streaming_prepare(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    recs = _records(60)
    for j in range(3):
        with open(os.path.join(src, f"f{j}.json"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in recs[j * 20:(j + 1) * 20]))
    stream = prepare_stream.prepared_stream(prepare_stream.product_stream(spark, src, max_files_per_trigger=1))
    out = os.path.join(tmpdir_path, "out")
    q = prepare_stream.start(stream, out, name=f"t{os.getpid()}-{id(out)}")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 60 and got.filter(F.col("text").contains("Title: Title number")).count() == 60
    counts_path = os.path.join(tmpdir_path, "counts")
    c = prepare_stream.start_counts(prepare_stream.category_counts(stream), counts_path, name=f"c{id(out)}")
    c.awaitTermination(120)
    got = {r.category: r["count"] for r in spark.read.parquet(counts_path).collect()}
    assert got == {"Books": 20, "Software": 20, "Toys": 20}


def test_inference_and_runtime(spark, tmpdir_path):
    from .test_features import _png
    d = os.path.join(tmpdir_path, "setB")
    os.makedirs(d)
    _png(os.path.join(d, "a.png"), 12, 12, 3, [1, 2, 3])
    _png(os.path.join(d, "small.png"), 4, 4, 3, [1, 2, 3])
    csv_path = os.path.join(tmpdir_path, "input.csv")
    with open(csv_path, "w") as f:
        f.write("parent_asin,main_category,title,features,description,image_paths\n")
        f.write('A1,Books,T1,f,d,a.png\nA2,NA,T2,,,"small.png; a.png"\nA3,Toys,T3,f,d,\n')
    vec = spark.createDataFrame([(f"A{i}", [0.1 * i] * 4, [0.2] * 4) for i in (1, 2, 3)],
                                "item_id string, image_vec array<float>, text_vec array<float>")
    head = scoring.init_head(8, 8, 1, seed=1)
    sub, summ = inference.generate_submission(spark, csv_path, d, vec, head, 1.8e9,
                                              out_csv=os.path.join(tmpdir_path, "sub"))
    rows = {r.item_id: r for r in sub.collect()}
    assert set(rows) == {"A1", "A2", "A3"} and rows["A1"].flops == "1.8"
    assert summ.first().n == 3
    flags = {r.item_id: r.has_images for r in inference.inference_rows(spark, csv_path, d).collect()}
    assert flags == {"A1": True, "A2": False, "A3": False}    # first path too small: not replaced
    rep = benchmark.report_runtime(view(spark, "timings", SF01), os.path.join(tmpdir_path, "rt"))
    assert rep.count() == 150
