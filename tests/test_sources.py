"""CSV round trips, stage cache, JSON report and history append."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.sources import csv as csv_src
from kiln.sources import metadata, reports, stage

SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("title", T.StringType()),
                       T.StructField("features", T.StringType()), T.StructField("average_rating", T.DoubleType())])
ROWS = [(1, 'say "hi", ok', "a\nb", 4.5), (2, "", "NA", None), (3, "NaN", "x | y", 3.0), (4, None, "null", 1.0)]


def test_csv_keep_empty_and_default_na(spark, tmpdir_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = os.path.join(tmpdir_path, "c")
    csv_src.write_csv(df, path)
    keep = {r.item_id: r for r in csv_src.read_csv_keep_empty(spark, path, SCHEMA).collect()}
    assert keep[1].title == 'say "hi", ok' and keep[1].features == "a\nb"
    assert keep[2].title == "" and keep[2].features == "NA" and keep[2].average_rating is None
    assert keep[4].title == ""          # null written as empty, read back as ""
    na = {r.item_id: r for r in csv_src.read_csv_default_na(spark, path, SCHEMA).collect()}
    assert na[2].title is None and na[2].features is None
    assert na[3].title is None and na[3].features == "x | y"
    assert na[4].features is None and na[1].average_rating == 4.5


def test_stage_cache_keyed_by_params(spark, tmpdir_path):
    calls = []

    def build(v):
        def f():
            calls.append(v)
            return spark.range(3).withColumn("v", F.lit(v))
        return f
    a = stage.cached_stage(spark, tmpdir_path, "s", {"p": 1}, build(1))
    b = stage.cached_stage(spark, tmpdir_path, "s", {"p": 1}, build(99))
    c = stage.cached_stage(spark, tmpdir_path, "s", {"p": 2}, build(2))
    assert calls == [1, 2]
    assert {r.v for r in b.collect()} == {1} and {r.v for r in c.collect()} == {2} and a.count() == 3


def test_stage_survives_a_broken_build(spark, tmpdir_path):
    def broken():
        raise RuntimeError("driver lost")

    def half():
        return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    for build in (broken, half):
        with pytest.raises(Exception, match="lost"):
            stage.cached_stage(spark, tmpdir_path, "s", {}, build)
    ok = stage.cached_stage(spark, tmpdir_path, "s", {}, lambda: spark.range(5))
    assert ok.count() == 5
    # An attempt that was written whole but never committed is not read either.
    folder = os.path.join(tmpdir_path, stage.stage_key("t", {}, stage.input_fingerprint([])))
    spark.range(9).write.parquet(os.path.join(folder, "attempt-lost"))
    assert stage.cached_stage(spark, tmpdir_path, "t", {}, lambda: spark.range(2)).count() == 2
    # A second commit cannot leave the manifest pointing at a missing table.
    spark.range(7).write.parquet(os.path.join(folder, "attempt-late"))
    stage._commit(spark, folder, "attempt-late")
    assert stage.cached_stage(spark, tmpdir_path, "t", {}, broken).count() in (2, 7)


def test_stage_misses_when_the_input_changes(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "in put+1")
    calls = []

    def get():
        src = spark.read.schema("id long").parquet(path)
        return stage.cached_stage(spark, tmpdir_path, "s", {}, lambda: calls.append(1) or src, [src])
    spark.range(3).write.parquet(path)
    assert get().count() == 3 and get().count() == 3 and len(calls) == 1
    spark.range(4).write.mode("append").parquet(path)
    assert get().count() == 7 and len(calls) == 2


def test_json_report_and_history(spark, tmpdir_path):
    rep = spark.createDataFrame([(1, 0.5, None)], "run_id long, latency double, peak double")
    p = os.path.join(tmpdir_path, "rep")
    reports.write_json_report(rep, p)
    assert spark.read.schema(rep.schema).json(p).first().latency == 0.5
    h = os.path.join(tmpdir_path, "hist")
    rows = spark.createDataFrame([(1, 1, 0.3, 0.1)], "run_id long, epoch int, train_loss double, val_plcc double")
    reports.append_history(rows, h)
    reports.append_history(rows.withColumn("epoch", F.lit(2)), h)
    back = spark.read.parquet(h)
    assert back.count() == 2 and len(back.columns) == 13 and back.filter("lr is null").count() == 2


def test_partitioned_source(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "meta")
    for cat in ("Books", "Software", "Other"):
        d = os.path.join(root, f"category={cat}")
        os.makedirs(d)
        with open(os.path.join(d, "part.json"), "w") as f:
            f.write('{"title": "t", "features": ["a"], "images": {"hi_res": ["u"], "large": null}, '
                    '"rating_number": 3, "extra": 1}\n')
    df = metadata.read_partitioned(spark, root, categories=("Software", "Books"))
    rows = sorted((r.category, r.category_order) for r in df.collect())
    assert rows == [("Books", 2), ("Software", 1)]   # list order, not name order
    assert "extra" not in df.columns and "images" in df.columns
    u = metadata.union_sources({"A": spark.createDataFrame([("x",)], "title string"),
                                "B": spark.createDataFrame([("y", 2.0)], "title string, average_rating double")})
    assert sorted((r.category, r.category_order) for r in u.collect()) == [("A", 1), ("B", 2)]


def _csv_dir(root, files):
    import csv
    os.makedirs(root)
    for name, rows in files.items():
        with open(os.path.join(root, name), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["item_id", "other", "title"])
            w.writerows(rows)
    return root


TITLED = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("title", T.StringType())])


@pytest.fixture()
def split_size(spark):
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_csv_is_the_same_in_any_number_of_splits(spark, tmpdir_path, split_size):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice('ab ,\n"\ré;') for _ in range(rng.randrange(40)))
    rows = [[i, text(), text()] for i in range(1500)]
    rows[300][2] = 'line "q"\n' * 800                # one record longer than many splits
    rows[301][1] = ""
    rows[302][2] = "\n\n\n"
    root = _csv_dir(os.path.join(tmpdir_path, "q"), {"a.csv": rows[:900], "b.csv": rows[900:], "empty.csv": []})
    size = sum(os.path.getsize(os.path.join(root, f)) for f in os.listdir(root))
    want = [(i, c) for i, _, c in rows]
    seen = set()
    for n in (1, 16, 200):
        split_size(size // n + 1)
        df = csv_src.read_csv_keep_empty(spark, root, TITLED)
        seen.add(spark.read.text(root).rdd.getNumPartitions())
        assert sorted(tuple(r) for r in df.collect()) == want
    assert len(seen) == 3 and max(seen) > 100


def test_csv_plan_reads_splits_and_shuffles_only_parts(spark, tmpdir_path):
    root = _csv_dir(os.path.join(tmpdir_path, "p"), {"a.csv": [[1, "x", "y"]]})
    plan = csv_src.read_csv_keep_empty(spark, root, TITLED)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan csv" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_csv_blank_lines_crlf_and_malformed_records(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "m")
    os.makedirs(root)
    with open(os.path.join(root, "f.csv"), "wb") as f:
        f.write(b'title,item_id\r\n"a\r\nb",1\r\n\r\nc\r\n"d ""e""",2\r\nf,3,4\r\n,5')
    rows = sorted(((r.item_id, r.title) for r in csv_src.read_csv_keep_empty(spark, root, TITLED).collect()), key=repr)
    assert rows == [(1, "a\r\nb"), (2, 'd "e"'), (3, "f"), (5, ""), (None, "c")]
    assert sorted(r.text for r in csv_src.malformed_records(spark, root, TITLED).collect()) == ["c", "f,3,4"]
    with pytest.raises(ValueError, match="no column other"):
        csv_src.read_csv_keep_empty(spark, root, T.StructType([T.StructField("other", T.StringType())]))


def test_csv_lines_reach_python_in_batches_bounded_by_bytes(spark, tmpdir_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    root = _csv_dir(os.path.join(tmpdir_path, "b"), {"a.csv": [[i, "x", "y" * 4000] for i in range(4000)]})

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"file": ["f"], "block": pa.array([0], pa.int64()), "owner": pa.array([None], pa.int64()),
                                              "text": [str(b.nbytes)]})

    try:
        spark.conf.unset(key)
        with monkeypatch.context() as m:
            m.setattr(csv_src, "_record_rows", sizes)
            got = [int(r.text) for r in csv_src.csv_records(spark, root).collect()]
        assert sum(got) > 16_000_000 and max(got) < 5_000_000
        assert sorted((r.item_id, len(r.title)) for r in csv_src.read_csv_keep_empty(spark, root, TITLED).collect()) == [(i, 4000) for i in range(4000)]
        spark.conf.set(key, "1000000")
        csv_src.csv_records(spark, root)
        assert spark.conf.get(key) == "1000000"              # a limit of the session's own stays
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
