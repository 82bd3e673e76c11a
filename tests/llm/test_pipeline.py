"""The registered queries against DuckDB, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kiln.llm.helpers import read, staged
from kiln.llm.queries import ORACLE, QUERIES

from ..conftest import SF001
from .test_dedup import brute_components, brute_spans


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))
    assert sorted(df.columns) == sorted(cols)


def test_stages_against_brute_force(spark):
    docs = read(spark, SF001, "documents")
    kept = docs
    by = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup", "repeated_passages"):
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = by[name](spark, kept, SF001)
        assert kept.columns == docs.columns
        after = {r.doc_id: r for r in kept.collect()}
        if name == "language_id":
            assert len(before) - len(after) <= 0.02 * len(before)
        elif name == "exact_dedup":
            low = {}
            for i, t in before:
                k = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                low[k] = max(low.get(k, i), i)
            assert sorted(after) == sorted(low.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, c in brute_components(before, 5, 80)[1].items() if i == c}
        else:
            want = brute_spans(before, corpus_pipeline.PASSAGE_BYTES)
            for k, (i, t) in enumerate(before):
                new = want[k][3].decode("utf-8", "ignore")
                assert (after[i].text == new and after[i].n_chars == len(new)) if new else i not in after
        kept = spark.createDataFrame(list(after.values()), docs.schema)
    packed = by["packing"](spark, kept, SF001).groupBy("doc_id").sum("n_bytes").collect()
    assert {r.doc_id: r[1] for r in packed} == {i: len(r.text.encode()) for i, r in after.items()}


CLASHES = ["Score", "accepted", "lang_pred", "bloom_b", "bloom_m", "dd_digest", "dd_class", "sd_starts", "sd_text_key",
           "nd_id", "th", "keep_id", "component", "a.b", "n_bytes", "pk_id", "shard"]


def test_stages_keep_clashing_columns(spark):
    docs = read(spark, SF001, "documents")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = staged(stage(spark, wide, SF001), "test"), staged(stage(spark, plain, SF001), "test")
        assert wide.columns == docs.columns + CLASHES
        rows = wide.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES)
    packed = [sorted(map(tuple, corpus_pipeline.pack_sequences(spark, d, SF001).collect())) for d in (wide, plain)]
    assert packed[0] == packed[1]


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 0
    docs = read(spark, SF001, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
        assert docs.count() == 0
