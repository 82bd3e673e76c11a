"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import alignment, decontaminate, knn, packing, vector_codes
from kiln.llm import exact_dedup as dedup
from kiln.llm import language_id as lang
from kiln.llm import near_dedup as near
from kiln.llm import quality, segmentation, toxicity
from kiln.llm import suffix_dedup as suffix
from kiln.llm import url_filter as urls
from kiln.llm.helpers import held_out_of, read

# Fixed rules of the URL query: host, path, verdict.
URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"
LANG_HELD_OUT, TOXIC_HELD_OUT, QUALITY_HELD_OUT = (4, 2), (4, 2), (5, 0)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang.fit_dictionaries(docs, ~held_out_of("doc_id", LANG_HELD_OUT))
    return lang.language_id(docs, model).select(
        "doc_id", held_out_of("doc_id", LANG_HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"), F.col("kn_id") % 20 == 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS r(host, path, verdict)")
    return urls.url_filter(read(spark, sf_dir, "pages"), rules)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), TOXIC_HELD_OUT)
    return toxicity.score_toxicity(docs, net, TOXIC_HELD_OUT)


def op7_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sampled segmentations: the ids themselves are hashed."""
    rows = segmentation.sample_encode(read(spark, sf_dir, "documents"), segmentation.load_pieces(), verify=True)
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                       "log_prob", "perturbed", "log_inclusion", "round_trip")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), QUALITY_HELD_OUT)
    return quality.score_quality(docs, model, QUALITY_HELD_OUT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(read(spark, sf_dir, "documents")).withColumn("changed", F.col("n_removed") > 0)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    flat = ",".join(str(x) for b in books for x in b.ravel().tolist())
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error",
                        F.lit(hashlib.sha256(flat.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read(spark, sf_dir, "documents"), alignment.load_tokenizers())


QUERIES = {f.__name__: f for f in (op1_language_id, op2_top_k, op3_url_filter, op4_exact_dedup, op5_packing, op6_toxicity, op7_sampled_segmentation, op8_quality, op9_suffix_dedup, op10_near_dedup,
                                  op11_decontamination, op12_vector_codes, op13_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run

_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Product quantisation round by round, in integers."""
    near = """(SELECT v.row, v.vec_id, v.label, v.p, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x),
                      lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
               FROM v JOIN c{r} c USING (p) QUALIFY row_number() OVER (PARTITION BY v.row, v.p ORDER BY dist, c.k) = 1)"""
    steps = [f"""
        c{r + 1} AS MATERIALIZED (
          WITH g AS (SELECT p, k, d, sum(x[d])::BIGINT AS s, count(*)::BIGINT AS n
                     FROM {near.format(r=r)}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS d) GROUP BY p, k, d),
          m AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY d) AS x FROM g GROUP BY p, k)
          SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m USING (p, k))""" for r in range(rounds)]
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT row_number() OVER () AS row, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        v AS MATERIALIZED (SELECT row, vec_id, label, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS x
                           FROM kept, (SELECT unnest(range({parts})) AS p)),
        c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM v
                            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),{",".join(steps)},
        z AS (SELECT row, vec_id, label, string_agg(printf('%02x', k::INTEGER), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
              FROM {near.format(r=rounds)} GROUP BY row, vec_id, label),
        b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM z, b"""


ORACLE = {
    "op11_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        dw AS MATERIALIZED (SELECT row, doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM d),
        bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
        win AS MATERIALIZED (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
        occ AS MATERIALIZED (
          SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT row, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
        hit AS MATERIALIZED (SELECT row, i, n, item_id FROM occ JOIN win USING (n, g)),
        words AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM hit) GROUP BY row),
        ids AS (SELECT row, count(DISTINCT item_id) AS n_items,
                       array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (row) LEFT JOIN ids USING (row)""",
    "op12_vector_codes": _codes_sql(),
    "op2_top_k": """
        WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
              FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op3_url_filter": rf"""
        WITH r(rh, rp, v) AS ({URL_RULES}),
        p AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        h AS (SELECT page_id, rh || rp AS rule, v,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS k
              FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT p.page_id, host, path, h.rule, coalesce(h.v, 'allow') AS verdict
        FROM p LEFT JOIN h ON p.page_id = h.page_id AND h.k = 1""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
}
