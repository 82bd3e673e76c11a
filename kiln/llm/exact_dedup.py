"""Exact deduplication by a tree merge of digest runs (DataFrame functions only).

Every document gets the SHA-256 of its normalised text (A-Z lower-cased; null
counts as empty) plus its byte length and a second, independent hash. Rows are
dealt into ``runs`` digest runs. Each round merges ``fan_in`` neighbouring runs
(a multiway merge: one keyed shuffle, combined map-side first), keeps one
identifier per digest and adds the counts, until one run is left. A merge joins
entries only if digest, length and second hash all agree, so an identifier that
is kept has been verified at every level. A digest held by a third of all rows
contributes at most one entry per task and run to each round.

Defined results: the identifier kept is the smallest (``keep="smallest"``) or
largest (``keep="largest"``) non-null one of the equal texts; null identifiers
lose to any other, and rows sharing the kept identifier are all kept; a class
of only null identifiers keeps its rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import ascii_lower, bloom_split, quoted, staged, unused


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return (docs.select(F.col(id_col).alias("dedup_id"), norm.alias("norm"))
            .select("dedup_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
                    F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("verify")))


KEY = ["digest", "n_bytes", "verify"]


def merge_runs(digest_rows: DataFrame, keep: str = "largest", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """(digest, n_bytes, verify, keep_id, group_size), one row per distinct text."""
    pick = F.max if keep == "largest" else F.min
    cur = digest_rows.select(F.pmod(F.xxhash64("dedup_id"), F.lit(runs)).alias("run"), *KEY,
                             F.col("dedup_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    n = runs
    while n > 1:
        n = -(-n // fan_in)
        cur = (cur.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *KEY)
               .agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    return cur.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(docs, id_col, text_col), "digests")      # texts are read once
    classes = merge_runs(rows, keep).filter("group_size > 1")      # single texts keep themselves
    classes = staged(classes, "digest-classes")                    # plain scans on both join sides: hot digests can be split
    c = classes.select(*[F.col(k).alias(f"c_{k}") for k in KEY], "keep_id", "group_size")
    on = [F.col(k) == F.col(f"c_{k}") for k in KEY]
    out = rows.join(c, on, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("dedup_id")).otherwise(F.col("keep_id"))
    return out.select(F.col("dedup_id").alias(id_col), keep_id.alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                      F.col("dedup_id").eqNullSafe(keep_id).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The documents without the copies ``exact_dedup`` drops; all columns
    stay. Texts whose digest cannot be a repeated one (Bloom filter of bounded
    size) pass without a shuffle. Rows repeated under the kept id leave one."""
    rows = staged(digests(docs, id_col, text_col), "digests")
    classes = staged(merge_runs(rows, keep).filter("group_size > 1"), "digest-classes")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digest, verify, keep_key, known = unused(docs, "dd_digest", "dd_verify", "dd_keep", "dd_class")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(norm.cast("binary"), 256))).withColumn(verify, F.xxhash64(norm))
    maybe, never = bloom_split(keyed, digest, classes.select(F.col("digest").alias(digest)))
    c = classes.select(F.col("digest").alias(digest), F.col("verify").alias(verify), F.col("keep_id").alias(keep_key),
                       F.lit(True).alias(known))
    held = maybe.join(c, [digest, verify], "left")
    single = held.filter(F.col(known).isNull())
    kept = held.filter(F.col(known) & F.col(id_col).eqNullSafe(F.col(keep_key))).dropDuplicates([digest, verify])
    cols = quoted(docs.columns)
    return never.select(*cols).unionByName(single.select(*cols)).unionByName(kept.select(*cols))
