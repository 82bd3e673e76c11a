"""Labelled text, length statistics, token ids, padding and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.config import END_ID, PAD_ID, START_ID, UNK_ID
from kiln.functions.text import product_text
from kiln.operators.indexing import with_row_index
from kiln.operators.joins import stage_parquet
from kiln.operators.partitioning import spread

# Word, number, or single other non-space character, on lower-cased text.
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def add_text(df: DataFrame, with_details: bool = True, out: str = "text") -> DataFrame:
    """T1 (five parts) / T2 (four parts, model samples)."""
    return df.withColumn(out, product_text(with_details))


def text_length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean, min, max length in code points."""
    n = F.length(F.col(text_col))
    return df.agg(F.avg(n).alias("mean_len"), F.min(n).cast("long").alias("min_len"),
                  F.max(n).cast("long").alias("max_len"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


VOCAB_BLOCK = 1_000_000      # vocabulary entries broadcast at once


def build_vocabulary(df: DataFrame, text_col: str = "text", min_count: int = 1, cap: int | None = None) -> DataFrame:
    """T4: corpus vocabulary (token, cnt, token_id): every token seen at least
    ``min_count`` times, numbered from 4 on (ids 0-3 are reserved) by count,
    most frequent first, ties by token. Counting is a partial aggregate (hot
    tokens combine map-side); ids come from a range partition on (count, token)
    with per-partition offsets, so no task sees the whole vocabulary. ``cap``
    keeps the first ``cap`` ids, the reserved ones included."""
    counts = (spread(df.select(text_col)).select(F.explode(tokens(F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= min_count)
              .withColumn("neg_cnt", -F.col("cnt")))
    ids = with_row_index(counts, ["neg_cnt", "token"], "row_idx").select("token", "cnt", (F.col("row_idx") + 4).cast("int").alias("token_id"))
    return ids if cap is None else ids.filter(F.col("token_id") < cap)


def with_token_ids(df: DataFrame, vocab: DataFrame, text_col: str = "text", max_length: int = 256, out: str = "input_ids",
                   block: int = VOCAB_BLOCK, keep: list[str] | None = None) -> DataFrame:
    """T4: ``df`` (its columns ``keep``, all by default) with ``[START] + ids +
    [END]`` of its text, at most ``max_length`` in total; unknown tokens get
    UNK, null texts have none.

    The token array of a row stays an array: a task looks up all tokens of a
    batch at once in an Arrow dictionary of the ``block`` first (most frequent)
    vocabulary entries, which bounds what is broadcast. With a larger
    vocabulary the rows are staged once, as ids; only the tokens that the
    dictionary lacks, rare ones by their ids, are joined with the rest of the
    vocabulary and put in place, whatever its size."""
    spark = df.sparkSession
    low, high = vocab.agg(F.min("token_id"), F.max("token_id")).first()
    stop = (low or 0) + block
    more = high is not None and high >= stop
    keep = df.columns if keep is None else keep
    known = F.slice(tokens(F.col(text_col)), 1, max_length - 2)
    cols = [F.col(f"`{c}`") for c in keep]
    src = df.select(F.struct(*cols).alias("row"), F.coalesce(known, F.array().cast("array<string>")).alias("token"))
    schema = (src.withColumn("ids", F.lit(None).cast("array<int>"))
              .withColumn("rare", F.lit(None).cast("array<struct<pos:int,token:string>>")).drop("token").schema)
    part = vocab.filter(F.col("token_id") < stop).select("token", "token_id").toArrow().sort_by("token").combine_chunks()
    sent = spark.sparkContext.broadcast(tuple(part[c].combine_chunks() for c in ("token", "token_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        for b in batches:
            token = b.column("token")
            flat, off = token.flatten(), np.asarray(token.offsets)
            off = (off - off[0]).astype(np.int32)
            got = numbers.take(pc.index_in(flat, value_set=words))
            miss = np.flatnonzero(np.asarray(got.is_null())) if more else np.zeros(0, np.int64)
            cut = np.searchsorted(miss, off).astype(np.int32)
            pos = (miss - np.repeat(off[:-1], np.diff(cut))).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(pos), flat.take(pa.array(miss))], names=["pos", "token"])
            ids = pc.fill_null(got, UNK_ID).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(pa.array(off), ids), pa.ListArray.from_arrays(pa.array(cut), rare)],
                                             names=["row", "ids", "rare"])

    coded = src.mapInArrow(run, schema)
    if more:
        coded = _with_rare_ids(coded, vocab.filter(F.col("token_id") >= stop))
    body = F.concat(F.array(F.lit(START_ID)), F.col("ids"), F.array(F.lit(END_ID)))
    return coded.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], body.alias(out))


def _with_rare_ids(coded: DataFrame, rest: DataFrame) -> DataFrame:
    """(row, ids) of (row, ids, rare) with the ids of the rare tokens that
    ``rest`` has. Staged rows are numbered, as equal rows stay apart; rows
    without rare tokens are not shuffled."""
    rows = stage_parquet(coded.withColumn("rid", F.monotonically_increasing_id()), "token-ids")
    rest = rest.groupBy("token").agg(F.min("token_id").cast("int").alias("token_id"))
    found = (rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.pos", "r.token").join(rest, "token")
             .groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token_id"))).alias("found")))     # at most a row's tokens
    has = F.size("rare") > 0
    put = F.transform("ids", lambda x, i: F.coalesce(F.try_element_at("found", i), x))
    patched = rows.filter(has).join(found, "rid", "left").select("row", F.when(F.col("found").isNull(), F.col("ids")).otherwise(put).alias("ids"))
    return patched.unionByName(rows.filter(~has).select("row", "ids"))


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "item_id", text_col: str = "text",
           max_length: int = 256, out: str = "input_ids") -> DataFrame:
    """T4: (``id_col``, ``out``), one row per input row, rows of equal id
    included (``with_token_ids``)."""
    ids = df.select(F.col(id_col), F.col(text_col).alias("enc_text"))
    return with_token_ids(spread(ids), vocab, "enc_text", max_length, out, keep=[id_col])


def batch_index(df: DataFrame, order_cols, batch_size: int = 32) -> DataFrame:
    """T7 (part): dense row index in order, ``batch_id = idx // batch_size``."""
    x = with_row_index(df, order_cols, "row_idx")
    return (x.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("long"))
            .withColumn("batch_pos", (F.col("row_idx") % batch_size).cast("int")))


def assemble_batches(indexed: DataFrame, id_col: str = "item_id", ids_col: str = "input_ids",
                     extra=("label", "has_images", "weight")) -> DataFrame:
    """T5 + T7: one row per batch, members in row order; token ids padded to
    the longest member of the batch with an attention mask. The batch is a
    fixed-size group (at most ``batch_size`` rows)."""
    extra = [c for c in extra if c in indexed.columns]
    g = (indexed.groupBy("batch_id")
         .agg(F.array_sort(F.collect_list(F.struct("batch_pos", id_col, ids_col, *extra))).alias("m")))
    longest = F.array_max(F.transform("m", lambda r: F.size(r[ids_col])))
    padded = F.transform("m", lambda r: F.concat(r[ids_col], F.array_repeat(
        F.lit(PAD_ID), longest - F.size(r[ids_col]))))
    return g.select(
        "batch_id",
        F.transform("m", lambda r: r[id_col]).alias("item_ids"),
        padded.alias("input_ids"),
        F.transform("m", lambda r: F.concat(F.array_repeat(F.lit(1), F.size(r[ids_col])),
                                            F.array_repeat(F.lit(0), longest - F.size(r[ids_col]))))
        .alias("attention_mask"),
        *[F.transform("m", _field(c)).alias(c + "s") for c in extra],
    )


def _field(name: str):
    return lambda r: r[name]


def token_counts(batches: DataFrame) -> DataFrame:
    """Real tokens per batch (mask sum), samples, and average per sample."""
    per = batches.select(
        "batch_id", F.size("item_ids").alias("samples"),
        F.aggregate(F.flatten("attention_mask"), F.lit(0).cast("long"),
                    lambda a, x: a + x).alias("tokens"))
    return per.withColumn("tokens_per_sample", F.col("tokens") / F.col("samples"))
