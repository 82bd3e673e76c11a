"""Catalogue preparation job and its profile.

Product records (S1/S2) -> normalise (N1-N7) -> filter (F1-F4) -> relabel
(N9) -> seeded per-category sample (P1) -> cast (N8), written once as a
parameter-keyed stage table (S6) in a shared folder; the profile (A1-A4,
T1, T3) reads the written table, so the expensive preparation runs once.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.config import PrepareConfig
from kiln.operators import filters, normalize, profile, sampling, text_features
from kiln.sources import csv as csv_src
from kiln.sources.metadata import select_source_fields
from kiln.sources.stage import cached_stage


def with_row_key(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Records without an id get a content key (SHA-256 of the record as
    JSON): deterministic under recomputation, unlike a generated id."""
    if key in df.columns:
        return df
    return df.withColumn(key, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))


def prepared(records: DataFrame, cfg: PrepareConfig = PrepareConfig(), hi_res="images.hi_res",
             large="images.large", videos="videos.url") -> DataFrame:
    """The preparation plan; the sample's keys are counted (and staged) at once,
    the records themselves are read when the result is."""
    x = select_source_fields(with_row_key(records))
    n = normalize.normalize_records(x, hi_res=hi_res, large=large, videos=videos)
    k = normalize.relabel_category(filters.filter_records(n))
    s = sampling.sample_per_group(k, "category", "item_id", cfg.frac, cfg.min_samples, cfg.seed)
    return normalize.cast_cleaned(s)


def prepare_catalogue(spark: SparkSession, records: DataFrame, stage_root: str,
                      cfg: PrepareConfig = PrepareConfig(), csv_path: str | None = None, **paths) -> DataFrame:
    """Build (or reuse) the cleaned stage; optionally export it as CSV."""
    cleaned = cached_stage(spark, stage_root, "cleaned", asdict(cfg), lambda: prepared(records, cfg, **paths), [records])
    if csv_path:
        csv_src.write_csv(cleaned, csv_path, mode="overwrite")
    return cleaned


def profile_catalogue(cleaned: DataFrame, order_col: str = "item_id") -> dict[str, DataFrame]:
    """Column profile, category and rating counts, text length statistics
    and the transposed first row."""
    return {
        "columns": profile.column_profile(cleaned),
        "categories": profile.value_counts(cleaned, "main_category"),
        "ratings": profile.value_counts(cleaned, "average_rating"),
        "text_stats": text_features.text_length_stats(text_features.add_text(cleaned)),
        "first_row": profile.first_row(cleaned, order_col),
    }
