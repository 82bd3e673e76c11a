"""Batch inference job: input CSV -> labelled text (T2) and local image
paths (I2) -> image directory (S7, I4, I5) -> stored feature vectors ->
gate (M1) -> fuse (M2) -> head (M3) -> clamp and format (M4, M5) -> CSV
(S5) and summary (M6)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators import images, scoring, text_features
from kiln.operators.joins import stage_parquet
from kiln.sources import csv as csv_src
from kiln.sources.images import read_image_dir

INPUT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                             ("parent_asin", "main_category", "title", "features", "description", "image_paths")])


def inference_rows(spark: SparkSession, input_csv: str, images_dir: str, k: int = 1) -> DataFrame:
    rows = csv_src.read_csv_default_na(spark, input_csv, INPUT_SCHEMA).withColumnRenamed("parent_asin", "item_id")
    rows = text_features.add_text(rows, with_details=False, out="question")
    rows = rows.withColumn("candidates", images.candidate_paths("image_paths", k))
    imgs = read_image_dir(spark, images_dir).select(F.col("path").alias("origin"), "width", "height")
    return images.attach_images(rows, imgs.filter(F.col("width") > 0), k=k)


def generate_submission(spark: SparkSession, input_csv: str, images_dir: str, vectors: DataFrame,
                        head: dict, flops: float, out_csv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``vectors``: (item_id, image_vec, text_vec) produced by the encoders,
    one row per item at most. Returns (submission, summary): one submission row
    per input row, with a null score where no vector is stored. The inputs are
    scored once, and the summary's seconds cover that job."""
    t0 = time.perf_counter()
    rows = inference_rows(spark, input_csv, images_dir)
    x = rows.select("item_id", "has_images").join(vectors, "item_id", "left")
    fused = x.select("item_id", scoring.fuse(scoring.gate_image_features("image_vec", "has_images"),
                                             F.col("text_vec")).alias("features"))
    scored = stage_parquet(scoring.score(fused, head, "features", ["item_id"]), "scored")
    seconds = time.perf_counter() - t0
    sub = scoring.submission(scored, scoring.head_param_count(head), flops)
    if out_csv:
        csv_src.write_csv(sub, out_csv, mode="overwrite")
    return sub, scoring.submission_summary(scored, seconds)
