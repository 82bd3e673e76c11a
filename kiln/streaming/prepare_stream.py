"""Continuous preparation of arriving product records.

Normalisation (N1-N7), filtering (F1-F4), text cleaning (C5) and labelled
text (T1) are per-row, so they run unchanged on a streaming DataFrame. The
sample (P1) and splits need whole-group counts and stay batch jobs over the
accumulated table. A running per-category count (A1's counts) is kept with
Spark's built-in streaming aggregation state. Sinks checkpoint into the
shared checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kiln.operators import cleaning, filters, normalize, text_features
from kiln.session import checkpoint_dir
from kiln.sources.metadata import PRODUCT_SCHEMA

STREAM_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("category", T.StringType())]
                             + PRODUCT_SCHEMA.fields)


def product_stream(spark: SparkSession, source_dir: str, fmt: str = "json",
                   schema: T.StructType = STREAM_SCHEMA, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))


def prepared_stream(records: DataFrame) -> DataFrame:
    """Normalised, filtered, cleaned records with their labelled text."""
    n = normalize.normalize_records(records)
    k = normalize.relabel_category(filters.filter_records(n))
    return text_features.add_text(cleaning.clean_columns(k))


def category_counts(prepared: DataFrame) -> DataFrame:
    """Running row count per category (streaming aggregation state)."""
    return prepared.groupBy("category").count()


def start(prepared: DataFrame, out_path: str, name: str = "prepare", available_now: bool = True) -> StreamingQuery:
    """Append prepared rows as parquet; the checkpoint sits in the shared
    checkpoint folder so the query can restart on any driver."""
    spark = prepared.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    w = prepared.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(out_path)


def start_counts(counts: DataFrame, out_path: str, name: str = "category-counts") -> StreamingQuery:
    """Keep the running counts as a parquet table at ``out_path``: in
    ``complete`` mode every micro-batch carries the whole (small, one row per
    category) result, which replaces the table. Re-running a batch after a
    failure writes the same table again, so the effect is exactly once; the
    state and the table live in shared storage, not in the driver."""
    spark = counts.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}"

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    return (counts.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
