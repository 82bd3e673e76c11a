"""Runtime-log analytics over a batch timing table.

Input rows: ``run_id, batch_idx, device, start_us, end_us, batch_size,
tokens, alloc_bytes, reserved_bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured_batches(timings: DataFrame, warmup: int = 5, cap: int | None = None) -> DataFrame:
    """R1 + R2: drop the first ``warmup`` batches of each run (by batch
    index) and keep at most ``cap`` after them."""
    keep = F.col("batch_idx") >= warmup
    if cap is not None:
        keep = keep & (F.col("batch_idx") < warmup + cap)
    return timings.filter(keep)


def _figures(measured: DataFrame, scope: str, batches: Column) -> DataFrame:
    """The report's columns per run of ``measured``."""
    g = measured.groupBy("run_id").agg(
        F.min("device").alias("device"),
        batches.cast("long").alias("measured_batches"),
        F.sum("batch_size").cast("long").alias("num_samples"),
        F.sum("tokens").cast("long").alias("num_input_tokens"),
        (F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("model_seconds"),
        ((F.max("end_us") - F.min("start_us")) / 1e6).alias("end_to_end_seconds"),
        (F.max(F.when(F.col("device").like("cuda%"), F.col("alloc_bytes"))) / 1048576.0).alias("peak_alloc_mib"),
        (F.max(F.when(F.col("device").like("cuda%"), F.col("reserved_bytes"))) / 1048576.0).alias("peak_reserved_mib"),
    )
    t = F.col("end_to_end_seconds" if scope == "end_to_end" else "model_seconds")
    tok = F.col("num_input_tokens")
    return g.select(
        "run_id", "device", "measured_batches", "num_samples", "num_input_tokens", "model_seconds",
        "end_to_end_seconds",
        (F.try_divide(t, F.col("num_samples")) * 1000.0).alias("latency_ms_per_sample"),
        F.try_divide(F.col("num_samples").cast("double"), t).alias("throughput_samples_per_sec"),
        F.when(tok > 0, t / tok * 1000.0).alias("latency_ms_per_token"),
        F.when(tok > 0, F.try_divide(tok.cast("double"), t)).alias("throughput_tokens_per_sec"),
        F.try_divide(tok, F.col("num_samples")).alias("avg_input_tokens_per_sample"),
        "peak_alloc_mib", "peak_reserved_mib")


def runtime_report(timings: DataFrame, warmup: int = 5, cap: int | None = None,
                   scope: str = "end_to_end", fail_on_empty: bool = False) -> DataFrame:
    """R3-R7 per run with a measured batch. ``model_seconds`` sums per-batch durations;
    ``end_to_end_seconds`` is last end minus first start. Token rates are
    null when a run has no tokens; rates use the ``scope`` time
    (``end_to_end`` or ``model``); peak memory (MiB) is null off-GPU. Rates per
    sample are null when a run has no sample. A run that names several devices
    reports the first in name order. With ``fail_on_empty`` a run without
    measured batches or samples raises (R6); ``checked_report`` sets such runs
    aside instead."""
    g = _figures(measured_batches(timings, warmup, cap), scope, F.count(F.lit(1)))
    if fail_on_empty:
        # Driven by the list of runs, and part of a selected value, so no
        # optimizer rule (empty-relation propagation, pruning) can drop it.
        runs = timings.select("run_id").distinct()
        g = runs.join(g, "run_id", "left").withColumn(
            "measured_batches",
            F.when(F.col("num_samples") > 0, F.col("measured_batches")).otherwise(
                F.raise_error(F.lit("No batches were measured for a run, or no samples.")).cast("long")))
    return g


NO_BATCH, NO_SAMPLE = "no measured batch", "no sample"


def checked_report(timings: DataFrame, warmup: int = 5, cap: int | None = None, scope: str = "end_to_end") -> DataFrame:
    """R6 without stopping the other runs: one row per run of ``timings``, the
    columns of ``runtime_report`` plus ``reason`` (null for a good run; else
    ``NO_BATCH`` or ``NO_SAMPLE``, with null rates). Runs are found in the same
    aggregation as the figures, so the timings are read once."""
    kept = F.col("batch_idx") >= warmup
    if cap is not None:
        kept = kept & (F.col("batch_idx") < warmup + cap)
    # Batches outside the measured window count nothing but keep their run.
    marked = timings.select("run_id", F.when(kept, F.lit(0)).otherwise(F.lit(None)).cast("int").alias("batch_idx"),
                            *[F.when(kept, F.col(c)).alias(c) for c in
                              ("device", "start_us", "end_us", "batch_size", "tokens", "alloc_bytes", "reserved_bytes")])
    g = _figures(marked, scope, F.count("batch_idx"))
    reason = F.when(F.col("measured_batches") == 0, F.lit(NO_BATCH)).when(F.coalesce("num_samples", F.lit(0)) == 0, F.lit(NO_SAMPLE))
    return g.withColumn("reason", reason)


def rejected_runs(checked: DataFrame) -> DataFrame:
    """(run_id, measured_batches, num_samples, reason) of the runs set aside."""
    return checked.filter(F.col("reason").isNotNull()).select("run_id", "measured_batches", F.coalesce("num_samples", F.lit(0)).alias("num_samples"), "reason")
