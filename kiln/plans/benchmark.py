"""Runtime report job over a batch-timing table (R1-R7), written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kiln.config import RuntimeConfig
from kiln.operators.runtime import checked_report, runtime_report
from kiln.sources.reports import write_json_report


def report_runtime(timings: DataFrame, out_json: str | None = None, cfg: RuntimeConfig = RuntimeConfig(),
                   scope: str = "end_to_end") -> DataFrame:
    rep = runtime_report(timings, cfg.warmup_batches, cfg.max_batches, scope=scope, fail_on_empty=True)
    if out_json:
        write_json_report(rep, out_json)
    return rep


def report_good_runs(timings: DataFrame, out_json: str, cfg: RuntimeConfig = RuntimeConfig(),
                     scope: str = "end_to_end") -> dict[str, int]:
    """Write the report of every run, the ones set aside with their reason, and
    return how many runs there are and how many were set aside. The counts are
    observed by the job that writes the report; nothing is read twice."""
    rep = checked_report(timings, cfg.warmup_batches, cfg.max_batches, scope)
    seen = Observation("runs")
    write_json_report(rep.observe(seen, F.count(F.lit(1)).alias("runs"), F.count("reason").alias("rejected")), out_json)
    return dict(seen.get)
