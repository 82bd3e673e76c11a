"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("train_plcc", T.DoubleType()),
    T.StructField("train_std_pred", T.DoubleType()),
    T.StructField("train_std_label", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_plcc", T.DoubleType()),
    T.StructField("val_mae", T.DoubleType()),
    T.StructField("val_rmse", T.DoubleType()),
    T.StructField("val_std_pred", T.DoubleType()),
    T.StructField("val_std_label", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
])


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metrics report (one row per run/model) as JSON lines."""
    df.write.mode(mode).json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append epoch rows keyed by (run_id, epoch) in the fixed
    13-column layout (run key + the 12 history columns)."""
    cols = [f.name for f in HISTORY_SCHEMA.fields]
    out = df.select(*[(df[c] if c in df.columns else F.lit(None))
                      .cast(HISTORY_SCHEMA[c].dataType).alias(c) for c in cols])
    out.write.mode("append").parquet(path)
