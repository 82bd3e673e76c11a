"""Parameter roll-up, dataset cost and the composite efficiency report
(E1, E4, E8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.metrics import ces_score, efficiency_factor, model_flops, resource_cost


def parameter_totals(manifest: DataFrame) -> DataFrame:
    """Per model, total / trainable / frozen parameters from a manifest
    of (model, name, shape, trainable)."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return (manifest.withColumn("__n", size).groupBy("model")
            .agg(F.sum("__n").cast("long").alias("total_params"),
                 F.coalesce(F.sum(F.when(F.col("trainable"), F.col("__n"))), F.lit(0)).cast("long")
                 .alias("trainable_params"))
            .withColumn("frozen_params", F.col("total_params") - F.col("trainable_params")))


def efficiency_report(models: DataFrame, params_col: str = "total_params", flops_col: str = "flops",
                      plcc_col: str = "plcc") -> DataFrame:
    """Resource cost, efficiency factor and score per model; the score
    is null when no correlation is given."""
    C = resource_cost(params_col, flops_col)
    return (models.withColumn("resource_cost", C)
            .withColumn("efficiency_factor", efficiency_factor(F.col("resource_cost")))
            .withColumn("ces", F.when(F.col(plcc_col).isNotNull(),
                                      ces_score(F.col(plcc_col), F.col("resource_cost")))))


def add_sample_flops(df: DataFrame, length_col: str, with_images=True, **shape) -> DataFrame:
    """E4 per row at the row's token length."""
    return df.withColumn("flops", model_flops(F.col(length_col), with_images=with_images, **shape))
