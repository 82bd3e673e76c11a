"""Per-category seeded sampling without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.joins import staged_keys
from kiln.operators.ranking import HASH, cut_positions, seeded_hash


def sample_target(n, frac: float, min_samples: int):
    """``min(n, max(int(n * frac), min_samples))`` in double arithmetic."""
    return F.least(n, F.greatest(F.floor(n.cast("double") * F.lit(float(frac))).cast("long"),
                                 F.lit(int(min_samples)).cast("long")))


def sample_per_group(df: DataFrame, group: str = "category", id_col: str = "item_id",
                     frac: float | None = 0.2, min_samples: int = 10000, seed: int = 42,
                     stage: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Keep ``min(n, max(int(n*frac), min_samples))`` rows of each group: the
    rows first in ``md5('<seed>:<id>'), id`` order. Same rows for the same
    seed under any partitioning. ``frac=None`` keeps everything.

    The counting passes read (group, id) alone; with ``stage`` these two columns
    are written once to the shared checkpoint folder, so that the upstream
    work runs once for the counts. The rows themselves are not written: the
    result is the input with a comparison against its group's cut, and runs the
    upstream work when it is read. A caller that uses few columns selects
    them first and passes ``keep``: these are then staged too and the result
    is read from them."""
    if frac is None:
        return df
    rows, narrow = staged_keys(df, [group, id_col], stage, keep, "sample-input")

    def quotas(counts):
        return counts.select(group, sample_target(F.col("__c"), frac, min_samples).alias("__q"))
    ranked = cut_positions(rows.withColumn(HASH, seeded_hash(seed, id_col)), [group], quotas, ["__q"], id_col,
                           narrow=narrow.withColumn(HASH, seeded_hash(seed, id_col)))
    return ranked.filter(F.col("__rank_slot") == 0).drop("__rank_slot", HASH)
