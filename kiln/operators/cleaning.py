"""Valid-entry filter with text cleaning and its accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.config import CLEANED_FIELDS
from kiln.functions.text import clean_text
from kiln.operators.filters import valid_entries_mask

BEFORE = "__before_"


def clean_columns(df: DataFrame, cols=CLEANED_FIELDS, keep_before: bool = False) -> DataFrame:
    """``clean_text`` over each text column; optionally keep the prior
    value as ``__before_<col>`` and flag changed rows (C6) in ``text_changed``."""
    if not keep_before:
        return df.withColumns({c: clean_text(c) for c in cols})
    before = df.withColumns({f"{BEFORE}{c}": F.col(c) for c in cols})
    after = before.withColumns({c: clean_text(c) for c in cols})
    changed = reduce(lambda a, b: a | b,
                     [~F.col(c).eqNullSafe(F.col(f"{BEFORE}{c}")) for c in cols])
    return after.withColumn("text_changed", changed)


def filter_valid_entries(df: DataFrame, cols=CLEANED_FIELDS) -> DataFrame:
    """F5 + C5 + C6: keep valid rows, clean their text, flag changed rows.
    Output keeps ``__before_*`` columns for the report operators."""
    return clean_columns(df.filter(valid_entries_mask()), cols, keep_before=True)


def filter_accounting(df: DataFrame, cols=CLEANED_FIELDS) -> DataFrame:
    """one row with ``kept``, ``total``, ``dropped`` and ``modified``
    counts, in a single aggregation pass."""
    valid = valid_entries_mask()
    changed = reduce(lambda a, b: a | b,
                     [~clean_text(c).eqNullSafe(F.col(c)) for c in cols])
    return df.agg(
        F.count_if(valid).cast("long").alias("kept"),
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(~valid).cast("long").alias("dropped"),
        F.count_if(valid & changed).cast("long").alias("modified"),
    )


def first_change_sample(cleaned: DataFrame, order_col: str = "item_id", cols=CLEANED_FIELDS) -> DataFrame:
    """The changed columns of the first changed row (by ``order_col``),
    one row per changed column with its before and after values. The top-1
    is a global ``min`` over a struct: a partial aggregate, no sort."""
    first = (cleaned.filter("text_changed")
             .select(F.min(F.struct(F.col(order_col),
                                    *[F.col(c) for c in cols],
                                    *[F.col(f"{BEFORE}{c}") for c in cols])).alias("r")))
    stacked = first.select(
        F.col(f"r.{order_col}").alias(order_col),
        F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                                     F.col(f"r.`{BEFORE}{c}`").alias("before"),
                                     F.col(f"r.{c}").alias("after"))
                            for i, c in enumerate(cols)])).alias("e"))
    return (stacked.filter(F.col(order_col).isNotNull()
                           & ~F.col("e.before").eqNullSafe(F.col("e.after")))
            .select(order_col, "e.pos", "e.column", "e.before", "e.after"))
