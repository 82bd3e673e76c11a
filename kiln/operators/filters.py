"""Predicates and filters of the preparation job (narrow, pushed into the
same codegen stage as normalisation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.predicates import is_blank, is_missing
from kiln.functions.text import strip

REQUIRED = ("main_category", "title", "features", "description", "average_rating", "rating_number")


def required_present(df: DataFrame, fields=REQUIRED) -> Column:
    """none of the required fields is missing (F1 by column type)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return ~reduce(lambda a, b: a | b, [is_missing(F.col(c), types[c]) for c in fields])


def long_enough(min_exclusive: int = 30) -> Column:
    """``title features description`` longer than the bound after strip."""
    combined = F.concat_ws(" ", F.col("title"), F.col("features"), F.col("description"))
    return F.length(strip(combined)) > min_exclusive


def has_image_urls() -> Column:
    """at least one of the two image URL strings is present."""
    return ~(is_blank("images_hi_res") & is_blank("images_large"))


def keep_mask(df: DataFrame) -> Column:
    return required_present(df) & long_enough() & has_image_urls()


def pinned_filter(df: DataFrame, cond: Column, plain=("item_id", "category")) -> DataFrame:
    """Filter ``df`` on ``cond`` without letting Catalyst push the predicate
    below the projection that computes the columns it reads.

    When a predicate refers to derived text columns, pushdown substitutes
    their expressions into the filter and the projection computes them again
    -- the normalisation would run twice per row. Here all but the ``plain``
    columns pass through a one-row generator: what reads its output stays
    above it, while predicates on ``plain`` columns, later ones too, still go
    through to the scan and prune partitions."""
    kept = [c for c in df.columns if c in plain]
    rest = [c for c in df.columns if c not in plain]
    row = F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rest])))
    return df.select(*[F.col(f"`{c}`") for c in kept], row).filter(cond).select(*[F.col(f"`{c}`") for c in df.columns])


def filter_records(df: DataFrame) -> DataFrame:
    """F1-F4 over normalised records (evaluated on the normalised values,
    once per row)."""
    return pinned_filter(df, keep_mask(df))


def valid_entries_mask() -> Column:
    """title non-blank and average rating present (not null, not NaN)."""
    r = F.col("average_rating")
    return ~is_blank("title") & r.isNotNull() & ~F.isnan(r)
