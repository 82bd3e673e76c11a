"""Record normalisation: nested product records to the flat product table.

All rules are narrow column expressions (one pass, whole-stage codegen,
no shuffle). Details rendering falls back to a pandas UDF only for rows
whose JSON the native path cannot print exactly (see ``format_details``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.config import CLEANED_DOUBLE_COLUMNS, CLEANED_STRING_COLUMNS, LIST_SEPARATOR, SCRUBBED_FIELDS
from kiln.functions.text import format_details, scrub, strip
from kiln.operators.partitioning import spread

_STR_DEFAULTS = ("main_category", "title")
_NUM_DEFAULTS = ("average_rating", "rating_number")


def _has(df: DataFrame, path: str) -> bool:
    try:
        df.select(path)
        return True
    except Exception:
        return False


def with_field_defaults(df: DataFrame) -> DataFrame:
    """Absent text fields become ``''``, absent numbers null; a field
    that is present but null keeps its null."""
    add = {}
    for c in _STR_DEFAULTS:
        if c not in df.columns:
            add[c] = F.lit("")
    for c in _NUM_DEFAULTS:
        if c not in df.columns:
            add[c] = F.lit(None).cast("double")
    return df.withColumns(add) if add else df


def _str_list(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast(T.ArrayType(T.StringType())))


def features_text(c) -> Column:
    """Non-null entries, ``|`` to space, each stripped, joined by
    `` | `` (empty entries are kept)."""
    return F.array_join(
        F.transform(F.filter(_str_list(c), lambda x: x.isNotNull()),
                    lambda x: strip(F.replace(x, F.lit("|"), F.lit(" ")))),
        LIST_SEPARATOR)


def description_text(c) -> Column:
    """Non-null entries stripped and joined by one space."""
    return F.array_join(
        F.transform(F.filter(_str_list(c), lambda x: x.isNotNull()), strip), " ")


def url_list_text(c) -> Column:
    """Drop null and empty URLs, join by `` | ``; a null list is
    treated as empty."""
    return F.array_join(
        F.filter(_str_list(c), lambda x: x.isNotNull() & (x != "")), LIST_SEPARATOR)


def normalize_records(df: DataFrame, hi_res="images.hi_res", large="images.large",
                      videos="videos.url", keep=("item_id", "category")) -> DataFrame:
    """N1-N7 in one projection. ``hi_res``/``large``/``videos`` name the URL
    lists (nested struct fields by default). Columns in ``keep`` that exist
    are carried through (row key, source category)."""
    df = with_field_defaults(spread(df))
    feats = df["features"] if "features" in df.columns else F.lit(None)
    desc = df["description"] if "description" in df.columns else F.lit(None)
    details = df["details"] if "details" in df.columns else F.lit(None).cast("string")

    def lst(path):
        return F.col(path) if _has(df, path) else F.lit(None).cast(T.ArrayType(T.StringType()))

    out = {
        "main_category": F.col("main_category").cast("string"),
        "title": F.col("title").cast("string"),
        "average_rating": F.col("average_rating").cast("double"),
        "rating_number": F.col("rating_number"),
        "features": features_text(feats),
        "description": description_text(desc),
        "images_hi_res": url_list_text(lst(hi_res)),
        "images_large": url_list_text(lst(large)),
        "video_urls": url_list_text(lst(videos)),
        "details": format_details(details),
    }
    for k in SCRUBBED_FIELDS:                      # N7
        out[k] = scrub(out[k])
    carried = [F.col(c) for c in keep if c in df.columns]
    return df.select(*carried, *[v.alias(k) for k, v in out.items()])


def cast_cleaned(df: DataFrame, strict: bool = True) -> DataFrame:
    """Eight text columns to string, two numbers to double. With
    ``strict`` a malformed number raises (ANSI cast); otherwise it is null."""
    def num(c):
        return F.col(c).cast("double") if strict else F.expr(f"try_cast(`{c}` as double)")
    rest = [c for c in df.columns if c not in CLEANED_STRING_COLUMNS + CLEANED_DOUBLE_COLUMNS]
    return df.select(*rest, *[F.col(c).cast("string").alias(c) for c in CLEANED_STRING_COLUMNS],
                     *[num(c).alias(c) for c in CLEANED_DOUBLE_COLUMNS])


def relabel_category(df: DataFrame, source_col: str = "category") -> DataFrame:
    """Overwrite ``main_category`` with the source category (applied
    after filtering on the original value)."""
    return df.withColumn("main_category", F.col(source_col))
