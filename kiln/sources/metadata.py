"""Product metadata sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.config import CATEGORIES, SOURCE_FIELDS

PRODUCT_SCHEMA = T.StructType([
    T.StructField("main_category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("images", T.StructType([
        T.StructField("hi_res", T.ArrayType(T.StringType())),
        T.StructField("large", T.ArrayType(T.StringType())),
    ])),
    T.StructField("videos", T.StructType([T.StructField("url", T.ArrayType(T.StringType()))])),
    T.StructField("details", T.StringType()),
    T.StructField("rating_number", T.LongType()),
])


def select_source_fields(df: DataFrame) -> DataFrame:
    """Keep the nine source fields (plus the row key and category when
    present); nested pruning then limits the scan to them."""
    keep = [c for c in ("item_id", "category") if c in df.columns]
    return df.select(*keep, *[c for c in SOURCE_FIELDS if c in df.columns])


def read_partitioned(spark: SparkSession, root: str, fmt: str = "json",
                     categories=CATEGORIES, schema: T.StructType | None = None) -> DataFrame:
    """Product records laid out as ``root/category=<name>/...``; the
    category comes from the partition directory. Only listed categories are
    scanned (partition pruning) and ``category_order`` records list order;
    ``categories=None`` reads every category. JSON needs a schema (the
    product schema by default); self-describing formats use their own."""
    r = spark.read.format(fmt)
    if schema is None and fmt == "json":
        schema = T.StructType(PRODUCT_SCHEMA.fields + [T.StructField("category", T.StringType())])
    if schema is not None:
        r = r.schema(schema)
    df = r.load(root)
    if categories is None:
        return select_source_fields(df)
    order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    return select_source_fields(df.filter(F.col("category").isin(*categories))).withColumn(
        "category_order", order.cast("int"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """S1 (alternative): one DataFrame per category name, unioned by name in
    the given order with the category as a column."""
    parts = [select_source_fields(df).withColumn("category", F.lit(name))
             .withColumn("category_order", F.lit(i + 1)) for i, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
