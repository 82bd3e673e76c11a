"""Input views that shape the driver's tables into the reference's inputs.

Each view is one SQL template rendered for Spark (tables read from parquet
paths) or for DuckDB (tables pre-registered by name), so a query and its
oracle see identical rows. The templates are the views of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DIALECT = {
    "spark": {"arr": "array", "str": "string", "empty": "cast(array() as array<string>)", "i0": "0"},
    "duckdb": {"arr": "list_value", "str": "varchar", "empty": "cast([] as varchar[])", "i0": "1"},
}

VIEWS = {
    "raw": """
select d.doc_id as item_id, d.source as category,
  case when d.doc_id % 97 = 0 then '' when d.doc_id % 53 = 0 then null else d.lang end as main_category,
  case when d.doc_id % 89 = 0 then null when d.doc_id % 83 = 0 then '   ' when d.doc_id % 71 = 0 then 'NA'
       else concat(substr(d.text, 1, 40), chr(9), 'T', chr(13)) end as title,
  case when d.doc_id % 79 = 0 then null else cast(10 + (d.doc_id * 37) % 41 as double) / 10 end as average_rating,
  case when d.doc_id % 73 = 0 then null else (d.doc_id * 7919) % 500 end as rating_number,
  case when d.doc_id % 31 = 0 then {empty}
       else {arr}(substr(d.text, 1, 30), null, 'a|b ', substr(d.text, 31, 30)) end as features,
  case when d.doc_id % 29 = 0 then null
       else {arr}(concat(' ', substr(d.text, 61)),
                  case when d.doc_id % 5 = 0 then 'see http://ex.com/a?b=1 <b>now</b>' else 'plain' end) end as description,
  case when d.doc_id % 23 = 0 then null
       else {arr}(concat('img/', cast(d.doc_id as {str}), '_h.png'), null, '') end as hi_res,
  case when d.doc_id % 19 = 0 then null when d.doc_id % 46 = 0 then {arr}('')
       else {arr}(concat('img/', cast(d.doc_id as {str}), '_l.png')) end as large,
  case when d.doc_id % 3 = 0 then null else {arr}('v1.mp4', '', 'v2.mp4') end as videos,
  case when d.doc_id % 7 = 0 then 'not json' when d.doc_id % 11 = 0 then '[1, 2]'
       when d.doc_id % 13 = 0 then '{{}}' when d.doc_id % 17 = 0 then null
       when d.doc_id % 9 = 4 then concat('{{"Brand": {{"name": "N', cast(d.doc_id as {str}), '", "tags": [1, true, null, "t", [], {{}}]}}, "weight": ',
            cast(d.doc_id % 7 as {str}), '.5, "ok": ', case when d.doc_id % 2 = 0 then 'true' else 'false' end, ', "none": null, "list": [[', cast(d.doc_id as {str}), ']]}}')
       when d.doc_id % 9 = 5 then '{{"A": 1, "B": "x;y", "A": 1}}'
       when d.doc_id % 9 = 6 then '{{"A": 1, "B": [true}}'
       else concat('{{"Brand": "B;', cast(d.doc_id % 25 as {str}), '", "Size": ', cast(d.doc_id % 9 as {str}), ', "A": "x"}}') end as details
from {t_documents} d""",
    "texts": """
select doc_id as item_id,
  concat(case when doc_id % 5 = 0 then 'see http://ex.com/a?b=1 now '
              when doc_id % 5 = 1 then '<b>bold</b><br/> '
              when doc_id % 5 = 2 then concat('tab', chr(9), 'cr', chr(13), 'q', chr(92), chr(39), 's ')
              when doc_id % 5 = 3 then 'WWW.Site.org/x <a href="http://q">z</a> '
              else '' end, text) as t
from {t_documents}""",
    "predictions": """
select vec_id % 4 as run_id, vec_id % 3 + 1 as epoch, vec_id as id,
  case when vec_id % 4 = 3 then cast(2.5 as double) else 3 + 10 * cast(embedding[{i0}] as double) end as prediction,
  1 + cast(label as double) * 2 / 5 as label,
  cast((vec_id * 7919) % 500 as double) as rating_number
from {t_embeddings}""",
    "history": """
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch, value as val_plcc
from {t_events}""",
    "timings": """
select run_id, batch_idx, case when run_id % 2 = 0 then 'cuda:0' else 'cpu' end as device,
  cast(sum(dur) over (partition by run_id order by batch_idx rows between unbounded preceding and current row) as bigint) - dur + 1000 * batch_idx as start_us,
  cast(sum(dur) over (partition by run_id order by batch_idx rows between unbounded preceding and current row) as bigint) + 1000 * batch_idx as end_us,
  1 + event_id % 32 as batch_size, case when run_id = 7 then 0 else 10 * (1 + event_id % 32) end as tokens,
  1048576 * (1 + event_id % 512) as alloc_bytes, 1048576 * (600 + event_id % 64) as reserved_bytes
from (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as batch_idx, event_id,
             cast(round(value * 1000) as bigint) as dur from {t_events}) x""",
    "manifest": """
select p_brand as model, concat('p', cast(p_partkey as {str})) as name,
  {arr}(cast(p_size as bigint), p_partkey % 64 + 1) as shape, p_partkey % 3 <> 0 as trainable
from {t_part}""",
    "models": """
select vec_id as model, 1000000 * (1 + vec_id % 3000) as params, cast(100000000 * (1 + (vec_id * 7) % 900) as double) as flops,
  cast(label as double) / 10 - cast(0.2 as double) as plcc
from {t_embeddings}""",
    "images": """
select concat('img/', cast(doc_id as {str}), '_h.png') as origin,
  case when doc_id % 5 = 0 then cast(-1 as int) else cast(8 + (doc_id * 13) % 40 as int) end as width,
  case when doc_id % 5 = 0 then cast(-1 as int) else cast(9 + (doc_id * 11) % 40 as int) end as height
from {t_documents}
union all
select concat('img/', cast(doc_id as {str}), '_l.png') as origin,
  case when doc_id % 5 = 4 then cast(-1 as int) else cast(8 + (doc_id * 13) % 40 as int) end as width,
  case when doc_id % 5 = 4 then cast(-1 as int) else cast(9 + (doc_id * 11) % 40 as int) end as height
from {t_documents}""",
}

# The records with whole texts as title and as feature entries.
VIEWS["raw_whole"] = (VIEWS["raw"].replace("concat(substr(d.text, 1, 40), chr(9), 'T', chr(13))", "concat(d.text, chr(9), 'T', chr(13))")
                      .replace("{arr}(substr(d.text, 1, 30), null, 'a|b ', substr(d.text, 31, 30))", "{arr}(d.text, null, 'a|b ', d.text)"))


def render(view: str, dialect: str, sf_dir: str | None = None) -> str:
    """SQL text of ``view`` for ``dialect`` ('spark' or 'duckdb')."""
    subs = dict(_DIALECT[dialect])
    for t in TABLES:
        subs[f"t_{t}"] = f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" if dialect == "spark" else t
    return VIEWS[view].format(**subs).strip()


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered 1.. per user in (ts, event_id) order -- the
    ``row_number()`` of the SQL views, computed without sending a hot user's
    events to one task."""
    from kiln.operators.scans import group_row_number
    return group_row_number(table(spark, "events", sf_dir), ["user_id"], ["ts", "event_id"], "__rn")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered_events(spark, sf_dir)
    return e.select(F.col("user_id").alias("run_id"), F.col("__rn").cast("int").alias("epoch"), F.col("value").alias("val_plcc"))


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.operators.scans import running_agg
    e = (_numbered_events(spark, sf_dir)
         .select(F.col("user_id").alias("run_id"), (F.col("__rn") - 1).cast("int").alias("batch_idx"), "event_id",
                 F.round(F.col("value") * 1000).cast("long").alias("dur")))
    t = running_agg(e, ["run_id"], "batch_idx", F.col("dur"), "sum", "__cum")
    gap = F.lit(1000) * F.col("batch_idx")
    return t.select(
        "run_id", "batch_idx",
        F.when(F.col("run_id") % 2 == 0, F.lit("cuda:0")).otherwise(F.lit("cpu")).alias("device"),
        (F.col("__cum") - F.col("dur") + gap).alias("start_us"), (F.col("__cum") + gap).alias("end_us"),
        (1 + F.col("event_id") % 32).alias("batch_size"),
        F.when(F.col("run_id") == 7, F.lit(0)).otherwise(10 * (1 + F.col("event_id") % 32)).cast("long").alias("tokens"),
        (F.lit(1048576) * (1 + F.col("event_id") % 512)).alias("alloc_bytes"),
        (F.lit(1048576) * (600 + F.col("event_id") % 64)).alias("reserved_bytes"))


# Views whose SQL numbers or accumulates rows per run with a window; Spark
# builds them with the skew-safe scans (same rows, checked in tests).
_BUILDERS = {"history": _history, "timings": _timings}


def view(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """The fixture view as a Spark DataFrame over ``sf_dir``."""
    if name in _BUILDERS:
        return _BUILDERS[name](spark, sf_dir)
    return spark.sql(render(name, "spark", sf_dir))


def sql_view(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """The view exactly as its SQL template (plain windows), for tests."""
    return spark.sql(render(name, "spark", sf_dir))


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def duck_ctes(*names: str) -> str:
    """``with`` clause defining the named views for the DuckDB oracle."""
    return "with " + ",\n".join(f"{n} as ({render(n, 'duckdb')})" for n in names)
