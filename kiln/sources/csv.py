"""CSV boundary of the pipeline (S3-S5). Parquet is the internal format;
CSV is read and written only where the outer files are CSV."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.config import NA_TOKENS

_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}
MALFORMED = "_malformed"
BATCH_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Unless the session sets a limit, Arrow batches hold at most
    ``BATCH_BYTES``: by rows alone, a Python worker's memory would grow with the
    length of the lines. Records are read when the caller acts, so the limit
    stays set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def _parity(c: Column) -> Column:
    """Quotes in a line, modulo 2."""
    return (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text lines of all files under ``path``, read
    in splits; ``block`` is where a line's split begins in its file."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, owner) of every split: whether it begins inside a
    quoted field, and if so the split in which that field's record began.

    A split's quotes are counted without knowing its state; a prefix sum of the
    parities over the splits of a file then gives each split's state. A record
    is left open by a split that ends inside quotes, unless it lies inside one
    record as a whole (it began inside and no line changes the state)."""
    per = lines.groupBy("file", "block").agg((F.sum(_parity(F.col("value"))) % 2).alias("odd"), F.max(_parity(F.col("value"))).alias("turns"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = per.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    opens = ((F.col("inside").cast("int") + F.col("odd")) % 2 == 1) & (~F.col("inside") | (F.col("turns") == 1))
    owner = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)
    return state.select("file", "block", "inside", F.when(F.col("inside"), owner).alias("owner"))


def _bounded(batches: Iterator[pa.RecordBatch], max_bytes: int = BATCH_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """Runs of lines of about ``max_bytes`` (a longer line is a run of its own),
    which bounds the copies and Python strings made of a batch."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("value")), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value, inside, owner) in file order -> records
    (file, block, owner, tail, text): whole ones (null owner), and the parts of
    records that go over a split's end: the last of a split (owner itself) and
    what a split begins with (owner from ``split_states``)."""
    here, held, inside, owner = None, [], False, None

    def flush() -> tuple | None:
        """What a split ends with, if a record is open."""
        if not held:
            return None
        return (here[0], here[1], owner if owner is not None else here[1], "\n".join(held))

    for b in _bounded(batches):
        value = pc.fill_null(b.column("value"), "")
        odd = np.asarray(pc.count_substring(value, '"'), dtype=np.int64) % 2
        file, block = b.column("file").dictionary_encode(), np.asarray(b.column("block"))
        code = np.asarray(file.indices)
        edge = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])) if b.num_rows else []
        out: list[tuple] = []
        for lo, hi in zip(edge, [*edge[1:], b.num_rows]):
            key = (file.dictionary[int(code[lo])].as_py(), int(block[lo]))
            if key != here:
                if (last := flush()) is not None:
                    out.append(last)
                here, held = key, []
                inside, owner = b.column("inside")[int(lo)].as_py(), b.column("owner")[int(lo)].as_py()
            text = value.slice(lo, hi - lo)
            # A record ends with every line after which no quote is open.
            state = (np.cumsum(odd[lo:hi]) + (1 if inside else 0)) % 2
            ends = np.flatnonzero(state == 0)
            plain = np.flatnonzero((state == 0) & (odd[lo:hi] == 0))         # one line, one record
            if len(plain):
                yield _whole(key, text.take(pa.array(plain)))
            start = 0
            for e in ends[odd[lo:hi][ends] == 1].tolist():                   # the last line of a record of several
                first = int(np.searchsorted(ends, e))
                begin = int(ends[first - 1]) + 1 if first else start
                held += text.slice(begin, e + 1 - begin).to_pylist()
                out.append((*key, owner, "\n".join(held)))
                held, owner = [], None
            tail = int(ends[-1]) + 1 if len(ends) else 0
            held += text.slice(tail).to_pylist()
            inside = bool(state[-1])
        if out:
            yield _records(out)
    if (last := flush()) is not None:
        yield _records([last])


_RECORD = "file string, block long, owner long, text string"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    f, b, o, t = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(b, pa.int64()), pa.array(o, pa.int64()), pa.array(t, pa.string())],
                                      names=["file", "block", "owner", "text"])


def _whole(key: tuple, text: pa.Array) -> pa.RecordBatch:
    n = len(text)
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.nulls(n, pa.int64()), text.cast(pa.string())],
                                      names=["file", "block", "owner", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the CSV records of all files under ``path``, headers
    included, read in splits whatever line ends the quoted fields hold.

    One pass counts quotes per split, a second one cuts the records. The split
    states are one row per split (at the usual 128 MB, 800,000 for 100 TB),
    which bounds what is broadcast; only records that go over a split's end are
    shuffled, at most two parts per split. Every quote must belong to a quoted
    field, as writers of the format quote any field that holds one."""
    _bound_batches(spark)
    lines = _lines(spark, path)
    states = split_states(lines).select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), "inside", "owner")
    rows = (lines.join(F.broadcast(states), (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
            .select("file", "block", "value", "inside", "owner").mapInArrow(_record_rows, _RECORD))
    parts = (rows.filter("owner IS NOT NULL").groupBy("file", "owner")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text")))
    whole = rows.filter("owner IS NULL").select("file", "text")
    return whole.unionByName(parts.select("file", "text")).filter(F.rtrim("text", F.lit("\r")) != "")


def _by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns as strings, found by header name (column order and
    extra columns do not matter, a missing column is an error), plus the
    record's text in ``MALFORMED`` if it has fewer or more fields than the
    header."""
    # Header of the first file: one short read, the files themselves are read in splits.
    names = spark.read.options(**_CSV_OPTS).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    slots = [f"c{i}" for i in range(len(names))]
    layout = T.StructType([*[T.StructField(c, T.StringType()) for c in slots], T.StructField(MALFORMED, T.StringType())])
    opts = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` string" for f in layout.fields)
    rec = csv_records(spark, path).select(F.from_csv(F.rtrim("text", F.lit("\r")), ddl, opts).alias("r"))
    header = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.lit(n)) for c, n in zip(slots, names)])
    return (rec.filter(~header).select(*[F.col(f"r.{slots[names.index(f.name)]}").alias(f.name) for f in schema.fields],
                                       F.col(f"r.{MALFORMED}").alias(MALFORMED)))


def malformed_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(text): records with fewer or more fields than the header."""
    return _by_name(spark, path, schema).filter(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("text"))


def read_csv_keep_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: read with the given schema; empty fields stay ``''`` (Spark reads
    a bare empty field as null, so string columns are coalesced)."""
    raw = _by_name(spark, path, schema)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            cols.append(c.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def na_to_null(c):
    """The default-NA rule: the 19 tokens become null."""
    return F.when(c.isNull() | c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)


def default_na(df: DataFrame) -> DataFrame:
    """The default-NA rule on every string column of a table that was stored
    with its empty strings kept."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: na_to_null(F.col(f"`{c}`")) for c in text})


def read_csv_default_na(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As a default pandas read -- the 19 NA tokens become null, before
    casting to the declared types."""
    raw = _by_name(spark, path, schema)
    return raw.select(*[na_to_null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
                        for f in schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, no index, UTF-8, quotes doubled, empty strings as ``""``-
    free empty fields. Written as a directory of part files by the
    executors."""
    (df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("encoding", "UTF-8").csv(path))
