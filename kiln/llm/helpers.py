"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.joins import stage_parquet

BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet under the shared checkpoint folder and reread.
    Unless the session sets a limit, Arrow batches hold at most ``BATCH_BYTES``
    meanwhile, so a task's memory does not grow with the length of its texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is not None:
        return stage_parquet(df, name)
    conf.set(key, str(BATCH_BYTES))
    try:
        return stage_parquet(df, name)
    finally:
        conf.unset(key)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for folder in folders:
            if "/stage-" not in folder:
                raise ValueError(f"{folder} is no stage table")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts (bytes = characters) take the
    native ``lower``; others go through ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32(id as text) mod m; a null id gives -1 (never held out)."""
    c = F.crc32(F.col(id_col).cast("string").cast("binary")) % m
    return F.coalesce(c, F.lit(-1))


def bounded_fraction(df: DataFrame, key: str, n_rows: int, total: int) -> DataFrame:
    """Deterministic hash sample of about ``n_rows`` of ``total`` rows."""
    if total <= n_rows:
        return df
    # Shares are counted in millionths, or finer where the share itself is small.
    unit = 1_000_000
    while n_rows * unit < 100 * total:
        unit *= 1000
    cut = n_rows * unit // total
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(unit)) < cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column,
                    id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(text, label) of at most about ``max_rows`` labelled rows that are not
    held out. The labels are sampled by id hash down to the bound before the
    join, so the broadcast side is bounded by ``max_rows`` whatever the corpus
    size. Repeated labels of an id collapse to their largest value."""
    lab = (labels.select(F.col(id_col).alias("lab_id"), F.col(target).cast("int").alias("label"))
           .filter(F.col("lab_id").isNotNull() & F.col("label").isin(0, 1))
           .filter(~held_out_of("lab_id", held_out)))
    total = lab.count()
    lab = bounded_fraction(lab, "lab_id", max_rows, total).groupBy("lab_id").agg(F.max("label").alias("label"))
    return (docs.select(F.col(id_col).alias("doc_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(lab), F.col("doc_key") == F.col("lab_id"))
            .select("doc_key", "text", "label"))


def held_out_of(id_col: str, rule: tuple[int, int]) -> Column:
    """Rows whose crc32(id as text) mod ``rule[0]`` equals ``rule[1]``."""
    return crc_mod(id_col, rule[0]) == rule[1]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts total about
    ``max_bytes``, so the arrays built per run stay bounded (a longer single
    text forms a run of its own)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(text) if isinstance(text, str) else text
        n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(n)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64 (returns a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    col = pa.compute.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    off = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def binary_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls."""
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def quoted(cols: list[str]) -> list[Column]:
    """Columns by exact name, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in cols]


def numbered(cols: list[str]) -> list[Column]:
    """``quoted`` columns named by position (c0, c1, ..): ``mapInArrow`` takes no
    dots in the names of its input."""
    return [c.alias(f"c{i}") for i, c in enumerate(quoted(cols))]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


BLOOM_BLOCKS = 1 << 20    # a filter broadcast by bloom_split has at most this many 16-byte rows


def _bloom_key(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit("bit"), key)
    mask = F.lit(0).cast("bigint")
    for i in range(3):
        bit = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return F.pmod(F.xxhash64(key), F.lit(BLOOM_BLOCKS)), mask


def bloom_split(big: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ``keys``, rows whose key is not) by a
    blocked Bloom filter of bounded size, broadcast. Null keys are not. An
    exact join must follow on the first part."""
    block, mask = _bloom_key(key)
    b, m = unused(big, "bloom_b", "bloom_m")
    bloom = keys.select(block.alias(b), mask.alias("m")).groupBy(b).agg(F.bit_or("m").alias(m))
    hit = F.col(m).isNotNull() & (F.col(m).bitwiseAND(mask) == mask) & F.col(key).isNotNull()
    tested = big.withColumn(b, block).join(F.broadcast(bloom), b, "left")
    return tested.filter(hit).drop(b, m), tested.filter(~hit).drop(b, m)
