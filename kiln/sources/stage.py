"""Cache-or-build stage tables.

A stage output is reused when it exists; otherwise it is computed, written
as parquet and read back. Unlike a path-only cache, the key includes a hash
of the stage parameters and of the input files (name, size, time of change),
so a changed parameter or input never reuses stale output.

Every build writes to a folder of its own and is committed by renaming one small
manifest into place. A driver lost half way leaves a folder without manifest:
nobody reads it and the next call builds again. Of two concurrent builds
one manifest stands, and whichever it is names a complete table. The rename
must be atomic, as it is on HDFS and POSIX file systems; where it is a copy (some
object stores), a reader may find the manifest missing and build once more.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "CURRENT"


def stage_key(name: str, params: dict, fingerprint: str = "") -> str:
    blob = json.dumps([params, fingerprint], sort_keys=True, default=str).encode()
    return f"{name}-{hashlib.sha1(blob).hexdigest()[:12]}"


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, Path class) of ``path``; works for any file system
    the cluster knows, not only local disks."""
    cls = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def input_fingerprint(inputs: Iterable[DataFrame]) -> str:
    """Hash of the file listing (path, size, time of change) below ``inputs``;
    one listing call a folder. Frames that read no files add nothing."""
    h = hashlib.sha1()
    for df in inputs:
        spark, wanted, seen = df.sparkSession, set(), []
        for f in df.inputFiles():
            wanted.add(f.split(":", 1)[-1].lstrip("/"))
        for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
            fs, cls = _fs(spark, folder)
            for st in fs.listStatus(cls(spark.sparkContext._jvm.java.net.URI(folder))):
                at = st.getPath().toUri().toString()
                if at.split(":", 1)[-1].lstrip("/") in wanted:
                    seen.append((at, st.getLen(), st.getModificationTime()))
        h.update(json.dumps(sorted(seen)).encode())
    return h.hexdigest()


def _current(spark: SparkSession, folder: str) -> str | None:
    """The committed table of a stage folder, or None."""
    fs, cls = _fs(spark, folder)
    at = cls(f"{folder}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{folder}/{stream.readLine()}"
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, attempt: str) -> None:
    fs, cls = _fs(spark, folder)
    draft = cls(f"{folder}/{attempt}.{MANIFEST}")
    out = fs.create(draft, False)
    out.writeBytes(attempt + "\n")
    out.close()
    if not fs.rename(draft, cls(f"{folder}/{MANIFEST}")):
        # Another build was committed first: its table stands.
        fs.delete(draft, False)
        fs.delete(cls(f"{folder}/{attempt}"), True)


def cached_stage(spark: SparkSession, root: str, name: str, params: dict,
                 build: Callable[[], DataFrame], inputs: Iterable[DataFrame] = ()) -> DataFrame:
    """Return the stage table under ``root`` for these parameters and
    ``inputs`` (the frames whose files ``build`` reads), building it first when no
    committed one exists."""
    folder = f"{root.rstrip('/')}/{stage_key(name, params, input_fingerprint(inputs))}"
    found = _current(spark, folder)
    if found is None:
        attempt = f"attempt-{uuid.uuid4().hex}"
        build().write.mode("errorifexists").parquet(f"{folder}/{attempt}")
        _commit(spark, folder, attempt)
        found = _current(spark, folder)
        if found is None:
            raise RuntimeError(f"the manifest of {folder} is gone after its commit")
    return spark.read.parquet(found)
