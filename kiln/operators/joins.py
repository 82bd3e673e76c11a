"""Size-checked broadcast and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir, scratch_path

# Bounds under which a materialised side table is broadcast: rows, and bytes
# as measured by the table's JSON text (an over-estimate of its binary size).
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss; never a machine-local copy)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      materialized: bool = False, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Return ``broadcast(small)`` when its row count is within ``max_rows``
    and its size within ``max_bytes``, else ``small`` unchanged so the join
    shuffles. ``small`` is checkpointed first, so measuring it (one
    aggregation: row count and JSON byte length) does not recompute its
    input; wide rows (arrays) are caught by the byte bound."""
    if not materialized:
        small = materialize(small)
    row = small.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))),
                               F.lit(0)).alias("b")).first()
    return F.broadcast(small) if row["n"] <= max_rows and row["b"] <= max_bytes else small


def stage_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back. Operators that pass over their input several times (a
    counting pass, then the selection) use it so that expensive upstream
    work -- normalisation, regex filters -- runs once, and later passes read
    only the columns they need (parquet column pruning). The files live in
    the cluster's shared folder, so a lost executor re-reads them."""
    import uuid
    path = scratch_path(df.sparkSession, f"stage-{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def staged_keys(df: DataFrame, keys: list[str], stage: bool, keep: list[str] | None, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, narrow) for operators that count first and select afterwards.
    ``narrow`` holds ``keys`` of every row, staged when ``stage`` is set. ``rows``
    is the input itself, or, with ``keep``, ``keys`` and the kept columns, read
    from the same stage table."""
    cols = list(dict.fromkeys([*keys, *(keep or [])]))
    narrow = df.select(*[F.col(f"`{c}`") for c in cols])
    if stage:
        narrow = stage_parquet(narrow, name)
    return (df if keep is None else narrow), narrow.select(*[F.col(f"`{c}`") for c in keys])
