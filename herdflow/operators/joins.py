"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdflow.session import scratch_path

# Default cap for an explicitly broadcast side (estimated in-memory bytes).
MAX_BROADCAST_BYTES = 128 * 1024 * 1024


def with_scalars(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Attach the columns of one-row aggregates (medians, bounds, year lists,
    counts) to every row of ``df`` as uncorrelated scalar subqueries: each is
    executed once and inlined as a value - no join, no row pairing."""
    out = df
    for i, s in enumerate(one_row):
        name = f"__scalar{i}"
        sub = s.select(F.struct(*[F.col(f"`{c}`") for c in s.columns]).alias(name)).scalar()
        out = out.select("*", sub.alias(name))
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != name],
                         *[F.col(name).getField(c).alias(c) for c in s.columns])
    return out


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: lineage is cut, the result survives executor loss, and the
    planner sees real file statistics for it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Materialise ``df`` as a table in the shared folder, count it
    and return it with a broadcast hint only when its estimated size is under
    ``max_bytes``; otherwise return it unhinted so the planner shuffles.

    Use for sides that are small by construction (bounded by a key domain,
    e.g. aggregated statistics); the checkpoint also cuts their lineage, so
    the expensive aggregation runs once and survives executor loss.
    """
    small = materialize(df)
    rows = small.count()
    est = rows * (16 + 8 * len(small.columns))
    if est <= max_bytes:
        return F.broadcast(small), True
    return small, False
