"""Row identity and row filters: dense row ids in a defined order, id
continuity, token-aware missing-row filters with reported counts, zero fill.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from herdflow.functions.nulls import MISSING_TOKENS, null_tokens


def dense_row_id(df: DataFrame, order_by: Sequence[str], out: str = "row_idx") -> DataFrame:
    """0-based dense index in the order of ``order_by`` (a full key).

    Range-partition and sort within partitions (distributed, deterministic for
    a deterministic input); the position inside a partition comes from
    ``monotonically_increasing_id``; per-partition row counts (one row per
    partition) give the running offsets, joined back as a small table. No
    single task holds all rows and no row leaves the JVM. The ordered rows are
    written once (shared folder) so both passes see the same positions.
    """
    from herdflow.operators.joins import materialize

    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = (df.repartitionByRange(int(n), *order_by).sortWithinPartitions(*order_by)
                 .withColumn("__mid", F.monotonically_increasing_id()))
    # The partition positions are physical; fix them in a written table so the
    # counts and the rows can never come from two different executions.
    ordered = materialize(ordered, "row-order")
    ordered = ordered.withColumn("__pid", F.shiftright("__mid", 33)) \
                     .withColumn("__pos", F.col("__mid") - F.shiftleft(F.col("__pid"), 33))
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)))
    j = ordered.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
    return j.withColumn(out, (F.col("__off") + F.col("__pos")).cast("long")).drop("__mid", "__pid", "__pos", "__off")


def format_row_id(idx_col: str, prefix: str, width: int = 9):
    """``PREFIX_000000002`` style id text."""
    return F.format_string(f"%s_%0{width}d", F.lit(prefix), F.col(idx_col))


def id_continuity_violations(df: DataFrame, idx_col: str, id_col: str, prefix: str, width: int = 9) -> DataFrame:
    """Rows whose id differs from the expected sequence id, plus gaps
    (``max index + 1 != rows``)."""
    expected = format_row_id(idx_col, prefix, width)
    return df.agg(F.count_if(F.col(id_col) != expected).alias("id_mismatches"),
                  (F.max(idx_col) + 1 - F.count(F.lit(1))).alias("index_gaps"))


def drop_rows_with_missing(df: DataFrame, cols: Iterable[str], tokens=MISSING_TOKENS,
                           name: str = "missing_filter") -> tuple[DataFrame, Observation]:
    """C1 + J14: drop rows where any column is missing (token-aware); the
    loaded / dropped counts are collected as an ``Observation`` by the first
    action on the result (no extra job)."""
    cols = list(cols)
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | null_tokens(c, tokens).isNull()
    obs = Observation(name)
    flagged = df.withColumn("__missing", any_missing).observe(
        obs, F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("__missing")).alias("dropped"))
    return flagged.filter(~F.col("__missing")).drop("__missing"), obs


def date_floor_filter(df: DataFrame, *, start: str, end: str, min_start=None) -> DataFrame:
    """Both dates known and (optionally) start not before ``min_start``."""
    cond = F.col(start).isNotNull() & F.col(end).isNotNull()
    if min_start is not None:
        cond = cond & (F.col(start) >= F.lit(min_start).cast("date"))
    return df.filter(cond)


def select_numeric(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Keep numeric columns only, minus an exclusion list."""
    from pyspark.sql.types import NumericType

    ex = set(exclude)
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex])


def ordered_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The preferred columns that exist first (in that order), then the rest."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def aligned_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """Index-aligned combination of two tables keyed the same way
    (pandas index alignment becomes an explicit key join)."""
    return left.join(right, list(key), how)


def add_polynomial(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Squared term of a numeric column."""
    return df.withColumn(out or f"{col}_sq", F.col(col).cast("double") * F.col(col).cast("double"))


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> 0 on the given columns (farms without records)."""
    return df.na.fill(0, list(cols))


def once(df: DataFrame, expr, name: str) -> DataFrame:
    """A column evaluated once per row: a generator of one element, which the
    optimizer does not inline into the expressions that use the column (inside
    a lambda it would be evaluated again for every element)."""
    return df.select("*", F.explode(F.array(expr)).alias(name))
