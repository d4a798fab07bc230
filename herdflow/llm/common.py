"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdflow.sources.tables import table

# Hash buckets per group in :func:`spread_rank`: the table of their counts has
# groups x RANK_BUCKETS rows whatever the size of the data.
RANK_BUCKETS = 4096

SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(col: str) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (empty for none)."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def key_text(col: str) -> Column:
    """A key as text; null becomes a text no number has."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("null"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_rank(rows: DataFrame, counted: DataFrame, group: str, digest: str, ties: Sequence[str],
                out: str) -> DataFrame:
    """0-based rank of each row in its group, in the order of (digest, ties),
    without gathering a group in one task.

    ``digest`` is a lowercase hexadecimal hash: its first three digits spread
    every group over ``RANK_BUCKETS`` ordered buckets; rows are ranked inside a
    bucket, and the rows of the buckets before it are added from a table of
    counts. ``counted`` has the same rows but may carry fewer columns, so that
    counting scans less. Rows equal in digest and ties are interchangeable.
    """
    bucket = F.substring(digest, 1, 3)
    counts = counted.groupBy(F.col(group).alias("__g"), bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__bucket").orderBy(digest, *ties)
    ranked = rows.withColumn("__bucket", bucket).withColumn("__inside", F.row_number().over(inside))
    joined = ranked.join(offsets, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(out, (F.col("__before") + F.col("__inside") - 1).cast("long")).drop(
        "__g", "__b", "__before", "__inside", "__bucket")
