"""Connected components of a link table, by alternating star contraction.

Every round points each node's larger neighbours, then its smaller ones, at the
smallest node around; rounds end when the links no longer change, and then each
node that is not the smallest of its component has one link, to that smallest
node. Per-node minima are partially aggregated and joined back, so a node with
very many links is never gathered. Each round is written to the shared folder:
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdflow.operators.joins import materialize

NODES_PER_FILE = 200_000


def _state(links: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mixed).first())


def components(links: DataFrame, nodes: int) -> DataFrame:
    """Links (u, v) of longs -> (u, v) with ``v`` the smallest node of u's
    component, for every linked ``u`` but that smallest node itself.

    ``nodes`` (about how many there are) sets the number of files a round is
    written to. Self-links and repeated links are harmless; no link gives no row."""
    files = nodes // NODES_PER_FILE + 1
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .filter("u != v").distinct().coalesce(files), "links")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n")).filter("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        then = materialize(small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(),
                           "links")
        was, state, now = state, _state(then), then
        if state == was:
            return now
