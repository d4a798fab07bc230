"""Column-pruned scans of the driver's parquet test tables.

Every loader reads one parquet file and immediately projects the columns a
query needs, so Catalyst pushes the projection (``ReadSchema``) and any later
filter (``PushedFilters``) into the scan. Timestamps arrive as
``TIMESTAMP_NTZ``; callers convert with ``to_date`` / ``cast`` as needed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet`` and keep only ``columns`` (all when
    none are given)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns:
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            raise ValueError(f"{name} is missing columns {missing}")
        df = df.select(*columns)
    return df
