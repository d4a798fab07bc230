"""I/O round trips: CSV/Parquet sinks and scans, JSON landing and flattening.

Files are written under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.functions.nulls import text_or_empty
from herdflow.plans.registry import register
from herdflow.session import scratch_path
from herdflow.sources.io import (file_digests, file_metadata, land_json, read_back, read_back_check, read_run_metadata,
                                 scan_csv, scan_json_records, sink, write_run_metadata)
from herdflow.sources.tables import table
from herdflow.operators.joins import with_scalars

CSV_SCHEMA = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderstatus STRING"
CSV_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]

# The second read-back is of a file set without every 11th order and with some
# prices changed, so that the check has rows to find on both sides.
CSV_ROUNDTRIP_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderstatus,
  CAST(o_orderkey AS VARCHAR) AS raw_key, CAST(count(*) OVER () AS BIGINT) AS written_rows,
  CAST(count(*) OVER () AS BIGINT) AS reread_rows, CAST(0 AS BIGINT) AS missing_after_write,
  CAST(count_if(o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) OVER () AS BIGINT) AS damaged_missing,
  CAST(count_if(o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0) OVER () AS BIGINT) AS damaged_extra,
  true AS files_hashed
FROM orders
"""


@register("csv_roundtrip", CSV_ROUNDTRIP_SQL)
def q_csv_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "orders", *CSV_COLUMNS)
    csv_out = scratch_path(spark, "orders-csv")
    pq_out = scratch_path(spark, "orders-parquet")
    sink(df, csv_out, "csv", partition_by=["o_orderstatus"])     # A11 + A12
    key = F.col("o_orderkey")
    damaged = df.filter(key % 11 != 0).withColumn(
        "o_totalprice", F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    sink(damaged, pq_out, "parquet")                             # A10 + A12
    back = scan_csv(spark, csv_out, schema=CSV_SCHEMA, columns=CSV_COLUMNS)   # A1/A2 (typed, pruned), A16
    raw = scan_csv(spark, csv_out, raw_strings=True)             # A3
    check = read_back_check(df, back).drop("extra_after_write")  # A13
    found = read_back_check(df, read_back(spark, pq_out, "parquet")).select(
        F.col("missing_after_write").alias("damaged_missing"), F.col("extra_after_write").alias("damaged_extra"))
    hashed = file_metadata(spark, csv_out + "/*/*.csv").agg(     # A14
        (F.count_if(F.length("sha256") == 64) == F.count(F.lit(1))).alias("files_hashed"))
    out = back.join(raw.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                               F.col("o_orderkey").alias("raw_key")), "o_orderkey")
    out = with_scalars(out, check, found, hashed)
    return out.select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
                      "o_orderstatus", "raw_key", "written_rows", "reread_rows", "missing_after_write",
                      "damaged_missing", "damaged_extra", "files_hashed")


FLATTEN_JSON_SQL = """
SELECT event_id, trim(event_type) AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "detail.k",
       user_id AS "detail.user_id", strftime(ts, '%Y-%m-%d') AS "detail.when.day"
FROM events
"""


@register("flatten_json", FLATTEN_JSON_SQL)
def q_flatten_json(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props", "ts")
    nested = e.select("event_id", F.concat(F.lit(" "), F.col("event_type")).alias("event_type"),
                      F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                               F.col("user_id").alias("user_id"),
                               F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day")).alias("when"))
                       .alias("detail"))
    landing = scratch_path(spark, "events-json")
    land_json(nested, landing)                                   # A15
    schema = ("event_id BIGINT, event_type STRING, "
              "detail STRUCT<k: BIGINT, user_id: BIGINT, when: STRUCT<day: STRING>>")
    flat = scan_json_records(spark, landing, schema=schema)      # A7
    return flat.withColumn("event_type", text_or_empty("event_type"))   # B31


# Run metadata (A14): counts, rule and digests of the written files as JSON,
# read back and compared with a second digest of the files, read in small parts.
RUN_METADATA_SQL = """
SELECT CAST(count(*) AS BIGINT) AS train_rows,
  CAST(count(c_custkey) AS BIGINT) AS matched_rows, CAST(count(*) - count(c_custkey) AS BIGINT) AS unmatched_rows,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS valid_farm_count, list_sort(list(DISTINCT year(o_orderdate))) [1] AS first_year,
  'ORDER_YEAR < TARGET_YEAR' AS rule, CAST(3 AS BIGINT) AS source_folders, true AS digests_hold, true AS sizes_hold, true AS has_time
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey
"""


@register("run_metadata", RUN_METADATA_SQL)
def q_run_metadata(spark, sf_dir):
    import datetime as dt

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = table(spark, sf_dir, "customer", "c_custkey").filter(F.col("c_custkey") % 5 != 0)
    counts = o.join(c, o.o_custkey == c.c_custkey, "left").agg(
        F.count(F.lit(1)).alias("train_rows"), F.count("c_custkey").alias("matched_rows"),
        F.count_if(F.col("c_custkey").isNull()).alias("unmatched_rows"),
        F.count_distinct("o_custkey").alias("valid_farm_count"),
        F.min(F.year("o_orderdate")).cast("bigint").alias("first_year")).first()
    sources, record_path = scratch_path(spark, "orders-source"), scratch_path(spark, "run-metadata")
    sink(o, sources, "csv", partition_by=["o_orderstatus"])
    pattern = sources + "/*/*.csv"
    files = {f.path: {"size": f["size"], "sha256": f.digest} for f in file_digests(spark, pattern).collect()}
    write_run_metadata(spark, record_path, {**counts.asDict(), "rule": "ORDER_YEAR < TARGET_YEAR", "source_files": files,
                                            "generated_at": dt.datetime.now(dt.timezone.utc).isoformat()})
    record = read_run_metadata(spark, record_path)
    again = file_digests(spark, pattern).collect()
    sizes = {f.path: f.length for f in spark.read.format("binaryFile").load(pattern).select("path", "length").collect()}
    held = record["source_files"]
    names = [*counts.asDict(), "rule"]
    row = tuple(record[n] for n in names) + (
        len({p.split("/")[-2] for p in held}), held == {f.path: {"size": f["size"], "sha256": f.digest} for f in again},
        sizes == {p: f["size"] for p, f in held.items()}, "T" in record["generated_at"])
    schema = ", ".join(f"{n} long" for n in counts.asDict()) + ", rule string"
    return spark.createDataFrame([row], schema + ", source_folders long, digests_hold boolean, sizes_hold boolean, has_time boolean")
