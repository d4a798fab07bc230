"""Streaming queries (L1, L2) run with ``trigger(availableNow=True)`` over the
test tables as file streams; results are read back from the sink."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from herdflow.functions.text import prefix_id
from herdflow.plans.registry import register
from herdflow.session import scratch_path
from herdflow.operators.joins import with_scalars
from herdflow.streaming.weather_stream import (daily_weather_stream, file_stream, incremental_append,
                                               run_available_now)

WATERMARK = "1 hour"

STREAM_DAILY_SQL = """
WITH o AS (SELECT CAST(user_id % 10 AS INTEGER) AS stn, ts - INTERVAL 1 HOUR AS obs_time,
             CAST(floor(value) AS BIGINT) % 40 - 5 AS tmax, CAST(floor(value) AS BIGINT) % 40 - 15 AS tmin,
             user_id % 100 AS hm FROM events),
w AS (SELECT stn, date_trunc('day', obs_time) AS ws, max(tmax) AS ta_max, min(tmin) AS ta_min,
        round(avg(hm), 6) AS rhm_avg, count(*) AS n_obs FROM o GROUP BY 1, 2),
wm AS (SELECT max(obs_time) - INTERVAL 1 HOUR AS watermark FROM o)
SELECT stn, strftime(ws, '%Y-%m-%d') AS day, ta_max, ta_min, rhm_avg, n_obs
FROM w, wm WHERE ws + INTERVAL 1 DAY <= watermark
"""


@register("stream_daily_weather", STREAM_DAILY_SQL)
def q_stream_daily_weather(spark, sf_dir):
    src = file_stream(spark, os.path.join(sf_dir, "events.parquet"))
    src = src.select((F.col("user_id") % 10).cast("int").alias("stn"), "ts",
                     (F.floor("value").cast("bigint") % 40 - 5).alias("tmax"),
                     (F.floor("value").cast("bigint") % 40 - 15).alias("tmin"),
                     (F.col("user_id") % 100).alias("hm"))
    plan = daily_weather_stream(src, ts="ts", stn="stn", watermark=WATERMARK,
                                value_cols={"ta_max": "max:tmax", "ta_min": "min:tmin", "rhm_avg": "avg:hm"})
    out = run_available_now(plan, name="daily-weather")
    res = spark.read.parquet(out)
    return res.select("stn", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "ta_max", "ta_min",
                      (F.round(F.col("rhm_avg") * 1e6, 0) / 1e6).alias("rhm_avg"), "n_obs")


STREAM_HISTORY_SQL = """
SELECT 'original' AS SOURCE, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_ids,
       CAST(count_if(c_acctbal < 0) AS BIGINT) AS n_negative FROM customer
"""


@register("stream_history_append", STREAM_HISTORY_SQL)
def q_stream_history_append(spark, sf_dir):
    src = file_stream(spark, os.path.join(sf_dir, "customer.parquet"), max_files=1)
    target = scratch_path(spark, "history-rows")
    counts = scratch_path(spark, "history-counts")

    def normalise(batch):
        return batch.select(prefix_id("C", F.col("c_custkey").cast("string")).alias("CATTLE_NO"),
                            F.col("c_acctbal").alias("acctbal"), F.lit("original").alias("SOURCE"))

    incremental_append(src, normalise=normalise, target=target, counts=counts, name="history",
                       checkpoint=scratch_path(spark, "history-progress"))
    rows = spark.read.parquet(target)
    per_batch = spark.read.parquet(counts).agg(F.sum("rows").alias("batch_rows"))
    out = rows.groupBy("SOURCE").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_distinct("CATTLE_NO").alias("n_ids"),
                                     F.count_if(F.col("acctbal") < 0).alias("n_negative"))
    # the per-batch counters must reconcile with the appended rows
    same = F.col("batch_rows") == F.col("n_rows")
    lost = F.raise_error(F.concat(F.lit("batches count "), F.col("batch_rows"), F.lit(" rows, the table has "),
                                  F.col("n_rows"))).cast("bigint")
    out = with_scalars(out, per_batch).withColumn("n_rows", F.when(same, F.col("n_rows")).otherwise(lost))
    return out.drop("batch_rows")
