"""Weather queries over ``events`` treated as hourly station observations.

Each event becomes one observation line ``YYYYMMDDHHMM STN v0 .. v10`` stamped
at the end of its hour; station = user_id % 10. Error events are written as
comment lines, click events comma-separated, view events with a trailing
backslash. The target station list comes from the region keys of ``nation``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.operators.joins import materialize
from herdflow.operators.weather import (DAILY_VARS, ROLLING_VARS, ROLLING_WINDOWS, complete_daily,
                                        daily_output, hourly_to_daily, monthly_weather,
                                        parse_observation_lines, request_grid, rolling_features, station_day_grid)
from herdflow.plans.common import round_doubles
from herdflow.plans.registry import register
from herdflow.sources.tables import table


def _obs_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    fl = F.floor("value").cast("bigint")
    tm = F.date_format(F.date_trunc("hour", F.col("ts")) + F.expr("INTERVAL 1 HOUR"), "yyyyMMddHHmm")
    fields = [
        F.when(F.col("event_id") % 13 == 0, F.lit(-99)).otherwise(F.col("user_id") % 100),   # v0 HM
        fl % 20,                                                                            # v1 WS
        F.floor(F.col("value") * 10).cast("bigint") % 300,                                  # v2 RN_DAY
        F.lit(0), fl % 40 - 5, F.lit(0), fl % 40 - 15, F.lit(0), F.lit(0), F.lit(0),        # v3..v9
        F.when(F.col("event_id") % 4 == 0, F.lit(-99)).when(F.col("event_id") % 4 == 1, F.lit(-1))
         .otherwise(fl % 15),                                                               # v10 WS1_AVG
    ]
    head = [tm, (F.col("user_id") % 10).cast("string")]
    body = head + [f.cast("string") for f in fields]
    bare = (F.col("event_type") != "error") & (F.col("event_id") % 17 == 0)     # time and station only
    line = (F.when(bare, F.concat_ws(" ", *head)).when(F.col("event_type") == "error", F.concat(F.lit("# "), F.concat_ws(" ", *body)))
             .when(F.col("event_type") == "click", F.concat_ws(", ", *body))
             .when(F.col("event_type") == "view", F.concat(F.concat_ws(" ", *body), F.lit(" \\")))
             .otherwise(F.concat_ws(" ", *body)))
    return e.select(line.alias("value"))


def _stations(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_regionkey")
    return n.select((F.col("n_regionkey") * 2).alias("stn")).distinct()


# Every sixth hour (of the time on the line) is not asked for.
HOURS = [h for h in range(24) if h % 6 != 5]


def _daily(spark, sf_dir):
    stations = _stations(spark, sf_dir)
    hour = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
    times = table(spark, sf_dir, "events", "ts").agg(F.min(hour).alias("start"), F.max(hour).alias("end"))
    obs = parse_observation_lines(_obs_lines(spark, sf_dir), requests=request_grid(stations, times, HOURS))  # A8, C11
    daily = materialize(hourly_to_daily(obs), "daily")        # read for the bounds and again for the grid
    bounds = daily.agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return complete_daily(daily, station_day_grid(stations, bounds))


_OBS_SQL = """
  obs AS (
    SELECT CAST(user_id % 10 AS INTEGER) AS stn,
      CAST(date_trunc('hour', ts) AS DATE) AS day,
      CAST(floor(value) AS BIGINT) % 40 - 5 AS tmax, CAST(floor(value) AS BIGINT) % 40 - 15 AS tmin,
      CAST(floor(value * 10) AS BIGINT) % 300 AS rn,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 100 END AS hm,
      CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) % 20
           WHEN event_id % 4 = 1 THEN CAST(floor(value) AS BIGINT) % 20
           ELSE CAST(floor(value) AS BIGINT) % 15 END AS ws
    FROM events WHERE event_type <> 'error' AND event_id % 17 <> 0 AND hour(date_trunc('hour', ts) + INTERVAL 1 HOUR) % 6 <> 5),
  st AS (SELECT DISTINCT n_regionkey * 2 AS stn FROM nation),
  d AS (SELECT stn, day, max(tmax) AS ta_max, max(rn) AS rn_day, min(tmin) AS ta_min,
          avg(hm) AS rhm_avg, avg(ws) AS ws_davg FROM obs WHERE stn IN (SELECT stn FROM st) GROUP BY stn, day),
  b AS (SELECT min(day) AS s, max(day) AS e FROM d),
  grid AS (SELECT st.stn, CAST(unnest(generate_series(b.s, b.e, INTERVAL 1 DAY)) AS DATE) AS day FROM st, b),
  full_d AS (SELECT grid.stn, grid.day, d.ta_max, d.rn_day, d.ta_min, d.rhm_avg, d.ws_davg
             FROM grid LEFT JOIN d ON grid.stn = d.stn AND grid.day = d.day)"""

DAILY_WEATHER_SQL = f"""
WITH {_OBS_SQL}
SELECT stn, CAST(year(day) AS VARCHAR) || '.' || CAST(month(day) AS VARCHAR) || '.' || CAST(day(day) AS VARCHAR) AS date,
  coalesce(round_even(ta_max, 1), -99.0)::DOUBLE AS ta_max, coalesce(round_even(rn_day, 1), -99.0)::DOUBLE AS rn_day,
  coalesce(round_even(ta_min, 1), -99.0)::DOUBLE AS ta_min, coalesce(round_even(rhm_avg, 1), -99.0)::DOUBLE AS rhm_avg,
  coalesce(round_even(ws_davg, 1), -99.0)::DOUBLE AS ws_davg
FROM full_d
"""


@register("daily_weather", DAILY_WEATHER_SQL)
def q_daily_weather(spark, sf_dir):
    return daily_output(_daily(spark, sf_dir)).withColumn("stn", F.col("stn").cast("int"))


def _rolling_sql():
    cols = []
    for w in ROLLING_WINDOWS:
        frame = f"OVER (PARTITION BY stn ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for v in ROLLING_VARS:
            cols += [f"round(avg({v}) {frame}, 6) AS {v}_mean_w{w}",
                     f"round(stddev_samp({v}) {frame}, 6) AS {v}_std_w{w}",
                     f"round(max({v}) {frame}, 6) AS {v}_max_w{w}",
                     f"round(min({v}) {frame}, 6) AS {v}_min_w{w}"]
        cols.append(f"round(avg(CASE WHEN coalesce(rn_day > 0, false) THEN 1.0 ELSE 0.0 END) {frame}, 6) AS rain_ratio_w{w}")
    return f"""
WITH {_OBS_SQL},
x AS (SELECT stn, day, CAST(ta_max AS DOUBLE) AS ta_max, CAST(ta_min AS DOUBLE) AS ta_min, CAST(rn_day AS DOUBLE) AS rn_day,
        rhm_avg, ws_davg, CAST(ta_max - ta_min AS DOUBLE) AS temp_range FROM full_d)
SELECT stn, strftime(day, '%Y-%m-%d') AS date, {", ".join(cols)}
FROM x
"""


@register("rolling_weather", _rolling_sql())
def q_rolling_weather(spark, sf_dir):
    d = _daily(spark, sf_dir)
    d = d.select(F.col("stn").cast("int").alias("stn"), "day",
                 *[F.col(v).cast("double").alias(v) for v in DAILY_VARS])
    d = d.withColumn("temp_range", F.col("ta_max") - F.col("ta_min"))
    out = rolling_features(d)
    return round_doubles(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumnRenamed("day", "date"))


MONTHLY_WEATHER_SQL = f"""
WITH {_OBS_SQL}
SELECT stn, strftime(date_trunc('month', day), '%Y-%m') AS month,
  round(avg(ta_max), 6) AS ta_max_month_mean, round(avg(ta_min), 6) AS ta_min_month_mean,
  round(avg(rhm_avg), 6) AS rhm_avg_month_mean, round(avg(ws_davg), 6) AS ws_davg_month_mean,
  CAST(max(ta_max) - min(ta_min) AS DOUBLE) AS temp_span,
  CAST(coalesce(sum(rn_day), 0) AS DOUBLE) AS rn_month_sum
FROM full_d GROUP BY stn, date_trunc('month', day)
"""


@register("monthly_weather", MONTHLY_WEATHER_SQL)
def q_monthly_weather(spark, sf_dir):
    d = _daily(spark, sf_dir).select(F.col("stn").cast("int").alias("stn"), "day",
                                     *[F.col(v).cast("double").alias(v) for v in DAILY_VARS])
    out = monthly_weather(d)
    return round_doubles(out.withColumn("month", F.date_format("month", "yyyy-MM")))

