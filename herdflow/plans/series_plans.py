"""Hourly forecasting data side on ``events``: channel = event_type, hourly
sum of the whole-number part of ``value`` on a dense hour grid.

Split over all hours: half train, a quarter val, the rest test; input 48,
horizon 24.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.operators.series import (autocorr_lags, forecast_scores, hourly_series, instance_denorm,
                                       instance_norm, inverse_standardise, patches, sliding_windows, split_borders,
                                       split_by_position, stamp_features, standardise, window_prompt,
                                       window_stats)
from herdflow.plans.common import round_doubles
from herdflow.plans.registry import register
from herdflow.sources.tables import table

SEQ, PRED = 48, 24
DESCRIPTION = "Hourly event totals per event type."


def _scaled(spark, sf_dir):
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    s = hourly_series(e.withColumn("v", F.floor("value").cast("double")), channel="event_type", ts="ts", value="v")
    # The borders follow the length of the series: one small job over the times.
    hours = e.agg((F.unix_timestamp(F.max(F.date_trunc("hour", "ts")))
                   - F.unix_timestamp(F.min(F.date_trunc("hour", "ts")))).alias("s")).first()["s"]
    n = (hours or 0) // 3600 + 1
    borders = split_borders(SEQ, n // 2, n // 4, n - n // 2 - n // 4)
    s = standardise(s, fit_filter=(F.col("idx") >= borders["train"][0]) & (F.col("idx") < borders["train"][1]))
    return split_by_position(s, borders)


def _windows(spark, sf_dir):
    return sliding_windows(_scaled(spark, sf_dir), seq_len=SEQ, pred_len=PRED, group=("split", "channel"),
                           pos="pos", value="scaled")


def _split_case(col="idx"):
    parts = []
    borders = {"train": ("0", "n_train"), "val": (f"n_train - {SEQ}", "n_train + n_val"),
               "test": (f"n_train + n_val - {SEQ}", "n")}
    for name, (lo, hi) in borders.items():
        parts.append(f"SELECT sc.*, '{name}' AS split, {col} - ({lo}) AS pos FROM sc, bd WHERE {col} >= {lo} AND {col} < {hi}")
    return " UNION ALL ".join(parts)


SCALED_SQL = f"""
  h AS (SELECT event_type AS channel, date_trunc('hour', ts) AS t, sum(floor(value)) AS v FROM events GROUP BY 1, 2),
  b AS (SELECT min(t) AS t0, max(t) AS t1 FROM h),
  grid AS (SELECT c.channel, unnest(generate_series(b.t0, b.t1, INTERVAL 1 HOUR)) AS t, b.t0 FROM (SELECT DISTINCT channel FROM h) c, b),
  s AS (SELECT grid.channel, grid.t, CAST(epoch(grid.t - grid.t0) / 3600 AS INTEGER) AS idx, CAST(coalesce(h.v, 0) AS DOUBLE) AS value
        FROM grid LEFT JOIN h ON grid.channel = h.channel AND grid.t = h.t),
  bd AS (SELECT n, n // 2 AS n_train, n // 4 AS n_val FROM (SELECT max(idx) + 1 AS n FROM s)),
  st AS (SELECT channel, avg(value) AS fit_mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS fit_std
         FROM s, bd WHERE idx < n_train GROUP BY channel),
  sc AS (SELECT s.*, st.fit_mean, st.fit_std, (s.value - st.fit_mean) / st.fit_std AS scaled FROM s LEFT JOIN st USING (channel)),
  sp AS ({_split_case()})"""

WINDOWS_SQL = f"""{SCALED_SQL},
  wl AS (SELECT split, channel, pos AS start,
           list(scaled) OVER (PARTITION BY split, channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SEQ + PRED - 1} FOLLOWING) AS w
         FROM sp),
  win AS (SELECT split, channel, start, w[1:{SEQ}] AS x, w[{SEQ + 1}:{SEQ + PRED}] AS y FROM wl WHERE len(w) = {SEQ + PRED})"""

STANDARDISE_SQL = f"""
WITH {SCALED_SQL}
SELECT channel, split, CAST(pos AS INTEGER) AS pos, strftime(t, '%Y-%m-%d %H:%M') AS t, value,
  round(fit_mean, 6) AS fit_mean, round(fit_std, 6) AS fit_std, round(scaled, 6) AS scaled,
  round(scaled * fit_std + fit_mean, 6) AS restored
FROM sp
"""


@register("standardise", STANDARDISE_SQL)
def q_standardise(spark, sf_dir):
    sc = _scaled(spark, sf_dir)
    sc = inverse_standardise(sc, "scaled", "restored")
    return round_doubles(sc.select("channel", "split", F.col("pos").cast("int").alias("pos"),
                                   F.date_format("t", "yyyy-MM-dd HH:mm").alias("t"), "value",
                                   "fit_mean", "fit_std", "scaled", "restored"))


SLIDING_SQL = f"""
WITH {WINDOWS_SQL}
SELECT split, channel, CAST(start AS INTEGER) AS start, len(x) AS n_x, len(y) AS n_y,
  round(x[1], 6) AS x_first, round(x[{SEQ}], 6) AS x_last, round(list_sum(x), 6) AS x_sum,
  round(y[1], 6) AS y_first, round(y[{PRED}], 6) AS y_last, round(list_sum(y), 6) AS y_sum
FROM win
"""


def _arr_sum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


@register("sliding_windows", SLIDING_SQL)
def q_sliding_windows(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return round_doubles(w.select(
        "split", "channel", F.col("start").cast("int").alias("start"), F.size("x").alias("n_x"),
        F.size("y").alias("n_y"), F.element_at("x", 1).alias("x_first"), F.element_at("x", -1).alias("x_last"),
        _arr_sum(F.col("x")).alias("x_sum"), F.element_at("y", 1).alias("y_first"),
        F.element_at("y", -1).alias("y_last"), _arr_sum(F.col("y")).alias("y_sum")))


NORM_SQL = f"""
  nm AS (SELECT *, list_sum(x) / len(x) AS norm_mean FROM win),
  nv AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - norm_mean) * (v - norm_mean))) / len(x) + 0.00001::DOUBLE) AS norm_stdev FROM nm),
  nx AS (SELECT *, list_transform(x, lambda v: (v - norm_mean) / norm_stdev * 1.0::DOUBLE + 0.0::DOUBLE) AS x_norm FROM nv)"""

INSTANCE_NORM_SQL = f"""
WITH {WINDOWS_SQL}, {NORM_SQL},
rt AS (SELECT *, list_transform(x_norm, lambda v: v * norm_stdev + norm_mean) AS back FROM nx)
SELECT split, channel, CAST(start AS INTEGER) AS start, round(norm_mean, 6) AS norm_mean, round(norm_stdev, 6) AS norm_stdev,
  round(x_norm[1], 6) AS xn_first, round(x_norm[{SEQ}], 6) AS xn_last,
  round(list_max(list_transform(list_zip(back, x), lambda p: abs(p[1] - p[2]))), 12) AS roundtrip_error
FROM rt
"""


def _normed(spark, sf_dir):
    return instance_norm(_windows(spark, sf_dir))


@register("instance_norm", INSTANCE_NORM_SQL)
def q_instance_norm(spark, sf_dir):
    n = instance_denorm(_normed(spark, sf_dir), "x_norm", "back")
    err = F.array_max(F.zip_with("back", "x", lambda a, b: F.abs(a - b)))
    out = round_doubles(n.select("split", "channel", F.col("start").cast("int").alias("start"), "norm_mean",
                                 "norm_stdev", F.element_at("x_norm", 1).alias("xn_first"),
                                 F.element_at("x_norm", -1).alias("xn_last"),
                                 F.struct(err.alias("e")).alias("exact")))
    return out.withColumn("roundtrip_error", F.round(F.col("exact.e"), 12)).drop("exact")


PATCH_LEN, STRIDE = 16, 8

PATCHES_SQL = f"""
WITH {WINDOWS_SQL}, {NORM_SQL},
pd AS (SELECT *, list_concat(x_norm, list_transform(range({STRIDE}), lambda i: x_norm[{SEQ}])) AS padded FROM nx),
pt AS (SELECT *, list_transform(range(CAST(floor((len(padded) - {PATCH_LEN}) / {STRIDE}) AS BIGINT) + 1),
                                lambda i: padded[i * {STRIDE} + 1 : i * {STRIDE} + {PATCH_LEN}]) AS p FROM pd)
SELECT split, channel, CAST(start AS INTEGER) AS start, len(p) AS n_patches, len(p[1]) AS patch_len,
  round(list_sum(p[1]), 6) AS first_patch_sum, round(list_sum(p[len(p)]), 6) AS last_patch_sum
FROM pt
"""


@register("patches", PATCHES_SQL)
def q_patches(spark, sf_dir):
    p = patches(_normed(spark, sf_dir), x="x_norm", patch_len=PATCH_LEN, stride=STRIDE)
    return round_doubles(p.select(
        "split", "channel", F.col("start").cast("int").alias("start"), F.size("patches").alias("n_patches"),
        F.size(F.element_at("patches", 1)).alias("patch_len"),
        _arr_sum(F.element_at("patches", 1)).alias("first_patch_sum"),
        _arr_sum(F.element_at("patches", -1)).alias("last_patch_sum")))


STATS_SQL = f"""
  ws AS (SELECT *, list_min(x_norm) AS w_min, list_max(x_norm) AS w_max,
           list_sort(x_norm)[CAST(floor((len(x_norm) + 1) / 2) AS BIGINT)] AS w_median,
           x_norm[len(x_norm)] - x_norm[1] AS w_trend FROM nx),
  ws2 AS (SELECT *, CASE WHEN w_trend > 0 THEN 'upward' ELSE 'downward' END AS w_direction FROM ws)"""

WINDOW_STATS_SQL = f"""
WITH {WINDOWS_SQL}, {NORM_SQL}, {STATS_SQL}
SELECT split, channel, CAST(start AS INTEGER) AS start, round(w_min, 6) AS w_min, round(w_max, 6) AS w_max,
  round(w_median, 6) AS w_median, round(w_trend, 6) AS w_trend, w_direction
FROM ws2
"""


def _stats(spark, sf_dir):
    return window_stats(_normed(spark, sf_dir), x="x_norm")


@register("window_stats", WINDOW_STATS_SQL)
def q_window_stats(spark, sf_dir):
    s = _stats(spark, sf_dir)
    return round_doubles(s.select("split", "channel", F.col("start").cast("int").alias("start"),
                                  "w_min", "w_max", "w_median", "w_trend", "w_direction"))


LAGS_SQL = f"""
  lg AS (SELECT *, list_transform(
           list_sort(list_transform(range(1, len(x_norm)), lambda l: {{'k': -round(list_sum(list_transform(range(0, len(x_norm)),
               lambda t: x_norm[t + 1] * x_norm[((t + l) % len(x_norm)) + 1])), 9), 'lag': l}}))[1:5],
           lambda s: s.lag) AS lags FROM ws2)"""

AUTOCORR_SQL = f"""
WITH {WINDOWS_SQL}, {NORM_SQL}, {STATS_SQL}, {LAGS_SQL}
SELECT split, channel, CAST(start AS INTEGER) AS start, array_to_string(lags, ',') AS lags FROM lg
"""


def _lagged(spark, sf_dir):
    return autocorr_lags(_stats(spark, sf_dir), x="x_norm", top_k=5, length=SEQ)


@register("autocorr_lags", AUTOCORR_SQL)
def q_autocorr_lags(spark, sf_dir):
    a = _lagged(spark, sf_dir)
    return a.select("split", "channel", F.col("start").cast("int").alias("start"),
                    F.array_join("lags", ",").alias("lags"))


# The reference's own window, over the whole series (no split is long enough).
LONG_SEQ, LONG_PRED = 512, 96

LONG_LAGS_SQL = f"""
WITH {SCALED_SQL},
wl AS (SELECT channel, idx AS start, list(scaled) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND {LONG_SEQ + LONG_PRED - 1} FOLLOWING) AS w FROM sc),
win AS (SELECT channel, start, w[1:{LONG_SEQ}] AS x FROM wl WHERE len(w) = {LONG_SEQ + LONG_PRED}),
{NORM_SQL},
ws2 AS (SELECT * FROM nx),
{LAGS_SQL}
SELECT channel, CAST(start AS INTEGER) AS start, array_to_string(lags, ',') AS lags FROM lg
"""


@register("autocorr_lags_long", LONG_LAGS_SQL)
def q_autocorr_lags_long(spark, sf_dir):
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    s = hourly_series(e.withColumn("v", F.floor("value").cast("double")), channel="event_type", ts="ts", value="v")
    n = e.agg((F.unix_timestamp(F.max(F.date_trunc("hour", "ts")))
               - F.unix_timestamp(F.min(F.date_trunc("hour", "ts")))).alias("s")).first()["s"]
    s = standardise(s, fit_filter=F.col("idx") < ((n or 0) // 3600 + 1) // 2)
    w = sliding_windows(s, seq_len=LONG_SEQ, pred_len=LONG_PRED, group=("channel",), pos="idx", value="scaled")
    a = autocorr_lags(instance_norm(w), x="x_norm", top_k=5, length=LONG_SEQ)
    return a.select("channel", F.col("start").cast("int").alias("start"), F.array_join("lags", ",").alias("lags"))


def _fixed4_sql(e):
    k = f"CAST(round(({e}) * 10000.0::DOUBLE) AS BIGINT)"
    return (f"(CASE WHEN {k} < 0 THEN '-' ELSE '' END || CAST(abs({k}) // 10000 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({k}) % 10000 AS VARCHAR), 4, '0'))")


PROMPT_SQL = f"""
WITH {WINDOWS_SQL}, {NORM_SQL}, {STATS_SQL}, {LAGS_SQL}
SELECT split, channel, CAST(start AS INTEGER) AS start,
  '<|start_prompt|>Dataset description: {DESCRIPTION}Task description: forecast the next {PRED} steps given the previous {SEQ} steps information; Input statistics: min value '
  || {_fixed4_sql('w_min')} || ', max value ' || {_fixed4_sql('w_max')} || ', median value ' || {_fixed4_sql('w_median')}
  || ', the trend of input is ' || w_direction || ', top 5 lags are : [' || array_to_string(lags, ', ') || ']<|<end_prompt>|>' AS prompt
FROM lg
"""


@register("window_prompt", PROMPT_SQL)
def q_window_prompt(spark, sf_dir):
    p = window_prompt(_lagged(spark, sf_dir), description=DESCRIPTION, seq_len=SEQ, pred_len=PRED)
    return p.select("split", "channel", F.col("start").cast("int").alias("start"), "prompt")


TIME_FEATURES_SQL = """
SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
  round(hour(ts) / 23.0::DOUBLE - 0.5::DOUBLE, 6) AS hour_of_day,
  round((isodow(ts) - 1) / 6.0::DOUBLE - 0.5::DOUBLE, 6) AS day_of_week,
  round((day(ts) - 1) / 30.0::DOUBLE - 0.5::DOUBLE, 6) AS day_of_month,
  round((dayofyear(ts) - 1) / 365.0::DOUBLE - 0.5::DOUBLE, 6) AS day_of_year,
  round((weekofyear(ts) - 1) / 52.0::DOUBLE - 0.5::DOUBLE, 6) AS week_of_year,
  round((minute(ts)) / 59.0::DOUBLE - 0.5::DOUBLE, 6) AS minute_of_hour
FROM events
"""


@register("time_features", TIME_FEATURES_SQL)
def q_time_features(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts")
    e = stamp_features(e, "ts", timeenc=0)
    e = stamp_features(e, "ts", timeenc=1, freq="h")
    e = stamp_features(e, "ts", timeenc=1, freq="W")
    e = stamp_features(e, "ts", timeenc=1, freq="15min")
    return round_doubles(e.drop("ts", "second_of_minute", "month_of_year")
                          .withColumns({c: F.col(c).cast("int") for c in ("month", "day", "weekday", "hour")}))


SEASON = 24

FORECAST_SQL = f"""
WITH {WINDOWS_SQL},
pr AS (SELECT channel, x, y, list_transform(range({PRED}), lambda j: x[{SEQ} - {SEASON} + (j % {SEASON}) + 1]) AS p
       FROM win WHERE split = 'test'),
z AS (SELECT channel, unnest(list_transform(list_zip(p, y), lambda q: q[1] - q[2])) AS d FROM pr)
SELECT channel, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae, count(*) AS n_steps FROM z GROUP BY channel
UNION ALL
SELECT 'ALL', round(avg(d * d), 6), round(avg(abs(d)), 6), count(*) FROM z
"""


@register("forecast_error", FORECAST_SQL)
def q_forecast_error(spark, sf_dir):
    w = _windows(spark, sf_dir).filter(F.col("split") == "test")
    w = w.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(PRED - 1)),
                                      lambda j: F.element_at("x", F.lit(SEQ - SEASON + 1) + j % SEASON)))
    per = forecast_scores(w, pred="p", true="y", group=("channel",))
    overall = forecast_scores(w, pred="p", true="y").select(F.lit("ALL").alias("channel"), "mse", "mae", "n_steps")
    return round_doubles(per.unionByName(overall))


# Many channels in, one out: only the target channel is scored.
FORECAST_MS_SQL = f"""
WITH {WINDOWS_SQL},
pr AS (SELECT channel, x, y, list_transform(range({PRED}), lambda j: x[{SEQ} - {SEASON} + (j % {SEASON}) + 1]) AS p
       FROM win WHERE split = 'test'),
z AS (SELECT channel, unnest(list_transform(list_zip(p, y), lambda q: q[1] - q[2])) AS d FROM pr)
SELECT 'last' AS target, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae, count(*) AS n_steps FROM z
WHERE channel = (SELECT max(channel) FROM z)
UNION ALL
SELECT 'click', round(avg(d * d), 6), round(avg(abs(d)), 6), count(*) FROM z WHERE channel = 'click'
"""


@register("forecast_error_ms", FORECAST_MS_SQL)
def q_forecast_error_ms(spark, sf_dir):
    w = _windows(spark, sf_dir).filter(F.col("split") == "test")
    w = w.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(PRED - 1)),
                                      lambda j: F.element_at("x", F.lit(SEQ - SEASON + 1) + j % SEASON)))
    last = forecast_scores(w, pred="p", true="y", features="MS").withColumn("target", F.lit("last"))
    click = forecast_scores(w, pred="p", true="y", features="MS", target="click").withColumn("target", F.lit("click"))
    return round_doubles(last.unionByName(click).select("target", "mse", "mae", "n_steps"))
