"""Weather operators: observation-text parsing, hourly -> daily aggregation,
station x day completion, row-based rolling features and monthly means.

Rolling features run on the *daily* table (bounded by stations x days), all
100 columns share one ``partitionBy(stn).orderBy(date)`` so Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdflow.functions.dates import hour_to_day
from herdflow.functions.nulls import obs_to_float, round_or_sentinel
from herdflow.operators.joins import with_scalars
from herdflow.operators.rows import once

DAILY_VARS = ["ta_max", "rn_day", "ta_min", "rhm_avg", "ws_davg"]
ROLLING_VARS = ["ta_max", "ta_min", "rn_day", "rhm_avg", "ws_davg", "temp_range"]
ROLLING_WINDOWS = (7, 14, 30, 90)


def parse_observation_lines(lines: DataFrame, text_col: str = "value",
                            time_format: str = "yyyyMMddHHmm", requests: DataFrame | None = None) -> DataFrame:
    """Skip blank and ``#`` lines, strip a trailing backslash, split on
    commas or whitespace; first field = observation time, second = station,
    the rest = numeric values (``""``/-99/-99.0/bad text -> NULL).

    C11: with ``requests`` (columns ``tm``, the time's text, and ``stn``) only
    lines of exactly a requested time and station and of at least three fields
    are kept, by a semi-join before any value is parsed."""
    t = F.regexp_replace(F.trim(F.col(text_col)), r"\\+$", "")
    t = F.trim(t)
    kept = lines.select(t.alias("__line")).filter((F.col("__line") != "") & ~F.col("__line").startswith("#"))
    # Each array is computed once per line: a one-element explode is a
    # generator, which the optimizer does not inline into every consumer
    # (otherwise the split and the value parsing repeat per field).
    parts = once(kept, F.split(F.col("__line"), r"\s*,\s*|\s+"), "__parts")
    if requests is not None:
        wanted = requests.select(F.col("tm").alias("__tm"), F.col("stn").cast("int").alias("__stn"))
        parts = parts.filter(F.size("__parts") >= 3).join(wanted, (F.get("__parts", 0) == F.col("__tm"))
                           & (F.get("__parts", 1).try_cast("int") == F.col("__stn")), "left_semi")
    parsed = parts.select(
        F.try_to_timestamp(F.get("__parts", 0), F.lit(time_format)).alias("tm"),
        F.get("__parts", 1).try_cast("int").alias("stn"),
        F.transform(F.slice("__parts", F.lit(3), F.greatest(F.size("__parts") - 2, F.lit(0))), lambda v: obs_to_float(v)).alias("__values"))
    parsed = once(parsed, F.col("__values"), "values").drop("__values")
    return parsed.filter(F.col("tm").isNotNull() & F.col("stn").isNotNull())


def request_grid(stations: DataFrame, bounds: DataFrame, hours: Sequence[int], stn: str = "stn",
                 time_format: str = "yyyyMMddHHmm") -> DataFrame:
    """C11: (tm, stn) of every station and every one of the ``hours`` of the days
    between the ``start`` and ``end`` of a one-row table."""
    each = F.sequence(F.date_trunc("hour", F.col("start")), F.date_trunc("hour", F.col("end")), F.expr("INTERVAL 1 HOUR"))
    grid = with_scalars(stations.select(F.col(stn).alias("stn")).distinct(), bounds.select("start", "end"))
    grid = grid.select("stn", F.explode(each).alias("t")).filter(F.hour("t").isin(list(hours)))
    return grid.select(F.date_format("t", time_format).alias("tm"), "stn")


def hourly_to_daily(obs: DataFrame, *, stn: str = "stn", tm: str = "tm",
                    values: str = "values") -> DataFrame:
    """Per (station, day) max of TA max (field 4), min of TA
    min (field 6), max cumulative rain (field 2), mean humidity (field 0),
    mean wind (field 10 when >= 0, else field 1 when >= 0). Day = date(t-1h)."""
    v = F.col(values)
    wind = (F.when(F.get(v, 10) >= 0, F.get(v, 10)).when(F.get(v, 1) >= 0, F.get(v, 1)))
    return (obs.select(F.col(stn).alias("stn"), hour_to_day(F.col(tm)).alias("day"),
                       F.get(v, 4).alias("__tmax"), F.get(v, 6).alias("__tmin"), F.get(v, 2).alias("__rn"),
                       F.get(v, 0).alias("__hm"), wind.alias("__ws"))
               .groupBy("stn", "day")
               .agg(F.max("__tmax").alias("ta_max"), F.max("__rn").alias("rn_day"),
                    F.min("__tmin").alias("ta_min"), F.avg("__hm").alias("rhm_avg"),
                    F.avg("__ws").alias("ws_davg")))


def station_day_grid(stations: DataFrame, bounds: DataFrame, stn: str = "stn") -> DataFrame:
    """D16 grid: every requested station gets every day in [start, end].
    ``bounds`` is a one-row scalar (columns ``start``, ``end``) broadcast to the
    station list, then exploded per station (output = stations x days, by
    definition of the operator)."""
    rng = F.sequence(F.col("start"), F.col("end"))
    return (stations.select(F.col(stn).alias("stn")).distinct()
            .transform(lambda s: with_scalars(s, bounds.select("start", "end")))
            .select("stn", F.explode(rng).alias("day")))


def complete_daily(daily: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid left join daily values; a missing day keeps NULLs."""
    return grid.join(daily, ["stn", "day"], "left")


def daily_output(daily: DataFrame) -> DataFrame:
    """B9 + B49: ``y.M.d`` date text and half-even 1-decimal values or -99.0."""
    return daily.select("stn", F.date_format("day", "y.M.d").alias("date"),
                        *[round_or_sentinel(c).alias(c) for c in DAILY_VARS])


def rolling_features(daily: DataFrame, *, stn: str = "stn", date: str = "day",
                     variables: Sequence[str] = ROLLING_VARS,
                     windows: Sequence[int] = ROLLING_WINDOWS, rain: str = "rn_day") -> DataFrame:
    """For each window w: mean, sample std, max, min over the current
    row and the w-1 rows before (row-based; partial windows allowed, NULLs
    ignored) plus the rain-day ratio (NULL rain counts as dry)."""
    base = Window.partitionBy(stn).orderBy(date)
    rain_flag = F.coalesce(F.col(rain) > 0, F.lit(False)).cast("double")
    cols = [F.col(stn), F.col(date)]
    for w in windows:
        frame = base.rowsBetween(-(w - 1), 0)
        for v in variables:
            cols += [F.avg(v).over(frame).alias(f"{v}_mean_w{w}"),
                     F.stddev_samp(v).over(frame).alias(f"{v}_std_w{w}"),
                     F.max(v).over(frame).alias(f"{v}_max_w{w}"),
                     F.min(v).over(frame).alias(f"{v}_min_w{w}")]
        cols.append(F.avg(rain_flag).over(frame).alias(f"rain_ratio_w{w}"))
    return daily.select(*cols)


def monthly_weather(daily: DataFrame, *, stn: str = "stn", date: str = "day",
                    mean_vars: Sequence[str] = ("ta_max", "ta_min", "rhm_avg", "ws_davg"),
                    rain: str = "rn_day") -> DataFrame:
    """B13 + E17: per (station, month) means and rain sum (all-NULL -> 0)."""
    return daily.groupBy(F.col(stn).alias("stn"), F.trunc(F.col(date), "MM").alias("month")).agg(
        *[F.avg(v).alias(f"{v}_month_mean") for v in mean_vars],
        (F.max(F.col("ta_max")) - F.min(F.col("ta_min"))).alias("temp_span"),
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("rn_month_sum"))
