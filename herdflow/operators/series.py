"""Hourly multichannel series: dense grid, positional split, standardisation,
sliding windows, instance normalisation, patching, window statistics,
circular autocorrelation lags, prompt text and forecast scoring.

Sliding windows scale by **blocks with a halo**: positions are cut into
blocks of ``block`` rows per channel; each row is also copied into the
previous block when it can end a window that starts there. Every window is
then assembled inside one bounded (channel, block) partition, so one long
series is spread over many tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdflow.functions.dates import int_time_features, time_features
from herdflow.operators.joins import with_scalars
from herdflow.operators.rows import once


def hourly_series(df: DataFrame, *, channel: str, ts: str, value: str) -> DataFrame:
    """Hourly sums per channel on a dense hour grid (missing hours -> 0) with
    the 0-based position ``idx`` from the global first hour."""
    h = df.select(F.col(channel).alias("channel"), F.date_trunc("hour", F.col(ts)).cast("timestamp").alias("t"),
                  F.col(value).alias("__v"))
    sums = h.groupBy("channel", "t").agg(F.sum("__v").alias("value"))
    bounds = sums.agg(F.min("t").alias("__t0"), F.max("t").alias("__t1"))
    grid = (with_scalars(sums.select("channel").distinct(), bounds)
                .select("channel", "__t0", F.explode(F.sequence("__t0", "__t1", F.expr("INTERVAL 1 HOUR"))).alias("t")))
    out = grid.join(sums, ["channel", "t"], "left")
    idx = ((F.unix_timestamp("t") - F.unix_timestamp("__t0")) / 3600).cast("int")
    return out.select("channel", "t", idx.alias("idx"), F.coalesce(F.col("value"), F.lit(0.0)).cast("double").alias("value"))


def select_channels(series: DataFrame, features: str = "M", target: str = "OT",
                    channel: str = "channel") -> DataFrame:
    """``M``/``MS`` keep every channel, ``S`` only the target channel."""
    if features in ("M", "MS"):
        return series
    if features == "S":
        return series.filter(F.col(channel) == F.lit(target))
    raise ValueError("features must be one of M, MS, S")


def split_borders(seq_len: int, n_train: int, n_val: int, n_test: int, percent: int = 100) -> dict[str, tuple[int, int]]:
    """[start, end) rows of train / val / test; val and test start
    ``seq_len`` earlier; train is shortened by ``percent`` (floor division)."""
    b1 = [0, n_train - seq_len, n_train + n_val - seq_len]
    b2 = [n_train, n_train + n_val, n_train + n_val + n_test]
    b2[0] = (b2[0] - seq_len) * percent // 100 + seq_len
    return {"train": (b1[0], b2[0]), "val": (b1[1], b2[1]), "test": (b1[2], b2[2])}


def split_by_position(series: DataFrame, borders: dict[str, tuple[int, int]], idx: str = "idx") -> DataFrame:
    """One copy of each row per split it falls into, with ``pos`` relative
    to the split start."""
    arr = F.array(*[F.when((F.col(idx) >= lo) & (F.col(idx) < hi),
                           F.struct(F.lit(name).alias("split"), (F.col(idx) - lo).alias("pos")))
                    for name, (lo, hi) in borders.items()])
    return (series.withColumn("__s", F.explode(F.filter(arr, lambda s: s.isNotNull())))
                  .select("*", "__s.split", "__s.pos").drop("__s"))


def standardise(series: DataFrame, *, channel: str = "channel", value: str = "value",
                fit_filter: Column) -> DataFrame:
    """H7: mean and population std of the fit slice per channel, applied to all
    rows (std 0 -> 1). Adds ``scaled``, ``fit_mean`` and ``fit_std``."""
    stats = (series.filter(fit_filter).groupBy(channel)
                   .agg(F.avg(value).alias("fit_mean"), F.stddev_pop(value).alias("__sd")))
    stats = stats.withColumn("fit_std", F.when(F.col("__sd") == 0, F.lit(1.0)).otherwise(F.col("__sd"))).drop("__sd")
    out = series.join(stats, channel, "left")
    return out.withColumn("scaled", (F.col(value) - F.col("fit_mean")) / F.col("fit_std"))


def inverse_standardise(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(col) * F.col("fit_std") + F.col("fit_mean"))


def sliding_windows(series: DataFrame, *, seq_len: int, pred_len: int, group: Sequence[str] = ("channel",),
                    pos: str = "pos", value: str = "value", block: int | None = None) -> DataFrame:
    """Every full window of ``seq_len`` inputs and the next ``pred_len``
    targets, stride 1. Window count per group = n - seq_len - pred_len + 1."""
    span = seq_len + pred_len
    block = block or max(4 * span, 256)
    if block < span:
        raise ValueError("block must be at least seq_len + pred_len")
    b = F.floor(F.col(pos) / block).cast("bigint")
    in_block = F.col(pos) - b * block
    # owners: own block, plus the previous block when this row can end a
    # window starting there (halo of span-1 rows).
    owners = F.when((in_block < span - 1) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    rows = series.select(*group, pos, value, b.alias("__blk"), F.explode(owners).alias("__own"))
    w = Window.partitionBy(*group, "__own").orderBy(pos).rowsBetween(0, span - 1)
    win = rows.withColumn("__w", F.collect_list(value).over(w))
    full = win.filter((F.col("__blk") == F.col("__own")) & (F.size("__w") == span))
    return full.select(*group, F.col(pos).alias("start"),
                       F.slice("__w", 1, seq_len).alias("x"), F.slice("__w", seq_len + 1, pred_len).alias("y"))


def _arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def instance_norm(df: DataFrame, x: str = "x", eps: float = 1e-5, subtract_last: bool = False,
                  affine_weight: float = 1.0, affine_bias: float = 0.0) -> DataFrame:
    """I4 'norm': per window mean (or last value), stdev = sqrt(var_pop + eps),
    optional affine; keeps the statistics as columns for 'denorm'."""
    n = F.size(x)
    mean = _arr_sum(F.col(x)) / n
    out = once(df, mean, "norm_mean")
    var = F.aggregate(F.col(x), F.lit(0.0), lambda acc, v: acc + (v - F.col("norm_mean")) * (v - F.col("norm_mean"))) / n
    out = once(out, F.sqrt(var + F.lit(eps)), "norm_stdev")
    center = F.element_at(F.col(x), -1) if subtract_last else F.col("norm_mean")
    out = once(out, center, "norm_center")
    return once(out, F.transform(
        x, lambda v: (v - F.col("norm_center")) / F.col("norm_stdev") * F.lit(affine_weight) + F.lit(affine_bias)), "x_norm")


def instance_denorm(df: DataFrame, col: str, out: str, eps: float = 1e-5, affine: bool = False,
                    affine_weight: float = 1.0, affine_bias: float = 0.0) -> DataFrame:
    """I4 'denorm' with the stored statistics; the affine step is undone only
    where it is on."""
    plain = lambda v: (v - F.lit(affine_bias)) / F.lit(affine_weight + eps * eps) if affine else v
    return df.withColumn(out, F.transform(col, lambda v: plain(v) * F.col("norm_stdev") + F.col("norm_center")))


def patches(df: DataFrame, x: str = "x", patch_len: int = 16, stride: int = 8, out: str = "patches") -> DataFrame:
    """Repeat the last value ``stride`` times, then cut ``patch_len``
    patches every ``stride``; count = (seq - patch_len) / stride + 2."""
    padded = F.concat(F.col(x), F.array_repeat(F.element_at(F.col(x), -1), stride))
    n_patches = F.floor((F.size(padded) - patch_len) / stride).cast("int") + 1
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), n_patches - 1),
                                          lambda i: F.slice(padded, i * stride + 1, patch_len)))


def window_stats(df: DataFrame, x: str = "x") -> DataFrame:
    """Min, max, lower median, trend (sum of differences) and its sign."""
    n = F.size(x)
    # The sum of first differences telescopes to last - first; the closed form
    # is exact, so a flat window is exactly 0 (downward) on every engine.
    return df.withColumns({
        "w_min": F.array_min(x), "w_max": F.array_max(x),
        "w_median": F.element_at(F.array_sort(x), F.floor((n + 1) / 2).cast("int")),
        "w_trend": F.element_at(F.col(x), -1) - F.element_at(F.col(x), 1),
    }).withColumn("w_direction", F.when(F.col("w_trend") > 0, F.lit("upward")).otherwise(F.lit("downward")))


# Windows of this length and more are transformed instead of summed lag by lag.
FFT_LENGTH = 128


def autocorr_lags(df: DataFrame, x: str = "x", top_k: int = 5, out: str = "lags", length: int | None = None) -> DataFrame:
    """Circular autocorrelation r[l] = sum_t x[t] * x[(t+l) mod T] for
    lags 1..T-1; the ``top_k`` lags by value (ties: value rounded to 1e-9, then
    the smaller lag). Short windows use higher-order functions, O(T^2) each; if
    the windows' ``length`` is known and at least FFT_LENGTH, Arrow batches go
    through one Fourier transform per length, O(T log T)."""
    if length is not None and length >= FFT_LENGTH:
        return autocorr_lags_fft(df, x, top_k, out)
    T = F.size(x)

    def r(lag):
        return F.aggregate(F.sequence(F.lit(0), T - 1), F.lit(0.0),
                           lambda acc, t: acc + F.get(F.col(x), t) * F.get(F.col(x), (t + lag) % T))

    scored = F.transform(F.sequence(F.lit(1), T - 1),
                         lambda lag: F.struct((-F.round(r(lag), 9)).alias("k"), lag.alias("lag")))
    check = F.when(T - 1 < top_k, F.raise_error(F.lit(f"window too short for top_k={top_k}")))
    return df.withColumn(out, F.coalesce(check.cast("array<int>"),
                                         F.transform(F.slice(F.array_sort(scored), 1, top_k), lambda s: s["lag"])))


def autocorr_lags_fft(df: DataFrame, x: str = "x", top_k: int = 5, out: str = "lags") -> DataFrame:
    """I7 for long windows: Arrow-batched pandas UDF over numpy FFT, one
    transform per window length and batch."""
    import numpy as np
    import pandas as pd

    def lags(col):
        if len(col) and col.map(len).min() - 1 < top_k:
            raise ValueError(f"window too short for top_k={top_k}")
        res = pd.Series([None] * len(col), index=col.index, dtype=object)
        for n, same in col.groupby(col.map(len)):        # one call per window length
            f = np.fft.rfft(np.stack(same.to_numpy()).astype(float), axis=1)
            corr = np.fft.irfft(f * np.conj(f), n=n, axis=1)
            corr[:, 1:] = (corr[:, 1:] + corr[:, :0:-1]) / 2     # r[l] = r[T - l] exactly
            order = np.argsort(-np.round(corr[:, 1:], 9), axis=1, kind="stable")
            for at, lags_of in zip(same.index, (order[:, :top_k] + 1).tolist(), strict=True):
                res.at[at] = lags_of
        return res

    # real (not postponed) annotations so Spark infers a scalar pandas UDF
    lags.__annotations__ = {"col": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(lags, "array<int>")(F.col(x)))


def fixed4(c: Column) -> Column:
    """Fixed 4-decimal text from integer arithmetic (engine-independent)."""
    k = F.round(c * F.lit(1e4), 0).cast("bigint")
    sign = F.when(k < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(k)
    return F.concat(sign, (a / 10000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((a % 10000).cast("string"), 4, "0"))


def window_prompt(df: DataFrame, *, description: str, seq_len: int, pred_len: int,
                  lags: str = "lags") -> DataFrame:
    """Natural-language description of one window from I6/I7 output."""
    # The wording of the prompt.
    text = F.concat(
        F.lit(f"<|start_prompt|>Dataset description: {description}"
              f"Task description: forecast the next {pred_len} steps given the previous {seq_len} steps information; "
              "Input statistics: min value "), fixed4(F.col("w_min")),
        F.lit(", max value "), fixed4(F.col("w_max")),
        F.lit(", median value "), fixed4(F.col("w_median")),
        F.lit(", the trend of input is "), F.col("w_direction"),
        F.lit(", top 5 lags are : ["), F.array_join(F.col(lags), ", "), F.lit("]<|<end_prompt>|>"))
    return df.withColumn("prompt", text)


def stamp_features(df: DataFrame, ts: str, timeenc: int = 1, freq: str = "h") -> DataFrame:
    """Integer calendar fields (timeenc 0) or scaled features."""
    feats = int_time_features(ts) if timeenc == 0 else time_features(ts, freq)
    return df.withColumns(feats)


def forecast_scores(df: DataFrame, *, pred: str, true: str, group: Sequence[str] = (), features: str = "M",
                    target: str | None = None, channel: str = "channel") -> DataFrame:
    """Exact global MSE and MAE over every predicted step. ``MS`` (many
    channels in, one out) scores the ``target`` channel only, by default the last."""
    if features == "MS":
        if target is None:
            last = df.agg(F.max(channel).alias("__last"))
            df = with_scalars(df, last).filter(F.col(channel) == F.col("__last")).drop("__last")
        else:
            df = select_channels(df, "S", target, channel)
    elif features not in ("M", "S"):
        raise ValueError("features must be one of M, MS, S")
    pairs = df.select(*group, F.explode(F.arrays_zip(F.col(pred).alias("p"), F.col(true).alias("y"))).alias("__z"))
    d = F.col("__z.p") - F.col("__z.y")
    return pairs.groupBy(*group).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
                                     F.count(F.lit(1)).alias("n_steps"))

