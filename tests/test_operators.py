"""Operators against brute-force pandas / numpy on small fixtures."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdflow.operators import farm, history, learn, lineage, quality, series, weather


# ---------------------------------------------------------------- history

def _history_fixture(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        year = int(rng.integers(2016, 2024))
        month = int(rng.integers(1, 13))
        rows.append((f"P{int(rng.integers(0, 3))}", dt.date(year, month, 15), float(rng.integers(20, 40)),
                     float(rng.integers(1, 100)) if i % 7 else None, ["A", "B", "C"][int(rng.integers(0, 3))]))
    return spark.createDataFrame(rows, "prov string, d date, age double, w double, g string"), rows


def _season(m):
    return "봄" if m in (3, 4, 5) else "여름" if m in (6, 7, 8) else "가을" if m in (9, 10, 11) else "겨울"


def test_history_stats_matches_brute_force(spark):
    hist, rows = _history_fixture(spark)
    main_rows = [(i, p, dt.date(y, m, 1), float(a)) for i, (p, y, m, a) in enumerate(
        itertools.product(["P0", "P1"], [2021, 2024], [2, 8], [25, 33]))]
    main = spark.createDataFrame(main_rows, "id int, prov string, d date, age double")
    out = history.history_stats(main, hist, province="prov", date="d", age="age", numeric_cols=["w"],
                                level_cols={"g": ["A", "B"]}, history_years=5, min_sample_count=5,
                                age_tolerance=3).toPandas().set_index("id")
    pdf = pd.DataFrame(rows, columns=["prov", "d", "age", "w", "g"])
    for i, p, d, a in main_rows:
        sel = pdf[(pdf.prov == p) & pdf.d.map(lambda x: d.year - 5 <= x.year <= d.year - 1)
                  & pdf.d.map(lambda x: _season(x.month) == _season(d.month))
                  & ((pdf.age - a).abs() <= 3)]
        r = out.loc[i]
        assert r.PAST_SAMPLE_COUNT == len(sel)
        if len(sel) >= 5:
            assert r.PAST_AVAILABLE == "YES"
            assert r.PAST_HISTORY_YEARS == sel.d.map(lambda x: x.year).nunique()
            w = sel.w.dropna()
            assert r.PAST_W_MEAN == pytest.approx(w.mean())
            assert r.PAST_W_VARIANCE == pytest.approx(w.var(ddof=1) if len(w) > 1 else 0.0)
            assert r.PAST_G_A_RATIO == pytest.approx((sel.g == "A").mean())
        else:
            assert r.PAST_AVAILABLE == "NO" and pd.isna(r.PAST_W_MEAN) and pd.isna(r.PAST_HISTORY_YEARS)


def test_history_moments_small_cases(spark):
    hist = spark.createDataFrame([("P", dt.date(2020, 5, 1), 30.0, 1.0), ("P", dt.date(2021, 5, 1), 30.0, 3.0)],
                                 "prov string, d date, age double, w double")
    main = spark.createDataFrame([(1, "P", dt.date(2022, 4, 1), 30.0), (2, "P", dt.date(2021, 4, 1), 30.0)],
                                 "id int, prov string, d date, age double")
    out = {r.id: r for r in history.history_stats(main, hist, province="prov", date="d", age="age",
                                                   numeric_cols=["w"], level_cols={}, min_sample_count=1,
                                                   age_tolerance=0).collect()}
    assert out[1].PAST_W_MEAN == 2.0 and out[1].PAST_W_VARIANCE == 2.0 and out[1].PAST_HISTORY_YEARS == 2
    assert out[2].PAST_W_MEAN == 1.0 and out[2].PAST_W_VARIANCE == 0.0       # 2021 itself is excluded


# ---------------------------------------------------------------- lineage

def test_resolve_ancestry_roles(spark):
    cols = lineage.LINEAGE_COLUMNS
    rows = [("c1", "F1", "M1", "g1", "h1", None, None),
            ("c2", "F1", "M2", "g1", "h1", "x", "y"),
            ("c3", "F2", "M3", "g2", "h2", None, None),
            ("c4", "F2", "X", "g9", "h2", None, None),       # conflict for F2
            ("c5", "B", "M4", None, None, None, None),
            ("c6", "Q", "B", None, None, "m1", "m2")]         # B in both roles
    lin = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    main = spark.createDataFrame([("c1",), ("F1",), ("F2",), ("B",), ("M2",), ("zz",)], "id string")
    got = {r.id: (r.LINEAGE_FATHER_NO, r.LINEAGE_MOTHER_NO)
           for r in lineage.resolve_ancestry(main, lin, id_col="id").collect()}
    assert got == {"c1": ("F1", "M1"), "F1": ("g1", "h1"), "F2": (None, None), "B": (None, None),
                   "M2": ("x", "y"), "zz": (None, None)}


def test_offspring_by_year_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", f"p{int(rng.integers(0, 5))}", int(rng.integers(2018, 2023)) if i % 9 else None)
            for i in range(120)]
    ch = spark.createDataFrame(rows, "child string, father string, y int")
    years = lineage.target_years((ch, "y"))
    out = lineage.offspring_by_year(ch, child="child", year="y", roles={"FATHER": "father"}, years=years).toPandas()
    pdf = pd.DataFrame(rows, columns=["child", "father", "y"])
    for _, r in out.iterrows():
        exp = pdf[(pdf.father == r.LINEAGE_NO) & pdf.y.notna() & (pdf.y < r.TARGET_YEAR)].child.nunique()
        assert r.PAST_OFFSPRING_COUNT == exp
    assert len(out) == pdf.father.nunique() * pdf.y.dropna().nunique()


def test_lookup_default_and_impute(spark):
    main = spark.createDataFrame([("a", 2020), ("b", 2020), (None, 2020)], "k string, y int")
    lk = spark.createDataFrame([("a", 2020, 5)], "k2 string, y2 int, v int")
    got = {r.k: r.out for r in lineage.lookup_with_default(main, lk, keys=[("k", "k2"), ("y", "y2")],
                                                           value="v", out="out").collect()}
    assert got == {"a": 5, "b": 0, None: None}
    reduced = {r.k: r.out for r in lineage.lookup_with_default(main, lk, keys=[("k", "k2"), ("y", "y2")],
                                                               value="v", out="out", reduce_lookup=True).collect()}
    assert reduced == got
    rows = spark.createDataFrame([("f", 2020, 1.0), ("f", 2020, 2.0), ("f", 2020, 4.0), ("f", 2020, None),
                                  ("g", 2020, None), ("g", 2020, 1.0)], "farm string, y int, v double")
    means = lineage.farm_year_means(rows, farm="farm", year="y", values=["v"])
    out = lineage.impute_from_group_year(rows, means, farm="farm", year="y", value="v").collect()
    filled = sorted((r.farm, r.v, r.v_IMPUTED) for r in out if r.v_IMPUTED == "YES")
    assert filled == [("f", round(7 / 3, 4), "YES")]
    assert sum(1 for r in out if r.v is None) == 1          # g has only one sample


# ---------------------------------------------------------------- farm

def test_gap_fill_rules(spark):
    df = spark.createDataFrame([(10.0, None, 20.0), (None, 5.0, 20.0), (None, 7.0, None), (None, None, None)],
                               "a double, b double, c double")
    got = [tuple(r) for r in farm.gap_fill_three(df, "a", "b", "c").collect()]
    assert got == [(10.0, 15.0, 20.0), (0.0, 5.0, 20.0), (7.0, 7.0, 7.0), (None, None, None)]


def test_area_lookup_group_overwrite(spark):
    area = spark.createDataFrame([("f1", 100.0, 10.0), ("f1", 100.0, 5.0), ("f2", -1.0, 3.0), ("f3", 50.0, None)],
                                 "farm string, area double, avg double")
    cand = spark.createDataFrame([("G", "HIGH", "f2"), ("G", "medium", "f3"), ("G", "HIGH", "f9"), ("H", "LOW", "f1")],
                                 "grp string, strength string, farm string")
    got = {r.farm: (r.FARM_AVG_HANWOO_COUNT, r.FARM_AREA, r.HANWOO_DENSITY)
           for r in farm.farm_area_lookup(area, cand, farm="farm", area_col="area", avg_col="avg", group="grp",
                                          strength="strength", validate=True).collect()}
    assert got["f1"] == (15.0, 100.0, 0.15)
    assert got["f2"] == got["f3"] == got["f9"] == (3.0, 50.0, 0.06)


# ---------------------------------------------------------------- series

def _series_df(spark, n=300, channels=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"c{c}", i, float(rng.normal())) for c in range(channels) for i in range(n)]
    return spark.createDataFrame(rows, "channel string, pos int, value double"), rows


def test_sliding_windows_block_halo(spark):
    df, rows = _series_df(spark)
    out = series.sliding_windows(df, seq_len=20, pred_len=7, block=40).toPandas()
    assert len(out) == (300 - 20 - 7 + 1) * 2
    vals = {(c, i): v for c, i, v in rows}
    for _, r in out.sample(25, random_state=0).iterrows():
        assert list(r.x) == [vals[(r.channel, r.start + k)] for k in range(20)]
        assert list(r.y) == [vals[(r.channel, r.start + 20 + k)] for k in range(7)]


def test_golden_window_counts():
    b = series.split_borders(512, 12 * 30 * 24, 4 * 30 * 24, 4 * 30 * 24)
    n_train = b["train"][1] - b["train"][0]
    n_val = b["val"][1] - b["val"][0]
    assert (n_train - 512 - 96 + 1) * 7 == 56231
    assert (n_val - 512 - 96 + 1) * 7 == 19495


def test_norm_patches_stats_lags(spark):
    rng = np.random.default_rng(5)
    xs = [rng.normal(size=48).round(3).tolist() for _ in range(6)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x array<double>")
    n = series.instance_denorm(series.instance_norm(df), "x_norm", "back")
    n = series.patches(n, x="x_norm", patch_len=16, stride=8)
    n = series.autocorr_lags(series.window_stats(n, x="x_norm"), x="x_norm")
    n = series.autocorr_lags_fft(n, x="x_norm", out="lags_fft")
    for r in n.collect():
        x = np.array(xs[r.id])
        xn = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
        assert np.allclose(r.back, x) and np.allclose(r.x_norm, xn)
        assert len(r.patches) == (48 - 16) // 8 + 2 and len(r.patches[0]) == 16
        assert r.w_median == pytest.approx(np.sort(xn)[(48 - 1) // 2])
        corr = np.fft.irfft(np.fft.rfft(xn) * np.conj(np.fft.rfft(xn)), n=48)
        order = np.lexsort((np.arange(1, 48), -np.round(corr[1:], 9)))
        assert list(r.lags) == (order[:5] + 1).tolist() == list(r.lags_fft)


# ---------------------------------------------------------------- weather

def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(11)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(rng.integers(0, 30)),
             float(rng.integers(-10, 5)), float(rng.integers(0, 3)) if d % 5 else None, 50.0, 2.0)
            for s in (1, 2) for d in range(40)]
    cols = ["stn", "day", "ta_max", "ta_min", "rn_day", "rhm_avg", "ws_davg"]
    df = spark.createDataFrame(rows, "stn int, day date, ta_max double, ta_min double, rn_day double, "
                                     "rhm_avg double, ws_davg double").withColumn("temp_range", F.col("ta_max") - F.col("ta_min"))
    out = weather.rolling_features(df, windows=(7,)).toPandas().sort_values(["stn", "day"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=cols).sort_values(["stn", "day"]).reset_index(drop=True)
    g = pdf.groupby("stn")
    exp_mean = g["ta_max"].transform(lambda x: x.rolling(7, min_periods=1).mean())
    exp_std = g["rn_day"].transform(lambda x: x.rolling(7, min_periods=1).std())
    exp_rain = (pdf.rn_day > 0).astype(float).groupby(pdf.stn).transform(lambda x: x.rolling(7, min_periods=1).mean())
    assert np.allclose(out.ta_max_mean_w7, exp_mean)
    assert np.allclose(out.rn_day_std_w7.astype(float), exp_std, equal_nan=True)
    assert np.allclose(out.rain_ratio_w7, exp_rain)


def test_observation_parsing_and_daily(spark):
    lines = ["# comment", "", "202401050100 5 60 1 2 0 10 0 -5 0 0 0 3 \\", "202401050200,5,70,1,4,0,12,0,-7,0,0,0,-1",
             "202401060000 5 -99 2 9 0 8 0 -2 0 0 0 -99"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    obs = weather.parse_observation_lines(df)
    daily = {r.day: r for r in weather.hourly_to_daily(obs).collect()}
    d = daily[dt.date(2024, 1, 5)]
    # the 00:00 line of the 6th covers 23:00-24:00 of the 5th (rain 9, wind
    # falls back to field 1 when field 10 is missing or negative)
    assert (d.ta_max, d.ta_min, d.rn_day, d.rhm_avg, d.ws_davg) == (12.0, -7.0, 9.0, 65.0, 2.0)
    assert len(daily) == 1


# ---------------------------------------------------------------- learning data

def test_group_folds_contract(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 60)), ["a", "b", "c"][int(rng.integers(0, 3))]) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, y string")
    out = learn.group_folds(df, group="g", label="y", n_folds=5, seed=42).toPandas()
    assert out.groupby("g").fold.nunique().max() == 1
    assert set(out.fold) == {0, 1, 2, 3, 4}


def test_quantile_bins_like_qcut(spark):
    vals = [float(v) for v in np.random.default_rng(4).integers(0, 50, size=500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.b for r in learn.quantile_bins(df, "x", "b", q=10).collect()]
    exp = pd.qcut(pd.Series(vals), 10, labels=False, duplicates="drop").tolist()
    assert got == exp


def test_median_impute_and_label_encode(spark):
    df = spark.createDataFrame([(1.0, None, "b"), (3.0, None, None), (None, None, "a"), (10.0, None, "b")],
                               "x double, y double, s string")
    out = learn.median_impute(df, ["x", "y"]).collect()
    assert [r.x for r in out] == [1.0, 3.0, 3.0, 10.0] and all(r.y == 0.0 for r in out)
    codes = {r.s: r.c for r in learn.label_encode(df, "s", "c").collect()}
    assert codes == {"a": 0, "b": 1, None: 2}       # NULL encodes as the text 'nan'


def test_classification_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "t int, p int")
    rep = {r.cls: r for r in learn.classification_report(df, truth="t", pred="p").collect()}
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == 1.0
    assert rep["2"].f1 == 0.0 and rep["macro"].support == 5


# ---------------------------------------------------------------- contracts

def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    row = quality.key_violations(df, ["k"]).first()
    assert (row.null_key_rows, row.duplicate_keys, row.duplicate_rows) == (1, 1, 2)
    with pytest.raises(quality.ContractError):
        quality.require_unique_key(df, ["k"])
    with pytest.raises(quality.ContractError):
        quality.require_columns(df, ["k", "missing"])
    prof = {r.column_name: r.n_missing for r in quality.missing_profile(df).collect()}
    assert prof == {"k": 1, "v": 0}
    before = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    after = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id int, v string")
    r = quality.row_preservation(before, after, ["id"], ["v"]).first()
    assert (r.missing_rows, r.extra_rows, r.changed_rows) == (0, 1, 1)


def test_imputation_needs_a_known_farm_and_year(spark):
    rows = spark.createDataFrame([(1, "a", 2020, 2.0), (2, "a", 2020, 4.0), (3, "a", 2020, 6.0), (4, "a", 2020, None),
                                  (5, None, 2020, 6.0), (6, None, 2020, 6.0), (7, None, 2020, 6.0),
                                  (8, None, 2020, None), (9, "a", None, None)], "i int, farm string, y int, v double")
    means = lineage.farm_year_means(rows, farm="farm", year="y", values=["v"])
    out = {r.i: (r.v, r.v_IMPUTED) for r in
           lineage.impute_from_group_year(rows, means, farm="farm", year="y", value="v").collect()}
    assert out[4] == (4.0, "YES") and out[8] == (None, "NO") and out[9] == (None, "NO")


def test_history_counts_more_years_than_a_word_has_bits(spark):
    from herdflow.operators.history import history_year_counts

    rows = spark.createDataFrame([("p", f"{y}-06-01", 30.0) for y in range(1900, 2000)], "p string, d string, a double")
    out = history_year_counts(rows.withColumn("d", F.to_date("d")), province="p", date="d", age="a", history_years=80,
                              age_tolerance=0)
    got = {r["__target_year"]: r.history_years for r in out.collect()}
    assert got[2000] == 80 and got[1950] == 50 and got[1901] == 1


def test_observation_lines_keep_every_field(spark):
    from herdflow.operators.weather import parse_observation_lines

    line = "202401010100 108 " + " ".join(str(i) for i in range(1500))
    got = parse_observation_lines(spark.createDataFrame([(line,), ("202401010100 108",)], "value string")).collect()
    assert sorted(len(r["values"]) for r in got) == [0, 1500]


def test_frequency_of_mostly_missing_values(spark):
    df = spark.createDataFrame([(i, None if i % 4 else "x", "y" if i % 3 else None) for i in range(40)],
                               "i int, a string, b string")
    got = {r.i: (r.a_freq, r.b_freq) for r in lineage.frequency_encode(df, ["a", "b"]).collect()}
    assert len(got) == 40 and got[0] == (10, None) and got[1] == (None, 26) and got[4] == (10, 26)


def test_farm_in_two_integrated_groups_is_refused(spark):
    from herdflow.operators.quality import ContractError

    cand = spark.createDataFrame([("g1", "f1", "HIGH"), ("g2", "f1", "MEDIUM"), ("g1", "f2", "HIGH")],
                                 "g string, f string, s string")
    members = farm.integrated_members(cand, group="g", farm="f", strength="s")
    with pytest.raises(ContractError):
        farm.check_single_group(members)
    farm.check_single_group(members.filter("__farm = 'f2'"))


def test_history_variance_of_large_values(spark):
    """Values near 10^9 with variance 1: no digit is lost, and nothing is negative."""
    rng = np.random.default_rng(5)
    rows, values = [], []
    for i in range(600):
        x = 1e9 + float(rng.normal(0, 1)) if i % 3 else 1e9 + 0.25
        rows.append(("P", dt.date(2015 + i % 5, 4, 1), float(30 + i % 9), x, 2.0e9))
        values.append(x)
    hist = spark.createDataFrame(rows, "prov string, d date, age double, w double, same double").repartition(7)
    main = spark.createDataFrame([("P", dt.date(2020, 4, 1), 34.0)], "prov string, d date, age double")
    r = history.history_stats(main, hist, province="prov", date="d", age="age", numeric_cols=["w", "same"], level_cols={},
                              history_years=5, min_sample_count=5, age_tolerance=12).first()
    want = np.var(np.array(values) - 1e9, ddof=1)
    assert r.PAST_SAMPLE_COUNT == 600 and abs(r.PAST_W_VARIANCE / want - 1) < 1e-6
    assert r.PAST_SAME_VARIANCE == 0.0 and r.PAST_SAME_MEAN == 2.0e9


def test_row_guard_names_the_step_that_changed_rows(spark):
    from herdflow.operators.joins import materialize

    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 else "x") for i in range(300)], "id long, v double, s string")
    lookup = spark.createDataFrame([(float(i), i) for i in range(7)], "v double, extra int")

    def build(twice):
        guard = quality.RowGuard(["id", "v", "s"])
        out = guard.watch(df, "load")
        out = guard.watch(out.repartition(3).join(lookup, "v", "left"), "lookup")
        if twice:
            out = out.join(spark.createDataFrame([(2.0, 1), (2.0, 2)], "v double, again int"), "v", "left")
        out = guard.watch(out, "second lookup")
        return guard, materialize(out.withColumn("s", F.lit("y")) if twice is None else out)

    guard, written = build(False)
    guard.require(df, written)
    assert guard.changed_steps() == []
    guard, written = build(True)
    assert guard.changed_steps() == ["second lookup"]
    with pytest.raises(quality.ContractError, match="second lookup"):
        guard.require(df, written)
    empty = df.filter("id < 0")
    assert quality.same_rows(empty, empty, ["id"]).first().same_rows
    swapped = df.withColumn("v", F.when(F.col("id") == 1, 2.0).when(F.col("id") == 2, 1.0).otherwise(F.col("v")))
    assert not quality.same_rows(df, swapped, ["id", "v"]).first().same_rows


def test_build_reports_the_run_that_wrote(spark):
    from herdflow.plans.builder_plans import _feature_table
    from herdflow.sources.tables import table

    from .conftest import SF_SMALL

    report = {}
    _feature_table(spark, SF_SMALL, "TRAIN", report)
    li = table(spark, SF_SMALL, "lineitem", "l_linenumber")
    n, dropped = li.agg(F.count(F.lit(1)), F.count_if(F.col("l_linenumber") == 7)).first()
    assert (report["loaded"], report["dropped"], report["rows"]) == (n, dropped, n - dropped)
    assert report["steps"][0] == "row filter" and report["steps"][-1] == "past history" and len(report["steps"]) == 8


# ------------------------------------------------------- observations, recounts, lags

def test_observation_lines_of_requested_times_only(spark):
    lines = ["202401010100 3 1 2", "202401010200 3 1 2", "202401010100 4 1 2", "202401010100 3", "# 202401010100 3 1 2",
             "202401010100, 3, 5, -99 \\", "2024010101 3 1 2", "202401010100 x 1 2", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    wanted = spark.createDataFrame([("202401010100", 3), ("202401010100", 5), ("202401010100", 3)], "tm string, stn int")
    found = weather.parse_observation_lines(df, requests=wanted).collect()
    assert sorted((r.tm.hour, r.stn, r["values"]) for r in found) == [(1, 3, [1.0, 2.0]), (1, 3, [5.0, None])]
    assert weather.parse_observation_lines(df).count() == 5
    bounds = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 2, 0))], "start timestamp, end timestamp")
    grid = weather.request_grid(spark.createDataFrame([(1,), (2,), (1,)], "stn int"), bounds, [0, 1, 23])
    assert sorted((r.tm, r.stn) for r in grid.collect()) == sorted(
        (t, s) for s in (1, 2) for t in ("202401010100", "202401012300", "202401020000"))


def test_recount_finds_a_damaged_last_year(spark):
    children = spark.createDataFrame([("c1", 2019, "f1"), ("c1", 2018, "f1"), ("c2", 2020, "f1"), ("c3", 2021, "f2"),
                                      ("c4", None, "f3"), ("c5", 2018, None)], "c string, y int, f string")
    years = lineage.target_years((spark.createDataFrame([(2019,), (2020,), (2021,)], "y int"), "y"))
    counts = lineage.offspring_by_year(children, child="c", year="y", roles={"FATHER": "f"}, years=years)
    args = {"child": "c", "year": "y", "roles": {"FATHER": "f"}}
    r = quality.recount_last_year(children, counts, **args).first()
    assert (r.ROLE, r.parents, r.mismatches) == ("FATHER", 3, 0)
    last = (F.col("TARGET_YEAR") == 2021) & (F.col("LINEAGE_NO") == "f1")
    wrong = counts.withColumn("PAST_OFFSPRING_COUNT", F.col("PAST_OFFSPRING_COUNT") - last.cast("long"))
    assert quality.recount_last_year(children, wrong, **args).first().mismatches == 1
    gone = counts.filter("LINEAGE_NO <> 'f3'")
    assert quality.recount_last_year(children, gone, **args).first().mismatches == 1
    early = counts.withColumn("PAST_OFFSPRING_COUNT", F.col("PAST_OFFSPRING_COUNT") + (F.col("TARGET_YEAR") == 2019).cast("long"))
    assert quality.recount_last_year(children, early, **args).first().mismatches == 0


def test_imputable_rows_equals_the_rows_that_imputation_fills(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 12)) if i % 11 else None, int(rng.integers(2018, 2021)) if i % 13 else None,
             float(rng.integers(0, 9)) if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, farm long, year int, v double")
    members = spark.createDataFrame([("1", "g"), ("2", "g"), ("3", "h")], "__farm string, __group string")
    for m in (None, members):
        means = lineage.farm_year_means(df, farm="farm", year="year", values=["v"], members=m)
        filled = lineage.impute_from_group_year(df, means, farm="farm", year="year", value="v", members=m, min_samples=5)
        n = lineage.imputable_rows(df, farm="farm", year="year", values={"n": "v"}, members=m, min_samples=5).first().n
        assert n == filled.filter("v_IMPUTED = 'YES'").count() > 0
    assert lineage.imputable_rows(df.filter("id < 0"), farm="farm", year="year", values={"n": "v"}).first().n == 0


def test_long_windows_are_transformed(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 160)]) for i in range(6)] + [(6, [1.0, -1.0] * 80)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    direct = {r.id: r.lags for r in series.autocorr_lags(df).collect()}
    chosen = series.autocorr_lags(df, length=160)
    assert "ArrowEvalPython" in chosen._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.lags for r in chosen.collect()} == direct and direct[6] == [2, 4, 6, 8, 10]
    assert "ArrowEvalPython" not in series.autocorr_lags(df, length=48)._jdf.queryExecution().executedPlan().toString()


def test_first_known_value_and_area_contracts(spark):
    rows = [(1, 3, 5.0), (1, 1, None), (1, 2, 7.0), (2, 1, None), (3, 9, 0.0)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    assert {r.k: r.x for r in farm.first_known(df, key="k", value="v", order=["o"], out="x").collect()} == {1: 7.0, 2: None, 3: 0.0}
    area = lambda rows: spark.createDataFrame(rows, "f string, a double, n double")
    cand = spark.createDataFrame([("1", "g", "HIGH"), ("2", "g", "HIGH")], "f string, g string, s string")
    args = {"farm": "f", "area_col": "a", "avg_col": "n", "group": "g", "strength": "s"}
    farm.farm_area_lookup(area([("1", 5.0, 1.0), ("1", 5.0, 2.0), ("2", 5.0, 1.0), ("3", 9.0, 1.0)]), cand, **args).collect()
    for bad, text in (([("3", 5.0, 1.0), ("3", 6.0, 1.0)], "farms"), ([("1", 5.0, 1.0), ("2", 6.0, 1.0)], "groups")):
        with pytest.raises(quality.ContractError, match=text):
            farm.farm_area_lookup(area(bad), cand, **args)


def test_scores_of_the_last_channel_only(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], [1.0, 4.0]), ("b", [0.0], [3.0])], "channel string, p array<double>, y array<double>")
    score = lambda **k: tuple(series.forecast_scores(df, pred="p", true="y", **k).first())
    assert score() == (13 / 3, 5 / 3, 3) and score(features="MS") == (9.0, 3.0, 1)
    assert score(features="MS", target="a") == (2.0, 1.0, 2)
    with pytest.raises(ValueError):
        score(features="X")


def test_weighted_quantiles_equal_repeated_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 30)) if i % 6 else None, int(rng.integers(1, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "x double, n int")
    each = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    probs = [0.0, 0.1, 0.5, 0.83, 1.0]
    assert learn.exact_quantiles(df, "x", probs, weight="n") == learn.exact_quantiles(each, "x", probs)


def test_offspring_of_repeated_and_unknown_children(spark):
    """Children on several rows, in several years and without an id count once per parent."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2]), rng.choice([None, 7, 8]), rng.choice([None, 2001, 2002, 2003]))
            for _ in range(150)] + [(1000 + i, 1, 7, 2001) for i in range(30)]
    ch = spark.createDataFrame(rows, "c long, f long, m long, y int")
    years = spark.createDataFrame([([2001, 2002, 2003, 2004],)], "__years array<int>")
    found = lineage.offspring_by_year(ch, child="c", year="y", roles={"FATHER": "f", "MOTHER": "m"}, years=years)
    first = {}
    for c, f, m, y in rows:
        for role, p in (("FATHER", f), ("MOTHER", m)):
            if p is not None:
                known = [x for x in (first.get((role, p, c)), y) if x is not None]
                first[role, p, c] = min(known) if known else None
    want = {(role, str(p), t): sum(1 for (r2, p2, _), y in first.items() if (r2, p2) == (role, p) and y is not None and y < t)
            for role, p, _ in first for t in (2001, 2002, 2003, 2004)}
    assert {(r.ROLE, r.LINEAGE_NO, r.TARGET_YEAR): r.PAST_OFFSPRING_COUNT for r in found.collect()} == want


def test_rows_are_summed_before_they_meet_their_groups(spark, capsys):
    rows = spark.createDataFrame([(i, i % 5, 2000 + i % 2, None if i % 3 == 0 else float(i)) for i in range(60)],
                                 "i long, farm long, year int, v double")
    members = spark.createDataFrame([("1", "g"), ("2", "g")], "__farm string, __group string")
    means = lineage.farm_year_means(rows, farm="farm", year="year", values=["v"], members=members)
    counts = lineage.imputable_rows(rows, farm="farm", year="year", values={"n": "v"}, members=members)
    for df in (means, counts):
        df.explain("extended")
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert plan.index("Join") < plan.rindex("Aggregate")
    want = {}
    for i in range(60):
        key = ("GROUP:g" if i % 5 in (1, 2) else f"FARM:{i % 5}", 2000 + i % 2)
        want.setdefault(key, []).extend([float(i)] if i % 3 else [])
    got = {(r["__key"], r["__year"]): (r.v_MEAN, r.v_SAMPLE_COUNT) for r in means.collect()}
    assert got == {k: (sum(v) / len(v) if v else None, len(v)) for k, v in want.items()}
    # Rows that cannot be filled are not joined: a row with a value is no row of the join's left side.
    filled = lineage.impute_from_group_year(rows, means, farm="farm", year="year", value="v", members=members)
    filled.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.index("Union") < plan.index("Join") and "isnull(v" in plan
    assert filled.count() == 60 and filled.filter("v_IMPUTED = 'YES'").count() == counts.first().n


def test_training_rows_carry_only_what_was_loaded(spark, monkeypatch, capsys):
    """Ids, seasons and parents' names are added after the rows were dealt; orders meet farms first."""
    from herdflow.operators import builder
    from herdflow.plans import builder_plans
    from herdflow.plans.common import animals

    written = {}
    write = builder.materialize
    monkeypatch.setattr(builder, "materialize", lambda df, name: write(written.setdefault(name, df), name))
    report = {}
    out = builder_plans._feature_table(spark, "/root/testdata/sf0.001", "TRAIN", report)
    assert {"DATA_ROW_ID", "ABATT_SEASON", "BIRTH_SEASON", "LINEAGE_FATHER_NO", "FATHER_PAST_OFFSPRING_COUNT"} <= set(out.columns)
    stage = set(written["training-stage"].columns)
    assert not stage & {"DATA_ROW_ID", "ABATT_SEASON", "BIRTH_SEASON", "LINEAGE_FATHER_NO", "CATTLE_NO", "father", "death_farm"}
    assert set(builder_plans.KEY) <= stage and report["rows"] == report["loaded"] - report["dropped"] == out.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        animals(spark, "/root/testdata/sf0.001").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert "l_orderkey" in joins[0] and not any("l_orderkey" in line for line in joins[1:])
