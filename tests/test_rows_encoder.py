"""Dense row ids, missing-row filter counts, encoder samples, joins helper."""

import datetime as dt

from pyspark.sql import functions as F

from herdflow.operators import joins, learn, rows


def test_dense_row_id_matches_sorted_order(spark):
    data = [(int(k), f"v{k}") for k in [17, 3, 99, 42, 5, 8, 1, 64, 23, 11] * 3]
    df = spark.createDataFrame([(k * 10 + i, v) for i, (k, v) in enumerate(data)], "k long, v string")
    out = rows.dense_row_id(df, ["k"], "idx").withColumn("rid", rows.format_row_id("idx", "TRAIN"))
    got = sorted((r.k, r.idx) for r in out.collect())
    keys = sorted(r.k for r in df.collect())
    assert got == [(k, i) for i, k in enumerate(keys)]
    assert out.filter(F.col("idx") == 2).first().rid == "TRAIN_000000002"
    chk = rows.id_continuity_violations(out, "idx", "rid", "TRAIN").first()
    assert (chk.id_mismatches, chk.index_gaps) == (0, 0)


def test_drop_rows_with_missing_observation(spark):
    df = spark.createDataFrame([("a", "1"), ("-99", "2"), ("b", " MISSING "), ("c", "3")], "x string, y string")
    kept, obs = rows.drop_rows_with_missing(df, ["x", "y"])
    assert sorted(r.x for r in kept.collect()) == ["a", "c"]
    assert obs.get == {"loaded": 4, "dropped": 2}
    filt = rows.date_floor_filter(spark.createDataFrame([(dt.date(2019, 1, 1), dt.date(2021, 1, 1)),
                                                         (dt.date(2020, 6, 1), dt.date(2021, 1, 1)),
                                                         (None, dt.date(2021, 1, 1))], "b date, e date"),
                                  start="b", end="e", min_start="2020-01-01")
    assert filt.count() == 1
    z = rows.zero_fill(spark.createDataFrame([(None, 1)], "a int, b int"), ["a"]).first()
    assert (z.a, z.b) == (0, 1)


def test_encoder_samples(spark):
    seq = spark.createDataFrame([("s1", t, float(t)) for t in range(6)] + [("s2", 0, 1.0), ("s2", 1, 2.0)],
                                "id string, t int, v double")
    out = {(r.id, r.target_idx): (list(r.encoder), r.target)
           for r in learn.encoder_samples(seq, entity=["id"], time_idx="t", value="v", max_encoder=3).collect()}
    assert out[("s1", 2)] == ([0.0, 1.0], 2.0)
    assert out[("s1", 5)] == ([2.0, 3.0, 4.0], 5.0)
    assert ("s1", 1) not in out and not any(k[0] == "s2" for k in out)


def test_small_helpers(spark):
    from herdflow.operators import quality, series

    df = spark.createDataFrame([(1, 2.0, "a", None, 0), (2, None, "b", 1.5, 3)], "k int, x double, s string, m double, n int")
    assert rows.select_numeric(df, exclude=["k"]).columns == ["x", "m", "n"]
    assert rows.ordered_columns(df, ["s", "zz", "k"]).columns == ["s", "k", "x", "m", "n"]
    assert rows.add_polynomial(df, "x").first().x_sq == 4.0
    agree = quality.null_sample_agreement(df, {"m": "n"}).first()
    assert agree.m_disagree == 0
    ser = spark.createDataFrame([("OT", 1), ("HUFL", 2)], "channel string, v int")
    assert series.select_channels(ser, "S", "OT").count() == 1 and series.select_channels(ser, "M").count() == 2


def test_with_scalars_no_join(spark):
    df = spark.range(5)
    stats = df.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    out = joins.with_scalars(df, stats, total)
    assert out.columns == ["id", "lo", "hi", "n"]
    assert {(r.lo, r.hi, r.n) for r in out.collect()} == {(0, 4, 5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_bounded_broadcast(spark):
    small = spark.range(10).withColumn("x", F.col("id") * 2)
    df, hinted = joins.bounded_broadcast(small, max_bytes=10_000)
    assert hinted and df.count() == 10
    _, hinted = joins.bounded_broadcast(small, max_bytes=10)
    assert not hinted
