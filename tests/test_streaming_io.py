"""Streaming equals batch on closed windows; sinks read back unchanged."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from herdflow.sources import io
from herdflow.streaming.weather_stream import (daily_weather_stream, file_stream, incremental_append,
                                               run_available_now)


def test_stream_equals_batch_on_closed_windows(spark):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h % 17)) for s in (1, 2) for h in range(0, 96, 3)]
    src = spark.createDataFrame(rows, "stn int, ts timestamp, v double")
    path = tempfile.mkdtemp(prefix="herdflow-stream-src-")
    src.write.mode("overwrite").parquet(path)
    spec = {"vmax": "max:v", "vmin": "min:v"}
    out = run_available_now(daily_weather_stream(file_stream(spark, path), ts="ts", stn="stn", value_cols=spec),
                            name="test-stream")
    streamed = {(r.stn, r.window.start.date()): (r.vmax, r.vmin, r.n_obs) for r in spark.read.parquet(out).collect()}
    batch = daily_weather_stream(src, ts="ts", stn="stn", value_cols=spec)
    wm = max(ts for _, ts, _ in rows) - dt.timedelta(hours=2)     # shift (1h) + watermark delay (1h)
    expected = {(r.stn, r.window.start.date()): (r.vmax, r.vmin, r.n_obs)
                for r in batch.collect() if r.window.end <= wm}
    assert streamed == expected and len(expected) > 0


def test_csv_parquet_roundtrip_and_json_flatten(spark):
    df = spark.createDataFrame([(1, "a b", 2.5), (2, "", None)], "id int, s string, x double")
    base = tempfile.mkdtemp(prefix="herdflow-io-")
    io.sink(df, os.path.join(base, "csv"), "csv")
    back = io.read_back(spark, os.path.join(base, "csv"), "csv", schema="id int, s string, x double")
    chk = io.read_back_check(df.na.fill({"s": ""}), back.na.fill({"s": ""})).first()
    assert (chk.written_rows, chk.reread_rows, chk.missing_after_write, chk.extra_after_write) == (2, 2, 0, 0)
    raw = io.scan_csv(spark, os.path.join(base, "csv"), raw_strings=True)
    assert sorted(r.x for r in raw.collect()) == ["", "2.5"]
    import pytest
    with pytest.raises(ValueError):
        io.sink(df, os.path.join(base, "x"), "xlsx")
    nested = spark.createDataFrame([(1, (2, (3,)))], "id int, a struct<b: int, c: struct<d: int>>")
    io.land_json(nested, os.path.join(base, "json"))
    flat = io.scan_json_records(spark, os.path.join(base, "json"), schema="id int, a struct<b: int, c: struct<d: int>>")
    assert flat.columns == ["id", "a.b", "a.c.d"] and tuple(flat.first()) == (1, 2, 3)
    meta = io.file_metadata(spark, os.path.join(base, "csv", "*.csv")).collect()
    assert meta and all(len(m.sha256) == 64 for m in meta)
    assert F is not None


def test_append_goes_on_after_a_restart(spark):
    """Old files may be gone by then: nothing is read twice, nothing is lost."""
    base = tempfile.mkdtemp(prefix="herdflow-append-")
    src, target, counts, progress = (os.path.join(base, x) for x in ("src", "rows", "counts", "progress"))
    write = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental_append(file_stream(spark, src), normalise=lambda b: b.select("id"),
                                     target=target, counts=counts, checkpoint=progress)
    write(0, 10)
    run()
    write(10, 15)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(15))
    assert sorted(r.rows for r in spark.read.parquet(counts).collect()) == [5, 10]


def test_stream_waits_without_a_limit(spark):
    import inspect

    assert inspect.signature(run_available_now).parameters["timeout_s"].default is None
    assert inspect.signature(incremental_append).parameters["timeout_s"].default is None


def test_rows_are_numbered_inside_their_file(spark):
    base = tempfile.mkdtemp(prefix="herdflow-files-")
    sizes = {"a": 2500, "b": 1, "c": 40}
    for name, n in sizes.items():
        with open(os.path.join(base, f"{name}.csv"), "w") as f:
            f.write("k,v\n" + "".join(f"{(i * 7919) % 100003},{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")       # files are read by many tasks
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = io.scan_files(spark, base + "/*.csv", "k long, v long")
        assert rows.rdd.getNumPartitions() > 0
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(r.v == r.row_index for r in got)
    assert {n + ".csv": c for n, c in sizes.items()} == {
        f: sum(r.source_file == f for r in got) for f in {r.source_file for r in got}}

    from herdflow.operators.learn import sample_per_file

    sample = sample_per_file(spark.createDataFrame(got), key=["k"], chunk_rows=1000, per_chunk=30, total=70)
    kept = sample.collect()
    per_chunk = {}
    for r in kept:
        assert r.chunk == r.row_index // 1000
        per_chunk[r.source_file, r.chunk] = per_chunk.get((r.source_file, r.chunk), 0) + 1
    assert all(n <= 30 for n in per_chunk.values())
    assert {f: sum(n for (g, _), n in per_chunk.items() if g == f) for f in ("a.csv", "b.csv", "c.csv")} == {
        "a.csv": 70, "b.csv": 1, "c.csv": 30}
    out = tempfile.mkdtemp(prefix="herdflow-samples-")
    io.sink_per_input(sample, out, "csv")
    folders = sorted(d for d in os.listdir(out) if d.startswith("source_file="))
    assert folders == [f"source_file={n}.csv" for n in "abc"]
    assert all(len([x for x in os.listdir(os.path.join(out, d)) if x.endswith(".csv")]) == 1 for d in folders)


def test_digest_is_the_same_by_parts_and_metadata_comes_back(spark):
    import hashlib

    base = tempfile.mkdtemp(prefix="herdflow-digest-")
    contents = {"empty": b"", "small": b"abc", "exact": b"x" * 1000, "large": os.urandom(5003)}
    for name, data in contents.items():
        with open(os.path.join(base, name), "wb") as f:
            f.write(data)

    def digest(data, part):
        parts = [data[i:i + part] for i in range(0, len(data), part)] or [b""]
        return hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()

    for part in (1000, 10_000):
        found = {os.path.basename(r.path): (r["size"], r.digest) for r in io.file_digests(spark, base + "/*", part).collect()}
        assert found == {n: (len(d), digest(d, part)) for n, d in contents.items() if d}
    record = {"rows": 3, "rule": "A < B", "paths": {"in": base}, "name": "é"}
    io.write_run_metadata(spark, os.path.join(base, "record"), record)
    assert io.read_run_metadata(spark, os.path.join(base, "record")) == record


def test_samples_carry_static_columns_and_all_targets(spark):
    from herdflow.operators.learn import sequence_samples

    rows = [(e, t, e * 100.0 + t, -float(t), "s" + str(e)) for e, n in ((1, 6), (2, 2), (3, 3)) for t in range(n)]
    seq = spark.createDataFrame(rows, "e int, t int, a double, b double, s string").repartition(4)
    got = sequence_samples(seq, entity=["e"], time_idx="t", static=["s"], reals=["b"], targets=["a", "b"], max_encoder=3)
    found = {(r.e, r.target_idx): ([tuple(x) for x in r.encoder], r.a, r.b, r.s, r.encoder_length) for r in got.collect()}
    want = {}
    for e, n in ((1, 6), (2, 2), (3, 3)):
        for t in range(2, n):
            steps = [(u, -float(u), e * 100.0 + u) for u in range(max(0, t - 3), t)]
            want[e, t] = (steps, e * 100.0 + t, -float(t), f"s{e}", len(steps))
    assert found == want


def test_packed_series_give_the_samples_of_exploded_ones(spark, capsys):
    """Repeated entities, unknown stations, months without weather and short ranges."""
    import datetime as dt

    from herdflow.operators import learn

    day = lambda m: dt.date(2020 + m // 12, m % 12 + 1, 5)
    rows = [(i % 17, "abc"[i % 3] if i % 5 else None, day(i % 7), day(i % 7 + i % 11 - 1), f"s{i % 2}") for i in range(24)]
    df = spark.createDataFrame(rows, "e int, stn string, m0 date, m1 date, s string")
    weather = spark.createDataFrame([(x, dt.date(2020 + m // 12, m % 12 + 1, 1), float(m) if m % 4 else None)
                                     for x in "ab" for m in (2, 3, 4, 8, 9)], "stn string, month date, v double")
    args = {"entity": ["e", "s"], "start": "m0", "end": "m1", "station": "stn", "weather": weather, "weather_vars": ["v"]}
    plain = learn.median_impute(learn.monthly_sequence(df, **args), ["v"], {"v": [0.5]})
    packed = learn.monthly_sequence(df, **args, packed=True, fill={"v": 0.5})
    steps = packed.select("e", "s", "stn", F.explode("steps").alias("x")).select("e", "s", "stn", "x.*")
    key = lambda r: str(r)
    assert sorted(map(tuple, steps.collect()), key=key) == sorted(
        map(tuple, plain.select("e", "s", "stn", "time_idx", "v").collect()), key=key)
    sample = {"entity": ["e"], "time_idx": "time_idx", "static": ["s"], "reals": [], "targets": ["v"], "max_encoder": 3}
    want = sorted((str(tuple(r)) for r in learn.sequence_samples(plain, **sample).collect()))
    found = learn.sequence_samples(packed, **sample, steps="steps")
    assert want and sorted(str(tuple(r)) for r in found.collect()) == want
    one = {"entity": ["e", "s"], "time_idx": "time_idx", "value": "v", "max_encoder": 3}
    single, kept = (x.filter("e >= 7 and e < 17") for x in (packed, plain))
    want = sorted((str(tuple(r)) for r in learn.encoder_samples(kept, **one).collect()))
    assert want and sorted(str(tuple(r)) for r in learn.encoder_samples(single, **one, steps="steps").collect()) == want
    # A sample is cut from its series' array: no window, no step is shuffled or sorted.
    learn.encoder_samples(packed, **one, steps="steps").explain()
    assert "Window" not in capsys.readouterr().out


def test_ranges_of_one_station_and_month_lie_together(spark, capsys):
    """Written once by station and first month; the series made of them deal no row again."""
    import datetime as dt

    from herdflow.operators import learn

    rows = [(i, "abcd"[i * 7 % 4] if i % 50 else None, dt.date(2020, 1 + i * 5 % 12, 1 + i % 28), dt.date(2021, 1, 15))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "e int, stn string, m0 date, m1 date")
    dealt = learn.dealt_ranges(df.repartition(8), entity=["e"], start="m0", end="m1", station="stn")
    assert sorted(map(str, dealt.collect())) == sorted(
        map(str, df.selectExpr("e", "stn", "date(trunc(m0, 'MM')) m0", "date(trunc(m1, 'MM')) m1").collect()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = dealt.select("stn", "m0", F.input_file_name().alias("f")).distinct().count()
    pairs = dealt.select("stn", "m0").distinct().count()
    assert files < pairs + parts        # a pair is in a second file only where a range ends
    weather = spark.createDataFrame([(x, dt.date(2020, 1 + m, 1), float(m)) for x in "abc" for m in range(12)],
                                    "stn string, month date, v double")
    series = learn.monthly_sequence(dealt, entity=["e"], start="m0", end="m1", station="stn", weather=weather,
                                    weather_vars=["v"], packed=True, fill={"v": 0.5})
    series.explain()
    assert "hashpartitioning" not in capsys.readouterr().out
