import random

import pytest
from pyspark.sql import functions as F

from meterflow.operators.counters import (
    carry_in,
    counter_delta,
    counter_rollup,
    daily_counter_rollup,
    group_5min,
    with_deltas,
)
from meterflow.operators.ordered import moving_avg, plain_delta, positions, prev_row
from meterflow.operators.readings import device_rollup, pivot_readings
from meterflow.operators.series import align_left

STEP = "1 minute"


def raw(spark, data):
    """(series, time, counter, current)"""
    df = spark.createDataFrame(data, "series string, t string, cumul bigint, curr bigint")
    return df.select("series", F.col("t").cast("timestamp_ntz").alias("ts"), "cumul", "curr")


def rolled(df, keys=("series",)):
    return counter_rollup(df, keys, "ts", STEP, {"peak": "curr"}, {"cumul": "cumul"})


def used(df, **options):
    return counter_delta(rolled(df), ["series"], "gts", STEP, {"use": "cumul"}, **options)


def test_rollup_and_gaps(spark, rows):
    df = raw(
        spark,
        [
            ("a", "2024-01-01 00:00:10", 100, 5),
            ("a", "2024-01-01 00:00:50", 110, 9),
            ("a", "2024-01-01 00:01:00", 120, 1),  # on the edge: next bucket
            ("a", "2024-01-01 00:03:30", 150, 2),  # one bucket is missing before it
            ("a", "2024-01-01 00:04:30", 140, 2),  # the counter was reset
            ("b", "2024-01-01 00:01:20", 7, None),
        ],
    )
    assert rows(used(df), "series", "gts", "cnt", "peak", "cumul", "use", "prev_gts") == [
        ("a", "2024-01-01 00:01:00", 2, 9, 110, None, None),
        ("a", "2024-01-01 00:02:00", 1, 1, 120, 10, "2024-01-01 00:01:00"),
        ("a", "2024-01-01 00:04:00", 1, 2, 150, None, None),
        ("a", "2024-01-01 00:05:00", 1, 2, 140, -10, "2024-01-01 00:04:00"),
        ("b", "2024-01-01 00:02:00", 1, None, 7, None, None),
    ]


def test_missing_previous_counter(spark, rows):
    df = raw(spark, [("a", "2024-01-01 00:00:10", None, 5), ("a", "2024-01-01 00:01:10", 8, 5)])
    assert [r[1] for r in rows(used(df), "gts", "use")] == [None, None]
    assert [r[1] for r in rows(used(df, null_prev="reference"), "gts", "use")] == [None, 9]
    with pytest.raises(ValueError):
        used(df, null_prev="zero")


@pytest.mark.parametrize("split", ["2024-01-01 00:05:00", "2024-01-01 00:07:00", "2024-01-01 00:10:00"])
def test_two_runs_equal_one(spark, rows, split):
    rng, data = random.Random(7), []
    for series in "ab":
        counter = 0
        for minute in range(15):
            for second in range(rng.randint(0, 2)):
                counter += rng.randint(0, 9)
                data.append((series, f"2024-01-01 00:{minute:02d}:{second * 20 + 5:02d}", counter, rng.randint(1, 9)))
    df = raw(spark, data)
    seed = carry_in(df, ["series"], "ts", STEP, split, {"cumul": "cumul"})
    at = F.lit(split).cast("timestamp_ntz")
    parts = used(df.where(F.col("ts") < at)).unionByName(used(df.where(F.col("ts") >= at), seed=seed))
    assert rows(parts) == rows(used(df))


def test_seed_inside_a_bucket(spark, rows):
    df = raw(
        spark,
        [
            ("a", "2024-01-01 00:00:10", 100, 5),
            ("a", "2024-01-01 00:00:40", 104, 5),
            ("a", "2024-01-01 00:01:10", 110, 5),
        ],
    )
    split = "2024-01-01 00:00:30"
    seed = carry_in(df, ["series"], "ts", STEP, split, {"cumul": "cumul"})
    later = df.where(F.col("ts") >= F.lit(split).cast("timestamp_ntz"))
    # The first bucket is taken against the seed, the second against the first.
    assert rows(used(later, seed=seed), "gts", "use") == [("2024-01-01 00:01:00", 4), ("2024-01-01 00:02:00", 6)]


def test_use_sums_to_the_counter(spark):
    df = raw(spark, [("a", f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", m * m, 1) for m in range(200)])
    total, low, high = used(df).agg(F.sum("use"), F.min("cumul"), F.max("cumul")).first()
    assert total == high - low


def test_whole_wide_table(spark, rows):
    df = spark.createDataFrame(
        [
            ("2024-01-01 10:00:00", 5, 7, 100, 200),
            ("2024-01-01 11:00:00", 9, None, 110, None),
            ("2024-01-01 12:00:00", 1, 8, 111, 230),
            ("2024-01-02 12:00:00", 2, 2, 150, 260),
            ("2024-01-04 09:00:00", 3, 3, 190, 290),
            ("2024-01-05 09:00:00", 4, 4, 195, 299),
        ],
        "t string, c1_curr bigint, c2_curr bigint, c1_cumul bigint, c2_cumul bigint",
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    circuits = {n: (f"{n}_curr", f"{n}_cumul") for n in ("c1", "c2")}
    days = daily_counter_rollup(df, "ts", circuits, now="2024-01-05 12:00:00")
    got = rows(with_deltas(days, ["c1", "c2", "all"]), "gts", "measures_count", "all_peak", "all_cumul", "c1_use", "all_use", "delta_gts")
    assert got == [
        ("2024-01-02 00:00:00", 3, 12, 341, 0, 0, "2024-01-02 00:00:00"),
        ("2024-01-03 00:00:00", 1, 4, 410, 39, 69, "2024-01-02 00:00:00"),
        ("2024-01-05 00:00:00", 1, 6, 480, 40, 70, "2024-01-03 00:00:00"),
    ]
    later = daily_counter_rollup(df, "ts", circuits, now="2024-01-05 12:00:00", high_water="2024-01-03 00:00:00")
    assert rows(later, "gts") == [("2024-01-05 00:00:00",)]


def test_five_minutes(spark, rows):
    df = raw(spark, [("a", "2024-01-01 00:04:59", 1, 5), ("a", "2024-01-01 00:05:00", 2, 3), ("a", "2024-01-01 00:09:00", 4, 1)])
    assert [tuple(map(str, r)) for r in group_5min(df, "ts", "curr", "cumul").collect()] == [
        ("2024-01-01 00:00:00", "1", "5", "1"),
        ("2024-01-01 00:05:00", "2", "3", "4"),
    ]


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_ordered_operators_match_brute_force(spark, block_rows):
    """One series holds most rows; blocks and partitions are far smaller than it."""
    rng = random.Random(3)
    data = [("hot", i, rng.randint(-9, 99) if rng.random() > 0.1 else None) for i in range(300)]
    data += [(None, i, i) for i in range(20)] + [("one", 0, 5)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    sizing = {"block_rows": block_rows, "partitions": 9}

    series = {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        series.setdefault(k, []).append((i, v))
    want_avg, want_prev, want_delta = {}, {}, {}
    for k, points in series.items():
        for n, (i, v) in enumerate(points):
            seen = [x for _, x in points[max(0, n - 3) : n + 1] if x is not None]
            before = points[n - 1] if n else points[n]
            want_avg[k, i] = round(sum(seen) / len(seen), 9) if seen else None
            want_prev[k, i] = before
            want_delta[k, i] = (v - before[1] if n and None not in (v, before[1]) else 0, before[0])

    got = moving_avg(df, ["k"], ["i"], "v", 4, **sizing).collect()
    assert {(r.k, r.i): r.moving_avg if r.moving_avg is None else round(r.moving_avg, 9) for r in got} == want_avg
    assert len(got) == len(data)
    got = prev_row(df, ["k"], ["i"], ["i", "v"], **sizing).collect()
    assert {(r.k, r.i): (r.prev_i, r.prev_v) for r in got} == want_prev
    got = plain_delta(df, ["k"], ["i"], {"d": "v"}, **sizing).collect()
    assert {(r.k, r.i): (r.d, r.delta_i) for r in got} == want_delta


def test_equal_rows_are_split(spark):
    """Most rows are copies of one row; they still get places of their own, over many partitions."""
    df = spark.createDataFrame([("k", 5)] * 200 + [("k", i) for i in range(5)], "k string, i int")
    got = positions(df, ["k"], ["i"], partitions=8, block_rows=20)
    assert sorted(r.pos for r in got.collect()) == list(range(1, 206))
    assert [r.i for r in sorted(got.collect(), key=lambda r: r.pos)] == [0, 1, 2, 3, 4] + [5] * 200
    got = prev_row(df, ["k"], ["i"], ["i"], partitions=8, block_rows=20)
    assert sorted((r.i, r.prev_i) for r in got.collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)] + [(5, 5)] * 199


@pytest.mark.parametrize("partitions, block_rows", [(1, 10), (5, 10), (16, 10), (5, 1000)])
def test_positions(spark, partitions, block_rows):
    data = [("hot", i) for i in range(100)] + [("b", i) for i in range(3)] + [(None, 1)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, i int")
    got = positions(df, ["k"], ["i"], "pos", "n", partitions=partitions, block_rows=block_rows).collect()
    assert sorted(((r.k or "", r.i, r.pos, r.n) for r in got)) == sorted(
        [("hot", i, i + 1, 100) for i in range(100)] + [("b", i, i + 1, 3) for i in range(3)] + [("", 1, 1, 1)]
    )


def readings_fixture(spark, data):
    df = spark.createDataFrame(data, "id string, t string, power bigint, energy bigint")
    return df.select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "power", "energy")


def test_devices_side_by_side(spark, rows):
    df = readings_fixture(
        spark,
        [
            ("x", "2024-01-01 00:00:10", 5, 10),
            ("x", "2024-01-01 00:01:10", 6, 20),
            ("x", "2024-01-01 00:02:10", 7, 30),
            ("y", "2024-01-01 00:00:20", 1, 100),
            ("y", "2024-01-01 00:01:20", 1, 200),
            ("z", "2024-01-01 00:00:30", 2, 1000),
            ("z", "2024-01-01 00:05:30", 2, 2000),
            ("other", "2024-01-01 00:00:30", 2, 1000),
        ],
    )
    got = rows(device_rollup(df, ["x", "y", "z"], "ts", STEP, "power", "energy"), "gts", "cnt", "c1_cumul", "c2_cumul", "c3_cumul")
    assert got == [
        ("2024-01-01 00:01:00", 1, 10, 100, 1000),
        ("2024-01-01 00:02:00", 1, 20, None, None),  # z is missing, so y is left out too
        ("2024-01-01 00:03:00", 1, 30, None, None),
    ]


def test_align_left(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "t int, x string")
    second = spark.createDataFrame([(1, 10), (2, 20), (9, 90)], "t int, y int")
    third = spark.createDataFrame([(1, None), (3, 300), (9, 900)], "t int, z int")
    want = base.join(second.join(third, "t"), "t", "left")
    assert rows(align_left(base, [second, third], "t"), "t", "x", "y", "z") == rows(want, "t", "x", "y", "z")


def record(number, value, unit, access=7, address=1, id="dev", ts="2016-01-28 06:48:13"):
    return (address, id, access, number, unit, value, ts)


def test_pivot_readings(spark):
    data = [
        record(0, "99", "Firmware"),
        record(1, "12", "Energy;100;Wh"),
        record(3, "345", "Manufacturer specific"),
        record(5, "1001", "Volume;m;m^3"),
        record(8, "2153", "Flow temperature;1e-2;deg C"),
        record(10, "-12", "Temperature Difference;1e-2;deg C"),
        record(13, "29", "Volume flow;m;m^3/h"),
        record(15, "0x1F", "Error flags"),
        record(23, "1999", "Volume flow;m;m^3/h"),
        record(25, "5", "Power;100;W"),
        record(11, "3", "Power;100;W", access=8),
        record(11, "4", "Power;k;W", id="other"),
    ]
    df = spark.createDataFrame(
        data, "address bigint, id string, accessNumber bigint, recordId int, recordUnit string, recordValue string, recordTimestamp string"
    )
    got = {(r.id, r.accessNumber): r for r in pivot_readings(df).collect()}
    assert set(got) == {("dev", 7), ("dev", 8), ("other", 7)}
    first, second = got["dev", 7], got["dev", 8]
    assert (first.heatingEnergy, first.energyM3T1, first.volume) == (1200, 345, int(0.001 * 1001 * 1000))
    assert (first.temp1, first.deltaT1T2, first.flow) == (21.53, -0.12, int(0.001 * 29 * 1000))
    assert (first.errorFlags, first.targetFlowMax, first.coolingEnergy) == ("0x1F", 1, None)
    # Both access numbers of the time share all measures.
    assert first.power == second.power == 300 and second.heatingEnergy == 1200
    assert got["other", 7].power == 4000


def test_series_of_one_table_are_read_once(spark, rows):
    from meterflow.operators.series import align_left, align_left_of, merge_series, merge_series_of

    data = [(t, s, v) for s, v in (("a", 1), ("b", 20), ("c", None)) for t in range(6) if (t + len(s) * 7 + (v or 3)) % 3]
    df = spark.createDataFrame([*data, (9, "c", 5), (10, None, 5), (11, "other", 5)], "t int, s string, v int")
    apart = [df.where(F.col("s") == n).select("t", F.col("v").alias(f"{n}_v")) for n in "abc"]
    fused = merge_series_of(df, "t", "s", ["a", "b", "c"], ["v"])
    assert rows(fused) == rows(merge_series(apart, "t"))
    assert rows(align_left_of(df, "t", "s", "a", ["b", "c"], ["v"])) == rows(align_left(apart[0], apart[1:], "t"))
    assert fused._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    with pytest.raises(Exception, match="several rows"):
        merge_series_of(df.unionByName(df), "t", "s", ["a", "b"], ["v"]).collect()
