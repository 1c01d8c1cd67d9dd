import random
import statistics

import pytest
from pyspark.sql import functions as F

from meterflow.operators.filters import bounded, closed_only, for_series, local_range, project, with_params
from meterflow.operators.resample import daily_rollup, daily_stats, parse_step, resample
from meterflow.operators.shape import (
    day_segments,
    extent,
    flag_nodata,
    last_per_day,
    max_across,
    unpivot_totals,
)

HELSINKI = "Europe/Helsinki"


def frame(spark, data, kind="timestamp_ntz"):
    return spark.createDataFrame(data, "t string, v bigint").select(F.col("t").cast(kind).alias("ts"), "v")


HOURS = [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 2), ("2024-01-01 10:00:00", 3)]


def values(df):
    return sorted(r["v"] for r in df.collect())


def pushed(df):
    """The filters that reach the scan, from the printed plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bounds(spark, kind):
    df = frame(spark, HOURS, kind)
    low, high = "2024-01-01T00:00:00.000000Z", "2024-01-01 10:00:00"
    assert values(bounded(df, "ts", low, high)) == [1, 2, 3]
    assert values(bounded(df, "ts", mints=low)) == [2, 3]
    assert values(bounded(df, "ts", maxts=high)) == [1, 2]
    assert values(bounded(df, "ts")) == [1, 2, 3]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_local_days(spark, kind):
    edges = [
        ("2015-03-28 21:59:59.999999", 1),
        ("2015-03-28 22:00:00", 2),
        ("2015-03-29 20:59:59.999999", 3),
        ("2015-03-29 21:00:00", 4),
    ]
    df = frame(spark, edges, kind)
    assert values(local_range(df, "ts", "20150329", "20150329", HELSINKI)) == [2, 3]
    assert values(local_range(df, "ts", "2015-03-28", "20150328", HELSINKI)) == [1]
    assert values(local_range(df, "ts", tz=HELSINKI, now="2015-03-29 10:00:00")) == [2, 3]
    assert values(local_range(df, "ts", mindate="20150329", tz=HELSINKI, now="2015-03-30 10:00:00")) == [2, 3, 4]


def test_filters_reach_the_scan(spark, tmp_path):
    frame(spark, HOURS).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for filtered in (
        local_range(df, "ts", "20240101", "20240101", HELSINKI),
        closed_only(df, "ts", "1 hour", "2024-01-01 05:30:00"),
        bounded(df, "ts", mints="2024-01-01 01:00:00"),
    ):
        plan = pushed(filtered)
        scan = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
        assert scan and ("(ts," in scan[0]), plan


def test_closed_buckets(spark):
    df = frame(spark, HOURS)
    assert values(closed_only(df, "ts", "1 hour", "2024-01-01 10:00:00")) == [1, 2]
    assert values(closed_only(df, "ts", "5 minutes", "2024-01-01 10:05:00")) == [1, 2, 3]
    assert values(closed_only(df, "ts", "1 day", "2024-01-01 23:00:00")) == []


def test_projection(spark):
    df = with_params(frame(spark, HOURS).withColumn("kind", F.lit("x")), step=60)
    assert project(df, ["step", "v"]).columns == ["ts", "step", "v"]
    assert for_series(df, kind="y").count() == 0 and for_series(df, kind="x", v=None).count() == 3


def test_steps():
    assert parse_step("H") == (1, "hour") and parse_step("15min") == (15, "minute") and parse_step("W") == (1, "week")
    assert parse_step("30S") == (30, "second") and parse_step("180min") == (180, "minute") and parse_step("48H") == (2, "day")
    assert parse_step("36H") == (36, "hour") and parse_step("2W") == (2, "week") and parse_step("3 months") == (3, "month")
    for bad in ("0H", "0D", "fortnight", ""):
        with pytest.raises(ValueError):
            parse_step(bad)


def test_steps_from_local_midnight(spark):
    """Three-hour buckets around both clock changes of Helsinki: 31 March (23 hours) and 27 October (25 hours)."""
    for day, hours in (("2024-03-31", 23), ("2024-10-27", 25)):
        times = spark.sql(
            f"SELECT timestamp_micros(unix_micros(to_utc_timestamp(timestamp'{day} 00:00:00', 'Europe/Helsinki'))"
            f" + id * 3600000000) AS ts, 1 AS v FROM range({hours})"
        )
        got = resample(times, "ts", "3H", "count", tz="Europe/Helsinki").orderBy("ts").collect()
        assert len(got) == 8 and sum(r.v for r in got) == hours
        assert sorted(r.v for r in got) == sorted([3] * 7 + [hours - 21])
        odd = resample(times, "ts", "45min", "count", tz="Europe/Helsinki")
        assert odd.count() == odd.select("ts").distinct().count() and odd.agg(F.sum("v")).first()[0] == hours


def test_several_days_months(spark):
    times = spark.sql("SELECT timestamp'2024-01-31 12:00:00' + make_interval(0, 0, 0, cast(id as int)) AS ts, 1 AS v FROM range(100)")
    two = resample(times, "ts", "2D", "count").orderBy("ts").collect()
    assert len(two) == 50 and {r.v for r in two} == {2} and str(two[0].ts) == "2024-01-31 00:00:00"
    months = resample(times, "ts", "2M", "count", "right").orderBy("ts").collect()
    assert [(str(r.ts)[:10], r.v) for r in months] == [("2024-02-29", 30), ("2024-04-30", 61), ("2024-06-30", 9)]


def test_empty_buckets(spark, rows):
    df = frame(spark, HOURS)
    got = rows(resample(df, "ts", "H", "sum"))
    assert len(got) == 11 and got[0] == ("2024-01-01 00:00:00", 1) and got[1] == ("2024-01-01 01:00:00", None)
    assert sum(v or 0 for _, v in got) == 6
    assert [v for _, v in rows(resample(df, "ts", "H", "count"))] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    assert rows(resample(df, "ts", "H", "max", "right"))[0] == ("2024-01-01 01:00:00", 1)
    assert len(rows(resample(df, "ts", "H", fill=False))) == 3
    assert rows(resample(df.where("v > 99"), "ts", "H")) == []


def test_hours_over_clock_changes(spark, rows):
    """The repeated local hour stays two buckets; the skipped one makes none."""
    autumn = frame(spark, [("2015-10-24 23:30:00", 1), ("2015-10-25 00:30:00", 2), ("2015-10-25 01:30:00", 3), ("2015-10-25 02:30:00", 4)])
    assert rows(resample(autumn, "ts", "H", tz=HELSINKI)) == [
        (f"2015-10-2{d} {h}:00:00", v) for d, h, v in ((4, "23", 1), (5, "00", 2), (5, "01", 3), (5, "02", 4))
    ]
    spring = frame(spark, [("2015-03-29 00:30:00", 1), ("2015-03-29 01:30:00", 2)])
    assert [v for _, v in rows(resample(spring, "ts", "H", tz=HELSINKI))] == [1, 2]


def test_local_days_over_clock_changes(spark, rows):
    df = frame(spark, [("2015-10-24 20:00:00", 1), ("2015-10-24 21:00:00", 2), ("2015-10-25 21:59:00", 3), ("2015-10-27 22:00:00", 4)])
    assert rows(resample(df, "ts", "D", tz=HELSINKI)) == [
        ("2015-10-23 21:00:00", 1),
        ("2015-10-24 21:00:00", 5),
        ("2015-10-25 22:00:00", None),
        ("2015-10-26 22:00:00", None),
        ("2015-10-27 22:00:00", 4),
    ]
    assert rows(resample(df, "ts", "D", tz=HELSINKI, label="right"))[1] == ("2015-10-25 22:00:00", 5)


def test_half_hour_zone(spark, rows):
    df = frame(spark, [("2024-01-01 00:10:00", 1), ("2024-01-01 00:40:00", 2)])
    assert rows(resample(df, "ts", "H", tz="Asia/Kolkata")) == [("2023-12-31 23:30:00", 1), ("2024-01-01 00:30:00", 2)]


def test_period_labels(spark, rows):
    """Week and month buckets are named by their last day, or the last day before them."""
    df = frame(spark, [("2024-01-07 23:00:00", 1), ("2024-01-08 00:00:00", 2), ("2024-03-01 00:00:00", 3)])
    weeks = rows(resample(df, "ts", "W", label="right"))
    assert weeks[:2] == [("2024-01-07 00:00:00", 1), ("2024-01-14 00:00:00", 2)] and len(weeks) == 9
    assert rows(resample(df, "ts", "W"))[0] == ("2023-12-31 00:00:00", 1)
    assert rows(resample(df, "ts", "M", label="right")) == [
        ("2024-01-31 00:00:00", 3),
        ("2024-02-29 00:00:00", None),
        ("2024-03-31 00:00:00", 3),
    ]
    assert rows(resample(df, "ts", "Q")) == [("2023-12-31 00:00:00", 6)]


@pytest.mark.parametrize("how", ["mean", "min", "first", "last", "median", "std", "var"])
def test_every_aggregate(spark, how):
    rng, data = random.Random(5), []
    for i in range(90):
        data.append((f"2024-01-01 {i // 30:02d}:{i % 30:02d}:00", rng.randint(0, 50) if i % 7 else None))
    expect = {
        "mean": statistics.mean,
        "min": min,
        "first": lambda v: v[0],
        "last": lambda v: v[-1],
        "median": statistics.median,
        "std": statistics.stdev,
        "var": statistics.variance,
    }[how]
    want = [expect([v for _, v in data[h * 30 : h * 30 + 30] if v is not None]) for h in range(3)]
    sizing = {"partitions": 5, "block_rows": 9} if how == "median" else {}
    df = frame(spark, data).select(F.lit("hot").alias("k"), "ts", "v", (F.col("v") * 2).alias("w"))
    got = sorted(resample(df, "ts", "H", how, keys=["k"], **sizing).collect(), key=lambda r: r.ts)
    assert [round(r.v, 9) for r in got] == [round(x, 9) for x in want]
    double = 4 if how == "var" else 2
    assert [round(r.w, 6) for r in got] == [round(x * double, 6) for x in want]


def test_medians_of_large_and_small_groups(spark):
    """One hour holds most rows, many of them equal; one holds no value."""
    rng = random.Random(9)
    data = [("2024-01-01 00:10:00", rng.choice([4, 4, 4, rng.randint(-50, 50)])) for _ in range(301)]
    data += [("2024-01-01 01:10:00", v) for v in (5, 1, 9, 2)] + [("2024-01-01 02:10:00", None)] * 30
    want = [statistics.median([v for t, v in data if t[12] == h and v is not None] or [0]) for h in "01"] + [None]
    for block_rows in (20, 10**6):
        got = resample(frame(spark, data), "ts", "H", "median", block_rows=block_rows)
        assert [r.v for r in sorted(got.collect(), key=lambda r: r.ts)] == want


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError):
        resample(frame(spark, HOURS), "ts", "H", "mode")


def test_daily(spark, rows):
    df = frame(spark, [("2024-01-01 21:59:00", 4), ("2024-01-01 22:01:00", 6), ("2024-01-01 22:02:00", 7), ("2024-01-04 12:00:00", 1)])
    assert rows(daily_stats(df, "ts", "v", HELSINKI, fill=True)) == [
        ("2024-01-01", 4, 4, 4.0),
        ("2024-01-02", 6, 7, 6.5),
        ("2024-01-03", None, None, None),
        ("2024-01-04", 1, 1, 1.0),
    ]
    assert len(rows(daily_stats(df, "ts", "v", HELSINKI))) == 3
    view = daily_rollup(df.withColumn("k", F.lit("x")), "ts", "v", HELSINKI, ["k"])
    assert rows(view)[1] == ("x", "20240102", 6, 6.5, 7, 2, HELSINKI)


def test_unpivot_and_back(spark, rows):
    df = spark.createDataFrame([(1, 5, None, 7), (2, None, None, None), (3, -1, 2, 0)], "ts int, a bigint, b bigint, c bigint")
    long = unpivot_totals(df, ["a", "b", "c"])
    assert rows(long.where("ts = 1"), "pos", "name", "value", "stack", "total", "nodata") == [
        (1, "a", 5, 5, 12, False),
        (2, "b", 0, 5, 12, True),
        (3, "c", 7, 12, 12, False),
    ]
    back = long.groupBy("ts").pivot("name", ["a", "b", "c"]).agg(F.max(F.when(~F.col("nodata"), F.col("value"))))
    assert rows(back) == rows(df)
    assert rows(flag_nodata(df, ["b"]).where("ts = 1")) == [(1, 5, 0, 7, True)]


def test_extents(spark, rows):
    df = frame(spark, HOURS)
    assert rows(extent(df, "v", "v")) == [(1, 3)]
    assert rows(extent(df, "v", "v", "ts", "2024-01-01 00:00:00", "2024-01-01 10:00:00")) == [(2, 2)]
    assert rows(extent(df, "v", "v", "ts", lo="2025-01-01")) == [(None, None)]
    assert rows(max_across([(df, "ts", "v"), (df.withColumn("v", F.col("v") * 10), "ts", "v")], hi="2024-01-01 10:00:00")) == [(20,)]


def test_last_row_of_a_day(spark, rows):
    df = frame(spark, [("2024-01-01 10:00:00", 1), ("2024-01-01 09:00:00", 5), ("2024-01-02 23:00:00", 2)])
    assert rows(last_per_day(df, "v", "ts")) == [("2024-01-01 09:00:00", 5), ("2024-01-02 23:00:00", 2)]
    assert rows(last_per_day(df, "v", "ts", HELSINKI)) == [("2024-01-01 09:00:00", 5), ("2024-01-02 23:00:00", 2)]


def test_day_segments(spark, rows):
    data = [(f"2024-01-01 {h:02d}:00:00", h) for h in range(24)]
    random.Random(2).shuffle(data)
    got = rows(day_segments(frame(spark, data), "ts", HELSINKI, ["ts"], partitions=4, block_rows=5), "day", "pos", "v")
    assert got == [("2024-01-01", h + 1, h) for h in range(22)] + [("2024-01-02", 1, 22), ("2024-01-02", 2, 23)]


@pytest.mark.parametrize("step, hours", [("36H", 36), ("30H", 30), ("2000min", 2000 / 60), ("90000S", 25)])
def test_steps_over_a_day_that_are_no_whole_days(spark, rows, step, hours):
    """Buckets count from the first local midnight by the local clock, as in plain Python."""
    import datetime
    import zoneinfo

    from meterflow.operators.resample import resample

    zone = zoneinfo.ZoneInfo("Europe/Helsinki")
    start = datetime.datetime(2024, 3, 28, 22, 30)
    data = [(start + datetime.timedelta(hours=5 * i + (40 if i > 20 else 0)), i) for i in range(50)]
    df = spark.createDataFrame([(t.isoformat(sep=" "), v) for t, v in data], "t string, v long").select(F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    local = lambda t: t.replace(tzinfo=datetime.timezone.utc).astimezone(zone).replace(tzinfo=None)
    first = local(start).replace(hour=0, minute=0)
    span = datetime.timedelta(hours=hours)
    sums = {}
    for t, v in data:
        sums[(local(t) - first) // span] = sums.get((local(t) - first) // span, 0) + v
    utc = lambda k: str((first + k * span).replace(tzinfo=zone).astimezone(datetime.timezone.utc).replace(tzinfo=None))
    for label, shift in (("left", 0), ("right", 1)):
        want = [(utc(k + shift), sums.get(k)) for k in range(max(sums) + 1)]
        assert rows(resample(df, "ts", step, "sum", label, "Europe/Helsinki")) == sorted(want)
