import pytest
from pyspark.sql import functions as F

from meterflow.functions import (
    bucket,
    day_key,
    from_ns,
    null_if_blank,
    parse_ts,
    row_max,
    row_sum,
    step_micros,
    to_local,
    to_ns,
    to_utc,
    unit_factor,
)


def times(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))


def test_bucket_edges(spark, rows):
    df = times(spark, "2024-01-01 00:00:59.999999", "2024-01-01 00:01:00", "2024-01-01 00:01:00.000001")
    assert [r[0] for r in rows(df.select(bucket(F.col("ts"), "1 minute", "end")))] == [
        "2024-01-01 00:01:00",
        "2024-01-01 00:02:00",
        "2024-01-01 00:02:00",
    ]
    assert rows(df.select(bucket(F.col("ts"), "5 minutes", "start")).distinct()) == [("2024-01-01 00:00:00",)]
    with pytest.raises(ValueError):
        bucket(F.col("ts"), "1 minute", "middle")


def test_steps():
    assert step_micros("5 minutes") == 300_000_000
    assert step_micros("1 day") == 86_400_000_000
    for bad in ("month", "1 month", "x hours"):
        with pytest.raises(ValueError):
            step_micros(bad)


def test_epoch_is_lossless(spark, rows):
    df = times(spark, "1969-12-31 23:59:59.999999", "2016-01-28 06:48:13.123457")
    back = df.select((from_ns(to_ns(F.col("ts"))) == F.col("ts").cast("timestamp")), to_ns(F.col("ts")))
    assert rows(back) == [(True, -1000), (True, 1453963693123457000)]


def test_both_text_forms(spark, rows):
    df = spark.createDataFrame(
        [("2015-11-10T07:46:13.771123Z",), ("2015-11-10 07:46:13.771123",), ("yesterday",), (None,)], "t string"
    )
    assert rows(df.select(parse_ts(F.col("t")).cast("timestamp_ntz"))) == [
        ("2015-11-10 07:46:13.771123",),
        ("2015-11-10 07:46:13.771123",),
        (None,),
        (None,),
    ]


def test_zones_over_clock_changes(spark, rows):
    df = times(spark, "2015-03-29 00:30:00", "2015-03-29 01:30:00", "2015-10-25 00:30:00", "2015-10-25 01:30:00")
    local = df.select(to_local(F.col("ts"), "Europe/Helsinki").alias("l"), day_key(F.col("ts"), "Europe/Helsinki", "yyyyMMdd"))
    assert rows(local) == [
        ("2015-03-29 02:30:00", "20150329"),
        ("2015-03-29 04:30:00", "20150329"),
        ("2015-10-25 03:30:00", "20151025"),
        ("2015-10-25 03:30:00", "20151025"),
    ]
    midnight = times(spark, "2015-03-29 00:00:00", "2015-03-30 00:00:00")
    assert rows(midnight.select(to_utc(F.col("ts"), "Europe/Helsinki"))) == [
        ("2015-03-28 22:00:00",),
        ("2015-03-29 21:00:00",),
    ]


def test_row_totals(spark, rows):
    df = spark.createDataFrame([(1, None, 3), (None, None, None), (-5, -2, None)], "a int, b int, c int")
    cols = ["a", "b", "c"]
    got = df.select(row_sum(cols), row_sum(cols, null_as_zero=True), row_max(cols)).collect()
    assert [tuple(r) for r in got] == [(4, 4, 3), (None, 0, None), (-7, -7, -2)]


def test_unit_factors(spark):
    cases = {
        "Energy;100;Wh": 100.0,
        "Volume;m;m^3": 1 / 1000,
        "Volume;my;m^3": 1 / 1000000,
        "Flow temperature;1e-2;deg C": 0.01,
        "Power;10 k;W": 10000.0,
        "Power;T;W": 1e9,
        "Manufacturer specific": 1.0,
        "Energy;unknown;Wh": 1.0,
        "Energy;1ex;Wh": 1.0,
        "Energy;;Wh": 1.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", unit_factor("u").alias("f"))
    assert {r["u"]: r["f"] for r in df.collect()} == cases


def test_blank_is_null(spark, rows):
    df = spark.createDataFrame([("",), (" ",), ("7",)], "t string")
    assert rows(df.select(null_if_blank(F.col("t")))) == [("7",), (None,), (None,)]
