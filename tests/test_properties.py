"""Laws that hold for any data."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.operators.counters import carry_in, counter_delta, counter_rollup
from meterflow.operators.keyed import insert_ignore, insert_replace
from meterflow.operators.resample import resample
from meterflow.operators.shape import unpivot_totals

SOME = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

#: (series, second of an hour, growth of the counter)
READINGS = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 1800), st.integers(0, 9)), min_size=1, max_size=40, unique_by=lambda r: r[:2]
)


def meter(spark, readings):
    rows, last = [], {}
    for series, second, growth in sorted(readings):
        last[series] = last.get(series, 0) + growth
        rows.append((series, second, last[series], growth))
    df = spark.createDataFrame(rows, "series string, s int, cumul bigint, curr bigint")
    return df.select("series", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).cast("timestamp_ntz").alias("ts"), "cumul", "curr")


def rolled(df):
    return counter_rollup(df, ["series"], "ts", "1 minute", {"peak": "curr"}, {"cumul": "cumul"})


def used(df, seed=None):
    return counter_delta(rolled(df), ["series"], "gts", "1 minute", {"use": "cumul"}, seed=seed)


@SOME
@given(READINGS, st.integers(0, 30))
def test_parts_equal_the_whole(spark, rows, readings, minute):
    df = meter(spark, readings)
    split = f"2024-01-01 00:{minute:02d}:00"
    at = F.lit(split).cast("timestamp_ntz")
    seed = carry_in(df, ["series"], "ts", "1 minute", split, {"cumul": "cumul"})
    parts = used(df.where(F.col("ts") < at)).unionByName(used(df.where(F.col("ts") >= at), seed))
    assert rows(parts) == rows(used(df))


@SOME
@given(READINGS, st.sampled_from(["5T", "H", "D", "W"]), st.sampled_from(["UTC", "Europe/Helsinki", "Asia/Kolkata"]))
def test_resampling_keeps_the_total(spark, readings, step, tz):
    df = meter(spark, readings).select("series", "ts", "curr")
    total = sum(r[2] for r in readings)
    assert resample(df, "ts", step, tz=tz, keys=["series"]).agg(F.sum("curr")).first()[0] == total


@SOME
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.integers(-9, 9))] * 3), min_size=1, max_size=10))
def test_unpivot_and_back(spark, rows, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "ts int, a bigint, b bigint, c bigint")
    long = unpivot_totals(df, ["a", "b", "c"])
    back = long.groupBy("ts").pivot("name", ["a", "b", "c"]).agg(F.max(F.when(~F.col("nodata"), F.col("value"))))
    assert rows(back) == rows(df)


@SOME
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99)), min_size=1, max_size=20, unique_by=lambda r: r[1]), st.integers(0, 20))
def test_loads_in_parts(spark, rows, data, cut):
    """First wins and last wins do not depend on how the deliveries are cut."""
    data.sort(key=lambda r: r[1])
    make = lambda part: spark.createDataFrame(part, "k int, n int")
    first, last = {}, {}
    for k, n in data:
        first.setdefault(k, n)
        last[k] = n
    none = make([])
    for load, want in ((insert_ignore, first), (insert_replace, last)):
        stored = none
        for part in (data[:cut], data[cut:]):
            stored = load(stored, make(part), ["k"], ["n"])
        assert {r.k: r.n for r in stored.collect()} == want and stored.count() == len(want)
