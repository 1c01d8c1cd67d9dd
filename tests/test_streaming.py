"""File streams that stop and go on give what one batch gives."""

import pytest
from pyspark.sql import functions as F

from meterflow.operators.counters import counter_delta, counter_rollup
from meterflow.operators.resample import daily_rollup
from meterflow.streaming import (
    daily_view_stream,
    dedup_stream,
    delta_stream,
    ingest_stream,
    late_rows,
    rollup_stream,
    run,
)

SCHEMA = "series string, ts timestamp, cumul bigint, curr bigint"
TOPS = ({"peak": "curr"}, {"cumul": "cumul"})


@pytest.fixture
def readings(spark):
    """Two series over ten hours with a gap."""
    hours = [0, 1, 2, 3, 6, 7, 8, 9]
    data = [
        (s, f"2024-01-01 {h:02d}:{m:02d}:00", (h * 60 + m) * k, m)
        for s, k in (("a", 1), ("b", 3))
        for h in hours
        for m in (0, 20, 40)
    ]
    df = spark.createDataFrame(data, "series string, t string, cumul bigint, curr bigint")
    return df.select("series", F.col("t").cast("timestamp").alias("ts"), "cumul", "curr")


def deliver(df, folder, low, high):
    """One file with the rows of some hours."""
    hour = F.hour("ts")
    df.where((hour >= low) & (hour < high)).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return ingest_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, max_files=1)


def test_rollup_and_delta_over_restarts(spark, rows, readings, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low, high in ((0, 2), (2, 4), (4, 8), (8, 10)):
        deliver(readings, source, low, high)
        rolled = rollup_stream(stream(spark, source), ["series"], "ts", "1 hour", "10 minutes", *TOPS)
        # Every round starts anew and goes on from its checkpoint.
        run(delta_stream(rolled, ["series"], "gts", "1 hour", {"use": "cumul"}, out), check).awaitTermination()
    batch = counter_delta(counter_rollup(readings, ["series"], "ts", "1 hour", *TOPS), ["series"], "gts", "1 hour", {"use": "cumul"})
    closed = batch.where(F.col("gts") <= "2024-01-01 09:30:00")
    cols = ["series", "gts", "cnt", "peak", "cumul", "use"]
    stored = spark.read.parquet(out)
    assert stored.select("batch").distinct().count() > 2
    assert rows(stored, *cols) == rows(closed, *cols)
    assert rows(stored.where("use IS NULL"), "series", "gts") == [
        (s, f"2024-01-01 {h}:00:00") for s in "ab" for h in ("01", "07")
    ]


def test_a_batch_that_runs_twice_counts_once(spark, rows, readings, tmp_path):
    out = str(tmp_path / "out")
    rolled = counter_rollup(readings, ["series"], "ts", "1 hour", *TOPS)

    class Batches:
        """Takes the batch function so that it can be called by hand."""

        schema, sparkSession = rolled.schema, spark

        @property
        def writeStream(self):
            return self

        def outputMode(self, mode):
            return self

        def foreachBatch(self, fn):
            return fn

    store = delta_stream(Batches(), ["series"], "gts", "1 hour", {"use": "cumul"}, out)
    cut = F.col("gts") <= "2024-01-01 03:00:00"
    store(rolled.where(cut), 0)
    store(rolled.where(~cut), 1)
    store(rolled.where(~cut), 1)
    whole = counter_delta(rolled, ["series"], "gts", "1 hour", {"use": "cumul"})
    cols = ["series", "gts", "cumul", "use"]
    assert rows(spark.read.parquet(out), *cols) == rows(whole, *cols)


def test_late_rows_stay_out(spark, rows, readings, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def go():
        rolled = rollup_stream(stream(spark, source), ["series"], "ts", "1 hour", "10 minutes", *TOPS)
        run(rolled.writeStream.format("parquet").option("path", out), check).awaitTermination()
        return rolled.schema

    deliver(readings, source, 0, 4)
    go()
    late = readings.where("hour(ts) = 1").withColumn("curr", F.lit(10**6).cast("bigint"))
    late.coalesce(1).write.mode("append").parquet(source)
    deliver(readings, source, 6, 10)
    stored = spark.read.schema(go()).parquet(out)
    assert stored.agg(F.max("peak")).first()[0] == 40 and stored.count() == 14
    assert late_rows(late, "ts", "2024-01-01 03:00:00").count() == late.count()


def test_daily_view_follows_events(spark, rows, readings, tmp_path):
    source, raw, view, check = (str(tmp_path / n) for n in ("in", "raw", "view", "check"))
    shifted = readings.withColumn("ts", F.col("ts") + F.expr("INTERVAL 15 HOURS"))

    def go():
        writer = daily_view_stream(
            stream(spark, source), ["series", "ts"], "ts", "curr", "Europe/Helsinki", raw, view, ["series"]
        )
        run(writer, check).awaitTermination()
        return spark.read.parquet(view).drop("day")

    cols = ["series", "eventGroupTimestamp", "minvalue", "avgvalue", "maxvalue", "eventCount", "aggregationTimezone"]
    first, second = shifted.where("ts < '2024-01-01 20:00:00'"), shifted.where("ts >= '2024-01-01 20:00:00'")
    first.coalesce(1).write.mode("append").parquet(source)
    go()
    # A day already in the view gets more rows, some of them delivered before.
    second.unionByName(first.where("series = 'a'")).coalesce(1).write.mode("append").parquet(source)
    assert rows(go(), *cols) == rows(daily_rollup(shifted, "ts", "curr", "Europe/Helsinki", ["series"]), *cols)


def test_repeated_delivery(spark, rows, readings, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for _ in range(2):
        deliver(readings, source, 0, 2)
        once = dedup_stream(stream(spark, source), ["series", "ts"], "ts", "3 hours")
        run(once.writeStream.format("parquet").option("path", out), check).awaitTermination()
    assert rows(spark.read.schema(once.schema).parquet(out)) == rows(readings.where("hour(ts) < 2"))


def test_cadence(spark, readings, tmp_path):
    deliver(readings, str(tmp_path / "in"), 0, 10)
    writer = stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen_rows")
    query = run(writer, str(tmp_path / "check"), every="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen_rows").count() == readings.count()
