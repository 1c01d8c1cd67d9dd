"""Stored tables, and streams and loads over them, with failures put in between their steps."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from meterflow.operators.counters import counter_delta, counter_rollup
from meterflow.operators.readings import device_stats
from meterflow.operators.resample import daily_rollup
from meterflow.plans.loads import load_device_stats
from meterflow.sources.stored import FAN, KEPT_VERSIONS, ConcurrentChange, StoredTable
from meterflow.streaming import ingest_stream, rollup_stream, run
from meterflow.streaming.stored import (
    KeyIndex,
    daily_flow,
    daily_parts,
    daily_view,
    dedup_flow,
    delta_flow,
    delta_into,
    delta_tables,
    once_only,
    rollup_flow,
    rollup_tables,
    store_stream,
)

PAIRS = StructType([StructField("k", IntegerType()), StructField("v", StringType())])
READINGS = "series string, ts timestamp, cumul bigint, curr bigint"
TOPS = ({"peak": "curr"}, {"cumul": "cumul"})


class Stopped(RuntimeError):
    pass


@pytest.fixture
def failing(monkeypatch):
    """Lets the n-th publication from now on fail, after its data has been written."""

    def arm(n):
        publish, left = StoredTable._publish, [n]

        def fail(self, *args, **kwargs):
            left[0] -= 1
            if left[0] == 0:
                raise Stopped
            return publish(self, *args, **kwargs)

        monkeypatch.setattr(StoredTable, "_publish", fail)

    return arm


@pytest.fixture
def pairs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), PAIRS)


def folders(path):
    return [n for n in os.listdir(path) if n.startswith("data=")]


def test_append_and_overwrite_once(spark, rows, pairs, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), PAIRS)
    assert table.read().count() == 0 and table.manifest().version == -1
    assert table.append(pairs((1, "a"), (1, "a")), ("file-1", 0)) and not table.append(pairs((1, "a")), ("file-1", 0))
    assert table.append(pairs((2, None)), ("file-2", 0), {"until": 7})
    assert rows(table.read()) == [(1, "a"), (1, "a"), (2, None)] and table.manifest().marks == {"until": 7}
    # From itself, with its columns in another order.
    assert table.overwrite(table.read().where("k = 2").select("v", "k"), ("mend", 1))
    assert not table.overwrite(pairs((9, "x")), ("mend", 0)) and rows(table.read()) == [(2, None)]
    assert table.append(pairs(), ("file-3", 0)) and table.read().count() == 1


def test_a_failed_change_leaves_the_table(spark, rows, pairs, tmp_path, failing, monkeypatch):
    path = str(tmp_path / "t")
    table = StoredTable(spark, path, PAIRS)
    table.append(pairs((1, "a")), ("f", 0))
    failing(1)
    with pytest.raises(Stopped):
        table.overwrite(pairs((5, "b")), ("g", 0))
    assert rows(table.read()) == [(1, "a")] and len(folders(path)) == 2
    assert table.overwrite(pairs((5, "b")), ("g", 0)) and rows(table.read()) == [(5, "b")]
    assert table.vacuum() == 1 and rows(table.read()) == [(5, "b")]
    # Another writer has published in the meantime.
    old = table.manifest()
    table.append(pairs((6, "c")), ("f", 1))
    monkeypatch.setattr(table, "manifest", lambda: old)
    with pytest.raises(ConcurrentChange):
        table.append(pairs((7, "d")), ("f", 2))
    monkeypatch.undo()
    assert rows(table.read()) == [(5, "b"), (6, "c")]


def test_folders_are_merged(spark, rows, pairs, tmp_path):
    path = str(tmp_path / "t")
    sums = lambda df: df.groupBy("v").agg(F.sum("k").cast("int").alias("k"))
    table = StoredTable(spark, path, PAIRS, ["v"], merge=sums)
    n = FAN * 3 + 2
    for i in range(n):
        table.append(pairs((i, "a"), (1, "b")), ("f", i))
    manifest = table.manifest()
    assert len(manifest.folders) == 3 + 2 and {level for _, level in manifest.folders} == {0, 1}
    assert rows(sums(table.read()), "v", "k") == [("a", n * (n - 1) // 2), ("b", n)] and table.read().count() == 5 * 2
    # Manifests and folders of versions long gone are deleted, those of the last ones are not.
    assert len(os.listdir(f"{path}/_manifest")) <= 2 * KEPT_VERSIONS + 2
    assert len(folders(path)) < n


# Streams


@pytest.fixture
def readings(spark):
    """Two series over ten hours with a gap."""
    hours = [0, 1, 2, 3, 6, 7, 8, 9]
    data = [(s, f"2024-01-01 {h:02d}:{m:02d}:00", (h * 60 + m) * k, m) for s, k in (("a", 1), ("b", 3)) for h in hours for m in (0, 20, 40)]
    df = spark.createDataFrame(data, "series string, t string, cumul bigint, curr bigint")
    return df.select("series", F.col("t").cast("timestamp").alias("ts"), "cumul", "curr")


@pytest.fixture
def feed(spark, tmp_path):
    """Deliver files, then start a stream over them that takes one file a batch."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")

    def go(writer_of, *deliveries):
        for df in deliveries:
            df.coalesce(1).write.mode("append").parquet(source)
        stream = ingest_stream(spark, source, StructType.fromDDL(READINGS), max_files=1)
        query = run(writer_of(stream), check)
        query.awaitTermination()

    return go


def hours(df, low, high):
    return df.where((F.hour("ts") >= low) & (F.hour("ts") < high))


def test_stream_is_stored_once_over_failures(spark, rows, readings, feed, tmp_path, failing):
    table = StoredTable(spark, str(tmp_path / "out"), StructType.fromDDL(READINGS + ", day date"), ["day"])
    to = lambda stream: store_stream(stream, table, ("day", "ts"))
    failing(2)  # the first batch is published, the second one is written and then cut off
    with pytest.raises(Exception, match="Stopped"):
        feed(to, *[hours(readings, h, h + 2) for h in (0, 2, 6)])
    assert table.read().count() == hours(readings, 0, 2).count() and len(folders(table.path)) == 2
    feed(to, hours(readings, 8, 10))
    feed(to)
    assert rows(table.read().drop("day")) == rows(readings) and len(table.manifest().loads) == 1
    assert table.vacuum() == 1


def test_repeated_keys_at_any_distance(spark, rows, readings, feed, tmp_path):
    late = readings.withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS")).withColumn("series", F.when(F.col("series") == "a", "a"))
    for bits, part in ((1 << 23, "exact"), (8, "full")):  # in a full bitmap every key is looked up
        out = StoredTable(spark, str(tmp_path / part / "out"), StructType.fromDDL(READINGS))
        index = KeyIndex(spark, str(tmp_path / part / "index"), ["series", "ts"], "ts", bits)
        for n, batch in enumerate((readings.unionByName(readings), late, readings.withColumn("curr", F.lit(99).cast("bigint")), late)):
            once_only(batch, ("s", n), index, ["curr"], lambda new, n=n: out.append(new, ("s", n)))
        assert rows(out.read()) == rows(readings.unionByName(late))


def test_dedup_flow_over_starts_and_failures(spark, rows, readings, feed, tmp_path, failing, monkeypatch):
    out = StoredTable(spark, str(tmp_path / "out"), StructType.fromDDL(READINGS + ", day date"), ["day"])
    index = KeyIndex(spark, str(tmp_path / "index"), ["series", "ts"], "ts")
    to = lambda stream: dedup_flow(stream, index, out, ["curr"], ("day", "ts"))
    feed(to, hours(readings, 0, 4), hours(readings, 2, 8))
    # Cut off at the rows, then at the bitmaps, then at the digests of one batch.
    for publication, delivery in ((1, [hours(readings, 0, 10)]), (2, []), (2, [])):
        monkeypatch.undo()
        failing(publication)
        with pytest.raises(Exception, match="Stopped"):
            feed(to, *delivery)
    monkeypatch.undo()
    feed(to)
    assert rows(out.read().drop("day")) == rows(readings)


def test_daily_view_costs_what_a_batch_costs(spark, rows, readings, feed, tmp_path):
    zone, groups = "Europe/Helsinki", ["series"]
    shifted = readings.withColumn("ts", F.col("ts") + F.expr("INTERVAL 15 HOURS"))
    parts = daily_parts(spark, str(tmp_path / "view"), {"series": "string"}, "bigint")
    index = KeyIndex(spark, str(tmp_path / "index"), ["series", "ts"], "ts")
    to = lambda stream: daily_flow(stream, index, "ts", "curr", zone, groups, parts)
    first, second = shifted.where("ts < '2024-01-01 20:00:00'"), shifted.where("ts >= '2024-01-01 20:00:00'")
    feed(to, first)
    # What is stored for the days is hidden: a batch that adds to the same days doesn't read it.
    hidden = [f"{parts.path}/{n}" for n in folders(parts.path)]
    for path in hidden:
        shutil.move(path, f"{tmp_path}/{os.path.basename(path)}")
    feed(to, second.unionByName(first.where("series = 'a'")))
    for path in hidden:
        shutil.move(f"{tmp_path}/{os.path.basename(path)}", path)
    cols = ["series", "eventGroupTimestamp", "minvalue", "avgvalue", "maxvalue", "eventCount", "aggregationTimezone"]
    assert rows(daily_view(parts, groups, zone), *cols) == rows(daily_rollup(shifted, "ts", "curr", zone, groups), *cols)


def test_consumption_reads_last_buckets_only(spark, rows, readings, feed, tmp_path):
    made = {}

    def to(stream):
        rolled = rollup_stream(stream, ["series"], "ts", "1 hour", "10 minutes", *TOPS)
        made["out"], made["last"] = delta_tables(spark, str(tmp_path / "d"), rolled.schema, ["series"], "gts", {"use": "cumul"})
        return delta_flow(rolled, ["series"], "gts", "1 hour", {"use": "cumul"}, made["out"], made["last"])

    feed(to, hours(readings, 0, 2), hours(readings, 2, 4))
    kept = [f"{made['out'].path}/{n}" for n in folders(made["out"].path)]
    for path in kept:
        shutil.move(path, f"{tmp_path}/{os.path.basename(path)}")
    feed(to, hours(readings, 6, 8), hours(readings, 8, 10))
    for path in kept:
        shutil.move(f"{tmp_path}/{os.path.basename(path)}", path)
    batch = counter_delta(counter_rollup(readings, ["series"], "ts", "1 hour", *TOPS), ["series"], "gts", "1 hour", {"use": "cumul"})
    cols = ["series", "gts", "cnt", "peak", "cumul", "use"]
    assert rows(made["out"].read(), *cols) == rows(batch.where("gts <= '2024-01-01 09:30:00'"), *cols)
    assert made["last"].read().count() == 2


def test_consumption_cut_off_before_its_state(spark, rows, readings, tmp_path, failing, monkeypatch):
    rolled = counter_rollup(readings, ["series"], "ts", "1 hour", *TOPS)
    out, last = delta_tables(spark, str(tmp_path / "d"), rolled.schema, ["series"], "gts", {"use": "cumul"})
    args = (["series"], "gts", "1 hour", {"use": "cumul"}, out, last)
    cut = F.col("gts") <= "2024-01-01 03:00:00"
    delta_into(rolled.where(cut), *args, ("s", 0))
    failing(2)
    with pytest.raises(Stopped):
        delta_into(rolled.where(~cut), *args, ("s", 1))
    monkeypatch.undo()
    delta_into(rolled.where(~cut), *args, ("s", 1))
    delta_into(rolled.where(~cut), *args, ("s", 1))
    whole = counter_delta(rolled, ["series"], "gts", "1 hour", {"use": "cumul"})
    assert rows(out.read(), "series", "gts", "use") == rows(whole, "series", "gts", "use")


@pytest.mark.parametrize("step", [None, 1, 2, 3])
def test_rolled_and_late_rows_are_the_input(spark, rows, readings, feed, tmp_path, failing, monkeypatch, step):
    tables = rollup_tables(spark, str(tmp_path / "h"), StructType.fromDDL(READINGS), ["series"], "ts", *TOPS)
    closed, opened, late = tables
    to = lambda stream: rollup_flow(stream, ["series"], "ts", "1 hour", "10 minutes", *TOPS, *tables)
    behind = hours(readings, 1, 2).withColumn("curr", F.lit(10**6).cast("bigint"))
    timeless = readings.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))
    feed(to, hours(readings, 0, 3), hours(readings, 3, 4).unionByName(timeless))
    if step:
        failing(step)
        with pytest.raises(Exception, match="Stopped"):
            feed(to, behind.unionByName(hours(readings, 6, 10)))
        monkeypatch.undo()
        feed(to)
    else:
        feed(to, behind.unionByName(hours(readings, 6, 10)))
    want = counter_rollup(readings, ["series"], "ts", "1 hour", *TOPS)
    cols = ["series", "gts", "cnt", "peak", "cumul"]
    assert rows(closed.read(), *cols) == rows(want.where("gts <= '2024-01-01 09:30:00'"), *cols)
    assert rows(opened.read(), *cols) == rows(want.where("gts > '2024-01-01 09:30:00'"), *cols)
    assert rows(late.read().groupBy("reason").count()) == [("bucket closed", behind.count()), ("no time", 1)]


# Loads of any number of meters


def meter_rows(spark, meters, days):
    data = [(f"m{m}", f"2024-01-{d:02d} {h:02d}:00:30", m + h, 100 * d + h + m) for m in meters for d in days for h in (0, 1, 2, 9)]
    df = spark.createDataFrame(data, "id string, t string, power bigint, energy bigint")
    return df.select("id", F.col("t").cast("timestamp").alias("ts"), "power", "energy").withColumn("day", F.to_date("ts"))


def test_device_statistics_in_parts(spark, rows, tmp_path, failing, monkeypatch):
    source, path = str(tmp_path / "readings"), str(tmp_path / "stats")
    cols = ["id", "gts", "cnt", "peak", "cumul", "delta"]

    def load(n, now):
        return load_device_stats(spark.read.parquet(source), path, "ts", "1 hour", "power", "energy", now, ("load", n))

    meter_rows(spark, range(11), (1, 2, 3)).write.partitionBy("day").parquet(source)
    load(0, "2024-01-02 01:30:00")
    # Days before the earliest mark aren't read any more.
    for name in ("day=2024-01-01",):
        shutil.move(f"{source}/{name}", f"{tmp_path}/{name}")
    failing(2)
    with pytest.raises(Stopped):
        load(1, "2024-01-03 05:00:00")
    monkeypatch.undo()
    load(1, "2024-01-03 05:00:00")
    load(1, "2024-01-03 05:00:00")
    shutil.move(f"{tmp_path}/day=2024-01-01", f"{source}/day=2024-01-01")
    # A twelfth meter brings readings of all days; meter 0 is silent from now on.
    meter_rows(spark, (11,), (1, 2, 3, 4)).unionByName(meter_rows(spark, range(1, 11), (4,))).write.mode("append").partitionBy("day").parquet(source)
    stats = load(2, "2024-01-05 00:00:00")
    whole = device_stats(spark.read.parquet(source).withColumnRenamed("ts", "recordTimestamp"), "recordTimestamp", "1 hour", "power", "energy")
    assert rows(stats.read(), *cols) == rows(whole, *cols)
    assert StoredTable(spark, f"{path}/marks", stats.schema).manifest().version == 2
