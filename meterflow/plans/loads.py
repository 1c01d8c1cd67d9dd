"""Incremental loads into stored tables: feed in, raw rows, statistics out.

Each load can be repeated: what is stored already is not stored again. Only single
times (high-water marks) and lists of calendar days come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterflow import schemas
from meterflow.functions.timing import day_key, from_ns, instant, step_interval
from meterflow.operators.counters import carry_in, counter_delta, counter_rollup
from meterflow.operators.filters import bounded, closed_only
from meterflow.operators.keyed import first_per_key, insert_replace, last_per_key, rows_to_insert, upsert_dim
from meterflow.operators.readings import device_rollup, pivot_readings
from meterflow.operators.series import last_seen, newer_than
from meterflow.session import hint_if_small, written
from meterflow.sources.files import read_counter_csv, read_meter_xml
from meterflow.sources.stored import Load, StoredTable
from meterflow.sources.tables import append, overwrite, power_stats_rows, water_stats_rows
from meterflow.streaming.stored import delta_into

STEP = "1 minute"


def _latest_time(df: DataFrame, col: str):
    """Latest time of a table partitioned by day, as a UTC wall clock whatever zone the driver runs in.

    The last day comes from the folders; times are read in that day only.
    """
    last = df.agg(F.max("day")).first()[0]
    return None if last is None else df.where(F.col("day") == last).agg(F.max(col).cast("timestamp_ntz")).first()[0]


def _stored_mark(spark: SparkSession, table: str):
    """Label of the last stored bucket."""
    if not spark.catalog.tableExists(table):
        return None
    return spark.table(table).agg(from_ns(F.max("groupNanoTs")).cast("timestamp_ntz")).first()[0]


def _since(df: DataFrame, ts: str, mark: Column) -> DataFrame:
    """Rows from ``mark`` on; the day column prunes folders."""
    return df.where((F.col(ts) >= mark) & (F.col("day") >= F.to_date(mark)))


def _with_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", day_key(F.col(ts)))


def _append_days(df: DataFrame, table: str) -> None:
    """Append to a table partitioned by day."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.select(*spark.table(table).columns).write.mode("append").insertInto(table)
    else:
        df.write.partitionBy("day").format("parquet").saveAsTable(table)


def replace_in_days(new: DataFrame, table: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Insert-replace into a table partitioned by ``day``; only the touched days are rewritten."""
    spark = new.sparkSession
    new = written(new, "new")
    if not spark.catalog.tableExists(table):
        _append_days(last_per_key(new, keys, order), table)
        return
    days = [r["day"] for r in new.select("day").distinct().collect()]
    if not days:
        return
    stored = spark.table(table).where(F.col("day").isin(days))
    merged = written(insert_replace(stored, new.select(*stored.columns), keys, order), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)


def load_power(spark: SparkSession, feed: str | list[str], raw_table: str, stats_table: str, now=None) -> None:
    """Electricity feed: new rows to the raw table, closed minutes to the statistics."""
    rows = read_counter_csv(spark, feed).drop("eventNanoTs")
    known = spark.catalog.tableExists(raw_table)
    rows = bounded(rows, "ts", mints=_latest_time(spark.table(raw_table), "ts") if known else None)
    # The raw time is a unique key.
    _append_days(_with_day(first_per_key(rows.where(F.col("ts").isNotNull()), ["ts"], rows.columns), "ts"), raw_table)

    raw = spark.table(raw_table)
    names = dict(zip(schemas.CIRCUITS, schemas.FEED_CIRCUITS))
    peaks = {f"c{n}_peak": f"circuit{at}_curr" for n, at in names.items()}
    cumuls = {f"c{n}_cumul": f"circuit{at}_cumul" for n, at in names.items()}
    mark = _stored_mark(spark, stats_table)
    fresh, seed = closed_only(raw, "ts", STEP, now), None
    if mark is not None:
        at = instant(raw, "ts", mark)
        fresh = _since(fresh, "ts", at)
        seed = carry_in(_since(raw, "ts", at - step_interval(STEP)), [], "ts", STEP, mark, cumuls)
    rolled = counter_rollup(fresh, [], "ts", STEP, peaks, cumuls, count="measures_count")
    uses = {f"c{n}_use": f"c{n}_cumul" for n in names}
    # The statistics are read above for the mark only, so appending to them is safe.
    append(power_stats_rows(counter_delta(rolled, [], "gts", STEP, uses, seed=seed)), stats_table)


def load_readings(
    spark: SparkSession,
    replies: str | list[str],
    address: int,
    device_table: str,
    record_table: str,
    reading_table: str,
    now=None,
) -> None:
    """Meter replies: devices upserted, records inserted once, new readings made from them."""
    devices, records = read_meter_xml(spark, replies, address)
    latest = last_per_key(devices, ["address", "id"], ["accessNumber"])
    if spark.catalog.tableExists(device_table):
        stored = spark.table(device_table)
    else:
        stored = spark.createDataFrame([], schemas.DEVICE)
    # Written first: a table is not read and replaced in the same job.
    overwrite(written(upsert_dim(stored, latest, ["address", "id"], now), "devices"), device_table)

    key = ["address", "id", "recordId", "recordTimestamp"]
    dated = _with_day(records.where(F.col("recordTimestamp").isNotNull()), "recordTimestamp")
    if spark.catalog.tableExists(record_table):
        days = [r["day"] for r in dated.select("day").distinct().collect()]
        known = spark.table(record_table).where(F.col("day").isin(days))
        fresh = rows_to_insert(known, dated, key, ["accessNumber", "recordValue"])
    else:
        fresh = first_per_key(dated, key, ["accessNumber", "recordValue"])
    _append_days(written(fresh, "records"), record_table)

    stored_records = spark.table(record_table)
    if spark.catalog.tableExists(reading_table):
        marks = last_seen(spark.table(reading_table), ["id"], "recordTimestamp")
        stored_records = newer_than(stored_records, marks, "id", "recordTimestamp")
    readings = _with_day(pivot_readings(stored_records), "recordTimestamp")
    replace_in_days(readings, reading_table, ["accessNumber", "id", "recordTimestamp"], ["address"])


def load_water(spark: SparkSession, reading_table: str, stats_table: str, devices: list[str], now=None) -> None:
    """Closed minutes of up to eight heat meters to their statistics; more are an error (``operators.readings.device_stats`` takes any number).

    The bucket before the stored mark is rolled up again as the predecessor, so loading in
    parts gives what one load would.
    """
    readings = spark.table(reading_table)
    mark = _stored_mark(spark, stats_table)
    ts, fresh, seed = "recordTimestamp", closed_only(readings, "recordTimestamp", STEP, now), None
    cumuls = [f"c{n}_cumul" for n in range(1, len(devices) + 1)]
    if mark is not None:
        at = instant(readings, ts, mark)
        before = _since(readings, ts, at - step_interval(STEP)).where(F.col(ts) < at)
        seed = device_rollup(before, devices, ts, STEP, "power", "heatingEnergy").select("gts", *cumuls)
        fresh = _since(fresh, ts, at)
    side = device_rollup(fresh, devices, ts, STEP, "power", "heatingEnergy")
    used = counter_delta(side, [], "gts", STEP, {f"c{n}_delta": c for n, c in enumerate(cumuls, 1)}, seed=seed)
    append(water_stats_rows(used), stats_table)


def load_device_stats(
    readings: DataFrame, path: str, ts: str, step: str, power: str, energy: str, now, load: Load, device: str = "id"
) -> StoredTable:
    """Closed buckets of any number of meters to their statistics below ``path``, a row for each meter and bucket.

    A marks table beside the statistics holds the last stored bucket of every meter with its counter. A load reads
    only readings from the earliest mark on (by day where the readings have a ``day``) and of each meter those after
    its own mark; older ones only of meters that turn up for the first time. It reads nothing of the statistics. A load that is repeated changes nothing, and a load that was
    cut off between the statistics and the marks is taken up there.
    """
    spark = readings.sparkSession
    of = {f.name: f.dataType.simpleString() for f in readings.schema}
    base = f"`{device}` {of[device]}, gts {of[ts]}, cnt bigint, peak {of[power]}, cumul {of[energy]}"
    stats = StoredTable(spark, f"{path}/stats", StructType.fromDDL(f"{base}, delta {of[energy]}, prev_gts {of[ts]}, day date"), ["day"])
    last = StoredTable(spark, f"{path}/marks", StructType.fromDDL(f"`{device}` {of[device]}, cumul {of[energy]}, gts {of[ts]}"))
    if last.holds(load):
        return stats
    marks = last.read()
    fresh = closed_only(readings.where(F.col(device).isNotNull()), ts, step, now)
    earliest = marks.agg(F.min("gts").cast("timestamp_ntz")).first()[0]
    if earliest is not None:
        at = instant(readings, ts, earliest)
        known = hint_if_small(marks.select(device, F.col("gts").alias("__mark")))
        late = F.col(ts) >= at
        recent = fresh.where(late & (F.col("day") >= F.to_date(at)) if "day" in fresh.columns else late)
        recent = recent.join(known, device, "left").where(F.col("__mark").isNull() | (F.col(ts) >= F.col("__mark")))
        # A meter that turns up without a mark takes its older readings as well; only then are any of them read.
        new = written(recent.where(F.col("__mark").isNull()).select(device).distinct(), "new-meters")
        fresh = recent.drop("__mark")
        if not new.isEmpty():
            fresh = fresh.unionByName(closed_only(readings, ts, step, now).where(~late).join(hint_if_small(new), device, "left_semi"))
    rolled = counter_rollup(fresh, [device], ts, step, {"peak": power}, {"cumul": energy})
    delta_into(written(rolled, "device-buckets"), [device], "gts", step, {"delta": "cumul"}, stats, last, load)
    return stats


def load_climate(events: DataFrame, table: str) -> None:
    """Climate events: the first of each key is stored, stored ones stay."""
    spark = events.sparkSession
    key = ["sourceType", "sourceId", "eventType", "eventTimestamp"]
    dated = _with_day(events, "eventTimestamp")
    if spark.catalog.tableExists(table):
        days = [r["day"] for r in dated.select("day").distinct().collect()]
        fresh = rows_to_insert(spark.table(table).where(F.col("day").isin(days)), dated, key, ["value"])
        _append_days(written(fresh, "climate"), table)
    else:
        _append_days(first_per_key(dated, key, ["value"]), table)
