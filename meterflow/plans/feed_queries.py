"""Feeds written from the given tables and read back, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators.readings import device_stats
from meterflow.plans.requests import export_range
from meterflow.plans.registry import COUNTERS_SQL, counters, ntz, query, table
from meterflow.schemas import METER_FEED
from meterflow.session import scratch_path, small_side
from meterflow.sources.climate import explode_measures, measure_rejects
from meterflow.sources.files import (
    page_columns,
    read_counter_csv,
    read_counter_pages,
    read_day_files,
    read_meter_csv,
    read_meter_replies,
    read_meter_xml,
)
from meterflow.sources.tables import write_csv
from meterflow.streaming.flows import (
    daily_view_stream,
    dedup_stream,
    delta_stream,
    ingest_stream,
    rollup_stream,
    run,
)


@query(
    "explode_measures",
    """SELECT event_id, ts, "sourceId", "eventType", value FROM (
    SELECT event_id, date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS "sourceId", 'Temperature' AS "eventType",
    value FROM events UNION ALL
    SELECT event_id, date_trunc('second', ts), CAST(user_id AS VARCHAR), 'Humidity', CAST(event_id % 100 AS DOUBLE)
    FROM events WHERE event_type != 'error')""",
)
def explode_measures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per event; the second value is missing for errors."""
    second = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    humidity = F.when(F.col("event_type") == "error", F.lit("null")).otherwise((F.col("event_id") % 100).cast("string"))
    reply = F.concat(
        F.lit('{"body":{"'), second, F.lit('":['), F.col("value").cast("string"), F.lit(","), humidity, F.lit("]}}")
    )
    replies = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("device"), reply.alias("value")
    )
    rows = explode_measures(replies, ["Temperature", "Humidity"], F.col("device"), "outdoor", "station", keep=["event_id"])
    return rows.select(
        "event_id",
        F.col("eventTimestamp").cast("timestamp_ntz").alias("ts"),
        "sourceId",
        "eventType",
        F.col("value").cast("double").alias("value"),
    )


@query(
    "counter_pages",
    f"""WITH {COUNTERS_SQL} SELECT cumul AS id, cumul AS circuit9_cumul, CASE WHEN series = 'view' THEN NULL ELSE user_id END
    AS circuit16_cumul, curr AS circuit9_curr, CAST(NULL AS BIGINT) AS circuit16_curr FROM m""",
)
def counter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter page per event; cells that are no number are null, the last element is masked."""
    cells = [F.lit(str(n)) for n in range(26)]
    cells[9], cells[18], cells[25] = (F.col(c).cast("string") for c in ("cumul", "curr", "curr"))
    cells[16] = F.when(F.col("series") == "view", F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    page = F.concat(F.lit("<html><body>"), F.concat_ws(",", *cells), F.lit("<br>\n</body></html>"))
    pages = counters(spark, sf_dir).select(F.col("cumul").alias("id"), page.alias("page"))
    columns = page_columns(F.col("page"), include=range(9, 25))
    return pages.select("id", *columns).select("id", "circuit9_cumul", "circuit16_cumul", "circuit9_curr", "circuit16_curr")


def _counter_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter table with the columns of a feed; what the given tables lack is null."""
    rows = counters(spark, sf_dir)
    given = {
        "circuit9_cumul": F.col("cumul"),
        "circuit10_cumul": F.col("user_id"),
        "circuit9_curr": F.when(F.col("series") != "error", F.col("curr")),
    }
    cells = [f"circuit{n}_{part}" for part in ("cumul", "curr") for n in range(9, 17)]
    return rows.select(
        F.col("cumul").alias("id"), "ts", *[given.get(c, F.lit(None).cast("bigint")).alias(c) for c in cells]
    )


@query(
    "csv_roundtrip",
    f"""WITH {COUNTERS_SQL} SELECT epoch_us(ts) * 1000 AS "eventNanoTs", ts, cumul AS circuit9_cumul,
    CASE WHEN series != 'error' THEN curr END AS circuit9_curr, user_id AS circuit10_cumul FROM m""",
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of the counter table and its read on the other side; quoted text and nulls included."""
    feed = _counter_feed(spark, sf_dir)
    path = scratch_path(spark, "power-feed")
    write_csv(feed, path, ts_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    back = read_counter_csv(spark, path)
    return back.select("eventNanoTs", ntz("ts"), "circuit9_cumul", "circuit9_curr", "circuit10_cumul")


@query(
    "export_range",
    f"""WITH {COUNTERS_SQL} SELECT epoch_us(ts) * 1000 AS "eventNanoTs", ts, cumul AS circuit9_cumul,
    CASE WHEN series != 'error' THEN curr END AS circuit9_curr, user_id AS circuit10_cumul FROM m
    WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-14 18:00:00'""",
)
def export_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows between two times, exported and read on the other side."""
    path = scratch_path(spark, "range-export")
    bounds = ("2024-01-10 06:30:00", "2024-01-14 18:00:00")
    export_range(_counter_feed(spark, sf_dir), path, *bounds, ts_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    back = read_counter_csv(spark, path)
    return back.select("eventNanoTs", ntz("ts"), "circuit9_cumul", "circuit9_curr", "circuit10_cumul")


@query(
    "meter_csv",
    """SELECT epoch_us(l_shipdate) * 1000 AS "recordNanoTs", l_orderkey AS "accessNumber", CAST(l_suppkey AS VARCHAR) AS id,
    l_shipdate AS "recordTimestamp", CAST(l_quantity AS BIGINT) AS "heatingEnergy", l_discount AS temp1 FROM lineitem""",
)
def meter_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {
        "rowId": F.col("l_linenumber").cast("bigint"),
        "accessNumber": F.col("l_orderkey"),
        "id": F.col("l_suppkey").cast("string"),
        "recordTimestamp": F.col("l_shipdate"),
        "heatingEnergy": F.col("l_quantity").cast("bigint"),
        "temp1": F.col("l_discount"),
    }
    feed = table(spark, sf_dir, "lineitem").select(
        *[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in METER_FEED]
    )
    path = scratch_path(spark, "meter-feed")
    write_csv(feed, path)
    return read_meter_csv(spark, path).select(
        "recordNanoTs", "accessNumber", "id", ntz("recordTimestamp"), "heatingEnergy", "temp1"
    )


@query(
    "day_files",
    """SELECT date_trunc('second', ts) AS ts,
    timezone('Europe/Helsinki', timezone('UTC', date_trunc('second', ts))) AS local_ts, value,
    CAST(event_id % 100 AS INTEGER) AS humidity FROM events""",
)
def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Helsinki"), F.col("ts"))
    path = scratch_path(spark, "day-files")
    table(spark, sf_dir, "events").select(
        F.unix_seconds(at).alias("Timestamp"),
        F.date_format(local, "yyyy/MM/dd HH:mm:ss").alias("ts"),
        "value",
        (F.col("event_id") % 100).cast("int").alias("Humidity"),
    ).write.csv(path, sep=";", header=True)
    return read_day_files(spark, path).withColumn("ts", ntz("ts"))


@query(
    "meter_xml",
    """SELECT CAST(l_suppkey AS VARCHAR) AS id, l_orderkey AS "accessNumber", 11 AS "recordId",
    'Power;100;W' AS "recordUnit", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "recordValue",
    l_shipdate AS "recordTimestamp", CASE WHEN l_linenumber > 3 THEN '2' END AS "recordTariff",
    'Maker' AS manufacturer FROM lineitem""",
)
def meter_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meter reply per line item, written as XML and read back as device and record rows."""
    value = lambda name: F.col(name).cast("string")
    tariff = F.when(F.col("l_linenumber") > 3, F.lit("<Tariff>2</Tariff>")).otherwise(F.lit(""))
    reply = F.concat(
        F.lit("<MBusData><SlaveInformation><Id>"),
        value("l_suppkey"),
        F.lit("</Id><Manufacturer>Maker</Manufacturer><Version>1</Version><AccessNumber>"),
        value("l_orderkey"),
        F.lit('</AccessNumber></SlaveInformation><DataRecord id="11"><Function>Instantaneous value</Function>'),
        F.lit("<StorageNumber>0</StorageNumber>"),
        tariff,
        F.lit("<Unit>Power;100;W</Unit><Value>"),
        F.col("l_quantity").cast("bigint").cast("string"),
        F.lit("</Value><Timestamp>"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("</Timestamp></DataRecord></MBusData>"),
    )
    path = scratch_path(spark, "meter-replies")
    # A reply is mostly the same tags. Compressed files are read as one part each, so they stay small (about 36 MB of text).
    feed = table(spark, sf_dir, "lineitem").select(reply.alias("value"))
    feed.write.option("maxRecordsPerFile", 100_000).text(path, compression="gzip")
    devices, records = read_meter_xml(spark, path, address=1)
    makers = devices.groupBy("id").agg(F.max("manufacturer").alias("manufacturer"))
    rows = records.join(small_side(makers), "id")
    return rows.select(
        "id",
        "accessNumber",
        "recordId",
        "recordUnit",
        "recordValue",
        ntz("recordTimestamp"),
        "recordTariff",
        "manufacturer",
    )


@query(
    "measures_bad_cells",
    """SELECT event_id, raw, reason FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_type FROM events),
    LATERAL (SELECT CAST(s AS VARCHAR) || ':0:n/a' AS raw, 'no number' AS reason WHERE event_type = 'error' UNION ALL
    SELECT CAST(s AS VARCHAR) || ':1:123456789012345', 'too large' WHERE event_type = 'signup' UNION ALL
    SELECT CAST(s AS VARCHAR) || ':2:7', 'no type' WHERE event_type = 'view')""",
)
def measures_bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a cell that is no number, too large or of no type: only that cell is rejected."""
    kind = F.col("event_type")
    cells = [
        F.when(kind == "error", F.lit('"n/a"')).otherwise(F.col("value").cast("string")),
        F.when(kind == "signup", F.lit("123456789012345")).otherwise(F.lit("5")),
    ]
    body = F.concat_ws(",", *cells, F.when(kind == "view", F.lit("7")))
    second = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    replies = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit('{"body":{"'), second, F.lit('":['), body, F.lit("]}}")).alias("value")
    )
    rejects = measure_rejects(replies, ["Temperature", "Humidity"], "station", keep=["event_id"])
    return rejects.select("event_id", "raw", "reason")


@query(
    "counter_page_files",
    f"""WITH {COUNTERS_SQL} SELECT cumul AS circuit9_cumul, user_id AS circuit10_cumul, curr AS circuit9_curr FROM m""",
)
def counter_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter pages saved many to a file, through the reader."""
    cells = [F.lit(str(n)) for n in range(26)]
    cells[9], cells[10], cells[18] = (F.col(c).cast("string") for c in ("cumul", "user_id", "curr"))
    page = F.concat(F.lit("<html><body>"), F.concat_ws(",", *cells), F.lit("<br>\n</body></html>"))
    path = scratch_path(spark, "counter-pages")
    counters(spark, sf_dir).select(page.alias("value")).write.text(path)
    return read_counter_pages(spark, path).select("circuit9_cumul", "circuit10_cumul", "circuit9_curr")


@query(
    "csv_columns_reordered",
    f"""WITH {COUNTERS_SQL} SELECT ts, cumul AS circuit9_cumul, user_id AS circuit10_cumul FROM m""",
)
def csv_columns_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily export with its columns in another order, read by name."""
    given = {"circuit9_cumul": F.col("cumul"), "circuit10_cumul": F.col("user_id")}
    cells = [f"circuit{n}_cumul" for n in range(16, 8, -1)]
    path = scratch_path(spark, "reordered")
    rows = counters(spark, sf_dir).select(*[given.get(c, F.lit(None).cast("bigint")).alias(c) for c in cells], "ts")
    write_csv(rows, path, ts_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return read_counter_csv(spark, path, layout="daily").select(ntz("ts"), "circuit9_cumul", "circuit10_cumul")


@query("csv_small_files", "SELECT event_id, value FROM events")
def csv_small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written under a limit of rows for each file, which must cost none."""
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    path = scratch_path(spark, "small-files")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        write_csv(table(spark, sf_dir, "events").select("event_id", "value"), path)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    return spark.read.schema("event_id bigint, value double").option("header", True).csv(path)


@query("xml_rejects", "SELECT reason, count(*) AS n FROM (SELECT 'no device id' AS reason FROM orders WHERE o_orderkey % 7 = 0) GROUP BY 1")
def xml_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of which every seventh has lost its device."""
    value = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<Id>"), F.col("o_custkey").cast("string"), F.lit("</Id>"))
    )
    reply = F.concat(F.lit("<MBusData><SlaveInformation>"), value, F.lit("<Version>1</Version></SlaveInformation></MBusData>"))
    path = scratch_path(spark, "cut-replies")
    table(spark, sf_dir, "orders").select(reply.alias("value")).write.text(path)
    rejects = read_meter_replies(spark, path, 1)[2]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "water_stats_many_devices",
    """WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, date_trunc('day', l_shipdate) + INTERVAL 1 DAY AS gts, count(*) AS cnt,
    max(CAST(l_quantity AS BIGINT)) AS peak, max(l_orderkey) AS cumul FROM lineitem GROUP BY 1, 2)
    SELECT b.id, b.gts, b.cnt, b.peak, b.cumul, b.cumul - p.cumul AS delta FROM b
    LEFT JOIN b p ON p.id = b.id AND p.gts = b.gts - INTERVAL 1 DAY""",
)
def water_stats_many_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of as many meters as there are suppliers, a row for each meter and day."""
    readings = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"),
        F.col("l_shipdate").alias("recordTimestamp"),
        F.col("l_quantity").cast("bigint").alias("power"),
        F.col("l_orderkey").alias("heatingEnergy"),
    )
    stats = device_stats(readings, "recordTimestamp", "1 day", "power", "heatingEnergy")
    return stats.select("id", ntz("gts"), "cnt", "peak", "cumul", "delta")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A file source wants a folder or a pattern; this pattern fits the table as one file or as many.
    rows = ingest_stream(spark, f"{sf_dir}/event[s].parquet", schema)
    return rows.select(
        F.col("event_type").alias("series"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("cumul"),
        F.round(F.col("value") * 100).cast("bigint").alias("curr"),
    )


_CLOSED_SQL = """b AS (SELECT series, date_trunc('hour', ts) + INTERVAL 1 HOUR AS gts, count(*) AS cnt,
    max(curr) AS peak, max(cumul) AS cumul FROM m GROUP BY 1, 2),
    c AS (SELECT * FROM b WHERE gts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM m))"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_stream(
        _event_stream(spark, sf_dir), ["series"], "ts", "1 hour", "10 minutes", {"peak": "curr"}, {"cumul": "cumul"}
    )


@query("stream_rollup", f"WITH {COUNTERS_SQL}, {_CLOSED_SQL} SELECT * FROM c")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hours from a file stream; the running hour is not out yet."""
    path = scratch_path(spark, "stream-rollup")
    rolled = _rolled(spark, sf_dir)
    writer = rolled.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    run(writer, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(rolled.schema).parquet(f"{path}/rows").withColumn("gts", ntz("gts"))


@query(
    "stream_delta",
    f"""WITH {COUNTERS_SQL}, {_CLOSED_SQL} SELECT c.series, c.gts, c.cnt, c.peak, c.cumul, c.cumul - p.cumul AS use
    FROM c LEFT JOIN c p ON p.series = c.series AND p.gts = c.gts - INTERVAL 1 HOUR""",
)
def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream-delta")
    writer = delta_stream(_rolled(spark, sf_dir), ["series"], "gts", "1 hour", {"use": "cumul"}, f"{path}/rows")
    run(writer, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("series", ntz("gts"), "cnt", "peak", "cumul", "use")


@query(
    "stream_daily",
    f"""WITH {COUNTERS_SQL} SELECT series, strftime(timezone('Europe/Helsinki', timezone('UTC', ts)), '%Y%m%d')
    AS "eventGroupTimestamp", min(curr) AS "minvalue", round(avg(curr), 6) AS "avgvalue", max(curr) AS "maxvalue",
    count(curr) AS "eventCount" FROM m GROUP BY 1, 2""",
)
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream-daily")
    writer = daily_view_stream(
        _event_stream(spark, sf_dir),
        ["series", "cumul", "ts"],
        "ts",
        "curr",
        "Europe/Helsinki",
        f"{path}/raw",
        f"{path}/view",
        ["series"],
    )
    run(writer, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/view").select(
        "series", "eventGroupTimestamp", "minvalue", F.round("avgvalue", 6).alias("avgvalue"), "maxvalue", "eventCount"
    )


@query("stream_dedup", f"WITH {COUNTERS_SQL} SELECT cumul, ts, series, curr FROM m")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    path = scratch_path(spark, "stream-dedup")
    twice = _event_stream(spark, sf_dir).unionByName(_event_stream(spark, sf_dir))
    once = dedup_stream(twice.select("cumul", "ts", "series", "curr"), ["cumul"], "ts", "1 hour")
    writer = once.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    run(writer, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{path}/rows").withColumn("ts", ntz("ts"))
