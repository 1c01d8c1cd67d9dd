"""Loads and streams over stored tables: in parts, repeated, and begun again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators.counters import counter_rollup
from meterflow.plans.feed_queries import _CLOSED_SQL
from meterflow.plans.loads import load_device_stats
from meterflow.plans.registry import COUNTERS_SQL, counters, ntz, query, table
from meterflow.session import scratch_path
from meterflow.sources.stored import StoredTable
from meterflow.sources.tables import load_series, scan
from meterflow.streaming.flows import ingest_stream, rollup_stream, run
from meterflow.streaming.stored import (
    KeyIndex,
    daily_flow,
    daily_parts,
    daily_view,
    dedup_flow,
    delta_flow,
    delta_tables,
    rollup_flow,
    rollup_tables,
    store_stream,
)


@query("append_twice_once", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def append_twice_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts appended, the second one twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = StoredTable(spark, scratch_path(spark, "append"), orders.schema)
    for k in (0, 1, 1, 2):
        store.append(orders.where(F.col("o_orderkey") % 3 == k), ("orders", k))
    return store.read()


@query("overwrite_versioned", "SELECT o_orderkey, o_totalprice * 2 AS price, 2 AS version FROM orders WHERE o_orderkey % 2 = 0")
def overwrite_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by a part of itself; the first load, repeated afterwards, changes nothing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("version"))
    store = StoredTable(spark, scratch_path(spark, "overwrite"), orders.schema)
    store.overwrite(orders, ("prices", 1))
    half = store.read().where(F.col("o_orderkey") % 2 == 0)
    store.overwrite(half.withColumn("price", F.col("price") * 2).withColumn("version", F.lit(2)), ("prices", 2))
    store.overwrite(orders, ("prices", 1))
    return store.read()


def _delivery() -> Column:
    """Events come in three deliveries by day of the month."""
    return F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))


class _Feed:
    """A folder that gets deliveries, and the stream that reads it; every delivery starts the stream anew."""

    def __init__(self, spark: SparkSession, name: str, rows: DataFrame):
        self.spark, self.path, self.schema, self.n = spark, scratch_path(spark, name), rows.schema, 0

    def deliver(self, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.path}/in/delivery-{self.n}")
        self.n += 1
        return ingest_stream(self.spark, f"{self.path}/in/delivery-*", self.schema)

    def run(self, writer) -> None:
        run(writer, f"{self.path}/checkpoint").awaitTermination()


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_resume", f"WITH {COUNTERS_SQL} SELECT * FROM m")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries to a stream that stops after each; the last start finds nothing new."""
    rows = _timed(spark, sf_dir)
    feed = _Feed(spark, "resume", rows)
    store = StoredTable(spark, f"{feed.path}/rows", rows.withColumn("day", F.to_date("ts")).schema, ["day"])
    for k in range(3):
        stream = feed.deliver(rows.where(_delivery() == k))
        feed.run(store_stream(stream, store, ("day", "ts")))
    feed.run(store_stream(stream, store, ("day", "ts")))
    return store.read().drop("day").withColumn("ts", ntz("ts"))


@query("stream_dedup_late", f"WITH {COUNTERS_SQL} SELECT * FROM m")
def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come again ten and twenty days later, in other starts of the stream, are stored once."""
    rows = _timed(spark, sf_dir)
    feed = _Feed(spark, "dedup", rows)
    store = StoredTable(spark, f"{feed.path}/rows", rows.schema)
    index = KeyIndex(spark, f"{feed.path}/index", ["cumul", "ts"], "ts")
    for k in range(3):
        again = rows.where((_delivery() < k) & (F.col("cumul") % 5 == k))
        stream = feed.deliver(rows.where(_delivery() == k).unionByName(again))
        feed.run(dedup_flow(stream, index, store, ["user_id"]))
    return store.read().withColumn("ts", ntz("ts"))


@query(
    "stream_daily_restarts",
    f"""WITH {COUNTERS_SQL} SELECT series, strftime(timezone('Europe/Helsinki', timezone('UTC', ts)), '%Y%m%d')
    AS "eventGroupTimestamp", min(curr) AS "minvalue", round(avg(curr), 6) AS "avgvalue", max(curr) AS "maxvalue",
    count(curr) AS "eventCount" FROM m GROUP BY 1, 2""",
)
def stream_daily_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily view over three deliveries, the later ones with events of days that are in the view, new and repeated."""
    rows = _timed(spark, sf_dir)
    feed = _Feed(spark, "daily", rows)
    groups = {"series": "string"}
    parts = daily_parts(spark, f"{feed.path}/view", groups, "bigint")
    index = KeyIndex(spark, f"{feed.path}/index", ["series", "cumul", "ts"], "ts")
    held_back = F.col("cumul") % 7 == 3
    for k in range(3):
        mine = rows.where((_delivery() == k) & ~held_back)
        more = rows.where((_delivery() == k - 1) & held_back) if k < 2 else rows.where((_delivery() >= k - 1) & held_back)
        again = rows.where((_delivery() < k) & (F.col("cumul") % 6 == 1) & ~held_back)
        stream = feed.deliver(mine.unionByName(more).unionByName(again))
        feed.run(daily_flow(stream, index, "ts", "curr", "Europe/Helsinki", [*groups], parts))
    return daily_view(parts, [*groups], "Europe/Helsinki").select(
        "series", "eventGroupTimestamp", "minvalue", F.round("avgvalue", 6).alias("avgvalue"), "maxvalue", "eventCount"
    )


@query(
    "stream_delta_restarts",
    f"""WITH {COUNTERS_SQL}, {_CLOSED_SQL} SELECT c.series, c.gts, c.cnt, c.peak, c.cumul, c.cumul - p.cumul AS use
    FROM c LEFT JOIN c p ON p.series = c.series AND p.gts = c.gts - INTERVAL 1 HOUR""",
)
def stream_delta_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumption of closed hours over three starts; each batch reads the last hour of each series and no more."""
    rows = _timed(spark, sf_dir)
    feed = _Feed(spark, "delta", rows)
    for k in range(3):
        stream = feed.deliver(rows.where(_delivery() == k))
        rolled = rollup_stream(stream, ["series"], "ts", "1 hour", "10 minutes", {"peak": "curr"}, {"cumul": "cumul"})
        store, last = delta_tables(spark, f"{feed.path}/delta", rolled.schema, ["series"], "gts", {"use": "cumul"})
        feed.run(delta_flow(rolled, ["series"], "gts", "1 hour", {"use": "cumul"}, store, last))
    return store.read().select("series", ntz("gts"), "cnt", "peak", "cumul", "use")


@query(
    "stream_rollup_late",
    f"""WITH {COUNTERS_SQL},
    d AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS gts,
        least(2, (day(ts) - 1) // 10 + CASE WHEN cumul % 20 = 7 THEN 1 ELSE 0 END) AS k FROM m),
    marks AS (SELECT k, max(max(ts)) OVER (ORDER BY k) - INTERVAL 10 MINUTE AS mark FROM d GROUP BY k),
    j AS (SELECT d.*, coalesce(gts <= b.mark, false) AS late FROM d LEFT JOIN marks b ON b.k = d.k - 1)
    SELECT CASE WHEN late THEN 'late' WHEN gts <= (SELECT max(mark) FROM marks) THEN 'closed' ELSE 'open' END AS state,
        series, gts, count(*) AS cnt, max(curr) AS peak, max(cumul) AS cumul FROM j GROUP BY 1, 2, 3""",
)
def stream_rollup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open hours, and the rows that came after their hour was closed: together all rows of the feed."""
    rows = _timed(spark, sf_dir)
    feed = _Feed(spark, "late", rows)
    tops = {"peak": "curr"}, {"cumul": "cumul"}
    closed, opened, late = rollup_tables(spark, f"{feed.path}/hours", rows.schema, ["series"], "ts", *tops)
    delivery = F.least(F.lit(2), _delivery() + F.when(F.col("cumul") % 20 == 7, 1).otherwise(0))
    for k in range(3):
        stream = feed.deliver(rows.where(delivery == k))
        feed.run(rollup_flow(stream, ["series"], "ts", "1 hour", "10 minutes", *tops, closed, opened, late))
    names = ["series", "gts", "cnt", "peak", "cumul"]
    states = {"closed": closed.read(), "open": opened.read(), "late": counter_rollup(late.read(), ["series"], "ts", "1 hour", *tops)}
    found = [df.select(F.lit(state).alias("state"), *names) for state, df in states.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("gts", ntz("gts"))


@query(
    "load_stats_parts",
    """WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, date_trunc('day', l_shipdate) + INTERVAL 1 DAY AS gts, count(*) AS cnt,
    max(CAST(l_quantity AS BIGINT)) AS peak, max(l_orderkey) AS cumul FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2)
    SELECT b.id, b.gts, b.cnt, b.peak, b.cumul, b.cumul - p.cumul AS delta FROM b
    LEFT JOIN b p ON p.id = b.id AND p.gts = b.gts - INTERVAL 1 DAY""",
)
def load_stats_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of as many meters as there are suppliers, loaded up to three times of the clock; one load is run twice."""
    readings = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("recordTimestamp"),
        F.col("l_quantity").cast("bigint").alias("power"),
        F.col("l_orderkey").alias("heatingEnergy"),
    )
    path = scratch_path(spark, "device-stats")
    for number, now in enumerate(("1993-06-15 12:00:00", "1996-02-29 00:00:00", "1996-02-29 00:00:00", "1998-01-01 00:00:00")):
        stats = load_device_stats(readings, path, "recordTimestamp", "1 day", "power", "heatingEnergy", now, ("meters", number))
    return stats.read().select("id", ntz("gts"), "cnt", "peak", "cumul", "delta")


@query(
    "load_series_text",
    "SELECT o_orderdate AS ts, o_custkey, o_totalprice FROM orders",
)
def load_series_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series from Parquet whose time is stored as ISO text in UTC."""
    path = scratch_path(spark, "series-text")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    table(spark, sf_dir, "orders").withColumn("at", text).drop("o_orderdate").write.parquet(path)
    return load_series(spark, path, ["o_custkey", "o_totalprice"], "at", "text").withColumn("ts", ntz("ts"))


@query("load_series_ns", "SELECT ts, user_id, value FROM events")
def load_series_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series from Parquet whose time is stored in nanoseconds."""
    path = scratch_path(spark, "series-ns")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    table(spark, sf_dir, "events").select(ns.alias("eventNanoTs"), "user_id", "value", "event_type").write.parquet(path)
    return load_series(spark, path, ["user_id", "value"], "eventNanoTs", "ns").withColumn("ts", ntz("ts"))


@query("scan_table", "SELECT * FROM nation")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a table by its name."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("scanned_nation")
    return scan(spark, "scanned_nation")
