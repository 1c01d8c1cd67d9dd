"""Bounds, local time, daily statistics and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions import bucket, day_key, from_ns, ns_of_seconds, parse_ts, to_local, to_ns, to_utc
from meterflow.operators.filters import bounded, closed_only, for_series, local_range, project, with_params
from meterflow.operators.ordered import moving_avg, prev_row
from meterflow.operators.resample import daily_rollup, daily_stats, resample
from meterflow.operators.shape import day_segments, extent, max_across
from meterflow.plans import requests
from meterflow.plans.registry import COUNTERS_SQL, counters, ntz, query, table
from meterflow.streaming.flows import late_rows

_ZONE = "Europe/Helsinki"
_LOCAL = f"timezone('{_ZONE}', timezone('UTC', ts))"


def _utc(wall: str) -> str:
    return f"timezone('UTC', timezone('{_ZONE}', {wall}))"


_EVENT = ["event_id", "ts", "user_id", "event_type", "value"]
_EVENT_SQL = ", ".join(_EVENT)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_EVENT)


@query(
    "bounded_between",
    f"SELECT {_EVENT_SQL} FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'",
)
def bounded_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(_events(spark, sf_dir), "ts", "2024-01-08T06:00:00.000000Z", "2024-01-20T18:30:00.000000Z")


@query("bounded_after", f"SELECT {_EVENT_SQL} FROM events WHERE ts > TIMESTAMP '2024-01-20 18:30:00'")
def bounded_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(_events(spark, sf_dir), "ts", mints="2024-01-20 18:30:00")


@query("bounded_before", f"SELECT {_EVENT_SQL} FROM events WHERE ts < TIMESTAMP '2024-01-08 06:00:00'")
def bounded_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(_events(spark, sf_dir), "ts", maxts="2024-01-08 06:00:00")


@query("closed_days", f"SELECT {_EVENT_SQL} FROM events WHERE ts < TIMESTAMP '2024-01-29 00:00:00'")
def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_only(_events(spark, sf_dir), "ts", "1 day", "2024-01-29 15:00:00")


@query("late_rows", f"SELECT {_EVENT_SQL} FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def late_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_rows(_events(spark, sf_dir), "ts", "2024-01-15 00:00:00")


@query(
    "local_range_helsinki",
    f"""SELECT event_id, ts, {_LOCAL} AS local_ts, strftime({_LOCAL}, '%Y%m%d') AS day FROM events
    WHERE CAST({_LOCAL} AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
)
def local_range_helsinki(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local_range(table(spark, sf_dir, "events"), "ts", "20240110", "20240112", _ZONE)
    ts = F.col("ts")
    return rows.select("event_id", "ts", to_local(ts, _ZONE).alias("local_ts"), day_key(ts, _ZONE, "yyyyMMdd").alias("day"))


@query("for_series_project", "SELECT ts, value, user_id FROM events WHERE event_type = 'purchase'")
def for_series_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(for_series(table(spark, sf_dir, "events"), event_type="purchase", user_id=None), ["value", "user_id"])


@query(
    "with_params",
    f"""WITH p AS (SELECT TIMESTAMP '2024-01-10 00:00:00' AS lo, 60 AS step)
    SELECT event_id, epoch_us(ts) // (step * 1000000) * step AS slot, ts >= lo AS inside FROM events, p""",
)
def with_params_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_params(_events(spark, sf_dir), lo="2024-01-10 00:00:00", step=60)
    start = F.unix_seconds(bucket(F.col("ts"), "1 minute", "start").cast("timestamp"))
    return rows.select("event_id", start.alias("slot"), (F.col("ts") >= F.col("lo").cast("timestamp_ntz")).alias("inside"))


@query(
    "epoch_roundtrip",
    """SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ns, o_orderdate AS back,
    epoch_us(o_orderdate) // 1000000 * 1000000000 AS second_ns, o_orderdate AS from_iso, o_orderdate AS from_space,
    timezone('Europe/Helsinki', timezone('UTC', o_orderdate)) AS local, o_orderdate AS local_back FROM orders""",
)
def epoch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    space = F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        to_ns(at).alias("ns"),
        from_ns(to_ns(at)).cast("timestamp_ntz").alias("back"),
        ns_of_seconds(F.unix_seconds(at.cast("timestamp"))).alias("second_ns"),
        parse_ts(iso).cast("timestamp_ntz").alias("from_iso"),
        parse_ts(space).cast("timestamp_ntz").alias("from_space"),
        to_local(at, _ZONE).alias("local"),
        to_utc(to_local(at, _ZONE), _ZONE).alias("local_back"),
    )


_STATS_SQL = f"""s AS (SELECT user_id, CAST({_LOCAL} AS DATE) AS d, min(value) AS min, max(value) AS max,
    round(avg(value), 6) AS avg FROM events GROUP BY 1, 2)"""


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select("user_id", F.col("ts").cast("string").alias("ts"), "min", "max", F.round("avg", 6).alias("avg"))


@query("daily_stats_local", f"WITH {_STATS_SQL} SELECT user_id, CAST(d AS VARCHAR) AS ts, min, max, avg FROM s")
def daily_stats_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(daily_stats(_events(spark, sf_dir), "ts", "value", _ZONE, ["user_id"]))


@query(
    "daily_stats_filled",
    f"""WITH {_STATS_SQL}, r AS (SELECT user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
    FROM s GROUP BY 1)
    SELECT user_id, CAST(d AS VARCHAR) AS ts, min, max, avg FROM r LEFT JOIN s USING (user_id, d)""",
)
def daily_stats_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(daily_stats(_events(spark, sf_dir), "ts", "value", _ZONE, ["user_id"], fill=True))


@query(
    "daily_rollup",
    f"""SELECT event_type, strftime({_LOCAL}, '%Y%m%d') AS "eventGroupTimestamp", min(value) AS "minvalue",
    round(avg(value), 6) AS "avgvalue", max(value) AS "maxvalue", count(value) AS "eventCount",
    '{_ZONE}' AS "aggregationTimezone" FROM events GROUP BY 1, 2""",
)
def daily_rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = daily_rollup(_events(spark, sf_dir), "ts", "value", _ZONE, ["event_type"])
    return view.withColumn("avgvalue", F.round("avgvalue", 6))


@query(
    "clima_daily",
    f"""WITH s AS (SELECT CAST({_LOCAL} AS DATE) AS d, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg
    FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT CAST(r.d AS VARCHAR) AS ts, min, max, avg FROM
    (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM s) r LEFT JOIN s USING (d)""",
)
def clima_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"source": "user_id", "type": "event_type", "ts": "ts"}
    stats = requests.clima_daily(_events(spark, sf_dir), "click", None, _ZONE, columns=names)
    return stats.select(F.col("ts").cast("string").alias("ts"), "min", "max", F.round("avg", 6).alias("avg"))


@query(
    "clima_events",
    f"""SELECT user_id, ts, max(CASE WHEN event_type = 'click' THEN value END) AS click,
    max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events
    WHERE event_type IN ('click', 'view')
    AND ts >= {_utc("TIMESTAMP '2024-01-01'")} AND ts < {_utc("TIMESTAMP '2024-02-01'")} GROUP BY 1, 2""",
)
def clima_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"source": "user_id", "type": "event_type", "ts": "ts"}
    return requests.clima_events(
        _events(spark, sf_dir), ["click", "view"], None, "20240101", "20240131", _ZONE, columns=names
    )


def _spine_sql(step: str) -> str:
    return f"""r AS (SELECT series, unnest(generate_series(min(b), max(b), INTERVAL {step})) AS b FROM g GROUP BY 1)"""


def _meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir).select("series", "ts", "curr", "cumul")


@query(
    "resample_sum_left",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, date_trunc('hour', ts) AS b, CAST(sum(curr) AS BIGINT) AS curr,
    CAST(sum(cumul) AS BIGINT) AS cumul FROM m GROUP BY 1, 2), {_spine_sql("1 HOUR")}
    SELECT series, b AS ts, curr, cumul FROM r LEFT JOIN g USING (series, b)""",
)
def resample_sum_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "H", "sum", keys=["series"])


@query(
    "resample_mean_right",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, time_bucket(INTERVAL 15 MINUTE, ts) AS b, avg(curr) AS curr
    FROM m GROUP BY 1, 2), {_spine_sql("15 MINUTE")}
    SELECT series, b + INTERVAL 15 MINUTE AS ts, round(curr, 6) AS curr FROM r LEFT JOIN g USING (series, b)""",
)
def resample_mean_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = resample(_meter(spark, sf_dir), "ts", "15T", "mean", "right", cols=["curr"], keys=["series"])
    return means.withColumn("curr", F.round("curr", 6))


@query(
    "resample_local_day",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, date_trunc('day', {_LOCAL}) AS b, max(curr) AS curr,
    max(cumul) AS cumul FROM m GROUP BY 1, 2), {_spine_sql("1 DAY")}
    SELECT series, {_utc("b")} AS ts, curr, cumul FROM r LEFT JOIN g USING (series, b)""",
)
def resample_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "D", "max", tz=_ZONE, keys=["series"])


@query(
    "resample_count_minutes",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, time_bucket(INTERVAL 5 MINUTE, ts) AS b, count(curr) AS curr
    FROM m GROUP BY 1, 2), {_spine_sql("5 MINUTE")}
    SELECT series, b AS ts, coalesce(curr, 0) AS curr FROM r LEFT JOIN g USING (series, b)""",
)
def resample_count_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "5min", "count", tz=_ZONE, cols=["curr"], keys=["series"])


@query(
    "resample_last_week",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, date_trunc('week', {_LOCAL}) AS b, max_by(curr, ts) AS curr,
    max_by(cumul, ts) AS cumul FROM m GROUP BY 1, 2)
    SELECT series, {_utc("CAST(b AS TIMESTAMP) + INTERVAL 6 DAY")} AS ts, curr, cumul FROM g""",
)
def resample_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "W", "last", "right", _ZONE, keys=["series"])


@query(
    "resample_first_month",
    """WITH g AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS b,
    max(o_orderdate) - min(o_orderdate) AS span, min_by(o_totalprice, o_orderdate + o_orderkey * INTERVAL 1 MICROSECOND) AS first_price
    FROM orders GROUP BY 1, 2),
    r AS (SELECT o_orderpriority, CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 MONTH)) AS TIMESTAMP) AS b
    FROM g GROUP BY 1)
    SELECT o_orderpriority, b - INTERVAL 1 DAY AS ts, first_price FROM r LEFT JOIN g USING (o_orderpriority, b)""",
)
def resample_first_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order value of each month; the order number tells orders of one day apart."""
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", at.alias("at"), F.col("o_totalprice").alias("first_price"))
    return resample(orders, "at", "M", "first", "left", keys=["o_orderpriority"])


@query(
    "resample_3h_local",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, time_bucket(INTERVAL 3 HOUR, {_LOCAL}) AS b, max(curr) AS curr
    FROM m GROUP BY 1, 2), {_spine_sql("3 HOUR")}
    SELECT series, {_utc("b")} AS ts, curr FROM r LEFT JOIN g USING (series, b)""",
)
def resample_3h_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour buckets from local midnight."""
    return resample(_meter(spark, sf_dir), "ts", "180min", "max", tz=_ZONE, cols=["curr"], keys=["series"])


@query(
    "resample_30s",
    f"""WITH {COUNTERS_SQL} SELECT series, time_bucket(INTERVAL 30 SECOND, ts) + INTERVAL 30 SECOND AS ts,
    CAST(sum(curr) AS BIGINT) AS curr FROM m GROUP BY 1, 2""",
)
def resample_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "30S", "sum", "right", cols=["curr"], keys=["series"], fill=False)


@query(
    "resample_2d",
    f"""WITH {COUNTERS_SQL}, d AS (SELECT *, CAST(date_trunc('day', {_LOCAL}) AS TIMESTAMP) AS u FROM m),
    f AS (SELECT series, min(u) AS lo FROM d GROUP BY 1),
    g AS (SELECT series, lo + CAST(date_diff('day', lo, u) // 2 * 2 AS INTEGER) * INTERVAL 1 DAY AS b, max(curr) AS curr
    FROM d JOIN f USING (series) GROUP BY 1, 2), {_spine_sql("2 DAY")}
    SELECT series, {_utc("b")} AS ts, curr FROM r LEFT JOIN g USING (series, b)""",
)
def resample_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days at once, from the first local day of each series."""
    return resample(_meter(spark, sf_dir), "ts", "2D", "max", tz=_ZONE, cols=["curr"], keys=["series"])


def _over_a_day(hours: int, how: str) -> str:
    """Buckets of so many hours of the local clock from the first local midnight of each series."""
    return f"""WITH {COUNTERS_SQL}, d AS (SELECT *, {_LOCAL} AS u FROM m),
    f AS (SELECT series, CAST(min(date_trunc('day', u)) AS TIMESTAMP) AS lo FROM d GROUP BY 1),
    g AS (SELECT series, lo + CAST(date_diff('second', lo, date_trunc('second', u)) // ({hours} * 3600) * {hours} AS INTEGER) * INTERVAL 1 HOUR AS b,
    {how} AS curr FROM d JOIN f USING (series) GROUP BY 1, 2), {_spine_sql(f"{hours} HOUR")}
    SELECT series, {_utc("b")} AS ts, curr FROM r LEFT JOIN g USING (series, b)"""


@query("resample_36h", _over_a_day(36, "max(curr)"))
def resample_36h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day and a half at once, from the first local midnight of each series."""
    return resample(_meter(spark, sf_dir), "ts", "36H", "max", tz=_ZONE, cols=["curr"], keys=["series"])


@query("resample_6000min", _over_a_day(100, "CAST(sum(curr) AS BIGINT)"))
def resample_6000min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps given in minutes that are longer than a day: 6,000 minutes are 100 hours."""
    return resample(_meter(spark, sf_dir), "ts", "6000min", "sum", tz=_ZONE, cols=["curr"], keys=["series"])


def _orders_by(unit: str, months: int) -> str:
    return f"""WITH g AS (SELECT o_orderpriority, date_trunc('{unit}', o_orderdate) AS b, count(*) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT o_orderpriority, CAST(unnest(generate_series(min(b), max(b), INTERVAL {months} MONTH)) AS TIMESTAMP) AS b
    FROM g GROUP BY 1)
    SELECT o_orderpriority, b + INTERVAL {months} MONTH - INTERVAL 1 DAY AS ts, coalesce(n, 0) AS n
    FROM r LEFT JOIN g USING (o_orderpriority, b)"""


def _orders_per(spark: SparkSession, sf_dir: str, step: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("n"))
    return resample(orders, "o_orderdate", step, "count", "right", keys=["o_orderpriority"])


@query("resample_quarter", _orders_by("quarter", 3))
def resample_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_per(spark, sf_dir, "Q")


@query("resample_year", _orders_by("year", 12))
def resample_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_per(spark, sf_dir, "Y")


@query(
    "resample_median_day",
    f"""WITH {COUNTERS_SQL}, g AS (SELECT series, date_trunc('day', ts) AS b, median(curr) AS curr,
    median(cumul) AS cumul FROM m GROUP BY 1, 2)
    SELECT series, CAST(b AS TIMESTAMP) AS ts, curr, cumul FROM g""",
)
def resample_median_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_meter(spark, sf_dir), "ts", "D", "median", keys=["series"])


@query(
    "resample_std_day",
    f"""WITH {COUNTERS_SQL} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(stddev_samp(curr), 4) AS std,
    round(var_samp(curr), 2) AS var FROM m GROUP BY 1""",
)
def resample_std_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _meter(spark, sf_dir)
    std = resample(rows, "ts", "D", "std", cols=["curr"]).select("ts", F.round("curr", 4).alias("std"))
    var = resample(rows, "ts", "D", "var", cols=["curr"]).select("ts", F.round("curr", 2).alias("var"))
    return std.join(var, "ts")


@query(
    "moving_avg_7",
    """WITH d AS (SELECT o_orderdate AS ts, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY 1, 2)
    SELECT ts, o_orderpriority, cents, round(avg(cents) OVER (PARTITION BY o_orderpriority ORDER BY ts
    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM d""",
)
def moving_avg_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").alias("ts"), "o_orderpriority")
        .agg(F.sum(cents).alias("cents"))
    )
    return moving_avg(days, ["o_orderpriority"], ["ts"], "cents", 7).withColumn("moving_avg", F.round("moving_avg", 4))


@query(
    "prev_row",
    f"""WITH {COUNTERS_SQL} SELECT series, ts, cumul, coalesce(lag(ts) OVER w, ts) AS prev_ts,
    coalesce(lag(cumul) OVER w, cumul) AS prev_cumul FROM m WINDOW w AS (PARTITION BY series ORDER BY ts, cumul)""",
)
def prev_row_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counters(spark, sf_dir).select("series", "ts", "cumul")
    return prev_row(rows, ["series"], ["ts", "cumul"], ["ts", "cumul"])


@query(
    "day_segments",
    f"""SELECT event_type, CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS day, event_id, ts, value,
    row_number() OVER (PARTITION BY event_type, CAST({_LOCAL} AS DATE) ORDER BY ts, event_id) AS pos FROM events""",
)
def day_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    placed = day_segments(points, "ts", _ZONE, ["ts", "event_id"], ["event_type"])
    return placed.withColumn("day", F.col("day").cast("string"))


@query(
    "extent_range",
    """SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, 'all' AS part FROM orders UNION ALL
    SELECT min(o_totalprice), max(o_totalprice), 'open' FROM orders
    WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
)
def extent_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    whole = extent(orders, "o_totalprice", "o_totalprice").withColumn("part", F.lit("all"))
    year = extent(orders, "o_totalprice", "o_totalprice", "o_orderdate", "1996-01-01", "1997-01-01")
    return whole.unionByName(year.withColumn("part", F.lit("open")))


@query(
    "max_across",
    """SELECT max(top) AS top FROM (SELECT max(o_totalprice) AS top FROM orders
    WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
    UNION ALL SELECT max(l_extendedprice) FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')""",
)
def max_across_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [
        (table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"),
        (table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice"),
    ]
    return max_across(sets, "1996-01-01", "1999-01-01")
