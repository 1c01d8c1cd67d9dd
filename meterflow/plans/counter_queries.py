"""Rollups, consumption and the requests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions import row_max, row_sum, to_ns
from meterflow.operators.counters import (
    carry_in,
    counter_delta,
    counter_rollup,
    daily_counter_rollup,
    group_5min,
    with_deltas,
)
from meterflow.operators.filters import closed_only
from meterflow.operators.readings import device_rollup
from meterflow.operators.series import align_left_of, high_water, merge_series, merge_series_of
from meterflow.operators.shape import flag_nodata, last_per_day, unpivot_totals
from meterflow.plans import requests
from meterflow.plans.registry import COUNTERS_SQL, EVENT_TYPES, counters, ntz, query, table
from meterflow.schemas import CIRCUITS
from meterflow.sources.tables import power_stats_rows, stats_all

_HOURS_SQL = (
    "b AS (SELECT series, date_trunc('hour', ts) + INTERVAL 1 HOUR AS gts, count(*) AS cnt, "
    "max(curr) AS peak, max(cumul) AS cumul FROM m GROUP BY 1, 2)"
)


def _hourly(df: DataFrame, keys=("series",)) -> DataFrame:
    return counter_rollup(df, keys, "ts", "1 hour", {"peak": "curr"}, {"cumul": "cumul"})


@query(
    "counter_hourly_use",
    f"""WITH {COUNTERS_SQL}, {_HOURS_SQL}
    SELECT b.series, b.gts, b.cnt, b.peak, b.cumul, b.cumul - p.cumul AS use,
           coalesce(epoch_us(p.gts) * 1000, -1) AS prev_ns
    FROM b LEFT JOIN b p ON p.series = b.series AND p.gts = b.gts - INTERVAL 1 HOUR""",
)
def counter_hourly_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = counter_delta(_hourly(counters(spark, sf_dir)), ["series"], "gts", "1 hour", {"use": "cumul"})
    return used.select(
        "series", "gts", "cnt", "peak", "cumul", "use", F.coalesce(to_ns(F.col("prev_gts")), F.lit(-1)).alias("prev_ns")
    )


@query(
    "counter_minute_use",
    f"""WITH {COUNTERS_SQL},
    b AS (SELECT user_id, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS gts, count(*) AS cnt,
                 max(curr) AS peak, max(cumul) AS cumul FROM m GROUP BY 1, 2)
    SELECT b.user_id, b.gts, b.cnt, b.peak, b.cumul, b.cumul - p.cumul AS use
    FROM b LEFT JOIN b p ON p.user_id = b.user_id AND p.gts = b.gts - INTERVAL 1 MINUTE""",
)
def counter_minute_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute buckets of many meters at once."""
    minutes = counter_rollup(counters(spark, sf_dir), ["user_id"], "ts", "1 minute", {"peak": "curr"}, {"cumul": "cumul"})
    return counter_delta(minutes, ["user_id"], "gts", "1 minute", {"use": "cumul"}).drop("prev_gts")


@query(
    "counter_use_seeded",
    f"""WITH {COUNTERS_SQL}, {_HOURS_SQL.replace("FROM m", "FROM m WHERE ts < TIMESTAMP '2024-01-30 22:00:00'")}
    SELECT b.series, b.gts, b.cnt, b.peak, b.cumul, b.cumul - p.cumul AS use
    FROM b LEFT JOIN b p ON p.series = b.series AND p.gts = b.gts - INTERVAL 1 HOUR""",
)
def counter_use_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: up to a stored bucket, then on from there with carried-in counters. Equals one run over all."""
    split = "2024-01-15 00:00:00"
    rows = closed_only(counters(spark, sf_dir), "ts", "1 hour", "2024-01-30 22:34:56")
    first, second = rows.where(f"ts < timestamp_ntz'{split}'"), rows.where(f"ts >= timestamp_ntz'{split}'")
    seed = carry_in(rows, ["series"], "ts", "1 hour", split, {"cumul": "cumul"})
    use = {"use": "cumul"}
    done = counter_delta(_hourly(first), ["series"], "gts", "1 hour", use)
    return done.unionByName(counter_delta(_hourly(second), ["series"], "gts", "1 hour", use, seed=seed)).drop("prev_gts")


@query(
    "counter_use_null_prev",
    f"""WITH {COUNTERS_SQL},
    b AS (SELECT series, date_trunc('hour', ts) + INTERVAL 1 HOUR AS gts,
                 max(CASE WHEN curr > 9000 THEN cumul END) AS cumul FROM m GROUP BY 1, 2)
    SELECT b.series, b.gts, b.cumul, b.cumul - coalesce(p.cumul, -1) AS use
    FROM b JOIN b p ON p.series = b.series AND p.gts = b.gts - INTERVAL 1 HOUR
    UNION ALL
    SELECT b.series, b.gts, b.cumul, NULL FROM b ANTI JOIN b p
    ON p.series = b.series AND p.gts = b.gts - INTERVAL 1 HOUR""",
)
def counter_use_null_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters missing in some buckets; a missing neighbour counts as -1 in this mode."""
    sparse = counters(spark, sf_dir).withColumn("cumul", F.when(F.col("curr") > 9000, F.col("cumul")))
    hours = counter_rollup(sparse, ["series"], "ts", "1 hour", {}, {"cumul": "cumul"}).drop("cnt")
    used = counter_delta(hours, ["series"], "gts", "1 hour", {"use": "cumul"}, null_prev="reference")
    return used.drop("prev_gts")


_WIDE_SQL = "w AS (SELECT cumul AS id, ts, " + ", ".join(
    f"CASE WHEN series = '{t}' THEN curr END AS c{n}_curr, CASE WHEN series = '{t}' THEN cumul END AS c{n}_cumul"
    for n, t in enumerate(EVENT_TYPES, 1)
) + " FROM m)"
_TYPED = range(1, len(EVENT_TYPES) + 1)


def wide_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per reading, one circuit per event type."""
    rows = counters(spark, sf_dir)
    return rows.select(
        F.col("cumul").alias("id"),
        "ts",
        *[
            F.when(F.col("series") == t, F.col(part)).alias(f"c{n}_{part}")
            for n, t in enumerate(EVENT_TYPES, 1)
            for part in ("curr", "cumul")
        ],
    )


def _all(part: str) -> str:
    return " + ".join(f"coalesce(c{n}_{part}, 0)" for n in _TYPED)


@query(
    "counter_daily_all",
    f"""WITH {COUNTERS_SQL}, {_WIDE_SQL},
    d AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS gts, count(*) AS measures_count,
          {", ".join(f"max(c{n}_curr) AS c{n}_peak, max(c{n}_cumul) AS c{n}_cumul" for n in _TYPED)},
          max({_all("curr")}) AS all_peak, max({_all("cumul")}) AS all_cumul
          FROM w WHERE ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1)
    SELECT *, {", ".join(f"coalesce({n}_cumul - lag({n}_cumul) OVER (ORDER BY gts), 0) AS {n}_use"
                         for n in [*(f"c{i}" for i in _TYPED), "all"])},
           coalesce(lag(gts) OVER (ORDER BY gts), gts) AS delta_gts FROM d""",
)
def counter_daily_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    circuits = {f"c{n}": (f"c{n}_curr", f"c{n}_cumul") for n in _TYPED}
    days = daily_counter_rollup(wide_counters(spark, sf_dir), "ts", circuits, now="2024-01-30 10:00:00")
    return with_deltas(days, [*circuits, "all"])


@query(
    "grp_5min",
    f"""WITH {COUNTERS_SQL} SELECT series, time_bucket(INTERVAL 5 MINUTE, ts) AS interval, count(*) AS cnt,
    max(curr) AS peak, max(cumul) AS reading FROM m GROUP BY 1, 2""",
)
def grp_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_5min(counters(spark, sf_dir), "ts", "curr", "cumul", ["series"])


_PIVOT_SQL = "h AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, " + ", ".join(
    f"CAST(sum(CASE WHEN series = '{t}' THEN curr END) AS BIGINT) AS {t}" for t in EVENT_TYPES
) + " FROM m GROUP BY 1)"


def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = counters(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"))
    return hours.agg(*[F.sum(F.when(F.col("series") == t, F.col("curr"))).alias(t) for t in EVENT_TYPES]).select(
        F.col("w")["end"].alias("ts"), *EVENT_TYPES
    )


@query(
    "row_totals",
    f"""WITH {COUNTERS_SQL}, {_PIVOT_SQL}
    SELECT ts, {", ".join(f"coalesce({t}, 0) AS {t}, {t} IS NULL AS {t}_nodata" for t in EVENT_TYPES)},
    CASE WHEN coalesce({", ".join(EVENT_TYPES)}) IS NOT NULL
         THEN {" + ".join(f"coalesce({t}, 0)" for t in EVENT_TYPES)} END AS all_use,
    {" + ".join(f"coalesce({t}, 0)" for t in EVENT_TYPES)} AS all_zero,
    greatest({", ".join(EVENT_TYPES)}) AS all_peak FROM h""",
)
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = hourly_by_type(spark, sf_dir).select(
        "*",
        row_sum(EVENT_TYPES).alias("all_use"),
        row_sum(EVENT_TYPES, null_as_zero=True).alias("all_zero"),
        row_max(EVENT_TYPES).alias("all_peak"),
    )
    return flag_nodata(totals, EVENT_TYPES)


@query(
    "unpivot_totals",
    f"""WITH {COUNTERS_SQL},
    h AS (SELECT date_trunc('day', ts) AS ts, {", ".join(
        f"CAST(sum(CASE WHEN series = '{t}' THEN curr END) AS BIGINT) AS {t}" for t in EVENT_TYPES)} FROM m GROUP BY 1),
    """
    + "l AS ("
    + " UNION ALL ".join(f"SELECT ts, {i} AS pos, '{t}' AS name, {t} AS v FROM h" for i, t in enumerate(EVENT_TYPES, 1))
    + """)
    SELECT ts, CAST(pos AS INTEGER) AS pos, name, coalesce(v, 0) AS value,
    CAST(sum(coalesce(v, 0)) OVER (PARTITION BY ts ORDER BY pos) AS BIGINT) AS stack,
    CAST(sum(coalesce(v, 0)) OVER (PARTITION BY ts) AS BIGINT) AS total, v IS NULL AS nodata FROM l""",
)
def unpivot_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = counters(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"))
    wide = days.agg(*[F.sum(F.when(F.col("series") == t, F.col("curr"))).alias(t) for t in EVENT_TYPES]).select(
        F.col("w")["start"].alias("ts"), *EVENT_TYPES
    )
    return unpivot_totals(wide, EVENT_TYPES)


def _type_sql(name: str) -> str:
    return (
        f"{name} AS (SELECT gts, peak AS {name}_peak, cumul AS {name}_cumul FROM b WHERE series = '{name}')"
    )


@query(
    "merge_series_outer",
    f"""WITH {COUNTERS_SQL}, {_HOURS_SQL}, {", ".join(_type_sql(t) for t in EVENT_TYPES)}
    SELECT * FROM click FULL JOIN error USING (gts) FULL JOIN purchase USING (gts)
    FULL JOIN signup USING (gts) FULL JOIN view USING (gts)""",
)
def merge_series_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_series_of(_hourly(counters(spark, sf_dir), ["series"]), "gts", "series", EVENT_TYPES, ["peak", "cumul"])


@query(
    "merge_two_tables",
    """WITH o AS (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS orders FROM orders GROUP BY 1),
    s AS (SELECT date_trunc('day', l_shipdate) AS day, count(*) AS shipped, CAST(sum(l_quantity) AS BIGINT) AS pieces FROM lineitem GROUP BY 1)
    SELECT CAST(day AS TIMESTAMP) AS day, orders, shipped, pieces FROM o FULL JOIN s USING (day)""",
)
def merge_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of two tables side by side: what is ordered and what is shipped on each day."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias("day")
    ordered = table(spark, sf_dir, "orders").groupBy(day("o_orderdate")).agg(F.count("*").alias("orders"))
    pieces = F.sum("l_quantity").cast("bigint").alias("pieces")
    shipped = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate")).agg(F.count("*").alias("shipped"), pieces)
    return merge_series([ordered, shipped], "day")


@query(
    "align_left_three",
    f"""WITH {COUNTERS_SQL}, {_HOURS_SQL}, {", ".join(_type_sql(t) for t in EVENT_TYPES[:3])}
    SELECT * FROM click LEFT JOIN (error JOIN purchase USING (gts)) USING (gts)""",
)
def align_left_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _hourly(counters(spark, sf_dir), ["series"])
    return align_left_of(hours, "gts", "series", "click", ["error", "purchase"], ["peak", "cumul"])


_WATER_SQL = f"""{_HOURS_SQL}, {", ".join(_type_sql(t) for t in EVENT_TYPES[:3])},
    sw AS (SELECT click.gts, b.cnt, click_peak AS c1_peak, click_cumul AS c1_cumul, error_peak AS c2_peak,
          error_cumul AS c2_cumul, purchase_peak AS c3_peak, purchase_cumul AS c3_cumul
          FROM click JOIN b ON b.series = 'click' AND b.gts = click.gts
          LEFT JOIN (SELECT * FROM error JOIN purchase USING (gts)) ep ON ep.gts = click.gts),
    water AS (SELECT sw.*, sw.c1_cumul - p.c1_cumul AS c1_delta, sw.c2_cumul - p.c2_cumul AS c2_delta,
          sw.c3_cumul - p.c3_cumul AS c3_delta FROM sw LEFT JOIN sw p ON p.gts = sw.gts - INTERVAL 1 HOUR)"""


def water_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three devices side by side with consumption, as the heat-meter statistics."""
    side = device_rollup(counters(spark, sf_dir), EVENT_TYPES[:3], "ts", "1 hour", "curr", "cumul", "series")
    return counter_delta(side, [], "gts", "1 hour", {f"c{n}_delta": f"c{n}_cumul" for n in (1, 2, 3)})


@query("device_rollup_three", f"WITH {COUNTERS_SQL}, {_WATER_SQL} SELECT * FROM water")
def device_rollup_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_stats(spark, sf_dir).drop("prev_gts")


_CIRCUIT_ROWS_SQL = "w AS (SELECT ts, " + ", ".join(
    f"CASE WHEN user_id % 8 = {n - 1} THEN curr END AS c{n}_curr, CASE WHEN user_id % 8 = {n - 1} THEN cumul END AS c{n}_c"
    for n in CIRCUITS
) + " FROM m)"
_POWER_SQL = f"""{_CIRCUIT_ROWS_SQL},
    s AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS gts, count(*) AS measures_count,
          {", ".join(f"max(c{n}_curr) AS c{n}_peak, max(c{n}_c) AS c{n}_cumul" for n in CIRCUITS)} FROM w GROUP BY 1),
    power AS (SELECT s.*, {", ".join(f"s.c{n}_cumul - p.c{n}_cumul AS c{n}_use" for n in CIRCUITS)}, p.gts AS prev_gts
          FROM s LEFT JOIN s p ON p.gts = s.gts - INTERVAL 1 HOUR)"""


def power_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight circuits in one wide table with consumption, as the electricity statistics."""
    circuit = F.pmod("user_id", F.lit(8)) + 1
    rows = counters(spark, sf_dir)
    wide = rows.select(
        "ts",
        *[F.when(circuit == n, F.col(part)).alias(f"c{n}_{part}") for n in CIRCUITS for part in ("curr", "cumul")],
    )
    rolled = counter_rollup(
        wide,
        [],
        "ts",
        "1 hour",
        {f"c{n}_peak": f"c{n}_curr" for n in CIRCUITS},
        {f"c{n}_cumul": f"c{n}_cumul" for n in CIRCUITS},
        count="measures_count",
    )
    return counter_delta(rolled, [], "gts", "1 hour", {f"c{n}_use": f"c{n}_cumul" for n in CIRCUITS})


@query(
    "power_stats_rows",
    f"""WITH {COUNTERS_SQL}, {_POWER_SQL}
    SELECT gts AS "groupTimestamp", {", ".join(f"c{n}_use, c{n}_cumul, c{n}_peak" for n in CIRCUITS)},
    CAST(NULL AS BIGINT) AS all_use, CAST(NULL AS BIGINT) AS all_cumul, CAST(NULL AS BIGINT) AS all_peak,
    measures_count FROM power""",
)
def power_stats_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the statistics table stores them, in its fixed projection. Whole-house columns stay unset there."""
    stored = stats_all(power_stats_rows(power_statistics(spark, sf_dir)))
    return stored.withColumn("groupTimestamp", ntz("groupTimestamp"))


def _sum_sql(part: str) -> str:
    cols = [f"c{n}_{part}" for n in CIRCUITS]
    return f"CASE WHEN coalesce({', '.join(cols)}) IS NOT NULL THEN {' + '.join(f'coalesce({c}, 0)' for c in cols)} END"


_LOCAL_HELSINKI = "timezone('Europe/Helsinki', timezone('UTC', {}))"


def _utc_of_local(wall: str) -> str:
    return f"timezone('UTC', timezone('Europe/Helsinki', {wall}))"


@query(
    "power_stats_request",
    f"""WITH {COUNTERS_SQL}, {_POWER_SQL},
    t AS (SELECT gts AS ts, {_sum_sql("use")} AS all_use, {_sum_sql("cumul")} AS all_cumul,
          greatest({", ".join(f"c{n}_peak" for n in CIRCUITS)}) AS all_peak, measures_count FROM power
          WHERE gts >= {_utc_of_local("TIMESTAMP '2024-01-01'")} AND gts < {_utc_of_local("TIMESTAMP '2024-02-01'")})
    SELECT {_utc_of_local("date_trunc('day', " + _LOCAL_HELSINKI.format("ts") + ")")} AS ts,
    CAST(sum(all_use) AS BIGINT) AS all_use, CAST(sum(all_cumul) AS BIGINT) AS all_cumul,
    CAST(sum(all_peak) AS BIGINT) AS all_peak, CAST(sum(measures_count) AS BIGINT) AS measures_count
    FROM t GROUP BY 1""",
)
def power_stats_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.power_stats(
        power_statistics(spark, sf_dir), mindate="20240101", maxdate="20240131", tz="Europe/Helsinki", aggrto="D"
    )


@query(
    "energy_water_request",
    f"""WITH {COUNTERS_SQL}, {_WATER_SQL}
    SELECT gts AS ts, c1_delta, c3_delta FROM water
    WHERE gts >= {_utc_of_local("TIMESTAMP '2024-01-01'")} AND gts < {_utc_of_local("TIMESTAMP '2024-02-01'")}""",
)
def energy_water_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.energy_water(
        water_stats(spark, sf_dir), ["c1_delta", "c3_delta"], "20240101", "20240131", "Europe/Helsinki"
    )


_FULL = ("20231201", "20240301")


@query(
    "combined_bundle",
    f"""WITH {COUNTERS_SQL}, {_POWER_SQL}, {_WATER_SQL},
    j AS (SELECT gts, c1_delta, c4_use, c3_use, c3_delta FROM power FULL JOIN water USING (gts)),
    g AS (SELECT date_trunc('hour', gts) AS ts, CAST(sum(c1_delta) AS BIGINT) AS c1_delta,
          CAST(sum(c4_use) AS BIGINT) AS c4_use, CAST(sum(c3_use) AS BIGINT) AS c3_use,
          CAST(sum(c3_delta) AS BIGINT) AS c3_delta FROM j GROUP BY 1)
    SELECT r.ts, c1_delta, c4_use, c3_use, c3_delta FROM
    (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM g) r LEFT JOIN g USING (ts)""",
)
def combined_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.combined(
        power_statistics(spark, sf_dir), water_stats(spark, sf_dir), "indirect0", *_FULL, "Europe/Helsinki", "H"
    )


@query(
    "combined_bundle_phases",
    f"""WITH {COUNTERS_SQL}, {_POWER_SQL}, {_WATER_SQL}
    SELECT gts AS ts, CASE WHEN coalesce(c6_use, c7_use, c8_use) IS NOT NULL
    THEN coalesce(c6_use, 0) + coalesce(c7_use, 0) + coalesce(c8_use, 0) END AS c678_use, c2_delta
    FROM power FULL JOIN water USING (gts)""",
)
def combined_bundle_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.combined(power_statistics(spark, sf_dir), water_stats(spark, sf_dir), "indirect1", *_FULL)


@query(
    "last_per_day",
    f"""WITH {COUNTERS_SQL}, {_WIDE_SQL}
    SELECT ts, id, {", ".join(f"c{n}_cumul" for n in _TYPED)} FROM w
    WHERE id IN (SELECT max(id) FROM w GROUP BY CAST(ts AS DATE))""",
)
def last_per_day_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_counters(spark, sf_dir)
    return last_per_day(rows, "id", "ts").select("ts", "id", *[f"c{n}_cumul" for n in _TYPED])


@query(
    "high_water_default",
    "SELECT max(ts) AS high_water, 'events' AS source FROM events UNION ALL "
    "SELECT TIMESTAMP '1970-01-01 00:00:00', 'none'",
)
def high_water_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts")
    top = high_water(events, "ts").withColumn("source", F.lit("events"))
    none = high_water(events.where(F.col("ts").isNull()), "ts", "1970-01-01 00:00:00").withColumn("source", F.lit("none"))
    return top.unionByName(none)
