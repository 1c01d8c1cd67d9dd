"""Loading by key, finding series, readings and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions import unit_factor
from meterflow.operators.keyed import (
    distinct_readings,
    duplicate_keys,
    first_per_key,
    insert_ignore,
    insert_replace,
    union_by,
    upsert_dim,
)
from meterflow.operators.ordered import latest
from meterflow.operators.readings import pivot_readings
from meterflow.operators.series import freshness, label_series, last_seen, newer_than, resolve_series
from meterflow.plans.registry import query, table
from meterflow.schemas import MEASURES

_KEY = ["user_id", "event_type", "hour"]
_LOADS_SQL = """e AS (SELECT user_id, event_type, date_trunc('hour', ts) AS hour, event_id, value FROM events),
    t AS (SELECT user_id, event_type, hour, event_id, value FROM (SELECT *, row_number() OVER
          (PARTITION BY user_id, event_type, hour ORDER BY event_id) AS n FROM e WHERE hour < TIMESTAMP '2024-01-20') WHERE n = 1),
    f AS (SELECT * FROM e WHERE hour >= TIMESTAMP '2024-01-10')"""


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table with one row per key, and a later delivery that overlaps it."""
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        "event_id",
        "value",
    )
    stored = first_per_key(rows.where("hour < timestamp_ntz'2024-01-20 00:00:00'"), _KEY, ["event_id"])
    return stored, rows.where("hour >= timestamp_ntz'2024-01-10 00:00:00'")


def _loads_sql(direction: str) -> str:
    return f"""{_LOADS_SQL}, n AS (SELECT user_id, event_type, hour, event_id, value FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, event_type, hour ORDER BY event_id {direction}) AS n FROM f) WHERE n = 1)"""


@query(
    "insert_ignore",
    f"WITH {_loads_sql('ASC')} SELECT * FROM t UNION ALL SELECT * FROM n ANTI JOIN t USING (user_id, event_type, hour)",
)
def insert_ignore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_ignore(*_loads(spark, sf_dir), _KEY, ["event_id"])


@query(
    "insert_replace",
    f"WITH {_loads_sql('DESC')} SELECT * FROM n UNION ALL SELECT * FROM t ANTI JOIN n USING (user_id, event_type, hour)",
)
def insert_replace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_replace(*_loads(spark, sf_dir), _KEY, ["event_id"])


@query(
    "union_by",
    f"WITH {_loads_sql('ASC')} SELECT * FROM t UNION ALL SELECT * FROM n ANTI JOIN t USING (user_id, event_type, hour)",
)
def union_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_by(*_loads(spark, sf_dir), _KEY, ["event_id"], ordered=False)


@query(
    "upsert_dim",
    """WITH o AS (SELECT * FROM customer WHERE c_acctbal < 5000), n AS (SELECT * FROM customer WHERE c_acctbal > 2000)
    SELECT c.c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN upper(c.c_mktsegment) ELSE c.c_mktsegment END AS c_mktsegment,
    CASE WHEN n.c_custkey IS NOT NULL THEN CAST(round(c.c_acctbal * 100) AS BIGINT) + 1
         ELSE CAST(round(c.c_acctbal * 100) AS BIGINT) END AS cents,
    CASE WHEN o.c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS "rowCreatedTimestamp",
    CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS "rowUpdatedTimestamp"
    FROM customer c LEFT JOIN o USING (c_custkey) LEFT JOIN n USING (c_custkey)""",
)
def upsert_dim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    stored = customers.where("c_acctbal < 5000").select(
        "c_custkey",
        "c_mktsegment",
        cents.alias("cents"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("rowCreatedTimestamp"),
        F.lit(None).cast("timestamp_ntz").alias("rowUpdatedTimestamp"),
    )
    fresh = customers.where("c_acctbal > 2000").select(
        "c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), (cents + 1).alias("cents")
    )
    return upsert_dim(stored, fresh, ["c_custkey"], now="2024-02-01 00:00:00")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("distinct_readings", "SELECT DISTINCT l_suppkey, l_shipdate, l_returnflag FROM lineitem")
def distinct_readings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_readings(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate", "l_returnflag"])


@query(
    "latest_per_user",
    """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3""",
)
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return latest(rows, ["user_id"], ["ts", "event_id"], 3)


@query("latest_global", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").select("event_id", "ts", "value"), [], ["ts", "event_id"])


@query("last_seen", "SELECT user_id, max(ts) AS mark FROM events GROUP BY 1")
def last_seen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_seen(table(spark, sf_dir, "events"), ["user_id"], "ts")


@query(
    "freshness",
    """SELECT user_id, min(ts) AS fresh_to FROM (SELECT user_id, event_type, max(ts) AS ts FROM events
    WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1, 2) GROUP BY 1""",
)
def freshness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", ["click", "view", "signup"])


@query(
    "newer_than",
    """WITH s AS (SELECT user_id, max(ts) AS mark FROM events WHERE value > 200 GROUP BY 1)
    SELECT event_id, user_id, ts, value FROM events LEFT JOIN s USING (user_id) WHERE mark IS NULL OR ts > mark""",
)
def newer_than_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose large values were stored already; their rows up to the last of these are known."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return newer_than(events, last_seen(events.where("value > 200"), ["user_id"], "ts"), "user_id", "ts")


#: A routing table: types of one device and the dataset that serves each. "error" has none.
_ROUTES = {"click": "web", "view": "web", "purchase": "shop", "signup": "accounts"}


@query(
    "resolve_series",
    """WITH q AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y%m%d') AS request,
                 event_type AS datatype FROM events),
    r AS (SELECT * FROM (VALUES ('click', 'web'), ('view', 'web'), ('purchase', 'shop')) AS v(datatype, dataset)),
    j AS (SELECT request, datatype, dataset FROM q LEFT JOIN r USING (datatype))
    SELECT request, 'house' AS device, datatype, dataset FROM j
    WHERE request NOT IN (SELECT request FROM j WHERE dataset IS NULL)""",
)
def resolve_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user and day for the types seen on it; accounts are routed but not loaded."""
    wanted = (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyyMMdd")).alias("request"),
            F.lit("house").alias("device"),
            F.col("event_type").alias("datatype"),
        )
        .distinct()
    )
    routing = spark.createDataFrame(
        [("house", kind, dataset) for kind, dataset in _ROUTES.items()], "device string, datatype string, dataset string"
    )
    return resolve_series(wanted, routing, available=["web", "shop"])


@query(
    "label_series",
    """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished'
    ELSE o_orderstatus END AS dispname,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' ELSE o_orderpriority END AS priority FROM orders""",
)
def label_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("O", "Open"), ("F", "Finished")], "code string, name string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    labelled = label_series(orders, names, "o_orderstatus")
    return label_series(labelled, {"1-URGENT": "Urgent"}, "o_orderpriority", "priority").drop("o_orderpriority")


_UNITS = [
    "Energy;100;Wh",
    "Volume;m;m^3",
    "Flow temperature;1e-2;deg C",
    "Power;k;W",
    "Volume flow;my;m^3/h",
    "Manufacturer specific",
    "Energy;10 k;Wh",
    "Energy;100 k;Wh",
    "Energy;M;Wh",
    "Energy;T;Wh",
    "Energy;10;Wh",
    "Energy;?;Wh",
]


@query(
    "unit_factor",
    f"""WITH u AS (SELECT p_partkey, p_size, list_element({_UNITS}, p_size % {len(_UNITS)} + 1) AS unit FROM part),
    x AS (SELECT *, CASE WHEN contains(unit, ';') THEN split_part(unit, ';', 2) ELSE '' END AS e FROM u)
    SELECT p_partkey, unit, CAST(CASE e WHEN 'm' THEN 0.001 WHEN 'my' THEN 0.000001 WHEN '10' THEN 10 WHEN '100' THEN 100
    WHEN 'k' THEN 1000 WHEN '10 k' THEN 10000 WHEN '100 k' THEN 100000 WHEN 'M' THEN 1000000 WHEN 'T' THEN 1000000000
    WHEN '1e-2' THEN 0.01 ELSE 1 END AS DOUBLE) AS factor FROM x""",
)
def unit_factor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in _UNITS])
    unit = F.element_at(units, F.col("p_size") % len(_UNITS) + 1)
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), unit_factor(unit).alias("factor"))


#: Unit text of the records that have one, by record id.
_RECORD_UNITS = {
    "Energy;100;Wh": (1, 2, 17, 18),
    "Volume;m;m^3": (5, 21),
    "Flow temperature;1e-2;deg C": (8, 9, 10),
    "Power;100;W": (11, 12, 22),
    "Volume flow;m;m^3/h": (13, 14, 23),
}
_FACTORS = {"Energy;100;Wh": 100, "Volume;m;m^3": 0.001, "Flow temperature;1e-2;deg C": 0.01, "Power;100;W": 100, "Volume flow;m;m^3/h": 0.001}


def meter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as device records: suppliers are devices, part numbers stand for record ids 0 to 29."""
    number = F.pmod("l_partkey", F.lit(30)).cast("int")
    unit: Column = F.lit("Manufacturer specific")
    for text, ids in _RECORD_UNITS.items():
        unit = F.when(number.isin(*ids), text).otherwise(unit)
    return table(spark, sf_dir, "lineitem").select(
        F.lit(1).cast("bigint").alias("address"),
        F.col("l_suppkey").cast("string").alias("id"),
        F.pmod("l_orderkey", F.lit(256)).alias("accessNumber"),
        number.alias("recordId"),
        unit.alias("recordUnit"),
        F.col("l_quantity").cast("bigint").cast("string").alias("recordValue"),
        F.col("l_shipdate").alias("recordTimestamp"),
        "l_orderkey",
        "l_linenumber",
    )


def _measure_sql() -> str:
    factor = {n: f for text, ids in _RECORD_UNITS.items() for n in ids for f in [_FACTORS[text]]}
    parts = []
    for number, (name, kind) in MEASURES.items():
        scaled = f"CAST({factor.get(number, 1)} AS DOUBLE) * v"
        value = {
            "scaled": f"CAST(trunc({scaled}) AS BIGINT)",
            "litres": f"CAST(trunc({scaled} * CAST(1000 AS DOUBLE)) AS BIGINT)",
            "plain": "v",
            "degrees": f"round({scaled}, 6)",
            "text": "CAST(v AS VARCHAR)",
        }[kind]
        parts.append(f'max(CASE WHEN r = {number} THEN {value} END) AS "{name}"')
    return ", ".join(parts)


@query(
    "pivot_readings",
    f"""WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, l_orderkey % 256 AS a, l_partkey % 30 AS r,
    CAST(l_quantity AS BIGINT) AS v, l_shipdate AS t, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 30, l_shipdate
    ORDER BY l_orderkey, l_linenumber, l_quantity) AS n FROM lineitem),
    k AS (SELECT * FROM x WHERE n = 1),
    w AS (SELECT id, t, {_measure_sql()} FROM k GROUP BY 1, 2),
    s AS (SELECT DISTINCT id, t, a FROM k)
    SELECT CAST(1 AS BIGINT) AS address, a AS "accessNumber", t AS "recordTimestamp", w.* EXCLUDE (t)
    FROM s JOIN w USING (id, t)""",
)
def pivot_readings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, the first of each key, turned into readings."""
    records = meter_records(spark, sf_dir).withColumn("quantity", F.col("recordValue").cast("bigint"))
    key = ["address", "id", "recordId", "recordTimestamp"]
    stored = first_per_key(records, key, ["l_orderkey", "l_linenumber", "quantity"])
    return pivot_readings(stored)
