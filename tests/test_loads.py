"""The three feeds from files to statistics, loaded in parts and in one go."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterflow import schemas
from meterflow.plans import requests
from meterflow.plans.loads import load_climate, load_power, load_readings, load_water
from meterflow.sources import load_series
from test_sources import one, put, reply


def feed_file(folder, name, data):
    """data: (id, time, counter of circuit 9, counter of circuit 10)"""
    cells = [f"circuit{n}_{p}" for p in ("cumul", "curr") for n in range(9, 17)]
    lines = [",".join(["id", "ts", *cells])]
    for number, ts, a, b in data:
        lines.append(",".join([str(number), f'"{ts}"', str(a), str(b), *['""'] * 6, str(a % 10), *['""'] * 7]))
    return put(folder, name, "\n".join(lines) + "\n")


READS = [
    (n, f"2024-01-01 {h:02d}:{m:02d}:{s:02d}.500000", n * 3, 1000 - n if n % 4 else '""')
    for n, (h, m, s) in enumerate((h, m, s) for h in (9, 10) for m in (0, 1, 2, 5, 6) for s in (5, 35))
]
STATS = ["groupNanoTs", "c1_use", "c1_cumul", "c1_peak", "c2_use", "c2_cumul", "measures_count", "deltaNanoTs"]


def test_power_in_parts(spark, rows, tmp_path):
    whole = feed_file(tmp_path, "whole.csv", READS)
    load_power(spark, whole, "p_raw1", "p_stats1", now="2024-01-01 10:06:30")
    # The export overlaps what was loaded before; the running minute is left for the next load.
    first = feed_file(tmp_path, "a.csv", READS[:7])
    second = feed_file(tmp_path, "b.csv", READS[2:])
    load_power(spark, first, "p_raw2", "p_stats2", now="2024-01-01 09:05:20")
    load_power(spark, second, "p_raw2", "p_stats2", now="2024-01-01 10:06:30")
    load_power(spark, second, "p_raw2", "p_stats2", now="2024-01-01 10:06:40")
    assert spark.table("p_raw2").count() == len(READS)
    stats = rows(spark.table("p_stats2"), *STATS)
    assert stats == rows(spark.table("p_stats1"), *STATS) and len(stats) == 9
    uses = [r[1] for r in stats]
    assert uses == [None, 6, 6, None, 6, None, 6, 6, None]
    assert stats[0][-1] == -1 and stats[1][-1] == stats[0][0]


def test_power_request(spark, rows, tmp_path):
    load_power(spark, feed_file(tmp_path, "f.csv", READS), "p_raw3", "p_stats3", now="2024-01-02 00:00:00")
    columns = [f"c{n}_{p}" for n in schemas.CIRCUITS for p in ("use", "cumul", "peak")]
    stats = load_series(spark, "p_stats3", [*columns, "measures_count"], "groupNanoTs", "ns")
    got = requests.power_stats(
        stats, ["all_use", "measures_count"], "20240101", "20240101", "Europe/Helsinki", "H", "sum", "left", ts="ts"
    )
    assert rows(got) == [("2024-01-01 09:00:00", 11, 10), ("2024-01-01 10:00:00", 13, 10)]
    today = requests.power_stats(stats, ["c1_use"], ts="ts", now="2024-01-01 20:00:00")
    assert today.count() == 10 and requests.power_stats(stats, ["c1_use"], ts="ts", now="2024-01-05").count() == 0


def meter_replies(minute, energy):
    ts = f"2024-01-01T10:{minute:02d}:10"
    records = lambda e: [one(1, e, "Energy;100;Wh", ts), one(11, 3, "Power;100;W", ts)]
    return {
        "67": reply("67", minute, *records(energy)),
        "66": reply("66", minute, *records(energy * 2)),
        "65": reply("65", minute, *records(energy * 3)),
    }


@pytest.mark.parametrize("parts", [[[0, 1, 2, 3, 5]], [[0, 1], [1, 2], [3, 5]]])
def test_readings(spark, rows, tmp_path, parts):
    tag = f"_{len(parts)}"
    names = [f"{n}{tag}" for n in ("devices", "records", "readings")]
    for number, minutes in enumerate(parts):
        text = "\n".join(r for m in minutes for k, r in meter_replies(m, 10 + m).items() if not (k == "65" and m == 2))
        path = put(tmp_path, f"replies{number}.xml", text)
        load_readings(spark, path, 1, *names, now=f"2024-01-02 00:00:0{number}")
        load_water(spark, names[2], f"water{tag}", ["67", "66", "65"], now=f"2024-01-01 10:{minutes[-1] + 1:02d}:00")
    devices = {r.id: r for r in spark.table(names[0]).collect()}
    assert set(devices) == {"65", "66", "67"} and devices["67"].accessNumber == 5
    assert (devices["67"].rowUpdatedTimestamp is None) == (len(parts) == 1)
    assert spark.table(names[1]).count() == 28 and spark.table(names[2]).count() == 14
    got = rows(spark.table(f"water{tag}"), "groupNanoTs", "c1_cumul", "c1_delta", "c2_delta", "c3_delta", "c2_cumul")
    assert [r[1:] for r in got] == [
        (1000, None, None, None, 2000),
        (1100, 100, 200, 300, 2200),
        (1200, 100, None, None, None),  # one device is missing in this minute
        (1300, 100, None, None, 2600),
        (1500, None, None, None, 3000),
    ]


def test_climate_is_loaded_once(spark, rows):
    schema = "t string, eventType string, value decimal(14,3)"
    data = [("2024-01-01 10:00:00", "Temperature", 1), ("2024-01-01 10:00:00", "Humidity", 50), ("2024-01-03 10:00:00", "Temperature", 3)]
    events = spark.createDataFrame([(t, k, Decimal(v)) for t, k, v in data], schema).select(
        F.col("t").cast("timestamp").alias("eventTimestamp"),
        F.lit("station").alias("sourceType"),
        F.lit("dev").alias("sourceId"),
        "eventType",
        "value",
        F.lit("outdoor").alias("locationType"),
    )
    load_climate(events.where("value < 3"), "climate")
    load_climate(events.withColumn("value", F.col("value") + 7), "climate")
    load_climate(events, "climate")
    stored = spark.table("climate")
    assert rows(stored.select(F.col("value").cast("int"))) == [(1,), (10,), (57,)]
    days = requests.clima_daily(stored, "Temperature", "dev", "Europe/Helsinki")
    assert [(r[0], r[1] and int(r[1])) for r in rows(days)] == [("2024-01-01", 1), ("2024-01-02", None), ("2024-01-03", 10)]
    side = requests.clima_events(stored, ["Temperature", "Humidity"], "dev", "20240101", "20240101")
    assert [(r[0], int(r[1]), int(r[2])) for r in rows(side)] == [("2024-01-01 10:00:00", 1, 57)]


def test_range_export(spark, rows, tmp_path):
    df = spark.sql("SELECT id, timestamp_seconds(1704067200 + id * 60) AS ts, IF(id = 2, NULL, 'a \"b\", c') AS note FROM range(6)")
    minute = "2024-01-01 00:0{}:00".format
    ids = lambda *bounds: [r[0] for r in rows(requests.raw_range(df, *bounds).select("id"))]
    assert ids(minute(1), minute(3)) == [1, 2, 3] and ids(minute(3)) == [4, 5] and ids(None, minute(2)) == [0, 1] and ids() == []
    requests.export_range(df, f"{tmp_path}/some", minute(1), minute(2))
    back = spark.read.csv(f"{tmp_path}/some", header=True, quote='"', escape='"')
    assert back.columns == ["id", "ts", "note"] and [(r.id, r.note) for r in back.orderBy("id").collect()] == [("1", 'a "b", c'), ("2", None)]
    requests.export_range(df, f"{tmp_path}/none")
    assert [r.value for r in spark.read.text(f"{tmp_path}/none").collect()] == ['"id","ts","note"']


def test_combined(spark, rows):
    el = spark.createDataFrame([(1, 10, 1, 2, 3, 4, 5), (2, 20, 2, None, None, None, 6)], "m int, x int, c3_use int, c6_use int, c7_use int, c8_use int, c4_use int")
    wat = spark.createDataFrame([(2, 7, 8, 9), (3, 1, 1, 1)], "m int, c1_delta int, c2_delta int, c3_delta int")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).cast("timestamp_ntz").alias("gts")
    el, wat = (df.select(at, *df.columns[1:]) for df in (el, wat))
    days = ("20240101", "20240101")
    assert rows(requests.combined(el, wat, "indirect1", *days)) == [
        ("2024-01-01 00:01:00", 9, None),
        ("2024-01-01 00:02:00", None, 8),
        ("2024-01-01 00:03:00", None, 1),
    ]
    assert requests.combined(el, wat, "indirect0", *days).columns == ["ts", "c1_delta", "c4_use", "c3_use", "c3_delta"]
    assert rows(requests.combined(el, wat, "indirect0", *days, aggrto="H")) == [("2024-01-01 00:00:00", 8, 11, 3, 10)]
    assert rows(requests.energy_water(wat, ["c2_delta"], *days)) == [("2024-01-01 00:02:00", 8), ("2024-01-01 00:03:00", 1)]
    routing = spark.createDataFrame([("house", "c3_use", "el"), ("house", "c2_delta", "wat"), ("house", "CO2", "air")], schemas.ROUTING)
    served = requests.datasets_for(spark, routing, {"el": el, "wat": wat}, "house", ["c3_use", "c2_delta"])
    assert served["c3_use"] is el and served["c2_delta"] is wat
    for wrong in (["c3_use", "CO2"], ["c3_use", "none"]):
        assert requests.datasets_for(spark, routing, {"el": el, "wat": wat}, "house", wrong) is None
    last = requests.daily_last(el.withColumn("id", F.col("x")), "id", ["c3_use"], "gts")
    assert rows(last) == [("2024-01-01 00:02:00", 2)]
