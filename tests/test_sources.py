import gzip
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES
from meterflow import schemas, session
from meterflow.session import written
from meterflow.sources import files
from meterflow.sources import (
    append,
    csv_lines,
    ensure_table,
    explode_measures,
    load_series,
    measure_rejects,
    overwrite,
    power_stats_rows,
    read_counter_csv,
    read_counter_pages,
    read_day_files,
    read_measures,
    read_meter_csv,
    read_meter_replies,
    read_meter_xml,
    scan,
    stats_all,
    water_stats_rows,
    write_csv,
)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)
    return str(path)


def test_counter_pages(spark, tmp_path):
    page = ",".join(str(n * 10) for n in range(26))
    put(tmp_path, "a.html", f"<html><body>{page}<br>\n</body></html>")
    put(tmp_path, "b.html", "")
    put(tmp_path, "c.html", "<body>1,2,3,4,5,6,7,8,9,x,100<br>\n</body>")
    got = sorted(read_counter_pages(spark, str(tmp_path)).collect(), key=lambda r: r.circuit9_cumul is None)
    assert len(got) == 2 and got[0].ts is not None
    assert (got[0].circuit9_cumul, got[0].circuit16_cumul, got[0].circuit9_curr, got[0].circuit16_curr) == (90, 160, 180, 250)
    assert (got[1].circuit9_cumul, got[1].circuit10_cumul, got[1].circuit11_cumul, got[1].circuit9_curr) == (None, 100, None, None)
    masked = read_counter_pages(spark, str(tmp_path / "a.html"), include=[9], arrived="2024-01-01 00:00:00").first()
    assert (str(masked.ts), masked.circuit9_cumul, masked.circuit10_cumul) == ("2024-01-01 00:00:00", 90, None)


def test_counter_feed(spark, tmp_path):
    cells = [f"circuit{n}_{p}" for p in ("cumul", "curr") for n in range(9, 17)]
    lines = [
        ",".join(f'"{c}"' for c in ["id", "ts", *cells]),
        '1,"2030-01-02 03:04:05.123456",' + ",".join(["5"] * 16),
        '2,"2030-01-02 03:04:10.000001",' + ",".join(['""'] + ["7"] * 15),
    ]
    path = put(tmp_path, "feed.csv", "\n".join(lines) + "\n")
    got = sorted(read_counter_csv(spark, path).collect(), key=lambda r: r.ts)
    assert "id" not in got[0].asDict()
    assert [r.eventNanoTs for r in got] == [1893553445123456000, 1893553450000001000]
    assert [r.circuit9_cumul for r in got] == [5, None] and got[1].circuit16_curr == 7


def test_daily_export(spark, tmp_path):
    header = ",".join(f'"{c}"' for c in ["ts", *[f"circuit{n}_cumul" for n in range(9, 17)]])
    path = put(tmp_path, "daily.csv", header + '\n"2031-03-04 05:06:07.000008","","","",41,"",52,63,74\n')
    got = read_counter_csv(spark, path).first()
    assert (got.circuit9_cumul, got.circuit12_cumul, got.circuit16_cumul) == (None, 41, 74)


def test_meter_feed(spark, tmp_path):
    names = [f.name for f in schemas.METER_FEED]
    row = {"rowId": "1", "accessNumber": "7", "id": '"67"', "recordTimestamp": '"2030-05-06T07:08:09.000000Z"', "temp1": "21.5"}
    path = put(tmp_path, "meter.csv", ",".join(names) + "\n" + ",".join(row.get(n, '""') for n in names) + "\n")
    got = read_meter_csv(spark, path).first()
    assert got.recordNanoTs == 1904281689000000000 and got.temp1 == 21.5 and got.heatingEnergy is None
    assert "rowId" not in got.asDict()


def test_day_files(spark, tmp_path):
    put(tmp_path, "one.csv", 'Timestamp;ts;value;Humidity\n1893456000;"2030/01/01 02:00:00";-7.5;61\n1893456900;"2030/01/01 02:15:00";;62\n')
    put(tmp_path, "none.csv", "Timestamp;ts;value;Humidity\n")
    got = sorted(read_day_files(spark, str(tmp_path / "*.csv"), "Europe/Helsinki").collect(), key=lambda r: r.ts)
    assert [str(r.local_as_utc) for r in got] == [str(r.ts.replace(tzinfo=None)) for r in got]
    assert [(r.value, r.humidity) for r in got] == [(-7.5, 61), (None, 62)]
    assert read_day_files(spark, str(tmp_path / "none.csv")).count() == 0


def test_climate(spark):
    replies = [
        ('{"body":{"1900000000":[4.25,31],"1900000300":[5.75,null]}}',),
        ('{"body":[]}',),
        ('{"body":{}}',),
        ("no json",),
    ]
    df = spark.createDataFrame(replies, "value string")
    got = explode_measures(df, ["Temperature", "Humidity"], "dev", "outdoor", "station").collect()
    assert sorted((str(r.eventTimestamp), r.eventType, float(r.value)) for r in got) == [
        ("2030-03-17 17:46:40", "Humidity", 31.0),
        ("2030-03-17 17:46:40", "Temperature", 4.25),
        ("2030-03-17 17:51:40", "Temperature", 5.75),
    ]
    assert {(r.sourceId, r.sourceType, r.locationType) for r in got} == {("dev", "station", "outdoor")}


def test_climate_files(spark, tmp_path):
    put(tmp_path, "r.json", '{"body":{"1900000000":[4.25,31]}}\n{"body":{"1900000300":[5.75,33]}}\n')
    got = read_measures(spark, str(tmp_path), ["Temperature", "Humidity"], "dev", "outdoor", "station")
    assert sorted(float(r.value) for r in got.collect()) == [4.25, 5.75, 31.0, 33.0]


def reply(device, access, *records):
    body = "".join(
        f'<DataRecord id="{n}"{extra}><Function>Instantaneous value</Function><StorageNumber>0</StorageNumber>{more}'
        f"<Unit>{unit}</Unit>\n<Value>{value}</Value><Timestamp>{ts}</Timestamp></DataRecord>"
        for n, value, unit, ts, extra, more in records
    )
    return (
        f"<MBusData>\n<SlaveInformation><Id>{device}</Id><Manufacturer>M</Manufacturer><Version>23</Version>"
        f"<ProductName>P</ProductName><Medium>Heat</Medium><AccessNumber>{access}</AccessNumber><Status>00</Status>"
        f"<Signature>0000</Signature></SlaveInformation>{body}</MBusData>"
    )


def one(n, value, unit="Power;100;W", ts="2030-05-06T07:08:09", extra="", more=""):
    return (n, value, unit, ts, extra, more)


def test_meter_xml(spark, tmp_path):
    first = reply("M-0001", 12, one(0, 5), one(11, 3, extra=' frame="0"', more="<Tariff>1</Tariff><Device>2</Device>"))
    put(tmp_path, "single.xml", '<?xml version="1.0" encoding="ISO-8859-1"?>\n' + first)
    put(tmp_path, "many.xml", "\n".join(reply(f"d{n}", n, one(1, n)) for n in range(4)))
    put(tmp_path, "log.xml", "<log>" + reply("x", 1, one(1, 7)) + reply("y", 1, one(1, 8)) + "</log>\n")
    devices, records = read_meter_xml(spark, str(tmp_path), address=31)
    assert {r.id for r in devices.collect()} == {"M-0001", "d0", "d1", "d2", "d3", "x", "y"}
    assert devices.columns == [f.name for f in schemas.DEVICE][:9]
    got = {(r.id, r.recordId): r for r in records.collect()}
    assert len(got) == 8
    full = got["M-0001", 11]
    assert (full.address, full.accessNumber, full.recordFrame, full.recordTariff, full.recordDevice) == (31, 12, "0", "1", "2")
    assert (full.recordUnit, full.recordValue, str(full.recordTimestamp)) == ("Power;100;W", "3", "2030-05-06 07:08:09")
    assert got["M-0001", 0].recordTariff is None
    assert records.columns == [f.name for f in schemas.DEVICE_RECORD]


def test_tables(spark, tmp_path):
    ensure_table(spark, "raw_counts", schemas.COUNTER_RAW)
    ensure_table(spark, "raw_counts", schemas.COUNTER_RAW)
    assert scan(spark, "raw_counts").count() == 0
    row = spark.range(1).select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        *[F.lit(n).cast("bigint").alias(f.name) for n, f in enumerate(schemas.COUNTER_RAW) if n],
    )
    append(row.select(*reversed(row.columns)), "raw_counts")
    append(row, "raw_counts")
    assert [r.circuit9_cumul for r in scan(spark, "raw_counts").collect()] == [1, 1]
    overwrite(row, "raw_counts")
    assert scan(spark, "raw_counts").count() == 1
    append(row, "made_by_append")
    assert scan(spark, "made_by_append").count() == 1
    got = load_series(spark, "raw_counts", ["circuit9_curr"], "ts")
    assert got.columns == ["ts", "circuit9_curr"] and got.count() == 1


def test_load_series_times(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame([(1904281689123456000, "2030-05-06T07:08:09.123456Z", 5)], "ns bigint, t string, v int").write.parquet(path)
    by_ns, by_text = (load_series(spark, path, ["v"], c, unit).first() for c, unit in (("ns", "ns"), ("t", "text")))
    assert by_ns == by_text and str(by_ns.ts) == "2030-05-06 07:08:09.123456"


def test_stats_rows(spark):
    rolled = spark.createDataFrame([("2024-01-01 00:01:00", 3, None, 5, 6, 7)], "gts string, measures_count bigint, prev_gts timestamp, c1_use bigint, c1_cumul bigint, c1_peak bigint")
    stored = power_stats_rows(rolled.withColumn("gts", F.col("gts").cast("timestamp")))
    assert stored.columns == [f.name for f in schemas.POWER_STATS]
    row = stats_all(stored).withColumn("d", F.lit(stored.first().deltaNanoTs)).first()
    assert (row.c1_use, row.c1_cumul, row.c1_peak, row.all_use, row.measures_count, row.d) == (5, 6, 7, None, 3, -1)


@pytest.mark.parametrize("na_rep", ["", "NaN"])
def test_csv_text(spark, na_rep):
    df = spark.createDataFrame([(1, 2.5, 'say "hi", you', True), (None, None, None, None)], "a int, b double, c string, d boolean")
    df = df.withColumn("ts", F.lit("2030-01-22 22:05:04").cast("timestamp"))
    ts = '"2030-01-22T22:05:04.000000Z"'
    assert [r.line for r in csv_lines(df, na_rep).collect()] == [
        f'1,2.5,"say ""hi"", you","true",{ts}',
        ",".join([f'"{na_rep}"'] * 4 + [ts]),
    ]


def test_csv_files(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(spark.range(10).select("id", F.lit("x").alias("name")).repartition(3), path, na_rep="NaN")
    files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    texts = [open(f).read().splitlines() for f in files]
    assert all(t[0] == '"id","name"' for t in texts if t) and sum(len(t) - 1 for t in texts if t) == 10
    write_csv(spark.range(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).collect()[0].value == '"id"'
    assert spark.read.option("header", True).csv(path).count() == 10


def test_csv_by_name(spark, tmp_path):
    names = ["ts", *[f"circuit{n}_cumul" for n in range(9, 17)]]
    row = dict(zip(names, ['"2030-01-01 00:00:00.000000"', *map(str, range(1, 9))]))
    turned = list(reversed(names))
    path = put(tmp_path, "turned/a.csv", ",".join(turned) + "\n" + ",".join(row[n] for n in turned) + "\n")
    got = read_counter_csv(spark, path, layout="daily").first()
    assert (got.circuit9_cumul, got.circuit16_cumul) == (1, 8) and got.ts is not None
    put(tmp_path, "mixed/a.csv", ",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    put(tmp_path, "mixed/b.csv", ",".join(turned) + "\n" + ",".join(row[n] for n in turned) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_counter_csv(spark, str(tmp_path / "mixed")).collect()
    with pytest.raises(ValueError, match="layout"):
        read_counter_csv(spark, path, layout="feed")


def test_small_csv_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        write_csv(spark.range(10), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 10


def test_bad_cells(spark):
    df = spark.createDataFrame([('{"body":{"1900000000":[1.5,"x"],"1900000300":[99999999999999,2,3],"soon":[1]}}',), ("cut",)], "value string")
    types = ["Temperature", "Humidity"]
    good = explode_measures(df, types, "dev", "outdoor", "station").collect()
    assert sorted(float(r.value) for r in good) == [1.5, 2.0]
    bad = {(r.raw, r.reason) for r in measure_rejects(df, types, "dev").collect()}
    assert bad == {("1900000000:1:x", "no number"), ("1900000300:0:99999999999999", "too large"), ("1900000300:2:3", "no type"), ("soon:0:1", "no time"), ("cut", "no reply")}


def test_cut_off_reply(spark, tmp_path):
    put(tmp_path, "a.xml", reply("d1", 1, one(1, 5)) + "<MBusData><SlaveInformation><Manufact")
    devices, records, rejects = read_meter_replies(spark, str(tmp_path), 3)
    assert [r.id for r in devices.collect()] == ["d1"] and records.count() == 1
    assert [r.reason for r in rejects.collect()] == ["no device id"]


def test_statistics_keep_all_devices(spark):
    rolled = spark.sql("SELECT timestamp'2030-01-01' AS gts, 1L AS cnt, timestamp'2030-01-01' AS prev_gts, 1L AS c1_delta, 2L AS c9_delta")
    with pytest.raises(ValueError, match="c9_delta"):
        water_stats_rows(rolled)
    assert water_stats_rows(rolled.drop("c9_delta")).first().c1_indirect is False


def test_pages_in_one_file(spark, tmp_path):
    page = "<html><body>" + ",".join(str(10 * n) for n in range(26)) + "<br>\n</body></html>"
    path = put(tmp_path, "many.html", "\n".join([page] * 3) + "\n")
    assert [r.circuit9_cumul for r in read_counter_pages(spark, path).collect()] == [90] * 3


def test_compressed_replies(spark, tmp_path, rows):
    text = "\n".join(reply(f"d{n}", n, one(1, n)) for n in range(50))
    put(tmp_path, "plain/a.xml", text)
    os.makedirs(tmp_path / "packed")
    with gzip.open(tmp_path / "packed/a.xml.gz", "wt") as f:
        f.write(text)
    (plain, there), (packed, here) = (read_meter_xml(spark, str(tmp_path / d)) for d in ("plain", "packed"))
    assert plain.count() == 50 and rows(plain) == rows(packed) and rows(there) == rows(here)


def test_text_of_good_replies_is_not_stored(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(files, "written", lambda df, name: stored.append(written(df, name)) or stored[-1])
    put(tmp_path, "a.xml", reply("d1", 1, one(1, 5)) + "<MBusData><SlaveInformation><Manufact")
    devices, records, rejects = read_meter_replies(spark, str(tmp_path), 3)
    assert [(r.SlaveInformation.Id if r.SlaveInformation else None, r.reply is None) for r in stored[0].orderBy("reply").collect()] == [("d1", True), (None, False)]
    assert [r.raw[:40] for r in rejects.collect()] == ["<MBusData><SlaveInformation><Manufact</M"]


def test_meter_xml_writes_little(spark, tmp_path, monkeypatch):
    """What the query stores, replies and parsed rows, stays far below the length of its replies (about 365 bytes)."""
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    rows = QUERIES["meter_xml"](spark, sf_dir).count()
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names)
    assert rows > 1000 and 0 < size < 100 * rows
