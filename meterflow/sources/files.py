"""Feeds that arrive as files. Cells that cannot be read become null, they do not fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterflow import schemas
from meterflow.functions.numbers import null_if_blank
from meterflow.functions.timing import parse_ts, to_ns, to_utc
from meterflow.session import written

#: Where a counter page keeps its numbers, and the order of its circuits.
_PAGE_BODY = r"(?s)<body>(.*?)<br>\n</body>"
_CUMUL_AT = range(9, 17)
_CURR_AT = range(18, 26)


def page_columns(text: Column, include: Sequence[int] | None = None) -> list[Column]:
    """Counter columns of one page; elements left out of ``include`` are null."""
    cells = F.split(F.regexp_extract(text, _PAGE_BODY, 1), ",")

    def cell(position: int, name: str) -> Column:
        if include is not None and position not in include:
            return F.lit(None).cast("bigint").alias(name)
        return F.trim(F.get(cells, F.lit(position))).try_cast("bigint").alias(name)

    return [
        *[cell(at, f"circuit{n}_cumul") for at, n in zip(_CUMUL_AT, schemas.FEED_CIRCUITS)],
        *[cell(at, f"circuit{n}_curr") for at, n in zip(_CURR_AT, schemas.FEED_CIRCUITS)],
    ]


def read_counter_pages(
    spark: SparkSession, path: str | list[str], include: Sequence[int] | None = None, arrived=None
) -> DataFrame:
    """One row per saved counter page; ``ts`` is the arrival time, by default that of the file.

    A file holds one page or many in a row; cutting at the closing tag lets large files be read in parallel.
    """
    pages = spark.read.text(path, lineSep="</html>").select("value", "_metadata.file_modification_time")
    ts = F.col("file_modification_time") if arrived is None else F.lit(arrived).cast("timestamp")
    # A page that came back empty holds no data and makes no row.
    return pages.where(F.length(F.btrim("value", F.lit(" \r\n\t"))) > 0).select(ts.alias("ts"), *page_columns(F.col("value"), include))


def _csv(spark: SparkSession, path, schema: StructType, sep: str = ",") -> DataFrame:
    """CSV files of one layout, read by column name.

    The columns may come in any order, the same in all files. A file with other columns, or with
    the columns in another order than the rest, is an error: read by position it would give wrong values.
    """
    header = spark.read.options(header=True, sep=sep).csv(path).columns
    if header and set(header) != set(schema.names):
        odd = sorted(set(header) ^ set(schema.names))
        raise ValueError(f"columns don't fit the layout, differing in {odd}")
    order = StructType([schema[c] for c in header]) if header else schema
    return spark.read.schema(order).options(header=True, enforceSchema=False, sep=sep).csv(path).select(*schema.names)


def read_counter_csv(
    spark: SparkSession, path: str | list[str], empty_as_null: bool = True, layout: str | None = None
) -> DataFrame:
    """Electricity feed: time parsed, epoch time added, surrogate id dropped.

    ``layout`` is ``feed`` for the full feed, ``daily`` for the daily export (cumulative columns only); without it
    the header decides. Files of both layouts in one folder are an error. ``""`` is a missing counter.
    """
    if layout is None:
        layout = "feed" if "id" in spark.read.option("header", True).csv(path).columns else "daily"
    schema = {"feed": schemas.COUNTER_FEED, "daily": schemas.COUNTER_DAILY}[layout]
    raw = _csv(spark, path, schema)
    counters = [c for c in schema.names if c.startswith("circuit")]

    def number(name: str) -> Column:
        text = null_if_blank(F.col(name))
        # Without blanks allowed, a blank is an error and raises.
        return (text.try_cast("bigint") if empty_as_null else F.col(name).cast("bigint")).alias(name)

    ts = parse_ts(F.col("ts"))
    return raw.select(to_ns(ts).alias("eventNanoTs"), ts.alias("ts"), *[number(c) for c in counters])


def read_meter_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Heat-meter feed: ISO time parsed, epoch time added, row number dropped."""
    raw = _csv(spark, path, schemas.METER_FEED)
    ts = parse_ts(F.col("recordTimestamp"))
    return raw.select(
        to_ns(ts).alias("recordNanoTs"),
        *[ts.alias(c) if c == "recordTimestamp" else F.col(c) for c in raw.columns if c != "rowId"],
    )


def read_day_files(spark: SparkSession, path: str | list[str], tz: str | None = None) -> DataFrame:
    """Day files: ``;`` separated, epoch seconds and quoted local time. Header-only files give no rows.

    With ``tz`` the local time is also converted, as a check of the epoch column.
    """
    raw = _csv(spark, path, schemas.DAY_FILE, sep=";")
    local = F.try_to_timestamp(F.col("ts"), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz")
    rows = raw.select(
        F.timestamp_seconds("Timestamp").alias("ts"), local.alias("local_ts"), "value", F.col("Humidity").alias("humidity")
    )
    return rows if tz is None else rows.withColumn("local_as_utc", to_utc(F.col("local_ts"), tz))


def reply_devices(replies: DataFrame, address: Column | int) -> DataFrame:
    """Device rows of meter replies."""
    info = "SlaveInformation"
    return replies.select(
        (F.lit(address) if isinstance(address, int) else address).cast("bigint").alias("address"),
        F.col(f"{info}.Id").alias("id"),
        F.col(f"{info}.Manufacturer").alias("manufacturer"),
        F.col(f"{info}.Version").try_cast("bigint").alias("version"),
        F.col(f"{info}.ProductName").alias("productName"),
        F.col(f"{info}.Medium").alias("medium"),
        F.col(f"{info}.AccessNumber").try_cast("bigint").alias("accessNumber"),
        F.col(f"{info}.Signature").alias("signature"),
        F.col(f"{info}.Status").alias("lastStatus"),
    )


def reply_records(replies: DataFrame, address: Column | int) -> DataFrame:
    """Record rows of meter replies, optional fields included."""
    opened = replies.select(
        (F.lit(address) if isinstance(address, int) else address).cast("bigint").alias("address"),
        F.col("SlaveInformation.Id").alias("id"),
        F.col("SlaveInformation.AccessNumber").try_cast("bigint").alias("accessNumber"),
        F.explode("DataRecord").alias("r"),
    )
    return opened.select(
        "address",
        "id",
        "accessNumber",
        F.col("r._id").try_cast("int").alias("recordId"),
        F.col("r._frame").alias("recordFrame"),
        F.col("r.Function").alias("recordFunction"),
        F.col("r.StorageNumber").try_cast("int").alias("recordStorageNumber"),
        F.col("r.Tariff").alias("recordTariff"),
        F.col("r.Device").alias("recordDevice"),
        F.col("r.Unit").alias("recordUnit"),
        F.col("r.Value").alias("recordValue"),
        F.col("r.Timestamp").alias("recordTimestampRaw"),
        F.try_to_timestamp(F.col("r.Timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("recordTimestamp"),
    )


def read_replies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Meter replies from files that hold one reply, many under one root, or many in a row.

    Splitting the text at the closing tag lets large files be read in parallel parts;
    a whole-file XML read stops after the first root element. Files may be compressed, each with gzip is then one part.
    """
    close = "</MBusData>"
    text = spark.read.text(path, lineSep=close)
    opened = F.regexp_extract("value", r"(?s)(<MBusData[\s>].*)$", 1)
    replies = text.select(F.concat(opened, F.lit(close)).alias("reply")).where(F.length(opened) > 0)
    parsed = F.from_xml("reply", schemas.METER_REPLY, {"rowTag": "MBusData"})
    # Opening the struct with a generator parses a reply once, not once per field.
    return replies.select("reply", F.inline(F.array(parsed)))


def reply_rejects(replies: DataFrame) -> DataFrame:
    """Replies without a device, as those cut off in transfer, with the text that was read."""
    return replies.where(F.col("SlaveInformation.Id").isNull()).select(
        F.lit("meter reply").alias("source"), F.col("reply").alias("raw"), F.lit("no device id").alias("reason")
    )


def read_meter_xml(spark: SparkSession, path: str | list[str], address: int = 0) -> tuple[DataFrame, DataFrame]:
    """Meter replies of one bus address -> (device rows, record rows).

    Replies without a device id are left out; ``read_meter_replies`` returns them as well.
    """
    return read_meter_replies(spark, path, address)[:2]


def read_meter_replies(
    spark: SparkSession, path: str | list[str], address: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meter replies of one bus address -> (device rows, record rows, rejected replies).

    All are made from the parsed replies, which are stored once: parsing costs far more
    than reading them back. The text is stored of rejected replies only, as nothing else needs it.
    """
    device = F.col("SlaveInformation.Id")
    replies = written(read_replies(spark, path).withColumn("reply", F.when(device.isNull(), F.col("reply"))), "replies")
    good = replies.where(device.isNotNull())
    return reply_devices(good, address), reply_records(good, address), reply_rejects(replies)
