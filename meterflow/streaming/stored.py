"""Streams into stored tables. Each batch is one load of its stream, so whatever a failure cut off is done once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import BinaryType, DateType, LongType, StructField, StructType, TimestampType

from meterflow.functions.timing import day_key, instant, step_interval, step_micros
from meterflow.operators.counters import counter_delta, counter_rollup
from meterflow.operators.keyed import first_per_key
from meterflow.session import hint_if_small, written
from meterflow.sources.stored import Load, StoredTable

Batch = Callable[[DataFrame, Load], None]

MARK_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def each_batch(df: DataFrame, fn: Batch, name: str | None = None) -> DataStreamWriter:
    """Call ``fn`` with every batch and its load.

    The load carries the id that the checkpoint gives a stream, so a stream begun anew with another checkpoint is
    another name. ``name`` sets one by hand.
    """

    def call(batch: DataFrame, number: int) -> None:
        stream = name or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        fn(batch, (stream, number))

    return df.writeStream.outputMode("append").foreachBatch(call)


def store_stream(df: DataFrame, table: StoredTable, day: tuple[str, str] | None = None, name: str | None = None) -> DataStreamWriter:
    """Rows of a stream appended to a table, each batch once. ``day`` = (column, time) adds the day of a time."""

    def store(batch: DataFrame, load: Load) -> None:
        table.append(batch if day is None else batch.withColumn(day[0], day_key(F.col(day[1]))), load)

    return each_batch(df, store, name)


# Consumption per bucket


def last_counters(rows: DataFrame, keys: Sequence[str], gts: str, counters: Sequence[str]) -> DataFrame:
    """The last bucket of every series with its counters."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, gts).alias(c) for c in counters], F.max(gts).alias(gts))


def delta_into(
    rolled: DataFrame,
    keys: Sequence[str],
    gts: str,
    step: str,
    cols: Mapping[str, str],
    table: StoredTable,
    last: StoredTable,
    load: Load,
    null_prev: str = "null",
) -> None:
    """Consumption of closed buckets, appended to ``table``; ``last`` holds the last bucket of every series.

    The table is partitioned by the day of the bucket, or by the first of its month if buckets are days or longer.

    Buckets come in order of time from load to load, so the last one is the only predecessor a new one can have.
    A load reads that one row for each series and nothing of what it has stored before.
    """
    counters = list(dict.fromkeys(cols.values()))
    before = last.read()
    if not table.holds(load):
        delta = counter_delta(rolled, keys, gts, step, cols, null_prev, before)
        unit = "month" if step_micros(step) >= step_micros("1 day") else "day"
        table.append(delta.withColumn("day", F.to_date(F.date_trunc(unit, gts))), load)
    both = before.unionByName(rolled.select(*keys, gts, *counters))
    last.overwrite(last_counters(both, keys, gts, counters), load)


def delta_flow(
    rolled: DataFrame, keys: Sequence[str], gts: str, step: str, cols: Mapping[str, str], table: StoredTable, last: StoredTable, null_prev: str = "null", name: str | None = None
) -> DataStreamWriter:
    """``delta_into`` for every batch of closed buckets (see ``rollup_stream``)."""

    def store(batch: DataFrame, load: Load) -> None:
        kept = batch.persist()
        try:
            delta_into(kept, keys, gts, step, cols, table, last, load, null_prev)
        finally:
            kept.unpersist()

    return each_batch(rolled, store, name)


def delta_tables(spark: SparkSession, path: str, rolled: StructType, keys: Sequence[str], gts: str, cols: Mapping[str, str]) -> tuple[StoredTable, StoredTable]:
    """The tables of ``delta_flow`` below ``path``: consumption by day, and last buckets."""
    of = {f.name: f for f in rolled}
    fields = [*rolled, *[StructField(new, of[c].dataType) for new, c in cols.items()], StructField("prev_gts", of[gts].dataType), StructField("day", DateType())]
    counters = list(dict.fromkeys(cols.values()))
    last = StructType([of[c] for c in (*keys, *counters, gts)])
    return StoredTable(spark, f"{path}/rows", StructType(fields), ["day"]), StoredTable(spark, f"{path}/last", last)


# Rollups that keep late rows


def rollup_flow(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: str,
    delay: str,
    peaks: Mapping[str, str],
    cumuls: Mapping[str, str],
    rolled: StoredTable,
    opened: StoredTable,
    late: StoredTable,
    name: str | None = None,
) -> DataStreamWriter:
    """Counter rollup of closed buckets, with every row that came too late for its bucket kept beside it.

    A bucket is closed when the highest time of all batches so far is ``delay`` past its end, and is then appended to
    ``rolled`` once. Rows of closed buckets, and rows without a time, go to ``late`` with ``batch`` and ``reason``.
    ``opened`` holds the partial results of buckets that are still open and the mark up to which they are closed;
    it is replaced last, so a batch that was cut off starts again from the same state.
    """
    tops = {**peaks, **cumuls}

    def store(batch: DataFrame, load: Load) -> None:
        if opened.holds(load):
            return
        batch = batch.withColumn(ts, F.col(ts).cast("timestamp")).persist()
        try:
            mark = opened.manifest().marks.get("closed")
            ahead = F.date_format(F.max(ts) - step_interval(delay), MARK_FORMAT)
            # All marks have one width, so texts compare as times do.
            mark_now = max((m for m in (mark, batch.agg(ahead).first()[0]) if m is not None), default=None)
            micros = F.unix_micros(F.col(ts))
            end = F.timestamp_micros(micros - F.pmod(micros, F.lit(step_micros(step))) + step_micros(step))
            too_late = F.lit(False) if mark is None else F.coalesce(end <= instant(batch, ts, mark), F.lit(False))
            reason = F.when(F.col(ts).isNull(), "no time").when(too_late, "bucket closed")
            judged = batch.withColumn("reason", reason).withColumn("batch", F.lit(load[1]).cast("bigint"))
            fresh = counter_rollup(judged.where(F.col("reason").isNull()), keys, ts, step, peaks, cumuls)
            merged = (
                fresh.unionByName(opened.read())
                .groupBy(*keys, "gts")
                .agg(F.sum("cnt").alias("cnt"), *[F.max(c).alias(c) for c in tops])
            )
            done = F.lit(False) if mark_now is None else F.col("gts") <= instant(merged, "gts", mark_now)
            merged = written(merged, "open-buckets")
            rolled.append(merged.where(done).withColumn("day", F.to_date("gts")), load)
            late.append(judged.where(F.col("reason").isNotNull()), load)
            opened.overwrite(merged.where(~done), load, {"closed": mark_now})
        finally:
            batch.unpersist()

    return each_batch(df, store, name)


def rollup_tables(
    spark: SparkSession, path: str, rows: StructType, keys: Sequence[str], ts: str, peaks: Mapping[str, str], cumuls: Mapping[str, str]
) -> tuple[StoredTable, StoredTable, StoredTable]:
    """The tables of ``rollup_flow`` below ``path``: closed buckets by day, open buckets, late rows."""
    of = {f.name: f.dataType for f in rows}
    base = [StructField(k, of[k]) for k in keys]
    base += StructType.fromDDL("gts timestamp, cnt bigint").fields + [StructField(new, of[c]) for new, c in {**peaks, **cumuls}.items()]
    late = [f if f.name != ts else StructField(ts, TimestampType()) for f in rows]
    late += StructType.fromDDL("reason string, batch bigint").fields
    return (
        StoredTable(spark, f"{path}/rolled", StructType([*base, StructField("day", DateType())]), ["day"]),
        StoredTable(spark, f"{path}/open", StructType(base)),
        StoredTable(spark, f"{path}/late", StructType(late)),
    )


# Repeated delivery, however late


class KeyIndex:
    """Which keys have been stored: digests by day, and of each day a bitmap of fixed size that rules most new keys out.

    Both are appended to by batches. A batch reads the bitmaps of its own days; only keys whose bit is set are looked
    up among the digests, in the days of those keys. ``day`` is the column whose calendar day parts the index; equal
    keys must have it equal, as the time of an event has when it is delivered again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], day: str, bits: int = 1 << 23):
        self.names, self.day, self.bits = list(keys), day, bits
        digests = StructType([StructField("digest", BinaryType()), StructField("day", DateType())])
        maps = StructType([StructField("bucket", LongType()), StructField("held", BinaryType()), StructField("day", DateType())])
        self.digests = StoredTable(spark, f"{path}/digests", digests, ["day"])
        self.maps = StoredTable(spark, f"{path}/maps", maps, ["day"], merge=self._merged)

    @staticmethod
    def _merged(maps: DataFrame) -> DataFrame:
        return maps.groupBy("day", "bucket").agg(F.bitmap_or_agg("held").alias("held"))

    def _digest(self) -> Column:
        # Nulls are left out of the JSON, so they differ from any text.
        return F.unhex(F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in self.names])), 256))

    def _bit(self) -> Column:
        return F.pmod(F.crc32("digest"), F.lit(self.bits))

    def _day(self) -> Column:
        return F.coalesce(F.to_date(F.col(self.day)), F.lit("1970-01-01").cast("date"))

    def new_rows(self, batch: DataFrame, order: Sequence[str]) -> DataFrame:
        """The first row of every key that is not in the index, with ``__digest`` and ``__day``; stored once."""
        keyed = batch.select("*", self._digest().alias("__digest"), self._day().alias("__day"))
        rows = written(first_per_key(keyed, ["__digest"], order), "delivery")
        days = [r[0] for r in rows.select("__day").distinct().collect()]
        asked = rows.select(F.col("__digest").alias("digest"), F.col("__day").alias("day")).withColumn("bit", self._bit())
        maps = self._merged(self.maps.read().where(F.col("day").isin(days)))
        # One byte of the bitmap, as a number.
        byte = F.expr("cast(conv(hex(substring(held, cast(bit % 32768 div 8 as int) + 1, 1)), 16, 10) as bigint)")
        hits = (
            asked.withColumn("bucket", F.bitmap_bucket_number(F.col("bit") + 1))
            .join(maps, ["day", "bucket"])
            .where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")) % 2 == 1)
            .select("day", "digest")
        )
        hits = written(hits, "hits")
        hit_days = [r[0] for r in hits.select("day").distinct().collect()]
        if not hit_days:
            return rows
        known = self.digests.read().where(F.col("day").isin(hit_days))
        present = written(known.join(hint_if_small(hits), ["day", "digest"], "left_semi").select(F.col("digest").alias("__digest")), "present")
        return rows.join(hint_if_small(present), "__digest", "left_anti").select(*rows.columns)

    def add(self, rows: DataFrame, load: Load) -> None:
        """Remember the keys of ``new_rows``. Bitmaps come first: a bit without its digest only costs a look."""
        keys = rows.select(F.col("__digest").alias("digest"), F.col("__day").alias("day"))
        bits = keys.withColumn("bit", self._bit() + 1)
        maps = bits.groupBy("day", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("held"))
        self.maps.append(maps, load)
        self.digests.append(keys, load)


def once_only(batch: DataFrame, load: Load, index: KeyIndex, order: Sequence[str], store: Callable[[DataFrame], object]) -> None:
    """Hand the rows of a batch whose keys are new to ``store``, then remember the keys."""
    if index.digests.holds(load):
        return
    rows = index.new_rows(batch, order)
    store(rows.drop("__digest", "__day"))
    index.add(rows, load)


def dedup_flow(df: DataFrame, index: KeyIndex, table: StoredTable, order: Sequence[str], day: tuple[str, str] | None = None, name: str | None = None) -> DataStreamWriter:
    """Every key stored once, whenever it is delivered again: the first row of the first batch that has it."""

    def store(batch: DataFrame, load: Load) -> None:
        def put(rows: DataFrame) -> None:
            table.append(rows if day is None else rows.withColumn(day[0], day_key(F.col(day[1]))), load)

        once_only(batch, load, index, order, put)

    return each_batch(df, store, name)


# The daily view


def daily_parts(spark: SparkSession, path: str, groups: Mapping[str, str], kind: str) -> StoredTable:
    """A table of partial daily values: lowest, highest, sum and count, which add up over batches."""
    fields = ", ".join(f"`{g}` {t}" for g, t in groups.items())
    total = "decimal(38,3)" if kind.startswith("decimal") else "double" if kind in ("double", "float") else "bigint"
    schema = StructType.fromDDL(f"{fields}, minvalue {kind}, maxvalue {kind}, total {total}, eventCount bigint, day string")
    return StoredTable(spark, path, schema, ["day"], merge=lambda rows: _added([*groups], rows))


def _added(groups: Sequence[str], rows: DataFrame) -> DataFrame:
    return rows.groupBy(*groups, "day").agg(
        F.min("minvalue").alias("minvalue"), F.max("maxvalue").alias("maxvalue"), F.sum("total").alias("total"), F.sum("eventCount").alias("eventCount")
    )


def daily_flow(
    events: DataFrame, index: KeyIndex, ts: str, value: str, tz: str, groups: Sequence[str], parts: StoredTable, name: str | None = None
) -> DataStreamWriter:
    """Daily view that follows the events at the cost of each batch: its new events become partial values of their local days.

    Nothing that was stored for a day is read again; keys delivered before are found by ``index``.
    """
    total = parts.schema["total"].dataType

    def store(batch: DataFrame, load: Load) -> None:
        def put(rows: DataFrame) -> None:
            placed = rows.withColumn("day", day_key(F.col(ts), tz, "yyyyMMdd"))
            partial = placed.groupBy(*groups, "day").agg(
                F.min(value).alias("minvalue"),
                F.max(value).alias("maxvalue"),
                F.sum(value).cast(total).alias("total"),
                F.count(value).alias("eventCount"),
            )
            parts.append(partial, load)

        once_only(batch, load, index, [ts, value], put)

    return each_batch(events, store, name)


def daily_view(parts: StoredTable, groups: Sequence[str], tz: str) -> DataFrame:
    """The daily view as it stands: min, avg, max and count of each day and group."""
    added = _added(groups, parts.read())
    return added.select(
        *groups,
        F.col("day").alias("eventGroupTimestamp"),
        "minvalue",
        F.when(F.col("eventCount") > 0, F.col("total").cast("double") / F.col("eventCount")).alias("avgvalue"),
        "maxvalue",
        "eventCount",
        F.lit(tz).alias("aggregationTimezone"),
    )


__all__ = [
    "KeyIndex", "daily_flow", "daily_parts", "daily_view", "dedup_flow", "delta_flow", "delta_into", "delta_tables", "each_batch",
    "last_counters", "once_only", "rollup_flow", "rollup_tables", "store_stream",
]
