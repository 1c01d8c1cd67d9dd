"""Streaming flows. Each writes by batch number, so a batch that runs twice counts once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from meterflow.functions.timing import day_key, instant, step_interval
from meterflow.operators.counters import counter_delta
from meterflow.operators.keyed import first_per_key
from meterflow.operators.resample import daily_rollup


def ingest_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
    **options,
) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start at a fixed cadence (``every``), or take what is there and stop.

    The checkpoint remembers where the flow stopped; starting again goes on from there.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rollup_stream(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: str,
    delay: str,
    peaks: Mapping[str, str],
    cumuls: Mapping[str, str],
    gts: str = "gts",
    count: str = "cnt",
) -> DataFrame:
    """Counter rollup of closed buckets only: a bucket comes out once, when the watermark has passed its end.

    Rows later than ``delay`` never change a bucket that is already out.
    """
    tops = {**peaks, **cumuls}
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(*keys, F.window(ts, step).alias("__w"))
        .agg(F.count(F.lit(1)).alias(count), *[F.max(src).alias(new) for new, src in tops.items()])
        .select(*keys, F.col("__w")["end"].alias(gts), count, *tops)
    )


def late_rows(df: DataFrame, ts: str, high_water) -> DataFrame:
    """Rows older than the last stored bucket, which never enter the rollup."""
    return df.where(F.col(ts) < instant(df, ts, high_water))


def _stored_schema(base: StructType, ddl: str) -> StructType:
    return StructType([*base.fields, *StructType.fromDDL(ddl).fields])


def delta_stream(
    rolled: DataFrame, keys: Sequence[str], gts: str, step: str, cols: Mapping[str, str], path: str, null_prev: str = "null"
) -> DataStreamWriter:
    """Consumption per closed bucket across batches.

    Each batch takes its predecessors from what earlier batches stored under ``path``,
    limited to the time just before and within the batch, and overwrites only its own
    folder ``batch=<n>``.
    """
    keys = list(keys)
    counters = list(dict.fromkeys(cols.values()))
    schema = _stored_schema(rolled.schema, "day date, batch bigint")
    # The folder has to exist before the first batch looks for its predecessors.
    empty = rolled.sparkSession.createDataFrame([], schema).drop("batch")
    empty.write.mode("ignore").partitionBy("day").parquet(f"{path}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            low, high = batch.agg(*[f(gts).cast("timestamp_ntz") for f in (F.min, F.max)]).first()
            if low is not None:
                # Two times per batch reach the driver; they prune the stored days and row groups.
                after, until = instant(batch, gts, low) - step_interval(step), instant(batch, gts, high)
                seed = (
                    batch.sparkSession.read.schema(schema)
                    .parquet(path)
                    .where((F.col("day") >= F.to_date(after)) & (F.col("day") <= F.to_date(until)))
                    .where((F.col("batch") < number) & F.col(gts).between(after, until))
                    .select(*keys, gts, *counters)
                )
                delta = counter_delta(batch, keys, gts, step, cols, null_prev, seed)
                (
                    delta.withColumn("day", F.to_date(gts))
                    .write.mode("overwrite")
                    .partitionBy("day")
                    .option("partitionOverwriteMode", "static")
                    .parquet(f"{path}/batch={number}")
                )
        finally:
            batch.unpersist()

    return rolled.writeStream.outputMode("append").foreachBatch(store)


def daily_view_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    tz: str,
    raw_path: str,
    view_path: str,
    groups: Sequence[str] = ("sourceType", "sourceId", "eventType", "locationType"),
) -> DataStreamWriter:
    """Daily view that follows the events: every local day a batch touches is made anew.

    New rows are stored by batch and day. A touched day is read back whole, first row per
    key wins, and only the folders of touched days are replaced in the view.
    """
    schema = _stored_schema(events.schema, "batch bigint, day string")

    def refresh(batch: DataFrame, number: int) -> None:
        (
            batch.withColumn("day", day_key(F.col(ts), tz, "yyyyMMdd"))
            .write.mode("overwrite")
            .partitionBy("day")
            .option("partitionOverwriteMode", "static")
            .parquet(f"{raw_path}/batch={number}")
        )
        stored = batch.sparkSession.read.schema(schema).parquet(raw_path).where(F.col("batch") <= number)
        # Calendar days of one batch: a short list whatever the number of rows.
        days = [r["day"] for r in stored.where(F.col("batch") == number).select("day").distinct().collect()]
        if not days:
            return
        touched = stored.where(F.col("day").isin(days))
        unique = first_per_key(touched, [*keys, "day"], ["batch", ts])
        view = daily_rollup(unique, ts, value, tz, groups)
        (
            view.withColumn("day", F.col("eventGroupTimestamp"))
            .repartition("day", F.pmod(F.hash(*groups), F.lit(8)))
            .write.mode("overwrite")
            .partitionBy("day")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(view_path)
        )

    return events.writeStream.outputMode("append").foreachBatch(refresh)


def dedup_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Repeated deliveries of a key within ``delay`` are dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys])
