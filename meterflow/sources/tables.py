"""Tables: scan, load, append, create; and CSV output."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType, TimestampNTZType, TimestampType

from meterflow.functions.timing import ISO_FORMAT, from_ns, parse_ts, to_ns
from meterflow.schemas import CIRCUITS, POWER_STATS, WATER_STATS


def scan(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def load_series(
    spark: SparkSession,
    table: str,
    cols: Sequence[str],
    ts_col: str,
    unit: str = "timestamp",
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """Named columns of a table with its time column parsed to ``ts``.

    ``unit`` says how the time is stored: ``ns``, ``text`` or ``timestamp``. With ``jdbc``
    the table is read from a database in parallel parts; give ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` with the connection options.
    """
    if jdbc is not None:
        rows = spark.read.format("jdbc").options(dbtable=table, **jdbc).load()
    elif "/" in table:
        rows = spark.read.parquet(table)
    else:
        rows = spark.table(table)
    parse = {"ns": from_ns, "text": parse_ts, "timestamp": lambda c: c}[unit]
    return rows.select(parse(F.col(ts_col)).alias("ts"), *cols)


def stats_all(stats: DataFrame) -> DataFrame:
    """The fixed projection of the electricity statistics."""
    names = [*(f"c{n}" for n in CIRCUITS), "all"]
    return stats.select("groupTimestamp", *[f"{n}_{p}" for n in names for p in ("use", "cumul", "peak")], "measures_count")


def _stats_rows(rollup: DataFrame, schema: StructType, gts: str, count: str, prev: str) -> DataFrame:
    """Rollup columns under their stored names; stored columns the rollup lacks are null, flags false.

    A circuit or device the table has no columns for is an error, not dropped.
    """
    known = {*schema.names, gts, count, prev, "prev_ns"}
    lost = [c for c in rollup.columns if c not in known and re.fullmatch(r"(c\d+|all)_\w+", c)]
    if lost:
        raise ValueError(f"the statistics table has no columns for {lost}")
    given = {
        "groupNanoTs": to_ns(F.col(gts)),
        "measures_count": F.col(count),
        "deltaNanoTs": F.coalesce(to_ns(F.col(prev)), F.lit(-1)),
        "groupTimestamp": F.col(gts),
        "rowCreatedTimestamp": F.current_timestamp(),
    }

    def value(field) -> Column:
        if field.name in given:
            source = given[field.name]
        elif field.name in rollup.columns:
            source = F.col(field.name)
        else:
            source = F.lit(False if field.name.endswith("_indirect") else None)
        return source.cast(field.dataType).alias(field.name)

    return rollup.select(*[value(field) for field in schema])


def power_stats_rows(
    rollup: DataFrame, gts: str = "gts", count: str = "measures_count", prev: str = "prev_gts"
) -> DataFrame:
    return _stats_rows(rollup, POWER_STATS, gts, count, prev)


def water_stats_rows(rollup: DataFrame, gts: str = "gts", count: str = "cnt", prev: str = "prev_gts") -> DataFrame:
    return _stats_rows(rollup, WATER_STATS, gts, count, prev)


def append(df: DataFrame, table: str) -> None:
    """Append by column name to an existing table, or create it."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.select(*spark.table(table).columns).write.insertInto(table)
    else:
        df.write.saveAsTable(table, format="parquet")


def overwrite(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def ensure_table(spark: SparkSession, table: str, schema: StructType, partition_by: Sequence[str] = ()) -> DataFrame:
    """Create a typed parquet table unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{parts}")
    return spark.table(table)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, na_rep: str = "", ts_format: str = ISO_FORMAT) -> DataFrame:
    """Rows as CSV text: numbers bare, everything else quoted, times formatted, nulls as quoted ``na_rep``."""

    def cell(field) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, NumericType):
            text = col.cast("string")
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            text = _quoted(F.date_format(col, ts_format))
        else:
            text = _quoted(col.cast("string"))
        return F.coalesce(text, F.lit(f'"{na_rep}"'))

    return df.select(F.concat_ws(",", *[cell(field) for field in df.schema]).alias("line"))


def write_csv(df: DataFrame, path: str, na_rep: str = "", ts_format: str = ISO_FORMAT, mode: str = "errorifexists") -> None:
    """CSV files with a header line each.

    The header goes in front of the first row of every file, as each task writes one file.
    """
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    # The low 33 bits of the id count the rows of a task from 0.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = csv_lines(df, na_rep, ts_format).select("line", first.alias("__first"))
    text = F.when(F.col("__first"), F.concat_ws("\n", F.lit(header), F.col("line"))).otherwise(F.col("line"))
    # The header is put once for each task, so a task has to write one file.
    lines.select(text.alias("value")).write.mode(mode).option("maxRecordsPerFile", 0).text(path)
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        # No rows: the header alone, as readers of the export expect one.
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)
