"""The questions users ask, each one lazy plan from stored table to result.

Results are DataFrames; ``sources.write_csv`` gives the CSV form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.numbers import row_max, row_sum
from meterflow.operators.filters import bounded, for_series, local_range, project
from meterflow.operators.resample import daily_stats, resample
from meterflow.operators.series import merge_series, resolve_series
from meterflow.operators.shape import last_per_day
from meterflow.schemas import CIRCUITS
from meterflow.sources.tables import ISO_FORMAT, write_csv

#: The series of each named bundle, in result order.
#: indirect0: floor heat, ventilation, bathroom floor heat, hot water.
#: indirect1: the three phases of the boiler, wood boiler.
BUNDLES = {
    "indirect0": ["c1_delta", "c4_use", "c3_use", "c3_delta"],
    "indirect1": ["c6_use", "c7_use", "c8_use", "c2_delta"],
}
_PHASES = ["c6_use", "c7_use", "c8_use"]


def _resampled(df: DataFrame, tz: str, aggrto: str | None, aggrhow: str, aggrlabel: str) -> DataFrame:
    return df if aggrto is None else resample(df, "ts", aggrto, aggrhow, aggrlabel, tz)


def datasets_for(
    spark: SparkSession, routing: DataFrame, datasets: Mapping[str, DataFrame], device: str, datatypes: Sequence[str]
) -> dict[str, DataFrame] | None:
    """The table that serves each requested type of a device; ``None`` when any is not served.

    One request names a handful of types, so its resolved pairs come to the driver.
    """
    wanted = spark.createDataFrame([(0, device, t) for t in datatypes], "request int, device string, datatype string")
    routed = {r["datatype"]: datasets[r["dataset"]] for r in resolve_series(wanted, routing, available=list(datasets)).collect()}
    return routed if routed else None


def with_house_totals(stats: DataFrame, datatypes: Sequence[str]) -> DataFrame:
    """Whole-house columns, computed only when asked: sums of use and counters, highest peak."""
    makers = {"all_use": row_sum, "all_cumul": row_sum, "all_peak": row_max}
    for name, maker in makers.items():
        if name in datatypes:
            part = name.removeprefix("all_")
            stats = stats.withColumn(name, maker([f"c{n}_{part}" for n in CIRCUITS]))
    return stats


def power_stats(
    stats: DataFrame,
    datatypes: Sequence[str] = ("all_use", "all_cumul", "all_peak", "measures_count"),
    mindate=None,
    maxdate=None,
    tz: str = "UTC",
    aggrto: str | None = None,
    aggrhow: str = "sum",
    aggrlabel: str = "left",
    ts: str = "gts",
    now=None,
) -> DataFrame:
    """Electricity statistics of local days: slice, totals, projection, resampling."""
    sliced = local_range(stats, ts, mindate, maxdate, tz, now)
    return _resampled(project(with_house_totals(sliced, datatypes), datatypes, ts), tz, aggrto, aggrhow, aggrlabel)


def energy_water(
    stats: DataFrame,
    datatypes: Sequence[str] = ("c1_delta",),
    mindate=None,
    maxdate=None,
    tz: str = "UTC",
    aggrto: str | None = None,
    aggrhow: str = "sum",
    aggrlabel: str = "left",
    ts: str = "gts",
    now=None,
) -> DataFrame:
    """Heat-meter statistics of local days: slice, projection, resampling."""
    sliced = local_range(stats, ts, mindate, maxdate, tz, now)
    return _resampled(project(sliced, datatypes, ts), tz, aggrto, aggrhow, aggrlabel)


def combined(
    electricity: DataFrame,
    water: DataFrame,
    combo: str = "indirect0",
    mindate=None,
    maxdate=None,
    tz: str = "UTC",
    aggrto: str | None = None,
    aggrhow: str = "sum",
    aggrlabel: str = "left",
    ts: str = "gts",
    now=None,
) -> DataFrame:
    """A named bundle of electricity and heat series side by side; boiler phases are summed."""
    datatypes = BUNDLES[combo]
    parts = [
        project(local_range(df, ts, mindate, maxdate, tz, now), [c for c in datatypes if c in df.columns], ts)
        for df in (electricity, water)
    ]
    merged = merge_series(parts, "ts")
    if combo == "indirect1":
        merged = merged.withColumn("c678_use", row_sum(_PHASES))
        datatypes = ["c678_use", "c2_delta"]
    return _resampled(merged.select("ts", *datatypes), tz, aggrto, aggrhow, aggrlabel)


def clima_daily(
    events: DataFrame,
    datatype: str,
    device: str | None,
    tz: str = "UTC",
    fill: bool = True,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Daily min, max and mean of one climate series, with empty days unless ``fill`` is off.

    Without a device the type is taken over all devices.
    """
    c = {"source": "sourceId", "type": "eventType", "ts": "eventTimestamp", "value": "value", **(columns or {})}
    series = for_series(events, **{c["source"]: device, c["type"]: datatype})
    return daily_stats(series, c["ts"], c["value"], tz, fill=fill)


def clima_events(
    events: DataFrame,
    datatypes: Sequence[str],
    device: str | None,
    mindate=None,
    maxdate=None,
    tz: str = "UTC",
    now=None,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Several types of one device side by side per time; without a device, those of every device, with its id.

    All types lie in one table, so one pass with a column per type replaces the outer merge.
    """
    c = {"source": "sourceId", "type": "eventType", "ts": "eventTimestamp", "value": "value", **(columns or {})}
    series = local_range(for_series(events, **{c["source"]: device}), c["ts"], mindate, maxdate, tz, now)
    kind = F.col(c["type"])
    return (
        series.where(kind.isin(*datatypes))
        .groupBy(F.col(c["ts"]).alias("ts"), *([] if device is not None else [c["source"]]))
        .agg(*[F.max(F.when(kind == t, F.col(c["value"]))).alias(t) for t in datatypes])
    )


def daily_last(counters: DataFrame, id_col: str, cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last stored counters of every UTC day."""
    return last_per_day(counters, id_col, ts).select(ts, *cols)


def raw_range(stored: DataFrame, mints=None, maxts=None, ts: str = "ts") -> DataFrame:
    """Stored rows as they are: between both times, after ``mints`` or before ``maxts`` alone; a request without a bound gets none."""
    if mints is None and maxts is None:
        return stored.limit(0)
    return bounded(stored, ts, mints, maxts)


def export_range(stored: DataFrame, path: str, mints=None, maxts=None, ts: str = "ts", ts_format: str = ISO_FORMAT) -> None:
    """``raw_range`` as CSV files for another server, written by the tasks that read the rows; a header alone if there are none."""
    write_csv(raw_range(stored, mints, maxts, ts), path, ts_format=ts_format)
