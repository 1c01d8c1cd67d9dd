"""Bounds, local calendar ranges, series filters and projections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.timing import floor_to, instant, now_or, to_local, to_utc


def bounded(df: DataFrame, ts: str, mints=None, maxts=None) -> DataFrame:
    """Both bounds: inclusive between. One bound: strict. None: all rows."""
    low = None if mints is None else instant(df, ts, mints)
    high = None if maxts is None else instant(df, ts, maxts)
    if low is not None and high is not None:
        return df.where(F.col(ts).between(low, high))
    if low is not None:
        return df.where(F.col(ts) > low)
    return df if high is None else df.where(F.col(ts) < high)


def _local_day(value: str | date | None, tz: str, now) -> Column:
    if value is None:
        return F.to_date(to_local(now_or(now), tz))
    if isinstance(value, str) and "-" not in value:
        value = datetime.strptime(value, "%Y%m%d").date()
    return F.lit(str(value)).cast("date")


def local_range(
    df: DataFrame, ts: str, mindate=None, maxdate=None, tz: str = "UTC", now: datetime | str | None = None
) -> DataFrame:
    """Rows of whole calendar days in ``tz``, both days included; default is today.

    The day edges are constants, folded to two UTC literals before the scan, so
    the filter is pushed down whatever the zone is.
    """
    start = to_utc(_local_day(mindate, tz, now).cast("timestamp_ntz"), tz)
    end = to_utc(F.date_add(_local_day(maxdate, tz, now), 1).cast("timestamp_ntz"), tz)
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= start.cast(kind)) & (F.col(ts) < end.cast(kind)))


def for_series(df: DataFrame, **equal) -> DataFrame:
    """Equality on any of source, type, location...; ``None`` leaves a column open."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def closed_only(df: DataFrame, ts: str, step: str, now=None) -> DataFrame:
    """Drop the bucket that is still running at ``now``."""
    edge = floor_to(now_or(now), step).cast(df.schema[ts].dataType.simpleString())
    return df.where(F.col(ts) < edge)


def project(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """The time column as ``ts`` and the asked columns, in the asked order."""
    return df.select(F.col(ts).alias("ts"), *columns)


def with_params(df: DataFrame, **params) -> DataFrame:
    """One-row parameters are constants of the plan; no join is needed to attach them."""
    return df.select("*", *[F.lit(value).alias(name) for name, value in params.items()])
