"""Reshaping for display: no-data flags, stacked totals, extents, day segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.numbers import is_nodata, value_or_zero
from meterflow.functions.timing import day_key, instant
from meterflow.operators.ordered import join_on, positions
from meterflow.session import small_side


def flag_nodata(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null becomes 0 and is remembered in ``<col>_nodata``."""
    return df.select(
        *[value_or_zero(c).alias(c) if c in cols else F.col(c) for c in df.columns],
        *[is_nodata(c).alias(f"{c}_nodata") for c in cols],
    )


def unpivot_totals(df: DataFrame, cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per series and time, stacked: ``stack`` runs across the series in column
    order, ``total`` is the whole stack. Everything is computed within the row."""
    filled = [value_or_zero(c) for c in cols]
    stacks = [reduce(lambda a, b: a + b, filled[: i + 1]) for i in range(len(cols))]
    parts = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("pos"),
                F.lit(c).alias("name"),
                filled[i].alias("value"),
                stacks[i].alias("stack"),
                stacks[-1].alias("total"),
                is_nodata(c).alias("nodata"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return df.select(ts, F.inline(parts))


def between_open(df: DataFrame, ts: str, lo=None, hi=None) -> DataFrame:
    """Rows strictly between two times; either may be open."""
    if lo is not None:
        df = df.where(F.col(ts) > instant(df, ts, lo))
    if hi is not None:
        df = df.where(F.col(ts) < instant(df, ts, hi))
    return df


def extent(df: DataFrame, low: str, high: str, ts: str | None = None, lo=None, hi=None) -> DataFrame:
    """Smallest ``low`` and largest ``high``, over all rows or an open time interval."""
    if ts is not None:
        df = between_open(df, ts, lo, hi)
    return df.agg(F.min(low).alias("low"), F.max(high).alias("high"))


def max_across(dfs: Sequence[tuple[DataFrame, str, str]], lo=None, hi=None) -> DataFrame:
    """Largest value over several (table, time column, value column) sets in an open interval."""
    parts = [between_open(df, ts, lo, hi).agg(F.max(value).alias("top")) for df, ts, value in dfs]
    return reduce(lambda a, b: a.unionByName(b), parts).agg(F.max("top").alias("top"))


def last_per_day(df: DataFrame, id_col: str, ts: str, tz: str = "UTC", keys: Sequence[str] = ()) -> DataFrame:
    """The row with the highest id of every day.

    The ids to keep are one per day, found by hash aggregation over two columns; the
    table is then filtered against them where it lies.
    """
    keys = list(keys)
    ids = df.groupBy(*keys, day_key(F.col(ts), tz).alias("__day")).agg(F.max(id_col).alias(id_col))
    return join_on(df, small_side(ids.select(*keys, id_col)), [*keys, id_col], "left_semi")


def day_segments(df: DataFrame, ts: str, tz: str, order: Sequence[str], keys: Sequence[str] = (), **sizing) -> DataFrame:
    """The points of every local day in order: the day and the place within it beside each point.

    Points stay rows. A list per day would have to be built in one task, however long
    the day; write the result partitioned by ``day`` to get one segment per folder.
    """
    days = df.withColumn("day", day_key(F.col(ts), tz))
    return positions(days, [*keys, "day"], order, "pos", **sizing)
