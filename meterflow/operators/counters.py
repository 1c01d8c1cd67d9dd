"""Cumulative counters: rollups per step and consumption between adjacent buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.numbers import row_sum
from meterflow.functions.timing import bucket, floor_to, instant, step_interval
from meterflow.operators.filters import closed_only
from meterflow.operators.ordered import plain_delta


def counter_rollup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: str,
    peaks: Mapping[str, str],
    cumuls: Mapping[str, str],
    gts: str = "gts",
    count: str = "cnt",
) -> DataFrame:
    """Rows, highest reading and last counter per series and bucket (labelled with its end).

    ``peaks`` and ``cumuls`` map result names to input columns, so one pass serves a
    long table (one circuit) and a wide one (many circuits). All parts combine map-side.
    """
    tops = {**peaks, **cumuls}
    return (
        df.groupBy(*keys, F.window(ts, step).alias("__w"))
        .agg(F.count(F.lit(1)).alias(count), *[F.max(src).alias(new) for new, src in tops.items()])
        .select(*keys, F.col("__w")["end"].alias(gts), count, *tops)
    )


def carry_in(
    df: DataFrame, keys: Sequence[str], ts: str, step: str, before, cumuls: Mapping[str, str], gts: str = "gts"
) -> DataFrame:
    """Last raw counters of every series before a point in time, as a seed for ``counter_delta``.

    Only the bucket of that time and the one before it can be adjacent to what follows,
    so nothing older is read.
    """
    edge = instant(df, ts, before)
    oldest = (floor_to(edge, step) - step_interval(step)).cast(df.schema[ts].dataType)
    older = df.where((F.col(ts) >= oldest) & (F.col(ts) < edge))
    # max_by over plain number columns keeps hash aggregation; a struct would force a sort.
    last = older.groupBy(*keys).agg(
        F.max(ts).alias("__last"), *[F.max_by(src, ts).alias(new) for new, src in cumuls.items()]
    )
    return last.where(F.col("__last").isNotNull()).select(*keys, bucket(F.col("__last"), step, "end").alias(gts), *cumuls)


def counter_delta(
    df: DataFrame,
    keys: Sequence[str],
    gts: str,
    step: str,
    cols: Mapping[str, str],
    null_prev: str = "null",
    seed: DataFrame | None = None,
    prev: str = "prev_gts",
) -> DataFrame:
    """Consumption per bucket: counter minus the counter of the bucket one step earlier.

    ``cols`` maps result names to counter columns of a rollup (one row per key and
    bucket). Without an adjacent bucket the result is null. ``seed`` rows (see
    ``carry_in``) count as predecessors only. ``null_prev='reference'`` takes -1 for an
    adjacent bucket whose counter is missing.

    Every bucket is sent to its own slot and to the next one, and both meet in one
    aggregation on (keys, slot): no ordered window, no second pass over the input.
    """
    if null_prev not in ("null", "reference"):
        raise ValueError("null_prev is 'null' or 'reference'")
    counters = list(dict.fromkeys(cols.values()))
    payload = [c for c in df.columns if c not in keys and c != gts]
    ahead = F.col(gts) + step_interval(step)

    def slot(kind: int, at: Column, names: Sequence[str], types: Mapping[str, object]) -> Column:
        return F.struct(
            at.alias("slot"),
            F.lit(kind).alias("kind"),
            F.col(gts).alias("label"),
            *[(F.col(c) if c in names else F.lit(None).cast(types[c])).alias(c) for c in payload],
        )

    types = {c: df.schema[c].dataType for c in payload}
    own, before, seeded = 0, 1, 2
    slots = df.select(
        *keys,
        F.inline(F.array(slot(own, F.col(gts), payload, types), slot(before, ahead, counters, types))),
    )
    if seed is not None:
        slots = slots.unionByName(
            seed.select(
                *keys,
                F.inline(
                    F.array(slot(seeded, F.col(gts), counters, types), slot(seeded, ahead, counters, types))
                ),
            )
        )

    def of(kind: int, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    met = (
        slots.groupBy(*keys, "slot")
        .agg(
            F.count_if(F.col("kind") == own).alias("__own"),
            of(before, "label").alias("__before"),
            of(seeded, "label").alias("__seeded"),
            *[of(own, c).alias(c) for c in payload],
            *[of(before, c).alias(f"__before_{c}") for c in counters],
            *[of(seeded, c).alias(f"__seeded_{c}") for c in counters],
        )
        .where(F.col("__own") > 0)
    )
    missing = F.lit(None) if null_prev == "null" else F.lit(-1)

    def use(c: str) -> Column:
        previous = F.when(F.col("__before").isNotNull(), F.col(f"__before_{c}")).otherwise(F.col(f"__seeded_{c}"))
        return F.when(F.coalesce("__before", "__seeded").isNotNull(), F.col(c) - F.coalesce(previous, missing))

    return met.select(
        *keys,
        F.col("slot").alias(gts),
        *payload,
        *[use(c).alias(new) for new, c in cols.items()],
        F.coalesce("__before", "__seeded").alias(prev),
    )


def daily_counter_rollup(
    df: DataFrame, ts: str, circuits: Mapping[str, tuple[str, str]], now=None, high_water=None
) -> DataFrame:
    """Days of a wide counter table, with the whole house.

    ``circuits`` maps a name to its (current, cumulative) columns. ``all_peak`` is the
    highest sum of simultaneous readings, not the sum of the peaks. Only closed UTC days
    after ``high_water`` (a day label already stored) are made.
    """
    df = closed_only(df, ts, "1 day", now)
    if high_water is not None:
        df = df.where(F.col(ts) >= instant(df, ts, high_water))
    totals = df.select(
        "*",
        row_sum([curr for curr, _ in circuits.values()], null_as_zero=True).alias("__peak"),
        row_sum([cumul for _, cumul in circuits.values()], null_as_zero=True).alias("__cumul"),
    )
    return counter_rollup(
        totals,
        [],
        ts,
        "1 day",
        {**{f"{n}_peak": curr for n, (curr, _) in circuits.items()}, "all_peak": "__peak"},
        {**{f"{n}_cumul": cumul for n, (_, cumul) in circuits.items()}, "all_cumul": "__cumul"},
        count="measures_count",
    )


def with_deltas(stats: DataFrame, names: Sequence[str], gts: str = "gts", **sizing) -> DataFrame:
    """``<name>_use`` for every ``<name>_cumul`` of a rollup, against the row before."""
    return plain_delta(stats, [], [gts], {f"{n}_use": f"{n}_cumul" for n in names}, **sizing)


def group_5min(df: DataFrame, ts: str, curr: str, cumul: str, keys: Sequence[str] = ()) -> DataFrame:
    """Five-minute groups labelled with their start: count, peak and counter reading, in time order."""
    return (
        df.groupBy(*keys, F.window(ts, "5 minutes").alias("__w"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.max(curr).alias("peak"), F.max(cumul).alias("reading"))
        .select(*keys, F.col("__w")["start"].alias("interval"), "cnt", "peak", "reading")
        .orderBy("interval", *keys)
    )
