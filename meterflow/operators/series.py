"""Putting several series side by side, and finding the right ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.operators.ordered import join_on
from meterflow.session import small_side


def _stack(dfs: Sequence[DataFrame], on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All inputs under each other, each with its own columns and its number."""
    values = [c for df in dfs for c in df.columns if c not in on]
    if len(values) != len(set(values)):
        raise ValueError(f"series share column names: {sorted(values)}")
    tagged = [df.select(*on, F.lit(i).alias("__src"), *[c for c in df.columns if c not in on]) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), values


def _unique(counts: Sequence[Column], on: Sequence[str]) -> Column:
    """True, and an error for the query where one series has a key twice: its rows would melt into one that never was."""
    twice = reduce(lambda a, b: a | b, [c > 1 for c in counts])
    return F.when(twice, F.raise_error(F.lit(f"a series has several rows of one {', '.join(on)}")).cast("boolean")).otherwise(
        F.lit(True)
    )


def merge_series(dfs: Sequence[DataFrame], on: str | Sequence[str] = "ts") -> DataFrame:
    """Full outer merge of any number of series that are unique on ``on``; a repeated key is an error.

    One aggregation on the merge key in place of a chain of outer joins, each of which
    would shuffle the growing result again.
    """
    on = [on] if isinstance(on, str) else list(on)
    stacked, values = _stack(dfs, on)
    seen = [f"__seen{i}" for i in range(len(dfs))]
    met = stacked.groupBy(*on).agg(
        *[F.max(c).alias(c) for c in values],
        *[F.count_if(F.col("__src") == i).alias(name) for i, name in enumerate(seen)],
    )
    return met.where(_unique([F.col(c) for c in seen], on)).select(*on, *values)


def align_left(base: DataFrame, others: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """All of ``base``; the others' columns only where **every** other series has the key.

    Equals a left join to the inner join of the others, for series unique on ``on``; a repeated key is an error.
    """
    on = [on] if isinstance(on, str) else list(on)
    stacked, values = _stack([base, *others], on)
    seen = [f"__seen{i}" for i in range(len(others) + 1)]
    met = stacked.groupBy(*on).agg(
        *[F.max(c).alias(c) for c in values],
        *[F.count_if(F.col("__src") == i).alias(name) for i, name in enumerate(seen)],
    )
    complete = reduce(lambda a, b: a & b, [F.col(name) > 0 for name in seen[1:]], F.lit(True))
    own = set(base.columns)
    return met.where(_unique([F.col(c) for c in seen], on) & (F.col(seen[0]) > 0)).select(
        *on, *[F.col(c) if c in own else F.when(complete, F.col(c)).alias(c) for c in values]
    )


def _side_by_side(df: DataFrame, on: Sequence[str], by: str, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key with the values of every series under ``<name>_<value>``, and how many rows each series has."""
    taken = [F.max(F.when(F.col(by) == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values]
    seen = [F.count_if(F.col(by) == n).alias(f"__seen{i}") for i, n in enumerate(names)]
    met = df.where(F.col(by).isin(list(names))).groupBy(*on).agg(*taken, *seen)
    return met.where(_unique([F.col(f"__seen{i}") for i in range(len(names))], on))


def merge_series_of(df: DataFrame, on: str | Sequence[str], by: str, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``merge_series`` for series that are rows of one table, told apart by column ``by``.

    The table is read once and each row is kept or dropped by one condition for each series, in place of one scan for each.
    """
    on = [on] if isinstance(on, str) else list(on)
    return _side_by_side(df, on, by, names, values).select(*on, *[f"{n}_{v}" for n in names for v in values])


def align_left_of(df: DataFrame, on: str | Sequence[str], by: str, base: str, others: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``align_left`` for series that are rows of one table; the table is read once."""
    on = [on] if isinstance(on, str) else list(on)
    met = _side_by_side(df, on, by, [base, *others], values).where(F.col("__seen0") > 0)
    complete = reduce(lambda a, b: a & b, [F.col(f"__seen{i}") > 0 for i in range(1, len(others) + 1)], F.lit(True))
    own = [F.col(f"{base}_{v}") for v in values]
    return met.select(*on, *own, *[F.when(complete, F.col(f"{n}_{v}")).alias(f"{n}_{v}") for n in others for v in values])


def newer_than(df: DataFrame, marks: DataFrame, key: str, ts: str, mark: str = "mark") -> DataFrame:
    """Rows newer than the last stored time of their device; unknown devices pass whole.

    ``marks`` has one row per device. It is measured before it is broadcast, so the
    raw rows are normally not shuffled at all.
    """
    known = small_side(marks.select(F.col(key), F.col(mark).alias("__mark")))
    joined = join_on(df, known, [key], "left")
    return joined.where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")


def last_seen(df: DataFrame, keys: Sequence[str], ts: str, name: str = "mark") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias(name))


def high_water(df: DataFrame, ts: str, default=None, name: str = "high_water") -> DataFrame:
    """Latest time of a table as one row; ``default`` for an empty table."""
    top = F.max(ts)
    if default is not None:
        top = F.coalesce(top, F.lit(default).cast(df.schema[ts].dataType))
    return df.agg(top.alias(name))


def freshness(
    df: DataFrame, source: str, kind: str, ts: str, kinds: Sequence[str] | None = None, name: str = "fresh_to"
) -> DataFrame:
    """Per source, how far *all* its types have come: the oldest of their latest times."""
    if kinds is not None:
        df = df.where(F.col(kind).isin(*kinds))
    latest = df.groupBy(source, kind).agg(F.max(ts).alias("__latest"))
    return latest.groupBy(source).agg(F.min("__latest").alias(name))


def resolve_series(
    requests: DataFrame,
    routing: DataFrame,
    request: str = "request",
    on: Sequence[str] = ("device", "datatype"),
    available: Sequence[str] | None = None,
) -> DataFrame:
    """Dataset of every requested (device, type) pair.

    A request with a pair that has no dataset, or whose dataset is not among the
    ``available`` ones, is left out as a whole.
    """
    if available is not None:
        routing = routing.where(F.col("dataset").isin(*available))
    # A few types make up most requests: joining by shuffle would pile them up on their keys.
    routed = join_on(requests, small_side(routing.select(*on, "dataset")), on, "left")
    broken = routed.where(F.col("dataset").isNull()).select(request).distinct()
    return join_on(routed.where(F.col("dataset").isNotNull()), broken, [request], "left_anti")


def label_series(df: DataFrame, names: DataFrame | Mapping[str, str], code: str, name: str = "dispname") -> DataFrame:
    """Display name of a series code; the code itself when it has none."""
    if isinstance(names, Mapping):
        lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
        return df.select("*", F.coalesce(F.try_element_at(lookup, F.col(code)), F.col(code)).alias(name))
    lookup = names.select(F.col(names.columns[0]).alias(code), F.col(names.columns[1]).alias("__name"))
    named = join_on(df, small_side(lookup), [code], "left")
    return named.select(*df.columns, F.coalesce("__name", F.col(code)).alias(name))
