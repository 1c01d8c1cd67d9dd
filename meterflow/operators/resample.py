"""Zone-aware resampling with empty buckets, and daily statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions.timing import day_key, step_micros, to_local, to_utc
from meterflow.operators.ordered import BLOCK_ROWS, join_on, running_counts
from meterflow.session import hint_if_small, small_side, written

#: Request step letters.
_STEP_LETTERS = {
    "S": "second",
    "s": "second",
    "sec": "second",
    "T": "minute",
    "min": "minute",
    "H": "hour",
    "h": "hour",
    "D": "day",
    "W": "week",
    "M": "month",
    "ME": "month",
    "Q": "quarter",
    "QE": "quarter",
    "A": "year",
    "Y": "year",
    "YE": "year",
}
_CALENDAR = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}

HOW = ("sum", "mean", "min", "max", "count", "first", "last", "median", "std", "var")


_DAY_MICROS = 86_400_000_000
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def parse_step(step: str) -> tuple[int, str]:
    """``'H'``, ``'15min'``, ``'30S'``, ``'3 hours'``, ``'2D'``, ``'36H'``, ``'W'`` -> (count, unit). Whole days of hours become days."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", step)
    if not match:
        raise ValueError(f"unknown step {step!r}")
    count, word = int(match[1] or 1), match[2]
    unit = _STEP_LETTERS.get(word, word.lower().rstrip("s"))
    if unit not in _CALENDAR and unit not in ("second", "minute", "hour") or not count:
        raise ValueError(f"unknown step {step!r}")
    if unit not in _CALENDAR and step_micros(f"{count} {unit}") >= _DAY_MICROS:
        days, rest = divmod(step_micros(f"{count} {unit}"), _DAY_MICROS)
        return (count, unit) if rest else (days, "day")
    return count, unit


def _even(step: tuple[int, str]) -> bool:
    """Whether a sub-day step divides an hour; its buckets are then the same in every zone of whole hours."""
    count, unit = step
    return unit not in _CALENDAR and 3_600_000_000 % step_micros(f"{count} {unit}") == 0


def _long(step: tuple[int, str]) -> bool:
    """Whether a step of hours, minutes or seconds is longer than a day and no whole number of days."""
    count, unit = step
    return unit not in _CALENDAR and step_micros(f"{count} {unit}") > _DAY_MICROS


def _anchored(step: tuple[int, str]) -> bool:
    """Whether buckets count from the first of the series and not from the clock."""
    return step[0] > 1 and step[1] in _CALENDAR or _long(step)


def _start(ts: Column, step: tuple[int, str], tz: str, first: Column | None = None) -> Column:
    """Start of the local bucket: a UTC instant for steps that divide an hour, else a wall clock of ``tz``.

    Other sub-day steps count from local midnight. Several days, weeks, months or years at once count
    from ``first``, the first bucket of one unit of the series, and steps such as 36 hours from its first midnight.
    """
    count, unit = step
    if unit in _CALENDAR:
        one = F.date_trunc(unit, to_local(ts, tz)).cast("timestamp_ntz")
        return one if count == 1 or first is None else _group(one, step, first)
    # Going back from the instant by the local remainder keeps the two hours apart that
    # share a wall-clock time when summer time ends.
    micros = F.unix_micros(ts.cast("timestamp"))
    local = micros if tz == "UTC" else F.unix_micros(to_local(ts, tz).cast("timestamp"))
    span = F.lit(step_micros(f"{count} {unit}"))
    if _even(step):
        return F.timestamp_micros(micros - F.pmod(local, span)).cast("timestamp_ntz")
    if _long(step):
        origin = F.unix_micros(first.cast("timestamp"))
        return F.timestamp_micros(local - F.pmod(local - origin, span)).cast("timestamp_ntz")
    of_day = F.pmod(local, F.lit(_DAY_MICROS))
    return F.timestamp_micros(local - F.pmod(of_day, span)).cast("timestamp_ntz")


def _group(one: Column, step: tuple[int, str], first: Column) -> Column:
    """Start of the group of ``count`` units, counted from ``first``, that holds the unit beginning at ``one``."""
    count, unit = step
    if unit in _MONTHS:
        months = lambda c: F.year(c) * 12 + F.month(c)
        past = months(one) - months(first)
        return F.add_months(first, past - F.pmod(past, F.lit(count * _MONTHS[unit]))).cast("timestamp_ntz")
    past = F.datediff(one, first)
    return F.date_add(first, past - F.pmod(past, F.lit(count * (7 if unit == "week" else 1)))).cast("timestamp_ntz")


def _span(step: tuple[int, str]) -> Column:
    count, unit = step
    if unit not in _CALENDAR:
        return F.expr(f"INTERVAL '{count}' {unit}")
    if unit in _MONTHS:
        return F.expr(f"INTERVAL '{count * _MONTHS[unit]}' MONTH")
    return F.expr(f"INTERVAL '{count * (7 if unit == 'week' else 1)}' DAY")


def _label(start: Column, step: tuple[int, str], tz: str, label: str) -> Column:
    """UTC name of a bucket. Buckets of days and below are named by an edge; longer ones by
    the last day before (left) or inside (right) them, as period-end labels are."""
    unit = step[1]
    edge = start if label == "left" else start + _span(step)
    if _even(step):
        return edge
    if unit not in _CALENDAR and not _long(step) and label == "right":
        # The last bucket of a day ends with the day.
        edge = F.least(edge, F.date_trunc("day", start).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return to_utc(edge if unit not in _CALENDAR or unit == "day" else edge - F.expr("INTERVAL 1 DAY"), tz)


def _range_of(rolled: DataFrame, keys: Sequence[str], at: str, cols: Sequence[Column]) -> DataFrame:
    """First and last bucket of every key of a rollup.

    Counting the values as well keeps all columns of the rollup in use here. Both uses of it
    are then the same plan, and Spark computes it once and reuses the exchange.
    """
    seen = [F.count(c).alias(f"__n{i}") for i, c in enumerate(cols)]
    bounds = rolled.groupBy(*keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"), *seen)
    in_use = F.greatest(F.lit(0), *[F.col(f"__n{i}") for i in range(len(cols))]) >= 0
    return bounds.where(F.col("__lo").isNotNull() & in_use).select(*keys, "__lo", "__hi")


def _spine(bounds: DataFrame, keys: Sequence[str], step: tuple[int, str], tz: str) -> DataFrame:
    """Every bucket from ``__lo`` to ``__hi`` of each key.

    Sub-day steps are laid out by day first; the days are spread over the cluster
    before they are cut finer, so a long range is not built in one task.
    """
    fine = _span(step)
    if step[1] in _CALENDAR or _long(step):
        return bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", fine)).alias("__b"))
    day = F.expr("INTERVAL 1 DAY")
    if _even(step):
        days = bounds.select(*keys, "__hi", F.explode(F.sequence("__lo", "__hi", day)).alias("__day"))
        stop = F.least(F.col("__day") + day - fine, F.col("__hi"))
        return days.repartition(*keys, "__day").select(*keys, F.explode(F.sequence("__day", stop, fine)).alias("__b"))
    midnight = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    days = bounds.select(
        *keys, "__lo", "__hi", F.explode(F.sequence(midnight("__lo"), midnight("__hi"), day)).alias("__day")
    )
    stop = F.col("__day") + day - F.expr("INTERVAL 1 SECOND")
    cut = days.repartition(*keys, "__day").select(
        *keys, "__lo", "__hi", F.explode(F.sequence("__day", stop, fine)).alias("__b")
    )
    # A bucket that lies wholly in the hour skipped in spring doesn't exist.
    exists = to_local(to_utc(F.col("__b"), tz), tz) < F.col("__b") + fine
    return cut.where(F.col("__b").between(F.col("__lo"), F.col("__hi")) & exists).select(*keys, "__b")


def _with_empty(spine: DataFrame, rolled: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every bucket of the spine, with its values if the rollup has it.

    Stacking both and aggregating needs one shuffle and no sort; a join that keeps null keys
    would shuffle and sort both sides.
    """
    values = [f for f in rolled.schema if f.name not in group]
    empty = spine.select(*group, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values])
    return empty.unionByName(rolled).groupBy(*group).agg(*[F.max(f.name).alias(f.name) for f in values])


def _aggregate(how: str, value: Column, ts: Column) -> Column:
    seen = F.when(value.isNotNull(), ts)
    return {
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "count": lambda: F.count(value),
        "first": lambda: F.min_by(value, seen),
        "last": lambda: F.max_by(value, seen),
        "std": lambda: F.stddev_samp(value),
        "var": lambda: F.var_samp(value),
    }[how]()


def _large_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str], **sizing) -> DataFrame:
    """Exact medians of groups of any size: the middle places of the ordered values.

    Equal values are counted first, and the counts are added up across partitions, so
    neither a large group nor a frequent value ends up in one task.
    """
    pairs = [F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__v")) for c in cols]
    long = df.select(*keys, F.inline(F.array(*pairs))).where(F.col("__v").isNotNull())
    group = [*keys, "__col"]
    counted = long.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    placed = running_counts(counted, group, ["__v"], "__c", "__upto", "__n", **sizing)

    def at(place: Column, col: str) -> Column:
        holds = (F.col("__upto") - F.col("__c") < place) & (place <= F.col("__upto"))
        return F.max(F.when(holds & (F.col("__col") == col), F.col("__v")))

    half = (F.col("__n") + 1) / 2
    middles = placed.groupBy(*keys).agg(*[((at(F.floor(half), c) + at(F.ceil(half), c)) / 2).alias(c) for c in cols])
    # A group with no value at all keeps its row.
    return join_on(df.select(*keys).distinct(), middles, keys, "left")


def _medians(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], block_rows: int = BLOCK_ROWS, **sizing
) -> DataFrame:
    """Exact medians. The built-in one holds the values of a group, so it gets the groups
    one task can hold; larger ones, found by counting, are done across tasks."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = written(counts.where(F.col("__n") > block_rows).select(*keys), "large")
    usual = [F.median(c).alias(c) for c in cols]
    if large.isEmpty():
        return df.groupBy(*keys).agg(*usual)
    large = hint_if_small(large)
    rest = join_on(df, large, keys, "left_anti").groupBy(*keys).agg(*usual)
    hot = join_on(df, large, keys, "left_semi")
    return rest.unionByName(_large_medians(hot, keys, cols, block_rows=block_rows, **sizing))


def resample(
    df: DataFrame,
    ts: str,
    step: str,
    how: str = "sum",
    label: str = "left",
    tz: str = "UTC",
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    fill: bool = True,
    **sizing,
) -> DataFrame:
    """One aggregate for all value columns per local bucket; empty buckets in between are kept.

    ``step`` is any number of seconds, minutes, hours, days, weeks, months, quarters or years. Sub-day steps that
    don't divide an hour begin anew at each local midnight; several days or more at once count from the
    first unit of the series, other steps over a day from its first local midnight by the local clock. The range of a series runs from its first to its last bucket. Empty buckets count 0
    and are null for every other aggregate. Labels are UTC instants in column ``ts``.
    """
    if how not in HOW or label not in ("left", "right"):
        raise ValueError(f"how is one of {HOW}, label is 'left' or 'right'")
    parsed = parse_step(step)
    keys = list(keys)
    cols = [c for c in df.columns if c != ts and c not in keys] if cols is None else list(cols)
    group = [*keys, "__b"]
    first = None
    if _anchored(parsed):
        one = F.min(_start(F.col(ts), (1, "day" if _long(parsed) else parsed[1]), tz)).alias("__first")
        if keys:
            df = join_on(df, small_side(df.groupBy(*keys).agg(one)), keys, "left")
            first = F.col("__first")
        else:
            first = F.lit(df.agg(one).first()[0]).cast("timestamp_ntz")
    placed = df.select(*keys, *cols, F.col(ts).alias("__ts"), _start(F.col(ts), parsed, tz, first).alias("__b"))
    placed = placed.where(F.col("__ts").isNotNull())
    if how == "median":
        rolled = _medians(placed, group, cols, **sizing)
    else:
        rolled = placed.groupBy(*group).agg(*[_aggregate(how, F.col(c), F.col("__ts")).alias(c) for c in cols])
    if fill:
        # A count is never null, so counting it would be dropped from the plan.
        used = [F.nullif(F.col(c), F.lit(-1)) if how == "count" else F.col(c) for c in cols]
        spine = _spine(_range_of(rolled, keys, "__b", used), keys, parsed, tz)
        rolled = _with_empty(spine, rolled, group)
        if how == "count":
            rolled = rolled.fillna(0, cols)
    return rolled.select(*keys, _label(F.col("__b"), parsed, tz, label).alias("ts"), *cols)


def daily_stats(
    df: DataFrame, ts: str, value: str, tz: str = "UTC", keys: Sequence[str] = (), fill: bool = False
) -> DataFrame:
    """Lowest, highest and mean value per local day; ``fill`` adds days without any value."""
    keys = list(keys)
    placed = df.select(*keys, value, day_key(F.col(ts), tz).alias("ts"))
    stats = placed.groupBy(*keys, "ts").agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg")
    )
    if not fill:
        return stats
    bounds = _range_of(stats, keys, "ts", [F.col(c) for c in ("min", "max", "avg")])
    days = bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr("INTERVAL 1 DAY"))).alias("ts"))
    return _with_empty(days, stats, [*keys, "ts"])


def daily_rollup(
    df: DataFrame,
    ts: str,
    value: str,
    tz: str,
    keys: Sequence[str] = ("sourceType", "sourceId", "eventType", "locationType"),
) -> DataFrame:
    """The daily view of climate events, keyed by zone as well: min, avg, max and count."""
    names = ["minvalue", "avgvalue", "maxvalue", "eventCount"]
    days = df.groupBy(*keys, day_key(F.col(ts), tz).alias("__day")).agg(
        *[f(value).alias(name) for f, name in zip((F.min, F.avg, F.max, F.count), names)]
    )
    return days.select(
        *keys,
        F.date_format("__day", "yyyyMMdd").alias("eventGroupTimestamp"),
        *names,
        F.lit(tz).alias("aggregationTimezone"),
    )
