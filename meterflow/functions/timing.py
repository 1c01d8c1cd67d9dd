"""Time expressions. Stored time is UTC; zones are applied per query."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}

#: The two text forms of stored UTC time.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
SPACE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_STORED_TIME = r"^\d{4}-\d\d-\d\d(T[\d:]{8}(\.\d{1,6})?Z| [\d:]{8}(\.\d{1,6})?)$"


def step_micros(step: str) -> int:
    """``'5 minutes'`` -> microseconds. Steps are fixed spans up to whole days."""
    count, _, unit = step.strip().partition(" ")
    unit = unit.strip().rstrip("s")
    if not count.isdigit() or unit not in _UNIT_MICROS:
        raise ValueError(f"not a fixed step: {step!r}")
    return int(count) * _UNIT_MICROS[unit]


def step_interval(step: str) -> Column:
    return F.expr(f"INTERVAL '{step_micros(step) // 1_000_000}' SECOND")


def to_ns(col: Column) -> Column:
    """Time -> epoch nanoseconds, as the feeds carry them."""
    return F.unix_micros(col.cast("timestamp")) * F.lit(1000)


def from_ns(ns: Column) -> Column:
    """Epoch nanoseconds -> time. The feeds carry microseconds at most, so nothing is lost."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))


def ns_of_seconds(seconds: Column) -> Column:
    return seconds.cast("bigint") * F.lit(1_000_000_000)


def parse_ts(text: Column) -> Column:
    """Either stored text form -> time; anything else -> null.

    The cast is cheap on text of the right shape; trying one pattern after the other
    would raise an error inside for every row of the second form.
    """
    return F.when(text.rlike(_STORED_TIME), text.try_cast("timestamp"))


def to_local(col: Column, tz: str) -> Column:
    """UTC instant -> wall clock of ``tz``.

    The session runs in UTC, so the casts change the type only. Shifting by a literal zone
    this way is several times cheaper per row than ``convert_timezone``.
    """
    at = col.cast("timestamp")
    return (at if tz == "UTC" else F.from_utc_timestamp(at, tz)).cast("timestamp_ntz")


def to_utc(wall: Column, tz: str) -> Column:
    """Wall clock of ``tz`` -> UTC instant."""
    at = wall.cast("timestamp")
    return (at if tz == "UTC" else F.to_utc_timestamp(at, tz)).cast("timestamp_ntz")


def day_key(col: Column, tz: str = "UTC", fmt: str | None = None) -> Column:
    """Calendar day of an instant in ``tz``; ``fmt`` gives text such as ``yyyyMMdd``."""
    wall = to_local(col, tz)
    return F.to_date(wall) if fmt is None else F.date_format(wall, fmt)


def bucket(col: Column, step: str, label: str = "start") -> Column:
    """Left-closed bucket of a fixed step, named by its start or its end."""
    if label not in ("start", "end"):
        raise ValueError("label is 'start' or 'end'")
    return F.window(col, step)[label]


def floor_to(col: Column, step: str) -> Column:
    """Start of the step that holds ``col``; foldable when ``col`` is a literal."""
    micros = F.unix_micros(col.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step_micros(step))))


def instant(df: DataFrame, name: str, value: Column | datetime | date | str) -> Column:
    """``value`` as a UTC literal of the type of column ``name``.

    The column itself stays uncast, so a comparison reaches the parquet scan.
    """
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    elif isinstance(value, date):
        value = value.isoformat()
    if isinstance(value, str):
        value = F.lit(value.replace("T", " ").rstrip("Z"))
    kind = df.schema[name].dataType.simpleString()
    return value.cast("timestamp_ntz").cast(kind) if kind != "timestamp" else value.cast("timestamp")


def now_or(now: Column | datetime | str | None) -> Column:
    """The reference time of a query; given explicitly for repeatable results."""
    if now is None:
        return F.current_timestamp()
    if isinstance(now, Column):
        return now.cast("timestamp")
    if isinstance(now, datetime):
        if now.tzinfo is not None:
            now = now.astimezone(timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    return F.lit(now.replace("T", " ").rstrip("Z")).cast("timestamp")
