"""Climate measurements: JSON replies to one row per time and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Largest size of a stored value.
_VALUE = "decimal(14,3)"


def _cells(df: DataFrame, device: Column | str, json: str, keep: Sequence[str]) -> DataFrame:
    """One row per cell of the replies, as text; one unreadable cell costs no other."""
    body = F.from_json(json, "struct<body: map<string, array<string>>>")["body"]
    times = df.select(
        *keep,
        (F.lit(device) if isinstance(device, str) else device).alias("sourceId"),
        F.explode(body).alias("__second", "__values"),
    )
    return times.select("*", F.posexplode("__values").alias("__place", "__value"))


def explode_measures(
    df: DataFrame,
    types: Sequence[str],
    device: Column | str,
    loctype: str,
    source: str,
    json: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``{"body": {"<epoch second>": [v1, v2]}}`` -> rows; the place in the list names the type.

    Missing values make no row, nor do cells that are no number, are too large or have no type or time;
    ``measure_rejects`` lists those. ``device`` is one id or a column of ids.
    """
    rows = _cells(df, device, json, keep)
    names = F.array(*[F.lit(t) for t in types])
    value, second = F.col("__value").try_cast(_VALUE), F.col("__second").try_cast("double")
    return rows.where(value.isNotNull() & second.isNotNull() & (F.col("__place") < len(types))).select(
        *keep,
        F.timestamp_seconds(second).alias("eventTimestamp"),
        F.lit(source).alias("sourceType"),
        "sourceId",
        F.element_at(names, F.col("__place") + 1).alias("eventType"),
        value.alias("value"),
        F.lit(loctype).alias("locationType"),
    )


def measure_rejects(
    df: DataFrame, types: Sequence[str], device: Column | str, json: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """The cells ``explode_measures`` can't use, with their text and the reason, and replies that are no reply at all."""
    place, value = F.col("__place"), F.col("__value")
    reason = (
        F.when(F.col("__second").try_cast("double").isNull(), "no time")
        .when(place >= len(types), "no type")
        .when(value.try_cast("double").isNull(), "no number")
        .when(value.try_cast(_VALUE).isNull(), "too large")
    )
    cells = _cells(df, device, json, keep).where(value.isNotNull()).select(
        *keep, "sourceId", F.concat_ws(":", F.col("__second"), place, value).alias("raw"), reason.alias("reason")
    )
    whole = df.where(F.from_json(json, "struct<body: string>")["body"].isNull() & F.col(json).isNotNull()).select(
        *keep,
        (F.lit(device) if isinstance(device, str) else device).alias("sourceId"),
        F.col(json).alias("raw"),
        F.lit("no reply").alias("reason"),
    )
    return cells.where(F.col("reason").isNotNull()).unionByName(whole)


def read_measures(
    spark: SparkSession, path: str | list[str], types: Sequence[str], device: str, loctype: str, source: str
) -> DataFrame:
    """Measures of one device from saved replies, one reply per line."""
    return explode_measures(spark.read.text(path), types, device, loctype, source)
