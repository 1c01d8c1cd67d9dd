"""Meter records, one row per measure, to readings, one row per time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.numbers import unit_factor
from meterflow.operators.counters import counter_delta, counter_rollup
from meterflow.schemas import MEASURES


def _ids(*kinds: str) -> list[int]:
    return [number for number, (_, kind) in MEASURES.items() if kind in kinds]


def record_values(number: Column, value: Column, factor: Column) -> dict[str, Column]:
    """The value of a record as whole number, real number or text, whichever its measure takes.

    Whole numbers are cut towards zero after scaling.
    """
    parsed = value.try_cast("double")
    whole = (
        F.when(number.isin(_ids("scaled")), factor * parsed)
        .when(number.isin(_ids("litres")), factor * parsed * F.lit(1000))
        .when(number.isin(_ids("plain")), parsed)
    )
    return {
        "whole": whole.cast("bigint"),
        "real": F.when(number.isin(_ids("degrees")), F.round(factor * parsed, 6)),
        "text": F.when(number.isin(_ids("text")), value.cast("string")),
    }


#: How a measure is read -> where ``record_values`` puts it.
_PLACES = {"scaled": "whole", "litres": "whole", "plain": "whole", "degrees": "real", "text": "text"}


def pivot_readings(records: DataFrame) -> DataFrame:
    """Wide readings from long records; record ids outside the known measures are dropped.

    Measures belong to (device, time). Every access number seen for that device and time
    gets a row with the same measures.
    """
    number = F.col("recordId")
    values = record_values(number, F.col("recordValue"), unit_factor("recordUnit"))
    known = records.select(
        "id", "recordTimestamp", "accessNumber", "address", "recordId", *[col.alias(name) for name, col in values.items()]
    )
    # One pass: a row for each access number, with what its records say. Few rows are left for the window.
    by_access = known.groupBy("id", "recordTimestamp", "accessNumber").agg(
        # An access number keeps one row per device and time, whatever bus addresses it came by.
        F.max("address").alias("address"),
        *[F.max(F.when(number == n, F.col(_PLACES[kind]))).alias(name) for n, (name, kind) in MEASURES.items()],
    )
    whole = Window.partitionBy("id", "recordTimestamp")
    return by_access.select(
        "id",
        "address",
        "accessNumber",
        "recordTimestamp",
        *[F.max(name).over(whole).alias(name) for name, _ in MEASURES.values()],
    )


def device_stats(
    readings: DataFrame, ts: str, step: str, peak: str, cumul: str, device: str = "id", seed: DataFrame | None = None
) -> DataFrame:
    """Peak, last counter and consumption of every device by bucket, a row for each, however many devices there are."""
    rolled = counter_rollup(readings, [device], ts, step, {"peak": peak}, {"cumul": cumul})
    return counter_delta(rolled, [device], "gts", step, {"delta": "cumul"}, seed=seed)


def device_rollup(
    readings: DataFrame, devices: list[str], ts: str, step: str, peak: str, cumul: str, device: str = "id"
) -> DataFrame:
    """Rollup of several devices side by side: ``c1`` leads, the others show only if all of them have the bucket.

    One scan for all devices: a rollup by device and bucket, then one row per bucket.
    """
    rolled = counter_rollup(
        readings.where(F.col(device).isin(*devices)), [device], ts, step, {"peak": peak}, {"cumul": cumul}
    )

    def of(n: int, col: str) -> Column:
        return F.max(F.when(F.col(device) == devices[n], F.col(col)))

    side = rolled.groupBy("gts").agg(
        of(0, "cnt").alias("cnt"),
        *[of(n, part).alias(f"c{n + 1}_{part}") for n in range(len(devices)) for part in ("peak", "cumul")],
        *[F.count_if(F.col(device) == name).alias(f"__has{n}") for n, name in enumerate(devices)],
    )
    complete = F.lit(True)
    for n in range(1, len(devices)):
        complete = complete & (F.col(f"__has{n}") > 0)
    return side.where(F.col("__has0") > 0).select(
        "gts",
        "cnt",
        "c1_peak",
        "c1_cumul",
        *[
            F.when(complete, F.col(f"c{n + 1}_{part}")).alias(f"c{n + 1}_{part}")
            for n in range(1, len(devices))
            for part in ("peak", "cumul")
        ],
    )
