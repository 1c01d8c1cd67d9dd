"""Row-wise numbers, null handling and measurement units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The exponent part of a unit text and its factor. "T" is 1e9 on purpose.
UNIT_FACTORS = {
    "m": 1 / 1000,
    "my": 1 / 1000000,
    "10": 10.0,
    "100": 100.0,
    "k": 1000.0,
    "10 k": 10000.0,
    "100 k": 100000.0,
    "M": 1000000.0,
    "T": 1000000000.0,
}


def _columns(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_sum(cols: Sequence[Column | str], null_as_zero: bool = False) -> Column:
    """Sum across columns. Nulls are skipped; all null gives null, or 0 with ``null_as_zero``."""
    cols = _columns(cols)
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    return total if null_as_zero else F.when(F.coalesce(*cols).isNotNull(), total)


def row_max(cols: Sequence[Column | str]) -> Column:
    """Largest value across columns, nulls skipped."""
    cols = _columns(cols)
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def value_or_zero(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0))


def is_nodata(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).isNull()


def null_if_blank(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def unit_factor(unit: Column | str) -> Column:
    """Multiplier in a unit text ``quantity;exponent;unit``; 1 when there is none."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    exponent = F.split_part(unit, F.lit(";"), F.lit(2))
    known = F.create_map(*[F.lit(v) for pair in UNIT_FACTORS.items() for v in pair])
    return F.coalesce(
        F.try_element_at(known, exponent),
        F.when(exponent.startswith("1e"), exponent.try_cast("double")),
        F.lit(1.0),
    )
