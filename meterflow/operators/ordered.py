"""Ordered work inside series of any size.

A plain window sorts a whole series in one task, which fails when one series
holds a large share of all rows. Here the rows of each series are counted first. Series
that one task can hold get the plain window: one shuffle, nothing stored. Longer ones are stored and
range partitioned on key *and* order, so that a series is spread over many tasks, and each
row gets its place in the series from small per-partition counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from meterflow.session import hint_if_small, small_side, written

#: Rows one task may sort for a window; longer series are cut into blocks of this size.
BLOCK_ROWS = 500_000


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join that matches null keys and keeps the left key columns."""
    names = {name: f"__{name}" for name in on}
    right = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for name, other in names.items():
        condition = condition & left[name].eqNullSafe(right[other])
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def _by_size(
    df: DataFrame,
    keys: Sequence[str],
    block_rows: int,
    usual: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """``usual`` for the series of at most ``block_rows`` rows, ``split`` for the rows of longer ones.

    Both give the same rows and only differ in how the work is laid out. Counting combines in the
    input tasks; the list of long series has less than rows / ``block_rows`` entries.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_rows)
    large = written(counts, "large")
    rows = large.agg(F.sum("__n")).first()[0]
    if not rows:
        return usual(df)
    if not keys:
        return split(df, rows)
    names = hint_if_small(large.select(*keys))
    rest, hot = (join_on(df, names, keys, how) for how in ("left_anti", "left_semi"))
    return usual(rest).unionByName(split(hot, rows))


def _tie(df: DataFrame) -> Column:
    """Tells rows of equal order apart; rows that are equal in all columns are interchangeable."""
    return F.xxhash64(*df.columns)


def _stored(df: DataFrame) -> DataFrame:
    """The rows with a number each, stored.

    The number tells equal rows apart, so that a mass of them can be split as well. Storing
    also spares the second run over the input that sampling for the ranges would need.
    """
    return written(df.withColumn("__tie", _tie(df)).withColumn("__copy", F.monotonically_increasing_id()), "rows")


def _with_offsets(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, partitions: int | None
) -> DataFrame:
    """Rows in ranges of key and order. Beside each: its partition and place there, and what
    its series holds in earlier partitions and in all.

    Partition and place are stored, so counting and numbering see the same split even if
    executors are lost. The sums have one row per key and partition the key touches:
    partitions + keys rows in all.
    """
    sort = [*keys, *order, "__tie", "__copy"]
    split = rows.repartitionByRange(partitions, *sort) if partitions else rows.repartitionByRange(*sort)
    ranged = written(
        split.sortWithinPartitions(*sort).select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "ranged",
    )
    sums = ranged.groupBy(*keys, "__part").agg(amount.alias("__n"), F.min("__row").alias("__first"))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "__part",
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(series).alias("__size"),
    )
    return join_on(ranged, small_side(offsets), [*keys, "__part"], "left")


def _ranges(rows: int, block_rows: int, partitions: int | None) -> int:
    """As many ranges as leave each about ``block_rows`` rows."""
    return partitions or -(-rows // block_rows)


def _placed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, block_rows: int, partitions: int | None
) -> tuple[DataFrame, Column, Column]:
    """Stored rows, their place in the series and the rows of it."""
    placed = _with_offsets(_stored(df), keys, order, F.count(F.lit(1)), _ranges(rows, block_rows, partitions))
    return placed, F.col("__before") + F.col("__row") - F.col("__first") + 1, F.col("__size")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    size: str | None = None,
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based place of each row in its series, and with ``size`` the rows of the series."""

    def added(placed: DataFrame, pos: Column, total: Column) -> DataFrame:
        return placed.select(
            *df.columns, pos.cast("bigint").alias(name), *([total.cast("bigint").alias(size)] if size else [])
        )

    def usual(rest: DataFrame) -> DataFrame:
        series = Window.partitionBy(*keys)
        return added(rest, F.row_number().over(series.orderBy(*order, _tie(df))), F.count(F.lit(1)).over(series))

    return _by_size(
        df, keys, block_rows, usual, lambda hot, rows: added(*_placed(hot, keys, order, rows, block_rows, partitions))
    )


def running_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    count: str,
    name: str = "upto",
    size: str = "total",
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """For rows that stand for ``count`` equal ones each: how many there are up to this row, and in all."""

    def usual(rest: DataFrame) -> DataFrame:
        series = Window.partitionBy(*keys)
        upto = F.sum(count).over(series.orderBy(*order, _tie(df)).rowsBetween(Window.unboundedPreceding, 0))
        return rest.select(*df.columns, upto.alias(name), F.sum(count).over(series).alias(size))

    def split(hot: DataFrame, rows: int) -> DataFrame:
        placed = _with_offsets(_stored(hot), keys, order, F.sum(count), _ranges(rows, block_rows, partitions))
        here = Window.partitionBy(*keys, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("__before") + F.sum(count).over(here)
        return placed.select(*df.columns, upto.alias(name), F.col("__size").alias(size))

    return _by_size(df, keys, block_rows, usual, split)


def with_trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Add columns that look at most ``back`` rows back, in blocks of bounded size.

    The last ``back`` rows of a block are repeated at the head of the next one and
    dropped again after the window, so block edges do not show in the result.
    """

    def usual(rest: DataFrame) -> DataFrame:
        added = columns(Window.partitionBy(*keys).orderBy(*order, _tie(df)))
        return rest.select(*df.columns, *[col.alias(name) for name, col in added.items()])

    def split(hot: DataFrame, rows: int) -> DataFrame:
        placed, pos, _ = _placed(hot, keys, order, rows, block_rows, partitions)
        size = max(block_rows, back + 1)
        block = F.floor((F.col("__pos") - 1) / size)
        in_tail = F.pmod(F.col("__pos") - 1, F.lit(size)) >= size - back
        homes = F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))
        spread = placed.select(*df.columns, pos.alias("__pos")).select(
            "*", block.alias("__own"), F.explode(homes).alias("__block")
        )
        added = columns(Window.partitionBy(*keys, "__block").orderBy("__pos"))
        return (
            spread.select(*df.columns, "__own", "__block", *[col.alias(name) for name, col in added.items()])
            .where(F.col("__own") == F.col("__block"))
            .drop("__own", "__block")
        )

    return _by_size(df, keys, block_rows, usual, split)


def moving_avg(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, k: int, name: str = "moving_avg", **sizing
) -> DataFrame:
    """Mean of the current and up to ``k - 1`` earlier rows of the series."""
    return with_trailing(
        df, keys, order, k - 1, lambda w: {name: F.avg(col).over(w.rowsBetween(-(k - 1), 0))}, **sizing
    )


def prev_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], prefix: str = "prev_", **sizing
) -> DataFrame:
    """Values of the row before; the first row of a series is its own predecessor."""
    has_previous = lambda w: F.lag(F.lit(True), 1, False).over(w)
    return with_trailing(
        df,
        keys,
        order,
        1,
        lambda w: {f"{prefix}{c}": F.when(has_previous(w), F.lag(c).over(w)).otherwise(F.col(c)) for c in cols},
        **sizing,
    )


def plain_delta(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str], **sizing
) -> DataFrame:
    """``{new: counter}``: difference to the row before, 0 on the first row and where a value is missing.

    ``delta_<first order column>`` names the row the difference was taken to.
    """
    at = order[0]
    return with_trailing(
        df,
        keys,
        order,
        1,
        lambda w: {
            **{new: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) for new, c in cols.items()},
            f"delta_{at}": F.coalesce(F.lag(at).over(w), F.col(at)),
        },
        **sizing,
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The last ``n`` rows of every group; without keys, of the whole table.

    The rank limit is applied in every input task before the shuffle, so a hot
    group sends at most ``n`` rows per task.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.select("*", rank.alias("__rank")).where(F.col("__rank") <= n).drop("__rank")
