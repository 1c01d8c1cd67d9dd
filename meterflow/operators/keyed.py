"""Loading by key: first wins, last wins, dimension upserts, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from meterflow.functions.timing import now_or
from meterflow.operators.ordered import join_on
from meterflow.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, hint_if_small, written


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # The rank limit also runs in the input tasks, so repeated keys are thinned out before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.select("*", rank.alias("__rank")).where(F.col("__rank") == 1).drop("__rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, [F.col(c).asc() for c in order])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, keys, [F.col(c).desc() for c in order])


#: Types whose smallest and largest value prune files and row groups.
_ORDERED = (NumericType, DateType, TimestampType, TimestampNTZType, StringType)


def _span(delivery: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The keys of a stored delivery, with a broadcast hint if few, and a filter for what they can meet.

    One small job measures both. Columns with a null among the keys give no filter, as nulls are equal here.
    """
    kinds = {f.name: f.dataType for f in delivery.schema}
    ranged = [k for k in keys if isinstance(kinds[k], _ORDERED)]
    # Texts of times keep the exact value whatever zone the driver is in.
    edge = lambda f, k: f(k).cast("string") if isinstance(kinds[k], (DateType, TimestampType, TimestampNTZType)) else f(k)
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 8 for k in keys), F.lit(0))
    found = delivery.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(width), F.lit(0)).alias("size"),
        *[edge(f, k).alias(f"{name}_{i}") for i, k in enumerate(ranged) for name, f in (("lo", F.min), ("hi", F.max))],
        *[F.count_if(F.col(k).isNull()).alias(f"nulls_{i}") for i, k in enumerate(ranged)],
    ).first()
    within = F.lit(True)
    for i, k in enumerate(ranged):
        if found["rows"] and not found[f"nulls_{i}"]:
            lo, hi = (F.lit(found[f"{e}_{i}"]).cast(kinds[k]) for e in ("lo", "hi"))
            within = within & F.col(k).between(lo, hi)
    few = found["rows"] <= BROADCAST_MAX_ROWS and found["size"] <= BROADCAST_MAX_BYTES
    columns = delivery.select(*keys)
    return F.broadcast(columns) if few else columns, within


def rows_to_insert(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of ``new`` an insert-ignore would add; append these to the stored table.

    The delivery is deduplicated once and stored. Its smallest and largest keys go into the scan of the target, and its keys
    find those the target has, so a target much larger than the delivery is read where it lies and only as far as needed.
    """
    fresh = written(first_per_key(new, keys, order), "delivery")
    wanted, within = _span(fresh, keys)
    present = join_on(target.select(*keys).where(within), wanted, keys, "left_semi")
    return join_on(fresh, present, keys, "left_anti")


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key wins and stored rows win over new ones.

    Stored rows pass through as they are; their keys are joined with those of the delivery.
    """
    return target.unionByName(rows_to_insert(target, new, keys, order))


def insert_replace(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last new row per key wins and replaces the stored row.

    The deduplicated delivery is stored once. If its keys are few they go to the stored rows,
    which are then neither shuffled nor sorted; else both sides are shuffled.
    """
    latest = written(last_per_key(new, keys, order), "delivery")
    kept = join_on(target, hint_if_small(latest.select(*keys)), keys, "left_anti")
    return kept.unionByName(latest)


def upsert_dim(
    target: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    now=None,
    created: str = "rowCreatedTimestamp",
    updated: str = "rowUpdatedTimestamp",
) -> DataFrame:
    """Update known devices, insert unknown ones.

    An update keeps the creation time and sets the update time; an insert sets the
    creation time only. ``new`` holds one row per key.
    """
    stamp = now_or(now).cast(target.schema[created].dataType)
    kept, fresh = "__kept", "__fresh"
    old = target.select(*[F.col(c).alias(f"o_{c}") for c in target.columns], F.lit(True).alias(kept))
    incoming = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias(fresh))
    same = F.lit(True)
    for key in keys:
        same = same & old[f"o_{key}"].eqNullSafe(incoming[f"n_{key}"])
    both = old.join(incoming, same, "full_outer")
    is_new = F.col(fresh).isNotNull()

    def value(c: str) -> Column:
        if c == created:
            return F.when(F.col(kept), F.col(f"o_{c}")).otherwise(stamp)
        if c == updated:
            return F.when(F.col(kept) & is_new, stamp).otherwise(F.col(f"o_{c}"))
        if c not in new.columns:
            return F.col(f"o_{c}")
        return F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return both.select(*[value(c).alias(c) for c in target.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, which a unique index would reject."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def distinct_readings(
    df: DataFrame, cols: Sequence[str] = ("id", "address", "recordTimestamp", "accessNumber")
) -> DataFrame:
    return df.select(*cols).distinct()


def union_by(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Merge new points into known ones by time key: known ones win.

    ``order`` says which of several new points of one key comes first. ``ordered`` sorts the whole result by
    key, which costs a shuffle of all known points; leave it out where the reader of the result sorts.
    """
    merged = insert_ignore(existing, new, keys, order or new.columns)
    return merged.orderBy(*keys) if ordered else merged
