"""Queries on the given tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Event types take the places of circuits or devices.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

#: The counter table of the SQL side, as ``counters`` below.
COUNTERS_SQL = (
    "m AS (SELECT event_type AS series, user_id, ts, event_id AS cumul, "
    "CAST(round(value * 100) AS BIGINT) AS curr FROM events)"
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as meter readings: the event number is the ever growing counter, the value the current reading."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"),
        "user_id",
        "ts",
        F.col("event_id").alias("cumul"),
        F.round(F.col("value") * 100).cast("bigint").alias("curr"),
    )


def ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)
