from pyspark.sql import functions as F

from meterflow.operators.keyed import (
    distinct_readings,
    duplicate_keys,
    insert_ignore,
    insert_replace,
    rows_to_insert,
    union_by,
    upsert_dim,
)
from meterflow.operators.ordered import latest
from meterflow.operators.series import (
    freshness,
    high_water,
    label_series,
    last_seen,
    merge_series,
    newer_than,
    resolve_series,
)
from meterflow.session import small_side


def table(spark, *data):
    return spark.createDataFrame(list(data), "k int, n int, v string")


def test_first_wins(spark, rows):
    target = table(spark, (1, 0, "old"), (None, 0, "null"))
    new = table(spark, (1, 1, "x"), (2, 3, "late"), (2, 2, "early"), (None, 5, "y"))
    want = [(1, 0, "old"), (2, 2, "early"), (None, 0, "null")]
    assert rows(insert_ignore(target, new, ["k"], ["n"])) == want
    # Loading the same rows again changes nothing.
    assert rows(insert_ignore(insert_ignore(target, new, ["k"], ["n"]), new, ["k"], ["n"])) == want
    assert rows(rows_to_insert(target, new, ["k"], ["n"])) == [(2, 2, "early")]


def test_last_wins(spark, rows):
    target = table(spark, (1, 0, "old"), (3, 0, "kept"))
    new = table(spark, (1, 1, "x"), (1, 2, "y"), (2, 2, "z"))
    want = [(1, 2, "y"), (2, 2, "z"), (3, 0, "kept")]
    assert rows(insert_replace(target, new, ["k"], ["n"])) == want
    assert rows(insert_replace(insert_replace(target, new, ["k"], ["n"]), new, ["k"], ["n"])) == want


def test_merge_points(spark):
    merged = union_by(table(spark, (5, 0, "a"), (1, 0, "b")), table(spark, (5, 9, "x"), (3, 1, "c")), ["k"])
    assert [tuple(r) for r in merged.collect()] == [(1, 0, "b"), (3, 1, "c"), (5, 0, "a")]


def test_dimension(spark, rows):
    schema = "address int, id string, status string, rowCreatedTimestamp timestamp_ntz, rowUpdatedTimestamp timestamp_ntz"
    stored = spark.createDataFrame([(1, "a", "old", None, None), (2, "b", "same", None, None)], schema).withColumn(
        "rowCreatedTimestamp", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    new = spark.createDataFrame([(1, "a", None), (3, "c", "new")], "address int, id string, status string")
    assert rows(upsert_dim(stored, new, ["address", "id"], now="2024-02-01 00:00:00")) == [
        (1, "a", None, "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
        (2, "b", "same", "2024-01-01 00:00:00", None),
        (3, "c", "new", "2024-02-01 00:00:00", None),
    ]


def test_duplicates(spark, rows):
    df = table(spark, (1, 0, "a"), (1, 0, "b"), (2, 0, "a"), (None, 0, "a"), (None, 0, "a"))
    assert rows(duplicate_keys(df, ["k", "n"])) == [(1, 0, 2), (None, 0, 2)]
    assert len(rows(distinct_readings(df, ["k", "v"]))) == 4


def test_latest(spark, rows):
    df = table(spark, *[(k, n, str(n)) for k in (1, 2) for n in range(5)], (3, 0, "only"))
    assert rows(latest(df, ["k"], ["n"], 2), "k", "n") == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 0)]
    assert rows(latest(df, [], ["n", "k"]), "k", "n") == [(2, 4)]


def test_marks(spark, rows):
    df = table(spark, (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d"), (None, 1, "e"))
    marks = last_seen(df.where("n < 3 AND k = 1"), ["k"], "n")
    assert rows(newer_than(df, marks, "k", "n"), "v") == [("c",), ("d",), ("e",)]
    empty = df.where("n > 99")
    assert rows(high_water(empty, "n", 0)) == [(0,)] and rows(high_water(df, "n")) == [(3,)]
    assert rows(freshness(df, "k", "v", "n"))[:2] == [(1, 1), (2, 1)]
    assert rows(freshness(df, "k", "v", "n", ["b", "c", "none"])) == [(1, 2)]


def test_outer_merge(spark, rows):
    a = spark.createDataFrame([(1, 10), (2, None)], "ts int, a int")
    b = spark.createDataFrame([(2, 20), (3, 30)], "ts int, b int")
    c = spark.createDataFrame([(3, "x"), (4, None)], "ts int, c string")
    want = a.join(b, "ts", "full_outer").join(c, "ts", "full_outer")
    assert rows(merge_series([a, b, c])) == rows(want)


def test_routing(spark, rows):
    routing = spark.createDataFrame(
        [("out", "Temperature", "warm"), ("out", "Humidity", "rest"), ("in", "CO2", "air")],
        "device string, datatype string, dataset string",
    )
    wanted = spark.createDataFrame(
        [(1, "out", "Temperature"), (2, "out", "Temperature"), (2, "out", "Noise"), (3, "in", "CO2"), (3, "out", "Humidity")],
        "request int, device string, datatype string",
    )
    got = rows(resolve_series(wanted, routing), "request", "datatype", "dataset")
    assert got == [(1, "Temperature", "warm"), (3, "CO2", "air"), (3, "Humidity", "rest")]
    # A dataset that is not loaded empties the whole request.
    assert rows(resolve_series(wanted, routing, available=["warm", "air"]), "request") == [(1,)]


def test_names(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    names = spark.createDataFrame([("a", "Alpha")], "c string, n string")
    want = [("a", "Alpha"), ("b", "b"), (None, None)]
    assert rows(label_series(df, names, "code")) == want
    assert rows(label_series(df, {"a": "Alpha"}, "code")) == want


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(100)
    plan = lambda side: df.join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small_side(df))
    assert "strategy=broadcast" not in plan(small_side(df, max_rows=99))
    assert "strategy=broadcast" not in plan(small_side(df, max_bytes=10))


def test_keys_of_the_delivery_prune_the_target(spark, rows, tmp_path):
    """The scan of the target gets the range of the keys; nulls, times and texts as keys keep every match."""
    from meterflow.operators.keyed import rows_to_insert

    target = spark.sql(
        "SELECT id, IF(id % 10 = 0, NULL, id) AS n, CONCAT('k', id) AS name, TIMESTAMP'2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE AS at FROM range(1000)"
    )
    target.write.parquet(f"{tmp_path}/t")
    target = spark.read.parquet(f"{tmp_path}/t")
    new = target.where("id BETWEEN 95 AND 105").unionByName(spark.sql("SELECT 5000L, 5000L, 'k5000', TIMESTAMP'2024-01-01 01:40:30'").toDF(*target.columns))
    for keys in (["id"], ["n"], ["name", "id"], ["at"], ["n", "at"]):
        found = rows_to_insert(target, new, keys, ["id"])
        want = [r for r in rows(new) if r[0] == 5000]
        assert rows(found) == want, keys
    plan = rows_to_insert(target, new, ["at", "id"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 95)" in plan and "<= 5000)" in plan and ">= 2024-01-01 01:35:00)" in plan
    assert rows_to_insert(target, new.limit(0), ["id"], ["id"]).count() == 0
