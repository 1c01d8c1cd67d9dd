import types

import pytest

from meterflow.session import shared_dir, written


def fake(master, named=None, current=None):
    made = []
    conf = types.SimpleNamespace(get=lambda key, default=None: named)
    context = types.SimpleNamespace(
        getConf=lambda: conf,
        getCheckpointDir=lambda: made[0] if made else current,
        setCheckpointDir=made.append,
        master=master,
    )
    return types.SimpleNamespace(conf=conf, sparkContext=context)


def test_the_named_folder_is_used():
    assert shared_dir(fake("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(fake("spark://host:7077", current="hdfs:///set")) == "hdfs:///set"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        shared_dir(fake("spark://host:7077"))
    assert "meterflow-" in shared_dir(fake("local[2]"))


def test_written_tables_stay_the_same(spark):
    from pyspark.sql import functions as F

    table = written(spark.range(100).withColumn("r", F.rand()))
    assert table.agg(F.sum("r")).first() == table.agg(F.sum("r")).first()
    assert written(spark.range(0)).columns == ["id"] and written(spark.range(0)).count() == 0
