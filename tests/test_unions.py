"""Rows of the two sides of a union meet, however adaptive execution merges the sides' partitions."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.intervals import merge_intervals
from tapeloom.plans.cuts import divide_ranges

SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3kb"}


@pytest.fixture
def merging(spark):
    was = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in was.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_ranges_and_places_of_a_recording_meet(merging, tmp_path):
    rows = merging.range(4000).select((F.col("id") % 200).alias("rec"), (F.rand(5) * 90000).alias("t"), F.col("id").alias("n"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = merging.read.schema(rows.schema).parquet(f"{tmp_path}/rows")
    keeps = merge_intervals(rows.filter("n % 9 = 0").select("rec", F.col("t").alias("start"), (F.col("t") + 9000).alias("end")))
    cuts = divide_ranges(keeps, rows.select("rec", "t"), parts=4, frame=10.0)
    found = sorted(map(tuple, cuts.collect()))
    merging.conf.set("spark.sql.adaptive.enabled", "false")
    assert found == sorted(map(tuple, divide_ranges(keeps, rows.select("rec", "t"), parts=4, frame=10.0).collect())) and len(found) > 300
