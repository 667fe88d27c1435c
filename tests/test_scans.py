"""Blocked scans against plain windows, and the spread of one key's rows over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.frames import as_of
from tapeloom.functions.scans import highest, latest, previous, running, total
from tapeloom.operators import intervals, runs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = [(k, float(t), i, rng.choice([None, rng.randrange(50)]), rng.choice("ab")) for k in ("x", "y") for i, t in enumerate(sorted(rng.choices(range(400), k=300)))]
    return spark.createDataFrame(data, "rec string, t double, i int, v int, s string")


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("width", [1.0, 7.5, 90.0, 1e6])
def test_blocks_give_what_windows_give(rows, back, width):
    what = {"a": total(F.col("v")), "b": highest(F.col("v")), "c": highest(F.col("v"), here=False), "d": latest(F.col("v")), "e": latest(F.col("v"), here=False), "f": previous(F.col("v")), "g": previous(F.struct("s"))}
    plain = running(rows, "rec", ["t", "i"], None, back, **what).collect()
    cut = running(rows, "rec", ["t", "i"], width, back, **what).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, cut)) and len(cut) == 600


def test_operators_in_blocks_equal_themselves(rows):
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    states = rows.select("rec", "t", "i", F.col("s").alias("state"))
    assert same(runs.flat_runs(states, order=("i",)), runs.flat_runs(states, order=("i",), width=13.0))
    scores = rows.select("rec", "t", "i", (F.coalesce("v", F.lit(3)) / 50).alias("score"))
    args = (scores, F.lit(0.5), F.lit(0.2), 2.0, 5.0)
    assert same(runs.hysteresis_intervals(*args, order=("i",)), runs.hysteresis_intervals(*args, order=("i",), width=13.0))
    spans = rows.select("rec", F.col("t").alias("start"), (F.col("t") + F.coalesce("v", F.lit(0)) / 20).alias("end"))
    assert same(intervals.merge_intervals(spans), intervals.merge_intervals(spans, width=13.0))
    marks = rows.filter("v > 40").select("rec", F.col("t").alias("at"), F.col("i").alias("m"))
    for forward in (False, True):
        for strict in (False, True):
            assert same(as_of(rows, marks, "rec", take=["m"], forward=forward, strict=strict), as_of(rows, marks, "rec", take=["m"], forward=forward, strict=strict, width=13.0))


def test_one_key_is_scanned_by_many_tasks(spark):
    one = spark.range(40_000).select(F.pmod("id", F.lit(1)).alias("rec"), F.col("id").cast("double").alias("t"), F.pmod("id", F.lit(7)).alias("v"))
    tasks = lambda df: df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max("s")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole, cut = tasks(running(one, "rec", ["t"], s=total(F.col("v")))), tasks(running(one, "rec", ["t"], 100.0, s=total(F.col("v"))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(whole) == 1 and len(cut) == 4 and max(r["count"] for r in cut) < 20_000  # of 4 partitions
