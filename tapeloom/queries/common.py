"""Bindings of the operators to the given tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds are counted from 2024-01-01 so that doubles keep microseconds exactly enough.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed rows of one recording per user."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", ((us - EPOCH_US) / F.lit(1e6)).alias("t"), "value", "event_type")


EV = f"ev AS (SELECT user_id AS rec, event_id, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t, value, event_type FROM events)"
#: Events as intervals, long enough to overlap.
SPAN = 200.0
IV = EV + f", iv AS (SELECT rec, event_id, t AS s, t + value * {SPAN} AS e, event_type FROM ev)"
#: Merged intervals m(rec, s, e) of a relation.
MERGE = """{name} AS (
    SELECT rec, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT rec, s, e, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE e > s
        )
    ) GROUP BY rec, island)"""


def merged(name: str, source: str) -> str:
    return MERGE.format(name=name, source=source)


def spans(df: DataFrame) -> DataFrame:
    return df.select("rec", "event_id", "event_type", F.col("t").alias("start"), (F.col("t") + F.col("value") * SPAN).alias("end"))


def r(column, digits: int = 6):
    """A column rounded for comparison with SQL (and without negative zeros)."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(column) if isinstance(column, str) else out
