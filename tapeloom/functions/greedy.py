"""Greedy choices along a key's rows, where each kept row shuts out the rows up to a place of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Key, as_of, before, islands, keys, ordered
from .storage import materialise


def keep_apart(df: DataFrame, key: Key, at: str, until: Column, *order: str) -> DataFrame:
    """The rows of df that are kept going up `at`: a key's first, then each next one at or past `until` of the last kept.

    Every row points to the next one that it would let in. A row at or past all earlier `until` is kept
    whatever came before and begins an island; within islands the kept rows are those reached along the
    pointers, whose length doubles each round. No key's rows come together in one row or one task's memory.
    The states' files are small for their rows, so the joins ask for merging: by size of file Spark would broadcast millions of rows.
    """
    k = keys(key)
    rows = df.withColumn("__rn", F.row_number().over(ordered(k, at, *order))).withColumn("__until", F.coalesce(until.cast("double"), F.col(at).cast("double")))
    reach = F.max("__until").over(before(k, "__rn"))
    rows = rows.withColumn("__free", F.coalesce(reach <= F.col(at), F.lit(True)))
    rows = materialise(islands(rows, F.col("__free"), k, "__rn", name="__island"))
    targets = rows.select(*k, F.col(at).cast("double").alias("__at"), F.col("__rn").alias("__next"), F.col("__island").alias("__there"))
    links = as_of(rows.select(*k, "__rn", "__until", "__island", "__free"), targets, k, "__until", "__at", ["__next", "__there"], forward=True)
    later = F.greatest(F.col("__next"), F.col("__rn") + 1)  # a row whose `until` is its own place lets the next one in
    inner = F.when((F.col("__there") == F.col("__island")) | (F.col("__next") <= F.col("__rn")), later)
    state = materialise(links.select(*k, "__rn", inner.alias("__next"), F.col("__free").alias("__kept")))
    while not state.filter("__next IS NOT NULL").isEmpty():
        ahead = state.select(*k, F.col("__rn").alias("__next"), F.col("__next").alias("__far")).hint("merge")
        jumped = state.join(ahead, [*k, "__next"], "left").select(*k, "__rn", F.col("__far").alias("__next"), "__kept")
        let_in = state.filter("__kept AND __next IS NOT NULL").select(*k, F.col("__next").alias("__rn"), F.lit(None).cast("int").alias("__next"), F.lit(True).alias("__kept"))
        state = materialise(jumped.unionByName(let_in).groupBy(*k, "__rn").agg(F.max("__next").alias("__next"), F.max("__kept").alias("__kept")))
    return rows.join(state.filter("__kept").select(*k, "__rn").hint("merge"), [*k, "__rn"], "left_semi").select(*df.columns)
