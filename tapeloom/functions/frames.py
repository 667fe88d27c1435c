"""Windows, as-of and interval joins shared by the recording operators.

Rows of one recording carry the key columns and a time in seconds; all helpers work per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Key = str | Sequence[str]


def keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def shuffled_unions(spark: SparkSession) -> None:
    """Let the session shuffle what follows a union, even where both its sides are partitioned by the key already.

    Spark 4.1 takes such a union as partitioned too, but adaptive execution may merge the small partitions of each side differently, and
    then a key's rows of the two sides are in different tasks. The setting is read when a query is planned, so it stays set.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ordered(key: Key, *order):
    return Window.partitionBy(*keys(key)).orderBy(*order)


def before(key: Key, *order):
    """All earlier rows, without the current one."""
    return ordered(key, *order).rowsBetween(Window.unboundedPreceding, -1)


def so_far(key: Key, *order):
    return ordered(key, *order).rowsBetween(Window.unboundedPreceding, 0)


def from_here(key: Key, *order):
    return ordered(key, *order).rowsBetween(0, Window.unboundedFollowing)


def whole(key: Key):
    return Window.partitionBy(*keys(key))


def islands(df: DataFrame, starts: Column, key: Key, *order, name: str = "island") -> DataFrame:
    """A running count of `starts`, which is true on the first row of each island."""
    flag = F.coalesce(starts, F.lit(True)).cast("int")
    return df.withColumn("__start", flag).withColumn(name, F.sum("__start").over(so_far(key, *order))).drop("__start")


def middle(df: DataFrame, key: Key, value: str, lower: bool = False) -> DataFrame:
    """Per key the upper median (the lower one on request), without gathering a key's values in one row."""
    w = ordered(key, value)
    n = F.count(F.lit(1)).over(whole(key))
    want = F.floor((n - 1) / 2) if lower else F.floor(n / 2)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys(key), value, (F.row_number().over(w) - 1).alias("__i"), want.alias("__w"))
    return ranked.filter("__i = __w").select(*keys(key), F.col(value).alias("median"))


def as_of(left: DataFrame, right: DataFrame, key: Key, t: str = "t", at: str = "at", take: Sequence[str] = (), forward: bool = False, strict: bool = False, width: float | None = None) -> DataFrame:
    """Each left row with the columns `take` of the last right row at or before it (first at or after it if forward).

    Both sides are united and sorted once per key; `strict` leaves out equal times. Of right rows
    at one time the last by `take` is used going back, the first going forward. With a `width` (of time) a key's rows are scanned
    in blocks (see scans.running), so that one key's rows are no task's alone; keys and times are not null then.
    """
    from .scans import latest, running

    shuffled_unions(left.sparkSession)
    k = keys(key)
    right_first = strict == forward  # going back, or strictly forward, right rows of an equal time sort first
    lrow = left.select(*k, F.col(t).alias("__t"), F.lit(int(right_first)).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__right"))
    rrow = right.select(*k, F.col(at).alias("__t"), F.lit(int(not right_first)).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*take).alias("__right"))
    both = lrow.unionByName(rrow)
    return running(both, k, ["__t", "__side", "__right"], width, back=forward, __found=latest(F.col("__right"))).filter("__left IS NOT NULL").select("__left.*", *[F.col("__found")[c].alias(c) for c in take])


def anchored(df: DataFrame, points: DataFrame, key: Key, t: str, seams: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
    """df with ``anchor``, the last of points (t) at or before t, and ``following``.

    With seams (time), a point before the last seam at or before t is no anchor, and ``following``
    is the first point at or after t; times within `slack` count as equal. Without, ``following`` is null.
    """
    k = keys(key)
    rows = as_of(df, points.select(*k, (F.col("t") - slack).alias("at"), F.col("t").cast("double").alias("anchor")), k, t, "at", ["anchor"])
    if seams is None:
        return rows.withColumn("following", F.lit(None).cast("double"))
    rows = as_of(rows, seams.select(*k, (F.col("time") - slack).alias("at"), F.col("time").alias("__seam")), k, t, "at", ["__seam"])
    rows = as_of(rows, points.select(*k, (F.col("t") + slack).alias("at"), F.col("t").cast("double").alias("following")), k, t, "at", ["following"], forward=True)
    since = F.col("__seam").isNull() | (F.col("anchor") >= F.col("__seam") - slack)
    return rows.withColumn("anchor", F.when(since, F.col("anchor"))).drop("__seam")


def buckets(start: Column, end: Column, width: float) -> Column:
    """The numbers of all buckets of `width` seconds that [start, end] touches."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def overlap_join(left: DataFrame, right: DataFrame, key: Key, width: float, ls: str = "start", le: str = "end", rs: str = "b_start", re_: str = "b_end", closed: bool = False) -> DataFrame:
    """Left rows with right rows whose half-open intervals overlap, by an equi-join on time buckets.

    A pair meets in every bucket that both touch and is kept in the first of these alone. `closed`
    counts shared end points.
    """
    k = keys(key)
    rcols = [c for c in right.columns if c not in k]
    lb = left.withColumn("__first", F.floor(F.col(ls) / width)).withColumn("__b", F.explode(buckets(F.col(ls), F.col(le), width)))
    rb = right.select(*k, *rcols, F.floor(F.col(rs) / width).alias("__rfirst"), F.explode(buckets(F.col(rs), F.col(re_), width)).alias("__b"))
    meet = (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le)) if closed else (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    return lb.join(rb, [*k, "__b"]).filter(meet & (F.col("__b") == F.greatest("__first", "__rfirst"))).drop("__b", "__first", "__rfirst")


def overlaps_any(left: DataFrame, right: DataFrame, key: Key, ls: str = "start", le: str = "end", rs: str = "b_start", re_: str = "b_end", name: str = "met") -> DataFrame:
    """Left rows with whether a right row's half-open interval overlaps theirs, in one window.

    Among the right rows that begin before a left row ends, the furthest end tells: one overlaps exactly
    if that lies past the left row's start.
    """
    shuffled_unions(left.sparkSession)
    k = keys(key)
    lrow = left.select(*k, F.col(le).cast("double").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("double").alias("__end"), F.struct(*left.columns).alias("__left"))
    rrow = right.select(*k, F.col(rs).cast("double").alias("__t"), F.lit(1).alias("__side"), F.col(re_).cast("double").alias("__end"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"))
    reach = F.max("__end").over(so_far(k, "__t", "__side"))
    both = lrow.unionByName(rrow).withColumn("__reach", reach).filter("__left IS NOT NULL")
    return both.select("__left.*", F.coalesce(F.col("__reach") > F.col(f"__left.{ls}"), F.lit(False)).alias(name))
