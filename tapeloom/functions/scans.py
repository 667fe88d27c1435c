"""Running values along a key's rows, for keys of any size: a scan within blocks, and what earlier blocks carry into each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import Key, keys


@dataclass(frozen=True)
class Running:
    """A running value: the sum, max, or last non-null of a column over all earlier rows, with or without the row itself; or ``prev``, its value on the row before."""

    op: str
    value: Column
    here: bool = True


def total(value: Column) -> Running:
    return Running("sum", value)


def highest(value: Column, here: bool = True) -> Running:
    return Running("max", value, here)


def latest(value: Column, here: bool = True) -> Running:
    return Running("last", value, here)


def previous(value: Column) -> Running:
    return Running("prev", value, False)


def running(df: DataFrame, key: Key, order: Sequence[str], width: float | None = None, back: bool = False, **values: Running) -> DataFrame:
    """df with a column for each running value along `order` (down it if `back`).

    Without a width, one window a key: one task holds a key's rows in turn. With it, a key's rows are cut into blocks of so many units of the
    first order column. Each block is a window group of its own, so that one key's rows are scanned by many tasks; a block's
    totals, a row each, are scanned in a second window, and what comes before a block is joined to its rows, which
    are where the first window has put them. Keys and the first order column are not null then.
    """
    k, down = keys(key), [F.desc(c) if back else F.asc(c) for c in order]
    names = {n: f"__v_{n}" for n in values}
    rows = df.withColumns({names[n]: r.value for n, r in values.items()})
    blocked = width is not None
    if blocked:
        rows = rows.withColumn("__block", F.floor(F.col(order[0]) / width))
    w = Window.partitionBy(*k, *(["__block"] if blocked else [])).orderBy(*down)
    simple = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}

    def own(n: str, r: Running) -> Column:
        c = F.col(names[n])
        if r.op == "prev":
            return F.lag(F.struct(c.alias("x"))).over(w) if blocked else F.lag(c).over(w)
        return simple[r.op](c).over(w.rowsBetween(Window.unboundedPreceding, 0 if r.here else -1))

    scanned = rows.withColumns({n: own(n, r) for n, r in values.items()})
    if not blocked:
        return scanned.drop(*names.values())

    end = F.min_by if back else F.max_by
    at = F.struct(*order)

    def whole(n: str, r: Running) -> Column:
        c = F.col(names[n])
        if r.op == "prev":
            return end(F.struct(c.alias("x")), at)
        return end(c, F.when(c.isNotNull(), at)) if r.op == "last" else simple[r.op](c)

    before = Window.partitionBy(*k).orderBy(F.desc("__block") if back else F.asc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*k, "__block").agg(*[whole(n, r).alias(n) for n, r in values.items()])
    carry = totals.select(*k, "__block", *[simple.get(r.op, simple["last"])(F.col(n)).over(before).alias(f"__c_{n}") for n, r in values.items()])

    def both(n: str, r: Running) -> Column:
        mine, past = F.col(n), F.col(f"__c_{n}")
        if r.op == "sum":
            return F.when(mine.isNull(), past).otherwise(mine + F.coalesce(past, F.lit(0)))
        if r.op == "max":
            return F.greatest(mine, past)
        return F.coalesce(mine, past)["x"] if r.op == "prev" else F.coalesce(mine, past)

    return scanned.join(carry, [*k, "__block"], "left").select(*df.columns, *[both(n, r).alias(n) for n, r in values.items()])


def islands_in(df: DataFrame, starts: Column, key: Key, order: Sequence[str], width: float | None = None, name: str = "island") -> DataFrame:
    """A running count of `starts`, true on the first row of each island, as frames.islands gives it for keys of any size."""
    return running(df, key, order, width, **{name: total(F.coalesce(starts, F.lit(True)).cast("long"))})
