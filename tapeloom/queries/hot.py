"""Scans of one recording that holds all rows: every event is of recording 0, which is scanned in blocks of time or of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import as_of
from ..operators import clocks, intervals, runs
from .clocks import DAY
from .clocks import ORACLE as CLOCKS
from .common import EV, events, r, spans
from .runs import ORACLE as RUNS
from .runs import _absences, _states

#: Seconds, and ids, of a block.
SECONDS, IDS = 50_000.0, 500


def _one(spark, sf):
    return events(spark, sf).withColumn("rec", F.lit(0).cast("long"))


def hot_unwrap(spark, sf):
    late = F.when(F.col("event_id") % 9 == 0, 100000).otherwise(0)
    rows = _one(spark, sf).withColumn("clock", F.pmod(F.floor("t") - late, F.lit(10 * DAY)))
    return clocks.unwrap_clock(rows, order="event_id", wrap=10 * DAY, width=IDS).select("rec", "event_id", "unwrapped", "back")


def hot_runs(spark, sf):
    found = runs.flat_runs(_one(spark, sf).withColumnRenamed("event_type", "state"), order=("event_id",), min_count=2, min_seconds=1000.0, width=SECONDS)
    return found.select("rec", "state", r("start"), r("end"), r("last"), "pictures")


def hot_monotone(spark, sf):
    """Rows whose value is over all values of smaller ids."""
    return runs.monotone_only(_one(spark, sf), "rec", "value", "event_id", width=IDS).select("rec", "event_id", r("value"))


def hot_hysteresis(spark, sf):
    scores = _one(spark, sf).withColumn("score", F.col("value") / 500)
    return runs.hysteresis_intervals(scores, F.lit(0.12), F.lit(0.03), 200.0, 5000.0, order=("event_id",), width=SECONDS).select("rec", r("start"), r("end"), "edge")


def hot_merge(spark, sf):
    rows = spans(_one(spark, sf).withColumn("value", F.col("value") / 200))
    return intervals.merge_intervals(rows, width=SECONDS).select("rec", r("start"), r("end"))


def hot_as_of(spark, sf):
    """Each click with the last purchase at or before it and the next one after it."""
    ev = _one(spark, sf)
    marks = ev.filter("event_type = 'purchase'").select("rec", F.col("t").alias("at"), F.col("event_id").alias("last"), F.col("event_id").alias("next"))
    rows = as_of(ev.filter("event_type = 'click'").select("rec", "event_id", "t"), marks, "rec", take=["last"], width=SECONDS)
    rows = as_of(rows, marks, "rec", take=["next"], forward=True, width=SECONDS)
    return rows.select("rec", "event_id", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("next", F.lit(-1)).alias("next"))


QUERIES = [hot_unwrap, hot_runs, hot_monotone, hot_hysteresis, hot_merge, hot_as_of]


def _all(sql: str) -> str:
    """The SQL of many recordings with all events in one."""
    assert "user_id AS rec" in sql
    return sql.replace("user_id AS rec", "0::BIGINT AS rec")


_ONE = EV.replace("user_id AS rec", "0::BIGINT AS rec")
ORACLE = {
    "hot_unwrap": _all(CLOCKS["t3_unwrap"]),
    "hot_runs": _all(RUNS["r1_flat_runs"]),
    "hot_monotone": f"""WITH {_ONE} SELECT rec, event_id, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY rec ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev) WHERE reach IS NULL OR value > reach""",
    "hot_hysteresis": f"WITH {_ONE}, sc AS (SELECT rec, event_id, t, value / 500 AS score FROM ev), {_states('sc', 'rec', '0.12', '0.03', 200.0)}, {_absences('rec', 5000.0)} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\", edge FROM ab",
    "hot_merge": f"""WITH {_ONE}, iv AS (SELECT rec, t AS s, t + value AS e FROM ev), p AS (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE e > s),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p)
        SELECT rec, round(min(s), 6) AS start, round(max(e), 6) AS "end" FROM g GROUP BY rec, g""",
    "hot_as_of": f"""WITH {_ONE}, m AS (SELECT rec, t AS at, event_id AS id FROM ev WHERE event_type = 'purchase')
        SELECT c.rec, c.event_id, coalesce(a.id, -1) AS last, coalesce(b.id, -1) AS next FROM ev c ASOF LEFT JOIN m a ON a.rec = c.rec AND c.t >= a.at ASOF LEFT JOIN m b ON b.rec = c.rec AND c.t <= b.at WHERE c.event_type = 'click'""",
}
