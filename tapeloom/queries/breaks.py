"""Break queries: low-valued events are silences, and the 15 s grid is scaled to a unit of hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import whole
from ..operators import breaks as b
from ..operators import intervals as iv
from .common import EV, events, r
from .runs import _absences as absences_sql
from .runs import _states as states_sql

UNIT = 20000.0
D = UNIT / 30


def _silences(spark, sf):
    """Events below 350 as silences whose length follows the value; one an instant."""
    ev = events(spark, sf).filter("value < 350")
    return ev.groupBy("rec", F.col("t").alias("time")).agg(F.max(F.col("value") * 8).alias("dur"))


def _candidates(spark, sf):
    return b.break_candidates(_silences(spark, sf), unit=UNIT)


def _blocks(spark, sf):
    return b.break_blocks(_candidates(spark, sf), unit=UNIT, min_score=0.6, min_fill=0.3, fewest=2)


def _bounds(spark, sf):
    return events(spark, sf).groupBy("rec").agg(F.max("t").alias("duration"))


def _changes(spark, sf):
    return events(spark, sf).select("rec", "t", (F.col("value") / 500).alias("diff"))


def d1_on_grid(spark, sf):
    ahead = b.next_on_grid(_silences(spark, sf), unit=UNIT)
    return ahead.select("rec", r("a"), r("b"))


def d2_candidates(spark, sf):
    return b.rank_candidates(_candidates(spark, sf)).select("rec", r("time"), "run", r("score"), "rank")


def d3_break_blocks(spark, sf):
    return _blocks(spark, sf).select("rec", r("start"), r("end"), "junctions", r("score"))


def _resets(spark, sf):
    return events(spark, sf).filter("event_type IN ('error', 'click')").select("rec", "t")


def d4_reset_blocks(spark, sf):
    # a fifth of the recordings states no length
    bounds = _bounds(spark, sf).withColumn("duration", F.when(F.col("rec") % 5 == 0, 0.0).otherwise(F.col("duration")))
    return b.blocks_from_resets(_resets(spark, sf), bounds, unit=UNIT, slack=2 * D).select("rec", r("start"), r("end"), "junctions", "score")


def d5_every_junction(spark, sf):
    return b.marks_every_junction(_resets(spark, sf), unit=UNIT, slack=3 * D, fewest=2)


def _absences(spark, sf):
    s = events(spark, sf).filter("event_type = 'purchase'")
    # every tenth runs from the recording's head
    start = F.when(F.col("event_id") % 10 == 0, 1.0).otherwise(F.col("t"))
    return s.select("rec", start.alias("start"), (F.col("t") + F.col("value") * 400).alias("end"))


def d6_absence_blocks(spark, sf):
    return b.blocks_from_absence(_candidates(spark, sf), _absences(spark, sf), _changes(spark, sf), _bounds(spark, sf), unit=UNIT, snap=6000.0, change=0.3, near=9000.0).select("rec", r("start"), r("end"), "score", "edge")


def _brief(spark, sf):
    return events(spark, sf).filter("event_type = 'signup'").select("rec", F.col("t").alias("start"), (F.col("t") + 20000).alias("end"))


def _quiet(spark, sf):
    return _silences(spark, sf).select("rec", (F.col("time") - F.col("dur") / 2).alias("start"), (F.col("time") + F.col("dur") / 2).alias("end"))


def d7_insert_blocks(spark, sf):
    return b.insert_blocks(_brief(spark, sf), _quiet(spark, sf), _blocks(spark, sf), least=500.0).select("rec", r("start"), r("end"), r("score"))


def d8_refine(spark, sf):
    return b.refine_boundaries(_blocks(spark, sf), _changes(spark, sf).filter("diff > 0.8"), _bounds(spark, sf), window=4000.0, floor=0.85).select("rec", r("start"), r("end"), "junctions")


def d9_detect(spark, sf):
    """All three methods, told by the data: resets of any recording, and corner scores of those with a dear signup."""
    ev = events(spark, sf)
    cornered = ev.filter("event_type = 'signup' AND value > 300").select("rec").distinct()
    scores = ev.join(cornered, "rec", "left_semi").select("rec", "t", (F.col("value") / 500).alias("score"))
    found = b.detect_breaks(
        _resets(spark, sf), _silences(spark, sf), scores, _changes(spark, sf), _bounds(spark, sf), unit=UNIT,
        resets=dict(slack=3 * D, fewest=3), absences=dict(snap=6000.0, change=0.3, near=9000.0), silent=dict(min_score=0.6, min_fill=0.3, fewest=2),
        refine=dict(window=4000.0, floor=0.85), split=dict(long=60000.0, edge_long=10000.0, brief=50000.0),
        present=F.lit(0.4), absent=F.lit(0.15), min_present=20000.0, window=30000.0,
    )
    return found.select("rec", r("start"), r("end"), r("score"), "method")


def _truth(spark, sf):
    ev = events(spark, sf).filter("event_type = 'purchase'")
    return ev.select("rec", F.col("t").alias("start"), (F.col("t") + 30000).alias("end"), (F.col("event_id") % 4 == 0).alias("grey"))


def d10_score(spark, sf):
    """Every other recording's first block begins, and every third one's last block ends, less than an edge from the recording's own end."""
    mine = iv.merge_intervals(_blocks(spark, sf)).select("rec", "start", "end").join(_bounds(spark, sf), "rec")
    start = F.when((F.col("rec") % 2 == 0) & (F.col("start") == F.min("start").over(whole("rec"))), 1000.0).otherwise(F.col("start"))
    end = F.when((F.col("rec") % 3 == 0) & (F.col("end") == F.max("end").over(whole("rec"))), F.greatest(F.col("duration") - 1500.0, F.col("start"))).otherwise(F.col("end"))
    mine = mine.select("rec", start.alias("start"), end.alias("end"))
    return b.score_breaks(mine, _truth(spark, sf), _bounds(spark, sf), unit=UNIT, edge=2000.0).select("rec", r("over"), r("under"), "false_blocks", "missed", "odd")


def d11_coverage(spark, sf):
    return b.mark_coverage(events(spark, sf).filter("event_type = 'view'"), _blocks(spark, sf), unit=UNIT, tol=3000.0).select("rec", r("share"), "spots")


QUERIES = [d1_on_grid, d2_candidates, d3_break_blocks, d4_reset_blocks, d5_every_junction, d6_absence_blocks, d7_insert_blocks, d8_refine, d9_detect, d10_score, d11_coverage]

_GAP = "(({g}) >= 0 AND round(({g}) / 20000.0) BETWEEN 1 AND {most} AND abs(({g}) - round(({g}) / 20000.0) * 20000.0) <= {slack})"
_SLACK = "least((a.dur + b.dur) / 2, 800.0) + 200.0"
_SIL = EV + f""", sil AS (SELECT rec, t AS time, max(value * 8) AS dur FROM ev WHERE value < 350 GROUP BY rec, t),
    nx AS (SELECT a.rec, a.time AS a, min(b.time) AS b FROM sil a JOIN sil b ON a.rec = b.rec AND b.time > a.time AND {_GAP.format(g='b.time - a.time', most=8, slack=_SLACK)} GROUP BY a.rec, a.time),
    pv AS (SELECT b.rec, b.time AS a, max(a.time) AS b FROM sil a JOIN sil b ON a.rec = b.rec AND b.time > a.time AND {_GAP.format(g='b.time - a.time', most=8, slack=_SLACK)} GROUP BY b.rec, b.time)"""
_CAND = _SIL + """, fw AS (SELECT rec, a, b, 1 AS n FROM nx UNION ALL SELECT fw.rec, fw.a, nx.b, n + 1 FROM fw JOIN nx ON nx.rec = fw.rec AND nx.a = fw.b),
    bw AS (SELECT rec, a, b, 1 AS n FROM pv UNION ALL SELECT bw.rec, bw.a, pv.b, n + 1 FROM bw JOIN pv ON pv.rec = bw.rec AND pv.a = bw.b),
    cd AS (SELECT *, 0.5 * least(dur, 1.0) + 0.5 * least((run - 1) / 4, 1.0) AS score FROM (
        SELECT sil.*, (coalesce(f.n, 0) + coalesce(g.n, 0) + 1)::BIGINT AS run FROM sil LEFT JOIN (SELECT rec, a, max(n) AS n FROM fw GROUP BY rec, a) f ON f.rec = sil.rec AND f.a = sil.time
        LEFT JOIN (SELECT rec, a, max(n) AS n FROM bw GROUP BY rec, a) g ON g.rec = sil.rec AND g.a = sil.time))"""
_BLK = _CAND + f""", s1 AS (SELECT *, lag(dur) OVER w AS pd, time - lag(time) OVER w AS gap FROM cd WHERE score >= 0.6 WINDOW w AS (PARTITION BY rec ORDER BY time)),
    s2 AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND {_GAP.format(g='gap', most=8, slack='least((dur + pd) / 2, 800.0) + 200.0')} THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY time ROWS UNBOUNDED PRECEDING) AS g FROM s1),
    blk AS (SELECT * FROM (SELECT rec, min(time) AS s, max(time) AS e, count(*) AS junctions, avg(score) AS score FROM s2 GROUP BY rec, g) WHERE junctions >= 2 AND junctions / (greatest(round((e - s) / 20000.0), 1) + 1) >= 0.3)"""
_RS = EV + ", m AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS gap FROM ev WHERE event_type IN ('error', 'click'))"
_BD = "bd AS (SELECT rec, max(t) AS d FROM ev GROUP BY rec)"


def _nearest(t: str, marks: str, reach: float, good: str = "true") -> str:
    return f"(SELECT arg_min(q.t, ((NOT {good})::INT, abs(q.t - {t}), q.t)) FROM {marks} q WHERE q.rec = x.rec AND abs(q.t - {t}) <= {reach})"


#: Absences x(rec, a, b, d) drawn to junctions jn: the start; own junctions up to past the end; the end among them and 8 units on.
_ABSENT = f"""y0 AS (SELECT x.*, coalesce({_nearest('x.a', 'jn', 12000.0, 'q.shown')}, a) AS s FROM x),
        my AS (SELECT y0.rec, a, b, d, s, q.t FROM y0 JOIN jn q ON q.rec = y0.rec AND q.t BETWEEN s - 0.1 AND b + 6000.0),
        gr AS (SELECT rec, a, b, d, t, 0 AS k FROM my UNION ALL SELECT rec, a, b, d, max(t) + n * 20000.0, 1 FROM my, range(1, 9) r(n) GROUP BY rec, a, b, d, n),
        en AS (SELECT rec, a, b, arg_min(t, (abs(t - b), k, t)) AS e FROM gr WHERE abs(t - b) <= 6000.0 AND (d <= 0 OR t <= d) GROUP BY rec, a, b),
        y1 AS (SELECT y0.*, coalesce(en.e, y0.b) AS e FROM y0 LEFT JOIN en USING (rec, a, b)),
        y2 AS (SELECT y1.*, (SELECT count(*) FROM my WHERE my.rec = y1.rec AND my.a = y1.a AND my.b = y1.b AND my.t <= y1.e + 0.1) AS n FROM y1),
        y3 AS (SELECT rec, d, CASE WHEN a <= 1.5 THEN 0 ELSE s END AS s, CASE WHEN d > 0 AND b >= d - 1.5 THEN d ELSE e END AS e, CASE WHEN n >= 2 THEN 1.0 ELSE 0.7 END::DOUBLE AS score FROM y2),
        z9 AS (SELECT * FROM (SELECT rec, s, greatest(e, s) AS e, score, s <= 1.5 OR greatest(e, s) >= d - 1.5 AS edge FROM y3) WHERE e - s >= CASE WHEN edge THEN 1 ELSE 5 END)"""

ORACLE = {
    "d1_on_grid": f"WITH {_SIL} SELECT rec, round(a, 6) AS a, round(b, 6) AS b FROM nx",
    "d2_candidates": f"WITH RECURSIVE {_CAND} SELECT rec, round(time, 6) AS time, run, round(score, 6) AS score, row_number() OVER (PARTITION BY rec ORDER BY score DESC, time)::INTEGER AS rank FROM cd",
    "d3_break_blocks": f"WITH RECURSIVE {_BLK} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\", junctions, round(score, 6) AS score FROM blk",
    "d4_reset_blocks": f"""WITH {_RS}, bd AS (SELECT rec, CASE WHEN rec % 5 = 0 THEN 0 ELSE max(t) END AS d FROM ev GROUP BY rec), g AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND {_GAP.format(g='gap', most=12, slack=2 * D)} THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM m),
        c AS (SELECT rec, min(t) AS a, max(t) AS b, count(*) AS n FROM g GROUP BY rec, g),
        k AS (SELECT rec, CASE WHEN n = 1 AND a <= 20000 THEN 0 ELSE a END AS s, CASE WHEN n = 1 AND a <= 20000 THEN a WHEN n = 1 AND d - a BETWEEN 0 AND 20000 THEN d ELSE b END AS e, n, CASE WHEN n >= 2 THEN 1.0 ELSE 0.9 END AS score
            FROM c JOIN bd USING (rec) WHERE n >= 2 OR a <= 20000 OR d - a BETWEEN 0 AND 20000),
        z AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k)
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end", n AS junctions, score::DOUBLE AS score FROM z WHERE reach IS NULL OR e > reach""",
    "d5_every_junction": f"WITH {_RS} SELECT rec, count(*) FILTER (abs(gap - 20000.0) <= {3 * D}) >= 2 AS every_junction FROM m GROUP BY rec",
    "d6_absence_blocks": f"""WITH RECURSIVE {_CAND}, {_BD}, big AS (SELECT rec, t FROM ev WHERE value / 500 >= 0.3),
        jn AS (SELECT rec, time AS t, EXISTS (SELECT 1 FROM big WHERE big.rec = cd.rec AND abs(big.t - cd.time) <= 9000) AS shown FROM cd WHERE score >= 0.6),
        x AS (SELECT ev.rec, CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE t END AS a, t + value * 400 AS b, d FROM ev JOIN bd USING (rec) WHERE event_type = 'purchase'), {_ABSENT}
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end", score, edge FROM z9""",
    "d7_insert_blocks": f"""WITH RECURSIVE {_BLK}, br AS (SELECT rec, t AS s, t + 20000 AS e FROM ev WHERE event_type = 'signup'), q AS (SELECT rec, time - dur / 2 AS s, time + dur / 2 AS e FROM sil)
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end", round(score, 6) AS score FROM blk UNION ALL
        SELECT rec, round(s, 6), round(e, 6), 0.8 FROM br WHERE EXISTS (SELECT 1 FROM q WHERE q.rec = br.rec AND q.e - q.s >= 500 AND q.s < br.e AND br.s < q.e) AND NOT EXISTS (SELECT 1 FROM blk k WHERE k.rec = br.rec AND k.s < br.e AND br.s < k.e)""",
    "d8_refine": f"""WITH RECURSIVE {_BLK}, {_BD}, big AS (SELECT rec, t FROM ev WHERE value / 500 >= 0.85),
        y AS (SELECT x.*, d, {_nearest('x.s', 'big', 4000.0)} AS ns, {_nearest('x.e', 'big', 4000.0)} AS ne FROM blk x JOIN bd ON bd.rec = x.rec),
        z AS (SELECT rec, CASE WHEN s = 0 THEN 0 ELSE coalesce(ns, s) END AS s, CASE WHEN e >= d THEN e ELSE coalesce(ne, e) END AS e, junctions FROM y)
        SELECT rec, round(s, 6) AS start, round(greatest(e, s), 6) AS "end", junctions FROM z""",
    "d11_coverage": f"""WITH RECURSIVE {_BLK}, sp AS (SELECT DISTINCT rec, t FROM (SELECT rec, s + n * 20000.0 AS t FROM (SELECT *, unnest(range(0, floor((e - s) / 20000.0)::BIGINT + 1)) AS n FROM blk) UNION ALL SELECT rec, e FROM blk)),
        v AS (SELECT rec, t FROM ev WHERE event_type = 'view')
        SELECT rec, round(avg(CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.rec = sp.rec AND abs(v.t - sp.t) <= 3000) THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS spots FROM sp GROUP BY rec""",
}


def _minus(name: str, a: str, c: str) -> str:
    """The seconds per recording of a outside of c, from the depths of both between their bounds."""
    return f"""{name}_st AS (SELECT rec, x0, sum(k) AS k, sum(h) AS h FROM (SELECT rec, s AS x0, 1 AS k, 0 AS h FROM {a} UNION ALL SELECT rec, e, -1, 0 FROM {a} UNION ALL SELECT rec, s, 0, 1 FROM {c} UNION ALL SELECT rec, e, 0, -1 FROM {c}) GROUP BY rec, x0),
        {name} AS (SELECT rec, sum(n - x0) AS kept FROM (SELECT rec, x0, lead(x0) OVER w AS n, sum(k) OVER w AS k, sum(h) OVER w AS h FROM {name}_st WINDOW w AS (PARTITION BY rec ORDER BY x0)) WHERE k > 0 AND h = 0 AND n IS NOT NULL GROUP BY rec)"""


_MINE = """m0 AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT rec, s, e, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM blk WHERE e > s)) GROUP BY rec, g),
    mi AS (SELECT rec, CASE WHEN rec % 2 = 0 AND s = min(s) OVER (PARTITION BY rec) THEN 1000.0 ELSE s END AS s, CASE WHEN rec % 3 = 0 AND e = max(e) OVER (PARTITION BY rec) THEN greatest(d - 1500.0, s) ELSE e END AS e FROM m0 JOIN bd USING (rec))"""
ORACLE["d10_score"] = f"""WITH RECURSIVE {_BLK}, {_BD}, {_MINE}, tr AS (SELECT rec, t AS s, t + 30000 AS e, event_id % 4 = 0 AS grey FROM ev WHERE event_type = 'purchase'),
        rl AS (SELECT * FROM tr WHERE NOT grey), gr AS (SELECT * FROM tr WHERE grey), rg AS (SELECT rec, s, e FROM tr), mg AS (SELECT rec, s, e FROM mi UNION ALL SELECT rec, s, e FROM gr), {_minus('ov', 'mi', 'rg')}, {_minus('un', 'rl', 'mg')},
        fb AS (SELECT rec, count(*) AS n FROM mi WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.rec = mi.rec AND tr.s < mi.e AND mi.s < tr.e) GROUP BY rec),
        ms AS (SELECT rec, count(*) AS n FROM rl WHERE NOT EXISTS (SELECT 1 FROM mi WHERE mi.rec = rl.rec AND rl.s < mi.e AND mi.s < rl.e) GROUP BY rec),
        od AS (SELECT mi.rec, count(*) AS n FROM mi JOIN bd USING (rec) WHERE s > 2000 AND e < d - 2000 AND e - s >= 40000 AND abs(e - s - round_even((e - s) / 20000.0, 0) * 20000.0) > 0.25 GROUP BY mi.rec)
        SELECT bd.rec, round(coalesce(ov.kept, 0), 6) AS over, round(coalesce(un.kept, 0), 6) AS under, coalesce(fb.n, 0) AS false_blocks, coalesce(ms.n, 0) AS missed, coalesce(od.n, 0) AS odd
        FROM bd LEFT JOIN ov USING (rec) LEFT JOIN un USING (rec) LEFT JOIN fb USING (rec) LEFT JOIN ms USING (rec) LEFT JOIN od USING (rec)"""

ORACLE["d9_detect"] = f"""WITH RECURSIVE {_CAND}, {_BD}, m AS (SELECT rec, t, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS gap FROM ev WHERE event_type IN ('error', 'click')),
        ej AS (SELECT rec FROM m GROUP BY rec HAVING count(*) FILTER (abs(gap - 20000.0) <= {3 * D}) >= 3),
        g4 AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND {_GAP.format(g='gap', most=12, slack=3 * D)} THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM m WHERE rec IN (SELECT rec FROM ej)),
        c4 AS (SELECT rec, min(t) AS a, max(t) AS b, count(*) AS n FROM g4 GROUP BY rec, g),
        k4 AS (SELECT rec, CASE WHEN n = 1 AND a <= 20000 THEN 0 ELSE a END AS s, CASE WHEN n = 1 AND a <= 20000 THEN a WHEN n = 1 AND d - a BETWEEN 0 AND 20000 THEN d ELSE b END AS e, CASE WHEN n >= 2 THEN 1.0 ELSE 0.9 END::DOUBLE AS score
            FROM c4 JOIN bd USING (rec) WHERE n >= 2 OR a <= 20000 OR d - a BETWEEN 0 AND 20000),
        one AS (SELECT rec, s, e, score, 'resets' AS method FROM (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k4) WHERE reach IS NULL OR e > reach),
        sc AS (SELECT rec, event_id, t, value / 500 AS score FROM ev WHERE rec NOT IN (SELECT rec FROM ej) AND rec IN (SELECT rec FROM ev WHERE event_type = 'signup' AND value > 300)),
        {states_sql('sc', 'rec', '0.4', '0.15', 20000.0)}, {absences_sql('rec', 30000.0)},
        big3 AS (SELECT rec, t FROM ev WHERE value / 500 >= 0.3), jn AS (SELECT rec, time AS t, EXISTS (SELECT 1 FROM big3 WHERE big3.rec = cd.rec AND abs(big3.t - cd.time) <= 9000) AS shown FROM cd WHERE score >= 0.6),
        x AS (SELECT ab.rec, ab.s AS a, ab.e AS b, d FROM ab JOIN bd USING (rec) WHERE ab.e - ab.s >= CASE WHEN edge THEN 10000 ELSE 60000 END), {_ABSENT},
        two AS (SELECT rec, s, e, score, 'mark' AS method FROM z9),
        s1 AS (SELECT *, lag(dur) OVER w AS pd, time - lag(time) OVER w AS gap FROM cd WHERE score >= 0.6 AND rec NOT IN (SELECT rec FROM ej) AND rec NOT IN (SELECT rec FROM sc) WINDOW w AS (PARTITION BY rec ORDER BY time)),
        s2 AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND {_GAP.format(g='gap', most=8, slack='least((dur + pd) / 2, 800.0) + 200.0')} THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY time ROWS UNBOUNDED PRECEDING) AS g FROM s1),
        three AS (SELECT rec, s, e, score, 'silence' AS method FROM (SELECT rec, min(time) AS s, max(time) AS e, count(*) AS junctions, avg(score) AS score FROM s2 GROUP BY rec, g) WHERE junctions >= 2 AND junctions / (greatest(round((e - s) / 20000.0), 1) + 1) >= 0.3),
        every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three), big AS (SELECT rec, t FROM ev WHERE value / 500 >= 0.85),
        yy AS (SELECT x.*, d, {_nearest('x.s', 'big', 4000.0)} AS ns, {_nearest('x.e', 'big', 4000.0)} AS ne FROM every x JOIN bd ON bd.rec = x.rec),
        zz AS (SELECT rec, CASE WHEN s = 0 THEN 0 ELSE coalesce(ns, s) END AS s, CASE WHEN e >= d THEN e ELSE coalesce(ne, e) END AS e, score, method FROM yy)
        SELECT rec, round(s, 6) AS start, round(greatest(e, s), 6) AS "end", round(score, 6) AS score, method FROM zz"""
