"""Interval queries: every event opens an interval in proportion to its value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import as_of
from ..operators import intervals as iv
from .common import EV, IV, SPAN, events, merged, r, spans

DAY = 86400.0
BUCKET = 4 * DAY


def _kind(df: DataFrame, *kinds: str) -> DataFrame:
    return df.filter(F.col("event_type").isin(*kinds))


def _bounds(ev: DataFrame) -> DataFrame:
    return ev.groupBy("rec").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def i1_merge(spark, sf):
    return iv.merge_intervals(spans(events(spark, sf))).select("rec", r("start"), r("end"))


def i2_complement(spark, sf):
    ev = events(spark, sf)
    return iv.complement(spans(ev), _bounds(ev)).select("rec", r("start"), r("end"))


def i3_subtract(spark, sf):
    s = spans(events(spark, sf))
    return iv.subtract(_kind(s, "view", "click", "signup"), _kind(s, "purchase")).select("rec", r("start"), r("end"))


def i4_covered(spark, sf):
    s = spans(events(spark, sf))
    return iv.covered_seconds(_kind(s, "view"), _kind(s, "click", "error"), bucket=BUCKET).select("rec", r("start"), r("end"), r("covered"), r("uncovered"))


def i5_semi(spark, sf):
    s = spans(events(spark, sf))
    return iv.overlap_semi(_kind(s, "purchase"), _kind(s, "error")).select("rec", "event_id", r("start"))


def i5_anti(spark, sf):
    s = spans(events(spark, sf))
    return iv.overlap_anti(_kind(s, "purchase"), _kind(s, "error")).select("rec", "event_id", r("start"))


def i6_kept(spark, sf):
    return iv.kept_seconds(iv.merge_intervals(spans(events(spark, sf)))).select("rec", r("kept"))


def i7_unplayed(spark, sf):
    ev = events(spark, sf)
    # every fifth recording has no plays; some begin with the first play, and some end within the last one
    head = F.when(F.col("rec") % 2 == 0, F.min("t")).otherwise(F.min("t") / 2)
    b = ev.groupBy("rec").agg(head.alias("head"), (F.max("t") + F.col("rec") % 3 * 20000 - 20000).alias("duration"))
    return iv.unplayed(spans(ev).filter("rec % 5 > 0"), b, least=3600.0).select("rec", r("start"), r("end"))


def i8_snap(spark, sf):
    ev = events(spark, sf)
    return iv.snap_intervals(_kind(spans(ev), "purchase"), _kind(ev, "view"), frame=1000.0, early=5.0).select("rec", r("start", 3), r("end", 3))


def i8_bounded(spark, sf):
    """Intervals on the grid since the last seam, where a recording ends ahead of its last events."""
    ev = events(spark, sf)
    bounds = ev.groupBy("rec").agg((F.max("t") * F.when(F.col("rec") % 3 > 0, 0.6)).alias("duration"))
    found = iv.snap_intervals(_kind(spans(ev), "purchase"), _kind(ev, "view"), frame=1000.0, early=5.0, seams=_kind(ev, "error").select("rec", F.col("t").alias("time")), bounds=bounds)
    return found.select("rec", r("start", 3), r("end", 3))


def i9_clip(spark, sf):
    s = spans(events(spark, sf))
    windows = _kind(s, "purchase").select("rec", "start", "end", (-F.col("start")).alias("shift"))
    cues = _kind(s, "view").select("rec", "event_id", "start", "end")
    return iv.clip_cues(cues, windows, bucket=BUCKET).select("rec", "event_id", r("start"), r("end"))


def i9_place(spark, sf):
    ev = events(spark, sf)
    cues = ev.select("rec", "event_id", F.col("t").alias("arrival"), (F.col("t") + (F.col("value") - 200) / 5).alias("own"))
    return iv.place_cues(cues).select("rec", "event_id", r("placed"))


def i10_clock(spark, sf):
    ev = events(spark, sf)
    # holes begin before 0 or run past the end; in one recording of seven they cover all of it, in another there are none
    b = ev.groupBy("rec").agg(F.when(F.col("rec") % 7 == 0, 10.0).otherwise(F.max("t") / 2).alias("duration"))
    holes = spans(ev).filter("rec % 7 <> 1").withColumn("start", F.when(F.col("rec") % 7 == 0, -5.0).otherwise(F.col("start") - 300000))
    return iv.clock_per_written(holes.withColumn("end", F.when(F.col("rec") % 7 > 0, F.col("end") - 300000).otherwise(F.col("end"))), b).select("rec", r("ratio", 6))


def i11_seams(spark, sf):
    ev = events(spark, sf)
    seams = _kind(ev, "error").select("rec", F.col("t").alias("time"), (F.col("t") - 10).alias("ends"))
    return iv.split_at_seams(_kind(spans(ev), "purchase"), seams, _kind(ev, "view"), bucket=BUCKET).select("rec", r("start"), r("end"))


def i11_unwritten(spark, sf):
    ev = events(spark, sf)
    seams = _kind(ev, "error").select("rec", F.col("t").alias("time"), (F.col("t") + F.col("value") * 40 - 12000).alias("ends"))
    return iv.unwritten(seams, _kind(ev, "view"), frame=8000.0).select("rec", r("start"), r("end"))


def _stretches(spark, sf):
    """Seams at errors, which end the stretches ahead of them, and points at views; ids are bytes."""
    ev = events(spark, sf)
    seams = _kind(ev, "error").select("rec", F.col("event_id").alias("seam"), F.col("event_id").alias("at"), F.col("t").alias("time"), (F.col("t") - 5).alias("ends"))
    points = _kind(ev, "view").select("rec", F.when(F.col("event_id") % 13 == 0, -1).otherwise(F.col("event_id")).alias("pos"), "t", (F.col("t") - F.col("value") * 5).alias("lead_start"), "event_id")
    return ev, seams, points


def i12_mend(spark, sf):
    """Walked points: some past the last picture's end, some past breakage, some last keys with a foreign lead."""
    ev, seams, points = _stretches(spark, sf)
    last = as_of(_kind(ev, "error").select("rec", "event_id", "t", "value"), points.filter("pos >= 0").select("rec", F.col("pos").alias("key_at"), F.col("t").alias("kt")).withColumn("at", F.col("key_at")), "rec", "event_id", "at", ["key_at", "kt"], strict=True)
    tails = last.select("rec", F.col("event_id").alias("seam"), F.when(F.col("event_id") % 4 > 0, F.col("t") - F.col("value") * SPAN).alias("shown_end"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 400).alias("broken_from"), "key_at", (F.col("kt") - 150.0).alias("key_lead"))
    mended, kept = iv.mend_seams(seams, tails, points, frame=10.0)
    return mended.select("rec", F.lit("seam").alias("what"), F.col("seam").alias("id"), r("ends")).unionByName(kept.select("rec", F.lit("point").alias("what"), F.col("event_id").alias("id"), r("t").alias("ends")))


def i12_replace(spark, sf):
    """Points of stretches whose first claimed time is off, by clicks; a third of the stretches have no time of their own, some no clicks."""
    ev, seams, points = _stretches(spark, sf)
    following = as_of(seams.select("rec", "seam"), points.filter("pos >= 0").select("rec", F.col("t").alias("first"), F.col("pos").alias("at")), "rec", "seam", "at", ["first"], forward=True)
    firsts = following.select("rec", "seam", F.when(F.col("seam") % 3 > 0, F.col("first") + F.when(F.col("seam") % 3 == 1, 1.5).otherwise(0.5)).alias("first"))
    clicks = as_of(_kind(ev, "click").select("rec", F.col("event_id").alias("pos"), "t", F.col("t").alias("lead_start"), "event_id"), seams.select("rec", F.col("at"), "seam"), "rec", "pos", "at", ["seam"])
    return iv.replace_stretches(seams, points, firsts, clicks.filter("seam IS NOT NULL")).select("rec", "event_id", "pos", r("t"))


QUERIES = [i1_merge, i2_complement, i3_subtract, i4_covered, i5_semi, i5_anti, i6_kept, i7_unplayed, i8_snap, i8_bounded, i9_clip, i9_place, i10_clock, i11_seams, i11_unwritten, i12_mend, i12_replace]

_KEEPS = "SELECT rec, s, e FROM iv WHERE event_type IN ('view', 'click', 'signup')"
_DEPTH = f"""st AS (
        SELECT rec, x0, sum(k) AS k, sum(h) AS h FROM (
            SELECT rec, s AS x0, 1 AS k, 0 AS h FROM ({_KEEPS}) UNION ALL SELECT rec, e, -1, 0 FROM ({_KEEPS})
            UNION ALL SELECT rec, s, 0, 1 FROM iv WHERE event_type = 'purchase' UNION ALL SELECT rec, e, 0, -1 FROM iv WHERE event_type = 'purchase'
        ) GROUP BY rec, x0
    ), dp AS (SELECT rec, x0 AS s, lead(x0) OVER w AS e, sum(k) OVER w AS k, sum(h) OVER w AS h FROM st WINDOW w AS (PARTITION BY rec ORDER BY x0)),
    pc AS (SELECT rec, s, e FROM dp WHERE k > 0 AND h = 0 AND e IS NOT NULL)"""


def _gaps(lo: str, least: float) -> str:
    return f"""g AS (
        SELECT x.rec, coalesce(lag(x.e) OVER (PARTITION BY x.rec ORDER BY x.s, x.e), {lo}) AS s, x.s AS e FROM (
            SELECT m.rec, m.s, m.e FROM m JOIN b USING (rec) WHERE m.e > {lo} AND m.s < hi UNION ALL SELECT rec, hi, hi FROM b
        ) x JOIN b USING (rec)) SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM g WHERE e - s > {least}"""


_OVER = "a.rec = o.rec AND a.s < o.e AND o.s < a.e"
ORACLE = {
    "i1_merge": f"WITH {IV}, {merged('m', 'iv')} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\" FROM m",
    "i2_complement": f"WITH {IV}, {merged('m', 'iv')}, b AS (SELECT rec, min(t) AS lo, max(t) AS hi FROM ev GROUP BY rec), {_gaps('lo', 1e-6)}",
    "i3_subtract": f"WITH {IV}, {_DEPTH}, {merged('m', 'pc')} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\" FROM m",
    "i4_covered": f"""WITH {IV}, src AS (SELECT * FROM iv WHERE event_type IN ('click', 'error')), {merged('m', 'src')},
        v AS (SELECT DISTINCT rec, s, e FROM iv WHERE event_type = 'view')
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end", round(c, 6) AS covered, round(e - s - c, 6) AS uncovered FROM (
            SELECT a.rec, a.s, a.e, coalesce(sum(least(a.e, o.e) - greatest(a.s, o.s)) FILTER (o.s IS NOT NULL), 0.0) AS c FROM v a LEFT JOIN m o ON {_OVER} GROUP BY a.rec, a.s, a.e)""",
    "i5_semi": f"""WITH {IV} SELECT rec, event_id, round(s, 6) AS start FROM iv a WHERE event_type = 'purchase'
        AND EXISTS (SELECT 1 FROM iv o WHERE o.event_type = 'error' AND {_OVER})""",
    "i5_anti": f"""WITH {IV} SELECT rec, event_id, round(s, 6) AS start FROM iv a WHERE event_type = 'purchase'
        AND NOT EXISTS (SELECT 1 FROM iv o WHERE o.event_type = 'error' AND {_OVER})""",
    "i6_kept": f"WITH {IV}, {merged('m', 'iv')} SELECT rec, round(sum(e - s), 6) AS kept FROM m GROUP BY rec",
    "i7_unplayed": f"""WITH {IV}, pl AS (SELECT * FROM iv WHERE rec % 5 > 0), {merged('m', 'pl')},
        b AS (SELECT rec, greatest(0, CASE WHEN rec % 2 = 0 THEN min(t) ELSE min(t) / 2 END) AS head, max(t) + rec % 3 * 20000 - 20000 AS d FROM ev GROUP BY rec),
        z AS (SELECT rec, min(s) AS first, max(e) AS last FROM m GROUP BY rec),
        g AS (SELECT rec, 0 AS s, first AS e FROM z JOIN b USING (rec) WHERE first - head >= 3600 UNION ALL
            SELECT rec, e, lead(s) OVER (PARTITION BY rec ORDER BY s) FROM m UNION ALL SELECT rec, last, d FROM z JOIN b USING (rec)),
        c AS (SELECT g.rec, greatest(g.s, 0) AS s, least(g.e, d) AS e FROM g JOIN b USING (rec) WHERE g.e IS NOT NULL AND d > 0)
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM c WHERE e - s >= 3600""",
    "i8_snap": f"""WITH {IV}, p AS (SELECT rec, t FROM ev WHERE event_type = 'view'), c AS (SELECT rec, s, e FROM iv WHERE event_type = 'purchase'),
        n AS (SELECT c.*, (SELECT max(t) FROM p WHERE p.rec = c.rec AND t <= c.s) AS sa, (SELECT max(t) FROM p WHERE p.rec = c.rec AND t <= c.e) AS ea FROM c),
        sn AS (SELECT rec, coalesce(sa + ceil((s - 5 - sa) / 1000 - 1e-9) * 1000, s) AS s, coalesce(ea + floor((e - ea) / 1000 + 1e-9) * 1000, e) AS e FROM n),
        {merged('m', 'sn')} SELECT rec, round(s, 3) AS start, round(e, 3) AS "end" FROM m""",
    "i8_bounded": f"""WITH {IV}, p AS (SELECT rec, t FROM ev WHERE event_type = 'view'), sm AS (SELECT rec, t FROM ev WHERE event_type = 'error'), c AS (SELECT rec, s, e FROM iv WHERE event_type = 'purchase'),
        b AS (SELECT rec, CASE WHEN rec % 3 > 0 THEN max(t) * 0.6 END AS d FROM ev GROUP BY rec), x AS (SELECT rec, s AS x0, true AS up FROM c UNION SELECT rec, e, false FROM c),
        y AS (SELECT x.*, d, (SELECT max(t) FROM p WHERE p.rec = x.rec AND t <= x0 + 10) AS a, (SELECT max(t) FROM sm WHERE sm.rec = x.rec AND t <= x0 + 10) AS since, (SELECT min(t) FROM p WHERE p.rec = x.rec AND t >= x0 - 10) AS nxt FROM x JOIN b USING (rec)),
        z AS (SELECT rec, x0, up, CASE WHEN x0 <= 0 OR x0 >= coalesce(d, 1e300) THEN x0 ELSE least(CASE WHEN a IS NULL OR a < coalesce(since, -1e300) - 10 THEN coalesce(nxt, x0)
            WHEN up THEN a + greatest(ceil((x0 - a - 5 - 10) / 1000 - 1e-9), 0) * 1000 ELSE a + greatest(floor((x0 - a + 10) / 1000 + 1e-9), 0) * 1000 END, coalesce(d, 1e300)) END AS o FROM y),
        sn AS (SELECT c.rec, u.o AS s, v.o AS e FROM c JOIN z u ON u.rec = c.rec AND u.x0 = c.s AND u.up JOIN z v ON v.rec = c.rec AND v.x0 = c.e AND NOT v.up WHERE v.o > u.o),
        {merged('m', 'sn')} SELECT rec, round(s, 3) AS start, round(e, 3) AS "end" FROM m""",
    "i9_clip": f"""WITH {IV} SELECT a.rec, a.event_id, round(greatest(a.s, o.s) - o.s, 6) AS start, round(least(a.e, o.e) - o.s, 6) AS "end"
        FROM iv a JOIN iv o ON {_OVER} WHERE a.event_type = 'view' AND o.event_type = 'purchase'""",
    "i9_place": f"""WITH {EV}, c AS (SELECT rec, event_id, t, t + (value - 200) / 5 AS own FROM ev)
        SELECT rec, event_id, round(CASE WHEN own < t - 1 OR own > t + 30 THEN t ELSE own END, 6) AS placed FROM c""",
    "i10_clock": f"""WITH {IV}, b AS (SELECT rec, CASE WHEN rec % 7 = 0 THEN 10.0 ELSE max(t) / 2 END AS d FROM ev GROUP BY rec),
        h AS (SELECT rec, greatest(CASE WHEN rec % 7 = 0 THEN -5.0 ELSE s - 300000 END, 0) AS s, least(CASE WHEN rec % 7 > 0 THEN e - 300000 ELSE e END, d) AS e FROM iv JOIN b USING (rec) WHERE rec % 7 <> 1),
        {merged('m', 'h')}, l AS (SELECT rec, sum(e - s) AS lost FROM m GROUP BY rec)
        SELECT rec, round(CASE WHEN lost > 0 AND d - lost > 0 THEN d / (d - lost) ELSE 1 END, 6) AS ratio FROM b LEFT JOIN l USING (rec)""",
    "i11_unwritten": f"""WITH {EV}, x AS (SELECT rec, t AS time, least(t, t + value * 40 - 12000) AS s, (SELECT min(v.t) FROM ev v WHERE v.rec = e.rec AND v.event_type = 'view' AND v.t >= e.t - 4000) AS p FROM ev e WHERE event_type = 'error')
        SELECT rec, round(s, 6) AS start, round(coalesce(p, time), 6) AS "end" FROM x WHERE coalesce(p, time) - s > 4000""",
    "i11_seams": f"""WITH {IV}, a AS (SELECT rec, s, e FROM iv WHERE event_type = 'purchase'), sm AS (SELECT rec, t FROM ev WHERE event_type = 'error'),
        p AS (SELECT rec, t FROM ev WHERE event_type = 'view'),
        mk AS (SELECT a.rec, a.s, a.e, sm.t AS x0, sm.t - 10 AS ends FROM a JOIN sm ON a.rec = sm.rec AND sm.t > a.s AND sm.t < a.e UNION ALL SELECT rec, s, e, s, NULL FROM a),
        pc AS (SELECT rec, x0, coalesce(lead(ends) OVER w, lead(x0) OVER w, e) AS stop, row_number() OVER w > 1 AS past FROM mk WINDOW w AS (PARTITION BY rec, s, e ORDER BY x0)),
        f AS (SELECT *, (SELECT min(t) FROM p WHERE p.rec = pc.rec AND p.t >= pc.x0) AS fp FROM pc)
        SELECT rec, round(CASE WHEN past THEN fp ELSE x0 END, 6) AS start, round(stop, 6) AS "end" FROM f WHERE fp < stop""",
    "i12_mend": f"""WITH {EV}, p AS (SELECT rec, event_id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id END AS pos, t, t - value * 5 AS ls FROM ev WHERE event_type = 'view'), e AS (SELECT *, coalesce(lag(event_id) OVER (PARTITION BY rec ORDER BY event_id), 0) AS lo FROM ev WHERE event_type = 'error'),
        s AS (SELECT e.rec, e.event_id, lo, CASE WHEN e.event_id % 4 > 0 AND e.t - 5 - (e.t - e.value * {SPAN}) > 2.5 THEN e.t - e.value * {SPAN} ELSE e.t - 5 END AS ends, CASE WHEN e.event_id % 5 = 0 THEN e.event_id - 400 END AS broken,
            max(p.pos) AS ka, max(p.t) - 150 AS kl FROM e LEFT JOIN p ON p.rec = e.rec AND p.pos >= 0 AND p.pos < e.event_id GROUP BY ALL)
        SELECT rec, 'seam' AS what, event_id AS id, round(ends, 6) AS ends FROM s UNION ALL
        SELECT rec, 'point', event_id, round(t, 6) FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rec = p.rec AND p.pos >= 0 AND p.pos >= s.lo AND p.pos < s.event_id AND (p.t >= s.ends - 2.5 OR p.pos >= s.broken OR (s.ka >= s.lo AND p.pos = s.ka AND p.ls < s.kl - 2.5)))""",
    "i12_replace": f"""WITH {EV}, p AS (SELECT rec, event_id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id END AS pos, t FROM ev WHERE event_type = 'view'), e AS (SELECT rec, event_id AS seam, coalesce(lead(event_id) OVER (PARTITION BY rec ORDER BY event_id), 1000000000) AS hi FROM ev WHERE event_type = 'error'),
        c AS (SELECT rec, event_id, event_id AS pos, t FROM ev WHERE event_type = 'click'),
        o AS (SELECT * FROM e WHERE seam % 3 > 0 AND (SELECT arg_min(t, pos) FROM p WHERE p.rec = e.rec AND pos >= seam) IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.rec = e.rec AND c.pos >= seam AND c.pos < hi)
            AND coalesce(abs((SELECT min(t) FROM p WHERE p.rec = e.rec AND pos >= seam AND pos < hi) - (SELECT arg_min(t, pos) FROM p WHERE p.rec = e.rec AND pos >= seam) - CASE WHEN seam % 3 = 1 THEN 1.5 ELSE 0.5 END) > 1, true))
        SELECT rec, event_id, pos, round(t, 6) AS t FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rec = p.rec AND pos >= seam AND pos < hi) UNION ALL
        SELECT rec, event_id, pos, round(t, 6) FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.rec = c.rec AND pos >= seam AND pos < hi)""",
}
