"""Cut-plan queries over events and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import easing as ez
from ..operators.intervals import merge_intervals
from ..plans import cuts as p
from .common import EV, events, r, table

FD, GAP = 1000.0, 800.0


def _points(spark, sf):
    ev = events(spark, sf).filter("event_type = 'view'")
    return ev.select("rec", "t", (F.col("t") - F.col("value") * 5).alias("lead_start"), (F.col("value") > 250).alias("open"), (F.col("value") > 400).alias("droppable"), (F.col("event_id") % 2 == 0).alias("starts_sequence"))


def _video(spark, sf):
    return events(spark, sf).groupBy("rec").agg(F.max("t").alias("duration")).select("rec", "duration", F.lit(FD).alias("frame"), F.lit(GAP).alias("gap"), F.lit(60.0).alias("tick"), (F.col("rec") % 2 == 0).alias("variable"))


def _ranges(spark, sf):
    ev = events(spark, sf).filter("event_type = 'purchase'")
    return ev.select("rec", F.col("event_id").alias("id"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 600).alias("end"))


def _keeps(spark, sf):
    return merge_intervals(_ranges(spark, sf))


def p1_access_points(spark, sf):
    ev = events(spark, sf)
    # every third picture is shown ahead of its place in decode order, often before the key picture itself
    shown = F.col("t") - F.when((F.col("event_type") != "purchase") & (F.col("event_id") % 3 == 0), 90000.0).otherwise(0.0)
    packets = ev.select("rec", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("key"), shown.alias("pts"), (F.col("value") > 60).alias("reference"), F.when(F.col("value") > 30, F.col("value") > 90).alias("unreferenced"), (F.col("event_id") * 188).alias("pos"))
    return p.access_points(packets).select("rec", r("time"), r("lead_start"), F.size("lead_indices").alias("leads"), F.aggregate("lead_indices", F.lit(0), lambda a, x: a + x).alias("index_sum"), "droppable", "pos")


def _ev(spark, sf):
    return events(spark, sf).select("rec", "event_id", "t")


def p2_entries(spark, sf):
    pts = _points(spark, sf)
    rows = p.nearest_point(p.entry_before(_ev(spark, sf), pts, slack=500.0), pts)
    rows = p.scene_step(rows, pts).withColumnRenamed("scene", "after")
    return p.scene_step(rows, pts, forward=False).select("rec", "event_id", r("entry"), r("nearest"), r("after"), r("scene").alias("before"))


def _plan(spark, sf):
    return p.plan_ranges(_ranges(spark, sf), _points(spark, sf), _video(spark, sf), bucket=100000.0)


def p3_plan(spark, sf):
    return _plan(spark, sf).select("rec", "id", "kind", r("start"), r("end"), r("copy_until"), r("seek_from"), "frames")


def p4_reencode(spark, sf):
    return p.reencode_range(_ranges(spark, sf), _points(spark, sf)).select("rec", "id", r("start"), r("end"), r("seek_from"))


def p5_frames(spark, sf):
    return p.frames_in(_ranges(spark, sf), _points(spark, sf), _video(spark, sf)).select("rec", "id", "frames")


def p6_totals(spark, sf):
    return p.plan_totals(_plan(spark, sf)).select("rec", r("copied"), r("reencoded"))


def p7_clean_join(spark, sf):
    return p.clean_join(_plan(spark, sf).select("rec", "id", "kind", "start", "end"), _points(spark, sf), budget=100000.0, min_copy=2000.0, eps=500.0).select("rec", "id", "kind", r("start"), r("end"))


def p8_move(spark, sf):
    return p.move_to_pictures(_ranges(spark, sf), _points(spark, sf), _video(spark, sf)).select("rec", "id", r("start"), r("end"))


def p9_parts(spark, sf):
    return p.divide_ranges(_keeps(spark, sf), _points(spark, sf).select("rec", "t"), parts=5, frame=FD).select("rec", "n", r("out"), r("src"), "on_point")


def p9_size(spark, sf):
    keeps = _keeps(spark, sf).withColumn("rate", F.lit(3.0))
    few = _points(spark, sf).filter("t - lead_start > 400").select("rec", "t")
    return p.divide_ranges(keeps, few, size=900000.0, frame=FD).select("rec", "n", r("out"), r("src"), "on_point")


def p9_problems(spark, sf):
    """Recordings by what keeps them from being divided into parts of a size: weights and lengths follow the user."""
    rate = F.when(F.col("rec") % 7 == 1, 0.0).when(F.col("rec") % 7 == 2, 9.0e6).when(F.col("rec") % 7 > 2, 300.0 * (F.col("rec") % 7))
    keeps = _keeps(spark, sf).withColumn("rate", rate).withColumn("end", F.when(F.col("rec") % 11 == 0, F.col("start") + 10).otherwise(F.col("end")))
    return p.division_problems(keeps, size=3000000.0, frame=FD)


def p10_weight(spark, sf):
    tracks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_extendedprice").alias("rate"))
    recs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), F.col("o_totalprice").alias("video_rate"), F.when(F.col("o_orderstatus") == "F", 1.0712345).alias("share"))
    return p.stream_weight(recs, tracks).select("rec", r("weight"))


def p11_timeline(spark, sf):
    clips = events(spark, sf).select("rec", F.col("event_id").alias("n"), (F.col("value") * 10).alias("length"), (F.col("event_type") == "view").alias("overlaps"), (F.col("value") / 10 - 4).alias("seconds"))
    return p.join_timeline(clips).select("rec", "n", r("takes_before"), r("takes_after"), r("out_start"))


def p12_easing(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50).alias("t"), (F.col("p_partkey") % 48).alias("which"))
    value = F.lit(None).cast("double")
    for i, curve in enumerate(ez.CURVES):
        for j, mode in enumerate(ez.MODES):
            value = F.when(F.col("which") == i * 4 + j, ez.easing(curve, mode, F.col("t"))).otherwise(value)
    gain = ez.fade_gain(F.col("t") * 10, 10 - F.col("t") * 10, F.lit(4.0), F.lit(7.0))
    return rows.select("p_partkey", r(value).alias("eased"), r(ez.showing(F.col("t"))).alias("showing"), r(gain).alias("gain"))


def p13_chapters(spark, sf):
    marks = events(spark, sf).filter("event_type = 'signup'")
    return p.chapters(_keeps(spark, sf), marks).select("rec", r("t"), "chapter")


def p14_live_marks(spark, sf):
    marks = events(spark, sf).filter("event_type IN ('signup', 'error', 'click')").select("rec", "event_id", "t")
    return p.live_marks(marks, _keeps(spark, sf), picture=20000.0).select("rec", "event_id", r("out"))


def p15_straddling(spark, sf):
    ev = events(spark, sf)
    frames = ev.select("rec", F.floor("t").alias("first"), F.floor(F.col("value") * 20).alias("length"))
    edges = ev.filter("event_type = 'error'").select("rec", F.floor(F.col("t") + F.pmod("event_id", F.lit(3)) * 300).alias("edge"), F.when(F.col("event_id") % 2 == 0, "head").otherwise("tail").alias("side"))
    return p.straddling_rows(frames, edges, bucket=20000.0)


def p12_fades(spark, sf):
    """Fades that parts ask for, on ranges as long as their size tells; the first and last of a brand lie at the output's ends."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 3.0).alias("length"), (F.col("p_retailprice") / 20).alias("a"), (F.col("p_retailprice") / 40 - 23).alias("b"), (F.row_number().over(w) == 1).alias("first"), F.lead("p_partkey").over(w).isNull().alias("last"))
    up, down = ez.fades_for(F.col("length"), F.col("a"), F.col("b"), F.col("first"), F.col("last"))
    return rows.select("p_partkey", r(up).alias("fade_in"), r(down).alias("fade_out"))


def p15_audible(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x / 200).alias("samples"), F.pmod("vec_id", F.lit(20)).alias("keep_from"), (F.lit(64) - F.pmod("vec_id", F.lit(13))).alias("keep_to"))
    return p.audible_outside(e).select("vec_id", "audible")


QUERIES = [p1_access_points, p2_entries, p3_plan, p4_reencode, p5_frames, p6_totals, p7_clean_join, p8_move, p9_parts, p9_size, p9_problems, p10_weight, p11_timeline, p12_easing, p12_fades, p13_chapters, p14_live_marks, p15_straddling, p15_audible]

_PT = EV + """, pt AS (SELECT rec, t, t - value * 5 AS ls, value > 250 AS op, value > 400 AS dr, event_id % 2 = 0 AS ss, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM ev WHERE event_type = 'view'),
    vd AS (SELECT rec, max(t) AS d FROM ev GROUP BY rec), fp AS (SELECT rec, min(t) AS f FROM pt GROUP BY rec),
    rg AS (SELECT rec, event_id AS id, t AS s, t + value * 600 AS e FROM ev WHERE event_type = 'purchase')"""
_KO = """km AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg WHERE e > s)) GROUP BY rec, g),
    ko AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, lead(s) OVER (PARTITION BY rec ORDER BY s) IS NULL AS final FROM km)"""
_SEEK = "coalesce((SELECT coalesce(q2.t, f.f) FROM pt q LEFT JOIN pt q2 ON q2.rec = q.rec AND q2.i = q.i - 2 JOIN fp f ON f.rec = q.rec WHERE q.rec = {x}.rec AND q.i = (SELECT max(i) FROM pt z WHERE z.rec = {x}.rec AND z.t <= {x}.s)), (SELECT f FROM fp WHERE fp.rec = {x}.rec), 0)"
_NEAR = "coalesce((SELECT arg_min(q.t, (abs(q.t - {t}), q.t)) FROM pt q WHERE q.rec = {x}.rec), 0)"


def _frames(x: str, fd: str) -> str:
    return f"CASE WHEN least({x}.e, d - {fd} / 2) <= {x}.s THEN 0 ELSE greatest(ceil((least({x}.e, d - {fd} / 2) - ph) / {fd} - 0.01) - ceil(({x}.s - ph) / {fd} - 0.01), 0) END::BIGINT"


_PLAN = _PT + f""", a AS (SELECT rg.rec, id, greatest(s, coalesce(f, 0)) AS s, e, d FROM rg JOIN vd USING (rec) LEFT JOIN fp USING (rec)), a1 AS (SELECT * FROM a WHERE e > s),
    k AS (SELECT a1.*, (SELECT min(t) FROM pt WHERE pt.rec = a1.rec AND t >= s - 400 AND t <= e + 400 AND (NOT op OR dr)) AS kf FROM a1),
    st AS (SELECT k.*, (SELECT max((ls, t)) FROM pt WHERE pt.rec = k.rec AND t > kf + 400 AND ls <= e + 400) AS stop FROM k),
    ce AS (SELECT *, CASE WHEN e >= d - 400 AND (stop IS NULL OR stop[1] <= e) THEN e ELSE stop[1] END AS ce, CASE WHEN e >= d - 400 AND (stop IS NULL OR stop[1] <= e) THEN NULL ELSE stop[2] END AS cu FROM st),
    ok AS (SELECT *, coalesce(ce - kf >= 2000, false) AS cp FROM ce),
    sg AS (SELECT rec, id, d, 'reencode' AS kind, s, kf AS e, NULL::DOUBLE AS cu FROM ok WHERE cp AND kf - s >= 800 - 1e-9 UNION ALL SELECT rec, id, d, 'copy', kf, ce, cu FROM ok WHERE cp
        UNION ALL SELECT rec, id, d, 'reencode', ce, e, NULL FROM ok WHERE cp AND e - ce > 400 UNION ALL SELECT rec, id, d, 'reencode', s, e, NULL FROM ok WHERE NOT cp),
    sp AS (SELECT sg.*, {_NEAR.format(t='sg.s', x='sg')} AS ph FROM sg), sf AS (SELECT *, CASE WHEN f1 = 0 THEN f2 ELSE f1 END AS frames FROM (SELECT sp.*, {_frames('sp', '1000.0')} AS f1, {_frames('sp', '800.0')} AS f2 FROM sp)),
    pl AS (SELECT * FROM sf WHERE kind <> 'reencode' OR frames > 0)"""
_E = {
    "none": "{t}", "quadratic": "pow({t}, 2)", "cubic": "pow({t}, 3)", "power": "pow({t}, 3)", "quartic": "pow({t}, 4)", "quintic": "pow({t}, 5)",
    "sine": "(1 - cos({t} * pi() / 2))", "circle": "(1 - sqrt(greatest(1 - {t} * {t}, 0)))", "exponential": "(CASE WHEN {t} <= 0 THEN 0 ELSE pow(2.0, 10 * {t} - 10) END)",
    "back": "(2.70158 * pow({t}, 3) - 1.70158 * pow({t}, 2))", "elastic": "(CASE WHEN {t} <= 0 THEN 0 WHEN {t} >= 1 THEN 1 ELSE -pow(2.0, 10 * {t} - 10) * sin(({t} * 10 - 10.75) * 2 * pi() / 3) END)",
    "bounce": "(1 - (CASE WHEN 1 - {t} < 1 / 2.75 THEN 7.5625 * pow(1 - {t}, 2) WHEN 1 - {t} < 2 / 2.75 THEN 7.5625 * pow(1 - {t} - 1.5 / 2.75, 2) + 0.75 WHEN 1 - {t} < 2.5 / 2.75 THEN 7.5625 * pow(1 - {t} - 2.25 / 2.75, 2) + 0.9375 ELSE 7.5625 * pow(1 - {t} - 2.625 / 2.75, 2) + 0.984375 END))",
}


def _eased() -> str:
    whens = []
    for i, c in enumerate(ez.CURVES):
        e = lambda x, c=c: _E[c].format(t=f"({x})")
        forms = [e("t"), f"1 - {e('1 - t')}", f"CASE WHEN t < 0.5 THEN {e('t * 2')} / 2 ELSE 1 - {e('(1 - t) * 2')} / 2 END", f"CASE WHEN t < 0.5 THEN (1 - {e('1 - t * 2')}) / 2 ELSE 0.5 + {e('(t - 0.5) * 2')} / 2 END"]
        whens += [f"WHEN {i * 4 + j} THEN {f}" for j, f in enumerate(forms)]
    return "CASE w " + " ".join(whens) + " END"


def _divided(rule: str) -> str:
    """Cuts one after another: the place near enough to the target, or else the frame grid; frames are 1000 s, the grid begins at 0."""
    down = rule == "size"
    start = "total > 2000 AND ceil(total / 300000.0) <= 999" if down else "total > 2000 AND total / 5 > 1000"
    more = "prev + 300000.0 < total - 1e-9" if down else "n < 4"
    target = "least(r.prev + 300000.0, r.total - 1000)" if down else "(r.n + 1) * r.total / 5"
    reach = "150000.0" if down else "r.total / 10"
    near = f"c.c > r.prev + 500 AND c.c <= q.t + 1e-9 AND c.c >= q.t - {reach}" if down else f"c.c > r.prev + 500 AND c.c < r.total - 1000 AND abs(c.c - q.t) <= {reach}"
    step = "floor(s / 1000 + 1e-6)" if down else "round(s / 1000)"
    # a place off the points: the grid time, held within its kept range
    exact = f"""SELECT CASE WHEN g < a THEN o WHEN g > b - 1e-9 THEN o + b - a ELSE q.t + g - s END AS x, (g < a AND o > 0) OR g > b - 1e-9 AS j
        FROM (SELECT *, {step} * 1000 AS g FROM (SELECT ko.s AS a, ko.e AS b, o, ko.s + q.t - o AS s FROM ko WHERE ko.rec = r.rec AND o <= q.t ORDER BY o DESC LIMIT 1))"""
    found = f"""SELECT r.rec, r.total, r.n + 1 AS n, CASE WHEN near.c IS NOT NULL OR good THEN coalesce(near.c, x) ELSE r.prev END AS prev, near.c IS NOT NULL OR good AS cut, near.c IS NOT NULL OR j AS onp
        FROM r, LATERAL (SELECT {target} AS t) q, LATERAL (SELECT arg_min(c.c, (abs(c.c - q.t), c.c)) AS c FROM cl c WHERE c.rec = r.rec AND {near}) near, LATERAL ({exact}) ex, LATERAL (SELECT x > r.prev + 500 AND x < r.total - 500 AS good) gd
        WHERE r.{more.replace("total", "r.total") if down else more}{" AND (r.n = 0 OR r.cut)" if down else ""}"""
    return f"""WITH RECURSIVE {_PT}, {_KO}, pl AS (SELECT ko.rec, o + t - s AS c FROM ko JOIN pt ON pt.rec = ko.rec AND t > s + 500 AND t < e - 500{" AND t - ls > 400" if down else ""} UNION ALL SELECT rec, o FROM ko WHERE o > 0),
        cl AS (SELECT rec, min(c) AS c FROM pl GROUP BY rec UNION ALL SELECT pl.rec, min(pl.c) FROM cl JOIN pl ON pl.rec = cl.rec AND pl.c >= cl.c + 500 GROUP BY pl.rec, cl.c),
        r AS (SELECT rec, total, 0 AS n, 0.0::DOUBLE AS prev, false AS cut, false AS onp FROM (SELECT rec, sum(e - s) AS total FROM ko GROUP BY rec) WHERE {start} UNION ALL {found}),
        f AS (SELECT rec, prev AS c, onp, row_number() OVER (PARTITION BY rec ORDER BY n) AS n FROM r WHERE cut)
        SELECT f.rec, f.n::INTEGER AS n, round(c, 6) AS out, round(ko.s + c - o, 6) AS src, onp AS on_point FROM f ASOF JOIN ko ON ko.rec = f.rec AND f.c >= ko.o"""


ORACLE = {
    "p1_access_points": f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS gop FROM ev),
        h AS (SELECT * EXCLUDE t, t - CASE WHEN event_type <> 'purchase' AND event_id % 3 = 0 THEN 90000.0 ELSE 0 END AS t, first_value(t) OVER w AS head, row_number() OVER w - 1 AS i FROM g WHERE gop > 0 WINDOW w AS (PARTITION BY rec, gop ORDER BY event_id)), c AS (SELECT *, i > 0 AND t < head AS lead FROM h)
        SELECT rec, round(head, 6) AS time, round(coalesce(min(t) FILTER (lead), head), 6) AS lead_start, count(*) FILTER (lead)::INTEGER AS leads, coalesce(sum(i) FILTER (lead), 0)::INTEGER AS index_sum,
            coalesce(bool_and(value <= 60 OR value > 90) FILTER (lead), true) AS droppable, min(event_id) * 188 AS pos FROM c GROUP BY rec, gop, head""",
    "p2_entries": f"""WITH {_PT} SELECT rec, event_id, round((SELECT max(t) FROM pt WHERE pt.rec = x.rec AND pt.t <= x.t + 500), 6) AS entry, round((SELECT arg_min(q.t, (abs(q.t - x.t), q.t)) FROM pt q WHERE q.rec = x.rec), 6) AS nearest,
        round((SELECT min(t) FROM pt WHERE pt.rec = x.rec AND pt.t > x.t + 0.001), 6) AS after, round((SELECT max(t) FROM pt WHERE pt.rec = x.rec AND pt.t < x.t - 0.001), 6) AS before FROM ev x""",
    "p3_plan": f"WITH {_PLAN} SELECT rec, id, kind, round(s, 6) AS start, round(e, 6) AS \"end\", round(cu, 6) AS copy_until, round(CASE WHEN kind = 'copy' THEN s ELSE {_SEEK.format(x='pl')} END, 6) AS seek_from, frames FROM pl",
    "p4_reencode": f"WITH {_PT}, x AS (SELECT rg.rec, id, greatest(s, coalesce(f, 0)) AS s, e FROM rg LEFT JOIN fp USING (rec)) SELECT rec, id, round(s, 6) AS start, round(e, 6) AS \"end\", round({_SEEK.format(x='x')}, 6) AS seek_from FROM x WHERE e > s",
    "p5_frames": f"WITH {_PT}, x AS (SELECT rg.*, d, {_NEAR.format(t='rg.s', x='rg')} AS ph FROM rg JOIN vd USING (rec)) SELECT rec, id, {_frames('x', '1000.0')} AS frames FROM x",
    "p6_totals": f"WITH {_PLAN} SELECT rec, round(sum(CASE WHEN kind = 'copy' THEN e - s ELSE 0 END), 6) AS copied, round(sum(CASE WHEN kind = 'reencode' THEN e - s ELSE 0 END), 6) AS reencoded FROM pl GROUP BY rec",
    "p7_clean_join": f"""WITH {_PLAN}, n AS (SELECT *, row_number() OVER w AS n, lag(kind) OVER w AS pk, lead(kind) OVER w AS nk, lead(e) OVER w AS ne FROM pl WINDOW w AS (PARTITION BY rec, id ORDER BY s)),
        x0 AS (SELECT *, CASE WHEN n = 1 THEN e ELSE s END AS x1 FROM n), c AS (SELECT *, (SELECT min(t) FROM pt WHERE pt.rec = x0.rec AND ss AND t >= x1 - 500) AS cl FROM x0),
        m AS (SELECT *, coalesce(((n = 2 AND kind = 'copy' AND pk = 'reencode') OR (n = 1 AND kind = 'reencode' AND nk = 'copy')) AND cl > x1 + 1e-6 AND cl <= x1 + 100500 AND CASE WHEN n = 2 THEN e ELSE ne END - cl >= 2000, false) AS mv FROM c)
        SELECT rec, id, kind, round(CASE WHEN mv AND n = 2 THEN cl ELSE s END, 6) AS start, round(CASE WHEN mv AND n = 1 THEN cl ELSE e END, 6) AS "end" FROM m""",
    "p8_move": f"""WITH {_PT}, x AS (SELECT rg.*, d, rec % 2 = 0 AS vr, {_NEAR.format(t='rg.s', x='rg')} AS p1, {_NEAR.format(t='rg.e', x='rg')} AS p2 FROM rg JOIN vd USING (rec)),
        y AS (SELECT *, p1 + round((s - p1) / 1000.0) * 1000.0 AS g1, p2 + round((e - p2) / 1000.0) * 1000.0 AS g2 FROM x)
        SELECT rec, id, round(CASE WHEN NOT vr AND abs(s - g1) <= 120 AND s < d - 500 THEN g1 - 120 ELSE s END, 6) AS start, round(CASE WHEN NOT vr AND abs(e - g2) <= 120 AND e < d - 500 THEN g2 - 120 ELSE e END, 6) AS "end" FROM y""",
    "p9_parts": _divided("parts"),
    "p9_size": _divided("size"),
    "p9_problems": f"""WITH {_PT}, {_KO}, t AS (SELECT rec, sum(CASE WHEN rec % 11 = 0 THEN 10 ELSE e - s END) AS total, CASE rec % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 9e6 ELSE 300 * (rec % 7) END AS w FROM km GROUP BY rec),
        x AS (SELECT rec, CASE WHEN total <= 2000 THEN 'nothing' WHEN w IS NULL OR w <= 0 THEN 'weight' WHEN 3e6 / w < 1 THEN 'second' WHEN ceil(total / (3e6 / w)) > 999 THEN 'many' END AS reason FROM t)
        SELECT rec, reason FROM x WHERE reason IS NOT NULL""",
    "p10_weight": """SELECT o_orderkey AS rec, round((o_totalprice + coalesce((SELECT sum(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey), 0) * 1.2) / 8 * CASE WHEN o_orderstatus = 'F' THEN 1.0712345 ELSE 1 END, 6) AS weight FROM orders""",
    "p11_timeline": f"""WITH {EV}, c AS (SELECT rec, event_id AS n, value * 10 AS len, event_type = 'view' AS ov, greatest(least(value / 10 - 4, 30.0), 0.0) AS d FROM ev),
        t AS (SELECT *, CASE WHEN lead(n) OVER (PARTITION BY rec ORDER BY n) IS NULL THEN 0 WHEN ov THEN d ELSE d / 2 END AS ta FROM c)
        SELECT rec, n, round(coalesce(lag(ta) OVER w, 0), 6) AS takes_before, round(ta, 6) AS takes_after, round(coalesce(sum(len - CASE WHEN ov THEN ta ELSE 0 END) OVER (PARTITION BY rec ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS out_start FROM t WINDOW w AS (PARTITION BY rec ORDER BY n)""",
    "p12_easing": f"""WITH x AS (SELECT p_partkey, p_size / 50 AS t, p_partkey % 48 AS w FROM part)
        SELECT p_partkey, round({_eased()}, 6) + 0.0 AS eased, round(greatest(0, least(1, t / 0.25, (1 - t) / 0.25)), 6) AS showing,
            round(least(0.5 - 0.5 * cos(pi() * greatest(0, least(1, t * 10 / 4))), 0.5 - 0.5 * cos(pi() * greatest(0, least(1, (10 - t * 10) / 7)))), 6) AS gain FROM x""",
    "p12_fades": """WITH x AS (SELECT p_partkey, p_size * 3.0 AS len, p_retailprice / 20 AS a, p_retailprice / 40 - 23 AS b, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS first, p_partkey = max(p_partkey) OVER (PARTITION BY p_brand) AS last FROM part)
        SELECT p_partkey, round(CASE WHEN first THEN 0 ELSE greatest(0, least(a, len / 2, 60)) END, 6) AS fade_in, round(CASE WHEN last THEN 0 ELSE greatest(0, least(b, len / 2, 60)) END, 6) AS fade_out FROM x""",
    "p15_audible": """SELECT vec_id, len(list_filter(range(0, 64), lambda i: abs(embedding[i + 1]::DOUBLE / 200) > 0.001 AND (i < vec_id % 20 OR i >= 64 - vec_id % 13))) > 0 AS audible FROM embeddings""",
    "p13_chapters": f"""WITH {_PT}, {_KO}, m AS (SELECT ev.rec, o + t - s AS t FROM ev ASOF JOIN ko ON ko.rec = ev.rec AND ev.t >= ko.s WHERE event_type = 'signup' AND (t < e OR (final AND t = e))),
        c AS (SELECT rec, o::DOUBLE AS t FROM ko UNION SELECT rec, t FROM m) SELECT rec, round(t, 6) AS t, row_number() OVER (PARTITION BY rec ORDER BY t)::INTEGER AS chapter FROM c""",
    "p14_live_marks": f"""WITH {_PT}, {_KO}, m AS (SELECT ev.rec, event_id, t, o + t - s AS out FROM ev ASOF JOIN ko ON ko.rec = ev.rec AND ev.t >= ko.s WHERE event_type IN ('signup', 'error', 'click') AND (t < e OR (final AND t = e))),
        n AS (SELECT *, lead(out) OVER (PARTITION BY rec ORDER BY out, t) AS nx FROM m) SELECT rec, event_id, round(out, 6) AS out FROM n WHERE nx IS NULL OR nx - out > 10000""",
    "p15_straddling": f"""WITH {EV}, f AS (SELECT rec, floor(t)::BIGINT AS first, floor(value * 20)::BIGINT AS length FROM ev), e AS (SELECT rec, floor(t + (event_id % 3) * 300)::BIGINT AS edge, CASE WHEN event_id % 2 = 0 THEN 'head' ELSE 'tail' END AS side FROM ev WHERE event_type = 'error')
        SELECT f.rec, first, length, edge, side FROM f JOIN e ON f.rec = e.rec AND CASE WHEN side = 'tail' THEN edge - 1 ELSE edge END >= first AND CASE WHEN side = 'tail' THEN edge - 1 ELSE edge END < first + length
        WHERE NOT CASE WHEN side = 'tail' THEN first + length = edge ELSE first = edge END""",
}
