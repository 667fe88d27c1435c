"""Clock queries: event ids are byte places, times folded by a day are a clock that wraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..operators import clocks as c
from .common import EV, events, r

DAY = 86400


def _seconds(spark, sf):
    return events(spark, sf).withColumn("s", F.floor(F.col("t")))


def _points(spark, sf):
    return events(spark, sf).filter("event_type = 'view'").select("rec", F.col("event_id").alias("pos"), F.col("t").alias("lead_start"), "t")


def _keeps(spark, sf):
    return events(spark, sf).filter("event_type = 'purchase'").select("rec", F.col("t").alias("start"), (F.col("t") + 3000).alias("end"))


def _pieces(spark, sf):
    """A piece at each error: it shifts by its own value."""
    return events(spark, sf).filter("event_type = 'error'").select("rec", F.col("event_id").alias("at"), (F.floor("value") * 900000 - 100000000).alias("shift"), F.floor(F.col("t") * 90000).alias("from_tick"))


def t1_timecode(spark, sf):
    ev = events(spark, sf)
    text = F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.floor(F.col("t") / 60).cast("string"), F.lit(":0"), F.pmod("event_id", F.lit(10)).cast("string"), F.lit(".25")))
    text = text.when(F.pmod("event_id", F.lit(5)) == 1, F.concat(F.lit("1:02:"), F.floor("value").cast("string"))).when(F.pmod("event_id", F.lit(5)) == 2, F.lit("-4")).when(F.pmod("event_id", F.lit(5)) == 3, F.lit("1:2:3:4")).otherwise(F.floor("value").cast("string"))
    return ev.select("event_id", r(tc.parse_timecode(text)).alias("parsed"), tc.format_timecode(F.col("t")).alias("formatted"))


def t2_rebase(spark, sf):
    return c.rebase_time(_seconds(spark, sf), "s", 0.5).select("rec", "event_id", r("t"))


def t3_unwrap(spark, sf):
    # every ninth clock is a little behind, which is no wrap
    late = F.when(F.col("event_id") % 9 == 0, 100000).otherwise(0)
    rows = _seconds(spark, sf).withColumn("clock", F.pmod(F.col("s") - late, F.lit(10 * DAY)))
    return c.unwrap_clock(rows, order="event_id", wrap=10 * DAY).select("rec", "event_id", "unwrapped", "back")


def t4_unwrap_mark(spark, sf):
    t = F.col("t") - 1500000
    return events(spark, sf).select("event_id", r(tc.unwrap_mark(t, F.lit(60000.0), 95443.7)).alias("mark"))


def t5_restarts(spark, sf):
    # one place in fifty is far behind; some gaps are leaps
    ev = events(spark, sf).withColumn("t", F.col("t") - F.when(F.col("event_id") % 50 == 0, 300000.0).otherwise(0.0))
    return c.clock_restarts(ev, pos="event_id", fall=100000.0, leap=180000.0).select("rec", "event_id", r("t"), r("latest"))


def t6_pieces(spark, sf):
    p = events(spark, sf).select("rec", F.col("event_id").alias("pos"), "t")
    seqs = p.select("rec", (F.floor(F.col("pos") / 2500) * 2500).alias("at")).distinct().withColumn("until", F.col("at") + 2500)
    return c.clock_pieces(p, seqs, bucket=2500.0)


def t7_restamp(spark, sf):
    rows = events(spark, sf).select("rec", F.col("event_id").alias("pos"), F.floor(F.col("t") * 90000).alias("ticks"))
    return c.restamp(rows, _pieces(spark, sf)).select("rec", "pos", "restamped")


def t8_seams(spark, sf):
    return c.seams(_pieces(spark, sf)).select("rec", "at", r("time"))


def t9_interpolate(spark, sf):
    ev = events(spark, sf)
    anchors = ev.filter("event_type = 'purchase'").select("rec", F.col("event_id").alias("i"), F.floor(F.col("t") * 1000).alias("clock"))
    return c.interpolate_between_anchors(ev.select("rec", F.col("event_id").alias("i")), anchors)


def _anchors(spark, sf):
    return events(spark, sf).select("rec", F.col("event_id").alias("packet"), F.round(F.col("t") + 40.0 * F.col("event_id"), 3).alias("at"))


def t10_paced(spark, sf):
    return c.paced_schedule(_anchors(spark, sf), 25.0).select("rec", "packet", r("paced", 3))


#: Steps of t10_choose_step and how far they may move an anchor; its anchors are late by up to 20 000 ticks.
STEPS, BUDGET = (100, 290), 8000


def _late_anchors(spark, sf):
    return events(spark, sf).select("rec", "event_type", F.col("event_id").alias("packet"), F.floor(F.col("t") + 40 * F.col("event_id") + 40 * F.col("value")).alias("at"))


def t10_choose_step(spark, sf):
    """Recordings of fewer than two purchases take the nominal step; of the others some fit at it, some at the fastest alone."""
    return c.choose_step(_late_anchors(spark, sf).filter("event_type = 'purchase'"), *STEPS, BUDGET).select("rec", "step")


def t10_times(spark, sf):
    """Arrival times of all packets, under the schedule of those that carry a clock reference."""
    rows = _late_anchors(spark, sf)
    anchors = rows.filter("event_type = 'purchase'")
    schedule = c.paced_schedule(anchors.join(c.choose_step(anchors, *STEPS, BUDGET), "rec"), F.col("step"))
    return c.packet_times(rows.select("rec", "packet"), schedule, pause=30_000).filter("when IS NOT NULL").select("rec", "packet", "when")


def t11_byte_to_time(spark, sf):
    rows = events(spark, sf).select("rec", F.col("event_id").alias("pos"))
    return c.byte_to_time(rows, _points(spark, sf), reach=500000.0).select("rec", "pos", r("t"))


def t12_grid(spark, sf):
    ev = events(spark, sf).select("rec", "event_id", "t")
    own = tc.on_grid_time(F.col("t"), F.lit(7.0), F.lit(1001.0))
    return c.grid_from_points(ev, _points(spark, sf), 1001.0).select("rec", "event_id", r("grid"), r(own).alias("plain"))


def t13_to_output(spark, sf):
    ev = events(spark, sf).select("rec", "event_id", "t")
    plain, keeps = c.source_to_output(ev, _merged(spark, sf)), _merged(spark, sf)
    seam = c.source_to_output(ev, keeps, seam=True).select("event_id", F.col("out").alias("seam"))
    return plain.join(seam, "event_id").select("rec", "event_id", r("out"), r("seam"))


def _merged(spark, sf):
    from ..operators.intervals import merge_intervals

    wide = _keeps(spark, sf).withColumn("end", F.col("start") + 60000)
    return merge_intervals(wide)


def t13_to_source(spark, sf):
    outs = events(spark, sf).select("rec", "event_id", (F.col("t") * 0.3123456789).alias("o"))
    return c.output_to_source(outs, _merged(spark, sf)).select("rec", "event_id", r("src"))


def t13_ranges(spark, sf):
    rows = events(spark, sf).filter("event_type = 'click'").select("rec", "event_id", F.col("t").alias("start"), (F.col("t") + 50000).alias("end"))
    return c.ranges_to_output(rows, _merged(spark, sf), bucket=100000.0).select("rec", "event_id", r("start"), r("end"))


def t14_shift(spark, sf):
    ev = events(spark, sf)
    table_ = ev.filter("event_type = 'view'").select("rec", (F.col("t") + F.when(F.pmod("rec", F.lit(3)) == 0, F.pmod("event_id", F.lit(5)) * 100.0).otherwise(12.5)).alias("t"))
    return c.estimate_shift(table_, ev.select("rec", "t"), 100.0).select("rec", r("spread"), r("shift"))


def t15_continuous(spark, sf):
    rows = events(spark, sf).select("rec", F.col("event_id").alias("n"), F.floor(F.col("event_id") / 97).alias("first_pos"), (F.floor(F.col("event_id") / 97) + F.pmod("event_id", F.lit(2)) - 1).alias("last_pos"), F.when(F.pmod("event_id", F.lit(11)) > 0, F.col("t")).alias("t0"), (F.col("t") + 400000).alias("t1"))
    return c.continuous_runs(rows, back=2000000.0, ahead=500000.0)


def t15_same_name(spark, sf):
    return c.same_name_runs(events(spark, sf).select("rec", F.col("event_id").alias("n"), F.col("event_type").alias("clip")))


QUERIES = [t1_timecode, t2_rebase, t3_unwrap, t4_unwrap_mark, t5_restarts, t6_pieces, t7_restamp, t8_seams, t9_interpolate, t10_paced, t10_choose_step, t10_times, t11_byte_to_time, t12_grid, t13_to_output, t13_to_source, t13_ranges, t14_shift, t15_continuous, t15_same_name]

_PC = EV + ", pc AS (SELECT rec, event_id AS x0, floor(value)::BIGINT * 900000 - 100000000 AS shift, floor(t * 90000)::BIGINT AS from_tick FROM ev WHERE event_type = 'error')"
_KM = EV + """, kp AS (SELECT rec, t AS s, t + 60000 AS e FROM ev WHERE event_type = 'purchase'),
    km AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kp)) GROUP BY rec, g),
    ko AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, lead(s) OVER (PARTITION BY rec ORDER BY s) IS NULL AS final FROM km)"""
_AN = EV + ", an AS (SELECT rec, event_id AS packet, round(t + 40.0 * event_id, 3) AS x0 FROM ev)"
_STEP = EV + """, al AS (SELECT rec, event_type, event_id AS packet, floor(t + 40 * event_id + 40 * value)::BIGINT AS x0 FROM ev), an AS (SELECT * FROM al WHERE event_type = 'purchase'),
    mx AS (SELECT a.rec, min(floor((b.x0 - a.x0 + 8000) / (b.packet - a.packet))) AS s FROM an a JOIN an b ON a.rec = b.rec AND a.packet < b.packet GROUP BY a.rec),
    st AS (SELECT rec, greatest(least(coalesce(s, 290), 290), 100)::BIGINT AS step FROM (SELECT DISTINCT rec FROM an) LEFT JOIN mx USING (rec))"""
_PACE = "min(x0 - packet * {s}) OVER (PARTITION BY rec{g} ORDER BY packet ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + packet * {s}"

ORACLE = {
    "t1_timecode": f"""WITH {EV}, x AS (SELECT event_id, t, CASE event_id % 5 WHEN 0 THEN floor(t / 60) * 60 + event_id % 10 + 0.25 WHEN 1 THEN 3720 + floor(value) WHEN 4 THEN floor(value) END AS p, round(t * 1000)::BIGINT AS ms FROM ev)
        SELECT event_id, round(p, 6) AS parsed, concat(ms // 3600000, ':', lpad((ms // 60000 % 60)::VARCHAR, 2, '0'), ':', lpad((ms // 1000 % 60)::VARCHAR, 2, '0'), '.', lpad((ms % 1000)::VARCHAR, 3, '0')) AS formatted FROM x""",
    "t2_rebase": f"WITH {EV} SELECT rec, event_id, round(floor(t) * 0.5 - min(floor(t) * 0.5) OVER (PARTITION BY rec), 6) AS t FROM ev",
    "t3_unwrap": f"""WITH {EV}, c AS (SELECT rec, event_id, ((floor(t)::BIGINT - CASE WHEN event_id % 9 = 0 THEN 100000 ELSE 0 END) % 864000 + 864000) % 864000 AS clock FROM ev), d AS (SELECT *, clock - lag(clock) OVER (PARTITION BY rec ORDER BY event_id) AS step FROM c)
        SELECT rec, event_id, clock + 864000 * (sum(CASE WHEN step < -432000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS unwrapped, coalesce(step < 0 AND step >= -432000, false) AS back FROM d""",
    "t4_unwrap_mark": f"""WITH {EV}, x AS (SELECT event_id, t - 1500000 AS t FROM ev), y AS (SELECT *, t + ceil(-t / 95443.7) * 95443.7 AS m FROM x)
        SELECT event_id, round(CASE WHEN t >= 0 THEN t WHEN m <= 60001 THEN m END, 6) AS mark FROM y""",
    "t5_restarts": f"""WITH {EV}, b AS (SELECT rec, event_id, t - CASE WHEN event_id % 50 = 0 THEN 300000.0 ELSE 0.0 END AS t FROM ev), m AS (SELECT *, max(t) OVER (PARTITION BY rec ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM b)
        SELECT rec, event_id, round(t, 6) AS t, round(latest, 6) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY event_id) AS i FROM m WHERE t < latest - 100000 OR t > latest + 180000) WHERE i = 1""",
    "t6_pieces": f"""WITH {EV}, p AS (SELECT rec, event_id AS pos, t, event_id // 2500 * 2500 AS x0 FROM ev),
        f AS (SELECT rec, x0, min(pos) AS p0, max(pos) AS p1, arg_min(t, pos) AS t0, arg_max(t, pos) AS t1 FROM p GROUP BY rec, x0),
        g AS (SELECT *, (p1 - p0)::DOUBLE AS b, t1 - t0 AS s FROM f),
        h AS (SELECT *, coalesce(CASE WHEN s > 0 AND b > 0 THEN b / s END, sum(b) FILTER (s > 0) OVER (PARTITION BY rec) / sum(s) FILTER (s > 0) OVER (PARTITION BY rec)) AS pace FROM g),
        l AS (SELECT rec, x0, t0 - (p0 - x0) / pace AS lo, t1 + (x0 + 2500 - p1) / pace AS hi FROM h WHERE pace > 0)
        SELECT rec, x0 AS "at", round((first_value(lo) OVER w + coalesce(sum(hi - lo) OVER (PARTITION BY rec ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - lo) * 90000)::BIGINT AS shift, round(lo * 90000)::BIGINT AS from_tick
        FROM l WINDOW w AS (PARTITION BY rec ORDER BY x0)""",
    "t7_restamp": f"""WITH {_PC}, q AS (SELECT rec, event_id AS pos, floor(t * 90000)::BIGINT + coalesce((SELECT arg_max(shift, x0) FROM pc WHERE pc.rec = ev.rec AND x0 <= event_id), (SELECT arg_min(shift, x0) FROM pc WHERE pc.rec = ev.rec), 0) AS v FROM ev)
        SELECT rec, pos, (v % 8589934592 + 8589934592) % 8589934592 AS restamped FROM q""",
    "t8_seams": f"WITH {_PC} SELECT rec, x0 AS \"at\", round(from_tick / 90000.0, 6) AS time FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY x0) AS i FROM pc) WHERE i > 1",
    "t9_interpolate": f"""WITH {EV}, a AS (SELECT rec, event_id AS i, floor(t * 1000)::BIGINT AS c, row_number() OVER (PARTITION BY rec ORDER BY event_id) AS n, count(*) OVER (PARTITION BY rec) AS m FROM ev WHERE event_type = 'purchase'),
        e AS (SELECT ev.rec, ev.event_id AS i, greatest(1, least((SELECT count(*) FROM a WHERE a.rec = ev.rec AND a.i <= ev.event_id), (SELECT max(m) FROM a WHERE a.rec = ev.rec) - 1)) AS n FROM ev WHERE rec IN (SELECT rec FROM a)),
        s AS (SELECT e.rec, e.i, x.i AS i0, x.c AS c0, coalesce(y.i, x.i) AS i1, coalesce(y.c, x.c) AS c1 FROM e JOIN a x ON x.rec = e.rec AND x.n = e.n LEFT JOIN a y ON y.rec = e.rec AND y.n = e.n + 1)
        SELECT rec, i, c0 + CASE WHEN i1 = i0 THEN 0 ELSE ((i - i0) * (c1 - c0) - ((i - i0) * (c1 - c0)) % (i1 - i0)) // (i1 - i0) END AS clock FROM s""",
    "t10_paced": f"WITH {_AN} SELECT rec, packet, round({_PACE.format(s='25.0', g='')}, 3) AS paced FROM an",
    "t10_choose_step": f"WITH {_STEP} SELECT rec, step FROM st",
    "t10_times": f"""WITH {_STEP}, sc AS (SELECT rec, packet, step, (min(x0 - packet * step) OVER (PARTITION BY rec ORDER BY packet ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + packet * step)::BIGINT AS pc FROM an JOIN st USING (rec)),
        j AS (SELECT al.rec, al.packet AS i, b.packet AS p, b.pc AS began, n.packet AS np, n.pc AS nw, coalesce(b.step, n.step) AS step, n.packet - al.packet AS back, n.packet - b.packet AS cnt, (n.pc - b.pc) // coalesce(b.step, n.step) AS slots
            FROM al ASOF LEFT JOIN sc b ON b.rec = al.rec AND al.packet > b.packet ASOF LEFT JOIN sc n ON n.rec = al.rec AND al.packet <= n.packet),
        x AS (SELECT *, greatest(slots - cnt, 0) AS spare, greatest(cnt * 30000 // (slots * step), 1) AS str FROM j)
        SELECT rec, i AS packet, CASE WHEN np IS NULL THEN began + (i - p) * step WHEN p IS NULL OR spare = 0 THEN nw - back * step ELSE nw - (back + back // str * str * spare // cnt) * step END AS "when" FROM x WHERE np IS NOT NULL OR p IS NOT NULL""",
    "t11_byte_to_time": f"""WITH {EV}, p AS (SELECT rec, event_id AS pos, t, lead(event_id) OVER w AS np, lead(t) OVER w AS nt FROM ev WHERE event_type = 'view' WINDOW w AS (PARTITION BY rec ORDER BY event_id)),
        f AS (SELECT rec, arg_min(t, pos) AS first FROM p GROUP BY rec), j AS (SELECT ev.rec, event_id AS pos, p.pos AS pp, p.t, np, nt, first FROM ev JOIN f USING (rec) ASOF LEFT JOIN p ON p.rec = ev.rec AND ev.event_id >= p.pos)
        SELECT rec, pos, round(CASE WHEN pp IS NULL THEN first WHEN nt - t > 0 AND nt - t <= 500000 THEN t + (nt - t) * (pos - pp) / (np - pp) ELSE t END, 6) AS t FROM j""",
    "t12_grid": f"""WITH {EV}, p AS (SELECT rec, t AS a FROM ev WHERE event_type = 'view')
        SELECT ev.rec, event_id, round(coalesce(a + floor((t - a) / 1001.0 + 0.25) * 1001.0, t), 6) AS grid, round(7.0 + floor((t - 7.0) / 1001.0 + 0.25) * 1001.0, 6) AS plain FROM ev ASOF LEFT JOIN p ON p.rec = ev.rec AND ev.t >= p.a""",
    "t13_to_output": f"""WITH {_KM}, j AS (SELECT ev.rec, event_id, t, s, e, o, final FROM ev ASOF LEFT JOIN ko ON ko.rec = ev.rec AND ev.t >= ko.s),
        x AS (SELECT *, CASE WHEN t < e OR (final AND t = e) THEN o + t - s END AS out FROM j)
        SELECT rec, event_id, round(out, 6) AS out, round(coalesce(out, o + e - s, 0), 6) AS seam FROM x""",
    "t13_to_source": f"""WITH {_KM}, q AS (SELECT rec, event_id, t * 0.3123456789 AS q FROM ev), j AS (SELECT q.rec, event_id, q, s, e, o FROM q ASOF LEFT JOIN ko ON ko.rec = q.rec AND q.q >= ko.o)
        SELECT rec, event_id, round(CASE WHEN s + q - o <= e THEN s + q - o END, 6) AS src FROM j""",
    "t13_ranges": f"""WITH {_KM}, g AS (SELECT rec, event_id, t AS s, t + 50000 AS e FROM ev WHERE event_type = 'click')
        SELECT g.rec, event_id, round(greatest(g.s, ko.s) + o - ko.s, 6) AS start, round(least(g.e, ko.e) + o - ko.s, 6) AS "end" FROM g JOIN ko ON g.rec = ko.rec AND g.s < ko.e AND ko.s < g.e""",
    "t14_shift": f"""WITH {EV}, tb AS (SELECT rec, t + CASE WHEN rec % 3 = 0 THEN (event_id % 5) * 100.0 ELSE 12.5 END AS t FROM ev WHERE event_type = 'view'),
        n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM tb),
        s AS (SELECT DISTINCT n.rec, n.t FROM n, range(8) j(j) WHERE n.i = j.j * n.n // 8), s2 AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM s),
        nr AS (SELECT s2.*, (SELECT max(t) FROM ev WHERE ev.rec = s2.rec AND ev.t <= s2.t) AS lo, (SELECT min(t) FROM ev WHERE ev.rec = s2.rec AND ev.t >= s2.t) AS hi FROM s2),
        b AS (SELECT rec, CASE WHEN hi IS NULL OR t - lo <= hi - t THEN lo ELSE hi END - t AS d FROM nr WHERE i > 1), bb AS (SELECT * FROM b WHERE d IS NOT NULL),
        md AS (SELECT rec, d AS m FROM (SELECT rec, d, row_number() OVER (PARTITION BY rec ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM bb) WHERE i = n // 2),
        sp AS (SELECT rec, max(d) - min(d) AS spread FROM bb GROUP BY rec)
        SELECT rec, round(spread, 6) AS spread, round(CASE WHEN spread <= 50 THEN m END, 6) AS shift FROM sp JOIN md USING (rec)""",
    "t15_continuous": f"""WITH {EV}, c AS (SELECT rec, event_id AS n, event_id // 97 AS fp, event_id // 97 + event_id % 2 - 1 AS lp, CASE WHEN event_id % 11 > 0 THEN t END AS t0, t + 400000 AS t1 FROM ev),
        d AS (SELECT *, lag(lp) OVER w AS plp, lag(t1) OVER w AS pt FROM c WINDOW w AS (PARTITION BY rec ORDER BY n)),
        e AS (SELECT *, sum(CASE WHEN plp IS NOT NULL AND fp = plp + 1 AND (t0 IS NULL OR t0 - pt BETWEEN -2000000 AND 500000) THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM d)
        SELECT rec, min(n) AS first, max(n) AS last, min(fp) AS first_pos, max(lp) AS last_pos, count(*) AS cells FROM e GROUP BY rec, g""",
    "t15_same_name": f"""WITH {EV}, d AS (SELECT rec, event_id AS n, event_type AS clip, lag(event_type) OVER (PARTITION BY rec ORDER BY event_id) AS p FROM ev),
        e AS (SELECT *, sum(CASE WHEN clip = p THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING) AS g FROM d)
        SELECT rec, clip, min(n) AS first, max(n) AS last, count(*) AS items FROM e GROUP BY rec, g, clip""",
}
