"""Gap and rate queries over events: a user is a recording, an event a picture of value-many bytes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gaps as g
from .common import EV, events, r, table

FRAME = 20000.0


def _packets(spark, sf):
    """Events in order of id, which is their decode order; every 13th is shown far ahead, every 26th out of decode time too."""
    ev = events(spark, sf)
    ahead = F.when(F.col("event_id") % 13 == 0, 5000000.0).otherwise(F.pmod("event_id", F.lit(7)) * 40.0)
    dts = F.col("t") - F.when(F.col("event_id") % 26 == 0, 5000000.0).otherwise(0.0)
    return ev.select("rec", F.col("event_id").alias("seq"), (F.col("t") * 0.5 + ahead).alias("pts"), dts.alias("dts"), F.floor("value").alias("size"), "t", "event_type")


def g1_gaps(spark, sf):
    return g.gaps(events(spark, sf), "rec", "t", "event_id").select("rec", "event_id", r("gap"))


def g1_median_gap(spark, sf):
    return g.median_gap(events(spark, sf)).select("rec", r("median_gap"))


def g2_closest_gap(spark, sf):
    return g.closest_gap(events(spark, sf)).select("rec", r("closest"))


def g3_variable_rate(spark, sf):
    # a third of the recordings has even gaps, with repeats and at times a hold; a third of those is too short to tell
    n = F.row_number().over(Window.partitionBy("rec").orderBy("event_id"))
    even = F.floor(n / F.when(F.col("rec") % 9 == 0, 3).otherwise(1)) * FRAME + F.when((F.col("rec") % 2 == 0) & (n > 40), 3 * FRAME).otherwise(0.0)
    ev = events(spark, sf).withColumn("t", F.when(F.col("rec") % 3 == 0, even).otherwise(F.col("t")))
    return g.is_variable_rate(ev, FRAME)


def g4_stray_times(spark, sf):
    return g.stray_times(_packets(spark, sf)).select("rec", "seq", r("pts", 3))


def g5_holes(spark, sf):
    return g.holes(events(spark, sf), FRAME).select("rec", r("missing"))


def g6_bit_rate(spark, sf):
    return g.measured_bit_rate(_packets(spark, sf), 40.0).select("rec", r("bit_rate"))


def g7_sampled_rate(spark, sf):
    p = _packets(spark, sf)
    return g.sampled_bit_rate(p.filter("event_type = 'view'"), p, n=6, seconds=50000.0).select("rec", r("bit_rate"))


def g8_pid_rates(spark, sf):
    stated = F.when(F.col("seq") % 3 > 0, F.pmod(F.floor(F.col("t") * 1000), F.lit(2**33)))
    p = _packets(spark, sf).withColumn("pid", F.col("event_type")).withColumn("clock", stated)
    return g.pid_rates(p, hz=1000.0).select("rec", "pid", "n", r("bit_rate"))


def _points(spark, sf):
    """Points of two files on one clock where the id's fourth bit differs; places fall, rise and stand still."""
    late = F.when(F.col("event_id") % 16 >= 8, 150000.0).otherwise(0.0)
    return events(spark, sf).select("rec", F.col("event_id").alias("n"), (F.col("t") - late).alias("t"), (F.floor(F.col("event_id") / 600) * 400 + F.floor(F.col("value") / 100) * 100).alias("pos"))


def g9_byte_profile(spark, sf):
    return g.byte_profile(_points(spark, sf)).select("rec", r("start"), r("end"), "bytes")


def g9_busier(spark, sf):
    keeps = events(spark, sf).filter("event_type = 'purchase'").select("rec", F.col("t").alias("start"), (F.col("t") + 40000.0).alias("end"))
    return g.busier(g.byte_profile(_points(spark, sf)), keeps, bucket=80000.0).select("rec", r("average"), r("busier", 3))


def g10_compare_gaps(spark, sf):
    ev = events(spark, sf)
    moved = ev.select("rec", (F.col("t") + F.when(F.pmod("rec", F.lit(2)) == 0, F.pmod("event_id", F.lit(3)) * 0.25).otherwise(7.0)).alias("t"))
    return g.compare_gaps(ev, moved, 0.3).select("rec", "na", "nb", r("worst"), "same")


def g11_histogram(spark, sf):
    ev = events(spark, sf).select("rec", F.floor(F.col("t") / 40000).cast("double").alias("t"))
    other = ev.withColumn("t", F.when(F.col("rec") % 2 == 0, F.floor(F.col("t") / 2)).otherwise(F.col("t") + F.col("t") % 2 * F.when(F.col("t") < 3, 1).otherwise(0)).cast("double"))
    return g.step_histogram_close(ev, other).select("rec", r("worst"), "close")


def g12_pulldown(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.when(F.col("l_quantity") > 40, 3).otherwise(2).alias("fields"))
    flags = g.pulldown_flag(rows).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), "o_orderpriority"), "rec")
    return g.pulldown_share(flags, "o_orderpriority").select("o_orderpriority", r("share"))


def g13_coverage(spark, sf):
    ev = events(spark, sf)
    bounds = ev.groupBy("rec").agg((F.max("t") * (1 + F.pmod("rec", F.lit(5)) / 20)).alias("duration"))
    return g.index_coverage(ev.filter("event_type = 'view'"), bounds)


QUERIES = [g1_gaps, g1_median_gap, g2_closest_gap, g3_variable_rate, g4_stray_times, g5_holes, g6_bit_rate, g7_sampled_rate, g8_pid_rates, g9_byte_profile, g9_busier, g10_compare_gaps, g11_histogram, g12_pulldown, g13_coverage]

_G = EV + ", g AS (SELECT rec, event_id, t, event_type, lead(t) OVER (PARTITION BY rec ORDER BY t, event_id) - t AS gap FROM ev)"
_MID = "SELECT rec, gap AS m FROM (SELECT rec, gap, row_number() OVER (PARTITION BY rec ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM {src} WHERE gap IS NOT NULL) WHERE i = {at}"
_UP, _LOW = _MID.replace("{at}", "n // 2"), _MID.replace("{at}", "(n - 1) // 2")
_PK = EV + ", pk AS (SELECT rec, event_id AS seq, t * 0.5 + CASE WHEN event_id % 13 = 0 THEN 5000000.0 ELSE (event_id % 7) * 40.0 END AS pts, t - CASE WHEN event_id % 26 = 0 THEN 5000000.0 ELSE 0 END AS dts, floor(value)::BIGINT AS size, t, event_type FROM ev)"
_STRAY = """st AS (SELECT rec, seq, pts FROM (SELECT *, lag(pts) OVER w AS p0, lead(pts) OVER w AS p1, lag(dts) OVER w AS d0, lead(dts) OVER w AS d1 FROM pk WINDOW w AS (PARTITION BY rec ORDER BY seq))
    WHERE pts > p0 + 60 AND pts > p1 + 60 AND NOT (d0 <= dts AND dts <= d1))"""
_PROF = EV + """, pr AS (SELECT rec, n, t AS s, lead(t) OVER w AS e, lead(pos) OVER w - pos AS bytes FROM (SELECT rec, event_id AS n, t - CASE WHEN event_id % 16 >= 8 THEN 150000.0 ELSE 0.0 END AS t, event_id // 600 * 400 + floor(value / 100)::BIGINT * 100 AS pos FROM ev) WINDOW w AS (PARTITION BY rec ORDER BY n)),
    pp AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, n) AS i FROM pr WHERE e > s AND bytes >= 0),
    ch AS (SELECT rec, i, e AS reach FROM pp WHERE i = 1 UNION ALL SELECT ch.rec, nx.i, nx.e FROM ch, LATERAL (SELECT i, e FROM pp WHERE pp.rec = ch.rec AND pp.s >= ch.reach ORDER BY i LIMIT 1) nx),
    p AS (SELECT pp.* FROM pp JOIN ch USING (rec, i))"""


def _shares(name: str, src: str) -> str:
    return f"""{name} AS (SELECT rec, step, n / sum(n) OVER (PARTITION BY rec) AS share FROM (SELECT rec, round(gap, 4) AS step, count(*) AS n FROM
        (SELECT rec, lead(t) OVER (PARTITION BY rec ORDER BY t) - t AS gap FROM {src}) WHERE gap IS NOT NULL GROUP BY rec, step))"""


ORACLE = {
    "g1_gaps": f"WITH {_G} SELECT rec, event_id, round(gap, 6) AS gap FROM g",
    "g1_median_gap": f"WITH {_G} SELECT rec, round(m, 6) AS median_gap FROM ({_UP.format(src='g')})",
    "g2_closest_gap": f"WITH {_G} SELECT rec, round(min(gap), 6) AS closest FROM g WHERE gap > 0 GROUP BY rec",
    "g3_variable_rate": f"""WITH {EV}, nn AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY event_id) AS n FROM ev),
        tt AS (SELECT rec, CASE WHEN rec % 3 = 0 THEN floor(n / CASE WHEN rec % 9 = 0 THEN 3 ELSE 1 END) * {FRAME} + CASE WHEN rec % 2 = 0 AND n > 40 THEN {3 * FRAME} ELSE 0 END ELSE t END AS t FROM nn),
        g AS (SELECT * FROM (SELECT rec, lead(t) OVER (PARTITION BY rec ORDER BY t) - t AS gap FROM tt) WHERE gap > 0), u AS (SELECT rec, least({FRAME}, m) AS u FROM ({_LOW.format(src='g')})),
        c AS (SELECT rec, count(*) AS n, count(*) FILTER (gap > 1.75 * u) AS held, count(*) FILTER (gap < {FRAME / 2}) AS dense FROM g JOIN u USING (rec) GROUP BY rec)
        SELECT rec, n, held, dense, n >= 32 AND (dense >= 4 OR held * 100 > n) AS variable FROM c""",
    "g4_stray_times": f"WITH {_PK}, {_STRAY} SELECT rec, seq, round(pts, 3) AS pts FROM st",
    "g5_holes": f"WITH {_G} SELECT rec, round(sum(CASE WHEN gap > {2.5 * FRAME} THEN gap - {FRAME} ELSE 0.0 END), 6) AS missing FROM g GROUP BY rec",
    "g6_bit_rate": f"""WITH {_PK}, {_STRAY} SELECT rec, round(sum(size) * 8 / (max(pts) FILTER (stray IS NULL) + 40.0), 6) AS bit_rate
        FROM pk LEFT JOIN (SELECT rec, seq, 1 AS stray FROM st) USING (rec, seq) GROUP BY rec""",
    "g7_sampled_rate": f"""WITH {_PK}, pt AS (SELECT rec, t FROM pk WHERE event_type = 'view'),
        i AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM pt),
        s AS (SELECT DISTINCT i.rec, i.t AS s FROM i, range(6) j(j) WHERE i.i = j.j * i.n // 6),
        w AS (SELECT * FROM (SELECT rec, s, (SELECT min(t) FROM pt WHERE pt.rec = s.rec AND pt.t >= s.s + 50000.0) AS e FROM s) WHERE e IS NOT NULL),
        b AS (SELECT w.rec, sum(pk.size) AS bytes FROM w JOIN pk ON pk.rec = w.rec AND pk.t >= w.s AND pk.t < w.e GROUP BY w.rec)
        SELECT rec, round(bytes * 8 / sec, 6) AS bit_rate FROM b JOIN (SELECT rec, sum(e - s) AS sec FROM w GROUP BY rec) USING (rec)""",
    "g8_pid_rates": f"""WITH {_PK}, c AS (SELECT rec, event_type AS pid, count(*) AS n, ((arg_max(floor(t * 1000)::BIGINT, seq) FILTER (seq % 3 > 0) - arg_min(floor(t * 1000)::BIGINT, seq) FILTER (seq % 3 > 0)) % 8589934592 + 8589934592) % 8589934592 / 1000.0 AS run
        FROM pk GROUP BY rec, event_type) SELECT rec, pid, n, CASE WHEN run > 0 THEN round(n * 188 * 8 / run, 6) END AS bit_rate FROM c""",
    "g9_byte_profile": f"WITH RECURSIVE {_PROF} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\", bytes FROM p",
    "g9_busier": f"""WITH RECURSIVE {_PROF}, a AS (SELECT rec, sum(bytes) / sum(e - s) AS average, sum(e - s) AS profiled FROM p GROUP BY rec),
        k AS (SELECT rec, t AS s, t + 40000.0 AS e FROM ev WHERE event_type = 'purchase'),
        o AS (SELECT k.rec, sum((least(k.e, p.e) - greatest(k.s, p.s)) * (p.bytes / (p.e - p.s) - average)) AS over FROM k JOIN p ON k.rec = p.rec AND k.s < p.e AND p.s < k.e JOIN a ON a.rec = k.rec GROUP BY k.rec)
        SELECT rec, round(average, 6) AS average, round(coalesce(over, 0.0) / 1.056, 3) AS busier FROM a LEFT JOIN o USING (rec)""",
    "g10_compare_gaps": f"""WITH {EV}, a AS (SELECT rec, lead(t) OVER w - t AS ga, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)),
        mv AS (SELECT rec, t + CASE WHEN rec % 2 = 0 THEN (event_id % 3) * 0.25 ELSE 7.0 END AS t FROM ev), b AS (SELECT rec, lead(t) OVER w - t AS gb, row_number() OVER w AS i FROM mv WINDOW w AS (PARTITION BY rec ORDER BY t)),
        c AS (SELECT rec, count(ga) AS na, count(gb) AS nb, max(abs(ga - gb)) AS worst FROM a FULL JOIN b USING (rec, i) GROUP BY rec)
        SELECT rec, na, nb, round(worst, 6) AS worst, na = nb AND coalesce(worst, 0) <= 0.3 AS same FROM c WHERE na > 0""",
    "g11_histogram": f"""WITH {EV}, x AS (SELECT rec, floor(t / 40000) AS t FROM ev), y AS (SELECT rec, CASE WHEN rec % 2 = 0 THEN floor(t / 2) ELSE t + CASE WHEN t < 3 THEN t % 2 ELSE 0 END END AS t FROM x), {_shares('a', 'x')}, {_shares('b', 'y')},
        c AS (SELECT rec, max(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) AS worst FROM a FULL JOIN b USING (rec, step) GROUP BY rec)
        SELECT rec, round(worst, 6) AS worst, worst < 0.1 AS close FROM c""",
    "g12_pulldown": """SELECT o_orderpriority, round(avg(p), 6) AS share FROM (SELECT l_orderkey, max(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY l_orderkey)
        JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "g13_coverage": f"""WITH {EV}, v AS (SELECT * FROM ev WHERE event_type = 'view'), g AS (SELECT rec, t, lead(t) OVER (PARTITION BY rec ORDER BY t) - t AS gap FROM v),
        f AS (SELECT rec, count(*) AS n, max(gap) AS widest, max(t) AS last FROM g GROUP BY rec), md AS ({_UP.format(src='g')}), b AS (SELECT rec, max(t) * (1 + (rec % 5) / 20) AS d FROM ev GROUP BY rec)
        SELECT rec, n, CASE WHEN n < 2 THEN 'few' WHEN widest > greatest(d / 10, 30) THEN 'gap' WHEN d - last > greatest(3 * m, least(10, d / 2)) THEN 'end' ELSE 'ok' END AS reason
        FROM f LEFT JOIN md USING (rec) JOIN b USING (rec)""",
}
