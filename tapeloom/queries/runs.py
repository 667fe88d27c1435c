"""Run, hysteresis and template queries over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as rn
from .common import EV, events, r, table

W = H = 8


def _scores(spark, sf):
    return events(spark, sf).select("rec", "event_id", "t", (F.col("value") / 500).alias("score"))


def _hyst():
    return dict(present=F.lit(0.08), absent=F.lit(0.03), min_present=5000.0, window=50000.0)


def _gone(spark, sf):
    """Absences of recordings half of which end some time after their last score."""
    ends = events(spark, sf).groupBy("rec").agg((F.max("t") + F.when(F.col("rec") % 2 == 0, 30000.0).otherwise(-5.0)).alias("stop"))
    return rn.hysteresis_intervals(_scores(spark, sf).join(ends, "rec"), **_hyst(), order=("event_id",), end="stop")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("vec"))


def _templates(spark, sf):
    high = rn.learn_template(_vectors(spark, sf)).select("rec", rn.highpass(F.col("template"), W, H).alias("template"))
    return high.withColumn("mask", rn.template_mask(F.transform("template", lambda v: F.round(v, 9)), W, H, keep=12, margin=1))


def r1_flat_runs(spark, sf):
    runs = rn.flat_runs(events(spark, sf).withColumnRenamed("event_type", "state"), order=("event_id",), min_count=2, min_seconds=1000.0)
    return runs.select("rec", "state", r("start"), r("end"), r("last"), "pictures")


def r2_classify_flat(spark, sf):
    # a brightness of the picture's own, so that dark, bright and mixed pictures occur
    luma = F.transform("embedding", lambda v: F.greatest(F.lit(16), F.least(F.lit(235), F.floor(v * 300 + F.pmod("vec_id", F.lit(5)) * 50 - 20))).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", luma.alias("luma"))
    return rn.classify_flat(rows, black=0.1, white=0.5, share=0.6).select("vec_id", "shade")


def r3_silence(spark, sf):
    ev = events(spark, sf)
    loud = F.col("value") >= 150
    frames = ev.select("rec", "t", (F.col("t") + 10).alias("end"), F.when(loud, F.col("t") + 1).alias("loud_first"), F.when(loud, F.col("t") + 4).alias("loud_last"))
    return rn.silent_stretches(frames, min_seconds=90000.0).select("rec", r("start"), r("end"))


def r3_loud_bounds(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 2.0).alias("t"), F.lit(100).alias("rate"), F.transform("embedding", lambda x: x * F.pmod("vec_id", F.lit(3)) / 60).alias("samples"))
    return rn.loud_bounds(e).select("vec_id", r("loud_first"), r("loud_last"))


def r4_monotone(spark, sf):
    return rn.monotone_only(events(spark, sf), "rec", "t", "event_id").select("rec", "event_id", r("t"))


def r5_debounce(spark, sf):
    return rn.debounce(events(spark, sf).filter("event_type = 'error'"), gap=100000.0).select("rec", r("t"))


def r5b_dedup_adjacent(spark, sf):
    return rn.dedup_adjacent(events(spark, sf), eps=5000.0, order=("event_id",)).select("rec", "event_id", r("t"))


def r6_hysteresis(spark, sf):
    return _gone(spark, sf).select("rec", r("start"), r("end"), "edge")


def r6_transitions(spark, sf):
    return rn.transitions(_scores(spark, sf), F.lit(0.08), F.lit(0.03), 5000.0, order=("event_id",))


def r7_split_absences(spark, sf):
    return rn.split_absences(_gone(spark, sf), long=200000.0, edge_long=10000.0, brief=50000.0).select("rec", r("start"), "edge", "kind")


def r8_outline(spark, sf):
    return rn.level_outline(events(spark, sf).withColumn("level", F.col("value") / 500), step=86400.0, fill=True)


def r9_thin(spark, sf):
    ev = events(spark, sf)
    own = rn.byte_interval(ev, size="value", budget=4000)
    return rn.thin_by_interval(ev.join(own, "rec"), interval=F.col("interval")).select("rec", r("t"))


def r10_change(spark, sf):
    return rn.change_score(_vectors(spark, sf), sig="vec", full=1.0).select("rec", "t", r("diff"))


def r11_scenes(spark, sf):
    ev = events(spark, sf).select("rec", "t", (F.col("value") / 500).alias("diff"))
    bounds = ev.groupBy("rec").agg(F.max("t").alias("duration"))
    return rn.scene_marks(ev, bounds, over=1.5, spacing=300000.0).select("rec", r("t"), r("diff"))


def r12_template(spark, sf):
    return rn.learn_template(_vectors(spark, sf)).select("rec", F.posexplode("template").alias("i", "v")).select("rec", "i", r("v"))


def r13_highpass(spark, sf):
    cells = _templates(spark, sf).select("rec", "mask", F.posexplode("template").alias("i", "v"))
    return cells.select("rec", "i", r("v"), F.array_contains("mask", F.col("i")).alias("kept"))


def r14_cluster(spark, sf):
    points = _templates(spark, sf).select("rec", F.explode("mask").alias("i")).select("rec", F.pmod("i", F.lit(W)).alias("x"), F.floor(F.col("i") / W).cast("int").alias("y"))
    return rn.largest_cluster(points, reach=1)


def r15_score(spark, sf):
    return rn.template_score(_vectors(spark, sf), _templates(spark, sf), W, H, ring=4).select("rec", "t", r("score"))


def r15_ring(spark, sf):
    return rn.ring_length(events(spark, sf), seconds=400000.0)


def r16_corner(spark, sf):
    rows = events(spark, sf).select("rec", F.col("event_type").alias("corner"), "t", (F.col("value") / 500).alias("score"))
    return rn.choose_corner(rows, fewest=5, least_break=30.0, min_present=1000.0, window=100000.0).select("rec", "corner", "transitions", r("share"))


QUERIES = [r1_flat_runs, r2_classify_flat, r3_silence, r3_loud_bounds, r4_monotone, r5_debounce, r5b_dedup_adjacent, r6_hysteresis, r6_transitions, r7_split_absences, r8_outline, r9_thin, r10_change, r11_scenes, r12_template, r13_highpass, r14_cluster, r15_score, r15_ring, r16_corner]


def _states(src: str, k: str, present: str, absent: str, min_present: float) -> str:
    return f"""h1 AS (SELECT *, score >= {present} AS up FROM {src}),
        h2 AS (SELECT *, sum(CASE WHEN was_up IS NULL OR up <> was_up THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, lag(up) OVER (PARTITION BY {k} ORDER BY t, event_id) AS was_up FROM h1)),
        h3 AS (SELECT *, min(t) OVER (PARTITION BY {k}, island) AS since, row_number() OVER (PARTITION BY {k} ORDER BY t, event_id) AS i FROM h2),
        h4 AS (SELECT *, CASE WHEN i = 1 THEN CASE WHEN up THEN 'P' ELSE 'A' END WHEN score < {absent} THEN 'A' WHEN up AND t - since >= {min_present} THEN 'P' END AS e FROM h3),
        h5 AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS state FROM h4),
        h6 AS (SELECT *, lag(state) OVER (PARTITION BY {k} ORDER BY t, event_id) AS was FROM h5)"""


def _absences(k: str, window: float, end: str = "last") -> str:
    cols = k.split(", ")
    return f"""z AS (SELECT {k}, max(t) AS last, arg_max(up, (t, event_id)) AS last_up, arg_max(since, (t, event_id)) AS last_since FROM h6 GROUP BY {k}),
        mk AS (SELECT *, lead(since) OVER (PARTITION BY {k} ORDER BY t) AS ended FROM h6 WHERE was IS NULL OR state <> was),
        ab AS (SELECT {', '.join('mk.' + c for c in cols)}, CASE WHEN was IS NULL THEN t ELSE greatest(since, t - {window}) END AS s,
            coalesce(ended, CASE WHEN last_up AND last_since < last THEN last_since END, {end}) AS e,
            was IS NULL OR (ended IS NULL AND NOT (last_up AND last_since < last)) AS edge FROM mk JOIN z ON {' AND '.join(f'mk.{c} = z.{c}' for c in cols)} WHERE state = 'A')"""


_SC = EV + ", sc AS (SELECT rec, event_id, t, value / 500 AS score FROM ev)"
_R6 = f"WITH {_SC}, {_states('sc', 'rec', '0.08', '0.03', 5000.0)}, {_absences('rec', 50000.0, 'greatest(last, last + CASE WHEN mk.rec % 2 = 0 THEN 30000 ELSE -5 END)')}"
_GREEDY = """m AS (SELECT rec, t, gap FROM {src}), k AS (
        SELECT rec, min(t) AS t FROM m GROUP BY rec
        UNION ALL SELECT m.rec, min(m.t) FROM k JOIN m ON m.rec = k.rec AND m.t >= k.t + m.gap AND m.t > k.t GROUP BY m.rec, k.t)"""
_TPL = """v AS (SELECT label AS rec, vec_id::DOUBLE AS t, embedding AS vec FROM embeddings), c AS (SELECT rec, i, avg(vec[i + 1]::DOUBLE) AS m FROM v, range(64) r(i) GROUP BY rec, i),
        hp AS (SELECT a.rec, a.i, CASE WHEN a.i % 8 IN (0, 7) OR a.i // 8 IN (0, 7) THEN 0.0 ELSE a.m - (l.m + r.m + u.m + d.m) / 4 END AS v FROM c a
            LEFT JOIN c l ON l.rec = a.rec AND l.i = a.i - 1 LEFT JOIN c r ON r.rec = a.rec AND r.i = a.i + 1 LEFT JOIN c u ON u.rec = a.rec AND u.i = a.i - 8 LEFT JOIN c d ON d.rec = a.rec AND d.i = a.i + 8),
        mask AS (SELECT rec, i FROM (SELECT rec, i, row_number() OVER (PARTITION BY rec ORDER BY -abs(round(v, 9)), i) AS n FROM hp WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6) WHERE n <= 12)"""
_LEVEL = "CASE WHEN {v} > 0 THEN greatest(0, least(255, round((20 * log10({v}) + 80) / 80 * 255)))::INTEGER ELSE 0 END"

ORACLE = {
    "r1_flat_runs": f"""WITH {EV}, a AS (SELECT *, lead(t) OVER w AS nxt, t - lag(t) OVER w AS gap, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS st
        FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t, event_id)), b AS (SELECT *, sum(st) OVER (PARTITION BY rec ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a),
        c AS (SELECT rec, island, event_type AS state, min(t) AS s, max(coalesce(nxt, t + coalesce(gap, 0))) AS e, max(t) AS last, count(*) AS pictures FROM b GROUP BY rec, island, event_type)
        SELECT rec, state, round(s, 6) AS start, round(e, 6) AS "end", round(last, 6) AS last, pictures FROM c WHERE pictures >= 2 AND e - s + 1e-9 >= 1000""",
    "r2_classify_flat": """WITH l AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(16, least(235, floor(v::DOUBLE * 300 + vec_id % 5 * 50 - 20)))::INTEGER) AS luma FROM embeddings)
        SELECT vec_id, CASE WHEN len(list_filter(luma, lambda v: v <= 37)) / 64 >= 0.6 THEN 'black' WHEN len(list_filter(luma, lambda v: v >= 125)) / 64 >= 0.6 THEN 'white' END AS shade FROM l""",
    "r3_silence": f"""WITH {EV}, l AS (SELECT rec, t + 1 AS f, t + 4 AS z FROM ev WHERE value >= 150 UNION ALL SELECT rec, max(t + 10), NULL FROM ev GROUP BY rec),
        s AS (SELECT rec, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE lag(z) OVER w END AS s, f AS e FROM l WINDOW w AS (PARTITION BY rec ORDER BY f, z NULLS LAST))
        SELECT rec, round(s, 6) AS start, round(e, 6) AS "end" FROM s WHERE e - s + 1e-9 >= 90000""",
    "r3_loud_bounds": f"""WITH l AS (SELECT vec_id, list_filter(range(0, 64), lambda i: abs((embedding[i + 1] * (vec_id % 3) / 60)::DOUBLE) > {10 ** -2.5!r}) AS p FROM embeddings)
        SELECT vec_id, round(vec_id * 2.0 + p[1] / 100, 6) AS loud_first, round(vec_id * 2.0 + (p[len(p)] + 1) / 100, 6) AS loud_last FROM l""",
    "r4_monotone": f"""WITH {EV} SELECT rec, event_id, round(t, 6) AS t FROM (SELECT *, max(t) OVER (PARTITION BY rec ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev)
        WHERE reach IS NULL OR t > reach""",
    "r5_debounce": f"""WITH RECURSIVE {EV}, src AS (SELECT rec, t, 100000.0 AS gap FROM ev WHERE event_type = 'error'), {_GREEDY.format(src='src')}
        SELECT rec, round(t, 6) AS t FROM k WHERE rec IN (SELECT rec FROM k GROUP BY rec HAVING count(*) >= 3)""",
    "r5b_dedup_adjacent": f"WITH {EV} SELECT rec, event_id, round(t, 6) AS t FROM (SELECT *, lag(t) OVER (PARTITION BY rec ORDER BY t, event_id) AS p FROM ev) WHERE p IS NULL OR t - p > 5000",
    "r6_hysteresis": f"{_R6} SELECT rec, round(s, 6) AS start, round(e, 6) AS \"end\", edge FROM ab",
    "r6_transitions": f"{_R6} SELECT rec, count(*) FILTER (was IS NOT NULL AND state <> was) AS transitions FROM h6 GROUP BY rec",
    "r7_split_absences": f"""{_R6}, kd AS (SELECT *, CASE WHEN e - s >= CASE WHEN edge THEN 10000 ELSE 200000 END THEN 'long' WHEN e - s >= 50000 THEN 'brief' END AS kind FROM ab)
        SELECT rec, round(s, 6) AS start, edge, kind FROM kd WHERE kind IS NOT NULL""",
    "r8_outline": f"""WITH {EV}, b AS (SELECT rec, floor(t / 86400)::BIGINT AS bucket, max(value / 500) AS top, sqrt(avg((value / 500) * (value / 500))) AS mean FROM ev WHERE t >= 0 GROUP BY rec, bucket),
        f AS (SELECT rec, unnest(range(0, max(bucket) + 1)) AS bucket FROM b GROUP BY rec)
        SELECT rec, bucket, coalesce({_LEVEL.format(v='top')}, 0) AS peak, coalesce({_LEVEL.format(v='mean')}, 0) AS rms FROM f LEFT JOIN b USING (rec, bucket)""",
    "r9_thin": f"""WITH RECURSIVE {EV}, g AS (SELECT rec, CASE WHEN sum(value) <= 4000 THEN 0 ELSE (max(t) - min(t)) * avg(value) / 4000 END AS gap FROM ev GROUP BY rec),
        src AS (SELECT ev.rec, ev.t, gap FROM ev JOIN g USING (rec)), {_GREEDY.format(src='src')} SELECT rec, round(t, 6) AS t FROM k""",
    "r10_change": """WITH v AS (SELECT label AS rec, vec_id::DOUBLE AS t, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
        SELECT rec, t, CASE WHEN b IS NOT NULL THEN round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i]::DOUBLE - b[i]::DOUBLE))) / 64, 6) END AS diff FROM v""",
    "r11_scenes": f"""WITH {EV}, d AS (SELECT rec, t, value / 500 AS diff FROM ev), md AS (SELECT rec, diff AS m FROM (SELECT rec, diff, row_number() OVER (PARTITION BY rec ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM d) WHERE i = n // 2),
        p AS (SELECT d.*, greatest(1, floor((SELECT max(t) FROM ev e WHERE e.rec = d.rec) / 300000)) AS cap, count(*) OVER (PARTITION BY rec) AS n, row_number() OVER (PARTITION BY rec ORDER BY diff DESC, t) AS i
            FROM d JOIN md USING (rec) WHERE diff >= greatest(1.5 * m, 0.055)),
        q AS (SELECT *, CASE WHEN n > cap THEN max(CASE WHEN i = cap THEN diff END) OVER (PARTITION BY rec) END AS lim FROM p)
        SELECT rec, round(t, 6) AS t, round(diff, 6) AS diff FROM q WHERE lim IS NULL OR diff >= lim""",
    "r12_template": f"WITH {_TPL} SELECT rec, i::INTEGER AS i, round(m, 6) + 0.0 AS v FROM c",
    "r13_highpass": f"WITH {_TPL} SELECT rec, i::INTEGER AS i, round(v, 6) + 0.0 AS v, kk IS NOT NULL AS kept FROM hp LEFT JOIN (SELECT rec, i, 1 AS kk FROM mask) USING (rec, i)",
    "r14_cluster": f"""WITH RECURSIVE {_TPL}, reach AS (SELECT rec, i AS a, i AS b FROM mask UNION SELECT r.rec, r.a, m.i FROM reach r JOIN mask m ON m.rec = r.rec AND abs(m.i % 8 - r.b % 8) <= 1 AND abs(m.i // 8 - r.b // 8) <= 1),
        l AS (SELECT rec, a, min(b) AS label FROM reach GROUP BY rec, a), s AS (SELECT *, count(*) OVER (PARTITION BY rec, label) AS n FROM l),
        w AS (SELECT rec, arg_min(label, (-n, label)) AS label FROM s GROUP BY rec)
        SELECT s.rec, (s.a % 8)::INTEGER AS x, (s.a // 8)::INTEGER AS y, n FROM s JOIN w USING (rec, label)""",
    "r15_score": f"""WITH {_TPL}, ro AS (SELECT rec, t, i, avg(x) OVER (PARTITION BY rec, i ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM (SELECT rec, t, i, vec[i + 1]::DOUBLE AS x FROM v, range(64) r(i))),
        h2 AS (SELECT a.rec, a.t, a.i, CASE WHEN a.i % 8 IN (0, 7) OR a.i // 8 IN (0, 7) THEN 0.0 ELSE a.m - (l.m + r.m + u.m + d.m) / 4 END AS v FROM ro a JOIN mask k ON k.rec = a.rec AND k.i = a.i
            LEFT JOIN ro l ON l.rec = a.rec AND l.t = a.t AND l.i = a.i - 1 LEFT JOIN ro r ON r.rec = a.rec AND r.t = a.t AND r.i = a.i + 1 LEFT JOIN ro u ON u.rec = a.rec AND u.t = a.t AND u.i = a.i - 8 LEFT JOIN ro d ON d.rec = a.rec AND d.t = a.t AND d.i = a.i + 8)
        SELECT h2.rec, h2.t, round(CASE WHEN sum(h2.v * h2.v) > 0 AND sum(hp.v * hp.v) > 0 THEN sum(h2.v * hp.v) / sqrt(sum(h2.v * h2.v) * sum(hp.v * hp.v)) ELSE 0 END, 6) + 0.0 AS score
        FROM h2 JOIN hp ON hp.rec = h2.rec AND hp.i = h2.i GROUP BY h2.rec, h2.t""",
    "r15_ring": f"""WITH {EV}, g AS (SELECT rec, lead(t) OVER (PARTITION BY rec ORDER BY t) - t AS gap FROM ev),
        md AS (SELECT rec, gap AS m FROM (SELECT rec, gap, row_number() OVER (PARTITION BY rec ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM g WHERE gap IS NOT NULL) WHERE i = n // 2)
        SELECT rec, greatest(2, least(64, round(400000.0 / m)))::INTEGER AS ring FROM md""",
    "r16_corner": f"""WITH {EV}, s0 AS (SELECT rec, event_type AS corner, event_id, t, value / 500 AS score FROM ev),
        md AS (SELECT rec, corner, score AS m FROM (SELECT *, row_number() OVER (PARTITION BY rec, corner ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY rec, corner) AS n FROM s0) WHERE i = n // 2),
        sc AS (SELECT s0.*, greatest(0.4 * m, 0.01) AS pr, greatest(0.15 * m, 0.004) AS ab FROM s0 JOIN md USING (rec, corner)), {_states('sc', 'rec, corner', 'pr', 'ab', 1000.0)}, {_absences('rec, corner', 100000.0)},
        f AS (SELECT rec, corner, avg(CASE WHEN score >= pr THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n, count(*) FILTER (was IS NOT NULL AND state <> was) AS transitions FROM h6 GROUP BY rec, corner),
        bk AS (SELECT rec, corner, count(*) AS breaks FROM ab GROUP BY rec, corner),
        ty AS (SELECT rec, corner, d AS typical FROM (SELECT rec, corner, e - s AS d, row_number() OVER (PARTITION BY rec, corner ORDER BY e - s) - 1 AS i, count(*) OVER (PARTITION BY rec, corner) AS n FROM ab) WHERE i = n // 2),
        gd AS (SELECT f.*, row_number() OVER (PARTITION BY rec ORDER BY transitions, share DESC, corner) AS i FROM f LEFT JOIN bk USING (rec, corner) LEFT JOIN ty USING (rec, corner)
            WHERE f.n >= 5 AND share >= 0.5 AND coalesce(breaks, 0) <= 12 AND (typical IS NULL OR typical >= 30))
        SELECT rec, corner, transitions, round(share, 6) AS share FROM gd WHERE i = 1""",
}
