"""Capacity, catalogue and verification queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..operators import capacity as cap
from ..operators import catalogue as cat
from ..operators import verify as v
from ..operators.intervals import merge_intervals
from .common import EV, events, r, table

#: Codecs and families stand for return flags and brands, so that tables of codes have rows to meet.
CODECS = ("mpeg2video", "h264", "aac", "ac3", "flac", "vp9", "pcm_s8", "pcm_s16le", "pcm_s16be", "alac", "opus")
FAMILIES = ("ts", "mp4", "ps", "mov", "webm", "mkv", "avi", "ogm")
TRACK_CODECS = ("aac", "ac3", "mp2", "pcm_s16be", "flac", "dts", "aac_latm", "pcm_dvd", "atrac9")


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _sql_pick(column: str, values) -> str:
    return f"[{', '.join(repr(x) for x in values)}][({column} % {len(values)} + 1)::INTEGER]"


def _tracks(spark, sf):
    li = table(spark, sf, "lineitem")
    codec = _pick(F.col("l_partkey"), TRACK_CODECS)
    sk = F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("rec"), codec.alias("codec"), F.when(F.col("l_quantity") > 10, (F.col("l_quantity") - 12) * 4000).alias("rate"), (F.col("l_linenumber") % 3 + 1).alias("channels"),
        F.lit(48000).alias("sample_rate"), _pick(F.col("l_linenumber"), (8, 16, 20, 24)).alias("bits"), F.when(F.col("l_linenumber") % 2 == 0, 90000).alias("clock"),
        (F.col("l_returnflag") == "R").alias("drop"), F.when(F.col("l_returnflag") == "A", _pick(sk, ("aac", "lpcm", "ac3"))).alias("to_codec"), F.when(sk % 5 == 0, 192000).alias("to_rate"),
        F.when(sk % 4 == 0, 1).alias("to_channels"), F.when(sk % 7 == 0, 44100).alias("to_sample_rate"), F.when(sk % 6 == 0, 24).alias("to_bits"),
    )


def c1_rates(spark, sf):
    recs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("video_rate"), (F.col("o_totalprice") * 2).alias("file_rate"), _pick(F.col("o_custkey"), ("mpeg2video", "h264")).alias("codec"))
    return cap.rates(recs, _tracks(spark, sf)).select("rec", r("video"), r("audio"), "can_shrink")


def c1_holes(spark, sf):
    """Rates of recordings of a thousand seconds, of which each line of an order leaves some unwritten; some have no length."""
    o = table(spark, sf, "orders")
    recs = o.select(F.col("o_orderkey").alias("rec"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("video_rate"), (F.col("o_totalprice") * 2).alias("file_rate"), F.lit("h264").alias("codec"), F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(1000.0).alias("duration"))
    holes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), (F.col("l_linenumber") * 150.0 - 200).alias("start"), (F.col("l_linenumber") * 150.0 - 200 + F.col("l_quantity") * 5).alias("end"))
    return cap.rates(recs, _tracks(spark, sf), holes=holes).select("rec", r("video"), r("audio"))


def c1_as_written(spark, sf):
    return cap.rates_as_written(_tracks(spark, sf)).select("rec", r("audio"))


def c1_as_written_ts(spark, sf):
    return cap.rates_as_written(_tracks(spark, sf), to_ts=True).select("rec", r("audio"))


def _estimates(spark, sf, disc=True):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 600).alias("disc"), (F.col("o_totalprice") / 50).alias("seconds"), F.lit(6000000.0).alias("video"), F.lit(192000.0).alias("audio"), F.when(F.col("o_orderstatus") == "F", 1000000.0).alias("busier"), (F.col("o_orderpriority") < "3").alias("can_shrink"))
    return cap.estimate_size(o, disc)


def c2_estimate_disc(spark, sf):
    return _estimates(spark, sf).select("o_orderkey", "bytes", "video_bytes")


def c2_estimate_file(spark, sf):
    return _estimates(spark, sf, False).select("o_orderkey", "bytes", "video_bytes")


def c3_fit(spark, sf):
    return cap.fit_discs(_estimates(spark, sf)).select("disc", "name", "bytes", "video_bytes", "usable", "fits", r("share"), "reachable")


def c3_disc_holds(spark, sf):
    """Parts as discs: some are written as overwritable images, which hold less."""
    p = table(spark, sf, "part")
    capacity = (F.col("p_retailprice") * 1000000).cast("long")
    return p.select("p_partkey", cap.disc_holds(capacity, F.col("p_size") % 2 == 0, 1200000000, 1350000000, 1500000000).alias("holds"))


def m1_series_title(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(_pick(k, ("", "[字]", "＜アニメ枠＞", "アニメA・", "【新】")), F.replace(F.col("c_name"), F.lit("#"), F.lit(" No")), _pick(k, (" #12 Snow", " 第３話「雪」", "（４）", " ep.5", " 第十二回", "「雪」", "＜再＞")))
    title = titles.series_title(name)
    return c.select("c_custkey", title.alias("title"))


def m2_shared_title(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("group"), F.col("c_custkey").alias("n"), F.concat(_pick(F.col("c_custkey") % 10, ("Sea", "Ｓｅａ", "Hill ")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(""), F.when(F.col("c_custkey") % 10 < 2, F.col("c_name")).otherwise("")).alias("name"))
    return cat.shared_title(c)


def m3_channel(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", titles.channel_number(F.col("p_partkey"), F.when(F.col("p_size") > 10, F.col("p_size"))).cast("long").alias("channel"))


def m4_began(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.concat_ws("-", F.lit("2024"), (k % 14).cast("string"), (k % 33).cast("string"))
    text = F.concat(text, F.lit(" "), (k % 25).cast("string"), F.lit(":"), (k % 61).cast("string"), F.when(k % 2 == 0, ":5").otherwise(""))
    b = titles.parse_began(text)
    return o.select("o_orderkey", *[F.coalesce(b[c], F.lit(-1)).alias(c) for c in ("month", "day", "hour", "minute", "second")])


def _sections(spark, sf):
    ev = events(spark, sf)
    return ev.select("rec", (F.lit(0x4E) + F.pmod("event_id", F.lit(4))).alias("table_id"), F.col("event_type").alias("service_id"), "t", "event_id", (F.col("value") > 40).alias("current"), F.floor(F.col("t") / 900000).alias("version"), F.lit(3).alias("last_no"), F.pmod("event_id", F.lit(3)).alias("section_no"))


def m5_latest_sections(spark, sf):
    return cat.latest_sections(_sections(spark, sf)).select("rec", "table_id", "service_id", "section_no", "event_id")


def m6_summary(spark, sf):
    ev = events(spark, sf).select("rec", "t", F.when(F.col("value") > 100, F.col("event_type")).alias("name"), F.when(F.col("value") > 300, F.round("value", 2)).alias("number"), F.when(F.col("value") < 50, F.col("event_id")).alias("ran"))
    return cat.programme_summary(ev, ("name", "number", "ran"), placeholders=("view", "click"))


def m6_events_at(spark, sf):
    s = events(spark, sf)
    return cat.events_at(s.filter("event_type = 'click'").select("rec", F.col("event_id").alias("id"), "t"), s.filter("event_type = 'view'"), "rec").select("rec", "id", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def m6_own_schedule(spark, sf):
    return cat.own_schedule(_sections(spark, sf).withColumn("own_service", F.lit("view"))).select("rec", "event_id", "table_id")


def m7_sound_names(spark, sf):
    ev = events(spark, sf)
    named = ev.select("rec", (F.col("event_type") == "purchase").alias("on_air"), F.col("event_id").alias("n"), F.concat(F.lit("d"), "event_id").alias("description"), F.array("event_type", F.when(F.col("value") > 250, "loud").otherwise("low")).alias("names"))
    tags = ev.select("rec").distinct().withColumn("wanted", F.array(F.when(F.col("rec") % 2 == 0, "loud").otherwise("low")))
    return cat.sound_track_names(named, tags)


def _parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 50).alias("group"), F.col("p_partkey").alias("rec"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("scan"), F.col("p_retailprice").alias("rate"))


def _diffs(spark, sf):
    p = _parts(spark, sf)
    return cat.conform_diff(p.filter("rec <= 50"), p, ("brand", "type", "scan"), {"rate": 0.05})


def m8_conform(spark, sf):
    return _diffs(spark, sf).select("rec", "what", F.when(F.col("what") != "rate", F.col("master")).alias("master"), F.when(F.col("what") != "rate", F.col("theirs")).alias("theirs"))


def _track_rows(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("codec"), F.max("l_quantity").alias("q"))
    return li.select(F.floor(F.col("l_orderkey") / 8).alias("group"), F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("track"), "codec", F.when(F.col("q") > 10, F.col("q").cast("int") % 3).alias("channels"))


def _track_diffs(spark, sf):
    rows = _track_rows(spark, sf)
    first = rows.groupBy("group").agg(F.min("rec").alias("rec"))
    return cat.conform_tracks(rows.join(first, ["group", "rec"]), rows)


def m8_tracks(spark, sf):
    return _track_diffs(spark, sf).fillna(0, ["track"])


def m9_actions(spark, sf):
    acts = cat.conform_actions(_diffs(spark, sf), _track_diffs(spark, sf))
    return acts.select("rec", "video", F.size("audio").alias("n_audio"), F.array_join(F.col("audio").cast("array<string>"), ",").alias("audio"))


def m10_container(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _pick(F.col("l_partkey"), CODECS).alias("codec"), _pick(F.col("l_suppkey"), FAMILIES).alias("family"))
    return cat.container_holds(rows).groupBy("codec", "family", "holds").agg(F.count(F.lit(1)).alias("n"))


def m11_selection(spark, sf):
    rows = events(spark, sf).select("rec", F.col("event_id").alias("n"), (F.floor(F.col("value") / 50) * F.when(F.col("rec") % 2 == 0, 60.0).otherwise(20.0)).alias("length"), (F.col("rec") % 7 == 0).alias("recorded"))
    return cat.default_selection(rows, recorded="recorded").select("rec", "n", "chosen")


def m12_marks(spark, sf):
    ev = events(spark, sf)
    items = ev.select("rec", F.pmod("event_id", F.lit(4)).alias("item"), "t").groupBy("rec", "item").agg(F.min("t").alias("start"), (F.max("t") - 200000).alias("end"))
    marks = ev.select("rec", F.pmod("event_id", F.lit(4)).alias("item"), F.floor("t").cast("double").alias("t"))
    return cat.place_marks(marks, items, slack=5000.0).select("rec", "item", r("at"))


def _hashes(spark, sf, shift):
    w = table(spark, sf, "conversations").select(F.col("conv_id").alias("rec"), (F.col("turn") + shift * F.pmod("conv_id", F.lit(4)).cast("int")).cast("int").alias("pos"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return w


def v1_align(spark, sf):
    return v.align_hashes(_hashes(spark, sf, 0), _hashes(spark, sf, 1).filter("pos % 7 < 6"))


def _pairs(spark, sf):
    ev = events(spark, sf)
    out = F.when(F.col("value") > 300, None).when(F.col("value") > 200, "x").otherwise(F.col("event_type"))
    return ev.select("rec", F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "copy").otherwise("reencode").alias("kind"), F.col("event_type").alias("src_hash"), out.alias("out_hash"), F.when(F.col("event_type") != "view", 25 + F.col("value") / 10 - F.when(F.col("event_id") % 100 == 0, 20).otherwise(0)).alias("psnr"), (F.pmod("event_id", F.lit(17)) == 0).alias("damaged"))


def v2_report(spark, sf):
    return v.verify_report(_pairs(spark, sf)).withColumn("worst", r("worst"))


def v3_psnr(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 100).alias("a"))
    other = e.select((F.col("vec_id") - F.pmod("vec_id", F.lit(3))).alias("partner"), "vec_id", "a")
    both = other.join(e.select(F.col("vec_id").alias("partner"), F.col("a").alias("b")), "partner")
    return both.select("vec_id", r(v.grid_psnr(F.col("a"), F.col("b")), 3).alias("psnr"), (v.picture_hash(F.col("a").cast("string")) == v.picture_hash(F.col("b").cast("string"))).alias("same"))


def v4_after_damage(spark, sf):
    return v.after_damage(_pairs(spark, sf)).select("rec", "pos", "excused")


def v5_track_length(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("length"), F.lit(2.5).alias("pictures"), (F.col("l_discount") * 40).alias("last_stamp"))
    return v.track_length_off(rows, allowed=0.5).groupBy("l_orderkey", "off").agg(F.count(F.lit(1)).alias("n"))


def v6_kept_fits(spark, sf):
    ev = events(spark, sf)
    # one recording of four tells no holes of its output, one of six none of its source
    out = ev.groupBy("rec").agg(F.sum("value").alias("seconds"), F.when(F.col("rec") % 4 > 0, F.min("value")).alias("holes"))
    kept = ev.groupBy("rec").agg((F.sum("value") - F.col("rec") % 5 * 200 + 300).alias("to"), F.lit(0.0).alias("from"), F.when(F.col("rec") % 6 > 0, F.max("value") / 2000).alias("source_holes"))
    return v.kept_fits(out, kept)


def v7_best_lag(spark, sf):
    ev = events(spark, sf).groupBy("rec", F.floor(F.col("t") / 86400).alias("bucket")).agg(F.max("value").alias("level"))
    # a middle part of each series is looked for in the whole one, moved and a little changed
    moved = ev.select("rec", (F.col("bucket") + F.pmod("rec", F.lit(5)) - 2).alias("bucket"), (F.col("level") * (1 + F.pmod("bucket", F.lit(3)) / 10)).alias("level"))
    return v.best_lag(ev.filter("bucket BETWEEN 4 AND 26"), moved, search=4).select("rec", F.col("lag").cast("long").alias("lag"), r("corr"))


def _wide(spark, sf):
    return merge_intervals(events(spark, sf).filter("event_type = 'purchase'").select("rec", F.col("t").alias("start"), (F.col("t") + 80000).alias("end")))


def v8_markers(spark, sf):
    from ..operators.clocks import source_to_output

    ev = events(spark, sf).filter("event_type = 'view'").select("rec", "event_id", "t")
    got = source_to_output(ev, _wide(spark, sf)).filter("out IS NOT NULL AND event_id % 5 > 0").select("rec", (F.col("out") + F.pmod("event_id", F.lit(3)) * 4.0).alias("t"))
    return v.marker_alignment(ev, got, _wide(spark, sf), guard=500.0, reach=6.0, bucket=100000.0).select("rec", "markers", "missing", r("worst"))


def v9_carried(spark, sf):
    """Ranges with rows moved unevenly, with look-back rows equal to the range's first row, and with strange rows ahead of them."""
    ev = events(spark, sf).filter("event_type = 'click'").select("rec", "event_id", "t", F.col("event_id").alias("hash"), F.floor(F.col("value") / 20).alias("size"))
    keeps = _wide(spark, sf).withColumn("range", F.col("start"))
    own = keeps.select("rec", "range", F.col("start").alias("s"), F.col("end").alias("e"))
    out = ev.join(own, "rec").filter("t >= s AND t < e").select("rec", "range", (F.col("t") - F.col("s") + F.when((F.col("event_id") % 9 == 0) & (F.col("rec") % 2 == 0), 1.0).otherwise(0.0)).alias("t"), "hash", "size")
    first = out.groupBy("rec", "range").agg(F.min(F.struct("t", "hash", "size")).alias("f"))
    kind = F.floor("range") % 4
    again = first.filter(kind > 0).select("rec", "range", (F.col("f.t") - 0.5).alias("t"), F.when(kind == 3, -1).otherwise(F.col("f.hash")).alias("hash"), F.when(kind == 2, F.col("f.size") + 1000).otherwise(F.col("f.size")).alias("size"))
    return v.carried_rows_check(ev, out.unionByName(again), keeps, bucket=100000.0, look_back=200000.0).select("rec", r("range"), "rows", "arrived", r("drift"), "passed")


def v10_quietest(spark, sf):
    return v.quietest_step(events(spark, sf).select("rec", "t", (-F.floor("value")).alias("db"))).select("rec", r("t"))


def v10_fade(spark, sf):
    ev = events(spark, sf)
    levels = ev.select("rec", "t", (-F.col("value") / 10).alias("db"))
    seams = ev.filter("event_type = 'purchase'").select("rec", "t", F.lit(30000.0).alias("fade"), F.lit(-20.0).alias("level"))
    return v.fade_envelope_check(levels, seams, quiet=-30.0, burst=-5.0, near=20000.0, outside=18.0, bucket=130000.0).select("rec", r("seam"), r("at_seam"), r("loudest"), r("away"), "passed")


QUERIES = [c1_rates, c1_holes, c1_as_written, c1_as_written_ts, c2_estimate_disc, c2_estimate_file, c3_fit, c3_disc_holds, m1_series_title, m2_shared_title, m3_channel, m4_began, m5_latest_sections, m6_summary, m6_events_at, m6_own_schedule, m7_sound_names, m8_conform, m8_tracks, m9_actions, m10_container, m11_selection, m12_marks, v1_align, v2_report, v3_psnr, v4_after_damage, v5_track_length, v6_kept_fits, v7_best_lag, v8_markers, v9_carried, v10_fade, v10_quietest]

def _per(codec: str) -> str:
    return f"CASE {codec} WHEN 'aac' THEN 96000 WHEN 'aac_latm' THEN 96000 WHEN 'ac3' THEN 96000 WHEN 'mp2' THEN 128000 WHEN 'flac' THEN 400000 WHEN 'dts' THEN 256000 ELSE 0 END"


# a stated rate above 0 counts, unless it is an AAC rate read off frames and under half of the codec's; then the codec's; then the samples'
_TR = f"""t0 AS (SELECT l_orderkey AS rec, l_suppkey AS sk, l_linenumber AS ln, l_returnflag AS fl, {_sql_pick('l_partkey', TRACK_CODECS)} AS codec, CASE WHEN l_quantity > 10 THEN (l_quantity - 12) * 4000 END AS rate,
        l_linenumber % 3 + 1 AS ch, [8, 16, 20, 24][l_linenumber % 4 + 1] AS bits FROM lineitem),
    t1 AS (SELECT *, {_per('codec')} * ch AS worth, codec = 'aac_latm' OR (codec = 'aac' AND ln % 2 = 0) AS probed FROM t0),
    tr AS (SELECT *, CASE WHEN rate > 0 AND NOT (probed AND rate < worth // 2) THEN rate WHEN worth > 0 THEN worth ELSE 48000 * ch * greatest(bits, 16) END::DOUBLE AS own FROM t1)"""


def _written(ts: bool) -> str:
    pair = lambda n: f"({n} + {n} % 2)" if ts else f"({n})"
    dvd = f"WHEN codec = 'pcm_dvd' THEN 48000 * {pair('ch')} * CASE WHEN bits > 16 THEN 24 ELSE 16 END" if ts else ""
    return f"""WITH {_TR}, w AS (SELECT *, CASE WHEN fl = 'A' THEN ['aac', 'lpcm', 'ac3'][(sk % 3 + 1)::INTEGER] END AS tc, CASE WHEN sk % 5 = 0 THEN 192000 END AS rt, CASE WHEN sk % 4 = 0 THEN 1 ELSE ch END AS nc, CASE WHEN sk % 7 = 0 THEN 44100 ELSE 48000 END AS sr, CASE WHEN sk % 6 = 0 THEN 24 ELSE bits END AS nb FROM tr),
        x AS (SELECT *, coalesce(tc, codec) AS target, coalesce(tc, codec) = 'lpcm' OR coalesce(tc, codec) LIKE 'pcm%' AS pcm FROM w),
        y AS (SELECT *, NOT (codec = 'dts' AND tc IS NULL) AND (target <> codec OR nc <> ch OR sr <> 48000 OR rt IS NOT NULL OR (pcm AND nb <> bits)) AS again FROM x)
        SELECT rec, round(sum(CASE WHEN fl = 'R' THEN 0 WHEN NOT again THEN CASE {dvd} WHEN true THEN own END WHEN pcm THEN sr * {pair('nc')} * greatest(nb, 16) WHEN rt IS NOT NULL THEN rt
            WHEN target <> codec THEN {_per('target')} * nc WHEN nc <> ch THEN greatest(own * nc / ch, 128000) ELSE own END::DOUBLE), 6) AS audio FROM y GROUP BY rec"""


def _est(disc: bool) -> str:
    fr = 1.056 if disc else 1.056 * 188 / 192
    snd = 1.2 if disc else 1.4 * 188 / 192
    whole = f"floor(px * {fr!r} + 192000.0 / 8 * s * {snd!r} + 19968 * s)::BIGINT + floor(s * 10)::BIGINT + 4096 + 98304" if disc else f"floor((px * {fr!r} + 192000.0 / 8 * s * {snd!r}) * 1.007)::BIGINT"
    return f"""es AS (SELECT *, {whole} AS bytes, floor(px * {fr!r})::BIGINT AS video_bytes FROM (
        SELECT o_orderkey, o_custkey % 600 AS disc, o_totalprice / 50 AS s, 6000000.0::DOUBLE / 8 * (o_totalprice / 50) + CASE WHEN o_orderstatus = 'F' THEN 1000000.0 ELSE 0 END AS px, o_orderpriority < '3' AS sh FROM orders))"""


_DISCS = ", ".join(f"('{n}', {b})" for n, b in cap.DISCS)
_PT = "pt AS (SELECT p_partkey % 50 AS g, p_partkey AS rec, CASE WHEN p_size > 5 THEN p_brand END AS brand, p_type AS type, p_size AS scan, p_retailprice AS rate FROM part)"
_DF = _PT + """, df AS (SELECT c.rec, w.what, CASE w.what WHEN 'brand' THEN m.brand WHEN 'type' THEN m.type WHEN 'scan' THEN m.scan::VARCHAR END AS master, CASE w.what WHEN 'brand' THEN c.brand WHEN 'type' THEN c.type WHEN 'scan' THEN c.scan::VARCHAR END AS theirs
    FROM pt c JOIN pt m ON m.g = c.g AND m.rec <= 50, (VALUES ('brand'), ('type'), ('scan'), ('rate')) w(what) WHERE coalesce(CASE w.what WHEN 'brand' THEN c.brand <> m.brand WHEN 'type' THEN c.type <> m.type WHEN 'scan' THEN c.scan <> m.scan ELSE abs(c.rate - m.rate) > 0.05 * abs(m.rate) END, false))"""
_TD = """tk AS (SELECT l_orderkey // 8 AS g, l_orderkey AS rec, l_linenumber AS track, max(l_returnflag) AS codec, CASE WHEN max(l_quantity) > 10 THEN max(l_quantity)::INTEGER % 3 END AS channels FROM lineitem GROUP BY l_orderkey, l_linenumber),
    mt AS (SELECT tk.* FROM tk JOIN (SELECT g, min(rec) AS rec FROM tk GROUP BY g) USING (g, rec)), cn AS (SELECT g, rec, count(*) AS n FROM tk GROUP BY g, rec),
    td AS (SELECT c.rec, c.track::INTEGER AS track, 'codec' AS what FROM tk c JOIN mt m USING (g, track) WHERE c.codec <> m.codec UNION ALL SELECT c.rec, c.track, 'channels' FROM tk c JOIN mt m USING (g, track) WHERE c.channels <> m.channels
        UNION ALL SELECT c.rec, NULL, 'tracks' FROM cn c JOIN (SELECT g, count(*) AS n FROM mt GROUP BY g) m USING (g) WHERE c.n <> m.n)"""
_SEC = EV + ", se AS (SELECT rec, 78 + event_id % 4 AS table_id, event_type AS service_id, t, event_id, value > 40 AS cur, floor(t / 900000)::BIGINT AS ver, event_id % 3 AS section_no FROM ev)"
_PR = EV + ", pr AS (SELECT rec, event_id AS pos, event_type = 'view' AS cp, event_type AS s, CASE WHEN value > 300 THEN NULL WHEN value > 200 THEN 'x' ELSE event_type END AS o, CASE WHEN event_type <> 'view' THEN 25 + value / 10 - CASE WHEN event_id % 100 = 0 THEN 20 ELSE 0 END END AS psnr, event_id % 17 = 0 AS dmg FROM ev)"
_KW = EV + """, wd AS (SELECT rec, t AS s, t + 80000 AS e FROM ev WHERE event_type = 'purchase'), km AS (SELECT rec, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wd)) GROUP BY rec, g),
    ko AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, lead(s) OVER (PARTITION BY rec ORDER BY s) IS NULL AS final FROM km)"""

ORACLE = {
    "c1_rates": f"""WITH {_TR} SELECT o_orderkey AS rec, round(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN o_totalprice ELSE o_totalprice * 2 * 0.9 END, 6) AS video, round(coalesce(a, 0), 6) AS audio, o_custkey % 2 = 0 AS can_shrink
        FROM orders LEFT JOIN (SELECT rec, sum(own) AS a FROM tr GROUP BY rec) x ON x.rec = o_orderkey""",
    "c1_holes": f"""WITH {_TR}, h AS (SELECT l_orderkey AS rec, greatest(l_linenumber * 150 - 200, 0)::DOUBLE AS s, least(l_linenumber * 150 - 200 + l_quantity * 5, 1000)::DOUBLE AS e FROM lineitem),
        g AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h WHERE e > s), l AS (SELECT rec, sum(greatest(e - greatest(s, coalesce(reach, s)), 0)) AS lost FROM g GROUP BY rec)
        SELECT o_orderkey AS rec, round(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN o_totalprice ELSE o_totalprice * 2 * 0.9 END * CASE WHEN o_orderkey % 9 > 0 AND lost < 1000 THEN 1000 / (1000 - lost) ELSE 1 END, 6) AS video, round(coalesce(a, 0), 6) AS audio
        FROM orders LEFT JOIN (SELECT rec, sum(own) AS a FROM tr GROUP BY rec) x ON x.rec = o_orderkey LEFT JOIN l ON l.rec = o_orderkey""",
    "c1_as_written": _written(False),
    "c1_as_written_ts": _written(True),
    "c3_disc_holds": """WITH p AS (SELECT p_partkey, floor(p_retailprice * 1000000)::BIGINT AS c, p_size % 2 = 0 AS image FROM part)
        SELECT p_partkey, CASE WHEN NOT image THEN c WHEN c >= 1500000000 THEN 1350000000 ELSE least(c, 1200000000) END AS holds FROM p""",
    "v10_quietest": f"WITH {EV} SELECT rec, round(min(t), 6) AS t FROM (SELECT *, floor(value) = max(floor(value)) OVER (PARTITION BY rec) AS least FROM ev) WHERE least GROUP BY rec",
    "c2_estimate_disc": f"WITH {_est(True)} SELECT o_orderkey, bytes, video_bytes FROM es",
    "c2_estimate_file": f"WITH {_est(False)} SELECT o_orderkey, bytes, video_bytes FROM es",
    "c3_fit": f"""WITH {_est(True)}, s AS (SELECT disc, (sum(bytes) + 1048576)::BIGINT AS bytes, coalesce(sum(video_bytes) FILTER (sh), 0)::BIGINT AS video_bytes FROM es GROUP BY disc),
        d AS (SELECT s.*, name, floor(cap * 0.99)::BIGINT AS usable FROM s, (VALUES {_DISCS}) v(name, cap)),
        x AS (SELECT *, bytes <= usable AS fits, CASE WHEN video_bytes > 0 THEN greatest(usable - (bytes - video_bytes), 0) / video_bytes ELSE 0 END AS raw FROM d)
        SELECT disc, name, bytes, video_bytes, usable, fits, round(CASE WHEN fits THEN 1 ELSE least(1, raw) END, 6) AS share, fits OR raw >= 0.35 AS reachable FROM x""",
    "m1_series_title": "SELECT c_custkey, replace(c_name, '#', ' No') AS title FROM customer",
    "m2_shared_title": """WITH c AS (SELECT c_custkey % 10 AS g, c_custkey AS n, ['Sea', 'Sea', 'Hill'][(c_custkey % 10 % 3 + 1)::INTEGER] AS base, c_custkey % 10 < 2 AS own, c_custkey % 3 = 0 AS num, c_name FROM customer),
        s AS (SELECT g, count(*) AS n, bool_or(own) AS own, count(DISTINCT CASE WHEN num THEN n ELSE -1 END) AS kinds, count(*) FILTER (num) AS nums, min(n) AS first, any_value(base) AS base, min(c_name) AS cn FROM c GROUP BY g)
        SELECT g AS "group", CASE WHEN own AND n = 1 THEN NULL WHEN own THEN NULL WHEN g % 3 = 1 THEN CASE WHEN kinds = 1 AND nums = 0 THEN 'Ｓｅａ' ELSE 'Ｓｅａ' END ELSE base END AS title FROM s""",
    "m3_channel": "SELECT p_partkey, (CASE WHEN p_partkey BETWEEN 100 AND 999 THEN p_partkey WHEN p_partkey >= 1000 AND p_size > 10 THEN p_size * 10 + (p_partkey & 7) + 1 ELSE 0 END)::BIGINT AS channel FROM part",
    "m4_began": """WITH x AS (SELECT o_orderkey, o_orderkey % 14 AS mo, o_orderkey % 33 AS d, o_orderkey % 25 AS h, o_orderkey % 61 AS mi, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS s FROM orders), y AS (SELECT *, mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h < 24 AND mi < 60 AS ok FROM x)
        SELECT o_orderkey, CASE WHEN ok THEN mo ELSE -1 END::INTEGER AS month, CASE WHEN ok THEN d ELSE -1 END::INTEGER AS day, CASE WHEN ok THEN h ELSE -1 END::INTEGER AS hour, CASE WHEN ok THEN mi ELSE -1 END::INTEGER AS minute, CASE WHEN ok THEN s ELSE -1 END::INTEGER AS second FROM y""",
    "m5_latest_sections": f"""WITH {_SEC}, c AS (SELECT *, max(ver) OVER (PARTITION BY rec, table_id, service_id) AS lv FROM se WHERE cur)
        SELECT rec, table_id, service_id, section_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY rec, table_id, service_id, section_no ORDER BY t DESC) AS i FROM c WHERE ver = lv) WHERE i = 1""",
    "m6_summary": f"""WITH {EV} SELECT rec, arg_min(event_type, t) FILTER (value > 100 AND event_type NOT IN ('view', 'click')) AS name, arg_min(round(value, 2), t) FILTER (value > 300) AS number, arg_min(event_id, t) FILTER (value < 50) AS ran FROM ev GROUP BY rec""",
    "m6_events_at": f"WITH {EV} SELECT c.rec, c.event_id AS id, coalesce(v.event_id, -1) AS event_id FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v ON v.rec = c.rec AND c.t >= v.t",
    "m6_own_schedule": f"WITH {_SEC} SELECT rec, event_id, table_id FROM se WHERE table_id BETWEEN 80 AND 95 AND service_id = 'view'",
    "m7_sound_names": f"""WITH {EV}, h AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY event_type <> 'purchase', event_id) AS i FROM ev WHERE (value > 250) = (rec % 2 = 0)) SELECT rec, event_id AS n, 'd' || event_id AS description FROM h WHERE i = 1""",
    "m8_conform": f"WITH {_DF} SELECT rec, what, master, theirs FROM df",
    "m8_tracks": f"WITH {_TD} SELECT rec, coalesce(track, 0)::INTEGER AS track, what FROM td",
    "m9_actions": f"""WITH {_DF}, {_TD}, a AS (SELECT rec, list_sort(list(DISTINCT track)) AS l FROM td WHERE track IS NOT NULL GROUP BY rec), w AS (SELECT rec, bool_or(what <> 'scan') AS video FROM df GROUP BY rec)
        SELECT rec, coalesce(video, false) AS video, coalesce(len(l), 0)::INTEGER AS n_audio, coalesce(array_to_string(l, ','), '') AS audio FROM w FULL JOIN a USING (rec)""",
    "m10_container": f"""WITH x AS (SELECT {_sql_pick('l_partkey', CODECS)} AS codec, {_sql_pick('l_suppkey', FAMILIES)} AS family FROM lineitem)
        SELECT codec, family, CASE family WHEN 'ts' THEN codec IN ('mpeg2video', 'h264', 'aac', 'ac3', 'opus') WHEN 'mp4' THEN codec <> 'pcm_s8' WHEN 'ps' THEN codec IN ('mpeg2video', 'h264', 'vp9', 'ac3', 'pcm_s16be') WHEN 'mov' THEN codec NOT IN ('flac', 'vp9', 'opus')
            WHEN 'webm' THEN codec IN ('vp9', 'opus') WHEN 'mkv' THEN codec <> 'pcm_s8' WHEN 'avi' THEN codec NOT IN ('pcm_s8', 'pcm_s16be', 'alac', 'opus') ELSE true END AS holds, count(*) AS n FROM x GROUP BY ALL""",
    "m11_selection": f"""WITH {EV}, x AS (SELECT rec, event_id AS n, floor(value / 50) * CASE WHEN rec % 2 = 0 THEN 60.0 ELSE 20.0 END AS len FROM ev)
        SELECT rec, n, rec % 7 = 0 OR CASE WHEN max(len) OVER (PARTITION BY rec) >= 300 THEN len >= 300 ELSE n = arg_max(n, (len, n)) OVER (PARTITION BY rec) END AS chosen FROM x""",
    "m12_marks": f"""WITH RECURSIVE {EV}, it AS (SELECT rec, event_id % 4 AS item, min(t) AS s, max(t) - 200000 AS e FROM ev GROUP BY rec, item), m AS (SELECT ev.rec, event_id % 4 AS item, floor(t) - s AS x0 FROM ev JOIN it ON it.rec = ev.rec AND it.item = event_id % 4 WHERE floor(t) >= s - 5000 AND floor(t) <= e + 5000),
        k AS (SELECT rec, item, min(x0) AS x0 FROM m GROUP BY rec, item UNION ALL SELECT m.rec, m.item, min(m.x0) FROM k JOIN m ON m.rec = k.rec AND m.item = k.item AND m.x0 >= k.x0 + 5000 GROUP BY m.rec, m.item, k.x0)
        SELECT rec, item, round(x0, 6) AS "at" FROM k""",
    "v1_align": """WITH a AS (SELECT conv_id AS rec, turn AS pos, md5(coalesce(text, '')) AS h FROM conversations), b AS (SELECT conv_id AS rec, turn + conv_id % 4 AS pos, md5(coalesce(text, '')) AS h FROM conversations WHERE (turn + conv_id % 4) % 7 < 6),
        c AS (SELECT a.rec, b.pos - a.pos AS offset_, count(*) AS n FROM a JOIN b ON a.rec = b.rec AND a.h = b.h AND b.pos - a.pos BETWEEN -5 AND 5 GROUP BY a.rec, offset_), w AS (SELECT rec, arg_min(offset_, (-n, offset_)) AS o, max(n) AS n FROM c GROUP BY rec),
        na AS (SELECT rec, count(*) AS na FROM a GROUP BY rec), nb AS (SELECT rec, count(*) AS nb FROM b GROUP BY rec)
        SELECT rec, coalesce(o, -5)::INTEGER AS "offset", coalesce(n, 0) AS identical, coalesce(na, 0) = coalesce(nb, 0) AS same_count FROM na FULL JOIN nb USING (rec) LEFT JOIN w USING (rec)""",
    "v2_report": f"""WITH {_PR}, x AS (SELECT rec, count(s) AS expected, count(o) AS produced, count(*) FILTER (s = o) AS identical, count(*) FILTER (cp AND NOT coalesce(s = o, false) AND NOT dmg) AS missed, round(min(psnr), 6) AS worst, count(*) FILTER (psnr < 25) AS "unlike", count(*) FILTER (dmg) AS damaged FROM pr GROUP BY rec)
        SELECT *, expected = produced AND missed = 0 AND "unlike" = 0 AS passed FROM x""",
    "v3_psnr": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 100::FLOAT)::FLOAT) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id - x.vec_id % 3),
        m AS (SELECT *, list_sum(list_transform(range(0, 16), lambda i: (a[i * 4 + 1]::DOUBLE - b[i * 4 + 1]::DOUBLE) * (a[i * 4 + 1]::DOUBLE - b[i * 4 + 1]::DOUBLE))) / 16 AS mse FROM p)
        SELECT vec_id, round(CASE WHEN mse = 0 THEN 99 ELSE 10 * log10(65025 / mse) END, 3) AS psnr, a = b AS same FROM m""",
    "v4_after_damage": f"WITH {_PR} SELECT rec, pos, coalesce(last_value(CASE WHEN dmg THEN true WHEN s = o THEN false END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS excused FROM pr",
    "v5_track_length": """WITH x AS (SELECT l_orderkey, l_quantity / 10 AS len, l_discount * 40 AS st FROM lineitem), y AS (SELECT l_orderkey, CASE WHEN len > 3.0 THEN 'long' WHEN len < 1.5 THEN 'short' WHEN st > 3.0 THEN 'late' END AS off FROM x)
        SELECT l_orderkey, off, count(*) AS n FROM y WHERE off IS NOT NULL GROUP BY l_orderkey, off""",
    "v6_kept_fits": f"WITH {EV} SELECT rec, sum(value) BETWEEN -0.5 AND sum(value) - rec % 5 * 200 + 300 + 0.5 AND (rec % 4 = 0 OR rec % 6 = 0 OR min(value) <= max(value) / 2000 + 0.5) AS fits FROM ev GROUP BY rec",
    "v7_best_lag": f"""WITH {EV}, l AS (SELECT rec, floor(t / 86400)::BIGINT AS b, max(value) AS v FROM ev GROUP BY rec, b), x AS (SELECT rec, b, v, v - avg(v) OVER (PARTITION BY rec) AS c FROM l WHERE b BETWEEN 4 AND 26),
        y AS (SELECT rec, b, v, v - avg(v) OVER (PARTITION BY rec) AS c FROM (SELECT rec, b + rec % 5 - 2 AS b, v * (1 + b % 3 / 10) AS v FROM l)),
        q AS (SELECT x.rec, (y.b - x.b)::BIGINT AS lag, sum(x.c * y.c) AS dot, corr(x.v, y.v) AS cr FROM x JOIN y ON y.rec = x.rec AND y.b - x.b BETWEEN -4 AND 4 GROUP BY x.rec, lag),
        e AS (SELECT q.* FROM q JOIN (SELECT rec, min(b) AS xa, max(b) AS xb FROM x GROUP BY rec) USING (rec) JOIN (SELECT rec, min(b) AS ya, max(b) AS yb FROM y GROUP BY rec) USING (rec) WHERE xa + lag >= ya AND xb + lag <= yb)
        SELECT rec, arg_min(lag, (-round(dot, 6), abs(lag), lag)) AS lag, round(arg_min(CASE WHEN isnan(cr) OR cr IS NULL THEN 0 ELSE cr END, (-round(dot, 6), abs(lag), lag)), 6) AS corr FROM e GROUP BY rec""",
    "v8_markers": f"""WITH {_KW}, mp AS (SELECT ev.rec, event_id, t, s, e, o + t - s AS out FROM ev ASOF JOIN ko ON ko.rec = ev.rec AND ev.t >= ko.s WHERE event_type = 'view' AND (t < e OR (final AND t = e))),
        g AS (SELECT rec, out + event_id % 3 * 4.0 AS t FROM mp WHERE event_id % 5 > 0), w AS (SELECT * FROM mp WHERE t < e - 500 AND s + 500 < t + 1e-9),
        n AS (SELECT rec, out, (SELECT arg_min(g.t - w.out, (abs(g.t - w.out), g.t)) FROM g WHERE g.rec = w.rec) AS d FROM w), f AS (SELECT rec, CASE WHEN abs(d) <= 6 THEN d END AS d FROM n)
        SELECT rec, count(*) AS markers, count(*) FILTER (d IS NULL) AS missing, round(arg_max(d, (abs(d), d)), 6) AS worst FROM f GROUP BY rec""",
    "v9_carried": f"""WITH {_KW}, ck AS (SELECT rec, event_id AS h, t, floor(value / 20)::BIGINT AS z FROM ev WHERE event_type = 'click'), i AS (SELECT ck.rec, s AS range, h, z, t, CASE WHEN h % 9 = 0 AND ck.rec % 2 = 0 THEN t - s + 1.0 ELSE t - s END AS ot FROM ck JOIN km ON km.rec = ck.rec AND t >= s AND t < e),
        fi AS (SELECT rec, range, arg_min(h, (ot, h)) AS h, arg_min(z, (ot, h)) AS z, min(ot) AS ot, floor(range)::BIGINT % 4 AS kind FROM i GROUP BY rec, range),
        o AS (SELECT rec, range, h, z, ot FROM i UNION ALL SELECT rec, range, CASE WHEN kind = 3 THEN -1 ELSE h END, CASE WHEN kind = 2 THEN z + 1000 ELSE z END, ot - 0.5 FROM fi WHERE kind > 0),
        b AS (SELECT *, row_number() OVER (PARTITION BY rec, range ORDER BY ot) AS j, EXISTS (SELECT 1 FROM ck WHERE ck.rec = o.rec AND ck.t < o.range AND ck.t >= o.range - 200000 AND ck.z = o.z) AS known FROM o),
        a AS (SELECT *, row_number() OVER (PARTITION BY rec, range ORDER BY t) AS n FROM i),
        c AS (SELECT rec, range, count(*) AS total, min(j) FILTER (NOT known) AS strange FROM b GROUP BY rec, range),
        m AS (SELECT a.rec, a.range, x, coalesce(b.h = a.h AND b.z = a.z, false) AS ok, b.ot - a.t AS mv FROM a CROSS JOIN range(0, 5) r(x) LEFT JOIN b ON b.rec = a.rec AND b.range = a.range AND b.j = a.n + x),
        g AS (SELECT rec, range, x, count(*) AS rows, count(*) FILTER (ok) AS arrived, max(mv) FILTER (ok) - min(mv) FILTER (ok) AS drift FROM m GROUP BY rec, range, x),
        w AS (SELECT g.*, total, rows = arrived AND (strange IS NULL OR strange > x) AS told FROM g JOIN c USING (rec, range)), y AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY rec, range ORDER BY told DESC, arrived DESC, x) = 1)
        SELECT rec, round(range, 6) AS range, rows, arrived, round(drift, 6) AS drift, told AND coalesce(drift, 0) < 0.001 AND total = rows + x AS passed FROM y""",
    "v10_fade": f"""WITH {EV}, s AS (SELECT rec, t AS seam FROM ev WHERE event_type = 'purchase'), j AS (SELECT s.rec, seam, t, -value / 10 AS db, abs(t - seam) AS d FROM s JOIN ev ON ev.rec = s.rec AND ev.t BETWEEN seam - 60000 AND seam + 60000),
        x AS (SELECT rec, seam, arg_min(db, (d, t, db)) AS at_seam, max(db) FILTER (d <= 20000) AS loudest, max(abs(db + 20)) FILTER (d > 30000) AS away FROM j GROUP BY rec, seam)
        SELECT rec, round(seam, 6) AS seam, round(at_seam, 6) AS at_seam, round(loudest, 6) AS loudest, round(away, 6) AS away, at_seam <= -30 AND coalesce(loudest, -30) <= -5 AND coalesce(away, 0) <= 18 AS passed FROM x""",
}
