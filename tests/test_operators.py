"""Operators on small frames with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import timecode, titles
from tapeloom.functions.easing import CURVES, MODES, easing
from tapeloom.functions.greedy import keep_apart
from tapeloom.operators import breaks, capacity, catalogue, clocks, gaps, intervals, runs, verify
from tapeloom.plans import cuts
from tapeloom.sources import archive


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merge_joins_touching_intervals(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 4.0), ("a", 5.0, 5.0), ("b", 2.0, 9.0), ("b", 3.0, 4.0)], "rec string, start double, end double")
    assert got(intervals.merge_intervals(df), "rec", "start") == [("a", 0.0, 2.0), ("a", 3.0, 4.0), ("b", 2.0, 9.0)]


def test_complement_of_nothing_is_all(spark):
    cuts_ = spark.createDataFrame([], "rec string, start double, end double")
    bounds = spark.createDataFrame([("a", 0.0, 10.0)], "rec string, lo double, hi double")
    assert got(intervals.complement(cuts_, bounds), "start") == [("a", 0.0, 10.0)]


def test_overlap_semi_keeps_repeated_rows(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 1.0), ("a", 5.0, 6.0)], "rec string, start double, end double")
    other = spark.createDataFrame([("a", 0.5, 0.6)], "rec string, start double, end double")
    assert intervals.overlap_semi(df, other).count() == 2
    assert intervals.overlap_anti(df, other).count() == 1


def test_runs_end_where_the_next_row_begins(spark):
    df = spark.createDataFrame([("a", 0.0, None), ("a", 0.1, "black"), ("a", 0.2, "black"), ("a", 0.3, None), ("a", 0.4, "white")], "rec string, t double, state string")
    assert got(runs.flat_runs(df), "start") == [("a", "black", 0.1, 0.3, 0.2, 2)]


def test_hysteresis_equals_a_plain_loop(spark):
    rng = random.Random(5)
    data, want = [], {}
    for key in range(40):
        rows = [(key, float(i), rng.random()) for i in range(rng.randrange(1, 30))]
        data += rows
        up0 = rows[0][2] >= 0.6
        state, since, changes, last_up = ("P" if up0 else "A"), rows[0][1], 0, up0
        for _, t, s in rows[1:]:
            up = s >= 0.6
            if up != last_up:
                since, last_up = t, up
            new = "A" if s < 0.3 else "P" if up and t - since >= 2 else state
            changes += new != state
            state = new
        want[key] = changes
    df = spark.createDataFrame(data, "rec long, t double, score double")
    moves = dict(got(runs.transitions(df, F.lit(0.6), F.lit(0.3), 2.0), "rec"))
    assert moves == want


def test_debounce_is_greedy_and_adjacent_is_not(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.5, 3.0, 4.5, 6.0)], "rec string, t double")
    assert [r[1] for r in got(runs.debounce(df), "t")] == [0.0, 3.0, 6.0]
    assert [r[1] for r in got(runs.dedup_adjacent(df, eps=2.0), "t")] == [0.0]


def test_medians_differ_on_even_counts(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 3.0)], "rec string, t double")
    assert got(gaps.median_gap(df), "rec") == [("a", 2.0)]


def test_paced_schedule_equals_a_backward_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(30):
        n = rng.randrange(1, 12)
        packets = sorted(rng.sample(range(100), n))
        at = [round(rng.random() * 50, 3) for _ in packets]
        rows += [(key, p, a) for p, a in zip(packets, at, strict=True)]
        for i in range(n - 2, -1, -1):
            at[i] = min(at[i], at[i + 1] - (packets[i + 1] - packets[i]) * 0.5)
        want |= {(key, p): round(a, 6) for p, a in zip(packets, at, strict=True)}
    df = clocks.paced_schedule(spark.createDataFrame(rows, "rec long, packet long, at double"), 0.5)
    assert {(r["rec"], r["packet"]): round(r["paced"], 6) for r in df.collect()} == want


def test_wrapped_mark_lands_in_the_recording(spark):
    df = spark.range(1).select(timecode.unwrap_mark(F.lit(-93848.7), F.lit(1807.1)).alias("t"))
    assert df.first()[0] == pytest.approx(1595.0, abs=0.1)


def test_timecodes(spark):
    texts = ["90", "1:30", "0:01:30.5", "-5", "nan", "1:2:3:4", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", timecode.parse_timecode(F.col("s")).alias("t"))
    assert [r[1] for r in got(df, "i")] == [90.0, 90.0, 90.5, None, None, None, None, None]


def test_break_chain_hops_over_off_grid_silences(spark):
    times = [100.0, 103.0, 115.0, 130.0, 145.0, 400.0]
    df = spark.createDataFrame([("a", t, 1.0) for t in times], "rec string, time double, dur double")
    cand = breaks.break_candidates(df)
    assert {r["time"]: r["run"] for r in cand.collect()} == {100.0: 4, 103.0: 1, 115.0: 4, 130.0: 4, 145.0: 4, 400.0: 1}
    # 103 s is as strong by its length alone only up to 0.5, so that it does not part the block
    assert [(r["start"], r["end"], r["junctions"]) for r in breaks.break_blocks(cand).collect()] == [(100.0, 145.0, 4)]


def test_titles(spark):
    names = {
        "＜アニメ枠＞海の歌 #12「雪」": "海の歌",
        "[字]山の声　第３話「朝」[再]": "山の声",
        "川の本（４）": "川の本",
        "森の家　第2期": "森の家　第2期",
        "空の窓「夜」": "空の窓",
        "谷の道 ep.5 x": "谷の道",
        "▼": "",
    }
    df = spark.createDataFrame([(k,) for k in names], "n string").select("n", titles.series_title(F.col("n")).alias("t"))
    assert {r["n"]: r["t"] for r in df.collect()} == names


@pytest.mark.parametrize("mode", MODES)
def test_easings_run_from_0_to_1(spark, mode):
    row = spark.range(1).select(*[easing(c, mode, F.lit(float(t))).alias(f"{c}{t}") for c in CURVES for t in (0, 1)]).first()
    for c in CURVES:
        assert row[f"{c}0"] == pytest.approx(0, abs=2e-3) and row[f"{c}1"] == pytest.approx(1, abs=2e-3)


def test_divide_into_parts_prefers_points(spark):
    keeps = spark.createDataFrame([("a", 0.0, 50.0), ("a", 60.0, 110.0)], "rec string, start double, end double")
    points = spark.createDataFrame([("a", 26.0)], "rec string, t double")
    cuts_ = [(r["out"], r["src"], r["on_point"]) for r in cuts.divide_ranges(keeps, points, parts=4, frame=1.0).orderBy("n").collect()]
    assert cuts_ == [(26.0, 26.0, True), (50.0, 60.0, True), (75.0, 85.0, False)]


def test_sections_need_their_checksum(spark):
    def crc(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c.to_bytes(4, "big")

    body = bytes([0x42, 0xB0, 9]) + b"hello"
    good, bad = body + crc(body), body + b"\0\0\0\0"
    rows = [("a", i, 17, True, bytearray(b"\0" + s + b"\xff" * 50)) for i, s in enumerate((good, bad))]
    df = spark.createDataFrame(rows, "rec string, seq long, pid int, unit_start boolean, payload binary")
    assert [(r["seq"], bytes(r["section"])) for r in archive.sections_from_packets(df, 17).collect()] == [(0, good)]


def test_m2ts_stride_is_found(spark):
    packet = bytes([0x47, 0x40, 0x11, 0x10]) + bytes(184)
    files = spark.createDataFrame([("ts", bytearray(packet * 6)), ("m2ts", bytearray((b"\1\2\3\4" + packet) * 6)), ("none", bytearray(1000))], "rec string, content binary")
    found = archive.packets_from_bytes(files).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("pid"), F.max("pos").alias("pos"))
    assert got(found, "rec") == [("m2ts", 6, 17, 960), ("ts", 6, 17, 940)]


def test_packets_of_recordings_that_begin_mid_packet(spark):
    def packet(n, stream):
        return bytes([0x47, 0x40, n, 0x10, 0, 0, 1, stream, 0, 0, 0x80, 0x80, 5, 0x21, 0, 1, 0, 2 * n + 1]) + bytes(170)

    def late(n, copy):
        return bytes([copy, 0x47 if copy == 0x47 else 0, 0, n])

    plain = b"".join(packet(n, 0xFD if n % 2 else 0xE0) for n in range(1, 9))
    timed = b"".join(late(n, 0x00) + packet(n, 0xE0) for n in range(1, 9))
    marked = b"".join(late(n, 0x47) + packet(n, 0xE0) for n in range(1, 9))
    files = {"aligned": plain, "mid": bytes(100) + plain, "far": bytes(1400) + plain, "timed": timed, "timed_mid": bytes(77) + timed, "marked": marked, "marked_mid": bytes(77) + marked, "beyond": bytes(1504) + plain}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "rec string, content binary")
    rows = {}
    for r in archive.packets_from_bytes(df).orderBy("rec", "seq").collect():
        rows.setdefault(r["rec"], []).append((r["pos"], r["pid"], r["pts"]))
    ahead = {"aligned": 0, "mid": 100, "far": 1400, "timed": 0, "timed_mid": 77, "marked": 0, "marked_mid": 77}
    size = {k: 188 if k in ("aligned", "mid", "far") else 192 for k in ahead}
    assert rows == {k: [(at + size[k] * (n - 1), n, n) for n in range(1, 9)] for k, at in ahead.items()}
    given = archive.packets_from_bytes(df.filter("rec IN ('mid', 'aligned')"), 188)
    assert got(given.groupBy("rec").count(), "rec") == [("aligned", 8), ("mid", 8)]


def test_grids_begin_anew_at_seams(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 11.5)], "rec string, t double")
    seams = spark.createDataFrame([("a", 10.0)], "rec string, time double")
    cuts_ = spark.createDataFrame([("a", 0.5, 3.5), ("a", 6.2, 7.9), ("a", 10.5, 14.2)], "rec string, start double, end double")
    assert got(intervals.snap_intervals(cuts_, points, frame=1.0, early=0.0, seams=seams), "start") == [("a", 1.0, 3.0), ("a", 11.5, 13.5)]
    times = spark.createDataFrame([("a", 0.5), ("a", 6.2), ("a", 10.4), ("a", 13.0)], "rec string, t double")
    assert got(clocks.grid_from_points(times, points, 1.0, seams=seams), "t") == [("a", 0.5, 1.0), ("a", 6.2, 6.0), ("a", 10.4, 11.5), ("a", 13.0, 12.5)]


def test_carried_rows_are_all_accounted_for(spark):
    src = spark.createDataFrame([("a", float(t), t, t % 7) for t in range(100)], "rec string, t double, hash int, size int")
    keeps = spark.createDataFrame([("a", n, 40.0, 43.0) for n in range(5)] + [("a", 5, 40.2, 40.8)], "rec string, range int, start double, end double")
    good = [(float(t), t, t % 7) for t in (40, 41, 42)]
    extra = {0: [(39.0, 7, 3)], 1: [(39.0 - i / 9, 7, 3) for i in range(5)], 2: [(39.0, 7, 99)], 3: [(50.0, 50, 1)], 4: []}
    rows = [("a", n, *r) for n, e in extra.items() for r in good + e] + [("a", 5, 40.5, 1, 1)]
    out = spark.createDataFrame(rows, "rec string, range int, t double, hash int, size int")
    found = {r["range"]: (r["rows"], r["arrived"], r["passed"]) for r in verify.carried_rows_check(src, out, keeps).collect()}
    assert found == {0: (3, 3, True), 1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, False), 4: (3, 3, True), 5: (0, 0, False)}


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_rows_kept_apart_equal_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], []
    for key in range(40):
        data = sorted((round(rng.random() * 30, 2), i, rng.choice([0.0, 0.4, 3.0, 9.0])) for i in range(rng.randrange(1, 60)))
        rows += [(key, t, i, g) for t, i, g in data]
        reach = None
        for t, i, g in data:
            if reach is None or t >= reach:
                want.append((key, i))
                reach = t + g
    df = spark.createDataFrame(rows, "rec long, t double, i long, gap double")
    assert sorted((r["rec"], r["i"]) for r in keep_apart(df, "rec", "t", F.col("t") + F.col("gap"), "i").collect()) == sorted(want)


def test_overlap_tests_equal_all_pairs(spark):
    rng = random.Random(9)
    spans = lambda n: [(rng.randrange(3), float(a), float(a + rng.randrange(1, 6))) for a in (rng.randrange(60) for _ in range(n))]
    left, right = spans(80), spans(15)
    meets = lambda a: any(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for b in right)
    schema = "rec long, start double, end double"
    df, other = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert got(intervals.overlap_semi(df, other), "rec", "start", "end") == sorted(a for a in left if meets(a))
    assert got(intervals.overlap_anti(df, other), "rec", "start", "end") == sorted(a for a in left if not meets(a))


def test_repeated_times_do_not_make_a_rate_variable(spark):
    even = [("a", i * 40.0) for i in range(50)] + [("a", i * 40.0) for i in range(0, 50, 5)]
    df = spark.createDataFrame(even + [("b", i * 40.0 + (5.0 if i % 10 == 0 else 0.0)) for i in range(30)], "rec string, t double")
    assert {r["rec"]: (r["n"], r["variable"]) for r in gaps.is_variable_rate(df, 40.0).collect()} == {"a": (49, False), "b": (29, False)}


def test_stream_rate_runs_between_stated_clocks(spark):
    df = frame(spark, "rec string, pid int, seq long, clock long", ("a", 1, 0, None), ("a", 1, 1, 2**33 - 90000), ("a", 1, 2, None), ("a", 1, 3, 90000), ("a", 1, 4, None), ("a", 2, 5, 7))
    assert got(gaps.pid_rates(df), "pid") == [("a", 1, 5, 5 * 188 * 8 / 2.0), ("a", 2, 1, None)]


def test_profile_keeps_still_places_and_the_first_of_overlaps(spark):
    points = frame(spark, "rec string, n long, t double, pos long", ("a", 0, 0.0, 100), ("a", 1, 5.0, 100), ("a", 2, 9.0, 700), ("a", 3, 4.0, 800), ("a", 4, 12.0, 900), ("a", 5, 13.0, -1))
    assert got(gaps.byte_profile(points), "start") == [("a", 0.0, 5.0, 0), ("a", 5.0, 9.0, 600)]


def test_unplayed_begins_at_nought_and_needs_plays(spark):
    plays = frame(spark, "rec string, start double, end double", ("a", 2.0, 5.0), ("a", 5.05, 8.0), ("a", 9.0, 10.0), ("b", 1.0, 4.0))
    bounds = frame(spark, "rec string, head double, duration double", ("a", 0.5, 12.0), ("b", 0.95, 4.0), ("c", 0.0, 9.0))
    assert got(intervals.unplayed(plays, bounds), "rec", "start") == [("a", 0.0, 2.0), ("a", 8.0, 9.0), ("a", 10.0, 12.0)]


def test_holes_count_within_the_recording(spark):
    holes = frame(spark, "rec string, start double, end double", ("a", -5.0, 2.0), ("a", 9.0, 50.0), ("b", -1.0, 20.0))
    bounds = frame(spark, "rec string, duration double", ("a", 10.0), ("b", 10.0), ("c", 10.0), ("d", 0.0))
    assert got(intervals.clock_per_written(holes, bounds), "rec") == [("a", 10 / 7), ("b", 1.0), ("c", 1.0), ("d", 1.0)]


def test_unwritten_runs_from_the_last_picture_to_the_next_point(spark):
    seams = frame(spark, "rec string, time double, ends double", ("a", 10.0, 8.0), ("a", 20.0, 21.0), ("a", 30.0, 29.0))
    points = frame(spark, "rec string, t double", ("a", 9.99), ("a", 20.0), ("a", 12.0))
    assert got(intervals.unwritten(seams, points, 0.04), "start") == [("a", 8.0, 9.99), ("a", 29.0, 30.0)]


def test_a_lone_reset_needs_a_length_behind_it(spark):
    marks = frame(spark, "rec string, t double", ("a", 500.0), ("b", 500.0), ("c", 600.0))
    bounds = frame(spark, "rec string, duration double", ("a", 0.0), ("b", 510.0), ("c", 590.0))
    assert got(breaks.blocks_from_resets(marks, bounds).select("rec", "start", "end"), "rec") == [("b", 500.0, 510.0)]


def test_chains_are_followed_to_their_end(spark):
    n = 3000
    df = spark.range(n).select(F.lit("a").alias("rec"), (F.col("id") * 15.0).alias("time"), F.lit(0.5).alias("dur"))
    assert {r["run"] for r in breaks.break_candidates(df).select("run").collect()} == {n}


def test_sound_is_priced_as_the_tracks_say(spark):
    schema = "rec int, codec string, rate long, channels int, sample_rate int, bits int, clock int, drop boolean, to_codec string, to_rate int, to_channels int, to_sample_rate int, to_bits int"
    own = lambda n, name, stated, ch=2, bits=16, clock=None, **to: (n, name, stated, ch, 48000, bits, clock, to.get("drop", False), to.get("codec"), to.get("rate"), to.get("fold"), to.get("sr"), to.get("to_bits"))
    tracks = frame(
        spark, schema, own(1, "pcm_s16be", 700000), own(2, "ac3", 5000), own(3, "aac", 30000, clock=90000), own(4, "aac", 30000), own(5, "unknown", None), own(6, "aac_latm", 90000),
        own(7, "dts", 900000, rate=192000), own(8, "dts", 900000, codec="aac", fold=1), own(9, "pcm_s16be", 700000, sr=44100, to_bits=24), own(10, "ac3", 300000, 6, fold=2), own(11, "pcm_dvd", 768000, 1, 20), own(12, "mp2", 100, drop=True),
    )
    recs = tracks.select("rec", F.lit(1.0).alias("video_rate"), F.lit(0.0).alias("file_rate"), F.lit("h264").alias("codec"))
    stated = {r["rec"]: r["audio"] for r in capacity.rates(recs, tracks).collect()}
    assert [stated[i] for i in range(1, 7)] == [700000, 5000, 192000, 30000, 48000 * 2 * 16, 192000]
    written = {r["rec"]: r["audio"] for r in capacity.rates_as_written(tracks).collect()}
    assert [written[i] for i in range(7, 13)] == [900000, 96000, 44100 * 2 * 24, 128000, 768000, 0]
    assert {r["rec"]: r["audio"] for r in capacity.rates_as_written(tracks, to_ts=True).collect()}[11] == 48000 * 2 * 24


def test_containers_of_all_families(spark):
    cases = {("ps", "mpeg2video"): True, ("ps", "aac"): False, ("ps", "mp2"): True, ("avi", "mpeg4"): True, ("avi", "mp3"): True, ("avi", "opus"): False, ("avi", "pcm_s16be"): False, ("avi", "alac"): False,
             ("ogm", "anything"): True, ("", "h264"): True, ("ts", "vp9"): False, ("mp4", "vp8"): False, ("mov", "prores"): True, ("webm", "h264"): False, ("mkv", "h264"): True}
    df = spark.createDataFrame(list(cases), "family string, codec string")
    assert {(r["family"], r["codec"]): r["holds"] for r in catalogue.container_holds(df).collect()} == cases


def test_the_last_of_equal_longest_is_chosen(spark):
    df = frame(spark, "rec string, n int, length double, disc boolean", ("a", 1, 200.0, False), ("a", 2, 200.0, False), ("a", 3, 100.0, False), ("b", 1, 5.0, True), ("b", 2, 6.0, True))
    assert [r["n"] for r in catalogue.default_selection(df).filter("chosen AND rec = 'a'").collect()] == [2]
    assert catalogue.default_selection(df, recorded="disc").filter("chosen AND rec = 'b'").count() == 2


def test_close_marks_are_told_from_the_last_kept(spark):
    marks = frame(spark, "rec string, item int, t double", *[("a", 1, 1 + i * 0.0006) for i in range(5)])
    items = frame(spark, "rec string, item int, start double, end double", ("a", 1, 1.0, 9.0))
    assert [round(r["at"], 4) for r in catalogue.place_marks(marks, items).orderBy("at").collect()] == [0.0, 0.0012, 0.0024]


def test_a_short_series_is_found_within_a_long_one(spark):
    rng = random.Random(4)
    level = [rng.random() for _ in range(60)]
    a = spark.createDataFrame([("a", i, 2 * level[i + 7] + 1) for i in range(20, 32)], "rec string, bucket long, level double")
    b = spark.createDataFrame([("a", i, x) for i, x in enumerate(level)], "rec string, bucket long, level double")
    row = verify.best_lag(a, b, search=10).first()
    assert row["lag"] == 7 and row["corr"] == pytest.approx(1.0)


def test_unknown_holes_fit(spark):
    out = frame(spark, "rec string, seconds double, holes double", ("a", 10.0, None), ("b", 10.0, 3.0), ("c", 10.0, 3.0))
    kept = frame(spark, "rec string, from double, to double, source_holes double", ("a", 9.0, 10.0, 0.0), ("b", 9.0, 10.0, None), ("c", 9.0, 10.0, 1.0))
    assert got(verify.kept_fits(out, kept), "rec") == [("a", True), ("b", True), ("c", False)]


def test_half_written_files_count_for_nothing(spark):
    rows = [("s", "new", 10, 9, False, False, 1), ("s", "half", 99, 8, False, True, 5), ("s", "stale", 99, 7, False, True, 90000), ("s", "old", 10, 6, False, False, 1), ("s", "older", 10, 5, False, False, 1)]
    df = spark.createDataFrame(rows, "store string, path string, bytes long, modified long, spare boolean, half boolean, age long")
    assert {r["path"]: r["kept"] for r in archive.retention_prune(df, 2, 20).collect()} == {"new": True, "half": True, "stale": False, "old": True, "older": False}


def test_a_scene_at_the_threshold_counts(spark):
    df = spark.createDataFrame([("a", float(i), 0.1) for i in range(5)] + [("a", 9.0, 0.3)], "rec string, t double, diff double")
    bounds = spark.createDataFrame([("a", 100.0)], "rec string, duration double")
    assert [r["t"] for r in runs.scene_marks(df, bounds, over=1.0, floor=0.3).collect()] == [9.0]


def divided(keeps, points, frame_, head, parts=None, every=None, size=None, rate=None):
    """Cuts (output time, on a clean place) of one recording by plain loops over its keeps."""
    at, total = [], 0.0
    for a, b in keeps:
        at.append(total)
        total += b - a
    every_place = sorted([at[i] + q - a for i, (a, b) in enumerate(keeps) for q in points if a + frame_ / 2 < q < b - frame_ / 2] + at[1:])
    clean = []
    for c in every_place:
        if not clean or c - clean[-1] >= frame_ / 2:
            clean.append(c)
    length = total / parts if parts else every or size / rate
    last, down, cuts, prev, n = total - frame_, size is not None, [], 0.0, 0
    while True:
        n += 1
        if (parts and n >= parts) or (every and n * length > last) or (down and prev + length >= total - 1e-9):
            return cuts
        t = min(prev + length, last) if down else n * length
        near = [c for c in clean if c > prev + frame_ / 2 and (t - length / 2 <= c <= t + 1e-9 if down else c < last and abs(c - t) <= length / 2)]
        if near:
            o, on = min(near, key=lambda c: (abs(c - t), c)), True
        else:
            i = max(j for j in range(len(at)) if at[j] <= t)
            a, b = keeps[i]
            s = a + t - at[i]
            steps = (s - head) / frame_
            grid = head + (math.floor(steps + 1e-6) if down else math.floor(steps + 0.5)) * frame_
            o, on = (at[i], i > 0) if grid < a else (at[i] + b - a, True) if grid > b - 1e-9 else (t + grid - s, False)
            if not prev + frame_ / 2 < o < last + frame_ / 2:
                if down:
                    return cuts
                continue
        cuts.append((o, on))
        prev = o


@pytest.mark.parametrize("rule", [{"parts": 2}, {"parts": 7}, {"every": 6.0}, {"size": 900.0}])
def test_divisions_equal_a_plain_loop(spark, rule):
    rng = random.Random(12)
    keeps, points, want = [], [], {}
    for rec in range(12):
        t, own = 0.0, []
        for _ in range(rng.randrange(1, 6)):
            t += rng.random() * 9
            own.append((t, t + 3 + rng.random() * 20))
            t = own[-1][1]
        marks = sorted(rng.random() * t for _ in range(rng.choice([0, 3, 40])))
        keeps += [(rec, a, b, 100.0) for a, b in own]
        points += [(rec, q) for q in marks]
        want[rec] = divided(own, marks, 0.5, 0.0, rate=100.0, **rule)
    found = cuts.divide_ranges(spark.createDataFrame(keeps, "rec long, start double, end double, rate double"), spark.createDataFrame(points, "rec long, t double"), frame=0.5, **rule)
    have = {rec: [] for rec in want}
    for r in found.orderBy("rec", "n").collect():
        have[r["rec"]].append((r["out"], r["on_point"]))
    for rec in want:
        assert [c[0] for c in have[rec]] == pytest.approx([c[0] for c in want[rec]]) and [c[1] for c in have[rec]] == [c[1] for c in want[rec]]


def test_recordings_that_cannot_be_divided_are_told(spark):
    keeps = frame(spark, "rec string, start double, end double, rate double", ("a", 0.0, 100.0, 10.0), ("b", 0.0, 0.01, 10.0), ("c", 0.0, 100.0, None), ("d", 0.0, 100.0, 99.0), ("e", 0.0, 9e6, 30.0))
    points = frame(spark, "rec string, t double", ("a", 49.0))
    assert got(cuts.division_problems(keeps, size=60.0), "rec") == [("b", "nothing"), ("c", "weight"), ("d", "second"), ("e", "many")]
    assert {r["rec"] for r in cuts.divide_ranges(keeps, points, size=60.0).collect()} == {"a"}
    assert got(cuts.division_problems(keeps, every=60.0).filter("reason = 'many'").select("rec"), "rec") == [("e",)]


def test_section_checksums(spark):
    whole = bytes([0x00, 0xB0, 0x0D, 0x00, 0x01, 0xC1, 0x00, 0x00, 0x00, 0x01, 0xF0, 0x00, 0x2A, 0xB1, 0x04, 0xB2])
    df = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(whole[:-1] + b"x")), (2, None), (3, bytearray())], "i int, s binary")
    found = [r[1] for r in got(df.select("i", archive.crc32_mpeg2("s")), "i")]
    assert found[0] == 0 and found[1] != 0 and found[2] is None and found[3] == 0xFFFFFFFF


def test_files_are_read_as_packets_and_sheets(spark, tmp_path):
    packet = lambda pid: bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + bytes(184)
    (tmp_path / "ts").mkdir()
    (tmp_path / "ts" / "a.ts").write_bytes(b"".join(packet(p) for p in (17, 18, 300, 17, 17, 17)))
    (tmp_path / "ts" / "b.ts").write_bytes(b"\x00" * 50 + b"".join(packet(p) for p in (5, 6, 7, 8, 9, 10)))
    rows = archive.read_ts_packets(spark, f"{tmp_path}/ts").select("rec", "seq", "pid").collect()
    assert sorted((r["rec"][-4:], r["seq"], r["pid"]) for r in rows) == [("a.ts", i, p) for i, p in enumerate((17, 18, 300, 17, 17, 17))] + [("b.ts", i, p) for i, p in enumerate((5, 6, 7, 8, 9, 10))]
    (tmp_path / "cue").mkdir()
    (tmp_path / "cue" / "x.cue").write_bytes('TITLE "\xe9"\nFILE "x" BINARY\n TRACK 01 AUDIO\n  INDEX 01 00:02:00\n TRACK 02 AUDIO\n  INDEX 00 01:00:00\n'.encode("latin-1"))
    assert [r["start"] for r in archive.read_cue_sheet(spark, f"{tmp_path}/cue").orderBy("start").collect()] == [2.0, 60.0]


def test_blocks_at_an_edge_have_no_odd_length(spark):
    bounds = spark.createDataFrame([("a", 1000.0), ("b", 1000.0), ("c", 1000.0)], "rec string, duration double")
    truth = spark.createDataFrame([("a", 500.0, 560.0, False)], "rec string, start double, end double, grey boolean")
    blocks = spark.createDataFrame([("a", 1.0, 48.0), ("b", 1.6, 48.6), ("c", 951.0, 998.6), ("c", 900.0, 947.0), ("b", 600.0, 660.2)], "rec string, start double, end double")
    assert got(breaks.score_breaks(blocks, truth, bounds).select("rec", "odd"), "rec") == [("a", 0), ("b", 1), ("c", 1)]


def test_rolling_means_in_chunks_equal_plain_ones(spark):
    rng = random.Random(8)
    vectors = {k: [[rng.random() for _ in range(6)] for _ in range(n)] for k, n in (("a", 1), ("b", 40), ("c", 37))}
    df = spark.createDataFrame([(k, float(i), v) for k, vs in vectors.items() for i, v in enumerate(vs)], "rec string, t double, vec array<double>")
    for ring, chunk in ((1, 5), (4, 5), (9, 8), (64, 7)):
        found = {(r["rec"], r["t"]): r["mean"] for r in runs.rolling_means(df, ring, chunk=chunk).collect()}
        assert len(found) == 78
        for k, vs in vectors.items():
            for i in range(len(vs)):
                part = vs[max(0, i - ring + 1) : i + 1]
                assert found[k, float(i)] == pytest.approx([sum(c) / len(part) for c in zip(*part, strict=True)])
