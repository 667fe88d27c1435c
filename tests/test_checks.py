"""Lags, look-back rows, snapped bounds and mended stretches against plain loops."""

import random
from math import ceil, floor

import numpy as np
import pytest

from tapeloom.operators import capacity, intervals, verify


def test_look_back_rows_that_equal_the_first_row(spark):
    src = spark.createDataFrame([("a", float(t), t % 5, 3) for t in range(100)], "rec string, t double, hash int, size int")
    keeps = spark.createDataFrame([("a", n, 40.0, 43.0) for n in range(4)], "rec string, range int, start double, end double")
    own = [(40.0, 0, 3), (41.0, 1, 3), (42.0, 2, 3)]
    ahead = {0: [(39.5, 0, 3)], 1: [(39.0 + i / 9, 0, 3) for i in range(4)], 2: [(39.0 + i / 9, 0, 3) for i in range(5)], 3: [(39.5, 0, 4)]}
    out = spark.createDataFrame([("a", n, *r) for n, rows in ahead.items() for r in rows + own], "rec string, range int, t double, hash int, size int")
    found = {r["range"]: (r["rows"], r["arrived"], r["passed"]) for r in verify.carried_rows_check(src, out, keeps).collect()}
    assert found[0] == (3, 3, True) and found[1] == (3, 3, True)
    assert not found[2][2] and found[3] == (3, 3, False)


@pytest.mark.parametrize("search", [20, 10_000])
def test_lags_equal_plain_correlation(spark, search):
    rng = np.random.default_rng(search)
    rows_a, rows_b, want = [], [], {}
    for rec in ("p", "q", "r"):
        long = rng.normal(size=26_000).cumsum() + rng.normal(size=26_000) * 3
        at = {"p": 7003, "q": 7040, "r": 16_500}[rec]
        short = long[at : at + 6000] * 2 + 5
        start = 7000  # places of a; b's are its index
        rows_a += [(rec, start + i, float(v)) for i, v in enumerate(short)]
        rows_b += [(rec, i, float(v)) for i, v in enumerate(long)]
        lags = [g for g in range(-search, search + 1) if start + g >= 0 and start + g + 6000 <= 26_000]
        x, y = short - short.mean(), long - long.mean()
        dots = np.correlate(y, x, "valid")
        want[rec] = min(lags, key=lambda g: (-round(float(dots[start + g]), 6), abs(g), g))
    a, b = (spark.createDataFrame(r, "rec string, bucket long, level double") for r in (rows_a, rows_b))
    got = {r["rec"]: (r["lag"], r["corr"]) for r in verify.best_lag(a, b, search=search).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    if search > 20:
        assert got["r"][0] == 9500 and got["r"][1] == pytest.approx(1.0)


def test_only_lags_within_the_long_series_count(spark):
    a = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 2])] + [("b", i, float(i)) for i in range(9)], "rec string, bucket long, level double")
    b = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 2, 0, 1, 4, 2])] + [("b", i, float(i)) for i in range(5)], "rec string, bucket long, level double")
    assert [(r["rec"], r["lag"]) for r in verify.best_lag(a, b, search=5).collect()] == [("a", 3)]


def snapped(t, start, points, seams, fd, duration, early):
    slack = fd * 0.01
    if t <= 0 or t >= duration:
        return t
    since = max((s for s in seams if s <= t + slack), default=float("-inf"))
    anchor = next((p for p in reversed(points) if p <= t + slack and p >= since - slack), None)
    if anchor is None:
        at = next((p for p in points if p >= t - slack), t)
    elif start:
        at = anchor + max(ceil((t - anchor - early - slack) / fd), 0) * fd
    else:
        at = anchor + max(floor((t - anchor + slack) / fd), 0) * fd
    return min(at, duration)


def test_bounds_past_the_end_stay(spark):
    rng = random.Random(3)
    points, seams = sorted(rng.uniform(0, 60) for _ in range(12)), [20.0, 45.5]
    cuts = [(t := rng.uniform(-3, 62), t + rng.uniform(0.01, 1.5)) for _ in range(25)]
    frame = lambda schema, rows: spark.createDataFrame(rows, schema)
    want = []
    for a, b in sorted((snapped(a, True, points, seams, 0.5, 50.2, 0.01), snapped(b, False, points, seams, 0.5, 50.2, 0.01)) for a, b in cuts):
        if b <= a:
            continue
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    found = intervals.snap_intervals(
        frame("rec string, start double, end double", [("a", *c) for c in cuts]), frame("rec string, t double", [("a", p) for p in points]), frame=0.5, early=0.01,
        seams=frame("rec string, time double", [("a", s) for s in seams]), bounds=frame("rec string, duration double", [("a", 50.2)]),
    )
    assert [[round(r["start"], 6), round(r["end"], 6)] for r in found.orderBy("start").collect()] == [[round(x, 6) for x in w] for w in want] and len(want) > 3


def test_walked_points_and_replaced_stretches(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    seams = frame("rec string, seam int, at long, time double, ends double", ("a", 1, 100, 10.0, 9.9), ("a", 2, 200, 20.0, 19.9))
    tails = frame("rec string, seam int, shown_end double, broken_from long, key_at long, key_lead double", ("a", 1, 9.0, None, 90, 8.0), ("a", 2, 19.89, 180, 160, 15.0))
    points = frame("rec string, id int, pos long, t double, lead_start double", ("a", 0, 10, 1.0, 1.0), ("a", 1, 80, 8.98, 8.9), ("a", 2, 90, 8.5, 7.0), ("a", 3, 150, 15.0, 14.99), ("a", 4, 160, 16.0, 14.5), ("a", 5, 185, 18.0, 18.0), ("a", 6, -1, 19.95, 19.0), ("a", 7, 250, 99.0, 99.0))
    mended, kept = intervals.mend_seams(seams, tails, points, frame=0.1)
    assert sorted((r["seam"], r["ends"]) for r in mended.collect()) == [(1, 9.0), (2, 19.9)]
    assert sorted(r["id"] for r in kept.collect()) == [0, 3, 6, 7]
    assert intervals.mend_seams(seams, tails, points, frame=0.1, walked=False)[1].count() == 8

    fresh = frame("rec string, seam int, id int, pos long, t double, lead_start double", ("a", 1, 11, 140, 12.0, 12.0), ("a", 1, 12, 170, 13.0, 13.0), ("a", 2, 13, 210, 21.0, 21.0))
    firsts = frame("rec string, seam int, first double", ("a", 1, 13.9), ("a", 2, 98.5))
    assert sorted(r["id"] for r in intervals.replace_stretches(seams, points, firsts, fresh).collect()) == [0, 1, 2, 6, 7, 11, 12]
    assert sorted(r["id"] for r in intervals.replace_stretches(seams, points, firsts.filter("seam = 2"), fresh).collect()) == list(range(8))


def test_rates_are_of_written_seconds(spark):
    recs = spark.createDataFrame([("a", 100.0, 1.0, "h264", 50.0), ("b", None, 100.0, "mpeg2video", 50.0), ("c", 100.0, 1.0, "h264", 50.0)], "rec string, video_rate double, file_rate double, codec string, duration double")
    tracks = spark.createDataFrame([], "rec string, codec string, rate double, channels int, sample_rate int, bits int")
    holes = spark.createDataFrame([("a", 10.0, 20.0), ("a", 15.0, 35.0), ("b", -5.0, 25.0)], "rec string, start double, end double")
    got = {r["rec"]: round(r["video"], 6) for r in capacity.rates(recs, tracks, holes=holes).collect()}
    assert got == {"a": 200.0, "b": 180.0, "c": 100.0}
