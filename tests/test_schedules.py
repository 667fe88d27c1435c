"""Step choice and packet times against plain loops over one recording's anchors."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import clocks


def solved(anchors, step):
    at = [list(a) for a in anchors]
    for k in range(len(at) - 2, -1, -1):
        at[k][1] = min(at[k][1], at[k + 1][1] - (at[k + 1][0] - at[k][0]) * step)
    return at


def searched(anchors, fastest, nominal, budget):
    """The largest step that fits, by halving."""
    if len(anchors) < 2:
        return nominal
    lo, hi, best = fastest, nominal, fastest
    while lo <= hi:
        middle = (lo + hi) // 2
        if max(a[1] - b[1] for a, b in zip(anchors, solved(anchors, middle), strict=True)) <= budget:
            best, lo = middle, middle + 1
        else:
            hi = middle - 1
    return best


def arrival(at, step, pause, i):
    n = next((k for k, (p, _) in enumerate(at) if p >= i), None)
    if n is None:
        return at[-1][1] + (i - at[-1][0]) * step
    packet, when = at[n]
    back = packet - i
    if n == 0:
        return when - back * step
    first, began = at[n - 1]
    count, slots = packet - first, (when - began) // step
    spare = max(slots - count, 0)
    if spare == 0:
        return when - back * step
    stretch = max(count * pause // (slots * step), 1)
    return when - (back + back // stretch * stretch * spare // count) * step


@pytest.fixture(scope="module")
def recordings():
    rng, out = random.Random(12), {}
    for r in range(40):
        packets = sorted(rng.sample(range(3, 4000), rng.choice([1, 2, 5, 30])))
        clock, rows = 10**6, []
        for a, b in zip([0, *packets], packets, strict=False):
            clock += max(1, int((b - a) * rng.choice([40, 95, 150, 400]) + rng.randrange(-900, 900)))
            rows.append((b, clock))
        out[f"r{r}"] = rows
    out["back"] = [(10, 5000), (20, 100), (30, 9000)]  # no step keeps within the budget
    return out


@pytest.mark.parametrize("budget", [0, 500, 20_000])
def test_chosen_steps_equal_a_search_by_halves(spark, recordings, budget):
    df = spark.createDataFrame([(r, p, t) for r, rows in recordings.items() for p, t in rows], "rec string, packet long, at long")
    got = {r["rec"]: r["step"] for r in clocks.choose_step(df, 60, 157, budget).collect()}
    want = {r: searched(rows, 60, 157, budget) for r, rows in recordings.items()}
    assert got == want and {60, 157} <= set(want.values()) and any(60 < s < 157 for s in want.values())
    assert clocks.choose_step(df.limit(0), 60, 157, budget).count() == 0


def test_packet_times_equal_a_loop(spark, recordings):
    df = spark.createDataFrame([(r, p, t) for r, rows in recordings.items() for p, t in rows], "rec string, packet long, at long")
    schedule = clocks.paced_schedule(df.join(clocks.choose_step(df, 60, 157, 20_000), "rec"), F.col("step"))
    packets = spark.createDataFrame([(r, i) for r in recordings for i in range(0, 4200, 7)] + [("none", 5)], "rec string, packet long")
    for pause in (13_500, 900):
        got = {(r["rec"], r["packet"]): r["when"] for r in clocks.packet_times(packets, schedule, pause).collect()}
        assert got.pop(("none", 5)) is None
        for r, rows in recordings.items():
            step = searched(rows, 60, 157, 20_000)
            at = solved(rows, step)
            assert all(got[r, i] == arrival(at, step, pause, i) for i in range(0, 4200, 7)), r
    known = {(r["rec"], r["packet"]): r["paced"] for r in schedule.collect()}
    own = clocks.packet_times(df.select("rec", "packet"), schedule).collect()
    assert all(known[r["rec"], r["packet"]] == r["when"] for r in own)  # a row of the schedule stands at its own time
