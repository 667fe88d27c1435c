"""The stateful processors on shuffled waves, run with plain stand-ins for Spark's states, timers and watermark."""

import random

import pytest
from pyspark.sql import Row

from tapeloom.streaming import streams as st


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(list(self.value or [])) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):  # noqa: N802
        self.value = (self.value or []) + rows

    def clear(self):
        self.value = None


class Lists(State):
    def get(self):
        return iter(self.value or [])


class Handle:
    def __init__(self):
        self.timers, self.states = set(), []

    def getListState(self, name, schema):  # noqa: N802
        self.states.append(Lists())
        return self.states[-1]

    def getValueState(self, name, schema):  # noqa: N802
        self.states.append(State())
        return self.states[-1]

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def play(make, waves, late, closing=10**9):
    """All rows that the waves of (key, us, ...) give; and the handles of the keys at the end, past `closing` seconds."""
    keys, out, top = {}, [], 0
    for wave in [*waves, []]:
        mark = max(0, top - late * 10**6) // 1000 if wave else closing * 1000
        groups = {}
        for key, us, *rest in wave:
            groups.setdefault(key, []).append(Row(key, us, us, *rest))
            top = max(top, us)
        for key, rows in groups.items():
            if key not in keys:
                keys[key] = (make(), Handle())
                keys[key][0].init(keys[key][1])
            out += keys[key][0].handleInputRows((key,), iter(rows), Mark(mark))
        mark = max(0, top - late * 10**6) // 1000 if wave else closing * 1000
        for key, (processor, handle) in keys.items():
            while due := sorted(t for t in handle.timers if t < mark):
                handle.timers.remove(due[0])
                out += processor.handleExpiredTimer((key,), Mark(mark), None)
    return out, {k: h for k, (_, h) in keys.items()}


def shuffled(rows, rng, late, waves):
    """Rows dealt to waves by the time at which they arrive, which is up to `late` seconds after their own."""
    rows = sorted(rows, key=lambda r: r[1] + rng.random() * late * 10**6)
    cuts = sorted(rng.sample(range(1, len(rows)), waves - 1))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for p in parts:
        rng.shuffle(p)
    return parts


def states_left(handles):
    return [k for k, h in handles.items() if h.timers or any(s.value for s in h.states)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_shuffled_waves_equal_ordered_ones(seed):
    rng = random.Random(seed)
    rows = [(key, 10**6 * (5 + 7 * i) + rng.randrange(10**6), 0.0, rng.choice(["a", "b", "b", None, "__end__"])) for key in "xyz" for i in range(40)]
    rows = [(k, us, us / 1e6, s) for k, us, _, s in rows]
    want = []
    for key in "xyz":
        own, run = sorted(r for r in rows if r[0] == key), None
        for _, _, t, s in own:
            if run and run[1] == s:
                run = (key, s, run[2], t, run[4] + 1)
                continue
            if run:
                want.append((key, run[1], run[2], t, run[3], run[4]))
            run = None if s in (None, "__end__") else (key, s, t, t, 1)
    out, handles = play(lambda: st._Runs("rec", "__end__", 86400.0), shuffled(rows, rng, 30, 9), 40)
    assert sorted(map(tuple, out)) == sorted(want)
    assert states_left(handles) == []


@pytest.mark.parametrize("seed", range(4))
def test_marks_apart_and_rising_rows_of_shuffled_waves(seed):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(10**6, 3 * 10**8), 90))
    rows = [("x", us, us / 1e6) for us in times]
    want, last = [], None
    for _, _, t in rows:
        if last is None or t >= last + 9.5:
            want.append(("x", t))
            last = t
    out, handles = play(lambda: st._Apart("rec", "t", 9.5), shuffled(rows, rng, 20, 7), 25)
    assert sorted(map(tuple, out)) == want and states_left(handles) == []

    rows = [("x", us, n, rng.random() + n / 60) for n, us in enumerate(times)]
    want, top = [], float("-inf")
    for _, _, n, t in rows:
        if t > top:
            want.append(("x", n, t))
            top = t
    out, handles = play(lambda: st._Rising("rec", "t", "seq", "long", 3600.0), shuffled(rows, rng, 20, 7), 25)
    assert sorted(map(tuple, out)) == want and states_left(handles) == []


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_shuffled_waves_equal_the_batch_blocks(spark, seed):
    from tapeloom.operators import breaks

    rng = random.Random(seed)
    time, silences = 20.0, {}
    for _ in range(220):
        time += rng.choice([15.0, 15.1, 30.0, 14.7, 60.0, 7.3, 22.0, 120.3, 400.0])
        silences[round(time, 3)] = round(rng.random() * 1.4, 3)
    frame = spark.createDataFrame([("x", t, d) for t, d in silences.items()], "rec string, time double, dur double")
    blocks = breaks.break_blocks(breaks.break_candidates(frame), min_score=0.5, min_fill=0.3, fewest=2).collect()
    want = sorted((r["rec"], r["start"], r["end"], r["junctions"], round(r["score"], 9)) for r in blocks)
    rows = [("x", round(t * 10**6), t, d) for t, d in silences.items()]
    out, handles = play(lambda: st._Chain("rec", 15.0, 8, 0.5, 0.3, 2), shuffled(rows, rng, 60, 12), 70)
    assert sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in out) == want and len(want) > 5
    assert states_left(handles) == []


def test_state_of_a_chain_is_bounded_and_late_rows_are_dropped():
    rows = [[("x", 10**6 * 15 * (n + 1), 15.0 * (n + 1), 0.9)] for n in range(300)]
    processor, handle = st._Chain("rec", 15.0, 8, 0.6, 0.6, 3), Handle()
    processor.init(handle)
    for n, wave in enumerate(rows):
        mark = 15_000 * n
        list(processor.handleInputRows(("x",), iter([Row(k, us, us, *r) for k, us, *r in wave]), Mark(mark)))
        for due in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(due)
            list(processor.handleExpiredTimer(("x",), Mark(mark), None))
        assert len(list(processor.rows.get())) < 40 and (not processor.held.exists() or len(processor.held.get()[1]) < 12)
    before = list(processor.rows.get())
    list(processor.handleInputRows(("x",), iter([Row("x", 10**6, 10**6, 1.0, 0.5)]), Mark(10**7)))
    assert list(processor.rows.get()) == before
