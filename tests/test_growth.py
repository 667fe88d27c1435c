"""What a task or a call takes on doesn't grow with the input: stream states, ranges of bytes, files of a wave."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_streams import Handle, Mark, play, shuffled, states_left

from tapeloom.functions import greedy
from tapeloom.operators import breaks, capacity, graph, intervals
from tapeloom.queries import streams as queries
from tapeloom.sources import transport
from tapeloom.streaming import streams as st


def play_bucket(processor, waves, late, closing):
    """As play, with all keys in one bucket; also the bucket's handle and the calls to its state store."""
    handle, out, top, calls = Handle(), [], 0, []
    processor.init(handle)
    for name in ("appendList", "put", "get"):
        for state in handle.states:
            was = getattr(state, name)
            setattr(state, name, lambda *a, was=was: (calls.append(1), was(*a))[1])
    for wave in [*waves, []]:
        mark = max(0, top - late * 10**6) // 1000 if wave else closing * 1000
        out += processor.handleInputRows((0,), iter([Row(0, us, key, us, *rest) for key, us, *rest in wave]), Mark(mark))
        top = max([top, *(us for _, us, *_ in wave)])
        mark = max(0, top - late * 10**6) // 1000 if wave else closing * 1000
        while due := sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(due[0])
            out += processor.handleExpiredTimer((0,), Mark(mark), None)
    return out, handle, len(calls)


MAKERS = {
    "runs": (lambda: st._Runs("rec", "__end__", 3600.0), lambda rng, us: (us / 1e6, rng.choice(["a", "b", None, "__end__"]))),
    "apart": (lambda: st._Apart("rec", "t", 9.5), lambda rng, us: (us / 1e6,)),
    "rising": (lambda: st._Rising("rec", "t", "seq", "long", 3600.0), lambda rng, us: (us, rng.random())),
    "chain": (lambda: st._Chain("rec", 15.0, 8, 0.5, 0.3, 2), lambda rng, us: (us / 1e6, rng.random() * 1.4)),
}


@pytest.mark.parametrize("name", MAKERS)
def test_keys_of_a_bucket_give_what_each_gives_alone(name):
    rng = random.Random(7)
    make, rest = MAKERS[name]
    rows = [(key, us, *rest(rng, us)) for key in range(60) for us in rng.sample(range(10**6, 9 * 10**8, 10**6 // 2), 50)]
    waves = shuffled(rows, rng, 30, 6)
    want, _ = play(make, waves, 40, 10**6)
    found, handle, calls = play_bucket(st.Bucketed(make()), waves, 40, 10**6)
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and len(want) > 60
    assert states_left({0: handle}) == [] and calls < 200  # not some for each of 60 keys and 6 waves


def test_short_ranges_share_tasks(tmp_path):
    for n in range(300):
        (tmp_path / f"{n}.ts").write_bytes(b"\x47" * (1000 + n))
    tasks = transport.TransportReader({"path": str(tmp_path), "range_bytes": "400"}, ["pid"]).partitions()
    ranges = [(r.path, r.lo, r.hi) for task in tasks for r in task.ranges]
    assert len(tasks) <= 250 and len(ranges) == len(set(ranges)) == 999
    assert sum(hi - lo for _, lo, hi in ranges) == sum(1000 + n for n in range(300))


def test_waves_of_large_contents_are_many_files(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_BYTES", 10_000)
    rows = spark.range(100).select("id", F.encode(F.repeat(F.lit("x"), 1000), "UTF-8").alias("content"), F.lit(None).cast("string").alias("none"))
    assert queries._files_of_wave(rows, 2) == 6 and queries._files_of_wave(rows.select("id"), 2) == 1 and queries._files_of_wave(rows.limit(0), 2) == 1


ROUNDS = {
    "apart": (greedy, lambda rows: greedy.keep_apart(rows.select("rec", "t"), "rec", "t", F.col("t") + 3), 12),
    "chains": (breaks, lambda rows: breaks.chain_lengths(rows.select("rec", F.col("t").alias("a"), F.when(F.col("t") < 9, F.col("t") + 1).alias("b"))), 30),
    "components": (graph, lambda rows: graph.components(rows.select(F.col("n").alias("node")), rows.filter("n < 29").select(F.col("n").alias("a"), (F.col("n") + 1).alias("b"))), 30),
}


@pytest.mark.parametrize("name", ROUNDS)
def test_stored_states_are_not_broadcast_by_size_of_file(name, spark, monkeypatch, capsys):
    module, run, want = ROUNDS[name]
    stored = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df: (df.explain(), stored(df))[1])
    rows = spark.range(30).select((F.col("id") % 3).alias("rec"), F.floor(F.col("id") / 3).alias("t"), F.col("id").alias("n"))
    found = run(rows)
    found.explain()
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans
    assert found.count() == want


def test_written_clocks_hold_one_sort(spark, capsys):
    holes = spark.range(30).select((F.col("id") % 3).alias("rec"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.5).alias("end"))
    bounds = spark.range(4).select(F.col("id").alias("rec"), F.lit(40.0).alias("duration"))
    found = intervals.clock_per_written(holes, bounds)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count(" Sort [") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == [(0, 1.6), (1, 1.6), (2, 1.6), (3, 1.0)]


def test_rates_of_a_repeated_recording_are_given_once_a_row(spark):
    recs = spark.createDataFrame([(1, 9.0, 20.0, "h264", 10.0), (1, 9.0, 20.0, "h264", 10.0), (None, 9.0, 20.0, "h264", 10.0), (2, 9.0, 20.0, "h264", None)], "rec long, video_rate double, file_rate double, codec string, duration double")
    tracks = spark.createDataFrame([(1, "aac", 5000.0, 2, 48000, 16)], "rec long, codec string, rate double, channels int, sample_rate int, bits int")
    holes = spark.createDataFrame([(1, -5.0, 1.0), (1, 8.0, 30.0), (1, 9.0, 8.0), (1, 0.5, 1.0), (1, None, 0.25), (None, 0.0, 5.0), (2, 1.0, 2.0), (7, 1.0, 2.0)], "rec long, start double, end double")
    found = capacity.rates(recs, tracks, holes=holes)
    want = [(1, 9.0 * 10 / 7, 5000.0), (1, 9.0 * 10 / 7, 5000.0), (2, 9.0, 0.0), (None, 9.0, 0.0)]
    assert sorted(map(repr, map(tuple, found.select("rec", "video", "audio").collect()))) == sorted(map(repr, want))
