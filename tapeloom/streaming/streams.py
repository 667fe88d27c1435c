"""Structured Streaming forms of the operators; on closed data each equals its batch form."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby
from math import floor

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.frames import Key, keys
from ..operators.runs import level_byte
from ..sources.archive import file_identity, new_or_changed


def stream_level_outline(stream: DataFrame, ts: str = "ts", level: str = "level", step: str = "50 milliseconds", late: str = "1 minute", key: Key = "rec") -> DataFrame:
    """Peak and RMS of each bucket as bytes, once the watermark has passed it."""
    rows = stream.withWatermark(ts, late).groupBy(*keys(key), F.window(ts, step).alias("w"))
    out = rows.agg(F.max(level).alias("top"), F.sqrt(F.avg(F.col(level) * F.col(level))).alias("mean"))
    return out.select(*keys(key), F.col("w.start").alias("start"), level_byte(F.col("top")).alias("peak"), level_byte(F.col("mean")).alias("rms"))


def stream_moving_mean(stream: DataFrame, ts: str = "ts", value: str = "value", length: str = "10 seconds", slide: str = "1 second", late: str = "1 minute", key: Key = "rec") -> DataFrame:
    """Means over overlapping windows."""
    rows = stream.withWatermark(ts, late).groupBy(*keys(key), F.window(ts, length, slide).alias("w"))
    return rows.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys(key), F.col("w.start").alias("start"), "mean", "n")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session's streams keep state in RocksDB meanwhile, which list states, timers and large states need."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    was = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Ordered(StatefulProcessor):
    """Rows of a key wait in a list until the watermark has passed them by `lag` seconds, then go on in order of time.

    A row is (us, ...) with its event time in microseconds. One timer of a key stands at the time at which its earliest row may
    go on; when it fires, `passed` gets the rows in order. A key that has no rows left and has been silent for `idle` seconds
    is forgotten, or sooner where `passed` says so. Rows that come when the watermark has passed them are dropped, as elsewhere in Spark.
    """

    rows_schema, held_schema = "", ""

    def __init__(self, idle: float, lag: float = 0.0) -> None:
        self.idle, self.lag = int(idle * 1_000_000), int(lag * 1_000_000)

    def passed(self, key: tuple, rows: list[tuple], later: list[tuple], held: tuple | None) -> tuple[list[Row], tuple | None, int | None]:
        """What rows and what is held give, and what to hold; later rows wait on. The third value is until when to hold it, if not for `idle`."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.held, self.due = handle.getListState("rows", self.rows_schema), handle.getValueState("held", self.held_schema), handle.getValueState("due", "at long")

    def _wake(self, us: int) -> None:
        """Let the key's timer fire once the watermark is past us, unless it fires sooner."""
        at = us // 1000 + 1
        if self.due.exists():
            due = self.due.get()[0]
            if due <= at:
                return
            self.handle.deleteTimer(due)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [tuple(r)[len(key) + 1 :] for r in rows]  # the key and the event time lead
        fresh = [r for r in fresh if r[0] > mark]
        if fresh:
            self.rows.appendList(fresh)
            self._wake(min(r[0] for r in fresh) + self.lag)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        out, later, held, due = self.step(key, list(self.rows.get()), self.held.get() if self.held.exists() else None, mark)
        self.rows.put(later) if later else self.rows.clear()
        self.held.update(held) if held is not None else self.held.clear()
        if due is not None:
            self._wake(due)
        return iter(out)

    def step(self, key: tuple, waiting: list[tuple], held: tuple | None, mark: int) -> tuple[list[Row], list[tuple], tuple | None, int | None]:
        """What a key gives once the watermark is at `mark`; the rows that wait on, what is held, and when (us) to go on with the key."""
        waiting = sorted(waiting)
        ready = [r for r in waiting if r[0] + self.lag <= mark]
        later = waiting[len(ready) :]
        out, held, until = self.passed(key, ready, later, held)
        if later:
            return out, later, held, later[0][0] + self.lag
        if held is None:
            return out, later, None, None
        until = held[0] + self.idle if until is None else until
        return (out, later, None, None) if until <= mark else (out, later, held, until)


#: Groups that the keys of a stream are dealt to.
BUCKETS = 1024
#: Rows of a bucket that go to the state store as one value.
CHUNK = 4096


class Bucketed(Ordered):
    """A processor for all keys of a bucket: their states lie in the bucket's lists, so that one call to the state store serves many keys.

    Rows and what is held lead with the key; what is held has the time (us) at which to go on with the key behind it. Both are stored in
    chunks, as a value costs the state store far more than the rows in it. A fired timer goes on with the keys that are due and leaves the others as they are.
    """

    rows_schema = held_schema = "chunk binary"

    def __init__(self, inner: Ordered) -> None:
        super().__init__(0)
        self.inner, self.lag = inner, inner.lag

    @staticmethod
    def _chunks(rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[i : i + CHUNK]),) for i in range(0, len(rows), CHUNK)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows, self.held, self.due = handle.getListState("rows", self.rows_schema), handle.getListState("held", self.held_schema), handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [r for r in (tuple(r)[2:] for r in rows) if r[1] > mark]  # the bucket and the event time lead
        if fresh:
            self.rows.appendList(self._chunks(fresh))
            self._wake(min(r[1] for r in fresh) + self.lag)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        waiting: dict[object, list[tuple]] = {}
        for (chunk,) in self.rows.get():
            for row in pickle.loads(chunk):
                waiting.setdefault(row[0], []).append(row[1:])
        held = {row[0]: (row[1:-1], row[-1]) for (chunk,) in self.held.get() for row in pickle.loads(chunk)}
        out, rows, kept, wakes = [], [], [], []
        for own in [*waiting, *(own for own in held if own not in waiting)]:
            mine, (what, due) = waiting.get(own, []), held.get(own, (None, None))
            due = min(r[0] for r in mine) + self.lag if mine else due
            if due <= mark:
                found, mine, what, due = self.inner.step((own,), mine, what, mark)
                out += found
            rows += [(own, *r) for r in mine]
            if what is not None:
                kept.append((own, *what, due))
            if due is not None:
                wakes.append(due)
        self.rows.put(self._chunks(rows)) if rows else self.rows.clear()
        self.held.put(self._chunks(kept)) if kept else self.held.clear()
        if wakes:
            self._wake(min(wakes))
        return iter(out)


def _in_order(stream: DataFrame, processor: Ordered, key: str, ts: str, late: str, columns: list[Column | str], out: str, buckets: int | None = None) -> DataFrame:
    """The processor's rows. Its keys are dealt to `buckets` groups (BUCKETS, if not told), each with one state of all its keys; with 0, each key has a state of its own.

    A row of the stream leads with what it is grouped by and its event time, which carries the watermark.
    """
    kind, buckets = stream.schema[key].dataType.simpleString(), BUCKETS if buckets is None else buckets
    own = [F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket"), ts, key] if buckets else [key, ts]
    rows = stream.withWatermark(ts, late).select(*own, F.unix_micros(ts).alias("us"), *columns)
    groups = rows.groupBy("__bucket" if buckets else key)
    return groups.transformWithState(Bucketed(processor) if buckets else processor, f"{key} {kind}, {out}", "append", "eventTime")


class _Runs(Ordered):
    rows_schema, held_schema = "us long, t double, state string", "us long, state string, start double, last double, n long"

    def __init__(self, key: str, end: str, idle: float) -> None:
        super().__init__(idle)
        self.key, self.end = key, end

    def passed(self, key, rows, later, held):
        out = []
        for name, group in groupby(rows, key=lambda r: r[2]):
            own = list(group)
            if held and held[1] == name:
                held = (own[-1][0], name, held[2], own[-1][1], held[4] + len(own))
                continue
            if held:
                out.append(Row(**{self.key: key[0], "state": held[1], "start": held[2], "end": own[0][1], "last": held[3], "pictures": held[4]}))
            held = None if name is None or name == self.end else (own[-1][0], name, own[0][1], own[-1][1], len(own))
        return out, held, None


def stream_runs(stream: DataFrame, key: str = "rec", ts: str = "ts", t: str = "t", state: str = "state", end: str = "__end__", late: str = "1 minute", idle: float = 86400.0) -> DataFrame:
    """Runs of one state as the next row closes them; a row of the state `end`, or of none, closes the last run.

    Rows may come in any order as long as the watermark (`late` behind the latest event time ts) has not passed them. The open run
    of a key that is silent for `idle` seconds of event time is let go without an end.
    """
    return _in_order(stream, _Runs(key, end, idle), key, ts, late, [F.col(t).cast("double").alias("t"), F.col(state).cast("string").alias("state")], "state string, start double, end double, last double, pictures long")


class _Apart(Ordered):
    rows_schema, held_schema = "us long, t double", "us long, last double"

    def __init__(self, key: str, t: str, gap: float) -> None:
        super().__init__(0)
        self.key, self.t, self.gap = key, t, gap

    def passed(self, key, rows, later, held):
        out = []
        for us, t in rows:
            if held is None or t >= held[1] + self.gap:
                held = (us, t)
                out.append(Row(**{self.key: key[0], self.t: t}))
        # a mark after the gap is kept whatever came before
        return out, held, held and held[0] + int(self.gap * 1_000_000) + 1


def stream_debounce(stream: DataFrame, key: str = "rec", ts: str = "ts", t: str = "t", gap: float = 2.0, late: str = "1 minute") -> DataFrame:
    """Marks at least `gap` seconds after the last kept one.

    Rows may come in any order ahead of the watermark; ts is t as an event time. The last kept mark is held until the watermark is
    `gap` past it, from when on it can't keep a mark out.
    """
    return _in_order(stream, _Apart(key, t, gap), key, ts, late, [F.col(t).cast("double").alias("t")], f"{t} double")


class _Rising(Ordered):
    held_schema = "us long, latest double"

    def __init__(self, key: str, t: str, order: str, kind: str, idle: float) -> None:
        super().__init__(idle)
        self.key, self.t, self.order = key, t, order
        self.rows_schema = f"us long, seq {kind}, t double"

    def passed(self, key, rows, later, held):
        out = []
        for us, seq, t in rows:
            if held is None or t > held[1]:
                held = (us, t)
                out.append(Row(**{self.key: key[0], self.order: seq, self.t: t}))
            else:
                held = (us, held[1])
        return out, held, None


def stream_monotone(stream: DataFrame, key: str = "rec", ts: str = "ts", t: str = "t", order: str = "seq", late: str = "1 minute", idle: float = 86400.0) -> DataFrame:
    """Rows later than all rows before them; any step back is dropped, however small.

    Rows go in the order of ts, their arrival as an event time, and then of `order`; they may come in any order ahead of the
    watermark. A key that is silent for `idle` seconds of event time is forgotten with its latest time.
    """
    kind = stream.schema[order].dataType.simpleString()
    return _in_order(stream, _Rising(key, t, order, kind, idle), key, ts, late, [F.col(order).alias("seq"), F.col(t).cast("double").alias("t")], f"{order} {kind}, {t} double")


class _Chain(Ordered):
    """Silences wait until all that could lie within four hops have come; what is held is the open block, and the last silences that a hop may start from."""

    #: Hops on either side beyond which a score doesn't grow.
    HOPS = 4
    rows_schema = "us long, time double, dur double"
    held_schema = "us long, recent array<struct<time:double,dur:double,back:int>>, start double, end double, dur double, junctions long, total double"

    def __init__(self, key: str, unit: float, most: int, min_score: float, min_fill: float, fewest: int) -> None:
        self.reach = (most + 0.05) * unit
        super().__init__(0, self.HOPS * self.reach)
        self.key, self.unit, self.most, self.min_score, self.min_fill, self.fewest = key, unit, most, min_score, min_fill, fewest

    def on_grid(self, a: tuple, b: tuple) -> bool:
        """D1 of two silences (time, dur, ...), a the earlier one."""
        gap, slack = b[0] - a[0], min((a[1] + b[1]) / 2, 0.04 * self.unit) + 0.01 * self.unit
        n = floor(gap / self.unit + 0.5)
        return 1 <= n <= self.most and abs(gap - n * self.unit) <= slack

    def ahead(self, at: int, rows: list[tuple]) -> int:
        hops = 0
        while hops < self.HOPS:
            near = (j for j in range(at + 1, len(rows)) if rows[j][0] - rows[at][0] <= self.reach)
            found = next((j for j in near if self.on_grid(rows[at], rows[j])), None)
            if found is None:
                return hops
            at, hops = found, hops + 1
        return hops

    def block(self, key: tuple, held: tuple) -> list[Row]:
        _, _, start, end, _, n, total = held
        slots = max(floor((end - start) / self.unit + 0.5), 1) + 1
        return [Row(**{self.key: key[0], "start": start, "end": end, "junctions": n, "score": total / n})] if n >= self.fewest and n / slots >= self.min_fill else []

    def passed(self, key, rows, later, held):
        out = []
        _, recent, *open_ = held or (0, [], None, None, None, 0, 0.0)
        recent = [tuple(x) for x in recent]
        silences = [r[1:] for r in rows + later]
        for i, (us, time, dur) in enumerate(rows):
            recent = [x for x in recent if time - x[0] <= self.reach]
            back = next((min(x[2] + 1, self.HOPS) for x in reversed(recent) if self.on_grid(x, (time, dur))), 0)
            recent.append((time, dur, back))
            score = 0.5 * min(dur, 1.0) + 0.5 * min((back + self.ahead(i, silences)) / self.HOPS, 1.0)
            if score >= self.min_score:
                start, end, last, n, total = open_
                if n and self.on_grid((end, last), (time, dur)):
                    open_ = [start, time, dur, n + 1, total + score]
                else:
                    if n:
                        out += self.block(key, (0, [], *open_))
                    open_ = [time, time, dur, 1, score]
            held = (us, recent, *open_)
        if held and not later:  # no silence came within reach of the last one: its block is whole
            return out + (self.block(key, held) if held[5] else []), None, None
        return out, held, None


def stream_break_chain(
    stream: DataFrame, key: str = "rec", ts: str = "ts", unit: float = 15.0, late: str = "1 minute", most: int = 8, min_score: float = 0.6, min_fill: float = 0.6, fewest: int = 3
) -> DataFrame:
    """Blocks of chained silences (time, dur), as D2 and D3 find them, once no later silence can change them.

    A score grows with four hops at most, so a silence's score is known when the watermark is four hops past it. State holds
    the silences of that time, the open block's sums and how long the chains behind are, never a whole session. Times of one key are distinct, and
    ts is `time` as an event time.
    """
    columns = [F.col("time").cast("double").alias("time"), F.col("dur").cast("double").alias("dur")]
    return _in_order(stream, _Chain(key, unit, most, min_score, min_fill, fewest), key, ts, late, columns, "start double, end double, junctions long, score double")


def stream_take_new(stream: DataFrame, path: str, checkpoint: str):
    """A writer that hands over what has come since the last take, once each, as Parquet files."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_append_new(stream: DataFrame, table: str, checkpoint: str, key: Key = "path"):
    """A writer that adds rows whose key the Parquet table at a path does not hold yet; one of a batch's equals."""
    k = keys(key)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch that runs again finds its own folder, leaves it out and overwrites it
        there = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(table).filter(~F.col("_metadata.file_path").contains(f"/batch-{number}/"))
        fresh = batch.dropDuplicates(k).join(there.select(*k), k, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch-{number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True)


def stream_new_recordings(stream: DataFrame, manifest: DataFrame, version: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer that passes only new or changed files of a binaryFile-like stream (path, length, modified, content)."""

    def passed(batch: DataFrame, number: int) -> None:
        sink(new_or_changed(file_identity(batch, version), manifest), number)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(passed).trigger(availableNow=True)


def stream_programme_join(stream: DataFrame, programmes: DataFrame, key: Key = "service_id", t: str = "t") -> DataFrame:
    """Stream rows with the programme on air at their time: [from, to) of the static side."""
    on = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in keys(key)]
    inside = (F.col(f"s.{t}") >= F.col("p.from")) & (F.col(f"s.{t}") < F.col("p.to"))
    cond = inside
    for o in on:
        cond = cond & o
    rest = [F.col(f"p.{c}") for c in programmes.columns if c not in keys(key)]
    return stream.alias("s").join(programmes.alias("p"), cond, "left").select("s.*", *rest)
