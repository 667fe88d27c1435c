"""Cut plans: access points, copy and re-encode segments, divisions, joined timelines."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, as_of, before, keys, ordered, overlap_join, shuffled_unions, so_far, whole
from ..functions.greedy import keep_apart
from ..operators.clocks import keep_offsets, source_to_output


def access_points(packets: DataFrame, key: Key = "rec", always_droppable: bool = False) -> DataFrame:
    """A row for each key packet: time, lead_start, lead_indices, droppable, pos.

    Pictures that follow it in decode order before the next key packet and are shown before it are
    its leading ones; they can be dropped if no other picture refers to them.
    """
    k = keys(key)
    w = so_far(k, "seq")
    rows = packets.withColumn("gop", F.sum(F.col("key").cast("int")).over(w)).filter("gop > 0")
    rows = rows.withColumn("head", F.first("pts").over(so_far([*k, "gop"], "seq"))).withColumn("i", F.row_number().over(ordered([*k, "gop"], "seq")) - 1)
    lead = ~F.col("key") & (F.col("pts") < F.col("head"))
    free = F.lit(True) if always_droppable else F.min(F.when(lead, ~F.col("reference") | F.coalesce("unreferenced", F.lit(False))))
    out = rows.groupBy(*k, "gop").agg(
        F.first("head").alias("time"),
        F.min(F.when(lead, F.col("pts"))).alias("lead"),
        F.array_sort(F.collect_list(F.when(lead, F.col("i")))).alias("lead_indices"),
        F.coalesce(free, F.lit(True)).alias("droppable"),
        F.min("pos").alias("pos"),
    )
    return out.select(*k, "time", F.coalesce("lead", "time").alias("lead_start"), "lead_indices", "droppable", "pos")


def entry_before(df: DataFrame, points: DataFrame, key: Key = "rec", t: str = "t", slack: float = 0.0) -> DataFrame:
    """The last point at or before t + slack."""
    k = keys(key)
    rows = df.withColumn("__at", F.col(t) + slack)
    return as_of(rows, points.select(*k, F.col("t").alias("at"), F.col("t").alias("entry")), k, "__at", "at", ["entry"]).drop("__at")


def nearest_point(df: DataFrame, points: DataFrame, key: Key = "rec", t: str = "t") -> DataFrame:
    """The nearest point, the earlier of two as near."""
    k = keys(key)
    p = points.select(*k, F.col("t").alias("at"))
    rows = as_of(df, p.withColumn("__lo", F.col("at")), k, t, "at", ["__lo"])
    rows = as_of(rows, p.withColumn("__hi", F.col("at")), k, t, "at", ["__hi"], forward=True)
    near = F.when(F.col("__hi").isNull() | (F.col(t) - F.col("__lo") <= F.col("__hi") - F.col(t)), F.col("__lo")).otherwise(F.col("__hi"))
    return rows.withColumn("nearest", F.coalesce(near, "__hi")).drop("__lo", "__hi")


def scene_step(df: DataFrame, scenes: DataFrame, key: Key = "rec", t: str = "t", eps: float = 1e-3, forward: bool = True) -> DataFrame:
    """The next scene after t + eps, or the previous before t - eps."""
    k = keys(key)
    rows = df.withColumn("__at", F.col(t) + (eps if forward else -eps))
    return as_of(rows, scenes.select(*k, F.col("t").alias("at"), F.col("t").alias("scene")), k, "__at", "at", ["scene"], forward=forward, strict=True).drop("__at")


def frames_between(a: Column, b: Column, phase: Column, frame: Column, duration: Column, slack: float = 0.01) -> Column:
    """P5: pictures of the grid through `phase` in [a, b); half a frame less where b is the recording's end."""
    stop = F.when(duration > 0, F.least(b, duration - frame / 2)).otherwise(b)
    first = lambda t: F.ceil((t - phase) / frame - slack)
    return F.when(stop <= a, F.lit(0)).otherwise(F.greatest(first(stop) - first(a), F.lit(0))).cast("long")


def frames_in(ranges: DataFrame, points: DataFrame, video: DataFrame, key: Key = "rec") -> DataFrame:
    """P5: ranges with `frames`, on the grid through the point nearest to the start (0 without one)."""
    k = keys(key)
    rows = nearest_point(ranges, points, k, "start").join(video.select(*k, "frame", "duration"), k)
    n = frames_between(F.col("start"), F.col("end"), F.coalesce("nearest", F.lit(0.0)), F.col("frame"), F.col("duration"))
    return rows.withColumn("frames", n).select(*ranges.columns, "frames")


def plan_ranges(ranges: DataFrame, points: DataFrame, video: DataFrame, key: Key = "rec", allow_open: bool = True, min_copy: float | None = None, bucket: float = 3600.0) -> DataFrame:
    """Segments (kind, start, end, copy_until, seek_from, frames) of each range (id, start, end).

    points: time t, lead_start, open, droppable. video: frame, gap (least distance of pictures),
    duration. The copy runs from the first point a copy can start at to the latest leading edge in
    reach (or the recording's end); what is left at either side is re-encoded, and so is all where
    the copy would be too short. Re-encoded pieces without a picture are dropped.
    """
    k = keys(key)
    first = points.groupBy(*k).agg(F.min("t").alias("first_point"))
    info = video.select(*k, "frame", "gap", "duration").join(first, k, "left")
    rows = ranges.select(*k, "id", F.col("start").alias("a"), F.col("end").alias("b")).join(info, k)
    rows = rows.withColumn("a", F.greatest("a", F.coalesce("first_point", F.lit(0.0)))).filter("b > a").withColumn("eps", F.col("gap") / 2).drop("first_point")
    usable = points if allow_open else points.filter("NOT open")
    reach = rows.withColumn("start", F.col("a") - F.col("eps")).withColumn("end", F.col("b") + F.col("eps"))
    p = usable.select(*k, F.least("t", "lead_start").alias("b_start"), F.col("t").alias("b_end"), "t", "lead_start", (~F.col("open") | F.col("droppable")).alias("can_start"))
    met = overlap_join(reach, p, k, bucket, closed=True)
    ident = [*k, "id", "a", "b"]
    inside = F.col("can_start") & (F.col("t") >= F.col("a") - F.col("eps")) & (F.col("t") <= F.col("b") + F.col("eps"))
    met = met.withColumn("k_first", F.min(F.when(inside, F.col("t"))).over(whole(ident)))
    ok = (F.col("t") > F.col("k_first") + F.col("eps")) & (F.col("lead_start") <= F.col("b") + F.col("eps"))
    facts = met.groupBy(*ident).agg(F.first("k_first").alias("k_first"), F.max(F.when(ok, F.struct("lead_start", "t"))).alias("stop"))
    rows = rows.join(facts, ident, "left")
    at_end = (F.col("duration") > 0) & (F.col("b") >= F.col("duration") - F.col("eps"))
    use_end = at_end & (F.col("stop").isNull() | (F.col("stop.lead_start") <= F.col("b")))
    rows = rows.withColumn("copy_end", F.when(use_end, F.col("b")).otherwise(F.col("stop.lead_start"))).withColumn("copy_until", F.when(~use_end, F.col("stop.t")))
    least = F.lit(float(min_copy)) if min_copy is not None else F.greatest(2 * F.col("frame"), F.lit(0.5))
    copies = F.coalesce(F.col("copy_end") - F.col("k_first") >= least, F.lit(False))
    none = F.lit(None).cast("double")
    seg = lambda kind, s, e, until: F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), until.alias("copy_until"))
    head = F.when(F.col("k_first") - F.col("a") >= F.col("gap") - 1e-9, seg("reencode", F.col("a"), F.col("k_first"), none))
    tail = F.when(F.col("b") - F.col("copy_end") > F.col("eps"), seg("reencode", F.col("copy_end"), F.col("b"), none))
    body = seg("copy", F.col("k_first"), F.col("copy_end"), F.col("copy_until"))
    parts = F.when(copies, F.array(head, body, tail)).otherwise(F.array(seg("reencode", F.col("a"), F.col("b"), none)))
    segs = rows.select(*k, "id", "gap", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("s")).select(*k, "id", "gap", "s.*")
    segs = frames_in(segs, points, video, k)
    segs = segs.join(video.select(*k, F.col("frame").alias("fd")), k)
    fine = frames_in(segs.drop("frames", "fd"), points, video.select(*k, F.col("gap").alias("frame"), "duration"), k).withColumnRenamed("frames", "fine")
    segs = segs.join(fine.select(*k, "id", "kind", "start", "fine"), [*k, "id", "kind", "start"])
    segs = segs.withColumn("frames", F.when((F.col("frames") == 0) & (F.col("gap") < F.col("fd")), F.col("fine")).otherwise(F.col("frames")))
    segs = segs.filter("kind <> 'reencode' OR frames > 0").select(*k, "id", "kind", "start", "end", "copy_until", "frames")
    return seek_back(segs, points, k).withColumn("seek_from", F.when(F.col("kind") == "copy", F.col("start")).otherwise(F.col("seek_from")))


def seek_back(df: DataFrame, points: DataFrame, key: Key = "rec", t: str = "start", back: int = 2) -> DataFrame:
    """Where to begin decoding for t: `back` points before the last one at or before it, the first at least."""
    k = keys(key)
    w = ordered(k, "t")
    p = points.select(*k, F.col("t").alias("at"), F.coalesce(F.lag("t", back).over(w), F.first("t").over(so_far(k, "t"))).alias("seek_from"))
    first = points.groupBy(*k).agg(F.min("t").alias("__first"))
    rows = as_of(df, p, k, t, "at", ["seek_from"]).join(first, k, "left")
    return rows.withColumn("seek_from", F.coalesce("seek_from", "__first", F.lit(0.0))).drop("__first")


def reencode_range(ranges: DataFrame, points: DataFrame, key: Key = "rec") -> DataFrame:
    """Each range as one re-encoded segment that starts no earlier than the first point."""
    k = keys(key)
    first = points.groupBy(*k).agg(F.min("t").alias("__f"))
    rows = ranges.join(first, k, "left").withColumn("start", F.greatest("start", F.coalesce("__f", F.lit(0.0)))).filter("end > start").drop("__f")
    return seek_back(rows.withColumn("kind", F.lit("reencode")), points, k)


def plan_totals(segments: DataFrame, key: Key = "rec") -> DataFrame:
    """Seconds copied and re-encoded."""
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("end") - F.col("start")).otherwise(0.0))
    return segments.groupBy(*keys(key)).agg(part("copy").alias("copied"), part("reencode").alias("reencoded"))


def clean_join(segments: DataFrame, points: DataFrame, key: Key = "rec", budget: float = 10.0, min_copy: float = 0.5, eps: float = 0.02) -> DataFrame:
    """A copy behind a re-encoded head starts at the next point within `budget` that begins a sequence."""
    k = keys(key)
    w = ordered([*k, "id"], "start")
    rows = segments.withColumn("__n", F.row_number().over(w)).withColumn("__prev", F.lag("kind").over(w)).withColumn("__next", F.lead("kind").over(w))
    p = points.filter("starts_sequence").select(*k, F.col("t").alias("at"), F.col("t").alias("clean"))
    rows = as_of(rows.withColumn("__from", F.when((F.col("__n") == 1), F.col("end")).otherwise(F.col("start")) - eps), p, k, "__from", "at", ["clean"], forward=True)
    at = F.when(F.col("__n") == 1, F.col("end")).otherwise(F.col("start"))
    pair = ((F.col("__n") == 2) & (F.col("kind") == "copy") & (F.col("__prev") == "reencode")) | ((F.col("__n") == 1) & (F.col("kind") == "reencode") & (F.col("__next") == "copy"))
    copy_end = F.when(F.col("__n") == 2, F.col("end")).otherwise(F.lead("end").over(w))
    moves = pair & (F.col("clean") > at + 1e-6) & (F.col("clean") <= at + budget + eps) & (copy_end - F.col("clean") >= min_copy)
    rows = rows.withColumn("__m", F.coalesce(moves, F.lit(False)))
    start = F.when(F.col("__m") & (F.col("__n") == 2), F.col("clean")).otherwise(F.col("start"))
    end = F.when(F.col("__m") & (F.col("__n") == 1), F.col("clean")).otherwise(F.col("end"))
    rest = [c for c in segments.columns if c not in (*k, "start", "end")]
    return rows.select(*k, *rest, start.alias("start"), end.alias("end"))


def move_to_pictures(ranges: DataFrame, points: DataFrame, video: DataFrame, key: Key = "rec") -> DataFrame:
    """On coarse clocks, bounds within two ticks of a picture go to two ticks ahead of it; none at the end.

    video: frame, tick, duration, variable. A tick over a hundredth of a frame is coarse; it counts
    as a twelfth of a frame at most.
    """
    k = keys(key)
    v = video.select(*k, "frame", F.least("tick", F.col("frame") / 12).alias("tick"), "duration", "variable")
    rows = ranges
    for side in ("start", "end"):
        rows = nearest_point(rows, points, k, side).withColumnRenamed("nearest", f"__{side}")
    rows = rows.join(v, k)
    coarse = ~F.col("variable") & (F.col("tick") > F.col("frame") * 0.01)

    def moved(side: str) -> Column:
        phase = F.coalesce(f"__{side}", F.lit(0.0))
        grid = phase + F.round((F.col(side) - phase) / F.col("frame")) * F.col("frame")
        near = F.abs(F.col(side) - grid) <= 2 * F.col("tick")
        return F.when(coarse & near & (F.col(side) < F.col("duration") - F.col("frame") / 2), grid - 2 * F.col("tick")).otherwise(F.col(side))

    rest = [c for c in ranges.columns if c not in (*k, "start", "end")]
    return rows.select(*k, *rest, moved("start").alias("start"), moved("end").alias("end"))


def division_problems(keeps: DataFrame, key: Key = "rec", parts: int | None = None, every: float | None = None, size: float | None = None, rate: str = "rate", frame: float = 1 / 30, most: int = 999) -> DataFrame:
    """Recordings that divide_ranges leaves whole, with the reason: nothing, frame, weight, second or many.

    Nothing is left to divide; parts would be a frame or less; the weight isn't known; parts of that
    size would be under a second; there would be more than `most` parts.
    """
    k = keys(key)
    rows = keeps.groupBy(*k).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("total"), (F.max(rate) if size is not None else F.lit(None).cast("double")).alias("rate"))
    total, weight = F.col("total"), F.col("rate")
    reason = F.when(total <= 2 * frame, "nothing")
    if parts is not None:
        reason = reason.when(total / parts <= frame, "frame")
    elif every is not None:
        reason = reason.when(F.ceil(total / every) > most, "many")
    else:
        length = F.lit(float(size)) / weight
        reason = reason.when(weight.isNull() | F.isnan(weight) | (weight <= 0), "weight").when(length < 1, "second").when(F.ceil(total / length) > most, "many")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select(*k, "reason")


class _Divider:
    """The cuts of one recording, found as its kept ranges and clean places go by in order of output time.

    Held are the last cut, the last place and the one behind it, and two ranges: nothing that grows with the recording.
    """

    def __init__(self, step: float, total: float, count: int, frame: float, head: float, down: bool) -> None:
        self.step, self.total, self.count, self.frame, self.head, self.down = step, total, count, frame, head, down
        self.last, self.prev, self.turn, self.cuts = total - frame, 0.0, 1, []
        self.below = self.above = None
        self.ranges: list[tuple[float, float, float]] = []

    def target(self) -> float:
        return min(self.prev + self.step, self.last) if self.down else self.turn * self.step

    def take(self, at: float, place: bool, other: float | None, end: float | None) -> None:
        """A place with the one behind it, or a range's output start with its source start and end."""
        while self.turn <= self.count and at > self.target() + 1e-9:
            self.decide()
        if place:
            self.below, self.above = (at if at >= 0 else None), other
        else:
            self.ranges = [*self.ranges[-1:], (at, other, end)]

    def finish(self) -> list[tuple[float, bool]]:
        while self.turn <= self.count:
            self.decide()
        return self.cuts

    def decide(self) -> None:
        """Cut at the place near enough to the target, or else on the frame grid within the range there; or not at all."""
        t, lo = self.target(), self.prev + self.frame / 2
        if self.down:
            near = self.below if self.below is not None and self.below > lo and self.below >= t - self.step / 2 else None
        else:
            fit = [c for c in (self.below, self.above) if c is not None and lo < c < self.last and abs(c - t) <= self.step / 2]
            near = min(fit, key=lambda c: (abs(c - t), c), default=None)
        out, start, end = next(r for r in reversed(self.ranges) if r[0] <= t or r is self.ranges[0])
        s = start + t - out
        steps = (s - self.head) / self.frame
        grid = self.head + (floor(steps + 1e-6) if self.down else floor(abs(steps) + 0.5) * (1 if steps >= 0 else -1)) * self.frame
        exact = out if grid < start else out + end - start if grid > end - 1e-9 else t + grid - s
        join = grid < start and out > 0 or grid > end - 1e-9
        o = exact if near is None else near
        good = near is not None or lo < o < self.last + self.frame / 2
        if good and not (self.down and self.prev + self.step >= self.total - 1e-9):
            self.cuts.append((o, near is not None or join))
            self.prev = o
            self.turn += 1
        else:
            self.turn = self.count + 1 if self.down else self.turn + 1


def divide_ranges(keeps: DataFrame, points: DataFrame, key: Key = "rec", parts: int | None = None, every: float | None = None, size: float | None = None, rate: str = "rate", frame: float = 1 / 30, head: float = 0.0, on_points: bool = True, most: int = 999) -> DataFrame:
    """Cuts (n, out, src, on_point) that divide kept ranges, laid end to end, by parts, seconds or bytes.

    A cut goes to the nearest clean place, a point or a join, within half a part; by size to the last
    one at or before the target. Without one it goes to the frame grid from `head`. Cuts rise by
    half a frame at least. Each cut is measured from the one before it: ranges and places of a recording pass in order through
    one task, sorted by Spark, which holds the last of each (see _Divider) and never all of them. For size, keeps carry the rate of
    bytes a second. Parameters out of range raise ValueError; recordings that cannot be divided have no
    cuts, and division_problems tells them and why.
    """
    if sum(x is not None for x in (parts, every, size)) != 1 or (parts is not None and not 2 <= parts <= most) or (every is not None and every < 1):
        raise ValueError("divide into 2 to 999 parts, or by seconds of one or more, or by bytes")
    shuffled_unions(keeps.sparkSession)
    k = keys(key)
    offs = keep_offsets(keeps, k)
    rows = offs.groupBy(*k).agg(F.max(F.col("out_start") + F.col("end") - F.col("start")).alias("total"))
    if size is not None:
        rows = rows.join(keeps.groupBy(*k).agg(F.max(rate).alias("__rate")), k)
    rows = rows.join(division_problems(keeps, k, parts, every, size, rate, frame, most).select(*k), k, "left_anti")
    step = F.col("total") / parts if parts else F.lit(float(every)) if every else F.lit(float(size)) / F.col("__rate")
    count = F.lit(parts - 1) if parts else F.floor((F.col("total") - frame) / step) if every else F.ceil(F.col("total") / step) * 2
    ranges = offs.join(rows.select(*k, "total", step.alias("step"), count.cast("long").alias("count")), k)
    line = ranges.select(*k, F.col("out_start").alias("at"), F.lit(False).alias("place"), F.col("start").alias("other"), "end", "total", "step", "count")
    if on_points:
        inner = points.select(*k, F.col("t").alias("b_start"), (F.col("t") + 1e-9).alias("b_end"))
        on = overlap_join(offs, inner, k, 3600.0).filter((F.col("b_start") > F.col("start") + frame / 2) & (F.col("b_start") < F.col("end") - frame / 2))
        places = on.select(*k, (F.col("out_start") + F.col("b_start") - F.col("start")).alias("c")).unionByName(offs.filter("out_start > 0").select(*k, F.col("out_start").alias("c")))
        places = keep_apart(places, k, "c", F.col("c") + frame / 2)
        ahead = offs.select(*k).distinct().select(*k, F.lit(-1.0).alias("c"))  # so that the first place is known as the one behind
        places = places.unionByName(ahead).withColumn("other", F.lead("c").over(ordered(k, "c")))
        line = line.unionByName(places.select(*k, F.col("c").alias("at"), F.lit(True).alias("place"), "other"), allowMissingColumns=True)
    # of a recording, its first range comes first and tells its length
    line = line.withColumn("first", F.col("place") | (F.col("at") > 0)).repartition(*k).sortWithinPartitions(*k, "first", "at", F.desc("place"), "other")
    down = size is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None

        def cuts(kinds: list[pa.DataType]) -> pa.RecordBatch:
            found = now.finish() if now else []
            columns = [pa.array([v] * len(found), t) for v, t in zip(own or [None] * len(kinds), kinds, strict=True)]
            columns += [pa.array(range(1, len(found) + 1), pa.int32()), pa.array([o for o, _ in found], pa.float64()), pa.array([j for _, j in found], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, [*k, "n", "out", "on_point"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in k]
            for *mine, at, place, other, end, total, step, count in zip(*(batch.column(c).to_pylist() for c in [*k, "at", "place", "other", "end", "total", "step", "count"]), strict=True):
                if mine != own:
                    yield cuts(kinds)
                    own, now = mine, None
                    if total is not None:
                        now = _Divider(step, total, count, frame, head, down)
                if now:
                    now.take(at, place, other, end)
        if kinds:
            yield cuts(kinds)

    named = ", ".join(f"{c} {line.schema[c].dataType.simpleString()}" for c in k)
    found = line.drop("first").mapInArrow(run, f"{named}, n int, out double, on_point boolean")
    where = as_of(found, offs.select(*k, F.col("out_start").alias("__o"), F.col("start").alias("__s")), k, "out", "__o", ["__o", "__s"])
    return where.select(*k, "n", "out", (F.col("__s") + F.col("out") - F.col("__o")).alias("src"), "on_point")


def stream_weight(recordings: DataFrame, tracks: DataFrame, key: Key = "rec", sound_share: float = 1.2) -> DataFrame:
    """P10: bytes a second of pictures and sound in the container: video_rate, and each track's rate, in bits."""
    k = keys(key)
    sound = tracks.groupBy(*k).agg(F.sum("rate").alias("sound"))
    rows = recordings.join(sound, k, "left")
    return rows.select(*k, ((F.col("video_rate") + F.coalesce("sound", F.lit(0.0)) * sound_share) / 8 * F.coalesce("share", F.lit(1.0))).alias("weight"))


def join_timeline(clips: DataFrame, key: Key = "rec", order: str = "n", longest: float = 30.0) -> DataFrame:
    """Clips (length, crossing to the next: overlaps, seconds) with what crossings take and output offsets.

    A crossing that overlaps takes its length from both clips and shortens the output by it; any
    other takes half from each.
    """
    k = keys(key)
    w = ordered(k, order)
    d = F.when(F.col("seconds") > 0, F.least("seconds", F.lit(longest))).otherwise(0.0)
    takes = F.when(F.lead(order).over(w).isNull(), 0.0).when(F.col("overlaps"), d).otherwise(d / 2)
    rows = clips.withColumn("takes_after", takes).withColumn("__over", F.when(F.col("overlaps"), F.col("takes_after")).otherwise(0.0))
    rows = rows.withColumn("takes_before", F.coalesce(F.lag("takes_after").over(w), F.lit(0.0)))
    start = F.coalesce(F.sum(F.col("length") - F.col("__over")).over(before(k, order)), F.lit(0.0))
    return rows.withColumn("out_start", start).drop("__over")


def chapters(keeps: DataFrame, marks: DataFrame, key: Key = "rec") -> DataFrame:
    """Numbered chapters in output time: where each kept range begins, and the source marks that survive."""
    k = keys(key)
    begins = keep_offsets(keeps, k).select(*k, F.col("out_start").alias("t"))
    mapped = source_to_output(marks.select(*k, "t"), keeps, k).filter("out IS NOT NULL").select(*k, F.col("out").alias("t"))
    rows = begins.unionByName(mapped).distinct()
    return rows.withColumn("chapter", F.row_number().over(ordered(k, "t")))


def live_marks(marks: DataFrame, keeps: DataFrame, key: Key = "rec", picture: float = 1 / 30) -> DataFrame:
    """Marks whose material survives; of those within half a picture in output time the later stays."""
    k = keys(key)
    rows = source_to_output(marks, keeps, k).filter("out IS NOT NULL")
    after = F.lead("out").over(ordered(k, "out", "t"))
    return rows.withColumn("__n", after).filter(F.col("__n").isNull() | (F.col("__n") - F.col("out") > picture / 2)).drop("__n")


def straddling_rows(frames: DataFrame, edges: DataFrame, key: Key = "rec", bucket: float = 60.0) -> DataFrame:
    """Frames (first, length in samples) that hold an edge inside but do not start there; a tail edge counts as edge - 1."""
    k = keys(key)
    f = frames.withColumn("start", F.col("first").cast("double")).withColumn("end", (F.col("first") + F.col("length")).cast("double"))
    at = F.when(F.col("side") == "tail", F.col("edge") - 1).otherwise(F.col("edge")).cast("double")
    e = edges.select(*k, "edge", "side", at.alias("b_start"), (at + 0.5).alias("b_end"))
    aligned = F.when(F.col("side") == "tail", F.col("first") + F.col("length") == F.col("edge")).otherwise(F.col("first") == F.col("edge"))
    return overlap_join(f, e, k, bucket).filter(~aligned).select(*k, "first", "length", "edge", "side")


def audible_outside(frames: DataFrame, level: float = 0.001, samples: str = "samples") -> DataFrame:
    """Whether samples outside of [keep_from, keep_to) of a frame exceed the level."""
    loud = F.exists(F.transform(samples, lambda v, i: (F.abs(v) > level) & ((i < F.col("keep_from")) | (i >= F.col("keep_to")))), lambda x: x)
    return frames.withColumn("audible", loud)
