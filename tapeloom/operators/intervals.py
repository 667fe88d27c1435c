"""Interval algebra over half-open [start, end) rows of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Key, anchored, as_of, before, keys, ordered, overlap_join, overlaps_any, shuffled_unions, so_far
from ..functions.scans import highest, islands_in, running

#: The default bucket of interval joins, in seconds; about the length of the longer intervals.
BUCKET = 3600.0


def merge_intervals(df: DataFrame, key: Key = "rec", start: str = "start", end: str = "end", width: float | None = None) -> DataFrame:
    """Unions of overlapping or touching intervals; empty and inverted ones are dropped.

    With a `width` (of start), a recording's rows are scanned in blocks (see scans.running).
    """
    k = keys(key)
    real = df.filter(F.col(end) > F.col(start)).select(*k, F.col(start).alias("start"), F.col(end).alias("end"))
    rows = running(real, k, ["start", "end"], width, __reach=highest(F.col("end"), here=False))
    marked = islands_in(rows, F.col("start") > F.col("__reach"), k, ["start", "end"], width)
    return marked.groupBy(*k, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(cuts: DataFrame, bounds: DataFrame, key: Key = "rec", least: float = 1e-6) -> DataFrame:
    """What cuts leave of [lo, hi] of each key in bounds; pieces up to `least` long are dropped."""
    k = keys(key)
    edges = merge_intervals(cuts, k).join(bounds.select(*k, "lo", "hi"), k)
    inside = edges.filter((F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")))
    stops = inside.select(*k, F.col("start").alias("a"), F.col("end").alias("b"))
    tail = bounds.select(*k, F.col("hi").alias("a"), F.col("hi").alias("b"))
    rows = stops.unionByName(tail).join(bounds.select(*k, "lo"), k)
    w = ordered(k, "a", "b")
    gaps = rows.select(*k, F.coalesce(F.lag("b").over(w), F.col("lo")).alias("start"), F.col("a").alias("end"))
    return gaps.filter(F.col("end") - F.col("start") > least)


def subtract(keeps: DataFrame, holes: DataFrame, key: Key = "rec") -> DataFrame:
    """The parts of merged keeps outside of holes, from running depths over both sides' bounds."""
    k = keys(key)

    def edges(df: DataFrame, name: str) -> DataFrame:
        both = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
        return df.filter("end > start").select(*k, F.explode(both).alias("e")).select(*k, "e.at", F.col("e.d").alias(name))

    steps = edges(keeps, "keep").unionByName(edges(holes, "hole"), allowMissingColumns=True)
    steps = steps.groupBy(*k, "at").agg(F.coalesce(F.sum("keep"), F.lit(0)).alias("keep"), F.coalesce(F.sum("hole"), F.lit(0)).alias("hole"))
    w = so_far(k, "at")
    depth = steps.select(*k, F.col("at").alias("start"), F.lead("at").over(ordered(k, "at")).alias("end"), F.sum("keep").over(w).alias("kd"), F.sum("hole").over(w).alias("hd"))
    return merge_intervals(depth.filter("kd > 0 AND hd = 0 AND end IS NOT NULL"), k)


def covered_seconds(spans: DataFrame, others: DataFrame, key: Key = "rec", bucket: float = BUCKET) -> DataFrame:
    """I4: for each span the seconds that the union of others covers, and those it leaves."""
    k = keys(key)
    union = merge_intervals(others, k).select(*k, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    spans = spans.select(*k, "start", "end")
    met = overlap_join(spans, union, k, bucket).groupBy(*k, "start", "end").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("covered"))
    out = spans.distinct().join(met, [*k, "start", "end"], "left")
    covered = F.coalesce("covered", F.lit(0.0))
    return out.select(*k, "start", "end", covered.alias("covered"), (F.col("end") - F.col("start") - covered).alias("uncovered"))


def overlap_semi(df: DataFrame, others: DataFrame, key: Key = "rec") -> DataFrame:
    """Rows whose interval overlaps one of others."""
    right = others.select(*keys(key), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlaps_any(df, right, key, name="__met").filter("__met").drop("__met")


def overlap_anti(df: DataFrame, others: DataFrame, key: Key = "rec") -> DataFrame:
    """Rows whose interval overlaps none of others."""
    right = others.select(*keys(key), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlaps_any(df, right, key, name="__met").filter("NOT __met").drop("__met")


def kept_seconds(df: DataFrame, key: Key = "rec") -> DataFrame:
    """The summed lengths, an inverted interval counting as nothing."""
    return df.groupBy(*keys(key)).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("kept"))


def unplayed(plays: DataFrame, bounds: DataFrame, key: Key = "rec", least: float = 0.1) -> DataFrame:
    """Stretches of [0, duration) that no play holds, each `least` seconds or more; none without plays.

    bounds: duration, and head, the first picture's time. The stretch ahead of the first play begins at 0,
    but is one only if that play begins `least` or more after the head.
    """
    k = keys(key)
    w = ordered(k, "start")
    rows = merge_intervals(plays, k)
    rows = rows.withColumn("__ahead", F.lag("end").over(w)).withColumn("__next", F.lead("start").over(w))
    ahead = F.col("__ahead")
    late = F.coalesce(F.col("start") - F.greatest("head", F.lit(0.0)) >= least, F.col("start") >= least)
    ahead_gap = F.struct(F.when(ahead.isNotNull(), ahead).when(late, F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    tail_gap = F.struct(F.when(F.col("__next").isNull(), F.col("end")).alias("start"), F.col("duration").alias("end"))
    found = rows.join(bounds.select(*k, "head", "duration"), k).select(*k, "duration", F.explode(F.array(ahead_gap, tail_gap)).alias("g")).filter("g.start IS NOT NULL AND duration > 0")
    clipped = found.select(*k, F.greatest(F.col("g.start"), F.lit(0.0)).alias("start"), F.least("g.end", "duration").alias("end"))
    return clipped.filter(F.col("end") - F.col("start") >= least)


def grid_before(t: Column, anchor: Column, frame: Column, early: float = 0.0) -> Column:
    """The last grid time anchor + n * frame at or before t (+ early)."""
    return anchor + F.floor((t + early - anchor) / frame + 1e-9) * frame


def snap_intervals(cuts: DataFrame, points: DataFrame, key: Key = "rec", frame: float = 1001 / 30000, early: float = 512 / 90000, seams: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """I8: start up to the next picture (within `early` of one counts as on it), end down to the current one; then merged.

    The picture grid runs from the nearest point at or before the bound; without one the bound stays. With seams
    (time) it runs from the nearest point since the last seam, and a bound ahead of every point of its stretch
    goes to the first point on; one at 0 or below stays, and intervals that come out empty are dropped. With bounds
    (duration) a bound at or past the recording's end stays too, and none goes beyond it; where no duration is told there is no end.
    """
    k = keys(key)
    slack = 0.0 if seams is None else frame / 100
    fd = F.lit(float(frame))
    rows = cuts.select(*k, "start", "end")
    rows = rows.withColumn("__until", F.lit(None).cast("double")) if bounds is None else rows.join(bounds.select(*k, F.col("duration").cast("double").alias("__until")), k, "left")
    rows = anchored(rows, points, k, "start", seams, slack).withColumnsRenamed({"anchor": "sa", "following": "sf"})
    rows = anchored(rows, points, k, "end", seams, slack).withColumnsRenamed({"anchor": "ea", "following": "ef"})
    steps = F.ceil((F.col("start") - early - slack - F.col("sa")) / fd - 1e-9)
    up = F.col("sa") + (steps if seams is None else F.greatest(steps, F.lit(0))) * fd
    down = grid_before(F.col("end"), F.col("ea"), fd, slack)
    if seams is not None:
        up, down = F.when(F.col("start") > 0, F.coalesce(up, "sf")), F.when(F.col("end") > 0, F.coalesce(F.greatest(down, F.col("ea")), "ef"))

    def held(side: str, moved: Column) -> Column:
        inside = F.col("__until").isNull() | (F.col(side) < F.col("__until"))
        return F.when(inside, F.least(F.coalesce(moved, F.col(side)), "__until")).otherwise(F.col(side)).alias(side)

    snapped = rows.select(*k, held("start", up), held("end", down))
    return merge_intervals(snapped if seams is None else snapped.filter("end > start"), k)


def clip_cues(cues: DataFrame, windows: DataFrame, key: Key = "rec", bucket: float = BUCKET) -> DataFrame:
    """Cues cut to the kept windows they meet and moved to output time; those outside are dropped."""
    k = keys(key)
    w = windows.select(*k, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("shift"))
    met = overlap_join(cues, w, k, bucket)
    rest = [c for c in cues.columns if c not in (*k, "start", "end")]
    return met.select(*k, *rest, (F.greatest("start", "b_start") + F.col("shift")).alias("start"), (F.least("end", "b_end") + F.col("shift")).alias("end"))


def place_cues(cues: DataFrame, own: str = "own", arrival: str = "arrival", behind: float = 1.0, ahead: float = 30.0) -> DataFrame:
    """A cue's instant is its own time unless that is too far behind or ahead of its arrival."""
    off = (F.col(own) < F.col(arrival) - behind) | (F.col(own) > F.col(arrival) + ahead)
    return cues.withColumn("placed", F.when(off | F.col(own).isNull(), F.col(arrival)).otherwise(F.col(own)))


def with_clock(bounds: DataFrame, holes: DataFrame, key: Key = "rec") -> DataFrame:
    """Bounds with ``ratio``, duration over the part of it outside of holes, which count within [0, duration]; 1 where all or none is written.

    Both sides are united and sorted once per key, and windows over that order tell a row of bounds what its
    holes take, so that a task holds one sort for all steps, which rows of bounds leave in the order of the key.
    """
    shuffled_unions(bounds.sparkSession)
    k = keys(key)
    rest = [c for c in bounds.columns if c not in k]
    known = holes.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in k))
    both = known.select(*k, F.greatest(F.col("start"), F.lit(0.0)).alias("__start"), F.col("end").cast("double").alias("__end"))
    both = both.unionByName(bounds.select(*k, F.struct(*rest).alias("__row")), allowMissingColumns=True)
    by = ordered(k, "__start", "__end")
    entire = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.withColumn("__to", F.when(F.col("__row").isNull(), F.least("__end", F.max("__row.duration").over(entire))))
    rows = rows.withColumn("__reach", F.max(F.when(F.col("__to") > F.col("__start"), F.col("__to"))).over(before(k, "__start", "__end")))
    new = F.col("__to") - F.greatest("__start", "__reach")
    rows = rows.withColumn("__lost", F.sum(F.when(new > 0, new)).over(entire)).filter("__row IS NOT NULL")
    duration = F.col("__row.duration")
    written = duration - F.coalesce("__lost", F.lit(0.0))
    ratio = F.when((duration > 0) & (written > 0), duration / written).otherwise(F.lit(1.0))
    return rows.select(*[F.col(c) if c in k else F.col("__row")[c].alias(c) for c in bounds.columns], ratio.alias("ratio"))


def clock_per_written(holes: DataFrame, bounds: DataFrame, key: Key = "rec") -> DataFrame:
    """The ratio of with_clock for each row of bounds."""
    k = keys(key)
    return with_clock(bounds.select(*k, "duration"), holes, k).select(*k, "ratio")


def split_at_seams(ranges: DataFrame, seams: DataFrame, points: DataFrame, key: Key = "rec", bucket: float = BUCKET) -> DataFrame:
    """Ranges cut at seams (time; pictures before it end at `ends`), starting at the first point past each seam.

    Pieces that hold no point are dropped, the first piece of a range keeps the range's start.
    """
    k = keys(key)
    s = seams.select(*k, F.col("time").alias("b_start"), (F.col("time") + 1e-9).alias("b_end"), "ends")
    inside = overlap_join(ranges.select(*k, "start", "end"), s, k, bucket).filter("b_start > start AND b_start < end")
    marks = inside.select(*k, F.col("start").alias("r0"), F.col("end").alias("r1"), F.col("b_start").alias("at"), F.col("ends"))
    first = ranges.select(*k, F.col("start").alias("r0"), F.col("end").alias("r1"), F.col("start").alias("at"), F.lit(None).cast("double").alias("ends"))
    rows = marks.unionByName(first)
    w = ordered([*k, "r0", "r1"], "at")
    pieces = rows.select(*k, "r0", "r1", "at", F.coalesce(F.lead("ends").over(w), F.lead("at").over(w), F.col("r1")).alias("end"), (F.row_number().over(w) > 1).alias("past_seam"))
    p = points.select(*k, F.col("t").alias("pt"), F.col("t").alias("first_point"))
    found = as_of(pieces, p, k, "at", "pt", ["first_point"], forward=True).filter(F.col("first_point") < F.col("end"))
    return found.select(*k, F.when(F.col("past_seam"), F.col("first_point")).otherwise(F.col("at")).alias("start"), "end")


def unwritten(seams: DataFrame, points: DataFrame, frame: float, key: Key = "rec") -> DataFrame:
    """Stretches that no cut writes: from where pictures stop at a seam (time, ends) to the first point past it.

    A point half a frame ahead of the seam is past it; without one the stretch ends at the seam. Stretches
    of half a frame or less are none.
    """
    k = keys(key)
    eps = frame / 2
    rows = seams.select(*k, "time", F.least("ends", "time").alias("start"), (F.col("time") - eps).alias("__past"))
    rows = as_of(rows, points.select(*k, F.col("t").alias("at"), F.col("t").cast("double").alias("__point")), k, "__past", "at", ["__point"], forward=True)
    return rows.select(*k, "start", F.coalesce("__point", "time").alias("end")).filter(F.col("end") - F.col("start") > eps)


def mend_seams(seams: DataFrame, tails: DataFrame, points: DataFrame, key: Key = "rec", frame: float = 1001 / 30000, walked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(seams, points), mended by what the stretch ahead of each seam ends with.

    seams: seam, at (its byte), time, ends. tails, by seam: shown_end, where the last picture of the stretch ends; broken_from, the byte of
    breakage; key_at and key_lead, byte and own lead of its last key picture; any may be null. points: t, pos, lead_start.
    A seam's `ends` moves back to shown_end where that is more than a quarter frame earlier. Of points that were `walked`, not
    read from a map, those of the stretch go that stand a quarter frame ahead of `ends` or later, that lie past the breakage, or that are
    its last key picture with a lead over a quarter frame earlier than the key's own. Points past the last seam, and without a byte, stay.
    """
    k, short = keys(key), frame / 4
    joined = seams.join(tails.select(*k, "seam", "shown_end", "broken_from", "key_at", "key_lead"), [*k, "seam"], "left")
    early = F.col("ends") - F.col("shown_end") > short
    mended = joined.withColumn("ends", F.when(early, F.col("shown_end")).otherwise(F.col("ends")))
    out = mended.select(*seams.columns)
    if not walked:
        return out, points
    begins = F.coalesce(F.lag("at").over(ordered(k, "at")), F.lit(0))
    stretch = F.struct((F.col("ends") - short).alias("stop"), "broken_from", F.when(F.col("key_at") >= begins, F.col("key_at")).alias("key_at"), "key_lead")
    told = mended.withColumn("tail", stretch).select(*k, F.col("at").alias("__at"), "tail")
    rows = as_of(points, told, k, "pos", "__at", ["tail"], forward=True, strict=True)
    leads = (F.col("pos") == F.col("tail.key_at")) & (F.col("lead_start") < F.col("tail.key_lead") - short)
    gone = (F.col("pos") >= 0) & ((F.col("t") >= F.col("tail.stop")) | (F.col("pos") >= F.col("tail.broken_from")) | leads)
    return out, rows.filter(~F.coalesce(gone, F.lit(False))).select(*points.columns)


def replace_stretches(seams: DataFrame, points: DataFrame, firsts: DataFrame, fresh: DataFrame, key: Key = "rec", slack: float = 1.0) -> DataFrame:
    """Points, those of a stretch replaced by `fresh` ones where its first claimed time is over `slack` seconds off.

    A stretch runs from a seam's byte `at` to the next one's. firsts: seam and `first`, the time of the key picture at the
    stretch's first byte; a stretch without it, or without fresh points (seam and points' columns), keeps its own. A stretch that claims none is replaced.
    Points ahead of the first seam and without a byte stay.
    """
    k = keys(key)
    own = as_of(points, seams.select(*k, F.col("at").alias("__at"), F.col("seam").alias("__seam")), k, "pos", "__at", ["__seam"])
    own = own.withColumn("__seam", F.when(F.col("pos") >= 0, F.col("__seam")))
    claimed = own.filter("__seam IS NOT NULL").groupBy(*k, F.col("__seam").alias("seam")).agg(F.min("t").alias("claimed"))
    off = firsts.filter("first IS NOT NULL").join(claimed, [*k, "seam"], "left").filter(F.col("claimed").isNull() | (F.abs(F.col("claimed") - F.col("first")) > slack))
    off = off.join(fresh.select(*k, "seam").distinct(), [*k, "seam"], "left_semi").select(*k, "seam")
    kept = own.join(off.withColumnRenamed("seam", "__seam"), [*k, "__seam"], "left_anti").select(*points.columns)
    return kept.unionByName(fresh.join(off, [*k, "seam"], "left_semi").select(*points.columns))
