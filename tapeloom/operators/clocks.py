"""Clocks: wraps, restarts, stretches put end to end, maps between times and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Key, anchored, as_of, before, from_here, islands, keys, middle, ordered, overlap_join, so_far, whole
from ..functions.scans import previous, running, total
from ..functions.storage import materialise
from ..functions.timecode import HZ, WRAP
from .gaps import systematic


def rebase_time(df: DataFrame, ticks: str, base: float, key: Key = "rec", start: str | None = None) -> DataFrame:
    """Seconds from ticks of `base` seconds, from `start` (a column), or else from the key's first."""
    t = F.col(ticks) * base
    zero = F.col(start) if start else F.min(t).over(whole(key))
    return df.withColumn("t", t - zero)


def unwrap_clock(df: DataFrame, key: Key = "rec", order: str = "seq", clock: str = "clock", wrap: int = WRAP, width: float | None = None) -> DataFrame:
    """The clock with a wrap added after each fall of more than half of one; `back` flags the smaller falls.

    With a `width` (of order), a recording's rows are scanned in blocks by many tasks (see scans.running).
    """
    rows = running(df, key, [order], width, __was=previous(F.col(clock)))
    step = F.col(clock) - F.col("__was")
    rows = rows.withColumn("__wrap", F.coalesce((step < -wrap / 2).cast("long"), F.lit(0).cast("long"))).withColumn("back", F.coalesce((step < 0) & (step >= -wrap / 2), F.lit(False)))
    rows = running(rows, key, [order], width, __turns=total(F.col("__wrap")))
    return rows.select(*df.columns, (F.col(clock) + F.col("__turns") * wrap).alias("unwrapped"), "back")


def clock_restarts(points: DataFrame, key: Key = "rec", pos: str = "pos", t: str = "t", fall: float = 0.25, leap: float = 2**32 / HZ) -> DataFrame:
    """T5: the first point, in byte order, that falls back behind the latest time so far or leaps ahead of it."""
    k = keys(key)
    latest = F.max(t).over(before(k, pos))
    odd = points.filter(F.col(pos) >= 0).withColumn("latest", latest).filter((F.col(t) < F.col("latest") - fall) | (F.col(t) > F.col("latest") + leap))
    first = odd.groupBy(*k).agg(F.min(F.struct(pos, t, "latest")).alias("f"))
    return first.select(*k, "f.*")


def clock_pieces(points: DataFrame, sequences: DataFrame, key: Key = "rec", bucket: float = 1e6) -> DataFrame:
    """Where each stretch of bytes [at, until) begins, the shift that puts stretches end to end, and its first tick.

    A stretch's pace is its own bytes a second, or the recording's where it has too few points; its
    span is drawn out at that pace to its byte ends.
    """
    k = keys(key)
    p = points.select(*k, F.col("pos").cast("double").alias("b_start"), (F.col("pos") + 0.5).alias("b_end"), "t")
    s = sequences.select(*k, "at", "until", F.col("at").cast("double").alias("start"), F.col("until").cast("double").alias("end"))
    inside = overlap_join(s, p, k, bucket).filter("b_start >= start AND b_start < end")
    facts = inside.groupBy(*k, "at", "until").agg(F.min(F.struct("b_start", "t")).alias("a"), F.max(F.struct("b_start", "t")).alias("b"))
    facts = facts.withColumn("bytes", F.col("b.b_start") - F.col("a.b_start")).withColumn("secs", F.col("b.t") - F.col("a.t"))
    whole_pace = F.sum(F.when(F.col("secs") > 0, F.col("bytes"))).over(whole(k)) / F.sum(F.when(F.col("secs") > 0, F.col("secs"))).over(whole(k))
    pace = F.coalesce(F.when((F.col("secs") > 0) & (F.col("bytes") > 0), F.col("bytes") / F.col("secs")), whole_pace)
    facts = facts.withColumn("pace", pace).filter("pace > 0")
    lo = F.col("a.t") - (F.col("a.b_start") - F.col("at")) / F.col("pace")
    hi = F.col("b.t") + (F.col("until") - F.col("b.b_start")) / F.col("pace")
    spans = facts.select(*k, "at", lo.alias("lo"), hi.alias("hi"))
    placed = F.first("lo").over(so_far(k, "at")) + F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before(k, "at")), F.lit(0.0))
    return spans.select(*k, "at", F.round((placed - F.col("lo")) * HZ).cast("long").alias("shift"), F.round(F.col("lo") * HZ).cast("long").alias("from_tick"))


def restamp(df: DataFrame, pieces: DataFrame, key: Key = "rec", pos: str = "pos", ticks: str = "ticks", wrap: int = WRAP) -> DataFrame:
    """Ticks shifted by the last piece at or before the byte (the first piece before that), modulo the wrap."""
    k = keys(key)
    first = pieces.groupBy(*k).agg(F.min_by("shift", "at").alias("first_shift"))
    rows = as_of(df, pieces.select(*k, "at", "shift"), k, pos, "at", ["at", "shift"]).join(first, k, "left")
    return rows.select(*df.columns, F.pmod(F.col(ticks) + F.coalesce("shift", "first_shift", F.lit(0)), F.lit(wrap)).alias("restamped"))


def seams(pieces: DataFrame, key: Key = "rec") -> DataFrame:
    """Every piece but the first, with the time it starts from."""
    k = keys(key)
    rows = pieces.withColumn("__i", F.row_number().over(ordered(k, "at")))
    return rows.filter("__i > 1").select(*k, "at", (F.col("from_tick") / HZ).alias("time"))


def interpolate_between_anchors(df: DataFrame, anchors: DataFrame, key: Key = "rec", i: str = "i") -> DataFrame:
    """The clock at place i on the line through the anchors (i, clock) around it, by whole division towards zero.

    Beyond the ends the nearest two anchors give the line; a single anchor gives its clock everywhere.
    """
    k = keys(key)
    n = F.row_number().over(ordered(k, "i"))
    a = anchors.select(*k, F.col(i).alias("i"), "clock").withColumn("n", n)
    w = ordered(k, "i")
    # each anchor carries the segment that begins at it; the last one carries the segment before it
    seg = a.select(*k, "i", F.struct(F.coalesce(F.when(F.lead("i").over(w).isNotNull(), F.col("i")), F.lag("i").over(w), F.col("i")).alias("i0"),
                                     F.coalesce(F.when(F.lead("i").over(w).isNotNull(), F.col("clock")), F.lag("clock").over(w), F.col("clock")).alias("c0"),
                                     F.coalesce(F.lead("i").over(w), F.col("i")).alias("i1"), F.coalesce(F.lead("clock").over(w), F.col("clock")).alias("c1")).alias("s"), "n")
    first = seg.filter("n = 1").select(*k, F.col("s").alias("f"))
    rows = as_of(df, seg.select(*k, F.col("i").alias("at"), "s"), k, i, "at", ["s"]).join(first, k)
    s = F.coalesce("s", "f")
    rows = rows.withColumn("__num", (F.col(i) - s["i0"]) * (s["c1"] - s["c0"])).withColumn("__den", s["i1"] - s["i0"])
    # whole division: a quotient of doubles loses ticks beyond 2^53
    whole_part = F.when(F.col("__den") == 0, 0).otherwise(F.expr("__num div nullif(__den, 0)"))
    return rows.select(*df.columns, (s["c0"] + whole_part).alias("clock"))


def paced_schedule(df: DataFrame, step: float | Column, key: Key = "rec", at: str = "at", packet: str = "packet") -> DataFrame:
    """The latest schedule no later than `at` in which packets stand at least `step` apart, as one window.

    Going back, each time is the least of its own and the next one's less the packets between times step.
    """
    s = step if isinstance(step, Column) else F.lit(step)
    paced = F.min(F.col(at) - F.col(packet) * s).over(from_here(key, packet)) + F.col(packet) * s
    return df.withColumn("paced", paced)


def choose_step(df: DataFrame, fastest: int, nominal: int, budget: int, key: Key = "rec", at: str = "at", packet: str = "packet") -> DataFrame:
    """Per key the largest whole step from `fastest` to `nominal` whose schedule moves no row by more than the budget.

    Where none does, the fastest; a key of fewer than two rows takes the nominal step. at and packet are whole numbers, and
    packets differ. A row is moved furthest by one later row, so a step fits if for all pairs it is at most (rise of at + budget)
    over the rise of packet. From the nominal step on, each round finds a key's worst pair at its step in one window and
    takes the largest step that this pair allows, which is never too small; the keys whose step fits are done, the others go on.
    """
    k = keys(key)
    rows = materialise(df.select(*k, F.col(at).cast("long").alias("__at"), F.col(packet).cast("long").alias("__p")))
    steps = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"))
    open_ = materialise(steps.select(*k, F.lit(nominal).cast("long").alias("step"), (F.col("__n") > 1).alias("__go")))
    done = open_.filter("NOT __go").select(*k, "step")
    open_ = open_.filter("__go").select(*k, "step")
    ahead = Window.partitionBy(*k).orderBy("__p").rowsBetween(1, Window.unboundedFollowing)
    slack = lambda s: F.col("__at") - F.col("__p") * F.col(s)
    while not open_.isEmpty():
        met = rows.join(open_, k).withColumn("__worst", F.min(F.struct(slack("step").alias("v"), F.col("__p").alias("p"), F.col("__at").alias("at"))).over(ahead))
        pair = F.struct((slack("step") - F.col("__worst.v")).alias("moved"), (F.col("__worst.at") - F.col("__at") + budget).alias("rise"), (F.col("__worst.p") - F.col("__p")).alias("run"))
        worst = met.filter("__worst IS NOT NULL").groupBy(*k).agg(F.first("step").alias("step"), F.max(pair).alias("w"))
        fits = F.col("w.moved") <= budget
        # whole division rounds towards 0, the step towards the smaller; steps under the fastest all end as it
        most = F.when(F.col("w.rise") < 0, fastest).otherwise(F.greatest(F.expr("w.rise div w.run"), F.lit(fastest)))
        worst = materialise(worst.select(*k, F.when(fits, F.col("step")).otherwise(most).cast("long").alias("step"), (fits | (most <= fastest)).alias("__fits")))
        done = done.unionByName(worst.filter("__fits").select(*k, "step"))
        open_ = worst.filter("NOT __fits").select(*k, "step")
    return done


def packet_times(packets: DataFrame, schedule: DataFrame, pause: int = 13_500, key: Key = "rec", packet: str = "packet", paced: str = "paced", step: str = "step") -> DataFrame:
    """Packets with ``when``, their arrival under a schedule (key, packet, paced, step) of whole ticks.

    Between two rows of the schedule a packet stands a step before the next, and the room that the run does not need is dealt out at
    the ends of stretches of about `pause` ticks. Ahead of the first row packets stand a step apart, and past the last one too; a
    key without a schedule has no times. One as-of join each way finds the rows around a packet.
    """
    k = keys(key)
    s = schedule.select(*k, F.col(packet).cast("long").alias("__at"), F.col(packet).cast("long").alias("__p"), F.col(paced).cast("long").alias("__when"), F.col(step).cast("long").alias("__step"))
    i = F.col(packet).cast("long")
    rows = as_of(packets, s, k, packet, "__at", ["__p", "__when", "__step"], forward=True)
    rows = rows.withColumnsRenamed({"__p": "__np", "__when": "__nw", "__step": "__ns"})
    # a packet that carries a row of the schedule has the row before it behind
    rows = as_of(rows, s, k, packet, "__at", ["__p", "__when", "__step"], strict=True)
    rows = rows.withColumn("__back", F.col("__np") - i).withColumn("__count", F.col("__np") - F.col("__p")).withColumn("__slots", F.expr("(__nw - __when) div __ns"))
    rows = rows.withColumn("__spare", F.greatest(F.col("__slots") - F.col("__count"), F.lit(0)))
    plain = F.col("__nw") - F.col("__back") * F.col("__ns")
    stretch = F.greatest(F.expr(f"(__count * {pause}) div (__slots * __ns)"), F.lit(1))
    rows = rows.withColumn("__stretch", F.when(F.col("__spare") > 0, stretch))
    dealt = F.col("__nw") - (F.col("__back") + F.expr("((__back div __stretch) * __stretch * __spare) div __count")) * F.col("__ns")
    when = F.when(F.col("__np").isNull(), F.col("__when") + (i - F.col("__p")) * F.col("__step")).when(F.col("__p").isNull() | (F.col("__spare") == 0), plain).otherwise(dealt)
    return rows.select(*packets.columns, when.alias("when"))


def byte_to_time(df: DataFrame, points: DataFrame, key: Key = "rec", pos: str = "pos", reach: float = 2.0) -> DataFrame:
    """The time shown at a byte, from the point before it and, where later by `reach` at most, the one after it."""
    k = keys(key)
    w = ordered(k, "pos")
    p = points.select(*k, F.col("pos").alias("at"), F.struct("pos", "lead_start", F.lead("pos").over(w).alias("npos"), F.lead("lead_start").over(w).alias("nlead")).alias("p"))
    first = points.groupBy(*k).agg(F.min(F.struct("pos", "lead_start"))["lead_start"].alias("first"))
    rows = as_of(df, p, k, pos, "at", ["p"]).join(first, k)
    span = F.col("p.nlead") - F.col("p.lead_start")
    moved = F.col("p.lead_start") + span * (F.col(pos) - F.col("p.pos")) / (F.col("p.npos") - F.col("p.pos"))
    t = F.when(F.col("p").isNull(), F.col("first")).when((span > 0) & (span <= reach), moved).otherwise(F.col("p.lead_start"))
    return rows.select(*df.columns, t.alias("t"))


def grid_from_points(df: DataFrame, points: DataFrame, frame: float, key: Key = "rec", t: str = "t", seams: DataFrame | None = None) -> DataFrame:
    """T on the frame grid that runs from the nearest point at or before it (t itself without one).

    With seams (time) the point must not be before the last seam; without such a point, the next one is the time.
    """
    rows = anchored(df, points, key, t, seams, 0.0 if seams is None else frame / 100)
    grid = F.col("anchor") + F.floor((F.col(t) - F.col("anchor")) / frame + 0.25) * frame
    return rows.select(*df.columns, F.coalesce(grid, F.col("following"), F.col(t)).alias("grid"))


def keep_offsets(keeps: DataFrame, key: Key = "rec") -> DataFrame:
    """Kept ranges laid end to end: out_start of each, and whether it is the last."""
    k = keys(key)
    length = F.col("end") - F.col("start")
    rows = keeps.select(*k, "start", "end", F.coalesce(F.sum(length).over(before(k, "start")), F.lit(0.0)).alias("out_start"))
    return rows.withColumn("is_last", F.lead("start").over(ordered(k, "start")).isNull())


def source_to_output(df: DataFrame, keeps: DataFrame, key: Key = "rec", t: str = "t", seam: bool = False) -> DataFrame:
    """Output time of a source time: NULL where it is cut, or the seam it falls on. The last range's end is inside."""
    k = keys(key)
    o = keep_offsets(keeps, k)
    rows = as_of(df, o.select(*k, F.col("start").alias("at"), F.struct("start", "end", "out_start", "is_last").alias("o")), k, t, "at", ["o"])
    inside = (F.col(t) < F.col("o.end")) | (F.col("o.is_last") & (F.col(t) == F.col("o.end")))
    out = F.when(inside, F.col("o.out_start") + F.col(t) - F.col("o.start"))
    cut = F.coalesce(F.col("o.out_start") + F.col("o.end") - F.col("o.start"), F.lit(0.0)) if seam else F.lit(None).cast("double")
    return rows.select(*df.columns, F.coalesce(out, cut).alias("out"))


def output_to_source(df: DataFrame, keeps: DataFrame, key: Key = "rec", o: str = "o") -> DataFrame:
    """Source time of an output time; a join instant belongs to what follows, beyond the end is NULL."""
    k = keys(key)
    offs = keep_offsets(keeps, k)
    rows = as_of(df, offs.select(*k, F.col("out_start").alias("at"), F.struct("start", "end", "out_start").alias("k")), k, o, "at", ["k"])
    src = F.col("k.start") + F.col(o) - F.col("k.out_start")
    return rows.select(*df.columns, F.when(src <= F.col("k.end"), src).alias("src"))


def ranges_to_output(ranges: DataFrame, keeps: DataFrame, key: Key = "rec", bucket: float = 3600.0) -> DataFrame:
    """The parts of ranges that are kept, in output time."""
    k = keys(key)
    offs = keep_offsets(keeps, k).select(*k, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "out_start")
    met = overlap_join(ranges, offs, k, bucket)
    move = F.col("out_start") - F.col("b_start")
    rest = [c for c in ranges.columns if c not in (*k, "start", "end")]
    return met.select(*k, *rest, (F.greatest("start", "b_start") + move).alias("start"), (F.least("end", "b_end") + move).alias("end"))


def estimate_shift(table: DataFrame, pictures: DataFrame, frame: float, key: Key = "rec", n: int = 8) -> DataFrame:
    """The constant by which pictures differ from an index table, from n systematic entries.

    Each sample takes its nearest picture; the first is kept apart. NULL where the others spread
    over more than half a frame; else their upper median.
    """
    k = keys(key)
    s = systematic(table.select(*k, "t"), n, k, "t").withColumn("i", F.row_number().over(ordered(k, "t")))
    p = pictures.select(*k, F.col("t").alias("at"))
    rows = as_of(s, p.withColumn("lo", F.col("at")), k, "t", "at", ["lo"])
    rows = as_of(rows, p.withColumn("hi", F.col("at")), k, "t", "at", ["hi"], forward=True)
    near = F.when(F.col("hi").isNull() | (F.col("t") - F.col("lo") <= F.col("hi") - F.col("t")), F.col("lo")).otherwise(F.col("hi"))
    body = rows.withColumn("d", near - F.col("t")).filter("i > 1 AND d IS NOT NULL")
    spread = body.groupBy(*k).agg((F.max("d") - F.min("d")).alias("spread"))
    return spread.join(middle(body, k, "d"), k).select(*k, "spread", F.when(F.col("spread") <= frame / 2, F.col("median")).alias("shift"))


def continuous_runs(cells: DataFrame, key: Key = "rec", order: str = "n", back: float = 0.25, ahead: float = 1.0) -> DataFrame:
    """Runs of rows whose places adjoin and whose clock goes on; an unknown start goes on."""
    k = keys(key)
    w = ordered(k, order)
    step = F.col("t0") - F.lag("t1").over(w)
    goes_on = (F.col("first_pos") == F.lag("last_pos").over(w) + 1) & (F.col("t0").isNull() | F.lag("t1").over(w).isNull() | ((step >= -back) & (step <= ahead)))
    rows = islands(cells, ~goes_on, k, order)
    return rows.groupBy(*k, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.count(F.lit(1)).alias("cells")).drop("island")


def same_name_runs(items: DataFrame, key: Key = "rec", order: str = "n", name: str = "clip") -> DataFrame:
    """Runs of adjacent rows of one clip name."""
    k = keys(key)
    rows = islands(items, ~F.col(name).eqNullSafe(F.lag(name).over(ordered(k, order))), k, order)
    return rows.groupBy(*k, "island", name).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("items")).drop("island")
