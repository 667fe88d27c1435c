"""Runs, hysteresis, thinning and level outlines of timed rows, and template scores of their pictures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, keys, middle, ordered, whole
from ..functions.greedy import keep_apart
from ..functions.scans import highest, islands_in, latest, previous, running, total
from .gaps import median_gap
from .graph import components


def flat_runs(df: DataFrame, key: Key = "rec", t: str = "t", state: str = "state", min_count: int = 2, min_seconds: float = 0.0, order: tuple[str, ...] = (), length: str | None = None, width: float | None = None) -> DataFrame:
    """Maximal runs of one non-null state: start, end (the next row's time), last row's time, rows.

    A run that reaches the last row ends there plus the gap before it, or plus its own `length`
    where that gap is over four times the length. With a `width` (of t), rows are scanned in blocks (see scans.running).
    """
    k, by = keys(key), [t, *order]
    rows = running(df, k, by, width, back=True, __next=previous(F.col(t)))
    rows = running(rows, k, by, width, __before=previous(F.struct(F.col(t).alias("t"), F.col(state).alias("s"))))
    rows = rows.withColumn("__gap", F.col(t) - F.col("__before.t"))
    own = F.col(length) if length else F.lit(None).cast("double")
    tail = F.col(t) + F.when(own.isNotNull() & (F.col("__gap") > 4 * own), own).otherwise(F.coalesce("__gap", own, F.lit(0.0)))
    rows = islands_in(rows.withColumn("__stop", F.coalesce("__next", tail)), F.col("__before").isNull() | ~F.col(state).eqNullSafe(F.col("__before.s")), k, by, width)
    runs = rows.filter(F.col(state).isNotNull()).groupBy(*k, "island", state).agg(F.min(t).alias("start"), F.max("__stop").alias("end"), F.max(t).alias("last"), F.count(F.lit(1)).alias("pictures"))
    return runs.filter((F.col("pictures") >= max(min_count, 1)) & (F.col("end") - F.col("start") + 1e-9 >= min_seconds)).drop("island")


def classify_flat(df: DataFrame, luma: str = "luma", black: float = 0.04, white: float = 0.99, share: float = 0.98, depth: int = 8) -> DataFrame:
    """R2: `shade` of pictures whose samples are nearly all at most black or at least white; black wins, NULL is neither.

    Levels are fractions of the legal range 16..235, scaled by the depth.
    """
    scale = 2 ** (depth - 8)
    level = lambda x: int((16 + x * (235 - 16)) * scale + 1e-6)
    low, high = level(black), level(white)
    part = lambda test: F.size(F.filter(luma, test)) / F.size(luma)
    shade = F.when(F.size(luma) <= 0, None).when(part(lambda v: v <= low) >= share, "black").when(part(lambda v: v >= high) >= share, "white")
    return df.withColumn("shade", shade)


def silent_stretches(frames: DataFrame, key: Key = "rec", min_seconds: float = 0.4) -> DataFrame:
    """Quiet from the last loud instant of a frame to the first loud instant after it.

    Frames carry t, end, and loud_first / loud_last, the first loud instant and the one after the
    last, both NULL in a quiet frame. The head counts from 0, the tail to the last frame's end.
    """
    k = keys(key)
    close = frames.groupBy(*k).agg(F.max("end").alias("t"), F.max("end").alias("loud_first")).withColumn("loud_last", F.lit(None).cast("double"))
    loud = frames.filter("loud_first IS NOT NULL").select(*k, "t", "loud_first", "loud_last").unionByName(close)
    w = ordered(k, "loud_first", F.col("loud_last").asc_nulls_last())
    start = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.lag("loud_last").over(w))
    spans = loud.select(*k, start.alias("start"), F.col("loud_first").alias("end"))
    return spans.filter(F.col("end") - F.col("start") + 1e-9 >= min_seconds)


def loud_bounds(frames: DataFrame, threshold_db: float = -50.0, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """loud_first and loud_last of frames from their samples, by the level 10 ** (dB / 20)."""
    floor = 10 ** (threshold_db / 20)
    at = F.filter(F.transform(samples, lambda v, i: F.when(F.abs(v) > floor, i)), lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    return frames.withColumn("loud_first", F.col("t") + first / F.col(rate)).withColumn("loud_last", F.col("t") + (last + 1) / F.col(rate))


def monotone_only(df: DataFrame, key: Key = "rec", t: str = "t", *order: str, width: float | None = None) -> DataFrame:
    """Rows later than all rows before them in the given order; with a `width` of it, scanned in blocks (see scans.running)."""
    return running(df, key, order, width, __r=highest(F.col(t), here=False)).filter(F.col("__r").isNull() | (F.col(t) > F.col("__r"))).drop("__r")


def debounce(df: DataFrame, key: Key = "rec", t: str = "t", gap: float = 2.0, fewest: int = 3) -> DataFrame:
    """Marks at least `gap` after the last kept one; none of a key that keeps under `fewest`."""
    kept = keep_apart(df.select(*keys(key), t), key, t, F.col(t) + gap)
    return kept.withColumn("__n", F.count(F.lit(1)).over(whole(key))).filter(F.col("__n") >= fewest).drop("__n")


def dedup_adjacent(df: DataFrame, key: Key = "rec", t: str = "t", eps: float = 1.0, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows more than eps after the row before them, kept or not."""
    prev = F.lag(t).over(ordered(key, t, *order))
    return df.withColumn("__p", prev).filter(F.col("__p").isNull() | (F.col(t) - F.col("__p") > eps)).drop("__p")


def thin_by_interval(df: DataFrame, key: Key = "rec", t: str = "t", interval: float | Column = 1.0) -> DataFrame:
    """The first row, then each next row at least `interval` (a number or a column of the key) after the last kept."""
    gap = interval if isinstance(interval, Column) else F.lit(float(interval))
    return keep_apart(df, key, t, F.col(t) + gap).select(*keys(key), t)


def byte_interval(df: DataFrame, key: Key = "rec", t: str = "t", size: str = "size", budget: int = 256 << 20) -> DataFrame:
    """The interval at which kept rows of average size stay within a budget of bytes."""
    facts = df.groupBy(*keys(key)).agg(F.avg(size).alias("a"), (F.max(t) - F.min(t)).alias("d"), F.sum(size).alias("b"))
    return facts.select(*keys(key), F.when(F.col("b") <= budget, 0.0).otherwise(F.col("d") * F.col("a") / budget).alias("interval"))


def hysteresis_states(df: DataFrame, present: Column, absent: Column, min_present: float, key: Key = "rec", t: str = "t", score: str = "score", order: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Rows with the state they leave: 'P' seen or 'A' gone, whether it changed, and their island's start.

    With a `width` (of t), rows are scanned in blocks (see scans.running).
    """
    k, by = keys(key), [t, *order]
    rows = running(df.withColumn("__up", F.col(score) >= present), k, by, width, __was=previous(F.struct("__up")))
    new = F.coalesce(F.col("__up") != F.col("__was.__up"), F.lit(True))
    rows = running(rows.withColumn("__new", new), k, by, width, island=total(F.col("__new").cast("long")), since=latest(F.when(F.col("__new"), F.col(t))))
    held = F.col("__up") & (F.col(t) - F.col("since") >= min_present)
    event = F.when(F.col("__was").isNull(), F.when(F.col("__up"), "P").otherwise("A")).when(F.col(score) < absent, "A").when(held, "P")
    rows = running(rows.withColumn("__e", event), k, by, width, state=latest(F.col("__e")))
    rows = running(rows, k, by, width, was=previous(F.col("state")))
    return rows.withColumn("changed", ~F.col("state").eqNullSafe(F.col("was")))


def hysteresis_intervals(df: DataFrame, present: Column, absent: Column, min_present: float = 1.0, window: float = 5.0, key: Key = "rec", t: str = "t", score: str = "score", order: tuple[str, ...] = (), end: str | None = None, width: float | None = None) -> DataFrame:
    """Absences (start, end, edge) of a score, with hysteresis.

    One begins when the score falls below `absent`, set back to where it fell below `present` but by
    `window` at most (on the first row as an edge), and ends where the score rose to `present` once
    it has stayed there for min_present. At the tail a rise before the last row counts; else the
    absence runs to the last row, or to the recording's end where a column `end` tells it and it is later, as an edge.
    """
    k = keys(key)
    rows = hysteresis_states(df, present, absent, min_present, k, t, score, order, width)
    until = F.max(end).cast("double") if end else F.lit(None).cast("double")
    final = rows.groupBy(*k).agg(F.max(F.struct(t, *order, "__up", "since")).alias("z"), until.alias("until")).select(*k, "until", F.col(f"z.{t}").alias("last"), F.col("z.__up").alias("last_up"), F.col("z.since").alias("last_since"))
    head = F.col("was").isNull()
    began = F.when(head, F.col(t)).otherwise(F.greatest(F.col("since"), F.col(t) - window))
    marks = rows.filter("changed").select(*k, t, "state", F.col("since").alias("back"), began.alias("start"), head.alias("head"))
    pairs = running(marks, k, [t], width, back=True, ended=previous(F.col("back"))).filter("state = 'A'").join(final, k)
    tail = F.when(F.col("last_up") & (F.col("last_since") < F.col("last")), F.col("last_since"))
    stop = F.coalesce("ended", tail, F.greatest("last", "until"))
    edge = F.col("head") | (F.col("ended").isNull() & tail.isNull())
    return pairs.select(*k, "start", stop.alias("end"), edge.alias("edge"))


def transitions(df: DataFrame, present: Column, absent: Column, min_present: float = 1.0, key: Key = "rec", t: str = "t", score: str = "score", order: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """Changes of state per key."""
    rows = hysteresis_states(df, present, absent, min_present, key, t, score, order, width)
    return rows.groupBy(*keys(key)).agg(F.sum((F.col("changed") & F.col("was").isNotNull()).cast("long")).alias("transitions"))


def split_absences(df: DataFrame, long: float = 20.0, edge_long: float = 1.0, brief: float = 1.75) -> DataFrame:
    """Absences as 'long' (edges need less) or 'brief'; shorter ones are dropped."""
    d = F.col("end") - F.col("start")
    kind = F.when(d >= F.when(F.col("edge"), edge_long).otherwise(long), "long").when(d >= brief, "brief")
    return df.withColumn("kind", kind).filter("kind IS NOT NULL")


def level_byte(level: Column) -> Column:
    """A level as 80 dB of a byte; silence is 0."""
    db = F.round((20 * F.log10(level) + 80) / 80 * 255)
    return F.when(level > 0, F.greatest(F.lit(0.0), F.least(F.lit(255.0), db))).otherwise(0.0).cast("int")  # least and greatest pass over NULLs


def level_outline(df: DataFrame, key: Key = "rec", t: str = "t", level: str = "level", step: float = 0.05, fill: bool = False) -> DataFrame:
    """Per bucket of `step` seconds the peak and RMS level as bytes; `fill` adds the empty buckets as 0."""
    k = keys(key)
    held = df.filter(F.col(t) >= 0).groupBy(*k, F.floor(F.col(t) / step).alias("bucket")).agg(F.max(level).alias("top"), F.sqrt(F.avg(F.col(level) * F.col(level))).alias("mean"))
    out = held.select(*k, "bucket", level_byte(F.col("top")).alias("peak"), level_byte(F.col("mean")).alias("rms"))
    if not fill:
        return out
    every = out.groupBy(*k).agg(F.max("bucket").alias("m")).select(*k, F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("bucket"))
    return every.join(out, [*k, "bucket"], "left").fillna(0, ["peak", "rms"])


def change_score(df: DataFrame, key: Key = "rec", t: str = "t", sig: str = "sig", full: float = 255.0) -> DataFrame:
    """Mean absolute difference of each signature to the one before, over the full scale; NULL on the first."""
    last = F.lag(sig).over(ordered(key, t))
    diff = F.aggregate(F.zip_with(sig, "__last", lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("__last", last).withColumn("diff", F.when(F.col("__last").isNotNull(), diff / (F.size(sig) * full))).drop("__last")


def scene_marks(df: DataFrame, bounds: DataFrame, key: Key = "rec", t: str = "t", diff: str = "diff", floor: float = 0.055, over: float = 3.0, spacing: float = 3.0) -> DataFrame:
    """Rows that differ by `over` typical differences and the floor or more; one in `spacing` seconds at most.

    Where more rows pass than the recording's length allows, the threshold is the difference that
    as many rows reach.
    """
    k = keys(key)
    typical = middle(df, k, diff)
    rows = df.join(typical, k).join(bounds.select(*k, "duration"), k).withColumn("__cut", F.greatest(over * F.col("median"), F.lit(floor)))
    cap = F.greatest(F.lit(1), F.floor(F.col("duration") / spacing))
    passed = rows.filter(F.col(diff) >= F.col("__cut")).withColumn("__n", F.count(F.lit(1)).over(whole(k))).withColumn("__i", F.row_number().over(ordered(k, F.desc(diff), t)))
    limit = F.max(F.when(F.col("__i") == cap, F.col(diff))).over(whole(k))
    kept = passed.withColumn("__limit", F.when(F.col("__n") > cap, limit)).filter(F.col("__limit").isNull() | (F.col(diff) >= F.col("__limit")))
    return kept.select(*k, t, diff)


def learn_template(df: DataFrame, key: Key = "rec", vec: str = "vec") -> DataFrame:
    """The element-wise mean of vectors, one array a key."""
    k = keys(key)
    cells = df.select(*k, F.posexplode(vec).alias("i", "v")).groupBy(*k, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return cells.groupBy(*k).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("template"))


def highpass(vec: Column, w: int, h: int) -> Column:
    """Each inner sample less the mean of its four neighbours; 0 on the border."""
    at = lambda i: F.get(vec, i).cast("double")

    def cell(i: Column) -> Column:
        x, y = F.pmod(i, F.lit(w)), F.floor(i / w)
        inner = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
        return F.when(inner, at(i) - (at(i - 1) + at(i + 1) + at(i - w) + at(i + w)) / 4).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), cell)


def template_mask(high: Column, w: int, h: int, keep: int = 500, margin: int = 4) -> Column:
    """The indices of the `keep` strongest samples inside the margin, ascending; of equals the first."""
    inside = lambda i: (F.pmod(i, F.lit(w)) >= margin) & (F.pmod(i, F.lit(w)) < w - margin) & (F.floor(i / w) >= margin) & (F.floor(i / w) < h - margin)
    scored = F.transform(F.filter(F.sequence(F.lit(0), F.lit(w * h - 1)), inside), lambda i: F.struct((-F.abs(F.get(high, i))).alias("s"), i.alias("i")))
    return F.sort_array(F.transform(F.slice(F.sort_array(scored), 1, keep), lambda x: x["i"]))


def largest_cluster(points: DataFrame, key: Key = "rec", reach: int = 3) -> DataFrame:
    """Points (x, y) of each key's largest component under Chebyshev distance `reach`; of equals the one with the first point.

    Points meet through cells of `reach` size, so that only neighbours are compared; components
    are found for all keys at once.
    """
    k = keys(key)
    node = points.select(*k, "x", "y", F.struct(*k, "y", "x").alias("node"))
    cells = node.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    near = F.explode(F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = cells.select(*k, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("node").alias("b"), near.alias("c")).select(*k, "x2", "y2", "b", "c.*")
    close = (F.abs(F.col("x") - F.col("x2")) <= reach) & (F.abs(F.col("y") - F.col("y2")) <= reach) & (F.col("node") < F.col("b"))
    edges = cells.join(spread, [*k, "cx", "cy"]).filter(close).select(F.col("node").alias("a"), "b")
    labels = components(node.select("node"), edges)
    sized = node.join(labels, "node").withColumn("n", F.count(F.lit(1)).over(whole([*k, "label"])))
    best = sized.groupBy(*k).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(*k, F.col("b.label").alias("label"))
    return sized.join(best, [*k, "label"]).select(*k, "x", "y", "n")


#: Pictures of a chunk in which rolling means are taken; a chunk also holds the pictures just ahead of it that its first means need.
CHUNK = 512


def rolling_means(df: DataFrame, ring: int, key: Key = "rec", t: str = "t", vec: str = "vec", chunk: int = CHUNK) -> DataFrame:
    """(key, t, mean) of each row: the means of its vector's elements over up to `ring` rows up to it.

    Pictures are numbered, and chunks of them go to tasks of their own with the ring - 1 pictures ahead; whole vectors are summed there, so
    that no sample becomes a row. Vectors of a key are of one length.
    """
    k, n = keys(key), max(chunk, ring)
    rows = df.select(*k, t, F.col(vec).cast("array<double>").alias("vec")).withColumn("__n", F.row_number().over(ordered(k, t)) - 1)
    own = F.floor(F.col("__n") / n)
    halo = F.when(F.col("__n") % n > n - ring, F.array(own, own + 1)).otherwise(F.array(own))
    parts = rows.select(*k, t, "vec", "__n", F.explode(halo).alias("__chunk"))

    def means(group: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("__n")
        number = part.column("__n").to_numpy()
        flat = part.column("vec").combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
        vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1)
        total = vectors.copy()
        for back in range(1, min(ring, len(number))):
            total[back:] += vectors[:-back]
        mean = total / np.minimum(np.arange(1, len(number) + 1), ring)[:, None]
        keep = np.flatnonzero(number // n == group[-1].as_py())
        ends = np.arange(len(keep) + 1, dtype=np.int32) * mean.shape[1]
        return part.select([*k, t]).take(pa.array(keep)).append_column("mean", pa.ListArray.from_arrays(pa.array(ends), pa.array(mean[keep].ravel())))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*k, t])
    return parts.groupBy(*k, "__chunk").applyInArrow(means, f"{kinds}, mean array<double>")


def template_score(df: DataFrame, templates: DataFrame, w: int, h: int, ring: int, key: Key = "rec", t: str = "t", vec: str = "vec") -> DataFrame:
    """Cosine of each row's rolling mean (of up to `ring` rows) with the template on its mask, after highpass.

    templates: key, template (highpassed), mask (indices). 0 where either norm is 0.
    """
    k = keys(key)
    rows = rolling_means(df, ring, k, t, vec).join(templates, k).withColumn("hp", highpass(F.col("mean"), w, h))
    total_ = lambda f: F.aggregate("mask", F.lit(0.0), lambda s, i: s + f(i))
    a, b = lambda i: F.get("hp", i), lambda i: F.get("template", i)
    rows = rows.select(*k, t, total_(lambda i: a(i) * b(i)).alias("ab"), total_(lambda i: a(i) * a(i)).alias("aa"), total_(lambda i: b(i) * b(i)).alias("bb"))
    return rows.select(*k, t, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("score"))


def ring_length(df: DataFrame, key: Key = "rec", t: str = "t", seconds: float = 5.0) -> DataFrame:
    """Rows that a rolling mean over `seconds` holds, from the median gap; 2 to 64."""
    n = F.round(F.lit(seconds) / F.col("median_gap"))
    return median_gap(df, key, t).select(*keys(key), F.greatest(F.lit(2), F.least(F.lit(64), n)).cast("int").alias("ring"))


def choose_corner(scores: DataFrame, key: Key = "rec", corner: str = "corner", t: str = "t", score: str = "score", fewest: int = 20, most_breaks: int = 12, least_break: float = 30.0, min_present: float = 1.0, window: float = 5.0) -> DataFrame:
    """Per key the plausible corner of fewest transitions, then of the larger present share, then the first by name.

    Plausible: seen in half of the rows, at most most_breaks absences, the median one least_break
    long (or none). Thresholds follow the corner's median score. A key without one has no row, and
    so has a corner of fewer rows than `fewest`.
    """
    k = [*keys(key), corner]
    level = middle(scores, k, score)
    rows = scores.join(level, k)
    present, absent = F.greatest(0.4 * F.col("median"), F.lit(0.01)), F.greatest(0.15 * F.col("median"), F.lit(0.004))
    facts = rows.groupBy(*k).agg(F.avg((F.col(score) >= present).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
    gone = hysteresis_intervals(rows, present, absent, min_present, window, k, t, score).withColumn("d", F.col("end") - F.col("start"))
    breaks = gone.groupBy(*k).agg(F.count(F.lit(1)).alias("breaks")).join(middle(gone, k, "d").withColumnRenamed("median", "typical"), k)
    moves = transitions(rows, present, absent, min_present, k, t, score)
    every = facts.join(moves, k).join(breaks, k, "left")
    good = every.filter((F.col("n") >= fewest) & (F.col("share") >= 0.5) & (F.coalesce("breaks", F.lit(0)) <= most_breaks) & (F.col("typical").isNull() | (F.col("typical") >= least_break)))
    best = F.row_number().over(ordered(key, "transitions", F.desc("share"), corner))
    return good.withColumn("__i", best).filter("__i = 1").select(*k, "transitions", "share")

