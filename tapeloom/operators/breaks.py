"""Break detection: chains of silences on a grid, snapped and refined block edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, before, islands, keys, ordered, overlap_join, whole
from ..functions.storage import materialise
from ..functions.timecode import on_grid
from . import intervals as iv

UNIT = 15.0
#: Seconds from either end of a recording that still are its edge.
EDGE = 1.5


def grid_slack(a: str = "dur", b: str = "b_dur", unit: float = UNIT):
    """The tolerance of two silences' distance: their mean length, 0.6 s of a 15 s unit at most, and 0.15 s."""
    return F.least((F.col(a) + F.col(b)) / 2, F.lit(0.04 * unit)) + 0.01 * unit


def grid_pairs(silences: DataFrame, key: Key = "rec", unit: float = UNIT, most: int = 8) -> DataFrame:
    """Pairs (key, a, b) of silences, a the earlier one, that stand on the grid from each other, by their centres."""
    k = keys(key)
    rows = silences.select(*k, "time", "dur", F.col("time").alias("start"), (F.col("time") + unit * most + 0.05 * unit).alias("end"))
    right = silences.select(*k, F.col("time").alias("b_start"), (F.col("time") + 1e-9).alias("b_end"), F.col("dur").alias("b_dur"))
    met = overlap_join(rows, right, k, unit * (most + 1)).filter("b_start > time")
    held = met.filter(on_grid(F.col("b_start") - F.col("time"), grid_slack(unit=unit), unit, most))
    return held.select(*k, F.col("time").alias("a"), F.col("b_start").alias("b"))


def next_on_grid(silences: DataFrame, key: Key = "rec", unit: float = UNIT, most: int = 8) -> DataFrame:
    """Each silence's nearest later one that stands on the grid from it: (key, a, b)."""
    return grid_pairs(silences, key, unit, most).groupBy(*keys(key), "a").agg(F.min("b").alias("b"))


def chain_lengths(hops: DataFrame, key: Key = "rec") -> DataFrame:
    """Hops from each row `a` along its pointers to the end of the chain, by pointer doubling.

    Each round joins the table with itself and doubles the distance covered; it is written to the
    checkpoint folder, and the rounds end when no pointer is left. A chain must not come back to itself.
    """
    k = keys(key)
    state = materialise(hops.select(*k, "a", "b", F.lit(1).cast("long").alias("n")))
    while True:
        there = state.select(*k, F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m")).hint("merge")  # small in the file, not in memory
        state = materialise(state.join(there, [*k, "b"], "left").select(*k, "a", F.col("c").alias("b"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
        if state.filter("b IS NOT NULL").isEmpty():
            return state.select(*k, "a", "n")


def break_candidates(silences: DataFrame, key: Key = "rec", unit: float = UNIT, most: int = 8) -> DataFrame:
    """Silences (time, dur, ...) with the length of the on-grid chain through them and their score.

    A hop goes to the nearest silence on the grid, over those off it; run counts both directions, whose
    chains are followed together.
    """
    k = keys(key)
    pairs = materialise(grid_pairs(silences, k, unit, most))
    ahead = pairs.groupBy(*k, "a").agg(F.min("b").alias("b")).select(*k, F.lit(1).alias("way"), "a", "b")
    behind = pairs.groupBy(*k, F.col("b").alias("a")).agg(F.max("a").alias("b")).select(*k, F.lit(-1).alias("way"), "a", "b")
    hops = chain_lengths(ahead.unionByName(behind), [*k, "way"]).groupBy(*k, F.col("a").alias("time")).agg(F.sum("n").alias("hops"))
    rows = silences.join(hops, [*k, "time"], "left").withColumn("run", F.coalesce("hops", F.lit(0)) + 1).drop("hops")
    score = 0.5 * F.least(F.col("dur"), F.lit(1.0)) + 0.5 * F.least((F.col("run") - 1) / 4, F.lit(1.0))
    return rows.withColumn("score", score)


def rank_candidates(candidates: DataFrame, key: Key = "rec") -> DataFrame:
    """The order of candidates: best score first, then by time."""
    return candidates.withColumn("rank", F.row_number().over(ordered(key, F.desc("score"), "time")))


def break_blocks(candidates: DataFrame, key: Key = "rec", unit: float = UNIT, most: int = 8, min_score: float = 0.6, min_fill: float = 0.6, fewest: int = 3) -> DataFrame:
    """D3: adjacent strong candidates on the grid as blocks (start, end, junctions, score) that are full enough."""
    k = keys(key)
    strong = candidates.filter(F.col("score") >= min_score)
    w = ordered(k, "time")
    rows = strong.withColumn("b_dur", F.lag("dur").over(w)).withColumn("__gap", F.col("time") - F.lag("time").over(w))
    rows = islands(rows, ~on_grid(F.col("__gap"), grid_slack(unit=unit), unit, most), k, "time")
    blocks = rows.groupBy(*k, "island").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("junctions"), F.avg("score").alias("score"))
    slots = F.greatest(F.round((F.col("end") - F.col("start")) / unit), F.lit(1.0)) + 1
    return blocks.filter((F.col("junctions") >= fewest) & (F.col("junctions") / slots >= min_fill)).drop("island")


def blocks_from_resets(marks: DataFrame, bounds: DataFrame, key: Key = "rec", unit: float = UNIT, most: int = 12, slack: float = 0.35) -> DataFrame:
    """Chains of marks on the grid as blocks of score 1; a lone mark near an end makes a block of 0.9 to it.

    A duration before the mark is none. A block inside another one is dropped.
    """
    k = keys(key)
    w = ordered(k, "t")
    rows = islands(marks.select(*k, "t"), ~on_grid(F.col("t") - F.lag("t").over(w), F.lit(slack), unit, most), k, "t")
    chains = rows.groupBy(*k, "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).join(bounds.select(*k, "duration"), k)
    left = F.col("duration") - F.col("a")
    lone_head, lone_tail = (F.col("n") == 1) & (F.col("a") <= unit), (F.col("n") == 1) & left.between(0, unit)
    start = F.when(lone_head, 0.0).otherwise(F.col("a"))
    end = F.when(lone_head, F.col("a")).when(lone_tail, F.col("duration")).otherwise(F.col("b"))
    blocks = chains.filter((F.col("n") >= 2) | lone_head | lone_tail).select(*k, start.alias("start"), end.alias("end"), F.col("n").alias("junctions"), F.when(F.col("n") >= 2, 1.0).otherwise(0.9).alias("score"))
    reach = F.max("end").over(before(k, "start", F.desc("end")))
    return blocks.withColumn("__r", reach).filter(F.col("__r").isNull() | (F.col("end") > F.col("__r"))).drop("__r")


def marks_every_junction(marks: DataFrame, key: Key = "rec", unit: float = UNIT, slack: float = 0.35, fewest: int = 3) -> DataFrame:
    """Whether `fewest` adjacent pairs of marks stand one unit apart."""
    k = keys(key)
    gap = F.col("t") - F.lag("t").over(ordered(k, "t"))
    rows = marks.withColumn("__one", (F.abs(gap - unit) <= slack).cast("int"))
    return rows.groupBy(*k).agg((F.coalesce(F.sum("__one"), F.lit(0)) >= fewest).alias("every_junction"))


def nearest_within(df: DataFrame, marks: DataFrame, reach: float, key: Key = "rec", t: str = "t", prefer: str | None = None, row: tuple[str, ...] = ()) -> DataFrame:
    """Each row's nearest mark within `reach` (of equals the earlier), preferred ones first; NULL without one.

    `row` names the columns that tell rows apart, besides the key and t.
    """
    k = keys(key)
    own = df.withColumn("start", F.col(t) - reach).withColumn("end", F.col(t) + reach)
    right = marks.select(*k, F.col("t").alias("b_start"), F.col("t").alias("b_end"), (F.col(prefer) if prefer else F.lit(True)).alias("__good"))
    met = overlap_join(own, right, k, 2 * reach + 1, closed=True)
    best = met.groupBy(*k, *row, t).agg(F.min(F.struct((~F.col("__good")).alias("bad"), F.abs(F.col("b_start") - F.col(t)).alias("off"), F.col("b_start").alias("at"))).alias("m"))
    return df.join(best.select(*k, *row, t, F.col("m.at").alias("nearest")), [*k, *row, t], "left")


def blocks_from_absence(candidates: DataFrame, absences: DataFrame, changes: DataFrame, bounds: DataFrame, key: Key = "rec", unit: float = UNIT, snap: float = 3.0, strong: float = 0.6, change: float = 0.08, near: float = 0.5, edge: float = EDGE) -> DataFrame:
    """Absences of a mark as blocks whose edges are drawn to junctions.

    The start goes to the nearest strong junction within twice `snap`, one with a picture change
    close by before any other. An absence's own junctions lie from its start to `snap` past its end;
    the end goes to the nearest within `snap` of them and of the 8 units on from the last, none past the
    recording. Two own junctions up to the end make a score of 1, else it is 0.7. Bounds within `edge` of
    the recording's ends go there; blocks shorter than 5 s (1 s at an end) are dropped.
    """
    k = keys(key)
    junctions = candidates.filter(F.col("score") >= strong).select(*k, F.col("time").alias("t"))
    big = changes.filter(F.col("diff") >= change).select(*k, "t")
    seen = nearest_within(junctions, big, near, k).withColumn("shown", F.col("nearest").isNotNull())
    rows = absences.join(bounds.select(*k, "duration"), k).select(*k, "duration", F.col("start").alias("a"), F.col("end").alias("b"))
    rows = nearest_within(rows, seen, 2 * snap, k, "a", "shown", ("b",)).withColumn("s", F.coalesce("nearest", "a")).drop("nearest")
    ident = [*k, "a", "b"]
    reach = rows.select(*ident, "duration", (F.col("s") - 0.1).alias("start"), (F.col("b") + snap).alias("end"))
    mine = overlap_join(reach, junctions.select(*k, F.col("t").alias("b_start"), F.col("t").alias("b_end")), k, 8 * unit, closed=True).withColumnRenamed("b_start", "t")
    within = lambda t: (F.abs(t - F.col("b")) <= snap) & ((F.col("duration") <= 0) | (t <= F.col("duration")))
    place = lambda t, order: F.struct(F.abs(t - F.col("b")).alias("off"), F.lit(order).alias("order"), t.alias("t"))
    mine = mine.withColumn("last", F.max("t").over(whole(ident))).withColumn("own", F.min(F.when(within(F.col("t")), place(F.col("t"), 0))).over(whole(ident)))
    on = F.array_min(F.transform(F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.col("last") + n * unit), within), lambda t: place(t, 1)))
    mine = mine.withColumn("e", F.coalesce(F.array_min(F.array_compact(F.array("own", on)))["t"], F.col("b")))
    facts = mine.groupBy(*ident).agg(F.first("e").alias("e"), F.sum((F.col("t") <= F.col("e") + 0.1).cast("int")).alias("inside"))
    rows = rows.join(facts, ident, "left")
    start = F.when(F.col("a") <= edge, 0.0).otherwise(F.col("s"))
    end = F.when((F.col("duration") > 0) & (F.col("b") >= F.col("duration") - edge), F.col("duration")).otherwise(F.coalesce("e", "b"))
    blocks = rows.select(*k, start.alias("start"), F.greatest(end, start).alias("end"), F.when(F.col("inside") >= 2, 1.0).otherwise(0.7).alias("score"), "duration")
    at_edge = (F.col("start") <= edge) | (F.col("end") >= F.col("duration") - edge)
    return blocks.select(*k, "start", "end", "score", at_edge.alias("edge")).filter(F.col("end") - F.col("start") >= F.when(F.col("edge"), 1.0).otherwise(5.0))


def insert_blocks(brief: DataFrame, silences: DataFrame, blocks: DataFrame, key: Key = "rec", least: float = 0.7) -> DataFrame:
    """Blocks, and the brief absences that overlap a silence of `least` seconds and no block (score 0.8)."""
    long = silences.filter(F.col("end") - F.col("start") >= least)
    held = iv.overlap_anti(iv.overlap_semi(brief, long, key), blocks, key)
    rows = held.select(*keys(key), "start", "end", F.lit(0.8).alias("score"))
    return blocks.select(*rows.columns).unionByName(rows)


def refine_boundaries(blocks: DataFrame, changes: DataFrame, bounds: DataFrame, key: Key = "rec", window: float = 0.5, floor: float = 0.08) -> DataFrame:
    """Each edge at the nearest picture change of `floor` within the window; 0, the end and order stay."""
    k = keys(key)
    big = changes.filter(F.col("diff") >= floor).select(*k, "t")
    rows = blocks.join(bounds.select(*k, "duration"), k)
    rows = nearest_within(rows.withColumnRenamed("start", "b_s").withColumnRenamed("end", "b_e"), big, window, k, "b_s", None, ("b_e",)).withColumnRenamed("nearest", "s")
    rows = nearest_within(rows, big, window, k, "b_e", None, ("b_s",)).withColumnRenamed("nearest", "e")
    start = F.when(F.col("b_s") == 0, 0.0).otherwise(F.coalesce("s", "b_s"))
    end = F.when(F.col("b_e") >= F.col("duration"), F.col("b_e")).otherwise(F.coalesce("e", "b_e"))
    rest = [c for c in blocks.columns if c not in (*k, "start", "end")]
    return rows.select(*k, start.alias("start"), F.greatest(end, start).alias("end"), *rest)


def detect_breaks(marks: DataFrame, silences: DataFrame, scores: DataFrame, changes: DataFrame, bounds: DataFrame, key: Key = "rec", unit: float = UNIT, resets: dict | None = None, absences: dict | None = None, silent: dict | None = None, refine: dict | None = None, split: dict | None = None, inserts: bool = False, **hysteresis) -> DataFrame:
    """Blocks per recording by the first method that applies, with its name; edges refined by D8.

    The dicts give options of D4 and D5, D6, D3, D8 and R7 that differ from theirs.

    Resets on every junction speak for themselves; else long absences of the corner mark with silences,
    and with `inserts` its brief ones too; a mark that never leaves means no break; without a mark,
    silences alone. Work of a later method is done only for recordings that an earlier one did not
    settle (anti joins on keys).
    """
    from . import runs

    k = keys(key)
    resets = resets or {}
    by_reset = materialise(marks_every_junction(marks, k, unit, **resets).filter("every_junction").select(*k))
    one = blocks_from_resets(marks.join(by_reset, k, "left_semi"), bounds, k, unit, slack=resets.get("slack", 0.35)).select(*k, "start", "end", "score", F.lit("resets").alias("method"))
    candidates = materialise(break_candidates(silences.join(by_reset, k, "left_anti"), k, unit))
    scored = scores.join(by_reset, k, "left_anti").join(bounds.select(*k, F.col("duration").alias("__end")), k, "left")
    gone = runs.split_absences(runs.hysteresis_intervals(scored, key=k, end="__end", **hysteresis), **(split or {}))
    two = blocks_from_absence(candidates, gone.filter("kind = 'long'"), changes, bounds, k, unit, **(absences or {})).select(*k, "start", "end", "score", F.lit("mark").alias("method"))
    if inserts:
        quiet = silences.select(*k, (F.col("time") - F.col("dur") / 2).alias("start"), (F.col("time") + F.col("dur") / 2).alias("end"))
        both = insert_blocks(gone.filter("kind = 'brief'").select(*k, "start", "end"), quiet, two.select(*k, "start", "end", "score"), k)
        two = both.withColumn("method", F.lit("mark"))
    three = break_blocks(candidates.join(scored.select(*k).distinct(), k, "left_anti"), k, unit, **(silent or {})).select(*k, "start", "end", "score", F.lit("silence").alias("method"))
    return refine_boundaries(one.unionByName(two).unionByName(three), changes, bounds, k, **(refine or {}))


def score_breaks(blocks: DataFrame, truth: DataFrame, bounds: DataFrame, key: Key = "rec", unit: float = UNIT, edge: float = EDGE) -> DataFrame:
    """Seconds of programme cut and of break left, blocks wholly in programme, breaks missed, odd lengths.

    truth rows with `grey` count neither way. A block that comes within `edge` of either end of the recording was cut off there,
    so that its length tells nothing.
    """
    k = keys(key)
    real, grey = truth.filter("NOT grey").select(*k, "start", "end"), truth.filter("grey").select(*k, "start", "end")
    total = lambda df, name: iv.kept_seconds(df, k).withColumnRenamed("kept", name)
    mine = blocks.select(*k, "start", "end")
    over = total(iv.subtract(iv.subtract(mine, real, k), grey, k), "over")
    under = total(iv.subtract(iv.subtract(real, mine, k), grey, k), "under")
    lone = iv.overlap_anti(mine, truth.select(*k, "start", "end"), k).groupBy(*k).agg(F.count(F.lit(1)).alias("false_blocks"))
    missed = iv.overlap_anti(real, mine, k).groupBy(*k).agg(F.count(F.lit(1)).alias("missed"))
    length = F.col("end") - F.col("start")
    inner = mine.join(bounds.select(*k, "duration"), k).filter((F.col("start") > edge) & (F.col("end") < F.col("duration") - edge) & (length >= 2 * unit))
    odd = inner.filter(F.abs(length - F.rint(length / unit) * unit) > 0.25).groupBy(*k).agg(F.count(F.lit(1)).alias("odd"))
    out = bounds.select(*k)
    for part in (over, under, lone, missed, odd):
        out = out.join(part, k, "left")
    return out.fillna(0)


def mark_coverage(marks: DataFrame, blocks: DataFrame, key: Key = "rec", unit: float = UNIT, tol: float = 0.75) -> DataFrame:
    """The share of block edges and inner junctions, one a unit, with a mark within tol."""
    k = keys(key)
    steps = F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / unit).cast("int"))
    spots = blocks.select(*k, F.explode(F.array_distinct(F.concat(F.transform(steps, lambda n: F.col("start") + n * unit), F.array("end")))).alias("t")).distinct()
    met = nearest_within(spots, marks.select(*k, "t"), tol, k)
    return met.groupBy(*k).agg(F.avg(F.col("nearest").isNotNull().cast("double")).alias("share"), F.count(F.lit(1)).alias("spots"))
