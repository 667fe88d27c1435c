"""Gaps, rates and samples of timed rows, per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, as_of, keys, middle, ordered, overlap_join, whole
from ..functions.greedy import keep_apart


def gaps(df: DataFrame, key: Key = "rec", t: str = "t", *order: str) -> DataFrame:
    """G1: rows with the gap to the next row, NULL on a key's last."""
    return df.withColumn("gap", F.lead(t).over(ordered(key, t, *order)) - F.col(t))


def median_gap(df: DataFrame, key: Key = "rec", t: str = "t") -> DataFrame:
    """G1: the upper median of consecutive gaps."""
    return middle(gaps(df, key, t), key, "gap").withColumnRenamed("median", "median_gap")


def closest_gap(df: DataFrame, key: Key = "rec", t: str = "t") -> DataFrame:
    """The least gap above 0."""
    return gaps(df, key, t).filter("gap > 0").groupBy(*keys(key)).agg(F.min("gap").alias("closest"))


def is_variable_rate(df: DataFrame, frame: float, key: Key = "rec", t: str = "t") -> DataFrame:
    """With 32 gaps above 0 or more, 4 dense ones, or more than 1 % held over 1.75 times the usual gap."""
    k = keys(key)
    g = gaps(df, k, t).filter("gap > 0")
    usual = middle(g, k, "gap", lower=True).select(*k, F.least(F.lit(float(frame)), "median").alias("usual"))
    counts = g.join(usual, k).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("gap") > 1.75 * F.col("usual")).cast("long")).alias("held"),
        F.sum((F.col("gap") < frame / 2).cast("long")).alias("dense"),
    )
    variable = (F.col("n") >= 32) & ((F.col("dense") >= 4) | (F.col("held") * 100 > F.col("n"))) & F.lit(frame > 0)
    return counts.select(*k, "n", "held", "dense", variable.alias("variable"))


def stray_times(packets: DataFrame, key: Key = "rec", seq: str = "seq", far: float = 60.0) -> DataFrame:
    """Rows shown more than `far` seconds after both neighbours in decode order and out of decode-time order."""
    w = ordered(key, seq)
    ahead = (F.col("pts") > F.lag("pts").over(w) + far) & (F.col("pts") > F.lead("pts").over(w) + far)
    in_order = (F.lag("dts").over(w) <= F.col("dts")) & (F.col("dts") <= F.lead("dts").over(w))
    return packets.withColumn("__s", ahead & ~in_order).filter("__s").drop("__s")


def holes(df: DataFrame, frame: float, key: Key = "rec", t: str = "t") -> DataFrame:
    """Seconds missing in gaps longer than two and a half frames."""
    missing = F.when(F.col("gap") > 2.5 * frame, F.col("gap") - frame).otherwise(0.0)
    return gaps(df, key, t).groupBy(*keys(key)).agg(F.sum(missing).alias("missing"))


def measured_bit_rate(packets: DataFrame, frame: float, key: Key = "rec") -> DataFrame:
    """Bits over the time up to the end of the last shown picture, stray times left out of the latter."""
    k = keys(key)
    stray = stray_times(packets, k).select(*k, "seq", F.lit(True).alias("stray"))
    marked = packets.join(stray, [*k, "seq"], "left")
    last = F.max(F.when(F.col("stray").isNull(), F.col("pts")))
    out = marked.groupBy(*k).agg(F.sum("size").alias("bytes"), (last + frame).alias("seconds"))
    return out.select(*k, (F.col("bytes") * 8 / F.col("seconds")).alias("bit_rate"))


def systematic(df: DataFrame, n: int, key: Key = "rec", *order: str) -> DataFrame:
    """The rows at places i * rows / n (whole division) of each key; all rows of a key with n or fewer."""
    k = keys(key)
    marked = df.withColumn("__i", F.row_number().over(ordered(k, *order)) - 1).withColumn("__n", F.count(F.lit(1)).over(whole(k)))
    # row i is floor(j * rows / n) for some j exactly if that holds for j = ceil(i * n / rows)
    return marked.withColumn("__j", F.expr(f"(__i * {n} + __n - 1) div __n")).filter(f"__j < {n} AND (__j * __n) div {n} = __i").drop("__i", "__n", "__j")


def sampled_bit_rate(points: DataFrame, packets: DataFrame, key: Key = "rec", n: int = 24, seconds: float = 2.0) -> DataFrame:
    """Video bytes per second over n systematic samples, each from a point to the first one `seconds` on."""
    k = keys(key)
    starts = systematic(points.select(*k, "t"), n, k, "t").select(*k, F.col("t").alias("start"), (F.col("t") + seconds).alias("want"))
    ends = points.select(*k, F.col("t").alias("at"), F.col("t").alias("end"))
    windows = as_of(starts, ends, k, "want", "at", ["end"], forward=True).filter("end IS NOT NULL")
    rows = packets.select(*k, F.col("t").alias("b_start"), (F.col("t") + 1e-6).alias("b_end"), "size")
    inside = overlap_join(windows.select(*k, "start", "end"), rows, k, max(seconds, 3600.0)).filter("b_start >= start AND b_start < end")
    bytes_ = inside.groupBy(*k).agg(F.sum("size").alias("bytes"))
    time = windows.groupBy(*k).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return time.join(bytes_, k).select(*k, (F.col("bytes") * 8 / F.col("seconds")).alias("bit_rate"))


def pid_rates(packets: DataFrame, key: Key = ("rec", "pid"), clock: str = "clock", wrap: int = 2**33, hz: float = 90000.0, packet: int = 188) -> DataFrame:
    """Bits per second of each stream: packets times their size over the run from its first to its last stated clock.

    The clock may wrap once; most packets state none. A stream that states under two has no rate.
    """
    k = keys(key)
    stated = F.when(F.col(clock).isNotNull(), F.struct("seq", clock))
    ends = packets.groupBy(*k).agg(F.min(stated).alias("a"), F.max(stated).alias("b"), F.count(F.lit(1)).alias("n"))
    run = F.pmod(F.col(f"b.{clock}") - F.col(f"a.{clock}"), F.lit(wrap)) / hz
    return ends.select(*k, "n", F.when(run > 0, F.col("n") * packet * 8 / run).alias("bit_rate"))


def byte_profile(points: DataFrame, key: Key = "rec", t: str = "t", pos: str = "pos", order: str = "n") -> DataFrame:
    """Stretches (start, end, bytes) between points next to each other in `order` whose time rises and whose place doesn't fall.

    Of stretches that overlap, as where two files run on one clock, the first in time is kept. Points
    without a place count for nothing.
    """
    k = keys(key)
    w = ordered(k, order)
    placed = points.filter(F.col(pos) >= 0)
    pairs = placed.select(*k, F.col(t).alias("start"), F.lead(t).over(w).alias("end"), (F.lead(pos).over(w) - F.col(pos)).alias("bytes"), F.col(order).alias("__n"))
    return keep_apart(pairs.filter("end > start AND bytes >= 0"), k, "start", F.col("end"), "__n").drop("__n")


def busier(profile: DataFrame, keeps: DataFrame, key: Key = "rec", least: float = 10.0, framing: float = 1.056, bucket: float = 3600.0) -> DataFrame:
    """Bytes by which kept ranges exceed the profile's average rate (0 for profiles under `least` seconds or without bytes)."""
    k = keys(key)
    average = profile.groupBy(*k).agg(F.sum("bytes").alias("b"), F.sum(F.col("end") - F.col("start")).alias("s")).select(*k, (F.col("b") / F.col("s")).alias("average"), F.col("s").alias("profiled"))
    rows = profile.select(*k, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "bytes")
    met = overlap_join(keeps.select(*k, "start", "end"), rows, k, bucket).join(average, k)
    held = F.least("end", "b_end") - F.greatest("start", "b_start")
    over = met.groupBy(*k).agg(F.sum(F.when((F.col("profiled") >= least) & (F.col("average") > 0), held * (F.col("bytes") / (F.col("b_end") - F.col("b_start")) - F.col("average"))).otherwise(0.0)).alias("over"))
    return average.join(over, k, "left").select(*k, "average", (F.coalesce("over", F.lit(0.0)) / framing).alias("busier"))


def compare_gaps(a: DataFrame, b: DataFrame, slack: float, key: Key = "rec", t: str = "t") -> DataFrame:
    """Whether both sides have as many gaps, each within slack of its partner, and the worst difference."""
    k = keys(key)
    number = lambda df, name: gaps(df, k, t).filter("gap IS NOT NULL").select(*k, F.row_number().over(ordered(k, t)).alias("i"), F.col("gap").alias(name))
    both = number(a, "ga").join(number(b, "gb"), [*k, "i"], "full_outer")
    out = both.groupBy(*k).agg(F.count("ga").alias("na"), F.count("gb").alias("nb"), F.max(F.abs(F.col("ga") - F.col("gb"))).alias("worst"))
    return out.select(*k, "na", "nb", "worst", ((F.col("na") == F.col("nb")) & (F.coalesce("worst", F.lit(0.0)) <= slack)).alias("same"))


def step_histogram_close(a: DataFrame, b: DataFrame, tol: float = 0.1, key: Key = "rec", t: str = "t", digits: int = 4) -> DataFrame:
    """Whether the shares of each (rounded) gap differ by less than tol on both sides."""
    k = keys(key)

    def shares(df: DataFrame, name: str) -> DataFrame:
        steps = gaps(df, k, t).filter("gap IS NOT NULL").groupBy(*k, F.round("gap", digits).alias("step")).agg(F.count(F.lit(1)).alias("n"))
        return steps.select(*k, "step", (F.col("n") / F.sum("n").over(whole(k))).alias(name))

    both = shares(a, "sa").join(shares(b, "sb"), [*k, "step"], "full_outer")
    worst = F.max(F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))))
    return both.groupBy(*k).agg(worst.alias("worst")).select(*k, "worst", (F.col("worst") < tol).alias("close"))


def pulldown_flag(packets: DataFrame, key: Key = "rec", fields: str = "fields") -> DataFrame:
    """Whether any picture is shown for other than two fields."""
    return packets.groupBy(*keys(key)).agg(F.max(F.col(fields) != 2).alias("pulldown"))


def pulldown_share(flags: DataFrame, group: Key) -> DataFrame:
    """The share of recordings with pulldown in each group."""
    return flags.groupBy(*keys(group)).agg(F.avg(F.col("pulldown").cast("double")).alias("share"))


def index_coverage(times: DataFrame, bounds: DataFrame, key: Key = "rec", t: str = "t") -> DataFrame:
    """Why an index does not cover its recording, or 'ok': few entries, a wide gap, an early end."""
    k = keys(key)
    g = gaps(times, k, t)
    facts = g.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("widest"), F.max(t).alias("last"))
    rows = facts.join(median_gap(times, k, t), k, "left").join(bounds.select(*k, "duration"), k)
    d = F.col("duration")
    reason = (
        F.when(F.col("n") < 2, "few")
        .when(F.col("widest") > F.greatest(d / 10, F.lit(30.0)), "gap")
        .when(d - F.col("last") > F.greatest(3 * F.col("median_gap"), F.least(F.lit(10.0), d / 2)), "end")
        .otherwise("ok")
    )
    return rows.select(*k, "n", reason.alias("reason"))

