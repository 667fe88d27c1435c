"""Checks of an output against its source: alignment, damage, lengths, sync and levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, as_of, keys, ordered, overlap_join, so_far
from .clocks import source_to_output


def align_hashes(a: DataFrame, b: DataFrame, key: Key = "rec", pos: str = "pos", hash_: str = "hash", search: int = 5) -> DataFrame:
    """V1: the offset of b in -search..search with the most equal places (the first of equals), and both counts."""
    k = keys(key)
    na, nb = (x.groupBy(*k).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "na"), (b, "nb")))
    tried = a.select(*k, F.col(pos).alias("__p"), F.col(hash_).alias("__h"), F.explode(F.sequence(F.lit(-search), F.lit(search))).alias("offset"))
    met = tried.withColumn("__q", F.col("__p") + F.col("offset")).join(b.select(*k, F.col(pos).alias("__q"), F.col(hash_).alias("__h")), [*k, "__q", "__h"])
    counts = met.groupBy(*k, "offset").agg(F.count(F.lit(1)).alias("identical"))
    best = counts.groupBy(*k).agg(F.min(F.struct((-F.col("identical")).alias("n"), "offset")).alias("m"))
    out = na.join(nb, k, "full_outer").join(best, k, "left").fillna(0, ["na", "nb"])
    return out.select(*k, F.coalesce("m.offset", F.lit(-search)).alias("offset"), F.coalesce(-F.col("m.n"), F.lit(0)).alias("identical"), (F.col("na") == F.col("nb")).alias("same_count"))


def verify_report(pairs: DataFrame, key: Key = "rec", unlike: float = 25.0) -> DataFrame:
    """V2: per output: pictures expected, produced, identical; copies that missed, worst PSNR, unlike and damaged ones; passed.

    pairs: kind ('copy' or 'reencode'), source and output hash (NULL where absent), psnr, damaged.
    """
    same = F.coalesce(F.col("src_hash") == F.col("out_hash"), F.lit(False))
    miss = (F.col("kind") == "copy") & ~same & ~F.col("damaged")
    out = pairs.groupBy(*keys(key)).agg(
        F.count("src_hash").alias("expected"),
        F.count("out_hash").alias("produced"),
        F.sum(same.cast("long")).alias("identical"),
        F.sum(miss.cast("long")).alias("missed"),
        F.min("psnr").alias("worst"),
        F.sum(F.coalesce((F.col("psnr") < unlike), F.lit(False)).cast("long")).alias("unlike"),
        F.sum(F.col("damaged").cast("long")).alias("damaged"),
    )
    return out.withColumn("passed", (F.col("expected") == F.col("produced")) & (F.col("missed") == 0) & (F.col("unlike") == 0))


def picture_hash(rows: Column) -> Column:
    """V3: a hash of a picture's bytes."""
    return F.xxhash64(rows)


def grid_psnr(a: Column, b: Column, every: int = 4, peak: float = 255.0) -> Column:
    """V3: PSNR of two sample arrays on every fourth sample: 99 when equal, NULL when their shapes differ."""
    sparse = F.filter(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), lambda v, i: i % every == 0)
    mse = F.aggregate(sparse, F.lit(0.0), lambda s, v: s + v) / F.size(sparse)
    return F.when(F.size(a) != F.size(b), None).when(mse == 0, 99.0).otherwise(10 * F.log10(peak * peak / F.when(mse > 0, mse)))


def after_damage(pairs: DataFrame, key: Key = "rec", pos: str = "pos") -> DataFrame:
    """V4: `excused`: rows from a damaged picture up to the next identical pair."""
    k = keys(key)
    event = F.when(F.col("damaged"), F.lit(True)).when(F.col("src_hash") == F.col("out_hash"), F.lit(False))
    return pairs.withColumn("excused", F.coalesce(F.last(event, ignorenulls=True).over(so_far(k, pos)), F.lit(False)))


def track_length_off(tracks: DataFrame, allowed: float = 0.0, slack: float = 0.5) -> DataFrame:
    """V5: tracks longer than the pictures, much shorter, or stamped past their end."""
    over = F.col("length") > F.col("pictures") + slack
    under = F.col("length") < F.col("pictures") - allowed - slack
    late = F.col("last_stamp") > F.col("pictures") + slack
    reason = F.when(over, "long").when(under, "short").when(late, "late")
    return tracks.withColumn("off", reason).filter("off IS NOT NULL")


def kept_fits(out: DataFrame, kept: DataFrame, key: Key = "rec", slack: float = 0.5) -> DataFrame:
    """V6: whether an output's seconds and holes fit what was kept (from, to, holes); holes that aren't known fit."""
    k = keys(key)
    rows = out.join(kept, k)
    return rows.select(*k, (F.col("seconds").between(F.col("from") - slack, F.col("to") + slack) & F.coalesce(F.col("holes") <= F.col("source_holes") + slack, F.lit(True))).alias("fits"))


def best_lag(a: DataFrame, b: DataFrame, key: Key = "rec", pos: str = "bucket", value: str = "level", search: int = 20) -> DataFrame:
    """V7: where a sits in b: the lag of the largest product of both centred series (of equals the least), and their
    correlation over the places that meet there, with those places' own means and norms.

    Lags are up to `search` either way, and only those at which a lies whole within b count; a key without one gives no row. Places
    are whole numbers, one row each, and may be missing. A series is cut into blocks of places, each of which a task correlates with b
    around it by FFT; the blocks' products are summed for each lag, and the correlation at the best lag is one join more.
    """
    k = keys(key)
    block = max(4096, 2 * search)

    def centred(df: DataFrame, name: str) -> DataFrame:
        facts = df.groupBy(*k).agg(F.avg(value).alias("__m"), F.min(pos).alias(f"__lo_{name}"), F.max(pos).alias(f"__hi_{name}"))
        return df.join(facts, k).select(*k, F.col(pos).cast("long").alias("__p"), (F.col(value) - F.col("__m")).cast("double").alias(name), f"__lo_{name}", f"__hi_{name}")

    x, y = centred(a, "x"), centred(b, "y")
    ranges = x.select(*k, "__lo_x", "__hi_x").distinct().join(y.select(*k, "__lo_y", "__hi_y").distinct(), k)
    number = lambda p: F.floor(p / block)
    xs = x.select(*k, "__p", "x", number(F.col("__p")).alias("__b"))
    ys = y.select(*[F.col(c).alias(c) for c in k], F.col("__p").alias("__p"), "y", F.explode(F.sequence(number(F.col("__p") - search), number(F.col("__p") + search))).alias("__b"))

    kinds = a.select(*k).schema
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)

    def products(group: tuple[pa.Scalar, ...], own: pa.Table, other: pa.Table) -> pa.Table:
        lo, n = group[-1].as_py() * block, 2 * search + 1
        size = 1 << (2 * block + 2 * search - 1).bit_length()
        left, right = np.zeros(size), np.zeros(size)
        left[own.column("__p").to_numpy() - lo] = own.column("x").to_numpy()
        right[other.column("__p").to_numpy() - lo + search] = other.column("y").to_numpy()
        n = n if len(own) and len(other) else 0
        dots = np.fft.irfft(np.conj(np.fft.rfft(left)) * np.fft.rfft(right), size)[:n] if n else []
        keyed = [pa.array([g.as_py()] * n, g.type) for g in group[:-1]]
        return pa.Table.from_arrays([*keyed, pa.array(range(-search, n - search), pa.int64()), pa.array(dots, pa.float64())], [*k, "lag", "dot"])

    dots = xs.groupBy(*k, "__b").cogroup(ys.groupBy(*k, "__b")).applyInArrow(products, f"{named}, lag long, dot double")
    whole_in = (F.col("__lo_x") + F.col("lag") >= F.col("__lo_y")) & (F.col("__hi_x") + F.col("lag") <= F.col("__hi_y"))
    tried = dots.groupBy(*k, "lag").agg(F.sum("dot").alias("dot")).join(ranges, k).filter(whole_in)
    best = tried.groupBy(*k).agg(F.min(F.struct((-F.round("dot", 6)).alias("c"), F.abs("lag").alias("d"), "lag"))["lag"].alias("lag"))
    met = x.join(best, k).select(*k, "lag", "x", (F.col("__p") + F.col("lag")).alias("__p")).join(y.select(*k, "__p", "y"), [*k, "__p"])
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in ("xy", "xx", "yy")]
    rows = met.groupBy(*k, "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), *sums)
    dot = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    norm = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    corr = F.when(norm > 1e-12, dot / F.sqrt(F.when(norm > 1e-12, norm))).otherwise(0.0)
    return best.join(rows.select(*k, "lag", corr.alias("corr")), [*k, "lag"], "left").select(*k, "lag", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def marker_alignment(expected: DataFrame, got: DataFrame, keeps: DataFrame, key: Key = "rec", guard: float = 0.05, reach: float = 0.05, bucket: float = 60.0) -> DataFrame:
    """V8: source markers mapped into the output (none within `guard` of a range's end) against the nearest there.

    Columns: markers, missing, and the worst signed offset.
    """
    k = keys(key)
    inner = keeps.select(*k, (F.col("start") + guard).alias("b_start"), (F.col("end") - guard).alias("b_end"))
    own = expected.select(*k, "t", F.col("t").alias("start"), (F.col("t") + 1e-9).alias("end"))
    safe = overlap_join(own, inner, k, bucket).select(*k, "t").distinct()
    want = source_to_output(safe, keeps, k).filter("out IS NOT NULL")
    near = as_of(want, got.select(*k, F.col("t").alias("at"), F.col("t").alias("lo")), k, "out", "at", ["lo"])
    near = as_of(near, got.select(*k, F.col("t").alias("at"), F.col("t").alias("hi")), k, "out", "at", ["hi"], forward=True)
    low, high = F.col("lo") - F.col("out"), F.col("hi") - F.col("out")
    off = F.when(F.col("hi").isNull() | (-low <= high), low).otherwise(high)
    rows = near.withColumn("off", F.when(F.abs(off) <= reach, off))
    worst = F.max(F.struct(F.abs("off").alias("a"), F.col("off").alias("o")))
    return rows.groupBy(*k).agg(F.count(F.lit(1)).alias("markers"), F.sum(F.col("off").isNull().cast("long")).alias("missing"), F.when(F.count("off") > 0, worst["o"]).alias("worst"))


def carried_rows_check(src: DataFrame, out: DataFrame, keeps: DataFrame, key: Key = "rec", spread: float = 0.001, bucket: float = 3600.0, look_back: float = 30.0, most: int = 4) -> DataFrame:
    """V9: per kept range: rows inside, those that arrive unchanged in order, and whether one offset moves them all.

    keeps carry `range`; out rows carry the range they came from. Ahead of a range's own rows may stand look-back rows: `most` at
    most, each of the size of a source row in the `look_back` seconds ahead of the range. Every number of them is tried:
    the fewest at which all rows agree, in hash and size, and all rows ahead are of known sizes is taken, else that at which most rows
    agree. Further rows than the range holds do not pass; a range that holds none is there only if rows came out for it.
    """
    k = keys(key)
    by = [*k, "range"]
    r = keeps.select(*by, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    own = src.select(*k, "t", "hash", "size", F.col("t").alias("start"), (F.col("t") + 1e-9).alias("end"))
    inside = overlap_join(own, r, k, bucket).select(*by, "t", "hash", "size")
    a = inside.withColumn("i", F.row_number().over(ordered(by, "t")))
    before_it = keeps.select(*by, (F.col("start") - look_back).alias("b_start"), F.col("start").alias("b_end"))
    sizes = overlap_join(own, before_it, k, bucket).select(*by, "size", F.lit(True).alias("known")).distinct()
    came = out.join(sizes, [*by, "size"], "left").withColumn("j", F.row_number().over(ordered(by, "t")))
    # beyond that number, the place of the first row's hash is tried as well, to tell what arrived
    first = came.join(a.filter("i = 1").select(*by, F.col("hash").alias("h1")), by).filter("hash = h1").groupBy(*by).agg((F.min("j") - 1).alias("far"))
    tries = F.array_distinct(F.array_compact(F.concat(F.sequence(F.lit(0), F.lit(most)), F.array("far"))))
    a = a.join(first, by, "left").withColumn("ahead", F.explode(tries)).withColumn("j", F.col("i") + F.col("ahead"))
    b = came.select(*by, "j", F.col("t").alias("ot"), F.col("hash").alias("oh"), F.col("size").alias("os"))
    same = F.coalesce((F.col("oh") == F.col("hash")) & (F.col("os") == F.col("size")), F.lit(False))
    met = a.join(b, [*by, "j"], "left").withColumn("ok", same).withColumn("move", F.when(F.col("ok"), F.col("ot") - F.col("t")))
    tried = met.groupBy(*by, "ahead").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("ok").cast("long")).alias("arrived"), (F.max("move") - F.min("move")).alias("drift"))
    # the first row of an unknown size bounds how many may stand ahead
    counts = came.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("known").isNull(), F.col("j"))).alias("strange"))
    tried = tried.join(counts, by, "left").withColumn("told", (F.col("rows") == F.col("arrived")) & (F.col("ahead") <= most) & (F.col("strange").isNull() | (F.col("strange") > F.col("ahead"))))
    best = tried.groupBy(*by).agg(F.max(F.struct("told", "arrived", (-F.col("ahead")).alias("less"), "rows", "drift")).alias("m")).select(*by, "m.*")
    rows = best.join(counts.select(*by, "total"), by, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "arrived", "total", "less")})
    passed = F.coalesce("told", F.lit(False)) & (F.coalesce("drift", F.lit(0.0)) < spread) & (F.col("total") == F.col("rows") - F.col("less"))
    return rows.withColumn("passed", passed).select(*by, "rows", "arrived", "drift", "passed")


def fade_envelope_check(levels: DataFrame, seams: DataFrame, key: Key = "rec", quiet: float = -40.0, burst: float = -12.0, near: float = 0.06, outside: float = 1.0, bucket: float = 60.0) -> DataFrame:
    """At each seam (t, fade, level): the level there, the loudest within `near`, and that outside the fade it is back.

    levels: t and db. Passed: quiet at the seam, no burst around it, and within `outside` dB of `level` just beyond the fade.
    """
    k = keys(key)
    s = seams.withColumn("start", F.col("t") - 2 * F.col("fade")).withColumn("end", F.col("t") + 2 * F.col("fade")).withColumnRenamed("t", "seam")
    rows = overlap_join(s, levels.select(*k, F.col("t").alias("b_start"), F.col("t").alias("b_end"), "db"), k, bucket, closed=True)
    d = F.abs(F.col("b_start") - F.col("seam"))
    facts = rows.groupBy(*k, "seam").agg(
        F.min(F.struct(d.alias("d"), "b_start", "db"))["db"].alias("at_seam"),
        F.max(F.when(d <= near, F.col("db"))).alias("loudest"),
        F.max(F.when(d > F.col("fade"), F.abs(F.col("db") - F.col("level")))).alias("away"),
    )
    passed = (F.col("at_seam") <= quiet) & (F.coalesce("loudest", F.lit(quiet)) <= burst) & (F.coalesce("away", F.lit(0.0)) <= outside)
    return facts.withColumn("passed", passed)


def quietest_step(levels: DataFrame, key: Key = "rec") -> DataFrame:
    """Where no seam is given: the time of the least level (the first of equals)."""
    return levels.groupBy(*keys(key)).agg(F.min(F.struct("db", "t")).getField("t").alias("t"))
