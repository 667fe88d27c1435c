"""Easing curves of crossings, and fades, as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CURVES = ("none", "back", "bounce", "circle", "elastic", "exponential", "power", "sine", "quadratic", "cubic", "quartic", "quintic")
MODES = ("in", "out", "in-out", "out-in")


def _bounce(t: Column) -> Column:
    """A dropped ball: four parabolas, each lower and shorter."""
    out = None
    # (until, centre, floor) of each parabola, in units of 1/2.75
    for until, centre, floor in ((1, 0, 0.0), (2, 1.5, 0.75), (2.5, 2.25, 0.9375), (None, 2.625, 0.984375)):
        value = 7.5625 * (t - centre / 2.75) * (t - centre / 2.75) + floor
        if out is None:
            out = F.when(t < until / 2.75, value)
        else:
            out = out.otherwise(value) if until is None else out.when(t < until / 2.75, value)
    return out


def ease_in(curve: str, t: Column) -> Column:
    """The slow-at-the-start form of a curve on 0..1."""
    powers = {"none": 1, "quadratic": 2, "cubic": 3, "power": 3, "quartic": 4, "quintic": 5}
    if curve in powers:
        return F.pow(t, F.lit(powers[curve]))
    grow = F.pow(F.lit(2.0), 10 * t - 10)
    return {
        "sine": lambda: 1 - F.cos(t * math.pi / 2),
        "circle": lambda: 1 - F.sqrt(F.greatest(1 - t * t, F.lit(0.0))),
        "exponential": lambda: F.when(t <= 0, 0.0).otherwise(grow),
        "back": lambda: 2.70158 * t * t * t - 1.70158 * t * t,
        "elastic": lambda: F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(-grow * F.sin((t * 10 - 10.75) * (2 * math.pi / 3))),
        "bounce": lambda: 1 - _bounce(1 - t),
    }[curve]()


def easing(curve: str, mode: str, t: Column) -> Column:
    """How much of a crossing shows when t of it has passed; 0 at 0 and 1 at 1, possibly outside between."""
    if curve not in CURVES or mode not in MODES:
        raise ValueError(f"no easing {curve} {mode}")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    e = lambda x: ease_in(curve, x)
    if mode == "in":
        return e(t)
    if mode == "out":
        return 1 - e(1 - t)
    if mode == "in-out":
        return F.when(t < 0.5, e(t * 2) / 2).otherwise(1 - e((1 - t) * 2) / 2)
    return F.when(t < 0.5, (1 - e(1 - t * 2)) / 2).otherwise(0.5 + e((t - 0.5) * 2) / 2)


def showing(progress: Column, share: float = 0.25) -> Column:
    """How solid a card over a crossing is: up over the first quarter, down over the last."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(p / share, (1 - p) / share)))


def fade_gain(since_start: Column, to_end: Column, fade_in: Column, fade_out: Column) -> Column:
    """Raised-cosine gain between two fades; where both reach, the quieter one holds."""
    rise = lambda x, d: F.when(d <= 0, 1.0).otherwise(0.5 - 0.5 * F.cos(math.pi * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.when(d > 0, d)))))
    return F.least(rise(since_start, fade_in), rise(to_end, fade_out))


def fades_for(length: Column, fade_in: Column, fade_out: Column, first: Column, last: Column, longest: float = 60.0) -> tuple[Column, Column]:
    """Lengths of a range's fades: half of it and `longest` at most, none at the output's own head and tail."""
    cut = lambda d, off: F.when(off, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(d, length / 2, F.lit(longest))))
    return cut(fade_in, first), cut(fade_out, last)
