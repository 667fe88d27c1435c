"""Column functions over times in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of the 90 kHz clock after which it starts again.
WRAP = 2**33
HZ = 90000.0


def parse_timecode(text: Column) -> Column:
    """Seconds of `s`, `m:s` or `h:m:s`; the last field may have decimals. NULL for anything else."""
    ok = F.trim(text).rlike(r"^([0-9]+:){0,2}[0-9]+(\.[0-9]*)?$|^([0-9]+:){0,2}\.[0-9]+$")
    fields = F.split(F.trim(text), ":")
    total = F.aggregate(fields, F.lit(0.0), lambda s, x: s * 60 + x.try_cast("double"))
    return F.when(ok, total)


def format_timecode(t: Column) -> Column:
    """`h:mm:ss.mmm`, rounded to milliseconds once and then divided."""
    ms = F.round(t * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = F.concat(F.floor(ms / 3600000).cast("string"), F.lit(":"), two(F.pmod(F.floor(ms / 60000), F.lit(60))), F.lit(":"), two(F.pmod(F.floor(ms / 1000), F.lit(60))), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    return F.when(t >= 0, part)


def unwrap_mark(t: Column, duration: Column, turn: float = WRAP / HZ) -> Column:
    """T4: a negative time gets whole turns of the clock; then, and only then, one past duration + 1 is NULL."""
    mended = t + F.ceil(-t / turn) * turn
    return F.when(t >= 0, t).when(mended <= duration + 1, mended)


def on_grid_time(t: Column, phase: Column, frame: Column) -> Column:
    """The frame grid's time for t: a quarter of a frame early still counts as the next frame."""
    return phase + F.floor((t - phase) / frame + 0.25) * frame


def on_grid(gap: Column, slack: Column, unit: float = 15.0, most: int = 8) -> Column:
    """Whether a gap is 1 to `most` units long, within slack."""
    n = F.round(gap / unit)
    return (n >= 1) & (n <= most) & (F.abs(gap - n * unit) <= slack)
