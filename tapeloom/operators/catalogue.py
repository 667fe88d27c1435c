"""Catalogues: shared titles, programme tables, conformance, containers and default choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.frames import Key, as_of, islands, keys, ordered, whole
from ..functions.greedy import keep_apart

#: What each family of containers holds (allow) or refuses; sound allows any picture and the listed sound.
CONTAINERS = {
    "ts": ("allow", ("mpeg1video", "mpeg2video", "mpeg4", "h264", "hevc", "vvc", "vc1", "aac", "aac_latm", "ac3", "eac3", "dts", "truehd", "mlp", "mp1", "mp2", "mp3", "opus", "pcm_bluray", "pcm_dvd")),
    "mp4": ("refuse", ("vp8", "aac_latm", "mlp", "pcm_u8", "pcm_s8", "prores", "hap", "dnxhd", "cfhd", "dvvideo", "v210", "ffv1", "utvideo", "huffyuv", "qtrle", "rawvideo", "h263", "flv1", "msmpeg4v2", "msmpeg4v3", "wmv1", "wmv2", "theora", "wavpack")),
    "ps": ("sound", ("mp1", "mp2", "mp3", "ac3", "dts", "pcm_s16be")),
    "mov": ("refuse", ("vp8", "vp9", "av1", "truehd", "mlp", "flac", "opus", "wavpack")),
    "webm": ("allow", ("vp8", "vp9", "av1", "opus", "vorbis")),
    "mkv": ("refuse", ("pcm_s8", "rawvideo", "qtrle", "pcm_f64be")),
    # the sound that has a WAVE format tag
    "avi": ("sound", ("aac", "aac_latm", "ac3", "adpcm_g722", "adpcm_g726", "adpcm_ima_wav", "adpcm_ms", "adpcm_yamaha", "amr_nb", "amr_wb", "atrac3", "dts", "flac", "g723_1", "g729", "gsm_ms", "mp2", "mp3", "pcm_alaw", "pcm_f32le", "pcm_f64le", "pcm_mulaw", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_s64le", "pcm_u8", "truespeech", "vorbis", "wmalossless", "wmapro", "wmav1", "wmav2", "wmavoice")),
}
#: Names of sound codecs, besides those that begin with pcm_ or adpcm_.
SOUND = ("aac", "aac_latm", "ac3", "ac4", "alac", "amr_nb", "amr_wb", "ape", "atrac3", "atrac9", "cook", "dolby_e", "dts", "eac3", "flac", "g723_1", "g729", "gsm", "gsm_ms", "lpcm", "mlp", "mp1", "mp2", "mp3", "musepack7", "musepack8", "nellymoser", "opus", "qcelp", "ra_144", "ra_288", "s302m", "shorten", "sipr", "speex", "tak", "truehd", "truespeech", "tta", "vorbis", "wavpack", "wmalossless", "wmapro", "wmav1", "wmav2", "wmavoice")


def shared_title(df: DataFrame, group: Key = "group", name: str = "name", order: str = "n") -> DataFrame:
    """M2: the title that all names of a group share, if need be without a number at its end; else NULL."""
    g = keys(group)
    rows = df.withColumn("__a", titles.series_title(F.col(name))).withColumn("__b", titles.without_bare_number(F.col("__a")))
    out = rows.groupBy(*g).agg(*[x for c in ("__a", "__b") for x in (F.count_distinct(titles.fold_width(F.col(c))).alias(f"{c}n"), F.min(F.struct(order, c)).alias(f"{c}f"))])
    bare = F.when((F.col("__bn") == 1) & (F.col("__bf.__b") != ""), F.col("__bf.__b"))
    return out.select(*g, F.when(F.col("__an") == 1, F.col("__af.__a")).otherwise(bare).alias("title"))


def latest_sections(sections: DataFrame, key: Key = ("rec", "table_id", "service_id"), order: str = "t") -> DataFrame:
    """M5: of current sections the last of each number since the version or the last number changed."""
    k = keys(key)
    now = sections.filter("current")
    w = ordered(k, order)
    change = ~(F.col("version").eqNullSafe(F.lag("version").over(w)) & F.col("last_no").eqNullSafe(F.lag("last_no").over(w)))
    rows = islands(now, change, k, order)
    rows = rows.withColumn("__last", F.max("island").over(whole(k))).filter("island = __last")
    rank = F.row_number().over(ordered([*k, "section_no"], F.desc(order)))
    return rows.withColumn("__i", rank).filter("__i = 1").drop("island", "__last", "__i")


def programme_summary(rows: DataFrame, fields: tuple[str, ...], key: Key = "rec", order: str = "t", placeholders: tuple[str, ...] = ()) -> DataFrame:
    """M6: per key the first stated value of each field in arrival order; placeholder names count as unstated."""
    k = keys(key)
    stated = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*placeholders), F.col(c)) if placeholders else F.col(c)
    firsts = [F.min(F.when(stated(c).isNotNull(), F.struct(F.col(order).alias("o"), stated(c).alias("v")))).getField("v").alias(c) for c in fields]
    return rows.groupBy(*k).agg(*firsts)


def events_at(df: DataFrame, sections: DataFrame, key: Key = "service_id", t: str = "t", take: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """M6: what was in force at an instant: the last section at or before it."""
    k = keys(key)
    return as_of(df, sections.select(*k, F.col("t").alias("at"), *take), k, t, "at", list(take))


def own_schedule(sections: DataFrame, service: str = "own_service") -> DataFrame:
    """M6: schedule tables (0x50 to 0x5F) of the recorded service alone."""
    return sections.filter(F.col("table_id").between(0x50, 0x5F) & (F.col("service_id") == F.col(service)))


def sound_track_names(events: DataFrame, tags: DataFrame, key: Key = "rec") -> DataFrame:
    """M7: the first description that names every wanted tag, events on air before others.

    events: key, on_air, n, description, names (array). tags: key, wanted (array).
    """
    k = keys(key)
    rows = events.join(tags, k).filter(F.size(F.array_except("wanted", "names")) == 0)
    best = rows.groupBy(*k).agg(F.min(F.struct((~F.col("on_air")).alias("off"), "n", "description")).alias("b"))
    return best.select(*k, F.col("b.n").alias("n"), F.col("b.description").alias("description"))


def conform_diff(master: DataFrame, clips: DataFrame, exact: tuple[str, ...], relative: dict[str, float], key: Key = "group", clip: str = "rec") -> DataFrame:
    """M8: (clip, what, master, theirs) of properties that both state and that differ.

    `relative` gives the tolerated relative difference of numbers. Text of both values is returned.
    """
    k = keys(key)
    both = clips.alias("c").join(master.alias("m"), k)
    c, m = lambda n: F.col(f"c.{n}"), lambda n: F.col(f"m.{n}")
    tests = [(n, c(n) != m(n)) for n in exact]
    tests += [(n, F.abs(c(n) - m(n)) > tol * F.abs(m(n))) for n, tol in relative.items()]
    items = [F.when(c(n).isNotNull() & m(n).isNotNull() & test, F.struct(F.lit(n).alias("what"), m(n).cast("string").alias("master"), c(n).cast("string").alias("theirs"))) for n, test in tests]
    return both.select(c(clip).alias(clip), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("d")).select(clip, "d.*")


def conform_tracks(master: DataFrame, clips: DataFrame, key: Key = "group", clip: str = "rec", position: str = "track", props: tuple[str, ...] = ("codec", "channels")) -> DataFrame:
    """M8: differences of sound tracks by position, among the positions both have, and of their number."""
    k = keys(key)
    m = master.select(*k, position, *[F.col(p).alias(f"m_{p}") for p in props])
    met = clips.join(m, [*k, position])
    items = [F.when(F.col(p).isNotNull() & F.col(f"m_{p}").isNotNull() & (F.col(p) != F.col(f"m_{p}")), F.lit(p)) for p in props]
    by_track = met.select(clip, F.col(position).cast("int").alias("track"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("what"))
    counts = clips.groupBy(*k, clip).agg(F.count(F.lit(1)).alias("n")).join(master.groupBy(*k).agg(F.count(F.lit(1)).alias("mn")), k).filter("n <> mn")
    return by_track.unionByName(counts.select(clip, F.lit(None).cast("int").alias("track"), F.lit("tracks").alias("what")))


def conform_actions(diffs: DataFrame, track_diffs: DataFrame, clip: str = "rec", harmless: tuple[str, ...] = ("scan",)) -> DataFrame:
    """M9: whether a clip's pictures must be rewritten, and which of its tracks."""
    video = diffs.groupBy(clip).agg(F.max(~F.col("what").isin(*harmless)).alias("video"))
    audio = track_diffs.filter("track IS NOT NULL").groupBy(clip).agg(F.array_sort(F.collect_set("track")).alias("audio"))
    out = video.join(audio, clip, "full_outer")
    return out.select(clip, F.coalesce("video", F.lit(False)).alias("video"), F.coalesce("audio", F.array().cast("array<int>")).alias("audio"))


def container_holds(df: DataFrame, codec: str = "codec", family: str = "family") -> DataFrame:
    """Rows with whether the container family takes the codec; a family without a rule takes all."""
    sound = F.col(codec).isin(*SOUND) | F.col(codec).startswith("pcm_") | F.col(codec).startswith("adpcm_")
    holds = F.lit(True)
    for name, (rule, codecs) in CONTAINERS.items():
        inside = F.col(codec).isin(*codecs)
        holds = F.when(F.col(family) == name, {"allow": inside, "refuse": ~inside, "sound": ~sound | inside}[rule]).otherwise(holds)
    return df.withColumn("holds", holds)


def default_selection(df: DataFrame, key: Key = "rec", length: str = "length", order: str = "n", least: float = 300.0, recorded: str | None = None) -> DataFrame:
    """`chosen`: titles of `least` seconds or more, or else the longest (the last of equals).

    `recorded` names a flag of discs of recordings, of which all titles are chosen.
    """
    k = keys(key)
    any_long = F.max(F.col(length) >= least).over(whole(k))
    rank = F.row_number().over(ordered(k, F.desc(length), F.desc(order)))
    chosen = F.when(any_long, F.col(length) >= least).otherwise(rank == 1)
    return df.withColumn("chosen", F.coalesce(F.col(recorded), F.lit(False)) | chosen if recorded else chosen)


def place_marks(marks: DataFrame, items: DataFrame, key: Key = "rec", slack: float = 0.001) -> DataFrame:
    """Marks of play items within the item (and slack), rebased to its start; those nearer than slack to the last kept drop."""
    k = keys(key)
    met = marks.join(items, [*k, "item"]).filter((F.col("t") >= F.col("start") - slack) & (F.col("t") <= F.col("end") + slack))
    rows = met.select(*k, "item", (F.col("t") - F.col("start")).alias("at"))
    return keep_apart(rows, [*k, "item"], "at", F.col("at") + slack)

