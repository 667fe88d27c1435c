"""What cuts come to on a disc or in a file, and whether they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Key, keys
from .intervals import with_clock

#: Bytes that the discs hold.
DISCS = (("BD-R/RE 25GB", 25025314816), ("BD-R/RE DL 50GB", 50050629632), ("BD-R XL 100GB", 100103356416), ("BD-R XL 128GB", 128001769472))
#: What framing costs around pictures and sound, and tables and index files.
FRAMING, SOUND_DISC, SOUND_FILE = 1.056, 1.2, 1.4 * 188 / 192
TABLES_DISC, TABLES_FILE = 104 * 192, 1.007
INDEX_RATE, INDEX_BASE, PADDING, DISC_BASE = 10, 4096, 98304, 1048576
MARGIN, LEAST_SHARE = 0.01, 0.35
#: Our own table of bits a second that a codec is worth for each channel, where a track states no rate.
CODEC_RATES = {"aac": 96000, "aac_latm": 96000, "ac3": 96000, "eac3": 96000, "mp2": 128000, "mp3": 96000, "opus": 64000, "vorbis": 64000, "dts": 256000, "truehd": 700000, "mlp": 700000, "flac": 400000}


def _worth(codec: Column, channels: Column) -> Column:
    """Bits a second that CODEC_RATES gives a codec for so many channels; 0 where it isn't listed."""
    table = F.create_map(*[F.lit(x) for pair in CODEC_RATES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, codec), F.lit(0)) * channels


def audio_rate(codec: Column, rate: Column, channels: Column, sample_rate: Column, bits: Column, clock: Column | None = None) -> Column:
    """The stated rate of a track, if above 0; else the codec's for its channels; else the samples' own.

    A stated AAC rate that was read off frames (LATM, or a track on a 90 kHz clock) and is below half of
    the codec's own isn't believed.
    """
    worth = _worth(codec, channels)
    probed = (codec == "aac_latm") | (codec.startswith("aac") & F.coalesce(clock == 90000, F.lit(False))) if clock is not None else codec == "aac_latm"
    least = F.when(probed, F.floor(worth / 2)).otherwise(0)
    return F.when((rate > 0) & (rate >= least), rate).when(worth > 0, worth).otherwise(sample_rate * channels * F.greatest(bits, F.lit(16))).cast("double")


def _own_rate(tracks: DataFrame) -> Column:
    c = F.col
    return audio_rate(c("codec"), c("rate"), c("channels"), c("sample_rate"), c("bits"), c("clock") if "clock" in tracks.columns else None)


def rates(recordings: DataFrame, tracks: DataFrame, key: Key = "rec", holes: DataFrame | None = None) -> DataFrame:
    """Video and audio bits a second of each recording; without a measured picture rate, nine tenths of the file's.

    tracks: codec, rate, channels, sample_rate, bits and, where known, clock (ticks a second). Bytes are measured over the whole
    clock, but only written seconds are kept: with holes (start, end), the stretches of the clock that nothing was written in, and
    recordings' `duration`, picture rates are of a written second (I10). Sound has its own clock.
    """
    k = keys(key)
    if holes is not None:
        recordings = with_clock(recordings, holes, k)
    # shuffled before they are summed: sums ahead of the shuffle would hold a whole piece of a file's recordings at once
    sound = tracks.select(*k, _own_rate(tracks).alias("own")).repartition(*k).groupBy(*k).agg(F.sum("own").alias("audio")).hint("merge")  # about as many rows as recordings
    video = F.when(F.col("video_rate") > 0, F.col("video_rate")).otherwise(F.col("file_rate") * 0.9)
    if holes is not None:
        video = video * F.col("ratio")
    return recordings.join(sound, k, "left").select(*k, video.alias("video"), F.coalesce("audio", F.lit(0.0)).alias("audio"), (F.col("codec") == "mpeg2video").alias("can_shrink"))


def rates_as_written(tracks: DataFrame, key: Key = "rec", to_ts: bool = False) -> DataFrame:
    """Audio bits a second as written: dropped tracks count nothing, rewritten ones their target's rate.

    Columns drop, to_codec, to_rate, to_channels, to_sample_rate, to_bits (NULL keeps the track's own) tell
    what is asked. DTS, TrueHD and MLP are carried whole unless a codec is named. Into a transport stream
    linear PCM goes in pairs of channels, and a DVD's at 16 or 24 bits.
    """
    c = F.col
    own, channels, target = _own_rate(tracks), F.coalesce("to_channels", "channels"), F.coalesce("to_codec", "codec")
    pcm = (target == "lpcm") | target.startswith("pcm_")
    whole = c("codec").isin("dts", "truehd", "mlp") & c("to_codec").isNull()
    asked = lambda wish, own: F.coalesce(c(wish) != c(own), F.lit(False))
    rewritten = ~whole & ((target != c("codec")) | (channels != c("channels")) | asked("to_sample_rate", "sample_rate") | c("to_rate").isNotNull() | (pcm & asked("to_bits", "bits")))
    paired = lambda n: n + n % 2 if to_ts else n
    samples = F.coalesce("to_sample_rate", "sample_rate") * paired(channels) * F.greatest(F.coalesce("to_bits", "bits"), F.lit(16))
    worth = _worth(target, channels)
    folded = F.when((c("channels") > 0) & (channels != c("channels")), F.greatest(own * channels / c("channels"), F.lit(128000.0))).otherwise(own)
    carried = own
    if to_ts:
        carried = F.when((c("codec") == "pcm_dvd") & (c("channels") > 0) & (c("sample_rate") > 0), c("sample_rate") * paired(c("channels")) * F.when(c("bits") > 16, 24).otherwise(16)).otherwise(own)
    recoded = F.when(pcm, samples).when(c("to_rate").isNotNull(), c("to_rate")).when(target != c("codec"), F.when(worth > 0, worth).otherwise(own)).otherwise(folded)
    price = F.when(c("drop"), 0.0).when(rewritten, recoded).otherwise(carried).cast("double")
    return tracks.groupBy(*keys(key)).agg(F.sum(price).alias("audio"))


def estimate_size(df: DataFrame, disc: bool = True) -> DataFrame:
    """Bytes and video_bytes of rows with seconds, video, audio (bits a second) and busier (bytes over the average)."""
    s = F.col("seconds")
    framing, sound = (FRAMING, SOUND_DISC) if disc else (FRAMING * 188 / 192, SOUND_FILE)
    pictures = F.greatest(F.greatest("video", F.lit(0.0)) / 8 * s + F.coalesce("busier", F.lit(0.0)), F.lit(0.0))
    streams = pictures * framing + F.greatest("audio", F.lit(0.0)) / 8 * s * sound
    whole = streams + TABLES_DISC * F.greatest(s, F.lit(0.0)) if disc else streams * TABLES_FILE
    extras = (s * INDEX_RATE).cast("long") + INDEX_BASE + PADDING if disc else F.lit(0)
    return df.withColumn("bytes", whole.cast("long") + extras).withColumn("video_bytes", (pictures * framing).cast("long"))


def fit_capacity(estimates: DataFrame, capacity: Column | int, key: Key = "disc", margin: float = MARGIN) -> DataFrame:
    """Per disc the sum of its cuts and, where they don't fit, the share that shrinkable pictures must come to."""
    total = estimates.groupBy(*keys(key)).agg((F.sum("bytes") + DISC_BASE).alias("bytes"), F.coalesce(F.sum(F.when(F.col("can_shrink"), F.col("video_bytes"))), F.lit(0)).alias("video_bytes"))
    cap = capacity if isinstance(capacity, Column) else F.lit(capacity)
    usable = (cap * (1 - min(max(margin, 0.0), 0.5))).cast("long")
    rows = total.withColumn("usable", usable).withColumn("fits", F.col("bytes") <= F.col("usable"))
    room = F.greatest(F.col("usable") - (F.col("bytes") - F.col("video_bytes")), F.lit(0))
    share = F.when(F.col("video_bytes") > 0, room / F.col("video_bytes")).otherwise(0.0)
    return rows.withColumn("share", F.when(F.col("fits"), 1.0).otherwise(F.least(F.lit(1.0), share))).withColumn("reachable", F.col("fits") | (share >= LEAST_SHARE))


def fit_discs(estimates: DataFrame, key: Key = "disc", margin: float = MARGIN) -> DataFrame:
    """fit_capacity against each of DISCS (four rows for each key)."""
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("capacity")) for n, b in DISCS]))
    own = estimates.withColumn("__d", sizes).select("*", "__d.name", "__d.capacity").drop("__d")
    return fit_capacity(own, F.col("capacity"), [*keys(key), "name", "capacity"], margin)


def disc_holds(capacity: Column, overwritable: Column, single: int, dual: int, dual_image: int) -> Column:
    """What a disc holds: its size, or where it is written as an overwritable image, one of two rooms."""
    return F.when(~overwritable, capacity).when(capacity >= dual_image, dual).otherwise(F.least(capacity, F.lit(single)))
