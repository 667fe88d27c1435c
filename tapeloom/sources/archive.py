"""Sources and sinks of a recording archive: transport packets, marks, cue sheets, captions, manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Key, keys, ordered, so_far
from . import transport


def _byte(raw: Column, at: Column | int) -> Column:
    """The unsigned byte at a place (from 0) of a binary column."""
    i = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("long")


def packets_from_bytes(files: DataFrame, stride: int | None = None) -> DataFrame:
    """A row for each transport packet of (rec, content): seq, pos, pid, unit_start, pcr (27 MHz), pts (90 kHz), payload.

    For bytes that are in a frame already; files of any size are read by `transport.read_packets`. The first packet and the
    stride are found as `transport.framing` says; where nothing fits and no stride is given, a row gives none. pos is where a packet's
    stride begins (under 0 if a first arrival time is cut off). Packets without the sync byte are dropped.
    """
    columns = ["rec", *transport.TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            kind = rows.schema.field("rec").type
            for rec, content in zip(rows.column("rec"), rows.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer() or b"", np.uint8)
                framed = transport.framing(data, len(data), stride)
                n = (len(data) - framed[0] - transport.PACKET) // framed[1] + 1 if framed else 0
                for k in range(0, n, transport.BLOCK_BYTES // 188):
                    at = framed[0] + k * framed[1]
                    yield transport.batch(rec.as_py(), data, at, at, *framed, min(transport.BLOCK_BYTES // 188, n - k), columns, None, kind)

    kind = files.schema["rec"].dataType.simpleString()
    return files.select("rec", "content").mapInArrow(run, f"rec {kind}, {transport.SCHEMA}")


def read_ts_packets(spark: SparkSession, path: str, stride: int | None = None, columns: Sequence[str] | None = None, pids: Sequence[int] | None = None) -> DataFrame:
    """Packets of all files at a path, read by ranges of bytes (see transport.read_packets)."""
    return transport.read_packets(spark, path, stride, columns, pids)


def read_mark_list(spark: SparkSession, path: str) -> DataFrame:
    """(rec, frame) of files with a frame number a line; other lines are skipped, missing files are empty."""
    lines = spark.read.option("ignoreMissingFiles", "true").text(path).select(F.col("_metadata.file_path").alias("rec"), F.trim("value").alias("value"))
    return lines.filter(F.col("value").rlike("^[0-9]+$")).select("rec", F.col("value").try_cast("long").alias("frame")).filter("frame IS NOT NULL")


def cue_starts(sheets: DataFrame) -> DataFrame:
    """S3: (rec, start) of the tracks in the first FILE of (rec, text): INDEX 01, or else 00; sorted, distinct; 75 frames a second."""
    lines = sheets.select("rec", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\t", " ")))
    word = F.upper(F.regexp_extract("line", r"^([A-Za-z]+)", 1))
    w = so_far("rec", "i")
    rows = lines.withColumn("file", F.sum((word == "FILE").cast("int")).over(w)).withColumn("track", F.sum((word == "TRACK").cast("int")).over(w)).filter("file <= 1 AND track > 0")
    part = lambda n: F.regexp_extract("line", r"(?i)^INDEX +([0-9]+) +([0-9]+):([0-9]{1,2}):([0-9]{1,2})", n)
    rows = rows.filter(part(1) != "").select("rec", "track", part(1).cast("int").alias("index"), (part(2).cast("double") * 60 + part(3).cast("double") + part(4).cast("double") / 75).alias("t"))
    per = rows.groupBy("rec", "track").agg(F.coalesce(F.max(F.when(F.col("index") == 1, F.col("t"))), F.max(F.when(F.col("index") == 0, F.col("t")))).alias("start"))
    return per.filter("start IS NOT NULL").select("rec", "start").distinct()


def read_cue_sheet(spark: SparkSession, path: str) -> DataFrame:
    """S3: track starts of all cue sheets at a path; keywords are ASCII, so titles are not decoded."""
    files = spark.read.format("binaryFile").load(path)
    return cue_starts(files.select(F.col("path").alias("rec"), F.decode("content", "ISO-8859-1").alias("text")))


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS with optional decimals."""
    part = lambda n: F.regexp_extract(text, r"^([0-9]+):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)$", n)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


def read_ttml_cues(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Df with begin and end of the first div of its caption documents; only rows whose end is later."""
    div = F.regexp_extract(payload, r"(?s)<(?:\w+:)?div\b([^>]*)>", 1)
    time = lambda name: clock_seconds(F.regexp_extract(div, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    return df.withColumn("begin", time("begin")).withColumn("end", time("end")).filter(F.col("end") > F.col("begin"))


def write_mark_list(df: DataFrame, path: str, frame: str = "frame") -> None:
    """Frame numbers, one a line and ascending."""
    df.select(frame).orderBy(frame).select(F.col(frame).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def file_identity(files: DataFrame, version: int) -> DataFrame:
    """What a file is told by: path, length, change time, a hash of its first 64 KiB, and the reader's version."""
    return files.select("path", "length", "modified", F.xxhash64(F.substring("content", 1, 65536)).alias("head"), F.lit(version).alias("version"))


def new_or_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Identities that the manifest does not hold as read whole."""
    whole = manifest.filter("whole").select("path", "length", "modified", "head", "version")
    return files.join(whole, ["path", "length", "modified", "head", "version"], "left_anti")


def retention_prune(df: DataFrame, keep: int, budget: int, key: Key = "store") -> DataFrame:
    """`kept`: newest first, spared rows counted ahead; the newest unspared one always stays.

    Others stay while their count and running bytes, dropped rows included, are within limits.
    Half-written rows (half, age in seconds) count for nothing: over a day old they go, younger ones stay.
    """
    k = keys(key)
    rows = df.withColumn("__half", F.coalesce("half", F.lit(False)))
    live = rows.filter("NOT __half")
    spared = live.groupBy(*k).agg(F.sum(F.when(F.col("spare"), 1).otherwise(0)).alias("sn"), F.sum(F.when(F.col("spare"), F.col("bytes")).otherwise(0)).alias("sb"))
    w = ordered([*k, "spare"], F.desc("modified"), "path")
    run = so_far([*k, "spare"], F.desc("modified"), "path")
    ranked = live.withColumn("__n", F.row_number().over(w)).withColumn("__b", F.sum("bytes").over(run)).join(spared, k)
    fits = (F.col("__n") + F.col("sn") <= keep) & (F.col("__b") + F.col("sb") <= budget)
    out = ranked.withColumn("kept", F.col("spare") | (F.col("__n") == 1) | fits).select(*df.columns, "kept")
    return out.unionByName(rows.filter("__half").select(*df.columns, (F.col("age") <= 86400).alias("kept")))


def append_new(existing: DataFrame, incoming: DataFrame, key: Key = "path") -> DataFrame:
    """Existing rows and those incoming ones whose key is not there yet."""
    return existing.unionByName(incoming.join(existing.select(*keys(key)), keys(key), "left_anti").dropDuplicates(keys(key)))


def merge_latest(existing: DataFrame, incoming: DataFrame, key: Key = "path", edited: str = "edited", order: Sequence[str] = ()) -> DataFrame:
    """Of both sides' rows of a key the one edited last; of equals the incoming one."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(ordered(key, F.desc(edited), F.desc("__new"), *order))
    return both.withColumn("__i", rank).filter("__i = 1").drop("__i", "__new")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        c = np.where(c >> 31, c << 1 ^ np.uint32(0x04C11DB7), c << 1).astype(np.uint32)
    return c


_CRC32 = _crc_table()


def _number(raw: Column, at: Column | int, n: int) -> Column:
    """The unsigned number in n bytes from a place (from 0) of a binary column on."""
    i = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(raw, i + 1, F.lit(n))), 16, 10).cast("long")


def crc32_mpeg2(section: str | Column) -> Column:
    """The checksum of a table section: 0 over a whole section with its own checksum; a table's lookup for each byte, in columns."""
    digits = F.hex(F.col(section) if isinstance(section, str) else section)
    table = F.array(*[F.lit(int(v)) for v in _CRC32])
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    fold = lambda c, i: F.shiftleft(c, 8).bitwiseAND(0xFFFFFFFF).bitwiseXOR(F.get(table, F.shiftright(c, 24).bitwiseXOR(byte(i)).cast("int")))
    n = F.length(digits) / 2
    return F.when(n == 0, 0xFFFFFFFF).otherwise(F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), F.lit(0xFFFFFFFF), fold))


def sections_from_packets(packets: DataFrame, pid: int, key: Key = "rec", checked: tuple[int, int] = (0x00, 0x6F)) -> DataFrame:
    """(seq, table_id, section) of one PID: payloads from each unit start on, cut by their lengths.

    What stands before a unit start's pointer ends the section begun earlier. Stuffing ends a unit;
    sections of table ids within `checked` must have a right checksum.
    """
    k = keys(key)
    rows = packets.filter((F.col("pid") == pid) & F.col("payload").isNotNull())
    pointer = _byte(F.col("payload"), 0)
    head = F.struct("seq", F.lit(0).alias("part"), F.lit(False).alias("fresh"), F.when(F.col("unit_start"), F.substring("payload", F.lit(2), pointer.cast("int"))).otherwise(F.col("payload")).alias("data"))
    tail = F.struct("seq", F.lit(1).alias("part"), F.lit(True).alias("fresh"), F.substring("payload", (pointer + 2).cast("int"), F.lit(188)).alias("data"))
    parts = rows.select(*k, F.explode(F.when(F.col("unit_start"), F.array(head, tail)).otherwise(F.array(head))).alias("x")).select(*k, "x.*")
    parts = parts.withColumn("unit", F.sum(F.col("fresh").cast("int")).over(so_far(k, "seq", "part"))).filter("unit > 0")
    units = parts.groupBy(*k, "unit").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("seq", "part", "data"))).alias("ps"))
    # bytes travel as Latin-1 characters, which one call can join
    units = units.withColumn("data", F.encode(F.array_join(F.transform("ps", lambda x: F.decode(x["data"], "ISO-8859-1")), ""), "ISO-8859-1"))
    # lengths are walked in columns: each step notes a section's place and goes on behind it; past the last one, steps only count
    size = F.octet_length("data").cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,table_id:bigint,len:bigint>>").alias("found"))

    def walk(s: Column, _: Column) -> Column:
        header = _number(F.col("data"), s["at"].cast("int"), 3)

        def noted(h: Column) -> Column:
            own, n = F.shiftright(h, 16), h.bitwiseAND(0x0FFF) + 3
            held = F.struct((s["at"] + n).alias("at"), F.concat(s["found"], F.array(F.struct(s["at"].alias("at"), own.alias("table_id"), n.alias("len")))).alias("found"))
            return F.when((own != 0xFF) & (s["at"] + n <= size), held).otherwise(F.struct(size.alias("at"), s["found"].alias("found")))

        # the header is read once a step, by a transform of an array of one
        return F.when(s["at"] + 3 > size, s).otherwise(F.get(F.transform(F.array(header), noted), 0))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(size / 3).cast("int")))
    cut = units.select(*k, "seq", "data", F.explode(F.aggregate(steps, zero, walk)["found"]).alias("f"))
    out = cut.select(*k, "seq", "f.table_id", F.substring("data", F.col("f.at").cast("int") + 1, F.col("f.len").cast("int")).alias("section"))
    guarded = F.when(F.col("table_id").between(*checked), F.col("section"))
    return out.filter(F.coalesce(crc32_mpeg2(guarded), F.lit(0).cast("long")) == 0)

