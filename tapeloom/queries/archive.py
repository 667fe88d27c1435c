"""Source and sink queries: events become packets, sheets and lists; documents stand for archived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..sources import archive as a
from ..sources import transport
from .common import EV, events, r, table


def _hex(column, digits: int):
    return F.lpad(F.hex(column), digits, "0")


def _packets(spark, sf):
    """Events with a packet each as hex, with the event's id as the PID and its time as PCR and PTS; every other one's stream id is FD."""
    ev = events(spark, sf).withColumn("pid", F.pmod("event_id", F.lit(8000))).withColumn("ticks", F.floor(F.col("t") * 1000))
    base = F.col("ticks")
    b4 = F.shiftright(base, 1)
    last = F.shiftleft(base.bitwiseAND(1), 15).bitwiseOR(F.lit(0x7E00)) + F.pmod("event_id", F.lit(300))
    p = lambda c: c
    pts = [F.lit(0x21).bitwiseOR(F.shiftleft(F.shiftright(base, 30).bitwiseAND(7), 1)), F.shiftright(base, 22).bitwiseAND(255), F.shiftleft(F.shiftright(base, 15).bitwiseAND(127), 1).bitwiseOR(F.lit(1)), F.shiftright(base, 7).bitwiseAND(255), F.shiftleft(base.bitwiseAND(127), 1).bitwiseOR(F.lit(1))]
    unit = F.when(F.col("value") > 250, 0x40).otherwise(0)
    parts = [F.lit("47"), _hex(unit.bitwiseOR(F.shiftright("pid", 8)), 2), _hex(F.col("pid").bitwiseAND(255), 2), F.lit("30"), F.lit("07"), F.lit("10"), _hex(p(b4), 8), _hex(last, 4), F.when(F.col("event_id") % 2 == 0, "000001FD000080800A").otherwise("000001E0000080800A"), *[_hex(x, 2) for x in pts]]
    text = F.rpad(F.concat(*parts), 376, "0")
    return ev.withColumn("packet", text)


def _streams(spark, sf):
    """A file for each user: a packet for each event. Two of three files of five packets or more begin mid-packet."""
    joined = _packets(spark, sf).groupBy("rec").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("event_id", "packet"))), lambda x: x["packet"])).alias("h"))
    ahead = F.when(F.length("h") >= 5 * 376, F.pmod("rec", F.lit(3)) * 50).otherwise(0).cast("int")
    return joined.select("rec", F.unhex(F.concat(F.repeat(F.lit("0B"), ahead), "h")).alias("content"))


def s1_packets(spark, sf):
    found = a.packets_from_bytes(_streams(spark, sf)).withColumn("pos", F.col("pos") - F.pmod("pos", F.lit(188)))  # less the bytes ahead
    return found.select("rec", "seq", "pos", "pid", "unit_start", "pcr", F.coalesce("pts", F.lit(-1)).alias("pts"))


#: Events of a recording of s1_ranges, and bytes of a range: a recording takes several.
RECORDED, RANGE = 4_000, 100_000


def s1_ranges(spark, sf):
    """Recordings of so many events on end, written as files of packets and read back by ranges; one PID of 8 is decoded."""
    from ..functions.storage import shared_folder

    path = shared_folder(spark, "recordings")
    rows = _packets(spark, sf).withColumn("store", F.floor(F.col("event_id") / RECORDED))
    # each packet's last byte is 0: the text sink ends its rows with it
    bytes_ = rows.select("store", "event_id", F.unhex(F.substring("packet", 1, 374)).cast("string").alias("value"))
    bytes_.repartition("store").sortWithinPartitions("store", "event_id").drop("event_id").write.partitionBy("store").option("lineSep", "\0").text(path)
    found = transport.read_packets(spark, path, columns=["rec", "seq", "pos", "pid", "pcr", "pts"], pids=range(0, 8000, 8), range_bytes=RANGE)
    return found.select(F.regexp_extract("rec", r"store=(\d+)", 1).cast("long").alias("store"), "seq", "pos", "pid", "pcr", F.coalesce("pts", F.lit(-1)).alias("pts"))


def s2_mark_list(spark, sf):
    """Marks of a list with headers and noise between, written by Spark and read back as files."""
    from ..functions.storage import shared_folder

    path = shared_folder(spark, "marks")
    lines = events(spark, sf).select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("fps "), "event_id")).when(F.col("event_id") % 10 == 1, F.lit("# frames")).otherwise(F.col("event_id").cast("string")).alias("value"))
    lines.write.text(path)
    return a.read_mark_list(spark, path).select("frame")


def s3_cue_sheet(spark, sf):
    ev = events(spark, sf)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.concat((F.floor("value") % 70).cast("string"), F.lit(":"), two(F.col("event_id") % 60), F.lit(":"), two(F.col("event_id") % 75))
    block = F.concat(F.when(F.col("i") == 40, "FILE \"b.bin\" BINARY\n").otherwise(""), F.lit("  TRACK 01 AUDIO\n"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("    INDEX 00 00:00:00\n"))).otherwise(""), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("    INDEX 01 "), at, F.lit("\n"))).otherwise(""))
    from ..functions.frames import ordered

    rows = ev.withColumn("i", F.row_number().over(ordered("rec", "event_id"))).withColumn("block", block)
    sheets = rows.groupBy("rec").agg(F.concat(F.lit("TITLE x\nFILE \"a.bin\" BINARY\n"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("i", "block"))), lambda x: x["block"]))).alias("text"))
    return a.cue_starts(sheets).select("rec", r("start"))


def s4_ttml(spark, sf):
    ev = events(spark, sf)
    clock = lambda s: F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(s) % 60).cast("string"), 2, "0"), F.lit(".25"))
    doc = F.concat(F.lit("<tt><body><div begin=\""), clock(F.col("value")), F.lit("\" end='"), clock(F.col("event_id") % 700), F.lit("'><p>x</p></div><div begin=\"00:00:00\" end=\"99:00:00\"/></body></tt>"))
    return a.read_ttml_cues(ev.select("event_id", doc.alias("payload"))).select("event_id", "begin", "end")


def s5_write_marks(spark, sf):
    """A written mark list, read back line by line."""
    from ..functions.storage import shared_folder

    path = shared_folder(spark, "mark-list")
    a.write_mark_list(events(spark, sf).filter("event_type = 'error'").select("event_id"), path, "event_id")
    return spark.read.option("lineSep", "\r\n").text(path)


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"), "doc_id", F.col("n_chars").alias("length"), (F.col("doc_id") * 10).alias("modified"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def s6_new_files(spark, sf):
    files = _files(spark, sf)
    now = a.file_identity(files, 2)
    then = a.file_identity(files.withColumn("length", F.col("length") + (F.col("doc_id") % 5 == 0).cast("int")), 2).withColumn("whole", F.col("modified") % 70 > 0)
    return a.new_or_changed(now, materialise(then)).select("path", "length", "modified")


def s7_retention(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("store"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("bytes"), (F.col("doc_id") * 7919 % 100003).alias("modified"), (F.col("doc_id") % 11 == 0).alias("spare"), (F.col("doc_id") % 13 == 0).alias("half"), F.when(F.col("doc_id") % 2 == 0, 90000).otherwise(10).alias("age"))
    return a.retention_prune(d, keep=20, budget=40000).select("store", "path", "kept")


def _jobs(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") * 10).alias("edited"))
    new = o.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("state"), (F.col("o_orderkey") % 15000 + 5).cast("long").alias("edited"))
    return old, new


def s8_append(spark, sf):
    return a.append_new(*_jobs(spark, sf))


def s8_merge(spark, sf):
    return a.merge_latest(*_jobs(spark, sf))


def s9_sections(spark, sf):
    """Two sections an event, the second cut off by the packet's end and carried on in the next packet.

    Every fourth event's first section is of a table whose checksums count, and has a wrong one.
    """
    ev = events(spark, sf)
    body = lambda table_id, n, c: F.concat(_hex(table_id, 2), F.lit("B0"), F.lit(f"{n:02X}"), F.rpad(_hex(c, 8), 2 * n, "A"))
    one = body(F.when(F.col("event_id") % 4 == 0, 0x40).otherwise(0x80), 20, F.col("event_id"))
    two = body(F.lit(0x81) + F.col("event_id") % 3, 180, F.col("event_id") + 100000)
    start = F.rpad(F.concat(F.lit("00"), one, two), 368, "F")
    rest = F.rpad(F.substring(F.concat(F.lit("00"), one, two), 369, 400), 368, "F")
    first = ev.select("rec", (F.col("event_id") * 2).alias("seq"), F.lit(17).alias("pid"), F.lit(True).alias("unit_start"), F.unhex(start).alias("payload"))
    second = ev.select("rec", (F.col("event_id") * 2 + 1).alias("seq"), F.lit(17).alias("pid"), F.lit(False).alias("unit_start"), F.unhex(rest).alias("payload"))
    found = a.sections_from_packets(first.unionByName(second), 17)
    return found.select("rec", "seq", "table_id", F.octet_length("section").alias("size"), F.conv(F.hex(F.substring("section", 4, 4)), 16, 10).cast("long").alias("id"))


QUERIES = [s1_packets, s1_ranges, s2_mark_list, s3_cue_sheet, s4_ttml, s5_write_marks, s6_new_files, s7_retention, s8_append, s8_merge, s9_sections]

ORACLE = {
    "s1_packets": f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY event_id) - 1 AS seq, floor(t * 1000)::BIGINT AS k FROM ev)
        SELECT rec, seq, seq * 188 AS pos, event_id % 8000 AS pid, value > 250 AS unit_start, k * 300 + event_id % 300 AS pcr, CASE WHEN value > 250 THEN k ELSE -1 END AS pts FROM p""",
    "s1_ranges": f"""WITH {EV}, p AS (SELECT *, event_id // 4000 AS store, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) - 1 AS seq, floor(t * 1000)::BIGINT AS k FROM ev)
        SELECT store, seq, seq * 188 AS pos, event_id % 8000 AS pid, k * 300 + event_id % 300 AS pcr, CASE WHEN value > 250 THEN k ELSE -1 END AS pts FROM p WHERE event_id % 8000 % 8 = 0""",
    "s2_mark_list": "SELECT event_id AS frame FROM events WHERE event_id % 10 > 1",
    "s3_cue_sheet": f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY event_id) AS i FROM ev)
        SELECT DISTINCT rec, round(CASE WHEN event_id % 4 > 0 THEN floor(value) % 70 * 60 + event_id % 60 + (event_id % 75) / 75 ELSE 0 END, 6) AS start FROM p WHERE i < 40 AND (event_id % 4 > 0 OR event_id % 3 = 0)""",
    "s4_ttml": f"""WITH {EV} SELECT event_id, floor(value) + 0.25 AS "begin", event_id % 700 + 0.25::DOUBLE AS "end" FROM ev WHERE event_id % 700 > floor(value)""",
    "s5_write_marks": "SELECT event_id::VARCHAR AS value FROM events WHERE event_type = 'error'",
    "s6_new_files": "SELECT '/' || source || '/' || doc_id AS path, n_chars AS length, doc_id * 10 AS modified FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0",
    "s7_retention": """WITH d AS (SELECT source AS store, doc_id::VARCHAR AS path, n_chars AS bytes, doc_id * 7919 % 100003 AS modified, doc_id % 11 = 0 AS spare, doc_id % 13 = 0 AS half, doc_id % 2 = 1 AS young FROM documents),
        l AS (SELECT * FROM d WHERE NOT half), s AS (SELECT store, count(*) FILTER (spare) AS sn, coalesce(sum(bytes) FILTER (spare), 0) AS sb FROM l GROUP BY store),
        w AS (SELECT l.*, sn, sb, row_number() OVER (PARTITION BY l.store, spare ORDER BY modified DESC, path) AS n, sum(bytes) OVER (PARTITION BY l.store, spare ORDER BY modified DESC, path ROWS UNBOUNDED PRECEDING) AS b FROM l JOIN s ON s.store IS NOT DISTINCT FROM l.store)
        SELECT store, path, spare OR n = 1 OR (n + sn <= 20 AND b + sb <= 40000) AS kept FROM w UNION ALL SELECT store, path, young FROM d WHERE half""",
    "s8_append": """WITH o AS (SELECT o_orderkey AS path, o_orderstatus AS state, o_custkey * 10 AS edited FROM orders WHERE o_orderkey % 3 < 2) SELECT * FROM o UNION ALL
        SELECT o_orderkey, o_orderpriority, o_orderkey % 15000 + 5 FROM orders WHERE o_orderkey % 3 = 2""",
    "s8_merge": """WITH b AS (SELECT o_orderkey AS path, o_orderstatus AS state, o_custkey * 10 AS edited, 0 AS n FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, o_orderpriority, o_orderkey % 15000 + 5, 1 FROM orders WHERE o_orderkey % 3 > 0)
        SELECT path, state, edited FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY edited DESC, n DESC) AS i FROM b) WHERE i = 1""",
    "s9_sections": f"WITH {EV} SELECT rec, event_id * 2 AS seq, 128::BIGINT AS table_id, 23::INTEGER AS size, event_id AS id FROM ev WHERE event_id % 4 > 0 UNION ALL SELECT rec, event_id * 2, 129 + event_id % 3, 183, event_id + 100000 FROM ev",
}
