"""Streaming queries: the events table is streamed in micro-batches and what comes out is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder
from ..streaming import streams as st
from .breaks import ORACLE as BREAKS
from .common import EPOCH_US, EV, r, table


#: Rows of a wave for each of its files, and bytes of what rows of no fixed size hold.
FILE_ROWS, FILE_BYTES = 500_000, 128 << 20


def _files_of_wave(df: DataFrame, waves: int) -> int:
    """The files that a wave of df is written to, by its rows and by the bytes of their texts and contents."""
    loose = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(sum((F.coalesce(c.cast("long"), F.lit(0)) for c in loose), F.lit(0).cast("long")))
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return 1 + max(rows // waves // FILE_ROWS, held // waves // FILE_BYTES)


def _feed(spark: SparkSession, sf: str, df: DataFrame, order: str, waves: int = 4) -> DataFrame:
    """df as a stream whose files arrive in waves of the given order, each wave a micro-batch of as many files as its rows need."""
    path = shared_folder(spark, "feed")
    at = F.col(order).cast("double")
    files = _files_of_wave(df, waves)
    cuts = df.select(at.alias("o")).approxQuantile("o", [i / waves for i in range(1, waves)], 0.001)
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        wave = df.filter((F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi))
        wave.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _events(spark, sf):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(F.col("user_id").alias("rec"), "event_id", F.timestamp_micros(us).alias("ts"), ((us - EPOCH_US) / F.lit(1e6)).alias("t"), "value", "event_type")


def _collect(spark, out: DataFrame) -> DataFrame:
    """All rows of a finite stream, from the sink's files."""
    path, checkpoint = shared_folder(spark, "out"), shared_folder(spark, "checkpoint")
    with st.state_store(spark):
        st.stream_take_new(out, path, checkpoint).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _closed(df: DataFrame) -> DataFrame:
    """df with a row years later for a key of its own, so that the watermark passes every row."""
    last = df.groupBy().agg(F.max("ts").alias("m")).select(F.lit(-1).cast("long").alias("rec"), (F.col("m") + F.expr("INTERVAL 900 DAYS")).alias("ts"))
    return df.unionByName(last, allowMissingColumns=True)


#: Seconds by which rows of the out-of-order streams come late, and the lateness that these allow.
LATE, ALLOWED = 432_000, "6 days"


def _shuffled(df: DataFrame, *by: str) -> DataFrame:
    """df with the time at which each row arrives, up to LATE seconds after its event time, so that waves hold rows of earlier ones' times."""
    return _closed(df).withColumn("arrives", F.col("ts").cast("double") + F.pmod(F.xxhash64(*by), F.lit(LATE)))


def w1_outline(spark, sf):
    feed = _feed(spark, sf, _closed(_events(spark, sf).select("rec", "ts", (F.col("value") / 500).alias("level"))), "ts")
    return _collect(spark, st.stream_level_outline(feed, step="1 day", late="1 hour")).filter("rec >= 0").select("rec", F.unix_micros("start").alias("start_us"), "peak", "rms")


def w2_moving_mean(spark, sf):
    feed = _feed(spark, sf, _closed(_events(spark, sf).select("rec", "ts", "value")), "ts")
    return _collect(spark, st.stream_moving_mean(feed, length="2 days", slide="1 day", late="1 hour")).filter("rec >= 0").select("rec", F.unix_micros("start").alias("start_us"), r("mean"), "n")


def w3_runs(spark, sf):
    feed = _feed(spark, sf, _shuffled(_events(spark, sf).select("rec", "ts", "t", F.col("event_type").alias("state")), "t"), "arrives")
    return _collect(spark, st.stream_runs(feed, late=ALLOWED, idle=400 * 86400.0)).select("rec", "state", r("start"), r("end"), r("last"), "pictures")


def w4_break_chain(spark, sf):
    """Blocks of chained silences that come out of order; equal to the batch blocks."""
    from .breaks import UNIT

    quiet = _events(spark, sf).filter("value < 350").groupBy("rec", "ts", F.col("t").alias("time")).agg(F.max(F.col("value") * 8).alias("dur"))
    found = st.stream_break_chain(_feed(spark, sf, _shuffled(quiet, "time"), "arrives"), unit=UNIT, late=ALLOWED, min_score=0.6, min_fill=0.3, fewest=2)
    return _collect(spark, found).select("rec", r("start"), r("end"), "junctions", r("score"))


def w5_debounce(spark, sf):
    feed = _feed(spark, sf, _shuffled(_events(spark, sf).filter("event_type = 'error'").select("rec", "ts", "t"), "t"), "arrives")
    return _collect(spark, st.stream_debounce(feed, gap=100000.0, late=ALLOWED)).select("rec", r("t"))


def w6_monotone(spark, sf):
    """Rows in the order of their ids, which as milliseconds are event times (past 0, where watermarks begin); they come up to 1000 ids late."""
    rows = _closed(_events(spark, sf).select("rec", F.col("event_id").alias("seq"), "t", F.timestamp_millis(F.col("event_id") + 1000).alias("ts")))
    feed = _feed(spark, sf, rows.withColumn("arrives", F.coalesce(F.col("seq") + F.pmod(F.xxhash64("t"), F.lit(1000)), F.lit(2**62))), "arrives")
    return _collect(spark, st.stream_monotone(feed, late="2 seconds", idle=400 * 86400.0)).select("rec", "seq", r("t"))


def w7_take_new(spark, sf):
    feed = _feed(spark, sf, _events(spark, sf).select("rec", "event_id"), "event_id")
    return _collect(spark, feed)


def w8_append_new(spark, sf):
    path = shared_folder(spark, "appended")
    rows = _events(spark, sf).select(F.col("event_id").alias("path"), "rec")
    rows.filter("path % 3 = 0").write.parquet(f"{path}/base")
    feed = _feed(spark, sf, rows.union(rows.filter("path % 5 = 0")), "path")
    st.stream_append_new(feed, path, shared_folder(spark, "checkpoint")).start().awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)


def w9_new_recordings(spark, sf):
    from .archive import _files

    files = _files(spark, sf)
    known = st.file_identity(files.filter("doc_id % 4 > 0"), 2).withColumn("whole", F.lit(True))
    path = shared_folder(spark, "recordings")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    st.stream_new_recordings(_feed(spark, sf, files, "modified", 2), known, 2, sink, shared_folder(spark, "checkpoint")).start().awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("path", "length", "modified")


def w10_programmes(spark, sf):
    ev = _events(spark, sf)
    feed = _feed(spark, sf, ev.filter("event_type = 'click'").select("rec", "event_id", "t"), "t")
    shows = ev.filter("event_type = 'view'").select("rec", F.col("event_id").alias("programme"), F.col("t").alias("from"), (F.col("t") + 40000).alias("to"))
    return _collect(spark, st.stream_programme_join(feed, shows, "rec")).select("rec", "event_id", F.coalesce("programme", F.lit(-1)).alias("programme"))


QUERIES = [w1_outline, w2_moving_mean, w3_runs, w4_break_chain, w5_debounce, w6_monotone, w7_take_new, w8_append_new, w9_new_recordings, w10_programmes]

_LEVEL = "CASE WHEN {v} > 0 THEN greatest(0, least(255, round((20 * log10({v}) + 80) / 80 * 255)))::INTEGER ELSE 0 END"
_DAY = 86400000000
ORACLE = {
    "w1_outline": f"""WITH b AS (SELECT user_id AS rec, epoch_us(ts) // {_DAY} * {_DAY} AS start_us, max(value / 500) AS top, sqrt(avg((value / 500) * (value / 500))) AS mean FROM events GROUP BY ALL)
        SELECT rec, start_us, {_LEVEL.format(v='top')} AS peak, {_LEVEL.format(v='mean')} AS rms FROM b""",
    "w2_moving_mean": f"""SELECT user_id AS rec, epoch_us(ts) // {_DAY} * {_DAY} - k * {_DAY} AS start_us, round(avg(value), 6) AS mean, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL""",
    "w3_runs": f"""WITH {EV}, a AS (SELECT *, lead(t) OVER w AS nxt, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS st FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)),
        b AS (SELECT *, sum(st) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT rec, g, event_type AS state, min(t) AS s, max(t) AS last, arg_max(nxt, t) AS e, count(*) AS n, bool_or(nxt IS NULL) AS open FROM b GROUP BY rec, g, event_type)
        SELECT rec, state, round(s, 6) AS start, round(e, 6) AS "end", round(last, 6) AS last, n AS pictures FROM c WHERE NOT open""",
    "w4_break_chain": BREAKS["d3_break_blocks"],
    "w9_new_recordings": "SELECT '/' || source || '/' || doc_id AS path, n_chars AS length, doc_id * 10 AS modified FROM documents WHERE doc_id % 4 = 0",
    "w5_debounce": f"""WITH RECURSIVE {EV}, m AS (SELECT rec, t FROM ev WHERE event_type = 'error'), k AS (SELECT rec, min(t) AS t FROM m GROUP BY rec UNION ALL SELECT m.rec, min(m.t) FROM k JOIN m ON m.rec = k.rec AND m.t >= k.t + 100000 GROUP BY m.rec, k.t)
        SELECT rec, round(t, 6) AS t FROM k""",
    "w6_monotone": f"""WITH {EV} SELECT rec, event_id AS seq, round(t, 6) AS t FROM (SELECT *, max(t) OVER (PARTITION BY rec ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev) WHERE reach IS NULL OR t > reach""",
    "w7_take_new": "SELECT user_id AS rec, event_id FROM events",
    "w8_append_new": "SELECT event_id AS path, user_id AS rec FROM events",
    "w10_programmes": f"""WITH {EV} SELECT c.rec, c.event_id, coalesce(v.event_id, -1) AS programme FROM ev c LEFT JOIN ev v ON v.rec = c.rec AND v.event_type = 'view' AND c.t >= v.t AND c.t < v.t + 40000 WHERE c.event_type = 'click'""",
}
