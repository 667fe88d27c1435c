"""Exact deduplication by a stateful stream over content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, materialise, maybe_broadcast, shared_path, stored

#: Deletes what the equality of texts ignores: space and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.metricsEnabled": "false",
}


def content_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """A row for each document: id, row locator, code points, SHA-256 of the normalised text, digest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(F.regexp_replace("__text", BLANKS, ""), 256)
    return (
        located(docs, F.col(id_col).alias("doc_id"), text.alias("__text"))
        .select("doc_id", "loc_file", "loc_row", F.char_length("__text").cast("long").alias("chars"), sha.alias("text_sha256"))
        .withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4))
    )


def dedup_stream(keys: DataFrame):
    """The streaming state of keys by digest: copies, the row that stays, and the first locator.

    A streaming aggregation without watermark: its keyed state never expires. Tasks combine rows of
    one digest before the shuffle, so that a digest with a third of all rows is one row a task.
    """
    stay = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "loc_file", "loc_row")
    return keys.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(stay).alias("stay"),
        F.min(F.struct("loc_file", "loc_row")).alias("locator"),
    )


def run_stream(spark: SparkSession, keys_path: str, schema, batches: int) -> DataFrame:
    """Stream the key files through the state in about `batches` micro-batches; the last state of each digest.

    The checkpoint and each batch's changed digests lie in the shared folder; a batch that is run
    again overwrites its own folder, so a lost executor or a restart leaves no double rows.
    """
    files = spark.read.schema(schema).parquet(keys_path).select("loc_file").inputFiles()
    out = shared_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(keys_path)
        query = (
            dedup_stream(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", shared_path(spark, "dedup-checkpoint"))
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = dedup_stream(spark.createDataFrame([], schema)).schema
    changed = spark.read.schema(state).option("basePath", out).parquet(f"{out}/batch=*") if files else spark.createDataFrame([], state)
    return changed.groupBy("digest").agg(F.max_by(F.struct("n", "stay", "locator"), "n").alias("s")).select("digest", "s.*")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_bits: int = 256,
    batches: int = 3,
) -> DataFrame:
    """One row for each document, dropped ones too, with the document of equal text that stays.

    Texts are equal when identical after deleting BLANKS. Of equal texts the one with the most code
    points stays, then the smallest id (a null id last), then the first stored row.

    1. A small key table (digest, id, locator; no text) is written to the shared folder.
    2. It is streamed through RocksDB-backed keyed state that never expires: digest, stable id,
       content locator and count.
    3. Digests that were hit again are checked on full bytes: their texts, found by digest, are
       compared whole (least against greatest of the group, combined within each task). Where a
       digest holds different bytes, its documents are grouped by the bytes themselves.
    4. Keys meet the final state by digest; a hot digest is split by adaptive skew joins, as the
       state has a row for each digest.

    Ids are of any type that sorts. Null texts count as empty, and all empty texts are equal. Rows that repeat, even with one id,
    are copies of each other and one of them stays. An empty table gives no rows. Other columns
    are not read. digest_bits below 256 is for tests of the check on full bytes.
    Columns: ``doc_id, keep_id, group_size, kept, text_sha256, loc_file, loc_row``.
    """
    spark, docs = docs.sparkSession, stored(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = shared_path(spark, "dedup-keys")
    content_keys(docs, id_col, text_col, digest_bits).write.parquet(path)
    schema = spark.read.parquet(path).schema
    keys = spark.read.schema(schema).parquet(path)
    state = run_stream(spark, path, schema, batches)
    state = materialise(state, "dedup-final")

    # 8 bytes of a digest suffice to find its texts; what else they find is a group of one
    hits = state.filter("n > 1").select(F.xxhash64("digest").alias("short")).distinct()
    texts = located(docs, F.col(id_col).alias("doc_id"), text.alias("__text")).withColumn("norm", F.regexp_replace("__text", BLANKS, ""))
    texts = texts.withColumn("digest", F.substring(F.sha2("norm", 256), 1, digest_bits // 4)).withColumn("short", F.xxhash64("digest"))
    hit_texts = texts.join(maybe_broadcast(hits, hits.count()), "short", "left_semi")
    differing = hit_texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest")
    differing = materialise(differing, "dedup-differing")
    n_differing = differing.count()

    stays = state.select("digest", "n", F.col("stay.doc_id").alias("keep_id"), F.col("stay.loc_file").alias("keep_file"), F.col("stay.loc_row").alias("keep_row"))
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("loc_file").eqNullSafe(F.col("keep_file")) & F.col("loc_row").eqNullSafe(F.col("keep_row"))).alias("kept"), "text_sha256", "loc_file", "loc_row"]
    if not n_differing:
        return keys.join(stays, "digest").select(*columns)
    plain = keys.join(maybe_broadcast(differing, n_differing), "digest", "left_anti").join(stays, "digest").select(*columns)
    split = texts.join(maybe_broadcast(differing, n_differing), "digest", "left_semi")
    split = split.withColumn("chars", F.char_length("__text").cast("long")).withColumn("text_sha256", F.sha2("norm", 256))
    per_text = dedup_stream(split.withColumn("digest", F.col("norm"))).withColumnRenamed("digest", "norm")
    per_text = per_text.select("norm", "n", F.col("stay.doc_id").alias("keep_id"), F.col("stay.loc_file").alias("keep_file"), F.col("stay.loc_row").alias("keep_row"))
    return plain.unionByName(split.join(per_text, "norm").select(*columns))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Of rows with null or empty texts one stays, of repeated rows too; ties go by exact_dedup's rule. An
    empty table stays empty, and columns of any name are carried along in a struct.
    """
    docs = stored(docs)
    found = exact_dedup(docs, id_col, text_col)
    dropped = materialise(found.filter("not kept").select("loc_file", "loc_row"), "dedup-dropped")
    rows = located(docs, F.struct("*").alias("row"))
    return rows.join(maybe_broadcast(dropped, dropped.count()), ["loc_file", "loc_row"], "left_anti").select("row.*")
