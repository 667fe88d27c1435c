"""Shared folder, row locators and bounded samples for the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of a few fixed-width columns is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 400_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which the session names in ``spark.checkpoint.dir``.

    Only a session in one process may leave it unset; a temporary folder takes its place there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def located(df: DataFrame, *columns) -> DataFrame:
    """columns of df with ``loc_file`` and ``loc_row``, which name each stored row (repeated rows too).

    A frame that isn't a plain scan of files is first written to the shared folder.
    """
    locator = (F.xxhash64("_metadata.file_path").alias("loc_file"), F.col("_metadata.row_index").alias("loc_row"))
    plain = df.select(*columns)
    try:
        out = df.select(*columns, *locator)
        out.schema  # noqa: B018  resolves the hidden column
        return out
    except AnalysisException:
        return materialise(plain, "located").select("*", *locator)


def stored(df: DataFrame) -> DataFrame:
    """df if it is a plain scan of files, so that its locators are the same in every plan; else a stored copy of it."""
    try:
        df.select(F.col("_metadata.row_index")).schema  # noqa: B018
        return df
    except AnalysisException:
        return materialise(df, "stored")


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its counted rows are within BROADCAST_ROWS; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def hash_sample(df: DataFrame, id_col: str, rows: int, seed: str) -> DataFrame:
    """About `rows` rows of df (all, if it has fewer), chosen by a seeded hash of the id."""
    total = df.count()
    if total <= rows:
        return df
    cut = int(rows / total * 2**31)
    key = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2**31))
    return df.filter(key < cut)


def bounded_rows(rows: DataFrame, group: str, counts: dict, sample: int, seed: str):
    """About `sample` rows of each group (all, if it has fewer) as a pandas frame, from one scan of rows.

    counts are the groups' rows. A row is chosen by a seeded hash of all its columns, so that rows that
    share an id, or have none, are told apart; copies in every column count once.
    """
    key = F.pmod(F.xxhash64(F.lit(seed), *[c for c in rows.columns]), F.lit(2**31))
    cuts = {v: int(min(1.0, sample / n) * 2**31) for v, n in counts.items() if n > sample}
    if cuts:
        table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        rows = rows.filter(key < F.coalesce(F.try_element_at(table, F.col(group)), F.lit(2**31)))
    return rows.distinct().toPandas()


#: Rows of an Arrow batch in the operators that hold whole texts and what they make of them in Python.
ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold ARROW_ROWS rows at most, which bounds a Python worker's memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def give_back() -> None:
    """Return a Python worker's freed memory to the system, so that what a task held isn't kept beside the next stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which gives memory back in its own way
        pass


def trimmed(run: Callable) -> Callable:
    """run, a function of a task's batches, which gives freed memory back when the task's batches are done."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole
