"""Proportional stratified interleaving into shards of equal row counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window group holds on average; the number of groups follows the counted rows.
GROUP_ROWS = 512
#: Groups whose counts are summed in one window; sums of blocks go before them.
BLOCK_GROUPS = 1024


def _starts(counts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """``keys, group, start``: the rows (n) of all earlier groups of a key, by blocks of groups, so that no window holds them all."""
    blocks = counts.withColumn("block", F.expr(f"{group} div {BLOCK_GROUPS}"))
    sums = blocks.groupBy(*keys, "block").agg(F.sum("n").alias("bn"))
    over = Window.partitionBy(*keys).orderBy("block") if keys else Window.orderBy("block")
    sums = sums.select(*keys, "block", (F.sum("bn").over(over) - F.col("bn")).alias("b0"))
    within = F.sum("n").over(Window.partitionBy(*keys, "block").orderBy(group)) - F.col("n")
    return blocks.withColumn("w0", within).join(sums, [*keys, "block"]).select(*keys, group, (F.col("b0") + F.col("w0")).alias("start"))


def stratified_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: str = "interleave",
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """Deal all rows to `shards` shards whose counts differ by one at most and whose mixture is the corpus's.

    Rows of a stratum are ranked in a seeded shuffle (md5 of seed, id, checksum and size). Row k (from 0) of a
    stratum with n rows stands at the fraction (2k+1)/2n; all rows, sorted by that fraction, are
    cut into runs of equal length. Any run holds each stratum in proportion, within one row or so.

    Neither a stratum nor the whole is sorted in one task: md5 values are uniform, so their leading
    digits cut each stratum into groups of GROUP_ROWS rows or fewer on average, and the fractions are
    uniform too. A rank is the count of all earlier groups plus the place in its own group. Only id, size and
    checksum are shuffled, never the text.

    Null ids, texts and strata count as empty text (a null stratum is a stratum of its own). Ties of the
    hash go by id, checksum and size; rows that repeat in all of them share a hash and get places of
    their own, one behind the other. An empty table gives no rows; other columns are not read. Columns: the id, ``size``
    (UTF-8 bytes + 16), ``text_crc32``, ``stratum_rank``, ``shard``, ``slot`` (from 0 in each shard).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text).alias("text_crc32"),
    )
    total = docs.select(F.count(F.lit(1))).first()[0]
    groups = max(1, math.ceil(total / GROUP_ROWS))
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "bytes"))
    rows = (
        rows.withColumn("h", shuffle)
        .withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "stratum"), F.lit("")))
        .withColumn("g", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * groups / 2**32).cast("long"))
    )
    counts = rows.groupBy("stratum", "g").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("stratum_rows"))
    starts = _starts(counts, ["stratum"], "g").join(sizes, "stratum")
    own = Window.partitionBy("stratum", "g").orderBy("h", "doc_id", "text_crc32", "bytes")
    ranked = (
        rows.withColumn("place", F.row_number().over(own) - 1)
        .join(starts, ["stratum", "g"])
        .withColumn("stratum_rank", F.col("start") + F.col("place"))
        .withColumn("fraction", (2 * F.col("stratum_rank") + 1).cast("double") / (2 * F.col("stratum_rows")).cast("double"))
        .withColumn("f", F.floor(F.col("fraction") * groups))
        .select("doc_id", "stratum", "bytes", "text_crc32", "stratum_rank", "fraction", "f", "h")
    )
    # the rows of a fraction group follow from the strata's counts alone: a stratum has about n / groups there
    cells = ranked.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    firsts = _starts(cells, [], "f").withColumnRenamed("start", "first")
    order = Window.partitionBy("f").orderBy("fraction", "stratum", "h", "doc_id", "text_crc32", "bytes")
    placed = ranked.withColumn("p", F.row_number().over(order) - 1).join(firsts, "f")
    position = F.col("first") + F.col("p")
    return (
        placed.withColumn("position", position)
        .withColumn("shard", F.expr(f"position * {shards} div {max(total, 1)}").cast("int"))
        .withColumn("slot", F.col("position") - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}"))
        .select(
            "doc_id",
            (F.col("bytes") + 16).alias("size"),
            "text_crc32",
            "stratum_rank",
            "shard",
            F.col("slot").cast("long").alias("slot"),
        )
    )
