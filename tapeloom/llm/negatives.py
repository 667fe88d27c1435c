"""Hard negatives: exact inner products by Strassen tiles, positives and windows kept in mergeable heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, materialise, small_batches, stored, trimmed

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's score lies.
LOW, HIGH = 30, 90
#: Anchors of a block, which the driver and each worker hold while all rows are scanned.
BLOCK = 8192
#: Anchors of a tile; candidates come in Arrow batches.
TILE = 256
#: Rows of a task.
TASK_ROWS = 25_000
#: Sides from which on a product is multiplied plainly.
LEAF = 64

_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven half-size products a level, sides padded with zeros to even.

    All sums are exact modulo 2**64, so the product is exact wherever its values fit in 64 bits.
    """
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The best `k` rows of each slot by score, then id (null last), then locator; two heaps merge by offering one's rows to the other."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.floor = k, np.full(slots, _LEAST)
        self.rows = [np.zeros(0, np.int64) for _ in range(6)]  # slot, score, no_id, id, file, row

    def offer(self, score: np.ndarray, fit: np.ndarray, who: list[np.ndarray]) -> None:
        """Take in scores (slots, rows) where they fit; what lies under a slot's k-th score can't stay and isn't sorted."""
        fit &= score >= self.floor[:, None]
        if score.shape[1] > self.k:
            fit &= score >= np.partition(np.where(fit, score, _LEAST), -self.k, axis=1)[:, -self.k, None]
        slot, c = np.nonzero(fit)
        if not len(slot):
            return
        rows = [np.concatenate([old, new]) for old, new in zip(self.rows, [slot, score[slot, c], *[w[c] for w in who]], strict=True)]
        order = np.lexsort((rows[5], rows[4], rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        slot = rows[0]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        full = place == self.k - 1
        self.floor[slot[full]] = rows[1][full]
        self.rows = [r[place < self.k] for r in rows]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _candidates(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Vectors as columns, labels, and (no_id, id, file, row)."""
    ids = batch.column("vec_id")
    who = [ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(), batch.column("loc_file").to_numpy(), batch.column("loc_row").to_numpy()]
    return np.ascontiguousarray(_matrix(batch.column("vector"), width).T), batch.column("label").to_numpy(), who


def _rows(heaps: Heaps, first: int) -> pa.RecordBatch:
    slot, score, no_id, ids, files, places = heaps.rows
    columns = [pa.array(slot + first), pa.array(score), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(files), pa.array(places)]
    return pa.RecordBatch.from_arrays(columns, ["slot", "score", "vec_id", "loc_file", "loc_row"])


_FOUND = "slot long, score long, vec_id long, loc_file long, loc_row long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The tasks' heaps of each slot merged: the first k with their rank."""
    order = [F.col("score").desc(), F.col("vec_id").isNull(), "vec_id", "loc_file", "loc_row"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def _positives(points: DataFrame, anchors, width: int, k: int) -> DataFrame:
    """The first k other rows of each anchor's label; a slot is the anchor's number in the block."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, labels, files, places = anchors.value
        firsts = range(0, len(matrix), TILE)
        heaps = [Heaps(len(matrix[f : f + TILE]), k) for f in firsts]
        for batch in batches:
            vectors, label, who = _candidates(batch, width)
            for first, heap in zip(firsts, heaps, strict=True):
                own = slice(first, first + TILE)
                score = strassen(matrix[own], vectors)
                itself = (files[own, None] == who[2]) & (places[own, None] == who[3])
                heap.offer(score, (labels[own, None] == label) & ~itself, who)
        for first, heap in zip(firsts, heaps, strict=True):
            yield _rows(heap, first)

    return _best(points.mapInArrow(run, _FOUND), k)


def _windows(points: DataFrame, anchors, pairs, width: int, k: int, low: int, high: int) -> DataFrame:
    """The first k rows of other labels within each pair's window; a slot is the pair's number in the block."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, labels, _, _ = anchors.value
        of, bound = pairs.value  # sorted by anchor
        firsts = range(0, len(matrix), TILE)
        spans = [tuple(np.searchsorted(of, [f, f + TILE])) for f in firsts]
        heaps = [Heaps(int(hi - lo), k) for lo, hi in spans]
        for batch in batches:
            vectors, label, who = _candidates(batch, width)
            for first, (lo, hi), heap in zip(firsts, spans, heaps, strict=True):
                score = strassen(matrix[first : first + TILE], vectors)[of[lo:hi] - first]
                edge = bound[lo:hi, None]
                heap.offer(score, (100 * score >= low * edge) & (100 * score <= high * edge) & (labels[of[lo:hi], None] != label), who)
        for (lo, _), heap in zip(spans, heaps, strict=True):
            yield _rows(heap, int(lo))

    return _best(points.mapInArrow(run, _FOUND), k)


def scaled(vector: str, width: int, scale: int) -> Column:
    """Components times scale, rounded down to whole numbers; far ones count as a limit at which sums of products still fit in 64 bits."""
    most = float(2 ** ((56 - max(width, 1).bit_length()) // 2))
    return F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale).cast("double"))).cast("long"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
) -> DataFrame:
    """Hard negatives of every row for which `anchor` holds: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of two vectors whose components are whole numbers (see scaled). Higher scores come first,
    of equals the smaller id (null last), then the row's locator. An anchor's positives are its first `positives` other rows
    of its label; for each, the first `negatives` rows of other labels whose score is within `low` to `high` percent of the
    positive's score are returned, so none where that score is negative.

    Anchors are a stated share of the rows and meet all rows: a block of anchors is broadcast, every task multiplies its rows
    with it tile by tile and keeps a heap for each anchor, and the tasks' heaps are merged by a window. A second scan does the same
    for the windows. A block's rows and positives, of bounded number, pass through the driver; candidates are never shuffled.

    Rows with a null label or vector, or a component that is null or not finite, take no part. Shorter vectors count
    as padded with zeros. Repeated rows are rows of their own, and so are anchors that share an id. An empty table gives no rows.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = located(
        stored(vectors).filter(label.isNotNull() & x.isNotNull() & whole), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n_anchors // block))
    points = rows.withColumn("vector", scaled("vector", width, scale)).withColumn("block", F.when(F.col("anchor"), F.pmod(F.xxhash64("loc_file", "loc_row"), F.lit(blocks)))).drop("anchor")
    points = small_batches(materialise(points.repartition(max(1, -(-n // TASK_ROWS))), "points"))
    spark = vectors.sparkSession
    out = None
    for b in range(blocks):
        own = points.filter(F.col("block") == b).toArrow()
        ids = own.column("vec_id").to_pylist()
        label_of, files, places = (own.column(c).to_numpy() for c in ("label", "loc_file", "loc_row"))
        held = spark.sparkContext.broadcast((_matrix(own.column("vector").combine_chunks(), width), label_of, files, places))
        found = materialise(_positives(points, held, width, positives), "positives").orderBy("slot", "rank").toArrow()
        of, bound, who = found.column("slot").to_numpy(), found.column("score").to_numpy(), found.column("vec_id").to_pylist()
        mined = _windows(points, held, spark.sparkContext.broadcast((of, bound)), width, negatives, low, high)
        names = [(i, ids[s], w, int(v)) for i, (s, w, v) in enumerate(zip(of.tolist(), who, bound.tolist(), strict=True))]
        pairs = spark.createDataFrame(names, "slot long, anchor_id long, positive_id long, positive_score long")
        part = mined.join(F.broadcast(pairs), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = materialise(part, "negatives")
        out = part if out is None else out.union(part)
    return out
