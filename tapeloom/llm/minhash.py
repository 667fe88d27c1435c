"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import located, materialise, maybe_broadcast, small_batches, stored, trimmed

#: 32 bands of 8 coordinates: a pair at similarity 0.8 shares a band with probability 0.997, at 0.9 with 1 - 1e-8.
BANDS, ROWS = 32, 8
SIMILARITY = 0.8
WORDS = 5

_FIRST = 2.0**-6
_tables: dict[int, np.ndarray] = {}


def _region(level: int) -> tuple[float, np.ndarray]:
    """Height of a rank region, and the distribution function of its Poisson number of darts per cell.

    Region 0 spans ranks from 0 to _FIRST; each later one is as high as all before it.
    """
    height = _FIRST if level == 0 else _FIRST * 2.0 ** (level - 1)
    if level not in _tables:
        n = np.arange(int(height + 12 * np.sqrt(height) + 24))
        logs = n * np.log(height) - height - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
        _tables[level] = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return height, _tables[level]


def dart_signatures(text: np.ndarray, cell: np.ndarray, texts: int, k: int) -> np.ndarray:
    """DartMinHash: (texts, k) dart ids; equal coordinates of two rows estimate their weighted Jaccard similarity.

    Darts fall on the plane of unit weight cells and ranks as a Poisson process that depends on the
    cell alone. Each dart is hashed to one of k coordinates, which keeps its earliest. Rank regions
    are opened one by one, each twice as high, only for texts with a coordinate still without a
    dart, so that a text costs about k log k darts whatever its length. Texts without cells keep 0.
    """
    out = np.zeros(texts * k, np.uint64)
    filled = np.zeros(texts * k, bool)
    open_ = np.bincount(text, minlength=texts) > 0
    level = 0
    while open_.any():
        live = open_[text]
        text, cell = text[live], cell[live]
        _, below = _region(level)
        u = hashing.mix(cell ^ np.uint64((level + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
        darts = np.searchsorted(below, (u >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(darts)
        number = darts[hit]
        which = np.repeat(hit, number)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        dart = hashing.mix(u[which] + (nth + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        place = text[which] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        new = ~filled[place]
        dart, place = dart[new], place[new]
        rank = hashing.mix(dart ^ np.uint64(0x27D4EB2F165667C5))
        order = np.lexsort((rank, place))
        dart, place = dart[order], place[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        out[place[first]] = dart[first]
        filled[place[first]] = True
        open_ &= ~filled.reshape(texts, k).all(axis=1)
        level += 1
    return out.reshape(texts, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    key = np.tile(hashing.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), 1))
    for r in range(rows):
        key = hashing.mix(key ^ hashing.mix(signatures[:, r::rows][:, :bands]))
    return key.astype(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """``fp, cells, bands`` beside the other columns for each row of docs; only its text goes through Python."""

    @F.arrow_udf("fp binary, cells long, bands array<long>")
    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            fps, sizes, banded = [], [], []
            for lo, hi in hashing.blocks(texts):
                part = texts[lo:hi]
                word, offset = hashing.words(part)
                text, cell = hashing.shingle_cells(word, offset, width)
                keys = band_keys(dart_signatures(text, cell, len(part), bands * rows), bands, rows)
                cells = np.bincount(text, minlength=len(part))
                fps += hashing.fingerprints(part, word, offset)
                sizes += cells.tolist()
                banded += [b if n else [] for b, n in zip(keys, cells, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(banded, pa.list_(pa.int64()))], ["fp", "cells", "bands"])

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, run("text").alias("s")).select(*rest, "s.*")


def cell_sets(texts: DataFrame, width: int) -> DataFrame:
    """``node, cells array<int>`` for rows of (node, text): the cells' hashes cut to 32 bits, distinct."""

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part_of = list(pdf["text"])
            for lo, hi in hashing.blocks(part_of):
                part = part_of[lo:hi]
                text, cell = hashing.shingle_cells(*hashing.words(part), width)
                small = (cell >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ends = np.cumsum(np.bincount(text, minlength=len(part)))
                yield pd.DataFrame({"node": pdf["node"].iloc[lo:hi], "cells": [np.unique(c) for c in np.split(small, ends[:-1])]})

    return texts.mapInPandas(run, "node long, cells array<int>")


def _alike(x: str, y: str, threshold: float):
    """Whether two columns of distinct cells have a Jaccard similarity of at least threshold.

    Sizes bound the overlap, so sets of unlike sizes are told apart without a comparison.
    """
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    need = threshold / (1 + threshold) * (F.size(x) + F.size(y)) - 1e-9  # |A & B| >= t |A or B|, solved for |A & B|
    return F.when(small < threshold * large - 1e-9, False).otherwise(F.size(F.array_intersect(x, y)) >= need)


def similar(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity, from their whole cell sets, is at least threshold."""
    left = cells.select(F.col("node").alias("a"), F.col("cells").alias("ca"))
    right = cells.select(F.col("node").alias("b"), F.col("cells").alias("cb"))
    return pairs.join(right, "b").join(left, "a").filter(_alike("ca", "cb", threshold)).select("a", "b")


def similar_across(mixed: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of one band key and different labels; pairs that are not alike leave the join unseen."""
    rows = mixed.join(cells, "node")
    left = rows.select("key", F.col("label").alias("lx"), F.col("node").alias("a"), F.col("cells").alias("ca"))
    right = rows.select(F.col("key").alias("k2"), F.col("label").alias("ly"), F.col("node").alias("b"), F.col("cells").alias("cb"))
    met = left.join(right, (F.col("key") == F.col("k2")) & (F.col("lx") < F.col("ly")) & _alike("ca", "cb", threshold))
    return met.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component, by rounds of least neighbour and pointer jumps.

    A round joins edges with labels on the node and takes the least label, combined within tasks, so
    a star with any number of leaves is one row a task. Each round is written to the shared folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = step.join(roots, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label"))
        jumped = materialise(jumped, "labels")
        changed = not jumped.filter("label <> was").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = SIMILARITY,
    width: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each document with its class of near-duplicates.

    Texts are near when the weighted Jaccard similarity of their shingles of `width` words is at
    least `threshold`; classes are the connected components of that relation over all pairs that
    share a band. Of a class the least id stays (null last), then the first stored row.

    1. Every whole text gets a DartMinHash signature; texts with the same words share a fingerprint
       and become one node, combined within tasks, so copies never meet pairwise.
    2. Each node is linked to the most-met node that it shares a band with. Linked pairs are
       checked on their whole cell sets, read again for these nodes alone.
    3. Where a band still holds several components, all its pairs across components are checked
       within the join, which lets only links out. So no link between different texts is lost, and
       members of one component are never paired.

    Null texts count as empty. Texts without words are near only if they are equal. Rows that
    repeat share a class and one of them stays. An empty table gives no rows. Other columns are
    not read. Columns: ``doc_id, class_id`` (the id that stays), ``group_size, kept, loc_file, loc_row``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    source = located(small_batches(docs), F.col(id_col).alias("doc_id"), text).select("doc_id", "loc_file", "loc_row", F.xxhash64("text").alias("text_key"), "text")
    signed = materialise(signatures(source, bands, rows, width), "signatures")

    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "loc_file", "loc_row", "text_key")
    nodes = signed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("stay"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = materialise(keys.join(shared, "key"), "members")
    # how often a node meets others: an original meets its copies more often than they meet each other
    hubs = members.groupBy("node").agg(F.sum("members").alias("met"))
    members = materialise(members.select("key", "node").join(hubs, "node").withColumn("hub", F.struct("met", "node")), "members")
    leaders = members.groupBy("key").agg(F.max("hub").alias("lead"))
    involved = materialise(members.select("node").distinct().join(nodes.select("node", "stay"), "node"), "involved")

    wanted = involved.select("node", F.col("stay.loc_file").alias("loc_file"), F.col("stay.loc_row").alias("loc_row"))
    texts = source.join(maybe_broadcast(wanted, involved.count()), ["loc_file", "loc_row"]).select("node", "text")
    cells = materialise(cell_sets(texts, width), "cells")

    def labelled(edges: DataFrame) -> DataFrame:
        found = components(edges)
        own = members.join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
        return materialise(own.join(mixed, "key"), "mixed")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    led = members.join(leaders, "key").groupBy("node").agg(F.max("lead").alias("lead")).filter("node <> lead.node")
    pairs = materialise(ordered(led.select(F.col("node").alias("x"), F.col("lead.node").alias("y"))), "pairs")
    edges = materialise(similar(pairs, cells, threshold), "links")

    edges = edges.union(similar_across(labelled(edges), cells, threshold))

    found = components(edges)
    in_class = nodes.join(found, "node", "left").select("fp", "n", "stay", F.coalesce("label", "node").alias("label"))
    classes = in_class.groupBy("label").agg(F.sum("n").alias("group_size"), F.min("stay").alias("stay"))
    of_fp = materialise(in_class.select("fp", "label").join(classes, "label").select("fp", "group_size", F.col("stay.doc_id").alias("class_id"), F.col("stay.loc_file").alias("kf"), F.col("stay.loc_row").alias("kr")), "classes")
    return signed.select("doc_id", "loc_file", "loc_row", "fp").join(of_fp, "fp").select(
        "doc_id", "class_id", "group_size", ((F.col("loc_file") == F.col("kf")) & (F.col("loc_row") == F.col("kr"))).alias("kept"), "loc_file", "loc_row"
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which near_duplicates keeps one for each class, with all their columns.

    Null texts count as empty; of equal texts without words, and of repeated rows, one stays; ties go by
    near_duplicates' rule. An empty table stays empty, and columns of any name are carried along in a struct.
    """
    docs = stored(docs)
    found = near_duplicates(docs, id_col, text_col, **options)
    dropped = materialise(found.filter("not kept").select("loc_file", "loc_row"), "near-dropped")
    rows = located(docs, F.struct("*").alias("row"))
    return rows.join(maybe_broadcast(dropped, dropped.count()), ["loc_file", "loc_row"], "left_anti").select("row.*")
