"""Lines that many documents share, found with two Bloom filters and confirmed by whole digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .common import located, materialise, small_batches, stored, trimmed

MIN_DOCS = 10
#: 64-bit words of a filter for each line of the corpus: 16 bits a line, of which a line sets three.
LINES_A_WORD = 4
#: A filter grows with the corpus up to this many words (64 MB). Past that more lines are suspected; none is lost.
MOST_WORDS = 1 << 23
#: Words of a filter's part; parts of all tasks meet by their number.
PART_WORDS = 1 << 13
#: A task's counts of suspected lines are handed over when it holds so many.
HELD_KEYS = 100_000

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """The lines of some texts: owner, bounds, and the bounds and hash of each line's key."""

    def __init__(self, texts: list[bytes], min_chars: int = 1) -> None:
        whole = b"\n".join(texts) + b"\n"
        data = np.frombuffer(whole, np.uint8)
        self.raw, self.end = whole, np.flatnonzero(data == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64)
        edge = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(edge, self.start, side="right")
        solid = np.flatnonzero(~_SPACE[data])
        first, past = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        full = first < past
        at = np.concatenate([solid, [0]])
        self.lo = np.where(full, at[first], self.start)
        self.hi = np.where(full, at[past - 1] + 1, self.start)
        lower = _LOWER[data]
        self.lower = lower.tobytes()
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.keyed = full & (chars[self.hi] - chars[self.lo] >= min_chars)
        self.hash = hashing.byte_ranges(lower, self.lo, self.hi)

    def key(self, line: int) -> bytes:
        return self.lower[self.lo[line] : self.hi[line]]

    def digest(self, line: int) -> bytes:
        return hashlib.sha256(self.key(line)).digest()

    def of(self, text: int) -> range:
        lo, hi = np.searchsorted(self.owner, [text, text + 1])
        return range(int(lo), int(hi))


def _lines(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, int, Lines]]:
    """Blocks of a batch's rows with their lines; a null text is one empty line."""
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    for lo, hi in hashing.blocks(texts):
        yield lo, hi, Lines(texts[lo:hi], min_chars)


def _bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter that a hash belongs to, and its three bits there."""
    one, six = np.uint64(1), np.uint64(63)
    mask = one << (hashes & six) | one << (hashes >> np.uint64(6) & six) | one << (hashes >> np.uint64(12) & six)
    return (hashes >> np.uint64(20) & np.uint64(words - 1)).astype(np.int64), mask


def filter_words(lines: int, most: int = MOST_WORDS) -> int:
    words = PART_WORDS
    while words < most and words * LINES_A_WORD < lines:
        words *= 2
    return words


def _seen(source: DataFrame, words: int, min_chars: int) -> DataFrame:
    """``part, once, twice``: the parts of both filters that a task's documents set."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            for _, _, lines in _lines(batch, min_chars):
                pair = np.unique(np.stack([lines.hash[lines.keyed], lines.owner[lines.keyed].astype(np.uint64)]), axis=1)
                value, n = np.unique(pair[0], return_counts=True)
                word, mask = _bits(value, words)
                again = (n > 1) | ((once[word] & mask) == mask)
                np.bitwise_or.at(twice, word[again], mask[again])
                np.bitwise_or.at(once, word, mask)
        for part in range(words // PART_WORDS):
            own = slice(part * PART_WORDS, (part + 1) * PART_WORDS)
            if once[own].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "once": [once[own].tobytes()], "twice": [twice[own].tobytes()]})

    return source.select("text").mapInArrow(run, "part int, once binary, twice binary")


def _merged(seen: DataFrame) -> DataFrame:
    """``part, twice`` over all tasks: what is set twice in one, or once in two. A task holds its own parts alone, not the rows that meet there."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = np.frombuffer(row["once"], np.uint64), np.frombuffer(row["twice"], np.uint64)
                if row["part"] in held:
                    a, b = held[row["part"]]
                    b |= twice | (a & once)
                    a |= once
                else:
                    held[row["part"]] = (once.copy(), twice.copy())
        for part, (_, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "twice": [twice.tobytes()]})

    return seen.repartition("part").mapInArrow(run, "part int, twice binary")


def repeat_filter(source: DataFrame, words: int, min_chars: int = 1) -> np.ndarray:
    """The filter of all hashes that two documents or more may share; of bounded size, so that the driver may hold it."""
    twice = np.zeros(words, np.uint64)
    for row in materialise(_merged(_seen(source, words, min_chars)), "repeat-filter").toLocalIterator():
        twice[row["part"] * PART_WORDS : (row["part"] + 1) * PART_WORDS] = np.frombuffer(row["twice"], np.uint64)
    return twice


def _suspects(lines: Lines, twice: np.ndarray) -> np.ndarray:
    """Numbers of the lines whose hash may be set twice."""
    word, mask = _bits(lines.hash, len(twice))
    return np.flatnonzero(lines.keyed & ((twice[word] & mask) == mask))


def suspected(source: DataFrame, twice: Broadcast, min_chars: int = 1) -> DataFrame:
    """``digest, hash, n, first``: suspected lines of a task with the number of its documents that hold them, and the first.

    A document counts once for a line. The first is that of the least id (null last), then of the least locator.
    """
    kind = source.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def rows(id_type: pa.DataType) -> pa.RecordBatch:
            first = [v[2] for v in held.values()]
            columns = [
                pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64()),
                pa.array([f[1] if not f[0] else None for f in first], id_type), pa.array([f[2] for f in first], pa.int64()), pa.array([f[3] for f in first], pa.int64()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["digest", "hash", "n", "first_id", "first_file", "first_row"])

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, files, places = (batch.column(c).to_pylist() for c in ("doc_id", "loc_file", "loc_row"))
            for lo, _, lines in _lines(batch, min_chars):
                found = _suspects(lines, twice.value)
                owner = lines.owner[found]
                for own in np.split(found, np.flatnonzero(np.diff(owner)) + 1) if len(found) else []:
                    i = lo + int(lines.owner[own[0]])
                    here = (ids[i] is None, ids[i] if ids[i] is not None else 0, files[i], places[i])
                    for digest, value in {lines.digest(j): int(lines.hash[j]) for j in own}.items():
                        if digest in held:
                            held[digest][1] += 1
                            held[digest][2] = min(held[digest][2], here)
                        else:
                            held[digest] = [value - (value >> 63 << 64), 1, here]
                if len(held) >= HELD_KEYS:
                    yield rows(id_type)
        if held:
            yield rows(id_type)

    return source.mapInArrow(run, f"digest binary, hash long, n long, first_id {kind}, first_file long, first_row long")


def shared_lines(source: DataFrame, twice: Broadcast, min_docs: int, min_chars: int = 1) -> DataFrame:
    """``digest, hash, n, first_id, first_file, first_row`` of all lines that at least `min_docs` documents hold.

    Only suspected lines are shuffled, a digest and a count for each of a task's.
    """
    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_file", "first_row")
    all_ = suspected(source, twice, min_chars).groupBy("digest").agg(F.min("hash").alias("hash"), F.sum("n").alias("n"), F.min(first).alias("first"))
    return all_.filter(F.col("n") >= min_docs).select("digest", "hash", "n", "first.first_id", "first.first_file", "first.first_row")


def _without(lines: Lines, text: int, drop: dict[bytes, bool], maybe: np.ndarray) -> tuple[int, int, bytes]:
    """Lines, dropped lines and what is left of a text; drop: digests, and whether their first line here stays."""
    own = lines.of(text)
    lost, stays = set(), set()
    for j in maybe.tolist():
        digest = lines.digest(j)
        if digest in drop:
            if drop[digest] and digest not in stays:
                stays.add(digest)
            else:
                lost.add(j)
    raw, start, end = lines.raw, lines.start, lines.end
    if not lost:
        return len(own), 0, raw[start[own[0]] : end[own[-1]]]
    return len(own), len(lost), b"\n".join(raw[start[j] : end[j]] for j in own if j not in lost)


_OUT = "n_lines long, n_dropped long, text binary, loc_file long, loc_row long"


def _out(batch: pa.RecordBatch, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("loc_file"), batch.column("loc_row")], ["doc_id", "n_lines", "n_dropped", "text", "loc_file", "loc_row"])


def _drop_known(source: DataFrame, shared: DataFrame, keep_first: bool, min_chars: int) -> DataFrame:
    """Texts without the shared lines, of which there are so few that every worker holds them."""
    known = {bytes(r["digest"]): (r["hash"], r["first_file"], r["first_row"]) for r in shared.toLocalIterator()}
    hashes = np.unique(np.array([v[0] for v in known.values()], np.int64).view(np.uint64))
    told = source.sparkSession.sparkContext.broadcast((hashes, {d: v[1:] for d, v in known.items()}))
    kind = source.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = told.value
        for batch in batches:
            out = []
            places = list(zip(batch.column("loc_file").to_pylist(), batch.column("loc_row").to_pylist(), strict=True))
            for lo, hi, lines in _lines(batch, min_chars):
                maybe = np.flatnonzero(lines.keyed & np.isin(lines.hash, hashes))
                bounds = np.searchsorted(lines.owner[maybe], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = maybe[bounds[i] : bounds[i + 1]]
                    drop = {d: keep_first and first[d] == places[lo + i] for d in map(lines.digest, own.tolist()) if d in first}
                    out.append(_without(lines, i, drop, own))
            yield _out(batch, out)

    return source.mapInArrow(run, f"doc_id {kind}, {_OUT}")


def _drop_joined(source: DataFrame, shared: DataFrame, twice: Broadcast, keep_first: bool, min_chars: int) -> DataFrame:
    """Texts without the shared lines, however many there are, by joins.

    A document's suspected lines meet the shared ones by their digest. Lines that hold over 1/2000 of all
    counts, of which there are 2000 at most, are broadcast; so no digest that is shuffled is frequent.
    """

    @trimmed
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, places = (batch.column(c).to_pylist() for c in ("loc_file", "loc_row"))
            for lo, _, lines in _lines(batch, min_chars):
                found = {(lo + int(lines.owner[j]), lines.digest(j)) for j in _suspects(lines, twice.value).tolist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([files[i] for i, _ in found], pa.int64()), pa.array([places[i] for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())],
                    ["loc_file", "loc_row", "digest"],
                )

    held = source.mapInArrow(marks, "loc_file long, loc_row long, digest binary")
    told = shared.select("digest", "first_file", "first_row", "n")
    often = (shared.agg(F.sum("n")).first()[0] or 0) / 2000
    hot = F.broadcast(told.filter(F.col("n") > often).drop("n"))
    rest = told.filter(F.col("n") <= often).drop("n")
    met = held.join(hot, "digest").unionByName(held.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest"))
    first = (F.col("loc_file") == F.col("first_file")) & (F.col("loc_row") == F.col("first_row"))
    drop = met.groupBy("loc_file", "loc_row").agg(F.collect_list(F.struct("digest", first.alias("first"))).alias("drop"))
    kind = source.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, drops = [], batch.column("drop").to_pylist()
            for lo, hi, lines in _lines(batch, min_chars):
                for i in range(hi - lo):
                    own = {d["digest"]: keep_first and d["first"] for d in drops[lo + i] or []}
                    maybe = np.array([j for j in lines.of(i) if lines.keyed[j]] if own else [], np.int64)
                    out.append(_without(lines, i, own, maybe))
            yield _out(batch, out)

    return source.join(drop, ["loc_file", "loc_row"], "left").mapInArrow(run, f"doc_id {kind}, {_OUT}")


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = 1,
    keep_first: bool = False,
    most_words: int = MOST_WORDS,
    broadcast_rows: int | None = None,
) -> DataFrame:
    r"""Every document without the lines that at least `min_docs` documents hold: ``doc_id, n_lines, n_dropped, text, loc_file, loc_row``.

    A text is split at \n. Lines are the same if equal after stripping ``[\x20\x09-\x0D]`` at both ends and lower-casing
    A-Z; keys of fewer than `min_chars` code points are never dropped. `keep_first` leaves a line where it occurs first:
    in the document of the least id (null last), then of the least locator, its first line there.

    1. Each task sets hashes of its documents' lines in a filter of those met once and one of those met twice; the tasks'
       filters are merged part by part. No line is shuffled, and one that two documents hold is never missed.
    2. Lines that the second filter holds are suspected. A task counts its documents for each by the whole key's digest, and
       only these counts are shuffled and summed.
    3. Where the shared lines are at most `broadcast_rows` (counted), every worker drops them in one scan; else they are
       joined with each document's suspected lines.

    Null texts count as empty, which is one line; repeated rows and rows without an id are documents of their own; an
    empty table gives no rows. Other columns are not read, whatever they are called.
    """
    if min_docs < 2:
        raise ValueError("the filters tell lines of two documents and more")
    docs = stored(small_batches(docs))
    source = located(docs, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    context = docs.sparkSession.sparkContext
    twice = context.broadcast(repeat_filter(source, filter_words(count, most_words), min_chars))
    shared = materialise(shared_lines(source, twice, min_docs, min_chars), "shared-lines")
    if shared.count() <= (common.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        out = _drop_known(source, shared, keep_first, min_chars)
    else:
        out = _drop_joined(source, shared, twice, keep_first, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("text").cast("string").alias("text"), "loc_file", "loc_row")
