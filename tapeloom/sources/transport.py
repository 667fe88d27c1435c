"""Transport streams read by byte ranges: every range finds its packets, and only asked-for columns and PIDs are decoded."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SYNC, PACKET, TIMED = 0x47, 188, 192
#: Packets on end that settle a spacing, the most that are counted to tell two apart, and strides that are searched.
RUN, HELD, SEARCHED = 5, 64, 8
#: Bytes at a file's start that its framing can depend on.
HEAD = TIMED * (SEARCHED + HELD + 1)
#: Bytes of a range, and of what is decoded at once.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Where there are more short ranges than FEW, a task takes some on end, up to so many bytes; a range counts as OPEN_BYTES at least.
FEW, TASK_BYTES, OPEN_BYTES = 200, 16 << 20, 64 << 10

TYPES = {"seq": pa.int64(), "pos": pa.int64(), "pid": pa.int64(), "unit_start": pa.bool_(), "pcr": pa.int64(), "pts": pa.int64(), "payload": pa.binary()}
SCHEMA = "seq long, pos long, pid long, unit_start boolean, pcr long, pts long, payload binary"


def _held(data: np.ndarray, at: int, stride: int, most: int) -> int:
    """Sync bytes on end, `stride` apart, from a place on."""
    seen = data[at : at + most * stride : stride] == SYNC
    return int(len(seen) if seen.all() else np.argmin(seen))


def find_run(data: np.ndarray, stride: int) -> int | None:
    """The first place under eight strides from which five sync bytes stand a stride apart."""
    for at in np.flatnonzero(data[: SEARCHED * stride] == SYNC).tolist():
        if _held(data, at, stride, RUN) == RUN:
            return at
    return None


def framing(head: np.ndarray, total: int, stride: int | None = None) -> tuple[int, int] | None:
    """Where the first sync byte of a recording is, and the packets' spacing: 188, or 192 with four bytes of arrival time ahead.

    A run of five settles it; bytes ahead are skipped. Bytes of the arrival time may read as sync, so of the runs 0, 3 and
    4 bytes on the longest is the packets', of equals the last. A recording of one to four packets must begin with one and
    have the byte in all. A given stride counts from the start where nothing fits.
    """
    sizes = [stride] if stride else [PACKET, TIMED]
    for size in sizes:
        at = find_run(head, size)
        if at is not None:
            if size == TIMED:
                at += max(d for _, d in sorted((_held(head, at + d, size, HELD), d) for d in (0, 3, 4) if _held(head, at + d, size, RUN) == RUN)[-1:])
            return at, size
    for size in sizes:
        n = total // size
        if 1 <= n < RUN and _held(head, size - PACKET, size, n) == n:
            return size - PACKET, size
    return (stride - PACKET, stride) if stride else None


def decode(data: np.ndarray, first: int, stride: int, n: int, columns: Sequence[str], pids: Sequence[int] | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """The numbers (from 0) of the packets that are kept, and their columns; pcr in 27 MHz, pts in 90 kHz ticks.

    n packets' sync bytes stand from `first` on, a stride apart. Packets without the sync byte, and of other PIDs, are dropped
    before anything else of them is read.
    """
    packets = np.lib.stride_tricks.as_strided(data[first:], (n, PACKET), (stride, 1), writeable=False)
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    keep = packets[:, 0] == SYNC
    if pids is not None:
        keep &= np.isin(pid, np.asarray(pids, np.int64))
    number = np.flatnonzero(keep)
    packets, pid = packets[number], pid[number]
    byte = lambda i: packets[:, i].astype(np.int64)
    control, adapted = byte(3), byte(4)
    fielded, loaded = control & 0x20 > 0, control & 0x10 > 0
    skip = 4 + np.where(fielded, 1 + adapted, 0)
    loaded &= skip < PACKET
    begins = byte(1) & 0x40 > 0
    found: dict[str, pa.Array] = {}
    for name in columns:
        if name == "pid":
            found[name] = pa.array(pid)
        elif name == "unit_start":
            found[name] = pa.array(begins)
        elif name == "pcr":
            ticks = byte(6) << 25 | byte(7) << 17 | byte(8) << 9 | byte(9) << 1 | byte(10) >> 7
            has = fielded & (adapted >= 7) & (byte(5) & 0x10 > 0)
            found[name] = pa.array(ticks * 300 + ((byte(10) & 1) << 8 | byte(11)), mask=~has)
        elif name == "pts":
            timed = loaded & begins & (skip <= PACKET - 14)
            rows = np.flatnonzero(timed)
            q = packets[rows[:, None], skip[rows, None] + np.arange(14)].astype(np.int64)
            video = (q[:, 0] == 0) & (q[:, 1] == 0) & (q[:, 2] == 1) & ((q[:, 3] >= 0xE0) & (q[:, 3] <= 0xEF) | (q[:, 3] == 0xFD)) & (q[:, 7] & 0x80 > 0)
            ticks, has = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
            ticks[rows] = (q[:, 9] & 0x0E) << 29 | q[:, 10] << 22 | (q[:, 11] & 0xFE) << 14 | q[:, 12] << 7 | q[:, 13] >> 1
            has[rows] = video
            found[name] = pa.array(ticks, mask=~has)
        elif name == "payload":
            inside = (np.arange(PACKET) >= skip[:, None]) & loaded[:, None]
            ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
            mask = np.packbits(loaded, bitorder="little").tobytes()
            found[name] = pa.Array.from_buffers(pa.binary(), len(number), [pa.py_buffer(mask), pa.py_buffer(ends.tobytes()), pa.py_buffer(packets[inside].tobytes())])
    return number, [found.get(name) for name in columns]


def batch(rec: str, data: np.ndarray, first: int, at: int, base: int, stride: int, n: int, columns: Sequence[str], pids: Sequence[int] | None, kind: pa.DataType | None = None) -> pa.RecordBatch:
    """Rows of n packets from data[first]; `at` is that place in the file. pos is where a packet's stride begins."""
    number, found = decode(data, first, stride, n, columns, pids)
    own = {"rec": lambda: pa.array([rec] * len(number), kind or pa.string()), "seq": lambda: pa.array((at + number * stride - base) // stride), "pos": lambda: pa.array(at + number * stride - (stride - PACKET))}
    return pa.RecordBatch.from_arrays([own[c]() if c in own else a for c, a in zip(columns, found, strict=True)], list(columns))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or of any scheme that Arrow knows, and the path there."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


def _files(path: str) -> list[tuple[str, int]]:
    """All files at a path, below it or matching its local pattern, with their sizes; hidden ones are left out."""
    store, at = _store(path)
    local = isinstance(store, fs.LocalFileSystem)
    found = []
    for one in sorted(glob.glob(at)) if local and glob.has_magic(at) else [at]:
        info = store.get_file_info(one)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found += store.get_file_info(fs.FileSelector(one, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = "file:" if local else path.split("://")[0] + "://"
    return [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


class Range(InputPartition):
    """Bytes of a file."""

    def __init__(self, path: str, total: int, lo: int, hi: int) -> None:
        self.path, self.total, self.lo, self.hi = path, total, lo, hi


class Ranges(InputPartition):
    """Ranges on end that a task reads one after another."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


class TransportReader(DataSourceReader):
    """Reads packets whose sync byte lies in a range."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns
        self.stride = int(options["stride"]) if options.get("stride") else None
        self.range_bytes = int(options.get("range_bytes") or RANGE_BYTES)
        self.pids = [int(x) for x in options["pids"].split(",")] if options.get("pids") else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes over tests of pid against values; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("pid",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pids = sorted(values if self.pids is None else values & set(self.pids))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        ranges = [Range(path, size, lo, min(lo + self.range_bytes, size)) for path, size in _files(self.path) for lo in range(0, size, self.range_bytes)]
        costs = [max(one.hi - one.lo, OPEN_BYTES) for one in ranges]
        most, tasks, room = min(sum(costs) // FEW, TASK_BYTES) if len(ranges) > FEW else 0, [], 0
        for one, cost in zip(ranges, costs, strict=True):
            if not tasks or cost > room:
                tasks.append(Ranges([]))
                room = most
            tasks[-1].ranges.append(one)
            room -= cost
        return tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._range(one)

    def _range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = _store(partition.path)
        with store.open_input_file(path) as file:
            at = lambda lo, n: np.frombuffer(file.read_at(max(0, min(n, partition.total - lo)), lo), np.uint8)
            framed = framing(at(0, HEAD), partition.total, self.stride)
            if framed is None:
                return
            base, stride = framed
            phase = self._phase(at(partition.lo, HEAD), partition.lo, base, stride)
            first = max(partition.lo + (phase - partition.lo) % stride, base if phase == base % stride else 0)
            many = max(BLOCK_BYTES // stride, 1)
            count = max(0, (min(partition.hi - 1, partition.total - PACKET) - first) // stride + 1)
            for k in range(0, count, many):
                n, begin = min(many, count - k), first + k * stride
                yield batch(partition.path, at(begin, n * stride), 0, begin, base, stride, n, self.columns, self.pids)

    @staticmethod
    def _phase(data: np.ndarray, lo: int, base: int, stride: int) -> int:
        """The recording's own phase where its packets stand on it here too; else, past lost bytes, that of the next run."""
        own = (base - lo) % stride if lo > base else base - lo
        places = len(data[own : own + RUN * stride : stride])
        if lo <= base or _held(data, own, stride, RUN) == places:
            return base % stride
        found = find_run(data, stride)
        return base % stride if found is None else (lo + found) % stride


class TransportSource(DataSource):
    """``spark.read.format("transport").load(path)``; a schema given to the reader says which columns are decoded."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def schema(self) -> str:
        return f"rec string, {SCHEMA}"

    def reader(self, schema: StructType) -> TransportReader:
        return TransportReader(dict(self.options), schema.fieldNames())


def read_packets(spark: SparkSession, path: str, stride: int | None = None, columns: Sequence[str] | None = None, pids: Sequence[int] | None = None, range_bytes: int = RANGE_BYTES):
    """A row for each transport packet of all files at a path, each read in ranges of bytes by as many tasks; of over FEW short ranges several share one.

    A file of any size may be read; no row holds one, and a task holds a block of packets. Every range takes the framing from
    the file's head (see framing) and its own first packet from its place; where bytes were lost, so that packets there no longer stand on
    the recording's phase, a range goes on from the next five sync bytes. `columns` and `pids` name what is decoded at all; filters
    on pid are pushed down too, for which a setting of the session is turned on. Files without packets, and empty ones, give no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # tests of pid reach the source
    spark.dataSource.register(TransportSource)
    kinds = dict(c.split(" ") for c in f"rec string, {SCHEMA}".split(", "))
    reader = spark.read.format("transport").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).option("range_bytes", range_bytes)
    if stride:
        reader = reader.option("stride", stride)
    if pids is not None:
        reader = reader.option("pids", ",".join(map(str, pids)))
    return reader.load(path)
