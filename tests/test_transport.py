"""Packets read by ranges of bytes against whole files, and against a plain loop over bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.sources import archive, transport


def packet(rng, pid, n):
    """A packet: a clock in every third, a video time in every fourth, payload of any bytes."""
    head = [0x47, (0x40 if n % 4 == 0 else 0) | pid >> 8, pid & 255]
    field = []
    if n % 3 == 0:
        base, ext = rng.randrange(2**33), rng.randrange(300)
        field = [0x10, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E | ext >> 8, ext & 255] + [0xFF] * rng.choice([0, 3, 150])
        field = [len(field), *field]
    elif n % 7 == 0:
        field = [183] + [0] * 183
    head.append((0x20 if field else 0) | (0x10 if len(field) < 184 else 0))
    rest = [rng.choice([0x47, 0, 1, rng.randrange(256)]) for _ in range(184 - len(field))]
    if n % 4 == 0 and len(rest) > 14:
        pts = rng.randrange(2**33)
        rest[:14] = [0, 0, 1, rng.choice([0xE0, 0xEF, 0xFD, 0xC0]), 0, 0, 0x80, rng.choice([0x80, 0]), 5, 0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE]
    return bytes(head + field + rest)


def plain(data, base, stride):
    """Rows by a loop: seq, pos, pid, unit_start, pcr, pts, payload."""
    out = []
    for seq, at in enumerate(range(base, len(data) - 187, stride)):
        p = data[at : at + 188]
        if p[0] != 0x47:
            continue
        skip = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        payload = p[skip:] if p[3] & 0x10 and skip < 188 else None
        pcr = pts = None
        if p[3] & 0x20 and p[4] >= 7 and p[5] & 0x10:
            pcr = (p[6] << 25 | p[7] << 17 | p[8] << 9 | p[9] << 1 | p[10] >> 7) * 300 + ((p[10] & 1) << 8 | p[11])
        q = payload
        if p[1] & 0x40 and q and len(q) >= 14 and q[:3] == b"\0\0\1" and (0xE0 <= q[3] <= 0xEF or q[3] == 0xFD) and q[7] & 0x80:
            pts = (q[9] & 0x0E) << 29 | q[10] << 22 | (q[11] & 0xFE) << 14 | q[12] << 7 | q[13] >> 1
        out.append((seq, at - (stride - 188), (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40 > 0, pcr, pts, payload))
    return out


def rows(df):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select("seq", "pos", "pid", "unit_start", "pcr", "pts", "payload").orderBy("pos").collect()]


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("ts")
    packets = [packet(rng, rng.choice([17, 256, 0x147, 8191]), n) for n in range(997)]
    files = {
        "plain": (b"".join(packets), 0, 188),
        "mid": (bytes(rng.choice([0x47, 9]) for _ in range(101)) + b"".join(packets), 101, 188),
        "timed": (bytes(33) + b"".join(bytes([rng.choice([0, 0x47]), 0x47, n & 255, 3]) + p for n, p in enumerate(packets)) + b"\x47" * 50, 37, 192),
        "few": (b"".join(packets[:3]), 0, 188),
    }
    for name, (data, _, _) in files.items():
        (folder / f"{name}.ts").write_bytes(data)
    (folder / "noise.ts").write_bytes(b"nothing here" * 1000)
    (folder / "empty.ts").write_bytes(b"")
    (folder / "_hidden.ts").write_bytes(packets[0] * 9)
    return folder, files


@pytest.mark.parametrize("range_bytes", [1 << 26, 47_100, 12_345])
def test_ranges_give_the_rows_of_the_whole_file(spark, recordings, range_bytes):
    folder, files = recordings
    found = transport.read_packets(spark, str(folder), range_bytes=range_bytes)
    assert found.rdd.getNumPartitions() >= sum(len(f[0]) for f in files.values()) // range_bytes
    got = {}
    for r in found.orderBy("pos").collect():
        got.setdefault(r["rec"].rpartition("/")[2], []).append(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]))
    assert got == {f"{name}.ts": plain(*f) for name, f in files.items()}


def test_bytes_in_a_frame_give_the_same_rows(spark, recordings):
    _, files = recordings
    frame = spark.createDataFrame([(k, bytearray(v[0])) for k, v in files.items()] + [("null", None), (None, bytearray(files["few"][0]))], "rec string, content binary")
    found = archive.packets_from_bytes(frame)
    for name, (data, base, stride) in files.items():
        assert rows(found.filter(F.col("rec") == name)) == plain(data, base, stride)
    assert found.filter("rec IS NULL").count() == 3


def test_only_asked_columns_and_pids_are_decoded(spark, recordings, monkeypatch):
    folder, files = recordings
    data, base, stride = files["mid"]
    path = f"{folder}/mid*"
    found = transport.read_packets(spark, path, columns=["pid", "pts"], pids=[17, 256], range_bytes=20_000)
    assert found.columns == ["pid", "pts"]
    assert sorted(map(tuple, found.fillna(-1).collect())) == sorted((r[2], -1 if r[5] is None else r[5]) for r in plain(data, base, stride) if r[2] in (17, 256))
    pushed = transport.read_packets(spark, path).filter("pid = 256").select("seq")
    assert sorted(r[0] for r in pushed.collect()) == [r[0] for r in plain(data, base, stride) if r[2] == 256]
    reader = transport.TransportReader({"path": path}, ["pid"])
    assert list(reader.pushFilters([transport.EqualTo(("pid",), 5), transport.In(("pid",), (5, 6)), transport.EqualTo(("seq",), 5)])) == [transport.EqualTo(("seq",), 5)] and reader.pids == [5]


def test_ranges_past_lost_bytes_find_a_phase_of_their_own(spark, recordings, tmp_path):
    data = recordings[1]["plain"][0]
    cut = data[: 188 * 300] + data[188 * 300 + 61 :]
    (tmp_path / "lost.ts").write_bytes(cut)
    found = transport.read_packets(spark, f"file:{tmp_path}/lost.ts", range_bytes=188 * 400)
    pos = [r[1] for r in rows(found)]
    assert [p for p in pos if p < 188 * 300] == [188 * n for n in range(300)]
    assert [p for p in pos if p >= 188 * 400] == [188 * n - 61 for n in range(401, 997)]  # the range that holds the loss reads on in its old phase
    with pytest.raises(Exception, match="FileNotFound|not found|No such"):
        transport.read_packets(spark, f"{tmp_path}/none").count()


def test_given_strides_and_recordings_cut_in_an_arrival_time(spark):
    rng = random.Random(1)
    body = b"".join(packet(rng, 17, n) for n in range(9))
    assert transport.framing(np.frombuffer(body, np.uint8), len(body), 192) == (4, 192)
    assert transport.framing(np.frombuffer(b"x" * 50 + body, np.uint8), len(body) + 50) == (50, 188)
    assert transport.framing(np.zeros(0, np.uint8), 0) is None
