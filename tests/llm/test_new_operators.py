"""Shared lines, spelling variants and hard negatives against brute force on small frames."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import line_dedup, negatives, spelling

SCHEMA = "doc_id long, text string, lang string, loc_file string, n long, hash string, drop int"
WIDE = 2**62


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, wide ids beside a null one, and columns that clash."""
    rng = random.Random(3)
    shared = ["A shared line", "  a SHARED line\t", "ünï \v\f", "x" * 70000]
    rows = [(None, None), (None, "a shared line\n\nlast"), (WIDE + 1, ""), (WIDE + 3, "\n\n"), (5, None)]
    for i in range(40):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own {rng.randrange(30)} {rng.choice('abc')}" for _ in range(rng.randrange(1, 9))]
        rows += [(i // 2, "\n".join(lines))] * (1 + i % 3 // 2)
    rows.append((7, "\n".join(f"line {k}" for k in range(20000)) + "\nA shared line"))
    return spark.createDataFrame([(i, t, "de", "f", 3, "h", 1) for i, t in rows], SCHEMA)


def key(line):
    return line.strip(" \t\n\v\f\r").translate(spelling._LOWER)


def without_shared(texts, min_docs, min_chars=1):
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def plain_lines(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["text"]) for r in rows)


@pytest.mark.parametrize("broadcast_rows", [None, 0])
@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 6), (3, 2)])
def test_shared_lines_equal_brute_force(odd, min_docs, min_chars, broadcast_rows):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((i is None, i or 0), *w) for (i, _), w in zip(docs, without_shared([t for _, t in docs], min_docs, min_chars), strict=True))
    got = line_dedup.drop_shared_lines(odd, min_docs=min_docs, min_chars=min_chars, broadcast_rows=broadcast_rows)
    assert plain_lines(got.collect()) == want


def test_full_filters_lose_no_line(odd, monkeypatch):
    """With a filter of 64 words nearly every line is suspected; digests tell them apart."""
    monkeypatch.setattr(line_dedup, "PART_WORDS", 64)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((i is None, i or 0), *w) for (i, _), w in zip(docs, without_shared([t for _, t in docs], 10), strict=True))
    assert plain_lines(line_dedup.drop_shared_lines(odd, most_words=64).collect()) == want


@pytest.mark.parametrize("broadcast_rows", [None, 0])
def test_first_occurrence_stays(spark, broadcast_rows):
    rows = [(9, "b\nsame\nsame"), (3, "x\nSame \nsame"), (None, "same"), (4, "same\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_shared_lines(docs, min_docs=2, keep_first=True, broadcast_rows=broadcast_rows).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {9: "b", 3: "x\nSame ", None: "", 4: "y"}


def test_lines_of_an_empty_table_and_of_one_document(odd):
    with pytest.raises(ValueError, match="two documents"):
        line_dedup.drop_shared_lines(odd, min_docs=1)
    assert line_dedup.drop_shared_lines(odd.limit(0)).count() == 0


def test_merged_filters_hold_what_two_tasks_hold(spark):
    docs = spark.createDataFrame([(i, f"common\nown {i}") for i in range(400)], "doc_id long, text string").repartition(8)
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    twice = line_dedup.repeat_filter(source, line_dedup.filter_words(800))
    lines = line_dedup.Lines([b"common\nown 1\nown 2"])
    assert 0 in line_dedup._suspects(lines, twice)
    assert sum(len(line_dedup._suspects(line_dedup.Lines([f"own {i}".encode()]), twice)) for i in range(400)) < 40


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, factor):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= factor * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    whole = {}
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        whole[w] = (row[0], root, *row[1:])
    return whole


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgé", "x"])
def test_variants_equal_brute_force(spark, alphabet):
    """Words of few letters share most grams; edits at every place, the middle of odd lengths and both ends among them."""
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 10))) for _ in range(150)}
    for w in sorted(words)[:40]:
        for i in range(len(w) + 1):
            words |= {w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]}
    counts = {w: rng.choice([5, 6, 25, 30, 130, 700]) for w in words}
    got = spelling.group_variants(spark.createDataFrame(sorted(counts.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == grouped(counts, 5)
    assert len(got) == len(counts)


def test_word_counts_and_planted_misspellings(spark, odd):
    texts = [(1, "Straße straße STRAßE Übergrößen übergrößen " * 3), (WIDE + 1, "planted words " * 400), (None, "planted"), (3, None), (3, ""), (4, "étudier")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    got = spelling.word_counts(docs, min_chars=5, min_count=1, alter_every=3).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in want.items() if len(w) >= 5}
    assert spelling.word_counts(odd.limit(0)).count() == 0 and spelling.group_variants(spelling.word_counts(odd.limit(0))).count() == 0
    assert spelling.group_variants(spelling.word_counts(odd)).filter("word = 'shared'").first()["n_near"] == 0


def test_small_parts_of_counts_add_up(odd, monkeypatch):
    whole = {tuple(r) for r in spelling.word_counts(odd, min_chars=2).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    assert {tuple(r) for r in spelling.word_counts(odd, min_chars=2).collect()} == whole


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (64, 64, 64), (65, 130, 67), (33, 200, 129)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-(2**27), 2**27, shape[:2]), rng.integers(-(2**27), 2**27, shape[1:])
    assert (negatives.strassen(a, b, leaf=4) == a.astype(object) @ b.astype(object)).all()
    assert (negatives.strassen(a, b) == a @ b).all()


def mined(rows, positives, wanted):
    """Brute force over (vec_id, vector, label) rows; labels as they are, anchors divisible by 100."""
    use = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for n, (i, v, lab) in enumerate(use):
        if i is None or i % 100:
            continue
        same = sorted(((j, score(v, w)) for m, (j, w, other) in enumerate(use) if m != n and other == lab), key=order)[:positives]
        rest = [(j, score(v, w)) for j, w, other in use if other != lab]
        for j, s in same:
            for rank, (k, t) in enumerate(sorted((x for x in rest if 30 * s <= 100 * x[1] <= 90 * s), key=order)[:wanted], 1):
                out.append((i, j, rank, k, s, t))
    return Counter(out)


SCHEMA13 = "vec_id long, embedding array<float>, label int, score double, slot int"


def test_negatives_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) + 0.4 for _ in range(5)], rng.randrange(3)) for i in range(330)]
    rows += [(i, [0.5] * 5, i % 2) for i in range(1000, 1060)]  # one common vector, ties by id
    rows += [(None, [0.5, 0.4], 0), (2000, None, 1), (2100, [0.1, None], 1), (2200, [float("nan")], 1), (2300, [float("inf")], 2), (2400, [0.2], None), (2500, [], 1), (WIDE + 1, [0.5, 0.5, 0.5], 2), (WIDE + 3, [0.5, 0.5, 0.5], 1)]
    frame = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA13).repartition(5)
    got = Counter(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect())
    want = mined([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 5, 10)
    assert got == want and len(got) > 100
    blocks = Counter(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, block=2).collect())
    assert blocks == want


def test_negatives_of_few_far_and_repeated_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA13)
    mine = lambda rows: sorted(tuple(r) for r in negatives.hard_negatives(frame(rows), F.col("vec_id") % 100 == 0).collect())
    assert mine([]) == [] and mine([(100, [1.0], 1)]) == [] and mine([(1, [1.0], 1), (2, [1.0], 2)]) == []
    twice = mine([(100, [1.0], 1), (100, [1.0], 1), (3, [0.5], 2), (3, [0.5], 2)])
    assert twice == [(100, 100, r, 3, 65536, 32768) for r in (1, 1, 2, 2)]
    far = mine([(100, [3e38], 1), (101, [3e38], 1), (102, [1e38], 2)])
    assert far == []  # both count as the limit, so the negative scores as high as the positive


def test_merged_heaps_equal_one(spark):
    rng = np.random.default_rng(4)
    score, who = rng.integers(0, 6, (3, 40)), [np.zeros(40, np.int64), rng.integers(0, 9, 40), np.zeros(40, np.int64), np.arange(40)]
    one, parts = negatives.Heaps(3, 5), negatives.Heaps(3, 5)
    one.offer(score, np.ones((3, 40), bool), who)
    for own in (slice(0, 7), slice(7, 9), slice(9, 40)):
        parts.offer(score[:, own], np.ones((3, 40), bool)[:, own], [w[own] for w in who])
    assert all((a == b).all() for a, b in zip(one.rows, parts.rows, strict=True))
    assert defaultdict(int, Counter(one.rows[0].tolist())) == {0: 5, 1: 5, 2: 5}
    assert negatives._matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
