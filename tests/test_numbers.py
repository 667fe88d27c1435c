"""Numbers at the ends of their ranges: silent levels, and whole division of large places."""

import pytest

from tapeloom.operators import clocks, runs


@pytest.mark.parametrize("level, byte", [(0.0, 0), (-0.5, 0), (None, 0), (1e-9, 0), (0.01, 128), (1.0, 255), (7.0, 255)])
def test_silence_is_the_lowest_level(spark, level, byte):
    rows = spark.createDataFrame([("a", 0.5, level)], "rec string, t double, level double")
    assert runs.level_outline(rows, step=1.0).first()["peak"] == byte


def test_clocks_far_apart_are_divided_as_whole_numbers(spark):
    i1, c1, i = 3_000_000_007, 2_592_000_011, 1_234_567_891
    anchors = spark.createDataFrame([("a", 0, 0), ("a", i1, c1), ("b", 0, 0), ("b", i1, -c1)], "rec string, i long, clock long")
    places = [i1 - 1, i, *range(i1 // 2, i1 // 2 + 40), *[i1 * n // 97 + 1 for n in range(1, 97)]]
    rows = spark.createDataFrame([(rec, p) for rec in "ab" for p in places], "rec string, i long")
    found = {(r["rec"], r["i"]): r["clock"] for r in clocks.interpolate_between_anchors(rows, anchors).collect()}
    assert found == {(rec, p): sign * (p * c1 // i1) for rec, sign in (("a", 1), ("b", -1)) for p in places}
