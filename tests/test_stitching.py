"""Views of captures and detections stitched over their seams."""

from __future__ import annotations

import math

import pytest

from sunspan.operators import stitching

SEEN = "capture_id long, view_no long, object_id long, kind string, confidence double, x0 long, y0 long, x1 long, y1 long"


def looped_views(width, height):
    """Whole image, then tiles by hand."""
    out = {(0, 0, width, height)}
    if max(width, height) > 768:
        tile = max(640, math.ceil(max(width, height) / 3))
        starts = lambda n: sorted({*range(0, max(1, n - tile + 1), tile - tile // 4), max(0, n - tile)})
        out |= {(x, y, min(tile, width - x), min(tile, height - y)) for y in starts(height) for x in starts(width)}
    return out


def test_views_of_every_size_equal_a_loop_and_cover_the_image(spark):
    sizes = [(w, h) for w in (1, 640, 768, 769, 1119, 1120, 1121, 1600, 1601, 4999, 30_000) for h in (5, 700, 768, 1281, 2000)]
    captures = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "capture_id long, width long, height long")
    found: dict[int, list] = {}
    for v in stitching.views_of(captures).collect():
        found.setdefault(v.capture_id, []).append((v.x, v.y, v.w, v.h))
    for i, (w, h) in enumerate(sizes):
        assert set(found[i]) == looped_views(w, h)
        tiles = [v for v in found[i] if v != (0, 0, w, h)]
        assert not tiles or (max(x + a for x, _, a, _ in tiles), max(y + b for _, y, _, b in tiles)) == (w, h)  # the last view is there
    assert stitching.views_of(captures.limit(0)).collect() == []
    assert {(v.capture_id, v.x, v.y, v.w, v.h) for v in stitching.views(view_captures=captures).collect()} == {(i, *v) for i, s in enumerate(sizes) for v in looped_views(*s)}


def test_an_object_on_a_seam_is_one_row(spark):
    captures = spark.createDataFrame([(1, 1600, 1300), (2, 600, 600)], "capture_id long, width long, height long")
    views = stitching.views_of(captures)
    at = {(v.x, v.y): v.view_no for v in views.where("capture_id = 1 and view_no > 0").collect()}
    assert {(0, 0), (480, 0), (960, 0), (0, 480)} <= set(at)
    rows = [
        (1, at[0, 0], 1, "pv", 0.6, 420, 100, 640, 200),  # 420 to 640, cut by the tile
        (1, at[480, 0], 2, "pv", 0.9, 0, 100, 220, 200),  # 480 to 700 of the same thing
        (1, 0, 3, "pv", 0.5, 430, 100, 690, 200),  # the whole view
        (1, at[480, 0], 4, "skylight", 0.9, 0, 100, 220, 200),  # another kind at the same place
        (1, at[960, 0], 5, "pv", None, 100, 100, 150, 150),
        (2, 0, 6, "pv", 0.7, 420, 100, 640, 200),  # another capture
        (1, 0, 7, None, 0.1, 420, 100, 640, 200),
        (1, 0, 8, "pv", 0.2, 50, 50, 50, 90),  # no area
    ]
    found = {(r.capture_id, r.object_id): r for r in stitching.stitch(spark.createDataFrame(rows, SEEN), views).collect()}
    assert set(found) == {(1, 1), (1, 4), (1, 5), (2, 6), (1, 7), (1, 8)}
    one = found[1, 1]
    assert (one.members, one.confidence, one.x0, one.y0, one.x1, one.y1) == (3, 0.9, 420, 100, 700, 200)
    assert found[1, 5].confidence is None and (found[1, 5].x0, found[1, 5].x1) == (1060, 1110)
    assert stitching.stitch(spark.createDataFrame([], SEEN), views).collect() == []


@pytest.mark.parametrize("shift", [0, 3000])
def test_pairs_meet_once_and_by_more_than_half_of_the_smaller(spark, shift):
    boxes = [(1, 0, 0, 1000, 1000), (2, 400, 400, 500, 500), (3, 900, 900, 1100, 1100), (4, 950, 0, 1049, 10), (5, 951, 20, 1051, 30), (6, 0, 0, 1000, 1000)]
    rows = [(i, 1, "pv", a + shift, b + shift, c + shift, d + shift) for i, a, b, c, d in boxes]
    df = spark.createDataFrame(rows, "id long, capture_id long, kind string, x0 long, y0 long, x1 long, y1 long")
    found = sorted((r.a, r.b) for r in stitching.same_objects(df).collect())
    assert found == [(1, 2), (1, 4), (1, 6), (2, 6), (4, 6)]
