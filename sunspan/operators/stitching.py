"""Views of large captures, and detections of all views as one set of objects.

A capture is seen whole and, beyond 768 pixels, in tiles along both axes that overlap by a quarter; the last tile of an
axis ends with the image. Detections of the views are moved to the capture's frame; those of one kind that share more
than half of the smaller one are the same object, along chains too, so an object on a seam is one row. A capture is a
group: chains never leave it, so its boxes travel once. Pairs alone (same_objects) meet by equality on cells, once, in
the cell of the corner of what they share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators._shared import by_group
from sunspan.operators._sql import operator, spark_text

# Captures up to WHOLE pixels are seen once; tiles have TILE pixels at least and a third of the longer side.
WHOLE, TILE = 768, 640
#: Side of a cell in which boxes meet, in pixels, and the share of the smaller box above which two are one.
CELL, SAME = 256, 0.5

_AXIS = "SELECT capture_id, tile, i, least(i * step, greatest(0, {0} - tile)) AS at FROM sized EACH(i, CAST(0 AS BIGINT), CAST(ceil(greatest(0, {0} - tile) * 1e0 / step) AS BIGINT))"
_VIEWS = f"""
SELECT capture_id, CAST(0 AS BIGINT) AS view_no, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, width AS w, height AS h FROM {{captures}}
UNION ALL
SELECT a.capture_id, 1 + b.i * 1000 + a.i AS view_no, a.at AS x, b.at AS y, least(a.tile, s.width) AS w, least(a.tile, s.height) AS h
FROM ({_AXIS.format("width")}) a JOIN ({_AXIS.format("height")}) b ON a.capture_id = b.capture_id JOIN sized s ON s.capture_id = a.capture_id"""
_SIZED = f"""sized AS (SELECT capture_id, width, height, tile, tile - CAST(floor(tile / 4e0) AS BIGINT) AS step FROM (
    SELECT capture_id, width, height, greatest({TILE}, CAST(ceil(greatest(width, height) / 3e0) AS BIGINT)) AS tile FROM {{captures}} WHERE greatest(width, height) > {WHOLE}) t)"""
#: The tiles as a list of starts, whose last is moved to the end of the image.
_LISTED = f"""
WITH {_SIZED.replace("{captures}", "view_captures")},
lists AS (SELECT *, list_distinct(list_concat(range(0, greatest(1, width - tile + 1), step), [greatest(0, width - tile)])) AS xs, list_distinct(list_concat(range(0, greatest(1, height - tile + 1), step), [greatest(0, height - tile)])) AS ys FROM sized)
SELECT capture_id, x, y, least(tile, width - x) AS w, least(tile, height - y) AS h FROM (SELECT *, unnest(ys) AS y FROM (SELECT *, unnest(xs) AS x FROM lists) t) u
UNION ALL SELECT capture_id, 0, 0, width, height FROM view_captures"""
views = operator("i6_views", "view_captures", f"WITH {_SIZED} SELECT capture_id, x, y, w, h FROM ({_VIEWS}) v".replace("{captures}", "{view_captures}"), oracle=_LISTED)


def views_of(captures: DataFrame) -> DataFrame:
    """capture_id, view_no, x, y, w and h of all views of captures (capture_id, width, height); 0 is the whole image.

    A row without a size has no tiles; an empty table has no views.
    """
    return captures.sparkSession.sql(spark_text(f"WITH {_SIZED} {_VIEWS}"), captures=captures)


def same_objects(boxes: DataFrame) -> DataFrame:
    """Pairs (a, b) of boxes (id, capture_id, kind, x0, y0, x1, y1) of one capture and kind that are the same object."""
    ends = lambda low, high: F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))
    held = boxes.where("x1 > x0 and y1 > y0").select("id", "capture_id", "kind", "x0", "y0", "x1", "y1", F.explode(ends("x0", "x1")).alias("cx"))
    held = held.withColumn("cy", F.explode(ends("y0", "y1")))
    a, b = (held.select("capture_id", "kind", "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1"))) for p in "ab")
    met = a.join(b, ["capture_id", "kind", "cx", "cy"]).where("a_id < b_id")
    low, high = ({c: f(f"a_{c}{n}", f"b_{c}{n}") for c in "xy"} for f, n in ((F.greatest, 0), (F.least, 1)))
    once = (F.floor(low["x"] / CELL) == F.col("cx")) & (F.floor(low["y"] / CELL) == F.col("cy"))
    shared = F.greatest(high["x"] - low["x"], F.lit(0)) * F.greatest(high["y"] - low["y"], F.lit(0))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    return met.where(once & (shared > SAME * F.least(area("a"), area("b")))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def stitch(seen: DataFrame, views: DataFrame) -> DataFrame:
    """capture_id, object_id, kind, confidence, members, x0, y0, x1 and y1: one row for each object of a capture.

    seen has (capture_id, view_no, object_id, kind, confidence, x0, y0, x1, y1) in the frames of the views. object_id
    is the least of the members', confidence the greatest that is known, the box holds all members. Boxes without an
    area are objects of their own; null kinds are never the same; an empty table stays empty.
    """
    place = views.select("capture_id", "view_no", "x", "y")
    moved = seen.join(place, ["capture_id", "view_no"]).select(
        "capture_id", "view_no", "object_id", "kind", "confidence",
        (F.col("x0") + F.col("x")).alias("x0"), (F.col("y0") + F.col("y")).alias("y0"), (F.col("x1") + F.col("x")).alias("x1"), (F.col("y1") + F.col("y")).alias("y1"),
    )
    kinds = dict(moved.dtypes)
    out = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ("capture_id", "object_id", "kind", "confidence", "members", "x0", "y0", "x1", "y1"))
    return by_group(moved, "capture_id", ["view_no", "object_id"], _merged, out)


def _merged(rows: list[tuple]) -> list[tuple]:
    """The objects of a capture's boxes, found by a sweep over their left sides for each kind."""
    kinds: dict[str, list[int]] = {}
    for i, (_, _, _, kind, _, *box) in enumerate(rows):
        if kind is not None and None not in box and box[2] > box[0] and box[3] > box[1]:
            kinds.setdefault(kind, []).append(i)
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for own in kinds.values():
        own.sort(key=lambda i: rows[i][5])
        x0, y0, x1, y1 = np.array([rows[i][5:] for i in own], dtype=float).T
        area, ends = (x1 - x0) * (y1 - y0), np.searchsorted(x0, x1)
        for n, i in enumerate(own):
            m = slice(n + 1, ends[n])
            shared = np.maximum(np.minimum(x1[n], x1[m]) - x0[m], 0) * np.maximum(np.minimum(y1[n], y1[m]) - np.maximum(y0[n], y0[m]), 0)
            for k in np.flatnonzero(shared > SAME * np.minimum(area[n], area[m])):
                up[find(own[n + 1 + k])] = find(i)
    parts: dict[int, list[tuple]] = {}
    for i, r in enumerate(rows):
        parts.setdefault(find(i), []).append(r)
    known = lambda part, c, f: f((r[c] for r in part if r[c] is not None), default=None)
    return [(p[0][0], known(p, 2, min), p[0][3], known(p, 4, max), len(p), known(p, 5, min), known(p, 6, min), known(p, 7, max), known(p, 8, max)) for p in parts.values()]
