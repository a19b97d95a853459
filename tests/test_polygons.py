"""Polygons as edge relations: covers, pairs and areas against closed cases and brute force."""

from __future__ import annotations

import contextlib
import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sunspan.operators import polygons
from sunspan.plans import queries
from sunspan.sources.files import read_features

SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]
KEYS = ("area_a", "area_b", "shared", "united", "only_a", "only_b")


def shapes(spark, rows):
    """Polygons (id, part, rings) as edges."""
    frame = spark.createDataFrame(rows, "id long, part long, rings array<array<array<double>>>")
    return polygons.edges_of(frame, "id", "rings", "part")


def areas(spark, a, b):
    row = polygons.overlay_pairs(objects=shapes(spark, a), edges=shapes(spark, b)).collect()
    return {(r.object_id, r.polygon_id): tuple(r[k] for k in KEYS) for r in row}


def moved(ring, dx, dy):
    return [[x + dx, y + dy] for x, y in ring]


def star(r, corners, centre=(0.0, 0.0), size=10.0):
    turn = r.random()
    ends = [(2 * math.pi * (k + turn) / corners, size * (0.4 + 0.6 * r.random())) for k in range(corners)]
    return [[centre[0] + d * math.cos(a), centre[1] + d * math.sin(a)] for a, d in ends]


# --- covers


def crosses(ring, x, y):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))


def on_rim(ring, x, y):
    return any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))


@pytest.mark.parametrize("cell", [16.0, 1.0, 1000.0])
def test_covers_equal_brute_force_with_holes_and_parts(spark, cell):
    r = random.Random(5)
    rows = [(1, 0, [SQUARE, HOLE[::-1]]), (1, 1, [moved(SQUARE, 20, 0)]), (2, 0, [moved(SQUARE[::-1], -3, -3) + [[-3.0, 7.0]]]), (3, 0, [moved([[x * 400, y * 300] for x, y in SQUARE], -2000, -1500)])]
    rows += [(10 + k, 0, [star(r, 3 + k % 7, (r.uniform(-40, 40), r.uniform(-40, 40)), r.choice([0.5, 5, 30]))]) for k in range(40)]
    points = [(x / 2, y / 2) for x in range(-8, 64) for y in range(-8, 24)] + [(r.uniform(-60, 60), r.uniform(-60, 60)) for _ in range(300)]
    points += [(float(x), float(y)) for _, _, rings in rows for x, y in rings[0]]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id long, x double, y double")
    found = polygons.identify(points=frame, edges=shapes(spark, rows), cell=cell).collect()
    want = {(i, n) for i, p in enumerate(points) for n, _, rings in rows if sum(crosses(ring, *p) for ring in rings) % 2 or any(on_rim(ring, *p) for ring in rings)}
    assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_smallest_cover_and_exteriors(spark):
    rows = [(1, 0, [SQUARE, HOLE]), (2, 0, [[[x * 3, y * 3] for x, y in SQUARE]]), (3, 0, [[[5.0, 5.0], [5.5, 5.0], [5.5, 5.5]]])]
    frame = spark.createDataFrame([(1, 5.2, 5.8), (2, 1.0, 1.0), (3, 5.4, 5.1), (4, 25.0, 25.0), (5, 31.0, 0.0), (6, 4.0, 5.0)], "point_id long, x double, y double")
    holes = {r.point_id: (r.polygon_id, r.area) for r in polygons.enclosing(points=frame, edges=shapes(spark, rows)).collect()}
    assert holes == {1: (2, 900.0), 2: (1, 96.0), 3: (3, 0.125), 4: (2, 900.0), 6: (1, 96.0)}  # the rim of a hole belongs to the polygon
    filled = {r.point_id: r.polygon_id for r in polygons.enclosing_exterior(points=frame, edges=shapes(spark, rows)).collect()}
    assert filled == {1: 1, 2: 1, 3: 3, 4: 2, 6: 1}


def test_points_and_polygons_meet_by_equality(spark):
    frame = spark.createDataFrame([(1, 5.2, 5.8)], "point_id long, x double, y double")
    for df in (polygons.identify(points=frame, edges=shapes(spark, [(1, 0, [SQUARE])])), polygons.overlay_pairs(objects=shapes(spark, [(1, 0, [SQUARE])]), edges=shapes(spark, [(1, 0, [SQUARE])]))):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        assert "CartesianProduct" not in plan.getvalue() and "NestedLoop" not in plan.getvalue() and "EvalPython" not in plan.getvalue() and "InArrow" not in plan.getvalue()


def test_odd_polygons(spark):
    rows = [(1, 0, None), (2, 0, []), (3, 0, [[[0.0, 0.0], [1.0, 1.0]]]), (4, 0, [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]]), (5, 0, [SQUARE + SQUARE[:1]])]
    edges = shapes(spark, rows)
    assert {r.polygon_id for r in edges.collect()} == {4, 5} and edges.where("polygon_id = 5").count() == 4
    frame = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.5, 0.0), (None, 5.0, 5.0)], "point_id long, x double, y double")
    assert {(r.point_id, r.polygon_id) for r in polygons.identify(points=frame, edges=edges).collect()} == {(1, 5), (2, 4), (2, 5), (None, 5)}
    assert polygons.identify(points=frame.limit(0), edges=edges).count() == 0 and polygons.identify(points=frame, edges=edges.limit(0)).count() == 0


def test_features_of_a_file_are_polygons(spark, tmp_path):
    ring = lambda ps: [[list(p) for p in ps] + [list(ps[0])]]
    feature = {"id": 7, "geometry": {"type": "MultiPolygon", "coordinates": [ring(SQUARE) + ring(HOLE), ring(moved(SQUARE, 20, 0))]}, "properties": {"building_id": 3}}
    (tmp_path / "f.json").write_text(json.dumps([feature]))
    edges = polygons.edges_of(read_features(spark, str(tmp_path / "f.json")))
    frame = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 25.0, 5.0)], "point_id long, x double, y double")
    assert {(r.point_id, r.polygon_id) for r in polygons.identify(points=frame, edges=edges).collect()} == {(1, "7:0"), (3, "7:1")}


# --- areas


@pytest.mark.parametrize(
    ("b", "want"),
    [
        ([SQUARE], (96, 100, 96, 100, 0, 4)),
        ([SQUARE, HOLE], (96, 96, 96, 96, 0, 0)),
        ([moved(SQUARE, 5, 5)], (96, 100, 24, 172, 72, 76)),
        ([moved(SQUARE, 10, 0)], (96, 100, 0, 196, 96, 100)),
        ([HOLE], (96, 4, 0, 100, 96, 4)),
        ([[[5.0, -5.0], [15.0, 5.0], [5.0, 15.0], [-5.0, 5.0]]], (96, 200, 96, 200, 0, 104)),
        ([[[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]], (96, 50, 48, 98, 48, 2)),
    ],
)
def test_areas_of_closed_cases(spark, b, want):
    [found] = areas(spark, [(1, 0, [SQUARE, HOLE])], [(2, 0, b)]).values()
    assert found == pytest.approx(want, abs=1e-6)


def clipped(triangle, other):
    """Area of what two triangles share, by cutting one with the sides of the other."""
    turn = lambda t: sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(t, t[1:] + t[:1], strict=True)) / 2
    if abs(turn(triangle)) < 1e-12 or abs(turn(other)) < 1e-12:
        return 0.0
    sign = math.copysign(1, turn(triangle)) * math.copysign(1, turn(other))
    left, right = (t if turn(t) > 0 else t[::-1] for t in (triangle, other))
    for (ax, ay), (bx, by) in zip(right, right[1:] + right[:1], strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in zip(left, left[1:] + left[:1], strict=True):
            s, t = side(p), side(q)
            out += [p] if s >= 0 else []
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        left = out
        if not left:
            return 0.0
    return sign * abs(turn(left))


def shared_by_fans(a, b):
    """Polygons are signed sums of the triangles of a corner and each side."""
    fan = lambda ring: [[ring[0], p, q] for p, q in zip(ring[1:], ring[2:], strict=False)]
    return abs(sum(clipped(s, t) for s in fan(a) for t in fan(b)))


def test_areas_equal_brute_force_and_add_up(spark):
    r = random.Random(11)
    a = {k: star(r, 3 + k % 8, (r.uniform(0, 30), r.uniform(0, 30)), r.choice([2, 8, 25])) for k in range(14)}
    b = {k: star(r, 3 + k % 5, (r.uniform(0, 30), r.uniform(0, 30)), r.choice([1, 9, 80])) for k in range(12)}
    found = areas(spark, [(k, 0, [v]) for k, v in a.items()], [(k, 0, [v]) for k, v in b.items()])
    for i, x in a.items():
        for j, y in b.items():
            want = shared_by_fans(x, y)
            assert found.get((i, j), (0,) * 6)[2] == pytest.approx(want, abs=1e-5), (i, j)
    for area_a, area_b, shared, united, only_a, only_b in found.values():
        assert united == pytest.approx(area_a + area_b - shared, abs=1e-5)
        assert (only_a, only_b) == pytest.approx((area_a - shared, area_b - shared), abs=1e-5)


@pytest.mark.parametrize("band", [64.0, 3.0])
def test_union_of_many_counts_nothing_twice(spark, band):
    things = spark.createDataFrame([(k, 0, 1, [moved(HOLE, dx, 0)]) for k, dx in enumerate((0.0, 1.0, 1.0, -3.0, 20.0))], "id long, part long, building_id long, rings array<array<array<double>>>")
    objects = polygons.edges_of(things, "id", "rings", "part").withColumn("building_id", F.lit(1).cast("long"))
    [row] = polygons.union(objects=objects, edges=shapes(spark, [(1, 0, [SQUARE])]), band=band).collect()
    assert (row.outline, row.objects, row.united, row.free) == pytest.approx((100, 2 * 3 + 2 * 2 + 4, 104, 90), abs=1e-6)


@pytest.mark.parametrize("name", ["s2_identify_rings", "j10_point_in_rings", "j11_enclosing_rings"])
def test_covers_broadcast_nothing(spark, tiny, name):
    """Exploded rows look as small to Spark as what they come from."""
    plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_boxes_of_all_sizes_meet_once(spark):
    r = random.Random(3)
    made = lambda n, at: [(at + k, 0, [moved([[x * s, y * s / 2] for x, y in SQUARE], r.uniform(-300, 300), r.uniform(-300, 300))]) for k, s in ((k, r.choice([0.01, 0.3, 3, 20, 200])) for k in range(n))]
    a, b = made(120, 0), made(90, 1000)
    box = lambda row: (min(p[0] for p in row[2][0]), max(p[0] for p in row[2][0]), min(p[1] for p in row[2][0]), max(p[1] for p in row[2][0]))
    meet = lambda p, q: p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
    for cell in (16.0, 1.0, 5000.0):
        found = [tuple(x) for x in polygons.box_pairs(shapes(spark, a), shapes(spark, b), cell).collect()]
        assert len(found) == len(set(found)) and set(found) == {(p[0], q[0]) for p in a for q in b if meet(box(p), box(q))}


@pytest.mark.parametrize("name", ["o2_ring_overlay", "s16_surveyed_rings", "j8_objects_rings", "j12_clip_rings", "f14_ring_membership"])
def test_overlays_make_their_pieces_once(spark, tiny, name):
    """A pair is one row that is swept where it is: polygons are exploded for their pieces and areas, not for each step."""
    plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 40 and plan.count("Exchange hashpartitioning") <= 20 and "Window" not in plan


@pytest.mark.parametrize("band", [64.0, 3.0])
def test_overlays_over_bands(spark, band):
    touching = moved(SQUARE, 0, 10)
    found = polygons.overlay_pairs(objects=shapes(spark, [(1, 0, [SQUARE, HOLE]), (3, 0, [[[0.0, 10.0], [5.0, 10.0], [9.0, 10.0]]])]), edges=shapes(spark, [(2, 0, [moved(SQUARE, 5, 5)]), (4, 0, [touching])]), band=band)
    got = {(r.object_id, r.polygon_id): tuple(r[k] for k in KEYS) for r in found.collect()}
    assert got == {(1, 2): (96, 100, 24, 172, 72, 76), (1, 4): (96, 100, 0, 196, 96, 100), (3, 2): (0, 100, 0, 100, 0, 100), (3, 4): (0, 100, 0, 100, 0, 100)}


def test_unions_of_piles_are_swept_at_the_rim(spark, tiny):
    """Cells that lie in one object need none of the others, and slabs are no rows of Spark's."""
    plan = queries.queries()["a1_union_rings"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    pile = [(k, 0, 1, [moved([[x / 2, y / 2] for x, y in SQUARE], k % 20 * 0.75, k // 20 % 20 * 0.75), [[x / 10 + k % 20 * 0.75 + 2, y / 10 + k // 20 % 20 * 0.75 + 2] for x, y in HOLE[::-1]]]) for k in range(500)]
    things = spark.createDataFrame([*pile, (900, 0, 1, [[[30.0, 0.0], [34.0, 4.0], [30.0, 8.0], [26.0, 4.0]]]), (901, 0, None, [SQUARE]), (902, 0, 3, [SQUARE])], "id long, part long, building_id long, rings array<array<array<double>>>")
    objects = polygons.edges_of(things, "id", "rings", "part").join(things.select(F.col("id").alias("polygon_id"), "building_id"), "polygon_id")
    for band in (64.0, 0.7):
        found = {r.building_id: tuple(r)[1:] for r in polygons.union(objects=objects, edges=shapes(spark, [(1, 0, [SQUARE, HOLE]), (2, 0, [SQUARE])]), band=band).collect()}
        side = 19 * 0.75 + 5
        assert found[1] == pytest.approx((96, side * side + 32, side * side + 32, 0), abs=1e-5)
        assert found[2] == (100, 0, 100, 100) and found[3] == (0, 100, 100, 0) and len(found) == 3
