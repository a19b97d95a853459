"""Many polygons at once against one at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from sunspan.operators import batches, rings, roofs
from sunspan.operators._shared import by_group, by_groups
from sunspan.operators.batches import Polygons
from sunspan.plans import queries as plans
from sunspan.settings import Panel, Settings

RINGS, ROWS = pa.list_(pa.list_(pa.list_(pa.float64()))), [
    ("building_id", pa.int64()), ("part_no", pa.int32()), ("face_id", pa.string()), ("rings", pa.list_(pa.list_(pa.list_(pa.float64())))), ("slope_x", pa.float64()), ("slope_y", pa.float64()),
    ("z", pa.float64()), ("anchor", pa.string()), ("pitch", pa.float64()), ("irradiation", pa.float64()), ("status", pa.string()), ("eligible", pa.bool_()),
    ("objects", pa.list_(pa.struct([("object_id", pa.int64()), ("kind", pa.string()), ("ring", pa.list_(pa.list_(pa.float64())))]))), ("cell", pa.float64()), ("us", pa.list_(pa.float64())), ("vs", pa.list_(pa.float64())),
]


def shape(r: np.random.Generator, x: float, y: float, size: float) -> list:
    """A turned box, a triangle, an L, a star or a box with a hole; closed or with repeated points sometimes."""
    kind = r.integers(0, 5)
    base = [[(0, 0), (1, 0), (1, 0.8), (0, 0.8)], [(0, 0), (1, 0.1), (0.3, 1)], [(0, 0), (1, 0), (1, 0.4), (0.5, 0.4), (0.5, 1), (0, 1)], [(math.cos(k) * (1 if k % 2 else 0.6), math.sin(k) * (1 if k % 2 else 0.6)) for k in range(6)], [(0, 0), (1, 0), (1, 1), (0, 1)]][kind]
    out = [base, [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]] if kind == 4 else [base]
    if r.random() < 0.5:
        out = [q[::-1] for q in out]
    if r.random() < 0.2:
        out = [[*q, q[0]] for q in out]
    if r.random() < 0.2:
        out = [[q[0], *q] for q in out]
    a = r.choice([0.0, 0.3, 1.2])
    return [[[x + size * (p * math.cos(a) - q * math.sin(a)), y + size * (p * math.sin(a) + q * math.cos(a))] for p, q in ring] for ring in out]


def buildings(n: int, seed: int, shade: bool = False) -> list[dict]:
    r, rows = np.random.default_rng(seed), []
    for b in range(n):
        x, y = (2640000.0, 1230000.0) if b % 3 else (0.0, 0.0)
        near = lambda d: (x + r.uniform(-d, d), y + r.uniform(-d, d))
        objects = [{"object_id": k, "kind": str(r.choice(["chimney", "existing_pv", "rwa", "skylight+existing_pv"], p=[0.5, 0.3, 0.05, 0.15])), "ring": shape(r, *near(8), 1.5)[0]} for k in range(r.integers(0, 4))]
        for k in range(r.integers(1, 5)):
            eligible = bool(r.random() < 0.7)
            us = [0.0, 0.5, -2.0] if shade and k % 2 else None
            rows.append({
                "building_id": b if b else None, "part_no": k, "face_id": f"{b}:{k if r.random() < 0.95 else 0}", "rings": shape(r, *near(6), r.uniform(1, 14)), "slope_x": float(r.choice([0.0, 0.4, -0.9])), "slope_y": float(r.choice([0.0, 0.3])),
                "z": None if r.random() < 0.1 else float(r.integers(400, 403)), "anchor": "measured", "pitch": float(r.choice([0.0, 20.0])), "irradiation": None if r.random() < 0.2 else float(r.choice([900.0, 1100.0, 5000.0])),
                "status": "suitable", "eligible": eligible, "objects": objects or None, "cell": 0.5 if us else None, "us": us, "vs": [0.1, 0.2, 1.0] if us else None,
            })
    return rows


@pytest.mark.parametrize("change", [{}, {"layout_policy": "physical"}, {"objective": "energy", "max_panels": 9}, {"annual_consumption_kwh": 9000.0, "existing_generation_kwh": 1000.0, "mode": "maximum"}, {"panel": Panel(row_gap_m=0.02)}, {"objective": "energy", "minimum_array_panels": 1}])
def test_buildings_by_batches_are_those_of_one_at_a_time(change):
    settings = Settings(**change)
    rows = buildings(70, len(str(change)), shade=not change)
    want = []
    for b in dict.fromkeys(r["building_id"] for r in rows):
        want += roofs.analyse_building([r for r in rows if r["building_id"] == b], settings)
    got = roofs.analyse_buildings(pa.Table.from_pylist(rows, pa.schema(ROWS)), settings)
    names = got.schema.names
    want = sorted(map(repr, (dict(zip(names, w, strict=True)) for w in want)))
    assert sorted(map(repr, got.to_pylist())) == want and any(p for p in got.column("panels").to_pylist())
    assert roofs.analyse_buildings(pa.Table.from_pylist([], pa.schema(ROWS)), settings, False).num_rows == 0


def test_faces_without_area_hold_nothing():
    row = buildings(1, 0)[0] | {"objects": None}
    rows = [row | {"face_id": f"{i}", "rings": r} for i, r in enumerate([None, [], [[[0.0, 0.0], [9.0, 9.0]]], [[[1.0, 1.0]] * 4], [[[0.0, 0.0], [4.0, 0.0], [9.0, 0.0]]]])]
    got = roofs.analyse_buildings(pa.Table.from_pylist(rows, pa.schema(ROWS)), Settings()).to_pylist()
    assert [(r["physical"], r["area_m2"], r["panels"]) for r in got] == [(0, 0.0, [])] * 5


def test_pairs_that_touch_are_those_of_two_at_a_time():
    r = np.random.default_rng(8)
    shapes = [shape(r, *r.uniform(-4, 4, 2), r.uniform(1, 6)) for _ in range(80)] + [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]], [[[4.0, 0.0], [8.0, 0.0], [8.0, 4.0], [4.0, 4.0]]]]
    got = Polygons.of(*batches.lists(pa.array(shapes, RINGS)))
    assert got.area() == pytest.approx([rings.area(s) for s in shapes])
    i, j = np.triu_indices(len(shapes), 1)
    hit = batches.touch(got.take(i), got.take(j))
    assert hit.tolist() == [rings.touch(shapes[a], shapes[b]) for a, b in zip(i, j, strict=True)] and 0 < hit.sum() < len(hit)
    group = np.repeat([0, 1, 2], [40, 2, 40])
    near = set(zip(*(x.tolist() for x in batches.pairs(group, got.box)), strict=True))
    assert near == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if group[a] == group[b] and not rings.apart(rings.bounds(shapes[a]), rings.bounds(shapes[b]))}


def test_groups_are_dealt_whatever_joins_did_before(spark, tiny):
    """A shuffle by the key alone is left out after a join by that key, and parts groups when the join turns out a broadcast."""
    a, b = (spark.range(3000).selectExpr("id % 50 AS g", "id") for _ in range(2))
    joined = a.join(b.groupBy("g").count(), "g")
    for grouped in (by_group(joined, "g", ["id"], lambda rows: [(rows[0][0], len(rows))], "g long, n long"), by_groups(joined, "g", ["id"], lambda t: pa.RecordBatch.from_pydict({"g": t.column("g").unique(), "n": pa.array([60] * len(t.column("g").unique()))}), "g long, n long")):
        assert "hashpartitioning(xxhash64(g" in grouped._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, grouped.collect())) == [(g, 60) for g in range(50)]


def test_answers_without_modules_do_not_make_them(spark, tiny):
    for name in ("a10_building_assessment", "a11_official_comparison"):
        assert "panels" not in plans.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString(), name


def test_overlaps_are_counted_over_all_pairs(spark):
    r, rows = np.random.default_rng(4), []
    for k in range(60):
        u, v = np.array([1.1, 0.2 * (k % 3)]), np.array([-0.2, 1.7])
        low = r.integers(0, 5, (k % 30, 2)) * r.choice([1.0, 0.55, 1.02])
        rows.append((f"f{k}", [np.concatenate([q, q + u, q + u + v, q + v]).tolist() for q in low @ np.array([u, v])] if k else None, low))
    want = {f: sum(bool((np.abs(low[i] - low[j]) < 1 - 1e-4).all()) for i in range(len(low)) for j in range(i)) for f, _, low in rows}
    df = spark.createDataFrame([(f, p) for f, p, _ in rows], "face_id string, panels array<array<double>>")
    assert {x.face_id: x.overlaps for x in roofs.validate_placement(df).collect()} == want and sum(want.values()) > 100


def test_shared_areas_edges_and_gaps_are_those_of_two_at_a_time():
    r = np.random.default_rng(9)
    shapes = [shape(r, *r.uniform(-5, 5, 2), r.uniform(1, 7)) for _ in range(70)] + [[[[float(x), 0.0], [x + w, 0.0], [x + w, 4.0], [float(x), 4.0]]] for x, w in ((20, 10), (30, 9), (39.3, 4), (43.7, 2), (46.2, 3))]
    got = Polygons.of(*batches.lists(pa.array(shapes, RINGS)))
    i, j = np.triu_indices(len(shapes), 1)
    over, along = batches.shared_area(got.take(i), got.take(j)), batches.shared_edge(got.take(i), got.take(j))
    told = [f"overlaps by {o:.1f} m2" if o > 0.5 else f"shares {e:.1f} m of edge" if e >= 1.5 else None for o, e in zip(over, along, strict=True)]
    assert told == [rings.link_reason(shapes[a], shapes[b]) for a, b in zip(i, j, strict=True)] and {str(x)[:4] for x in told} == {"over", "shar", "None"}
    assert over == pytest.approx([rings.overlap_area(shapes[a], shapes[b]) for a, b in zip(i, j, strict=True)])
    points = [np.concatenate([rings.closed(x) for x in s]) for s in shapes]
    gap = [0.0 if rings.touch(shapes[a], shapes[b]) else min(rings.point_distance(shapes[a], points[b]).min(), rings.point_distance(shapes[b], points[a]).min()) for a, b in zip(i, j, strict=True)]
    close = batches.near(got.take(i), got.take(j), 0.5)
    assert close.tolist() == [g <= 0.5 for g in gap] and 0 < close.sum() < len(close) and any(0 < g <= 0.5 for g in gap)
    assert len(batches.near(got.take(i[:0]), got.take(j[:0]), 0.5)) == 0 == len(batches.shared_edge(got.take(i[:0]), got.take(j[:0])))


def test_unions_of_groups_are_those_of_one_at_a_time(monkeypatch):
    r = np.random.default_rng(3)
    group = np.sort(r.integers(0, 25, 70))
    group = np.unique(group, return_inverse=True)[1]
    shapes = [shape(r, *r.uniform(-6, 6, 2), r.uniform(1, 7)) for _ in group]
    want = [rings.union_area([s for s, g in zip(shapes, group, strict=True) if g == k]) for k in range(group.max() + 1)]
    got = Polygons.of(*batches.lists(pa.array(shapes, RINGS)))
    assert batches.union_area(group, got) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(batches.parts, "__defaults__", (500,))
    assert batches.union_area(group, got) == pytest.approx(want, abs=1e-9)
    assert len(batches.union_area(group[:0], got.take(group[:0]))) == 0


def test_coplanar_groups_are_those_of_one_at_a_time(spark):
    """Chains of faces beside each other; repeated rows and names, unknown slopes and heights."""
    r, rows = np.random.default_rng(12), []
    for b in range(25):
        for k in range(int(r.integers(1, 9))):
            s = shape(r, *r.uniform(-5, 5, 2), r.uniform(1, 6))
            rows.append((b, k, f"{b}:{k % 7}", [[[round(float(v), 3) for v in p] for p in q] for q in s], None if k % 5 == 4 else float(r.choice([0.0, 0.15, 0.3])), 0.0, None if k == 6 else float(r.choice([0.0, 1.2, 2.4]))))
    want = []
    for b in range(25):
        parts = []
        for _, _, face, s, sx, sy, z in (x for x in rows if x[0] == b):
            n = np.array([-(sx or 0.0), -sy, 1.0])
            parts.append((rings.area(s), face, s, n / np.linalg.norm(n), z or 0.0))
        joined = []
        for p in sorted(parts, key=lambda p: (-p[0], p[1])):
            for g in joined:
                points = lambda s: np.concatenate([rings.closed(x) for x in s])
                gap = min(0.0 if rings.touch(p[2], q[2]) else min(rings.point_distance(p[2], points(q[2])).min(), rings.point_distance(q[2], points(p[2])).min()) for q in g)
                if p[3] @ g[0][3] >= roofs.COPLANAR_COS and abs(p[4] - g[0][4]) <= roofs.COPLANAR_RISE_M and gap <= roofs.COPLANAR_GAP_M:
                    g.append(p)
                    break
            else:
                joined.append([p])
        want += [(b, p[1], g[0][1], len(g), round(sum(q[0] for q in g), 2)) for g in joined for p in g]
    df = spark.createDataFrame(rows, "building_id long, part_no int, face_id string, rings array<array<array<double>>>, slope_x double, slope_y double, z double")
    got = [(x.building_id, x.face_id, x.lead, x.members, round(x.area, 2)) for x in roofs.join_coplanar(df).collect()]
    assert sorted(got) == sorted(want) and max(w[3] for w in want) > 2
    assert roofs.join_coplanar(df.limit(0)).collect() == []


def test_polygons_of_a_batch_are_looked_at_together(spark, monkeypatch):
    """No polygon is asked on its own any more."""
    for name in ("link_reason", "touch", "overlap_area", "union_area", "point_distance", "area", "bounds", "inside"):
        monkeypatch.setattr(rings, name, None)
    seen, by = [], roofs.by_groups
    monkeypatch.setattr(roofs, "by_groups", lambda df, key, order, fn, schema: seen.append(fn) or by(df, key, order, fn, schema))
    row = {"g": 1, "part_no": 1, "rings": [[[0.0, 0.0], [9.0, 0.0], [9.0, 5.0], [0.0, 5.0]]], "slope_x": 0.0, "slope_y": 0.0, "z": 1.0, "pitch": 0.0, "contains_click": True, "egid": 1}
    rows = [row | {"building_id": 1, "_group": 1, "_building": 1, "face_id": f} for f in ("a", "b")]
    schema = "building_id long, part_no long, face_id string, rings array<array<array<double>>>, slope_x double, slope_y double, z double, pitch double, contains_click boolean"
    df = spark.createDataFrame([], schema)
    for made in (roofs.ring_links(df), roofs.join_coplanar(df), roofs.merge_building(df, spark.createDataFrame([], "face_id string, accepted boolean"))):
        assert made.columns
    got = [fn(pa.Table.from_pylist(rows)).to_pylist() for fn in seen]
    assert got[0] == [{"a": "a", "b": "b", "reason": "overlaps by 45.0 m2"}] and [g["members"] for g in got[1]] == [2, 2] and got[2][0]["area_m2"] == 45.0 and got[2][0]["members"] == ["a", "b"]


def test_roofs_are_grown_as_one_by_one(spark):
    """Groups with and without links, without a click, with repeated faces, without identities."""
    from sunspan.operators import graph

    r, rows, links, want = np.random.default_rng(6), [], [], []
    for g in range(60):
        n = int(r.integers(1, 8))
        own = [(g, k, f"{g}:{k if k < 6 else 0}", None if r.random() < 0.3 else int(r.integers(0, 3)), None if r.random() < 0.2 else bool(r.random() < 0.3)) for k in range(n)]
        mine = [(f"{g}:{a}", f"{g}:{b}") for a in range(min(n, 6)) for b in range(a + 1, min(n, 6)) if g % 3 and r.random() < 0.4]
        rows, links = rows + own, links + mine
        egid = {f: e or None for _, _, f, e, _ in own}
        anchor = next((f for _, _, f, _, c in own if c), own[0][2])
        reason, known, more = {anchor: "anchor"}, {egid[anchor]} - {None}, True
        while more:
            more = False
            for _, _, f, _, _ in own:
                if reason.get(f) in ("anchor", "linked"):
                    continue
                if egid[f] and known and egid[f] not in known:
                    reason[f] = "other_identity"
                elif any(reason.get(b if a == f else a) in ("anchor", "linked") for a, b in mine if f in (a, b)):
                    reason[f], known, more = "linked", known | ({egid[f]} - {None}), True
                else:
                    reason[f] = "apart"
        want += [(g, f, reason[f] in ("anchor", "linked"), reason[f]) for _, _, f, _, _ in own]
    faces = spark.createDataFrame(rows, "building_id long, part_no int, face_id string, egid long, contains_click boolean")
    near = spark.createDataFrame(links, "a string, b string")
    got = graph.select_connected(faces, near)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[3] for w in want} == {"anchor", "linked", "apart", "other_identity"}
    assert graph.select_connected(faces.limit(0), near).collect() == []
    plan = plans.queries()["a2_merge_ring_building"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # links, growth and unions
