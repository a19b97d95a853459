"""Steps whose rows have to stay few on large tables, against plain loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from sunspan.operators import buildings, images, layout, relational, rings
from sunspan.plans import queries as plans


def test_cells_of_piles_are_counted_without_being_made(spark, tiny):
    """Piles of boxes that cover each other partly, wholly and from many sides; no cell is shuffled or grouped."""
    rng = np.random.default_rng(5)
    low = rng.integers(-4, 4, (60, 2)) + rng.choice([0.0, 0.3, 0.5], (60, 2))
    side = rng.choice([0.0, 0.4, 1.0, 3.5, 7.0, 9.0], (60, 2))
    rows = [(int(i // 12), int(i % 12), f"{i // 12}:{i % 12}", float(rng.integers(0, 4)) if i % 7 else None, *map(float, low[i]), *map(float, low[i] + side[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "building_id long, part_no long, face_id string, z double, x0 double, y0 double, x1 double, y1 double")
    cells = {}
    for building, part, face, z, x0, y0, x1, y1 in rows:
        for x in range(math.floor(x0 + 0.5), math.ceil(x1 - 0.5)):
            for y in range(math.floor(y0 + 0.5), math.ceil(y1 - 0.5)):
                cells.setdefault((building, x, y), []).append((z is None, -(z or 0.0), part, face))
    top = {k: min(v)[3] for k, v in cells.items()}
    assert max(map(len, cells.values())) > 3
    assert {(r.building_id, r.cx, r.cy): r.face_id for r in relational.upper_face(faces=df).collect()} == top
    assert relational.upper_face(faces=df).count() == len(top)
    assert {r.face_id: r.visible for r in relational.topmost(faces=df).collect()} == dict(Counter(top.values()))
    assert {r.building_id: r.cells for r in buildings.footprint(faces=df).collect()} == dict(Counter(k[0] for k in top))
    assert relational.topmost(faces=df.limit(0)).collect() == [] == buildings.footprint(faces=df.limit(0)).collect()
    for name in ("a28_footprint_cells", "w2_upper_face_wins", "w3_topmost_area"):
        plan = plans.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Generate" in plan) == (name == "w2_upper_face_wins") and not any("cx" in line for line in plan.splitlines() if "Aggregate" in line or "Window" in line), name


def test_packing_by_batches_equals_the_expression_of_a_row(spark, tiny):
    """Boxes of all sizes, empty and turned ones, unknown ones and those with an obstacle; modules and pairs too."""
    rng = np.random.default_rng(3)
    low, side = rng.uniform(-50, 50, (300, 2)).round(2), rng.choice([-1.0, 0.0, 0.61, 1.734, 1.8, 2.4, 4.112, 7.5, 11.0, 33.3], (300, 2))
    rows = [(f"f{i}", *map(float, low[i]), *map(float, low[i] + side[i]), None if i % 13 == 0 else i) for i in range(300)] + [("none", None, 0.0, 9.0, 9.0, 1)]
    df = spark.createDataFrame(rows, "face_id string, x0 double, y0 double, x1 double, y1 double, pk long")
    want = spark.sql(layout._CHOSEN, faces=df).orderBy("face_id").collect()
    got = layout.fitted(df, "face_id", lattice=True).where("panels > 0").orderBy("face_id").collect()
    assert [(r.face_id, r.panels, r.col.n, r.col.met, r.col.start, r.line.n, r.line.met, r.line.start) for r in got] == [(r.face_id, r.panels, r.col.n, r.col.met, r.col.start, r.line.n, r.line.met, r.line.start) for r in want]
    assert len(want) > 100 and any(r.col.met and r.line.met for r in want)
    both = [sorted(map(repr, d.collect())) for d in (layout.lattices(df), spark.sql(layout.LATTICES, faces=df))]
    assert both[0] == both[1]
    faces = plans.bind(spark, tiny, "faces")
    for name in ("k2_optimise_panels", "k2_panels", "k6_face_loop", "k7_demand_allocation", "k8_objective_comparison", "m1_roof_potential"):
        plan = plans.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") <= 2 and "MapInArrow" in plan and "lambdafunction" not in plan, name  # the join of the binding, and of two objectives
    assert layout.optimise(faces=faces.limit(0)).collect() == []


def test_captures_travel_by_the_hundred(spark, tiny):
    """Large pixels do not meet in one batch of Arrow, and each capture is looked at once."""
    for name in ("i3_pv_field", "i5_rooflights"):
        plan = plans.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython") == 1 and plan.count("MapInArrow") == 1, name  # the latter draws, a capture in a batch


def test_outlines_of_parts_anywhere_are_those_of_the_whole_frame():
    rng = np.random.default_rng(2)
    for _ in range(20):
        small = rng.random((7, 9)) < 0.7
        top, left = rng.integers(0, 20, 2)
        frame = np.zeros((40, 40), dtype=bool)
        frame[top : top + 7, left : left + 9] = small
        got, want = images.outlines(frame, 0.1, 500), images.outlines(small, 0.1, 500)
        assert [r.tolist() for r in got] == [(r + [left, top]).tolist() for r in want]
        assert sum(rings.signed_area(r) for r in got) in (small.sum(), -small.sum())
    assert images.outlines(np.zeros((4, 4), dtype=bool), 1.0, 9) == []


def test_objects_of_a_capture_meet_in_one_shuffle(spark, tiny):
    plan = plans.queries()["g7_stitched"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "moved-" not in plan and "labels-" not in plan


def test_half_metre_cells_are_counted_by_columns_and_rows(spark, tiny):
    plan = plans.queries()["k1_usable_cells"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    df = spark.createDataFrame([("a", 0.5, 1.0, 7.0, 6.5), ("b", 0.0, 0.0, 0.0, 4.0), ("c", -3.0, -2.0, -1.0, 2.0), ("a", 0.0, 0.0, 1.0, 1.0), ("n", None, 0.0, 1.0, 1.0)], "face_id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.face_id: r[1:] for r in relational.usable_cells(faces=df).collect()}
    want = {}
    for f, x0, y0, x1, y1 in (r for r in df.collect() if r.x0 is not None):
        for cx in range(int(x0 * 2), int(x1 * 2)):
            for cy in range(int(y0 * 2), int(y1 * 2)):
                x, y = cx * 0.5 + 0.25, cy * 0.5 + 0.25
                edge = x < x0 + 0.3 or x > x1 - 0.3 or y < y0 + 0.3 or y > y1 - 0.3
                met = x0 + 2 - 0.4 <= x <= x0 + 3 + 0.4 and y0 + 1 - 0.4 <= y <= y0 + 2 + 0.4
                c = want.setdefault(f, [0, 0, 0, 0])
                c[0] += 1
                c[1 if edge else 2 if met else 3] += 1
    assert got == {f: tuple(c) for f, c in want.items()}
