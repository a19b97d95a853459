"""Every operator with SQL against DuckDB, golden scalars, invariants and hand-made cases."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sunspan.functions import scalars
from sunspan.operators import graph, kernels, layout, relational, shade
from sunspan.operators._sql import ansi
from sunspan.plans import pipeline
from sunspan.plans import queries as plans
from sunspan.plans.bindings import TABLES
from sunspan.sources import files
from sunspan.streaming import feed


@pytest.fixture(scope="session")
def duck(tiny):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_operator_equals_duckdb(spark, tiny, duck, name):
    got = plans.queries()[name](spark, tiny)
    columns = sorted(got.columns)
    cursor = duck.execute(plans.oracles()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))


def test_queries_without_sql_have_rows(spark, tiny):
    for name in sorted(plans.queries().keys() - plans.oracles().keys()):
        assert plans.queries()[name](spark, tiny).limit(1).count() == 1, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_shared_texts_are_translated():
    assert ansi("bround(f(x), 2) / 2") == "(0e0 + round_even(f(x), 2)) / 2"
    assert ansi("regexp_replace(a, '<[^>]+>', '')").endswith("'g')")
    with pytest.raises(TypeError):
        relational.assess_face(other=None)


@pytest.mark.parametrize(("text", "kw"), [("5.25 kW", 5.25), ("1.4 MW", 1400.0), ("12,5 kW", 12.5), ("unknown", None), ("1.2.3 kW", None), (None, None)])
def test_power_text(spark, text, kw):
    df = spark.createDataFrame([(1, text)], "plant_id long, power_text string")
    assert scalars.parse_power(plants=df).first().power_kw == kw


@pytest.mark.parametrize(("text", "ok"), [("31.02.2020", False), ("01.03.2020", True), ("01.03.1820", False), ("1.3.2020", False), (None, False)])
def test_swiss_date(spark, text, ok):
    df = spark.createDataFrame([(1, text)], "id long, date_text string")
    assert (scalars.swiss_date(texts=df).first().day is not None) == ok


@pytest.mark.parametrize("text", ["NaN", "Infinity", "-Infinity", "abc", "", None])
def test_no_number(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, v string")
    assert scalars.number(texts=df).first().number is None


def test_capacity_and_unknown_energy(spark):
    df = spark.createDataFrame([(1, 20, None), (2, 20, 1000.0)], "id long, n_panels long, yield_kwh double")
    assert [(r.kwp, r.kwh) for r in scalars.capacity(vectors=df).orderBy("id").collect()] == [(9.0, None), (9.0, 9000)]


def faces(spark, boxes, **extra):
    rows = []
    for n, box in enumerate(boxes, 1):
        x0, y0, x1, y1 = map(float, box)
        row = dict(building_id=20, part_no=n, face_id=f"20:{n}", x0=x0, y0=y0, x1=x1, y1=y1, w=x1 - x0, h=y1 - y0, area=(x1 - x0) * (y1 - y0), z=400.0, pitch=30.0, aspect=0.0, azimuth=180.0,
                   irradiation=1200.0, egid=7, contains_click=n == 1, anchor="measured", conflict=False, area_disagreement=0.0, coverage=1.0, official_kwh=1.0, s=1, pk=1)
        rows.append(row | {k: v[n - 1] for k, v in extra.items()})
    schema = "building_id long, part_no int, face_id string, x0 double, y0 double, x1 double, y1 double, w double, h double, area double, z double, pitch double, aspect double, azimuth double, irradiation double, egid long, contains_click boolean, anchor string, conflict boolean, area_disagreement double, coverage double, official_kwh double, s long, pk long"
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)


def test_traversal_gives_every_face_a_reason(spark):
    df = faces(spark, [(0, 0, 5, 5), (5, 0, 10, 5), (10, 0, 15, 5), (30, 0, 35, 5), (4, 4, 9, 9)], egid=[7, None, 7, 7, 8])
    rows = {r.face_id: (r.accepted, r.reason) for r in graph.select_connected(df, relational.adjacency(faces=df)).collect()}
    assert rows == {"20:1": (True, "anchor"), "20:2": (True, "linked"), "20:3": (True, "linked"), "20:4": (False, "apart"), "20:5": (False, "other_identity")}
    assert pipeline.prepare(df).count() == 3


def test_coplanar_strips_are_one_component(spark):
    df = faces(spark, [(0, 0, 6.5, 1.6), (0, 1.6, 6.5, 3.2), (0, 3.2, 6.5, 4.8), (0, 4.8, 6.5, 6.4)], azimuth=[180.0, 180.0, 182.0, 20.0])
    found = graph.components(relational.coplanar(faces=df)).collect()
    assert {(r.id, r.component) for r in found} == {("20:1", "20:1"), ("20:2", "20:1"), ("20:3", "20:1")}


@pytest.mark.parametrize(
    ("change", "status"),
    [({}, "suitable"), ({"anchor": ["projected_2d"]}, "not_recommended"), ({"pitch": [66.0]}, "not_recommended"), ({"azimuth": [350.0]}, "not_recommended"), ({"irradiation": [None]}, "needs_review"), ({"irradiation": [700.0]}, "not_recommended"),
     ({"coverage": [None]}, "needs_review"), ({"coverage": [0.9]}, "needs_review"), ({"area_disagreement": [0.3]}, "not_recommended")],
)
def test_suitability(spark, change, status):
    row = relational.assess_face(faces=faces(spark, [(0, 0, 10, 10)], **change)).first()
    assert (row.status, row.eligible) == (status, status != "not_recommended")


def test_modules_lie_inside_and_apart(spark):
    df = faces(spark, [(0, 0, 10, 8), (20, 0, 28, 6)], pk=[3, 1])
    rows = layout.panels(faces=df).collect()
    best = {r.face_id: r for r in layout.optimise(faces=df).collect()}
    for face, (x0, y0, x1, y1), obstacle in (("20:1", (0, 0, 10, 8), (2, 1, 3, 2)), ("20:2", (20, 0, 28, 6), None)):
        w, h = (1.134, 1.762) if best[face].orientation == "portrait" else (1.762, 1.134)
        mine = [(r.x, r.y) for r in rows if r.face_id == face]
        assert len(mine) == best[face].panels > 4
        for n, (x, y) in enumerate(mine):
            assert x0 + 0.3 - 1e-4 <= x and x + w <= x1 - 0.3 + 1e-4 and y0 + 0.3 - 1e-4 <= y and y + h <= y1 - 0.3 + 1e-4
            assert all(abs(x - a) >= w - 1e-4 or abs(y - b) >= h - 1e-4 for a, b in mine[:n])
            if obstacle:
                assert x + w <= obstacle[0] - 0.4 + 1e-4 or x >= obstacle[2] + 0.4 - 1e-4 or y + h <= obstacle[1] - 0.4 + 1e-4 or y >= obstacle[3] + 0.4 - 1e-4
    out = pipeline.analyse(df, limit=best["20:1"].panels + 2).orderBy("face_id").collect()
    assert [r.placed for r in out] == [best["20:1"].panels, 2]


def test_arrays_are_ordered_and_small_ones_dropped(spark):
    panels = spark.createDataFrame([("f", i, j) for i, j in [(0, 0), (0, 1), (1, 0), (1, 1), (5, 5), (9, 9), (9, 10), (9, 11), (9, 12), (10, 12)]], "face_id string, i long, j long")
    links = spark.createDataFrame([("f", 0, 0, 0, 1), ("f", 0, 0, 1, 0), ("f", 1, 0, 1, 1), ("f", 9, 9, 9, 10), ("f", 9, 10, 9, 11), ("f", 9, 11, 9, 12), ("f", 9, 12, 10, 12)], "face_id string, ai long, aj long, bi long, bj long")
    rows = graph.grouped_panels(panels, links).orderBy("array_no", "place").collect()
    assert [(r.array_no, r.i, r.j) for r in rows] == [(0, 9, 9), (0, 9, 10), (0, 9, 11), (0, 9, 12), (0, 10, 12), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]


def test_consensus_fit_ignores_a_plant_room():
    y, x = np.mgrid[0:40, 0:40].astype(float)
    z = 500 + math.tan(math.radians(30)) * x + 0.2 * y
    z[5:22, 8:32] += 3
    fit = kernels.consensus_plane(x.ravel(), y.ravel(), z.ravel())
    assert abs(fit["slope_x"] - math.tan(math.radians(30))) < 1e-8 and abs(fit["slope_y"] - 0.2) < 1e-8 and fit["inliers"] == 1600 - 17 * 24
    assert kernels.consensus_plane(np.arange(5.0), np.arange(5.0), np.arange(5.0)) is None


def test_rings():
    square = np.array([(0, 0), (4, 0), (4, 3), (0, 3)], dtype=float)
    assert kernels.ring_area(square) == 12
    turn = np.array([[math.cos(0.5), -math.sin(0.5)], [math.sin(0.5), math.cos(0.5)]])
    angle, length, width = kernels.rotated_rectangle(square @ turn.T)
    assert (round(length, 6), round(width, 6)) == (4, 3) and abs(angle % 180 - math.degrees(0.5)) < 1e-6
    assert kernels.ring_area(kernels.clip_convex(square, np.array([(1, 1), (9, 1), (9, 9), (1, 9)], dtype=float))) == pytest.approx(6)
    assert kernels.covers_point(square, 1, 1) and not kernels.covers_point(square, 5, 1)
    line = np.array([(i / 100, 0.001 * (i % 2)) for i in range(401)])
    assert len(kernels.bounded_simplify(line)) == 2
    assert kernels.boxes_union_area(np.array([(0, 0, 2, 2), (1, 1, 3, 3)], dtype=float)) == 7
    assert len(kernels.convex_hull(np.array([(0, 0), (1, 1), (2, 2)], dtype=float))) == 2


def test_detections_merge_within_a_kind_only(spark):
    rows = [(1, 1, "existing_pv", "yolo", 0.9, 0.0, 0.0, 4.0, 4.0, None), (2, 1, "existing_pv", "image", 0.5, 1.0, 0.0, 5.0, 4.0, 1.0), (3, 1, "skylight", "image", 0.4, 1.0, 1.0, 2.0, 2.0, None), (4, 1, "skylight", "map", 0.3, 1.0, 1.0, 2.0, 2.0, 0.5), (5, 1, "chimney", "map", None, 5.0, 0.0, 6.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "object_id long, capture_id long, kind string, source string, confidence double, x0 double, y0 double, x1 double, y1 double, height_m double")
    merged = {r.object_id: (r.members, r.area) for r in kernels.merge_detections(df).collect()}
    assert merged == {1: (2, 20.0), 3: (2, 1.0), 5: (1, 1.0)}
    kept = {r.object_id: (r.sources, r.kinds, r.height_m) for r in kernels.deduplicate(df).collect()}
    assert kept == {1: ("image+yolo", "existing_pv+skylight", 1.0), 4: ("map", "skylight", 0.5), 5: ("map", "chimney", 2.0)}


def test_heights_of_joined_objects_may_be_unknown(spark):
    rows = [(i, 1, "chimney", "map", None, 0.0, 0.0, 2.0, 2.0, h) for i, h in enumerate([None, None, 1.0, None, 0.5])]
    rows += [(9, 2, "chimney", "map", None, 0.0, 0.0, 2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "object_id long, capture_id long, kind string, source string, confidence double, x0 double, y0 double, x1 double, y1 double, height_m double")
    got = {r.capture_id: r for r in kernels.deduplicate(df).collect()}
    assert got[1].height_m == 1.0 and got[1].area == 4.0 and got[2].height_m is None


def test_tree_walk_and_siblings(spark):
    tree = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 1, False), (4, 3, True), (5, 2, True)], "id long, parent long, covers boolean")
    assert {(r.id, r.level) for r in graph.walk_tree(tree, 1).collect()} == {(1, 0), (2, 1), (5, 2)}
    df = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12), (5, None)], "building_id long, egid long")
    assert {r.building_id for r in graph.expand_siblings(df, df.where("building_id = 1")).collect()} == {1, 2, 3}


def test_files(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    record = {"id": 5, "geometry": {"type": "MultiPolygon", "coordinates": [[ring, hole], [[[0, 0], [1, 1]]]]}, "properties": {"building_id": 9, "neigung": 30}}
    (tmp_path / "roofs.json").write_text(json.dumps([record]))
    row = files.read_features(spark, str(tmp_path / "roofs.json")).collect()
    assert [(r.face_id, r.area, r.x1, r.building_id) for r in row] == [("5:0", 11.0, 4.0, 9)]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text("0 0.1 0.2 0.3 0.4 0.5 0.6\nbroken\n0 1 2\n")
    labels = files.read_label_polygons(spark, str(tmp_path / "labels")).collect()
    assert [(r.file, len(r.points)) for r in labels] == [("a.txt", 3)]
    (tmp_path / "up").mkdir()
    (tmp_path / "up/x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(20))
    (tmp_path / "up/y.bin").write_bytes(b"nothing")
    assert {(r.kind, r.accepted) for r in files.read_images(spark, str(tmp_path / "up")).collect()} == {("png", True), (None, False)}
    boxes = spark.createDataFrame([("roof", "1", 0.0, 0.0, 1.0, 1.0)], "layer string, id string, x0 double, y0 double, x1 double, y1 double")
    assert json.loads(files.geojson_lines(boxes).first().value)["geometry"]["coordinates"][0][2] == [1.0, 1.0]


def test_pages_are_checked(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]

    def page(name, crs, n, more):
        features = [{"geometry": {"type": "Polygon", "coordinates": square}, "properties": {"EGID": str(i), "kind": "x"}} for i in range(n)]
        (tmp_path / name).write_text(json.dumps({"crs": {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{crs}"}}, "exceededTransferLimit": more, "features": features}))

    page("0.json", 2056, 3, True)
    page("1.json", 2056, 2, False)
    rows = files.read_pages(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r.egid for r in rows} == {0, 1, 2} and rows[0].rings == [[[float(v) for v in p] for p in square[0]]]
    with pytest.raises(ValueError):
        files.read_pages(spark, str(tmp_path), most=4)
    page("2.json", 4326, 1, False)
    with pytest.raises(Exception, match="coordinate system"):
        files.read_pages(spark, str(tmp_path))


def test_operators_take_settings(spark):
    df = faces(spark, [(0, 0, 10, 10), (20, 0, 30, 10)], irradiation=[700.0, 900.0])
    assert [r.status for r in relational.assess_face(faces=df).orderBy("face_id").collect()] == ["not_recommended", "suitable"]
    assert [r.status for r in relational.assess_face(faces=df, minimum_irradiation=600.0).orderBy("face_id").collect()] == ["suitable", "suitable"]
    assert [r.face_id for r in relational.identify_point(faces=df, x=25.0, y=5.0).collect()] == ["20:2"]
    assert relational.identify_envelope(faces=df, most=1, minx=0.0, maxx=40.0, miny=0.0, maxy=9.0).count() == 1
    assert layout.allocation(faces=df, most_panels=3).agg(F.sum("placed")).first()[0] == 3
    with pytest.raises(TypeError):
        relational.assess_face(faces=df, unknown=1)


def test_streams(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", feed.windowed_counts(stream), "append"), ("visits", feed.sessions(stream), "append"), ("latest", feed.latest_state(stream.withWatermark("ts", "2 hours"), 10**9), "update")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() > 0
    want = {r.user_id: r.v for r in spark.read.parquet(str(tmp_path / "in")).groupBy("user_id").agg(F.max_by("value", "ts").alias("v")).collect()}
    assert {r.user_id: r.value for r in spark.table("latest").collect()}.keys() == want.keys()


def test_rays_never_travel_as_rows(spark, tiny):
    """Heights are looked up where a tile's cells are; cells are made in many tasks and neither broadcast nor shuffled."""
    plan = plans.queries()["j15_ray_horizon"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "explode(sequence" not in plan.split("FlatMapCoGroups")[0]
    cells = plan.split("Generate explode")
    assert "Exchange" not in cells[1] and "REPARTITION_BY_NUM" in cells[2]


def test_tile_horizons_of_odd_rows(spark):
    """Repeated cells, tiles without cells, null places and null eyes count as they do where each point is joined."""
    samples = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.0), (2, 0, 0.5, 0.5, 0.0), (1, 1, None, 0.5, 0.0), (1, 2, 0.5, 0.5, None), (None, 0, 0.5, 0.5, 0.0)], "tile_id long, sample long, x double, y double, z double")
    terrain = spark.createDataFrame([(1, 0, 1, 5.0), (1, 0, 1, None), (1, 0, 1, 3.0), (None, 0, 1, 9.0)], "tile_id long, cx long, cy long, z double")
    got = {(r.tile_id, r.sample, r.bin): (r.horizon, r.coverage) for r in shade.tile_horizons(samples, terrain).collect()}
    assert len(got) == 5 * 144
    assert got[1, 0, 0] == (math.atan2(4.75, 0.5), 2 * 2 / (138 + 2 * 3))  # at .5 and 1 m
    assert {got[k, n, b] for k, n in ((2, 0), (1, 1), (None, 0)) for b in range(144)} == {(0.0, 0.0)}
    assert got[1, 2, 0] == (0.0, 4 / 144)


def test_modules_are_paired_and_grouped_in_place(spark, tiny):
    """One shuffle, of faces: a lattice tells its pairs and arrays; they are those of modules that are joined."""
    for name in ("j3_module_adjacency", "g3_grouped_panels"):
        plan = plans.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 1, name
    faces = plans.bind(spark, tiny, "faces").where("building_id < 60")
    want = graph.grouped_panels(layout.panels(faces=faces), layout.module_adjacency(faces=faces)).collect()
    got = graph.grouped_lattices(spark.sql(plans.spark_text(layout.LATTICES), faces=faces)).collect()
    assert sorted(got) == sorted(want) and len(want) > 500


def test_lattice_with_a_hole_from_side_to_side():
    """Two arrays, the larger first, and one that is too small left out."""
    rows = graph._lattice(5, 3, (2, 2, 0, 2), 4).tolist()
    assert [(i, j) for i, j, n, _ in rows if n == 0][0] == (0, 0) and {n for *_, n, _ in rows} == {0, 1} and len(rows) == 12
    assert len(graph._lattice(3, 3, (1, 1, 0, 2), 4)) == 0
