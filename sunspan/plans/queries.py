"""Every registered operator bound to the star-schema tables, with its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunspan.functions import scalars  # noqa: F401  registers its operators
from sunspan.operators import buildings, graph, horizon, images, kernels, layout, polygons, raster, relational, roofs, shade, stitching  # noqa: F401
from sunspan.operators._sql import OPERATORS, SqlOperator, ansi, spark_text
from sunspan.plans.bindings import BINDINGS, TABLES

#: Bindings that the two engines spell differently.
SPARK_ONLY = {"numbers": "SELECT id AS n FROM range(200)"}
DUCK_ONLY = {"numbers": "SELECT range AS n FROM range(200)"}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation over the tables of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_ONLY.get(name) or BINDINGS[name]
    used = [t for t in (*TABLES, "numbers") if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(spark_text(text), **{t: bind(spark, sf_dir, t) for t in used})


def _query(op: SqlOperator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(**{k: bind(spark, sf_dir, k) for k in op.inputs})


def _oracle(op: SqlOperator) -> str:
    names = sorted((k for k in op.inputs if k not in TABLES), key=lambda k: k != "numbers")  # others may read numbers
    ctes = [f"{k} AS ({DUCK_ONLY.get(k) or ansi(BINDINGS[k])})" for k in names]
    body = op.sql()
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body if not body.lstrip().upper().startswith("WITH") else f"WITH {', '.join(ctes)}, {body.lstrip()[4:]}" if ctes else body


def _ctes(*names: str) -> str:
    return ", ".join(f"{k} AS ({DUCK_ONLY.get(k) or ansi(BINDINGS[k])})" for k in names)


def _links(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(spark_text(text), **{n: bind(spark, sf_dir, n) for n in names})


def g1_select_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = bind(spark, sf_dir, "faces")
    return graph.select_connected(faces, relational.adjacency(faces=faces))


def g2_coplanar_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(relational.coplanar(faces=bind(spark, sf_dir, "faces"))).withColumnRenamed("id", "face_id")


def g3_grouped_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grouped_lattices(layout.lattices(bind(spark, sf_dir, "faces")))


def g4_tileset_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk_tree(_links(spark, sf_dir, TREE, "orders"), 1)


def g5_sibling_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = bind(spark, sf_dir, "faces")
    return graph.expand_siblings(faces, faces.where("building_id = 100").select("building_id"))


def g6_cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_links(spark, sf_dir, raster.CELL_LINKS, "cells", "numbers")).withColumnRenamed("id", "cell")


def g7_merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.merge_detections(bind(spark, sf_dir, "detections"))


def g8_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.deduplicate(bind(spark, sf_dir, "detections"))


def a1_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.union_area(bind(spark, sf_dir, "faces"))


def a4_fit_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.fit_plane(raster.clean_raster_input(bind(spark, sf_dir, "cells")))


def a26_roof_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.group_triangles(bind(spark, sf_dir, "vectors"))


def p22_bounded_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.simplify_rings(bind(spark, sf_dir, "vectors"))


def p5_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.alignments(bind(spark, sf_dir, "vectors"))


def ring_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with rings and slopes."""
    ring = F.array(*(F.array(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    steep = lambda f: -F.tan(F.radians("pitch")) * f(F.radians("azimuth"))
    faces = bind(spark, sf_dir, "faces")
    return faces.select("*", F.array(ring).alias("rings"), steep(F.sin).alias("slope_x"), steep(F.cos).alias("slope_y"))


def roof_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thing of a square metre on every third face; every fourth of them is a plant."""
    kind = F.when(F.col("s") % 4 == 0, "existing_pv").when(F.col("s") % 4 == 1, "chimney").when(F.col("s") % 16 == 2, "rwa").otherwise("skylight")
    corner = lambda x, y: F.array(F.col("x0") + 2 + x, F.col("y0") + 0.5 + y)
    square = F.array(*(corner(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    return bind(spark, sf_dir, "faces").where("pk % 3 = 0").select("building_id", (F.col("building_id") * 16 + F.col("part_no")).alias("object_id"), kind.alias("kind"), square.alias("ring"))


def k6_roof_analysis(spark: SparkSession, sf_dir: str, panels: bool = True) -> DataFrame:
    return roofs.analyse_roofs(ring_faces(spark, sf_dir), roof_objects(spark, sf_dir), panels=panels)


def k12_validate_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roofs.validate_placement(k6_roof_analysis(spark, sf_dir))


def a10_building_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roofs.building_assessment(k6_roof_analysis(spark, sf_dir, panels=False))


def a11_official_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = bind(spark, sf_dir, "faces").select("building_id", (F.col("area") / F.cos(F.radians("pitch"))).alias("area_m2"), F.col("official_kwh").alias("kwh"))
    return roofs.official_comparison(k6_roof_analysis(spark, sf_dir, panels=False), official)


def k9_map_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roofs.overlay(ring_faces(spark, sf_dir), k6_roof_analysis(spark, sf_dir), roof_objects(spark, sf_dir))


def j1_ring_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roofs.ring_links(ring_faces(spark, sf_dir))


def a2_merge_ring_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = ring_faces(spark, sf_dir)
    return roofs.merge_building(faces, graph.select_connected(faces, roofs.ring_links(faces)))


TREE = """SELECT o_orderkey AS id, CASE WHEN o_orderkey = 1 THEN NULL ELSE CAST(floor(o_orderkey / 3e0) AS BIGINT) END AS parent, o_orderkey % 7 <> 5 AS covers FROM {orders}"""

def a27_join_coplanar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roofs.join_coplanar(ring_faces(spark, sf_dir))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of captures as their detections would look: brown roofs, blue fields with frame lines, and dark windows."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes of boxes are much work, and would be put together
    held = bind(spark, sf_dir, "detections").repartition(tasks, "capture_id").groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "kind", "x0", "y0", "x1", "y1"))).alias("things"))
    size, ppm = (272, 200), 4.0
    around = [[2.0, 2.0], [size[0] - 3.0, 2.0], [size[0] - 3.0, size[1] - 3.0], [2.0, size[1] - 3.0]]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, things in zip(b.column("capture_id").to_pylist(), b.column("things").to_pylist(), strict=True):
                r = np.random.default_rng(capture or 0)
                image = np.array([150.0, 140.0, 132.0]) + r.normal(0, 4, (size[1], size[0], 3))
                for t in [t for t in things if t["kind"] in ("existing_pv", "skylight")][:12]:
                    x0, y0, x1, y1 = (int(t[c] * ppm) for c in ("x0", "y0", "x1", "y1"))
                    patch = image[y0:y1, x0:x1]
                    patch[:] = ((95.0, 105.0, 140.0) if t["kind"] == "existing_pv" else (98.0, 101.0, 118.0)) + r.normal(0, 3, patch.shape)
                    if t["kind"] == "existing_pv":
                        patch[::5] -= 45
                        patch[:, ::5] -= 45
                rgb = np.clip(image, 0, 255).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_pydict({"capture_id": pa.array([capture], pa.int64()), "width": pa.array([size[0]], pa.int32()), "height": pa.array([size[1]], pa.int32()), "rgb": [rgb], "ppm": [ppm]})

    made = held.mapInArrow(draw, "capture_id long, width int, height int, rgb binary, ppm double")
    return made.withColumn("roof", F.array(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in around))))


def i1_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.detect_obstacles(bind(spark, sf_dir, "cells"))


def i3_pv_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.detect_solar_fields(captures(spark, sf_dir)).drop("rings")


def i5_rooflights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.detect_roof_windows(captures(spark, sf_dir)).drop("rings")


def face_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon.sun_access(bind(spark, sf_dir, "roof_samples"), bind(spark, sf_dir, "heights"), step=16.0)


def k4_face_sunlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon.face_sunlight(face_access(spark, sf_dir))


def k3_face_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return horizon.sunlight_exclusions(face_access(spark, sf_dir))


#: What is seen of each detection in a view: the part inside, where this is a fifth of it or more.
SEEN = """SELECT capture_id, view_no, object_id, kind, confidence, x0 - x AS x0, y0 - y AS y0, x1 - x AS x1, y1 - y AS y1 FROM (
    SELECT d.capture_id, v.view_no, d.object_id, d.kind, d.confidence, v.x, v.y, greatest(d.x0 * 20, v.x) AS x0, greatest(d.y0 * 20, v.y) AS y0, least(d.x1 * 20, v.x + v.w) AS x1, least(d.y1 * 20, v.y + v.h) AS y1,
           (d.x1 - d.x0) * (d.y1 - d.y0) * 400e0 AS whole FROM {detections} d JOIN {views} v ON d.capture_id = v.capture_id) t WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 0.2e0 * whole"""


def g7_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = stitching.views_of(bind(spark, sf_dir, "view_captures"))
    return stitching.stitch(spark.sql(SEEN, detections=bind(spark, sf_dir, "detections"), views=views), views)


#: The same over all pairs of a capture, with views from lists.
_STITCHED = f"""WITH RECURSIVE {_ctes("detections", "view_captures")},
views AS (SELECT row_number() OVER () AS view_no, * FROM ({stitching.views.oracle.strip()}) l),
moved AS (SELECT row_number() OVER () AS id, s.capture_id, s.object_id, s.kind, s.confidence, s.x0 + v.x AS x0, s.y0 + v.y AS y0, s.x1 + v.x AS x1, s.y1 + v.y AS y1
          FROM ({SEEN.format(detections="detections", views="views")}) s JOIN views v ON v.capture_id = s.capture_id AND v.view_no = s.view_no),
links AS (SELECT a.id AS a, b.id AS b FROM moved a JOIN moved b ON a.capture_id = b.capture_id AND a.kind = b.kind AND a.id < b.id
          WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))),
reach(id, other) AS (SELECT id, id FROM moved UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.other),
groups AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT capture_id, min(object_id) AS object_id, kind, max(confidence) AS confidence, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM moved m JOIN groups g ON g.id = m.id GROUP BY capture_id, kind, component"""

ROOFS = (g7_stitched, k4_face_sunlight, k3_face_exclusions, a27_join_coplanar, i1_obstacles, i3_pv_field, i5_rooflights, k6_roof_analysis, k12_validate_placement, a10_building_assessment, a11_official_comparison, k9_map_overlay, j1_ring_links, a2_merge_ring_building)
CODE = {f.__name__: f for f in (*ROOFS, g1_select_connected, g2_coplanar_components, g3_grouped_panels, g4_tileset_walk, g5_sibling_fixpoint, g6_cell_components, g7_merge_detections, g8_deduplicate, a1_union_area, a4_fit_plane, a26_roof_faces, p22_bounded_simplify, p5_alignment)}

REACH = """reach(id, other) AS (SELECT a, a FROM links UNION SELECT b, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.other)"""
CODE_SQL = {
    "g7_stitched": _STITCHED,
    "g2_coplanar_components": f"WITH RECURSIVE {_ctes('faces')}, links AS ({ansi(relational.coplanar.text).format(faces='faces')}), {REACH} SELECT id AS face_id, min(other) AS component FROM reach GROUP BY id",
    "g4_tileset_walk": f"WITH RECURSIVE n AS ({TREE.format(orders='orders')}), w(id, level) AS (SELECT id, 0 FROM n WHERE id = 1 AND covers UNION ALL SELECT n.id, w.level + 1 FROM n JOIN w ON n.parent = w.id WHERE n.covers AND w.level < 24) SELECT id, level FROM w",
    "g6_cell_components": f"WITH RECURSIVE {_ctes('cells', 'numbers')}, links AS ({ansi(raster.CELL_LINKS).format(cells='cells', numbers='numbers')}), {REACH} SELECT id AS cell, min(other) AS component FROM reach GROUP BY id",
    "a1_union_area": f"WITH {_ctes('faces')} SELECT building_id, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT building_id, cx, cy FROM ({ansi(relational.FACE_CELLS).format(faces='faces')}) c) t GROUP BY building_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(op) for name, op in OPERATORS.items()} | CODE


def oracles() -> dict[str, str]:
    return {name: _oracle(op) for name, op in OPERATORS.items()} | CODE_SQL
