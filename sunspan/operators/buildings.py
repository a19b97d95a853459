"""Operators over whole buildings: measured models, footprints, merged outlines, the face loop and the two smaller entry points."""

from __future__ import annotations

from sunspan.operators._sql import ansi, operator
from sunspan.operators.layout import packed
from sunspan.operators.relational import ASSESSED, BOXED, FACE_CELLS, OX, OY, uncovered

VERTICES = """SELECT l_orderkey AS batch, l_partkey * 3 + n AS vertex_id, CAST((l_partkey * 7 + n * 5) % 19 AS DOUBLE) AS vx, CAST((l_suppkey * 3 + n * 11) % 17 AS DOUBLE) AS vy, CAST((l_partkey + n) % 5 AS DOUBLE) AS vz, l_linenumber AS triangle, n AS corner
FROM {lineitem} l EACH(n, CAST(0 AS BIGINT), CAST(2 AS BIGINT))"""
TRIANGLES = f"""SELECT batch, triangle, min(vertex_id) AS first_vertex, max(CASE WHEN corner = 0 THEN vx END) AS ax, max(CASE WHEN corner = 0 THEN vy END) AS ay, max(CASE WHEN corner = 0 THEN vz END) AS az,
    max(CASE WHEN corner = 1 THEN vx END) AS bx, max(CASE WHEN corner = 1 THEN vy END) AS by_, max(CASE WHEN corner = 1 THEN vz END) AS bz,
    max(CASE WHEN corner = 2 THEN vx END) AS cx, max(CASE WHEN corner = 2 THEN vy END) AS cy, max(CASE WHEN corner = 2 THEN vz END) AS cz
FROM ({VERTICES}) v GROUP BY batch, triangle"""
gather_triangles = operator("j20_gather_triangles", "lineitem", f"SELECT batch, CAST(triangle AS BIGINT) AS triangle, ax, ay, az, bx, by_, bz, cx, cy, cz FROM ({TRIANGLES}) t")
building_at = operator("s23_building_at", "faces", "SELECT building_id, face_id, footprint FROM (SELECT building_id, face_id, bround(area, 4) AS footprint, row_number() OVER (PARTITION BY building_id ORDER BY CASE WHEN x0 - 1.5e0 <= 12e0 AND x1 + 1.5e0 >= 12e0 THEN 0 ELSE 1 END, area, part_no) AS rn FROM {faces}) t WHERE rn = 1")
paged = operator("s15_paged_superstructures", "detections", "SELECT CAST(floor(object_id / 4000e0) AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n, min(object_id) AS first_id, max(object_id) AS last_id FROM {detections} GROUP BY CAST(floor(object_id / 4000e0) AS BIGINT)")
public_sunlight = operator("p19_public_sunlight", "vectors", "SELECT id, month, bround(sun_deg, 3) AS sun_deg FROM {vectors}")
drawn_plane = operator("p20_drawn_plane", "faces", "SELECT face_id, CASE WHEN area >= 1 THEN face_id END AS accepted, CASE WHEN area < 1 THEN 'too_small' END AS problem FROM {faces}")
valid_polygon = operator("p21_polygon_from_points", "detections", "SELECT object_id, (x1 - x0) * (y1 - y0) >= 4 AND x1 > x0 AND y1 > y0 AS valid FROM {detections}")
footprint_member = operator("f14_footprint_membership", "faces", "SELECT a.face_id FROM {faces} a WHERE (least(a.x1, 30e0) - greatest(a.x0, 0e0)) * (least(a.y1, 8e0) - greatest(a.y0, 0e0)) >= greatest(0.25e0, 0.6e0 * a.area) AND least(a.x1, 30e0) > greatest(a.x0, 0e0) AND least(a.y1, 8e0) > greatest(a.y0, 0e0)")
retained = operator("f15_object_retention", "detections faces", f"SELECT a.object_id FROM {{detections}} a LEFT JOIN {{faces}} b ON a.building_id = b.building_id GROUP BY a.object_id, a.source HAVING a.source = 'map' OR max(CASE WHEN {OX} > 0 AND {OY} > 0 THEN {OX} * {OY} ELSE 0e0 END) > 1")
confidence_order = operator("f21_manual_first", "detections", "SELECT capture_id, object_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY CASE WHEN kind = 'existing_pv' THEN 0 WHEN source = 'manual' THEN 1 ELSE 2 END, object_id) AS BIGINT) AS place FROM {detections}")
merged_building = operator(
    "a2_merge_building", "faces",
    """SELECT building_id, bround(max(x1) - min(x0), 4) AS width, bround(max(y1) - min(y0), 4) AS depth, CASE WHEN sum(area) >= max(CASE WHEN contains_click THEN area ELSE 0e0 END) THEN 'union' ELSE 'anchor' END AS outline,
              CAST(count(*) AS BIGINT) AS members, CASE WHEN count(*) = 1 THEN max(pitch) END AS pitch FROM {faces} GROUP BY building_id""",
)
#: The cells of a building are those that each face adds to the ones before it.
footprint = operator(
    "a28_footprint_cells", "faces", f"SELECT building_id, CAST(sum(cells) AS BIGINT) AS cells FROM (SELECT building_id, {uncovered('0L')} AS cells FROM ({BOXED}) f) c GROUP BY building_id",
    oracle=ansi(f"SELECT building_id, CAST(count(*) AS BIGINT) AS cells FROM (SELECT DISTINCT building_id, cx, cy FROM ({FACE_CELLS}) c) t GROUP BY building_id"),
)
face_loop = packed(
    "k6_face_loop",
    """SELECT building_id, face_id, status, panels AS physical, CASE WHEN status = 'not_recommended' OR panels < 4 THEN CAST(0 AS BIGINT) ELSE panels END AS recommended,
               bround(CASE WHEN status = 'not_recommended' OR panels < 4 THEN 0e0 ELSE panels * 0.45e0 END, 3) AS kwp,
               CASE WHEN status = 'not_recommended' OR panels < 4 THEN CAST(0 AS BIGINT) ELSE CAST(bround(panels * 0.45e0 * irradiation * 0.8e0, 0) AS BIGINT) END AS kwh
        FROM {assessed}""",
    joined=f"""SELECT f.building_id, f.face_id, f.status, b.panels AS physical, CASE WHEN f.status = 'not_recommended' OR b.panels < 4 THEN CAST(0 AS BIGINT) ELSE b.panels END AS recommended,
               bround(CASE WHEN f.status = 'not_recommended' OR b.panels < 4 THEN 0e0 ELSE b.panels * 0.45e0 END, 3) AS kwp,
               CASE WHEN f.status = 'not_recommended' OR b.panels < 4 THEN CAST(0 AS BIGINT) ELSE CAST(bround(b.panels * 0.45e0 * f.irradiation * 0.8e0, 0) AS BIGINT) END AS kwh
        FROM ({ASSESSED}) f JOIN (<BEST>) b ON b.face_id = f.face_id""",
)
upload = operator("k10_upload_analyse", "detections", "SELECT capture_id, bround(ppm, 6) AS ppm, CAST(floor(w / ppm / 1.154e0) * floor(h / ppm / 1.782e0) AS BIGINT) AS panels, TRUE AS approximate FROM (SELECT capture_id, (max(x1) - min(x0)) / 12e0 AS ppm, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM {detections} GROUP BY capture_id) t")
capture_document = operator("k13_capture_summary", "faces plants detections", "SELECT f.building_id, f.faces, f.area, coalesce(d.objects, 0) AS objects, coalesce(p.plants, 0) AS plants FROM (SELECT building_id, max(egid) AS egid, CAST(count(*) AS BIGINT) AS faces, bround(sum(area), 2) AS area FROM {faces} GROUP BY building_id) f LEFT JOIN (SELECT building_id, CAST(count(*) AS BIGINT) AS objects FROM {detections} GROUP BY building_id) d ON d.building_id = f.building_id LEFT JOIN (SELECT egid, CAST(count(*) AS BIGINT) AS plants FROM {plants} GROUP BY egid) p ON p.egid = f.egid")
