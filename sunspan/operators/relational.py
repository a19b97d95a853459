"""Filters, joins, aggregations, windows and set operations of the inventory over domain relations.

Where a predicate compares rows pairwise, an equality on the building, tile or grid bucket carries the join and the
exact predicate is what remains, so that Spark plans a hash or merge join and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sunspan.functions.scalars import POWER_KW, TILE_YEAR
from sunspan.operators._sql import ansi, operator

# --- scans and selections -------------------------------------------------------------------------------------------
identify_point = operator("s2_identify_point", "faces", "SELECT face_id, building_id FROM {faces} WHERE x0 <= :x AND x1 >= :x AND y0 <= :y AND y1 >= :y", x=12.0, y=3.0)
identify_envelope = operator("s3_identify_envelope", "faces", "SELECT face_id FROM {faces} WHERE x1 >= :minx - :around AND x0 <= :maxx + :around AND y1 >= :miny - :around AND y0 <= :maxy + :around ORDER BY building_id, part_no LIMIT :most", minx=20.0, miny=1.0, maxx=24.0, maxy=4.0, around=2.0, most=500)
find_by_attribute = operator("s4_find_by_attribute", "faces", "SELECT face_id, building_id, pitch, irradiation FROM {faces} WHERE building_id = :building ORDER BY part_no LIMIT :most", building=100, most=100)
address = operator(
    "s6_building_address", "faces plants",
    """SELECT building_id, plant_id AS address_id, distance FROM (
        SELECT f.building_id, p.plant_id, abs(f.x0 - p.plant_id % 30) AS distance,
               row_number() OVER (PARTITION BY f.building_id ORDER BY CASE WHEN f.egid IS NOT NULL AND f.egid = p.egid THEN 0 ELSE 1 END, abs(f.x0 - p.plant_id % 30), p.plant_id) AS rn
        FROM {faces} f JOIN {plants} p ON f.building_id = p.plant_id WHERE f.part_no <= 2) t WHERE rn = 1""",
)
search = operator("s7_search_locations", "pages", "SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '')) AS label FROM {pages} WHERE url IS NOT NULL ORDER BY page_id LIMIT 7",
    oracle="SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS label FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 7")
ORIGIN = "regexp_extract(asset_name, '_([0-9][0-9][0-9][0-9]-[0-9][0-9][0-9][0-9])', 1)"
newest_tiles = operator(
    "s8_newest_tiles", "tiles",
    f"""SELECT item_id, origin, asset_name FROM (
        SELECT item_id, asset_name, {ORIGIN} AS origin, row_number() OVER (PARTITION BY {ORIGIN} ORDER BY CASE WHEN taken_at IS NULL THEN 1 ELSE 0 END, taken_at DESC, item_id) AS rn
        FROM {{tiles}} WHERE media_type = 'image/tiff' AND asset_name LIKE '%.tif' AND locate('_0.5_', asset_name) > 0) t WHERE rn = 1""",
)
tile_origin = operator("s9_tile_origin", "tiles", f"SELECT item_id, CAST(substr({ORIGIN}, 1, 4) AS BIGINT) * 1000 AS east, CAST(substr({ORIGIN}, 6, 4) AS BIGINT) * 1000 AS north FROM {{tiles}}")
CLEAN = "CASE WHEN z < -100 OR z > 5000 THEN NULL ELSE z END"
mosaic = operator("s10_mosaic", "cells", f"SELECT row_no, col_no, bround(min_by(v, tile_id), 6) AS z FROM (SELECT tile_id, row_no, col_no, {CLEAN} AS v FROM {{cells}}) t WHERE v IS NOT NULL GROUP BY row_no, col_no")
clean_raster = operator("s11_clean_raster", "cells", f"SELECT tile_id, row_no, col_no, bround({CLEAN}, 6) AS z FROM {{cells}}")
surveyed = operator("s16_surveyed_polygons", "detections faces", "SELECT d.object_id, f.face_id, bround((least(d.x1, f.x1) - greatest(d.x0, f.x0)) * (least(d.y1, f.y1) - greatest(d.y0, f.y0)), 6) AS area FROM {detections} d JOIN {faces} f ON d.building_id = f.building_id WHERE least(d.x1, f.x1) > greatest(d.x0, f.x0) AND least(d.y1, f.y1) > greatest(d.y0, f.y0) AND (least(d.x1, f.x1) - greatest(d.x0, f.x0)) * (least(d.y1, f.y1) - greatest(d.y0, f.y0)) >= 0.15e0")
registered_pv = operator(
    "s17_registered_pv", "faces plants",
    """SELECT e.building_id, count(p.plant_id) > 0 AS known, CAST(count(p.plant_id) AS BIGINT) AS plants FROM (
        SELECT building_id, egid FROM (SELECT building_id, egid, row_number() OVER (PARTITION BY building_id ORDER BY egid) AS rn FROM (SELECT DISTINCT building_id, egid FROM {faces} WHERE egid > 0) d) t WHERE rn <= 4) e
        LEFT JOIN {plants} p ON p.egid = e.egid GROUP BY e.building_id""",
)
imagery_year = operator("s18_imagery_year", "texts", f"SELECT event_type, max(coalesce({TILE_YEAR.format('href')}, CAST(extract(YEAR FROM ts) AS INT))) AS year FROM {{texts}} GROUP BY event_type")
cache_prune = operator("s20_cache_prune", "tiles", "SELECT item_id FROM (SELECT item_id, sum(CAST(floor(bytes) AS BIGINT)) OVER (PARTITION BY media_type ORDER BY taken_at DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM {tiles} WHERE taken_at IS NOT NULL) t WHERE kept > 20000000")
attributes_for = operator("s24_attributes_for", "customer nation", "SELECT c_custkey AS batch, n_name AS value FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")

# --- predicates -----------------------------------------------------------------------------------------------------
usable_part = operator("f1_usable_part", "faces", "SELECT face_id FROM {faces} WHERE w > 0 AND h > 0 AND w * h >= 0.25e0")
public_candidate = operator("f2_public_candidate", "faces", "SELECT building_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY part_no) AS rn FROM {faces} WHERE area >= 2) t WHERE rn <= 48")
pv_category = operator("f3_pv_category", "plants", "SELECT plant_id FROM {plants} WHERE lower(trim(coalesce(category, ''))) = 'photovoltaic'")
roof_identity = operator("f4_identity_refused", "faces", "SELECT f.face_id FROM {faces} f JOIN (SELECT building_id, min(egid) AS known FROM {faces} WHERE part_no = 1 GROUP BY building_id) k ON k.building_id = f.building_id WHERE f.egid IS NOT NULL AND k.known IS NOT NULL AND f.egid <> k.known")

REASONS = """
SELECT *, CASE WHEN anchor = 'projected_2d' THEN 1 ELSE 0 END AS r_projected, CASE WHEN conflict THEN 1 ELSE 0 END AS r_conflict,
       CASE WHEN area_disagreement > 0.2e0 THEN 1 ELSE 0 END AS r_area, CASE WHEN pitch > 65 THEN 1 ELSE 0 END AS r_steep,
       CASE WHEN pitch >= 10 AND least(azimuth, 360e0 - azimuth) <= 35 THEN 1 ELSE 0 END AS r_north,
       CASE WHEN irradiation < :minimum_irradiation THEN 1 ELSE 0 END AS r_dim, CASE WHEN irradiation IS NULL THEN 1 ELSE 0 END AS c_irradiation,
       CASE WHEN coverage IS NULL THEN 'no_sunlight' WHEN anchor = 'approximate' THEN 'approximate_anchor' WHEN coverage < 0.98e0 THEN 'partial_coverage' END AS c_sun
FROM {faces}"""
ASSESSED_TEXT = f"""SELECT *, CASE WHEN r_projected + r_conflict + r_area + r_steep + r_north + r_dim > 0 THEN 'not_recommended'
       WHEN c_irradiation = 1 OR c_sun IS NOT NULL THEN 'needs_review' ELSE 'suitable' END AS status FROM ({REASONS}) r"""
#: For operators that take no setting.
ASSESSED = ASSESSED_TEXT.replace(":minimum_irradiation", "800e0")
assess_face = operator(
    "f5_assess_face", "faces",
    f"SELECT face_id, building_id, status, status <> 'not_recommended' AS eligible, r_projected, r_conflict, r_area, r_steep, r_north, r_dim, c_irradiation, c_sun FROM ({ASSESSED_TEXT}) a",
    minimum_irradiation=800.0,
)


def with_status(faces: DataFrame, minimum_irradiation: float) -> DataFrame:
    """``faces`` with status and eligible, without a join."""
    text = assess_face.set({"minimum_irradiation": minimum_irradiation}, f"SELECT *, status <> 'not_recommended' AS eligible FROM ({ASSESSED_TEXT}) a")
    return faces.sparkSession.sql(text, faces=faces)


obstacle_filter = operator("f6_obstacle_filter", "detections", "SELECT capture_id, object_id FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (x1 - x0) * (y1 - y0) DESC, object_id) AS rn FROM {detections} WHERE (x1 - x0) * (y1 - y0) >= 4 AND least(x1 - x0, y1 - y0) >= 0.7e0 AND height_m >= 0.35e0) t WHERE rn <= 40")
rooflight_filter = operator("f7_rooflight_filter", "detections", "SELECT capture_id, object_id FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (x1 - x0) * (y1 - y0) DESC, object_id) AS rn FROM {detections} WHERE (x1 - x0) * (y1 - y0) BETWEEN 0.25e0 AND 6e0 AND (x1 - x0) / (y1 - y0) BETWEEN 0.3e0 AND 3.4e0) t WHERE rn <= 60")
pv_gate = operator("f8_pv_field_gate", "detections", "SELECT capture_id, CASE WHEN dark >= 12 THEN 'covered' WHEN bright >= 5 AND bright - dark >= 14 AND share <= 0.92e0 THEN 'separated' ELSE 'none' END AS gate FROM (SELECT capture_id, bround(avg(CASE WHEN confidence < 0.5e0 THEN confidence * 40e0 END), 6) AS dark, bround(avg(CASE WHEN confidence >= 0.5e0 THEN confidence * 40e0 END), 6) AS bright, avg(CASE WHEN kind = 'existing_pv' THEN 1e0 ELSE 0e0 END) AS share FROM {detections} GROUP BY capture_id) t")
pv_component = operator("f9_pv_component", "detections", "SELECT capture_id, object_id FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (x1 - x0) * (y1 - y0) DESC, object_id) AS rn FROM {detections} WHERE kind = 'existing_pv' AND (x1 - x0) * (y1 - y0) >= 3 AND NOT (confidence < 0.1e0 AND height_m < 0.5e0)) t WHERE rn <= 30")
alignment_gate = operator("f10_alignment_acceptance", "vectors", "SELECT id, CASE WHEN value <= 50 THEN 'no_edges' WHEN height / 450e0 < 1.02e0 THEN 'no_gain' WHEN value < 0.35e0 * 490 THEN 'weak' WHEN n_panels IN (0, 59) THEN 'on_search_wall' ELSE 'accepted' END AS verdict FROM {vectors}")
measured_gate = operator("f13_measured_acceptance", "faces", "SELECT building_id, max(CASE WHEN x0 - 1.5e0 <= 12e0 AND x1 + 1.5e0 >= 12e0 AND y0 - 1.5e0 <= 3e0 AND y1 + 1.5e0 >= 3e0 THEN 1 ELSE 0 END) = 1 AS accepted FROM {faces} GROUP BY building_id")
override_owned = operator("f16_override_ownership", "overrides faces", "SELECT DISTINCT r.face_id FROM {overrides} r LEFT JOIN {faces} f ON r.face_id = f.face_id AND r.building_id = f.building_id WHERE f.face_id IS NULL")
capture_integrity = operator("f17_capture_integrity", "captures", "SELECT doc_id, length(text) = stored_chars AND sha2(text, 256) = stored_sha256 AND abs(ppm - stored_ppm) <= 1e-5 * stored_ppm AS intact FROM {captures}")
roof_triangles = operator("f18_roof_triangles", "vectors", "SELECT id FROM {vectors} WHERE 1e0 / sqrt(a * a + b * b + 1e0) >= 0.30e0")
colour_bins = operator("f19_colour_bins", "faces", "SELECT face_id, CASE WHEN irradiation >= 1200 THEN 'high' WHEN irradiation >= 1000 THEN 'medium' WHEN irradiation IS NOT NULL THEN 'low' END AS bin FROM {faces}")
breakdown = operator("f20_breakdown", "detections", "SELECT capture_id, bround(sum(a), 6) AS shown FROM (SELECT capture_id, kind, sum((x1 - x0) * (y1 - y0)) AS a FROM {detections} GROUP BY capture_id, kind) t WHERE a > 0.05e0 GROUP BY capture_id")

# --- joins ----------------------------------------------------------------------------------------------------------
PAIRS = "{faces} a JOIN {faces} b ON a.building_id = b.building_id AND a.part_no < b.part_no"
OX, OY = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
GAP = f"sqrt(pow(greatest(0e0, -{OX}), 2) + pow(greatest(0e0, -{OY}), 2))"
LINKS = f"""
SELECT a.building_id, a.face_id AS a, b.face_id AS b, a.part_no AS pa, b.part_no AS pb, bround(greatest(0e0, {OX}) * greatest(0e0, {OY}), 6) AS overlap,
       bround({GAP}, 6) AS gap, bround(CASE WHEN {OX} <= 0 THEN greatest(0e0, {OY} + 0.7e0) ELSE greatest(0e0, {OX} + 0.7e0) END, 6) AS shared
FROM {PAIRS}"""
adjacency = operator("j1_link_reason", "faces", f"SELECT a, b, CASE WHEN overlap > 0.5e0 THEN 'overlap' ELSE 'shared_edge' END AS reason, overlap, gap FROM ({LINKS}) l WHERE overlap > 0.5e0 OR (gap <= 0.35e0 AND shared >= 1.5e0)")
COPLANAR = f"""
SELECT a.building_id, a.face_id AS a, b.face_id AS b, a.part_no AS pa, b.part_no AS pb FROM {PAIRS}
WHERE least(a.pitch, b.pitch) > 5 AND abs(a.pitch - b.pitch) <= 6 AND least(abs(a.azimuth - b.azimuth), 360e0 - abs(a.azimuth - b.azimuth)) <= 12 AND {GAP} <= 0.6e0"""
coplanar = operator("j2_coplanar_pairs", "faces", f"SELECT a, b FROM ({COPLANAR}) c")
best_overlap = operator(
    "j4_best_overlap", "detections faces",
    f"""SELECT d.object_id, max_by(f.face_id, f.o * 1000 - f.part_no) AS face_id, bround(max(f.o) / max((d.x1 - d.x0) * (d.y1 - d.y0)), 3) AS share
        FROM {{detections}} d LEFT JOIN (SELECT a.object_id, b.face_id, b.part_no, greatest(0e0, {OX}) * greatest(0e0, {OY}) AS o FROM {{detections}} a JOIN {{faces}} b ON a.building_id = b.building_id) f
        ON f.object_id = d.object_id AND f.o > 0 GROUP BY d.object_id""",
)
enriched = operator("j5_as_roof_planes", "faces plants", "SELECT f.face_id, coalesce(f.egid, p.egid) AS egid, bround((f.aspect + 540e0) % 360e0, 6) AS azimuth, bround(f.official_kwh, 3) AS official_kwh FROM {faces} f LEFT JOIN {plants} p ON f.building_id = p.plant_id")
register_faces = operator("j6_register_faces", "faces plants", f"SELECT f.building_id, CAST(count(*) AS BIGINT) AS plants, bround(sum(p.kw), 2) AS kw FROM (SELECT DISTINCT building_id, egid FROM {{faces}} WHERE egid IS NOT NULL) f JOIN (SELECT egid, {POWER_KW.format('power_text')} AS kw FROM {{plants}} WHERE lower(trim(coalesce(category, ''))) = 'photovoltaic') p ON f.egid = p.egid GROUP BY f.building_id")
cross_check = operator(
    "j7_register_cross_check", "faces plants detections",
    """SELECT b.building_id, CASE WHEN r.n > 0 AND coalesce(s.n, 0) = 0 THEN 'registered_not_seen' WHEN coalesce(s.n, 0) > 0 AND coalesce(r.n, 0) = 0 AND b.e > 0 THEN 'seen_not_registered' ELSE 'consistent' END AS finding
       FROM (SELECT building_id, max(egid) AS egid, count(egid) AS e FROM {faces} GROUP BY building_id) b
       LEFT JOIN (SELECT egid, count(*) AS n FROM {plants} WHERE lower(trim(coalesce(category, ''))) = 'photovoltaic' GROUP BY egid) r ON r.egid = b.egid
       LEFT JOIN (SELECT building_id, count(*) AS n FROM {detections} WHERE kind = 'existing_pv' GROUP BY building_id) s ON s.building_id = b.building_id""",
)
objects_faces = operator("j8_objects_faces", "detections faces", f"SELECT a.object_id, b.face_id, bround({OX} * {OY}, 6) AS area FROM {{detections}} a JOIN {{faces}} b ON a.building_id = b.building_id WHERE {OX} > 0 AND {OY} > 0 AND {OX} * {OY} >= 1e-6")
rwa_faces = operator("j9_rwa_clearance", "detections faces", "SELECT a.object_id, b.face_id FROM {detections} a JOIN {faces} b ON a.building_id = b.building_id WHERE a.kind = 'rwa' AND least(a.x1 + 2, b.x1) > greatest(a.x0 - 2, b.x0) AND least(a.y1 + 2, b.y1) > greatest(a.y0 - 2, b.y0)")
enclosing = operator("j10_point_in_face", "faces vectors", "SELECT v.id, min_by(f.face_id, f.area * 100 + f.part_no) AS face_id FROM {vectors} v JOIN {faces} f ON f.building_id = v.id WHERE 2e0 + v.tilt BETWEEN f.x0 AND f.x1 AND v.sun_deg / 3e0 BETWEEN f.y0 AND f.y1 GROUP BY v.id")
enclosing_building = operator("j11_enclosing_roof", "faces", "SELECT building_id, bround(sum(area), 6) AS area, max(CASE WHEN x0 <= 12 AND x1 >= 12 AND y0 <= 3 AND y1 >= 3 THEN 1 ELSE 0 END) = 1 AS covers FROM {faces} GROUP BY building_id HAVING max(CASE WHEN x0 <= 12 AND x1 >= 12 AND y0 <= 3 AND y1 >= 3 THEN 1 ELSE 0 END) = 1")
clip_faces = operator("j12_clip_faces", "faces", "SELECT face_id, greatest(x0, 4e0) AS x0, least(x1, 44e0) AS x1, greatest(y0, 1e0) AS y0, least(y1, 9e0) AS y1 FROM {faces} WHERE (least(x1, 44e0) - greatest(x0, 4e0)) * (least(y1, 9e0) - greatest(y0, 1e0)) >= 0.25e0 AND least(x1, 44e0) > greatest(x0, 4e0) AND least(y1, 9e0) > greatest(y0, 1e0)")
bridge_veto = operator("j13_bridge_veto", "cells", f"SELECT tile_id, CASE WHEN count(h) < 6 THEN TRUE ELSE avg(CASE WHEN h >= 2 THEN 1e0 WHEN h < 2 THEN 0e0 END) >= 0.6e0 END AS supported FROM (SELECT tile_id, {CLEAN} - ground AS h FROM {{cells}} WHERE col_no BETWEEN 18 AND 21) t GROUP BY tile_id")
height_above_ground = operator("j14_surface_minus_terrain", "cells", f"SELECT s.tile_id, s.row_no, s.col_no, bround(s.v - t.ground, 6) AS height FROM (SELECT tile_id, row_no, col_no, {CLEAN} AS v FROM {{cells}}) s LEFT JOIN {{cells}} t ON s.tile_id = t.tile_id AND s.row_no = t.row_no AND s.col_no = t.col_no")
manifest_semi = operator("j17_manifest_semi", "splits pages", "SELECT s.id FROM {splits} s WHERE NOT EXISTS (SELECT 1 FROM {pages} p WHERE p.page_id = s.egid)")
split_leakage = operator("j18_split_leakage", "splits", "SELECT s.id FROM {splits} s LEFT JOIN (SELECT egid FROM {splits} GROUP BY egid HAVING count(DISTINCT split) > 1) l ON s.egid = l.egid WHERE l.egid IS NULL")
image_mask = operator("j19_image_mask", "documents labels", "SELECT d.doc_id, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id")
absorb = operator("j21_absorbed_skylights", "detections", f"SELECT a.object_id AS skylight, min(b.object_id) AS pv FROM {{detections}} a JOIN {{detections}} b ON a.capture_id = b.capture_id WHERE a.kind = 'skylight' AND a.source = 'image' AND b.kind = 'existing_pv' AND {OX} > 0 AND {OY} > 0 AND {OX} * {OY} >= 0.95e0 * (a.x1 - a.x0) * (a.y1 - a.y0) GROUP BY a.object_id")

# --- aggregations ---------------------------------------------------------------------------------------------------
height_anchor = operator(
    "a5_height_anchor", "cells",
    f"""SELECT a.tile_id, CASE WHEN a.n >= 12 AND sum(CASE WHEN abs(c.d - a.p25) <= 0.35e0 THEN 1 ELSE 0 END) >= 12 AND sum(CASE WHEN abs(c.d - a.p25) <= 0.35e0 THEN 1 ELSE 0 END) >= 0.4e0 * a.n THEN 'measured'
               WHEN a.n >= 6 THEN 'approximate' ELSE 'refused' END AS anchor,
           bround(CASE WHEN a.n >= 12 AND sum(CASE WHEN abs(c.d - a.p25) <= 0.35e0 THEN 1 ELSE 0 END) >= 12 AND sum(CASE WHEN abs(c.d - a.p25) <= 0.35e0 THEN 1 ELSE 0 END) >= 0.4e0 * a.n THEN a.p25 WHEN a.n >= 6 THEN a.med END, 4) AS z
       FROM (SELECT tile_id, {CLEAN} - 0.15e0 * col_no AS d FROM {{cells}}) c
       JOIN (SELECT tile_id, count(d) AS n, percentile(d, 0.25) AS p25, median(d) AS med FROM (SELECT tile_id, {CLEAN} - 0.15e0 * col_no AS d FROM {{cells}}) t WHERE d IS NOT NULL GROUP BY tile_id) a ON a.tile_id = c.tile_id
       GROUP BY a.tile_id, a.n, a.p25, a.med""",
)
rise_threshold = operator(
    "a6_rise_threshold", "cells",
    f"""SELECT tile_id, bround(CASE WHEN n < 8 THEN 0.28e0 ELSE greatest(0.28e0, 4 * 1.4826e0 * mad) END, 4) AS threshold FROM (
        SELECT d.tile_id, count(d.r) AS n, median(abs(d.r - m.dm)) AS mad
        FROM (SELECT c.tile_id, c.r FROM (SELECT tile_id, {CLEAN} - 0.15e0 * col_no - 500e0 AS r FROM {{cells}}) c
              JOIN (SELECT tile_id, median({CLEAN} - 0.15e0 * col_no - 500e0) AS mm FROM {{cells}} GROUP BY tile_id) k ON k.tile_id = c.tile_id WHERE c.r <= k.mm) d
        JOIN (SELECT c.tile_id, median(c.r) AS dm FROM (SELECT tile_id, {CLEAN} - 0.15e0 * col_no - 500e0 AS r FROM {{cells}}) c
              JOIN (SELECT tile_id, median({CLEAN} - 0.15e0 * col_no - 500e0) AS mm FROM {{cells}} GROUP BY tile_id) k ON k.tile_id = c.tile_id WHERE c.r <= k.mm GROUP BY c.tile_id) m ON m.tile_id = d.tile_id
        GROUP BY d.tile_id) t""",
)
register_summary = operator("a7_register_summary", "plants", f"SELECT egid, CAST(count(*) AS BIGINT) AS plants, bround(sum({POWER_KW.format('power_text')}), 2) AS total_kw FROM {{plants}} WHERE lower(trim(coalesce(category, ''))) = 'photovoltaic' GROUP BY egid")
rejected_summary = operator("a8_rejected_summary", "faces", f"SELECT building_id, CAST(sum(CASE WHEN status = 'not_recommended' THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN status = 'not_recommended' AND ok > 0 THEN 1 ELSE 0 END) AS BIGINT) AS beside_accepted FROM (SELECT building_id, status, sum(CASE WHEN status <> 'not_recommended' THEN 1 ELSE 0 END) OVER (PARTITION BY building_id) AS ok FROM ({ASSESSED}) a) t GROUP BY building_id")
confidence = operator("a9_confidence_summary", "detections", "SELECT capture_id, bround(avg(CASE WHEN source = 'yolo' AND kind = 'existing_pv' THEN confidence END), 3) AS pv, bround(avg(CASE WHEN source = 'yolo' AND kind <> 'existing_pv' THEN confidence END), 3) AS other, CAST(sum(CASE WHEN source = 'yolo' AND confidence < 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM {detections} GROUP BY capture_id")
provenance = operator("a12_data_provenance", "detections", "SELECT source, kind, CAST(count(*) AS BIGINT) AS objects, CAST(count(confidence) AS BIGINT) AS scored FROM {detections} GROUP BY source, kind")
vintage_findings = operator(
    "a13_vintage_findings", "plants",
    f"""SELECT egid, CAST(max(extract(YEAR FROM day)) AS BIGINT) AS newest, bround(sum(kw), 2) AS kw, CAST(:today_year - :photo_year AS BIGINT) AS photo_age FROM (
        SELECT egid, {POWER_KW.format('power_text')} AS kw, CASE WHEN regexp_like(commissioned_text, '^[0-9][0-9][.][0-9][0-9][.](19|20)[0-9][0-9]$') THEN try_to_date(commissioned_text, 'dd.MM.yyyy') END AS day FROM {{plants}}) p
        WHERE extract(YEAR FROM day) > :photo_year GROUP BY egid""",
    photo_year=1998, today_year=2026,
)
vintage_confidence = operator("a14_vintage_confidence", "plants", "SELECT plant_id, CASE WHEN age <= 2 THEN 'high' WHEN age <= 4 THEN 'medium' WHEN age IS NOT NULL THEN 'low' ELSE 'unknown' END AS level FROM (SELECT plant_id, :today_year - extract(YEAR FROM taken_at) AS age FROM {plants}) t", today_year=2001)
building_statistics = operator("a17_building_statistics", "faces", "SELECT building_id, CAST(count(*) AS BIGINT) AS faces, bround(sum(area), 3) AS area_m2, bround(sum(official_kwh), 2) AS official_kwh, bround(100e0 * sum(CASE WHEN irradiation >= 800 THEN area ELSE 0e0 END) / sum(area), 1) AS utilisation_pct FROM {faces} GROUP BY building_id")
statistics_rollup = operator("a17_rollup", "faces", "SELECT building_id, part_no, bround(sum(area), 3) AS area_m2 FROM {faces} GROUP BY ROLLUP (building_id, part_no)")
otsu = operator(
    "a18_split_threshold", "detections",
    """SELECT capture_id, CAST(min(bin) AS BIGINT) AS threshold FROM (
        SELECT *, max(var) OVER (PARTITION BY capture_id) AS best FROM (
            SELECT capture_id, bin, bround(w0 * (n - w0) * pow(s0 / w0 - (s - s0) / nullif(n - w0, 0), 2), 4) AS var FROM (
                SELECT capture_id, bin, sum(c) OVER (PARTITION BY capture_id ORDER BY bin) * 1e0 AS w0, sum(c * bin) OVER (PARTITION BY capture_id ORDER BY bin) * 1e0 AS s0,
                       sum(c) OVER (PARTITION BY capture_id) * 1e0 AS n, sum(c * bin) OVER (PARTITION BY capture_id) * 1e0 AS s
                FROM (SELECT capture_id, CAST(floor(confidence * 256e0) AS BIGINT) AS bin, count(*) AS c FROM {detections} WHERE confidence IS NOT NULL GROUP BY capture_id, CAST(floor(confidence * 256e0) AS BIGINT)) h) c) v WHERE var IS NOT NULL) m
        WHERE var = best GROUP BY capture_id""",
)
robust_colour = operator("a19_colour_threshold", "detections", "SELECT d.capture_id, bround(max(m.md) + greatest(8e0, 3 * 1.4826e0 * median(abs(d.confidence * 255e0 - m.md))), 4) AS threshold FROM {detections} d JOIN (SELECT capture_id, median(confidence * 255e0) AS md FROM {detections} GROUP BY capture_id) m ON m.capture_id = d.capture_id GROUP BY d.capture_id")
pixel_scores = operator("a21_scores", "truth", "SELECT image, tp, fp, fn, bround(tp * 1e0 / nullif(tp + fp + fn, 0), 6) AS iou, bround(2e0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, bround(tp * 1e0 / nullif(tp + fp, 0), 6) AS prec, bround(tp * 1e0 / nullif(tp + fn, 0), 6) AS recall FROM (SELECT image, CAST(sum(CASE WHEN truth AND predicted THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN predicted AND NOT truth THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN truth AND NOT predicted THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM {truth} GROUP BY image) t")
capacity_error = operator("a22_capacity_metrics", "splits", "SELECT source, bround(avg(abs(kw - found / 10e0)), 4) AS mae FROM {splits} GROUP BY source HAVING count(found) > 0")
percentiles = operator("a23_percentiles", "vectors", "SELECT user_id, bround(percentile(value, 0.5), 4) AS p50, bround(percentile(value, 0.95), 4) AS p95 FROM {vectors} GROUP BY user_id")
pv_recall = operator("a24_pv_recall", "splits", "SELECT source, CAST(count(*) AS BIGINT) AS plants, CAST(sum(CASE WHEN found / (kw / 0.19e0) >= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS halves, bround(median(found / (kw / 0.19e0)), 4) AS median_share FROM {splits} WHERE kw BETWEEN 5 AND 80 GROUP BY source")
split_counts = operator("a25_split_counts", "splits", "SELECT source, CAST(count(*) AS BIGINT) AS images, CAST(count(found) AS BIGINT) AS with_objects FROM {splits} GROUP BY source")
obstacle_survey = operator("a29_obstacle_survey", "detections", "SELECT capture_id, bround(sum((x1 - x0) * (y1 - y0)), 3) AS area, bround(100e0 * sum((x1 - x0) * (y1 - y0)) / 2400e0, 1) AS share_pct, max(height_m) AS highest FROM {detections} WHERE kind <> 'existing_pv' GROUP BY capture_id")
zonal = operator("a30_zonal_stats", "cells", f"SELECT tile_id, CAST(floor(row_no / 8e0) AS BIGINT) AS zone, CAST(count({CLEAN}) AS BIGINT) AS cells, min(col_no) AS c0, max(col_no) AS c1, bround(max({CLEAN}), 4) AS highest, bround(avg({CLEAN}), 4) AS mean FROM {{cells}} GROUP BY tile_id, CAST(floor(row_no / 8e0) AS BIGINT)")
approx_coplanar = operator("a3_merge_coplanar_sums", "faces", f"SELECT c.a AS face_id, CAST(count(*) AS BIGINT) AS partners, bround(sum(f.area), 4) AS partner_area, bround(sum(f.area * f.irradiation) / sum(CASE WHEN f.irradiation IS NOT NULL THEN f.area END), 0) AS irradiation FROM ({COPLANAR}) c JOIN {{faces}} f ON f.face_id = c.b GROUP BY c.a")

# --- windows --------------------------------------------------------------------------------------------------------
first_per_id = operator("w1_first_per_face", "raw_faces", "SELECT face_id, rank_key, bround(q, 4) AS q FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY rank_key, q, p) AS rn FROM {raw_faces}) t WHERE rn = 1")
LOW, HIGH = "CAST(floor({0} + 0.5e0) AS BIGINT)", "CAST(ceil({0} - 0.5e0) AS BIGINT) - 1"
#: One-metre cells by their centres: a row for each cell of each face.
FACE_CELLS = f"SELECT building_id, face_id, part_no, z, cx, cy, status FROM ({ASSESSED}) f EACH(cx, {LOW.format('x0')}, {HIGH.format('x1')}) EACH(cy, {LOW.format('y0')}, {HIGH.format('y1')})"
#: The same as boxes of cells without making them, [l, r) by [b, t), each with the boxes of its building that it meets and
#: that win over it: a row for each face. Faces lie in the order of their parts already, so that none is sorted again.
_OVER = "u.l < r AND u.r > l AND u.b < t AND u.t > b AND CASE WHEN u.z <=> z THEN u.n < n ELSE z IS NULL OR coalesce(u.z > z, FALSE) END"
BOXED = f"""SELECT building_id, face_id, l, r, b, t, filter(held, u -> {_OVER}) AS upper FROM (
    SELECT *, collect_list(named_struct('l', l, 'r', r, 'b', b, 't', t, 'z', z, 'n', n)) OVER (PARTITION BY building_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS held FROM (
        SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY part_no) AS n FROM (
            SELECT building_id, face_id, part_no, z, {LOW.format('x0')} AS l, {HIGH.format('x1')} + 1 AS r, {LOW.format('y0')} AS b, {HIGH.format('y1')} + 1 AS t FROM {{faces}}) e WHERE l < r AND b < t) w) h"""


def uncovered(zero: str) -> str:
    """What the boxes of ``upper``, of which each meets l, r, b and t, leave of these: a difference for one box, else slabs
    between their sides with the length that their intervals cover; ``zero`` is a zero of the coordinates' type."""
    slabs = "array_sort(array_distinct(concat(array(l, r), transform(upper, u -> greatest(l, u.l)), transform(upper, u -> least(r, u.r)))))"
    inside = "array_sort(transform(filter(upper, u -> u.l <= xs[i] AND u.r > xs[i]), u -> named_struct('b', u.b, 't', least(t, u.t))))"
    length = f"aggregate({inside}, named_struct('at', b, 'sum', {zero}), (a, u) -> named_struct('at', greatest(a.at, u.t), 'sum', a.sum + greatest({zero}, u.t - greatest(a.at, u.b)))).sum"
    many = f"aggregate(transform(array({slabs}), xs -> aggregate(transform(sequence(0, size(xs) - 2), i -> (xs[i + 1] - xs[i]) * ({length})), {zero}, (a, v) -> a + v)), {zero}, (a, v) -> a + v)"
    one = "(least(r, upper[0].r) - greatest(l, upper[0].l)) * (least(t, upper[0].t) - greatest(b, upper[0].b))"
    return f"(r - l) * (t - b) - CASE size(upper) WHEN 0 THEN {zero} WHEN 1 THEN {one} ELSE {many} END"


_TOP = f"(SELECT *, row_number() OVER (PARTITION BY building_id, cx, cy ORDER BY z DESC, part_no) AS rn FROM ({FACE_CELLS}) c) t WHERE rn = 1"
upper_face = operator(
    "w2_upper_face_wins", "faces",
    f"SELECT building_id, cx, cy, face_id FROM ({BOXED}) f EACH(cx, l, r - 1) EACH(cy, b, t - 1) WHERE size(upper) = 0 OR NOT exists(upper, u -> u.l <= cx AND u.r > cx AND u.b <= cy AND u.t > cy)",
    oracle=ansi(f"SELECT building_id, cx, cy, face_id FROM {_TOP}"),
)
topmost = operator(
    "w3_topmost_area", "faces", f"SELECT face_id, CAST(sum(visible) AS BIGINT) AS visible FROM (SELECT face_id, {uncovered('0L')} AS visible FROM ({BOXED}) f) v WHERE visible > 0 GROUP BY face_id",
    oracle=ansi(f"SELECT face_id, CAST(count(*) AS BIGINT) AS visible FROM {_TOP} GROUP BY face_id"),
)
top_objects = operator("w5_top_objects", "detections", "SELECT capture_id, object_id, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, object_id) AS rn FROM {detections} WHERE confidence IS NOT NULL) t WHERE rn <= 30")
newest_per_origin = operator("w6_newest_per_origin", "tiles", f"SELECT origin, item_id FROM (SELECT item_id, {ORIGIN} AS origin, row_number() OVER (PARTITION BY {ORIGIN} ORDER BY taken_at DESC, item_id) AS rn FROM {{tiles}} WHERE taken_at IS NOT NULL) t WHERE rn = 1")
lru = operator("w7_lru_running_total", "tiles", "SELECT item_id, CAST(sum(CAST(floor(bytes) AS BIGINT)) OVER (PARTITION BY media_type ORDER BY taken_at DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS kept_bytes FROM {tiles} WHERE taken_at IS NOT NULL")
ring_length = operator("w8_ring_length", "vectors", "SELECT id, bround(sum(coalesce(side, 0e0)) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS along FROM (SELECT id, user_id, sqrt(pow(a - lag(a) OVER (PARTITION BY user_id ORDER BY id), 2) + pow(b - lag(b) OVER (PARTITION BY user_id ORDER BY id), 2)) AS side FROM {vectors}) s")

# --- sets -----------------------------------------------------------------------------------------------------------
SET_A, SET_B = "SELECT building_id FROM {faces} WHERE irradiation >= 1000", "SELECT building_id FROM {faces} WHERE pitch < 10"
union_keys = operator("o1_union", "faces", f"SELECT building_id FROM ({SET_A}) a UNION SELECT building_id FROM ({SET_B}) b")
common_keys = operator("o2_intersection", "faces", f"SELECT building_id FROM ({SET_A}) a INTERSECT SELECT building_id FROM ({SET_B}) b")
left_keys = operator("o3_difference", "faces", f"SELECT building_id FROM ({SET_A}) a EXCEPT SELECT building_id FROM ({SET_B}) b")
symmetric = operator("o4_symmetric_difference", "faces", f"SELECT building_id FROM (SELECT building_id FROM ({SET_A}) a EXCEPT SELECT building_id FROM ({SET_B}) b) x UNION ALL SELECT building_id FROM (SELECT building_id FROM ({SET_B}) c EXCEPT SELECT building_id FROM ({SET_A}) d) y")
key_difference = operator("o5_key_difference", "faces plants", "SELECT DISTINCT egid FROM {faces} WHERE egid IS NOT NULL EXCEPT SELECT egid FROM {plants} WHERE lower(trim(coalesce(category, ''))) = 'photovoltaic'")
warnings = operator("o6_ordered_distinct", "detections", "SELECT capture_id, kind, min(object_id) AS first_seen FROM {detections} GROUP BY capture_id, kind")
source_union = operator("o7_source_union", "detections", "SELECT capture_id, kind, array_join(sort_array(collect_set(source)), '+') AS sources FROM {detections} GROUP BY capture_id, kind", oracle="SELECT capture_id, kind, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM detections GROUP BY capture_id, kind")
parts = operator("o8_parts", "detections", "SELECT object_id, CAST(pos AS BIGINT) AS part, corner FROM (SELECT object_id, posexplode(array(x0, y0, x1, y1)) AS (pos, corner) FROM {detections}) t", oracle="SELECT object_id, CAST(i - 1 AS BIGINT) AS part, [x0, y0, x1, y1][i] AS corner FROM (SELECT *, unnest(range(1, 5)) AS i FROM detections) t")

# --- cells, exclusion areas and accounting --------------------------------------------------------------------------
#: Along one axis, cells, those off the edge and those of these beside the obstacle: counted by the same comparisons.
_RUN = """transform(array(sequence(CAST({0}0 * 2 AS BIGINT), CAST({0}1 * 2 AS BIGINT) - 1)), s -> transform(array(filter(s, c -> NOT (c * 0.5e0 + 0.25e0 < {0}0 + :edge_m OR c * 0.5e0 + 0.25e0 > {0}1 - :edge_m))), o ->
    named_struct('n', CAST(size(s) AS BIGINT), 'off', CAST(size(o) AS BIGINT), 'met', CAST(size(filter(o, c -> c * 0.5e0 + 0.25e0 BETWEEN {0}0 + {1} - :obstacle_m AND {0}0 + {2} + :obstacle_m)) AS BIGINT)))[0])[0]"""
_HALVES = f"SELECT face_id, {_RUN.format('x', '2e0', '3e0')} AS a, {_RUN.format('y', '1e0', '2e0')} AS b FROM {{faces}} WHERE CAST(x0 * 2 AS BIGINT) < CAST(x1 * 2 AS BIGINT) AND CAST(y0 * 2 AS BIGINT) < CAST(y1 * 2 AS BIGINT)"
#: The edge is a matter of a cell's column or row and the obstacle of both, so cells are products of columns and rows.
usable_cells = operator(
    "k1_usable_cells", "faces",
    f"""SELECT face_id, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(n - off) AS BIGINT) AS edge_cells, CAST(sum(met) AS BIGINT) AS blocked_cells, CAST(sum(off - met) AS BIGINT) AS usable_cells
        FROM (SELECT face_id, a.n * b.n AS n, a.off * b.off AS off, a.met * b.met AS met FROM ({_HALVES}) h) t GROUP BY face_id""",
    oracle=ansi("""SELECT face_id, CAST(count(*) AS BIGINT) AS cells, CAST(sum(CASE WHEN edge THEN 1 ELSE 0 END) AS BIGINT) AS edge_cells, CAST(sum(CASE WHEN NOT edge AND blocked THEN 1 ELSE 0 END) AS BIGINT) AS blocked_cells,
              CAST(sum(CASE WHEN NOT edge AND NOT blocked THEN 1 ELSE 0 END) AS BIGINT) AS usable_cells FROM (
        SELECT face_id, cx * 0.5e0 + 0.25e0 < x0 + :edge_m OR cx * 0.5e0 + 0.25e0 > x1 - :edge_m OR cy * 0.5e0 + 0.25e0 < y0 + :edge_m OR cy * 0.5e0 + 0.25e0 > y1 - :edge_m AS edge,
               cx * 0.5e0 + 0.25e0 BETWEEN x0 + 2e0 - :obstacle_m AND x0 + 3e0 + :obstacle_m AND cy * 0.5e0 + 0.25e0 BETWEEN y0 + 1e0 - :obstacle_m AND y0 + 2e0 + :obstacle_m AS blocked
        FROM {faces} f EACH(cx, CAST(x0 * 2 AS BIGINT), CAST(x1 * 2 AS BIGINT) - 1) EACH(cy, CAST(y0 * 2 AS BIGINT), CAST(y1 * 2 AS BIGINT) - 1)) t GROUP BY face_id"""),
    edge_m=0.3, obstacle_m=0.4,
)
overlay = operator("k9_overlay", "faces detections", "SELECT 'roof' AS layer, face_id AS id, bround(area, 3) AS area FROM {faces} UNION ALL SELECT CASE kind WHEN 'existing_pv' THEN 'pv' ELSE 'obstacles' END AS layer, CAST(object_id AS STRING) AS id, bround((x1 - x0) * (y1 - y0), 3) AS area FROM {detections}")
detection_views = operator(
    "i6_detection_views", "vectors numbers",
    """SELECT id, CAST(least(n * (tile - CAST(floor(tile / 4e0) AS BIGINT)), px - tile) AS BIGINT) AS start_px, tile FROM (SELECT id, px, greatest(640, CAST(ceil(px / 3e0) AS BIGINT)) AS tile FROM (SELECT id, CAST(width_m * 3 AS BIGINT) AS px FROM {vectors}) p WHERE px > 768) t
       CROSS JOIN {numbers} WHERE n < 8 AND (n = 0 OR (n - 1) * (tile - CAST(floor(tile / 4e0) AS BIGINT)) + tile < px)""",
)
extrema_ttl = operator("t1_latest_within_ttl", "events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00') t WHERE rn = 1")
