"""Scalar functions of the inventory (text, dates, planes, sun), each as a projection over a table that holds its inputs.

Numbers are rounded half to even at the end, so that results do not hang on the last bit of a library's sine.
"""

from __future__ import annotations

from sunspan.operators._sql import operator

#: A number or null: NaN and infinities are no numbers, and compare as greater than every other value.
NUMBER = "CASE WHEN abs(try_cast({0} AS DOUBLE)) <= 1.79e308 THEN try_cast({0} AS DOUBLE) END"


def pmod(x: str, m: str) -> str:
    """A remainder that is never negative, in SQL that both engines share."""
    return f"((({x}) % {m}) + {m}) % {m}"


number = operator("n1_number", "texts", f"SELECT id, {NUMBER.format('v')} AS number FROM {{texts}}")
nonnegative = operator("n2_number", "texts", f"SELECT id, CASE WHEN d >= 0 THEN d END AS number FROM (SELECT id, {NUMBER.format('v')} AS d FROM {{texts}}) t")

POWER_KW = """try_cast(replace(regexp_extract({0}, '([0-9.,]+)[ ]*([kKmM])?[wW]', 1), ',', '.') AS DOUBLE)
    * CASE WHEN lower(regexp_extract({0}, '([0-9.,]+)[ ]*([kKmM])?[wW]', 2)) = 'm' THEN 1000e0 ELSE 1e0 END"""
parse_power = operator("n3_parse_power_kw", "plants", f"SELECT plant_id, bround({POWER_KW.format('power_text')}, 6) AS power_kw FROM {{plants}}")
parse_power_in_text = operator("n3_power_in_text", "documents", f"SELECT doc_id, bround({POWER_KW.format('text')}, 6) AS power_kw FROM {{documents}}")
TILE_YEAR = "try_cast(nullif(regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '_((19|20)[0-9][0-9])_', 1), '') AS INT)"
tile_year = operator("n4_tile_year", "texts", f"SELECT id, {TILE_YEAR.format('href')} AS year FROM {{texts}}")
UNESCAPED = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
clean_label = operator(
    "n5_clean_label", "pages", "SELECT page_id, " + UNESCAPED.format("regexp_replace(html, '<[^>]+>', '')") + " AS label FROM {pages}",
    oracle="SELECT page_id, " + UNESCAPED.format("regexp_replace(html, '<[^>]+>', '', 'g')") + " AS label FROM pages",
)
feature_of_face = operator("n6_feature_of_face", "texts", "SELECT id, split_part(face_id, ':', 1) AS feature_id, split_part(face_id, ':', 2) AS part FROM {texts}")
null_safe_text = operator("n7_null_safe_text", "texts", "SELECT id, lower(trim(coalesce(label, ''))) AS label FROM {texts}")
canonical_json = operator(
    "n8_canonical_json", "texts", "SELECT id, to_json(named_struct('face', face_id, 'id', id)) AS key FROM {texts}",
    oracle="SELECT id, CAST(to_json(struct_pack(face := face_id, id := id)) AS VARCHAR) AS key FROM texts",
)
hash_bucket = operator(
    "n9_hash_bucket", "splits",
    "SELECT id, CAST(pmod(CAST(conv(substr(sha2(source, 256), 1, 8), 16, 10) AS BIGINT), 10) AS BIGINT) AS bucket, pmod(CAST(conv(substr(sha2(CAST(id AS STRING), 256), 1, 8), 16, 10) AS BIGINT), 5) = 0 AS keep_empty FROM {splits}",
    oracle="SELECT id, CAST(CAST(concat('0x', substr(sha256(source), 1, 8)) AS UBIGINT) % 10 AS BIGINT) AS bucket, CAST(concat('0x', substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS UBIGINT) % 5 = 0 AS keep_empty FROM splits",
)
number_text = operator("n10_number_text", "vectors", "SELECT id, format_string('%.1f', bround(a, 1)) AS one, format_string('%.3f', bround(b, 3)) AS three FROM {vectors}")
identity = operator("n11_identity", "texts", "SELECT id, nullif(nullif(egid_text, ''), '0') AS egid FROM {texts}")
label_line = operator("n12_label_line", "texts", "SELECT id, concat('0 ', format_string('%.6f', bround(x / 11e0, 6)), ' ', format_string('%.6f', bround(y / 11e0, 6))) AS line FROM {texts}")

swiss_date = operator(
    "d1_swiss_date", "texts",
    "SELECT id, CASE WHEN regexp_like(date_text, '^[0-9][0-9][.][0-9][0-9][.](19|20)[0-9][0-9]$') THEN try_to_date(date_text, 'dd.MM.yyyy') END AS day FROM {texts}",
)
age = operator(
    "d2_age_years", "texts",
    "SELECT id, CAST(2026 - extract(YEAR FROM CASE WHEN regexp_like(date_text, '^[0-9][0-9][.][0-9][0-9][.](19|20)[0-9][0-9]$') THEN try_to_date(date_text, 'dd.MM.yyyy') END) AS BIGINT) AS age FROM {texts}",
)
day_of_year = operator("d3_day_of_21st", "vectors", "SELECT id, CAST(dayofyear(make_date(2025, month, 21)) AS BIGINT) AS day FROM {vectors}")
month_days = operator("d4_days_in_month", "vectors", "SELECT id, CAST(day(last_day(make_date(2025, month, 1))) AS BIGINT) AS days FROM {vectors}")
utc_text = operator(
    "d5_utc_text", "texts", "SELECT id, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS retrieved_at FROM {texts}",
    oracle="SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS retrieved_at FROM texts",
)

# Fixed values of the fractional-year series for declination and the equation of time (published by NOAA).
def declination(g: str) -> str:
    return f"0.006918e0 - 0.399912e0 * cos({g}) + 0.070257e0 * sin({g}) - 0.006758e0 * cos(2 * {g}) + 0.000907e0 * sin(2 * {g}) - 0.002697e0 * cos(3 * {g}) + 0.00148e0 * sin(3 * {g})"


def equation_of_time(g: str) -> str:
    return f"229.18e0 * (0.000075e0 + 0.001868e0 * cos({g}) - 0.032077e0 * sin({g}) - 0.014615e0 * cos(2 * {g}) - 0.040849e0 * sin(2 * {g}))"


SUN = f"""
SELECT id, lat, lon, month, hour, {declination("g")} AS decl, {equation_of_time("g")} AS eqt
FROM (SELECT *, 2e0 * pi() / 365e0 * (dayofyear(make_date(2025, month, 21)) - 1 + (hour - 12e0) / 24e0) AS g FROM {{vectors}}) s"""
ANGLED = f"SELECT *, radians((hour * 60e0 + eqt + 4e0 * lon) / 4e0 - 180e0) AS ha, radians(lat) AS phi FROM ({SUN}) a"
hour_angle = operator("d6_hour_angle", "vectors", f"SELECT id, bround(degrees(ha), 6) AS hour_angle, bround(eqt, 6) AS equation_of_time FROM ({ANGLED}) h")
solar_position = operator(
    "p11_solar_position", "vectors",
    f"""SELECT id, bround(-cos(decl) * sin(ha), 6) AS east, bround(cos(phi) * sin(decl) - sin(phi) * cos(decl) * cos(ha), 6) AS north,
               bround(sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha), 6) AS up FROM ({ANGLED}) h""",
)

# Fixed values of the published approximate transformation between WGS84 and LV95 (about a metre).
to_lv95 = operator(
    "p1_to_lv95", "vectors",
    """SELECT id,
       bround(2600072.37e0 + 211455.93e0 * l - 10938.51e0 * l * p - 0.36e0 * l * p * p - 44.54e0 * l * l * l, 3) AS east,
       bround(1200147.07e0 + 308807.95e0 * p + 3745.25e0 * l * l + 76.63e0 * p * p - 194.56e0 * l * l * p + 119.79e0 * p * p * p, 3) AS north
       FROM (SELECT id, (lat * 3600e0 - 169028.66e0) / 10000e0 AS p, (lon * 3600e0 - 26782.5e0) / 10000e0 AS l FROM {vectors}) t""",
)
to_wgs84 = operator(
    "p1_to_wgs84", "vectors",
    """SELECT id,
       bround((2.6779094e0 + 4.728982e0 * y + 0.791484e0 * y * x + 0.1306e0 * y * x * x - 0.0436e0 * y * y * y) * 100e0 / 36e0, 8) AS lon,
       bround((16.9023892e0 + 3.238272e0 * x - 0.270978e0 * y * y - 0.002528e0 * x * x - 0.0447e0 * y * y * x - 0.014e0 * x * x * x) * 100e0 / 36e0, 8) AS lat
       FROM (SELECT id, (east - 2600000e0) / 1000000e0 AS y, (north - 1200000e0) / 1000000e0 AS x FROM {vectors}) t""",
)
capture_grid = operator(
    "p2_capture_grid", "vectors",
    """SELECT id, CASE WHEN least(w, d) > 0 AND greatest(w, d) <= 1000 THEN bround(ppm, 6) END AS ppm,
       CASE WHEN greatest(w, d) <= 1000 THEN greatest(256, CAST(ceil(bround(w * ppm, 6)) AS BIGINT)) END AS width_px,
       CASE WHEN greatest(w, d) <= 1000 THEN greatest(256, CAST(ceil(bround(d * ppm, 6)) AS BIGINT)) END AS height_px
       FROM (SELECT *, least(10e0, 1280e0 / greatest(w, d)) AS ppm FROM (SELECT id, width_m + 16e0 AS w, depth_m + 16e0 AS d FROM {vectors}) g) t""",
)
pixel_point = operator("p3_pixel_ring", "faces", "SELECT face_id, bround((x0 - 0e0) * 10e0 + 1.5e0, 4) AS px0, bround((40e0 - y1) * 10e0 - 0.5e0, 4) AS py0, bround((x1 - 0e0) * 10e0 + 1.5e0, 4) AS px1, bround((40e0 - y0) * 10e0 - 0.5e0, 4) AS py1 FROM {faces}")
world_point = operator("p4_world_pixel", "vectors", "SELECT id, bround(2600000e0 + (a - 0.5e0) / 10e0, 6) AS east, bround(1200040e0 - (b + 0.25e0) / 10e0, 6) AS north, bround((east - 2600000e0) * 10e0 + 0.5e0, 4) AS px, bround((1200040e0 - north) * 10e0 - 0.25e0, 4) AS py FROM {vectors}")

PLANE = "SELECT *, sqrt(a * a + b * b + 1e0) AS nn, sqrt(1e0 + a * a) AS un FROM {vectors}"
BASIS = f"SELECT *, -a / nn AS nx, -b / nn AS ny, 1e0 / nn AS nz, 1e0 / un AS ux, 0e0 AS uy, a / un AS uz FROM ({PLANE}) p"
FRAME = f"SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz FROM ({BASIS}) b"
from_slopes = operator("p6_plane_from_slopes", "vectors", f"SELECT id, bround(nx, 9) AS nx, bround(ny, 9) AS ny, bround(nz, 9) AS nz, bround(ux, 9) AS ux, bround(uz, 9) AS uz, bround(vx, 9) AS vx, bround(vy, 9) AS vy, bround(vz, 9) AS vz FROM ({FRAME}) f")
local_world = operator(
    "p7_local_world", "vectors",
    f"""SELECT id, bround(u, 6) AS u, bround(v, 6) AS v, bround(2600000e0 + u * ux + v * vx, 5) AS east, bround(1200000e0 + u * uy + v * vy, 5) AS north,
        bround(450e0 + u * uz + v * vz, 5) AS z
        FROM (SELECT *, (east - 2600000e0) * ux + (north - 1200000e0) * uy + dz * uz AS u, (east - 2600000e0) * vx + (north - 1200000e0) * vy + dz * vz AS v
              FROM (SELECT *, a * (east - 2600000e0) + b * (north - 1200000e0) AS dz FROM ({FRAME}) f) g) h""",
)
describe_plane = operator(
    "p8_describe_plane", "vectors",
    f"""SELECT id, bround(pitch, 6) AS pitch, CASE WHEN pitch > 0.1e0 THEN bround({pmod("degrees(atan2(nx, ny))", "360e0")}, 6) END AS azimuth, bround(1e0 / nz, 6) AS area_factor
        FROM (SELECT *, degrees(acos(least(1e0, nz))) AS pitch FROM ({BASIS}) f) g""",
)
official_plane = operator(
    "p9_official_plane", "faces",
    f"""SELECT face_id, source, CASE WHEN source = 'official' THEN bround({pmod("aspect + 180e0", "360e0")}, 6) END AS azimuth,
        CASE WHEN source = 'official' THEN bround(tan(radians(pitch)), 9) END AS slope,
        CASE WHEN source = 'official' THEN bround(area / cos(radians(pitch)), 6) END AS derived_area,
        CASE WHEN source = 'official' THEN bround(abs(area / cos(radians(pitch)) - area * 1.2e0) / (area * 1.2e0), 6) END AS area_difference
        FROM (SELECT *, CASE WHEN pitch >= 0 AND pitch < 85 AND aspect BETWEEN -180 AND 180 THEN 'official' WHEN anchor = 'measured' THEN 'surface_fit' ELSE 'projected_2d' END AS source FROM {{faces}}) f""",
)
plane_from_fit = operator(
    "p10_plane_from_fit", "vectors",
    "SELECT id, CASE WHEN n_panels >= 12 AND abs(a) <= 1.25e0 AND sqrt(a * a + b * b) < tan(radians(75e0)) AND value / 1000e0 <= 0.25e0 THEN 'surface_fit' ELSE 'projected_2d' END AS source FROM {vectors}",
)
ROW_GAP = "CASE WHEN {0} < 0.01e0 THEN 0e0 ELSE {1} * sin(radians({0})) / tan(radians(greatest(1e0, {2}))) END"
row_gap = operator("p13_row_gap", "vectors", f"SELECT id, bround({ROW_GAP.format('tilt', '1.762e0', 'sun_deg')}, 6) AS gap FROM {{vectors}}")
flat_layout = operator("p14_flat_roof_layout", "vectors", f"SELECT id, bround(1.762e0 * cos(radians(tilt)), 6) AS depth, bround(coalesce(CASE WHEN n_panels % 5 = 0 THEN 0.4e0 END, {ROW_GAP.format('tilt', '1.762e0', 'sun_deg')}), 6) AS gap FROM {{vectors}}")
solar_data = operator(
    "p15_solar_data", "faces",
    "SELECT face_id, clean AS irradiation, bround(clean * 0.8e0, 6) AS yield_kwh, CASE WHEN clean IS NULL THEN 'unknown' ELSE 'official' END AS source FROM (SELECT face_id, CASE WHEN irradiation >= 0 AND irradiation <= 3000 THEN irradiation END AS clean FROM {faces}) f",
)
capacity = operator("p16_capacity", "vectors", "SELECT id, bround(n_panels * 450e0 / 1000e0, 3) AS kwp, CAST(bround(bround(n_panels * 450e0 / 1000e0, 3) * yield_kwh, 0) AS BIGINT) AS kwh FROM {vectors}")
dimensions = operator("p17_dimensions", "faces", "SELECT face_id, bround(greatest(w, h), 2) AS length_m, bround(least(w, h), 2) AS width_m FROM {faces}")
public_plane = operator("p18_public_plane", "faces", "SELECT face_id, building_id, egid, pitch, azimuth, irradiation, bround(area, 2) AS area_m2 FROM {faces}")
planning = operator("p23_planning_constraints", "vectors", "SELECT id, mode, bround(0.3e0 * f, 3) AS edge_m, bround(0.4e0 * f, 3) AS obstacle_m, bround(0.2e0 * f, 3) AS pv_m, 2e0 AS rwa_m FROM (SELECT *, CASE mode WHEN 'conservative' THEN 1.5e0 WHEN 'maximum' THEN 0.5e0 ELSE 1e0 END AS f FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'maximum' ELSE 'recommended' END AS mode FROM {vectors}) m) t")
thickness = operator("p24_thickness", "detections", "SELECT object_id, bround(least(x1 - x0, y1 - y0), 2) AS thickness_m FROM {detections}")
quaternion = operator(
    "p25_quaternion_matrix", "vectors",
    """SELECT id, bround(1 - 2 * (y * y + z * z), 6) AS m00, bround(2 * (x * y - z * w), 6) AS m01, bround(2 * (x * z + y * w), 6) AS m02,
       bround(2 * (x * y + z * w), 6) AS m10, bround(1 - 2 * (x * x + z * z), 6) AS m11, bround(2 * (y * z - x * w), 6) AS m12,
       bround(2 * (x * z - y * w), 6) AS m20, bround(2 * (y * z + x * w), 6) AS m21, bround(1 - 2 * (x * x + y * y), 6) AS m22
       FROM (SELECT id, a / q AS x, b / q AS y, tilt / 50e0 / q AS z, 1e0 / q AS w FROM (SELECT *, sqrt(a * a + b * b + tilt * tilt / 2500e0 + 1e0) AS q FROM {vectors}) n) t""",
)
triangle_normals = operator(
    "p26_triangle_normals", "vectors",
    """SELECT id, bround(cx, 6) AS nx, bround(cy, 6) AS ny, bround(cz, 6) AS nz, bround(sqrt(cx * cx + cy * cy + cz * cz) / 2e0, 6) AS area
       FROM (SELECT id, b * 1e0 - tilt / 10e0 * height / 450e0 AS cx, tilt / 10e0 * 2e0 - a * 1e0 AS cy, a * height / 450e0 - b * 2e0 AS cz FROM {vectors}) t""",
)
panels_3d = operator("p27_panels_3d", "faces", "SELECT face_id, CASE WHEN anchor <> 'projected_2d' THEN bround(z + tan(radians(pitch)) * (x1 - x0), 6) END AS corner_z, bround(cos(radians(pitch)), 9) AS normal_z FROM {faces}")
row_mask = operator("p28_facet_mask", "faces", "SELECT face_id, col_no, row_no FROM {faces} f EACH(col_no, CAST(x0 * 2 AS BIGINT), CAST(x1 * 2 AS BIGINT) - 1) EACH(row_no, CAST(y0 * 2 AS BIGINT), CAST(y1 * 2 AS BIGINT) - 1) WHERE part_no = 1")
boundary_points = operator("p29_boundary_points", "faces", "SELECT face_id, CAST(n AS BIGINT) AS k, bround(CASE WHEN along < w THEN x0 + along WHEN along < w + h THEN x1 WHEN along < 2 * w + h THEN x1 - (along - w - h) ELSE x0 END, 6) AS x, bround(CASE WHEN along < w THEN y0 WHEN along < w + h THEN y0 + (along - w) WHEN along < 2 * w + h THEN y1 ELSE y1 - (along - 2 * w - h) END, 6) AS y FROM (SELECT *, n * 2 * (w + h) / 32e0 AS along FROM {faces} f EACH(n, CAST(0 AS BIGINT), CAST(31 AS BIGINT))) t")
texture = operator("p31_channels", "vectors", "SELECT id, b8 - r8 AS blueness, bround((r8 + g8 + b8) / 3e0, 6) AS grey FROM (SELECT id, id % 256 AS r8, (id * 3) % 256 AS g8, (id * 7) % 256 AS b8 FROM {vectors}) t")
