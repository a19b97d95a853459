"""Domain relations derived from the star-schema tables by arithmetic that Spark and DuckDB share.

Each text reads tables by name; BINDINGS[name] is what operators get as ``name``.
"""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RAW_FACES = """
SELECT l_orderkey AS building_id, l_linenumber AS part_no,
       concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS face_id,
       l_partkey * 1000 + l_suppkey AS rank_key, l_quantity AS q, l_extendedprice AS p,
       CAST(10 * (l_linenumber - 1) AS DOUBLE) AS x0, CAST(2 * (l_suppkey % 3) AS DOUBLE) AS y0,
       CAST(6 + l_partkey % 6 AS DOUBLE) AS w, CAST(2 + l_suppkey % 8 AS DOUBLE) AS h,
       CAST(400 AS DOUBLE) + CAST(l_partkey % 17 AS DOUBLE) / 2e0 AS z,
       CAST((7 * l_partkey) % 70 AS DOUBLE) AS pitch, CAST((37 * l_suppkey) % 360 - 180 AS DOUBLE) AS aspect,
       CASE WHEN l_tax = 0 THEN NULL ELSE CAST(600 + (13 * l_partkey) % 900 AS DOUBLE) END AS irradiation,
       CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_partkey % 29 = 0 THEN o_custkey + 1 ELSE o_custkey END AS egid,
       l_suppkey AS s, l_partkey AS pk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

FACES = f"""
SELECT building_id, part_no, face_id, x0, y0, x0 + w AS x1, y0 + h AS y1, w, h, w * h AS area, z, pitch, aspect,
       CASE WHEN aspect + 180 >= 360 THEN aspect - 180 ELSE aspect + 180 END AS azimuth, irradiation, egid,
       part_no = 1 AS contains_click,
       CASE pk % 7 WHEN 0 THEN 'projected_2d' WHEN 1 THEN 'approximate' ELSE 'measured' END AS anchor,
       pk % 11 = 0 AS conflict, CAST(s % 10 AS DOUBLE) / 20e0 AS area_disagreement,
       CASE WHEN pk % 5 = 0 THEN NULL ELSE CAST(90 + s % 11 AS DOUBLE) / 100e0 END AS coverage,
       w * h / 1.5e0 * irradiation / 10e0 AS official_kwh, s, pk
FROM (SELECT *, row_number() OVER (PARTITION BY building_id, part_no ORDER BY rank_key, q, p) AS rn FROM ({RAW_FACES}) r) t
WHERE rn = 1
"""

#: What a user changed on a face by its name; one in 31 names a face that is not of this building.
OVERRIDES = f"""
SELECT face_id AS override_id, building_id, concat(CAST(building_id AS STRING), ':', CAST(part_no + CASE WHEN pk % 31 = 0 THEN 20 ELSE 0 END AS STRING)) AS face_id, pk % 2 = 0 AS excluded
FROM ({FACES}) f WHERE pk % 4 = 0
"""

PLANTS = """
SELECT o_orderkey AS plant_id, o_custkey AS egid,
       CASE o_orderkey % 4
         WHEN 0 THEN concat(CAST(o_orderkey % 40 AS STRING), '.', CAST(o_orderkey % 10 AS STRING), ' kW')
         WHEN 1 THEN concat('1.', CAST(o_orderkey % 10 AS STRING), ' MW')
         WHEN 2 THEN concat(CAST(o_orderkey % 90 AS STRING), ',', CAST(o_orderkey % 7 AS STRING), 'kW')
         ELSE 'unknown' END AS power_text,
       concat(lpad(CAST(extract(day FROM o_orderdate) + CASE WHEN o_orderkey % 9 = 0 THEN 10 ELSE 0 END AS STRING), 2, '0'), '.',
              lpad(CAST(extract(month FROM o_orderdate) AS STRING), 2, '0'), '.', CAST(extract(year FROM o_orderdate) AS STRING)) AS commissioned_text,
       CASE WHEN o_orderpriority LIKE '1%' THEN ' Photovoltaic ' WHEN o_orderpriority LIKE '2%' THEN 'PHOTOVOLTAIC'
            WHEN o_orderpriority LIKE '3%' THEN NULL ELSE 'Wind' END AS category,
       o_orderdate AS taken_at, o_totalprice AS price
FROM orders
"""

DETECTIONS = """
SELECT event_id AS object_id, user_id AS capture_id, 1 + event_id % 1499 AS building_id,
       CASE event_id % 5 WHEN 0 THEN 'existing_pv' WHEN 1 THEN 'skylight' WHEN 2 THEN 'chimney' WHEN 3 THEN 'rwa' ELSE 'other_obstacle' END AS kind,
       CASE (event_id % 97) % 5 WHEN 0 THEN 'yolo' WHEN 1 THEN 'map' WHEN 2 THEN 'manual' WHEN 3 THEN 'image' ELSE 'elevation' END AS source,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 500e0 END AS confidence,
       CAST((event_id * 7) % 60 AS DOUBLE) AS x0, CAST((event_id * 13) % 40 AS DOUBLE) AS y0,
       CAST((event_id * 7) % 60 + 2 + event_id % 5 + CASE WHEN event_id % 35 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS x1,
       CAST((event_id * 13) % 40 + 1 + event_id % 4 + CASE WHEN event_id % 35 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS y1,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 30 AS DOUBLE) / 10e0 END AS height_m
FROM events
"""

CELLS = """
SELECT tile_id, row_no, col_no,
       CASE WHEN id % 17 = 0 THEN NULL WHEN id % 101 = 0 THEN -9999e0
            ELSE 500e0 + 0.15e0 * col_no + CASE WHEN row_no BETWEEN 12 AND 15 AND col_no BETWEEN 14 AND 17 THEN 2e0 ELSE 0e0 END END AS z,
       CASE WHEN id % 19 = 0 THEN NULL ELSE 490e0 + 0.05e0 * row_no END AS ground
FROM (SELECT event_id AS id, CAST(floor(event_id / 1600e0) AS BIGINT) AS tile_id,
             CAST(floor((event_id % 1600) / 40e0) AS BIGINT) AS row_no, event_id % 40 AS col_no FROM events) e
"""

TILES = """
SELECT o_orderkey AS item_id, concat('terrain_', CAST(1990 + o_orderkey % 40 AS STRING), '_', CAST(2480 + o_custkey % 300 AS STRING), '-',
              CAST(1075 + o_custkey % 200 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '_2_' ELSE '_0.5_' END, '2056.tif') AS asset_name,
       CASE WHEN o_orderkey % 6 = 0 THEN 'image/png' ELSE 'image/tiff' END AS media_type,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS taken_at, o_totalprice AS bytes
FROM orders
"""

TEXTS = """
SELECT event_id AS id,
       CASE event_id % 9 WHEN 0 THEN 'NaN' WHEN 1 THEN 'abc' WHEN 2 THEN '-3.5' WHEN 3 THEN 'Infinity' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE CAST(event_id % 1000 AS STRING) END AS v,
       concat('https://tiles.example/a_1987_b/img', CASE event_id % 4 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '_x_' END, CAST(1890 + event_id % 180 AS STRING), '_', CAST(event_id % 50 AS STRING), '_.tif') AS href,
       CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '' ELSE CAST(event_id AS STRING) END AS egid_text,
       CASE event_id % 3 WHEN 0 THEN '  Existing PV ' WHEN 1 THEN NULL ELSE 'ROOF' END AS label,
       concat(CAST(event_id AS STRING), ':', CAST(event_id % 6 AS STRING)) AS face_id,
       concat(lpad(CAST(1 + event_id % 31 AS STRING), 2, '0'), '.', lpad(CAST(1 + event_id % 13 AS STRING), 2, '0'), CASE event_id % 5 WHEN 0 THEN '/' ELSE '.' END, CAST(1790 + event_id % 260 AS STRING)) AS date_text,
       CAST(event_id % 640 AS DOUBLE) / 64e0 AS x, CAST((event_id * 7) % 640 AS DOUBLE) / 64e0 AS y, ts, event_type
FROM events
"""

VECTORS = """
SELECT event_id AS id, CAST(event_id % 41 - 20 AS DOUBLE) / 16e0 AS a, CAST((event_id * 3) % 37 - 18 AS DOUBLE) / 16e0 AS b,
       2600000e0 + CAST(event_id % 977 AS DOUBLE) AS east, 1200000e0 + CAST((event_id * 11) % 883 AS DOUBLE) AS north, 450e0 + CAST(event_id % 29 AS DOUBLE) AS height,
       6e0 + CAST(event_id % 400 AS DOUBLE) / 100e0 AS lon, 46e0 + CAST(event_id % 150 AS DOUBLE) / 100e0 AS lat,
       CAST(event_id % 9 AS DOUBLE) * 5e0 AS tilt, CAST(event_id % 24 AS DOUBLE) / 2e0 AS sun_deg,
       CAST(20 + event_id % 900 AS DOUBLE) AS width_m, CAST(10 + (event_id * 7) % 700 AS DOUBLE) AS depth_m,
       CAST(event_id % 12 + 1 AS INT) AS month, CAST(event_id % 48 AS DOUBLE) / 2e0 AS hour, event_id % 60 AS n_panels,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(700 + event_id % 500 AS DOUBLE) END AS yield_kwh, value, user_id
FROM events
"""

TRUTH = "SELECT doc_id AS id, quality = 1 AS truth, toxic = 1 AS predicted, doc_id % 10 AS image FROM labels"

SPLITS = """
SELECT doc_id AS id, source, CASE WHEN doc_id % 10 < 2 THEN CAST(floor(doc_id / 10e0) AS BIGINT) ELSE 1000000 + doc_id END AS egid,
       CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
       CAST(n_chars AS DOUBLE) / 100e0 AS kw, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(n_chars % 500 AS DOUBLE) END AS found
FROM documents
"""

#: Stored captures: one in 50 was changed after its digest was taken, one in 70 has another resolution.
CAPTURES = """
SELECT doc_id, text, n_chars AS stored_chars, sha2(CASE WHEN doc_id % 50 = 0 THEN concat(text, 'x') ELSE text END, 256) AS stored_sha256,
       10e0 + CAST(doc_id % 7 AS DOUBLE) / 8e0 AS ppm, (10e0 + CAST(doc_id % 7 AS DOUBLE) / 8e0) * CASE WHEN doc_id % 70 = 3 THEN 1.001e0 ELSE 1e0 END AS stored_ppm
FROM documents
"""

#: Nine samples on the roof of each tile, and the heights around it: a wall in the south, a gap without heights in some.
#: Tiles are dealt out before their cells are made: by their own size they would go to one task.
SAMPLES = """
SELECT t.tile_id, CAST(n.n AS BIGINT) AS sample, 126e0 + 2e0 * (n.n % 3) AS x, 126e0 + 2e0 * CAST(floor(n.n / 3e0) AS DOUBLE) AS y, 498e0 + CAST(t.tile_id % 4 AS DOUBLE) AS z
FROM (SELECT DISTINCT CAST(floor(event_id / 1600e0) AS BIGINT) AS tile_id FROM events) t CROSS JOIN numbers n WHERE n.n < 9
"""
TERRAIN = """
SELECT tile_id, cx, cy, CASE WHEN tile_id % 5 = 3 AND cx < 100 THEN NULL WHEN cy BETWEEN 108 AND 111 AND cx BETWEEN 100 AND 120 + 5 * (tile_id % 7) THEN 506e0 + CAST(tile_id % 6 AS DOUBLE)
                             ELSE 490e0 + CAST((cx * 7 + cy * 3) % 11 AS DOUBLE) / 10e0 END AS z
FROM (SELECT /*+ REPARTITION(200, tile_id) */ DISTINCT CAST(floor(event_id / 1600e0) AS BIGINT) AS tile_id FROM events) t EACH(cx, CAST(0 AS BIGINT), CAST(255 AS BIGINT)) EACH(cy, CAST(0 AS BIGINT), CAST(255 AS BIGINT))
"""

#: Outlines of buildings on a map as edges: eight corners around a middle, every third with a court, every fifth with a
#: second part; and blocks of the map, one for each supplier.
def _corner(x_or_y: str, k: str, ways: str, radius: str, middle: str) -> str:
    return f"CAST({middle} + (CAST(substr('{ways}', CAST({k} AS INT) + 1, 1) AS BIGINT) - 1) * ({radius}) AS DOUBLE) AS {x_or_y}"


def _around(key: str, table: str, corners: int, ways: tuple[str, str], radius: str, middle: tuple[str, str], part: int, ring: int, where: str) -> str:
    """Edges between ``corners`` corners, in the directions of ``ways`` (0, 1, 2 for -1, 0, 1) and with a radius by k."""
    after = f"((k + 1) % {corners})"
    ends = (_corner(f"{e}{c}", k, ways[i], radius.format(k=k), middle[i]) for e, k in (("u", "k"), ("v", after)) for i, c in enumerate("xy"))
    return f"SELECT {key} AS polygon_id, CAST({part} AS BIGINT) AS part, CAST({ring} AS BIGINT) AS ring, k AS i, {', '.join(ends)} FROM (SELECT * FROM {table} WHERE {where}) t EACH(k, CAST(0 AS BIGINT), CAST({corners - 1} AS BIGINT))"


_MIDDLE = ("40 * ({0} % 128)", "40 * CAST(floor({0} / 128e0) AS BIGINT)")
_HERE = tuple(m.format("o_orderkey") for m in _MIDDLE)
_COMPASS, _SQUARE, _BACK = ("22100012", "12221000"), ("2200", "0220"), ("1012", "0121")
OUTLINES = " UNION ALL ".join(
    (
        _around("o_orderkey", "orders", 8, _COMPASS, "4 + (o_orderkey * 7 + {k} * 5) % 9", _HERE, 0, 0, "o_orderkey > 0"),
        _around("o_orderkey", "orders", 4, _BACK, "2", _HERE, 0, 1, "o_orderkey % 3 = 0"),
        _around("o_orderkey", "orders", 4, _SQUARE, "3", (f"19 + {_HERE[0]}", _HERE[1]), 1, 0, "o_orderkey % 5 = 0"),
        _around("1000000000 + s_suppkey", "supplier", 4, _SQUARE, "95", ("95 + 200 * (s_suppkey % 25)", "90 + 200 * CAST(floor(s_suppkey / 25e0) AS BIGINT)"), 0, 0, "s_suppkey >= 0"),
    )
)
_BUILDING = "(1 + (event_id * 37) % 1499)"
_THERE = tuple(m.format(_BUILDING) for m in _MIDDLE)
#: Clicks near buildings, on corners and edges too.
CLICKS = f"""
SELECT event_id AS point_id, CAST({_THERE[0]} AS DOUBLE) + CAST((event_id * 7) % 57 - 24 AS DOUBLE) / 2e0 AS x, CAST({_THERE[1]} AS DOUBLE) + CAST((event_id * 11) % 53 - 26 AS DOUBLE) / 2e0 AS y FROM events
"""
#: Things that were surveyed on and beside roofs: four corners around a middle.
_THING = (f"({_THERE[0]} + (event_id * 5) % 31 - 13)", f"({_THERE[1]} + (event_id * 3) % 21 - 10)")
SURVEYED = f"SELECT {_BUILDING} AS building_id, e.* FROM ({_around('event_id', 'events', 4, ('2101', '1210'), '1 + (event_id + {k} * 3) % 4', _THING, 0, 0, 'event_id >= 0')}) e".replace(f"SELECT {_BUILDING} AS building_id", f"SELECT {_BUILDING.replace('event_id', 'polygon_id')} AS building_id")

#: Heights of a square map of cells of 16 m, numbered along a Z curve so that it grows in both directions with the table:
#: ground, houses of 1 by 2 cells, and ponds of a cell without heights.
_CURVE = tuple(" + ".join(f"CAST(floor(event_id / {float(4**k * 2**c)!r}) AS BIGINT) % 2 * {2**k}" for k in range(12)) for c in (0, 1))
HEIGHTS = f"""
SELECT cx, cy, CASE WHEN cx % 32 = 13 AND cy % 32 = 18 THEN NULL WHEN cx % 4 = 1 AND cy % 4 BETWEEN 1 AND 2 THEN 498e0 + value / 90e0 ELSE 490e0 + value / 490e0 END AS z
FROM (SELECT event_id, value, {_CURVE[0]} AS cx, {_CURVE[1]} AS cy FROM events) e
"""
#: A sample on the face of each building that is clicked, on and between the houses.
ROOF_SAMPLES = """
SELECT building_id * 100 + part_no AS id, face_id, CAST(130 + (building_id * 37) % 241 AS DOUBLE) + 0.25e0 AS x, CAST(130 + (building_id * 91) % 239 AS DOUBLE) + 0.75e0 AS y,
       494e0 + CAST(s % 9 AS DOUBLE) AS z, pitch, azimuth
FROM faces_of WHERE contains_click
"""

#: Captures with sizes in pixels, some of one view only.
VIEW_CAPTURES = "SELECT user_id AS capture_id, 500 + (user_id * 137) % 2300 AS width, 400 + (user_id * 211) % 1500 AS height FROM events GROUP BY user_id"

BINDINGS = {
    "view_captures": VIEW_CAPTURES,
    "heights": HEIGHTS, "roof_samples": ROOF_SAMPLES.replace("faces_of", f"({FACES}) f"),
    "edges": OUTLINES, "points": CLICKS, "objects": SURVEYED,
    "raw_faces": RAW_FACES, "faces": FACES, "overrides": OVERRIDES, "plants": PLANTS, "detections": DETECTIONS, "cells": CELLS, "tiles": TILES, "texts": TEXTS,
    "vectors": VECTORS, "truth": TRUTH, "splits": SPLITS, "captures": CAPTURES, "samples": SAMPLES, "terrain": TERRAIN, **{t: f"SELECT * FROM {t}" for t in TABLES},
}
