"""Shade as relations: samples on roofs, rays over heights, and the sun of a year by its directions.

Samples and heights of a tile meet by one shuffle by tile, and a small numpy helper looks along the rays, so that rays
never travel as rows; the oracles join each point of each ray. Rays and the sun are relations of fixed size. The same is
done for whole faces and large windows, a block at a time, in roofs.py.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.functions.scalars import declination, equation_of_time
from sunspan.operators._sql import SqlOperator, ansi, operator

#: 144 azimuths, and distances of .5 to 20 m by .5 and of 21 to 120 m by 1.
RAYS = """SELECT a.n AS bin, CASE WHEN m.n < 40 THEN 0.5e0 * (m.n + 1) ELSE m.n - 19e0 END AS d, radians(a.n * 2.5e0) AS angle
          FROM {numbers} a CROSS JOIN {numbers} m WHERE a.n < 144 AND m.n < 140"""
HORIZONS = f"""SELECT s.tile_id, s.sample, s.bin, greatest(0e0, max(coalesce(atan2(t.z - s.z - 0.25e0, s.d), -pi() / 2e0))) AS horizon, avg(CASE WHEN t.z IS NULL THEN 0e0 ELSE 1e0 END) AS coverage
               FROM (SELECT p.tile_id, p.sample, p.z, r.bin, r.d, CAST(floor(p.x + r.d * sin(r.angle)) AS BIGINT) AS cx, CAST(floor(p.y + r.d * cos(r.angle)) AS BIGINT) AS cy FROM {{samples}} p CROSS JOIN ({RAYS}) r) s
               LEFT JOIN {{terrain}} t ON t.tile_id = s.tile_id AND t.cx = s.cx AND t.cy = s.cy GROUP BY s.tile_id, s.sample, s.bin"""


def tile_horizons(samples: DataFrame, terrain: DataFrame) -> DataFrame:
    """The rows of HORIZONS: a tile's samples and cells meet in a task, and cells are looked up by their place in its box."""
    angle = np.array([math.radians(b * 2.5) for b in range(144)])
    d = np.array([0.5 * (m + 1) if m < 40 else m - 19.0 for m in range(140)])
    dx, dy = (d * np.array([[f(a)] for a in angle]) for f in (math.sin, math.cos))
    schema = pa.schema([("tile_id", pa.int64()), ("sample", pa.int64()), ("bin", pa.int64()), ("horizon", pa.float64()), ("known", pa.int64()), ("asked", pa.int64())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if right.num_rows:
            cx, cy, z = (right.column(c).to_numpy() for c in ("cx", "cy", "z"))
            has = right.column("z").is_valid().to_numpy()
            x0, y0, wide, high = cx.min(), cy.min(), cx.max() - cx.min() + 1, cy.max() - cy.min() + 1
            cell = (cy - y0) * wide + cx - x0
            top = np.full(wide * high, -np.inf)
            np.maximum.at(top, cell[has], z[has])
            rows, known = np.bincount(cell, minlength=wide * high), np.bincount(cell[has], minlength=wide * high)
        for tile, sample, x, y, eye in zip(*(left.column(c).to_pylist() for c in ("tile_id", "sample", "x", "y", "z")), strict=True):
            horizon, seen, asked = np.zeros(144), np.zeros(144, dtype=np.int64), np.full(144, 140)
            if right.num_rows and None not in (x, y):
                col, row = (np.floor(c + e).astype(np.int64) - c0 for c, e, c0 in ((x, dx, x0), (y, dy, y0)))
                there = (col >= 0) & (col < wide) & (row >= 0) & (row < high)
                at = np.where(there, row * wide + col, 0)
                seen, asked = np.where(there, known[at], 0).sum(axis=1), np.where(there, np.maximum(1, rows[at]), 1).sum(axis=1)
                if eye is not None:
                    horizon = np.maximum(0.0, np.arctan2(np.where(there, top[at], -np.inf) - eye - 0.25, d).max(axis=1))
            made.append((np.full(144, tile), np.full(144, sample), np.arange(144), horizon, seen, asked))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], schema=schema) if made else schema.empty_table()

    cells = terrain.where("tile_id is not null and cx is not null and cy is not null").select("tile_id", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("z").cast("double").alias("z"))
    double = [F.col(c).cast("double").alias(c) for c in "xyz"]
    placed = samples.select("tile_id", "sample", *double)
    met = placed.groupBy("tile_id").cogroup(cells.groupBy("tile_id")).applyInArrow(look, "tile_id long, sample long, bin long, horizon double, known long, asked long")
    return met.groupBy("tile_id", "sample", "bin").agg(F.max("horizon").alias("horizon"), (F.sum("known") / F.sum("asked")).alias("coverage"))


def over_horizons(name: str, text: str, inputs: str = "samples terrain numbers", **settings: float) -> SqlOperator:
    """An operator over ``{horizons}``; its oracle is over all points of all rays."""
    oracle = ansi(text.replace("{horizons}", f"({HORIZONS})"))
    return operator(name, inputs, text, oracle=oracle, derived={"horizons": lambda samples, terrain, **_: tile_horizons(samples, terrain)}, **settings)


ray_horizon = over_horizons("j15_ray_horizon", f"SELECT tile_id, sample, bin, bround(horizon, 6) AS horizon, bround(coverage, 6) AS coverage FROM {{horizons}} h")
horizon = over_horizons("a15_horizon", f"SELECT tile_id, bin, bround(max(horizon), 6) AS highest, bround(avg(coverage), 6) AS coverage FROM {{horizons}} h GROUP BY tile_id, bin")

HOURS = f"""SELECT month, hour, days, decl, radians((hour * 60e0 + eqt + 4e0 * :lon) / 4e0 - 180e0) AS ha, radians(:lat) AS phi FROM (
    SELECT month, hour, days, {declination("g")} AS decl, {equation_of_time("g")} AS eqt FROM (
        SELECT month, hour, day(last_day(make_date(2025, month, 1))) AS days, 2e0 * pi() / 365e0 * (dayofyear(make_date(2025, month, 21)) - 1 + (hour - 12e0) / 24e0) AS g
        FROM (SELECT CAST(m.n + 1 AS INT) AS month, 4e0 + h.n / 2e0 AS hour FROM {{numbers}} m CROSS JOIN {{numbers}} h WHERE m.n < 12 AND h.n < 33) t) s) a"""
POSITIONS = f"SELECT month, hour, days, -cos(decl) * sin(ha) AS east, cos(phi) * sin(decl) - sin(phi) * cos(decl) * cos(ha) AS north, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha) AS up FROM ({HOURS}) h"
#: Directions of the sun before a plane with normal (nx, ny, nz): above 5 degrees, weighed by incidence and days.
DIRECTIONS = f"""SELECT month, hour, up, CAST(bround(CASE WHEN azimuth < 0 THEN azimuth + 360e0 ELSE azimuth END / 2.5e0, 0) AS BIGINT) % 144 AS bin, {{1}} incidence * days AS weight FROM (
    SELECT {{0}} month, hour, days, up, degrees(atan2(east, north)) AS azimuth, east * nx + north * ny + up * nz AS incidence FROM {{2}}) i WHERE incidence > 0 AND up > sin(radians(5e0))"""
PLANES = "SELECT DISTINCT pitch, azimuth, sin(radians(pitch)) * sin(radians(azimuth)) AS nx, sin(radians(pitch)) * cos(radians(azimuth)) AS ny, cos(radians(pitch)) AS nz FROM {faces}"
_OF_PLANES = DIRECTIONS.replace("{0}", "pitch, azimuth AS facing,").replace("{1}", "pitch, facing,").replace("{2}", f"({PLANES}) f CROSS JOIN ({POSITIONS}) p")
_LEVEL = DIRECTIONS.replace("{0}", "").replace("{1}", "").replace("{2}", f"(SELECT *, 0e0 AS nx, 0e0 AS ny, 1e0 AS nz FROM ({POSITIONS}) p) q")
sampled_sun = operator("p12_sampled_sun", "faces numbers", f"SELECT pitch, facing, month, hour, bround(up, 6) AS up, bround(weight, 6) AS weight FROM ({_OF_PLANES}) s", lat=47.0, lon=8.0)
sun_bins = operator("j16_azimuth_bin", "faces numbers", f"SELECT pitch, facing, month, hour, bin FROM ({_OF_PLANES}) s", lat=47.0, lon=8.0)

#: Access of each sample of a level face; null where less than 98 % of what weighs is known.
ACCESS = f"""SELECT tile_id, sample, CASE WHEN known >= 0.98e0 THEN annual END AS annual, CASE WHEN known >= 0.98e0 THEN winter END AS winter, known FROM (
    SELECT h.tile_id, h.sample, sum(CASE WHEN asin(least(1e0, s.up)) > h.horizon THEN s.weight ELSE 0e0 END) / sum(s.weight) AS annual, sum(h.coverage * s.weight) / sum(s.weight) AS known,
           sum(CASE WHEN s.month IN (11, 12, 1, 2) AND asin(least(1e0, s.up)) > h.horizon THEN s.weight ELSE 0e0 END) / nullif(sum(CASE WHEN s.month IN (11, 12, 1, 2) THEN s.weight END), 0e0) AS winter
    FROM {{horizons}} h JOIN ({_LEVEL}) s ON s.bin = h.bin GROUP BY h.tile_id, h.sample) a"""
sun_access = over_horizons("a16_sun_access", f"SELECT tile_id, sample, bround(annual, 6) AS annual, bround(winter, 6) AS winter, bround(known, 6) AS known FROM ({ACCESS}) a", lat=47.0, lon=8.0)
sunlight = over_horizons(
    "k4_analyse_sunlight",
    f"""SELECT tile_id, count(annual) > 0 AS available, bround(count(annual) * 1e0 / count(*), 6) AS coverage_fraction, bround(avg(annual), 6) AS mean_direct_sun_access, bround(avg(winter), 6) AS winter_direct_sun_access
        FROM ({ACCESS}) a GROUP BY tile_id""",
    lat=47.0, lon=8.0,
)
sun_exclusions = over_horizons("k3_sunlight_exclusions", f"SELECT tile_id, sample FROM ({ACCESS}) a WHERE annual < :minimum_sun_access", lat=47.0, lon=8.0, minimum_sun_access=0.6)

#: One hour: states of samples of a level face; unknown where the ray is not known, all shade at night.
STATES = f"""SELECT h.tile_id, h.sample, CASE WHEN p.up <= 0 THEN 'shade' WHEN h.coverage IS NULL OR h.coverage < 0.98e0 THEN 'unknown' WHEN asin(least(1e0, p.up)) <= h.horizon THEN 'shade' ELSE 'sun' END AS state
    FROM (SELECT *, CAST(bround(CASE WHEN azimuth < 0 THEN azimuth + 360e0 ELSE azimuth END / 2.5e0, 0) AS BIGINT) % 144 AS bin FROM (SELECT *, degrees(atan2(east, north)) AS azimuth FROM ({POSITIONS}) q WHERE month = :month AND hour = :hour) o) p
    JOIN {{horizons}} h ON h.bin = p.bin"""
shadow = over_horizons("k5_instantaneous_shadow", f"SELECT tile_id, sample, state FROM ({STATES}) s", lat=47.0, lon=8.0, month=12, hour=11.0)
shadow_query = over_horizons(
    "k11_shadow_query",
    f"SELECT tile_id, bround(sum(CASE WHEN state = 'shade' THEN 1e0 ELSE 0e0 END) / count(*), 6) AS shade, bround(sum(CASE WHEN state = 'unknown' THEN 1e0 ELSE 0e0 END) / count(*), 6) AS unknown FROM ({STATES}) s GROUP BY tile_id",
    lat=47.0, lon=8.0, month=3, hour=9.0,
)
