"""Horizons over a pyramid of heights against asking every height, and access to sun on tilted faces."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sunspan.operators import horizon, roofs

STEP = 1.0
SAMPLES = "id long, face_id string, x double, y double, z double, pitch double, azimuth double"


def scene(seed):
    """Ground that rises, houses, trees and a pond without heights."""
    r = random.Random(seed)
    grid = np.fromfunction(lambda y, x: 400 + 0.02 * x, (340, 340))
    for _ in range(60):
        y, x, h = r.randrange(330), r.randrange(330), r.uniform(3, 14)
        grid[y : y + r.randrange(2, 14), x : x + r.randrange(2, 14)] += h
    grid[150:156, 60:90] = np.nan
    grid[5, 5], grid[9, 9] = 9999, -200
    return grid


def heights_of(spark, grid):
    rows = [(x, y, None if math.isnan(z) else float(z)) for y, line in enumerate(grid) for x, z in enumerate(line.tolist())]
    return spark.createDataFrame(rows, "cx long, cy long, z double").repartition(4)


def samples_of(spark, grid, n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = r.uniform(120, 220) if k % 3 else r.uniform(-20, 360), r.uniform(120, 220)
        z = 400 + 0.02 * x + r.choice([6.0, 9.0, 12.0])  # on roofs
        rows.append((k, f"f{k // 4}", x, y, z, float(r.choice([0, 20, 45])), float(r.choice([0, 135, 180, 270]))))
    return rows, spark.createDataFrame(rows, SAMPLES)


def dense(grid, rows):
    known = np.where((grid >= horizon.LOW) & (grid <= horizon.HIGH), grid, np.nan)[::-1]
    return roofs.horizons(np.array([r[2:5] for r in rows]), known, 0.0, float(grid.shape[0]), STEP)


@pytest.mark.parametrize("seed", [1, 2])
def test_horizons_equal_asking_every_height_with_fewer_rows(spark, seed):
    grid = scene(seed)
    rows, samples = samples_of(spark, grid, 24, seed)
    high, seen = dense(grid, rows)
    joined: list[int] = []
    found = {(r.id, r.bin): (r.slope, r.missing) for r in horizon.horizons(samples, heights_of(spark, grid), STEP, joined).collect()}
    for k in range(len(rows)):
        for b in range(144):
            slope, missing = found.get((k, b), (0.0, 0))
            assert math.atan(slope) == pytest.approx(high[k, b], abs=1e-9)
            assert missing == round(140 * (1 - seen[k, b]))
    assert (high > 0).any() and (seen < 1).any()
    assert sum(joined) < 0.15 * len(rows) * 144 * 140, joined


def test_access_on_tilted_faces_equals_the_sun_over_dense_horizons(spark):
    grid = scene(3)
    rows, samples = samples_of(spark, grid, 24, 3)
    high, seen = dense(grid, rows)
    found = {r.id: r for r in horizon.sun_access(samples, heights_of(spark, grid), 47.0, 8.0, STEP).collect()}
    states = set()
    for k, row in enumerate(rows):
        tilt, facing = math.radians(row[5]), math.radians(row[6])
        normal = np.array([math.sin(tilt) * math.sin(facing), math.sin(tilt) * math.cos(facing), math.cos(tilt)])
        sun, weight, month = roofs.sampled_sun(47.0, 8.0, normal)
        bins, winter = roofs.azimuth_bin(sun), np.isin(month, roofs.WINTER)
        visible = np.arcsin(sun[:, 2]) > high[k, bins]
        known = (seen[k, bins] * weight).sum() / weight.sum()
        assert found[k].known == pytest.approx(known, abs=1e-9)
        states.add(known >= horizon.KNOWN)
        if known >= horizon.KNOWN:
            assert found[k].annual == pytest.approx((visible * weight).sum() / weight.sum(), abs=1e-6)
            if winter.any():
                assert found[k].winter == pytest.approx((visible * weight)[winter].sum() / weight[winter].sum(), abs=1e-6)
            else:
                assert found[k].winter is None
        else:
            assert found[k].annual is None and found[k].winter is None
    assert states == {True, False}


def test_a_wall_in_the_south_takes_sun_and_excludes(spark):
    grid = np.full((300, 300), 400.0)
    flat = [(0, "a", 150.5, 150.5, 401.0, 0.0, 180.0), (1, "b", 150.5, 40.5, 401.0, 0.0, 180.0), (2, "c", None, None, None, 0.0, 180.0), (3, "d", 150.5, 150.5, 401.0, None, None)]
    grid[140:146, 100:200] = 425.0
    access = horizon.sun_access(spark.createDataFrame(flat, SAMPLES), heights_of(spark, grid), step=STEP)
    found = {r.id: r for r in access.collect()}
    assert found[0].winter < found[0].annual < 0.6 and found[1].annual is None  # too near the edge of what is known
    assert found[2].annual is None and abs(found[2].known) < 1e-9 and found[3].annual is None
    assert [r.face_id for r in horizon.sunlight_exclusions(access, 0.6).collect()] == ["a"]
    faces = {r.face_id: r for r in horizon.face_sunlight(access).collect()}
    assert faces["a"].available and faces["a"].coverage_fraction == 1 and not faces["b"].available
    empty = spark.createDataFrame([], SAMPLES)
    assert horizon.horizons(empty, heights_of(spark, grid[:2, :2]), STEP).collect() == []


def test_access_makes_no_rows_of_rays_and_parts_change_nothing(spark, monkeypatch):
    """Rows of a sample stay as many as samples, and a block dealt to several parts gives the same."""
    grid = scene(4)
    _, samples = samples_of(spark, grid, 24, 4)
    again = samples.unionByName(samples.withColumn("id", samples.id + 100))
    whole = {r.id: tuple(r)[1:] for r in horizon.sun_access(samples, heights_of(spark, grid), step=STEP).collect()}
    monkeypatch.setattr(horizon, "DEALT", 5)
    monkeypatch.setattr(horizon, "horizons", None)  # its tiles are rows for each sample
    parts = {r.id: tuple(r)[1:] for r in horizon.sun_access(again, heights_of(spark, grid), step=STEP).collect()}
    assert len(whole) == 24 and parts == whole | {k + 100: v for k, v in whole.items()}
