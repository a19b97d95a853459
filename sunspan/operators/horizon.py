"""Horizons over a pyramid of heights, and the access to direct sun of samples on tilted faces.

A sample looks along 144 azimuths at 140 distances. Asking the height below each of these is 20,160 rows a sample; here
the rays are dealt to square tiles around the sample, and heights to a pyramid of block maxima and known counts. A
sample asks coarse tiles first, then the finer tiles of those that stand higher than it or are not wholly known. Of
these it looks into the steepest of each direction, and then only into those that could still raise the horizon of
some of their rays. What is lower costs a row for its coarse tile, and results are those of asking all. On roofs among
houses and trees some 12 % of the rows of the dense form are joined. Access to sun makes no such rows: samples meet the
heights around their block in a task, which looks along the rays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators import shade
from sunspan.operators._shared import stored
from sunspan.operators._sql import spark_text

#: Cells of a fine tile along a side, and fine tiles of a coarse one; directions of which the steepest tile is asked first.
FINE, COARSE, SECTORS = 4, 4, 36
#: Height that a module stands above its face, with the uncertainty of heights; least share of what weighs to be known.
CLEARANCE, KNOWN = 0.25, 0.98
LOW, HIGH = -100.0, 5000.0
#: Samples of a block that are looked at together; a block of more is dealt to several parts.
DEALT = 10_000


def _rays(samples: DataFrame, step: float) -> DataFrame:
    """bin, d, dx, dy and the fine and coarse tile of each point of a ray, relative to a sample; 20,160 rows."""
    spark = samples.sparkSession
    rays = spark.sql(shade.RAYS.replace("{numbers}", "range(200)").replace("a.n", "a.id").replace("m.n", "m.id"))
    rays = rays.select(F.col("bin").cast("int").alias("bin"), F.col("d").cast("double").alias("d"), (F.col("d") * F.sin("angle")).alias("dx"), (F.col("d") * F.cos("angle")).alias("dy"))
    fine = FINE * step
    tiles = {f"{name}{c}": F.floor(F.col(f"d{c}") / size).cast("int") for name, size in (("f", fine), ("g", fine * COARSE)) for c in "xy"}
    return stored(rays.withColumns(tiles).coalesce(1), "rays")


def _windows(blocks: DataFrame, side: int) -> DataFrame:
    """Of blocks (bx, by, top, known) the greatest top and the known cells of each two by two; full if none is missing."""
    ends = F.explode(F.array(*[F.struct((F.col("bx") - i).alias("wx"), (F.col("by") - j).alias("wy")) for i in (0, 1) for j in (0, 1)]))
    wide = blocks.select(ends.alias("w"), "top", "known").groupBy("w.wx", "w.wy").agg(F.max("top").alias("top"), F.sum("known").alias("known"))
    return wide.select("wx", "wy", "top", (F.col("known") == 4 * side * side).alias("full"))


def pyramid(heights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known cells (cx, cy, z), and windows of fine and of coarse blocks, from heights (cx, cy, z), a row for each cell."""
    cells = heights.where(f"z >= {LOW} and z <= {HIGH}").select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("z").cast("double").alias("z"))
    cells = stored(cells, "heights")  # Spark knows its size then
    group = lambda df, x, y, side, top, known: df.groupBy(F.floor(F.col(x) / side).alias("bx"), F.floor(F.col(y) / side).alias("by")).agg(F.max(top).alias("top"), known.alias("known"))
    fine = stored(group(cells, "cx", "cy", FINE, "z", F.count(F.lit(1))), "pyramid")
    coarse = group(fine, "bx", "by", COARSE, "top", F.sum("known"))
    return cells, stored(_windows(fine, FINE), "fine"), stored(_windows(coarse, FINE * COARSE), "coarse")


def horizons(samples: DataFrame, heights: DataFrame, step: float = 1.0, joined: list[int] | None = None) -> DataFrame:
    """id, bin, slope and missing of samples (id, x, y, z): the tangent of the horizon and how many of 140 heights are unknown.

    Heights (cx, cy, z) have a row for each cell of ``step`` metres; a null height, one out of range or a cell without
    a row is unknown. Rows come only for bins with a horizon above level or with unknown heights: all else is (0, 0).
    Samples meet windows and cells by equality of numbers; rays and tiles are relations of fixed size. A sample with a
    null position meets nothing, so all its bins are unknown; ids are to differ; an empty table stays empty. ``joined``
    is given the numbers of rows that were joined with heights, which costs further jobs.
    """
    fine_side, coarse_side = FINE * step, FINE * COARSE * step
    rays = _rays(samples, step)
    cells, fine, coarse = pyramid(heights)
    here = samples.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("z") + CLEARANCE).alias("eye"))

    def noted(df: DataFrame) -> DataFrame:
        if joined is not None:
            joined.append(df.count())
        return df

    higher = F.coalesce(F.col("top") > F.col("eye"), F.lit(False))

    def below(df: DataFrame, windows: DataFrame, c: tuple[str, str], side: float) -> DataFrame:
        """Tiles with top and full of their windows; full is null where nothing is known."""
        df = df.withColumns({"wx": F.floor(F.col("x") / side) + F.col(c[0]), "wy": F.floor(F.col("y") / side) + F.col(c[1])})
        return noted(df).join(windows, ["wx", "wy"], "left").withColumn("bound", F.when(higher, (F.col("top") - F.col("eye")) / F.col("near")).otherwise(0.0))

    def steepest(df: DataFrame, tile: list[str]) -> DataFrame:
        """``df`` with first: true for the steepest tile of each direction, and for those with unknown cells."""
        sector = F.floor((F.degrees(F.atan2(F.col(tile[0]) + 0.5, F.col(tile[1]) + 0.5)) + 180) * SECTORS / 360.001).cast("int")
        best = df.groupBy("id", sector.alias("sector")).agg(F.max_by(F.struct(*tile), F.struct("bound", *tile)).alias("t")).select("id", "t.*", F.lit(True).alias("best"))
        return stored(df.join(best, ["id", *tile], "left").withColumn("first", ~F.col("full") | F.coalesce("best", F.lit(False))).drop("best"), "tiles")

    def looked_into(points: DataFrame) -> DataFrame:
        """id, bin, slope and missing of points of rays."""
        points = points.withColumns({"cx": F.floor((F.col("x") + F.col("dx")) / step), "cy": F.floor((F.col("y") + F.col("dy")) / step)})
        met = noted(points.select("id", "bin", "eye", "d", "cx", "cy")).join(cells, ["cx", "cy"], "left")
        slope = F.greatest(F.lit(0.0), F.coalesce(F.max((F.col("z") - F.col("eye")) / F.col("d")), F.lit(0.0)))
        return met.groupBy("id", "bin").agg(slope.alias("slope"), F.count_if(F.col("z").isNull()).alias("missing"))

    def fine_of(df: DataFrame) -> DataFrame:
        parts = F.broadcast(rays.groupBy("gx", "gy", "fx", "fy").agg(F.min("d").alias("near")))
        found = below(df.select("id", "x", "y", "eye", "gx", "gy").join(parts, ["gx", "gy"]), fine, ("fx", "fy"), fine_side)
        return found.where(higher | F.coalesce(~F.col("full"), F.lit(True))).select("id", "x", "y", "eye", "gx", "gy", "fx", "fy", "full", "bound", (F.col("top") - F.col("eye")).alias("rise"))

    # coarse tiles: a row for each that the rays reach, fixed for all samples
    tiles = F.broadcast(rays.groupBy("gx", "gy").agg(F.min("d").alias("near")))
    asked = stored(below(here.crossJoin(tiles), coarse, ("gx", "gy"), coarse_side).where("full is null or not full or bound > 0").select("id", "x", "y", "eye", "gx", "gy", "full", "bound"), "coarse-tiles")
    coarse_tiles = steepest(asked.where("full is not null"), ["gx", "gy"])

    # of the steepest coarse tiles of each direction the steepest fine ones; their slopes bound what others may add
    inner = stored(fine_of(coarse_tiles.where("first")), "fine-tiles")
    tile = ["gx", "gy", "fx", "fy"]
    fine_tiles = steepest(inner.where("full is not null"), ["fx", "fy", "gx", "gy"])
    first = stored(looked_into(fine_tiles.where("first").join(F.broadcast(rays), tile)), "first")
    so_far = F.coalesce("slope", F.lit(0.0))

    def could_raise(df: DataFrame, of: list[str], bound) -> DataFrame:
        """Tiles by bin, where the tile's bound there is above the slope that is known."""
        bins = F.broadcast(rays.groupBy(*of, "bin").agg(F.min("d").alias("nearest")))
        return df.join(bins, of).join(first.select("id", "bin", "slope"), ["id", "bin"], "left").where(bound > so_far)

    others = could_raise(coarse_tiles.where("not first"), ["gx", "gy"], F.col("bound")).select("id", "x", "y", "eye", "gx", "gy").distinct()
    later = fine_of(others)
    rest = fine_tiles.where("not first").select("id", "x", "y", "eye", *tile, "rise").unionByName(later.select("id", "x", "y", "eye", *tile, "rise"))
    rest = could_raise(rest, tile, F.col("rise") / F.col("nearest")).select("id", "bin", "x", "y", "eye", *tile)
    rest = looked_into(rest.join(F.broadcast(rays), [*tile, "bin"]))

    gone = []
    for df, of in ((asked, ["gx", "gy"]), (inner, tile)):
        unknown = F.broadcast(rays.groupBy(*of, "bin").agg(F.count(F.lit(1)).alias("missing")))
        gone.append(df.where("full is null").join(unknown, of).select("id", "bin", F.lit(0.0).alias("slope"), "missing"))
    every = first.unionByName(rest).unionByName(gone[0]).unionByName(gone[1]).groupBy("id", "bin").agg(F.max("slope").alias("slope"), F.sum("missing").alias("missing"))
    return every.where("slope > 0 or missing > 0")


def _looked(rays: dict[str, np.ndarray], sun: dict[str, np.ndarray], step: float):
    """Of rows of cells (kind 0) and then samples (kind 1) of each key the sums that a sample's plane loses, batch by batch."""
    d, dx, dy = (rays[c].reshape(144, 140) for c in ("d", "dx", "dy"))
    winter = np.isin(sun["month"], (11, 12, 1, 2))

    def lost(grid: np.ndarray | None, low: tuple[int, int], x, y, z, normals) -> np.ndarray:
        spots, of = np.unique(np.stack([x, y], axis=1), axis=0, return_inverse=True)
        eyes, at = np.unique(np.stack([of.ravel(), z + CLEARANCE], axis=1), axis=0, return_inverse=True)  # equal positions are asked once
        slope, missing, top, last = np.zeros((len(eyes), 144)), np.full((len(eyes), 144), 140.0), None, -1
        for k, (spot, eye) in enumerate(eyes):
            if spot != last:
                last, top = spot, None
                if grid is not None and np.isfinite(spots[int(spot)]).all():
                    col, row = (np.floor((c + e) / step).astype(np.int64) - c0 for c, e, c0 in zip(spots[int(spot)], (dx, dy), low, strict=True))
                    there = (col >= 0) & (col < grid.shape[1]) & (row >= 0) & (row < grid.shape[0])
                    top = np.where(there, grid[np.where(there, row, 0), np.where(there, col, 0)], np.nan)
                    unknown = np.isnan(top).sum(axis=1)
            if top is not None:
                slope[k], missing[k] = np.fmax(0.0, np.fmax.reduce((top - eye) / d, axis=1)), unknown
        out = np.empty((len(x), 5))
        for i in range(0, len(x), 1000):
            n, p = normals[i : i + 1000], at.ravel()[i : i + 1000]
            incidence = n[:, :1] * sun["east"] + n[:, 1:2] * sun["north"] + n[:, 2:] * sun["up"]
            weight = np.where(incidence > 0, incidence * sun["days"], 0.0)  # none of a null plane
            hidden = np.where(sun["rise"] <= slope[p][:, sun["bin"]], weight, 0.0)
            unseen = weight * missing[p][:, sun["bin"]] / 140
            out[i : i + 1000] = np.stack([weight.sum(axis=1), weight[:, winter].sum(axis=1), hidden.sum(axis=1), hidden[:, winter].sum(axis=1), unseen.sum(axis=1)], axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, grid, low = None, [], None, (0, 0)
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("bx", "by", "salt", "kind")], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if b.num_rows else []
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here, part = tuple(keys[i, :3]), b.slice(int(i), int(j - i))
                if here != key:
                    key, cells, grid = here, [], None
                if keys[i, 3] == 0:
                    cells.append([part.column(c).to_numpy() for c in ("cx", "cy", "z")])
                    continue
                if cells:
                    cx, cy, top = (np.concatenate(c) for c in zip(*cells, strict=True))
                    low, grid, cells = (cx.min(), cy.min()), np.full((cy.max() - cy.min() + 1, cx.max() - cx.min() + 1), np.nan), []
                    np.fmax.at(grid, (cy - low[1], cx - low[0]), top)
                x, y, z, *normal = (part.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "nx", "ny", "nz"))
                sums = lost(grid, low, x, y, z, np.stack(normal, axis=1))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "face_id": part.column("face_id")} | {c: sums[:, k] for k, c in enumerate(SUMS)})

    return run


#: What is summed for a sample: weights of its plane, in winter, and what of these is hidden or unknown.
SUMS = ("whole", "whole_winter", "hidden", "hidden_winter", "unknown")


def sun_access(samples: DataFrame, heights: DataFrame, lat: float = 47.0, lon: float = 8.0, step: float = 1.0) -> DataFrame:
    """id, face_id, annual, winter and known of samples (id, face_id, x, y, z, pitch, azimuth) on tilted faces.

    annual and winter are the shares of direct sun, weighed by incidence and days, that no horizon hides; null where
    less than KNOWN of what weighs is known, or where the sun never stands before the plane. Samples are dealt to square
    blocks, and those of a block to parts of some ``DEALT``; each part is sent the heights that its rays may reach, and
    a task looks along the rays, once for equal positions. Rays and the sun of a year are relations of fixed size.
    """
    spark = samples.sparkSession
    rays = spark.sql(shade.RAYS.replace("{numbers}", "range(200)").replace("a.n", "a.id").replace("m.n", "m.id"))
    rays = rays.select("bin", F.col("d").cast("double").alias("d"), (F.col("d") * F.sin("angle")).alias("dx"), (F.col("d") * F.cos("angle")).alias("dy")).orderBy("bin", "d").toArrow()
    place = shade.POSITIONS.replace(":lat", repr(float(lat))).replace(":lon", repr(float(lon)))
    directions = spark.sql(spark_text(shade.DIRECTIONS.replace("{0}", "east, north, days,").replace("{1}", "east, north, days,").replace("{2}", f"(SELECT *, 0D AS nx, 0D AS ny, 1D AS nz FROM ({place}) p)")), numbers=spark.sql("SELECT id AS n FROM range(200)"))
    sun = directions.select("month", "bin", "east", "north", "up", F.col("days").cast("double").alias("days"), F.tan(F.asin(F.least(F.lit(1.0), F.col("up")))).alias("rise")).toArrow()
    rays, sun = ({c: t.column(c).to_numpy() for c in t.column_names} for t in (rays, sun))

    reach = math.ceil(float(rays["d"].max()) / step) + 1
    side = max(32, reach)
    here = lambda c: F.coalesce(F.floor(F.floor(F.col(c) / step) / side), F.lit(0)).cast("long")
    normal = {"nx": F.sin(F.radians("pitch")) * F.sin(F.radians("azimuth")), "ny": F.sin(F.radians("pitch")) * F.cos(F.radians("azimuth")), "nz": F.when(F.col("azimuth").isNotNull(), F.cos(F.radians("pitch")))}
    doubles = {c: F.col(c).cast("double") for c in ("x", "y", "z", "pitch", "azimuth")}
    placed = stored(samples.select("id", "face_id", *doubles).withColumns(doubles).withColumns({"bx": here("x"), "by": here("y")}), "placed")
    parts = placed.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("parts"))
    salt = F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("long")
    asking = placed.hint("merge").join(parts, ["bx", "by"]).withColumns({"salt": salt, "kind": F.lit(1), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long"), **normal})

    cells = heights.select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.col("z").cast("double").alias("z"))
    cells = stored(cells, "heights").where(f"z >= {LOW} and z <= {HIGH}")  # a filter would make z's terms again for each of its bounds
    cells = cells.withColumns({"hx": F.floor(F.col("cx") / side), "hy": F.floor(F.col("cy") / side)})
    around = F.explode(F.array(*[F.struct((F.col("bx") + i).alias("hx"), (F.col("by") + j).alias("hy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    keys = parts.withColumn("h", around).select("bx", "by", "h.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    near = lambda c, b: F.col(c).between(F.col(b) * side - reach, (F.col(b) + 1) * side + reach)
    told = cells.hint("merge").join(keys, ["hx", "hy"]).where(near("cx", "bx") & near("cy", "by")).withColumn("kind", F.lit(0))

    columns = ["bx", "by", "salt", "kind", "cx", "cy", "x", "y", "z", "nx", "ny", "nz", "id", "face_id"]
    rows = asking.select(columns).unionByName(told.select("bx", "by", "salt", "kind", "cx", "cy", "z"), allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in ("id", "face_id"))
    lost = rows.repartition(tasks, "bx", "by", "salt").sortWithinPartitions("bx", "by", "salt", "kind", "x", "y").mapInArrow(_looked(rays, sun, step), types + "".join(f", {c} double" for c in SUMS))
    share = lambda part, all_of: 1 - F.col(part) / F.nullif(F.col(all_of), F.lit(0.0))
    known = share("unknown", "whole")
    enough = known >= KNOWN
    return lost.select("id", "face_id", F.when(enough, share("hidden", "whole")).alias("annual"), F.when(enough, share("hidden_winter", "whole_winter")).alias("winter"), F.coalesce(known, F.lit(0.0)).alias("known"))


def face_sunlight(access: DataFrame) -> DataFrame:
    """A row for each face: whether anything is known, for which share of its samples, and their mean access."""
    mean = lambda c: F.bround(F.avg(c), 6)
    return access.groupBy("face_id").agg((F.count("annual") > 0).alias("available"), F.bround(F.count("annual") / F.count(F.lit(1)), 6).alias("coverage_fraction"), mean("annual").alias("mean_direct_sun_access"), mean("winter").alias("winter_direct_sun_access"))


def sunlight_exclusions(access: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Samples with known access below ``minimum``; unknown ones are no exclusions."""
    return access.where(F.col("annual") < minimum).select("id", "face_id", F.bround("annual", 6).alias("annual"))
