"""The three entry points as plans over tables, for one clicked roof or for all buildings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunspan.operators import graph, layout, relational, roofs
from sunspan.operators._shared import stored
from sunspan.settings import Settings


def prepare(faces: DataFrame) -> DataFrame:
    """Faces of each building that belong to its clicked roof: adjacency, then growth from the clicked face."""
    chosen = graph.select_connected(faces, relational.adjacency(faces=faces))
    return faces.join(chosen.where("accepted").select("face_id"), "face_id", "left_semi")


def select_roof(features: DataFrame, east: float, north: float) -> DataFrame:
    """The roof that a click (metres east and north) selects among roof features (face_id, building_id, rings, egid, pitch).

    Features are one capture: the one under the click is the anchor, and those join that touch an accepted one and do
    not belong to another known building. See merge_building() for the columns; an empty table gives no row.
    """
    crossings = """aggregate(rings, 0, (n, ring) -> n + aggregate(sequence(1, size(ring)), 0, (m, i) -> m + if(
        (ring[i - 1][1] > {y}) <> (ring[i % size(ring)][1] > {y})
        and {x} < (ring[i % size(ring)][0] - ring[i - 1][0]) * ({y} - ring[i - 1][1]) / nullif(ring[i % size(ring)][1] - ring[i - 1][1], 0) + ring[i - 1][0], 1, 0)))"""
    inside = F.expr(crossings.format(x=repr(float(east)), y=repr(float(north)))) % 2 == 1
    faces = features.withColumn("capture_id", F.lit(1).cast("long")).withColumn("contains_click", inside)
    order = Window.partitionBy("capture_id").orderBy(F.col("contains_click").desc(), "face_id")
    faces = faces.withColumn("part_no", F.row_number().over(order))
    chosen = graph.select_connected(faces, roofs.ring_links(faces, "capture_id"), "capture_id")
    return roofs.merge_building(faces, chosen, "capture_id")


def analyse(faces: DataFrame, power_w: float = 450.0, ratio: float = 0.8, limit: int | None = None) -> DataFrame:
    """Modules, kWp and kWh a year of each face: assessment, packing, then allocation by yield up to ``limit`` a building.

    A face without irradiation has unknown energy, never zero.
    """
    packed = layout.optimise(faces=faces)
    assessed = relational.assess_face(faces=faces).select("face_id", "status", "eligible")
    rows = faces.select("building_id", "face_id", "part_no", "irradiation").join(packed, "face_id").join(assessed, "face_id")
    panels = F.when(F.col("eligible"), F.col("panels")).otherwise(F.lit(0))
    if limit is not None:
        before = Window.partitionBy("building_id").orderBy(F.col("irradiation").desc_nulls_last(), "part_no").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("offered", panels)
        panels = F.greatest(F.lit(0), F.least(F.col("offered"), F.lit(limit) - F.coalesce(F.sum("offered").over(before), F.lit(0))))
    rows = rows.withColumn("placed", panels.cast("long")).withColumn("kwp", F.bround(F.col("placed") * power_w / 1000, 3))
    return rows.select("building_id", "face_id", "status", "orientation", "placed", "kwp", F.bround(F.col("kwp") * F.col("irradiation") * ratio, 0).cast("long").alias("kwh"))


def analyse_rings(faces: DataFrame, objects: DataFrame, settings: Settings | None = None, terrain: DataFrame | None = None) -> DataFrame:
    """A row for each face with rings: shade where heights (x, y, z) are given, then packing, allocation and accounting."""
    sunlight = None if terrain is None else stored(roofs.analyse_sunlight(faces, roofs.height_blocks(terrain)), "sunlight")
    return roofs.analyse_roofs(faces, objects, settings, sunlight)


def shadow(sunlight: DataFrame, planes: DataFrame, month: int, hour: float) -> DataFrame:
    """Samples in sun, in shade and unknown of each face at an hour (UTC) of the 21st of a month."""
    return roofs.instantaneous_shadow(sunlight, planes, month, hour)
