"""Sources and sinks: files of the domain as DataFrames, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits for uploaded images.
MOST_BYTES, SUFFIXES = 20 << 20, ("png", "jpg", "jpeg", "webp")
FEATURE_SCHEMA = (
    "id bigint, geometry struct<type: string, coordinates: array<array<array<array<double>>>>>, "
    "properties struct<building_id: bigint, gwr_egid: string, neigung: double, ausrichtung: double, flaeche: double, mstrahlung: double, stromertrag: double, klasse: int>"
)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Uploads as rows (path, length, content, digest, accepted): accepted within the size limit and of a known kind by their first bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.expr("substring(content, 1, 12)"))
    kind = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    accepted = (F.col("length") <= MOST_BYTES) & kind.isNotNull()
    return rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), accepted.alias("accepted"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Roof features from a JSON array of GeoJSON-like records: a row per part of each geometry, with its rings and box.

    Parts whose exterior has fewer than four points are left out; unknown attributes are null.
    """
    rows = spark.read.schema(FEATURE_SCHEMA).option("multiLine", "true").json(path)
    parts = rows.select("id", "properties.*", F.posexplode("geometry.coordinates").alias("part", "rings"))
    x, y = F.transform(F.col("rings")[0], lambda p: p[0]), F.transform(F.col("rings")[0], lambda p: p[1])
    out = parts.where(F.size(F.col("rings")[0]) >= 4).withColumn("face_id", F.concat_ws(":", "id", "part"))
    return out.withColumns({"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y), "area": ring_area("rings")})


PAGE_SCHEMA = (
    "crs struct<type: string, properties: struct<name: string>>, exceededTransferLimit boolean, "
    "features array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: map<string, string>>>"
)


def read_pages(spark: SparkSession, path: str, crs: str = "2056", most: int = 200_000) -> DataFrame:
    """Surveyed structures from pages of features (a file each, named in their order): page, egid, rings and properties.

    Every page has to be in the coordinate system ``crs``; another one, or none, raises an error, and so do more than
    ``most`` features, and a last page that says that more would follow. Polygons without points are left out.
    """
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", "true").json(path).withColumn("page", F.input_file_name())
    name = F.coalesce(F.col("crs.properties.name"), F.lit(""))
    checked = pages.withColumn("features", F.when(name.endswith(crs), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("coordinate system of "), "page", F.lit(" is "), name)).cast(pages.schema["features"].dataType)))
    totals = checked.agg(F.sum(F.size("features")), F.max_by("exceededTransferLimit", "page")).first()
    if (totals[0] or 0) > most or totals[1]:
        raise ValueError(f"{totals[0]} features of {most} at most, or pages are missing")
    rows = checked.select("page", F.explode("features").alias("f"))
    rings = F.filter("f.geometry.coordinates", lambda r: F.size(r) > 3)
    return rows.select("page", F.col("f.properties")["EGID"].try_cast("long").alias("egid"), rings.alias("rings"), F.col("f.properties").alias("properties")).where(F.size("rings") > 0)


def ring_area(rings: str):
    """Column: area of a polygon's exterior less its holes, by shoelace sums in higher-order functions."""
    shoelace = f"""abs(aggregate(sequence(0, size({{0}}) - 2), 0D, (s, i) -> s + {{0}}[i][0] * {{0}}[i + 1][1] - {{0}}[i + 1][0] * {{0}}[i][1])) / 2D"""
    return F.expr(f"{shoelace.format(rings + '[0]')} - aggregate(slice({rings}, 2, greatest(size({rings}) - 1, 0)), 0D, (s, r) -> s + {shoelace.format('r')})")


def read_label_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Label files with a line ``class x y x y ...`` per object: file, class and its points; malformed lines are left out."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split(F.trim("value"), r"\s+").alias("t"))
    numbers = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda v: v.try_cast("double"))
    rows = lines.select("file", F.col("t")[0].try_cast("int").alias("class"), numbers.alias("v")).where("class is not null and size(v) >= 6 and size(v) % 2 = 0 and not exists(v, x -> x is null)")
    return rows.select("file", "class", F.expr("transform(sequence(0, size(v) div 2 - 1), i -> struct(v[2 * i] as x, v[2 * i + 1] as y))").alias("points"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest, an array of records or one record per line."""
    return spark.read.option("multiLine", "true").json(path)


def geojson_lines(overlay: DataFrame) -> DataFrame:
    """One GeoJSON feature per row of boxes (layer, id, x0, y0, x1, y1), as text lines for ``write.text``."""
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("layer"), F.col("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return overlay.select(F.to_json(feature).alias("value"))


def write_captures(result: DataFrame, path: str) -> None:
    """Results as Parquet by capture, so that a capture written again replaces its own partition only."""
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(path)
