"""Polygons as relations of edges: which of them cover a point, which boxes meet, and areas of what they share.

Rings are broken into edge rows (polygon_id, part, ring, i, ux, uy, vx, vy), exteriors counter-clockwise and holes
clockwise. Polygons and points meet by equality on cells of a grid with levels: a polygon lives on the level whose
cells are about its size, so it has few cells whatever its size, and a point has one cell on each level. Inside, edges
are dealt to the bands that points ask for, so that a point meets the edges of its own band only.

Areas come from a sweep: all edges of a group are cut into slabs at corners and crossings, and along a slab a running
sum of directions tells what lies inside; edges that coincide are no special case. Pairs are stored once,
and each is one row with the edges of both, swept by one expression over arrays in what their boxes share. Unions are swept
in cells, and only in those that no object covers by itself.

Joins here are merges by hint: Spark takes the size of exploded edges and cells for that of the rows that they come from,
and would broadcast them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators._shared import stored
from sunspan.operators._sql import operator, spark_text


def _merged(text: str, a: str, b: str) -> str:
    """A text that oracles share, with joins of ``a`` and ``b`` as merges in Spark."""
    return re.sub(rf"SELECT ((?:(?!SELECT).)*? FROM \S+ {a} JOIN \S+ {b} ON)", rf"SELECT /*+ MERGE({a}, {b}) */ \1", text, flags=re.S)


#: Side of a cell on the first level, in metres; levels double it. Bands are a part of a polygon's cell.
CELL, LEVELS, BANDS = 16.0, 12, 16


def edges_of(polygons: DataFrame, id_col: str = "face_id", rings_col: str = "rings", part_col: str | None = None) -> DataFrame:
    """Edge rows of polygons with ``rings_col`` (array of rings, the exterior first, each an array of (x, y) pairs).

    Rings may be closed or not and run either way; edges of no length are left out, and so are rings of fewer than
    three points, null rings and null polygons. ``part_col`` numbers the parts of a polygon, each a row.
    """
    part = F.lit(0).cast("long") if part_col is None else F.col(part_col).cast("long")
    rings = polygons.select(F.col(id_col).alias("polygon_id"), part.alias("part"), F.posexplode(rings_col).alias("ring", "p")).where("size(p) >= 3")
    turn = "aggregate(sequence(0, size(p) - 1), 0D, (s, i) -> s + p[i][0] * p[(i + 1) % size(p)][1] - p[(i + 1) % size(p)][0] * p[i][1])"
    turned = rings.withColumn("p", F.expr(f"if(({turn} > 0) = (ring = 0), p, reverse(p))"))
    ends = F.expr("transform(p, (a, i) -> struct(cast(i as bigint) as i, a[0] as ux, a[1] as uy, p[(i + 1) % size(p)][0] as vx, p[(i + 1) % size(p)][1] as vy))")
    return turned.select("polygon_id", "part", F.col("ring").cast("long").alias("ring"), F.inline(ends)).where("ux <> vx or uy <> vy")


_COVER = f"""
boxes AS (SELECT polygon_id, part, min(least(ux, vx)) AS x0, max(greatest(ux, vx)) AS x1, min(least(uy, vy)) AS y0, max(greatest(uy, vy)) AS y1 FROM edges GROUP BY polygon_id, part),
sized AS (SELECT *, :cell * pow(2e0, level) AS side FROM (SELECT *, CAST(least({LEVELS}, greatest(0, ceil(log2(greatest(x1 - x0, y1 - y0, 1e-9) / :cell)))) AS BIGINT) AS level FROM boxes) t),
cover AS (SELECT polygon_id, part, level, side, cx, cy FROM sized EACH(cx, CAST(floor(x0 / side) AS BIGINT), CAST(floor(x1 / side) AS BIGINT)) EACH(cy, CAST(floor(y0 / side) AS BIGINT), CAST(floor(y1 / side) AS BIGINT))),
seen AS (SELECT point_id, x, y, level, CAST(floor(x / (:cell * pow(2e0, level))) AS BIGINT) AS cx, CAST(floor(y / (:cell * pow(2e0, level))) AS BIGINT) AS cy
         FROM {{points}} EACH(level, CAST(0 AS BIGINT), CAST(:levels AS BIGINT))),
near AS (SELECT /*+ MERGE(s, c) */ s.point_id, s.x, s.y, c.polygon_id, c.part, c.side, CAST(floor(s.y * {BANDS} / c.side) AS BIGINT) AS band FROM seen s JOIN cover c ON s.level = c.level AND s.cx = c.cx AND s.cy = c.cy),
asked AS (SELECT DISTINCT polygon_id, part, side, band FROM near),
banded AS (SELECT /*+ MERGE(e, s) */ e.polygon_id, e.part, e.ux, e.uy, e.vx, e.vy, s.band FROM edges e JOIN asked s ON e.polygon_id = s.polygon_id AND e.part = s.part
           AND s.band BETWEEN floor(least(e.uy, e.vy) * {BANDS} / s.side) AND floor(greatest(e.uy, e.vy) * {BANDS} / s.side)),
met AS (SELECT /*+ MERGE(n, e) */ n.point_id, n.polygon_id, n.part,
               sum(CASE WHEN (e.uy > n.y) <> (e.vy > n.y) AND n.x < e.ux + (n.y - e.uy) * (e.vx - e.ux) / nullif(e.vy - e.uy, 0e0) THEN 1 ELSE 0 END) AS crossed,
               max(CASE WHEN (e.vx - e.ux) * (n.y - e.uy) = (e.vy - e.uy) * (n.x - e.ux) AND n.x BETWEEN least(e.ux, e.vx) AND greatest(e.ux, e.vx) AND n.y BETWEEN least(e.uy, e.vy) AND greatest(e.uy, e.vy) THEN 1 ELSE 0 END) AS touched
        FROM near n JOIN banded e ON e.polygon_id = n.polygon_id AND e.part = n.part AND e.band = n.band GROUP BY n.point_id, n.polygon_id, n.part),
covering AS (SELECT DISTINCT point_id, polygon_id FROM met WHERE crossed % 2 = 1 OR touched = 1)
"""
_AREAS = "areas AS (SELECT polygon_id, bround(sum(ux * vy - vx * uy) / 2e0, 6) AS area FROM {edges} GROUP BY polygon_id)"

#: By winding number over all pairs of a point and a polygon's box, each ring for itself: a text apart from the above.
_WOUND = """
boxed AS (SELECT polygon_id, part, min(ux) AS x0, max(ux) AS x1, min(uy) AS y0, max(uy) AS y1 FROM {edges} GROUP BY polygon_id, part),
wound AS (SELECT p.point_id, e.polygon_id, e.part, e.ring,
                 sum(CASE WHEN e.uy <= p.y AND e.vy > p.y AND (e.vx - e.ux) * (p.y - e.uy) - (p.x - e.ux) * (e.vy - e.uy) > 0 THEN 1
                          WHEN e.uy > p.y AND e.vy <= p.y AND (e.vx - e.ux) * (p.y - e.uy) - (p.x - e.ux) * (e.vy - e.uy) < 0 THEN -1 ELSE 0 END) AS turns,
                 bool_or(abs((e.vx - e.ux) * (p.y - e.uy) - (p.x - e.ux) * (e.vy - e.uy)) = 0 AND (p.x - e.ux) * (p.x - e.vx) <= 0 AND (p.y - e.uy) * (p.y - e.vy) <= 0) AS rim
          FROM {points} p JOIN boxed b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 JOIN {edges} e ON e.polygon_id = b.polygon_id AND e.part = b.part
          GROUP BY p.point_id, e.polygon_id, e.part, e.ring),
"""
_INSIDE = "covering AS (SELECT DISTINCT point_id, polygon_id FROM (SELECT point_id, polygon_id, part FROM wound GROUP BY point_id, polygon_id, part HAVING bool_or(rim) OR sum(turns) <> 0) t)"
_INSIDE_EXTERIOR = "covering AS (SELECT DISTINCT point_id, polygon_id FROM wound WHERE ring = 0 AND (rim OR turns <> 0))"
_SMALLEST = "SELECT point_id, polygon_id, area FROM (SELECT c.point_id, c.polygon_id, a.area, row_number() OVER (PARTITION BY c.point_id ORDER BY a.area, c.polygon_id) AS rn FROM covering c JOIN areas a ON a.polygon_id = c.polygon_id) t WHERE rn = 1"


def _points(name: str, select: str, oracle: str, edges: str = "SELECT * FROM {edges}", inside: str = _INSIDE):
    text = f"WITH edges AS ({edges}), {_COVER.strip()}, {_AREAS} {_merged(select, 'c', 'a')}"
    return operator(name, "points edges", text, oracle=f"WITH {_WOUND.strip()} {inside}, {_AREAS.replace('bround', 'round_even')} {oracle}", cell=CELL, levels=LEVELS)


identify = _points("s2_identify_rings", "SELECT point_id, polygon_id FROM covering", "SELECT point_id, polygon_id FROM covering")
enclosing = _points("j10_point_in_rings", _SMALLEST, _SMALLEST)
enclosing_exterior = _points("j11_enclosing_rings", _SMALLEST, _SMALLEST, "SELECT * FROM {edges} WHERE ring = 0", _INSIDE_EXTERIOR)

# --- boxes that meet ------------------------------------------------------------------------------------------------
_BOXES = f"""SELECT *, CAST(least({LEVELS}, greatest(0, ceil(log2(greatest(x1 - x0, y1 - y0, 1e-9) / :cell)))) AS BIGINT) AS level
FROM (SELECT polygon_id AS id, min(least(ux, vx)) AS x0, max(greatest(ux, vx)) AS x1, min(least(uy, vy)) AS y0, max(greatest(uy, vy)) AS y1 FROM {{edges}} WHERE polygon_id IS NOT NULL GROUP BY polygon_id) t"""
_CELLS = """SELECT * FROM (SELECT *, explode(array_union(array(level), filter(array(:levels), l -> l > level))) AS up FROM {boxes}) t
EACH(cx, CAST(floor(x0 / (:cell * pow(2e0, up))) AS BIGINT), CAST(floor(x1 / (:cell * pow(2e0, up))) AS BIGINT)) EACH(cy, CAST(floor(y0 / (:cell * pow(2e0, up))) AS BIGINT), CAST(floor(y1 / (:cell * pow(2e0, up))) AS BIGINT))"""
_MEET = """SELECT /*+ MERGE(a, b) */ a.id AS object_id, b.id AS polygon_id FROM {one} a JOIN {two} b ON a.up = b.up AND a.cx = b.cx AND a.cy = b.cy
WHERE a.up = greatest(a.level, b.level) AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
AND a.cx = floor(greatest(a.x0, b.x0) / (:cell * pow(2e0, a.up))) AND a.cy = floor(greatest(a.y0, b.y0) / (:cell * pow(2e0, a.up)))"""


def box_pairs(objects: DataFrame, edges: DataFrame, cell: float = CELL) -> DataFrame:
    """object_id and polygon_id of polygons whose boxes meet, stored once for all that reads them.

    Pairs meet on the level of the larger box, where it has its own cells only, once, in the cell of the lower left
    corner of what they share. A box has cells on the levels that occur on the other side, of which there are 13 at most.
    """
    spark = objects.sparkSession
    said = lambda text, **more: spark_text(re.sub(r":cell\b", f"{float(cell)!r}D", text)).replace(":levels", more.get("levels", ""))
    boxes = [stored(spark.sql(said(_BOXES), edges=e), "boxes") for e in (objects, edges)]
    levels = [", ".join(f"{r.level}L" for r in b.select("level").distinct().collect()) or "0L" for b in boxes]
    one, two = (spark.sql(said(_CELLS, levels=other), boxes=b) for b, other in zip(boxes, levels[::-1], strict=True))
    return stored(spark.sql(said(_MEET), one=one, two=two), "pairs")


box_pairs.takes = ("cell",)  # settings of the operator that it is given

# --- areas by a sweep -----------------------------------------------------------------------------------------------
#: Cells along a side of a block, whose full cells are bits; work that is done at once in a task, in numbers.
BLOCK, AT_ONCE = 64, 1 << 21


def _x_at(lx, ly, slope, y):
    return lx + (y - ly) * slope


def _swept_rows(way_a, way_b, lx, ly, slope, y0, y1, right) -> np.ndarray:
    """Areas in a, in b and in both of groups of as many pieces each (a row a group, a column a piece), left of ``right``."""
    n, e = lx.shape
    cuts = [y0, y1]
    for k in range(e):  # crossings of piece k with later ones
        with np.errstate(all="ignore"):
            off, rest = lx - ly * slope, slice(k + 1, None)
            y = (off[:, rest] - off[:, k : k + 1]) / (slope[:, k : k + 1] - slope[:, rest])
            cuts.append(np.where((y > np.maximum(y0[:, rest], y0[:, k : k + 1])) & (y < np.minimum(y1[:, rest], y1[:, k : k + 1])), y, y0[:, :1]))
    y = np.sort(np.concatenate(cuts, axis=1), axis=1)
    out = np.zeros((n, 3))
    row, at = np.nonzero(y[:, 1:] > y[:, :-1])
    for i in range(0, len(row), max(1, AT_ONCE // e)):  # slabs
        r, low, high = (v[i : i + max(1, AT_ONCE // e)] for v in (row, y[row, at], y[row, at + 1]))
        low, high = low[:, None], high[:, None]
        x = np.where((y0[r] <= low) & (y1[r] >= high), _x_at(lx[r], ly[r], slope[r], (low + high) / 2), np.inf)
        order = np.argsort(x, axis=1)
        x = np.minimum(np.take_along_axis(x, order, 1), right[r][:, None])
        with np.errstate(invalid="ignore"):
            width = np.diff(x, axis=1, append=right[r][:, None])
        width[~np.isfinite(width)] = 0.0  # behind the last one, where nothing is to its right
        here = np.take_along_axis((y0[r] <= low) & (y1[r] >= high), order, 1)
        a, b = (np.cumsum(np.where(here, np.take_along_axis(w[r], order, 1), 0), axis=1) != 0 for w in (way_a, way_b))
        for k, inside in enumerate((a, b, a & b)):
            np.add.at(out[:, k], r, ((high - low) * width * inside).sum(axis=1))
    return out


def _swept(pieces: DataFrame, key: list[str]) -> DataFrame:
    """``key``, area_a, area_b and shared of groups of pieces (way_a, way_b, lx, ly, slope, y0, y1, right).

    A piece is at lx + (y - ly) * slope from y0 to y1, and ``right`` ends what lies to the right of the last one. Pieces that
    coincide are one; a group's pieces are rows that lie one after the other, and groups of one size are swept at once.
    """
    names = ["lx", "ly", "slope", "y0", "y1", "right"]
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pieces.repartition(tasks, *key).groupBy(*key, *names).agg(F.sum("way_a").alias("way_a"), F.sum("way_b").alias("way_b")).sortWithinPartitions(*key)
    schema = ", ".join([f"{k} long" for k in key] + ["area_a double", "area_b double", "shared double"])

    def areas(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(k).to_numpy() for k in key]
        first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if t.num_rows else [])
        sizes, got = np.diff(np.append(first, t.num_rows)), np.zeros((len(first), 3))
        said = [t.column(c).to_numpy() for c in ("way_a", "way_b", *names)]
        for e in np.unique(sizes):
            found = np.flatnonzero(sizes == e)
            step = max(1, int(AT_ONCE // (e * e)))
            for i in range(0, len(found), step):
                at = first[found[i : i + step], None] + np.arange(e)
                values = [v[at] for v in said]
                got[found[i : i + step]] = _swept_rows(*values[:-1], values[-1][:, 0])
        return pa.RecordBatch.from_pydict({k: v[first] for k, v in zip(key, keys, strict=True)} | {c: got[:, k] for k, c in enumerate(("area_a", "area_b", "shared"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = np.all([(v := t.column(k).to_numpy()) == v[-1] for k in key], axis=0) if t.num_rows else np.zeros(0, bool)
            held = t.slice(int(np.argmax(last)) if t.num_rows else 0)  # its rows may go on in the next batch
            if held.num_rows < t.num_rows:
                yield areas(t.slice(0, t.num_rows - held.num_rows))
        if held is not None and held.num_rows:
            yield areas(held)

    return met.mapInArrow(run, schema)


def _full_cells(side: float):
    """Of objects (group_id, x0, x1, lo, hi, ring) the cells that lie in one wholly, as bits of rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ring = b.column("ring")
            start = ring.offsets.to_numpy()
            ux, uy, vx, vy = (ring.values.field(c).to_numpy() for c in ("ux", "uy", "vx", "vy"))
            group, *box = (b.column(c).to_numpy() for c in ("group_id", "x0", "x1", "lo", "hi"))
            x0, x1, lo, hi = (np.floor(v / side).astype(np.int64) for v in box)
            rows = hi - lo + 1
            of = np.repeat(np.arange(len(group)), rows)  # an object's row of cells
            cy = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
            across, edges = (x1 - x0 + 1)[of], np.diff(start)[of]
            work = np.cumsum(across * edges)
            i = 0
            while i < len(of):
                j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + AT_ONCE, "right")))
                o, y, n = of[i:j], cy[i:j], across[i:j]
                cell = np.repeat(np.arange(j - i), n)
                x = x0[o][cell] + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                many = edges[i:j][cell]
                p = np.repeat(np.arange(len(cell)), many)
                q = start[o][cell][p] + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
                xl, yl, xr, yr = x[p] * side, y[cell][p] * side, (x[p] + 1) * side, (y[cell][p] + 1) * side
                up = vy[q] > uy[q]
                lx, ly, hy, hx = np.where(up, ux[q], vx[q]), np.minimum(uy[q], vy[q]), np.maximum(uy[q], vy[q]), np.where(up, vx[q], ux[q])
                with np.errstate(all="ignore"):
                    slope = (hx - lx) / (hy - ly)
                    one, two = (_x_at(lx, ly, slope, v) for v in (np.maximum(ly, yl), np.minimum(hy, yr)))
                    flat = ly == hy
                    left, beyond = (np.where(flat, f(lx, hx), f(one, two)) for f in (np.minimum, np.maximum))
                    meets = np.where(flat, (yl < ly) & (ly < yr), np.maximum(ly, yl) < np.minimum(hy, yr)) & (left < xr) & (beyond > xl)
                    middle = (yl + yr) / 2
                    wound = np.where(~flat & (ly <= middle) & (middle < hy) & (_x_at(lx, ly, slope, middle) < (xl + xr) / 2), np.where(up, 1, -1), 0)
                k = np.flatnonzero((np.bincount(p, meets, len(cell)) == 0) & (np.bincount(p, wound, len(cell)) != 0))
                yield pa.RecordBatch.from_pydict({"group_id": group[o][cell][k], "bx": x[k] // BLOCK, "by": y[cell][k] // BLOCK, "line": y[cell][k] % BLOCK, "bit": np.int64(1) << (x[k] % BLOCK)})
                i = j

    return run


#: Edges as pieces between y0 and y1 in a cell: what is left of it stands on its left side, what is right of it is not told.
_IN_CELL = """SELECT {key}, CAST({way_a} AS BIGINT) AS way_a, CAST({way_b} AS BIGINT) AS way_b, inline(filter(array(
        named_struct('lx', lx, 'ly', ly, 'slope', slope, 'y0', one, 'y1', two, 'right', xr),
        named_struct('lx', xl, 'ly', 0e0, 'slope', 0e0, 'y0', CASE WHEN slope < 0 THEN two ELSE y0 END, 'y1', CASE WHEN slope < 0 THEN y1 ELSE one END, 'right', xr)), p -> p.y1 > p.y0))
    FROM (SELECT *, least(y1, greatest(y0, CASE WHEN slope = 0 THEN (CASE WHEN lx <= xl THEN y1 ELSE y0 END) WHEN slope > 0 THEN ly + (xl - lx) / slope ELSE ly + (xr - lx) / slope END)) AS one,
                    least(y1, greatest(y0, CASE WHEN slope = 0 THEN (CASE WHEN lx >= xr THEN y0 ELSE y1 END) WHEN slope > 0 THEN ly + (xr - lx) / slope ELSE ly + (xl - lx) / slope END)) AS two
          FROM (SELECT *, cx * {side} AS xl, (cx + 1) * {side} AS xr, greatest(ly, cy * {side}) AS y0, least(top, (cy + 1) * {side}) AS y1 FROM ({cells}) c) c WHERE y0 < y1) c"""
_RISING = "CASE WHEN vy > uy THEN 1 ELSE -1 END AS way, CASE WHEN vy > uy THEN ux ELSE vx END AS lx, least(uy, vy) AS ly, greatest(uy, vy) AS top, (vx - ux) / nullif(vy - uy, 0e0) AS slope"
_HELD = """SELECT building_id AS group_id, min(least(ux, vx)) AS x0, max(greatest(ux, vx)) AS x1, min(least(uy, vy)) AS lo, max(greatest(uy, vy)) AS hi, collect_list(named_struct('ux', ux, 'uy', uy, 'vx', vx, 'vy', vy)) AS ring
FROM {objects} WHERE building_id IS NOT NULL GROUP BY building_id, polygon_id"""


def outline_areas(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id and area_a of outlines by themselves."""
    pieces = edges.sparkSession.sql(f"SELECT polygon_id AS group_id, way AS way_a, 0 AS way_b, lx, ly, slope, ly AS y0, top AS y1, CAST('Infinity' AS DOUBLE) AS right FROM (SELECT polygon_id, {_RISING} FROM {{edges}} WHERE uy <> vy AND polygon_id IS NOT NULL) e", edges=edges)
    return _swept(pieces, ["group_id"]).select("group_id", "area_a")


def object_areas(objects: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """group_id, area_b and shared of the objects of each group, cell by cell.

    Cells are about a fourth of what objects measure (their root mean square, a power of two, ``band`` at most), so they are
    some 25 for each object. A cell that lies in one object wholly needs none of the others: where many lie upon each
    other, what is swept are the cells along the rim. Outlines meet cells of objects by group and row of cells.
    """
    spark = objects.sparkSession
    held = stored(spark.sql(_HELD, objects=objects), "held")
    size = held.agg(F.sqrt(F.avg(F.pow(F.greatest(F.col("x1") - F.col("x0"), F.col("hi") - F.col("lo")), F.lit(2))))).first()[0] or 1.0
    side = min(float(band), 2.0 ** math.floor(math.log2(size / 4)))
    bits = held.select("group_id", "x0", "x1", "lo", "hi", "ring").mapInArrow(_full_cells(side), "group_id long, bx long, by long, line long, bit long")
    lines = bits.groupBy("group_id", "bx", "by", "line").agg(F.bit_or("bit").alias("bits"))
    full = lines.groupBy("group_id", "bx", "by").agg(F.map_from_entries(F.collect_list(F.struct("line", "bits"))).alias("m"))
    full = stored(full.select("group_id", "bx", "by", F.expr(f"transform(sequence(0L, {BLOCK - 1}L), r -> coalesce(m[r], 0L))").alias("lines")), "full")
    at = lambda c: f"CAST(floor({c} / {side!r}D) AS BIGINT)"
    block = lambda c: f"CAST(floor({c} / {side * BLOCK!r}D) AS BIGINT)"
    cells = spark_text(f"""SELECT group_id, cx, cy, {_RISING} FROM (SELECT group_id, cx, cy, inline(ring) FROM (
        SELECT * FROM (SELECT /*+ MERGE(h, f) */ h.*, f.lines FROM (SELECT *, bx * {BLOCK} AS ox, by * {BLOCK} AS oy FROM {{held}} EACH(bx, {block("x0")}, {block("x1")}) EACH(by, {block("lo")}, {block("hi")})) h LEFT JOIN {{full}} f ON f.group_id = h.group_id AND f.bx = h.bx AND f.by = h.by) b
        EACH(cx, greatest(ox, {at("x0")}), least(ox + {BLOCK - 1}, {at("x1")})) EACH(cy, greatest(oy, {at("lo")}), least(oy + {BLOCK - 1}, {at("hi")}))) c
        WHERE lines IS NULL OR shiftright(lines[CAST(cy - oy AS INT)], CAST(cx - ox AS INT)) & 1 = 0) e WHERE uy <> vy""")
    said = {"key": "group_id, cx, cy", "side": f"{side!r}D"}
    rim = spark.sql(_IN_CELL.format(way_a="0", way_b="way", cells=cells, **said), held=held, full=full)
    whole = spark.sql(spark_text(f"""SELECT group_id, cx, cy, 0L AS way_a, 1L AS way_b, cx * {side!r}D AS lx, 0D AS ly, 0D AS slope, cy * {side!r}D AS y0, (cy + 1) * {side!r}D AS y1, (cx + 1) * {side!r}D AS right
        FROM (SELECT group_id, bx * {BLOCK} + i AS cx, by * {BLOCK} + line AS cy, bits, i FROM (SELECT group_id, bx, by, posexplode(lines) AS (line, bits) FROM {{full}}) f EACH(i, 0L, {BLOCK - 1}L)) c WHERE shiftright(bits, CAST(i AS INT)) & 1 = 1"""), full=full)
    inside = stored(rim.unionByName(whole).groupBy("group_id", "cx", "cy", "lx", "ly", "slope", "y0", "y1", "right").agg(F.sum("way_a").alias("way_a"), F.sum("way_b").alias("way_b")), "inside")
    here = inside.select("group_id", "cx", "cy").distinct()
    beside = spark_text(f"""SELECT /*+ MERGE(h, e) */ h.group_id, h.cx, h.cy, e.way, e.lx, e.ly, e.top, e.slope FROM {{here}} h JOIN (
        SELECT * FROM (SELECT /*+ MERGE(g) */ polygon_id AS group_id, least(ux, vx) AS xl, {_RISING} FROM {{edges}} LEFT SEMI JOIN (SELECT DISTINCT group_id FROM {{here}}) g ON g.group_id = polygon_id WHERE uy <> vy) o EACH(cy, {at("ly")}, {at("top")})) e ON e.group_id = h.group_id AND e.cy = h.cy AND e.xl < (h.cx + 1) * {side!r}D""")
    outline = spark.sql(_IN_CELL.format(way_a="way", way_b="0", cells=beside, **said), here=here, edges=edges)
    return _swept(inside.unionByName(outline), ["group_id", "cx", "cy"]).groupBy("group_id").agg(F.sum("area_b").alias("area_b"), F.sum("shared").alias("shared"))


object_areas.takes = ("band",)


#: The same areas by a sweep the other way, over intervals that each polygon's crossings with a line enclose two by two.
_UPRIGHT = """
spans AS (SELECT {key}, side, polygon, least(ux, vx) AS x0, greatest(ux, vx) AS x1, ux, uy, (vy - uy) / (vx - ux) AS slope FROM layers WHERE ux <> vx),
stops AS (SELECT {key}, x0 AS x FROM spans UNION SELECT {key}, x1 FROM spans UNION
          SELECT {key}, x FROM (SELECT {p_key}, (q.uy - q.ux * q.slope - p.uy + p.ux * p.slope) / (p.slope - q.slope) AS x, greatest(p.x0, q.x0) AS lo, least(p.x1, q.x1) AS hi
                                FROM spans p JOIN spans q ON {p_is_q} AND p.slope < q.slope) c WHERE x > lo AND x < hi),
strips AS (SELECT * FROM (SELECT {key}, x AS lo, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS hi FROM stops) t WHERE hi > lo),
hits AS (SELECT {p_key}, p.side, p.polygon, s.lo, s.hi, p.uy + ((s.lo + s.hi) / 2 - p.ux) * p.slope AS y FROM spans p JOIN strips s ON {p_is_s} AND p.x0 <= s.lo AND p.x1 >= s.hi),
placed AS (SELECT *, row_number() OVER w AS n, lead(y) OVER w AS above FROM hits WINDOW w AS (PARTITION BY {key}, side, polygon, lo ORDER BY y)),
intervals AS (SELECT {key}, side, lo, hi, y, above FROM placed WHERE n % 2 = 1),
steps AS (SELECT {key}, lo, hi, y, lead(y) OVER (PARTITION BY {key}, lo ORDER BY y) AS above FROM (SELECT {key}, lo, hi, y FROM intervals UNION SELECT {key}, lo, hi, above FROM intervals) t),
told AS (SELECT {p_key}, (p.hi - p.lo) * (p.above - p.y) AS area,
                EXISTS (SELECT 1 FROM intervals s WHERE {p_is_s} AND s.side = 'a' AND s.lo = p.lo AND s.y < (p.y + p.above) / 2 AND s.above > (p.y + p.above) / 2) AS in_a,
                EXISTS (SELECT 1 FROM intervals s WHERE {p_is_s} AND s.side = 'b' AND s.lo = p.lo AND s.y < (p.y + p.above) / 2 AND s.above > (p.y + p.above) / 2) AS in_b
         FROM steps p WHERE p.above > p.y),
overlaid AS (SELECT {key}, round_even(coalesce(sum(area) FILTER (WHERE in_a), 0), 6) AS area_a, round_even(coalesce(sum(area) FILTER (WHERE in_b), 0), 6) AS area_b,
                    round_even(coalesce(sum(area) FILTER (WHERE in_a AND in_b), 0), 6) AS shared, round_even(coalesce(sum(area) FILTER (WHERE in_a OR in_b), 0), 6) AS united,
                    round_even(coalesce(sum(area) FILTER (WHERE in_a AND NOT in_b), 0), 6) AS only_a, round_even(coalesce(sum(area) FILTER (WHERE in_b AND NOT in_a), 0), 6) AS only_b FROM told GROUP BY {key})
"""


def _upright(*key: str) -> str:
    same = lambda other: " AND ".join(f"p.{k} = {other}.{k}" for k in key)
    return _UPRIGHT.format(key=", ".join(key), p_key=", ".join(f"p.{k}" for k in key), p_is_q=same("q"), p_is_s=same("s")).strip()


_LAYERS = """layers AS (SELECT p.object_id, p.polygon_id, 'a' AS side, o.polygon_id AS polygon, o.ux, o.uy, o.vx, o.vy FROM pairs p JOIN {objects} o ON o.polygon_id = p.object_id
           UNION ALL SELECT p.object_id, p.polygon_id, 'b' AS side, e.polygon_id AS polygon, e.ux, e.uy, e.vx, e.vy FROM pairs p JOIN {edges} e ON e.polygon_id = p.polygon_id)"""
_ALL_PAIRS = """ends AS (SELECT polygon_id, min(ux) AS x0, max(ux) AS x1, min(uy) AS y0, max(uy) AS y1 FROM {objects} GROUP BY polygon_id),
other AS (SELECT polygon_id, min(ux) AS x0, max(ux) AS x1, min(uy) AS y0, max(uy) AS y1 FROM {edges} GROUP BY polygon_id),
pairs AS (SELECT a.polygon_id AS object_id, b.polygon_id FROM ends a JOIN other b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""

#: The sweep of a pair as one expression of its row. Pieces are its rising edges, with their ways as a or b by side;
#: :e are the pieces of a band between :lo and :hi, :c the cuts among them. A slab adds what lies between pieces where :in holds.
_CROSS = "(q.lx - q.ly * q.slope - p.lx + p.ly * p.slope) / (p.slope - q.slope)"
_CUTS = f"""array_sort(array_distinct(concat(transform(:e, r -> greatest(r.ly, :lo)), transform(:e, r -> least(r.top, :hi)),
    flatten(transform(:e, p -> transform(filter(:e, q -> p.slope < q.slope AND {_CROSS} > greatest(p.ly, q.ly, :lo) AND {_CROSS} < least(p.top, q.top, :hi)), q -> {_CROSS}))))))"""
_SLABS = """aggregate(zip_with(slice(:c, 1, greatest(0, size(:c) - 1)), slice(:c, 2, greatest(0, size(:c) - 1)), (low, high) -> (high - low) * aggregate(
    array_sort(transform(filter(:e, r -> r.ly <= low AND r.top >= high), r -> struct(r.lx + ((low + high) / 2e0 - r.ly) * r.slope AS x, r.a AS a, r.b AS b))), struct(0e0 AS x, 0 AS a, 0 AS b, 0e0 AS s),
    (t, r) -> struct(r.x AS x, t.a + r.a AS a, t.b + r.b AS b, t.s + CASE WHEN :in THEN r.x - t.x ELSE 0e0 END AS s), t -> t.s)), 0e0, (s, v) -> s + v)"""
_BAND = "EACH(band, CAST(floor(lo / :band) AS BIGINT), greatest(CAST(floor(lo / :band) AS BIGINT), CAST(ceil(hi / :band) AS BIGINT) - 1))"


def _put(text: str, **said: str) -> str:
    return re.sub(r":(e|c|lo|hi|in)\b", lambda m: said.get(m[1], m[0]), text)


def _pieces(name: str, source: str, key: str, other: str) -> str:
    """Polygons of pairs with their box, their rising edges as an array and the area that is inside of them."""
    piece = f"""named_struct('lx', CASE WHEN vy > uy THEN ux ELSE vx END, 'ly', least(uy, vy), 'top', greatest(uy, vy), 'slope', (vx - ux) / nullif(vy - uy, 0e0), 'xl', least(ux, vx),
        '{name}', CASE WHEN vy > uy THEN 1 ELSE -1 END, '{other}', 0)"""
    if name == "b":  # both sides have their fields in one order
        piece = piece.replace("'b', CASE WHEN vy > uy THEN 1 ELSE -1 END, 'a', 0", "'a', 0, 'b', CASE WHEN vy > uy THEN 1 ELSE -1 END")
    return f"""{name}_held AS (SELECT polygon_id, min(least(ux, vx)) AS x0, max(greatest(ux, vx)) AS x1, min(least(uy, vy)) AS lo, max(greatest(uy, vy)) AS hi, collect_list(CASE WHEN uy <> vy THEN {piece} END) AS pieces
        FROM {{{source}}} LEFT SEMI JOIN (SELECT DISTINCT {key} AS asked FROM {{pairs}}) p ON polygon_id = asked GROUP BY polygon_id),
{name}_areas AS (SELECT polygon_id, sum({_put(_SLABS, e="e", c="c", **{"in": f"t.{name} <> 0"})}) AS area FROM (SELECT *, {_put(_CUTS, e="e", lo="low", hi="high")} AS c FROM (
        SELECT polygon_id, greatest(lo, band * :band) AS low, least(hi, (band + 1) * :band) AS high, filter(pieces, r -> r.ly < (band + 1) * :band AND r.top > band * :band) AS e FROM {name}_held {_BAND}) s) s GROUP BY polygon_id)"""


#: A pair meets in what their boxes share; whole areas follow once for a polygon. What a polygon alone does not tell is
#: summed from bands by pair, where pairs already are. Areas of whole and rest add up.
_PAIRED = f"""{_pieces("a", "objects", "object_id", "b")}, {_pieces("b", "edges", "polygon_id", "a")},
half AS (SELECT /*+ MERGE(p, q) */ p.object_id, p.polygon_id, q.x0, q.x1, q.lo, q.hi, q.pieces FROM {{pairs}} p JOIN b_held q ON q.polygon_id = p.polygon_id),
beside AS (SELECT /*+ MERGE(h, o) */ h.object_id, h.polygon_id, least(h.x1, o.x1) AS xr, greatest(h.lo, o.lo) AS lo, least(h.hi, o.hi) AS hi, concat(o.pieces, h.pieces) AS pieces FROM half h JOIN a_held o ON o.polygon_id = h.object_id),
met AS (SELECT object_id, polygon_id, sum({_put(_SLABS, e="e", c="c", **{"in": "t.a <> 0 AND t.b <> 0"})}) AS shared FROM (SELECT *, {_put(_CUTS, e="e", lo="low", hi="high")} AS c FROM (
        SELECT object_id, polygon_id, greatest(lo, band * :band) AS low, least(hi, (band + 1) * :band) AS high,
               filter(pieces, r -> r.ly < least(hi, (band + 1) * :band) AND r.top > greatest(lo, band * :band) AND r.xl <= xr) AS e FROM beside {_BAND} WHERE size(pieces) > 0) s) s GROUP BY object_id, polygon_id)"""
_WHOLES = {
    "a": ("a_whole AS (SELECT /*+ MERGE(m, w) */ m.*, w.area AS inside_a FROM {0} m JOIN a_areas w ON w.polygon_id = m.object_id)", "bround(inside_a, 6) AS area_a"),
    "b": ("b_whole AS (SELECT /*+ MERGE(m, w) */ m.*, w.area AS inside_b FROM {0} m JOIN b_areas w ON w.polygon_id = m.polygon_id)", "bround(inside_b, 6) AS area_b"),
}


def _areas(name: str, select: str):
    needs = [k for k, words in (("a", ("area_a", "only_a", "united")), ("b", ("area_b", "only_b", "united"))) if any(w in select for w in words)]
    steps, last, columns = [], "met", ["object_id", "polygon_id", "bround(shared, 6) AS shared"]
    for k in needs:
        steps.append(_WHOLES[k][0].format(last))
        last = f"{k}_whole"
        columns += [_WHOLES[k][1], f"bround(inside_{k} - shared, 6) AS only_{k}"]
    if len(needs) == 2:
        columns.append("bround(inside_a + inside_b - shared, 6) AS united")
    text = f"WITH {', '.join([_PAIRED, *steps])}, overlaid AS (SELECT {', '.join(columns)} FROM {last}) {select}"
    oracle = f"WITH {_ALL_PAIRS}, {_LAYERS}, {_upright('object_id', 'polygon_id')} {select.replace('bround', 'round_even')}"
    return operator(name, "objects edges", text, oracle=oracle, derived={"pairs": box_pairs}, cell=CELL, band=64.0)


overlay_pairs = _areas("o2_ring_overlay", "SELECT object_id, polygon_id, area_a, area_b, shared, united, only_a, only_b FROM overlaid")
surveyed = _areas("s16_surveyed_rings", "SELECT object_id, polygon_id, shared AS area FROM overlaid WHERE shared >= 0.15e0")
objects_faces = _areas("j8_objects_rings", "SELECT object_id, polygon_id, shared AS area, bround(shared / area_a + 0.000001e0, 4) AS share FROM overlaid WHERE shared >= 0.000001e0")
clip = _areas("j12_clip_rings", "SELECT polygon_id, object_id, shared AS area, only_b AS outside FROM overlaid WHERE shared >= 0.25e0")
footprint_member = _areas("f14_ring_membership", "SELECT object_id, polygon_id FROM overlaid WHERE shared >= greatest(0.25e0, 0.6e0 * area_a)")
_WHOLE = """layers AS (SELECT polygon_id AS group_id, 'a' AS side, concat('outline ', CAST(part AS STRING)) AS polygon, ux, uy, vx, vy FROM {edges}
           UNION ALL SELECT building_id AS group_id, 'b' AS side, concat('object ', CAST(polygon_id AS STRING)) AS polygon, ux, uy, vx, vy FROM {objects})"""
union = operator(
    "a1_union_rings", "objects edges", """SELECT /*+ MERGE(a, b) */ coalesce(a.group_id, b.group_id) AS building_id, bround(coalesce(area_a, 0e0), 6) AS outline, bround(coalesce(area_b, 0e0), 6) AS objects,
       bround(coalesce(area_a, 0e0) + coalesce(area_b, 0e0) - coalesce(shared, 0e0), 6) AS united, bround(coalesce(area_a, 0e0) - coalesce(shared, 0e0), 6) AS free FROM {alone} a FULL JOIN {within} b ON b.group_id = a.group_id""",
    oracle=f"WITH {_WHOLE}, {_upright('group_id')} SELECT group_id AS building_id, area_a AS outline, area_b AS objects, united, only_a AS free FROM overlaid", derived={"alone": outline_areas, "within": object_areas}, band=64.0,
)
