"""Module packing: every layout of the grid of orientations and offsets is counted, and the first of the best wins.

A module is a column and a row of its lattice, and it is blocked where its column and its row both meet the obstacle.
So columns and rows are counted apart, and a layout's modules are columns times rows less blocked columns times blocked
rows. Both counts are quotients: a face's 32 layouts follow from its row, without a join or a shuffle, for all faces of
a batch at once, and modules are made for the chosen layout only. LATTICES is the same as one expression of a row, which
tests compare. The oracles make every column and row of every layout and count them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators._sql import ansi, operator
from sunspan.operators.relational import ASSESSED

USABLE = "SELECT face_id, building_id, part_no, x0 + 0.3e0 AS x0, y0 + 0.3e0 AS y0, x1 - 0.3e0 AS x1, y1 - 0.3e0 AS y1, irradiation, CASE WHEN pk % 3 = 0 THEN x0 + 2e0 END AS ox, CASE WHEN pk % 3 = 0 THEN y0 + 1e0 END AS oy FROM {faces}"
WIDE, HIGH = "CASE o WHEN 0 THEN 1.134e0 ELSE 1.762e0 END", "CASE o WHEN 0 THEN 1.762e0 ELSE 1.134e0 END"


def _axis(low: str, high: str, size: str, obstacle: str) -> str:
    """Places along one axis: for each orientation o and offset f, lattice place i, and whether the obstacle is met."""
    return f"""SELECT face_id, o, f, i, place, NOT ({obstacle} IS NULL OR place + size <= {obstacle} - 0.4e0 OR place >= {obstacle} + 1.4e0) AS met FROM (
        SELECT *, lo + f * 0.25e0 * (size + 0.02e0) + i * (size + 0.02e0) AS place FROM (
            SELECT face_id, o, f, i, {size} AS size, {low} AS lo, {high} AS hi, {obstacle} FROM ({USABLE}) u EACH(o, CAST(0 AS BIGINT), CAST(1 AS BIGINT)) EACH(f, CAST(0 AS BIGINT), CAST(3 AS BIGINT))
            EACH(i, CAST(0 AS BIGINT), CAST(floor(({high} - {low}) / 1.154e0) AS BIGINT))) a) b
        WHERE place + size <= hi + 1e-9"""


COLUMNS, ROWS = _axis("x0", "x1", WIDE, "ox"), _axis("y0", "y1", HIGH, "oy")
COUNTS = "SELECT face_id, o, f, count(*) AS n, sum(CASE WHEN met THEN 1 ELSE 0 END) AS met FROM ({0}) p GROUP BY face_id, o, f"
COUNTED = f"""
SELECT face_id, o, fx, fy, ord, panels FROM (
    SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY panels DESC, ord) AS rn FROM (
        SELECT c.face_id, c.o, c.f AS fx, r.f AS fy, c.o * 16 + r.f * 4 + c.f AS ord, CAST(c.n * r.n - c.met * r.met AS BIGINT) AS panels
        FROM ({COUNTS.format(COLUMNS)}) c JOIN ({COUNTS.format(ROWS)}) r ON r.face_id = c.face_id AND r.o = c.o) l WHERE panels > 0) w WHERE rn = 1"""
MADE = f"""
SELECT b.face_id, c.i AS i, r.i AS j, c.place AS px, r.place AS py, CASE b.o WHEN 0 THEN 1.134e0 ELSE 1.762e0 END AS mw, CASE b.o WHEN 0 THEN 1.762e0 ELSE 1.134e0 END AS mh
FROM ({COUNTED}) b JOIN ({COLUMNS}) c ON c.face_id = b.face_id AND c.o = b.o AND c.f = b.fx JOIN ({ROWS}) r ON r.face_id = b.face_id AND r.o = b.o AND r.f = b.fy
WHERE NOT (c.met AND r.met)"""


def _quotients(low: str, high: str, size: str, obstacle: str) -> str:
    """For orientations and offsets (k = 4 o + f) how many lattice places there are, and which of them meet the obstacle."""
    size = size.replace("CASE o", "CASE k div 4")
    step, start = f"({size} + 0.02e0)", f"({low} + (k % 4) * 0.25e0 * ({size} + 0.02e0))"
    last = f"(floor(({high} + 1e-9 - {size} - {start}) / {step}))"
    from_, to = f"greatest(0, floor(({obstacle} - 0.4e0 - {size} - {start}) / {step}) + 1)", f"least({last}, ceil(({obstacle} + 1.4e0 - {start}) / {step}) - 1)"
    return f"""transform(sequence(0, 7), k -> named_struct('n', greatest(0L, {last} + 1), 'met', if({obstacle} IS NULL, 0L, greatest(0L, {to} - {from_} + 1)),
        'size', {size}, 'start', {start}, 'low', {from_}, 'high', {to}))"""


def _fitted(rows: str) -> str:
    """``rows`` of faces with cols, lines and best: 64 times the modules of the best layout, and 63 less its number."""
    edges = "x0 + 0.3e0 AS ux0, y0 + 0.3e0 AS uy0, x1 - 0.3e0 AS ux1, y1 - 0.3e0 AS uy1, CASE WHEN pk % 3 = 0 THEN x0 + 2e0 END AS ox, CASE WHEN pk % 3 = 0 THEN y0 + 1e0 END AS oy"
    count = "cols[(l div 16) * 4 + l % 4].n * lines[l div 4].n - cols[(l div 16) * 4 + l % 4].met * lines[l div 4].met"
    axes = f"named_struct('cols', {_quotients('ux0', 'ux1', WIDE, 'ox')}, 'lines', {_quotients('uy0', 'uy1', HIGH, 'oy')})"
    # generators of one row: what is computed there is computed once, and no filter carries it elsewhere
    return f"""SELECT * EXCEPT (axes), axes.cols, axes.lines FROM (SELECT *, {edges} FROM ({rows}) f) e LATERAL VIEW explode(array({axes})) _a AS axes
        LATERAL VIEW explode(array(array_max(transform(sequence(0, 31), l -> ({count.replace("cols[", "axes.cols[").replace("lines[", "axes.lines[")}) * 64 + 63 - l)))) _b AS best"""


BEST = f"SELECT face_id, ord div 16 AS o, cols, lines, ord, panels FROM (SELECT face_id, cols, lines, 63 - best % 64 AS ord, best div 64 AS panels FROM ({_fitted('SELECT * FROM {faces}')}) t) b WHERE panels > 0"
_CHOSEN = f"SELECT face_id, panels, col, line FROM (SELECT face_id, panels, cols[CAST((ord div 16) * 4 + ord % 4 AS INT)] AS col, lines[CAST(ord div 4 AS INT)] AS line FROM ({BEST}) b) c"
PANELS = f"""
SELECT face_id, i, j, col.start + i * (col.size + 0.02e0) AS px, line.start + j * (line.size + 0.02e0) AS py, col.size AS mw, line.size AS mh
FROM {{chosen}} c EACH(i, CAST(0 AS BIGINT), col.n - 1) EACH(j, CAST(0 AS BIGINT), line.n - 1)
WHERE NOT (col.met > 0 AND line.met > 0 AND i BETWEEN col.low AND col.high AND j BETWEEN line.low AND line.high)"""


_AXIS = "struct<n:bigint,met:bigint,size:double,start:double,low:bigint,high:bigint>"


def _places(low: np.ndarray, high: np.ndarray, at: np.ndarray, sizes: tuple[float, float]) -> dict[str, np.ndarray]:
    """What _quotients() tells, as arrays of 8 orientations and offsets by faces; ``at`` is NaN without an obstacle."""
    k = np.arange(8)[:, None]
    size = np.where(k < 4, *sizes)
    step = size + 0.02
    start = low + k % 4 * 0.25 * step
    last = np.floor((high + 1e-9 - size - start) / step)
    first, end = np.maximum(0, np.floor((at - 0.4 - size - start) / step) + 1), np.fmin(last, np.ceil((at + 1.4 - start) / step) - 1)
    met = np.where(np.isnan(at), 0, np.maximum(0, end - first + 1))
    return {"n": np.maximum(0, last + 1), "met": met, "size": np.broadcast_to(size, start.shape), "start": start, "low": first, "high": end}


def fitted(faces: DataFrame, *keep: str, lattice: bool = False) -> DataFrame:
    """``keep`` of each face with ord and panels of its best layout, null where its box is not known; with ``lattice`` also
    col and line, the columns and rows of that layout as _quotients() has them. A row is a face; nothing is shuffled."""
    made = [f"{f.name} {f.dataType.simpleString()}" for f in faces.select(*keep).schema.fields] + ["ord bigint", "panels bigint"] + [f"{c} {_AXIS}" for c in ("col", "line") if lattice]
    whole, axis = (lambda v, known: pa.array(v.astype(np.int64), mask=~known)), ("n", "met", "size", "start", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x0, y0, x1, y1 = (np.asarray(b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float) for c in ("_x0", "_y0", "_x1", "_y1"))
            holed = np.asarray(b.column("_hole").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            known = np.isfinite(x0 + y0 + x1 + y1)
            x0, y0, x1, y1 = (np.where(known, v, 0.0) for v in (x0, y0, x1, y1))
            cols, lines = _places(x0 + 0.3, x1 - 0.3, np.where(holed, x0 + 2, np.nan), (1.134, 1.762)), _places(y0 + 0.3, y1 - 0.3, np.where(holed, y0 + 1, np.nan), (1.762, 1.134))
            number = np.arange(32)
            at_col, at_line = number // 16 * 4 + number % 4, number // 4
            count = cols["n"][at_col] * lines["n"][at_line] - cols["met"][at_col] * lines["met"][at_line]
            ord_ = count.argmax(axis=0)  # the first of the best
            row = np.arange(b.num_rows)
            out = [b.column(c) for c in keep] + [whole(ord_, known), whole(count[ord_, row] if b.num_rows else ord_, known)]
            for places, at in ((cols, at_col), (lines, at_line)) if lattice else ():
                chosen = (np.nan_to_num(places[c][at[ord_], row]) for c in axis)
                out.append(pa.StructArray.from_arrays([pa.array(v if c in ("size", "start") else v.astype(np.int64)) for c, v in zip(axis, chosen, strict=True)], names=list(axis)))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "ord", "panels", *(("col", "line") if lattice else ())])

    asked = faces.select(*keep, *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), (F.col("pk") % 3 == 0).alias("_hole"))
    return asked.mapInArrow(run, ", ".join(made))


def _best(faces: DataFrame) -> DataFrame:
    return fitted(faces, "face_id").where("panels > 0").withColumn("o", F.expr("ord div 16"))


def _chosen(faces: DataFrame) -> DataFrame:
    return fitted(faces, "face_id", lattice=True).where("panels > 0")


def _usable(faces: DataFrame) -> DataFrame:
    return fitted(faces.sparkSession.sql(ASSESSED, faces=faces).where("status <> 'not_recommended'"), "building_id", "face_id", "part_no", "irradiation").withColumn("fits", F.expr("coalesce(greatest(0L, panels), 0L)"))


def _assessed(faces: DataFrame) -> DataFrame:
    return fitted(faces.sparkSession.sql(ASSESSED, faces=faces), "building_id", "face_id", "irradiation", "status").where("panels > 0")


#: What texts read by name: relations of faces with their best layouts.
PACKED = {"best": _best, "chosen": _chosen, "usable": _usable, "assessed": _assessed}


def packed(name: str, text: str, joined: str | None = None, **settings: float):
    """An operator over {best}, <PANELS> or <FITTED> by their names in ``text``; its oracle is ``joined``, or the same text,
    over all that is counted or made."""
    fill = lambda t, best, panels, fitted: t.replace("<BEST>", best).replace("<PANELS>", panels).replace("<FITTED>", fitted)
    spark = fill(text, "SELECT * FROM {best}", PANELS, "SELECT building_id, face_id, part_no, irradiation, fits FROM {usable}")
    return operator(name, "faces", spark, oracle=ansi(fill(joined or text, COUNTED, MADE, JOINED)), derived={k: f for k, f in PACKED.items() if "{" + k + "}" in spark}, **settings)


#: Faces that may be used, with the modules that their best layout holds.
JOINED = f"SELECT f.building_id, f.face_id, f.part_no, f.irradiation, coalesce(b.panels, 0) AS fits FROM ({ASSESSED}) f LEFT JOIN ({COUNTED}) b ON b.face_id = f.face_id WHERE f.status <> 'not_recommended'"
optimise = packed("k2_optimise_panels", f"SELECT face_id, CASE o WHEN 0 THEN 'portrait' ELSE 'landscape' END AS orientation, CAST(ord % 16 AS BIGINT) AS layout, panels FROM (<BEST>) b")
panels = packed("k2_panels", f"SELECT face_id, i, j, bround(px, 4) AS x, bround(py, 4) AS y FROM (<PANELS>) p")
_PAIRS = """SELECT a.face_id, a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj FROM (
            SELECT *, i + CAST(floor(s / 3e0) AS BIGINT) - 1 AS ni, j + s % 3 - 1 AS nj FROM (<PANELS>) p EACH(s, CAST(0 AS BIGINT), CAST(8 AS BIGINT))) a
        JOIN (<PANELS>) b ON b.face_id = a.face_id AND b.i = a.ni AND b.j = a.nj
        WHERE a.i * 100 + a.j < b.i * 100 + b.j AND sqrt(pow(greatest(0e0, abs(a.px - b.px) - a.mw), 2) + pow(greatest(0e0, abs(a.py - b.py) - a.mh), 2)) <= 0.02e0 + 0.05e0 + 1e-9"""


def _there(i: str, j: str) -> str:
    """Whether a place of the chosen layout holds a module."""
    return f"{i} BETWEEN 0 AND col.n - 1 AND {j} BETWEEN 0 AND line.n - 1 AND NOT (col.met > 0 AND line.met > 0 AND {i} BETWEEN col.low AND col.high AND {j} BETWEEN line.low AND line.high)"


#: A module's neighbours are places of its own lattice: pairs follow from the row of the face, without a join. The
#: four neighbours that come later are asked for. Only the oracle joins modules.
_GAPS = [f"pow(greatest(0e0, abs(({axis}.start + {a} * ({axis}.size + 0.02e0)) - ({axis}.start + {b} * ({axis}.size + 0.02e0))) - {axis}.size), 2)" for axis, a, b in (("col", "i", "ni"), ("line", "j", "nj"))]
PAIRS = f"""SELECT face_id, i AS ai, j AS aj, ni AS bi, nj AS bj FROM (
        SELECT *, i + CAST(floor(s / 3e0) AS BIGINT) - 1 AS ni, j + s % 3 - 1 AS nj FROM (
            SELECT face_id, col, line, i, j FROM {{chosen}} c EACH(i, CAST(0 AS BIGINT), col.n - 1) EACH(j, CAST(0 AS BIGINT), line.n - 1) WHERE {_there("i", "j")}) p EACH(s, CAST(5 AS BIGINT), CAST(8 AS BIGINT))) a
    WHERE {_there("ni", "nj")} AND sqrt({" + ".join(_GAPS)}) <= 0.02e0 + 0.05e0 + 1e-9"""
module_adjacency = operator("j3_module_adjacency", "faces", PAIRS, oracle=ansi(_PAIRS.replace("<PANELS>", MADE)), derived={"chosen": _chosen})
_LATTICE = "SELECT face_id, col.n AS n, line.n AS m, if(col.met > 0 AND line.met > 0, array(col.low, col.high, line.low, line.high), array(0L, -1L, 0L, -1L)) AS hole FROM {0} c"
#: A row for each face: the columns and rows of its chosen layout, and those between which modules are blocked.
LATTICES = _LATTICE.format(f"({_CHOSEN})")


def lattices(faces: DataFrame) -> DataFrame:
    """What LATTICES tells, by fitted()."""
    return faces.sparkSession.sql(_LATTICE.format("{chosen}"), chosen=_chosen(faces))


demand = packed(
    "k7_demand_allocation",
    """SELECT building_id, face_id, wanted FROM (
        SELECT building_id, face_id, CAST(greatest(0, least(panels, needed - coalesce(sum(panels) OVER (PARTITION BY building_id ORDER BY irradiation DESC, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS wanted
        FROM (SELECT building_id, face_id, part_no, irradiation, fits AS panels, CAST(ceil(:target_kwh / (:power_kw * irradiation * :performance_ratio)) AS BIGINT) AS needed
              FROM (<FITTED>) b WHERE fits > 0 AND irradiation IS NOT NULL) t) w""",
    joined=f"""SELECT building_id, face_id, wanted FROM (
        SELECT building_id, face_id, CAST(greatest(0, least(panels, needed - coalesce(sum(panels) OVER (PARTITION BY building_id ORDER BY irradiation DESC, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS wanted
        FROM (SELECT f.building_id, f.face_id, f.part_no, f.irradiation, b.panels, CAST(ceil(:target_kwh / (:power_kw * f.irradiation * :performance_ratio)) AS BIGINT) AS needed
              FROM (<BEST>) b JOIN ({ASSESSED}) f ON f.face_id = b.face_id WHERE f.status <> 'not_recommended' AND f.irradiation IS NOT NULL) t) w""",
    target_kwh=4000.0, power_kw=0.45, performance_ratio=0.8,
)

BEFORE = "coalesce(sum(fits) OVER (PARTITION BY building_id{0} ORDER BY {1} DESC, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
ALLOCATED = f"SELECT building_id, face_id, irradiation, fits, CAST(greatest(0, least(fits, :most_panels - {BEFORE.format('', 'coalesce(irradiation, -1e0)')})) AS BIGINT) AS placed FROM (<FITTED>) t"
allocation = packed("w4_allocation", f"SELECT building_id, face_id, fits, placed FROM ({ALLOCATED}) w", most_panels=60)
roof_potential = packed(
    "m1_roof_potential",
    f"""SELECT building_id, CAST(count(*) AS BIGINT) AS faces, CAST(sum(placed) AS BIGINT) AS panels, bround(sum(placed) * :power_kw, 3) AS kwp,
               CASE WHEN count(*) = count(irradiation) THEN CAST(bround(sum(placed * :power_kw * irradiation * :performance_ratio), 0) AS BIGINT) END AS kwh
        FROM ({ALLOCATED}) w GROUP BY building_id""",
    most_panels=60, power_kw=0.45, performance_ratio=0.8,
)
objectives = packed(
    "k8_objective_comparison",
    f"""SELECT building_id, objective, CAST(sum(placed) AS BIGINT) AS panels FROM (
        SELECT building_id, objective, greatest(0, least(fits, :most_panels - {BEFORE.format(', objective', 'score')})) AS placed
        FROM (SELECT building_id, part_no, fits, o.objective, CASE WHEN o.objective = 'energy' THEN coalesce(irradiation, -1e0) ELSE fits * 1e0 END AS score
              FROM (<FITTED>) t CROSS JOIN (SELECT 'capacity' AS objective UNION ALL SELECT 'energy' AS objective) o) s) p GROUP BY building_id, objective""",
    most_panels=60,
)
