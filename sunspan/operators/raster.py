"""Raster operators over cell relations (tile, row, col, value): stencils are joins with a table of offsets."""

from __future__ import annotations

from sunspan.operators._sql import operator
from sunspan.operators.relational import CLEAN

RESIDUAL = f"SELECT tile_id, row_no, col_no, {CLEAN} - 0.15e0 * col_no - 500e0 AS residual FROM {{cells}}"
RAISED = f"SELECT tile_id, row_no, col_no FROM ({RESIDUAL}) r WHERE residual > 0.35e0"
OFFSETS = "SELECT a.n - 1 AS dr, b.n - 1 AS dc FROM {numbers} a CROSS JOIN {numbers} b WHERE a.n < 3 AND b.n < 3"
DILATED = f"SELECT DISTINCT r.tile_id, r.row_no + o.dr AS row_no, r.col_no + o.dc AS col_no FROM ({RAISED}) r CROSS JOIN ({OFFSETS}) o"
CLOSED = f"""SELECT d.tile_id, d.row_no, d.col_no FROM ({DILATED}) d CROSS JOIN ({OFFSETS}) o
             JOIN ({DILATED}) e ON e.tile_id = d.tile_id AND e.row_no = d.row_no + o.dr AND e.col_no = d.col_no + o.dc
             GROUP BY d.tile_id, d.row_no, d.col_no HAVING count(*) = 9"""
#: Bindings for component operators: cells as nodes, 8-neighbours as links.
CELL_LINKS = f"""SELECT a.tile_id * 100000000 + a.row_no * 10000 + a.col_no AS a, b.tile_id * 100000000 + b.row_no * 10000 + b.col_no AS b
                 FROM ({CLOSED}) a CROSS JOIN ({OFFSETS}) o JOIN ({CLOSED}) b ON b.tile_id = a.tile_id AND b.row_no = a.row_no + o.dr AND b.col_no = a.col_no + o.dc"""

raised_cells = operator("i1_raised_cells", "cells", f"SELECT * FROM ({RAISED}) r")
closed_cells = operator("i1_closed_obstacles", "cells numbers", f"SELECT * FROM ({CLOSED}) c")
core_cells = operator(
    "i2_core_cells", "cells numbers",
    f"""SELECT d.tile_id, d.row_no, d.col_no FROM (SELECT tile_id, row_no, col_no FROM {{cells}} WHERE z IS NOT NULL) d CROSS JOIN ({OFFSETS}) o
        JOIN (SELECT tile_id, row_no, col_no FROM {{cells}} WHERE z IS NOT NULL) e ON e.tile_id = d.tile_id AND e.row_no = d.row_no + o.dr AND e.col_no = d.col_no + o.dc
        GROUP BY d.tile_id, d.row_no, d.col_no HAVING count(*) = 9""",
)
gradient = operator(
    "p30_edge_strength", "cells",
    f"""SELECT tile_id, row_no, col_no, bround(sqrt(pow((r - l) / 2e0, 2) + pow((d - u) / 2e0, 2)), 6) AS edge FROM (
        SELECT tile_id, row_no, col_no, lag(v) OVER (PARTITION BY tile_id, row_no ORDER BY col_no) AS l, lead(v) OVER (PARTITION BY tile_id, row_no ORDER BY col_no) AS r,
               lag(v) OVER (PARTITION BY tile_id, col_no ORDER BY row_no) AS u, lead(v) OVER (PARTITION BY tile_id, col_no ORDER BY row_no) AS d
        FROM (SELECT tile_id, row_no, col_no, {CLEAN} AS v FROM {{cells}}) c) g WHERE l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL""",
)
estimate_shift = operator(
    "a20_estimate_shift", "cells numbers",
    f"""SELECT tile_id, dx, dy, score FROM (
        SELECT tile_id, dx, dy, score, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, ord) AS rn FROM (
            SELECT c.tile_id, s.dx, s.dy, s.ord, bround(avg(c.v), 6) AS score
            FROM (SELECT a.n - 5 AS dx, b.n - 5 AS dy, a.n * 11 + b.n AS ord FROM {{numbers}} a CROSS JOIN {{numbers}} b WHERE a.n < 11 AND b.n < 11) s
            CROSS JOIN (SELECT n AS k, CASE WHEN n < 4 THEN 11 ELSE 16 END AS r0, 13 + n % 4 AS c0 FROM {{numbers}} WHERE n < 8) p
            JOIN (SELECT tile_id, row_no, col_no, {CLEAN} - 500e0 AS v FROM {{cells}}) c ON c.row_no = p.r0 + s.dy AND c.col_no = p.c0 + s.dx
            WHERE c.v IS NOT NULL GROUP BY c.tile_id, s.dx, s.dy, s.ord HAVING count(*) >= 5) t) r WHERE rn = 1""",
)
box_mean = operator(
    "i5_local_contrast", "cells",
    f"SELECT tile_id, row_no, col_no, bround(v - avg(v) OVER (PARTITION BY tile_id, row_no ORDER BY col_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS contrast FROM (SELECT tile_id, row_no, col_no, {CLEAN} AS v FROM {{cells}}) c WHERE v IS NOT NULL",
)
refit_plane = operator(
    "a4_refit_plane", "cells",
    f"""SELECT tile_id, n, bround(sxz / nullif(sxx, 0), 6) AS slope_col, bround(syz / nullif(syy, 0), 6) AS slope_row FROM (
        SELECT t.tile_id, CAST(count(*) AS BIGINT) AS n, sum((t.col_no - m.mc) * (t.v - m.mv)) AS sxz, sum(pow(t.col_no - m.mc, 2)) AS sxx, sum((t.row_no - m.mr) * (t.v - m.mv)) AS syz, sum(pow(t.row_no - m.mr, 2)) AS syy
        FROM (SELECT tile_id, row_no, col_no, {CLEAN} AS v FROM {{cells}}) t
        JOIN (SELECT tile_id, avg(col_no) AS mc, avg(row_no) AS mr, avg({CLEAN}) AS mv FROM {{cells}} WHERE z IS NOT NULL AND z > -100 GROUP BY tile_id) m ON m.tile_id = t.tile_id
        WHERE t.v IS NOT NULL GROUP BY t.tile_id HAVING count(*) >= 12) s""",
)


def clean_raster_input(cells):
    """Cells with missing and impossible heights as null."""
    return clean_cells(cells=cells)


clean_cells = operator("s11_cells", "cells", f"SELECT tile_id, row_no, col_no, {CLEAN} AS z FROM {{cells}}")
