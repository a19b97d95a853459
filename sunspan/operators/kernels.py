"""Kernels that no composition of built-ins expresses: robust fits, polygon algorithms and order-dependent merges.

Each runs by group (tile, capture, building), whose rows fit one task, as an Arrow-backed grouped function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators._shared import by_group

# --- rings ----------------------------------------------------------------------------------------------------------


def ring_area(ring: np.ndarray) -> float:
    """Signed area by the shoelace sum; counter-clockwise is positive."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by a monotone chain; collinear points are left out."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def rotated_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Angle in degrees of the longest side, length and width of the smallest rectangle around the points."""
    hull = convex_hull(points)
    if len(hull) < 3:
        d = np.ptp(hull, axis=0) if len(hull) else np.zeros(2)
        return float(np.degrees(np.arctan2(d[1], d[0]))) if len(hull) > 1 else 0.0, float(np.hypot(*d)), 0.0
    best = None
    for d in np.roll(hull, -1, axis=0) - hull:
        u = d / np.hypot(*d)
        a, b = np.ptp(hull @ u), np.ptp(hull @ np.array([-u[1], u[0]]))
        if best is None or a * b < best[0] - 1e-12:
            angle = np.degrees(np.arctan2(u[1], u[0])) + (0 if a >= b else 90)
            best = (a * b, angle, max(a, b), min(a, b))
    return float(best[1]), float(best[2]), float(best[3])


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line of points, without recursion."""
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b], ring[b] - ring[a]
        n = np.hypot(*d)
        off = np.abs(d[0] * (p[:, 1] - ring[a, 1]) - d[1] * (p[:, 0] - ring[a, 0])) / n if n else np.hypot(*(p - ring[a]).T)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return ring[keep]


def bounded_simplify(ring: np.ndarray, most: int = 200) -> np.ndarray | None:
    """The first of the tolerances .025, .05, .1, ... up to 1 that leaves at most ``most`` points; None if none does."""
    tolerance = 0.025
    while tolerance <= 1:
        out = simplify(ring, tolerance)
        if len(out) <= most:
            return out
        tolerance *= 2
    return None


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: the part of a ring inside a counter-clockwise convex window."""
    out = [tuple(p) for p in ring]
    for (ax, ay), (bx, by) in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not out:
            break
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        nxt = []
        for i, p in enumerate(out):
            q, s, t = out[i - 1], side[i - 1], side[i]
            if (s >= 0) != (t >= 0):
                f = s / (s - t)
                nxt.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if t >= 0:
                nxt.append(p)
        out = nxt
    return np.array(out).reshape(-1, 2)


def covers_point(ring: np.ndarray, x: float, y: float) -> bool:
    """Ray casting: whether a point lies inside a ring."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def boxes_union_area(boxes: np.ndarray) -> float:
    """Area that boxes (x0, y0, x1, y1) cover together, over the grid of their edges."""
    if not len(boxes):
        return 0.0
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    cx, cy = (xs[:-1] + xs[1:]) / 2, (ys[:-1] + ys[1:]) / 2
    hit = np.zeros((len(cx), len(cy)), dtype=bool)
    for x0, y0, x1, y1 in boxes:
        hit |= ((cx > x0) & (cx < x1))[:, None] & ((cy > y0) & (cy < y1))[None, :]
    return float((hit * np.outer(np.diff(xs), np.diff(ys))).sum())


def union_area(faces: DataFrame) -> DataFrame:
    """building_id and the area that its boxes cover together."""

    def run(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], boxes_union_area(np.array([r[1:] for r in rows])))]

    return by_group(faces.select("building_id", "x0", "y0", "x1", "y1"), "building_id", [], run, "building_id long, area double")


def _point_groups(points: DataFrame, key: str = "user_id") -> DataFrame:
    return points.select(F.col(key).alias("ring_id"), "id", F.col("a").alias("x"), F.col("b").alias("y"))


def alignments(points: DataFrame) -> DataFrame:
    """ring_id, angle in [-90, 90), length and width of the smallest rectangle around each group of points."""

    def run(rows: list[tuple]) -> list[tuple]:
        angle, length, width = rotated_rectangle(np.array([r[2:] for r in rows], dtype=float))
        return [(rows[0][0], round((angle + 90) % 180 - 90, 2), round(length, 2), round(width, 2))]

    return by_group(_point_groups(points), "ring_id", ["id"], run, "ring_id long, angle double, length double, width double")


def simplify_rings(points: DataFrame) -> DataFrame:
    """ring_id, points before and after, and area of the hull of each group, simplified."""

    def run(rows: list[tuple]) -> list[tuple]:
        hull = convex_hull(np.array([r[2:] for r in rows], dtype=float))
        out = bounded_simplify(np.vstack([hull, hull[:1]])) if len(hull) > 2 else None
        return [(rows[0][0], len(rows), None if out is None else len(out) - 1, None if out is None else round(ring_area(out[:-1]), 6))]

    return by_group(_point_groups(points), "ring_id", ["id"], run, "ring_id long, before long, after long, area double")


# --- heights --------------------------------------------------------------------------------------------------------

# Fixed values of the consensus fit: seed, samples, tolerance in metres, cells that it needs, inliers below which it is refused.
SEED, TRIES, TOLERANCE, LEAST_CELLS, LEAST_INLIERS = 20260908, 200, 0.25, 12, 8


def consensus_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> dict | None:
    """Slopes, offset, inliers, error and rank of the plane that most points agree on; None for too few points.

    All samples of three are drawn and solved at once. Where hardly any points agree with the best, all take part. The
    plane is then fitted to those that agree, by their sums, until they no longer change, three times at most.
    """
    if len(z) < LEAST_CELLS:
        return None
    points = np.column_stack([x - x.mean(), y - y.mean(), np.ones(len(z))])
    three = np.argpartition(np.random.default_rng(SEED).random((TRIES, len(z))), 3, axis=1)[:, :3]
    some = three[np.abs(np.linalg.det(points[three])) > 1e-9]
    agree = np.ones(len(z), dtype=bool)
    if len(some):
        planes = np.linalg.solve(points[some], z[some][..., None])[..., 0]
        close = np.abs(planes @ points.T - z) <= TOLERANCE
        top = close[close.sum(axis=1).argmax()]
        agree = top if top.sum() >= LEAST_INLIERS else agree
    for _ in range(3):
        p, q = points[agree], z[agree]
        plane = np.linalg.pinv(p.T @ p) @ (p.T @ q)
        off = np.abs(points @ plane - z)
        nearer = off <= TOLERANCE
        if nearer.sum() < LEAST_INLIERS or (nearer == agree).all():
            break
        agree = nearer
    offset = plane[2] - plane[0] * x.mean() - plane[1] * y.mean()
    rank = np.linalg.matrix_rank(points[agree])
    return {"slope_x": plane[0], "slope_y": plane[1], "offset": offset, "inliers": int(agree.sum()), "rmse": float(np.sqrt((off[agree] ** 2).mean())), "rank": int(rank)}


def fit_plane(cells: DataFrame) -> DataFrame:
    """tile_id and its consensus plane over (col, row); a tile with fewer than 12 known cells has none."""
    columns = ("slope_x", "slope_y", "offset", "inliers", "rmse", "rank")

    def run(rows: list[tuple]) -> list[tuple]:
        _, row, col, z = zip(*rows, strict=True)
        fit = consensus_plane(np.array(col, dtype=float), np.array(row, dtype=float), np.array(z, dtype=float))
        return [(rows[0][0], *(round(float(fit[c]), 9) if c not in ("inliers", "rank") else fit[c] for c in columns))] if fit else []

    known = cells.where("z is not null").select("tile_id", "row_no", "col_no", "z")
    return by_group(known, "tile_id", ["row_no", "col_no"], run, "tile_id long, slope_x double, slope_y double, offset double, inliers long, rmse double, rank long")


def group_triangles(triangles: DataFrame) -> DataFrame:
    """batch, face and area of triangles joined greedily, largest first: within 12 degrees and .4 m of a face's plane."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.column_stack([-pdf["a"], -pdf["b"], np.ones(len(pdf))])
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        area, offset = pdf["value"].to_numpy() / 100, pdf["height"].to_numpy() % 7 / 5
        faces: list[dict] = []
        for i in np.lexsort((pdf["id"].to_numpy(), -area)):
            if n[i, 2] < 0.30:
                continue
            for f in faces:
                if n[i] @ f["n"] >= np.cos(np.radians(12)) and abs(offset[i] - f["offset"]) <= 0.4:
                    f["area"] += area[i]
                    f["count"] += 1
                    break
            else:
                faces.append({"n": n[i], "offset": offset[i], "area": area[i], "count": 1})
        kept = [(f["area"], f["count"]) for f in faces if f["area"] >= 3]
        return pd.DataFrame({"batch": pdf["user_id"].iloc[0], "face": range(len(kept)), "area": [round(a, 6) for a, _ in kept], "triangles": [c for _, c in kept]})

    return triangles.select("user_id", "id", "a", "b", "height", "value").groupBy("user_id").applyInPandas(run, "batch long, face long, area double, triangles long")


# --- detections -----------------------------------------------------------------------------------------------------


def _overlap(a: tuple, b: tuple) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _area(a: tuple) -> float:
    return (a[2] - a[0]) * (a[3] - a[1])


def merge_detections(detections: DataFrame) -> DataFrame:
    """Detections of a capture by falling confidence: one of a kind that overlaps an earlier one by more than half of the smaller joins it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "object_id"], ascending=[False, True], na_position="last")
        kept: list[dict] = []
        for r in pdf.itertuples(index=False):
            box = (r.x0, r.y0, r.x1, r.y1)
            for k in kept:
                if k["kind"] == r.kind and any(_overlap(box, b) / min(_area(box), _area(b)) > 0.5 for b in k["boxes"]):
                    k["boxes"].append(box)
                    break
            else:
                kept.append({"object_id": r.object_id, "kind": r.kind, "confidence": r.confidence, "boxes": [box]})
        return pd.DataFrame([(pdf["capture_id"].iloc[0], k["object_id"], k["kind"], k["confidence"], len(k["boxes"]), round(boxes_union_area(np.array(k["boxes"])), 6)) for k in kept], columns=["capture_id", "object_id", "kind", "confidence", "members", "area"])

    return detections.groupBy("capture_id").applyInPandas(run, "capture_id long, object_id long, kind string, confidence double, members long, area double")


def deduplicate(detections: DataFrame) -> DataFrame:
    """Objects of a capture, existing plants first, then marks by hand: what overlaps one of its kind joins it, and an
    image's skylight of which 95 % lies in a plant is evidence of the plant. Kinds never merge; touching stays apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = np.where(pdf["kind"] == "existing_pv", 0, np.where(pdf["source"] == "manual", 1, 2))
        pdf = pdf.assign(rank=rank, height_m=pdf["height_m"].astype(float)).sort_values(["rank", "object_id"])
        kept: list[dict] = []
        for r in pdf.itertuples(index=False):
            box = (r.x0, r.y0, r.x1, r.y1)
            for k in kept:
                inside = r.kind == "skylight" and r.source == "image" and k["kind"] == "existing_pv" and max(_overlap(box, b) for b in k["boxes"]) >= 0.95 * _area(box)
                same = k["kind"] == r.kind and any(_overlap(box, b) > 1e-6 for b in k["boxes"])
                if inside or same:
                    k["sources"].add(r.source)
                    k["kinds"].add(r.kind)
                    if same:
                        k["boxes"].append(box)
                        k["height"] = np.fmax(k["height"], r.height_m)
                    break
            else:
                kept.append({"id": r.object_id, "kind": r.kind, "boxes": [box], "sources": {r.source}, "kinds": {r.kind}, "height": r.height_m})
        rows = [(pdf["capture_id"].iloc[0], k["id"], k["kind"], "+".join(sorted(k["sources"])), "+".join(sorted(k["kinds"])), k["height"], round(boxes_union_area(np.array(k["boxes"])), 6)) for k in kept]
        return pd.DataFrame(rows, columns=["capture_id", "object_id", "kind", "sources", "kinds", "height_m", "area"])

    return detections.groupBy("capture_id").applyInPandas(run, "capture_id long, object_id long, kind string, sources string, kinds string, height_m double, area double")
