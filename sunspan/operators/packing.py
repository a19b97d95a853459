"""Packing of many faces at once: lattices are lines of modules, and a margin or an object takes a stretch of a line.

The results are those of roofs._packed(), which packs a face on its own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from sunspan.operators import rings
from sunspan.operators.batches import AT_ONCE, EPS, Polygons, columns_below, contains, crossings, parts, spread
from sunspan.operators.rings import FRACTIONS, MITRE, MOST_CANDIDATES
from sunspan.settings import Settings

#: What a hole of a roof is.
TAKEN, PLANT, OBSTACLE = 0, 1, 2


def _bands(shape: Polygons, margin: np.ndarray, outwards: np.ndarray) -> np.ndarray:
    """rings.Bands.along() of all sides: centre, axis, half length and half width."""
    no = np.arange(len(shape.sides))
    p, d = shape.sides[:, :2], shape.sides[:, 2:] - shape.sides[:, :2]
    n = np.hypot(d[:, 0], d[:, 1])
    u = d / n[:, None]
    was = u[no + shape.before]
    turn = shape.left * np.arctan2(was[:, 0] * u[:, 1] - was[:, 1] * u[:, 0], (was * u).sum(axis=1))
    start = np.where((turn > 0) == outwards, margin * np.minimum(np.tan(np.abs(turn) / 2), MITRE), 0.0)
    end = start[no + shape.after]
    return np.column_stack([p + u * ((n + end - start) / 2)[:, None], u, (n + start + end) / 2, np.maximum(margin, EPS)])


def _turn(x: np.ndarray, y: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x * c - y * s, x * s + y * c


def _box(roof: Polygons, sides: np.ndarray, bands: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """Region.bounds() by the corners of the inner outline, and where it needs cells because there are too few."""
    no = np.arange(len(roof.sides))
    d = roof.sides[:, 2:] - roof.sides[:, :2]
    u = d / np.maximum(np.hypot(d[:, 0], d[:, 1]), EPS)[:, None]
    was = u[no + roof.before]
    cross = was[:, 0] * u[:, 1] - was[:, 1] * u[:, 0]
    both = was + u
    shift = np.column_stack([-both[:, 1], both[:, 0]]) * (roof.left * edge / np.maximum(1 + (was * u).sum(axis=1), 0.08))[:, None]
    corner = roof.padded(np.where((np.abs(cross) > EPS)[:, None], roof.sides[:, :2] + shift, np.nan))
    with np.errstate(invalid="ignore"):
        n = np.isfinite(corner[:, :, 0]).sum(axis=1)
        tried = corner + (np.nansum(corner, axis=1, keepdims=True) / np.maximum(n, 1)[:, None, None] - corner) * 1e-7
        x, y = tried[:, :, 0], tried[:, :, 1]
        ok = np.isfinite(x) & contains(sides, x, y)
        for k in range(bands.shape[1]):
            cx, cy, ax, ay, half, wide = (bands[:, k, i, None] for i in range(6))
            dx, dy = x - cx, y - cy
            hit = (np.abs(dx) < half * np.abs(ax) + wide * np.abs(ay) - EPS) & (np.abs(dy) < half * np.abs(ay) + wide * np.abs(ax) - EPS)
            ok &= ~(hit & (np.abs(dx * ax + dy * ay) < half - EPS) & (np.abs(dy * ax - dx * ay) < wide - EPS))
    low, high = np.where(ok[:, :, None], corner, np.inf).min(axis=1, initial=np.inf), np.where(ok[:, :, None], corner, -np.inf).max(axis=1, initial=-np.inf)
    return np.hstack([low, high]), ok.sum(axis=1) < 2


def _stretches(bands: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the middle of a module in a line at y reaches into each band; from inf where it does not."""
    cx, cy, ax, ay, half, wide = (bands[:, :, i] for i in range(6))
    w, h, ux, uy = w[:, None] / 2, h[:, None] / 2, np.abs(ax), np.abs(ay)
    dy = y[:, None] - cy
    most = w + half * ux + wide * uy - EPS
    ok = np.abs(dy) < h + half * uy + wide * ux - EPS
    low, high = -most, most
    with np.errstate(invalid="ignore", divide="ignore"):
        for along, across, reach in ((ax, dy * ay, half + w * ux + h * uy - EPS), (ay, -dy * ax, wide + w * uy + h * ux - EPS)):
            flat = np.abs(along) < 1e-12  # what lies along the line has the same distance everywhere
            ok &= ~flat | (np.abs(across) < reach)
            middle, by = -across / along, reach / np.abs(along)
            low, high = np.maximum(low, np.where(flat, -np.inf, middle - by)), np.minimum(high, np.where(flat, np.inf, middle + by))
    return np.where(ok, cx + low, np.inf), cx + high


@lru_cache(maxsize=50_000)
def _order(held: bytes, nx: int, beside: tuple, minimum: int) -> np.ndarray:
    """rings.grouped() of the modules of a lattice: their places in it, group by group."""
    cells = np.flatnonzero(np.frombuffer(held, dtype=bool)).tolist()
    if minimum <= 1:
        return np.array(cells, dtype=np.int64)
    free, groups = set(cells), []
    for c in cells:
        if c in free:
            free.discard(c)
            group = [c]
            for q in group:
                for a, b in beside:
                    if 0 <= q % nx + a < nx and (k := q + a + b * nx) in free:
                        free.discard(k)
                        group.append(k)
            groups.append(group)
    kept = sorted((g for g in groups if len(g) >= minimum), key=lambda g: (-len(g), g[0]))
    return np.array([c for g in kept for c in g], dtype=np.int64)


@lru_cache(maxsize=64)
def _beside(w: float, h: float, dx: float, dy: float, gap: float) -> tuple:
    """Steps to the modules of a lattice that are gap + .05 m apart at most, by rows."""
    reach = gap + 0.05 + EPS
    columns, rows = (int((reach + side) / step) + 1 for side, step in ((w, dx), (h, dy)))
    near = lambda a, b: math.hypot(max(0.0, abs(a) * dx - w), max(0.0, abs(b) * dy - h)) <= reach
    return tuple((a, b) for b in range(-rows, rows + 1) for a in range(-columns, columns + 1) if (a or b) and near(a, b))


def pack(roof: Polygons, holes: Polygons, of: np.ndarray, margin: np.ndarray, kind: np.ndarray, angle: np.ndarray, flat: np.ndarray, eligible: np.ndarray, settings: Settings) -> list[dict | None]:
    """What roofs._packed() tells of each roof; None of those that have no inner outline by corners.

    holes are polygons of the roofs ``of``, in their order, each with a margin and a kind; ``angle`` turns a lattice.
    """
    n = len(roof)
    have = np.bincount(of, minlength=n)
    first = np.cumsum(have) - have
    sides = np.bincount(of, weights=holes.count, minlength=n).astype(np.int64) + roof.count
    extent = roof.box[:, 2:] - roof.box[:, :2]
    # roofs with as many sides and candidates are taken together, with so many numbers for each
    size = np.where(roof.count > 0, (64 + 16 * np.maximum(extent, 0).prod(axis=1)).astype(np.int64) + 64 * sides, 1)
    out: list[dict | None] = [None] * n
    for at in parts(size):
        which, no = spread(have[at])
        mine = first[at][which] + no
        for p, found in zip(at.tolist(), _pack(roof.take(at), holes.take(mine), which, no, margin[mine], kind[mine], angle[at], flat[at], eligible[at], settings), strict=True):
            out[p] = found
    return out


def _pack(roof: Polygons, holes: Polygons, of: np.ndarray, slot: np.ndarray, margin: np.ndarray, kind: np.ndarray, angle: np.ndarray, flat: np.ndarray, eligible: np.ndarray, settings: Settings) -> list[dict | None]:
    n, panel, edge = len(roof), settings.panel, settings.edge_margin_m * settings.factor
    counts = _accounts(roof, holes, of, slot, kind)
    c, s = np.cos(np.radians(-angle)), np.sin(np.radians(-angle))
    turned = lambda shape, who: shape.moved(lambda x, y, which: _turn(x, y, c[who][which], s[who][which]))
    everyone = np.arange(n)
    roof, holes = turned(roof, everyone), turned(holes, of)
    own, others = _bands(roof, np.full(len(roof.sides), edge), np.zeros(len(roof.sides), dtype=bool)), _bands(holes, np.repeat(margin, holes.count), np.ones(len(holes.sides), dtype=bool))
    sides, bands = roof.padded(), roof.padded(own)
    hole_sides, hole_bands = holes.padded(), holes.padded(others)
    # all bands of a roof side by side, for its corners
    who = np.concatenate([np.repeat(everyone, roof.count), np.repeat(of, holes.count)])
    order = np.argsort(who, kind="stable")
    number = np.bincount(who, minlength=n)
    row, no = spread(number)
    every = np.full((n, int(number.max(initial=0)), 6), np.nan)
    every[row, no] = np.concatenate([own, others])[order]
    box, few = _box(roof, sides, every, edge)
    few &= roof.count > 0
    known = (roof.count > 0) & ~few
    box[~known] = 0.0
    slots = [np.flatnonzero(slot == k) for k in range(int(slot.max(initial=-1)) + 1)]
    fraction, best, ways = np.array(FRACTIONS), np.zeros((n, 2, 4, 4), dtype=np.int64), []
    for o, (w, length) in enumerate(((panel.width, panel.height), (panel.height, panel.width))):
        h, gap = np.full(n, length), np.full(n, panel.gap)
        h[flat] = length * math.cos(math.radians(panel.flat_tilt_deg))
        gap[flat] = rings.row_gap(length, panel.flat_tilt_deg, panel.design_sun_deg) if panel.row_gap_m is None else panel.row_gap_m
        dx, dy = w + panel.gap, h + gap
        nx = np.maximum(0, np.floor((box[:, 2, None] - box[:, 0, None] - fraction * dx - w + EPS) / dx).astype(np.int64) + 1)
        ny = np.maximum(0, np.floor((box[:, 3, None] - box[:, 1, None] - fraction * dy[:, None] - h[:, None] + EPS) / dy[:, None]).astype(np.int64) + 1)
        nx[~known], ny[~known] = 0, 0
        if (nx.sum(axis=1) * ny.sum(axis=1)).max(initial=0) > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidate modules on one face")
        lines, j = spread(ny.ravel())
        p, fy = lines // 4, lines % 4
        y = box[p, 1] + fraction[fy] * dy[p] + h[p] / 2 + dy[p] * j
        i = np.arange(int(nx.max(initial=0)))
        places = (box[:, 0, None] + fraction * dx + w / 2)[:, :, None] + dx * i  # roof, offset, column
        x = places.reshape(n, -1)[p]
        free = np.zeros(x.shape, dtype=bool)
        meets = crossings(sides[p], y)
        for k in range(meets.shape[1]):
            free ^= x < meets[:, k, None]
        _keep_off(free, np.arange(len(p)), x, bands[p], y, np.full(len(p), w), h[p])
        for here in slots:
            place = np.full(n, -1)
            place[of[here]] = here
            some = np.flatnonzero(place[p] >= 0)
            q, xs = place[p[some]], x[some]
            hit, meets = np.zeros(xs.shape, dtype=bool), crossings(hole_sides[q], y[some])
            for k in range(meets.shape[1]):
                hit ^= xs < meets[:, k, None]
            free[some] &= ~hit
            _keep_off(free, some, xs, hole_bands[q], y[some], np.full(len(some), w), h[p[some]])
        free = free.reshape(len(p), 4, len(i)) & (i < nx[p][:, :, None])
        if len(i):
            np.add.at(best, (p, o, fy), free.sum(axis=2))
        ways.append((w, h, dx, dy, nx, ny, places, box[:, 1], free, np.cumsum(ny.ravel()) - ny.ravel()))
    best = best.reshape(n, 32)
    chosen = best.argmax(axis=1)
    most = best[everyone, chosen]
    recommended = settings.layout_policy == "recommended"
    nothing, out = np.zeros((0, 4, 2)), []
    for q in range(n):
        if few[q]:
            out.append(None)
            continue
        area, pv, obstacle = (v * 0.1 * 0.1 for v in counts[q].tolist())
        made = {"panels": nothing, "physical": int(most[q]), "orientation": None, "factor": settings.factor, "area": area, "screened": area, "pv": 0.0, "obstacle": 0.0, "shaded": 0.0}
        if most[q]:
            made["orientation"] = ("portrait", "landscape")[chosen[q] // 16]
        if eligible[q]:
            made |= {"screened": 0.0, "pv": pv, "obstacle": obstacle}
        if most[q] and (eligible[q] or not recommended):
            w, h, dx, dy, nx, ny, places, low, free, start = ways[chosen[q] // 16]
            fy, fx = chosen[q] % 16 // 4, chosen[q] % 4
            height, columns = float(h[q]), int(nx[q, fx])
            held = free[start[4 * q + fy] : start[4 * q + fy] + ny[q, fy], fx, :columns]
            place = _order(held.tobytes(), columns, _beside(w, height, dx, float(dy[q]), panel.gap), settings.minimum_array_panels if recommended else 1)
            cx, cy = places[q, fx][place % columns], low[q] + FRACTIONS[fy] * dy[q] + height / 2 + dy[q] * (place // columns)
            x, y = np.add.outer(cx, np.array([-w, w, w, -w]) / 2), np.add.outer(cy, np.array([-height, -height, height, height]) / 2)
            made["panels"] = np.stack(_turn(x, y, c[q], -s[q]), axis=2)
        out.append(made)
    return out


def _keep_off(free: np.ndarray, rows: np.ndarray, x: np.ndarray, bands: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> None:
    """Takes the modules at x of some rows that reach into bands."""
    low, high = _stretches(bands, y, w, h)
    hit = np.zeros(x.shape, dtype=bool)
    for k in range(low.shape[1]):
        hit |= (x > low[:, k, None]) & (x < high[:, k, None])
    free[rows] &= ~hit


def _accounts(roof: Polygons, holes: Polygons, of: np.ndarray, slot: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Cells of .1 m of each roof less what is taken, those of plants and those of other objects, by stretches of a row of cells."""
    step, n = 0.1, len(roof)
    some = roof.count > 0
    box = np.where(some[:, None], roof.bounds(), 0.0)
    nx, ny = (np.where(some, np.maximum(1, np.ceil((box[:, i + 2] - box[:, i]) / step - EPS)), 0).astype(np.int64) for i in (0, 1))
    out = np.zeros((n, 3), dtype=np.int64)
    p, j = spread(ny)
    y = box[p, 1] + step * (j + 0.5)
    cells = lambda sides, rows: columns_below(box[p[rows], 0], step, nx[p[rows]], crossings(sides, y[rows]))
    rows = np.arange(len(p))
    ends = [cells(roof.padded()[p], rows)]
    sides, kinds, number = holes.padded(), [], np.bincount(of, minlength=n)
    plain = np.flatnonzero(number[p] == 0)  # without holes stretches follow from the ends alone
    k = np.sort(ends[0][plain], axis=1)
    np.add.at(out[:, 0], p[plain], (k * np.where((k.shape[1] - np.arange(k.shape[1])) % 2 == 1, 1, -1)).sum(axis=1))
    rows = np.flatnonzero(number[p] > 0)
    ends = [ends[0][rows]]
    for o in range(int(slot.max(initial=-1)) + 1):
        place = np.full(n, -1)
        here = np.flatnonzero(slot == o)
        place[of[here]] = here
        q = place[p[rows]]
        found = np.zeros((len(rows), sides.shape[1]), dtype=np.int64)
        found[q >= 0] = cells(sides[q[q >= 0]], rows[q >= 0])
        ends.append(found)
        kinds.append(np.where(q >= 0, kind[q], -1)[:, None])
    if len(rows):
        start = np.sort(np.concatenate([np.zeros((len(rows), 1), dtype=np.int64), *ends], axis=1), axis=1)
        length = np.diff(start, axis=1)
        start = start[:, :-1]

        def held(e: np.ndarray) -> np.ndarray:
            inside = np.zeros(start.shape, dtype=bool)
            for k in range(e.shape[1]):
                inside ^= e[:, k, None] > start
            return inside

        own, plant, other = held(ends[0]), np.zeros(start.shape, dtype=bool), np.zeros(start.shape, dtype=bool)
        for e, what in zip(ends[1:], kinds, strict=True):
            hit = held(e)
            own &= ~(hit & (what == TAKEN))
            plant |= hit & (what == PLANT)
            other |= hit & (what == OBSTACLE)
        for i, what in enumerate((own, own & plant, own & other & ~plant)):
            np.add.at(out[:, i], p[rows], (length * what).sum(axis=1))
    return out
