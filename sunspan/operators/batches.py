"""Many polygons at once: sides of all of them in one array, lines of rows and cells that meet them, pairs that touch.

What rings.py tells of one polygon is told here of thousands by a few calls of numpy. Sides of a polygon follow each
other, ring by ring; those of several are padded with NaN, which no line meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa

from sunspan.operators import rings

EPS = rings.EPS
#: Numbers in an array of a step; larger batches are taken in parts.
AT_ONCE = 400_000


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with so many items each: the row and the number in it of every item."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def numbers(t: pa.Table, name: str, missing: float = 0.0) -> np.ndarray:
    return t.column(name).fill_null(missing).to_numpy()


def groups(t: pa.Table, name: str) -> np.ndarray:
    """Numbers of the groups of rows that follow each other."""
    known, value = t.column(name).is_valid().to_numpy(), numbers(t, name, 0)
    return np.cumsum(np.concatenate([[False], (value[1:] != value[:-1]) | (known[1:] != known[:-1])])[: len(value)])


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, and their items; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, column.flatten()


@dataclass
class Polygons:
    """Sides (ax, ay, bx, by) of polygons, how many each has, and for each side where the one before and after it is,
    how many sides its ring has and whether what is bounded lies on its left (1) or right (-1)."""

    sides: np.ndarray
    count: np.ndarray
    before: np.ndarray
    after: np.ndarray
    ring: np.ndarray
    left: np.ndarray
    box: np.ndarray
    middle: np.ndarray

    @staticmethod
    def of(size: np.ndarray, points: pa.Array) -> Polygons:
        """From the number of rings of each polygon and the rings, lists of points. Rings without area bound nothing."""
        length, flat = lists(points)
        width, values = lists(flat)
        at = np.cumsum(width) - width
        values = values.to_numpy(zero_copy_only=False)
        xy = np.column_stack([values[at], values[at + 1]]) if len(at) else np.zeros((0, 2))
        owner = np.repeat(np.arange(len(size)), size)
        box = np.tile([np.inf, np.inf, -np.inf, -np.inf], (len(size), 1))
        start = np.cumsum(length) - length
        shut = np.flatnonzero(length > 1)
        shut = shut[(xy[start[shut]] == xy[start[shut] + length[shut] - 1]).all(axis=1)]
        keep = np.ones(len(xy), dtype=bool)
        keep[start[shut] + length[shut] - 1] = False
        ring = np.repeat(np.arange(len(length)), length)[keep]
        xy = xy[keep]
        polygon = owner[ring]
        for i, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
            f.at(box[:, i], polygon, xy[:, i % 2])
        first = np.cumsum(size) - size
        lead = ring == first[polygon]
        n = np.bincount(polygon[lead], minlength=len(size))
        middle = np.column_stack([np.bincount(polygon[lead], weights=xy[lead, i], minlength=len(size)) / np.maximum(n, 1) for i in (0, 1)])
        while True:  # without repeated points
            size_of = np.bincount(ring, minlength=len(length))[ring]
            n = spread(np.bincount(ring, minlength=len(length)))[1]
            after, no = np.where(n == size_of - 1, 1 - size_of, 1), np.arange(len(ring))
            ok = np.hypot(*(xy[no + after] - xy).T) > EPS
            if ok.all():
                break
            ring, xy = ring[ok], xy[ok]
        q, r = xy - xy[no - n], xy[no + after] - xy[no - n]
        area = np.bincount(ring, weights=q[:, 0] * r[:, 1] - r[:, 0] * q[:, 1], minlength=len(length)) / 2
        ok = (size_of > 2) & (np.abs(area[ring]) > EPS)
        sides = np.hstack([xy, xy[no + after]])[ok]
        before = np.where(n == 0, size_of - 1, -1)
        polygon = owner[ring]
        left = np.sign(area)
        out = Polygons(sides, np.bincount(polygon[ok], minlength=len(size)), before[ok], after[ok], size_of[ok], left[ring][ok], box, middle)
        start = np.cumsum(out.count) - out.count
        for p in np.flatnonzero((size > 1) & (out.count > 0)).tolist():  # a ring inside an odd number of others bounds a hole
            here = slice(start[p], start[p] + out.count[p])
            shape, i = [], here.start
            while i < here.stop:
                shape.append(out.sides[i : i + out.ring[i], :2])
                i += out.ring[i]
            at = here.start
            for k, s in enumerate(shape):
                if sum(bool(rings.inside([t], s[:1])[0]) for j, t in enumerate(shape) if j != k) % 2:
                    out.left[at : at + len(s)] *= -1
                at += len(s)
        return out

    def __len__(self) -> int:
        return len(self.count)

    def take(self, at: np.ndarray) -> Polygons:
        count = self.count[at]
        which, no = spread(count)
        k = (np.cumsum(self.count) - self.count)[at][which] + no
        return Polygons(self.sides[k], count, self.before[k], self.after[k], self.ring[k], self.left[k], self.box[at], self.middle[at])

    @staticmethod
    def joined(some: list[Polygons]) -> Polygons:
        return Polygons(*(np.concatenate([getattr(p, f.name) for p in some]) for f in fields(Polygons)))

    def moved(self, to) -> Polygons:
        """With other coordinates: ``to`` has a function of x, y and the polygon of each point. Turns stay as they are."""
        which = np.repeat(np.arange(len(self)), self.count)
        x, y = to(self.sides[:, 0], self.sides[:, 1], which)
        ends = np.arange(len(which)) + self.after
        out = Polygons(np.column_stack([x, y, x[ends], y[ends]]), self.count, self.before, self.after, self.ring, self.left, self.box, self.middle)
        out.box = out.bounds()
        return out

    def bounds(self) -> np.ndarray:
        """Boxes of the sides; of no sides an empty one."""
        box = np.tile([np.inf, np.inf, -np.inf, -np.inf], (len(self), 1))
        some = np.flatnonzero(self.count)
        if len(some):
            at = (np.cumsum(self.count) - self.count)[some]
            for i, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum)):
                box[some, i] = f.reduceat(self.sides[:, i % 2], at)
        return box

    def area(self) -> np.ndarray:
        which, no = spread(self.count)
        base = self.sides[np.arange(len(which)) - no, :2]
        p, q = self.sides[:, :2] - base, self.sides[:, 2:] - base
        return np.bincount(which, weights=self.left * (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2, minlength=len(self))

    def lead(self) -> np.ndarray:
        """Corners of the first ring of each, and their middle, padded."""
        which, no = spread(self.count)
        first = self.ring[np.arange(len(which)) - no]
        out = self.padded(np.where((no < first)[:, None], self.sides[:, :2], np.nan))
        with np.errstate(invalid="ignore"):
            return np.concatenate([out, np.nanmean(out, axis=1, keepdims=True)], axis=1)

    def padded(self, values: np.ndarray | None = None) -> np.ndarray:
        """Sides, or values of them, with a row for each polygon."""
        values = self.sides if values is None else values
        which, no = spread(self.count)
        out = np.full((len(self), int(self.count.max(initial=0)), *values.shape[1:]), np.nan)
        out[which, no] = values
        return out

    def rings(self) -> list[list[np.ndarray]]:
        """Corners of the rings of each."""
        out, at = [], 0
        for n in self.count.tolist():
            end, shape = at + n, []
            while at < end:
                shape.append(self.sides[at : at + self.ring[at], :2])
                at += int(self.ring[at])
            out.append(shape)
        return out

    def bytes(self) -> list[bytes]:
        """What tells polygons apart: their corners, and the sizes of rings where there are several."""
        data, end = np.ascontiguousarray(self.sides[:, :2]).tobytes(), (np.cumsum(self.count) * 16).tolist()
        out = [data[a:b] for a, b in zip([0, *end], end, strict=False)]
        which, no = spread(self.count)
        for p in np.unique(which[self.ring != self.count[which]]).tolist():
            out[p] += self.ring[which == p].tobytes()
        return out


def parts(size: np.ndarray, most: int = AT_ONCE) -> Iterator[np.ndarray]:
    """Numbers of rows, those of a size together, so many that rows times the largest size are not more than ``most``."""
    order = np.argsort(size, kind="stable")
    ordered, at = size[order], 0
    while at < len(order):
        step = max(1, most // max(1, int(ordered[at])))
        end = min(len(order), at + step)
        while end > at + 1 and (end - at) * int(ordered[end - 1]) > most:
            end = at + max(1, (end - at) // 2)
        yield order[at:end]
        at = end


def crossings(sides: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the line at each height meets the sides of its row; -inf where it does not."""
    y = y[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        at = (sides[:, :, 2] - sides[:, :, 0]) * (y - sides[:, :, 1]) / (sides[:, :, 3] - sides[:, :, 1]) + sides[:, :, 0]
        return np.where((sides[:, :, 1] > y) != (sides[:, :, 3] > y), at, -np.inf)


def columns_below(x0: np.ndarray, step: float, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the n cells in a row from x0 have their centres below a place."""
    x0, n = x0[:, None], n[:, None]
    with np.errstate(invalid="ignore"):
        k = np.clip(np.ceil((np.where(np.isfinite(at), at, x0 - 9 * step) - x0) / step - 0.5), -1, n + 1)
        k -= x0 + step * (k - 1 + 0.5) >= at
        k += x0 + step * (k + 0.5) < at
    return np.clip(k, 0, n).astype(np.int64)


def apart(a: np.ndarray, b: np.ndarray, by: float = 1e-6) -> np.ndarray:
    """rings.apart() of rows of boxes."""
    return (a[:, 0] > b[:, 2] + by) | (b[:, 0] > a[:, 2] + by) | (a[:, 1] > b[:, 3] + by) | (b[:, 1] > a[:, 3] + by)


def contains(sides: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points of a row lie inside the polygon of the row."""
    out = np.zeros(x.shape, dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(sides.shape[1]):
            ax, ay, bx, by = (sides[:, k, i, None] for i in range(4))
            out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1.0, by - ay) + ax)
    return out


def touch(a: Polygons, b: Polygons) -> np.ndarray:
    """rings.touch() of rows of polygons."""
    out = np.zeros(len(a), dtype=bool)
    p, q = a.box, b.box
    near = np.flatnonzero(~((p[:, 0] >= q[:, 2]) | (q[:, 0] >= p[:, 2]) | (p[:, 1] >= q[:, 3]) | (q[:, 1] >= p[:, 3])) & (a.count > 0) & (b.count > 0))
    for part in parts(a.count[near] * b.count[near]):
        at = near[part]
        one, two = a.take(at), b.take(at)
        e, f = one.padded(), two.padded()
        hit = np.zeros(len(at), dtype=bool)
        for shape, other in ((e, two), (f, one)):
            points = other.lead()
            hit |= contains(shape, points[:, :, 0], points[:, :, 1]).any(axis=1)
        e, f = e[:, :, None, :], f[:, None, :, :]
        side = lambda o, x, y: (o[..., 2] - o[..., 0]) * (y - o[..., 1]) - (o[..., 3] - o[..., 1]) * (x - o[..., 0])
        with np.errstate(invalid="ignore"):
            cross = (side(e, f[..., 0], f[..., 1]) * side(e, f[..., 2], f[..., 3]) < -EPS) & (side(f, e[..., 0], e[..., 1]) * side(f, e[..., 2], e[..., 3]) < -EPS)
        out[at] = hit | cross.any(axis=(1, 2))
    return out


def pairs(group: np.ndarray, box: np.ndarray, by: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows of a group, which follow each other, whose boxes are not farther apart than ``by`` on either axis."""
    end = np.searchsorted(group, group, side="right")
    one, two = [], []
    for d in range(1, int(np.bincount(group).max(initial=0)) if len(group) else 0):
        i = np.flatnonzero(np.arange(len(group)) + d < end)
        i = i[~apart(box[i], box[i + d], by)]
        one.append(i)
        two.append(i + d)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (one, two))
    order = np.lexsort((j, i))
    return i[order], j[order]


def stretches(shapes: Polygons, row: np.ndarray, which: np.ndarray, x0: np.ndarray, n: np.ndarray, y: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and first cells and ends of the stretches of cells that polygons ``which`` cover in ``row``: n cells from x0, at a height y."""
    out = []
    for part in parts(shapes.count[which]):
        some, at = np.unique(which[part], return_inverse=True)
        ends = np.sort(columns_below(x0[part], step, n[part], crossings(shapes.take(some).padded()[at], y[part])), axis=1)
        for k in range(ends.shape[1] - 1, 0, -2):  # a cell lies inside where an odd number of sides is on its right
            here = np.flatnonzero(ends[:, k] > ends[:, k - 1])
            out.append((row[part[here]], ends[here, k - 1], ends[here, k]))
        if ends.shape[1] % 2:
            here = np.flatnonzero(ends[:, 0] > 0)
            out.append((row[part[here]], 0 * ends[here, 0], ends[here, 0]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))


def covered(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that stretches cover, once where several do: rows and how many more cells each stretch has than those before."""
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    width = int(high.max(initial=0)) + 1
    reached = np.maximum.accumulate(row * width + high) - row * width
    before = np.concatenate([[0], np.where(row[1:] == row[:-1], reached[:-1], 0)])[: len(row)]
    return row, np.maximum(0, high - np.maximum(low, before))


def _cells(low: np.ndarray, high: np.ndarray, step: float) -> np.ndarray:
    return np.maximum(1, np.ceil((high - low) / step - EPS)).astype(np.int64)


def shared_area(a: Polygons, b: Polygons, step: float = 0.1) -> np.ndarray:
    """rings.overlap_area() of rows of polygons."""
    out = np.zeros(len(a))
    low, high = np.maximum(a.box[:, :2], b.box[:, :2]), np.minimum(a.box[:, 2:], b.box[:, 2:])
    some = np.flatnonzero((low < high).all(axis=1))
    ny = _cells(low[some, 1], high[some, 1], step)
    for part in parts(ny):
        at, rows = some[part], ny[part]
        pair, j = spread(rows)
        p = at[pair]
        nx = _cells(low[at, 0], high[at, 0], step)[pair]
        y, row = low[p, 1] + step * (j + 0.5), np.arange(len(p))
        one, two = (stretches(s, row, p, low[p, 0], nx, y, step) for s in (a, b))
        both = covered(*(np.concatenate(x) for x in zip(one, two, strict=True)))
        cells = sum(np.bincount(pair[r], weights=h - g, minlength=len(at)) for r, g, h in (one, two)) - np.bincount(pair[both[0]], weights=both[1], minlength=len(at))
        out[at] = cells * step * step
    return out


def union_area(group: np.ndarray, shapes: Polygons, step: float = 0.05) -> np.ndarray:
    """rings.union_area() of the polygons of each group, whose numbers follow each other from 0."""
    i, j = pairs(group, shapes.box)
    met = np.zeros(int(group.max(initial=-1)) + 1, dtype=bool)
    met[group[i[touch(shapes.take(i), shapes.take(j))]]] = True
    total = np.bincount(group, weights=shapes.area(), minlength=len(met))
    first, size = np.searchsorted(group, np.arange(len(met))), np.bincount(group, minlength=len(met))
    some = np.flatnonzero(met)
    if not len(some):
        return total
    box = np.column_stack([f.reduceat(shapes.box[:, k], first) for k, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))])[some]
    whole = np.floor((box[:, 3] - box[:, 1]) / 2 + EPS).astype(np.int64)  # stripes of 2 m are counted each on its own
    per, rest = round(2 / step), box[:, 3] - (box[:, 1] + 2 * whole)
    ny = whole * per + np.where(rest > 0, np.ceil(rest / step - EPS), 0).astype(np.int64)
    for part in parts(ny * size[some]):
        groups, rows = some[part], ny[part]
        owner, no = spread(size[groups])
        shape = first[groups][owner] + no
        # a polygon is asked in the rows that its box meets only
        start = np.clip(np.floor((shapes.box[shape, 1] - box[part][owner, 1]) / step).astype(np.int64) - 1, 0, None) if len(shape) else shape
        end = np.minimum(rows[owner], np.ceil((shapes.box[shape, 3] - box[part][owner, 1]) / step).astype(np.int64) + 1)
        item, k = spread(np.maximum(0, end - start))
        k, who = k + start[item], owner[item]
        y = box[part][who, 1] + 2.0 * (k // per) + step * (k % per + 0.5)
        n = _cells(box[part][:, 0], box[part][:, 2], step)[who]
        base = np.cumsum(rows) - rows
        row, more = covered(*stretches(shapes, base[who] + k, shape[item], box[part][who, 0], n, y, step))
        total[groups] = np.bincount(np.searchsorted(base, row, side="right") - 1, weights=more, minlength=len(groups)) * step * step
    return total


def point_distance(sides: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of the points of each row from the nearest side of the row's polygon."""
    out = np.full(x.shape, np.inf)
    with np.errstate(invalid="ignore"):
        for k in range(sides.shape[1]):
            ax, ay, bx, by = (sides[:, k, i, None] for i in range(4))
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.maximum(dx * dx + dy * dy, EPS * EPS), 0, 1)
            out = np.fmin(out, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return out


def near(a: Polygons, b: Polygons, by: float) -> np.ndarray:
    """Which rows of polygons touch or lie ``by`` apart at most."""
    out = np.zeros(len(a), dtype=bool)
    gap = np.maximum(0.0, np.maximum(a.box[:, :2] - b.box[:, 2:], b.box[:, :2] - a.box[:, 2:])) if len(a) else np.zeros((0, 2))
    some = np.flatnonzero((np.hypot(gap[:, 0], gap[:, 1]) <= by) & (a.count > 0) & (b.count > 0))
    out[some] = touch(a.take(some), b.take(some))
    some = some[~out[some]]
    for part in parts(a.count[some] * b.count[some]):
        at = some[part]
        e, f = a.take(at).padded(), b.take(at).padded()
        with np.errstate(invalid="ignore"):
            out[at] = np.fmin(np.nanmin(np.where(np.isnan(f[:, :, 0]), np.inf, point_distance(e, f[:, :, 0], f[:, :, 1])), axis=1), np.nanmin(np.where(np.isnan(e[:, :, 0]), np.inf, point_distance(f, e[:, :, 0], e[:, :, 1])), axis=1)) <= by
    return out


def shared_edge(a: Polygons, b: Polygons, reach: float = 0.35, step: float = 0.02) -> np.ndarray:
    """Length of the first one's outline, by points ``step`` apart, within ``reach`` of the second one."""
    out = np.zeros(len(a))
    length = np.hypot(a.sides[:, 2] - a.sides[:, 0], a.sides[:, 3] - a.sides[:, 1])
    number = np.maximum(1, np.ceil(length / step)).astype(np.int64)
    pair = np.repeat(np.arange(len(a)), a.count)
    box = b.box[pair] + np.array([-1, -1, 1, 1]) * (reach + 0.01)
    low, high = np.zeros(len(pair)), np.ones(len(pair))
    for i in (0, 1):  # the part of each side that is in reach of the other's box
        p, d = a.sides[:, i], a.sides[:, i + 2] - a.sides[:, i]
        with np.errstate(invalid="ignore", divide="ignore"):
            one, two = (box[:, i] - p) / d, (box[:, i + 2] - p) / d
        none = np.abs(d) < 1e-12
        inside = (p >= box[:, i]) & (p <= box[:, i + 2])
        low = np.maximum(low, np.where(none, np.where(inside, 0.0, 2.0), np.fmin(one, two)))
        high = np.minimum(high, np.where(none, np.where(inside, 1.0, -1.0), np.fmax(one, two)))
    start = np.clip(np.floor(low * number - 1.5), 0, number).astype(np.int64)
    end = np.clip(np.ceil(high * number + 1.5), 0, number).astype(np.int64)
    size = np.where(low <= high + 1e-9, np.maximum(0, end - start), 0)
    for part in parts(size * np.maximum(1, b.count[pair])):
        side, k = spread(size[part])
        side = part[side]
        t = (k + start[side] + 0.5) / number[side]
        x, y = (a.sides[side, i] + t * (a.sides[side, i + 2] - a.sides[side, i]) for i in (0, 1))
        here = np.flatnonzero((x >= box[side, 0]) & (y >= box[side, 1]) & (x <= box[side, 2]) & (y <= box[side, 3]))
        side, x, y = side[here], x[here, None], y[here, None]
        some, at = np.unique(pair[side], return_inverse=True)
        sides = b.take(some).padded()[at]
        hit = ((point_distance(sides, x, y) <= reach + EPS) | contains(sides, x, y))[:, 0]
        out += np.bincount(pair[side[hit]], weights=(length / number)[side[hit]], minlength=len(a))
    return out
