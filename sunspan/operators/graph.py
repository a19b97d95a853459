"""Graph operators: components by bounded rounds of joins, traversals with growing state by group."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.operators import batches
from sunspan.operators._shared import by_group, by_groups, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component, the least id that links reach; least labels spread by joins, with pointer jumps, until none changes."""
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to"))
    both = stored(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "links")
    labels = both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component"))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("theirs")), "to").groupBy("id").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = stored(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        labels = step.select("id", "component")
        if not step.where("was <> component").limit(1).count():
            return labels


def select_connected(faces: DataFrame, links: DataFrame, group: str = "building_id") -> DataFrame:
    """face_id, accepted and reason of every face of a group, grown from the clicked face (else the first).

    Faces are tried in input order (part_no), again and again until a pass adds none. A face whose identity differs
    from every known one is refused; one that is linked to an accepted face joins, and its identity becomes known.
    Groups are buildings: their faces fit one task.
    """
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    near = links.select(F.inline(ways))  # a union would make the links twice
    beside = near.groupBy("x").agg(F.sort_array(F.collect_set("y")).alias("beside")).withColumnRenamed("x", "face_id")
    rows = faces.select(group, "part_no", "face_id", "egid", "contains_click").join(beside, "face_id", "left").select(group, "part_no", "face_id", "egid", "contains_click", "beside")

    def grow(ids: list[str], egids: list, clicked: list, besides: list) -> list[str]:
        parts, egid = {i: p or () for i, p in zip(ids, besides, strict=True)}, {i: e or None for i, e in zip(ids, egids, strict=True)}
        anchor = next((i for i, c in zip(ids, clicked, strict=True) if c), ids[0])
        accepted, known, reason = {anchor}, {egid[anchor]} - {None}, {anchor: "anchor"}
        grown = True
        while grown:
            grown = False
            for i in ids:
                if i in accepted:
                    continue
                if egid[i] is not None and known and egid[i] not in known:
                    reason[i] = "other_identity"
                elif accepted.intersection(parts[i]):
                    accepted.add(i)
                    known |= {egid[i]} - {None}
                    reason[i], grown = "linked", True
                else:
                    reason[i] = "apart"
        return [reason[i] for i in ids]

    def run(t: pa.Table) -> pa.RecordBatch:
        number, egid, clicked = batches.groups(t, group), batches.numbers(t, "egid", 0), t.column("contains_click").fill_null(False).to_numpy()
        size = np.bincount(number)
        first = np.cumsum(size) - size
        anchor, there = first.copy(), np.flatnonzero(clicked)
        anchor[number[there[::-1]]] = there[::-1]  # the first that is clicked
        known = egid[anchor][number]
        reason = np.where((egid != 0) & (known != 0) & (egid != known), "other_identity", "apart").astype(object)
        reason[anchor] = "anchor"
        # groups with links, and those that repeat a face, are grown one by one
        names = t.column("face_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        pairs = np.sort(number * (len(number) + 1) + names + 1)
        again = pairs[1:][pairs[1:] == pairs[:-1]] // (len(number) + 1)
        linked = np.unique(np.concatenate([number[batches.lists(t.column("beside"))[0] > 0], again]))
        rows = np.flatnonzero(np.isin(number, linked))
        some = t.select(["face_id", "egid", "contains_click", "beside"]).take(rows)
        columns, at = [c.to_pylist() for c in some.columns], 0
        for n in size[linked].tolist():
            reason[rows[at : at + n]] = grow(*(c[at : at + n] for c in columns))
            at += n
        accepted = (reason == "anchor") | (reason == "linked")
        return pa.RecordBatch.from_arrays([t.column(group).combine_chunks(), t.column("face_id").combine_chunks(), pa.array(accepted.astype(bool)), pa.array(reason.tolist(), pa.string())], names=[group, "face_id", "accepted", "reason"])

    return by_groups(rows, group, ["part_no"], run, f"{group} long, face_id string, accepted boolean, reason string")


def _arrays(points: list[tuple], beside: dict[tuple, list], minimum: int) -> list[tuple]:
    """i, j, array_no and place of ``points`` (sorted) that are linked as ``beside`` says."""
    place = {p: n for n, p in enumerate(points)}
    seen, groups = set(), []
    for p in points:
        if p not in seen:
            seen.add(p)
            queue, group = deque([p]), []
            while queue:
                q = queue.popleft()
                group.append(q)
                for r in sorted(beside[q]):
                    if r not in seen:
                        seen.add(r)
                        queue.append(r)
            groups.append(group)
    kept = sorted((g for g in groups if minimum <= 1 or len(g) >= minimum), key=lambda g: (-len(g), place[g[0]]))
    return [(i, j, n, k) for n, g in enumerate(kept) for k, (i, j) in enumerate(g)]


@lru_cache(maxsize=1024)
def _lattice(n: int, m: int, hole: tuple[int, ...], minimum: int) -> np.ndarray:
    """The arrays of a lattice of n by m modules without those of a hole, where all that touch, at corners too, are linked."""
    points = [(i, j) for i in range(n) for j in range(m) if not (hole[0] <= i <= hole[1] and hole[2] <= j <= hole[3])]
    held = set(points)
    beside = {(i, j): [p for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) if p in held] for i, j in points}
    return np.array(_arrays(points, beside, minimum), dtype=np.int64).reshape(-1, 4)


def grouped_lattices(lattices: DataFrame, minimum: int = 4) -> DataFrame:
    """What grouped_panels() gives for faces (face_id, n, m, hole), a row for each, whose modules stand in one lattice.

    hole has the first and last column and the first and last row without modules. Modules are made and grouped where
    their face is, and faces of one lattice are grouped once; nothing is shuffled.
    """

    def made(face_ids: pa.Array, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
        faces = face_ids.take(pa.array(np.repeat(np.array(at, dtype=np.int64), [len(f) for f in found])))
        return pa.RecordBatch.from_arrays([faces, *(pa.array(c) for c in np.ascontiguousarray(rows.T))], names=["face_id", "i", "j", "array_no", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, size = [], [], 0
            for k, (n, m, hole) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "m", "hole")), strict=True)):
                at.append(k)
                found.append(_lattice(n, m, tuple(hole), minimum))
                size += len(found[-1])
                if size > 100_000:
                    yield made(b.column("face_id"), at, found)
                    at, found, size = [], [], 0
            yield made(b.column("face_id"), at, found)

    return lattices.select("face_id", "n", "m", "hole").mapInArrow(run, "face_id string, i long, j long, array_no long, place long")


def grouped_panels(panels: DataFrame, links: DataFrame, minimum: int = 4) -> DataFrame:
    """face_id, i, j, array_no and place of modules in arrays of ``minimum`` or more, largest array first, breadth first inside.

    Groups are faces: the modules of one fit one task.
    """
    nodes = panels.select("face_id", F.struct("i", "j").alias("p")).groupBy("face_id").agg(F.sort_array(F.collect_list("p")).alias("nodes"))
    pairs = links.groupBy("face_id").agg(F.collect_list(F.array("ai", "aj", "bi", "bj")).alias("pairs"))

    def order(rows: list[tuple]) -> list[tuple]:
        face, points, near = rows[0]
        points = [(p["i"], p["j"]) for p in points]
        beside: dict[tuple, list] = {p: [] for p in points}
        for ai, aj, bi, bj in near or []:
            beside[ai, aj].append((bi, bj))
            beside[bi, bj].append((ai, aj))
        return [(face, *r) for r in _arrays(points, beside, minimum)]

    rows = nodes.join(pairs, "face_id", "left").select("face_id", "nodes", "pairs")
    return by_group(rows, "face_id", [], order, "face_id string, i long, j long, array_no long, place long")


def walk_tree(nodes: DataFrame, root: int, depth: int = 24) -> DataFrame:
    """id and level of the nodes (id, parent, covers) that covered nodes reach from the root, at most ``depth`` levels down."""
    front = nodes.where((F.col("id") == root) & F.col("covers")).select("id", F.lit(0).alias("level"))
    found = front
    for level in range(1, depth + 1):
        front = stored(nodes.where("covers").join(front.select(F.col("id").alias("parent")), "parent").select("id", F.lit(level).alias("level")), "front")
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found


def expand_siblings(faces: DataFrame, seeds: DataFrame, rounds: int = 4) -> DataFrame:
    """building_id of the seeds and of all buildings that share an identity with them, grown for a few rounds."""
    known = stored(seeds.select("building_id").distinct(), "known")
    for _ in range(rounds):
        ids = faces.join(known, "building_id", "left_semi").where("egid is not null").select("egid").distinct()
        grown = stored(faces.join(ids, "egid", "left_semi").select("building_id").unionByName(known).distinct(), "known")
        if grown.count() == known.count():
            return grown
        known = grown
    return known
