"""Embedding near-dedup by NN-descent.

Equal vectors are one class. A first neighbour graph comes from random-hyperplane trees: each vector keeps the LIST best
of the leaves that it is in. NN-descent then refines it: the neighbours of a vector, and those that have it as a
neighbour, are compared with each other wherever one of them is new, and each keeps the best that it meets, until
hardly any new link comes in. Edges below the threshold are dropped, the rest is checked in double precision.

A list that is not full of links holds all links of its vector. One that is full is saturated and is enlarged to its
whole group: vectors that links connect, with a saturated one among them, are a group; NN-descent looks for links that
lead out of groups, which join them, until there are none; then the vectors of a group are compared with each other by
pairs of blocks, and their links are counted, not listed. Recall is audited against brute force for vectors that have links; while it is too low
the lists get longer and the trees more, and if that does not raise it, the run fails.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunspan.llm._arrow import release, slices, stored
from sunspan.llm._graph import components

LOG = logging.getLogger(__name__)
#: Neighbours that a vector keeps at first, and those that have it as a neighbour that take part in a comparison.
LIST, MEET = 10, 10
#: Rounds of NN-descent at most, and the share of new links among those listed that asks for another round.
ROUNDS, CHANGE = 10, 0.001
#: Vectors of a leaf, on average, and at most of those that are compared for the first graph.
LEAF, CHUNK = 256, 1024
#: Chance that a pair right at the threshold shares no leaf of the first graph.
MISS = 0.05
#: Vectors of a group that are compared at once; a larger group is dealt over pairs of blocks of about so many.
BLOCK = 2048
#: Vectors that the audit asks first and at most, the links that it looks for, and the recall of these that it demands.
AUDIT, MOST_ASKED, ENOUGH, RECALL = 256, 4096, 256, 0.995
#: Times that lists are made longer for a low recall.
TRIES = 2
#: By how much single precision may lack of the threshold; what it lets through is checked in double precision.
ROUGH = 1e-5
SIGNATURE = 30
ENTRY = np.dtype([("id", "<i8"), ("cos", "<f4"), ("fresh", "u1")])


def _clean(x: list | None) -> np.ndarray | None:
    """A vector as float64; None if it is null or zero or has null or non-finite components."""
    if not x or any(v is None for v in x):
        return None
    v = np.array(x, dtype=np.float64) + 0.0
    return v if np.isfinite(v).all() and v.any() else None


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=8)
def _planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(17).normal(size=(dim, trees * bits))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a tree, and trees: a pair at the threshold is on one side of a plane with chance 1 - angle / pi."""
    side = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = min(SIGNATURE, max(0, math.ceil(math.log2(max(1, n) / LEAF)))) if side > 0.5 and n > CHUNK else 0
    together = side**bits
    return bits, 1 if together >= 1 else math.ceil(math.log(MISS) / math.log1p(-together))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        vectors = [None if i is None else _clean(x) for i, x in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True)]
        raw = [None if v is None else v.tobytes() for v in vectors]
        same = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], names=["id", "same", "vec"])


def _signed(bits: int, trees: int):
    """Rows (id, part, vec) with the vector's size, its leaf in each tree and the vector in single precision."""
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, part, raw = (b.column(c).to_pylist() for c in ("id", "part", "vec"))
            for size in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == size]
                unit = _unit([raw[i] for i in at])
                above = (unit @ _planes(size // 8, trees, bits) > 0).reshape(len(at), trees, bits)
                leaves = (above * weights).sum(axis=2).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([ids[i] for i in at], pa.int64()),
                        "part": pa.array([part[i] for i in at], pa.int64()),
                        "unit": pa.array([x.tobytes() for x in unit.astype("<f4")], pa.binary()),
                        "size": pa.array([size] * len(at), pa.int32()),
                        "leaves": pa.array(leaves.tolist(), pa.list_(pa.int32())),
                    }
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows of one key in sorted rows."""
    last, rows = None, []
    for b in batches:
        for k, row in zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), zip(*(b.column(c).to_pylist() for c in rest), strict=True), strict=True):
            if k != last and rows:
                yield rows
                rows = []
            last = k
            rows.append(row)
    if rows:
        yield rows


def _best(ids: np.ndarray, cos: np.ndarray, most: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """The ``most`` best of entries, each id once; of equal cosines the lesser id, of equal ids the older entry."""
    out = np.empty(len(ids), dtype=ENTRY)
    out["id"], out["cos"], out["fresh"] = ids, cos, 1 if fresh is None else fresh
    out = out[np.lexsort((out["fresh"], out["id"]))]
    out = out[np.append(True, out["id"][1:] != out["id"][:-1])] if len(out) else out
    return out[np.lexsort((out["id"], -out["cos"]))[:most]]


def _rows(ids: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "list": pa.array([x.tobytes() for x in lists], pa.binary())})


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1)


def _leaves(most: int):
    """Chunks of leaves to the best neighbours of each vector there, of other parts than its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("tree", "size", "leaf", "chunk"), ("id", "part", "unit")):
            if len(rows) < 2:
                continue
            ids, part = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
            x = _matrix([r[2] for r in rows])
            cos = x @ x.T
            cos[part[:, None] == part[None, :]] = -2
            k = min(most, len(rows) - 1)
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            lists = [_best(ids[t], c, most) for t, c in ((t[c[t] > -2], c[t[c[t] > -2]]) for t, c in zip(top, cos, strict=True))]
            yield _rows(ids.tolist(), lists)
        release()

    return run


def _merged(most: int, least: float):
    """Rows (id, lists, old) to the best of the lists, how many of these reach ``least``, and how many of those are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists, near, new_ones = [], [], []
            for found, old in zip(b.column("lists").to_pylist(), b.column("old").to_pylist(), strict=True):
                known = np.frombuffer(old or b"", dtype=ENTRY)
                new = np.frombuffer(b"".join(found or []), dtype=ENTRY)
                fresh = np.append(np.zeros(len(known), dtype=np.uint8), np.ones(len(new), dtype=np.uint8))
                lists.append(_best(np.append(known["id"], new["id"]), np.append(known["cos"], new["cos"]), most, fresh))
                near.append(int((lists[-1]["cos"] >= least).sum()))
                new_ones.append(int(lists[-1]["fresh"][: near[-1]].sum()))
            worst = [float(x["cos"][-1]) if len(x) == most else -2.0 for x in lists]
            yield pa.RecordBatch.from_pydict(
                {"id": b.column("id"), "list": pa.array([x.tobytes() for x in lists], pa.binary()), "worst": pa.array(worst, pa.float32()), "near": pa.array(near, pa.int64()), "new": pa.array(new_ones, pa.int64())}
            )

    return run


MERGED = "id long, list binary, worst float, near long, new long"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, list) to rows (hub, member, fresh, back): each neighbour, and each vector that has the hub as neighbour."""
    for b in slices(batches):
        lists = [np.frombuffer(x, dtype=ENTRY) for x in b.column("list").to_pylist()]
        if not (n := [len(x) for x in lists]) or not sum(n):
            continue
        own, every = np.repeat(b.column("id").to_numpy(), n), np.concatenate(lists)
        fresh = np.tile(every["fresh"].astype(bool), 2)
        hub, member = np.append(own, every["id"]), np.append(every["id"], own)
        back = np.repeat([False, True], len(own))
        for at in range(0, len(hub), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_pydict({"hub": hub[part], "member": member[part], "fresh": fresh[part], "back": back[part]})


def _meet(most: int):
    """Members of hubs to what each of them meets there that is better than the worst of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lists = [], []
        for rows in _groups(batches, ("hub",), ("member", "fresh", "part", "worst", "unit")):
            rows = list({r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values())
            fresh = np.array([r[1] for r in rows])
            if len(rows) < 2 or not fresh.any():
                continue
            ids, part = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 2))
            x = _matrix([r[4] for r in rows])
            cos = x @ x.T
            better = (cos > np.array([r[3] for r in rows], dtype=np.float32)[:, None]) & (part[:, None] != part[None, :]) & (fresh[:, None] | fresh[None, :])
            for i in np.flatnonzero(better.any(axis=1)).tolist():
                at = np.flatnonzero(better[i])
                made.append(int(ids[i]))
                lists.append(_best(ids[at], cos[i][at], most))
            if len(made) > 5000:
                yield _rows(made, lists)
                made, lists = [], []
        yield _rows(made, lists)
        release()

    return run


def _checked(threshold: float):
    """Pairs (a, b) with both vectors to those that are linked in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = (b.column(f"vec_{c}").to_pylist() for c in "ab")
            keep = np.zeros(len(x), dtype=bool)
            for size in {len(v) for v in x}:
                at = [i for i, v in enumerate(x) if len(v) == size]
                keep[at] = np.einsum("ij,ij->i", _unit([x[i] for i in at]), _unit([y[i] for i in at])) >= threshold
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def descend(vectors: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that NN-descent finds between vectors (id, part, vec) of different parts, and the saturated ids.

    a holds b in its list; an id is saturated if its list is full of links.
    """
    bits, trees = shape(vectors.count(), threshold)
    signed = stored(vectors.mapInArrow(_signed(bits, trees * most // LIST if bits else 1), "id long, part long, unit binary, size int, leaves array<int>"), "signed")
    placed = signed.select("id", "part", "unit", "size", F.posexplode("leaves").alias("tree", "leaf"))
    counted = placed.groupBy("tree", "size", "leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = placed.join(counted.where("chunks > 1"), ["tree", "size", "leaf"], "left")
    key = ("tree", "size", "leaf", "chunk")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id", "tree"), F.coalesce("chunks", F.lit(1)))).select(*key, "id", "part", "unit")
    found = placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_leaves(most), "id long, list binary")
    state = found.groupBy("id").agg(F.collect_list("list").alias("lists")).withColumn("old", F.lit(None).cast("binary"))
    state = stored(state.mapInArrow(_merged(most, threshold - ROUGH), MERGED), "lists")
    nodes = signed.select(F.col("id").alias("member"), "part", "unit")
    for turn in range(ROUNDS):
        near, new = state.agg(F.sum("near"), F.sum("new")).first() if turn else (0, 1)  # one round whatever the graph
        if not new or new <= CHANGE * near:
            break
        edges = state.select("id", "list").mapInArrow(_edges, "hub long, member long, fresh boolean, back boolean")
        first = Window.partitionBy("hub", "back").orderBy(F.col("fresh").desc(), F.xxhash64("hub", "member"))
        edges = edges.withColumn("place", F.row_number().over(first)).where(f"place <= {max(most, MEET)}").select("hub", "member", "fresh")
        rows = edges.join(nodes.join(state.select(F.col("id").alias("member"), "worst"), "member"), "member").select("hub", "member", "fresh", "part", "worst", "unit")
        found = rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(_meet(most), "id long, list binary")
        met = found.groupBy("id").agg(F.collect_list("list").alias("lists"))
        state = state.select("id", F.col("list").alias("old")).join(met, "id", "left").select("id", "lists", "old")
        state = stored(state.mapInArrow(_merged(most, threshold - ROUGH), MERGED), "lists")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = [x[x["cos"] >= threshold - ROUGH] for x in (np.frombuffer(v, dtype=ENTRY) for v in b.column("list").to_pylist())]
            if lists:
                yield pa.RecordBatch.from_pydict({"a": np.repeat(b.column("id").to_numpy(), [len(x) for x in lists]), "b": np.concatenate(lists)["id"].astype(np.int64)})

    links = state.select("id", "list").mapInArrow(listed, "a long, b long")
    for c in "ab":
        links = links.join(vectors.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}")), c)
    links = stored(links.select("a", "b", "vec_a", "vec_b").mapInArrow(_checked(threshold), "a long, b long"), "edges")
    return links, links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {most}").select("id")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (root := root[root])).any():
            pass


def _compare(threshold: float):
    """Blocks of groups to rows (id, near, around, root) of the vectors with links there.

    near counts the links and around the copies at their other ends; root is the block's vector that stands for those
    linked there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("part", "low", "high"), ("id", "copies", "vec", "low", "high", "chunk")):
            if len(rows) < 2:
                continue
            x, (low, high) = _unit([r[2] for r in rows]), rows[0][3:5]
            if low == high:
                a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                left = np.array([r[5] == low for r in rows])
                left, right = np.flatnonzero(left), np.flatnonzero(~left)
                a, b = np.nonzero(x[left] @ x[right].T >= threshold)
                a, b = left[a], right[b]
            if not len(a):
                continue
            ids, copies = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
            near = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
            around = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            at = np.flatnonzero(near)
            root = ids[_roots(len(rows), a, b)]
            yield pa.RecordBatch.from_pydict(
                {"id": ids[at], "near": near[at].astype(np.int64), "around": around[at].astype(np.int64), "root": root[at]}
            )
        release()

    return run


def _within(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, near, around, root) of the links between all vectors (id, copies, vec) of one part."""
    large = members.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    placed = members.join(large, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(29)), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    key = ("part", "low", "high")
    placed = placed.select(*key, "chunk", "id", "copies", "vec").repartition(*key).sortWithinPartitions(*key)
    return placed.mapInArrow(_compare(threshold), "id long, near long, around long, root long")


def _audit(queries: list[tuple[int, bytes]], threshold: float):
    """Rows (id, vec) to the numbers of vectors that each of ``queries`` is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, raw = b.column("id").to_pylist(), b.column("vec").to_pylist()
            for size in {len(r) for r in raw}:
                mine = [(i, r) for i, r in zip(ids, raw, strict=True) if len(r) == size]
                asked = [(i, r) for i, r in queries if len(r) == size]
                if asked:
                    near = _unit([r for _, r in asked]) @ _unit([r for _, r in mine]).T >= threshold
                    near &= np.array([i for i, _ in asked])[:, None] != np.array([i for i, _ in mine])[None, :]
                    yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in asked], pa.int64()), "n": near.sum(axis=1).astype(np.int64)})

    return run


def _truth(classes: DataFrame, threshold: float, among: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The ids that the audit asks, and their links by brute force: four times as many ids while these are too few.

    Asked are vectors of all classes, or of those with an id in ``among``; MOST_ASKED bounds what is fetched.
    """
    spark, vectors, n = classes.sparkSession, classes.select("id", "vec"), AUDIT
    chosen = vectors if among is None else stored(vectors.join(among, "id", "left_semi"), "asked")
    while True:
        asked = [(r.id, bytes(r.vec)) for r in chosen.orderBy(F.xxhash64("id"), "id").limit(n).collect()]
        wanted = vectors.mapInArrow(_audit(asked, threshold), "id long, n long").agg(F.sum("n")).first()[0] or 0
        if wanted >= ENOUGH or len(asked) < n or n >= MOST_ASKED:
            return spark.createDataFrame([(i,) for i, _ in asked], "id long"), wanted
        n *= 4


def _found(classes: DataFrame, threshold: float, most: int) -> DataFrame:
    """Rows (id, near, around, root) of the links of classes (id, copies, vec) that lists of ``most`` entries lead to."""
    links, full = descend(classes.select("id", F.col("id").alias("part"), "vec"), threshold, most)
    full = stored(full, "saturated")
    while True:  # groups with a saturated vector, and links that lead out of them
        reach = components(links).withColumnRenamed("component", "part")
        dense = reach.join(full, "id", "left_semi").select("part").distinct()
        group = stored(reach.join(dense, "part", "left_semi").join(classes, "id").select("id", "part", "copies", "vec"), "groups")
        more = descend(group.select("id", "part", "vec"), threshold, most)[0]
        if not more.limit(1).count():
            break
        links = stored(links.unionByName(more), "edges")
    # the lists of other groups hold all their links
    loose = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(group.select(F.col("id").alias("a")), "a", "left_anti")
    loose = stored(loose, "loose")
    ends = loose.unionByName(loose.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(classes.select(F.col("id").alias("b"), "copies"), "b")
    ends = ends.select(F.col("a").alias("id"), F.lit(1).cast("long").alias("near"), F.col("copies").alias("around"), F.least("a", "b").alias("root"))
    return stored(ends.unionByName(_within(group, threshold)), "found")


def neighbours(classes: DataFrame, threshold: float) -> tuple[DataFrame, float | None]:
    """Rows (id, near, around, root) of vectors (id, copies, vec as packed float64), and the audited recall.

    Where none of the vectors drawn has a link, those that were found to have some are asked, so recall is None only if
    no link was found and no vector drawn has one.

    near and around add up over a vector's rows to its links and to the copies at their ends; (id, root) reach what
    links reach.
    """
    asked, wanted = _truth(classes, threshold)
    for attempt in range(TRIES + 1):
        found = _found(classes, threshold, LIST << attempt)
        if not wanted:
            asked, wanted = _truth(classes, threshold, found.select("id").distinct())
        got = found.join(F.broadcast(asked), "id", "left_semi").agg(F.sum("near")).first()[0] or 0
        recall = got / wanted if wanted else None
        if recall is None or recall >= RECALL:
            return found, recall
    raise RuntimeError(f"recall of links is {recall:.4f} with lists of {LIST << TRIES}, below {RECALL}: {got} of {wanted} links of the audited vectors")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """id, n_links, component_id and kept for each row.

    Two vectors are linked when their cosine in double precision reaches the threshold. A vector that is null, empty
    or zero, or holds a null or non-finite component, is linked with nothing, as are vectors of different lengths
    with each other. Equal vectors are linked and take part once, with their number. Repeated rows, even of one id,
    are vectors of their own. component_id is the smallest id reachable, itself included, and kept says whether it is
    the row's own; for a null id both are null and it is linked with nothing. Other columns are not read; an empty
    table stays empty; the length of vectors is bounded by a task's memory only. Below the threshold nothing is linked;
    the share of links found is audited and logged, and a share below RECALL that longer lists do not mend raises an error.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    rows = stored(rows.mapInArrow(_prepare, "id long, same binary, vec binary"), "vectors")
    classes = stored(rows.where("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "copies")
    found, recall = neighbours(classes.select("id", "copies", "vec"), threshold)
    LOG.info("recall of links of the audited vectors: %s", "no links" if recall is None else f"{recall:.4f}")
    around = found.groupBy("id").agg(F.sum("around").alias("around"))
    reach = components(found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")))
    known = classes.select("same", "id", "copies").join(around, "id", "left").join(reach, "id", "left")
    known = known.select("same", (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "same").join(known, "same", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
