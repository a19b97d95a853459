"""N-gram Jaccard join by signature trees.

A document is the set of its distinct shingles of K words. Documents of one set are one class; a class takes part by
its smallest document. Shingles have one order for all sets: rare ones first, as far as a table of fixed size tells,
then by hash. Of a set of n shingles any set that it is linked with holds percent * n / 100 at least, so both hold one
of the first n - ceil(percent * n / 100) + 1 of either: these are the keys by which classes meet, and no link is lost.
The order decides how many classes meet, never which links are found.

1. Each class is compared with the class that leads most where they share a key (the one whose keys most others have,
   as the original of many copies does), and then with the leads of its other keys, unless links join them already.
   This only sets the order of work: it joins up groups of near copies of any size with a few comparisons for each
   member, so that the trees need not walk through pairs inside such a group.
2. Where a key spans several components, its classes are put in signature trees. Nodes hold the OR of token bitmaps,
   the range of set sizes and the component, if there is but one. Pairs of nodes are walked down together and left
   where sizes, components or the largest overlap that the bitmaps allow rule a link out. What remains is compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunspan.llm._arrow import discard, release, slices, stored, sweep
from sunspan.llm._graph import components
from sunspan.llm._words import Words, mix, sequence_hashes

#: Classes of one key that a tree holds; more are dealt over trees for pairs of blocks.
BLOCK = 4096
FANOUT = 8
#: Slots of the table that tells frequent shingles: a byte each, whatever the input.
SLOT_BITS = 20
#: A slot counts as frequent from so many times the average, and from so many documents of a task and of all.
FREQUENT, LEAST_IN_TASK, LEAST_IN_ALL = 4, 8, 64


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; with fewer words than k, the whole sequence is one."""
    w = Words([t.encode("utf-8", "surrogatepass") for t in texts], lower=True)
    grams = sequence_hashes(w.hashes, k)
    out = []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(sequence_hashes(w.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """Token bitmap of four to eight bits for each shingle; a power of two of bits, 64 at least."""
    width = max(64, 1 << int(4 * len(s)).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_keys(s: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, one of which every set that it is linked with has among its own first ones."""
    n = len(s) + percent * len(s) // -100 + 1 if len(s) else 0
    rank = ranks[slots(s)]
    return (s[np.lexsort((s, rank))[:n]] if rank.any() else s[:n]).view(np.int64)


def _sketches(k: int):
    """A row for each text, and then rows (slot, n) of the slots that many sets of the task have; slot -1 has their sum."""
    names = ("id", "version", "n", "same", "bits", "slot")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())

    def made(**columns: list) -> pa.RecordBatch:
        size = len(columns["n"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for b in slices(batches):
            sets = shingle_sets([x or "" for x in b.column("text").to_pylist()], k)
            table += np.bincount(slots(np.concatenate(sets)), minlength=len(table))
            sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)), len(s)) for s in sets]
            same = [b"".join(x.to_bytes(8, "little") for x in y) for y in sums]
            yield made(id=b.column("id"), version=b.column("version"), n=[len(s) for s in sets], same=same, bits=[bitmap(s) for s in sets])
            del b, sets
        total = int(table.sum())
        high = np.flatnonzero(table >= max(LEAST_IN_TASK, FREQUENT * total / len(table)))
        yield made(slot=[-1, *high.tolist()], n=[total, *table[high].tolist()])
        release()

    return run


def _ranks(sketches: DataFrame) -> bytes:
    """For each slot how frequent its shingles are: 0, or 1 and more with each doubling. A row per slot is collected at most."""
    counted = sketches.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.where(f"slot < 0 or n >= {LEAST_IN_ALL}").toArrow()
    slot, n = found["slot"].to_numpy(), found["n"].to_numpy()
    least = max(LEAST_IN_ALL, FREQUENT * int(n[slot < 0].sum()) / (1 << SLOT_BITS))
    hot = (slot >= 0) & (n >= least)
    ranks = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    ranks[slot[hot]] = 1 + np.log2(n[hot] / least).astype(np.uint8)
    return zlib.compress(ranks.tobytes())


def _keys(k: int, percent: int, packed: bytes):
    """Texts to a row for each of their keys; a key of a frequent slot is dealt over so many deals as its rank tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        for b in slices(batches):
            keys = [prefix_keys(s, ranks, percent) for s in shingle_sets([x or "" for x in b.column("text").to_pylist()], k)]
            ids = np.repeat(b.column("id").to_numpy(), [len(x) for x in keys])
            keys = np.concatenate(keys)
            rank = ranks[slots(keys.view(np.uint64))].astype(np.uint64)
            deal = np.where(rank > 0, 1 + (mix(ids.view(np.uint64)) & ((np.uint64(1) << np.minimum(rank, np.uint64(30))) - np.uint64(1))), 0).astype(np.int32)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_pydict({"key": keys[part], "deal": deal[part], "id": ids[part]})
            del b, keys, ids
        release()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and deal to those whose key another row has; keys of frequent slots (deal above 0) all stay."""
    last = None  # the row before, and whether it is yet to come
    for b in batches:
        key, deal, ids = (b.column(c).to_numpy() for c in ("key", "deal", "id"))
        if not len(key):
            continue
        same = np.append(last is not None and last[0] == key[0], key[1:] == key[:-1])
        keep = same | (deal > 0)
        keep[:-1] |= same[1:]
        if last is not None and same[0] and last[2]:
            yield pa.RecordBatch.from_pydict({"key": key[:1], "id": np.array([last[1]])})
        yield pa.RecordBatch.from_pydict({"key": key[keep], "id": ids[keep]})
        last = (key[-1], ids[-1], not keep[-1])


def _linked(k: int, percent: int):
    """Pairs of texts to pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a, c = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            texts = list(dict.fromkeys(a + c))
            sets = dict(zip(texts, shingle_sets([t or "" for t in texts], k), strict=True))
            keep = []
            for x, y in zip(a, c, strict=True):
                s, t = sets[x], sets[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            del b, a, c, texts, sets
        release()

    return run


class SignatureForest:
    """A tree over bitmaps for each segment of rows, all in the same arrays.

    levels[0] are the sets, in the order of their segments; each further level has FANOUT nodes of the one before to a
    node, and the last level a node for each segment. A level holds bitmaps, least and largest sizes, the most
    shingles that a bitmap does not tell apart, the component (-1 for several) and the range of nodes below.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray, segments: np.ndarray):
        places = np.arange(len(sizes))
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), groups, places, places + 1)]
        while len(segments) and (segments[1:] == segments[:-1]).any():
            bits, low, high, extra, group, _, _ = self.levels[-1]
            first = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
            inner = np.arange(len(segments)) - np.repeat(first, np.diff(np.append(first, len(segments))))
            cut = np.flatnonzero(inner % FANOUT == 0)
            most = np.maximum.reduceat(group, cut)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, cut, axis=0),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(extra, cut),
                    np.where(np.minimum.reduceat(group, cut) == most, most, -1),
                    cut,
                    np.append(cut[1:], len(segments)),
                )
            )
            segments = segments[cut]
        self.roots = segments

    def pairs(self, other: SignatureForest, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of sets that may be linked, by a walk down from pairs (x, y) of roots; with itself each pair once."""
        for level in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            mine, theirs = (t.levels[min(level, len(t.levels) - 1)] for t in (self, other))
            kept = [self._possible(mine, theirs, x[i : i + 65536], y[i : i + 65536], percent) for i in range(0, len(x), 65536)]
            keep = np.concatenate(kept) if kept else np.empty(0, dtype=bool)
            if self is other:
                keep &= (x < y) if level == 0 else (x <= y)
            x, y = x[keep], y[keep]
            if level:
                x, y = self._down(x, y, mine if level < len(self.levels) else None, theirs if level < len(other.levels) else None)
        return x, y

    @staticmethod
    def _down(x: np.ndarray, y: np.ndarray, mine: tuple | None, theirs: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the nodes below; a tree without a level there stays where it is."""
        for level, first in ((mine, True), (theirs, False)):
            if level is None:
                continue
            node = x if first else y
            n = level[6][node] - level[5][node]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            below = np.repeat(level[5][node], n) + inner
            x, y = (below, np.repeat(y, n)) if first else (np.repeat(x, n), below)
        return x, y

    @staticmethod
    def _possible(mine: tuple, theirs: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        possible = (100 * mine[2][x] >= percent * theirs[1][y]) & (100 * theirs[2][y] >= percent * mine[1][x])
        possible &= (mine[4][x] != theirs[4][y]) | (mine[4][x] < 0)
        at = np.flatnonzero(possible)
        bits_a, low_a, high_a, extra_a = (v[x[at]] for v in mine[:4])
        bits_b, low_b, high_b, extra_b = (v[y[at]] for v in theirs[:4])
        most = np.minimum(np.minimum(high_a, high_b), np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64) + np.minimum(extra_a, extra_b))
        possible[at] = (100 + percent) * most >= percent * (low_a + low_b)
        return possible


def _folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps at a width in bytes: bits that are equal modulo it fall together."""
    out = np.zeros((len(bitmaps), width), dtype=np.uint8)
    for i, x in enumerate(bitmaps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def tree_pairs(tree: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], components: np.ndarray, blocks: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of ids (a < b), as rows, that may be linked: of one tree, and there of one block or of two different.

    Sizes of linked sets differ by a factor of 2 at most, so their bitmaps have one width or one that is twice the
    other; there is a tree for each width (and block).
    """
    order = np.lexsort((ids, sizes, components, blocks, tree))
    tree, ids, sizes, components, blocks = (v[order] for v in (tree, ids, sizes, components, blocks))
    bits = [bits[i] for i in order.tolist()]
    widths = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    edge = np.append(True, (tree[1:] != tree[:-1]) | (blocks[1:] != blocks[:-1]))
    segment = np.cumsum(edge) - 1
    of_tree, of_block = tree[edge], blocks[edge]  # a segment's tree and block; a tree has one or two
    begins = np.append(True, of_tree[1:] != of_tree[:-1])
    first = np.flatnonzero(begins)
    second = np.append(first[1:], len(of_tree)) - 1
    two = first != second
    apart = np.repeat(two, np.diff(np.append(first, len(of_tree))))

    def forest(width: int, folded: int) -> tuple[np.ndarray, SignatureForest]:
        at = np.flatnonzero(widths == width)
        return at, SignatureForest(_folded([bits[i] for i in at.tolist()], folded), sizes[at], components[at], segment[at])

    def roots(one: SignatureForest, other: SignatureForest, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of roots for pairs of segments, where both forests have them."""
        x, y = np.searchsorted(one.roots, left), np.searchsorted(other.roots, right)
        there = (x < len(one.roots)) & (y < len(other.roots))
        x, y, left, right = x[there], y[there], left[there], right[there]
        there = (one.roots[x] == left) & (other.roots[y] == right)
        return x[there], y[there]

    every = np.arange(len(of_tree))
    out = []
    for width in np.unique(widths).tolist():
        at, own = forest(width, width)
        found = [own.pairs(own, *roots(own, own, every[~apart], every[~apart]), percent)]
        twin = forest(width, width)[1] if two.any() else own
        found.append(own.pairs(twin, *roots(own, twin, first[two], second[two]), percent))
        out += [(at[x], at[y]) for x, y in found]
        if 2 * width in widths:
            theirs, wider = forest(2 * width, width)
            for left, right in ((every[~apart], every[~apart]), (first[two], second[two]), (second[two], first[two])):
                x, y = own.pairs(wider, *roots(own, wider, left, right), percent)
                out.append((at[x], theirs[y]))
    x, y = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 2
    return np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1), axis=0)


#: Rows of trees that are walked at once; a larger tree is walked alone.
TOGETHER = 20_000


def _candidates(percent: int):
    """Rows sorted by key, left and right block to pairs that trees cannot rule out."""

    def solve(parts: list[dict]) -> pa.RecordBatch:
        key, one, two, ids, n, component, block = (np.concatenate([p[c] for p in parts]) for c in ("key", "one", "two", "id", "n", "component", "block"))
        tree = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        pairs = tree_pairs(tree, ids, n, [x for p in parts for x in p["bits"]], component, block, percent)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for b in batches:
            part = {c: b.column(c).to_numpy() for c in ("key", "one", "two", "id", "n", "component", "block")} | {"bits": b.column("bits").to_pylist()}
            if rows + b.num_rows > TOGETHER:  # up to where the last tree of the batch begins
                new = np.flatnonzero(np.append(_differs(waiting[-1], part) if waiting else True, (np.diff(part["key"]) != 0) | (np.diff(part["one"]) != 0) | (np.diff(part["two"]) != 0)))
                if len(new) and (waiting or new[-1]):
                    waiting.append({c: v[: new[-1]] for c, v in part.items()})
                    yield solve(waiting)
                    waiting, rows, part = [], 0, {c: v[new[-1] :] for c, v in part.items()}
            if len(part["key"]):
                waiting.append(part)
                rows += len(part["key"])
        if waiting:
            yield solve(waiting)
        release()

    return run


def _differs(before: dict, after: dict) -> bool:
    """Whether the first row of ``after`` is of another tree than the last of ``before``."""
    return any(before[c][-1] != after[c][0] for c in ("key", "one", "two"))


def _possible(percent: int):
    """Pairs with sizes and bitmaps of both sides to those that these do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = [b.column(f"n_{x}").to_numpy() for x in "ab"]
            bits = [b.column(f"bits_{x}").to_pylist() for x in "ab"]
            widths = np.array([[len(x) for x in side] for side in bits]).min(axis=0)
            keep = np.zeros(b.num_rows, dtype=bool)
            for width in np.unique(widths).tolist():  # both sides at the width of the narrower one
                at = np.flatnonzero(widths == width)
                one, two = (_folded([side[i] for i in at], width) for side in bits)
                left, right = n[0][at], n[1][at]
                extra = [size - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for size, x in ((left, one), (right, two))]
                most = np.minimum(np.minimum(left, right), np.bitwise_count(one & two).sum(axis=1, dtype=np.int64) + np.minimum(*extra))
                keep[at] = (100 + percent) * most >= percent * (left + right)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _pairs(lead: str, rows: DataFrame) -> DataFrame:
    """(a, b) with a < b of each row's id and its lead."""
    other = -F.col(f"{lead}.minus")
    return rows.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose documents are linked."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_linked(k, percent), "a long, b long")


def _led(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that sizes and bitmaps do not rule out."""
    for x in "ab":
        pairs = pairs.join(sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    pairs = pairs.where(f"100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a")
    return pairs.mapInArrow(_possible(percent), "a long, b long")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles, class_id and component_id of each document.

    Two documents are linked when 100 * intersection >= percent * union of their sets; percent is from 50 to
    100, so that their sizes differ by a factor of 2 at most. class_id is the smallest document with the same set,
    component_id the smallest that links reach, itself included.
    A-Z are lower-cased, other letters are not. A text that is null, empty or has no words is an empty set: it is
    linked with nothing and a class of its own. Equal sets are linked (similarity 1), so ties go to the smallest id.
    Repeated rows of one id count once if they have one text; of several texts that with the greatest set digest
    counts. Very long texts have as many keys as their sets ask for. Rows without an id are left out. Other columns
    are not read; an empty table stays empty. Links are decided on 64-bit hashes of shingles.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    texts = texts.withColumn("version", F.xxhash64("text"))
    sketches = stored(texts.mapInArrow(_sketches(k), "id long, version long, n long, same binary, bits binary, slot long"), "sketches")
    first_sketches = sketches
    packed, sketches = _ranks(sketches), sketches.where("slot is null").drop("slot")
    sets = sketches.groupBy("id").agg(F.max(F.struct("same", "n", "version")).alias("s")).select("id", "s.same", "s.n", "s.version")
    classes = stored(sketches.where("n > 0").groupBy("same").agg(F.min("id").alias("class_id")), "classes")
    # an empty set has no class to be looked up, and a key of its own so that they do not meet in one task
    sets = sets.withColumn("same", F.when(F.col("n") > 0, F.col("same")).otherwise(F.col("id").cast("string").cast("binary")))
    owned = stored(sets.join(classes, "same", "left").select("id", "n", "version", F.coalesce("class_id", "id").alias("class_id")), "owned")
    heads = owned.where("id = class_id and n > 0").select("id", "version")
    # repeated rows: a group of the columns by which they were joined asks for no other shuffle
    texts = stored(texts.join(heads, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.first("text").alias("text")).select("id", "text"), "texts")
    sketches = stored(sketches.join(heads, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).drop("version"), "heads")
    discard(first_sketches, classes)

    met = texts.mapInArrow(_keys(k, percent, packed), "key long, deal int, id long").repartition("key", "deal").sortWithinPartitions("key", "deal")
    keys = stored(met.mapInArrow(_shared, "key long, id long"), "keys")
    sweep(df.sparkSession)
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    met = stored(keys.join(shared, "key"), "met")
    discard(keys, shared)
    # a class that many others are copies of has the keys that most of them kept: it leads where it takes part
    weight = stored(met.groupBy("id").agg(F.sum("members").alias("weight")), "weight")
    weighed = stored(met.select("key", "id").join(weight, "id").select("key", "id", F.struct("weight", (-F.col("id")).alias("minus")).alias("rank")), "weighed")
    leads = stored(weighed.groupBy("key").agg(F.max("rank").alias("lead")), "leads")
    led = weighed.join(leads, "key").where(F.col("id") != -F.col("lead.minus")).select("id", "lead").distinct()
    led = stored(led, "led")
    discard(weight, weighed, leads)
    sweep(df.sparkSession)
    first = stored(_pairs("lead", led.groupBy("id").agg(F.max("lead").alias("lead"))).distinct(), "first")
    once_near = stored(_verified(_led(first, sketches, percent), texts, k, percent).distinct(), "near")
    joined = components(once_near)
    # once more with the leads of all keys that still span several components, a pair for each member at most
    sweep(df.sparkSession)
    other = joined.withColumnsRenamed({"id": "b", "component": "theirs"})
    again = _pairs("lead", led).distinct()
    again = again.join(joined.withColumnsRenamed({"id": "a", "component": "mine"}), "a", "left").join(other, "b", "left")
    again = again.where(F.coalesce("mine", "a") != F.coalesce("theirs", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    near = stored(once_near.unionByName(_verified(_led(again, sketches, percent), texts, k, percent)).distinct(), "near")
    discard(led, first, once_near, joined)
    joined = components(near)

    sweep(df.sparkSession)
    placed = met.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "placed")
    discard(met, joined)
    spans = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("digest"),
    ).where("low < high")
    once = spans.groupBy("members", "digest").agg(F.min("key").alias("key"))  # keys of the same classes need one tree
    once = stored(once.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "trees")
    members = placed.join(once, "key").join(sketches.select("id", "n", "bits"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "n", "bits", "component", "block")
    members = members.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    rest = stored(members.mapInArrow(_candidates(percent), "a long, b long").distinct(), "rest")
    discard(placed, once)
    sweep(df.sparkSession)
    whole = components(near.unionByName(_verified(rest, texts, k, percent)))
    discard(near, rest, texts, sketches)
    ids = owned.join(whole.withColumnRenamed("id", "class_id"), "class_id", "left")
    return ids.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
