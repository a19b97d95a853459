"""Substring dedup by super-k-mer partitioning.

A window is K consecutive words of a document; its minimiser is the least hash of M consecutive words in it.
Consecutive windows with one minimiser travel as one packed string (their words, once) to the minimiser's bucket. There
all windows are sorted, equal neighbours are compared byte by byte, and each window learns the smallest document that
holds it. Strings that several documents of one batch share are sent once, for the smallest of them: all windows of
the others are repeats whatever the bucket says. Minimisers that a passage in very many documents makes hot are found
in a first pass that counts minimisers; their windows travel one by one, dealt by their own hash.

A bucket is small, whatever the input: a partition holds many, sorted, and treats one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import release, slices
from sunspan.llm._words import Words, mix, sequence_hashes, sliding_min, word_hashes

#: Bytes of text whose strings are packed together.
BATCH_BYTES = 4 << 20
#: Words of the input for each bucket, and for each partition of buckets as long as these are not very many.
BUCKET_WORDS, PARTITION_WORDS, MOST_PARTITIONS = 800_000, 20_000_000, 20_000
#: A minimiser is hot when more than this part of a partition's fair share of runs, and more than LEAST_HOT runs, have it.
HOT_SHARE, LEAST_HOT = 0.02, 64
#: Minimisers that a task counts at once.
COUNTED = 1 << 22
#: Blocks of fewer bytes are left to the codec of the shuffle.
COMPRESSED = 2048


class Batch:
    """Windows of a batch of documents and their runs of one minimiser."""

    def __init__(self, ids: list[int], texts: list[str], k: int, m: int):
        self.words = w = Words([t.encode("utf-8", "surrogatepass") for t in texts])
        self.ids = np.array(ids, dtype=np.int64)
        n = len(w.hashes) - k + 1
        if n <= 0:
            self.at = self.least = np.empty(0, dtype=np.int64)
            return
        whole = w.doc[:n] == w.doc[k - 1 :]
        self.at = np.flatnonzero(whole)  # windows by their first word
        self.least = sliding_min(sequence_hashes(w.hashes, m), k - m + 1)[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run, as indexes into ``at``."""
        n = len(self.at)
        if not n:
            return self.at, self.at
        new = np.ones(n, dtype=bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, n))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")


def hot_minimisers(rows: DataFrame, k: int, m: int, partitions: int) -> tuple[np.ndarray, int]:
    """The hot minimisers, ascending, and the number of words. Every run of every document is counted.

    A task tells the minimisers that have half the share of its own runs which makes one hot, so what it leaves out of
    a hot one is less than half of it: no hot one is missed. Both what a task tells and what is hot in the end are
    bounded by the number of partitions.
    """
    share = HOT_SHARE / partitions

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting = 0, []
        known, times = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

        def fold() -> None:
            nonlocal known, times, waiting
            some, n = np.unique(np.concatenate(waiting or [np.empty(0, dtype=np.uint64)]), return_counts=True)
            both, place = np.unique(np.concatenate([known, some]), return_inverse=True)
            known, times, waiting = both, np.bincount(place, np.concatenate([times, n]), len(both)).astype(np.int64), []

        for b in slices(batches, BATCH_BYTES):
            batch = Batch(b.column("id").to_pylist(), b.column("text").to_pylist(), k, m)
            words += len(batch.words.hashes)
            waiting.append(batch.least[batch.runs()[0]].astype(np.uint64))
            if sum(map(len, waiting)) > COUNTED:
                fold()
        fold()
        total = int(times.sum())
        high = np.flatnonzero(times >= max(2, share / 2 * total))
        yield pa.RecordBatch.from_pydict(
            {
                "minimiser": pa.array(np.concatenate([np.zeros(2, dtype=np.uint64), known[high]]).view(np.int64)),
                "kind": pa.array([0, 1] + [2] * len(high), pa.int32()),
                "n": pa.array([words, total, *times[high].tolist()], pa.int64()),
            }
        )

    counted = rows.mapInArrow(count, "minimiser long, kind int, n long").groupBy("kind", "minimiser").agg(F.sum("n").alias("n")).where(f"kind < 2 or n >= {LEAST_HOT}").toArrow()
    kind, n, minimiser = (counted[c].to_numpy() for c in ("kind", "n", "minimiser"))
    hot = (kind == 2) & (n >= max(LEAST_HOT, share / 2 * int(n[kind == 1].sum())))
    return np.sort(minimiser[hot].view(np.uint64)), int(n[kind == 0].sum())


def _pack(parts: dict[str, bytes]) -> bytes:
    """The parts in a row, behind a byte that says whether they are compressed."""
    head = b"".join(len(parts[x]).to_bytes(8, "little") for x in ("ids", "positions", "counts", "strings"))
    data = head + parts["ids"] + parts["positions"] + parts["counts"] + parts["strings"]
    return b"\0" + data if len(data) < COMPRESSED else b"\1" + zstandard.ZstdCompressor(level=3).compress(data)


def _plain(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block[1:]) if block[0] else block[1:]


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = _plain(block)
    sizes, at = [int.from_bytes(data[i : i + 8], "little") for i in (0, 8, 16, 24)], 32
    parts = []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    return np.frombuffer(parts[0], dtype=np.int64), np.frombuffer(parts[1], dtype=np.int32), np.frombuffer(parts[2], dtype=np.int32), parts[3]


def _groups(batches: Iterator[pa.RecordBatch], key: str, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of one key in sorted rows: the key and the values of a column."""
    last, values = None, []
    for b in batches:
        for k, v in zip(b.column(key).to_pylist(), b.column(column).to_pylist(), strict=True):
            if k != last and values:
                yield last, values
                values = []
            last = k
            values.append(v)
    if values:
        yield last, values


def _target(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers a document's runs."""
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(hot: bytes, buckets: int, k: int, m: int):
    """Batches of documents to blocks of packed strings, one for each bucket, and of runs that are known to repeat.

    The latter have the bucket -1 - b, where b is the one that gathers their documents' runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.frombuffer(hot, dtype=np.uint64)
        for b in slices(batches, BATCH_BYTES):
            batch = Batch(b.column("id").to_pylist(), b.column("text").to_pylist(), k, m)
            if not len(batch.at):
                continue
            w = batch.words
            first, count = batch.runs()
            least = batch.least[first]
            single = listed[np.minimum(np.searchsorted(listed, least), len(listed) - 1)] == least if len(listed) else np.zeros(len(first), dtype=bool)
            alone = np.flatnonzero(np.repeat(single, count))
            windows = sequence_hashes(w.hashes, k)[batch.at[alone]] if len(alone) else np.empty(0, dtype=np.uint64)
            key = np.concatenate([batch.least[first[~single]], windows])
            first, count = np.concatenate([first[~single], alone]), np.concatenate([count[~single], np.ones(len(alone), dtype=np.int64)])
            word = batch.at[first]
            begin, end = w.starts[word].tolist(), w.ends[word + count + k - 2].tolist()
            data = w.data.tobytes()
            doc, position = batch.ids[w.doc[word]], (word - w.first[w.doc[word]]).astype(np.int32)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            # the smallest document first among equal strings, so that it stands for them
            order = np.lexsort((position, doc))
            seen: dict[bytes, int] = {}
            strings, owner, places, repeats = [], [], [], []
            docs, positions, counts = doc.tolist(), position.tolist(), count.tolist()
            for i in order.tolist():
                s = data[begin[i] : end[i]]
                j = seen.setdefault(s, len(strings))
                if j == len(strings):
                    strings.append(s)
                    owner.append(i)
                    places.append([positions[i]])
                elif docs[i] == docs[owner[j]]:
                    places[j].append(positions[i])
                else:
                    repeats.append(i)
            owners = np.array(owner, dtype=np.int64)
            target = bucket[owners]
            by = np.argsort(target, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(target[by]) != 0)) if len(by) else by
            out_bucket, out_block = [], []
            for begins, ends in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):  # buckets that the batch has
                chosen = by[begins:ends].tolist()
                mine = [places[j] for j in chosen]
                out_bucket.append(int(target[chosen[0]]))
                out_block.append(
                    _pack(
                        {
                            "ids": doc[owners[chosen]].tobytes(),
                            "positions": np.array([p for x in mine for p in x], dtype=np.int32).tobytes(),
                            "counts": np.array([len(x) for x in mine], dtype=np.int32).tobytes(),
                            "strings": b"\n".join(strings[j] for j in chosen),
                        }
                    )
                )
            if repeats:
                r = np.array(repeats, dtype=np.int64)
                to = _target(doc[r], buckets)
                r, to = r[np.argsort(to, kind="stable")], np.sort(to, kind="stable")
                for c in np.split(r, np.flatnonzero(np.diff(to)) + 1):
                    out_bucket.append(-1 - int(_target(doc[c[:1]], buckets)[0]))
                    out_block.append(_pack({"ids": doc[c].tobytes(), "positions": position[c].tobytes(), "counts": count[c].astype(np.int32).tobytes(), "strings": b""}))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out_bucket, pa.int64()), "block": pa.array(out_block, pa.binary())})

    return run


def _by_target(ids: np.ndarray, positions: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of windows as one packed row for each bucket that gathers a document's runs."""
    target = _target(ids, buckets)
    order = np.lexsort((positions, ids, target))
    target, rows = target[order], np.stack([ids, positions.astype(np.int64), counts.astype(np.int64)], axis=1)[order]
    cut = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(ids) else np.empty(0, dtype=np.int64)
    ends = np.append(cut[1:], len(target))
    packed = [rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    packed = [b"\0" + x if len(x) < COMPRESSED else b"\1" + zstandard.ZstdCompressor(level=1).compress(x) for x in packed]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(target[cut], pa.int64()), "packed": pa.array(packed, pa.binary())})


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs, sorted by bucket, to one row for each document."""
    for _, packed in _groups(batches, "bucket", "packed"):
        every = np.concatenate([np.frombuffer(_plain(x), dtype=np.int64).reshape(-1, 3) for x in packed])
        every = every[np.argsort(every[:, 0], kind="stable")]
        ids, pairs = every[:, 0], every[:, 1:].astype("<i4")
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends = np.append(cut[1:], len(ids))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[cut], pa.int64()), "runs": pa.array([pairs[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())})


def smallest_documents(strings: bytes, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of newline-separated strings: its string, its place in it, and the smallest id among equal windows."""
    data = np.frombuffer(strings + b"\n", dtype=np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.append(0, ends[:-1] + 1)
    last = data[ends] == 10
    string = np.cumsum(last) - last
    hashes = word_hashes(data, starts, ends)
    n = len(hashes) - k + 1
    at = np.flatnonzero(string[:n] == string[k - 1 :])
    key = sequence_hashes(hashes, k)[at]
    del hashes
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    owner = ids[string[at]]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.empty(0, dtype=np.int64)
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(key) else group
    # equal hashes: the words themselves are compared with those of the group's first window
    head = cut[group] if len(key) else group
    b, e = starts[at], ends[at + k - 1]
    check = np.flatnonzero(head != np.arange(len(head)))
    h = head[check]
    differs = [i for i, x, y, p, q in zip(check.tolist(), b[check].tolist(), e[check].tolist(), b[h].tolist(), e[h].tolist(), strict=True) if strings[x:y] != strings[p:q]]
    least = np.minimum.reduceat(owner, cut) if len(cut) else owner
    found = least[group] if len(key) else owner
    for g in {int(group[i]) for i in differs}:  # windows of one hash that are not equal
        members = np.flatnonzero(group == g)
        best: dict[bytes, int] = {}
        for i in members.tolist():
            w = strings[b[i] : e[i]]
            best[w] = min(best.get(w, int(owner[i])), int(owner[i]))
        for i in members.tolist():
            found[i] = best[strings[b[i] : e[i]]]
    first_word = np.flatnonzero(np.append(True, last[:-1]))
    return string[at], at - first_word[string[at]], found


def _bucket_runs(blocks: list[bytes], k: int, buckets: int) -> pa.RecordBatch | None:
    """All blocks of a bucket to runs of windows that start in a smaller document too."""
    owner, places, times, strings = zip(*map(_unpack, blocks), strict=True)
    owner, places, times = np.concatenate(owner), np.concatenate(places), np.concatenate(times)
    string, offset, least = smallest_documents(b"\n".join(strings), owner, k)
    repeat = least < owner[string]
    string, offset = string[repeat], offset[repeat]
    if not len(string):
        return None
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))
    cut = np.flatnonzero(new)
    length = np.diff(np.append(cut, len(string)))
    string, offset = string[cut], offset[cut]
    begin = np.cumsum(times) - times
    n = times[string]  # a run for each place of its string in the document
    which = np.repeat(np.arange(len(string)), n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    place = places[begin[string[which]] + inner]
    return _by_target(owner[string[which]], place + offset[which], length[which], buckets)


def _count(k: int, buckets: int):
    """Blocks sorted by bucket, one bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in _groups(batches, "bucket", "block"):
            if bucket < 0:
                parts = zip(*(_unpack(x)[:3] for x in blocks), strict=True)
                yield _by_target(*(np.concatenate(x) for x in parts), buckets)
            elif (found := _bucket_runs(blocks, k, buckets)) is not None:
                yield found
        release()

    return run


def repeated_runs(df: DataFrame, id_col: str, text_col: str, k: int = 13, m: int = 3) -> DataFrame:
    """id and runs (packed little-endian int32 pairs: first window, number of windows) of each document with repeats."""
    spark = df.sparkSession
    rows = _texts(df, id_col, text_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot, words = hot_minimisers(rows, k, m, partitions)
    partitions = max(partitions, min(MOST_PARTITIONS, words // PARTITION_WORDS))
    buckets = max(partitions, -(-words // BUCKET_WORDS))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int")).sortWithinPartitions("bucket")

    blocks = dealt(rows.mapInArrow(_split(hot.tobytes(), buckets, k, m), "bucket long, block binary"))
    runs = blocks.mapInArrow(_count(k, buckets), "bucket long, packed binary")
    return dealt(runs).mapInArrow(_gather, "id long, runs binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3, kept_col: str = "kept_text") -> DataFrame:
    """id, n_words, n_removed and ``kept_col``: the words no window of which starts in a document with a smaller id too.

    Kept words are joined by one space. A null text has no words and an empty result, as has an empty one; texts of
    fewer than ``k`` words have no window and keep all words. A null id is in no order: its text stays whole and
    removes nothing. Repeated rows are one document (equal ids are not smaller) and get equal results; if rows of one
    id have different texts, windows that repeat in one of them are removed at those places in all. Other columns are
    not passed on; an empty table stays empty.
    """
    runs = repeated_runs(df, id_col, text_col, k, m)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(runs, "id", "left")
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept_col, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, kept = [], [], []
            for text, packed in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if packed:
                    pairs = np.frombuffer(packed, dtype="<i4").reshape(-1, 2)
                    pairs = pairs[pairs[:, 0] + pairs[:, 1] + k - 1 <= len(words)]
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + k - 1, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[f.name for f in fields]
            )

    return rows.mapInArrow(run, T.StructType(fields))


