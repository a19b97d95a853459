"""Importance resampling of documents towards a target distribution of word n-grams.

Documents and target texts are bags of features, the runs of 1 to ``n`` consecutive words, hashed into buckets. A bucket
gains the logarithm of how much likelier it is in the target than in all documents; a document weighs the mean gain of
its features, and a digest of its id adds Gumbel noise, so that the highest scores are a draw without replacement.

Inside a partition, the words of many texts become word ids, and a suffix array over them, sorted as deep as the longest
feature, brings equal n-grams together: runs of the LCP array are the repeated ones. Each run is hashed once, and its
bucket is scattered back to all its occurrences. Bucket counts are added up over all documents; ranks come from a range
partition of the scores, so that no task sorts more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, release, slices, stored, texts
from sunspan.llm._words import PUNCTUATION, Words

NGRAM, BUCKETS, LEAST_WORDS = 2, 10_000, 20
#: Bytes of text whose words share one suffix array.
SUFFIX_BYTES = 8 << 20


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` in the order of the ``depth`` ids that start there; past the end is less than any id.

    Ranks of the first 1, 2, 4, ... ids are doubled until they are ``depth`` deep.
    """
    rank, width = ids.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.zeros(len(rank), dtype=np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1]
        width += step
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The LCP array: how many ids (up to ``depth``, none after a 0) each position in ``order`` shares with the one before."""
    padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
    lcp = np.zeros(len(order), dtype=np.int64)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(depth):
        ahead = padded[order + k]
        same &= (ahead[1:] == ahead[:-1]) & (ahead[1:] != 0)
        lcp[1:] += same
    return lcp


def feature_buckets(words: Words, n: int = NGRAM, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each length k from 1 to n the bucket of the k words that start at each word, -1 where the text ends before."""
    out = [np.full(len(words.starts), -1, dtype=np.int64) for _ in range(n)]
    if not len(words.starts):
        return out
    codes, _ = words.codes()
    at = np.arange(len(codes)) + words.doc  # a 0 stands between texts
    ids = np.zeros(int(at[-1]) + 1, dtype=np.int64)
    ids[at] = codes.astype(np.int64) + 1
    order = suffix_order(ids, n)
    lcp = common_prefixes(ids, order, n)
    word_at = np.full(len(ids), -1, dtype=np.int64)
    word_at[at] = np.arange(len(codes))
    order_word = word_at[order]
    left = np.where(order_word >= 0, words.first[1:][words.doc[order_word]] - order_word, 0)
    body = words.data.tobytes()
    for k in range(1, n + 1):
        whole = left >= k
        heads = whole & (lcp < k)
        place, head = order_word[whole], order_word[heads]
        if len(head):
            spans = zip(words.starts[head].tolist(), words.ends[head + k - 1].tolist(), strict=True)
            hashed = np.fromiter((crc32(body[a:b]) % buckets for a, b in spans), dtype=np.int64, count=len(head))
            out[k - 1][place] = hashed[np.cumsum(heads[whole]) - 1]
    return out


def _words(batch: pa.RecordBatch, text_col: str) -> Words:
    return Words([t.encode() for t in texts(batch, text_col)], lower=True, gaps=PUNCTUATION)


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all rows fall into each bucket that has any.

    Null and empty texts have no features; repeated rows count again; whole texts count, whatever their length; an
    empty table has no buckets. Each task sends a row per bucket at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, SUFFIX_BYTES):
            for found in feature_buckets(_words(batch, text_col), n, buckets):
                total += np.bincount(found[found >= 0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])
        release()

    parts = df.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket; ``buckets`` rows bound what is fetched."""
    counts = []
    for table in (source, target):
        one = [0] * buckets
        for r in table.collect():
            one[r["bucket"]] = r["n"]
        counts.append(one)
    s_all, t_all = (float(sum(c) + buckets) for c in counts)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(*counts, strict=True)], dtype=np.int64)


def weigh(df: DataFrame, gains: np.ndarray, text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """``df`` with n_words, n_features and weight, the floored mean gain of a text's features.

    Null and empty texts and those without words have no features and weigh 0. Rows are weighed one by one, whole
    texts whatever their length; repeated rows weigh alike; input columns of these names are replaced; an empty table
    stays empty.
    """
    buckets = len(gains)

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        words = _words(batch, text_col)
        total = np.zeros(len(words.starts) + 1, dtype=np.int64)
        many = np.zeros(len(words.counts), dtype=np.int64)
        for k, found in enumerate(feature_buckets(words, n, buckets)):
            total[1:] += np.where(found >= 0, gains[found], 0)
            many += np.maximum(0, words.counts - k)
        total = np.cumsum(total)
        summed = total[words.first[1:]] - total[words.first[:-1]]
        weight = np.where(many > 0, summed // np.maximum(many, 1), 0)
        return {name: pa.array(x, pa.int64()) for name, x in (("n_words", words.counts), ("n_features", many), ("weight", weight))}

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return add_columns(df, fn, fields, [text_col], SUFFIX_BYTES)


def noise(id_col: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and id; a null id counts as the text null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with ``rank_col``, 1, 2, 3, ... over all rows in ``order``, as a table in the shared folder.

    Rows are dealt by ranges of ``order`` and numbered within each; only the counts of the ranges are added up in one
    place, a row for each partition. An empty table stays empty.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != rank_col]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("_rank_at"))
    dealt = stored(dealt, "ranked")
    part, at = F.shiftright("_rank_at", 33), F.col("_rank_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_rank_part")).agg((F.max(at) + 1).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_rank_part", ahead.alias("_rank_ahead"))  # a row for each partition
    found = dealt.withColumn("_rank_part", part).join(F.broadcast(sizes), "_rank_part")
    return found.select(*kept, (F.col("_rank_ahead") + at + 1).alias(rank_col))


def scores(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank of every row of ``docs``.

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) of highest scores are drawn, ties
    to the smaller id; rank is their order and null for all others. ``target`` holds the texts to come near to, in a
    column of the same name. Rows of null, empty or very short texts are never drawn but have a score; a null id is an
    id; repeated rows are rows, drawn next to each other; without target texts or documents all gains are those of
    empty counts; an empty table stays empty. Only the ``buckets`` gains reach the driver.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, text_col, n, buckets), buckets)
    rows = weigh(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), gains, "_text", n)
    rows = rows.select("_id", "n_features", "weight", (F.col("weight") + noise(F.col("_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("_able"))
    rows = stored(rows, "scores")  # ranges are drawn from a sample, which would weigh all texts once more
    rows = ranked(rows, [F.desc("_able"), F.desc("score"), F.asc_nulls_first("_id")])
    drawn = rows.where("_able").count() * percent // 100
    rank = F.when(F.col("_able") & (F.col("rank") <= drawn), F.col("rank"))
    return rows.select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str = "rank", **options: int) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns and ``rank_col``; options as for scores().

    Rows that share an id are drawn together, with the rank of the first of them; rows without an id are not drawn. An
    input column named ``rank_col`` is replaced.
    """
    found = scores(docs, target, id_col, text_col, **options).where(F.col("rank").isNotNull())
    drawn = found.groupBy(F.col(f"`{id_col}`").alias("_drawn")).agg(F.min("rank").alias(rank_col))
    rest = docs.drop(rank_col) if rank_col in docs.columns else docs
    return rest.join(drawn, rest[f"`{id_col}`"] == F.col("_drawn")).drop("_drawn")
