"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings. In training, each labelled text that mentions an
identity group is scored again with each of its identity terms swapped for each term that can stand for it, and every
change of the score costs: the weights of group terms are driven together, so that a neutral mention of a group does
not raise the score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, texts
from sunspan.llm._labels import training_rows

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5)
SPACE = (1 << 20) - 1
#: Labelled rows that training reads at most, half of them of either label.
TRAINING_ROWS = 6000
#: Features are kept when this many standard errors away from what chance gives.
LEAST_Z = 4.0
#: Pull of every weight towards zero, so that chance features of long texts do not add up.
L1 = 3e-3
RATE = 0.05
CACHE_WORDS = 400_000

#: Terms of one row can stand for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "buddhist", "hindu", "atheist"),
    ("muslims", "christians", "jews", "buddhists", "hindus", "atheists"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "locals"), ("immigrant", "refugee", "local"),
    ("old", "young"), ("blind", "deaf", "disabled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
PARTNERS = {w: tuple(v for v in row if v != w) for row in IDENTITY for w in row}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """Hashes of the whole word and of its beginnings."""
    return [zlib.crc32(x.encode()) & SPACE for x in (word + "$", *(word[:n] for n in PREFIXES if len(word) >= n))]


def text_features(found: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in found for f in features(w)), dtype=np.int64))


@dataclass
class Model:
    """Weights of the features that were kept, ascending, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}
        self.weight = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))

    def score(self, text: str) -> float:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        hit: set[int] = set()
        cache, weight = self.cache, self.weight
        for w in words(text):
            known = cache.get(w)
            if known is None:
                known = cache[w] = tuple(f for f in features(w) if f in weight)
            if known:
                hit.update(known)
        z = self.bias + sum(weight[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def changes(found: set[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features lost and gained by each swap of one identity term of a set of words for one of its partners."""
    out = []
    for w in sorted(found & PARTNERS.keys()):
        rest = found - {w}
        own = set(features(w))
        kept = {f for x in rest for f in features(x) if f in own}  # shared with other words
        for v in PARTNERS[w]:
            new = set(features(v)) if v not in rest else set()
            gained = new - own - {f for x in rest for f in features(x) if f in new}
            out.append((np.array(sorted(own - kept - new), dtype=np.int64), np.array(sorted(gained), dtype=np.int64)))
    return out


class Swaps:
    """Differences of feature rows, text less swapped text, as a sparse matrix over kept features."""

    def __init__(self, swaps: list[list[tuple[np.ndarray, np.ndarray]]], keep: np.ndarray):
        self.text = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps])
        pairs = [p for x in swaps for p in x]
        column = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.empty(0, dtype=np.int64)
        sign = np.concatenate([np.repeat((1.0, -1.0), (len(a), len(b))) for a, b in pairs]) if pairs else np.empty(0)
        row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
        at = np.minimum(np.searchsorted(keep, column), len(keep) - 1)
        known = keep[at] == column if len(keep) else np.zeros(len(column), dtype=bool)
        self.row, self.column, self.sign, self.size = row[known], at[known], sign[known], len(pairs)
        self.share = 1 / np.maximum(np.bincount(self.text, minlength=len(swaps)), 1)[self.text] if pairs else np.empty(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.column], self.size)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.sign * g[self.row], width)


def fit(rows: list[np.ndarray], swaps: list[list[tuple[np.ndarray, np.ndarray]]], y: np.ndarray, strength: float = 4.0, decay: float = 1e-3, steps: int = 250) -> Model:
    """rows: features of each text; swaps: changes() of each text.

    The loss is that of the labels, either kind with the same weight, and ``strength`` times the mean over texts with
    identity terms of the mean square by which a swap changes the score.
    """
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, dtype=np.int64), np.empty(0), float(3.0 * (2 * y.mean() - 1)) if len(y) else 0.0)
    count = np.stack([np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == v]), minlength=SPACE + 1) for v in (0, 1)])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share, overall = count / n[:, None], count.sum(0) / n.sum()
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(overall * (1 - overall), 1e-9) * (1 / n[0] + 1 / n[1]))
    terms = np.array(sorted({f for w in PARTNERS for f in features(w)}))
    keep = np.union1d(np.flatnonzero((z >= LEAST_Z) & (count.sum(0) >= 5)), terms[count.sum(0)[terms] > 0])

    x = np.zeros((len(rows), len(keep)), dtype=np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(keep, r)
        at = at[at < len(keep)]
        x[i, at[np.isin(keep[at], r)]] = 1
    swapped = Swaps(swaps, keep)
    cost = 2 * strength * swapped.share / max(1, len(np.unique(swapped.text)))
    weight_of = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]).astype(np.float32)
    w, b = np.zeros(len(keep), dtype=np.float32), np.float32(0)
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    score = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        z = x @ w + b
        p = score(z)
        g = (p - y) * weight_of
        moved = np.zeros(len(keep))
        if swapped.size:
            was = p[swapped.text]
            now = score(z[swapped.text] - swapped.times(w))
            step = cost * (was - now)
            first, second = step * was * (1 - was), -step * now * (1 - now)
            g = g + np.bincount(swapped.text, first + second, len(y))
            moved = -swapped.back(second, len(keep))
        grad = np.append(x.T @ g.astype(np.float32) + decay * w + moved, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - np.float32(move[-1])
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0).astype(np.float32)
    return Model(keep.astype(np.int64), w.astype(np.float64), float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", test: tuple[int, int] = (3, 1), most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the label from the texts alone; see training_rows() for the rows that it learns from.

    Only hashed features of that bounded sample reach the driver. Null and empty texts have no features; repeated rows
    count as often as they are there. Without rows of both labels, as in empty tables, the model is constant.
    """
    rows = training_rows(docs, labels, label, test, most, id_col, text_col)
    columns = "y int, plain binary, swaps array<struct<lost:binary,gained:binary>>"

    def extract(batches):
        for b in batches:
            plain, swaps = [], []
            for t in texts(b, "text"):
                found = words(t)
                plain.append(text_features(found).astype("<u4").tobytes())
                swaps.append([{"lost": p.astype("<u4").tobytes(), "gained": q.astype("<u4").tobytes()} for p, q in changes(found)])
            kind = pa.list_(pa.struct([("lost", pa.binary()), ("gained", pa.binary())]))
            yield pa.RecordBatch.from_pydict({"y": b.column("y").cast(pa.int32()), "plain": pa.array(plain, pa.binary()), "swaps": pa.array(swaps, kind)})

    got = rows.select("y", "text").mapInArrow(extract, columns).toArrow().to_pylist()
    got.sort(key=lambda r: (r["y"], r["plain"]))  # the same sums in any order of partitions
    unpack = lambda x: np.frombuffer(x, dtype="<u4").astype(np.int64)
    swaps = [[(unpack(s["lost"]), unpack(s["gained"])) for s in r["swaps"]] for r in got]
    return fit([unpack(r["plain"]) for r in got], swaps, np.array([r["y"] for r in got], dtype=np.float32))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` from 0 to 1.

    The whole text counts, whatever its length; null and empty texts get the score of no words. Repeated rows get
    equal scores; an input column named ``score_col`` is replaced; an empty table stays empty.
    """
    ids, weights, bias = model.ids, model.weights, model.bias

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = _model(ids.tobytes(), weights.tobytes(), bias)
        return {score_col: pa.array([m.score(t) for t in texts(batch, text_col)], pa.float64())}

    return add_columns(df, fn, [T.StructField(score_col, T.DoubleType())], [text_col])


_MODELS: dict[tuple, Model] = {}


def _model(ids: bytes, weights: bytes, bias: float) -> Model:
    """One model, with its cache of words, for all batches of a worker."""
    key = (hash(ids), hash(weights), bias)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(np.frombuffer(ids, dtype=np.int64), np.frombuffer(weights, dtype=np.float64), bias)
    return _MODELS[key]


def predicted(score_col: str = "score", threshold: float = 0.7):
    return (F.col(score_col) >= threshold).cast("int")
