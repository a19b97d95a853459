"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from measures of its characters and words and
from the words themselves, hashed to signed places; gated attention, learned from document labels alone, weighs the
passages; the weighted sum is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, slices, texts
from sunspan.llm._labels import training_rows
from sunspan.llm._words import Words, sequence_hashes

PASSAGE = 64
TRAINING_ROWS = 4000
#: Bytes of text that are scored at once: the measures of a slice take some thirty times as much.
SLICE = 1 << 20
HIDDEN, GATE = 12, 8

_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "pipe": b"|", "symbol": b"%*$&#@~^+=<>", "shout": b"!?", "stop": b".,;:", "quote": b"\"'()[]{}/\\_-", "high": range(128, 256)}
_TABLES = []
for _members in _CLASSES.values():
    _t = np.zeros(256, dtype=np.int32)
    _t[list(_members)] = 1
    _TABLES.append(_t)
MEASURES = len(_TABLES) + 9
#: Signed places that words are hashed to, and how much more their weights are pulled to zero than others.
PLACES, PULL = 128, 300.0
FEATURES = MEASURES + PLACES
#: Standard deviations that an input counts at most, so that unknown words cannot outvote all else.
LIMIT = np.append(np.full(MEASURES, 8.0), np.full(PLACES, 2.0))


def passages(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage, and the document that each belongs to; a text without words is one passage of zeros."""
    w = Words([t.encode("utf-8", "surrogatepass") for t in batch])
    counts = np.maximum(w.counts, 0)
    parts = np.maximum(1, -(-counts // PASSAGE))
    doc = np.repeat(np.arange(len(batch)), parts)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = w.first[:-1][doc] + inner * PASSAGE
    end = np.minimum(begin + PASSAGE, w.first[1:][doc])
    n = end - begin
    out = np.zeros((len(doc), FEATURES))
    if len(w.hashes):
        def total(per_word: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(per_word))
            return sums[end] - sums[begin]

        size = w.ends - w.starts
        chars = np.maximum(total(size), 1)
        for i, table in enumerate(_TABLES):
            sums = np.zeros(len(w.data) + 1, dtype=np.int32)
            np.cumsum(table[w.data], out=sums[1:])
            own = sums[w.ends] - sums[w.starts]
            out[:, i] = total(own) / chars
            if i == 0:
                capitals = (own == size) & (size > 1)
        at = len(_TABLES)
        words = np.maximum(n, 1)
        repeat = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1]))
        place = np.searchsorted(begin[n > 0], np.arange(len(w.hashes)), side="right") - 1
        distinct = np.zeros(len(w.hashes), dtype=np.int64)
        order = np.lexsort((w.hashes, place))
        h, p = w.hashes[order], place[order]
        distinct[order] = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
        grams = sequence_hashes(w.hashes, 3)
        seen = np.zeros(len(w.hashes), dtype=np.int64)
        if len(grams):
            d = w.doc[: len(grams)]
            order = np.lexsort((np.arange(len(grams)), grams, d))
            g, dd = grams[order], d[order]
            seen[order[1:]] = (g[1:] == g[:-1]) & (dd[1:] == dd[:-1])
        last = w.data[w.ends - 1]
        out[:, at] = total(repeat) / words
        out[:, at + 1] = total(distinct) / words
        out[:, at + 2] = total(seen) / words
        out[:, at + 3] = total(capitals) / words
        out[:, at + 4] = total(size) / words / 8
        out[:, at + 5] = np.sqrt(np.maximum(total(size * size) / words - (total(size) / words) ** 2, 0)) / 4
        out[:, at + 6] = total((last == 46) | (last == 44)) / words
        out[:, at + 7] = total(size <= 3) / words
        out[:, at + 8] = np.log1p(n) / 4
        cell = place * PLACES + (w.hashes & np.uint64(PLACES - 1)).astype(np.int64)
        sign = np.where(w.hashes >> np.uint64(63), 1.0, -1.0)
        full = np.flatnonzero(n > 0)
        out[full, MEASURES:] = np.bincount(cell, sign, len(full) * PLACES).reshape(len(full), PLACES) / np.sqrt(n[full])[:, None]
    return out, doc


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # (FEATURES + 1, HIDDEN)
    gate: np.ndarray  # (HIDDEN + 1, GATE)
    value: np.ndarray  # (HIDDEN + 1, GATE)
    attend: np.ndarray  # (GATE,)
    out: np.ndarray  # (HIDDEN + 1,)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT)

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All that a score of scaled() passages goes through."""
        h = np.tanh(x @ self.encode[:-1] + self.encode[-1])
        v = np.tanh(h @ self.value[:-1] + self.value[-1])
        g = 1 / (1 + np.exp(-(h @ self.gate[:-1] + self.gate[-1])))
        e = (v * g) @ self.attend
        first = np.searchsorted(doc, np.arange(n))
        a = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a /= np.add.reduceat(a, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.out[:-1] + self.out[-1], -40, 40)))
        return {"x": x, "h": h, "v": v, "g": g, "a": a, "z": z, "p": p, "first": first}

    def scores(self, batch: list[str]) -> np.ndarray:
        x, doc = passages(batch)
        return self.forward(self.scaled(x), doc, len(batch))["p"] if len(batch) else np.empty(0)


def gradient(m: Model, x: np.ndarray, doc: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss, by weights; x as from scaled()."""
    f = m.forward(x, doc, len(y))
    d = (f["p"] - y) * share
    grad = {"out": np.append(f["z"].T @ d, d.sum())}
    dz = d[:, None] * m.out[:-1]
    dh = f["a"][:, None] * dz[doc]
    da = (dz[doc] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[doc])
    grad["attend"] = (f["v"] * f["g"]).T @ de
    dv = de[:, None] * m.attend * f["g"] * (1 - f["v"] ** 2)
    dg = de[:, None] * m.attend * f["v"] * f["g"] * (1 - f["g"])
    grad["value"] = np.vstack([f["h"].T @ dv, dv.sum(0)])
    grad["gate"] = np.vstack([f["h"].T @ dg, dg.sum(0)])
    dh = (dh + dv @ m.value[:-1].T + dg @ m.gate[:-1].T) * (1 - f["h"] ** 2)
    grad["encode"] = np.vstack([f["x"].T @ dh, dh.sum(0)])
    return grad


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Model:
    """x: measures of passages, doc: the document of each (ascending from 0), y: its label."""
    r = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    m = Model(mean, scale, r.normal(0, 0.3, (FEATURES + 1, HIDDEN)), r.normal(0, 0.3, (HIDDEN + 1, GATE)), r.normal(0, 0.3, (HIDDEN + 1, GATE)), r.normal(0, 0.3, GATE), np.zeros(HIDDEN + 1))
    n = len(y)
    if not n or y.min() == y.max():
        m.out[-1] = 3.0 * (2 * y.mean() - 1) if n else 0.0
        return m
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    m.encode[MEASURES:-1] *= 0.1
    pull = np.ones((FEATURES + 1, 1))
    pull[MEASURES:-1] = PULL
    names = ("encode", "gate", "value", "attend", "out")
    moments = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    x = m.scaled(x)
    for t in range(1, steps + 1):
        grad = gradient(m, x, doc, y, share)
        for k in names:
            g = grad[k] + decay * (pull if k == "encode" else 1) * getattr(m, k)
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            setattr(m, k, getattr(m, k) - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8))
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", test: tuple[int, int] = (5, 0), most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the label from the texts alone; see training_rows() for the rows that it learns from.

    Measures of the passages of that bounded sample reach the driver: FEATURES floats for each 64 words. Null and empty
    texts are one passage without words; repeated rows count as often as they are there. Without rows of both labels,
    as in empty tables, the model is constant.
    """
    rows = training_rows(docs, labels, label, test, most, id_col, text_col)

    def extract(batches):
        for b in slices(batches, SLICE):
            x, doc = passages(texts(b, "text"))
            x = x.astype("<f4")
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_pydict(
                {"id": b.column("id"), "y": b.column("y"), "x": pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())}
            )

    got = rows.mapInArrow(extract, "id long, y int, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["x"]))  # the same sums in any order of partitions
    parts = [np.frombuffer(r["x"], dtype="<f4").astype(np.float64).reshape(-1, FEATURES) for r in got]
    x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(x, doc, np.array([r["y"] for r in got], dtype=np.float64))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col`` from 0 to 1, from all passages of the text.

    Null and empty texts are one passage without words. Repeated rows get equal scores; an input column named
    ``score_col`` is replaced; an empty table stays empty.
    """
    parts = {f.name: getattr(model, f.name) for f in fields(model)}

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {score_col: pa.array(np.round(Model(**parts).scores(texts(batch, text_col)), 12), pa.float64())}

    return add_columns(df, fn, [T.StructField(score_col, T.DoubleType())], [text_col], limit=SLICE)


def predicted(score_col: str = "score", threshold: float = 0.3):
    return (F.col(score_col) >= threshold).cast("int")
