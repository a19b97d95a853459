"""BPE encoding and decoding.

Each distinct word keeps a segment tree over the ranks of its adjacent symbol pairs. The root yields the leftmost
pair of the lowest rank; merging it is a point update of three leaves with a logarithmic climb each, until the root
says that no pair can be merged. The trees of all words of a batch that are not in the worker's bounded cache are rows
of one array and advance together.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, texts

NONE = np.iinfo(np.int64).max
#: Words kept in a worker's cache; when it is full, it starts anew.
CACHE_WORDS = 120_000
#: Words of so many bytes go through their trees alone where a batch has so few of their size: a round of arrays costs
#: more than a few plain numbers.
LONG, FEW = 512, 16
NO_PAIR = int(NONE)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A BPE with word ends, read from a tokenizers file: NFC, lower case, white space dropped."""

    #: White space as Unicode defines it.
    SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    #: From here on letters and numbers are looked up by the regex module, below by explicit sets, which is faster.
    WIDE = 0x250

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{self.SPACE}\p{{L}}\p{{N}}]+")
        letters, numbers = ("".join(chr(i) for i in range(self.WIDE) if unicodedata.category(chr(i))[0] == k) for k in "LN")
        self.narrow_word = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{self.SPACE}{letters}{numbers}]+")
        self.wide = re.compile(f"[{chr(self.WIDE)}-\U0010ffff]")
        chars, end = _byte_chars(), spec["model"]["end_of_word_suffix"] or ""
        self.inside = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        size = max(max(vocab.values()), *self.special.values()) + 1
        table = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            table[i] = t.encode()
        self.table = table
        self.special_bytes = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        self.cache: dict[str, bytes] = {}

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each mergeable pair."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for size in np.unique(width):
            rows = np.flatnonzero(width == size)
            step = max(1, (1 << 18) // int(size))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                if len(part) <= FEW and size >= LONG:
                    for i in part.tolist():
                        out[i] = self._tree(words[i], int(size))
                    continue
                for i, ids in zip(part.tolist(), self._trees([words[i] for i in part], lengths[part], int(size)), strict=True):
                    out[i] = ids
        return out

    def _trees(self, words: list[bytes], lengths: np.ndarray, size: int) -> list[bytes]:
        """Words of at most ``size`` bytes (a power of two), a tree of 2 * size nodes each; leaf p is node size + p."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), dtype=np.uint8).reshape(n, size)
        at = np.arange(size)
        sym = self.inside[raw]
        every = np.arange(n)
        sym[every, lengths - 1] = self.last[raw[every, lengths - 1]]
        sym[at[None, :] >= lengths[:, None]] = -1
        after = np.minimum(at[None, :] + 1, size).repeat(n, 0)
        after[at[None, :] >= lengths[:, None] - 1] = size  # size: nothing follows
        before = (at[None, :] - 1).repeat(n, 0)
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        if size > 1:
            rank = self._rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, size - 1)
            tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, rank * size + at[:-1])
        lo = size
        while lo > 1:
            tree[:, lo // 2 : lo] = np.minimum(tree[:, lo : 2 * lo : 2], tree[:, lo + 1 : 2 * lo : 2])
            lo //= 2
        live = every
        while True:
            root = tree[live, 1]
            live, root = live[root != NONE], root[root != NONE]
            if not len(live):
                break
            rank, p = np.divmod(root, size)
            new = self.made[rank]
            q = after[live, p]
            r = after[live, q]
            sym[live, p], sym[live, q] = new, -1
            after[live, p] = r
            has = r < size
            before[live[has], r[has]] = p[has]
            b = before[live, p]
            value = np.where(has, self._rank(new, sym[live, np.minimum(r, size - 1)]), NONE)
            self._put(tree, live, p, np.where(value == NONE, NONE, value * size + p), size)
            self._put(tree, live, q, np.full(len(live), NONE), size)
            some = b >= 0
            rows, b = live[some], b[some]
            value = self._rank(sym[rows, b], new[some])
            self._put(tree, rows, b, np.where(value == NONE, NONE, value * size + b), size)
        kept = sym >= 0
        flat, ends = sym[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _tree(self, word: bytes, size: int) -> bytes:
        """One word of at most ``size`` bytes, by the same tree as plain numbers; a change goes up as far as it matters."""
        pairs, made, last = self.pairs, self.made, len(word) - 1
        sym = self.inside[np.frombuffer(word, dtype=np.uint8)].tolist()
        sym[last] = int(self.last[word[last]])
        after, before = list(range(1, last + 2)), list(range(-1, last))
        tree = [NO_PAIR] * (2 * size)
        for p in range(last):
            if (rank := pairs.get(sym[p] << 32 | sym[p + 1])) is not None:
                tree[size + p] = rank * size + p
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, q: int) -> None:
            rank = pairs.get(sym[p] << 32 | sym[q]) if q <= last else None
            node = size + p
            tree[node] = NO_PAIR if rank is None else rank * size + p
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while (root := tree[1]) != NO_PAIR:
            rank, p = divmod(root, size)
            q = after[p]
            sym[p], sym[q] = int(made[rank]), -1
            after[p] = r = after[q]
            put(q, last + 1)
            put(p, r)
            if r <= last:
                before[r] = p
            if before[p] >= 0:
                put(before[p], p)
        return np.array([x for x in sym if x >= 0], dtype="<u4").tobytes()

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int) -> None:
        node = leaf + size
        tree[rows, node] = value
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character on its own, so no final sigma
        text = text.lower()
        return (self.word if self.wide.search(text) else self.narrow_word).findall(text)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text; strings of special tokens become those tokens."""
        docs = [[y for x in self.split_special.split(t) for y in ([x] if x in self.special else self.words(x))] if "<|" in t else self.words(t) for t in batch]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            self.cache.update(self.special_bytes)
        fresh = list(set().union(*docs).difference(self.cache)) if docs else []
        self.cache.update(zip(fresh, self.merge([w.encode("utf-8", "replace") for w in fresh]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, d)) for d in docs]

    def decode(self, ids: bytes) -> bytes:
        """The tokens joined by one space, in UTF-8: the file names no decoder, so word ends and byte characters stay."""
        return b" ".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, text_col: str, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give zero ids (an empty binary). Every row is encoded on its own, so ties and repeated rows
    are simply encoded again; an input column named ``ids_col`` is replaced, all others pass through; an empty table
    stays empty. A very long word has a tree of its own, of a size next to its length. Strings that spell special
    tokens become those tokens.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {ids_col: pa.array(load(tokenizer_path).encode(texts(batch, text_col)), pa.binary())}

    return add_columns(df, fn, [T.StructField(ids_col, T.BinaryType())], [text_col])


def decode(df: DataFrame, ids_col: str, tokenizer_path: str, text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text that packed ids stand for; null ids give an empty text.

    Ids outside the vocabulary raise IndexError. Rows are decoded one by one, whole arrays whatever their length, so
    repeated rows get equal texts. An input column named ``text_col`` is replaced; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        model = load(tokenizer_path)
        return {text_col: pa.array([model.decode(x or b"").decode() for x in batch.column(ids_col).to_pylist()], pa.string())}

    return add_columns(df, fn, [T.StructField(text_col, T.StringType())], [ids_col])


def transcode(df: DataFrame, text_col: str, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode() and decode() of those ids in one pass over the rows; the text column itself is left out of the result."""

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        model = load(tokenizer_path)
        ids = model.encode(texts(batch, text_col))
        return {ids_col: pa.array(ids, pa.binary()), decoded_col: pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string())}

    fields = [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())]
    return add_columns(df, fn, fields, [text_col], limit=1 << 20, drop=(text_col,))
