"""Secret scans by assignment-aware lexing.

Three plain patterns give base spans (assign, access, hex). The lexer reads source and configuration syntax
(``name = "literal"``, ``"name": literal``, ``name := literal``, ``name => literal``, ``name: literal``, literals in
triple quotes, ``<name>literal</name>``, and values that YAML has on the lines below a name) into name-literal pairs,
joins literals and constants that are added up, follows names that stand for an earlier constant, and scores each
literal by how sensitive the name is that it ends up in. Literals that score enough are spans of kind ``lexed``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, texts

KINDS = ("assign", "access", "hex", "lexed")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

OPERATOR = re.compile(r":=|=>|(?<![=!<>+\-*/%&|^~])=(?![=~])|:(?![:/=])")
QUOTED = re.compile(r"""(?:[rRbBuUfF]{0,2})("[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`]*`)""")
TRIPLE = re.compile(r"""(?:[rRbBuUfF]{0,2})(\"{3}|'{3})""")
OPEN_TAG = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>", re.ASCII)
CLOSE_TAG = re.compile(r"\s*>", re.ASCII)
BELOW = re.compile(r"[ \t]*(?:([|>])[-+0-9]*[ \t]*)?\r?\n")
DASH = re.compile(r"- +")
KEY = re.compile(r"[\w.\"'-]+[ \t]*:(?:\s|\Z)")
BARE = re.compile(r"(?:[^\s,;#\"'`(){}\[\]<>|=:]+|:(?=//))+={0,2}")
BLANK = re.compile(r"[ \t]*")
PLUS = re.compile(r"[ \t]*\+[ \t]*")
SPACES = " \t\n\r\f\v"
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z", re.ASCII)

#: How telling a part of a name is; above THRESHOLD, so that a strong literal is reported for each.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "clientsecret": 1.0,
    "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "key": 0.6, "pass": 0.6, "salt": 0.6, "signature": 0.6, "dsn": 0.6,
}
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|none|null|nil|true|false|todo|changeme|example|your.*|<.*>|\$\{.*\}|%\w+%|password|secret|token)\Z", re.IGNORECASE)
THRESHOLD = 0.55
#: First characters of a value that are kept to see a placeholder; those of fixed length are shorter.
HEAD = 64


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float


def base_spans(text: str) -> list[Span]:
    """The spans of the three plain patterns, leftmost and without overlap within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [Span("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [Span("access", *m.span(), None, 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    at = 0
    while m := LONG_HEX.search(text, at):  # a run of 24 is found first; its maximal run is the match
        run = HEX.match(text, m.start())
        out.append(Span("hex", *run.span(), None, 1.0))
        at = run.end()
    return out


def name_weight(name: str) -> float:
    """0 to 1: how sensitive a name is; parts are split at punctuation and at changes of case."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


class Value:
    """What weighs a literal that is added up from others, whatever its length: its ends and its characters' counts."""

    __slots__ = ("head", "tail", "counts", "length")

    def __init__(self, text: str = "") -> None:
        self.head, self.tail, self.counts, self.length = text[:HEAD], text[-1:], Counter(text), len(text)

    def add(self, other: Value) -> None:
        if self.length < HEAD:
            self.head = (self.head + other.head)[:HEAD]
        self.tail = other.tail or self.tail
        self.counts.update(other.counts)
        self.length += other.length

    def placeholder(self) -> bool:
        if self.length <= HEAD:
            return bool(PLACEHOLDER.match(self.head))
        inner = self.counts - Counter(self.head[0] + self.tail)
        return bool(PLACEHOLDER.match(self.head + "".join(inner) + self.tail))

    def weight(self) -> float:
        if self.length < 6 or self.placeholder() or any(c.isspace() for c in self.counts):
            return 0.0
        shares = [c / self.length for c in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        kinds = "".join(self.counts)
        classes = sum(bool(re.search(p, kinds)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
        return min(1.0, entropy / 4 + 0.15 * (classes - 1) + (0.1 if self.length >= 16 else 0.0))


def literal_weight(value: str) -> float:
    """0 to 1: how much a literal looks like a secret: long enough, varied, no placeholder, no prose."""
    return Value(value).weight()


def _name(text: str, end: int) -> str | None:
    """The name that ends before an operator at ``end``."""
    at = end
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"'`])":
        at -= 1
    stop = at
    while at and (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "_$.-")):
        at -= 1
    name = text[at:stop].strip(".-")
    return name if name and not name[0].isdigit() else None


def _closing(text: str, quotes: str, start: int) -> int:
    """Where the first unescaped ``quotes`` from ``start`` are, -1 if nowhere."""
    at = start
    while (found := text.find(quotes, at)) >= 0:
        back = found
        while back > start and text[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        at = found + 1
    return -1


def _literal(text: str, at: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Pieces (start, end, quoted) of the value that starts at ``at``, and where it ends; pieces are joined by +."""
    pieces: list[tuple[int, int, bool]] = []
    while True:
        at = BLANK.match(text, at).end()
        if (m := TRIPLE.match(text, at)) and (end := _closing(text, m[1], m.end())) >= 0:
            pieces.append((m.end(), end, True))
            at = end + 3
        elif m := QUOTED.match(text, at):
            pieces.append((m.start(1) + 1, m.end(1) - 1, True))
            at = m.end()
        elif (m := BARE.match(text, at)) and (not pieces or IDENTIFIER.match(m[0])):
            pieces.append((*m.span(), False))
            at = m.end()
        else:
            return pieces, at
        plus = PLUS.match(text, at)
        if not plus or not (pieces[-1][2] or IDENTIFIER.match(text[slice(*pieces[-1][:2])])):
            return pieces, at
        at = plus.end()


class Line(NamedTuple):
    """A line from ``start``: its text without blanks, a dash or the line's end, and where the next line starts."""

    start: int
    text: int
    end: int
    next: int


def _line(text: str, at: int) -> Line | None:
    """The line at ``at``, or None where a carriage return stands inside it; every step is a search or one pass."""
    stop = text.find("\n", at)
    after = len(text) if stop < 0 else stop + 1
    stop = len(text) if stop < 0 else stop
    if stop > at and after > stop and text[stop - 1] == "\r":
        stop -= 1
    if text.find("\r", at, stop) >= 0:
        return None
    begin = BLANK.match(text, at, stop).end()
    if dash := DASH.match(text, begin, stop):
        begin = dash.end()
    return Line(at, begin, begin + len(text[begin:stop].rstrip(" \t")), after)


def _below(text: str, name_at: int, at: int) -> list[tuple[int, int, bool]]:
    """Pieces of a value on the lines below a YAML name: a block's lines, or the one plain or quoted value."""
    begin = name_at
    while begin and text[begin - 1] in " \t-\"'":
        begin -= 1
    if (begin and text[begin - 1] != "\n") or not (m := BELOW.match(text, at)):
        return []
    depth, block, at = len(text[begin:name_at].rstrip("-\"'")), m[1], m.end()
    pieces: list[tuple[int, int, bool]] = []
    while at < len(text) and (line := _line(text, at)):
        full = line.end > line.text
        if BLANK.match(text, at, line.text).end() - at <= depth and not (block and not full):
            break
        if not block:
            return [] if KEY.match(text, line.text, line.end) else _literal(text, line.text)[0]
        if full:
            pieces.append((line.text, line.end, True))
        at = line.next
    return pieces


def _elements(text: str) -> list[tuple[int, str, tuple[int, int]]]:
    """Start, name and content's span of each element that holds text only; each looks as far as the next <."""
    out = []
    for m in OPEN_TAG.finditer(text):
        stop = text.find("<", m.end())
        if stop < 0:
            break
        if text.startswith("</" + m[1], stop) and CLOSE_TAG.match(text, stop + 2 + len(m[1])) and text.find(">", m.end(), stop) < 0:
            inner = text[m.end() : stop]
            start = m.end() + len(inner) - len(inner.lstrip(SPACES))
            end = m.end() + len(inner.rstrip(SPACES))
            if end > start:
                out.append((m.start(), m[1], (start, end)))
    return out


class Assigned(NamedTuple):
    """A value as it is written: each part is a span of the text, or the number of the earlier value that it names."""

    name: str
    parts: list[tuple[int, int] | int]


def _values(text: str, assigned: list[Assigned], wanted: list[int]) -> dict[int, Value]:
    """The values of ``wanted`` and of all that they are added up from, each added up once."""
    need = set()
    ahead = list(wanted)
    while ahead:
        if (k := ahead.pop()) not in need:
            need.add(k)
            ahead += [p for p in assigned[k].parts if isinstance(p, int)]
    out: dict[int, Value] = {}
    for k in sorted(need):  # a value only names earlier ones
        out[k] = Value()
        for p in assigned[k].parts:
            out[k].add(out[p] if isinstance(p, int) else Value(text[slice(*p)]))
    return out


def lexed_spans(text: str) -> list[Span]:
    """Literals that end up in a sensitive name, each with the name that scores most, the first of equals."""
    constants: dict[str, int] = {}
    assigned: list[Assigned] = []
    found: list[tuple] = [(m.start(), m) for m in OPERATOR.finditer(text)]
    if "</" in text:
        found = sorted(found + _elements(text), key=lambda x: x[0])
    for _, m, *element in found:
        if element:
            name, pieces = m, [(*element[0], True)]
        else:
            name, pieces = _name(text, m.start()), []
            if name is not None:
                pieces = _literal(text, m.end())[0]
                if not pieces and m[0] == ":":
                    pieces = _below(text, text.rfind(name, 0, m.start()), m.end())
        parts: list[tuple[int, int] | int] = []
        for start, end, quoted in pieces:
            word = text[start:end]
            if not quoted and IDENTIFIER.match(word) and word in constants:
                parts.append(constants[word])
            elif quoted or len(pieces) == 1:  # a name without a constant in a sum is no literal
                parts.append((start, end))
        if not parts:
            continue
        constants[name] = len(assigned)
        assigned.append(Assigned(name, parts))
    weights = {k: w for k, a in enumerate(assigned) if (w := name_weight(a.name))}
    values = _values(text, assigned, list(weights))
    best = {k: (score, -k) for k, w in weights.items() if (score := w * values[k].weight()) >= THRESHOLD}
    out: dict[tuple[int, int], tuple[float, int]] = {}
    for k in range(len(assigned) - 1, -1, -1):  # from values to what they are added up from
        if k in best:
            for p in assigned[k].parts:
                into = best if isinstance(p, int) else out
                into[p] = max(into.get(p, best[k]), best[k])
    return [Span("lexed", a, b, assigned[-k].name, round(score, 4)) for (a, b), (score, k) in out.items() if b > a]


def scan(text: str) -> list[Span]:
    """All spans by start, then kind as listed in KINDS, then end."""
    return sorted(base_spans(text) + (lexed_spans(text) if ":" in text or "=" in text or "</" in text else []), key=lambda s: (s.start, ORDER[s.kind], s.end))


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("name", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(df: DataFrame, text_col: str, spans_col: str = "secret_spans") -> DataFrame:
    """``df`` with ``spans_col``: array of (kind, start, end, name, score), offsets in code points, end exclusive.

    Null and empty texts give an empty array. Spans of different kinds may overlap; within a kind of the plain
    patterns they do not. Rows are scanned one by one, whole texts whatever their length, so repeated rows get equal
    spans; an input column named ``spans_col`` is replaced; an empty table stays empty. Time grows with the length of
    a text, also with runs of blanks, quotes or tags; only blocks inside blocks are read once for each block around
    them, and as each is indented more, these are fewer than the square root of twice the length.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [[s._asdict() for s in scan(t)] for t in texts(batch, text_col)]
        return {spans_col: pa.array(found, _ARROW)}

    return add_columns(df, fn, [T.StructField(spans_col, SPANS)], [text_col])


def redact(df: DataFrame, text_col: str, spans_col: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each run of overlapping spans in ``text_col`` replaced by ``mark``.

    Null and empty texts stay as they are; rows without spans too. Repeated rows are treated alike; other columns pass
    through; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist(), strict=True):
            if text and spans:
                pieces, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        pieces += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join(pieces) + text[at:]
            out.append(text)
        return {text_col: pa.array(out, pa.string())}

    order = df.columns
    return add_columns(df, fn, [T.StructField(text_col, T.StringType())], [text_col, spans_col]).select(order)


def span_text(spans: str, kinds: tuple[str, ...] = KINDS):
    """Column: kind:start:end of the spans of ``kinds``, comma-joined in their order."""
    kept = F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
