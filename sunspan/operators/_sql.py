"""Operators as declarative SQL over named DataFrames.

An operator is called with DataFrames by name and returns a DataFrame; Catalyst plans the whole. The texts keep to the
part of SQL that Spark and DuckDB share, so the same text, put through ``ansi``, is what results are checked against.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Every operator by its query name.
OPERATORS: dict[str, SqlOperator] = {}


def ansi(text: str) -> str:
    """A shared text in DuckDB's spelling."""
    text = re.sub(r"/\*\+.*?\*/ ", "", text)  # hints are Spark's
    text = _each(text, "CROSS JOIN unnest(range({1}, ({2}) + 1)) _{0}({0})")
    text = _wrapped(text, "bround(", "(0e0 + round_even(")  # zero has no sign in Spark's
    for spark, duck in (("percentile(", "quantile_cont("), ("format_string(", "printf("), ("regexp_like(", "regexp_matches(")):
        text = re.sub(r"\b" + re.escape(spark), duck, text)
    text = re.sub(r"regexp_replace\((.+?), ('[^']+'), ('[^']*')\)", r"regexp_replace(\1, \2, \3, 'g')", text)
    text = re.sub(r"\bsha2\((.+?), 256\)", r"sha256(\1)", text)
    text = re.sub(r"locate\(('[^']*'), (\w+)\)", r"strpos(\2, \1)", text)
    text = re.sub(r"try_to_date\((\w+), 'dd.MM.yyyy'\)", r"CAST(try_strptime(\1, '%d.%m.%Y') AS DATE)", text)
    return text


def _each(text: str, form: str) -> str:
    """EACH(x, lo, hi), a row for each whole number from lo to hi (none if lo is greater), in an engine's form."""
    at = 0
    while (at := text.find("EACH(", at)) >= 0:
        depth, end, cuts = 1, at + 5, [at + 5]
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if depth == 1 and text[end] == ",":
                cuts.append(end + 1)
            end += 1
        cuts.append(end)
        parts = [text[a : b - 1].strip() for a, b in zip(cuts, cuts[1:], strict=False)]
        made = form.format(*parts)
        text = text[:at] + made + text[end:]
        at += len(made)
    return text


def spark_text(text: str) -> str:
    return _each(text, "LATERAL VIEW explode(if({1} <= {2}, sequence({1}, {2}), cast(array() AS array<bigint>))) _{0} AS {0}")


def _wrapped(text: str, name: str, other: str) -> str:
    """Calls of ``name`` as calls of ``other``, which opens one more parenthesis."""
    at = 0
    while (at := text.find(name, at)) >= 0:
        depth, end = 1, at + len(name)
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + other + text[at + len(name) : end] + ")" + text[end:]
        at += len(other)
    return text


@dataclass
class SqlOperator:
    name: str
    inputs: tuple[str, ...]
    text: str
    about: str = ""
    oracle: str | None = None  # where DuckDB needs another text
    settings: dict[str, float | str] = field(default_factory=dict)  # :name in the text, with its default
    derived: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)  # {name} in the text, from the inputs by name

    def __call__(self, **given: DataFrame | float | str) -> DataFrame:
        """The operator over DataFrames and settings by name; settings that are not given have their defaults."""
        missing = set(self.inputs) - given.keys()
        if missing or given.keys() - set(self.inputs) - self.settings.keys():
            raise TypeError(f"{self.name} needs {sorted(self.inputs)} and takes {sorted(self.settings)}")
        frames = {k: given[k] for k in self.inputs}
        spark = next(iter(frames.values())).sparkSession
        set_to = self.settings | {k: given[k] for k in self.settings if k in given}
        frames |= {k: f(**frames, **{n: set_to[n] for n in getattr(f, "takes", ())}) for k, f in self.derived.items()}
        return spark.sql(spark_text(self.set({k: given[k] for k in self.settings if k in given})), **frames)

    def set(self, given: dict[str, float | str] | None = None, text: str | None = None) -> str:
        """The text with its settings as literals."""
        text = text or self.text
        for name, value in (self.settings | (given or {})).items():
            literal = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value) + ("e0" if isinstance(value, float) and "e" not in repr(value) else "")
            text = re.sub(rf":{name}\b", literal, text)
        return text

    def sql(self) -> str:
        names = {k: k for k in self.inputs}
        return self.set(text=self.oracle or ansi(self.set())).format(**names)


def operator(name: str, inputs: str, text: str, about: str = "", oracle: str | None = None, derived: dict[str, Callable[..., DataFrame]] | None = None, **settings: float | str) -> SqlOperator:
    """Registers an operator; the part of the name before the first underscore is its id in the inventory."""
    made = SqlOperator(name, tuple(inputs.split()), text, about, oracle, settings, derived or {})
    OPERATORS[name] = made
    return made
