"""The filter language: `score >= 50 AND has(SSN)` becomes one Column that Catalyst can push down.

Conditions are joined by AND and OR from left to right, without precedence.  `=` and `!=` compare trimmed lower-case
text, `<` and the like numbers (durations in days, exposures by rank, text that is no number as 0).  A missing field
makes every condition false but missing().
"""

from __future__ import annotations

import re
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .score import exposure_rank

FIELDS = ("path", "score", "tier", "exposure", "encryption", "size", "file_type", "owner", "source", "last_accessed", "last_modified", "staleness_days", "entity_count")
# Days of a duration's unit.
DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}

_CONDITION = re.compile(r"\s*(?:(?P<f>has|missing)\s*\(\s*(?P<arg>\w+)\s*\)|(?P<field>\w+)\s*(?P<op>>=|<=|!=|=|>|<|contains\b|matches\b)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s()]+))", re.I)
_JOIN = re.compile(r"\s*(AND|OR)(?![A-Za-z0-9])", re.I)
_NESTED = re.compile(r"\([^)]*[+*][^)]*\)[+*{]")


class Fields:
    """Names of a filter -> columns of a table; entities is a map or an array of struct(type, count)."""

    def __init__(self, columns: dict[str, Column], entities: Column | None = None, as_map: bool = True):
        self.columns, self.entities, self.as_map = columns, entities, as_map

    def field(self, name: str) -> Column:
        name = name.lower()
        if name in self.columns:
            return self.columns[name]
        if name == "entity_count" and self.entities is not None:
            counts = F.map_values(self.entities) if self.as_map else F.transform(self.entities, lambda e: e["count"])
            return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        if name not in FIELDS:
            warnings.warn(f"unknown filter field {name}", stacklevel=2)
        return F.lit(None).cast("string")

    def has(self, entity_type: str) -> Column:
        names = F.lit(None).cast("array<string>") if self.entities is None else F.map_keys(self.entities) if self.as_map else F.transform(self.entities, lambda e: e["type"])
        return F.exists(names, lambda n: F.upper(n) == entity_type.upper())


def _number(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    days = F.lit(None).cast("double")
    for unit, n in DAYS.items():
        days = F.when(F.lower(F.substring(text, -1, 1)) == unit, F.regexp_extract(text, "^([0-9]+)", 1).cast("double") * n).otherwise(days)
    return F.coalesce(F.when(text.rlike("(?i)^[0-9]+[dwmy]$"), days), exposure_rank(text).cast("double"), text.try_cast("double"), F.lit(0.0))


def _compiles(pattern: str) -> bool:
    """Whether the JVM, which will match it, takes the pattern."""
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _compare(field: Column, op: str, value: str) -> Column:
    text, given = F.lower(F.trim(field.cast("string"))), value.strip().lower()
    if op == "=":
        return text == given
    if op == "!=":
        return text != given
    if op == "contains":
        return F.contains(text, F.lit(given))
    if op == "matches":
        if len(value) > 500 or _NESTED.search(value):
            return F.lit(False)
        value = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", value.replace("(?P<", "(?<"))  # named groups as the JVM writes them
        if not _compiles(value):
            return F.lit(False)
        return (F.length(field.cast("string")) <= 1_000_000) & field.cast("string").rlike(f"(?i){value}")
    left, right = _number(field), _number(F.lit(value))
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def parse(expression: str, fields: Fields) -> Column:
    """The expression as a boolean Column; ValueError if it does not start with a condition."""
    at, out, joined = 0, None, None
    while True:
        m = _CONDITION.match(expression, at)
        if not m:
            if out is None or joined:
                raise ValueError(f"a condition is expected at {expression[at:at + 20]!r}")
            return out
        if m["f"]:
            found = fields.has(m["arg"]) if m["f"].lower() == "has" else fields.field(m["arg"]).isNull()
        else:
            value = m["value"][1:-1] if m["value"][0] in "\"'" else m["value"]
            found = _compare(fields.field(m["field"]), m["op"].lower(), value)
        found = F.coalesce(found, F.lit(False))
        out = found if out is None else (out & found) if joined == "AND" else (out | found)
        j = _JOIN.match(expression, m.end())
        if not j:
            return out
        joined, at = j[1].upper(), j.end()


def of(results: DataFrame) -> Fields:
    """The fields that a table of results has."""
    columns = {("size" if c == "size_bytes" else c): F.col(c) for c in results.columns if c != "entities"}
    kind = dict(results.dtypes).get("entities", "")
    return Fields(columns, F.col("entities") if kind else None, not kind.startswith("array"))


class Where:
    """An expression built step by step: Where("score >= 50").and_("tier = HIGH").or_has("SSN")."""

    def __init__(self, condition: str):
        self.text = self._one(condition)

    @staticmethod
    def _one(condition: str) -> str:
        m = _CONDITION.match(condition)
        if not m or condition[m.end():].strip():
            raise ValueError(f"one condition is expected, not {condition!r}")
        return condition.strip()

    def and_(self, condition: str) -> Where:
        self.text += f" AND {self._one(condition)}"
        return self

    def or_(self, condition: str) -> Where:
        self.text += f" OR {self._one(condition)}"
        return self

    def and_has(self, entity_type: str) -> Where:
        return self.and_(f"has({entity_type})")

    def or_has(self, entity_type: str) -> Where:
        return self.or_(f"has({entity_type})")

    def column(self, results: DataFrame) -> Column:
        return parse(self.text, of(results))


def criteria(min_score=None, max_score=None, tier=None, path_glob=None, file_type=None, min_size=None, max_size=None) -> Column:
    """Structured criteria on columns path, score, tier, file_type, size_bytes, error; rows with an error are out."""
    import fnmatch

    parts = [F.col("error").isNull()]
    if min_score is not None:
        parts.append(F.col("score") >= min_score)
    if max_score is not None:
        parts.append(F.col("score") <= max_score)
    if tier is not None:
        parts.append(F.upper("tier") == tier.upper())
    if path_glob is not None:
        parts.append(F.col("path").rlike("^" + fnmatch.translate(path_glob).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?s:")))
    if file_type is not None:
        parts.append(F.endswith(F.lower("path"), F.lit(file_type.lower())))
    if min_size is not None:
        parts.append(F.col("size_bytes") >= min_size)
    if max_size is not None:
        parts.append(F.col("size_bytes") <= max_size)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))
