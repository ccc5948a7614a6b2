"""Dictionary matching: many terms against many texts in one pass per text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

MIN_LENGTH = 4
CONFIDENCE = 0.80
#: So many terms are sent to the executors at once; a larger dictionary is taken in parts.
MOST_TERMS = 200_000


def load(spark: SparkSession, path: str, entity_type: str, min_length: int = MIN_LENGTH, deny: tuple = ()) -> DataFrame:
    """A file with one term a line -> term, entity_type; `#` starts a comment, short and denied terms go."""
    term = F.lower(F.trim("value"))
    rows = spark.read.text(path).select(term.alias("term")).where((F.length("term") >= min_length) & ~F.col("term").startswith("#"))
    return (rows.where(~F.col("term").isin(*deny)) if deny else rows).distinct().withColumn("entity_type", F.lit(entity_type))


class Matcher:
    def __init__(self, terms: list[tuple[str, str]]):
        self.types = {}
        for term, kind in terms:
            self.types.setdefault(term, kind)
        if ahocorasick and self.types:
            self.machine = ahocorasick.Automaton()
            for term in self.types:
                self.machine.add_word(term, term)
            self.machine.make_automaton()
        else:
            self.machine = re.compile("|".join(re.escape(t) for t in sorted(self.types, key=len, reverse=True)) or r"(?!)")

    def places(self, low: str) -> Iterator[tuple[int, str]]:
        if ahocorasick and self.types:
            for end, term in self.machine.iter(low):
                yield end + 1 - len(term), term
        else:
            yield from ((m.start(), m[0]) for m in self.machine.finditer(low))

    def __call__(self, text: str) -> list[dict]:
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: places would shift
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for start, term in self.places(low):
            end = start + len(term)
            if (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
                out.append({"start": start, "end": end, "text": text[start:end], "entity_type": self.types[term], "confidence": CONFIDENCE, "detector": "dictionary", "tier": 1, "rule_ord": 10_000})
        return out


def matches(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_TERMS) -> DataFrame:
    """docs -> a span for each place where a term stands between word edges."""
    from .refine import refine

    parts = max(1, -(-terms.count() // most))
    out = None
    for k in range(parts):
        here = [(r["term"], r["entity_type"]) for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select("term", "entity_type").orderBy("term", "entity_type").collect()]
        matcher = docs.sparkSession.sparkContext.broadcast(here)
        made: list = []

        def step(t: str, spans: list[dict], matcher=matcher, made=made) -> list[dict]:
            if not made:
                made.append(Matcher(matcher.value))
            return made[0](t)

        found = refine(docs, None, [step], key, text)
        out = found if out is None else out.unionByName(found)
    return out
