"""License scans: an exact set-similarity join of text blocks with license templates.

Base labels come from phrases: the places where a phrase's words stand one after another.  The join adds labels: all
tokens of the templates are ordered by how many documents hold them; a template's prefix is its |T| - ceil(t |T|) + 1
rarest tokens, and a block that holds at least t of the template holds one of these.  The places of prefix tokens are
the candidates; a block is the words of the text within |T| words of such a place, also over line ends, as notices are
wrapped.  Length filter: blocks with fewer than ceil(t |T|) words fall out; positional filter: so do those whose k-th
prefix token leaves fewer than that many tokens behind it.  Then the containment is counted in full.

Words are the runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased.  Null text
is empty; texts are read whole; repeated rows are rows like others; extra columns are ignored.  Templates and phrases
are fixed tables, so what is sent to the executors is bounded.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The templates' words and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
)
THRESHOLD = 0.8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


def frequencies(docs: DataFrame, tokens: list[str], text: str = "text") -> dict[str, int]:
    """How many documents hold each token, counted over all documents."""
    known = frozenset(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for x in batch.column(0):
                for w in known.intersection(words(x.as_py())):
                    total[w] += 1
        yield pa.RecordBatch.from_pydict({"token": list(total), "n": list(total.values())}, schema=pa.schema([("token", pa.string()), ("n", pa.int64())]))

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in found.collect()}  # a row for each template token at most


class Scanner:
    """Phrases and templates, made ready for one text after another."""

    def __init__(self, frequency: dict[str, int], phrases: dict = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD):
        self.phrases = defaultdict(list)
        for phrase, label in phrases.items():
            w = tuple(phrase.split())
            anchor = min(range(len(w)), key=lambda k: (frequency.get(w[k], 0), k))
            self.phrases[w[anchor]].append((anchor, w, label))
        self.prefixes = defaultdict(list)
        for text, label in templates:
            w = text.split()
            tokens = sorted(set(w), key=lambda x: (frequency.get(x, 0), x))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for k, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefixes[token].append((frozenset(tokens), need, len(w), len(tokens) - k, label))
        self.anchors = frozenset(self.phrases) | frozenset(self.prefixes)

    def scan(self, text: str | None) -> tuple:
        w = words(text)
        hits = self.anchors.intersection(w)
        if not hits:
            return len(w), 0, None, None, "", "", 0.0
        places = [k for k, x in enumerate(w) if x in hits]
        starts, labels = [], set()
        for k in places:
            for at, phrase, label in self.phrases.get(w[k], ()):
                if k >= at and tuple(w[k - at: k - at + len(phrase)]) == phrase:
                    starts.append(k - at)
                    labels.add(label)
        found, score = set(labels), 1.0 if labels else 0.0
        for k in places:
            for tokens, need, length, behind, label in self.prefixes.get(w[k], ()):
                low, high = max(0, k - length), k + length + 1
                if behind < need or min(high, len(w)) - low < need:
                    continue
                share = len(tokens.intersection(w[low:high]))
                if share >= need:
                    found.add(label)
                    score = max(score, share / len(tokens))
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), score


def scan(docs: DataFrame, key: tuple = ("doc_id",), text: str = "text", phrases: dict = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs -> the key columns and RESULT."""
    tokens = sorted({w for x in [*phrases, *(t for t, _ in templates)] for w in x.split()})
    scanner = Scanner(frequencies(docs, tokens, text), phrases, templates, threshold)
    kept = docs.select(*key, F.col(text).cast("string").alias("_text"))
    schema = kept.drop("_text").schema
    for column in RESULT.split(", "):
        schema = schema.add(*column.split(" "))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    return kept.mapInArrow(rows, schema)
