"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, drawn from its code point; a run of three letters is bound as
rot(rot(a)) * rot(b) * c, with rot a fixed cyclic shift; a text is the sum (bundle) of its runs' vectors, a language
the sum of its texts' unit vectors.  A text gets the language whose prototype has the largest cosine with it; ties go
to the first language in code point order.  Whole texts are read, lower-cased, with every run of other characters as
one blank.

The prototypes are fitted on at most `bound` labelled rows of each language, chosen by a hash of doc_id and text; that
is the one sample here.  Null text, or text without a letter: `und`, score 0.  Null lang is no label.  Without any
label all is `und`.  Extra columns are kept out; repeated rows are rows like others; very long texts are cut nowhere,
they are counted piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 2048
BOUND = 4000
_PIECE = 1 << 21

RESULT = "doc_id long, lang_pred string, score double"


@lru_cache(maxsize=4096)
def _letter(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng([20240607, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def _bound_vectors(runs: np.ndarray, dims: int) -> np.ndarray:
    """(n, 3) code points -> n x dims."""
    letters, at = np.unique(runs, return_inverse=True)
    base = np.stack([_letter(int(c), dims) for c in letters])
    a, b, c = at.reshape(runs.shape).T
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one 32, with one at both ends; empty if no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return raw[:0]
    code = np.where(letter, raw, 32)
    code = np.concatenate([[32], code, [32]]).astype(np.uint32)
    return code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]


def bundles(texts: list, dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each text, and whether it has a letter."""
    out, has = np.zeros((len(texts), dims), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    group, size = [], 0
    for k, text in enumerate(texts):
        code = _codes(text) if text else np.empty(0, np.uint32)
        has[k] = len(code) > 0
        for at in range(0, max(0, len(code) - 2), _PIECE):
            piece = code[at: at + _PIECE + 2]
            group.append((k, piece))
            size += len(piece)
            if size >= _PIECE:
                _count(group, out, dims)
                group, size = [], 0
        if len(group) >= 128:
            _count(group, out, dims)
            group, size = [], 0
    if group:
        _count(group, out, dims)
    return out, has


def _count(group: list, out: np.ndarray, dims: int) -> None:
    flat = np.concatenate([x for _, x in group])
    owner = np.repeat(np.arange(len(group)), [len(x) for _, x in group])
    letters = np.unique(flat)
    n = len(letters)
    at = np.searchsorted(letters, flat).astype(np.int64)
    run = (at[:-2] * n + at[1:-1]) * n + at[2:]
    same = owner[2:] == owner[:-2]
    run, owner = run[same], owner[2:][same]
    if n ** 3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(run, minlength=n ** 3))
        place = np.zeros(n ** 3, dtype=np.int64)
        place[seen] = np.arange(len(seen))
        run = place[run]
    else:
        seen, run = np.unique(run, return_inverse=True)
    codes = np.stack([letters[seen // (n * n)], letters[seen // n % n], letters[seen % n]], axis=1)
    owners = np.array([k for k, _ in group])
    for low in range(0, len(seen), 8192):  # runs by parts, so that memory is bounded whatever the script
        part = (run >= low) & (run < low + 8192) if len(seen) > 8192 else slice(None)
        width = min(8192, len(seen) - low)
        counts = np.bincount(owner[part] * width + (run[part] - low), minlength=len(group) * width).reshape(len(group), width).astype(np.float32)
        vectors = _bound_vectors(codes[low: low + width], dims).astype(np.float32)
        np.add.at(out, owners, counts @ vectors)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bound: int = BOUND, dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Labelled rows -> prototype of each language; at most about `bound` rows of each are used, evenly by hash."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, bound / n))]), F.col("lang")), F.lit(0.0))
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                vectors = _unit(bundles(texts[at: at + 512], dims)[0])
                for name in set(langs[at: at + 512]):
                    of = [k for k, x in enumerate(langs[at: at + 512]) if x == name]
                    total[name] = total.get(name, 0) + vectors[of].sum(axis=0, dtype=np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dims, "i": list(range(dims)), "v": v.tolist()}, schema=pa.schema([("lang", pa.string()), ("i", pa.int32()), ("v", pa.float64())]))

    out: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(sums, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["v"]
    return {k: out[k] for k in sorted(out) if np.linalg.norm(out[k]) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: list[str] | tuple = ("doc_id",), text: str = "text", dims: int = DIMENSIONS) -> DataFrame:
    """docs -> the key columns, lang_pred and score (the cosine, at least 0)."""
    names = list(prototypes)
    matrix = _unit(np.stack([prototypes[k] for k in names])).astype(np.float32) if names else np.zeros((0, dims), np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, matrix))  # languages x dims
    kept = docs.select(*key, F.col(text).cast("string").alias("_text"))
    schema = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors, has = bundles(part.column(part.num_columns - 1).to_pylist(), dims)
                if names:
                    cosine = _unit(vectors) @ matrix.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
                else:
                    has[:] = False
                pred = [names[best[k]] if has[k] else "und" for k in range(len(has))]
                points = [float(score[k]) if has[k] else 0.0 for k in range(len(has))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(points, pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of the fit: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
