"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

A text's words (runs of letters, digits and the like, lower-cased) give its set of WORDS-word shingles; a text with
fewer words has its word sequence as its one shingle, a text without words has none and is linked with nothing.  Texts
with equal sets are one entry with a count.  An entry has `bands` band hashes, each of `rows` minima; both are chosen
for the target recall at the least similarity.  Band hashes are shuffled, entries that share one become candidates:

  1. Each entry is compared with one other, the least that it shares a band with.  The links found join entries to
     groups, by nothing but links that hold.
  2. Within a group all pairs are compared: those of a large group of near copies once, not band by band.
  3. Entries of different groups are compared where they share a band, each pair in the first band that it shares.

All comparisons are on the full sets, dealt in blocks times blocks.  From a block come the number of links of each
entry and the edges of a spanning forest, so a group of any size is neither expanded into pairs nor kept in one task.
Links between copies count too, by the entries' counts.

Rows: null or blank text is kept and linked with nothing.  Rows that share doc_id are rows like others; a null doc_id
comes last.  Of linked rows the first by doc_id, then by a hash of the text, stays; deduplicate() keeps one of rows
alike in both.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import cut, release, scratch
from .graph import components
from .vectors import _forest

WORDS = 5
LEAST = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
#: A worker keeps the hashes of so many words, and those of one text.
MOST_KNOWN = 1 << 16

_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def choose_bands(least: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as let `bands` bands of them, `most` hashes in all, reach the recall."""
    best = None
    for rows in range(1, most + 1):
        chance = least ** rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return (x ^ (x >> np.uint64(27))) * _M1


class Shingler:
    """Text -> sorted array of distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self._known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        if not found:
            return np.empty(0, np.uint64)
        known = self._known
        if len(known) > MOST_KNOWN:
            known.clear()
        codes = np.empty(len(found), np.uint64)
        codes[:] = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found]
        n = max(1, len(found) - self.words + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.words, len(found))):
                out = _mix(out * _M1 + codes[k: k + n] + np.uint64(k + 1))
        return np.unique(out)


class Signer:
    """Shingle hashes -> band hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
            low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(low), 2048):
                a = low[at: at + 2048][None] * self.mul[:, None]
                a ^= a >> np.uint32(15)
                a += high[at: at + 2048][None] ^ self.add[:, None]
                a *= np.uint32(0x85EBCA6B)
                a ^= a >> np.uint32(13)
                np.minimum(least, a.min(axis=1), out=least)
            out = np.arange(1, self.bands + 1, dtype=np.uint64) * _M1
            for column in least.reshape(self.bands, self.rows).T.astype(np.uint64):
                out = _mix(out + column + np.uint64(1))
        return out.view(np.int64)


def _print(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """docs (id, row, text) -> id, row, mark (128-bit hash of the set; null without words), node, n_shingles, bands."""
    signer = Signer(bands, rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            marks, sizes, signed = [], [], []
            for x in batch.column(2):
                found = shingler(x.as_py())
                marks.append(_print(found) if len(found) else None)
                sizes.append(len(found))
                signed.append(signer(found) if len(found) else None)
            nodes = [None if m is None else int.from_bytes(m[:8], "little", signed=True) for m in marks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], names=["id", "row", "mark", "node", "n_shingles", "bands"])

    return docs.mapInArrow(sign, "id long, row long, mark binary, node long, n_shingles long, bands array<long>")


def _pairs(here: list, there: list, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets whose Jaccard similarity is at least `least`."""
    nx, ny = np.array([len(s) for s in here]), np.array([len(s) for s in there])
    flat = np.concatenate([*here, *there])
    owner = np.repeat(np.arange(len(here) + len(there)), np.concatenate([nx, ny]))
    _, at = np.unique(flat, return_inverse=True)
    both = np.bincount(at[owner < len(here)], minlength=at.max() + 1).clip(0, 1) & np.bincount(at[owner >= len(here)], minlength=at.max() + 1).clip(0, 1)
    column = np.cumsum(both) - 1
    keep = both[at] > 0
    owner, at = owner[keep], column[at[keep]]
    common = np.zeros((len(here), len(there)), np.float32)
    width = 4096
    order = np.argsort(at // width, kind="stable")
    owner, at = owner[order], at[order]
    edges = np.searchsorted(at // width, np.arange(0, (int(at.max()) // width + 2) if len(at) else 1))
    for low, high in zip(edges[:-1], edges[1:]):
        if high > low:
            o, c = owner[low:high], at[low:high] % width
            x, y = np.zeros((len(here), width), np.float32), np.zeros((len(there), width), np.float32)
            left = o < len(here)
            x[o[left], c[left]] = 1
            y[o[~left] - len(here), c[~left]] = 1
            common += x @ y.T
    return np.nonzero(common >= least * (nx[:, None] + ny[None] - common) - 1e-6)


def _first_shared(x: list, y: list) -> np.ndarray:
    """For each pair of band lists the place of the first band that is in both."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 65536):
        out[at: at + 65536] = (np.stack(x[at: at + 65536]) == np.stack(y[at: at + 65536])).argmax(axis=1)
    return out


def _compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The links between blocks p and q of one group; where `k` is not negative, those between members of different groups whose first shared band is the k-th."""
    p, q, k = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0]), int(pdf["k"].iloc[0])
    nodes, many, block, of = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["block"].to_numpy(), pdf["component"].to_numpy()
    found = [np.asarray(x, dtype=np.int64) for x in pdf["shingles"]]
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(left) and len(right):
        a, b = _pairs([found[i] for i in left], [found[i] for i in right], least)
        a, b = left[a], right[b]
        if p == q:
            a, b = a[a < b], b[a < b]
        if k >= 0:
            other = of[a] != of[b]
            a, b = a[other], b[other]
            if len(a):
                bands = pdf["bands"].tolist()
                here = _first_shared([bands[i] for i in a], [bands[i] for i in b]) == k
                a, b = a[here], b[here]
    counts = np.bincount(a, many[b], len(nodes)) + np.bincount(b, many[a], len(nodes))
    some = np.flatnonzero(counts)
    tree = _forest(len(nodes), a, b)
    return pd.DataFrame({
        "node": pd.Series([*nodes[some], *(nodes[x] for x, _ in tree)], dtype="int64"),
        "links": pd.Series([*counts[some].astype(np.int64), *([0] * len(tree))], dtype="int64"),
        "to": pd.Series([*([None] * len(some)), *(int(nodes[y]) for _, y in tree)], dtype="Int64"),
    })


def _classes(docs: DataFrame, key: str, text: str, words: int, least: float, recall: float, most_hashes: int) -> DataFrame:
    """docs -> id, row (hash of the text), n_shingles; for rows with words also n_links, copy_id, and the class's first id and row."""
    bands, rows = choose_bands(least, recall, most_hashes)
    release(docs.sparkSession)  # before Python workers start
    plain = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).cast("string").alias("text"))
    signed = cut(signatures(plain, bands, rows, words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    entries = cut(signed.where("mark is not null").groupBy("mark").agg(F.first("node").alias("node"), first, F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))

    banded = entries.select("node", F.posexplode("bands").alias("k", "band"))
    shared = banded.groupBy("k", "band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("k", "band", "first")
    near = cut(banded.join(shared, ["k", "band"]))
    wanted = cut(near.groupBy("node").agg(F.min("first").alias("to")))
    release(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingler(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["mark", "shingles"])

    # the texts of the candidates alone, each once: rows alike in id and text are alike in their sets
    ids = entries.join(wanted.select("node"), "node", "left_semi").select("first.id", "first.row")
    texts = plain.join(ids.select(F.col("id").alias("i"), F.col("row").alias("r")), F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left_semi").select("text").where(F.col("text").isNotNull())
    full = texts.mapInArrow(sets, "mark binary, shingles array<long>").dropDuplicates(["mark"])
    full = cut(full.join(entries.select("mark", "node", "n", "n_shingles", "bands"), "mark").drop("mark"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                common = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(common >= least * (len(u) + len(v) - common) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    one = wanted.where("node <> to").join(full.select("node", F.col("shingles").alias("x")), "node").join(full.select(F.col("node").alias("to"), F.col("shingles").alias("y")), "to")
    groups = components(one.select(F.col("node").alias("a"), F.col("to").alias("b"), "x", "y").mapInArrow(linked, "a long, b long"))
    members = cut(full.select("node", "n_shingles").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))

    many = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    inside = members.join(members.groupBy("component").agg(many, F.count("*").alias("c")).where("c > 1").drop("c"), "component").select("node", "component", F.lit(-1).alias("k"), F.col("component").alias("band"), "blocks")
    meeting = near.select("node", "k", "band").join(members, "node")
    mixed = meeting.groupBy("k", "band").agg(many, F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"), *[F.sum(F.xxhash64(F.lit(x), "node").cast("decimal(38,0)")).alias(f"s{x}") for x in (1, 2)]).where("low <> high")
    # bands that bring the same entries together are one: the first, where pairs are counted anyway
    mixed = mixed.groupBy("low", "high", "c", "s1", "s2").agg(F.min(F.struct("k", "band", "blocks")).alias("f")).select("f.*")
    across = meeting.join(mixed, ["k", "band"]).select("node", "component", "k", "band", "blocks")
    placed = inside.unionByName(across).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = placed.join(full.select("node", "n", "shingles", "bands"), "node")
    dealt = dealt.select("k", "band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "component", "node", "n", "shingles", F.when(F.col("k") >= 0, F.col("bands")).alias("bands"))
    found = cut(dealt.groupBy("k", "band", "p", "q").applyInPandas(lambda pdf: _compare(pdf, least), "node long, links long, to long"))

    joined = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = cut(entries.select("mark", "node", "first", "n").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    known = of.join(of.groupBy("component").agg(F.min("first").alias("top")), "component").select(
        "mark", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("first.id").alias("copy_id"), F.col("top.id").alias("class_id"), F.col("top.row").alias("class_row"))
    return cut(signed.select("id", "row", "mark", "n_shingles").join(known, "mark", "left").drop("mark"), keep=True)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """docs -> key, copy_id (first id with an equal set), class_id (first id that links reach), n_links, n_shingles, kept."""
    kind = docs.schema[key].dataType.simpleString()
    with scratch(docs.sparkSession):
        rows = _classes(docs, key, text, words, least, recall, most_hashes)
    free = F.col("n_links").isNull()
    return rows.select(
        F.col("id").cast(kind).alias(key), F.when(free, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(free, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", (free | _is_first()).alias("kept"))


def _is_first():
    return F.col("id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """docs without those that are linked to an earlier one; of rows alike in id and text one stays, unless they have no words."""
    with scratch(docs.sparkSession):
        rows = _classes(docs, key, text, words, least, recall, most_hashes).where("n_links is not null")
        gone = cut(rows.where(~_is_first()).select(F.col("id").alias("_id_of_gone"), F.col("row").alias("_mark_of_gone")).distinct(), keep=True)
        again = cut(rows.where(_is_first()).groupBy("id", "row").count().where("count > 1").select(F.col("id").alias("_id_of_gone"), F.col("row").alias("_mark_of_gone")), keep=True)
    marked = docs.withColumn("_mark_of_text", F.xxhash64(text))
    same = F.col(key).cast("long").eqNullSafe(F.col("_id_of_gone")) & (F.col("_mark_of_text") == F.col("_mark_of_gone"))
    kept = marked.join(gone, same, "left_anti")
    if again.limit(1).count():
        kept = kept.join(again, same, "left_anti").unionByName(marked.join(again, same, "left_semi").dropDuplicates([key, "_mark_of_text"]))
    return kept.select(*docs.columns)
