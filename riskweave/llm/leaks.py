"""Benchmark decontamination by latent semantic retrieval.

  1. The words of all benchmark items are the vocabulary; in how many documents each occurs is counted over all
     documents, which gives its inverse document frequency (IDF).
  2. Items are cut into passages of PASSAGE words at most.  The TF-IDF matrix of each shard of SHARD passages gets a
     randomised SVD on an executor: a random projection, refined by POWER multiplications, of as many dimensions as it
     takes until no passage has more than SLACK of its norm outside; how much it has is kept with it.
  3. Every document is read whole as overlapping windows of 2 or 3 blocks of BLOCK words, the latter for passages of
     more than SHORT words.  Windows and passages are compared in the latent space; one whose cosine with a passage
     reaches COSINE, less what the passage has outside, is a candidate for the passage's item.  So no pair whose cosine
     in the full space reaches COSINE is lost, however many items there are.  Windows whose words could not reach
     COSINE with any passage, by each word's largest weight in some groups of them, are not projected.
  4. A candidate leaks the item if a stretch of the text, not much longer than the item, holds LEAST of the item's words
     as a longest common subsequence (all of them if the item has fewer than 8) and ANSWER of the item's answer, its
     last sentence or what follows its last answer mark; the text around the stretch must hold words with WEIGHT of the
     item's IDF.  Each stretch that starts with a word of the item is looked at.

The benchmark is a query set, taken in groups of some GROUP distinct items; the vocabulary, latent space and items of one
group are what is sent to the executors.  Rows: null text of a document is clean; items without a word match nothing;
items that repeat are all reported; an empty benchmark leaves all clean; null item_id is reported as an empty name.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 16
PASSAGE = 48
SHORT = 17
SHARD = 256
POWER = 2
SLACK = 0.1
COSINE = 0.2
FEW = 0.15
AROUND = 48
WEIGHT = 0.5
LEAST = 0.6
ANSWER = 0.5
GROUP = 4000
PART = 1 << 14

_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"(?:answer|antwort|réponse|respuesta|solution)\s*[:=]", re.I)
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def answer_of(text: str) -> list[str]:
    """The words after the last answer mark, else of the last sentence; of at least three words where the item has them."""
    marks = list(_ANSWER.finditer(text))
    if marks and words(text[marks[-1].end():]):
        return words(text[marks[-1].end():])
    out: list[str] = []
    for part in reversed(_SENTENCE.split(text)):
        out = words(part) + out
        if len(out) >= 3:
            break
    return out


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Item:
    __slots__ = ("name", "words", "answer", "need", "counts", "known", "total", "width", "signature", "few")

    def __init__(self, name, text: str, vocabulary: dict, idf: np.ndarray):
        self.name = name
        self.words = [vocabulary[w] for w in words(text)]
        self.answer = [vocabulary[w] for w in answer_of(text)]
        n = len(self.words)
        self.need = n if n < 8 else -int(-LEAST * n // 1)
        self.width = n + max(4, n // 2)
        counts = self.counts = Counter(self.words)
        self.known = frozenset(counts)
        self.total = float(idf[list(counts)].sum())
        most = self.need - max(1, int(FEW * n))  # so many of the words needed may be common ones
        rest, self.signature = 0, []
        for w in sorted(counts, key=lambda w: (idf[w], w)):
            if not self.signature and rest + counts[w] <= most:
                rest += counts[w]
            else:
                self.signature.append(w)
        self.few = self.need - rest


class Shard:
    """The latent space of some passages: for each word of theirs its coordinates, for each passage its own and how much of its norm they leave out."""

    def __init__(self, passages: list[tuple[int, list[int]]], idf: np.ndarray):
        self.owner = np.array([k for k, _ in passages], np.int64)
        self.wide = np.array([len(x) > SHORT for _, x in passages])
        self.words, at = np.unique(np.concatenate([x for _, x in passages]), return_inverse=True)
        self.matrix = np.zeros((len(passages), len(self.words)), np.float32)  # passages of unit length
        np.add.at(self.matrix, (np.repeat(np.arange(len(passages)), [len(x) for _, x in passages]), at), 1)
        self.matrix *= idf[self.words].astype(np.float32)
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)

    def project(self, idf: np.ndarray) -> None:
        a, rank = self.matrix, 32
        rng = np.random.default_rng(23)
        while True:
            rank = min(2 * rank, *a.shape)
            q = np.linalg.qr(a.T @ rng.standard_normal((len(a), min(rank + 8, *a.shape))).astype(np.float32))[0]
            for _ in range(POWER):
                q = np.linalg.qr(a.T @ (a @ q))[0]
            basis = q @ np.linalg.svd(a @ q, full_matrices=False)[2].T[:, :rank]
            latent = a @ basis
            self.outside = np.sqrt(np.maximum(0, 1 - (latent * latent).sum(axis=1)))
            if rank == min(a.shape) or self.outside.max() <= SLACK:
                break
        enough = max(1, int(np.argmax(np.sqrt(np.maximum(0, 1 - np.cumsum(latent * latent, axis=1))).max(axis=0) <= SLACK)) + 1) if self.outside.max() <= SLACK else rank
        self.latent = latent[:, :enough]
        self.outside = np.sqrt(np.maximum(0, 1 - (self.latent * self.latent).sum(axis=1))) + 1e-4
        self.map = np.vstack([basis[:, :enough] * idf[self.words].astype(np.float32)[:, None], np.zeros((1, enough), np.float32)])
        del self.matrix

    def index(self, vocabulary: int) -> None:
        """Where each word of the whole vocabulary is among this shard's words; the last place has those that are not."""
        self.place = np.full(vocabulary + 1, len(self.words), np.int32)
        self.place[self.words] = np.arange(len(self.words))


class Model:
    """Vocabulary, items, passages and their latent spaces, of one group."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], n_docs: int):
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in items for w in words(t)}))}
        self.idf = np.array([np.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 0.05 for w in self.vocabulary], np.float64)
        self.weights = self.idf.tolist()
        self.items = [Item(name, text, self.vocabulary, self.idf) for name, text in items if words(text)]
        self.known = np.zeros(len(self.vocabulary) + 1, bool)  # of the item that is looked at
        passages = [(k, x.words[at: at + PASSAGE]) for k, x in enumerate(self.items) for at in range(0, max(1, len(x.words) - BLOCK + 1), PASSAGE)]
        passages.sort(key=lambda x: len(x[1]) > SHORT)  # short ones together
        self.shards = [Shard(passages[at: at + SHARD], self.idf) for at in range(0, len(passages), SHARD)]
        other = self.idf.mean() if self.items else 1.0  # of words that no item has
        self.value = np.append(self.idf, other)
        self.square = (self.value ** 2).astype(np.float32)
        self.reach = {wide: self._reach(wide) for wide in (False, True)}

    def _reach(self, wide: bool) -> np.ndarray | None:
        """For each word the most that it can add to a window's product with a passage of each of some groups of passages."""
        rows = [(x, k) for x in self.shards for k in np.flatnonzero(x.wide == wide).tolist()]
        if not rows:
            return None
        groups = min(len(rows), max(16, min(64, len(rows) // 12)))
        out = np.zeros((len(self.vocabulary) + 1, groups), np.float32)
        for g in range(groups):
            for x, k in rows[g::groups]:
                out[x.words, g] = np.maximum(out[x.words, g], x.matrix[k])
        return out * self.value[:, None].astype(np.float32)

    def ready(self, shards: list[Shard]) -> None:
        self.shards = shards
        for x in shards:
            x.index(len(self.vocabulary))

    def candidates(self, codes: np.ndarray) -> set[int]:
        """Items with a passage that a window of the text is like."""
        out: set[int] = set()
        blocks = -(-len(codes) // BLOCK)
        first = np.arange(0, len(codes), BLOCK)
        square = np.append(0, np.cumsum(np.add.reduceat(self.square[codes], first, dtype=np.float64)))
        for width, wide in ((2, False), (3, True)):
            if self.reach[wide] is None:
                continue
            reach = np.add.reduceat(self.reach[wide][codes], first, axis=0)
            reach = np.vstack([np.zeros((1, reach.shape[1])), np.cumsum(reach, axis=0, dtype=np.float64)])
            start = np.arange(max(1, blocks - width + 1))
            end = np.minimum(start + width, blocks)
            some = start[(reach[end] - reach[start]).max(axis=1) + 1e-3 >= COSINE * np.sqrt(square[end] - square[start])]
            for low in range(0, len(some), 64):
                at = some[low: low + 64, None] * BLOCK + np.arange(width * BLOCK)
                self._search(np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], -1), wide, out)
        return out

    def _search(self, windows: np.ndarray, wide: bool, out: set) -> None:
        """windows: rows of word codes, -1 behind the text's end."""
        other = len(self.vocabulary)
        codes = np.sort(np.where(windows < 0, other, windows), axis=1)
        weight = np.where(np.sort(windows < 0, axis=1), 0, self.value[codes])  # what is behind the end weighs nothing
        new = np.ones(codes.shape, bool)
        new[:, 1:] = (codes[:, 1:] != codes[:, :-1]) | (codes[:, 1:] == other)
        run = np.cumsum(new.ravel()) - 1
        times = np.bincount(run)[run].reshape(codes.shape)  # a word that comes n times weighs n times
        size = np.sqrt((times * weight * weight).sum(axis=1))[:, None]
        for shard in self.shards:
            if (shard.wide == wide).any():
                latent = shard.map[shard.place[codes]].sum(axis=1)
                hit = (latent @ shard.latent.T >= (COSINE - shard.outside) * size) & (shard.wide == wide)
                out.update(shard.owner[np.flatnonzero(hit.any(axis=0))].tolist())

    def scan(self, text: str | None) -> dict:
        """Item number -> share of its words that the text has, for the items that the text leaks."""
        found = words(text)
        if not found:
            return {}
        codes = np.array(list(map(self.vocabulary.get, found, repeat(len(self.vocabulary)))), np.int64)
        some: set = set()
        for start in range(0, len(codes), PART):  # very long texts by parts, which overlap by a window
            some |= self.candidates(codes[start: start + PART + 3 * BLOCK])
        shares = {k: self.check(self.items[k], codes) for k in sorted(some)}
        return {k: share for k, share in shares.items() if share}

    def check(self, item: Item, codes: np.ndarray) -> float:
        n = len(item.words)
        mine = list(item.known)
        self.known[mine] = True
        places = np.flatnonzero(self.known[codes])
        self.known[mine] = False
        self.known[item.signature] = True
        few = np.append(0, np.cumsum(self.known[codes[places]]))
        self.known[item.signature] = False
        ends = np.searchsorted(places, places + item.width)
        starts = np.arange(len(places))
        starts = np.flatnonzero((ends - starts >= item.need) & (few[ends] - few[starts] >= item.few))
        seen = codes[places].tolist()
        most = low = high = shared = 0
        free = item.counts.copy()  # how often the stretch may still hold each word
        for k, end in zip(starts.tolist(), ends[starts].tolist()):
            if k >= high:
                free, low, high, shared = item.counts.copy(), k, k, 0
            for w in seen[high: end]:
                free[w] -= 1
                shared += free[w] >= 0
            for w in seen[low: k]:
                shared -= free[w] >= 0
                free[w] += 1
            low, high = k, end
            if shared < item.need or shared <= most:
                continue
            part = seen[k: end]
            common = lcs(item.words, part)
            if common > most and common >= item.need and lcs(item.answer, part) >= ANSWER * len(item.answer):
                around = AROUND + 2 * n
                held = item.known.intersection(codes[max(0, places[k] - around): places[k] + around].tolist())
                if (len(held) >= 2 or len(item.known) <= 2) and sum(map(self.weights.__getitem__, held)) >= WEIGHT * item.total:
                    most = common
                    if most == n:
                        break
        return most / n


def _vocabulary(items: DataFrame) -> frozenset:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({w for x in batch.column(0) for w in words(x.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    return frozenset(r["w"] for r in items.select("text").mapInArrow(split, "w string").distinct().collect())  # as large as the benchmark's vocabulary


def _counts(docs: DataFrame, vocabulary: frozenset) -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total[None] += batch.num_rows
            for x in batch.column(0):
                total.update(vocabulary.intersection(words(x.as_py())))
        yield pa.RecordBatch.from_pydict({"w": list(total), "n": list(total.values())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    found = {r["w"]: r["n"] for r in docs.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}  # a row a word
    return found, found.pop(None, 0) or 0


def _project(docs: DataFrame, model: Model) -> None:
    """The latent spaces of all shards, each found on an executor."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(model.idf)
    rows = spark.createDataFrame([(k, pickle.dumps(x)) for k, x in enumerate(model.shards)], "k int, shard binary").repartition(max(1, len(model.shards)), "k")

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = pickle.loads(data)
                shard.project(idf.value)
                yield pa.RecordBatch.from_pydict({"k": [k], "shard": [pickle.dumps(shard)]}, schema=pa.schema([("k", pa.int32()), ("shard", pa.binary())]))

    done = {r["k"]: pickle.loads(r["shard"]) for r in rows.mapInArrow(decompose, "k int, shard binary").toLocalIterator()}
    model.ready([done[k] for k in sorted(done)])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", group: int = GROUP) -> DataFrame:
    """docs -> key, row (tells apart rows that share the key), contaminated, n_items, items (sorted, comma-joined), share (largest)."""
    plain = docs.select(key, F.xxhash64(text).alias("row"), F.col(text).cast("string").alias("_rw_text"))
    clean = plain.drop("_rw_text").schema.add("items", T.ArrayType(T.StringType())).add("share", "double")
    rows = benchmark.select(F.col(item).cast("string").alias("name"), F.col(passage).cast("string").alias("text")).where("text is not null").distinct()
    marked = rows.withColumn("h", F.pmod(F.xxhash64("name", "text"), F.lit(1 << 30)))
    groups = max(1, -(-marked.count() // group))
    vocabulary = _vocabulary(rows)
    frequency, n_docs = _counts(plain.select("_rw_text"), vocabulary) if vocabulary else ({}, 0)
    out = None
    for g in range(groups):
        part = [(r["name"] or "", r["text"]) for r in marked.where(F.col("h") % groups == g).select("name", "text").collect()]
        model = Model(sorted(part), frequency, n_docs)
        if model.shards:
            _project(docs, model)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                items, shares = [], []
                for x in batch.column(2):
                    found = model.scan(x.as_py()) if model.items else {}
                    items.append([model.items[k].name for k in found])
                    shares.append(max(found.values(), default=0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.string())), pa.array(shares, pa.float64())], names=[key, "row", "items", "share"])

        found = plain.mapInArrow(scan, clean)
        out = found if out is None else out.unionByName(found)
    if groups > 1:
        out = out.groupBy(key, "row").agg(F.flatten(F.collect_list("items")).alias("items"), F.max("share").alias("share"), (F.count("*") / groups).cast("int").alias("alike"))
        out = out.withColumn("alike", F.explode(F.sequence(F.lit(1), "alike")))
    items = F.transform(F.array_sort(F.transform(F.array_distinct("items"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])
    return out.select(key, "row", (F.size("items") > 0).alias("contaminated"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.array_join(items, ",").alias("items"), "share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that hold benchmark items."""
    gone = find(docs, benchmark, key, text, **options).where("contaminated").select(F.col(key).alias("_rw_key"), F.col("row").alias("_rw_row")).distinct()
    marked = docs.withColumn("_rw_mark", F.xxhash64(text))
    return marked.join(gone, F.col(key).eqNullSafe(F.col("_rw_key")) & (F.col("_rw_mark") == F.col("_rw_row")), "left_anti").drop("_rw_mark")
