"""Near-duplicate vectors through an inverted multi-index.

Vectors are scaled to length 1 and split into halves; each half has its own codebook (k-means, fitted on at most SAMPLE
vectors chosen by hash), and the pairs of codewords form a grid of cells.  Every vector is kept in the cell of its
nearest codewords.  As a query it goes through the cells in the order of how far it would have to move to get there
(multi-sequence order over the two halves' sorted lists) and stops when a neighbour at the least similarity would have
to move more than `reach` standard deviations of a random direction: the target recall fixes `reach`.  In a visited cell
the cosine is computed for all its vectors in double precision.

Equal vectors are one entry with a count.  Cells are dealt in blocks of BLOCK residents times BLOCK visitors, so that a
cell with a third of all vectors is many tasks of bounded size.  A pair that both ends find is counted in the cell with
the smaller number.  What leaves a block is, for each vector, its number of links, and the edges of a spanning forest.

Vectors are compared with those of their own length.  Each of the MOST_LENGTHS most frequent lengths has an index, its
codebooks growing with its number of vectors to MOST_WORDS words; a length beyond these, or with few vectors, is one
cell, in which all are compared.

Rows: null, zero and non-finite vectors link with nothing: their component is their own id.  Rows that share vec_id and vector are linked with each other like any equal vectors.  Null vec_id is
allowed; it is no component's id unless nothing else is there.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import cut, scratch
from .graph import components

SAMPLE = 20_000
BLOCK = 4096
RECALL = 0.9999
PER_CELL = 512
MOST_WORDS = 512
MOST_LENGTHS = 32


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - 0.5 * (centers ** 2).sum(1)).argmax(1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _margins(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row; and how far the row lies from the border to each other codeword's region."""
    score = x @ centers.T - 0.5 * (centers ** 2).sum(1)
    near = score.argmax(1)
    gap = np.sqrt(np.maximum(((centers[near][:, None, :] - centers[None]) ** 2).sum(2), 1e-24))
    return near, (score[np.arange(len(x)), near][:, None] - score) / gap


class MultiIndex:
    """The two codebooks, and which cells a vector visits."""

    def __init__(self, sample: np.ndarray, cells: int, least: float, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        k = int(max(1, min(MOST_WORDS, round(math.sqrt(cells)))))
        self.books = [_kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half:], k)]
        self.size = len(self.books[0]), len(self.books[1])
        radius = math.sqrt(2 - 2 * least)
        # a neighbour's offset has the radius as its length at most; along a given direction it is normal with this deviation
        self.reach = radius * min(1.0, NormalDist().inv_cdf(recall) / math.sqrt(max(1, sample.shape[1])))

    def home(self, x: np.ndarray) -> np.ndarray:
        near = [(h @ b.T - 0.5 * (b ** 2).sum(1)).argmax(1) for h, b in zip((x[:, : self.half], x[:, self.half:]), self.books)]
        return near[0] * self.size[1] + near[1]

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each row the cells within reach, nearest first."""
        (_, m1), (_, m2) = _margins(x[:, : self.half], self.books[0]), _margins(x[:, self.half:], self.books[1])
        o1, o2 = np.argsort(m1, axis=1, kind="stable"), np.argsort(m2, axis=1, kind="stable")
        for k in range(len(x)):
            a, b = m1[k][o1[k]], m2[k][o2[k]]
            a, b = a[: np.searchsorted(a, self.reach, "right")], b[: np.searchsorted(b, self.reach, "right")]
            square = a[:, None] ** 2 + b[None] ** 2
            i, j = np.nonzero(square <= self.reach ** 2)
            order = np.argsort(square[i, j], kind="stable")
            yield (o1[k][i] * self.size[1] + o2[k][j])[order]

    def reaches(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether row k visits cells[k]."""
        (_, m1), (_, m2) = _margins(x[:, : self.half], self.books[0]), _margins(x[:, self.half:], self.books[1])
        at = np.arange(len(x))
        return m1[at, cells // self.size[1]] ** 2 + m2[at, cells % self.size[1]] ** 2 <= self.reach ** 2


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links a-b join, n - 1 at most."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vectors -> key, n_links, component_id, kept."""
    kind = vectors.schema[key].dataType.simpleString()
    with scratch(vectors.sparkSession):
        found = _links(vectors, key, embedding, least, recall, sample, block)
    return found.select(F.col("id").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
                        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))


def _links(vectors: DataFrame, key: str, embedding: str, least: float, recall: float, sample: int, block: int) -> DataFrame:
    """vectors -> id, n_links, component_id; the latter null where nothing is to be compared."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # rows that are equal are one entry, whose node number is a hash of the vector
    rows = cut(raw.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    entries = rows.where("v is not null").groupBy("node").agg(F.first("v").alias("v"), F.min("id").alias("least_id"), F.count("*").alias("n"))
    entries = cut(entries)
    lengths = entries.groupBy(F.size("v").alias("d")).count().where(F.col("count") >= 4 * PER_CELL).orderBy(F.desc("count"), "d").limit(MOST_LENGTHS).collect()
    indexes = {}
    for r in lengths:
        share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < math.ceil(min(1.0, sample / r["count"]) * (1 << 20))
        taken = entries.where((F.size("v") == r["d"]) & share).select("v").limit(2 * sample).collect()
        if taken:
            indexes[r["d"]] = MultiIndex(_unit([x["v"] for x in taken]), r["count"] // PER_CELL, least, recall)
    shared = spark.sparkContext.broadcast(indexes)  # for each length at most 2 x MOST_WORDS x half the dimensions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = part.column(1).to_pylist()
                of = np.array([len(v) for v in found], np.int64)
                home, visits = of << 32, [np.array([d << 32]) for d in of]  # a cell's number starts with the vectors' length
                for d in np.unique(of).tolist():
                    if d in shared.value:
                        here = np.flatnonzero(of == d)
                        x = _unit([found[k] for k in here])
                        home[here] += shared.value[d].home(x)
                        for k, cells in zip(here, shared.value[d].visits(x)):
                            visits[k] = visits[k] + cells
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(home), pa.array(visits, pa.list_(pa.int64()))], names=["node", "v", "n", "home", "visits"])

    placed = cut(entries.select("node", "v", "n").mapInArrow(place, "node long, v array<double>, n long, home long, visits array<long>"))
    living = placed.groupBy("home").agg(F.count("*").alias("residents")).select(F.col("home").alias("cell"), "residents")
    coming = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    grid = cut(living.join(coming, "cell").select("cell", F.ceil(F.col("residents") / block).alias("rows"), F.ceil(F.col("visitors") / block).alias("columns")))
    salt = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stay = placed.select("node", "v", "n", "home", F.col("home").alias("cell"), F.lit(True).alias("resident")).join(grid, "cell").withColumn("r", salt("rows")).withColumn("c", span("columns"))
    visit = placed.select("node", "v", "n", "home", F.explode("visits").alias("cell")).withColumn("resident", F.lit(False)).join(grid, "cell").withColumn("c", salt("columns")).withColumn("r", span("rows"))
    both = stay.select("cell", "r", "c", "node", "v", "n", "home", "resident").unionByName(visit.select("cell", "r", "c", "node", "v", "n", "home", "resident"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        index = shared.value.get(cell >> 32)  # without one the length is one cell
        here, come = pdf[pdf["resident"]], pdf[~pdf["resident"]]
        out = {"node": [], "links": [], "to": []}
        if len(here) and len(come):
            x, y = _unit(here["v"]), _unit(come["v"])
            hn, cn, home, many_h, many_c = here["node"].to_numpy(), come["node"].to_numpy(), come["home"].to_numpy(), here["n"].to_numpy(), come["n"].to_numpy()
            count_h, count_c, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
            for at in range(0, len(y), 512):
                p, q = np.nonzero((x @ y[at: at + 512].T) >= least)
                q += at
                # of two in one cell the pair comes twice; of two in different cells twice if both go to the other's
                once = np.where(home[q] == cell, hn[p] < cn[q], True)
                p, q = p[once], q[once]
                other = np.flatnonzero(home[q] < cell)
                for low in range(0, len(other), 8192):
                    some = other[low: low + 8192]
                    twice = index.reaches(x[p[some]], home[q[some]] & 0xFFFFFFFF)
                    p[some[twice]] = -1
                q, p = q[p >= 0], p[p >= 0]
                np.add.at(count_h, p, many_c[q])
                np.add.at(count_c, q, many_h[p])
                edges += [(int(hn[i]), int(cn[j - len(x)])) for i, j in _forest(len(x) + len(y), p, q + len(x))]
            for nodes, counts in ((hn, count_h), (cn, count_c)):
                some = counts > 0
                out["node"] += nodes[some].tolist()
                out["links"] += counts[some].tolist()
                out["to"] += [None] * int(some.sum())
            for a, b in edges:
                out["node"].append(a)
                out["links"].append(0)
                out["to"].append(b)
        return pd.DataFrame({"node": pd.Series(out["node"], dtype="int64"), "links": pd.Series(out["links"], dtype="int64"), "to": pd.Series(out["to"], dtype="Int64")})

    found = cut(both.groupBy("cell", "r", "c").applyInPandas(compare, "node long, links long, to long"))
    joined = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = cut(entries.select("node", "least_id", "n").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least_of = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = of.join(least_of, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return cut(rows.select("id", "node").join(known, "node", "left").select("id", "n_links", "component_id"), keep=True)
