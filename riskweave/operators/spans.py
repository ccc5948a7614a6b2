"""Span conflicts: one span a place, containment, greedy non-overlap, islands."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import refine


def dedupe(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One span for each (start, end): the highest tier, then confidence, then the first rule."""
    best = Window.partitionBy(key, "start", "end").orderBy(F.desc("tier"), F.desc("confidence"), "rule_ord")
    return spans.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def drop_contained(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without spans that lie in a longer one, or an equal and better one, of a compatible type, whatever their tiers.

    Only runs of touching spans are looked at, each by itself.
    """
    return _within_runs(spans, key, ("start", "end", "tier", "confidence", "rule_ord", "entity_type"), lambda found: refine.without_contained("", found))


def _within_runs(spans: DataFrame, key: str, needed: tuple[str, ...], choose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What `choose` keeps of each run of touching spans, which it gets as the columns needed.

    Runs are small groups however long a document is, and there are as many as documents: they go to Python by the
    batch, as a call for each would cost a hundred times what is done in it.
    """
    gathered = _runs(spans, key).groupBy(key, "_run").agg(F.collect_list(F.struct(*spans.columns)).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            columns, kept, at = [flat.field(c).to_pylist() for c in needed], [], 0
            for n in batch.column(0).value_lengths().to_pylist():
                if n == 1:
                    kept.append(at)
                else:
                    found = [dict(zip(needed, values), _at=k) for k, values in enumerate(zip(*(c[at: at + n] for c in columns)), at)]
                    kept += sorted(s["_at"] for s in choose(refine.in_order("", found)))
                at += n
            yield pa.RecordBatch.from_struct_array(flat.take(pa.array(kept, pa.int64())))

    return gathered.select("_spans").mapInArrow(run, spans.schema)


def _runs(spans: DataFrame, key: str) -> DataFrame:
    """spans with the number of their run of touching spans."""
    order = Window.partitionBy(key).orderBy("start", "end", "rule_ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int"))
    return starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _chosen(spans: list[dict]) -> list[dict]:
    """By tier, confidence, length, rule and place in turn, each span that overlaps none taken before."""
    taken: list[tuple[int, int]] = []
    keep = []
    for s in sorted(spans, key=lambda s: (-s["tier"], -s["confidence"], s["start"] - s["end"], s["rule_ord"], s["start"])):
        start, end = s["start"], s["end"]
        k = bisect_left(taken, (start, end))
        if (k == len(taken) or taken[k][0] >= end) and (k == 0 or taken[k - 1][1] <= start):
            taken.insert(k, (start, end))
            keep.append(s)
    return keep


def without_overlaps(text: str, spans: list[dict]) -> list[dict]:
    """non_overlapping() as a step of refine.refine()."""
    return spans if len(spans) < 2 else refine.in_order(text, _chosen(spans))


def non_overlapping(spans: DataFrame, key: str = "doc_id", piece: int = 1 << 16) -> DataFrame:
    """The greedy choice by tier, confidence, length: no two spans of a document overlap.

    Choices are made within runs of touching spans, which are found by a window.
    """
    return _within_runs(spans, key, ("start", "end", "tier", "confidence", "rule_ord"), _chosen)


def one_a_place(text: str, spans: list[dict]) -> list[dict]:
    """dedupe() as a step of refine.refine()."""
    best: dict[tuple[int, int], dict] = {}
    for s in sorted(spans, key=lambda s: (-s["tier"], -s["confidence"], s["rule_ord"])):
        best.setdefault((s["start"], s["end"]), s)
    return list(best.values())


#: resolve() as steps of refine.refine().
RESOLVE = (one_a_place, refine.without_contained, without_overlaps)


def islands(positions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching (start, end) ranges as one."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int")
    runs = positions.select(key, "start", "end").distinct().withColumn("_new", new).withColumn("_run", F.sum("_new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def resolve(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """All of it: place, containment, greedy choice."""
    return non_overlapping(drop_contained(dedupe(spans, key), key), key)
