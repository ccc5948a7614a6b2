"""The pipelines as one call each, and a facade over them.

An object goes through: findings of external classifiers -> scan triggers -> the objects that a trigger names are
scanned -> findings of all sources merged -> scores.  Objects without a trigger are never read by the scanner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, detect, filterlang, labels, merge, report, score, triggers
from ..sinks import reports

FINDING = ("object_id", "input_ord", "entity_type", "count", "confidence", "source")


def triggered(findings: DataFrame, contexts: DataFrame, as_of: str) -> DataFrame:
    """contexts (object_id, exposure, encryption, has_classification, last_modified) with triggers and priority."""
    entities = findings.groupBy("object_id").agg(F.collect_list(F.struct(F.col("entity_type").alias("type"), "count", "confidence")).alias("_entities"))
    rows = contexts.join(entities, "object_id", "left").withColumn("_stale", triggers.staleness_days(F.col("last_modified"), F.lit(as_of)))
    found = triggers.triggers(F.coalesce("_entities", F.array().cast(entities.schema["_entities"].dataType)), F.col("has_classification"), F.col("exposure"), F.col("encryption"), F.col("_stale"))
    rows = rows.withColumn("triggers", found)
    return rows.withColumn("priority", triggers.priority(F.col("exposure"), F.col("triggers"))).drop("_entities", "_stale")


def process(findings: DataFrame, contexts: DataFrame, contents: DataFrame | None = None, as_of: str = "1970-01-01", strategy: str = "max") -> DataFrame:
    """-> object_id, triggers, priority, scanned, score, tier and the rest of the score's columns.

    contents: object_id, text of what can be read; only objects with a trigger are scanned.
    """
    due = triggered(findings, contexts, as_of)
    rows = findings.select(*FINDING)
    if contents is not None:
        wanted = due.where(F.size("triggers") > 0).select("object_id")
        scanned = detect.counts(contents.join(wanted, "object_id", "left_semi"), "object_id")
        rows = rows.unionByName(scanned.select("object_id", F.lit(1 << 30).alias("input_ord"), "entity_type", "count", "confidence", F.lit("scanner").alias("source")))
    merged = merge.findings(rows, strategy).join(contexts.select("object_id", "exposure"), "object_id", "left")
    scored = score.score(merged, "object_id", exposure="exposure")
    seen = contents.select("object_id", F.lit(True).alias("_read")).distinct() if contents is not None else None
    due = due.withColumn("scanned", F.lit(False)) if seen is None else due.join(seen, "object_id", "left").withColumn("scanned", F.coalesce("_read", F.lit(False)) & (F.size("triggers") > 0)).drop("_read")
    out = due.select("object_id", "triggers", "priority", "scanned").join(scored, "object_id", "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0))).withColumn("tier", F.coalesce("tier", F.lit("MINIMAL")))


def process_content(contents: DataFrame) -> DataFrame:
    """Contents without any finding: all are scanned, with priority 100 and the one trigger `no_labels`."""
    scored = score.score(detect.counts(contents, "object_id"), "object_id")
    out = contents.select("object_id").join(scored, "object_id", "left")
    return out.withColumn("triggers", F.array(F.lit("no_labels"))).withColumn("priority", F.lit(100)).withColumn("score", F.coalesce("score", F.lit(0))).withColumn("tier", F.coalesce("tier", F.lit("MINIMAL")))


class Engine:
    """The operations a user starts from, on one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def scan(self, docs: DataFrame, key: str = "path") -> DataFrame:
        """Texts -> results (path, size_bytes, score, tier, entities, error)."""
        found = detect.counts(docs, key)
        entities = found.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "count")))).alias("entities"))
        rows = docs.select(key, F.octet_length("text").cast("long").alias("size_bytes")).join(score.score(found, key).select(key, "score", "tier"), key, "left").join(entities, key, "left")
        return rows.select(F.col(key).alias("path"), "size_bytes", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("tier", F.lit("MINIMAL")).alias("tier"),
                           F.coalesce("entities", F.create_map().cast("map<string,bigint>")).alias("entities"), F.lit(None).cast("string").alias("error"))

    def find(self, results: DataFrame, where: str, limit: int | None = None) -> DataFrame:
        rows = results.where(filterlang.parse(where, filterlang.of(results)))
        return rows if limit is None else report.ordered(rows, limit=limit)

    def report(self, results: DataFrame, path: str) -> None:
        reports.save(results, path)

    def quarantine(self, results: DataFrame, source: str, destination: str, where: str, **options) -> DataFrame:
        return actions.quarantine(results, source, destination, where, **options)

    def inventory(self, items: DataFrame, **criteria) -> DataFrame:
        return labels.inventory(items, **criteria)

    def stats(self, results: DataFrame) -> DataFrame:
        """One row: files, mean, largest and least score, share of files by tier, the ten most frequent entity types."""
        whole = report.summary(results)
        share = [F.try_divide(F.col(f"tier_{t.lower()}") * 100.0, F.col("total_files") - F.col("error_count")).alias(f"pct_{t.lower()}") for t in report.TIER_ORDER]
        top = report.entity_histogram(results, 10).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "entity_type"))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["entity_type"]), ","))
        return whole.select("total_files", F.round("mean_score", 6).alias("mean_score"), "max_score", "min_score", *share, top.scalar().alias("top_entities"))

    def health(self) -> DataFrame:
        """name, ok, detail of what the engine needs."""
        rows = [("spark", True, self.spark.version)]
        for name in ("pyarrow", "pandas", "numpy", "ahocorasick"):
            try:
                rows.append((name, True, str(getattr(__import__(name), "__version__", ""))))
            except ImportError as e:
                rows.append((name, name == "ahocorasick", str(e)))  # regular expressions take its place
        return self.spark.createDataFrame(rows, "name string, ok boolean, detail string")
