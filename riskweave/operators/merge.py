"""Merging findings and contexts of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import exposure_name, exposure_rank

STRATEGIES = ("max", "sum", "first")
# Encryption, weakest first.
ENCRYPTION = ("none", "platform", "customer_managed")


def findings(rows: DataFrame, strategy: str = "max", key: str = "object_id") -> DataFrame:
    """(key, input_ord, entity_type, count, confidence, source) -> one row for each object and type.

    max: largest count and confidence; sum: counts added; first: count and confidence of the first input.  Where the
    rows have positions, array<struct<start,end>>, those of all sources are joined, each place once.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    count = {"max": F.max("count"), "sum": F.sum("count"), "first": F.min_by("count", "input_ord")}[strategy]
    confidence = F.min_by("confidence", "input_ord") if strategy == "first" else F.max("confidence")
    positions = [F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions")] if "positions" in rows.columns else []
    return rows.withColumn("entity_type", F.upper(F.trim("entity_type"))).groupBy(key, "entity_type").agg(
        count.alias("count"), confidence.alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"), *positions)


def contexts(rows: DataFrame, key: str = "object_id") -> DataFrame:
    """The worst case of an object's contexts; descriptions come from the first, the classification's source from the last."""
    weakest = F.min(F.when(F.col("encryption") == "customer_managed", 2).when(F.col("encryption") == "platform", 1).otherwise(0))
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("cross_account_access", "anonymous_access", "versioning", "access_logging", "retention_policy", "has_classification") if c in rows.columns]
    firsts = [F.min_by(c, "input_ord").alias(c) for c in ("path", "owner", "size_bytes", "file_type") if c in rows.columns]
    dates = [F.max(c).alias(c) for c in ("last_modified", "last_accessed", "staleness_days") if c in rows.columns]
    out = rows.groupBy(key).agg(F.max(F.coalesce(exposure_rank(F.col("exposure")), F.lit(0))).alias("_level"), weakest.alias("_encryption"), *flags, *firsts, *dates)
    return out.withColumn("exposure", exposure_name(F.col("_level"))).withColumn("encryption", F.element_at(F.array(*[F.lit(x) for x in ENCRYPTION]), F.col("_encryption") + 1)).drop("_level", "_encryption")


def combined(confidences, method: str = "max"):
    """Aggregate of a confidence column: max, average, or average weighted by itself."""
    return {"max": F.max(confidences), "average": F.avg(confidences), "weighted": F.try_divide(F.sum(confidences * confidences), F.sum(confidences))}[method]
