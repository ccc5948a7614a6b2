"""Risk scores: weights, co-occurrence, exposure, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import category_of, weight_of

# Fixed values.
SCALE = 4.0
RULES = (
    (("direct_identifier", "health_info"), 2.0, "hipaa_phi"), (("direct_identifier", "financial"), 1.8, "identity_theft"), (("credential",), 1.5, "credential_exposure"),
    (("quasi_identifier", "health_info"), 1.5, "phi_without_id"), (("contact", "health_info"), 1.4, "phi_with_contact"),
    (("direct_identifier", "quasi_identifier", "financial"), 2.2, "full_identity"), (("classification_marking",), 2.5, "classified_data"),
)
TIERS = ((80, "CRITICAL"), (55, "HIGH"), (31, "MEDIUM"), (11, "LOW"))
EXPOSURES = ("PRIVATE", "INTERNAL", "ORG_WIDE", "PUBLIC")
MULTIPLIERS = (1.0, 1.2, 1.8, 2.5)
NO_CONFIDENCE = 0.90


def tier_of(score: Column) -> Column:
    """Tier of the score before rounding."""
    out = F.lit("MINIMAL")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def exposure_rank(name: Column) -> Column:
    """0 to 3; null for other names."""
    up, out = F.upper(F.trim(name)), F.lit(None).cast("int")
    for k, x in enumerate(EXPOSURES):
        out = F.when(up == x, k).otherwise(out)
    return out


def exposure_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in EXPOSURES]), rank.cast("int") + 1)


def multiplier_of(exposure: Column) -> Column:
    out = F.lit(MULTIPLIERS[0])
    for x, m in zip(EXPOSURES, MULTIPLIERS):
        out = F.when(F.upper(F.trim(exposure)) == x, m).otherwise(out)
    return out


def co_occurrence(categories: Column) -> tuple[Column, Column]:
    """Set of categories -> the largest multiplier of the rules that hold, and the names of the rules that have it."""
    held = F.filter(F.array(*[
        F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in need]), categories)) == 0, F.struct(F.lit(m).alias("m"), F.lit(name).alias("name"))) for need, m, name in RULES
    ]), lambda x: x.isNotNull())
    most = F.coalesce(F.array_max(F.transform(held, lambda x: x["m"])), F.lit(1.0))
    return most, F.transform(F.filter(held, lambda x: x["m"] == most), lambda x: x["name"])


def score(entities: DataFrame, key: str = "doc_id", exposure: str | None = None, dimension: DataFrame | None = None, types: bool = False) -> DataFrame:
    """(key, entity_type, count, confidence [, exposure]) -> a row for each object with its score and tier.

    One shuffle: the confidence of an object is the mean over its matches, which factors out of the sum of weights, so
    everything comes from one aggregate.  types: also entity_types, an entry for each row of the object, in order, so that
    what was found need not be computed again and joined.
    """
    rows = entities.withColumn("_type", F.col("entity_type")).withColumn("entity_type", F.upper(F.trim("entity_type")))
    if dimension is not None:
        rows = rows.join(dimension, "entity_type", "left").withColumn("weight", F.coalesce("weight", F.lit(5))).withColumn("category", F.coalesce("category", F.lit("unknown")))
    else:
        rows = rows.withColumn("weight", weight_of(F.col("entity_type"))).withColumn("category", category_of(F.col("entity_type")))
    level = F.max(exposure_rank(F.col(exposure))) if exposure else F.lit(0)
    grouped = rows.groupBy(key).agg(
        F.sum(F.col("weight") * SCALE * (1 + F.log(F.greatest(F.lit(1), F.col("count"))))).alias("base"),
        (F.sum(F.col("confidence") * F.col("count")) / F.sum("count")).alias("confidence"),
        F.sum("count").alias("entity_count"), F.sort_array(F.collect_set(F.when(F.col("category") != "unknown", F.col("category")))).alias("categories"), F.coalesce(level, F.lit(0)).alias("level"),
        *([F.sort_array(F.collect_list("_type")).alias("entity_types")] if types else []),
    )
    most, names = co_occurrence(F.col("categories"))
    content = F.least(F.lit(100.0), F.col("base") * F.coalesce("confidence", F.lit(NO_CONFIDENCE)) * F.col("co_occurrence"))
    final = F.least(F.lit(100.0), F.col("content") * multiplier_of(F.col("exposure")))
    return (
        grouped.withColumn("co_occurrence", most).withColumn("rules", names).withColumn("exposure", exposure_name(F.col("level"))).withColumn("content", content).withColumn("final", final)
        .select(key, F.bround("final", 0).cast("int").alias("score"), tier_of(F.col("final")).alias("tier"), F.bround("content", 1).alias("content_score"), "co_occurrence", "rules", "categories", "exposure", "entity_count", "confidence", *(["entity_types"] if types else []))
    )
