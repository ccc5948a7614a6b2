"""When an object must be scanned, and how soon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import weight_of

# Fixed values.
STALE_DAYS = 365
HIGH_WEIGHT = 8
SURE = 0.80
BY_EXPOSURE = {"PRIVATE": 0, "INTERNAL": 10, "ORG_WIDE": 30, "PUBLIC": 50}
BOOSTS = {"no_encryption": 20, "low_confidence_high_risk": 25, "stale_data": 5, "no_labels": 15}
DESCRIPTIONS = {
    "no_labels": "There is no classification yet", "public_access": "Anyone can reach it", "org_wide": "The whole organisation can reach it", "no_encryption": "It is stored without encryption",
    "stale_data": "It has not changed for more than a year", "low_confidence_high_risk": "A type of high risk was found, but not for sure",
}


def staleness_days(modified: Column, as_of: Column) -> Column:
    """Whole days, at least 0; 0 where the time cannot be read."""
    then = F.try_to_timestamp(modified.cast("string"))
    return F.greatest(F.lit(0), F.coalesce(F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(then)) / 86400), F.lit(0)).cast("int"))


def triggers(entities: Column, has_classification: Column, exposure: Column, encryption: Column, stale: Column) -> Column:
    """Array of trigger names; entities: array of struct(type, count, confidence)."""
    none = F.coalesce(F.size(entities), F.lit(0)) <= 0
    doubtful = F.exists(entities, lambda e: (weight_of(F.upper(e["type"])) >= HIGH_WEIGHT) & (e["confidence"] < SURE))
    level = F.upper(exposure)
    found = F.array(
        F.when(none | ~F.coalesce(has_classification, F.lit(False)), "no_labels"),
        F.when(level == "PUBLIC", "public_access").when(level == "ORG_WIDE", "org_wide"),
        F.when(encryption == "none", "no_encryption"),
        F.when(stale > STALE_DAYS, "stale_data"),
        F.when(F.coalesce(doubtful, F.lit(False)), "low_confidence_high_risk"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def priority(exposure: Column, found: Column) -> Column:
    out = F.lit(0)
    for name, n in BY_EXPOSURE.items():
        out = F.when(F.upper(exposure) == name, n).otherwise(out)
    for name, n in BOOSTS.items():
        out = out + F.when(F.array_contains(found, name), n).otherwise(0)
    return F.least(F.lit(100), out)


def urgency(score: Column, found: Column) -> Column:
    return F.when(F.size(found) == 0, "NONE").when(score >= 75, "IMMEDIATE").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def described(found: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    return F.transform(found, lambda t: F.coalesce(F.element_at(names, t), t))
