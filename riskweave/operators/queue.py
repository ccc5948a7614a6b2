"""The scan queue as a table: priorities, the order of work, a bounded take, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triggers import BY_EXPOSURE

# What each trigger adds to a job's priority, by either of its names.
BOOSTS = {"no_encryption": 20, "low_conf_high_risk": 25, "low_confidence_high_risk": 25, "stale_data": 5, "no_labels": 15, "public_access": 10, "org_wide": 5}
SMALL, LARGE = 1 << 20, 100 << 20
MOST_RETRIES = 3


def priority(exposure: Column, triggers: Column, size_bytes: Column, large: int = LARGE) -> Column:
    """0 to 100: exposure, every trigger as often as it is named, small files first, large ones last."""
    table = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    base = F.coalesce(F.try_element_at(table(BY_EXPOSURE), F.upper(F.coalesce(exposure, F.lit("PRIVATE")))), F.lit(0))
    boosts = F.aggregate(triggers, F.lit(0), lambda n, t: n + F.coalesce(F.try_element_at(table(BOOSTS), F.lower(t)), F.lit(0)))
    size = F.when((size_bytes > 0) & (size_bytes < SMALL), 5).when(size_bytes > large, -10).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), base + boosts + size))


def priority_in_context(exposure: Column, triggers: Column, size_bytes: Column, encryption: Column, has_classification: Column) -> Column:
    """The same, with what the context implies named once more: no encryption, no classification."""
    implied = F.filter(F.array(F.when(encryption == "none", "no_encryption"), F.when(~F.coalesce(has_classification, F.lit(False)), "no_labels")), lambda x: x.isNotNull())
    return priority(exposure, F.concat(triggers, implied), size_bytes)


def next_jobs(jobs: DataFrame, limit: int, priority: str = "priority", order: str = "seq") -> DataFrame:
    """The jobs that are taken next: highest priority first, of equals the first that came.  A bounded take, merged from each partition's own."""
    return jobs.orderBy(F.desc(priority), order).limit(limit)


def offered(queue: DataFrame, jobs: DataFrame, capacity: int, priority: str = "priority", order: str = "seq") -> DataFrame:
    """jobs with accepted: whether a queue of this capacity, that holds `queue`, takes them in their order."""
    free = queue.agg(F.greatest(F.lit(0), F.lit(capacity) - F.count("*")).alias("n")).first()["n"]
    taken = jobs.orderBy(order).limit(int(free)).select(F.col(order).alias("_taken")) if free else jobs.limit(0).select(F.col(order).alias("_taken"))
    return jobs.join(taken, F.col(order) == F.col("_taken"), "left").withColumn("accepted", F.col("_taken").isNotNull()).drop("_taken")


def requeued(failed: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """Failed jobs that go back, one retry later; those without one left are given up."""
    return failed.withColumn("retries", F.col("retries") + 1).withColumn("state", F.when(F.col("retries") <= most, "queued").otherwise("failed"))
