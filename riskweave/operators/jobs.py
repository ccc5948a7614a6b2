"""What a running scan tells: progress, pages of results, timings, failures, changes under way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THROTTLE = 0.1


def progress(results: DataFrame, job: str = "job_id", at: str = "seconds", throttle: float = THROTTLE) -> DataFrame:
    """job, seconds, scanned, with_risk, largest: the state after the last result of each step of `throttle` seconds."""
    step = F.floor(F.col(at) / throttle)
    per = results.groupBy(job, step.alias("_step")).agg(F.max(at).alias(at), F.count("*").alias("_n"), F.count_if(F.col("score") > 0).alias("_risk"), F.max("score").alias("_most"))
    upto = Window.partitionBy(job).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(job, at, F.sum("_n").over(upto).alias("scanned"), F.sum("_risk").over(upto).alias("with_risk"), F.max("_most").over(upto).alias("largest"))


def events(results: DataFrame, job: str = "job_id") -> DataFrame:
    """One closing event for each job: complete, or error if nothing could be read."""
    done = results.groupBy(job).agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return done.withColumn("event", F.when(F.col("files") == F.col("errors"), "error").otherwise("complete"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """The `number`-th page, from 1, of rows in this order."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def timings(samples: DataFrame, by: str = "detector", ms: str = "ms") -> DataFrame:
    """by, calls, mean, least and most milliseconds, and the types found: the roll-up of a metrics table."""
    return samples.groupBy(by).agg(F.count("*").alias("calls"), F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(F.coalesce("found", F.lit(0))).alias("found"))


def outcome(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, detector, status) -> the detectors that ran, failed, timed out, and whether the result is partial or void."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("detector"))))
    out = runs.groupBy(key).agg(of("ok").alias("ran"), of("failed").alias("failed"), of("timeout").alias("timed_out"))
    bad = F.size("failed") + F.size("timed_out") > 0
    return out.withColumn("partial", bad & (F.size("ran") > 0)).withColumn("void", bad & (F.size("ran") == 0))


def changed_meanwhile(before: DataFrame, after: DataFrame, on: str = "path") -> DataFrame:
    """path, reason: files whose hash, or else whose time, was another before the scan than after."""
    b = before.select(on, F.col("content_hash").alias("_h"), F.col("mtime").alias("_m"))
    joined = after.join(b, on)
    reason = F.when(F.col("content_hash") != F.col("_h"), "content").when(F.col("mtime") != F.col("_m"), "time")
    return joined.select(on, reason.alias("reason")).where("reason is not null")


def issues(results: DataFrame, expected: str, score: Column, key: str = "id", limit: int = 50) -> DataFrame:
    """Samples scored far from their expected tier, the farthest first: the calibration report's list."""
    from .report import tier_rank
    from .score import tier_of

    off = F.abs(tier_rank(tier_of(score)) - tier_rank(F.col(expected)))
    return results.withColumn("off_by", off).where("off_by > 1").orderBy(F.desc("off_by"), key).limit(limit)
