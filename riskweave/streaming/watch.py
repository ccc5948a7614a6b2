"""File events as a stream: filter, debounce, snapshot changes, incremental rescans."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "event_type string, path string, is_directory boolean, dest_path string, ts timestamp"
GAP = "500 milliseconds"


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")


def wanted(include: tuple = (), exclude: tuple = ("*.tmp", "*~"), hidden: bool = False) -> Column:
    """Files only; not excluded, not hidden; included if patterns are given."""
    name = F.substring_index("path", "/", -1)
    out = ~F.coalesce(F.col("is_directory"), F.lit(False))
    for p in exclude:
        out = out & ~name.rlike(_glob(p))
    if not hidden:
        out = out & ~F.col("path").rlike(r"(^|/)\.[^/]")
    if include:
        some = F.lit(False)
        for p in include:
            some = some | name.rlike(_glob(p))
        out = out & some
    return out


def debounced(events: DataFrame, gap: str = GAP, late: str = "10 seconds") -> DataFrame:
    """Of the events on a path that follow each other within the gap, the last; state ends with the watermark."""
    rows = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"), F.count("*").alias("events"))
    return rows.select("path", "event_type", "ts", "events")


def debounced_batch(events: DataFrame, seconds: float, key: str = "path", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same over a finished table: sessions with their last event."""
    by = Window.partitionBy(key).orderBy(at, tie)
    time = F.col(at).cast("timestamp").cast("double")
    new = F.coalesce(time - F.lag(time).over(by) > seconds, F.lit(True)).cast("int")
    session = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("_new", new).withColumn("session", session)
    return rows.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.max_by("event_type", F.struct(F.col(at), F.col(tie))).alias("event_type"))


def rescans(stream: DataFrame, known: Callable[[], DataFrame], scan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that scans what is new or changed: each batch without the (path, content_hash) already known."""

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts")))).where("_r = 1").drop("_r")
        sink(scan(newest.join(known().select("path", "content_hash"), ["path", "content_hash"], "left_anti")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
