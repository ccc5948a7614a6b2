"""Commands that act on files, as manifests: what would be done to which file.  Nothing here touches a file.

A manifest row: path, action, target, reason, dry_run, done.  An executor outside applies rows that are not done; a
second run with the manifest of the first plans only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exposure, filterlang

COLUMNS = ("path", "action", "target", "reason", "dry_run", "done")


def selected(results: DataFrame, expression: str | None = None, min_score: int | None = None, tier: str | None = None) -> DataFrame:
    """Results without error that match the filter expression and the criteria."""
    rows = results.where("error is null") if "error" in results.columns else results
    if expression:
        rows = rows.where(filterlang.parse(expression, filterlang.of(rows)))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return rows if tier is None else rows.where(F.upper("tier") == tier.upper())


def _manifest(rows: DataFrame, action: str, target: Column, reason: str, dry_run: bool, done: DataFrame | None) -> DataFrame:
    planned = rows.select("path", F.lit(action).alias("action"), target.cast("string").alias("target"), F.lit(reason).alias("reason"), F.lit(dry_run).alias("dry_run"), F.lit(False).alias("done"))
    return planned if done is None else planned.join(done.where(F.col("done") & (F.col("action") == action)).select("path").distinct(), "path", "left_anti").select(*COLUMNS)


def relocated(path: Column, source: str, destination: str) -> Column:
    """The path below `source` kept below `destination`; of paths elsewhere the name alone."""
    source, destination = source.rstrip("/"), destination.rstrip("/")
    inside = F.startswith(path, F.lit(source + "/"))
    return F.concat(F.lit(destination + "/"), F.when(inside, F.substr(path, F.lit(len(source) + 2))).otherwise(F.substring_index(path, "/", -1)))


def quarantine(results: DataFrame, source: str, destination: str, expression: str, dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    return _manifest(selected(results, expression), "quarantine", relocated(F.col("path"), source, destination), expression, dry_run, done)


def move(results: DataFrame, source: str, destination: str, expression: str | None = None, dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    return _manifest(selected(results, expression), "move", relocated(F.col("path"), source, destination), expression or "", dry_run, done)


def delete(results: DataFrame, expression: str | None = None, min_score: int | None = None, dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    if expression is None and min_score is None:
        raise ValueError("a filter expression or a least score is needed to delete")
    return _manifest(selected(results, expression, min_score), "delete", F.lit(None), expression or f"score >= {min_score}", dry_run, done)


def restrict(results: DataFrame, expression: str, to: int = exposure.PRIVATE, dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    """target: the permission bits in octal."""
    mode = F.conv(exposure.recommended_mode(F.lit(to), F.lit(False), F.lit(False)).cast("string"), 10, 8)
    return _manifest(selected(results, expression), "restrict", mode, expression, dry_run, done)


def encrypt(results: DataFrame, expression: str, suffix: str = ".enc", dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    rows = selected(results, expression).where(~F.endswith(F.col("path"), F.lit(suffix)))
    return _manifest(rows, "encrypt", F.concat("path", F.lit(suffix)), expression, dry_run, done)


def tag(results: DataFrame, expression: str, dry_run: bool = False, done: DataFrame | None = None) -> DataFrame:
    """target: the label as `tier:score`."""
    return _manifest(selected(results, expression), "tag", F.concat_ws(":", F.col("tier"), F.col("score").cast("string")), expression, dry_run, done)
