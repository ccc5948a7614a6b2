"""The vault: findings in the clear, spans encrypted.

A row: path, file_hash, scanned_at, source, entity_counts (map), score, tier, spans (binary, AES-GCM of the spans' JSON
under the caller's key, with a random start, so that equal spans do not look equal).  The key is a column or literal of
16, 24 or 32 bytes; as a literal it shows in plans, so keep it in a column of a table that only the vault's job reads,
or set spark.sql.redaction.string.regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .report import tier_rank

SPANS = "array<struct<start:int,end:int,text:string,entity_type:string,confidence:double>>"


def entries(results: DataFrame, spans: DataFrame, key: Column, source: str, on: str = "path") -> DataFrame:
    """results (path, file_hash, scanned_at, score, tier) and their spans -> vault rows."""
    parts = ("start", "end", "text", "entity_type", "confidence")
    by_type = spans.groupBy(on, "entity_type").agg(F.collect_list(F.struct(*parts)).alias("_of"))
    found = by_type.groupBy(on).agg(F.sort_array(F.flatten(F.collect_list("_of"))).alias("_s"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", F.size("_of").cast("long").alias("n"))))).alias("entity_counts"))
    rows = results.join(found.hint("merge"), on, "left")  # narrow columns are estimated so small that Spark would broadcast all spans
    text = F.to_json(F.coalesce("_s", F.array().cast(found.schema["_s"].dataType)))
    return rows.select(on, "file_hash", "scanned_at", F.lit(source).alias("source"), F.coalesce("entity_counts", F.create_map().cast("map<string,bigint>")).alias("entity_counts"), "score", "tier", F.aes_encrypt(text.cast("binary"), key).alias("spans"))


def opened(rows: DataFrame, key: Column) -> DataFrame:
    """rows with their spans in the clear; null where the key is another."""
    return rows.withColumn("spans", F.from_json(F.try_aes_decrypt("spans", key).cast("string"), SPANS))


def stored(vault: DataFrame, new: DataFrame, on: str = "path") -> DataFrame:
    """The vault with new rows: of each path and source the newest scan; every row shows its path's largest score and highest tier.

    One shuffle by path and one sort behind it.  An aggregate that keeps whole rows would sort them before the shuffle
    too, all that a task has read at once.
    """
    dealt = vault.unionByName(new).repartition(F.col(on))
    newest, same = Window.partitionBy(on, "source").orderBy(F.desc("scanned_at"), F.desc("file_hash")), Window.partitionBy(on)
    rows = dealt.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    most = rows.withColumn("score", F.max("score").over(same)).withColumn("tier", F.max_by("tier", tier_rank(F.col("tier"))).over(same))
    return most.select(*vault.columns)


def primary_source(vault: DataFrame, on: str = "path") -> DataFrame:
    """The source that looked at each path last."""
    return vault.groupBy(on).agg(F.max_by("source", F.struct("scanned_at", "source")).alias("source"))


def queued(entries: DataFrame, key: Column) -> DataFrame:
    """Audit entries that wait for a key: everything but order and chain encrypted."""
    return entries.select("chain", "seq", F.aes_encrypt(F.to_json(F.struct("id", "timestamp", "user_id", "action", "details")).cast("binary"), key).alias("sealed"))


def flushed(queue: DataFrame, key: Column) -> DataFrame:
    """Queued entries as they are appended to the chain."""
    kind = "id string, timestamp string, user_id string, action string, details string"
    return queue.select("chain", "seq", F.from_json(F.try_aes_decrypt("sealed", key).cast("string"), kind).alias("e")).select("chain", "seq", "e.*")
