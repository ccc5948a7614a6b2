"""Hash-chained audit rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def entry_text(id_: str, timestamp: str, user: str, action: str, details: str, previous: str) -> str:
    return "|".join((id_, timestamp, user, action, details, previous))


def chained(entries: DataFrame, chain: str = "chain", order: str = "seq") -> DataFrame:
    """entries (chain, seq, id, timestamp, user_id, action, details) with prev_hash and entry_hash.

    A chain is sequential, so it is one task's; its rows pass through in order, batch by batch, and are never held whole.
    """

    columns = entries.columns

    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, GENESIS
        for pdf in parts:
            before, after = [], []
            for r in pdf.to_dict("records"):
                if r[chain] != now or not before and now is None:
                    now, last = r[chain], GENESIS
                before.append(last)
                last = hashlib.sha256(entry_text(*[str(r[c]) for c in ("id", "timestamp", "user_id", "action", "details")], last).encode()).hexdigest()
                after.append(last)
            yield pdf.assign(prev_hash=before, entry_hash=after)

    schema = T.StructType([*entries.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    return entries.repartition(F.col(chain)).sortWithinPartitions(chain, order).select(*columns).mapInPandas(link, schema)


def broken(entries: DataFrame, chain: str = "chain", order: str = "seq") -> DataFrame:
    """Rows whose hash or link is wrong, with the reason."""
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy(chain).orderBy(order))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "timestamp", "user_id", "action", "details", "prev_hash")])
    marked = entries.withColumn("_before", before).withColumn("reason", F.when(F.col("prev_hash") != F.col("_before"), "broken_link").when(F.sha2(text.cast("binary"), 256) != F.col("entry_hash"), "altered"))
    return marked.where("reason is not null").drop("_before")


def read(entries: DataFrame, action: str | None = None, user: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of an action, of a user, newest first."""
    out = entries if action is None else entries.where(F.col("action") == action)
    out = out if user is None else out.where(F.col("user_id") == user)
    out = out.orderBy(F.desc("timestamp"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def stats(entries: DataFrame) -> DataFrame:
    """One row: total_entries, by_action and by_user (arrays of struct(name, n), sorted), oldest, newest."""
    def counted(column: str) -> DataFrame:
        return entries.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("counts"))

    whole = entries.agg(F.count("*").alias("total_entries"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    return whole.withColumn("by_action", counted("action").scalar()).withColumn("by_user", counted("user_id").scalar())
