"""The label index: versions of labels by content hash, path mappings, lookups and upserts on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL_JSON = "v int, id string, hash string, labels array<struct<t:string,c:double,d:string,h:string,n:int>>, src string, ts bigint"
MOST_ROWS = 10_000


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep_old: tuple = ()) -> DataFrame:
    """old with new written over it by key; the latest of new wins, columns of keep_old stay where new has null."""
    latest = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    o, n = old.alias("o"), latest.alias("n")
    rest = [c for c in old.columns if c not in keys]
    matched = F.col(f"n.{order}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old else F.when(matched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in rest]).select(*old.columns)


def latest(versions: DataFrame, key: str = "label_id", at: str = "scanned_at", tie: str = "content_hash") -> DataFrame:
    """The newest version of each label."""
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), tie))).where("_r = 1").drop("_r")


def history(versions: DataFrame, limit: int = 100, key: str = "label_id", at: str = "scanned_at", tie: str = "content_hash") -> DataFrame:
    """The newest `limit` versions of each label, numbered."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), tie))).where(F.col("version") <= limit)


def matching(min_score=None, max_score=None, tier=None, entity_type=None, since=None, like: bool = False) -> Column:
    """Predicate on versions; entity types match whole, or as a part of the list with like=True."""
    out = F.lit(True)
    if min_score is not None:
        out = out & (F.col("risk_score") >= min_score)
    if max_score is not None:
        out = out & (F.col("risk_score") <= max_score)
    if tier is not None:
        out = out & (F.col("risk_tier") == tier)
    if entity_type is not None:
        out = out & (F.contains(F.col("entity_types"), F.lit(entity_type)) if like else F.array_contains(F.split("entity_types", ","), entity_type))
    if since is not None:
        out = out & (F.col("scanned_at") >= F.lit(since).cast("timestamp"))
    return out


def query(objects: DataFrame, versions: DataFrame, tenant: str | None = None, limit: int = 100, offset: int = 0, **what) -> DataFrame:
    """Objects with the versions that match, newest first."""
    objects = objects.where(F.col("tenant_id") == tenant) if tenant is not None else objects
    return objects.join(versions.where(matching(**what)), "label_id").orderBy(F.desc("scanned_at"), "label_id", "content_hash").offset(max(0, offset)).limit(max(1, min(limit, MOST_ROWS)))


def count(objects: DataFrame, versions: DataFrame, tenant: str | None = None, **what) -> DataFrame:
    """How many rows query() would have without a limit."""
    objects = objects.where(F.col("tenant_id") == tenant) if tenant is not None else objects
    return objects.join(versions.where(matching(**what)), "label_id").agg(F.count("*").alias("n"))


def tenant_counts(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """tenant_id, labels, versions; versions are counted by label before they meet their tenant."""
    per = versions.groupBy("label_id").agg(F.count("*").alias("n"))
    return objects.join(per, "label_id", "left").groupBy("tenant_id").agg(F.countDistinct("label_id").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions"))


def exported(objects: DataFrame, versions: DataFrame, tenant: str | None = None, **what) -> DataFrame:
    """The matching versions as JSON lines, newest first; write them as text, or read them piece by piece with toLocalIterator()."""
    objects = objects.where(F.col("tenant_id") == tenant) if tenant is not None else objects
    rows = objects.join(versions.where(matching(**what)), "label_id")
    return rows.orderBy(F.desc("scanned_at"), "label_id", "content_hash").select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def aggregated(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, entity_type, value_hash (of the first span), confidence (mean), count: what a label says of each type."""
    from ..functions.text import value_hash

    return spans.groupBy(key, "entity_type").agg(F.min_by("text", F.struct("start", "end")).alias("value"), F.avg("confidence").alias("confidence"), F.count("*").alias("count")).withColumn("value_hash", value_hash(F.col("value"), F.col("entity_type"))).drop("value")


def inventory(items: DataFrame, tier: str | None = None, entity: str | None = None, min_score=None, max_score=None, path_contains: str | None = None) -> DataFrame:
    """Inventory rows (path, score, tier, entities map) that match; names and paths whatever their case."""
    out = F.lit(True)
    if tier:
        out = out & (F.upper(F.coalesce(F.col("tier"), F.lit(""))) == tier.upper())
    if entity:
        out = out & F.exists(F.map_keys("entities"), lambda k: F.upper(k) == entity.upper())
    if min_score is not None:
        out = out & (F.coalesce(F.col("score"), F.lit(0)) >= min_score)
    if max_score is not None:
        out = out & (F.coalesce(F.col("score"), F.lit(0)) <= max_score)
    if path_contains:
        out = out & F.contains(F.lower("path"), F.lit(path_contains.lower()))
    return items.where(out)


def by_path(mappings: DataFrame, versions: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The version that each path (all, or those of `paths`) has now."""
    mappings = paths.join(mappings, "file_path", "left") if paths is not None else mappings
    return mappings.join(versions, ["label_id", "content_hash"], "left" if paths is not None else "inner")


def resolve(pointers: DataFrame, versions: DataFrame, pointer: str = "pointer") -> DataFrame:
    """label_id:content_hash pointers -> versions."""
    parts = F.split(F.col(pointer), ":")
    return pointers.withColumn("label_id", F.get(parts, 0)).withColumn("content_hash", F.get(parts, 1)).join(versions, ["label_id", "content_hash"], "left")


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the labels named."""
    return {name: t.join(ids, "label_id", "left_anti") for name, t in tables.items()}


def unlabelled(files: DataFrame, labels: DataFrame, on: str = "path") -> DataFrame:
    return files.join(labels.select(on), on, "left_anti")


def verified(files: DataFrame, labels: DataFrame, on: str = "path") -> DataFrame:
    """files with reason: valid, no_label or hash_mismatch."""
    joined = files.join(labels.select(on, F.col("content_hash").alias("label_hash")), on, "left")
    return joined.withColumn("reason", F.when(F.col("label_hash").isNull(), "no_label").when(F.col("label_hash") == F.col("content_hash"), "valid").otherwise("hash_mismatch"))


def label_set(entities: Column, label_id: Column, content_hash: Column, source: Column, ts: Column) -> Column:
    """Compact label JSON; entities: array of struct(t, c, d, h, n)."""
    return F.to_json(F.struct(F.lit(1).alias("v"), label_id.alias("id"), content_hash.alias("hash"), entities.alias("labels"), source.alias("src"), ts.alias("ts")))


def parsed(json: Column) -> Column:
    return F.from_json(json, LABEL_JSON)


def valid(json: Column) -> Column:
    x = parsed(json)
    good = (x["v"] == 1) & x["id"].rlike("^ol_[a-f0-9]{12}$") & x["hash"].rlike("^[a-f0-9]{12}$") & F.forall(x["labels"], lambda e: e["t"].isNotNull() & e["c"].between(0, 1) & e["h"].rlike("^[a-f0-9]{6}$"))
    return F.coalesce(good, F.lit(False))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, change (created, deleted, modified) of rows that differ."""
    b = before.select(F.col(key).alias("_b"), F.struct(*compare).alias("_was"))
    a = after.select(F.col(key).alias("_a"), F.struct(*compare).alias("_is"))
    joined = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    change = F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "deleted").when(~F.col("_was").eqNullSafe(F.col("_is")), "modified")
    return joined.select(F.coalesce("_b", "_a").alias(key), change.alias("change")).where("change is not null")
