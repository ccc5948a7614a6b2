"""Summaries, roll-ups, top lists and export rows over scan results.

Scan results: path, size_bytes, score (null: not scanned), tier, entities map<string,bigint>, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIER_ORDER = ("MINIMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def summary(results: DataFrame) -> DataFrame:
    """One row; rows with an error count as files and errors, and in nothing else."""
    good = F.col("error").isNull()
    score = F.when(good, F.col("score"))
    tiers = [F.count_if(good & (F.upper("tier") == t)).alias(f"tier_{t.lower()}") for t in TIER_ORDER]
    return results.agg(
        F.count("*").alias("total_files"), F.count_if(~good).alias("error_count"), F.sum(F.when(good, F.col("size_bytes"))).alias("total_size"),
        F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), *tiers)


def entity_histogram(results: DataFrame, top: int | None = 20) -> DataFrame:
    """entity_type, count: the most frequent; ties by name."""
    rows = results.where("error is null").select(F.explode("entities").alias("entity_type", "n")).groupBy("entity_type").agg(F.sum("n").alias("count"))
    return rows.orderBy(F.desc("count"), "entity_type").limit(top) if top else rows


def score_deciles(results: DataFrame) -> DataFrame:
    return results.where("error is null and score is not null").groupBy((F.least(F.floor(F.col("score") / 10), F.lit(9)) * 10).cast("long").alias("from_score")).agg(F.count("*").alias("files"))


def tier_rank(tier: Column) -> Column:
    out = F.lit(-1)
    for k, t in enumerate(TIER_ORDER):
        out = F.when(F.upper(tier) == t, k).otherwise(out)
    return out


def ordered(results: DataFrame, by: str = "score", descending: bool = True, limit: int | None = None) -> DataFrame:
    column = tier_rank(F.col("tier")) if by == "tier" else F.col({"score": "score", "path": "path", "size": "size_bytes"}[by])
    rows = results.where("error is null").orderBy(column.desc() if descending else column.asc(), "path")
    return rows.limit(limit) if limit else rows


def prefixes(path: Column) -> Column:
    """Every directory above a path, the root first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))


def directory_tree(results: DataFrame, depth: int | None = None) -> DataFrame:
    """directory, depth, files, size, mean and largest score, weighted by files."""
    rows = results.where("error is null").select("size_bytes", "score", F.explode(prefixes(F.col("path"))).alias("directory"))
    level = F.when(F.col("directory") == "/", 0).otherwise(F.size(F.split("directory", "/")) - 1)
    out = rows.withColumn("depth", level)
    out = out.where(F.col("depth") <= depth) if depth is not None else out
    return out.groupBy("directory", "depth").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


def child_average_tree(results: DataFrame, depth: int = 3) -> DataFrame:
    """Directory means as the mean of their children's means, level by level from `depth` up."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    cut = results.where("error is null").select(F.transform(F.slice(parts, F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda x: x).alias("p"), F.col("score").cast("double").alias("s"))
    level = cut.groupBy("p").agg(F.avg("s").alias("mean_score"))
    out = None
    for d in range(depth - 1, -1, -1):
        here = level.where(F.size("p") > d).groupBy(F.slice("p", 1, d).alias("p")).agg(F.avg("mean_score").alias("mean_score")) if d else level.groupBy(F.array().cast("array<string>").alias("p")).agg(F.avg("mean_score").alias("mean_score"))
        rows = here.select(F.concat(F.lit("/"), F.array_join("p", "/")).alias("directory"), F.lit(d).alias("depth"), "mean_score")
        out = rows if out is None else out.unionByName(rows)
        level = here.unionByName(level.where(F.size("p") <= d)) if d else level
    return out


def intensity(counts: DataFrame, by: str = "entity_type") -> DataFrame:
    """count as a share of the largest of its type."""
    return counts.join(counts.groupBy(by).agg(F.max("count").alias("_most")), by).withColumn("intensity", F.least(F.lit(1.0), F.try_divide("count", "_most"))).drop("_most")


def export_rows(results: DataFrame, between: str = ":", separator: str = "|") -> DataFrame:
    """Flat rows for CSV: entities as `TYPE:n|TYPE:n`."""
    pairs = F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(e["key"], F.lit(between), e["value"].cast("string")))
    return results.withColumn("entity_count", F.aggregate(F.map_values("entities"), F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("entities", F.array_join(pairs, separator))


#: A rank is first bracketed to this share of the rows, by a sketch whose error is a tenth of it.
BRACKET = 0.001


def percentiles(values: DataFrame, column: str, ps: tuple = (50, 95, 99), by: tuple = ()) -> DataFrame:
    """Nearest-rank percentiles, exact; no group's values are sorted or gathered in one task.

    A sketch of each group brackets the ranks; then what lies below a bracket is counted, and only the distinct values
    inside it, some thousandths of the rows, are ranked.
    """
    if not by:  # one group: its one row of bounds is broadcast
        return percentiles(values.withColumn("_whole", F.lit(0)), column, ps, ("_whole",)).drop("_whole")
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    at = [max(0.0, min(1.0, p / 100 + d)) for p in ps for d in (-BRACKET, BRACKET)]
    groups = rows.groupBy(*by).agg(F.count("*").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.percentile_approx("_v", at, int(10 / BRACKET)).alias("_at"))
    brackets = F.array(*[F.struct(F.lit(p).alias("p"), F.get("_at", 2 * k).alias("low"), F.get("_at", 2 * k + 1).alias("high")) for k, p in enumerate(ps)])
    bounds = groups.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.explode(brackets).alias("b"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    few = F.broadcast if by == ("_whole",) else lambda x: x
    met = rows.join(few(bounds), same)  # a group has len(ps) brackets, which every row of it meets
    kept = met.where(F.col("_v") <= F.col("b.high")).withColumn("_in", F.when(F.col("_v") >= F.col("b.low"), F.col("_v")))
    counts = kept.groupBy(*by, F.col("b.p").alias("p"), "_in").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "p").orderBy(F.col("_in").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).where("_in is not null")
    whole = groups.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "count", "min", "max")
    joined = ranked.join(few(whole), same)
    found = [F.min(F.when((F.col("p") == p) & (F.col("upto") > F.floor(F.col("count") * p / 100)), F.col("_in"))).alias(f"p{p}") for p in ps]
    return joined.groupBy(*by, "count", "min", "max").agg(*found)


PARTS = 64


def stratified(rows: DataFrame, stratum: str, key: str, sizes: dict, seed: int = 1) -> DataFrame:
    """So many rows of each stratum, chosen by a hash of the key: reruns agree.  A stratum's parts choose first, so no task ranks it whole."""
    want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(stratum)), F.lit(0))
    ordered = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    ordered = ordered.withColumn("_part", F.pmod(F.xxhash64("_hash"), F.lit(PARTS)))
    for keys in ((stratum, "_part"), (stratum,)):
        ordered = ordered.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", key))).where(F.col("_rank") <= want)
    return ordered.drop("_rank", "_hash", "_part")
