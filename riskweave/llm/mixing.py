"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size is to be taken r times.  The whole part is certain; the
fraction is rounded so that the words taken hardly differ from the target.  Two documents with fractional parts p and
q and sizes s and t exchange mass: s*p + t*q stays, one of the parts becomes 0 or 1, and the chances of the two ways
are such that every expectation stays.  This is done along blocks of documents; the one document of each block that is
still fractional goes on to the next level of a tree, until each source has one, which is rounded at random.  So the
words taken from a source differ from its target by less than one document; as a block is folded from its largest
document to its smallest, this one is as a rule a small one.

Everything is DataFrame operations: a block is an array that one aggregate() folds, blocks have at most BLOCK
documents however large a source is, and a level passes on one document a block.

Rows: null text has size 0; a null source is a source, the last; null doc_id is allowed.  Rows alike in source, doc_id
and text share one decision (their sizes are added for the exchange).  Documents of size 0 take floor(r) copies, that
is 0 words.  An empty table gives an empty result.  Draws are hashes of (seed, level, doc_id, size), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import cut, scratch, words_in

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK = 256


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size) rows -> source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and share 100 % of all sizes; no target passes
    most times the source's size, and what is above goes to the others by weight.  In closed form: ordered by size per
    weight, the first k are full, and k is the least for which the next one's share does not pass its bound.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    ranked = of.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    order = everything.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    shared = (
        ranked.withColumn("bound", most * F.col("source_size"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("bound"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything))
        .withColumn("free", F.struct(F.col("source_size") / F.col("weight"), F.col("rank")) >= F.struct(F.col("at.col1"), F.col("at.rank")))
    )
    return shared.select("source", "source_size", "weight", F.when(F.col("free"), F.col("at.level") * F.col("weight")).otherwise(F.col("bound")).alias("target"))


def _draw(seed: int, level: Column, *what: Column) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), level, *what), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _fold(rows: Column) -> Column:
    """Array of struct(id, n, size, whole, p, u) -> struct(c: the one still fractional or null, out: the others)."""
    row = "struct<id:struct<source:string,doc_id:string,mark:bigint>,n:bigint,size:bigint,whole:bigint,p:double,u:double>"
    first = F.expr(f"named_struct('c', cast(null as {row}), 'out', cast(array() as array<{row}>))")
    tiny = 1e-9

    def put(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["n"].alias("n"), x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"), x["u"].alias("u")).cast(row)

    def snap(p: Column) -> Column:
        return F.when(p < tiny, F.lit(0.0)).when(p > 1 - tiny, F.lit(1.0)).otherwise(p)

    def step(s: Column, x: Column) -> Column:
        c = s["c"]
        up = F.least(x["size"] * (1 - x["p"]), c["size"] * c["p"])  # words that can go from c to x
        down = F.least(x["size"] * x["p"], c["size"] * (1 - c["p"]))
        moved = F.when(x["u"] * (up + down) < down, up).otherwise(-down)
        px, pc = snap(x["p"] + moved / x["size"]), snap(c["p"] - moved / c["size"])
        x2, c2 = put(x, px), put(c, pc)
        whole_x, whole_c = (px <= 0) | (px >= 1), (pc <= 0) | (pc >= 1)
        done = F.struct(F.lit(None).cast(row).alias("c"), F.concat(s["out"], F.array(put(x, snap(x["p"])))).alias("out"))
        pair = F.struct(
            F.when(whole_x & whole_c, F.lit(None).cast(row)).when(whole_x, c2).otherwise(x2).alias("c"),
            F.concat(s["out"], F.when(whole_x & whole_c, F.array(x2, c2)).when(whole_x, F.array(x2)).otherwise(F.array(c2))).alias("out"),
        )
        p = snap(x["p"])
        return F.when((x["size"] <= 0) | (p <= 0) | (p >= 1), F.struct(c.alias("c"), done["out"].alias("out"))).when(c.isNull(), F.struct(put(x, p).alias("c"), s["out"].alias("out"))).otherwise(pair)

    return F.aggregate(rows, first, step)


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """-> doc_id, source, mark (hash of the text), n (rows alike), size (of one), source_size, target, copies."""
    with scratch(docs.sparkSession):
        return cut(_plan(docs, weights, most, seed, block), keep=True)


def _plan(docs: DataFrame, weights: tuple, most: float, seed: int, block: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    goal = cut(targets(slim, weights, most))
    goal_of = goal.select(F.col("source").alias("goal_source"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    units = slim.groupBy("source", "doc_id", "mark").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    rows = (
        units.join(goal_of, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("ratio", ratio)
        .select(
            F.struct("source", F.col("doc_id").cast("string").alias("doc_id"), "mark").alias("id"), "n", "size",
            F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"),
        )
    )
    level, done = 0, None
    rows = cut(rows)
    most_of = rows.groupBy("id.source").count().agg(F.max("count")).first()[0] or 0
    while True:
        blocks = max(1, -(-most_of // (block * 8)))
        key = F.xxhash64(F.lit(seed + 7919 * level), "id.doc_id", "id.mark")
        numbered = rows.withColumn("salt", F.pmod(key, F.lit(blocks))).withColumn(
            "chunk", F.floor((F.row_number().over(Window.partitionBy("id.source", "salt").orderBy(key, "id.doc_id", "id.mark", "size")) - 1) / block))
        folded = cut(
            numbered.groupBy("id.source", "salt", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct(
                (-F.col("size")).alias("z"), key.alias("k"), F.struct("id", "n", "size", "whole", "p", _draw(seed, F.lit(level), "id.doc_id", "id.mark", "size").alias("u")).alias("row")))).alias("rows"))
            .select(_fold(F.transform("rows", lambda x: x["row"])).alias("f"))
        )
        settled = folded.select(F.explode("f.out").alias("r")).select("r.*")
        done = settled if done is None else done.unionByName(settled)
        left = folded.where("f.c is not null").select("f.c.*")
        most_of = left.groupBy("id.source").count().agg(F.max("count")).first()[0] or 0
        if most_of <= 1:
            last = left.withColumn("p", F.when(_draw(seed, F.lit(-1), "id.doc_id", "id.mark") < F.col("p"), 1.0).otherwise(0.0))
            done = done.unionByName(last)
            break
        rows, level = left.drop("u"), level + 1
    return (
        done.join(goal_of, F.col("id.source").eqNullSafe(F.col("goal_source")))
        .select(F.col("id.doc_id").cast(kind).alias("doc_id"), F.col("id.source").alias("source"), F.col("id.mark").alias("mark"), "n",
                F.expr("size div n").alias("size"), "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the plan says, with the number of the copy as column `copy`."""
    marked = docs.drop("copy").withColumn("_rw_mark", F.xxhash64("text"))
    chosen = plan(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_rw_doc_id"), F.col("source").alias("_rw_source"), F.col("mark").alias("_rw_of"), F.col("copies").alias("_rw_copies"))
    same = (F.col("_rw_mark") == F.col("_rw_of")) & F.col("doc_id").eqNullSafe(F.col("_rw_doc_id")) & F.col("source").eqNullSafe(F.col("_rw_source"))
    return marked.join(chosen, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rw_copies")))).drop("_rw_mark", "_rw_doc_id", "_rw_source", "_rw_of", "_rw_copies")
