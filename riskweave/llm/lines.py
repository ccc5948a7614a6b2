"""Line dedup as an exact set-similarity join.

A line's tokens are its lower-cased words; lines are equal or near by the Jaccard similarity of their token sets.  A
line goes if an earlier line (by doc_id, then line number) has a similarity of at least LEAST with it.

  1. Token sets are written once, as 32-bit hashes.  Lines with the same lower-cased text (by a 128-bit hash) are one
     class; all but its first line go.  Classes alone are joined, so copies of a line, however many, are never paired.
  2. Tokens are counted over all lines in 2^18 hash buckets; rarity, then the token's hash, is the global order.
  3. Star: classes that share the least or the largest hash among their rarer tokens are compared with the first class
     that has it.  This settles most of a large group of near copies with one comparison each.
  4. Prefix filter: of two sets with the similarity t, n <= m tokens, one of the n - ceil(2t/(1+t) n) + 1 rarest tokens
     of the smaller is one of the m - ceil(t m) + 1 rarest of the larger.  Classes meet on these.  Length filter:
     m <= n/t.  Positional filter: what is left behind the shared token must suffice for the overlap t/(1+t) (n+m).
     Parity maps of the sets, 64 bits or, from WIDE tokens on, 128, bound the tokens that differ.  Pairs whose later
     class is settled already are left out.
  5. Candidates are verified on their whole token sets.

All of it is DataFrame operations.  Lines without a word, and null texts, are never removed.  Rows that share doc_id are
ordered by a hash of the text, rows alike in both share one decision, null doc_id comes first; only where such rows are
there is the table numbered anew.  An empty table gives an empty result; a line of any length is one line.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._support import cut, scratch, sweep

LEAST = 0.8
BUCKETS = 1 << 18
WIDE = 48
#: Keys of lines are broadcast up to this many; beyond, they are joined by shuffle.
MOST_BROADCAST = 1 << 20
#: A line's number is its document's number times a power of two, plus its place; both have so many bits in all.
BITS = 62

#: Hashes of words are too many for a dictionary page: none is tried.
PLAIN = {"parquet.enable.dictionary#t.list.element": "false", "parquet.enable.dictionary#prefix.list.element": "false"}

_OTHER_SPACE = "\t\x0b\x0c\r"


def _tokens(line: Column) -> Column:
    """32-bit hashes of a lower-cased line's distinct words; the empty words beside blanks go."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in _OTHER_SPACE:
        odd = odd | F.contains(line, F.lit(c))
    words = F.when(odd, F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")).otherwise(F.split(line, " "))
    return F.array_distinct(F.transform(words, lambda w: F.hash(w)))


def numbered(docs: DataFrame, key: str, text: str, most: int = 1 << 40) -> DataFrame:
    """docs with the column _n, which orders and tells apart documents: the key itself where that does so and is below `most`."""
    ids = docs.select(F.col(key).cast("long").alias("id"))
    span = ids.agg(F.min("id"), F.max("id"), F.count("*") - F.count("id")).first()
    if not span[2] and -most < (span[0] or 0) and (span[1] or 0) < most and not ids.groupBy("id").count().where("count > 1").limit(1).count():
        return docs.withColumn("_rw_n", F.col(key).cast("long"))
    marked = docs.withColumn("_rw_id", F.col(key).cast("long")).withColumn("_rw_mark", F.xxhash64(text))
    places = cut(marked.select("_rw_id", "_rw_mark").distinct().orderBy(F.col("_rw_id").asc_nulls_first(), "_rw_mark").select(F.col("_rw_id").alias("_rw_i"), F.col("_rw_mark").alias("_rw_m"), F.monotonically_increasing_id().alias("_rw_k")), keep=True)
    part = F.shiftright("_rw_k", 33)
    before, at = [], 0
    for r in places.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():  # a row for each partition of the sort
        before += [0] * (r["part"] - len(before)) + [at]
        at += r["count"]
    start = F.split(F.lit(",".join(map(str, before)) or "0"), ",").cast("array<bigint>")
    numbers = places.select("_rw_i", "_rw_m", (F.get(start, part.cast("int")) + F.col("_rw_k").bitwiseAND((1 << 33) - 1)).alias("_rw_n"))
    return marked.join(numbers, F.col("_rw_id").eqNullSafe(F.col("_rw_i")) & (F.col("_rw_mark") == F.col("_rw_m"))).drop("_rw_id", "_rw_mark", "_rw_i", "_rw_m")


def token_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line, or for a null text: id, the key, n_lines, pos, t (its tokens' hashes), k1 and k2 (hashes of its text), n (number of tokens)."""
    split = docs.select(F.col("_rw_n").alias("id"), F.col(key).alias("key"), F.split(F.lower(F.col(text).cast("string")), "\n").alias("lines"))
    # counted before the lines are dealt out, so that no line's row carries the whole array
    split = split.select("id", "key", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), "lines")
    every = split.select("id", "key", "n_lines", F.posexplode_outer("lines").alias("pos", "line"))
    every = every.select("id", "key", "n_lines", F.coalesce("pos", F.lit(0)).alias("pos"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"),
                         F.when(F.coalesce(F.col("line"), F.lit("")) != "", _tokens(F.col("line"))).otherwise(F.array().cast("array<int>")).alias("t"))
    # steps that need no tokens read their number, not the tokens
    return cut(every.withColumn("n", F.size("t")), **PLAIN)


def rarity(sets: DataFrame) -> Column:
    """For each hash bucket a number from 0 to 127, larger if its tokens are more frequent; over all lines."""
    counts = sets.select(F.explode("t").alias("h")).select(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).groupBy("b").count().toArrow()  # BUCKETS rows at most
    table = np.zeros(BUCKETS)
    table[counts["b"].to_numpy()] = counts["count"].to_numpy()
    ranks = np.minimum(127, np.floor(3 * np.log2(1 + table))).astype(int).tolist()
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")  # one literal, made into an array by the JVM


def _when_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, counted here, are within the bound."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _differ(x: str, y: str) -> Column:
    """At least so many tokens are in one of the sets alone."""
    one, two = (lambda a: F.bit_count(F.col(f"{x}.{a}").bitwiseXOR(F.col(f"{y}.{a}")))), (lambda s: F.col(f"{s}.b1").bitwiseXOR(F.col(f"{s}.b2")))
    return F.when((F.col(f"{x}.n") >= WIDE) & (F.col(f"{y}.n") >= WIDE), one("b1") + one("b2")).otherwise(F.bit_count(two(x).bitwiseXOR(two(y))))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(x, y) pairs -> o, the later line of those whose token sets have the similarity."""
    pairs = cut(pairs)
    needed = cut(pairs.select(F.explode(F.array("x", "y")).alias("line")).distinct())
    found = cut(sets.join(_when_small(needed), F.col("o") == F.col("line"), "left_semi").select("o", "t").dropDuplicates(["o"]), **PLAIN)
    both = pairs.join(found.select(F.col("o").alias("x"), F.col("t").alias("tx")), "x").join(found.select(F.col("o").alias("y"), F.col("t").alias("ty")), "y")
    common = F.size(F.array_intersect("tx", "ty"))
    # common >= least * union with `common` on one side, so that it is computed once
    return cut(both.where((1 + least) * common >= least * (F.size("tx") + F.size("ty")) - 1e-9).select(F.col("y").alias("o")).distinct())


def _removed(sets: DataFrame, least: float) -> DataFrame:
    """Token sets with the line number o -> o of every line that goes."""
    spark = sets.sparkSession
    lines = sets.where("n > 0")
    slim = lines.select("o", "k1", "k2")
    classes = cut(slim.groupBy("k1", "k2").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first <> last").select("k1", "k2", "first"))
    copies = cut(slim.join(_when_small(classes), ["k1", "k2"]).where("o <> first").select("o"))
    sweep(spark)

    table = rarity(lines)
    # never null, which lets Spark sort these as plain longs
    place = lambda h: F.coalesce(F.shiftleft(F.get(table, h.bitwiseAND(BUCKETS - 1)), 32) + h, F.lit(0).cast("long"))
    # a token flips one bit, which the last bits of its hash name
    parity = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h)))
    wide = F.col("n") >= WIDE
    half = lambda bit: parity(F.filter("t", lambda h: h.bitwiseAND(64) == bit))
    firsts = lines.join(_when_small(copies), "o", "left_anti").select("o", "n", "t", F.sort_array(F.transform("t", place)).alias("s"))
    low = lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")
    rarer = F.transform(F.slice("s", F.lit(1), F.ceil(F.col("n") / 2).cast("int")), lambda x: x.bitwiseAND(0xFFFFFFFF))
    firsts = cut(firsts.select(
        "o", "n", F.when(wide, half(0)).otherwise(parity(F.col("t"))).alias("b1"), F.when(wide, half(64)).otherwise(F.lit(0).cast("long")).alias("b2"),
        F.transform(F.slice("s", F.lit(1), (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int")), low).alias("prefix"), rarer.alias("r"),
    ).select("o", "n", "b1", "b2", "prefix", F.xxhash64(F.lit(0), F.array_min("r"), F.lit(0)).alias("r1"), F.xxhash64(F.lit(1), F.array_max("r"), F.lit(0)).alias("r2")), **PLAIN)

    # the first class of each star key against the others
    few = (1 - least) / (1 + least) * (F.col("x.n") + F.col("y.n")) + 1e-9
    near = (F.col("x.n") >= least * F.col("y.n") - 1e-9) & (F.col("y.n") >= least * F.col("x.n") - 1e-9) & (_differ("x", "y") <= few)
    arms = firsts.select("o", "n", "b1", "b2", F.explode(F.array("r1", "r2")).alias("r"))
    heads = arms.groupBy("r").agg(F.min("o").alias("first"), F.count("*").alias("f")).where("f > 1")
    heads = arms.join(heads, "r").where("o = first").select("r", "o", "n", "b1", "b2")
    star = heads.alias("x").join(arms.alias("y"), (F.col("x.r") == F.col("y.r")) & (F.col("x.o") < F.col("y.o")) & near).select(F.col("x.o").alias("x"), F.col("y.o").alias("y")).distinct()
    settled = _verified(star, lines, least)
    sweep(spark)

    # prefixes; `most` is the size that a larger partner may have, 0 beyond the smaller set's prefix
    closed = settled.withColumn("closed", F.lit(True))
    smaller = F.col("n") - F.ceil(2 * least / (1 + least) * F.col("n") - 1e-9) + 1
    rows = firsts.join(_when_small(closed), "o", "left").select("o", "n", "b1", "b2", F.col("closed").isNull().alias("open"), F.posexplode("prefix").alias("at", "token"))
    rows = rows.select("o", "n", "b1", "b2", "open", "at", "token", F.when(F.col("at") < smaller, F.floor(F.col("n") / least + 1e-9)).otherwise(0).cast("int").alias("most"))
    # the last term always holds; with it both sides have the same columns, so that Spark shuffles the rows once
    length = (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.n")) & (F.col("x.most") + F.col("y.most") > 0)
    unlike = (F.col("x.n") < F.col("y.n")) | (F.col("x.o") < F.col("y.o"))
    need = F.ceil(least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    position = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    looking = F.when(F.col("x.o") < F.col("y.o"), F.col("y.open")).otherwise(F.col("x.open"))
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & length & unlike & position & (_differ("x", "y") <= few) & looking)
    rest = met.select(F.least("x.o", "y.o").alias("x"), F.greatest("x.o", "y.o").alias("y")).distinct()
    return copies.unionByName(settled).unionByName(_verified(rest, lines, least)).distinct()


def removals(docs: DataFrame, key: str, text: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs -> (id, key, n_lines) of every document, and (id, removed: sorted places of the lines that go) of those that lose any."""
    with scratch(docs.sparkSession):
        most = 1 << 40
        while True:
            sets = token_sets(numbered(docs, key, text, most), key, text)
            span = sets.agg(F.max(F.abs("id")), F.max("pos")).first()
            bits = int(span[1] or 0).bit_length()
            if most == 0 or int(span[0] or 0).bit_length() + bits <= BITS:
                break
            most = 0  # numbers without gaps take fewer bits
        sets = sets.withColumn("o", F.col("id") * (1 << bits) + F.col("pos"))
        gone = _removed(sets, least).select(F.shiftright("o", bits).alias("id"), F.col("o").bitwiseAND((1 << bits) - 1).cast("int").alias("pos"))
        removed = cut(gone.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("removed")), keep=True)
        every = cut(sets.where("pos = 0").select("id", "key", "n_lines"), keep=True)
    return every, removed


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs -> key, n_lines, removed (sorted line numbers from 0)."""
    every, removed = removals(docs, key, text, least)
    return every.join(removed, "id", "left").select(F.col("key").alias(key), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with the lines that go taken out of the text; documents that lose every line with a word go."""
    every, removed = removals(docs, key, text, least)
    return _without(numbered(docs, key, text), every, removed, text).select(*docs.columns)


def _without(marked: DataFrame, every: DataFrame, removed: DataFrame, text: str) -> DataFrame:
    lost = removed.join(every.select("id", "n_lines").distinct(), "id")
    stay = lost.select(F.col("id").alias("_rw_id"), F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), "removed").alias("_rw_stay"))
    joined = marked.join(stay, F.col("_rw_n") == F.col("_rw_id"), "left").withColumn("_rw_lines", F.when(F.col("_rw_id").isNotNull(), F.split(text, "\n")))
    kept = F.when(F.size("_rw_lines") > 0, F.array_join(F.transform("_rw_stay", lambda p: F.get("_rw_lines", p)), "\n"))
    joined = joined.withColumn(text, F.when(F.col("_rw_id").isNull(), F.col(text)).otherwise(kept))
    return joined.where(F.col("_rw_id").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
