"""The queries of this subpackage, each its operator over a whole table; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._support import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shingles

    return shingles.join(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectors

    return vectors.links(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, prototypes)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pseudonyms

    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="riskweave demonstration key")
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *[of(k).alias(f"n_{k}") for k, _ in pseudonyms.KINDS])


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import leaks

    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read(warc.archive(table(spark, sf_dir, "pages"))).drop("payload")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    found = lines.decide(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in dict(globals()).items() if name.startswith("op") and callable(f)}

SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, max(page_id) AS m, count(*) AS k FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
        SELECT p.page_id, p.url, p.n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.m IS NOT NULL AND f.m IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.m IS DISTINCT FROM p.page_id THEN f.m END AS refers_to
        FROM p LEFT JOIN f ON f.d = p.d""",
}
