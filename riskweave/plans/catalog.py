"""The named queries over the standard tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, text
from ..operators import audit, detect, exposure, filterlang, labels, merge, quality, report, score, spans, triggers
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The keys of a table, dealt over all cores.  Of a narrow table Spark reads millions of rows in one task, and what makes a text of each key would stay in it."""
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _t(spark, d, name).select(key).repartition(n, key)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SUM = "list_sum([CASE WHEN i % 2 = 1 THEN (substr(value, i, 1)::INT * 2) // 10 + (substr(value, i, 1)::INT * 2) % 10 ELSE substr(value, i, 1)::INT END for i in range(1, 17)])"
_FOUND = r"""raw AS (
  SELECT doc_id, 'EMAIL' AS entity_type, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'CREDIT_CARD', unnest(regexp_extract_all(text, '\b[0-9]{16}\b')) FROM documents
  UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) FROM documents
  UNION ALL SELECT doc_id, 'PHONE', unnest(regexp_extract_all(text, '\([0-9]{3}\) [0-9]{3}-[0-9]{4}')) FROM documents
  UNION ALL SELECT doc_id, 'AWS_ACCESS_KEY', unnest(regexp_extract_all(text, '\bAKIA[A-Z2-7]{16}\b')) FROM documents
  UNION ALL SELECT doc_id, 'SECRET', unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) FROM documents),
judged AS (SELECT *, CASE entity_type WHEN 'EMAIL' THEN 0.96 WHEN 'AWS_ACCESS_KEY' THEN 0.99 WHEN 'SECRET' THEN 0.9
  WHEN 'CREDIT_CARD' THEN CASE WHEN regexp_matches(value, '^(4|5[1-5]|2[2-7]|3[0-9]|6)') THEN CASE WHEN """ + _SUM + r""" % 10 = 0 THEN 0.99 ELSE 0.87 END END
  WHEN 'IP_ADDRESS' THEN CASE WHEN regexp_matches(value, '^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$') THEN 0.9 END
  WHEN 'PHONE' THEN CASE WHEN substr(value, 2, 1) NOT IN ('0', '1') AND substr(value, 2, 3) NOT IN ('555', '911', '411') THEN 0.9 END END::DOUBLE AS confidence FROM raw),
found AS (SELECT * FROM judged WHERE confidence IS NOT NULL),
counted AS (SELECT doc_id, entity_type, count(*) AS n, avg(confidence) AS c FROM found GROUP BY 1, 2)"""
_SCORED = _FOUND + r""",
weighed AS (SELECT *, CASE entity_type WHEN 'EMAIL' THEN 5 WHEN 'CREDIT_CARD' THEN 10 WHEN 'IP_ADDRESS' THEN 4 WHEN 'PHONE' THEN 4 ELSE 10 END AS w FROM counted),
objects AS (SELECT doc_id, sum(w * 4.0 * (1 + ln(n))) AS base, sum(c * n) / sum(n) AS conf, sum(n)::BIGINT AS entity_count,
  CASE WHEN bool_or(entity_type IN ('AWS_ACCESS_KEY', 'SECRET')) THEN 1.5 ELSE 1.0 END AS co FROM weighed GROUP BY 1),
contents AS (SELECT *, least(100.0, base * conf * co) AS content FROM objects),
scored AS (SELECT *, content AS final, round_even(content, 0)::INT AS score, CASE WHEN content >= 80 THEN 'CRITICAL' WHEN content >= 55 THEN 'HIGH' WHEN content >= 31 THEN 'MEDIUM' WHEN content >= 11 THEN 'LOW' ELSE 'MINIMAL' END AS tier FROM contents)"""
_RESULTS = _SCORED + r""",
results AS (SELECT d.doc_id, '/' || d.source || '/' || d.lang || '/' || d.doc_id || '.txt' AS path, d.n_chars AS size_bytes, s.score, coalesce(s.tier, 'MINIMAL') AS tier, coalesce(s.entity_count, 0) AS entity_count, d.lang, d.source
  FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score.score(detect.counts(_t(spark, d, "documents")))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Scan results of documents: one aggregate for the scores, one join."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    found = detect.counts(_t(spark, d, "documents"))
    entities = found.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "count")))).alias("entities"))
    joined = docs.join(score.score(found).select("doc_id", "score", "tier", "entity_count"), "doc_id", "left").join(entities, "doc_id", "left")
    return joined.select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size_bytes"), "score",
        F.coalesce("tier", F.lit("MINIMAL")).alias("tier"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("entities", F.create_map().cast("map<string,bigint>")).alias("entities"), F.lit(None).cast("string").alias("error"), "lang", "source")


@query("WITH " + _SCORED + " SELECT doc_id, score, tier, round_even(content, 1) AS content_score, entity_count FROM scored")
def pii_doc_scores(spark, d):
    return _scored(spark, d).select("doc_id", "score", "tier", "content_score", "entity_count")


@query("WITH " + _SCORED + " SELECT tier, count(*) AS docs, sum(entity_count)::BIGINT AS entities FROM scored GROUP BY 1")
def pii_tier_distribution(spark, d):
    return _scored(spark, d).groupBy("tier").agg(F.count("*").alias("docs"), F.sum("entity_count").alias("entities"))


@query("WITH " + _FOUND + ' SELECT entity_type, count(*) AS "count", count(DISTINCT doc_id) AS docs, round(avg(confidence), 6) AS confidence FROM found GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20')
def entity_histogram_top20(spark, d):
    rows = detect.findings(_t(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("entity_type").agg(F.count("*").alias("count"), F.count_distinct("doc_id").alias("docs"), F.round(F.avg("confidence"), 6).alias("confidence")).orderBy(F.desc("count"), "entity_type").limit(20)


@query("WITH " + _FOUND + " SELECT d.lang, d.source, count(*) AS entities, count(DISTINCT f.doc_id) AS docs FROM found f JOIN documents d ON d.doc_id = f.doc_id GROUP BY ROLLUP (d.lang, d.source)")
def pii_by_lang_source_rollup(spark, d):
    rows = detect.findings(_t(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("entities"), F.count_distinct("doc_id").alias("docs"))


@query("WITH " + _FOUND + " SELECT lower(split_part(value, '@', 2)) AS domain, count(*) AS emails, count(DISTINCT lower(value)) AS addresses FROM found WHERE entity_type = 'EMAIL' GROUP BY 1")
def email_domains(spark, d):
    rows = detect.findings(_t(spark, d, "documents").select("doc_id", "text"), types=("EMAIL",))
    return rows.groupBy(F.lower(F.substring_index("value", "@", -1)).alias("domain")).agg(F.count("*").alias("emails"), F.count_distinct(F.lower("value")).alias("addresses"))


@query("WITH " + _FOUND + " SELECT confidence, count(*) AS cards FROM found WHERE entity_type = 'CREDIT_CARD' GROUP BY 1")
def card_luhn_confidence(spark, d):
    return detect.findings(_t(spark, d, "documents").select("doc_id", "text"), types=("CREDIT_CARD",)).groupBy("confidence").agg(F.count("*").alias("cards"))


@query("WITH " + _FOUND + " SELECT doc_id, substr(sha256(value), 1, 6) AS value_hash, substr(value, 1, 2) || repeat('*', length(value) - 4) || substr(value, -2) AS preview FROM found WHERE entity_type = 'SECRET'")
def secret_token_hash(spark, d):
    rows = detect.findings(_t(spark, d, "documents").select("doc_id", "text"), types=("SECRET",))
    return rows.select("doc_id", text.value_hash(F.col("value"), F.col("entity_type")).alias("value_hash"), text.redacted(F.col("value")).alias("preview"))


@query("WITH " + _FOUND + " SELECT entity_type, substr(sha256(CASE WHEN entity_type = 'EMAIL' THEN lower(trim(value)) WHEN entity_type = 'PHONE' THEN regexp_replace(value, '[^0-9+]', '', 'g') ELSE value END), 1, 6) AS value_hash, count(DISTINCT doc_id) AS docs, count(*) AS places FROM found GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1")
def value_correlation(spark, d):
    rows = detect.findings(_t(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("entity_type", text.value_hash(F.col("value"), F.col("entity_type")).alias("value_hash")).agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("places")).where("docs > 1")


@query("SELECT substr(sha256(text), 1, 12) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark, d):
    return _t(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("WITH " + _RESULTS + """ SELECT count(*) AS total_files, 0::BIGINT AS error_count, sum(size_bytes)::BIGINT AS total_size, round(avg(score), 6) AS mean_score, median(score) AS median_score, min(score) AS min_score, max(score) AS max_score,
  count(*) FILTER (tier = 'MINIMAL') AS tier_minimal, count(*) FILTER (tier = 'LOW') AS tier_low, count(*) FILTER (tier = 'MEDIUM') AS tier_medium, count(*) FILTER (tier = 'HIGH') AS tier_high, count(*) FILTER (tier = 'CRITICAL') AS tier_critical FROM results""")
def report_summary(spark, d):
    return report.summary(_results(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("WITH " + _RESULTS + " SELECT least(floor(score / 10), 9)::BIGINT * 10 AS from_score, count(*) AS files FROM results WHERE score IS NOT NULL GROUP BY 1")
def score_deciles(spark, d):
    return report.score_deciles(_results(spark, d))


@query("WITH " + _RESULTS + " SELECT path, score, tier FROM results WHERE score IS NOT NULL ORDER BY score DESC, path LIMIT 25")
def top_risk(spark, d):
    return report.ordered(_results(spark, d).where("score is not null"), limit=25).select("path", "score", "tier")


def _find(name: str, expression: str, where: str) -> None:
    def find(spark, d):
        rows = _results(spark, d)
        fields = filterlang.Fields({"path": F.col("path"), "score": F.col("score"), "tier": F.col("tier"), "size": F.col("size_bytes"), "source": F.col("source")}, F.col("entities"))
        return rows.where(filterlang.parse(expression, fields)).select("doc_id", "path", "score", "tier", "entity_count")

    find.__name__, find.__doc__ = name, expression
    query("WITH " + _RESULTS + f" SELECT doc_id, path, score, tier, entity_count FROM results r WHERE {where}")(find)


_HAS = "EXISTS (SELECT 1 FROM counted c WHERE c.doc_id = r.doc_id AND c.entity_type = '{}')"
_find("find_score", "score >= 30", "score >= 30")
_find("find_tier_or_size", "tier = LOW OR size > 5000", "tier = 'LOW' OR size_bytes > 5000")
_find("find_has_and", f"has(EMAIL) AND score > 15", _HAS.format("EMAIL") + " AND score > 15")
_find("find_left_fold", "has(SECRET) OR tier = LOW AND size < 2000", "(" + _HAS.format("SECRET") + " OR tier = 'LOW') AND size_bytes < 2000")
_find("find_missing", "missing(score) AND path contains src1", "score IS NULL AND contains(path, 'src1')")
_find("find_not_equal", "tier != MINIMAL AND path matches '/en/[0-9]+5'", "tier <> 'MINIMAL' AND regexp_matches(path, '/en/[0-9]+5')")
_find("find_entity_count", "entity_count >= 2 OR score != 19", "entity_count >= 2 OR (score IS NOT NULL AND score <> 19)")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabeled_docs(spark, d):
    return labels.unlabelled(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("WITH " + _SCORED + " SELECT l.quality, l.toxic, s.tier, count(*) AS docs, round(avg(s.score), 6) AS mean_score FROM scored s JOIN labels l ON l.doc_id = s.doc_id GROUP BY 1, 2, 3")
def high_risk_quality_join(spark, d):
    return _scored(spark, d).join(_t(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "tier").agg(F.count("*").alias("docs"), F.round(F.avg("score"), 6).alias("mean_score"))


def _versions(spark, d):
    """Events as label versions: a user is a label."""
    return _t(spark, d, "events").select(F.col("user_id").alias("label_id"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("content_hash"), F.round("value", 4).alias("risk_score"), "event_type")


@query("SELECT label_id, scanned_at, content_hash, risk_score FROM (SELECT user_id AS label_id, ts AS scanned_at, event_id AS content_hash, round(value, 4) AS risk_score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def label_latest_version(spark, d):
    return labels.latest(_versions(spark, d)).select("label_id", "scanned_at", "content_hash", "risk_score")


@query("SELECT label_id, content_hash, version FROM (SELECT user_id AS label_id, event_id AS content_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS version FROM events) WHERE version <= 3")
def label_history(spark, d):
    return labels.history(_versions(spark, d), 3).select("label_id", "content_hash", "version")


@query("SELECT c.c_custkey AS label_id, o.o_orderkey AS content_hash, o.o_orderdate AS scanned_at FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice >= 150000 ORDER BY o.o_orderdate DESC, 1, 2 LIMIT 100")
def label_query(spark, d):
    objects = _t(spark, d, "customer").select(F.col("c_custkey").alias("label_id"), F.col("c_mktsegment").alias("tenant_id"))
    versions = _t(spark, d, "orders").select(F.col("o_custkey").alias("label_id"), F.col("o_orderkey").alias("content_hash"), F.col("o_orderdate").alias("scanned_at"), F.col("o_totalprice").alias("risk_score"))
    return labels.query(objects, versions, "BUILDING", min_score=150000).select("label_id", "content_hash", "scanned_at")


@query("""SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'created' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS change
  FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0) b FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) a ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s""")
def snapshot_diff(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    before = orders.where("o_orderkey % 7 <> 0")
    after = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return labels.snapshot_diff(before, after, "o_orderkey", ["o_orderstatus"])


def _two_sources(spark, d):
    docs = _t(spark, d, "documents")
    one = detect.counts(docs).select(F.col("doc_id").alias("object_id"), F.lit(0).alias("input_ord"), "entity_type", "count", "confidence", F.lit("pattern").alias("source"))
    two = one.where("object_id % 2 = 0").select("object_id", F.lit(1).alias("input_ord"), "entity_type", (F.col("count") + 1).alias("count"), F.lit(0.75).alias("confidence"), F.lit("other").alias("source"))
    return one.unionByName(two)


for _name, _count, _conf in (("max", "max(n)", "max(c)"), ("sum", "sum(n)::BIGINT", "max(c)"), ("first", "min_by(n, o)", "min_by(c, o)")):
    def _merged(spark, d, strategy=_name):
        rows = merge.findings(_two_sources(spark, d), strategy)
        return rows.select("object_id", "entity_type", "count", F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"))

    _merged.__name__ = f"merge_{_name}"
    query("WITH " + _FOUND + f""", pairs AS (SELECT doc_id, 0 AS o, entity_type, n, c, 'pattern' AS s FROM counted UNION ALL SELECT doc_id, 1, entity_type, n + 1, 0.75, 'other' FROM counted WHERE doc_id % 2 = 0)
      SELECT doc_id AS object_id, entity_type, {_count} AS "count", round({_conf}, 6) AS confidence, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM pairs GROUP BY 1, 2""")(_merged)


@query("WITH " + _SCORED + """, e AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'ORG_WIDE' ELSE 'PUBLIC' END AS exposure, least(100.0, content * CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.2 WHEN 2 THEN 1.8 ELSE 2.5 END) AS f FROM contents)
  SELECT doc_id, exposure, round_even(f, 0)::INT AS score, CASE WHEN f >= 80 THEN 'CRITICAL' WHEN f >= 55 THEN 'HIGH' WHEN f >= 31 THEN 'MEDIUM' WHEN f >= 11 THEN 'LOW' ELSE 'MINIMAL' END AS tier FROM e""")
def exposure_score(spark, d):
    rows = detect.counts(_t(spark, d, "documents")).withColumn("exposure", score.exposure_name(F.col("doc_id") % 4))
    return score.score(rows, exposure="exposure").select("doc_id", "exposure", "score", "tier")


@query("WITH " + _FOUND + """, x AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'ORG_WIDE' ELSE 'PUBLIC' END AS exposure, d.doc_id % 3 = 0 AS unencrypted, d.doc_id % 800 > 365 AS stale,
    d.doc_id % 5 <> 0 AS labelled, (SELECT count(*) FROM counted c WHERE c.doc_id = d.doc_id) AS k FROM documents d),
  t AS (SELECT *, concat_ws(',', CASE WHEN k = 0 OR NOT labelled THEN 'no_labels' END, CASE exposure WHEN 'PUBLIC' THEN 'public_access' WHEN 'ORG_WIDE' THEN 'org_wide' END, CASE WHEN unencrypted THEN 'no_encryption' END, CASE WHEN stale THEN 'stale_data' END) AS triggers,
    least(100, CASE exposure WHEN 'INTERNAL' THEN 10 WHEN 'ORG_WIDE' THEN 30 WHEN 'PUBLIC' THEN 50 ELSE 0 END + CASE WHEN unencrypted THEN 20 ELSE 0 END + CASE WHEN stale THEN 5 ELSE 0 END + CASE WHEN k = 0 OR NOT labelled THEN 15 ELSE 0 END) AS priority FROM x)
  SELECT doc_id, triggers, priority, CASE WHEN triggers = '' THEN 'NONE' WHEN priority >= 75 THEN 'IMMEDIATE' WHEN priority >= 50 THEN 'HIGH' WHEN priority >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM t""")
def scan_triggers_priority(spark, d):
    found = detect.counts(_t(spark, d, "documents")).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("entity_type").alias("type"), "count", "confidence")).alias("entities"))
    rows = _t(spark, d, "documents").select("doc_id").join(found, "doc_id", "left")
    level = score.exposure_name(F.col("doc_id") % 4)
    names = triggers.triggers(F.col("entities"), F.col("doc_id") % 5 != 0, level, F.when(F.col("doc_id") % 3 == 0, "none").otherwise("platform"), F.col("doc_id") % 800)
    rows = rows.select("doc_id", names.alias("t"), triggers.priority(level, names).alias("priority"))
    return rows.select("doc_id", F.array_join("t", ",").alias("triggers"), "priority", triggers.urgency(F.col("priority"), F.col("t")).alias("urgency"))


@query(r"""WITH p AS (SELECT '/' || regexp_extract(url, '^https?://([^/]+)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/$', '') AS path, length(html) AS n FROM pages WHERE url IS NOT NULL),
  parts AS (SELECT n, list_filter(string_split(path, '/'), lambda x: x <> '') AS q FROM p),
  up AS (SELECT n, '/' || array_to_string(q[1:k], '/') AS directory, k AS depth FROM (SELECT n, q, unnest(range(0, len(q))) AS k FROM parts))
  SELECT directory, depth::INT AS depth, count(*) AS files, sum(n)::BIGINT AS size_bytes FROM up GROUP BY 1, 2""")
def page_host_rollup(spark, d):
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1), "/$", ""))
    rows = _t(spark, d, "pages").where("url is not null").select(path.alias("path"), F.length("html").alias("size_bytes"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("error"))
    return report.directory_tree(rows).select("directory", "depth", "files", "size_bytes")


@query("WITH " + _RESULTS + """, up AS (SELECT size_bytes, score, unnest(['/', '/' || source, '/' || source || '/' || lang]) AS directory FROM results)
  SELECT directory, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, round(avg(score), 6) AS mean_score, max(score) AS max_score FROM up GROUP BY 1""")
def directory_rollup(spark, d):
    return report.directory_tree(_results(spark, d)).select("directory", "files", "size_bytes", F.round("mean_score", 6).alias("mean_score"), "max_score")


@query("""WITH l AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l)
  SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def events_debounce(spark, d):
    return watch.debounced_batch(_t(spark, d, "events"), 3600, key="user_id").select("user_id", "session", "events", "first_ts", "last_ts")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  SELECT event_type, count(*) AS "count", min(value) AS "min", max(value) AS "max", min(value) FILTER (k > floor(n * 0.5)) AS p50, min(value) FILTER (k > floor(n * 0.95)) AS p95, min(value) FILTER (k > floor(n * 0.99)) AS p99 FROM r GROUP BY 1""")
def percentile_latency(spark, d):
    return report.percentiles(_t(spark, d, "events"), "value", by=("event_type",))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('1:' || doc_id), doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 10 ELSE 0 END""")
def stratified_sample(spark, d):
    return report.stratified(_t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 50, "fr": 20, "de": 10})


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 3 AS s, l_linenumber * 3 + (l_quantity::BIGINT % 7) + 1 AS e FROM lineitem),
  m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS n FROM x),
  r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT doc_id, min(s)::BIGINT AS "start", max(e)::BIGINT AS "end" FROM r GROUP BY doc_id, k""")
def interval_islands(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 3).cast("long").alias("start"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("long") % 7 + 1).alias("end"))
    return spans.islands(rows)


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS reason_key FROM customer WHERE c_custkey % 10 = 3""")
def label_verify(spark, d):
    files = _t(spark, d, "customer").select(F.col("c_custkey"), "c_mktsegment", F.col("c_custkey").alias("path"), F.lit("h").alias("content_hash"))
    known = files.where("c_custkey % 10 <> 3").select("path", "content_hash")
    return labels.verified(files, known).where("reason = 'no_label'").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("reason_key"))


@query("""WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS v FROM conversations),
  f AS (SELECT conv_id, v, min(turn) AS first_turn FROM c GROUP BY 1, 2)
  SELECT c.conv_id, c.turn, c.v AS value, count(*) AS places FROM c JOIN f ON f.conv_id = c.conv_id AND f.v = c.v AND c.turn > f.first_turn GROUP BY 1, 2, 3""")
def conversation_known_values(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("value"))
    first = rows.groupBy("conv_id", "value").agg(F.min("turn").alias("first_turn"))
    return rows.join(first, ["conv_id", "value"]).where("turn > first_turn").groupBy("conv_id", "turn", "value").agg(F.count("*").alias("places"))


@query(r"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS addresses, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS chars FROM pages""")
def page_text_pii(spark, d):
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    return _t(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(plain, F.lit(detect.NATIVE["IP_ADDRESS"][0]), F.lit(0))).cast("long").alias("addresses"), F.length(plain).cast("long").alias("chars"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 3 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS rank FROM part")
def bucket_exposure(spark, d):
    k = F.col("p_size") % 4
    yes, no = F.lit(True), F.lit(False)
    rank = exposure.s3(F.when(k == 0, "public-read").otherwise("private"), k != 0, no, no, k == 1, k == 2)
    return _t(spark, d, "part").select("p_partkey", rank.alias("rank"))


@query("SELECT n_nationkey, n_name, upper(substr(sha256(n_name), 1, 6)) AS hash, n_nationkey % 2 = 0 AS valid FROM nation")
def checksum_nations(spark, d):
    """Check digits that are made valid for every second row."""
    body = F.lpad(F.col("n_nationkey").cast("string"), 9, "4")
    good = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(body, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    digit = F.substring(good, 10, 1).cast("int")
    value = F.when(F.col("n_nationkey") % 2 == 0, good).otherwise(F.concat(body, ((digit + 1) % 10).cast("string")))
    return _t(spark, d, "nation").select("n_nationkey", "n_name", F.upper(F.substring(F.sha2("n_name", 256), 1, 6)).alias("hash"), checksums.luhn(value).alias("valid"))


@query()
def doc_spans(spark, d):
    """All rules with offsets, spans cleaned, conflicts resolved."""
    return detect.resolved(_t(spark, d, "documents"))


@query()
def span_type_counts(spark, d):
    return detect.spans(_t(spark, d, "documents")).groupBy("entity_type").agg(F.count("*").alias("spans"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT user_id AS chain, count(*) AS entries, 0::BIGINT AS broken FROM events GROUP BY 1")
def audit_chain_verify(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("timestamp"), F.col("user_id").cast("string"), F.col("event_type").alias("action"), F.coalesce("props", F.lit("")).alias("details"))
    chained = audit.chained(rows)
    bad = audit.broken(chained).groupBy("chain").agg(F.count("*").alias("broken"))
    return chained.groupBy("chain").agg(F.count("*").alias("entries")).join(bad, "chain", "left").select("chain", "entries", F.coalesce("broken", F.lit(0)).alias("broken"))
