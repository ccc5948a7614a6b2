"""More named queries: index, queue, manifests, ladders, check digits, span refinement, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry
from ..functions import checksums, text
from ..operators import actions, audit, detect, dictionary, exposure, labels, queue, refine, report, score
from ..sinks import reports
from .catalog import _RESULTS, _results, _spread, _t, query
from .engine import Engine, process, process_content

_REGISTRY = "reg(entity_type, weight, category) AS (VALUES " + ", ".join(f"('{t}', {w}, '{c}')" for t, (w, c) in sorted(registry.WEIGHTS.items())) + ")"


@query("WITH " + _REGISTRY + " SELECT category, count(*) AS types, sum(CASE WHEN weight >= 8 THEN 1 ELSE 0 END)::BIGINT AS high_risk FROM reg GROUP BY 1")
def registry_categories(spark, d):
    table = registry.dimension(spark)
    high = registry.high_risk(table).withColumn("high", F.lit(1))
    return table.join(high.select("entity_type", "high"), "entity_type", "left").groupBy("category").agg(F.count("*").alias("types"), F.coalesce(F.sum("high"), F.lit(0)).alias("high_risk"))


@query("""SELECT 'SSN' AS entity_type, 3 AS weight, 'direct_identifier' AS category UNION ALL SELECT 'EMAIL', 9, 'contact' UNION ALL SELECT 'BADGE', 4, 'custom' UNION ALL SELECT 'PHONE', 4, 'contact'""")
def registry_overrides(spark, d):
    """System, then user overrides: the later wins, weights out of range and repeats do no harm."""
    kind = "entity_type string, weight int, category string"
    system = spark.createDataFrame([("ssn", 2, None), ("EMAIL", 9, None), ("phone", 11, None)], kind)
    user = spark.createDataFrame([(" SSN ", 3, None), ("SSN", 1, None), ("BADGE", 4, "custom")], kind)
    return registry.dimension(spark, system, user).where("entity_type in ('SSN', 'EMAIL', 'BADGE', 'PHONE')")


_INVENTORY = "WITH " + _RESULTS


@query(_INVENTORY + """ SELECT r.path, r.score, r.tier FROM results r WHERE coalesce(r.score, 0) >= 10 AND contains(lower(r.path), '/en/')
  AND EXISTS (SELECT 1 FROM counted c WHERE c.doc_id = r.doc_id AND c.entity_type = 'EMAIL')""")
def inventory_filter(spark, d):
    return labels.inventory(_results(spark, d), entity="email", min_score=10, path_contains="/EN/").select("path", "score", "tier")


@query(_INVENTORY + """, e AS (SELECT doc_id, string_agg(entity_type || ':' || n, '|' ORDER BY entity_type) AS e FROM counted GROUP BY 1)
  SELECT r.path || ',' || coalesce(r.score, 0) || ',' || r.tier || ',' || coalesce(e.e, '') || ',' || r.source AS value FROM results r LEFT JOIN e ON e.doc_id = r.doc_id""")
def inventory_csv(spark, d):
    return reports.inventory_csv(_results(spark, d).withColumn("exposure", F.col("source")))


@query(_INVENTORY + """ SELECT path, 'quarantine' AS action, '/safe/' || substr(path, 7) AS target, 'score >= 20' AS reason, true AS dry_run, false AS done FROM results
  WHERE score >= 20 AND starts_with(path, '/src1/') AND doc_id % 2 = 0 UNION ALL
  SELECT path, 'quarantine', '/safe/' || doc_id || '.txt', 'score >= 20', true, false FROM results WHERE score >= 20 AND NOT starts_with(path, '/src1/') AND doc_id % 2 = 0""")
def quarantine_manifest(spark, d):
    """What a second run plans, when files with odd ids were moved by the first."""
    rows = _results(spark, d)
    done = actions.quarantine(rows.where("doc_id % 2 = 1"), "/src1", "/safe", "score >= 20").withColumn("done", F.lit(True))
    return actions.quarantine(rows, "/src1", "/safe", "score >= 20", dry_run=True, done=done)


@query(_INVENTORY + """ SELECT path, 'restrict' AS action, '640' AS target FROM results WHERE tier = 'LOW' UNION ALL SELECT path, 'encrypt', path || '.enc' FROM results WHERE score >= 15
  UNION ALL SELECT path, 'tag', tier || ':' || score FROM results WHERE score >= 15 UNION ALL SELECT path, 'delete', NULL FROM results WHERE score >= 25
  UNION ALL SELECT path, 'move', '/out' || path FROM results WHERE tier = 'LOW'""")
def action_manifests(spark, d):
    rows = _results(spark, d)
    parts = [actions.restrict(rows, "tier = LOW", exposure.INTERNAL), actions.encrypt(rows, "score >= 15"), actions.tag(rows, "score >= 15"), actions.delete(rows, min_score=25), actions.move(rows, "/", "/out", "tier = LOW")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("path", "action", "target")


@query(_INVENTORY + """ SELECT count(*) AS total_files, round(avg(score), 6) AS mean_score, max(score) AS max_score, min(score) AS min_score,
  sum((tier = 'MINIMAL')::INT) * 100.0 / count(*) AS pct_minimal, sum((tier = 'LOW')::INT) * 100.0 / count(*) AS pct_low, sum((tier = 'MEDIUM')::INT) * 100.0 / count(*) AS pct_medium,
  sum((tier = 'HIGH')::INT) * 100.0 / count(*) AS pct_high, sum((tier = 'CRITICAL')::INT) * 100.0 / count(*) AS pct_critical,
  (SELECT string_agg(entity_type, ',' ORDER BY n DESC, entity_type) FROM (SELECT entity_type, sum(n) AS n FROM counted GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_entities FROM results""")
def shell_stats(spark, d):
    return Engine(spark).stats(_results(spark, d))


def _jobs(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c"))
    level = F.element_at(F.array(*[F.lit(x) for x in score.EXPOSURES]), (F.col("c") % 4 + 1).cast("int"))
    names = F.filter(F.array(F.when(F.col("c") % 3 == 0, "stale_data"), F.when(F.col("c") % 5 == 0, "no_labels"), F.when(F.col("c") % 7 == 0, "low_conf_high_risk")), lambda x: x.isNotNull())
    return rows.select("seq", level.alias("exposure"), names.alias("triggers"), (F.col("c") * 20_000_000 % 150_000_000).alias("size_bytes"), F.when(F.col("c") % 2 == 0, "none").otherwise("platform").alias("encryption"), (F.col("c") % 11 > 0).alias("classified"))


_JOBS = """j AS (SELECT o_orderkey AS seq, o_custkey AS c, o_custkey * 20000000 % 150000000 AS size_bytes FROM orders),
 q AS (SELECT seq, least(100, greatest(0, CASE c % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 50 END + (c % 3 = 0)::INT * 5 + (c % 5 = 0)::INT * 15 + (c % 7 = 0)::INT * 25
   + CASE WHEN size_bytes > 0 AND size_bytes < 1048576 THEN 5 WHEN size_bytes > 104857600 THEN -10 ELSE 0 END)) AS priority,
  least(100, greatest(0, CASE c % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 50 END + (c % 3 = 0)::INT * 5 + (c % 5 = 0)::INT * 15 + (c % 7 = 0)::INT * 25 + (c % 2 = 0)::INT * 20 + (c % 11 = 0)::INT * 15
   + CASE WHEN size_bytes > 0 AND size_bytes < 1048576 THEN 5 WHEN size_bytes > 104857600 THEN -10 ELSE 0 END)) AS in_context FROM j)"""


@query("WITH " + _JOBS + " SELECT seq, priority, in_context FROM q")
def queue_priority(spark, d):
    j = _jobs(spark, d)
    return j.select("seq", queue.priority(F.col("exposure"), F.col("triggers"), F.col("size_bytes")).alias("priority"),
                    queue.priority_in_context(F.col("exposure"), F.col("triggers"), F.col("size_bytes"), F.col("encryption"), F.col("classified")).alias("in_context"))


@query("WITH " + _JOBS + " SELECT seq, priority FROM q ORDER BY priority DESC, seq LIMIT 50")
def queue_next(spark, d):
    return queue.next_jobs(queue_priority(spark, d).select("seq", "priority"), 50)


def _versions(spark, d):
    """Orders as versions of their customer's label, a nation as a tenant."""
    objects = _t(spark, d, "customer").select(F.col("c_custkey").alias("label_id"), F.col("c_nationkey").cast("string").alias("tenant_id"))
    versions = _t(spark, d, "orders").select(F.col("o_custkey").alias("label_id"), F.col("o_orderkey").cast("string").alias("content_hash"), F.col("o_orderdate").cast("timestamp").alias("scanned_at"),
                                             (F.col("o_orderkey") % 101).cast("int").alias("risk_score"), F.col("o_orderpriority").alias("risk_tier"), F.col("o_orderstatus").alias("entity_types"))
    return objects, versions


@query("""SELECT count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 7 AND o.o_orderkey % 101 >= 40 AND o.o_orderpriority = '1-URGENT'""")
def label_query_count(spark, d):
    return labels.count(*_versions(spark, d), tenant="7", min_score=40, tier="1-URGENT")


@query("""SELECT c.c_nationkey::VARCHAR AS tenant_id, count(DISTINCT c.c_custkey) AS labels, count(o.o_orderkey) AS versions FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def tenant_counts(spark, d):
    return labels.tenant_counts(*_versions(spark, d))


@query("""SELECT o.o_orderkey::VARCHAR AS content_hash, o.o_custkey AS label_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 3 AND o.o_orderkey % 101 >= 90""")
def label_export(spark, d):
    """JSON lines, read back."""
    lines = labels.exported(*_versions(spark, d), tenant="3", min_score=90)
    return lines.select(F.from_json("value", "content_hash string, label_id long").alias("r")).select("r.*")


def _entries(spark, d):
    return _t(spark, d, "events").select((F.col("user_id") % 50).alias("chain"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                         F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), F.coalesce("props", F.lit("")).alias("details"))


@query("""WITH e AS (SELECT user_id % 50 AS chain, event_id AS seq, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
 kept AS (SELECT *, n % 23 = 17 AS changed, lag(n) OVER (PARTITION BY chain ORDER BY seq) AS before FROM e WHERE n % 31 <> 9)
 SELECT chain, seq, CASE WHEN coalesce(before, 0) <> n - 1 THEN 'broken_link' ELSE 'altered' END AS reason FROM kept WHERE coalesce(before, 0) <> n - 1 OR changed""")
def audit_tampered(spark, d):
    """Chains in which some entries were changed and others removed: each is found, and nothing else."""
    from pyspark.sql import Window

    rows = audit.chained(_entries(spark, d)).withColumn("n", F.row_number().over(Window.partitionBy("chain").orderBy("seq")))
    rows = rows.withColumn("details", F.when(F.col("n") % 23 == 17, F.concat("details", F.lit("!"))).otherwise(F.col("details"))).where("n % 31 <> 9").drop("n")
    return audit.broken(rows).select("chain", "seq", "reason")


@query("""SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events WHERE event_type = 'click' AND user_id % 10 = 3 ORDER BY 2 DESC, 1 DESC LIMIT 40""")
def audit_read(spark, d):
    return audit.read(_entries(spark, d).where("cast(user_id as long) % 10 = 3"), action="click", limit=40).select("id", "timestamp")


@query("""SELECT (SELECT count(*) FROM events) AS total_entries, (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS oldest, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS newest,
 (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS by_action, (SELECT count(DISTINCT user_id) FROM events) AS users""")
def audit_stats(spark, d):
    s = audit.stats(_entries(spark, d))
    return s.select("total_entries", "oldest", "newest", F.array_join(F.transform("by_action", lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ",").alias("by_action"), F.size("by_user").cast("long").alias("users"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no_label' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' ELSE 'valid' END AS reason FROM documents""")
def label_verify_reasons(spark, d):
    files = _t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("path"), text.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    known = files.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("000000000000")).otherwise(F.col("content_hash")).alias("content_hash"))
    return labels.verified(files, known).select("doc_id", "reason")


@query("""SELECT m, CASE WHEN d THEN CASE r WHEN 0 THEN 448 WHEN 1 THEN 488 WHEN 2 THEN 493 ELSE 511 END ELSE CASE r WHEN 0 THEN 384 WHEN 1 THEN 416 WHEN 2 THEN 420 ELSE 438 END + CASE WHEN x AND r < 3 THEN 64 ELSE 0 END END AS mode, r AS rank
 FROM (SELECT DISTINCT c_custkey % 512 AS m, CASE WHEN c_custkey % 512 & 2 <> 0 THEN 3 WHEN c_custkey % 512 & 4 <> 0 THEN 2 WHEN c_custkey % 512 & 32 <> 0 THEN 1 ELSE 0 END AS r, c_custkey % 512 & 64 <> 0 AS x, c_custkey % 512 & 128 <> 0 AS d FROM customer)""")
def posix_modes(spark, d):
    """Exposure of a file's mode, and the mode that this exposure calls for."""
    m = _t(spark, d, "customer").select((F.col("c_custkey") % 512).alias("m")).distinct()
    rank = exposure.posix(F.col("m").cast("int"))
    return m.select("m", exposure.recommended_mode(rank, F.col("m").bitwiseAND(128) != 0, F.col("m").bitwiseAND(64) != 0).alias("mode"), rank.alias("rank"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 1 WHEN c_custkey % 6 = 1 THEN CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END WHEN c_custkey % 6 = 2 THEN 2 WHEN c_custkey % 6 = 3 THEN 0 WHEN c_custkey % 6 = 4 THEN 1 ELSE 0 END AS rank,
 c_nationkey % 3 = 1 AND c_custkey % 2 = 0 AS crosses FROM customer""")
def direct_permissions(spark, d):
    k, no = F.col("c_custkey"), F.lit(None).cast("string")
    granted = F.struct(
        F.when(k % 6 == 0, "site").alias("site"), F.when(k % 6 == 1, F.when(k % 5 == 0, "Everyone except external users").otherwise("Finance team")).alias("group"),
        F.when(k % 6 == 2, "a_b.com#EXT#@x.org").when(k % 6 == 3, "a@x.org").otherwise(no).alias("user_email"), no.alias("user_type"), F.when(k % 6 == 4, "backup").alias("application"))
    members = F.array(F.lit("user:a@x.org"), F.when(k % 2 == 0, "serviceAccount:job@other").otherwise("serviceAccount:job@mine"))
    project = F.when(F.col("c_nationkey") % 3 == 1, "mine").otherwise("")
    return _t(spark, d, "customer").select("c_custkey", exposure.direct_permission(granted).alias("rank"), exposure.crosses_projects(members, project).alias("crosses"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 16 = 0 THEN '0x00000000' ELSE concat_ws('|', CASE WHEN n_nationkey & 1 <> 0 THEN 'READ_DATA' END, CASE WHEN n_nationkey & 2 <> 0 THEN 'WRITE_DATA' END,
 CASE WHEN n_nationkey & 4 <> 0 THEN 'DELETE' END, CASE WHEN n_nationkey & 8 <> 0 THEN 'GENERIC_READ' END) END AS rights FROM nation""")
def access_rights(spark, d):
    k = F.col("n_nationkey").cast("long")
    mask = k.bitwiseAND(3) + F.when(k.bitwiseAND(4) != 0, 0x10000).otherwise(0) + F.when(k.bitwiseAND(8) != 0, 0x80000000).otherwise(0)
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(exposure.rights(mask), "|").alias("rights"))


_DIGITS = "list_sum([substr(x, i, 1)::INT * CASE WHEN i % 3 = 1 THEN 3 WHEN i % 3 = 2 THEN 7 ELSE 1 END for i in range(1, 10)])"


@query("WITH c AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 % 99999999)::VARCHAR, 8, '0') AS s FROM customer), v AS (SELECT k, '02' || substr(s, 1, 7) AS x, s FROM c) SELECT k, " + _DIGITS + """ % 10 = 0 AS aba,
 (lpad(s, 10, '0') || '0000000013140' || (k % 10))::HUGEINT % 97 = 1 AS iban, (substr(s, 1, 1)::INT + substr(s, 3, 1)::INT + substr(s, 5, 1)::INT + 2 * (substr(s, 2, 1)::INT + substr(s, 4, 1)::INT + substr(s, 6, 1)::INT)) % 10 = substr(s, 7, 1)::INT AS dea,
 (s || s || lpad(k::VARCHAR, 4, '0'))::HUGEINT % 97 = 1 AS lei, CASE WHEN substr(s, 1, 3) IN ('000', '666') OR substr(s, 1, 1) = '9' THEN 0.85 WHEN substr(s, 4, 2) = '00' OR substr(s, 6, 3) || '1' = '0000' THEN 0.8 ELSE 0.99 END::DOUBLE AS ssn FROM v""")
def checksum_identifiers(spark, d):
    k = F.col("c_custkey")
    s = F.lpad((k * 7919 % 99999999).cast("string"), 8, "0")
    return _t(spark, d, "customer").select(
        k.alias("k"), checksums.aba_routing(F.concat(F.lit("02"), F.substring(s, 1, 7))).alias("aba"),
        checksums.iban(F.concat(F.lit("DE0"), (k % 10).cast("string"), F.lpad(s, 10, "0"), F.lit("00000000"))).alias("iban"), checksums.dea(F.concat(F.lit("AB"), F.substring(s, 1, 7))).alias("dea"),
        checksums.lei(F.concat(s, s, F.lpad(k.cast("string"), 4, "0"))).alias("lei"), checksums.ssn_confidence(F.concat(s, F.lit("1"))).alias("ssn"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿœß0-9]+')) AS t FROM documents)
 SELECT doc_id, t AS term, count(*) AS places FROM w WHERE t IN ('estion', 'thereou', 'erhe', 'inre', 'ration', 'einver', 'ciónue', 'onthe') GROUP BY 1, 2""")
def dictionary_terms(spark, d):
    terms = spark.createDataFrame([(t, "TERM") for t in ("estion", "thereou", "erhe", "inre", "ration", "einver", "ciónue", "onthe")], "term string, entity_type string")
    return dictionary.matches(_t(spark, d, "documents"), terms, most=3).groupBy("doc_id", F.lower("text").alias("term")).agg(F.count("*").alias("places"))


@query("""SELECT c_custkey AS doc_id, 'NAME' AS entity_type, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'ACCOUNT_NUMBER', 'AC' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'EMAIL', 'u' || c_custkey || '@mail.org' FROM customer""")
def structured_fields(spark, d):
    """Values behind labels; a label that is known and not sensitive ends a value, prose behind one is none."""
    k = F.col("c_custkey").cast("string")
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Name: "), "c_name", F.lit("  Account number: AC"), k, F.lit(" Status: open\nE-mail: u"), k, F.lit("@mail.org; more\nEmployer: this is the place that was named")).alias("text"))
    return refine.refine(docs, None, ["fields"]).select("doc_id", "entity_type", "text")


@query("""SELECT c_custkey AS doc_id, length('Dear ' || c_name || ', account of ') + (CASE p WHEN 1 THEN 0 ELSE length(c_name || ' and ') END) AS start, CASE p WHEN 1 THEN 0.95 * 0.9 ELSE 0.95 * 0.9 END::DOUBLE AS confidence
 FROM customer, (VALUES (1), (2)) v(p)""")
def repeated_values(spark, d):
    """A value found once is found at its other places, not inside longer words."""
    name = F.col("c_name")
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.concat(F.lit("Dear "), name, F.lit(", account of "), name, F.lit(" and "), name, F.lit(". Not "), name, F.lit("son")).alias("text"))
    first = docs.select("doc_id", F.lit(5).alias("start"), (F.length("c_name") + 5).alias("end"), F.col("c_name").alias("text"), F.lit("NAME").alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("pattern").alias("detector"), F.lit(2).alias("tier"), F.lit(0).alias("rule_ord"))
    return refine.refine(docs, first, ["repeats"]).where("detector = 'repeat_finder'").select("doc_id", "start", "confidence")


@query("""SELECT n_nationkey AS doc_id, 'NAME_PATIENT' AS entity_type, 2 AS spans FROM nation UNION ALL SELECT n_nationkey, 'ADDRESS', 1 FROM nation""")
def refined_spans(spark, d):
    """Address parts joined, a name's more specific type taken over, a contained span dropped whatever its tier."""
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("Ann Lee, 5 Main Street, Apt 7, Springfield; Ann Lee").alias("text"))
    rows = [(0, 7, "Ann Lee", "NAME_PATIENT", 0.9, 2), (0, 3, "Ann", "NAME", 0.99, 4), (44, 51, "Ann Lee", "NAME", 0.8, 2), (9, 22, "5 Main Street", "ADDRESS", 0.9, 2), (28, 29, "7", "ADDRESS", 0.8, 1), (31, 42, "Springfield", "ADDRESS", 0.7, 3)]
    one = spark.createDataFrame([(*r[:5], "x", r[5], k) for k, r in enumerate(rows)], "start int, end int, text string, entity_type string, confidence double, detector string, tier int, rule_ord int")
    spans = docs.select("doc_id").join(one.select(F.explode(F.array(F.struct("*"))).alias("s")).agg(F.collect_list("s").alias("all")).select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("doc_id"), "all"), "doc_id").select("doc_id", F.explode("all").alias("s")).select("doc_id", "s.*")
    return refine.refine(docs, spans, ["contained", "addresses", "names"]).groupBy("doc_id", "entity_type").agg(F.count("*").cast("int").alias("spans"))


_KNOWN = "lpad((100 + c_custkey % 500)::VARCHAR, 3, '0') || '-12-' || lpad((1 + c_custkey % 9000)::VARCHAR, 4, '0')"


@query("""SELECT c_custkey AS doc_id, round_even(least(100.0, CASE WHEN c_custkey % 2 = 0 THEN 10 * 4.0 * 0.99 ELSE 4 * 4.0 * 0.9 END), 0)::INT AS score, CASE WHEN c_custkey % 2 = 0 THEN 'SSN' ELSE 'PHONE' END AS entity_type FROM customer""")
def catalog_scores(spark, d):
    """Scores from the whole rule catalog: social security numbers and dashed phone numbers count."""
    k = F.col("c_custkey")
    ssn = F.concat(F.lpad((100 + k % 500).cast("string"), 3, "0"), F.lit("-12-"), F.lpad((1 + k % 9000).cast("string"), 4, "0"))
    docs = _spread(spark, d, "customer", "c_custkey").select(k.alias("doc_id"), F.when(k % 2 == 0, F.concat(F.lit("his "), ssn, F.lit(" here"))).otherwise(F.concat(F.lit("call 212-"), F.lpad((200 + k % 700).cast("string"), 3, "0"), F.lit("-0100 now"))).alias("text"))
    return score.score(detect.catalog_counts(docs), types=True).select("doc_id", "score", F.explode("entity_types").alias("entity_type"))


@query("""WITH o AS (SELECT c_custkey AS id, c_custkey % 4 AS e, c_custkey % 3 = 0 AS c FROM customer)
 SELECT id AS object_id, CASE WHEN c THEN '' ELSE 'no_labels' END AS triggers, (CASE WHEN c THEN 0 ELSE 15 END)::INT AS priority, NOT c AS scanned,
 round_even(least(100.0, least(100.0, (5 * 4.0 * (1 + ln(2)) + CASE WHEN NOT c THEN 4 * 4.0 ELSE 0 END) * CASE WHEN c THEN 0.96 ELSE (0.96 * 2 + 0.9) / 3 END)), 0)::INT AS score FROM o""")
def process_objects(spark, d):
    """Findings of a classifier, and of the scanner where a trigger asks for it, merged and scored."""
    k = F.col("c_custkey")
    base = _t(spark, d, "customer").select(k.alias("object_id"))
    findings = base.select("object_id", F.lit(0).alias("input_ord"), F.lit("EMAIL").alias("entity_type"), F.lit(2).cast("long").alias("count"), F.lit(0.96).alias("confidence"), F.lit("dlp").alias("source"))
    contexts = base.select("object_id", F.lit("PRIVATE").alias("exposure"), F.lit("platform").alias("encryption"), (F.col("object_id") % 3 == 0).alias("has_classification"), F.lit("2024-01-01 00:00:00").alias("last_modified"))
    contents = base.select("object_id", F.lit("server 10.0.0.1 is up").alias("text"))
    out = process(findings, contexts, contents, as_of="2024-02-01 00:00:00")
    return out.select("object_id", F.array_join("triggers", ",").alias("triggers"), "priority", "scanned", "score")


@query("""SELECT n_nationkey AS object_id, 'no_labels' AS trigger, 100 AS priority, CASE WHEN n_nationkey % 2 = 0 THEN 19 ELSE 0 END AS score FROM nation""")
def process_contents(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("object_id"), F.when(F.col("n_nationkey") % 2 == 0, "mail to a@b.com").otherwise("nothing").alias("text"))
    return process_content(docs).select("object_id", F.get("triggers", 0).alias("trigger"), "priority", "score")


@query("""SELECT c_custkey, repeat('█', (c_custkey % 101 / 100.0 * 20)::DOUBLE::INT - CASE WHEN (c_custkey % 101 / 100.0 * 20)::DOUBLE::INT > c_custkey % 101 / 100.0 * 20 THEN 1 ELSE 0 END)
 || repeat('░', 20 - ((c_custkey % 101 / 100.0 * 20)::DOUBLE::INT - CASE WHEN (c_custkey % 101 / 100.0 * 20)::DOUBLE::INT > c_custkey % 101 / 100.0 * 20 THEN 1 ELSE 0 END)) AS bar, c_custkey % 3 = 0 AS binary, c_custkey % 4 = 1 AS archive FROM customer""")
def text_checks(spark, d):
    k = F.col("c_custkey")
    content = F.when(k % 3 == 0, F.when(k % 2 == 0, F.unhex(F.repeat(F.lit("8081"), 40))).otherwise(F.unhex(F.lit("616200")))).otherwise(F.lit("plain téxt\n").cast("binary"))
    name = F.when(k % 4 == 1, F.concat(F.lit("a."), F.element_at(F.array(F.lit("ZIP"), F.lit("tar.gz"), F.lit("7z")), (k % 3 + 1).cast("int")))).otherwise("a.txt")
    return _t(spark, d, "customer").select("c_custkey", text.score_bar(k % 101).alias("bar"), text.is_binary(content).alias("binary"), text.is_archive(name).alias("archive"))


@query("""SELECT n_nationkey, 'id 123-45-6789 on 10/05/1980, ' || n_name || ' will sell lO' AS text FROM nation""")
def scanned_digits(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", text.repaired_digits(F.concat(F.lit("id l23-4S-67B9 on 1O/O5/l98O, ").substr(1, 0), F.lit("id l23-4S-6789 on 1O/O5/l98O, "), "n_name", F.lit(" will sell lO"))).alias("text"))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'ADDRESS' WHEN 2 THEN 'ADDRESS' WHEN 3 THEN 'NAME' ELSE 'SSN' END AS entity_type,
 CASE c_custkey % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.88 WHEN 2 THEN 0.9 * 0.85 WHEN 3 THEN 0.85 ELSE 0.99 END::DOUBLE AS confidence, CASE c_custkey % 6 WHEN 3 THEN 2 ELSE 1 END AS spans FROM customer WHERE c_custkey % 6 <> 5""")
def whole_detection(spark, d):
    """Rules, label fields, context and clean-up together."""
    k = F.col("c_custkey")
    made = F.when(k % 6 == 0, F.concat(F.lit("E-mail: a"), k.cast("string"), F.lit("@mail.org"))).when(k % 6 == 1, F.lit("he lives at 12 Long Oak Street since then")).when(k % 6 == 2, F.lit("Mr. Springfield came"))
    made = made.when(k % 6 == 3, F.lit("Mr. Adam Smith wrote. Adam Smith left")).when(k % 6 == 4, F.concat(F.lit("ssn "), F.lpad((100 + k % 500).cast("string"), 3, "0"), F.lit("-12-3456 known"))).otherwise(F.lit("nothing to see"))
    docs = _spread(spark, d, "customer", "c_custkey").select(k.alias("doc_id"), made.alias("text"))
    found = detect.whole(docs)
    return found.groupBy("doc_id", "entity_type").agg(F.round(F.max("confidence"), 9).alias("confidence"), F.count("*").cast("int").alias("spans"))


@query("""WITH s AS (SELECT c_custkey, v, CASE v WHEN 1 THEN c_custkey % 90 ELSE c_custkey % 50 END AS score FROM customer, (VALUES (1), (2)) t(v))
 SELECT '/f/' || c_custkey AS path, CASE v WHEN 1 THEN 'scanner' ELSE 'dlp' END AS source, max(score) OVER (PARTITION BY c_custkey)::INT AS score, 'EMAIL:' || c_custkey AS value, c_custkey % 2 = 0 AND v = 1 AS rescanned FROM s""")
def vault_rows(spark, d):
    """Stored, stored again for some, opened with the key; with another key nothing opens."""
    from ..operators import vault

    k, key = F.col("c_custkey"), F.lit("0123456789abcdef").cast("binary")
    base = _spread(spark, d, "customer", "c_custkey").select(k, F.concat(F.lit("/f/"), k.cast("string")).alias("path"), F.lit("h").alias("file_hash"))
    spans = base.select("path", F.lit(0).alias("start"), F.lit(5).alias("end"), k.cast("string").alias("text"), F.lit("EMAIL").alias("entity_type"), F.lit(0.9).alias("confidence"))

    def scan(score, source, at, which="true"):
        rows = base.where(which).select("path", "file_hash", F.lit(at).cast("timestamp").alias("scanned_at"), score.cast("int").alias("score"), F.lit("LOW").alias("tier"))
        return vault.entries(rows, spans, key, source)

    old = scan(k % 90, "scanner", "2024-01-01").unionByName(scan(k % 50, "dlp", "2024-01-02"))
    rows = vault.stored(old, scan(k % 90, "scanner", "2024-02-01", "c_custkey % 2 = 0"))
    open_ = vault.opened(rows.withColumn("sealed", F.col("spans")), key).withColumnsRenamed({"spans": "clear", "sealed": "spans"})
    tried = vault.opened(open_, F.lit("another key 16 b").cast("binary"))
    value = F.concat(F.element_at("clear", 1)["entity_type"], F.lit(":"), F.element_at("clear", 1)["text"])
    shut = F.when(F.col("spans").isNull(), value).otherwise(F.raise_error(F.lit("another key opens a row of the vault")))
    return tried.select("path", "source", "score", shut.alias("value"), (F.col("scanned_at") > F.lit("2024-01-15").cast("timestamp")).alias("rescanned"))


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS seconds, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 70 END AS score FROM events),
 g AS (SELECT job_id, floor(seconds / 50) AS step, max(seconds) AS seconds, count(*) AS n, sum((score > 0)::INT) AS r, max(score) AS m FROM e GROUP BY 1, 2)
 SELECT job_id, seconds, sum(n) OVER w AS scanned, sum(r) OVER w AS with_risk, max(m) OVER w AS largest FROM g WINDOW w AS (PARTITION BY job_id ORDER BY step)""")
def job_progress(spark, d):
    from ..operators import jobs

    rows = _t(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seconds"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 70).alias("score"))
    return jobs.progress(rows, throttle=50)


@query("""SELECT event_type AS detector, count(*) AS calls, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, sum(user_id % 4)::BIGINT AS found FROM events WHERE value IS NOT NULL GROUP BY 1""")
def detector_timings(spark, d):
    from ..operators import jobs

    rows = _t(spark, d, "events").where("value is not null").select(F.col("event_type").alias("detector"), F.col("value").alias("ms"), (F.col("user_id") % 4).alias("found"))
    return jobs.timings(rows).withColumn("mean_ms", F.round("mean_ms", 6))


@query("""SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'content' ELSE 'time' END AS reason FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0""")
def changed_during_scan(spark, d):
    from ..operators import jobs

    before = _t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.lit("a").alias("content_hash"), F.lit(1.0).alias("mtime"))
    k = F.col("path")
    after = before.withColumn("content_hash", F.when(k % 4 == 0, "b").otherwise("a")).withColumn("mtime", F.when((k % 5 == 0) | (k % 4 == 0), 2.0).otherwise(1.0))
    return jobs.changed_meanwhile(before, after)


@query("""SELECT c_custkey::VARCHAR AS id, 2 AS n, 'EMAIL' AS first_type, 'a' || c_custkey AS first_text FROM customer""")
def annotated_corpus(spark, d):
    """The three layouts, read from JSON, mean the same."""
    from ..sources import corpora

    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("a"), k, F.lit(" and b"))
    end = (F.length(k) + 1).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("start"), end.alias("end"), F.lit("EMAIL").alias("label")), F.struct((end + 5).alias("start"), (end + 6).alias("end"), F.lit("X").alias("label")))
    other = F.array(F.struct(F.lit(0).alias("start_offset"), end.alias("end_offset"), F.lit("EMAIL").alias("type"), F.concat(F.lit("a"), k).alias("value")), F.struct((end + 5).alias("start_offset"), (end + 6).alias("end_offset"), F.lit("X").alias("type"), F.lit("b").alias("value")))
    rows = [F.to_json(F.struct(k.alias("id"), text.alias("source_text"), F.lit("m").alias("privacy_mask"), spans.alias("span_labels"))), F.to_json(F.struct(k.alias("id"), text.alias("text"), other.alias("entities"))), F.to_json(F.struct(k.alias("id"), text.alias("content"), spans.alias("labels")))]
    made = _t(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, rows[0]).when(F.col("c_custkey") % 3 == 1, rows[1]).otherwise(rows[2]).alias("j"))
    found = corpora.normal(made.select(F.from_json("j", corpora.SAMPLE).alias("s")).select("s.*"))
    return found.select("id", F.size("entities").alias("n"), F.get("entities", 0)["type"].alias("first_type"), F.get("entities", 0)["text"].alias("first_text"))


@query("""SELECT * FROM (VALUES ('1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa', true), ('1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb', false), ('1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2', true), ('3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy', true), ('0OIl', false)) t(address, valid)""")
def bitcoin_addresses(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "0OIl")], "address string")
    return rows.select("address", checksums.bitcoin_base58(F.col("address")).alias("valid"))


@query("WITH " + _JOBS + " SELECT seq, priority FROM q ORDER BY priority DESC, seq LIMIT 20 OFFSET 40")
def result_page(spark, d):
    from ..operators import jobs

    return jobs.page(queue_priority(spark, d).select("seq", "priority"), [F.desc("priority"), F.col("seq")], 3, 20)


def _values(rows, names: str) -> str:
    """Expected rows, written out as SQL."""
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") t({names})"


#: Published examples of identifiers, and the same with one character changed.
_IDENTIFIERS = (
    ("cusip", "037833100", True), ("cusip", "037833101", False), ("isin", "US0378331005", True), ("isin", "US0378331006", False), ("sedol", "0263494", True), ("sedol", "0263495", False),
    ("lei", "529900T8BM49AURSDO55", True), ("lei", "529900T8BM49AURSDO56", False), ("vin", "1M8GDM9AXKP042788", True), ("vin", "1M8GDM9A1KP042788", False), ("iban", "GB82 WEST 1234 5698 7654 32", True),
    ("iban", "GB82 WEST 1234 5698 7654 33", False), ("npi", "1234567893", True), ("npi", "1234567894", False), ("aba_routing", "021000021", True), ("aba_routing", "021000022", False), ("figi", "BBG000BLNNH6", True),
    ("figi", "BBX000BLNNH6", False), ("swift", "DEUTDEFF500", True), ("swift", "DEUTDEF", False), ("ethereum", "0x52908400098527886E0F7030069857D2E4169EE7", True), ("ethereum", "0x5290", False),
    ("luhn", "79927398713", True), ("luhn", "79927398714", False), ("ipv4", "255.10.0.1", True), ("ipv4", "256.1.1.1", False), ("us_phone", "(212) 555-0100", True), ("us_phone", "555-010-0100", False), ("age", "125", True), ("age", "126", False),
    ("dea", "AB1234563", True), ("dea", "AB1234564", False),
)


@query(_values(_IDENTIFIERS, "name, value, valid"))
def checksum_examples(spark, d):
    rows = spark.createDataFrame([(n, v) for n, v, _ in _IDENTIFIERS], "name string, value string")
    valid = F.lit(None).cast("boolean")
    for name in dict.fromkeys(n for n, _, _ in _IDENTIFIERS):
        valid = F.when(F.col("name") == name, getattr(checksums, name)(F.col("value"))).otherwise(valid)
    return rows.select("name", "value", F.coalesce(valid, F.lit(False)).alias("valid"))


#: ladder, case, rank: what each setting of a store opens to whom.
_LADDERS = (
    ("nfs", "*", 3), ("nfs", "", 3), ("nfs", "10.0.0.0/8", 3), ("nfs", "10.0.0.0/16", 2), ("nfs", "10.0.0.0/24", 1), ("nfs", "10.0.0.1/32", 0), ("nfs", "*.corp.org", 1), ("nfs", "web*", 2), ("nfs", "host1", 0),
    ("trustee", "Everyone", 2), ("trustee", "ANONYMOUS LOGON", 3), ("trustee", "CORP\\Domain Users", 1), ("trustee", "creator owner", 0), ("trustee", "CORP\\ann", 0), ("sid", "S-1-1-0", 3), ("sid", "S-1-5-11", 2), ("sid", "S-1-5-18", 1), ("sid", "S-1-5-21-9", 0),
    ("link", "anonymous", 3), ("link", "organization", 2), ("link", "specificPeople", 0), ("link", "unknown", 0),
    ("gcs", "allUsers", 3), ("gcs", "allAuthenticatedUsers", 2), ("gcs", "domain:x.org", 1), ("gcs", "group:g@x.org", 1), ("gcs", "user:a@x.org", 0),
    ("blob", "container", 3), ("blob", "blob", 2), ("blob", "private", 0), ("s3", "public-read", 3), ("s3", "authenticated-read", 2), ("s3", "private", 0), ("s3", "aws-exec-read", 1),
)


@query(_values(_LADDERS, "ladder, value, rank"))
def exposure_ladders(spark, d):
    v, no, yes = F.col("value"), F.lit(None).cast("string"), F.lit(False)
    none = F.array().cast("array<string>")
    ranks = {
        "nfs": exposure.nfs_host(v), "trustee": exposure.trustee(v, no), "sid": exposure.trustee(F.lit("x"), v), "link": exposure.sharing_link(v, no, no, F.lit(True)), "gcs": exposure.gcs(F.array(v), none, yes, yes),
        "blob": exposure.blob(v, F.lit("Deny"), F.lit(0), F.lit(0), yes, yes), "s3": exposure.s3(v, F.lit(False), yes, yes, yes, yes),
    }
    rank = F.lit(None).cast("int")
    for name, column in ranks.items():
        rank = F.when(F.col("ladder") == name, column).otherwise(rank)
    return spark.createDataFrame([(a, b) for a, b, _ in _LADDERS], "ladder string, value string").select("ladder", "value", rank.alias("rank"))


@query("""SELECT doc_id, 'EMAIL' AS entity_type, count(*) AS truth, count(*) AS tp, 0::BIGINT AS fn FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS v FROM documents) GROUP BY 1
 UNION ALL SELECT doc_id, 'PHONE', count(*), sum((substr(v, 2, 1) BETWEEN '2' AND '9' AND substr(v, 2, 3) NOT IN ('555', '911', '411'))::INT)::BIGINT, sum((NOT (substr(v, 2, 1) BETWEEN '2' AND '9' AND substr(v, 2, 3) NOT IN ('555', '911', '411')))::INT)::BIGINT
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')) AS v FROM documents) GROUP BY 1""")
def detection_recall(spark, d):
    """The catalog's spans against independent annotations, the bare patterns' matches: by type and document."""
    docs = _t(spark, d, "documents")
    bare = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "PHONE": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"}

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value")))

    every = F.concat(*[of(kind, pattern) for kind, pattern in bare.items()])
    truth = docs.select("doc_id", F.explode(every).alias("x")).groupBy("doc_id", "x.entity_type").agg(F.count("*").alias("truth"))
    found = detect.spans(docs).where(F.col("entity_type").isin(*bare)).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
    both = truth.join(found, ["doc_id", "entity_type"], "left").withColumn("tp", F.least("truth", F.coalesce("n", F.lit(0))))
    return both.select("doc_id", "entity_type", "truth", "tp", (F.col("truth") - F.col("tp")).alias("fn"))
