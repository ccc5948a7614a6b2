import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave import plugins, registry
from riskweave.functions import checksums, text
from riskweave.operators import actions, cleanup, context, detect, dictionary, exposure, filterlang, jobs, labels, queue, refine, report, score, spans, vault
from riskweave.plans import catalog_more
from riskweave.plans.engine import Engine
from riskweave.sinks import reports
from riskweave.sources import corpora, embedded, files

RESULTS = "path string, size_bytes long, score int, tier string, entities map<string,bigint>, error string"


def span(start, end, kind, value, confidence=0.9, tier=2, detector="pattern", order=0):
    return {"start": start, "end": end, "text": value, "entity_type": kind, "confidence": confidence, "detector": detector, "tier": tier, "rule_ord": order}


@pytest.fixture(scope="module")
def results(spark):
    rows = [("/d/a.csv", 10, 85, "CRITICAL", {"SSN": 10, "NAME": 25}, None), ("/d/b, c.txt", 20, 45, "MEDIUM", {"EMAIL": 5}, None), ('/d/"q".txt', 30, 5, "MINIMAL", {}, None), ("/x/bad", 0, None, None, {}, "denied")]
    return spark.createDataFrame(rows, RESULTS)


def test_registry(spark, tmp_path):
    path = tmp_path / "w.yaml"
    path.write_text("# registry\ndirect:\n  SSN: 9   # note\n  BADGE: 4\n\ncustom: # more\n  ODD_ID: 3\n  BAD: 77\n")
    got = {(r.entity_type, r.weight, r.category) for r in registry.from_yaml(spark, str(path)).collect()}
    assert got == {("SSN", 9, "direct"), ("BADGE", 4, "direct"), ("ODD_ID", 3, "custom")}
    table = {r.entity_type: (r.weight, r.category) for r in registry.dimension(spark, registry.from_yaml(spark, str(path)), None).collect()}
    assert table["SSN"] == (9, "direct") and table["ODD_ID"] == (3, "custom") and table["EMAIL"] == (5, "contact") and len(table) == len(registry.WEIGHTS) + 2
    assert {r.entity_type for r in registry.types_in(registry.dimension(spark), "immigration").collect()} == {"SEVIS_ID", "TRAVEL_DOCUMENT_NUMBER", "PETITION_NUMBER"}
    assert spark.range(1).select(registry.is_known(F.lit(" ssn ")).alias("a"), registry.is_known(F.lit("NO")).alias("b")).first() == (True, False)


def test_builder(results):
    where = filterlang.Where("score >= 40").and_has("ssn").or_("tier = medium")
    assert where.text == "score >= 40 AND has(ssn) OR tier = medium"
    assert {r.path for r in results.where(where.column(results)).collect()} == {"/d/a.csv", "/d/b, c.txt"}
    for bad in ("score", "score > 1 AND tier = x", ""):
        with pytest.raises(ValueError):
            filterlang.Where(bad)


def test_patterns_of_either_kind(results):
    find = lambda e: {r.path for r in results.where(filterlang.parse(e, filterlang.of(results))).collect()}
    assert find("path matches '(?P<x>d)/a'") == {"/d/a.csv"} and find("path matches '(?<x>A)[.]c'") == {"/d/a.csv"} and find("path matches '('") == set()


def test_contained():
    found = refine.without_contained("", [span(0, 100, "NAME", "", tier=2), span(0, 5, "NAME", "", tier=4), span(10, 20, "NAME_PATIENT", "", tier=3), span(10, 20, "EMAIL", ""), span(200, 210, "DATE_DOB", ""), span(200, 210, "DATE", "", 0.95)])
    assert {(s["start"], s["end"], s["entity_type"]) for s in found} == {(0, 100, "NAME"), (10, 20, "EMAIL"), (200, 210, "DATE")}
    many = refine.without_contained("", [span(k, k + 3000 - k, "NAME", "") for k in range(0, 2000)])
    assert len(many) == 1


def test_contained_frame(spark):
    rows = [(1, 0, 100, 2, "NAME"), (1, 0, 5, 4, "NAME"), (1, 10, 20, 3, "NAME"), (1, 300, 310, 2, "NAME"), (2, 0, 5, 2, "NAME")]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, tier int, entity_type string").select("*", F.lit("x").alias("text"), F.lit(0.9).alias("confidence"), F.lit("p").alias("detector"), F.lit(0).alias("rule_ord"))
    assert {(r.doc_id, r.start) for r in spans.drop_contained(df).collect()} == {(1, 0), (1, 300), (2, 0)} and spans.drop_contained(df).count() == 3


def test_refinements():
    t = "see Johnson, call 5551234 now"
    assert [(s["text"], round(s["confidence"], 4)) for s in refine.snapped(t, [span(4, 8, "NAME", "John")])] == [("Johnson", 0.855)]
    assert refine.snapped("x" * 50, [span(20, 25, "NAME", "xxxxx")])[0]["text"] == "xxxxx" and refine.snapped(t, [span(40, 50, "NAME", "")]) == []
    t = "5 Elm Street, Apt 7, Rome and 9 Oak Road"
    parts = [span(0, 12, "ADDRESS", "5 Elm Street", 0.9), span(18, 19, "ADDRESS", "7", 0.7, 3), span(21, 25, "ADDRESS", "Rome", 0.8), span(30, 40, "ADDRESS", "9 Oak Road")]
    assert [(s["text"], s["confidence"], s["tier"]) for s in refine.joined_addresses(t, parts)] == [("5 Elm Street, Apt 7, Rome", 0.7, 3), ("9 Oak Road", 0.9, 2)]
    t = "Ann Lee met Ann Leeds; ann lee; Ann Lee"
    found = refine.repeated(t, [span(0, 7, "NAME_PATIENT", "Ann Lee", 0.8)])
    assert [(s["start"], s["entity_type"], round(s["confidence"], 3), s["tier"]) for s in found] == [(0, "NAME_PATIENT", 0.8, 2), (32, "NAME_PATIENT", 0.76, 1)]
    assert len(refine.repeated("ab12 " * 200, [span(0, 4, "MRN", "ab12")])) == 51 and len(refine.repeated("x x x", [span(0, 1, "NAME", "x")])) == 1
    t = "Patient name: Ann Lee  DOB: 1980-01-02 Notes: the patient was seen and has been sent home\nMRN: 12345;"
    assert [(s["entity_type"], s["text"]) for s in refine.fields(t, [])] == [("NAME_PATIENT", "Ann Lee"), ("DATE_DOB", "1980-01-02"), ("MRN", "12345")]


def test_context():
    keep = lambda step, t, s: bool(step(t, [s]))
    assert not keep(context.no_false_ssn, "invoice no 123456789", span(11, 20, "SSN", "123456789", 0.7)) and keep(context.no_false_ssn, "his 123456789", span(4, 13, "SSN", "123456789", 0.7))
    assert not keep(context.no_plain_secret, "the secret of life", span(4, 10, "CLASSIFICATION_LEVEL", "secret")) and keep(context.no_plain_secret, "SECRET//NOFORN", span(0, 6, "CLASSIFICATION_LEVEL", "SECRET"))
    card = "DRIVER LICENSE CLASS: C 12345"
    assert context.is_id_card(card) and not keep(context.no_model_record_numbers, card, span(24, 29, "MRN", "12345", detector="ml")) and keep(context.no_model_record_numbers, card, span(24, 29, "MRN", "12345"))
    assert context.is_tracking_number("9400 1000 0000 0000 0000 00", "USPS: ") and not context.is_tracking_number("12", "USPS: ") and not context.is_tracking_number("123456789", "total ")
    assert [s["entity_type"] for s in context.cities_not_names("", [span(0, 1, "NAME", "Springfield"), span(0, 1, "NAME", "Ann Lee"), span(0, 1, "NAME", "ROME, GA")])] == ["ADDRESS", "NAME", "ADDRESS"]
    t = "Dr. Ann Lee and Bob Ray, MD and Cy Fox"
    assert [s["entity_type"] for s in context.names_by_context(t, [span(4, 11, "NAME_PROVIDER", "Ann Lee"), span(16, 23, "NAME_PROVIDER", "Bob Ray"), span(32, 38, "NAME_PROVIDER", "Cy Fox")])] == ["NAME_PROVIDER", "NAME_PROVIDER", "NAME"]
    assert context.trimmed_names(["was"])("", [span(0, 12, "NAME", "Ann Lee, was")])[0]["text"] == "Ann Lee"
    assert [s["text"] for s in context.unlabelled_addresses("at 12 Long Oak Street, Apt 4 today", [])] == ["12 Long Oak Street, Apt 4"]
    step = context.allowed(["test"], {"NAME": ["May"]}, {"DATE": "version"})
    assert [round(s["confidence"], 2) for s in step("version 1.2", [span(0, 1, "X", "Test"), span(0, 1, "NAME", "may"), span(0, 1, "DATE", "may"), span(8, 11, "DATE", "1.2")])] == [0.9, 0.27]
    nan, inf = float("nan"), float("inf")
    assert [context.calibrated(*x) for x in ((nan, "checksum"), (inf, "x"), (-inf, "structured"), (0.2, "secrets"), (0.7, "other"))] == [0.85, 1.0, 0.90, 0.80, 0.7]
    assert context.isolated(lambda t, s: 1 / 0)("", [1]) == [1]


def test_plugins(spark):
    p = plugins.Plugins()

    @p.validator("even", length=4)
    def even(v):
        return int(v) % 2 == 0

    p.rule("badge", r"\bB-(\d{4})\b", 0.8, group=1, validator="even")
    with pytest.raises(Exception):
        p.rule("x", "(")

    @p.detector("hello")
    def hello(t, found):
        k = t.find("hello")
        return found if k < 0 else [*found, span(k, k + 5, "GREETING", "hello", order=50_000)]

    @p.detector("faulty")
    def faulty(t, found):
        raise RuntimeError("no")

    docs = spark.createDataFrame([(1, "B-1234 hello"), (2, "B-1235"), (3, None)], "doc_id int, text string")
    got = {(r.doc_id, r.entity_type, round(r.confidence, 2)) for r in detect.whole(docs, plugins=p).collect()}
    assert got == {(1, "BADGE", 0.82), (1, "GREETING", 0.9)}
    assert even("12 34") and not even("123") and not even("12x4")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_is_one_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(None, "Mr. Adam Smith wrote"), (None, "mail to a@b.com."), (-1, "Mr. Ann\u2003, patient: Cy Fox Lee\nhe\u00a0"), (-2, ""), (-3, None), (-4, "ab12345678 " * 3 + "MRN: AB12345678, AB12345678x AB12345678")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    found = detect.whole(docs)
    plan = plan_of(found)
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "InPandas" not in plan
    assert [r.entity_type for r in found.where("doc_id is null").orderBy("entity_type").collect()] == ["EMAIL", "NAME"]
    rows = docs.where("doc_id is not null")
    apart = spans.non_overlapping(refine.refine(rows, cleanup.clean(detect.spans(rows)), ["fields", *context.AFTER]))
    assert "InPandas" not in plan_of(apart) and plan_of(apart).count("MapInArrow") == 3
    by_place = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "end", "text", "entity_type", "confidence", "detector", "tier", "rule_ord").collect())
    assert by_place(found.where("doc_id is not null")) == by_place(apart)


def test_catalog_counts_is_one_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "Card 4111 1111 1111 1111, mail a.b@example.com; DOB: 01/02/1990, member 12345678"), (-2, None), (-3, "")], "doc_id long, text string"))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(detect.resolved(docs)) == plain(spans.resolve(cleanup.clean(detect.spans(docs))))
    found = detect.catalog_counts(docs)
    plan = plan_of(score.score(found, types=True))
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "InPandas" not in plan
    scored = score.score(found, types=True).select("doc_id", "score", F.explode("entity_types").alias("entity_type"))
    assert plain(scored) == plain(score.score(found).select("doc_id", "score").join(found.select("doc_id", "entity_type"), "doc_id"))
    assert "entity_types" not in score.score(found).columns
    assert plan_of(catalog_more.catalog_scores(spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1


def test_cleaned(spark):
    texts = [" a@b.com. ", "a@b.com", "a@b.com\r.", "a@b.com\r\n.", "a@b.com\n\n.", "\u2003Ann Lee\u00a0\n", "Ann Lee\nBob", "A\nBob", "Al.", "Al...", "\x1cAnn\x1d", " \t\u3000", "12-34.;", "Ann\u2028\nx", ".", "\u1680ab", "\x85ab\u200bcd"]
    rows = [(k, 5, 5 + len(t), t, kind, 0.9, "x", 2, 0) for k, t in enumerate(texts) for kind in ("NAME", "NAME_PATIENT", "NAMES", "EMAIL", "PHONE", "URL")]
    df = spark.createDataFrame(rows, f"k int, {detect.SPAN}")
    want = sorted(tuple(r) for r in cleanup.clean(df).select(*df.columns).collect())
    names = df.columns[1:]
    assert want == sorted((r[0], *(s[n] for n in names)) for r in rows for s in cleanup.cleaned("", [dict(zip(names, r[1:]))]))


def test_dictionary(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# comment\nBlue Cross\nabc\nnurse\nnurse\n deny me \n")
    terms = dictionary.load(spark, str(path), "PAYER", deny=("deny me",))
    assert {r.term for r in terms.collect()} == {"blue cross", "nurse"}
    docs = spark.createDataFrame([(1, "Blue Cross, NURSE and nurses; blue crossing"), (2, None), (3, "İ nurse")], "doc_id int, text string")
    for most in (1, 100):
        assert {(r.doc_id, r.start, r.text) for r in dictionary.matches(docs, terms, most=most).collect()} == {(1, 0, "Blue Cross"), (1, 12, "NURSE"), (3, 2, "nurse")}


def test_reports(spark, results, tmp_path):
    lines = [r.value for r in reports.csv_lines(results).collect()]
    assert lines[0].startswith("path,") and '"/d/b, c.txt",20,45,MEDIUM,EMAIL:5,' in lines and '"/d/""q"".txt",30,5,MINIMAL,,' in lines
    assert len([json.loads(r.value) for r in reports.json_lines(results).collect()]) == 4
    body = json.loads(reports.json_document(results).first().value)
    assert body["summary"]["total_files"] == 4 and body["summary"]["error_count"] == 1 and body["entities"]["NAME"] == 25
    assert "| CRITICAL | 1 |" in reports.markdown(results).first().value and "<td>/d/a.csv</td>" in reports.html(results).first().value
    for kind in ("json", "jsonl", "csv", "md", "html"):
        Engine(spark).report(results, f"{tmp_path}/r.{kind}")
        assert spark.read.text(f"{tmp_path}/r.{kind}").count() > 0
    with pytest.raises(ValueError):
        reports.save(results, "r.doc")
    for k, content in enumerate(('{"files": [{"path": "a", "score": 3, "entities": {"SSN": 1}}]}', '[{"path": "a", "score": 3, "entities": {"SSN": 1}}]')):
        (tmp_path / f"i{k}.json").write_text(content)
        (r,) = reports.inventory(spark, str(tmp_path / f"i{k}.json")).collect()
        assert (r.path, r.score, r.entities) == ("a", 3, {"SSN": 1})


def test_engine(spark, results):
    docs = spark.createDataFrame([("/a", "mail a@b.com"), ("/b", "none")], "path string, text string")
    found = Engine(spark).scan(docs)
    assert {(r.path, r.score) for r in Engine(spark).find(found, "has(EMAIL)").collect()} == {("/a", 19)}
    assert [r.path for r in Engine(spark).find(results, "score > 0", limit=2).collect()] == ["/d/a.csv", "/d/b, c.txt"]
    assert all(r.ok for r in Engine(spark).health().collect()) and Engine(spark).stats(results).first().top_entities == "NAME,SSN,EMAIL"
    assert [r.target for r in Engine(spark).quarantine(results, "/d", "/q", "score > 50").collect()] == ["/q/a.csv"]
    with pytest.raises(ValueError):
        actions.delete(results)


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(text.repaired_digits(F.lit("l23-4S-6789 sells lO")).alias("a"), text.repaired_digits(F.lit("slide")).alias("b"), text.score_bar(F.lit(50), 4).alias("c"), text.normal_label(F.lit(" Date  of birth :- ")).alias("d"), text.is_archive(F.lit("X.TAR.GZ")).alias("e")).first()
    assert tuple(got) == ("123-45-6789 sells lO", "slide", "██░░", "DATE OF BIRTH", True)
    contents = [b"", b"abc", b"a\x00", bytes([0x80, 0x81] * 50), "é漢".encode(), b"\x01\x02\x03ab", b"ok\tok\n"]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(contents)], "k int, c binary")
    assert [r.b for r in rows.select("k", text.is_binary(F.col("c")).alias("b")).orderBy("k").collect()] == [False, False, True, True, False, True, False]
    big = bytes(range(256)) * 1000
    want = [hashlib.blake2b(str(len(c)).encode() + c[:65536] + (c[-65536:] if len(c) > 65536 else b""), digest_size=16).hexdigest() for c in (b"abc", big, b"x" * 70_000)]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate((b"abc", big, b"x" * 70_000))], "k int, c binary")
    assert [r.h for r in rows.select("k", text.quick_hash(F.col("c")).alias("h")).orderBy("k").collect()] == want


def test_spreadsheets():
    data = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="People"/><sheet name="Other"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>card</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>4111111111111111</v></c><c/></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>here</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    assert files.text_of("a.xlsx", data.getvalue()) == "[Sheet: People]\ncard | 4111111111111111\ntwo runs | here"


def test_queue(spark):
    jobs_ = spark.createDataFrame([(1, 10), (2, 90), (3, 90), (4, 50)], "seq int, priority int")
    assert [r.seq for r in queue.next_jobs(jobs_, 3).collect()] == [2, 3, 4]
    assert {r.seq for r in queue.offered(jobs_, jobs_.withColumn("seq", F.col("seq") + 10), 6).where("accepted").collect()} == {11, 12} and queue.offered(jobs_, jobs_, 2).where("accepted").count() == 0
    back = queue.requeued(spark.createDataFrame([(1, 0), (2, 3)], "seq int, retries int"))
    assert {(r.seq, r.retries, r.state) for r in back.collect()} == {(1, 1, "queued"), (2, 4, "failed")}


def test_jobs(spark):
    runs = spark.createDataFrame([(1, "a", "ok"), (1, "b", "failed"), (2, "a", "timeout"), (3, "a", "ok")], "doc_id int, detector string, status string")
    assert {(r.doc_id, r.partial, r.void, tuple(r.failed)) for r in jobs.outcome(runs).collect()} == {(1, True, False, ("b",)), (2, False, True, ()), (3, False, False, ())}
    events = jobs.events(spark.createDataFrame([(1, None), (1, "x"), (2, "x")], "job_id int, error string"))
    assert {(r.job_id, r.event, r.errors) for r in events.collect()} == {(1, "complete", 1), (2, "error", 1)}
    samples = spark.createDataFrame([(1, 90.0, "LOW"), (2, 35.0, "MEDIUM"), (3, 5.0, "CRITICAL")], "id int, score double, expected string")
    assert [(r.id, r.off_by) for r in jobs.issues(samples, "expected", F.col("score")).collect()] == [(3, 4), (1, 3)]


def test_vault(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    found = spark.createDataFrame([("/a", 5, 8, "x", "SSN", 0.9), ("/a", 0, 3, "y", "EMAIL", 0.8), ("/a", 9, 12, "z", "EMAIL", 0.7)], "path string, start int, end int, text string, entity_type string, confidence double")

    def scans(rows, source):
        results = spark.createDataFrame(rows, "path string, file_hash string, at string, score int, tier string").withColumn("scanned_at", F.col("at").cast("timestamp")).drop("at")
        return vault.entries(results, found, key, source)

    old = scans([("/a", "h", "2024-01-01", 90, "critical"), ("/b", "h", None, 5, "LOW"), (None, "h", "2024-01-01", 7, None)], "scanner").unionByName(scans([("/a", "h", "2024-01-02", 20, "LOW")], "dlp"))
    rows = vault.stored(old, scans([("/a", "h", "2024-02-01", 30, "MEDIUM"), ("/b", "i", None, 4, "MINIMAL")], "scanner"))
    plan = plan_of(rows)
    assert "SortAggregate" not in plan and "BroadcastHashJoin" not in plan
    got = {(r.path, r.source, r.file_hash, r.score, r.tier, str(r.scanned_at)[:10], tuple(sorted(r.entity_counts.items())), tuple(s.text for s in r.spans)) for r in vault.opened(rows, key).collect()}
    counts, texts = (("EMAIL", 2), ("SSN", 1)), ("y", "x", "z")
    assert got == {("/a", "scanner", "h", 30, "MEDIUM", "2024-02-01", counts, texts), ("/a", "dlp", "h", 30, "MEDIUM", "2024-01-02", counts, texts), ("/b", "scanner", "i", 4, "MINIMAL", "None", (), ()), (None, "scanner", "h", 7, None, "2024-01-01", (), ())}


def test_vault_queue(spark):
    key = F.lit("0123456789abcdef").cast("binary")
    rows = spark.createDataFrame([(1, 1, "i", "t", "u", "a", "d")], "chain int, seq int, id string, timestamp string, user_id string, action string, details string")
    sealed = vault.queued(rows, key)
    assert sealed.columns == ["chain", "seq", "sealed"] and vault.flushed(sealed, key).collect() == rows.collect()


def test_labels_of_spans(spark):
    rows = spark.createDataFrame([(1, 9, 12, "b@c", "EMAIL", 0.8), (1, 0, 3, "A@B", "EMAIL", 0.9)], "doc_id int, start int, end int, text string, entity_type string, confidence double")
    (r,) = labels.aggregated(rows).collect()
    want = spark.range(1).select(text.value_hash(F.lit("A@B"), F.lit("EMAIL"))).first()[0]
    assert (r.value_hash, r["count"], round(r.confidence, 3)) == (want, 2, 0.85)


def test_percentiles_are_exact(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.floor(F.pow(F.rand(3), 4) * 1000).alias("x")).cache()
    for by in ((), ("g",)):
        for r in report.percentiles(rows, "x", by=by).collect():
            v = sorted(x.x for x in (rows.where(F.col("g") == r.g) if by else rows).select("x").collect())
            assert [r.p50, r.p95, r.p99] == [v[int(len(v) * p / 100)] for p in (50, 95, 99)] and r["count"] == len(v)


def test_base58(spark):
    got = spark.createDataFrame([("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb",), (None,), ("",)], "a string").select(checksums.bitcoin_base58(F.col("a")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, False, False]


def test_corpus_file(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "ab cd", "labels": [{"start": 3, "end": 5, "label": "NAME"}]}\n{"id": "2", "text": ""}\n')
    (r,) = corpora.load(spark, str(tmp_path / "c.jsonl")).collect()
    assert [tuple(e) for e in r.entities] == [(3, 5, "NAME", "cd")]


def test_rights(spark):
    assert spark.range(1).select(exposure.rights(F.lit(0x80000003).cast("long")).alias("r")).first().r == ["READ_DATA", "WRITE_DATA", "GENERIC_READ"]


EXAMPLES = {
    "EMPLOYER": "Employer: Acme Corp", "NAME_RELATIVE": "wife: Ann Lee", "FACILITY": "at Saint Mary Hospital now", "SOLANA_ADDRESS": "Solana wallet: " + "4Nd1mYQzX7vL" * 3, "CARDANO_ADDRESS": "addr1" + "q9" * 30,
    "LITECOIN_ADDRESS": "ltc1" + "q9" * 15, "DOGECOIN_ADDRESS": "D9" + "aB3" * 10 + "cd", "XRP_ADDRESS": "XRP: r" + "aB3" * 9, "CRYPTO_SEED_PHRASE": "seed phrase: " + " ".join(["apple"] * 12), "SCI_MARKING": "TS//SCI",
    "ITAR_MARKING": "ITAR controlled", "EAR_MARKING": "ECCN: 5A002", "DOD_CONTRACT": "W91CRB-08-D-0012", "GSA_CONTRACT": "GS-35F-0119Y", "GPS_COORDINATES": "at 48.85837, 2.29448", "SSN_PARTIAL": "SSN ending in 6789",
    "CREDIT_CARD_PARTIAL": "card ending in 1111", "SIN": "SIN: 046 454 286", "TFN": "TFN 123 456 782", "AADHAAR": "Aadhaar 2345 6789 0123", "CURP": "BADD110313HCMLNS09", "SVNR": "SVNR 1237 010180", "MEDICARE_ID": "1EG4-TE5-MK73", "NDC": "NDC 0002-1433-80",
    "PHONE_EXT": "555-1234 ext. 42", "FAX": "Fax: 212-555-0100", "PAGER": "pager 555-0100", "DATETIME": "2024-01-02T03:04:05Z", "BLOOD_TYPE": "blood type: O+", "HEIGHT": "Height: 180 cm", "WEIGHT": "weight: 80 kg", "BMI": "BMI 22.5",
    "INMATE_NUMBER": "inmate 12345-678", "SEVIS_ID": "N0012345678", "PETITION_NUMBER": "EAC2190012345", "GREEN_CARD_NUMBER": "green card: SRC0123456789", "EAD_NUMBER": "EAD SRC0123456789", "LICENSE_PLATE": "license plate: ABC-1234",
    "MEMBER_ID": "member 12345678", "DUNS_NUMBER": "DUNS: 12-345-6789", "UEI": "UEI: J1K2L3M4N5P6", "ABA_ROUTING": "ABA 021000021", "ACCOUNT_NUMBER": "account no. 12345678", "CERTIFICATE_NUMBER": "certificate 123456", "UNIQUE_ID": "UID: ABC12345",
    "STATE_ID": "state id: 1234567", "MEDICAL_LICENSE": "medical license A12345", "MILITARY_ID": "EDIPI 1234567890", "ACCESSION_ID": "accession: S-12345", "PHARMACY_ID": "NCPDP 1234567", "ROOM_NUMBER": "room 12B", "BED_NUMBER": "bed 3",
    "AUTH_NUMBER": "authorization 123456", "RX_NUMBER": "Rx# 1234567", "ENROLLMENT_ID": "enrollment E123456", "FINANCIAL_AID_ID": "FAFSA 12345678", "TRANSCRIPT": "transcript T123456", "IEP_ID": "IEP 12345", "TEACHER_ID": "teacher T1234",
    "BAR_NUMBER": "bar no. 123456", "PACER_ID": "PACER 123456", "ARREST_RECORD": "booking 123456", "PROBATION_ID": "parole 123456", "WARRANT_NUMBER": "warrant W123456", "VISA_NUMBER": "visa 12345678", "I94_NUMBER": "I-94: 123456789A1",
    "TRAVEL_DOCUMENT_NUMBER": "travel document 12345678", "NATURALIZATION_NUMBER": "naturalization certificate 12345678", "SSN": "123-45-6789", "EMAIL": "a@b.com", "BITCOIN_ADDRESS": "bc1" + "q9" * 10, "IBAN": "DE89370400440532013000",
}


def test_every_rule_type_finds_its_example(spark):
    rows = sorted(EXAMPLES.items())
    found = detect.spans(spark.createDataFrame([(t, f"x {e} y") for t, e in rows], "doc_id string, text string")).select("doc_id", "entity_type").distinct().collect()
    types = {t: {r.entity_type for r in found if r.doc_id == t} for t, _ in rows}
    assert [t for t in types if t not in types[t]] == []


def test_hints_lose_nothing(spark):
    from riskweave.operators.rules import RULES

    texts = [f"x {e} y" for e in EXAMPLES.values()] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = tuple(r._replace(hints=()) for r in RULES)
    assert sorted(detect.spans(docs).collect()) == sorted(detect.spans(docs, rules=plain).collect())


def _docx(text="hello"):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("[Content_Types].xml", "<Types></Types>")
        z.writestr("_rels/.rels", "<Relationships></Relationships>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:p><w:t>{text}</w:t></w:p></w:document>')
    return data.getvalue()


def test_embedded_labels(spark):
    label = '{"id":"ol_1--2","n":"<&>"}'
    rows = [("/a.docx", bytearray(_docx())), ("/b.html", bytearray(b"<p>x</p>")), ("/c.txt", bytearray(b"x")), ("/d.docx", bytearray(b"broken"))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("label", F.lit(label))
    out = embedded.labelled(df)
    assert {(r.path, r.method) for r in out.collect()} == {("/a.docx", "embedded"), ("/b.html", "embedded"), ("/c.txt", "pointer"), ("/d.docx", "pointer")}
    again = embedded.labelled(out.withColumn("label", F.lit("second")))
    assert {r.path: r.label for r in embedded.labels(out).collect()} == {"/a.docx": label, "/b.html": label, "/c.txt": None, "/d.docx": None}
    got = {r.path: r for r in again.collect()}
    assert embedded.get("a.docx", bytes(got["/a.docx"].content)) == "second" and files.text_of("a.docx", bytes(got["/a.docx"].content)) == "hello" and bytes(got["/b.html"].content).count(b"second") == 1


def test_archives_say_when_they_are_cut(spark, monkeypatch):
    import bz2
    import tarfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k in range(5):
            z.writestr(f"f{k}.txt", "x")
        z.writestr("../evil.txt", "x")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:xz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    bomb = bz2.compress(b"0" * 30_000_000)
    assert [n for n, _ in files._members("a.zip", data.getvalue(), 0)] == [f"f{k}.txt" for k in range(5)]
    rows = [("a.tar.xz", bytearray(tar.getvalue())), ("b.bz2", bytearray(bomb)), ("c.zip", bytearray(b"no"))]
    got = files.members(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r.path, r.member, r.error) for r in got} == {("a.tar.xz", "in.txt", None), ("b.bz2", None, "too large unpacked"), ("c.zip", None, "BadZipFile")}
    monkeypatch.setattr(files, "MOST_MEMBERS", 2)
    with pytest.raises(files.Limit):
        list(files._members("a.zip", data.getvalue(), 0))


def test_file_metadata(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 trailer /Encrypt 5 0 R")
    rows = {r.name: r for r in files.metadata(files.listing(spark, str(tmp_path))).collect()}
    assert rows["b.txt"].kind == "text/plain" and rows["b.txt"].size_bytes == 5 and rows["b.txt"].content_hash == hashlib.sha256(b"plain").hexdigest()[:12]
    assert (rows["a.docx"].encrypted, rows["c.pdf"].encrypted, rows["a.docx"].extension) == (False, True, "docx")
    assert files.listing(spark, str(tmp_path), max_files=2).count() == 2
