import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import html_text, langid, leaks, licenses, lines, mixing, pseudonyms, queries, shingles, vectors, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (3, LONG + " phi", None, None, None), (None, LONG.replace("mu", "m"), "en", None, 1), (None, None, None, None, None),
        (4, None, "en", "b", None), (5, "", "fr", "b", 0), (6, " \n\t ", "fr", "b", 0), (7, "wörd " * 30_000 + "ende", "de", "b", 5), (7, "other text under the same id", "en", "c", 5), (8, "12345 !!", "en", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("copy", F.lit(1)).withColumn("node", F.lit("x")).withColumn("found", F.lit("y")).withColumn("size", F.lit("z")).withColumn("items", F.lit("i"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_targets_fill_up_and_stop_at_three_times(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), ("c", 900), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    bound, weight, total = {"a": 30, "b": 300, "c": 2700, None: 270}, {"a": 5, "b": 2, "c": 1, None: 5}, 1100
    full: set = set()
    while True:
        level = (total - sum(bound[k] for k in full)) / sum(w for k, w in weight.items() if k not in full)
        more = {k for k in bound if k not in full and level * weight[k] > bound[k]}
        if not more:
            break
        full |= more
    for k in bound:
        assert got[k] == pytest.approx(bound[k] if k in full else level * weight[k])


def test_mix_keeps_targets(spark, docs):
    rows, again = queries.op1_mixing(spark, SF).collect(), queries.op1_mixing(spark, SF).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, again))
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] + 1


def test_mix_odd(odd, none):
    got = mixing.plan(odd)
    assert got.agg(F.sum("n")).first()[0] == odd.count()
    assert mixing.plan(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns.count("copy") == 1 and set(odd.columns) == set(mixed.columns)


def _jaccard(docs):
    shingler = shingles.Shingler()
    return [(r.doc_id, set(shingler(r.text).tolist())) for r in docs.select("doc_id", "text").collect()]


def test_shingle_join_is_whole(spark, docs):
    sets = _jaccard(docs)
    got = {r.doc_id: r for r in queries.op2_shingles(spark, SF).collect()}
    near = defaultdict(set)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                near[a].add(b)
                near[b].add(a)
    for a, _ in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert (got[a].n_links, got[a].class_id) == (len(near[a]), min(seen))


def test_shingle_join_odd(odd, none):
    got = shingles.join(odd)
    assert got.count() == odd.count() and shingles.join(none).count() == 0
    kept = [(r.doc_id, r.text) for r in shingles.deduplicate(odd).collect()]
    assert sum(1 for i, t in kept if t and t.startswith("alpha")) == 2 and (4, None) in kept and (7, "other text under the same id") in kept


def test_shingle_join_loses_no_row_that_shares_an_id(spark):
    other = " ".join(f"w{k}" for k in range(20))
    near = LONG + " phi"
    rows = [(1, LONG), (7, LONG), (7, other), (9, near), (9, near + " chi"), (None, near + " psi"), (None, near + " psi"), (8, "  "), (8, "  "), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("row", F.lit("r")).withColumn("_mark", F.lit(1))
    kept = shingles.deduplicate(docs)
    assert kept.columns == docs.columns and {r._mark for r in kept.collect()} == {1}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, LONG), (7, other), (8, "  "), (8, "  "), (8, None)])
    got = Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in shingles.join(docs).collect())
    assert got[(1, 1, 5, True)] == 1 and got[(7, 7, 0, True)] == 1 and got[(None, 1, 5, False)] == 2
    copies = shingles.deduplicate(spark.createDataFrame([(5, other)] * 4 + [(None, LONG)] * 2, "doc_id int, text string")).collect()
    assert Counter(r.doc_id for r in copies) == Counter([5, None])


def test_shingle_join_of_large_and_chained_groups(spark, monkeypatch):
    """Blocks, groups and bands against all pairs."""
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    vocabulary = [f"t{k}" for k in range(400)]
    rows = []
    for g in range(6):
        base = rng.choice(vocabulary, 90).tolist()
        for k in range(30):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, 90))] = f"new{g}-{k}"
            rows.append((len(rows), " ".join(w)))
    sets = _jaccard(spark.createDataFrame(rows, "doc_id int, text string"))
    want = Counter()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                want[a] += 1
                want[b] += 1
    got = {r.doc_id: r.n_links for r in shingles.join(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {k: want[k] for k, _ in rows} and sum(want.values()) > 500


def test_bands_reach_the_recall():
    for least, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = shingles.choose_bands(least, recall)
        assert 1 - (1 - least ** rows) ** bands >= recall and bands * rows <= shingles.MOST_HASHES


def test_licenses(spark, odd, none):
    texts = ["Released UNDER the MIT License.", "Apache License, Version 2.0 - CC BY-NC", "is licensed under the GNU General Public License version 3", "nothing of this kind", None, "", "x under\nthe mit license y under the mit license", "ünder the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k: k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3" in got[2].labels and got[3].labels == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_licenses_of_wrapped_notices(spark):
    filler = [f"w{k}" for k in range(40)]
    texts, want = [], []
    for template, label in licenses.TEMPLATES:
        w = template.split()
        for width in (4, 8, 12):
            texts.append("\n".join(" * " + " ".join(x[k: k + width]) for x in (filler, w, filler) for k in range(0, len(x), width)))
            want.append(label)
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at"
    half = "This Source Code Form is subject to\n" + "\n".join(filler) + "\nthe terms of the Mozilla Public License"
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate([*texts, mpl, half])), "doc_id int, text string")).collect()}
    for k, label in enumerate([*want, "mpl-2"]):
        assert label in got[k].labels.split(",") and got[k].score >= 0.8
    assert got[len(texts) + 1].labels == ""


def test_license_join_against_brute_force(spark):
    """Every window of the template's length on both sides of every word."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(120):
        w = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][0].split()
        gone = rng.random(len(w)) < (0.0, 0.15, 0.3)[k % 3]
        texts.append(" ".join(["the", "of"] * 5 + [x if not g else f"z{k}" for x, g in zip(w, gone)] + ["software", "license"] * 4))
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for k, t in enumerate(texts):
        w, want = t.split(), set()
        for template, label in licenses.TEMPLATES:
            tokens, n = set(template.split()), len(template.split())
            if any(x in tokens and len(tokens & set(w[max(0, at - n): at + n + 1])) >= math.ceil(0.8 * len(tokens) - 1e-9) for at, x in enumerate(w)):
                want.add(label)
        phrases = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {t} "}
        assert phrases <= got[k] and got[k] - phrases <= want and len(want - got[k]) == 0


def test_vectors_of_a_real_grid(spark):
    """Several cells, neighbours at offsets of several shapes, lengths mixed."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((4000, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.standard_normal((4000, 16)) * (rng.random((4000, 16)) < rng.choice([0.1, 0.5, 1.0], (4000, 1)))
    step *= rng.uniform(0.05, 0.33, (4000, 1)) / np.maximum(1e-9, np.linalg.norm(step, axis=1, keepdims=True))
    x = np.vstack([base, base + step])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000 + k, [1.0, float(k % 2)]) for k in range(4)]
    got = {r.vec_id: r for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=512).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() and true.sum() > 4000
    assert [(got[9000 + k].n_links, got[9000 + k].component_id) for k in range(4)] == [(1, 9000), (1, 9001), (1, 9000), (1, 9001)]


def test_vectors_odd_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 2.0, 0.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.links(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect())
    assert got == Counter({(1, 2, 1): 2, (None, 2, 1): 1, (2, 1, 2): 1, (3, 1, 2): 1})


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = [*base, *(base[k % 8] + 0.05 * rng.standard_normal(16) for k in range(200)), base[0], base[0] * 3]
    rows = [(k, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, 2.0])]
    got = {r.vec_id: r for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(None)), block=16).collect()}
    m = np.array([r[1] for r in rows[: len(x)]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    true = near.sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    for k in range(1000, 1006):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_held_out(spark, docs):
    got = {r.doc_id: r for r in queries.op5_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert len(got) == len(truth) and sum(got[k].lang_pred == truth[k] for k in held) >= 0.97 * len(held)


def test_language_odd(odd, none):
    prototypes = langid.fit(odd)
    got = [(r.text_is_null, r.lang_pred, r.score) for r in langid.identify(odd.withColumn("text_is_null", F.col("text").isNull()), prototypes, key=("doc_id", "text_is_null")).collect()]
    assert len(got) == odd.count() and all(p == "und" and s == 0 for isnull, p, s in got if isnull)
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


def test_language_of_emoji_is_undefined():
    assert len(langid._codes("😀😀 12")) == 0 and len(langid._codes("𝒳")) == 3 and len(langid._codes("漢")) == 3


def test_html_keeps_what_only_looks_like_a_box():
    page = ('<body><article><h1>T</h1><p>One.</p><section class="related-work"><p>Two.</p></section><p class="legal-background">Three.</p><p>x = <math><mi>a</mi></math></p>'
            '<div class="comments-section"><p>Nice</p></div><div class="ad-slot">buy</div></article></body>')
    assert html_text.main_text(page) == "T\nOne.\nTwo.\nThree.\nx = a"
    long = "Long text of it, on and on. " * 30
    assert html_text.main_text(f"<body><article class=teaser><p>Short.</p></article><div class=text><p>{long}</p><p>{long}</p></div></body>").startswith("Long text")


@pytest.mark.parametrize("piece", ['<a b="c" ', '<div class="ad">', '<a b="c> x ', "<![CDATA[ x ", "<title>x", "<svg>x", "< ", "</x ", "<!x ", "<p>x", "<b><span>", "</b>", "<li>x", "<!-- "])
def test_html_of_hostile_pages_takes_linear_time(piece):
    import time

    def took(n):
        start = time.process_time()
        html_text.main_text(piece * n + "<article><h1>x</h1><p>some text</p></article>")
        return time.process_time() - start

    small, large = took(5000), took(40_000)
    assert large < 30 * max(small, 0.02)


def test_html_odd(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, "<p>b"), (2, None, None), (3, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(7))
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == Counter([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "b", 1), (2, None, "", 0), (3, "v", "", 0)])
    assert html_text.extract(df.limit(0)).count() == 0


def test_html():
    page = (
        '<html><head><title>T</title></head><body class="x"><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1>'
        '<p>First  <b>bold</b>\n text<p>Second &eacute;<ul><li>one<li>two</ul><form><input> Mail</form><div id="comments"><p>Nice post</p></div></article></main><aside>Ad</aside><footer>Foot</footer></body></html>'
    )
    assert html_text.main_text(page) == "Head & line\nFirst bold text\nSecond é\none\ntwo"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<script>x") == "" and html_text.main_text("plain words") == "plain words"
    plain = "<body><div id=menu><a href=x>a</a></div><div><div><p>" + "Long text here. " * 20 + "</p><p>" + "More of it. " * 20 + "</p></div></div><div class='sidebar'>side</div></body>"
    assert html_text.main_text(plain).startswith("Long text here.") and "side" not in html_text.main_text(plain)
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_of_plain_divs():
    short, long = "A paragraph of fifty letters, or thereabouts, here", "A list entry that goes on. " * 8
    post = f"<div class=post><p>{short} one</p><ul><li>{long}<li>{long}</ul><p>{short} two</p></div>"
    want = [f"{short} one", long.strip(), long.strip(), f"{short} two"]
    assert html_text.main_text(f"<body>{post}</body>").split("\n") == want
    links = "<div><a href=a>Home</a> | <a href=b>News</a> | <a href=c>About</a></div>"
    assert html_text.main_text(f"<body><div id=wrap>{links}{post}</div><div class=sidebar>side</div></body>").split("\n") == want
    paragraphs = "".join(f"<p>{long}{k}</p>" for k in range(5))
    entry = [f"{long}{k}" for k in range(5)]
    for page in (f"<div class=post><h1>Title</h1><div class=entry>{paragraphs}</div><p>End.</p></div>", f"<div class=post><h1>Title</h1>{paragraphs}End.</div>"):
        assert html_text.main_text(f"<body>{page}</body>").split("\n") == ["Title", *entry, "End."]
    assert html_text.main_text(f"<body><h1>Title</h1><div class=entry>{paragraphs}</div></body>").split("\n") == ["Title", *entry]
    assert html_text.main_text(f"<body><div>{short} {long}<ul><li>{long}</ul>tail</div></body>").endswith("\ntail")


def test_html_pages(spark):
    rows = queries.op6_html(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)


def _feistel(x, a, b, key, kind):
    import hashlib

    left, right = divmod(x, b)
    for i in range(pseudonyms.ROUNDS):
        of = lambda v: int(hashlib.sha256(f"{key}|{kind}|{i}|{v}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + of(right) % a) % a
        else:
            right = (right + of(left) % b) % b
    return left * b + right


def test_pseudonyms(spark, odd, none):
    rows = [(1, "card 4111 1111 1111 1111, ip 10.0.0.1, born 1980-02-29, ssn 123-45-6789, +1 (212) 555-1234, a@b.com"), (2, "4111111111111111 and 4111111111111112"), (3, None), (4, "")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = {x.kind: x.new for x in got[1].found}
    assert set(new) == {"card", "ipv4", "date", "ssn", "phone", "email"} and got[3].text is None and got[4].text == ""
    body = f"4111{_feistel(11111111111, 10 ** 5, 10 ** 6, 'k', 'card'):011d}"
    card = new["card"].replace(" ", "")
    assert card[:15] == body and [len(p) for p in new["card"].split(" ")] == [4] * 4
    assert got[2].text == f"{card} and 4111111111111112"
    ip = _feistel(10 << 24 | 1, 65536, 65536, "k", "ipv4")
    assert new["ipv4"] == ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))
    assert pseudonyms.pseudonymise(odd, "k").count() == odd.count() and pseudonyms.pseudonymise(none, "k").count() == 0


def test_pseudonyms_of_every_list(spark):
    """Dates, social security and phone numbers against a plain version; what is not valid stays."""
    from datetime import date, timedelta

    first = date(1900, 1, 1)
    days = [date(1900, 1, 1), date(1980, 2, 29), date(2099, 12, 31), date(2001, 11, 5)]
    want = {}
    for d in days:
        new = first + timedelta(_feistel((d - first).days, 17, 4297, "k", "date"))
        want |= {d.isoformat(): new.isoformat(), d.strftime("%m/%d/%Y"): new.strftime("%m/%d/%Y"), d.strftime("%d.%m.%Y"): new.strftime("%d.%m.%Y")}
    assert all(1900 <= int(x[:4]) < 2100 for x in want.values() if "-" in x)
    for area, group, serial in ((1, 1, 1), (665, 50, 77), (667, 99, 9999), (899, 12, 3456)):
        place = _feistel((area - (2 if area > 666 else 1)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "k", "ssn")
        a, rest = divmod(place, 99 * 9999)
        a += 1
        want[f"{area:03d}-{group:02d}-{serial:04d}"] = f"{a + (a >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    for x, y, z in ((212, 555, 1234), (999, 200, 0)):
        place = _feistel((x - 200) * 8_000_000 + (y - 200) * 10_000 + z, 800, 8_000_000, "k", "phone")
        a, rest = divmod(place, 8_000_000)
        want[f"({x}) {y}-{z:04d}"] = f"({a + 200}) {rest // 10_000 + 200}-{rest % 10_000:04d}"
    same = ["2023-02-30", "31/31/1999", "000-12-3456", "4111111111111112", "1234567890123", "300.1.2.3"]
    rows = list(enumerate([*want, *same]))
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(k, f"x {t} y") for k, t in rows], "doc_id int, text string"), "k").collect()}
    assert [got[k] for k, _ in rows] == [f"x {t} y" for t in [*want.values(), *same]]
    mails = [f"user{k}@mail{k % 7}.com" for k in range(300)]
    texts = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(mails)), "doc_id int, text string"), "k").collect()
    assert len({r.text for r in texts}) == 300 and not {r.text for r in texts} & set(mails)
    (r,) = pseudonyms.pseudonymise(spark.createDataFrame([(1, "password: c0rrect-horse!battery7.")], "doc_id int, text string"), "k").collect()
    assert "horse" not in r.text and r.text.endswith(".")


def test_pseudonyms_of_dates_keep_their_form(spark):
    from datetime import date

    def plain(m):
        sep = "." if "." in m else "/"
        one, two, year = m.split(sep)
        turned = sep == "/" and int(one) > 12
        day_first = sep == "." or turned
        month, day = (two, one) if day_first else (one, two)
        low, days, months = (13, 19, None) if turned else (1, 9 if len(day) == 1 else 31, None)
        months = 9 if len(month) == 1 else 12
        x, kind = ((int(year) - 1900) * months + int(month) - 1) * days + int(day) - low, f"date-{low}-{days}-{months}"
        while True:
            x = _feistel(x, 200 * months, days, "k", kind)
            y, mo, d = x // days // months + 1900, x // days % months + 1, x % days + low
            try:
                date(y, mo, d)
                break
            except ValueError:
                pass
        mo, d = str(mo).zfill(len(month)), str(d).zfill(len(day))
        return sep.join([d, mo, str(y)] if day_first else [mo, d, str(y)])

    olds = ["13/02/1999", "1.2.2004", "31.1.2000", "9/30/2010", "1/1/1900", "31/12/2099", "1.12.1987", "30/6/2001", "7/04/1976"] + [f"{d}/{m}/20{y:02d}" for d in (13, 20, 28) for m in (2, 11) for y in range(30)]
    got = [r.text for r in pseudonyms.pseudonymise(spark.createDataFrame([(k, x) for k, x in enumerate(olds)], "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    assert got == [plain(x) for x in olds] and len(set(got)) == len(set(olds))
    assert all([len(p) for p in re.split("[./]", a)] == [len(p) for p in re.split("[./]", b)] for a, b in zip(olds, got))


def test_secrets_without_digits_and_of_any_length(spark):
    long = "Ab" * 300
    secrets = ["correcthorse", "AKIA" + "ABCDEFGH" * 2, "abcdefab" * 4, "x" * 128, "x" * 129, "y" * 192, "y" * 193, long]
    texts = [f"password: {secrets[0]}", *secrets[1:3], *(f"api_key={x} end" for x in secrets[3:])]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame([*enumerate(texts), (99, "no secret here")], "doc_id int, text string"), "k").collect()}
    for k, x in enumerate(secrets):
        (found,) = got[k].found
        assert (found.kind, found.old, len(found.new)) == ("secret", x, len(x)) and got[k].text == texts[k].replace(x, found.new) and x not in got[k].text
    assert got[99].text == "no secret here" and got[99].found == []


def test_permutation_is_one_to_one(spark):
    got = spark.range(35).select(pseudonyms.permute(F.col("id"), F.lit(5).cast("long"), F.lit(7).cast("long"), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(35))


def test_leaks(spark, odd, none):
    b = [(1, LONG), (2, "one two three four five six seven eight nine ten eleven twelve. The answer is forty two"), (3, None), (4, ""), (None, "short item here")]
    filler = " ".join(f"w{k}" for k in range(200))
    changed = LONG.replace("delta", "q").replace("kappa", "z").replace("nu", "v")
    docs = spark.createDataFrame([(1, f"{filler} {LONG} {filler}"), (2, f"{filler} {changed} {filler}"), (3, filler), (4, None), (5, ""), (6, "alpha beta")], "doc_id long, text string").withColumn("row", F.lit(0))
    bench = spark.createDataFrame(b, "item_id long, text string")
    got = {r.doc_id: r.items for r in leaks.find(docs.drop("row"), bench).collect()}
    assert got == {1: "1", 2: "1", 3: "", 4: "", 5: "", 6: ""}
    assert {r.doc_id for r in leaks.decontaminate(docs, bench).collect()} == {3, 4, 5, 6}
    assert leaks.find(none, bench).count() == 0 and not any(r.contaminated for r in leaks.find(odd, bench.limit(0)).collect())


def _leaks_by_force(texts, bench):
    """Every stretch of every text against every item, without candidates."""
    frequency = Counter(w for t in texts for w in set(leaks.words(t)))
    idf = lambda ws: sum(math.log((1 + len(texts)) / (1 + frequency[w])) + 0.05 for w in ws)
    out = []
    for t in texts:
        w, hit = leaks.words(t), set()
        for k, b in bench.items():
            x, answer = leaks.words(b), leaks.answer_of(b)
            n, known = len(x), set(x)
            need, width, around = n if n < 8 else math.ceil(leaks.LEAST * n), n + max(4, n // 2), leaks.AROUND + 2 * n
            for at in range(len(w)):
                part = w[at: at + width]
                if w[at] in known and sum((Counter(part) & Counter(x)).values()) >= need and leaks.lcs(x, part) >= need and leaks.lcs(answer, part) >= leaks.ANSWER * len(answer):
                    held = known & set(w[max(0, at - around): at + around])
                    if (len(held) >= 2 or len(known) <= 2) and idf(held) >= leaks.WEIGHT * idf(known):
                        hit.add(k)
                        break
        out.append(hit)
    return out


def test_leaks_of_many_items_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    pick = lambda n: rng.choice(vocabulary, n, p=np.arange(3000, 0, -1) / 4501500).tolist()
    bench = {k: " ".join(pick(int(rng.integers(3, 70)))) + ". " + " ".join(pick(4)) for k in range(400)}
    texts = []
    for k in range(120):
        x = leaks.words(bench[k])
        share = 0.0 if k % 4 == 0 else 0.3 if k % 4 < 3 else 0.5
        changed = [w if rng.random() > share else "other" for w in x[:-4]] + x[-4:]
        texts.append(" ".join(pick(60) + changed + pick(60)))
    want = _leaks_by_force(texts, bench)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    for group in (4000, 150):
        got = {r.doc_id: {int(x) for x in r["items"].split(",") if x} for r in leaks.find(docs, items, group=group).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert sum(k in hit for k, hit in enumerate(want)) >= 50 and all(k in want[k] for k in range(0, 120, 4))


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, 20).tolist(), rng.integers(0, 6, 30).tolist()
        assert leaks.lcs(a, b) == plain(a, b)


def test_warc_round_trip(spark):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.op9_warc(spark, SF)
    want = db.sql(queries.SQL["op9_warc"])
    at = [got.columns.index(c) for c in want.columns]
    assert sorted((tuple(r[k] for k in at) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_warc_payloads(spark):
    import hashlib

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    bundles = warc.archive(spark.read.parquet(f"{SF}/pages.parquet"))
    for r in warc.read(bundles).collect():
        whole = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(whole), hashlib.sha1(whole).hexdigest())
        assert bytes(r.payload) == (whole if r.record_type == "response" else b"") and (r.record_type == "response" or pages[r.refers_to] == whole)
    ids = [r.record_id for r in warc.index(warc.archive(spark.createDataFrame([(1, "u", "x")] * 5, "page_id long, url string, html string"))).collect()]
    assert len(set(ids)) == 5
    w = warc.BundleWriter()
    w.add(*(lambda i, d: (i, 1, d.replace(b"text", b"tixt")))(*warc._record(1, "u", b"some text", 9, hashlib.sha1(b"some text").hexdigest(), None, False)))
    data, _ = w.close()
    with pytest.raises(ValueError):
        list(warc._records(warc.read_frame(data, warc.seek_table(data)[0])))


def test_warc_odd(spark):
    big = "<p>é" * 2000
    rows = [(1, "u1\nx", big), (9, None, big), (9, "again", big), (None, "n", big), (3, "s", "small"), (4, "s", "small"), (5, "e", None)]
    bundles = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)))
    got = warc.read(bundles).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 9), (9, "response", None), (9, "response", None), (None, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None)])
    assert {r.url for r in got} >= {"u1\nx", None}
    data = {r.bundle: bytes(r.data) for r in bundles.collect()}
    for r in warc.index(bundles).collect():
        assert warc.read_record(data[r.bundle], r.frame, r.offset, r.length)["page_id"] == r.page_id
    assert warc.read(warc.bundle(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_lines_against_brute_force(spark, docs):
    got = {r.doc_id: r.removed_lines for r in queries.op10_lines(spark, SF).collect()}
    seen, gone = [], defaultdict(list)
    for d, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if s:
                if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                    gone[d].append(k)
                seen.append(s)
    assert got == {d: ",".join(map(str, gone[d])) for d in got}


def test_lines_of_many_words_against_brute_force(spark):
    """Sizes around the width of the parity maps, near and far variants, ids that no number of bits holds beside places."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(500)]
    made = []
    for size in (3, 8, 20, 44, 47, 48, 52, 60, 130, 300):
        for _ in range(4):
            base = rng.choice(vocabulary, size, replace=False).tolist()
            for share in (0.0, 0.05, 0.1, 0.12, 0.2, 0.3):
                gone = rng.random(size) < share
                made.append(" ".join(w if not g else f"new{rng.integers(1 << 30)}" for w, g in zip(rng.permutation(base).tolist(), gone)))
    order = rng.permutation(len(made))
    docs = [(int(k) * (1 << 55), "\n".join(made[i] for i in order[at: at + 6])) for k, at in enumerate(range(0, len(made), 6))]
    seen, want = [], {}
    for d, t in docs:
        gone = []
        for k, line in enumerate(t.split("\n")):
            s = frozenset(line.split())
            if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                gone.append(k)
            seen.append(s)
        want[d] = gone
    got = {r.doc_id: r.removed for r in lines.decide(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 60


def test_long_documents_lose_lines_in_linear_time(spark):
    import time

    text = "\n".join(f"line number {k} of many {k * 7}" for k in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "own words only here")], "doc_id long, text string")
    start = time.time()
    kept = {r.doc_id: r.text for r in lines.deduplicate(docs).collect()}
    assert set(kept) == {1, 3} and kept[3] == "own words only here" and time.time() - start < 120


def test_line_steps_that_need_no_tokens_read_none(spark, monkeypatch):
    plans, real = [], lines.cut

    def cut(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **options)

    monkeypatch.setattr(lines, "cut", cut)
    some = spark.createDataFrame([(1, "one two three\nfour five"), (2, "One two THREE\n\n one  two three "), (3, None), (4, "five four")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in lines.decide(some).collect()} == {1: [], 2: [0, 2], 3: [], 4: [0]}
    reads = [{c.split("#")[0] for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", p) for c in scan.split(",")} for p in plans]
    copies = [r for r in reads if {"k1", "k2"} <= r]
    assert len(copies) >= 2 and not any("t" in r for r in copies)


def test_lines_odd(spark, odd, none):
    got = lines.decide(odd)
    assert got.count() == odd.count() and lines.decide(none).count() == 0
    kept = [(r.doc_id, r.text) for r in lines.deduplicate(odd).collect()]
    assert sum(1 for _, t in kept if t and t.startswith("alpha")) == 1 and (4, None) in kept and (5, "") in kept
    near = " ".join(f"w{k}" for k in range(30))
    some = spark.createDataFrame([(1, near), (2, near.replace("w3 ", "x ") + "\nnew line here"), (3, "  \n" + near.upper())], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in lines.decide(some).collect()} == {1: [], 2: [0], 3: [1]}


def _stage(spark, name, rows, monkeypatch=None):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = dict(pipeline.STAGES)[name](spark, spark.createDataFrame(rows, DOCS).withColumn("_mark", F.lit(1)).withColumn("row", F.lit(2)), SF)
    return pipeline, out


@pytest.fixture(scope="module")
def some_docs(docs):
    """Documents of the given table with near copies, repeated lines, foreign scripts, noise, odd rows."""
    rows = [tuple(r) for r in docs.where("doc_id < 45 and length(text) < 6000").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    first = rows[0][1]
    long = next(r for r in rows if len(r[1].split()) > 150)
    more = [
        (900, first, "de", "a", 1), (901, long[1] + " tail words", "en", None, None), (902, long[1].replace(long[1].split()[20], "changed", 1), None, "a", 1), (903, "漢字" * 60, None, "a", 1), (904, "12 34 !!", "en", "a", 1),
        (905, "x9Qz7Kpw " * 20, None, "a", 1), (906, None, "en", None, None), (907, "", "en", "b", 0), (907, long[1], "en", "b", 0), (None, long[1], "en", "b", 0), (908, "\n".join(first.split("\n")[:2]) + "\nown line of this text", "de", "a", 1),
    ]
    return rows + more


def test_pipeline_language(spark, some_docs):
    pipeline, out = _stage(spark, "language ID", some_docs)
    assert out.columns == list(pipeline.COLUMNS)
    labelled = [(r[1], r[2]) for r in some_docs if r[2]]
    vectors_, _ = langid.bundles([t for t, _ in labelled])
    unit = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=-1, keepdims=True))
    names = sorted({x for _, x in labelled})
    prototypes = unit(np.stack([unit(vectors_[[k for k, (_, x) in enumerate(labelled) if x == n]]).sum(axis=0) for n in names]))
    want = []
    for i, t, lang, source, n in some_docs:
        if t and any(c.isalpha() for c in t):
            cosine = unit(langid.bundles([t])[0][0]) @ prototypes.T
            if cosine.max() >= pipeline.LEAST_LANGUAGE_SCORE or len(t) < pipeline.LONG_ENOUGH:
                want.append((i, t, lang or names[int(cosine.argmax())], source, n))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    gone = {r[0] for r in some_docs} - {r[0] for r in got}
    assert {903, 904, 906} <= gone and not gone - {903, 904, 905, 906}
    assert dict(pipeline.STAGES)["language ID"](spark, spark.createDataFrame([(1, "ab", None, None, 1), (2, "1", None, None, 1)], DOCS), SF).count() == 1


def test_pipeline_lines(spark, some_docs):
    pipeline, out = _stage(spark, "line dedup", some_docs)
    order = sorted(some_docs, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in order].count(907) == 2  # the blank one has no line to lose, so their order does not matter
    seen, want = [], []
    for i, t, lang, source, _ in order:
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if not s or not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        left = "\n".join(kept)
        if left == (t or "") or left.strip():
            want.append((i, t if t is None else left, lang, source, None if t is None else len(left)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) < len(some_docs)


def test_pipeline_near_duplicates(spark, some_docs):
    pipeline, out = _stage(spark, "n-gram Jaccard join", some_docs)

    def shingles_of(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles_of(r[1]) for r in some_docs], list(range(len(some_docs)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    stays = {}
    for k, r in enumerate(some_docs):
        if sets[k]:
            stays.setdefault(group[k], []).append((r[0] is None, r[0] or 0, k))
    keep = {min(v)[2] for v in stays.values()} | {k for k, s in enumerate(sets) if not s}
    assert Counter(tuple(r) for r in out.collect()) == Counter(some_docs[k] for k in keep) and len(keep) < len(some_docs) - 3


def test_near_duplicates_bound_memory(spark, some_docs, monkeypatch):
    from riskweave.llm import _support

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 3_000_000, 1, 8).orderBy(F.sha2(F.col("id").cast("string"), 256)).write.format("noop").mode("overwrite").save()
    taken = runtime.totalMemory()
    _support.release(spark)
    assert runtime.totalMemory() < taken
    calls = []
    monkeypatch.setattr(shingles, "release", lambda s: calls.append(s))
    assert _stage(spark, "n-gram Jaccard join", some_docs[:8])[1].count() and calls
    shingler = shingles.Shingler()
    for k in range(0, 400_000, 5000):
        assert len(shingler(" ".join(f"w{j}" for j in range(k, k + 5000)))) == 4996
    assert len(shingler._known) <= shingles.MOST_KNOWN + 5000


def test_pipeline_decontamination(spark, some_docs):
    _, out = _stage(spark, "benchmark decontamination", some_docs)
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    planted = [(950, "Some words. " + next(t for t in bench.values() if len(t.split()) > 20) + " And others.", "en", "a", 1)]
    hits = _leaks_by_force([r[1] for r in some_docs], {k: t for k, t in bench.items() if t})
    want = [r for r, h in zip(some_docs, hits) if not h]
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert _stage(spark, "benchmark decontamination", planted + some_docs[:5])[1].where("doc_id = 950").count() == 0


def test_pipeline_mix(spark, some_docs):
    pipeline, out = _stage(spark, "mixing sources to target weights", some_docs)
    assert out.columns == [*pipeline.COLUMNS, "copy"]
    target = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in some_docs], "source string, size long")).collect()}
    taken, largest = Counter(), Counter()
    for r in out.collect():
        assert 1 <= r["copy"] <= 3
        taken[r.source] += len((r.text or "").split())
    for r in some_docs:
        largest[r[3]] = max(largest[r[3]], len((r[1] or "").split()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    empty = spark.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_runs(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 50 < len(rows) and {r.doc_id for r in rows} <= ids
