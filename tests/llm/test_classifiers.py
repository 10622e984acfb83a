"""Quality rules, classifiers and page extraction: brute force, held-out accuracy, odd rows."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import html_tree, langid, licences, quality, rules, sample_pages
from foliant.llm.queries import QUERIES


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op5_quality_rules"](spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in found} == {k: counts(t) for k, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in found)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.9


def test_rules_odd_rows(spark, odd_rows, no_rows):
    rows = [tuple(r) for r in odd_rows.select("doc_id", "text").collect()]
    found = sorted((tuple(r)[:7] for r in rules.judge(odd_rows).collect()), key=repr)
    assert found == sorted(((i, *counts(t)) for i, t in rows), key=repr)
    assert rules.judge(no_rows).count() == 0 == rules.kept_documents(no_rows).count()
    repeated = spark.createDataFrame([(1, "a b c a b c d"), (2, "x x x x"), (3, "a\n\na\n a\nb b")], "doc_id long, text string")
    assert [tuple(r)[1:7] for r in rules.judge(repeated).orderBy("doc_id").collect()] == [counts(t) for t in ("a b c a b c d", "x x x x", "a\n\na\n a\nb b")]


def test_kept_documents_equal_verdicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = rules.kept_documents(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rules.judge(docs).where("kept").collect()}


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    votes = []
    for accuracy in (0.9, 0.8, 0.7):
        vote = np.where(rng.random(4000) < accuracy, truth, ~truth).astype(int)
        votes.append(np.where(rng.random(4000) < 0.2, rules.ABSTAIN, vote))
    patterns = collections.Counter(zip(*[v.tolist() for v in votes]))
    model = rules.fit(sorted(patterns.items()), rounds=300)
    assert model.prior == pytest.approx(0.7, abs=0.08)
    for accuracy, chance in zip((0.9, 0.8, 0.7), model.chances):
        good = chance[rules.GOOD][0] / (chance[rules.GOOD][0] + chance[rules.BAD][0])
        assert good == pytest.approx(accuracy, abs=0.08)
    assert rules.fit([]).chances == []


def test_licence_model_is_accurate_and_calibrated():
    model = licences.default_model()
    samples = licences._samples(99, 3)
    logits = []
    for text, _ in samples:
        grams = [model.weights[g] for g in licences.ngrams(text) if g in model.weights]
        logits.append((np.array(model.bias) + np.sum(grams, axis=0) if grams else np.array(model.bias)) / model.temperature)
    p = np.exp(logits - np.max(logits, axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.array([model.classes[i] == c for i, (_, c) in zip(p.argmax(axis=1), samples)])
    assert right.mean() > 0.93 and abs(right.mean() - p.max(axis=1).mean()) < 0.08


def test_licence_scan(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"), (2, "My licence expired."), (3, "Licensed under the Foo Bar License"), (4, None), (5, "SPDX-License-Identifier: GPL-3.0-or-later"),
        (6, "Text. Licensed under CC BY-SA 4.0.\nReleased under the MIT License."), (6, "Licensed under the GNU Lesser General Public License, version 3"), (7, ""), (8, "no such thing"),
    ]
    found = sorted(((r["doc_id"], r["families"], r["n_notices"], r["n_unknown"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == [(1, "mit", 1, 0), (2, "", 0, 1), (3, "", 0, 1), (4, "", 0, 0), (5, "gpl-3.0", 1, 0), (6, "cc-by-sa,mit", 2, 0), (6, "lgpl", 1, 0), (7, "", 0, 0), (8, "", 0, 0)]


def test_licence_scores_equal_plain_form(spark):
    model = licences.default_model()
    text = "This work is licensed under the GNU General Public License, version 3, or so they say"
    row = licences.notices(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    logits = (np.array(model.bias) + sum(np.array(model.weights[g]) for g in licences.ngrams(text) if g in model.weights)) / model.temperature
    p = np.exp(logits - logits.max())
    assert row["family"] == model.classes[int(p.argmax())] == "gpl-3.0" and row["probability"] == pytest.approx(p.max() / p.sum(), rel=1e-5)


def test_licence_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    signs = {"apache-2.0": "Licensed under the Apache License, Version 2.0", "mit": "Released under the MIT License", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "Licensed under CC BY-NC 4.0"}
    for r in QUERIES["op2_license_scan"](spark, sf_dir).collect():
        assert {f for f, s in signs.items() if s in texts[r["doc_id"]]} == set(r["families"].split(",")) & set(signs)


def test_licence_odd_rows(odd_rows, no_rows):
    assert licences.scan(odd_rows).where("families = ''").count() == odd_rows.count() and licences.scan(no_rows).count() == 0


PAGE = """<html lang=en><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make things better. Accept?</p></div><article><h1>Real title</h1><p>First &amp; foremost,
this is the   text<br>of it. It goes on.</p><script>var x = "</p>";</script><ul><li>One point made here.</li></ul><p>Last words of the article, to end it.</p></article>
<div id="comments"><h3>Replies</h3><ol><li><p>I disagree with all of this strongly.</p></li></ol></div><aside><p>Related stories you may like.</p></aside><form><input><button>Send</button></form><footer>&copy; 2024 Someone</footer></body></html>"""


@pytest.fixture(scope="module")
def tree():
    return html_tree.default_model()


def test_page(tree):
    assert html_tree.main_texts([PAGE, None, "", "<p>", "plain"], tree)[:4] == ["Real title\nFirst & foremost, this is the text of it. It goes on.\nOne point made here.\nLast words of the article, to end it.", "", "", ""]


def test_marginals_equal_enumeration(tree):
    page = html_tree.Page("<div class=post><p>Some words here. And more.</p><ul><li>x</li></ul></div><footer>c</footer>")
    n = len(page.tag)
    unary = [sum(tree.weights[f] for f in row) for row in page.active()]
    bond = [tree.run if t == "#text" else tree.element for t in page.tag]
    total, content = 0.0, np.zeros(n)
    for bits in range(1 << n):
        x = [bits >> i & 1 for i in range(n)]
        weight = np.exp(sum(u for u, b in zip(unary, x) if b) + sum((bond[i] if x[i] == x[page.parent[i]] else -bond[i]) for i in range(1, n)))
        total += weight
        content += weight * np.array(x)
    assert np.allclose(tree.marginals([page])[0], content / total)


def test_unseen_layouts(tree):
    right = total = 0
    for source, labels in sample_pages.labelled_pages(80, seed=77):
        page = html_tree.Page(source)
        for text, tag, p in zip(page.text, page.tag, tree.marginals([page])[0]):
            if tag == "#text":
                total += 1
                right += (p >= 0.5) == labels[text]
    assert right / total > 0.97


def test_extraction_query(spark, sf_dir):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op3_html_extraction"](spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_extraction_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<div" * 3000, "x"), (3, "u", "<p>" + "a. " * 50_000, "x"), (4, "u", "<a href='x>broken <b>q", "x")]
    found = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert found.count() == len(rows) and found.where("page_id = 1").first()["text"] == ""
    assert html_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op4_quality_classifier"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    unseen = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in unseen]) > 0.95


def test_quality_odd_rows(spark, odd_rows, no_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    assert quality.quality_scores(odd_rows, labels).where("score between 0 and 1").count() == odd_rows.count()
    blank = quality.quality_scores(odd_rows, labels.limit(0))
    assert {r["score"] for r in blank.collect()} == {0.5} and quality.quality_scores(no_rows, labels).count() == 0


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2 * quality.DIMENSIONS))
    y = (rng.random(3000) < 1 / (1 + np.exp(-4 * x[:, 0] + 3 * np.abs(x[:, 1])))).astype(float)
    net = quality.fit_network(x[:2000], y[:2000])
    net.temperature = quality.calibrate(net, x[2000:2500], y[2000:2500])
    p = net.scores(x[2500:])
    assert ((p >= 0.5) == y[2500:]).mean() > 0.75 and abs(p.mean() - y[2500:].mean()) < 0.1


def test_language_query(spark, sf_dir):
    found = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert np.mean([r["lang"] == r["url"].split("/")[3] for r in found]) > 0.97


def test_language_evidence_fuses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_lang = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max("text").alias("text")).collect()}
    rows = [(i, f"https://h{i % 3}.example.org/x", f'<html lang="{k}"><body><p>{t}</p>', "c") for i, (k, t) in enumerate(sorted(by_lang.items()) * 5)]
    rows += [(100, "https://h9.example.org/", f'<html lang="xx"><p>{by_lang["fr"]}', "c"), (101, None, None, None), (101, None, None, None), (102, "https://h9.example.org/y", '<html lang="de"><p>1 2 3', "c")]
    found = {r["page_id"]: r for r in langid.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), docs).collect()}
    assert found[100]["lang"] == "fr" and found[100]["declared"] == "other" and found[102]["lang"] == "de" and 0 < found[101]["probability"] <= 1
    pages = spark.createDataFrame(rows[:2], "page_id long, url string, html string, host string")
    assert langid.page_languages(pages.limit(0), docs).count() == 0
    assert [r["lang"] for r in langid.page_languages(pages, docs.limit(0)).collect()] == [None, None]


def test_every_notice_is_read_and_confirmed(spark):
    wanted = [(f, t) for f, texts in sorted(licences.NOTICES.items()) for t in texts]
    assert all(any(c in t.lower() for c in licences.CUES) for _, t in wanted)
    gate = set(licences.gate_words(0.6))
    assert all(gate & set(licences.ngrams(t)) for _, t in wanted)
    found = {r["doc_id"]: r["families"] for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wanted)], "doc_id long, text string")).collect()}
    assert [(t, found[i]) for i, (_, t) in enumerate(wanted)] == [(t, f) for f, t in wanted]


def test_gate_leaves_out_no_share():
    parts = {}
    for gram, _, notice, part in licences._notice_parts():
        parts.setdefault(notice, []).append((gram, part))
    for least in (0.3, 0.6, 0.9):
        gate = set(licences.gate_words(least))
        assert all(sum(p for g, p in rows if not gate & set(g.split(" "))) < least for rows in parts.values())


def test_all_licences_of_a_paragraph(spark):
    prose = "the river ran low and the people of the town came to see what was left of it "
    rows = [
        (1, "Dual licensed under the MIT License or the Apache License, Version 2.0"),
        (2, prose * 40 + "released under the GPL v3 " + prose * 40 + "licensed under CC BY-SA 4.0 " + prose * 40),
        (3, "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
        (4, prose * 60),
    ]
    found = {r["doc_id"]: (r["families"], r["n_notices"], r["n_unknown"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("apache-2.0,mit", 1, 0), 2: ("cc-by-sa,gpl-3.0", 1, 0), 3: ("agpl-3.0", 1, 0), 4: ("", 0, 0)}


def test_deep_and_broken_pages_take_time_by_their_length(tree):
    import time

    body = "<article><p>Some words stand here. They end here.</p></article>"
    pages = ["<div>" * 100_000 + body, body + "</div>" * 100_000 + "<p>" * 50_000, "<span><li>" * 50_000 + body, "<a href='x>" * 50_000 + body, '<b c="' + "<i d='e'>" * 50_000 + body]
    began = time.process_time()
    found = html_tree.main_texts(pages, tree)
    assert time.process_time() - began < 60
    assert found[1] == "Some words stand here. They end here."


def test_closing_stops_at_the_part_that_holds_it():
    page = html_tree.Page("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<p>e<td>f</table><p>g<div>h</div>i")
    runs = {t: page.parent[i] for i, t in enumerate(page.text) if t}
    tags = {t: page.tag[p] for t, p in runs.items()}
    assert tags == {"a": "li", "b": "li", "c": "li", "d": "td", "e": "p", "f": "td", "g": "p", "h": "div", "i": "body"}
    assert page.parent[runs["a"]] == page.parent[runs["c"]] and page.tag[page.parent[page.parent[runs["b"]]]] == "li"


def plain_languages(rows, model, lean=5.0, smoothing=1.0, trust=300):
    """The fused posterior page by page, in plain loops. rows: (host, domain, suffix, declared, text evidence)."""
    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    soft = [softmax(r[4]) for r in rows]
    total = sum(soft)
    share = (total + smoothing) / (total.sum() + len(total) * smoothing)
    out = []
    for i, row in enumerate(rows):
        same = lambda k: sum((s for j, s in enumerate(soft) if j != i and rows[j][k] == row[k]), np.zeros(len(total)))  # noqa: E731, B023
        score = np.array(row[4], float)
        for k in (3, 2):
            score += np.log((same(k) + smoothing) / (total - soft[i] + smoothing * len({r[k] for r in rows})))
        domain = (same(1) + lean * share) / (same(1).sum() + lean)
        score += np.log((same(0) + lean * domain) / (same(0).sum() + lean))
        p = softmax(score)
        out.append((model.languages[int(p.argmax())], p.max()))
    return out


def test_language_posterior_equals_plain_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_text_model(docs)
    short = {r["lang"]: " ".join(r["text"].split()[:6]) for r in docs.groupBy("lang").agg(F.max("text").alias("text")).collect()}
    hosts = [("a.example.co.uk", "example.co.uk", "uk"), ("b.example.co.uk", "example.co.uk", "uk"), ("other.co.uk", "other.co.uk", "uk"), ("www.site.de", "site.de", "de"), ("10.0.0.7", "10.0.0.7", ""), ("localhost", "localhost", "localhost")]
    pages, rows = [], []
    for i in range(40):
        host, domain, suffix = hosts[i % len(hosts)]
        lang = sorted(short)[i % 3]
        said = ["", lang, "xx"][i % 3 if i % 5 else 1]
        body = "" if i % 11 == 0 else short[lang]
        html = f"<html{f' lang={said}' if said else ''}><body><p>{body}</p>"
        pages.append((i, f"https://user@{host}:80/p{i}", html))
        rows.append((host, domain, suffix, "other" if said == "xx" else said, model.evidence(langid.visible_text(html), 300)))
    found = langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).orderBy("page_id").collect()
    for r, (lang, chance) in zip(found, plain_languages(rows, model), strict=True):
        assert r["lang"] == lang and r["probability"] == pytest.approx(chance, rel=1e-6)


def test_rare_languages_keep_their_class(spark):
    docs = spark.createDataFrame([(i, "aa", f"alpha beta gamma {i}") for i in range(60)] + [(900, "bb", "omega psi chi phi omega psi")], "doc_id long, lang string, text string")
    assert langid.fit_text_model(docs, per_language=5).languages == ["aa", "bb"]


def test_notices_over_several_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
    rows = [
        (1, "\n".join("# " + x for x in mit.split("\n"))),
        (2, " * licensed under the GNU General\n * Public License, version 2\n"),
        (3, "This is free and unencumbered software released into the public\ndomain."),
        (4, "it lies in the public\ndomain"),
        (5, "// Licensed under the Apache License,\n// Version 2.0\n//\n// Released under the\n// MIT License"),
        (6, "made available under the Eclipse Public License, version 2.0"),
    ]
    found = {r["doc_id"]: (r["families"], r["n_unknown"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("mit", 0), 2: ("gpl-2.0", 0), 3: ("unlicense", 0), 4: ("", 1), 5: ("apache-2.0,mit", 0), 6: ("", 1)}


def plain_best_window(text, model, least_share=0.6):
    """Likeliest class of each 64-word window, in plain loops; the families among them that are likely and confirmed."""
    parts = {}
    for gram, family, notice, part in licences._notice_parts():
        parts.setdefault((family, notice), {})[gram] = part
    w = re.findall(licences._WORD, text.lower())
    sure = set()
    for start in range(0, max(len(w) - 32, 1), 32):
        grams = licences.ngrams(" ".join(w[start : start + 64]))
        logits = (np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.classes)))) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        family = model.classes[int(p.argmax())]
        share = max((sum(x for g, x in held.items() if g in grams) for (f, _), held in parts.items() if f == family), default=0)
        if family != licences.UNKNOWN and p.max() >= 0.5 and share >= least_share:
            sure.add(family)
    return sure


def test_licences_of_documents_hold_against_plain_windows(spark):
    import random

    r = random.Random(8)
    notices = [(f, t) for f, texts in sorted(licences.NOTICES.items()) for t in texts]
    prose = "the river ran low and people of the town came to see what was left of it after a long summer without rain".split()
    rows = []
    for i in range(120):
        words = r.choices(prose, k=r.randint(0, 150))
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randint(0, len(words))
            words[at:at] = (r.choice(notices)[1] if r.random() < 0.8 else r.choice(licences.OTHER)).split()
        rows.append((i, " ".join(words)))
    model = licences.default_model()
    found = {x["doc_id"]: set(filter(None, x["families"].split(","))) for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:  # the scan may confirm further families beside the likeliest of a window
        assert plain_best_window(text, model) <= found[i]
        assert found[i] <= {f for f, t in notices if sum(g in licences.ngrams(text) for g in licences.ngrams(t)) >= 0.5 * len(licences.ngrams(t))}


def test_rows_of_words_equal_plain_form():
    import xxhash

    bodies = [b"a bb a a ccc", b"", b"a", b"a a  x\ty"]
    words, endings, lengths = quality.rows_of(bodies)
    plain, ends = [], []
    for body in bodies:
        split = body.split()
        plain += [xxhash.xxh3_64_intdigest(w) % quality.WORDS for w in split]
        ends += [quality.REPEATED if i and w == split[i - 1] else quality.WORDS + xxhash.xxh3_64_intdigest(w[-2:]) % quality.ENDINGS for i, w in enumerate(split)]
    assert words.tolist() == plain and endings.tolist() == ends and lengths.tolist() == [len(b.split()) for b in bodies]


def test_word_vectors_and_scores_equal_plain_form(spark):
    """Sums of neighbours' index vectors, means of rows, and the network, all in loops."""
    texts = ["one two three two", "four", "", None, "two two one five one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    places, signs = quality.index_vectors()
    own = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for row in range(quality.ROWS):
        for k in range(2):
            own[row, places[row, k]] = signs[row, k]
    context = np.zeros_like(own)
    streams = []
    for text in texts:
        words, endings, _ = quality.rows_of([(text or "").encode()])
        streams.append((words, endings))
        for stream in (words, endings):
            for i, row in enumerate(stream):
                for j in range(max(0, i - 2), min(len(stream), i + 3)):
                    if j != i:
                        context[row] += own[stream[j]]
    context -= context.sum(axis=0) / max(np.abs(context).sum(), 1) * np.abs(context).sum(axis=1, keepdims=True)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, context + own, atol=1e-5)
    pooled = {r["doc_id"]: np.frombuffer(r["vector"], "<f4") for r in quality.pooled(docs, vectors).collect()}
    for i, (words, endings) in enumerate(streams):
        wanted = np.concatenate([vectors[s].sum(axis=0) / max(len(s), 1) for s in (words, endings)])
        assert np.allclose(pooled[i], wanted, atol=1e-5)
