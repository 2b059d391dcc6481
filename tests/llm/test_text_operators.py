"""Operators on single texts: brute force, edge cases, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import chars, decontaminate, html_text, langid, licenses, line_dedup, quality, toxicity

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " \n\t", "!?", "a", "É", "naïve Über 東京 word", "x" * 5000, "a b " * 3000, "A B C", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean, n_words string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0.5, True, "x") for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3


@pytest.mark.parametrize("table, pattern", [(chars.blank_word_table, BLANK), (chars.plain_word_table, PLAIN)])
def test_words_agree_with_the_pattern(table, pattern):
    texts = [lower(t) for t in ODD]
    text, starts = chars.codes(texts)
    begin, end, first = chars.words(text, starts, table())
    for i, t in enumerate(texts):
        want = pattern.findall(t)
        got = ["".join(map(chr, text[b:e])) for b, e in zip(begin[first[i]:first[i + 1]], end[first[i]:first[i + 1]])]
        assert got == want
    assert [b for a, b in chars.batches(texts, 10)][-1] == len(texts)
    assert [i for a, b in chars.batches(texts, 10) for i in range(a, b)] == list(range(len(texts)))


def test_hashes_follow_content_only():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    text, starts = chars.codes([" ".join(words[:200]), " ".join(words[200:])])
    begin, end, first = chars.words(text, starts, chars.blank_word_table())
    h = chars.hashes(text, begin, end)
    seen = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    sh, cut = chars.shingles(h, first, 5)
    assert cut.tolist() == [0, 196, 392]
    flat = {}
    for k in range(196):
        assert flat.setdefault(tuple(words[k:k + 5]), sh[k]) == sh[k]
    short, cut = chars.shingles(h[:3], np.array([0, 3, 3]), 5)
    assert cut.tolist() == [0, 1, 1] and len(short) == 1


def test_language(spark):
    de, en = "der hund und die katze schlafen heute nacht", "the dog and the cat are sleeping tonight"
    rows = [(i, de if i % 2 else en, "de" if i % 2 else "en", "s") for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, en, None, None), (7, de, "de", "s")]
    out = langid.identify(docs(spark, rows)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and fold(r.doc_id) == 1)
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == ("de" if r.doc_id % 2 else "en")
    by = {r.doc_id: r for r in out}
    assert [by[100 + i].lang_pred == "und" for i in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert langid.identify(docs(spark, [])).collect() == []
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "abc")])).collect()] == ["und"]
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs(spark, [(i, "abc", f"l{i}") for i in range(3)]), max_languages=2)


def test_language_counts_against_brute_force():
    texts = ["Ab, c", "", None, "éa"]
    text, starts, has = langid._letters(texts)
    plain = ["".join(map(chr, text[a:b])) for a, b in zip(starts, starts[1:])]
    assert plain[0] == " ab  c " or plain[0].split() == ["ab", "c"]
    assert has.tolist() == [True, False, False, True] and plain[3] == " éa "
    for k, (gram, first) in zip((1, 2), langid._grams(text, starts, 20, (1, 2))):
        seen = {}
        for i, p in enumerate(plain):
            want = [p[j:j + k] for j in range(len(p) - k + 1)]
            assert len(want) == first[i + 1] - first[i]
            for g, b in zip(want, gram[first[i]:first[i + 1]].tolist()):
                assert seen.setdefault(g, b) == b


def test_toxicity(spark):
    rnd = random.Random(3)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rnd.choice(clean) for _ in range(30)] + (["vilething"] * 2 if toxic else [])
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    labels += [(0, 1, 1), (None, 0, 1), (5000, 1, 1), (4, 1, None)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.detect(docs(spark, rows), lab).collect()}
    assert len(out) == len(rows)
    for i in range(900):
        assert out[i].predicted == int(i % 6 == 0) == int(out[i].score >= 0.7)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].predicted == 0
    again = {r.doc_id: r.score for r in toxicity.detect(docs(spark, rows[::-1]).repartition(5), lab).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-9 for i in out)
    assert toxicity.detect(docs(spark, []), lab).collect() == []
    assert all(r.predicted == 0 for r in toxicity.detect(docs(spark, rows), lab.where("false")).collect())


def test_risk_stays_non_negative():
    """With every unlabelled row also a positive, the bracket would go below zero: the fit must not run away."""
    rows = [np.array([0])] * 20
    weight, bias = toxicity.fit(rows, rows, 0.3, 1)
    assert abs(weight[0] + bias) < 20


def test_quality(spark):
    good = "This is a fair sentence with some words. It ends here, as it should."
    rows = [(i, good if i % 4 else "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! BUY!!", "en", "s") for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD[:6])] + [(None, good), (1, good, "en", "s")]
    lab = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(150)] + [(None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None and i < 200} == {i for i in range(200) if i % 4} and ids.count(1) == 2
    assert quality.keep_good(docs(spark, []), lab).collect() == []
    assert quality.keep_good(d, lab.where("false")).count() == len(rows)


@pytest.mark.parametrize("k", [1, 2, 50, 999, 1000, 2000])
def test_kth_largest(spark, k):
    rnd = random.Random(k)
    values = [round(rnd.gauss(0, 1000), 3) for _ in range(900)] + [5.0] * 100
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert quality.kth_largest(df, "v", k) == pytest.approx(sorted(values, reverse=True)[min(k, 1000) - 1], abs=1e-5)
    assert quality.kth_largest(df.where("v is null"), "v", 3) is None


def _hits(texts, items, size=10):
    windows = {}
    for i, t in items:
        w = PLAIN.findall(lower(t))
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).update({str(i)} if i is not None else set())
    out = {}
    for i, t in texts:
        w, hit, found = PLAIN.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 9, 10, 11, 25])))) for i in range(25)]
    items += [(3, "Alpha, BETA"), (None, "gamma delta epsilon"), (90, None), (91, "..."), (10, items[4][1])]
    texts = []
    for i in range(150):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            t[5:5] = PLAIN.findall(lower(rnd.choice(items[:27])[1]))
        texts.append((i, rnd.choice([" ", ", ", "\n"]).join(t)))
    texts += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "alpha beta"), (2001, "x gamma delta epsilon y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.find(d, bench).collect()}
    assert got == _hits(texts, items)
    clean = decontaminate.clean(d, bench)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, v in got.items() if not v[4]}
    assert not any(r.contaminated for r in decontaminate.find(d, bench.where("false")).collect())
    assert decontaminate.find(docs(spark, []), bench).collect() == []
    assert decontaminate.find(docs(spark, [(5, "alpha beta"), (5, "alpha beta"), (5, None)]), bench).count() == 3


def test_line_removal(spark):
    rule = "All rights reserved by the owners of this site."
    rows = [(i, f"Own line {i}, long enough to stay whatever happens to the other one.\n{rule.upper() if i % 2 else rule}\r\n\nend {i}", "en", f"s{i % 12}") for i in range(48)]
    rows += [(100, rule, "en", "s1"), (101, None, "en", None), (102, "", "en", "s2"), (103, "\n\n", "en", "s2"), (None, f"{rule}\n" + "w " * 40, "en", None)]
    rows += [(200 + i, f"rare {'x' * 70}\nmany {i} {'y' * 70}", "en", f"s{i % 9}") for i in range(40)]
    d = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    out = line_dedup.strip(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].n_removed == 1 and rule not in by[0].text and by[0].text.endswith("\n\nend 0") and by[0].n_chars == len(by[0].text)
    assert by[100].text == rule and by[100].n_removed == 0  # nothing else in it
    assert by[101].text is None and by[101].n_lines == 0 and by[102].text == "" and by[103].text == "\n\n"
    assert by[None].n_removed == 1 and by[200].n_removed == 0  # nine sites are too few
    assert line_dedup.strip(d.where("false")).collect() == []


def test_mostly_boilerplate_loses_its_lines(spark):
    rule = "All rights reserved by the owners of this site."
    rows = [(i, f"{rule}\nown {i}\n", "en", f"s{i}") for i in range(12)] + [(50 + i, f"{rule}\n\nSame page everywhere.", "en", f"s{i}") for i in range(12)]
    d = docs(spark, [*rows, (90, f"{rule}\n \n", "en", "s1"), (91, None, "en", "s1"), (92, f"{rule}\nSame page everywhere.\nx", "en", "s2")])
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    by = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.strip(d).collect()}
    assert all(by[i] == (f"own {i}\n", 1) for i in range(12)) and by[92] == ("x", 2)
    assert all(by[50 + i] == (rows[12 + i][1], 0) for i in range(12))  # copies of one page on 12 sites
    assert by[90] == (f"{rule}\n \n", 0) and by[91] == (None, 0)
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, d, "").collect()}
    assert staged == {i: t for i, (t, _) in by.items()}
    clash = d.withColumns({"n_lines": F.lit("mine"), "n_removed": F.lit(None), "line": F.lit(1), "site": F.lit(2)})
    out = line_dedup.strip(clash)
    assert out.columns == [*d.columns, "line", "site", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == by
    staged = corpus_pipeline.line_stage(spark, clash, "")
    assert staged.columns == clash.columns and {(r.n_lines, r.n_removed) for r in staged.collect()} == {("mine", None)}


def test_line_removal_agrees_with_sql(spark, sf_dir, tmp_path):
    import duckdb

    rows = [(i, "\n".join([f"l{i}", *[f"common {j}" for j in range(4) if (i // 3) % (j + 2)], f"tail{i} " * 20]), "en", f"s{i % 14}") for i in range(300)]
    d = docs(spark, rows).select("doc_id", "text", "source")
    con = duckdb.connect()
    documents = d.toPandas()  # noqa: F841
    want = con.execute(line_dedup.ORACLE).fetchall()
    got = line_dedup.strip(d).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.n_removed for r in got)


def test_line_removal_moves_no_text_twice(spark, capsys):
    rows = [(i, f"own {i}\n" + "\n".join(f"Rule {j}\r" for j in range(i // 12 % 4)), "en", f"s{i % 12}") for i in range(96)]
    rows += [(200 + i, "rule 0\nRULE 1", "en", "s1") for i in range(2)] + [(300, None, "en", None), (None, "rule 0\nmine", "en", None)]
    d = docs(spark, [*rows, *rows[:5]]).withColumn("n_chars", F.length("text").cast("long"))
    listed, joined = line_dedup.strip(d), line_dedup.strip(d, listed=2)
    got = sorted(map(str, listed.collect()))
    assert got == sorted(map(str, joined.collect())) and len(got) == 105 and "text='mine'" in "".join(got)
    capsys.readouterr()
    listed.explain()
    assert "Exchange" not in capsys.readouterr().out  # a few lines go to the texts
    joined.explain()
    plan = capsys.readouterr().out
    moved = [line for line in plan.splitlines() if " AS __row#" in line and "struct(" in line]
    assert moved and all("text, text#" not in line and line.count(" AS __text#") == 1 for line in moved)  # once a row
    parted = [line for line in plan.splitlines() if "Generate explode" in line]
    assert parted and not any("text#" in line for line in parted)  # and not once a line


def test_licenses_against_brute_force(spark):
    texts = ["Released under the MIT License.", "under the mit license under the MIT license", "Licensed under CC BY-NC 4.0.", "cc by nc sa",
             "the Apache License, Version 2.0", "GNU General Public License, version 3 or later", "x under the mit licenses", *ODD]
    phrases = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    d = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    for i, t in enumerate(texts):
        w = PLAIN.findall(lower(t))
        at = [(k, v) for k in range(len(w)) for p, v in phrases.items() if tuple(w[k:k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[5].labels == "gpl-3" and "cc-by-nc-sa" in got[3].labels
    assert licenses.scan(docs(spark, [])).collect() == []
    assert len(licenses.rules()) > 200


@pytest.mark.parametrize("text, labels", [
    ("GPLv2", "gpl-2"), ("GPL-3.0", "gpl-3"), ("GPL 2.0 only", "gpl-2"), ("LGPL", "lgpl"), ("AGPL", "agpl"), ("LGPLv2.1", "lgpl-2.1"), ("LGPL-2.0", "lgpl-2"),
    ("Apache-2.0", "apache-2"), ("BSD-3-Clause", "bsd-3"), ("MIT licensed", "mit"), ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND ISC", "gpl-2,isc,mit"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("mit isc zlib", ""),
    ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
])
def test_short_forms_of_licenses(text, labels):
    assert licenses.scan_text(text)[5] == labels


def test_suppression_against_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        spans = [(a := rnd.randrange(20), a + rnd.randrange(1, 8), rnd.choice([10, 20, 30]), i) for i in range(rnd.randrange(1, 12))]

        def beats(x, y):
            inside = x[0] <= y[0] and x[1] >= y[1] and x[2] >= y[2]
            same = x[:2] == y[:2] and x[2] == y[2]
            return x is not y and inside and (not same or x[3] < y[3])

        want = {s for s in spans if not any(beats(o, s) for o in spans)}
        assert set(licenses.suppress(spans)) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href=#>Home</a></ul></nav><div id="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>five &lt;six&gt;<!-- no --></p>
<div class="adBanner">Buy</div><blockquote>quote</blockquote><form><label>Mail</label><input></form>
<section id="comments"><article><p>First!</p></article></section><p hidden>no</p></article>
<aside>See also</aside><footer>(c)</footer></body></html>"""


def test_page_text(spark):
    page = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", None), (3, None, ""), (4, "http://b.com", "plain &amp; bare"),
            (5, "http://b.com/x", "<p>cut off <b>her"), (6, "x", "<p>a</p><script>never closed"), (7, "http://c.com", "1 < 2 and 3 > 2"), (1, "http://a.com/1", PAGE)]
    df = spark.createDataFrame(page, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit(1))
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    by = {r.page_id: r.text for r in rows}
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)
    assert by[1] == "A & B\n\nOne two three four\n\nfive <six>\n\nquote"
    assert [by[i] for i in range(2, 8)] == ["", "", "plain & bare", "cut off her", "a", "1 < 2 and 3 > 2"]
    assert html_text.extract(df.where("false")).collect() == []


def test_template_branches_go(spark):
    def page(i):
        return f"<body><div class=wrap><p class=lead>Welcome to us</p><div class=x><p>Body {i}</p></div><div class=y>Same box</div></div></body>"

    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(8)] + [(20 + i, "http://a.com/0", page(0)) for i in range(30)]
    rows += [(100 + i, f"http://few.com/{i}", page(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert by[3] == "Body 3" and by[25] == "Body 0" and by[101] == "Welcome to us\n\nBody 1\n\nSame box"


def test_copied_articles_stay(spark):
    page = "<body><article><h1>T</h1><p>Same text everywhere</p></article><footer>f</footer></body>"
    rows = [(i, f"http://a.com/{i}", page + f"<!-- {i} -->") for i in range(12)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"T\n\nSame text everywhere"}


def test_large_ids_beside_nulls_keep_their_digits(spark):
    big = 2**60 + 1
    d = docs(spark, [(big, "the dog"), (None, "a cat"), (big + 2, None)])
    pages = spark.createDataFrame([(big, "http://a.com", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, "the dog")], "item_id long, text string")
    for out in (langid.identify(d), licenses.scan(d), decontaminate.find(d, bench), toxicity.detect(d, spark.createDataFrame([], "doc_id long, toxic int"))):
        assert {r.doc_id for r in out.collect()} == {big, None, big + 2}
    assert {r.page_id for r in html_text.extract(pages).collect()} == {big, None}
