"""The site style tree: its entropies by brute force, what it removes and what class names may not remove."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tabloom.llm import common, html_text

PAGES = "page_id long, url string, html string"


def _article(i, rng):
    words = [f"w{rng.randrange(10_000)}" for _ in range(12)]
    return f"""<body><article><h1>Title {i}</h1><p>{' '.join(words)}</p>
        <div><ul><li>Read more on this site</li><li>Write to the editors</li></ul></div>
        <section><p>Section {i} of {words[0]}</p><table><tr><td>cell {i}</td><td>unit</td></tr></table></section>
        <div class="note">{'Subscribers read on' if i % 7 else f'Correction {i}'}</div>
        <blockquote>Quoted {words[1]} {i}</blockquote></article></body>"""


def test_template_in_plain_boxes_of_the_article_goes(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a.com/{i}", _article(i, rng)) for i in range(40)]
    rows += [(100 + i, f"http://b.com/{i}", rows[0][2]) for i in range(40)]  # one article only: no evidence
    by = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(40):
        assert "Read more" not in by[i] and "Write to the editors" not in by[i]
        assert f"Title {i}\n\n" in by[i] and f"Section {i} of" in by[i] and f"cell {i}" in by[i] and "Quoted" in by[i]
    assert by[100] == by[139] and "Read more on this site" in by[100]


def _places(pages, least):
    """Places of template by the definition, from parsed pages of one host."""
    seen = {}
    for blocks in pages:
        text = "\n".join(b[2] for b in blocks if b[6])
        seen.setdefault(text, blocks)
    m = len(seen)
    if m < html_text.MIN_PAGES:
        return set()
    contents, shapes = defaultdict(Counter), defaultdict(Counter)
    for blocks in seen.values():
        for path, parent, content in {(b[0], b[1], b[2]) for b in blocks}:
            contents[path, parent][content] += 1
        for parent in {b[1] for b in blocks}:
            shapes[parent][tuple(b[0] for b in blocks if b[1] == parent)] += 1
    out = set()
    for (path, parent), counts in contents.items():
        content = 1 - sum(map(math.log, counts.values())) / (len(counts) * math.log(m))
        total = sum(shapes[parent].values())
        shape = -sum(c / total * math.log(c / total) for c in shapes[parent].values()) / math.log(m)
        if sum(counts.values()) >= html_text.MIN_PAGES and content < html_text.CONTENT_LEAST and shape < html_text.SHAPE_LEAST:
            out.add(path)
    return out


def test_places_by_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for i in range(60):
        boxes = [f"<div><p>{rng.choice(['Same', 'Other'])} box</p></div>", f"<ul><li>{rng.choice('abc')}</li><li>x</li></ul>",
                 f"<section><p>text {rng.randrange(30)}</p></section>", "<div class=z>always</div>", f"<h2>{i}</h2>"]
        pages.append("<article>" + "".join(b for b in boxes if rng.random() < rng.choice([0.5, 0.95, 1.0])) + "</article>")
    pages += pages[:10]
    parsed = [[(*b[:3], b[3], b[4], b[5], not b[3] and b[4]) for b in html_text.parse(p)] for p in pages]
    want = _places(parsed, None)
    rows = spark.createDataFrame([(i, "a.com", p) for i, p in enumerate(pages)], "page_id long, host string, html string")
    found = common.map_texts(rows, ["page_id", "host"], "html", f"blocks {html_text._BLOCKS}, page long", html_text._parsed)
    got = {r.path for r in html_text.template_places(found).collect()}
    assert len(want) >= 2 and got == {html_text._hash(p) for p in want}


@pytest.mark.parametrize("name", [
    "social-science", "form-of-life", "alert-fatigue", "comment-on-law", "search-and-rescue", "related-works-chapter", "header-files-in-c",
    "article-header", "postHeader", "entry-content", "has-sidebar", "no-comments", "comments-open", "platform", "shadow", "sideboard", "x",
])
def test_names_of_content(name):
    assert not html_text.marked(name, False)


@pytest.mark.parametrize("name", [
    "ad", "adBanner", "ad-slot-3", "site-header", "main-nav", "footer", "page_footer", "post-comments", "comment-list", "sidebar-left",
    "cookie-notice", "related-posts", "share-buttons", "newsletter-signup", "site-header__nav", "entry-footer", "breadcrumbs",
])
def test_names_of_chrome(name):
    assert html_text.marked(name, False)


def test_names_do_not_take_article_text(spark):
    page = """<body><div class="content"><div class="article-header"><h1>Title</h1></div><div class="social-science">One</div>
        <p class="form-of-life">Two</p><div class="site-footer">foot</div><div class="social">share</div></div></body>"""
    out = html_text.extract(spark.createDataFrame([(1, "http://a.com", page)], PAGES)).first()
    assert out.text == "Title\n\nOne\n\nTwo"


def test_long_page(spark):
    page = "<article>" + "<p>word &amp; word</p>" * 20_000 + "<div>" * 3000 + "deep" + "</article>"
    out = html_text.extract(spark.createDataFrame([(1, "http://a.com", page), (2, None, None)], PAGES)).orderBy("page_id").collect()
    assert out[0].text.count("word & word") == 20_000 and out[0].text.endswith("deep") and out[1].text == ""
