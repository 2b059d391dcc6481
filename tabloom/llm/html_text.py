"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of element styles (tag, class, id and role on the way down from the
root). Two entropies tell how much a place in the tree matters: of its presentations, that is the child sequences
its pages show there, and of its contents. A place that looks and reads the same on all pages of a host is
template, and its branch is left out of each page; what the page itself marks as menu, header, footer, sidebar, notice,
advert, form or comments never counts as text.

Pages with the same text count once in the tree, whatever stands around it, and unstyled paragraphs and headings that
stand straight in the page's own article are its content however often the article is published, so copies and quotations
are not mistaken for template. On all else in the article, its sections, lists, tables and boxes, the tree decides. Hosts with fewer than `MIN_PAGES` different pages give no evidence, and nothing is removed by the tree there.
"""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import common

MIN_PAGES = 5
_ROWS = 256
CONTENT_LEAST, SHAPE_LEAST = 0.3, 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table",
          "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head"}
_NEVER = {"head", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video",
          "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "label", "menu", "dialog",
          "search", "title", "fieldset", "noembed", "noframes", "xmp", "applet", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
          "menubar", "toolbar"}
# A class or id name marks its element if each of its words is one of these or merely says where or how, and one is of these.
_PURPOSES = set("""nav navbar navigation menu submenu topbar breadcrumb breadcrumbs header masthead footer foot colophon copyright
    sidebar side aside rail widget widgets related recommend recommended recommendation recommendations trending popular share
    sharing social follow ad ads adv advert adverts advertisement advertisements adsense banner promo promos promotion promotions
    sponsor sponsors sponsored commercial teaser cookie cookies consent gdpr notice notices notification notifications alert popup
    modal overlay newsletter subscribe subscription signup login search form comment comments commentlist disqus replies reply
    respond discussion pager pagination tags toolbar skip""".split())
_PLACES = set("""site main page top bottom left right upper lower global local mobile desktop primary secondary first last sticky
    fixed floating inner outer wrapper wrap container box block area section panel group row col column bar list item items link
    links button buttons icon icons slot unit zone label title more us me up down in on to the and by post posts article entry
    story blog content body text media web js ui id new meta info inline""".split())
_OWN_HEAD = {"article", "post", "entry", "story", "content", "body", "text"}
_ABOUT = re.compile(r"(?:has|with|without|no|is)[-_].*|comments?[-_](?:open|closed)", re.S)  # says what is beside it, not what it is
_CAMEL = re.compile(r"([a-z])([A-Z])")
_OWN = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_SPACE = re.compile(r"\s+")


def marked(name: str, inside: bool) -> bool:
    """Whether one class or id name says that its element is something other than content.

    A header of an article, by its name or because it stands inside one, holds the title and counts.
    """
    name = _CAMEL.sub(r"\1-\2", name).lower()
    if _ABOUT.fullmatch(name):
        return False
    words = {w for w in re.split(r"[^a-z]+", name) if len(w) > 1}
    purposes = words & _PURPOSES
    if purposes == {"header"} and (inside or words & _OWN_HEAD):
        return False
    return bool(purposes) and words <= _PURPOSES | _PLACES


def _style(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """The element's style and whether it is marked as something other than content.

    A header stands above the page, or inside an article above its text, where it holds the title and counts.
    """
    never = tag in _NEVER or tag == "header" and not inside
    if not attributes or attributes.isspace():
        return tag, never
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    name = " ".join(_SPACE.sub(" ", a[k]).strip() for k in ("class", "id") if a.get(k))
    role = a.get("role", "").strip().lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
        r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)
    chrome = never or role in _ROLES or bool(hidden)
    if name and tag not in ("html", "body", "main"):
        chrome = chrome or any(marked(n, inside) for n in name.split(" "))
    return f"{tag}.{name}#{role}" if name or role else tag, chrome


def parse(page: str | None) -> list[tuple[str, str, str, bool, bool, bool]]:
    """The text blocks of a page in order: (path, path of the parent, text, chrome, in the article, plain).

    References are decoded, white space runs are one blank, empty blocks are left out. A missing end tag is taken
    as set where the next block or the parent's end needs it.
    """
    page = page or ""
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, chrome, in the article, plain
    blocks: list[tuple[str, str, str, bool, bool, bool]] = []
    parts: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        if text:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _BLOCK:
                    break
            else:
                k = -1
            _, path, _, inside, plain = stack[k] if k >= 0 else ("", "", False, False, True)
            chrome = any(s[2] for s in stack)
            blocks.append((path, stack[k - 1][1] if k > 0 else "", text, chrome, inside, plain))

    at = 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if not match:
            parts.append(page[at:])
            break
        parts.append(page[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            if tag in _BLOCK or any(s[0] == tag and s[2] for s in stack):
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "body", "td", "th", "nav", "footer", "aside", "form") and tag not in _BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        style, chrome = _style(tag, match[3], bool(stack) and stack[-1][3])
        if tag in _BLOCK or chrome:
            flush()
        if tag in _BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                above = stack[k][0]
                if above == "p" or above == tag == "li" or above in ("dt", "dd") and tag in ("dt", "dd"):
                    del stack[k:]
                    break
                if above in _BLOCK:
                    break
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = len(page) if not end else end.start()
            if tag not in _NEVER:
                continue
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if tag in _VOID or match[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        up = stack[-1] if stack else ("", "", False, False, True)
        inside = up[3] or tag in ("article", "main")
        plain = tag in ("article", "main") or up[4] and tag not in _BLOCK or (
            up[0] in ("article", "main") and tag in _OWN and style == tag)
        path = f"{up[1]}/{style}" if tag in _BLOCK else up[1]
        stack.append((tag, path, chrome, inside, plain))
    flush()
    return blocks


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_BLOCKS = "array<struct<path: long, parent: long, content: long, fixed: boolean, text: string>>"


def _parsed(pages):
    out, articles = [], []
    for page in pages:
        found = parse(page)
        main = any(inside and not chrome for _, _, _, chrome, inside, _ in found)
        rows = []
        for path, parent, text, chrome, inside, plain in found:
            use = not chrome and (inside or not main)
            fixed = bool(use and inside and plain)
            rows.append((_hash(path), _hash(parent), _hash(text), fixed, text if use else None))
        out.append(rows)
        articles.append(_hash("\n".join(r[4] for r in rows if r[4] is not None)))
    return [out, articles]


def template_places(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path) of the places that are template, from a table (host, page, blocks).

    With m different pages, the content of a place matters by 1 - sum(log c) / (n log m), where its n contents stand
    on c pages each; its presentation by the entropy to base m of the child sequences of its parent. A place goes
    where both are small. Every sum is an aggregation by host and place, combined before the shuffle.
    """
    pages = parsed.where("host is not null").select("host", "page", F.arrays_zip(
        F.col("blocks.path").alias("path"), F.col("blocks.parent").alias("parent"), F.col("blocks.content").alias("content")).alias("b"))
    pages = common.staged(pages.dropDuplicates(["host", "page"]), "tree")
    m = pages.groupBy("host").count().where(F.col("count") >= min_pages).select(
        F.col("host").alias("h"), F.log("count").alias("log_m"))
    content = pages.select("host", F.explode(F.array_distinct("b")).alias("b")).groupBy(
        "host", "b.path", "b.parent", "b.content").count()
    content = content.groupBy("host", "path", "parent").agg(
        F.sum(F.log("count")).alias("sum_log"), F.count("*").alias("n"), F.sum("count").alias("seen"))
    shapes = pages.select("host", F.explode(F.array_distinct("b.parent")).alias("parent"), F.col("b").alias("all"))
    shapes = shapes.select("host", "parent", F.xxhash64(F.expr(
        "array_join(transform(filter(all, x -> x.parent = parent), x -> string(x.path)), ',')")).alias("shape"))
    shapes = shapes.groupBy("host", "parent", "shape").count().groupBy("host", "parent").agg(
        F.sum("count").alias("total"), F.sum(F.col("count") * F.log("count")).alias("weighted"))
    both = content.join(shapes, ["host", "parent"]).join(m, F.col("host") == F.col("h"))
    content_imp = 1 - F.col("sum_log") / (F.col("n") * F.col("log_m"))
    shape_imp = (F.log("total") - F.col("weighted") / F.col("total")) / F.col("log_m")
    often = F.col("seen") >= min_pages
    return both.where(often & (content_imp < CONTENT_LEAST) & (shape_imp < SHAPE_LEAST)).select("host", "path").distinct()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    The text is the page's blocks in order, joined by two line ends; empty for null, empty or textless html. Pages
    without a host are read on their own. Where a page has an article or main element, only blocks within count.
    Rows that repeat are read alike.
    """
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]+)", 1))
    key = F.xxhash64("url", "html")
    rows = pages.select("page_id", "url", F.when(host != "", host).alias("host"), key.alias("key"), "html")
    # blocks take more memory than html: a few pages at a time
    parsed = common.staged(common.map_texts(
        rows, ["page_id", "url", "host", "key"], "html", f"blocks {_BLOCKS}, page long", _parsed, _ROWS), "pages")
    places = common.staged(template_places(parsed), "template")
    loose = parsed.select("host", "key", F.explode(F.expr(
        "array_distinct(transform(filter(blocks, b -> b.text is not null and not b.fixed), b -> b.path))")).alias("path"))
    gone = loose.join(places, ["host", "path"]).groupBy("key").agg(F.collect_set("path").alias("gone"))
    gone = common.staged(gone, "gone")  # its size is known then, and few rows can go to every task
    # pages with nothing but their own article have nothing to lose and stay where they are
    may_lose = F.exists("blocks", lambda b: b["text"].isNotNull() & ~b["fixed"])
    some = parsed.where(may_lose).join(gone, "key", "left").select("page_id", "url", "blocks", "gone")
    rest = parsed.where(~may_lose).select("page_id", "url", "blocks", F.lit(None).cast("array<long>").alias("gone"))
    kept = F.expr("filter(blocks, b -> b.text is not null and (b.fixed or gone is null or not array_contains(gone, b.path)))")
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    out = some.unionByName(rest).select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
