"""Element trees and selectors against trees built beside their HTML, and articles by value."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.sources import elements as el
from siftwork.sources import extraction as ex

TAGS = ["div", "p", "span", "b", "ul", "section", "a", "h2", "br"]
CLASSES = ["x", "y", "news-body", "é"]


def grown(r, depth=0):
    """A random element: (tag, attributes, children); children are elements or texts. p holds no blocks."""
    tag = r.choice(TAGS)
    attrs = {}
    if r.random() < 0.5:
        attrs["class"] = " ".join(r.choices(CLASSES, k=r.randint(1, 2)))
    if r.random() < 0.2:
        attrs["id"] = f"i{r.randint(0, 5)}"
    if r.random() < 0.2:
        attrs["data-k"] = r.choice(["one", "one two", "en-GB", ""])
    if tag == "br":
        return tag, attrs, []
    children = []
    for _ in range(r.randint(0, 4) if depth < 6 else 0):
        if r.random() < 0.4:
            if not children or isinstance(children[-1], tuple):
                children.append(r.choice(["some text", " ", "a < b & c", "\n tail "]))
            continue
        if tag == "ul":
            children.append(("li", {}, [grown(r, depth + 2)] if r.random() < 0.5 else ["item"]))
        else:
            children.append(grown(r, depth + 1))
    return tag, attrs, children


BLOCKS = {"div", "p", "ul", "section", "h2"}


def inline(node):
    """Whether nothing within would end a paragraph."""
    return isinstance(node, str) or node[0] not in BLOCKS and all(map(inline, node[2]))


def legal(node):
    """The tree as HTML can have it: blocks within p, and links within links, become spans."""
    if isinstance(node, str):
        return node
    tag, attrs, children = node
    if tag == "p" and not all(map(inline, children)):
        tag = "section"
    return tag, attrs, [legal(c) for c in children]


def written(node, r, last=True, follower=None, above=()):
    """HTML of a tree, closing tags left out where the next tag or the parent's end implies them."""
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, attrs, children = node
    head = "<" + tag + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">"
    if tag == "br":
        return head
    body = "".join(written(c, r, i == len(children) - 1, children[i + 1] if i + 1 < len(children) else None, (*above, tag)) for i, c in enumerate(children))
    after = follower[0] if isinstance(follower, tuple) else None
    implied = last and tag not in above or tag == "p" and after in BLOCKS or tag == "li" and after == "li"
    # An element whose end its parent's end tag implies; a later sibling's tag implies it for p and li only.
    return head + body + ("" if implied and r.random() < 0.5 else f"</{tag}>")


def flat(node, above=(), out=None, siblings=None):
    """Rows (tag, attributes, path, place, previous sibling, node) in document order."""
    out = [] if out is None else out
    at = len(out)
    row = {"at": at, "tag": node[0], "attrs": node[1], "above": list(above), "place": siblings[0] if siblings else 0, "before": siblings[1] if siblings else -1}
    out.append(row)
    if siblings:
        siblings[:] = siblings[0] + 1, at
    own = [0, -1]
    for c in node[2]:
        if isinstance(c, tuple):
            flat(c, (*above, at), out, own)
    row["last"] = len(out) - 1
    return out


def pages(n, seed):
    r = random.Random(seed)
    trees = [legal(("body", {}, [grown(r) for _ in range(r.randint(1, 5))])) for _ in range(n)]
    return [flat(t) for t in trees], ["".join(written(t, r)) + "</body>" for t in trees]


def test_trees_as_built():
    for rows, html in zip(*pages(400, 1)):
        found, _ = el.parsed(html)
        assert [(e["tag"], e["last"], e["above"], e["place"], e["before"]) for e in found] == [(x["tag"], x["last"], x["above"], x["place"], x["before"]) for x in rows], html


def fits(row, step):
    value = {k.lower(): v for k, v in row["attrs"].items()}
    tests = {"": lambda v, w: True, "=": lambda v, w: v == w, "~=": lambda v, w: w in v.split(), "|=": lambda v, w: v == w or v.startswith(w + "-"), "^=": lambda v, w: w != "" and v.startswith(w), "$=": lambda v, w: w != "" and v.endswith(w), "*=": lambda v, w: w != "" and w in v}
    return (
        step["tag"] in (None, row["tag"])
        and step["id"] in (None, value.get("id"))
        and set(step["classes"]) <= set(value.get("class", "").split())
        and all(a["name"] in value and tests[a["op"]](value[a["name"]], a["value"]) for a in step["attributes"])
        and step["place"] in (None, row["place"])
    )


def matches(rows, row, steps):
    """Right to left, all ways tried."""
    if not fits(row, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    parent = row["above"][-1] if row["above"] else -1
    siblings = [x for x in rows[: row["at"]] if (x["above"][-1] if x["above"] else -1) == parent]
    before = {" ": [rows[i] for i in row["above"]], ">": [rows[parent]] if parent >= 0 else [], "+": siblings[-1:], "~": siblings}[steps[-1]["how"]]
    return any(matches(rows, x, steps[:-1]) for x in before)


SELECTORS = [
    "div p", "div > p", ".x.y", "p + span", "h2 ~ p", "#i1", "[data-k]", "[data-k='one']", "[data-k~=two]", "[data-k|=en]", '[class^="news"]', "[class$=y]", "[class*=ws]",
    "li:first-child", "ul li:nth-child(2)", "div, span b, .é", "*", "body > * > *", "section > .x ~ p b", "div div div", "a+a", "[data-k*='']",
]


@pytest.fixture(scope="module")
def random_pages(spark):
    rows, html = pages(60, 2)
    return rows, el.tree(spark.createDataFrame(list(enumerate(html)), "i int, html string").repartition(4)).cache()


@pytest.mark.parametrize("text", SELECTORS)
def test_selectors(random_pages, text):
    rows, trees = random_pages
    parsed = el.selector(text)
    literal = F.from_json(F.lit(json.dumps(parsed)), f"array<array<{el.STEP}>>")
    found = {r["i"]: r["at"] for r in trees.select("i", F.transform(el.selected(F.col("elements"), literal), lambda e: e["at"]).alias("at")).collect()}
    want = [[x["at"] for x in page if any(matches(page, x, steps) for steps in parsed)] for page in rows]
    assert [found[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("text", ["", " ", "a >", "> a", "a,,b", "a[", "a:hover", ".", "a ! b"])
def test_no_selectors(text):
    with pytest.raises(ValueError):
        el.selector(text)


def test_broken_pages():
    for html in (None, "", "<", "<p", "</p>", "<![x", "text only", "<b><i></b></i>", "<td>1<td>2", "<div " * 50, "<!-- open", "<script>if (a < b) {", "&nbsp", "\0<p>\0"):
        elements, texts = el.parsed(html)
        assert all(e["at"] <= e["last"] < len(elements) and e["first"] <= e["stop"] <= len(texts) for e in elements)
    deep, _ = el.parsed("<div>" * 3000 + "x")
    assert len(deep) == 3000 and max(len(e["above"]) for e in deep) == el.DEEPEST - 1
    tags = [e["tag"] for e in el.parsed("<table><tr><td><p>a</table><ul><li>a<li><ul><li>b</ul><li>c</ul>")[0]]
    assert tags == ["table", "tr", "td", "p", "ul", "li", "li", "ul", "li", "li"]


LONG, OTHER = "A long enough sentence about the matter at hand. " * 3, "Another text, which is no part of the story as such. " * 3
OUTLET = [("paper.example", 2, ["h1.top", "h1"], ["div.story", "div.body p", "!"], [".when", "time"]), ("deep.paper.example", 1, [], ["#main"], []), ("none.example", 3, None, None, None)]
LD = '<script type="application/ld+json">%s</script>'


@pytest.fixture(scope="module")
def outlets(spark):
    return spark.createDataFrame(OUTLET, "domain string, place int, title_selectors array<string>, body_selectors array<string>, date_selectors array<string>")


def read(spark, outlets, pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "i long, url string, html string")
    return ex.articles(rows, outlets).orderBy("i").collect()


def test_outlet_of_a_page(spark, outlets):
    hosts = ["https://www.paper.example/a", "http://m.paper.example:80/", "https://x.deep.paper.example", "paper.example.org", "otherpaper.example", None, "not a url", "https://none.example/1"]
    rows = read(spark, outlets, [(h, "<p>x") for h in hosts])
    assert [r["outlet"] for r in rows] == ["paper.example", "paper.example", "deep.paper.example", None, None, None, None, "none.example"]


def test_bodies(spark, outlets):
    at = "https://paper.example/1"
    ld = json.dumps([{"@type": "Other", "articleBody": OTHER}, {"@type": "NewsArticle", "articleBody": LONG.strip(), "headline": "From data", "author": [{"name": "A. Writer"}]}])
    cases = [
        # Nested boxes: paragraphs of the box, those of ten characters and fewer left out; the title by its selector.
        (at, f"<h1>Other title</h1><h1 class=top>Chosen <i>title</i></h1><div class=story><div><p>{LONG}<p>too short<ul><li>no paragraph</ul></div></div>", "Chosentitle", LONG.strip(), "SOURCE_SPECIFIC", ["div.story hit"]),
        # A box without paragraphs gives its lines, scripts left out.
        (at, f"<title>Longer title</title><h1 class=top>ab</h1><h1>No first one</h1><div class=story>{LONG}<br>and a second line<script>no()</script></div>", "Longer title", LONG.strip() + "\nand a second line", "SOURCE_SPECIFIC", ["div.story hit"]),
        # The first selector finds too little, the second enough.
        (at, f"<div class=story>short</div><div class=body><p>{LONG}</p></div>", None, LONG.strip(), "SOURCE_SPECIFIC", ["div.story short", "div.body p hit"]),
        (at, LD % ld + "<title>Page</title>", "From data", LONG.strip(), "JSON_LD", ["div.story none", "div.body p none", "! none"]),
        ("https://elsewhere.example", LD % "{broken" + LD % ld, "From data", LONG.strip(), "JSON_LD", []),
        # No selector, no data: the article element without menus and asides.
        ("https://elsewhere.example", f"<nav><p>{OTHER}</nav><article><header>{OTHER}</header>{LONG}<aside>{OTHER}</aside></article><h1>Heading of it</h1>", "Heading of it", LONG.strip(), "BEAUTIFULSOUP", []),
        ("https://elsewhere.example", f"<article>small</article><div class='a story-body b'>{LONG}</div><div class=news-content>{OTHER}</div>", None, LONG.strip(), "BEAUTIFULSOUP", []),
        ("https://elsewhere.example", f"<p>{LONG}<p>too short to be a paragraph<p>{OTHER}<footer><p>{OTHER}</footer>", None, f"{LONG.strip()}\n{OTHER.strip()}", "BEAUTIFULSOUP", []),
        # What the page says of itself, if that is long enough.
        ("https://elsewhere.example", f"<meta content='{LONG}' property=og:description><meta name=twitter:title content=Named><p>x", "Named", LONG.strip(), "OPENGRAPH", []),
        ("https://elsewhere.example", "<meta content='short' property=og:description><title> Only a title </title>", "Only a title", None, "BEAUTIFULSOUP", []),
        ("https://elsewhere.example", None, None, None, "BEAUTIFULSOUP", []),
    ]
    rows = read(spark, outlets, [c[:2] for c in cases])
    for row, (_, _, title, body, method, tries) in zip(rows, cases):
        assert (row["title"], row["body"], row["extraction_method"], [f"{t['selector']} {t['outcome']}" for t in row["tries"]]) == (title, body, method, tries)
    assert rows[3]["author"] == rows[4]["author"] == "A. Writer"


def test_dates(spark, outlets):
    at, graph = "https://paper.example/1", json.dumps({"@graph": [{"datePublished": "2024-01-02"}, {"datePublished": "2024-01-03"}, {"x": 1}]})
    meta = "<meta {}='{}' content='{}'>"
    cases = [
        (at, "<p class=when>unreadable</p><time datetime='2024-05-06T10:00:00+06:00'>May</time>", "2024-05-06", "selector:time"),
        (at, "<p class=when><b>৬ মে ২০২৪</b></p>", "2024-05-06", "selector:.when"),
        ("x.example", LD % graph, "2024-01-03", "json_ld.datePublished"),
        ("x.example", LD % "oops" + LD % '[{"datePublished": "2024-01-04"}, {"datePublished": "soon"}]', "2024-01-04", "json_ld.datePublished"),
        ("x.example", LD % '{"@graph": {"@graph": [{"datePublished": "2024-01-05"}]}}', "2024-01-05", "json_ld.datePublished"),
        ("x.example", meta.format("name", "pubdate", "2024-02-01") + meta.format("property", "article:published_time", "2024-02-02"), "2024-02-02", "meta.article:published_time"),
        ("x.example", meta.format("itemprop", "datePublished", "2024-02-03"), "2024-02-03", "meta.itemprop.datePublished"),
        ("x.example", meta.format("name", "dc.date.issued", "2024-02-04") + meta.format("name", "publish_date", "never"), "2024-02-04", "meta.dc.date.issued"),
        ("x.example", "<time datetime=2023-01-01></time><time itemprop=datePublished>2 March 2024</time>", "2024-03-02", "time.itemprop.datePublished"),
        ("x.example", "<time datetime=2023-01-01></time>", None, None),
    ]
    for row, (_, _, day, label) in zip(read(spark, outlets, [c[:2] for c in cases]), cases):
        assert (str(row["published"]["local_date"]) if row["published"] else None, row["date_source"]) == (day, label)


def test_headlines(spark, outlets):
    top = "<meta property=og:title content='The title itself'>"
    cases = [
        (f"{top}<h1>Wrong one</h1><div><h3>A line before it</h3><h1>The title itself</h1><h2>A line after it</h2></div>", ["A line before it", "A line before it The title itself", "A line after it", "The title itself A line after it"]),
        (f"{top}<h3>No sibling of it</h3><div><h1>The title itself</h1></div><h2>No sibling either</h2>", []),
        (f"{top}<h2><a href=x>A line with a link</a></h2><h1>The title itself</h1><p>No heading, this</p>", []),
        (f"{top}<h2>short</h2><h1>The title itself</h1><h4>The title itself</h4>", []),
        ("<p>nothing here", []),
    ]
    rows = read(spark, outlets, [("x.example", f"{h}<p>{LONG}") for h, _ in cases])
    assert [r["headlines"] for r in rows] == [want for _, want in cases]


def test_health(spark, outlets):
    good, bad = f"<div class=story>{LONG}</div>", "<div class=story>small</div>"
    rows = spark.createDataFrame([(i, "https://paper.example", h) for i, h in enumerate([bad, good, bad, "<p>", bad, good])] + [(i, "https://deep.paper.example", "<p>") for i in range(10, 17)], "i long, url string, html string")
    out = ex.articles(rows.repartition(3), outlets)
    report = ex.health(out, "i")
    found = {(r["outlet"], r["selector"]): tuple(r)[2:] for r in report.collect()}
    assert found == {
        ("paper.example", "div.story"): (6, 2, 1, 3, 0, False),
        ("paper.example", "div.body p"): (4, 0, 4, 0, 4, True),
        ("paper.example", "!"): (4, 0, 4, 0, 4, True),
        ("deep.paper.example", "#main"): (7, 0, 7, 0, 7, True),
    }
    left = {r["domain"]: r["body_selectors"] for r in ex.usable(outlets, report).collect()}
    assert left == {"paper.example": ["div.story", "div.body p", "!"], "deep.paper.example": [], "none.example": None}


def test_health_counts_an_entity_as_one_character(spark, outlets):
    body = lambda n: f"<div class=story>say &quot;{'a' * (n - 5)}</div>"
    rows = spark.createDataFrame([(i, "https://paper.example", body(n)) for i, n in enumerate((ex.LEAST_BODY - 1, ex.LEAST_BODY))], "i long, url string, html string")
    report = ex.health(ex.articles(rows, outlets), "i")
    assert {(r["hits"], r["none"], r["short"]) for r in report.where("selector = 'div.story'").collect()} == {(1, 0, 1)}


def test_health_parses_pages_once(spark, outlets, monkeypatch):
    seen, tree = spark.sparkContext.accumulator(0), el.tree

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, "https://paper.example", f"<div class=story>{LONG}</div>") for i in range(12)], "i long, url string, html string")
    monkeypatch.setattr(el, "tree", lambda pages, html: (t := tree(pages, html)).mapInArrow(counted, t.schema))
    report = ex.health(ex.articles(rows, outlets), "i")
    assert [tuple(r)[:4] for r in report.collect()] == [("paper.example", "div.story", 12, 12)]
    assert seen.value == 12


def test_portions(monkeypatch):
    monkeypatch.setattr(el, "PAGES_BYTES", 100)
    html = ["x" * n for n in (40, 60, 1, 500, 0)] + [None] + ["y"] * 150
    batch = pa.record_batch({"i": list(range(len(html))), "html": html, "m": [[{"a": str(i)}] for i in range(len(html))]})
    parts = list(el.portions(batch, "html"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in parts[:3]] == [2, 1, 1] and max(p.num_rows for p in parts) == el.PAGES
    assert all(p.num_rows == 1 or sum(len(h or "") for h in p.column("html").to_pylist()) <= 100 for p in parts)
    assert max(p.get_total_buffer_size() for p in parts[:2]) < batch.get_total_buffer_size() / 4  # copies
    assert list(el.portions(batch.slice(0, 0), "html")) == []
