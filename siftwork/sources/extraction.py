"""Articles from element trees: the selectors of a page's outlet first, then what pages have in common.

Title, body and date are each taken from the first place that gives enough, and the row says which place that was. What
became of each body selector is kept with the row, so that selectors that no longer fit a redesigned site show up in
health() and can be left out by usable().
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import dates, urls
from siftwork.functions.text import clean_extracted, clean_title, once
from siftwork.sources import elements as el
from siftwork.sources.staged import staged

LEAST_BODY, LEAST_TITLE, LEAST_PART, LEAST_PARAGRAPH = 100, 6, 11, 41
DEGRADED, SKIPPED = 3, 6
# JSON-LD types of articles, class names of bodies, and where pages keep their dates.
ARTICLE_TYPES = ("NewsArticle", "Article", "ReportageNewsArticle", "WebPage")
BODY_CLASSES = (
    "article-body", "article_body", "post-content", "entry-content", "news-body", "story-body", "news-content", "details-body",
    "dtl_content_block", "jw_article_body", "content-body", "news-details", "details-text", "details-txt",
)
DATE_METAS = (
    ("property", "article:published_time"), ("property", "og:article:published_time"), ("itemprop", "datePublished"), ("name", "publish_date"),
    ("name", "pubdate"), ("name", "dc.date.issued"),
)
KICKERS = ("h2", "h3", "h4")
KINDS = ("title_selectors", "body_selectors", "date_selectors")
_CHOICE = f"array<struct<selector:string,alternatives:array<array<{el.STEP}>>>>"


def compiled(outlets: DataFrame) -> DataFrame:
    """outlets (domain, place, and arrays title_selectors, body_selectors, date_selectors) with the selectors parsed.

    What is no selector matches nothing.
    """
    step = pa.struct([("how", pa.string()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attributes", pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())]))), ("place", pa.int32())])
    kind = pa.list_(pa.struct([("selector", pa.string()), ("alternatives", pa.list_(pa.list_(step)))]))

    def one(text: str) -> dict:
        try:
            return {"selector": text, "alternatives": el.selector(text)}
        except ValueError:
            return {"selector": text, "alternatives": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [pa.array([[one(s) for s in row or [] if s] for row in batch.column(k).to_pylist()], kind) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), batch.column("place"), *parsed], ["domain", "place", *KINDS])

    return outlets.select("domain", F.col("place").cast("int").alias("place"), *KINDS).mapInArrow(run, "domain string, place int, " + ", ".join(f"{k} {_CHOICE}" for k in KINDS))


def by_outlet(pages: DataFrame, outlets: DataFrame, url: str = "url") -> DataFrame:
    """pages with outlet (its domain) and its compiled selectors: the outlet of lowest place whose domain the host is or is below.

    Hosts are matched once each, by their suffixes, so that the pages themselves meet one row per host.
    """
    rows = pages.withColumn("_host", urls.host(F.col(url)))
    labels = F.split("_host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("_host").where("_host IS NOT NULL").distinct().select("_host", F.explode(suffix).alias("domain"))
    first = hosts.join(outlets.select("domain", "place"), "domain").groupBy("_host").agg(F.min(F.struct("place", "domain"))["domain"].alias("outlet"))
    known = first.join(outlets.drop("place").withColumnRenamed("domain", "outlet"), "outlet")
    return rows.join(known, "_host", "left").drop("_host").withColumns({k: F.coalesce(k, F.array().cast(_CHOICE)) for k in KINDS})


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _meta(*attributes: tuple[str, str]) -> Column:
    """The content of the page's first meta element with one of these attributes, in their order, null where that is empty."""
    metas = el.of_tag(F.col("elements"), "meta")
    return F.coalesce(*[_filled(_first(F.filter(metas, lambda e: e["attributes"][a] == v))["attributes"]["content"]) for a, v in attributes])


def _ld() -> Column:
    """The JSON-LD scripts of a page, in order, as variants; those that can't be read are left out."""
    scripts = F.filter(F.col("elements"), lambda e: (e["tag"] == "script") & (e["attributes"]["type"] == "application/ld+json"))
    return F.filter(F.transform(scripts, lambda e: F.try_parse_json(el.raw_text(e, F.col("texts")))), lambda v: v.isNotNull())


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _dated(v: Column) -> Column:
    """The items of a JSON-LD script that may carry a date: later ones first, each before its @graph (two levels deep)."""

    def opened(item: Column, levels: int) -> Column:
        graph = F.try_variant_get(item, "$['@graph']", "variant")
        if not levels:
            return F.array(item)
        return F.concat(F.array(item), F.when(graph.isNull(), F.array().cast("array<variant>")).otherwise(F.flatten(F.transform(F.reverse(_items(graph)), lambda x: opened(x, levels - 1)))))

    return F.flatten(F.transform(F.reverse(_items(v)), lambda item: opened(item, 2)))


def _body_of(e: Column) -> Column:
    """An element's paragraphs of enough characters, or, if it has none at all, its text line by line."""
    paragraphs = el.of_tag(el.inside(F.col("elements"), e), "p")
    texts = F.filter(F.transform(paragraphs, lambda p: el.text_of(p, F.col("texts"))), lambda t: F.length(t) >= LEAST_PART)
    return F.when(F.size(paragraphs) > 0, F.array_join(texts, "\n")).otherwise(el.text_of(e, F.col("texts"), "\n"))


def _selected_body() -> Column:
    """struct<body, tries>: what the first selector with enough text gives, and the outcome of each one tried: hit, short or none."""
    none = F.struct(F.lit(None).cast("string").alias("body"), F.array().cast("array<struct<selector:string,outcome:string>>").alias("tries"))

    def attempt(acc: Column, choice: Column) -> Column:
        found = el.selected(F.col("elements"), choice["alternatives"])
        text = once(found, lambda es: F.when(F.size(es) > 0, F.array_join(F.filter(F.transform(es, _body_of), lambda t: t != ""), "\n")))

        def judged(t: Column) -> Column:
            outcome = F.when(F.length(t) >= LEAST_BODY, "hit").when(t.isNull(), "none").otherwise("short")
            return F.struct(F.when(F.length(t) >= LEAST_BODY, t).alias("body"), F.array_append(acc["tries"], F.struct(choice["selector"].alias("selector"), outcome.alias("outcome"))).alias("tries"))

        return F.when(acc["body"].isNotNull(), acc).otherwise(once(text, judged))

    return F.aggregate("body_selectors", none, attempt)


def _heuristic_body() -> Column:
    """A body without any selector's success: selectors however short, the article element, body classes, long paragraphs."""
    elements, texts = F.filter(F.col("elements"), lambda e: ~e["furniture"]), F.col("texts")
    plain = lambda e: el.text_of(e, texts, "\n", furniture=False)
    joined = lambda es: F.array_join(F.filter(F.transform(es, plain), lambda t: t != ""), "\n")
    by_selector = F.transform("body_selectors", lambda c: joined(F.filter(el.selected(F.col("elements"), c["alternatives"]), lambda e: ~e["furniture"])))
    longest = F.aggregate(by_selector, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    article = plain(_first(el.of_tag(elements, "article")))
    boxes = el.of_tag(elements, "div", "section")
    by_class = _first(F.filter(F.transform(F.array(*map(F.lit, BODY_CLASSES)), lambda c: F.filter(boxes, lambda e: F.array_contains(e["classes"], c))), lambda es: F.size(es) > 0))
    paragraphs = F.array_join(F.filter(F.transform(el.of_tag(elements, "p"), lambda e: el.text_of(e, texts, furniture=False)), lambda t: F.length(t) >= LEAST_PARAGRAPH), "\n")
    enough = lambda t: F.length(t) >= LEAST_BODY

    def classes(t: Column) -> Column:
        return once(joined(by_class), lambda c: F.when(F.length(c) > F.length(t), c).otherwise(t))

    def then(t: Column, more: Column) -> Column:
        return once(t, lambda known: F.when(enough(known), known).otherwise(more if more is not None else known))

    one = once(longest, lambda t: F.when(enough(t), t).otherwise(F.coalesce(article, t)))
    two = once(one, lambda t: F.when(enough(t), t).otherwise(F.coalesce(classes(t), t)))
    return _filled(then(two, paragraphs))


def _date() -> Column:
    """struct<label, date> of the first place whose date can be read."""
    elements, texts = F.col("elements"), F.col("texts")
    shown = lambda e: F.coalesce(_filled(e["attributes"]["datetime"]), el.text_of(e, texts))
    place = lambda label, raw: F.struct(label.alias("label"), raw.alias("raw"))
    by_selector = F.transform("date_selectors", lambda c: place(F.left(F.concat(F.lit("selector:"), c["selector"]), F.lit(80)), shown(_first(el.selected(elements, c["alternatives"])))))
    by_ld = F.transform(F.flatten(F.transform("_ld", _dated)), lambda i: place(F.lit("json_ld.datePublished"), _string(i, "$.datePublished")))
    by_meta = F.array(*[place(F.lit(f"meta.{v}" if a != "itemprop" else f"meta.itemprop.{v}"), _meta((a, v))) for a, v in DATE_METAS])
    by_time = F.transform(F.slice(F.filter(elements, lambda e: (e["tag"] == "time") & (e["attributes"]["itemprop"] == "datePublished")), 1, 1), lambda e: place(F.lit("time.itemprop.datePublished"), shown(e)))
    read = F.transform(F.concat(by_selector, by_ld, by_meta, by_time), lambda p: F.struct(p["label"].alias("label"), dates.publication(p["raw"]).alias("date")))
    return _first(F.filter(read, lambda p: p["date"].isNotNull()))


def headlines(elements: Column, texts: Column, title: Column) -> Column:
    """A headline's other forms: the heading (h2 to h4) right before or after its h1, of 8 to 200 characters and without a link,
    alone and joined with the title."""
    tops = el.of_tag(elements, "h1")
    h1 = F.coalesce(_first(F.filter(tops, lambda e: el.one_line(e, texts) == title)), _first(tops))

    def forms(top: Column) -> Column:
        before = F.when(top["before"] >= 0, F.get(elements, F.greatest(top["before"], F.lit(0))))
        after = F.get(elements, top["last"] + 1)

        def line(e: Column) -> Column:
            known = once(clean_title(el.one_line(e, texts)), lambda t: F.when(F.length(t).between(8, 200) & (t != title), t))
            return F.when(e["tag"].isin(*KICKERS) & (e["parent"] == top["parent"]) & (F.size(el.of_tag(el.inside(elements, e), "a")) == 0), known)

        return once(F.struct(line(before).alias("b"), line(after).alias("a")), lambda x: F.array_compact(F.array(x["b"], F.concat(x["b"], F.lit(" "), title), x["a"], F.concat(title, F.lit(" "), x["a"]))))

    return F.when(h1.isNotNull() & title.isNotNull(), once(h1, forms)).otherwise(F.array().cast("array<string>"))


def articles(pages: DataFrame, outlets: DataFrame, url: str = "url", html: str = "html", snippet: Column | None = None) -> DataFrame:
    """pages with outlet, title, headlines, body, author, extraction_method, published (as dates.publication), date_source and tries.

    outlets: domain, place and arrays of selectors, as for compiled(). Bodies of fewer than LEAST_BODY characters are null,
    and so is everything of null and empty pages; snippet stands in for a missing title.
    """
    kept = pages.columns
    rows = el.tree(by_outlet(pages, compiled(outlets), url), html).withColumn("_ld", _ld())
    chosen = _first(F.filter(F.transform("title_selectors", lambda c: el.text_of(_first(el.selected(F.col("elements"), c["alternatives"])), F.col("texts"))), lambda t: F.length(t) >= LEAST_TITLE))
    stories = F.filter(F.flatten(F.transform("_ld", _items)), lambda i: _string(i, "$['@type']").isin(*ARTICLE_TYPES) & (F.length(_string(i, "$.articleBody")) >= LEAST_BODY))
    name = lambda i: F.coalesce(_string(i, "$.author.name"), _string(i, "$.author[0].name"))
    story = _first(F.transform(stories, lambda i: F.struct(_string(i, "$.articleBody").alias("body"), _string(i, "$.headline").alias("headline"), name(i).alias("author"))))
    texts = F.col("texts")
    first_text = lambda tag: _filled(el.text_of(_first(el.of_tag(F.col("elements"), tag)), texts))
    rows = rows.withColumns({"_own": _selected_body(), "_title": chosen, "_story": story, "_at": _date()})
    rows = rows.withColumn("_guess", F.when(F.col("_own.body").isNull() & F.col("_story").isNull(), _heuristic_body()))
    about = _meta(("property", "og:description"), ("name", "og:description"), ("property", "description"), ("name", "description"))
    body, method = F.coalesce("_own.body", "_story.body", "_guess"), F.when(F.col("_own.body").isNotNull(), "SOURCE_SPECIFIC").when(F.col("_story").isNotNull(), "JSON_LD").otherwise("BEAUTIFULSOUP")
    short = F.coalesce(F.length(body) < LEAST_BODY, F.lit(True)) & F.coalesce(F.length(about) > LEAST_BODY, F.lit(False))
    guessed = F.coalesce(_meta(("property", "og:title")), first_text("h1"), first_text("title"))
    named = _meta(("property", "og:title"), ("name", "og:title"), ("property", "twitter:title"), ("name", "twitter:title"))
    heuristic = F.col("_guess").isNotNull()
    title = F.coalesce("_title", F.when(F.col("_own.body").isNull(), F.col("_story.headline")), F.when(heuristic, guessed), named, first_text("title"))
    author = F.coalesce(F.when(F.col("_own.body").isNull(), F.col("_story.author")), F.when(heuristic, _meta(("name", "author"))))
    rows = rows.withColumns({"_body": F.when(short, about).otherwise(body), "extraction_method": F.when(short, "OPENGRAPH").otherwise(method), "_title": clean_title(title), "author": author})
    usable = F.when(~F.lower(F.trim("_title")).isin("", "google news"), F.col("_title"))
    rows = rows.withColumn("title", F.coalesce(usable, snippet if snippet is not None else F.lit(None).cast("string")))
    rows = rows.withColumns({"headlines": headlines(F.col("elements"), texts, F.col("title")), "body": clean_extracted(F.col("_body"), LEAST_BODY)})
    out = [c for c in kept if c not in ("title", "headlines", "body", "author", "extraction_method", "published", "date_source", "tries", "outlet")]
    return rows.select(*out, "outlet", "title", "headlines", "body", "author", "extraction_method", F.col("_at.date").alias("published"), F.col("_at.label").alias("date_source"), F.col("_own.tries").alias("tries"))


def health(rows: DataFrame, order: str) -> DataFrame:
    """Of articles() rows, per outlet and body selector: asked, hits, none, short, misses (since the last hit, by order), degraded.

    A selector is asked where those before it gave too little. Outlets may be of any size: rows are counted before the shuffle.
    Tries are staged, as they are counted twice: pages are parsed once.
    """
    tried = rows.where("outlet IS NOT NULL").select("outlet", F.col(order).alias("_at"), F.explode("tries").alias("t")).select("outlet", "_at", "t.*")
    tried = staged(tried, "tries")
    keys = ["outlet", "selector"]
    counts = tried.groupBy(*keys).agg(F.count("*").alias("asked"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("hit", "none", "short")], F.max(F.when(F.col("outcome") == "hit", F.col("_at"))).alias("_last"))
    late = tried.join(counts.select(*keys, "_last"), keys).where("_last IS NULL OR _at > _last").groupBy(*keys).agg(F.count("*").alias("misses"))
    out = counts.join(late, keys, "left").withColumn("misses", F.coalesce("misses", F.lit(0)))
    return out.select(*keys, "asked", F.col("hit").alias("hits"), "none", "short", "misses", (F.col("misses") >= DEGRADED).alias("degraded"))


def usable(outlets: DataFrame, report: DataFrame) -> DataFrame:
    """outlets without the body selectors that have missed SKIPPED times in a row, for the next run."""
    gone = report.where(F.col("misses") >= SKIPPED).groupBy(F.col("outlet").alias("domain")).agg(F.collect_set("selector").alias("_gone"))
    left = F.array_except("body_selectors", F.coalesce("_gone", F.array().cast("array<string>")))
    return outlets.join(gone, "domain", "left").withColumn("body_selectors", left).drop("_gone")
