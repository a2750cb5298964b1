"""Pages as trees of elements, and CSS selectors on them.

tree() parses each page once. An element's number is its place in document order; `last` is the number of the last element
inside it and texts `first` to `stop` are the text in it, so that what an element holds is a slice of the page's arrays.
Selectors are rows of steps, so that each page can have those of its own outlet; they are matched by array functions, a
flag per element and step, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import collapse

#: Elements further down are taken as children at this depth, as browsers do.
DEEPEST = 512
#: Trees are made of so many pages at a time, and of so many bytes of them unless one alone has more.
PAGES, PAGES_BYTES = 64, 1 << 20
# Fixed values of HTML: elements without content, start tags that end an open paragraph, and which open elements a start
# tag ends, up to which others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: End tags don't reach through these, nor does a block end a paragraph outside them.
WALLS = frozenset({"td", "th", "caption", "button", "object"})
HIDDEN = frozenset({"script", "style", "template"})
FURNITURE = frozenset({"nav", "header", "footer", "aside", "script", "style", "noscript"})

ELEMENT = "struct<at:int,last:int,parent:int,before:int,place:int,tag:string,id:string,classes:array<string>,attributes:map<string,string>,above:array<int>,first:int,stop:int,furniture:boolean>"
TEXT = "struct<text:string,hidden:boolean,furniture:boolean>"
STEP = "struct<how:string,tag:string,id:string,classes:array<string>,attributes:array<struct<name:string,op:string,value:string>>,place:int>"


class _Page(HTMLParser):
    """Elements and texts of one page, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[dict] = []
        self.open: list[dict] = []
        self.children: list[list[int]] = [[0, -1]]  # of the page and of each open element: how many so far, and the last one

    def _close(self, down_to: int) -> None:
        for e in self.open[down_to:]:
            e["last"], e["stop"] = len(self.elements) - 1, len(self.texts)
        del self.open[down_to:], self.children[down_to + 1 :]

    def _end(self, names, walls) -> None:
        """Close the outermost open element of these names that no wall holds."""
        found = None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i]["tag"]
            if tag in walls:
                break
            if tag in names:
                found = i
        if found is not None:
            self._close(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end({"p"}, WALLS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if len(self.open) >= DEEPEST:
            self._close(DEEPEST - 1)
        given = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        above, siblings = self.open[-1] if self.open else None, self.children[-1]
        at = len(self.elements)
        e = {"at": at, "last": at, "parent": above["at"] if above else -1, "before": siblings[1], "place": siblings[0], "tag": tag, "id": given.get("id"), "classes": given.get("class", "").split()}
        e |= {"attributes": list(given.items()), "above": [*above["above"], above["at"]] if above else [], "first": len(self.texts), "stop": len(self.texts)}
        e["furniture"] = tag in FURNITURE or bool(above and above["furniture"])
        siblings[:] = siblings[0] + 1, at
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.children.append([0, -1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a closing slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                return self._close(i)
            if self.open[i]["tag"] in WALLS and tag not in ENDS and tag != "table":
                return

    def handle_data(self, data: str) -> None:
        e = self.open[-1] if self.open else {"tag": "", "furniture": False}
        self.texts.append({"text": data, "hidden": e["tag"] in HIDDEN, "furniture": e["furniture"]})


def parsed(html: str | None) -> tuple[list[dict], list[dict]]:
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # a declaration that the parser gives up on; what came before it stands
        pass
    page._close(0)
    return page.elements, page.texts


_KINDS = [
    pa.list_(pa.struct([("at", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("before", pa.int32()), ("place", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("above", pa.list_(pa.int32())), ("first", pa.int32()), ("stop", pa.int32()), ("furniture", pa.bool_())])),
    pa.list_(pa.struct([("text", pa.string()), ("hidden", pa.bool_()), ("furniture", pa.bool_())])),
]


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in portions of PAGES rows and PAGES_BYTES of a column at most, one row at least; copied, so that none keeps the batch."""
    rows, held = [], 0
    for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if rows and (len(rows) == PAGES or held + (size or 0) > PAGES_BYTES):
            yield batch.take(pa.array(rows))
            rows, held = [], 0
        rows.append(at)
        held += size or 0
    if rows:
        yield batch.take(pa.array(rows))


def tree(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with elements and texts, parsed from html; null and empty pages have none of either."""
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, html):
                both = [parsed(h) for h in some.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array([b[i] for b in both], _KINDS[i]) for i in (0, 1))], [*names, "elements", "texts"])
            del batch  # before the next one is read

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in pages.dtypes), f"elements array<{ELEMENT}>", f"texts array<{TEXT}>"]))


_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_PART = re.compile(rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\s\]]+))\s*)?\]|:(?P<pseudo>first-child|nth-child\((?P<nth>\d+)\))")
_BETWEEN = re.compile(r"\s*([>+~,])\s*|\s+")


def selector(text: str) -> list[list[dict]]:
    """The alternatives of a CSS selector, each a list of steps; ValueError for what it doesn't know.

    Tags, *, ids, classes, attributes with all six operators, :first-child, :nth-child(n), the four combinators and commas.
    """
    out, steps, how, at, text = [], [], "", 0, text.strip()
    while at < len(text):
        step = {"how": how, "tag": None, "id": None, "classes": [], "attributes": [], "place": None}
        began = at
        while m := _PART.match(text, at):
            if m["tag"] and at > began:
                break
            at = m.end()
            if m["tag"] and m["tag"] != "*":
                step["tag"] = m["tag"].lower()
            elif m["id"]:
                step["id"] = m["id"]
            elif m["cls"]:
                step["classes"].append(m["cls"])
            elif m["attr"]:
                step["attributes"].append({"name": m["attr"].lower(), "op": m["op"] or "", "value": next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")})
            elif m["pseudo"]:
                step["place"] = int(m["nth"]) - 1 if m["nth"] else 0
        if at == began:
            raise ValueError(f"not a selector: {text!r} at {at}")
        steps.append(step)
        if at < len(text):
            m = _BETWEEN.match(text, at)
            if not m or m.end() == len(text):
                raise ValueError(f"not a selector: {text!r} at {at}")
            at, how = m.end(), m[1] or " "
            if how == ",":
                out.append(steps)
                steps, how = [], ""
    if not steps:
        raise ValueError("an empty selector")
    return [*out, steps]


def _holds(e: Column, a: Column) -> Column:
    """Whether an element has an attribute as a step asks."""
    value, want = e["attributes"][a["name"]], a["value"]
    word = F.array_contains(F.split(value, r"\s+"), want)
    return (
        F.when(value.isNull(), F.lit(False))
        .when(a["op"] == "", F.lit(True))
        .when(a["op"] == "=", value == want)
        .when(a["op"] == "~=", word)
        .when(a["op"] == "|=", (value == want) | F.startswith(value, F.concat(want, F.lit("-"))))
        .when(want == "", F.lit(False))
        .when(a["op"] == "^=", F.startswith(value, want))
        .when(a["op"] == "$=", F.endswith(value, want))
        .otherwise(F.contains(value, want))
    )


def _fits(e: Column, s: Column) -> Column:
    own = (s["tag"].isNull() | (e["tag"] == s["tag"])) & (s["id"].isNull() | F.coalesce(e["id"] == s["id"], F.lit(False))) & (s["place"].isNull() | (e["place"] == s["place"]))
    return own & F.forall(s["classes"], lambda c: F.array_contains(e["classes"], c)) & F.forall(s["attributes"], lambda a: _holds(e, a))


def _related(elements: Column, flags: Column, e: Column, how: Column) -> Column:
    """Whether the element that a step asks for before this one is flagged; flags are per element."""
    flagged = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    earlier = F.exists(F.filter(F.slice(elements, F.greatest(e["parent"], F.lit(0)) + 1, F.greatest(e["at"] - F.greatest(e["parent"], F.lit(0)), F.lit(0))), lambda x: x["parent"] == e["parent"]), lambda x: flagged(x["at"]))
    return (
        F.when(how == "", F.lit(True))
        .when(how == " ", F.exists(e["above"], flagged))
        .when(how == ">", (e["parent"] >= 0) & flagged(F.greatest(e["parent"], F.lit(0))))
        .when(how == "+", (e["before"] >= 0) & flagged(F.greatest(e["before"], F.lit(0))))
        .otherwise(earlier)
    )


def selected(elements: Column, alternatives: Column) -> Column:
    """The elements that a selector (array of arrays of steps) matches, in document order, each once."""
    none = F.array().cast("array<boolean>")

    def flags(steps: Column) -> Column:
        return F.aggregate(steps, none, lambda acc, s: F.transform(elements, lambda e: _fits(e, s) & _related(elements, acc, e, s["how"])))

    hits = F.array_distinct(F.flatten(F.transform(alternatives, lambda steps: F.transform(F.filter(F.arrays_zip(flags(steps).alias("hit"), elements.alias("e")), lambda z: z["hit"]), lambda z: z["e"]["at"]))))
    return F.transform(F.array_sort(hits), lambda i: F.get(elements, i))


def inside(elements: Column, e: Column) -> Column:
    """The elements within one, in document order."""
    return F.slice(elements, e["at"] + 2, e["last"] - e["at"])


def stripped(e: Column, texts: Column, furniture: bool = True) -> Column:
    """The pieces of text within an element, without white space around them and without empty ones; scripts are no text,
    and without furniture neither are menus, headers, footers and asides."""
    own = F.filter(F.slice(texts, e["first"] + 1, e["stop"] - e["first"]), lambda t: ~t["hidden"] & (F.lit(furniture) | ~t["furniture"]))
    return F.filter(F.transform(own, lambda t: F.regexp_replace(t["text"], r"(?U)^\s+|\s+$", "")), lambda t: t != "")


def text_of(e: Column, texts: Column, between: str = "", furniture: bool = True) -> Column:
    return F.array_join(stripped(e, texts, furniture), between)


def raw_text(e: Column, texts: Column) -> Column:
    """All text within an element as it is written, scripts included."""
    return F.array_join(F.transform(F.slice(texts, e["first"] + 1, e["stop"] - e["first"]), lambda t: t["text"]), "")


def of_tag(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def one_line(e: Column, texts: Column) -> Column:
    return collapse(text_of(e, texts, " "))
