"""Personal data and information-theoretic sanitisation, in DataFrame functions only.

Base spans are matches of four patterns. Beyond them, a term near an entity may reveal it. Over the corpus,
  PMI(t; e) = log2(N n(t, e) / (n(t) n(e))),   IC(e) = log2(N / n(e)),
where n counts documents (with t, with e, with t near e). A term whose PMI is at least ALPHA of what the entity itself
tells, IC(e), discloses it, and is a span of kind term wherever it stands near e. Pairs seen in fewer than SUPPORT
different contexts are no evidence: a copied passage is one context, however often it is copied.
sanitised counts and replaces over whole texts as well (whole_spans); the rows of found_spans keep to the window of its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import discard, stored, told_apart

#: Kinds in the order in which spans of equal start are listed, and the pattern of each.
KINDS = ("email", "ip", "card", "phone", "term")
# A match starts where a run starts or where the last match ended (\G); so long runs are tried once, not at each place.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Whole runs of 12 to 19 digits, at most one space or hyphen between two.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

ALPHA, SUPPORT, CONTEXT = 0.9, 2, 120
#: Lengths are summed by runs of 2^RUN_BITS.
RUN_BITS = 8
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _only_digits(match: Column) -> Column:
    return F.translate(match, " ().-+", "")


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_only_digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(IP_VALID),
        "card": lambda: (n >= 12) & (n <= 19) & _luhn(_only_digits(match)),
        "phone": lambda: (n >= 9) & (n <= 15),
    }[kind]()


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value); value is worked out once, though lambdas within body name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(found: Column, between: Column) -> Column:
    """Matches as structs x, start, end (code points from 0, end exclusive), from the texts between them, as split gives them.

    A start is the sum of the lengths before it: sums of whole runs of RUN lengths, then what is left. So a text of many
    matches costs little more than its matches.
    """
    add = lambda t, s: t + s
    # Lengths up to a match: those of the texts before it, its own text before included, and of the matches before it.
    steps = F.zip_with(F.transform(between, lambda x: F.length(x)), F.concat(F.array(F.lit(0)), F.transform(found, lambda x: F.length(x))), add)

    def places(v: Column) -> Column:
        runs = F.sequence(F.lit(0), F.shiftright(F.size(v["steps"]), RUN_BITS))
        sums = F.transform(runs, lambda r: F.aggregate(F.slice(v["steps"], F.shiftleft(r, RUN_BITS) + 1, F.lit(1 << RUN_BITS)), F.lit(0), add))

        def start(sums: Column, i: Column) -> Column:
            whole = F.shiftright(i + 1, RUN_BITS)
            rest = F.slice(v["steps"], F.shiftleft(whole, RUN_BITS) + 1, i + 1 - F.shiftleft(whole, RUN_BITS))
            return F.aggregate(F.slice(sums, F.lit(1), whole), F.lit(0), add) + F.aggregate(rest, F.lit(0), add)

        return _with(sums, lambda sums: F.transform(v["found"], lambda x, i: F.struct(x.alias("x"), start(sums, i).alias("start"))))

    starts = _with(F.struct(found.alias("found"), steps.alias("steps")), places)
    return F.transform(starts, lambda m: F.struct(m["x"].alias("x"), m["start"].alias("start"), (m["start"] + F.length(m["x"])).alias("end")))


def _as_spans(placed: Column, kind: str) -> Column:
    return F.transform(placed, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def _matches(kind: str, pattern: str, hint: Column) -> Column:
    """Valid matches of text as spans. hint is a cheap test that a match needs."""
    text = F.col("text")
    placed = _placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    valid = F.filter(placed, lambda m: _valid(kind, m["x"]))
    return F.when(hint, _as_spans(valid, kind)).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with base, the spans of e-mail addresses, IP addresses, cards and phones by start, then kind."""
    text = F.col("text")
    digit = text.rlike(r"[0-9][\x20-]?[0-9]")
    parts = [_matches("email", EMAIL, text.contains("@")), _matches("ip", IP, text.rlike(r"[0-9]\.[0-9]")), _matches("card", CARD, digit), _matches("phone", PHONE, text.contains("+"))]
    return docs.withColumn("base", F.coalesce(F.array_sort(F.concat(*parts)), F.array().cast(_SPAN)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _marks(spans: Column, n: Column) -> Column:
    """A string of n characters: 1 where a span of spans, which are in order, covers the text, 0 elsewhere."""

    def step(acc: Column, s: Column) -> Column:
        some = lambda mark, n: F.repeat(F.lit(mark), F.greatest(F.lit(0), n))
        new = F.array(some("0", s["start"] - acc["at"]), some("1", s["end"] - F.greatest(acc["at"], s["start"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], new).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.repeat(F.lit("0"), n - acc["at"])))


def contexts(spanned: DataFrame) -> DataFrame:
    """A row per letter run near a base span: doc_id, entity, context (hash), term, start, end.

    Near: within CONTEXT characters to either side; runs that touch a base span, or the edge of the context, don't count.
    """
    marked = spanned.where(F.size("base") > 0).withColumn("marks", _marks(F.col("base"), F.length("text")))
    near = marked.select("doc_id", "text", "marks", F.explode("base").alias("s"))
    entity = F.concat_ws(":", F.col("s.kind"), F.lower(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))))
    sides = F.array(
        F.struct(F.greatest(F.lit(0), F.col("s.start") - CONTEXT).alias("from"), F.least(F.col("s.start"), F.lit(CONTEXT)).alias("n")),
        F.struct(F.col("s.end").alias("from"), F.lit(CONTEXT).alias("n")),
    )
    rows = near.select("doc_id", entity.alias("entity"), "text", "marks", F.explode(sides).alias("side"))
    cut = lambda c: F.substr(c, F.col("side.from") + 1, F.col("side.n"))
    rows = rows.select("doc_id", "entity", F.col("side.from").alias("from"), F.col("side.n").alias("n"), cut("text").alias("piece"), cut("marks").alias("marks"))
    placed = _placed(F.regexp_extract_all("piece", F.lit(r"\p{L}+"), F.lit(0)), F.split("piece", r"\p{L}+", -1))
    rows = rows.select("doc_id", "entity", "from", "n", "marks", F.xxhash64("piece").alias("context"), F.explode(placed).alias("m"))
    # The run with the character before it and the one after it.
    clear = ~F.substr("marks", F.greatest("m.start", F.lit(1)), F.col("m.end") + 2 - F.greatest("m.start", F.lit(1))).contains("1")
    whole = ((F.col("m.start") > 0) | (F.col("from") == 0)) & (F.col("m.end") < F.col("n")) & (F.length(F.lower("m.x")) > 1)
    return rows.where(clear & whole).select("doc_id", "entity", "context", F.lower("m.x").alias("term"), (F.col("from") + F.col("m.start")).alias("start"), (F.col("from") + F.col("m.end")).alias("end"))


def disclosures(spanned: DataFrame, near: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(entity, term) of the terms near entities whose disclosure, PMI / IC, is at least alpha."""
    total = spanned.agg(F.count("*").alias("N"))
    pairs = near.groupBy("entity", "term", "context").agg(F.count_distinct("doc_id").alias("docs")).groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    together = near.groupBy("entity", "term").agg(F.count_distinct("doc_id").alias("n_te")).join(pairs, ["entity", "term"])
    entities = near.groupBy("entity").agg(F.count_distinct("doc_id").alias("n_e"))
    # All words of all documents, as one row per word and task before the shuffle.
    words = spanned.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_t"))
    rows = together.join(entities, "entity").join(terms, "term", "left").crossJoin(F.broadcast(total))  # one row
    n_t = F.greatest(F.coalesce("n_t", "n_te"), F.col("n_te"))
    pmi = F.log2(F.col("N") * F.col("n_te") / (n_t * F.col("n_e")))
    ic = F.log2(F.col("N") / F.col("n_e"))
    return rows.where((ic > 0) & (pmi >= F.lit(alpha) * ic)).select("entity", "term")


def all_spans(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs (doc_id, text and others; null texts as empty) with base and spans, base among them.

    Rows of one doc_id must have one text; told_apart() numbers others.
    """
    spark = docs.sparkSession
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    near, _ = stored(contexts(base_spans(whole.select("doc_id", "text"))), "near")
    revealing = disclosures(whole, near, alpha, support)
    hits = near.join(revealing, ["entity", "term"]).where("doc_id is not null")
    extra, _ = stored(hits.groupBy("doc_id").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms")), "terms")  # bounded by the document
    joined = base_spans(whole).join(extra, "doc_id", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(F.col("terms").cast(_SPAN), F.array().cast(_SPAN))))).drop("terms")


def _terms(pattern: str, text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _replaced(text: Column, spans: Column, tag) -> Column:
    """text with tag(span) for each span; where spans overlap, for the first one."""

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), tag(s)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def _any_of(words: Column) -> Column:
    """A pattern of these letter runs."""
    return F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))


def wide_disclosures(spanned: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(entity, term) that disclose by documents that hold both, however far apart; and held (doc_id, entity).

    spanned: doc_id, text, base. As n(t, e) is at most n(e), a term of more than n(e)^alpha N^(1 - alpha) documents can't reach
    alpha, and isn't paired. The context of a pair in a document is what stands within CONTEXT of all places of both.
    """
    total = spanned.agg(F.count("*").alias("N"))
    with_base = spanned.where((F.size("base") > 0) & F.col("doc_id").isNotNull())
    each = with_base.select("doc_id", "text", F.explode("base").alias("s"))
    low = F.greatest(F.lit(0), F.col("s.start") - CONTEXT)
    entity = F.concat_ws(":", F.col("s.kind"), F.lower(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))))
    held = each.select("doc_id", entity.alias("entity"), F.xxhash64(F.substr("text", low + 1, F.col("s.end") + CONTEXT - low)).alias("around"))
    held = held.groupBy("doc_id", "entity").agg(F.hash(F.array_sort(F.collect_set("around"))).alias("around"))  # bounded by the document
    held, _ = stored(held, "held")
    n_e = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    # Runs that touch a base span have the mark beside them.
    rest = _replaced(F.col("text"), F.col("base"), lambda s: F.lit("\ue000"))
    words = with_base.select("doc_id", F.explode(_terms(r"(?<![\p{L}\x{E000}])\p{L}{2,}+(?!\x{E000})", rest)).alias("run"))
    n_t = spanned.select(F.explode(_terms(r"\p{L}+", F.lower("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    words = words.withColumn("term", F.lower("run")).select("doc_id", "term").distinct().join(n_t, "term", "left").withColumn("n_t", F.coalesce("n_t", F.lit(1)))
    bound = lambda n: F.pow(n, F.lit(alpha)) * F.pow(F.col("N"), F.lit(1 - alpha)) * (1 + 1e-9)
    most = n_e.agg(F.max("n_e").alias("most")).crossJoin(total)
    rare = words.crossJoin(F.broadcast(most)).where(F.col("n_t") <= bound(F.col("most"))).drop("most")  # one row
    pairs = held.join(n_e, "entity").join(rare, "doc_id").where(F.col("n_t") <= bound(F.col("n_e")))
    together = pairs.groupBy("entity", "term", "n_e", "n_t", "N").agg(F.count_distinct("doc_id").alias("n_te")).where(F.col("n_te") >= support)
    pmi = F.log2(F.col("N") * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    ic = F.log2(F.col("N") / F.col("n_e"))
    likely, _ = stored(together.where((ic > 0) & (pmi >= F.lit(alpha) * ic)).select("entity", "term"), "likely")
    # The texts are read again only for documents and terms that may count.
    where = rare.select("doc_id", "term").join(held, "doc_id").join(likely, ["entity", "term"])
    wanted = where.select("doc_id", "term").distinct()
    beside = wanted.join(with_base.select("doc_id", "text"), "doc_id").withColumn("cut", F.split(F.lower("text"), _any_of(F.array("term")), -1)).withColumn("last", F.size("cut") - 1)
    sides = F.transform("cut", lambda p, i: F.concat(F.when(i > 0, F.left(p, F.lit(CONTEXT))).otherwise(""), F.lit("\n"), F.when(i < F.col("last"), F.right(p, F.lit(CONTEXT))).otherwise("")))
    beside = beside.groupBy("doc_id", "term").agg(F.min(F.xxhash64(sides)).alias("beside"))
    contexts_ = where.join(beside, ["doc_id", "term"]).groupBy("entity", "term").agg(F.count_distinct("around", "beside").alias("n"))
    return contexts_.where(F.col("n") >= support).select("entity", "term"), held


def whole_spans(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """As all_spans, but terms count over whole texts, too, and all places of a term are spans in each document of its entity."""
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    spanned, _ = stored(base_spans(whole.select("doc_id", "text")), "spanned")
    near, _ = stored(contexts(spanned), "near")
    wide, held = wide_disclosures(spanned, alpha, support)
    revealing = disclosures(whole, near, alpha, support).union(wide).distinct()
    hidden = held.select("doc_id", "entity").join(revealing, "entity").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    hidden, _ = stored(hidden, "terms")
    rows = base_spans(whole).join(hidden, "doc_id", "left")
    # The runs of this very text whose lower case is a term; places come from the text between them.
    runs = F.filter(_terms(r"\p{L}{2,}+", F.col("text")), lambda w: F.array_contains("terms", F.lower(w)))
    rows = rows.withColumn("_runs", F.when(F.col("terms").isNotNull(), runs).otherwise(F.array().cast("array<string>")))
    some = F.size("_runs") > 0
    found = F.when(some, F.regexp_extract_all("text", _any_of(F.col("_runs")), F.lit(0)))
    between = F.when(some, F.split("text", _any_of(F.col("_runs")), -1))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["end"]) & (s["start"] <= b["end"]))
    extra = F.when(some, F.filter(_as_spans(_placed(found, between), "term"), clear)).otherwise(F.array().cast(_SPAN))
    return rows.withColumn("spans", F.array_sort(F.concat("base", extra))).drop("terms", "_runs")


def found_spans(docs: DataFrame, **settings) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null and empty texts have no spans. Terms are looked up by row: rows that repeat a doc_id and its text share them, different
    texts of one doc_id don't, and rows without doc_id have none. Texts may have any length; no rows give no rows.
    """
    rows, _ = told_apart(docs.select("doc_id", "text"))
    rows = all_spans(rows.select(F.col("_row").alias("doc_id"), "text", F.col("doc_id").alias("_own")), **settings).drop("doc_id").withColumnRenamed("_own", "doc_id")
    n = lambda kind, spans="base": F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n("term", "spans"))


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span in text replaced by the tag of its kind; where spans overlap, the first one's. Null stays."""
    others = [c for c in docs.columns if c != "text"]
    apart, _ = told_apart(docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("_null"), *others).alias("_given")))
    rows = whole_spans(apart.select(F.col("_row").alias("doc_id"), "text", F.col("_given").alias("_row")), **settings)
    tags = F.array(*[F.lit(TAGS[k]) for k in KINDS])
    clean = _replaced(F.col("text"), F.col("spans"), lambda s: F.element_at(tags, s["kind"] + 1))
    text = F.when(F.col("_row._null"), F.lit(None)).when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


_PLACES = "list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0)"
_BASE = "\n  UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d" for k, p in enumerate((
    "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "[0-9]([\\x20-]?[0-9])+", "\\+[0-9][\\x20().0-9-]+[0-9]",
)))
#: The rows of found_spans in DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {_BASE}),
placed AS (SELECT doc_id, kind, m[i] AS x, {_PLACES.format(g="g", m="m")} AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
digits AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS n FROM placed),
base AS (
  SELECT doc_id, kind, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS z, x FROM digits
  WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_matches(x, '{IP_VALID}') WHEN 3 THEN length(n) BETWEEN 9 AND 15
    ELSE length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(n)), lambda i:
      CASE WHEN i % 2 = 0 THEN CAST(n[length(n) - i] AS INT) WHEN CAST(n[length(n) - i] AS INT) > 4 THEN 2 * CAST(n[length(n) - i] AS INT) - 9 ELSE 2 * CAST(n[length(n) - i] AS INT) END)) % 10 = 0 END),
lists AS (SELECT doc_id, list({{'a': a, 'z': z}}) AS spans FROM base GROUP BY doc_id),
sides AS (
  SELECT doc_id, kind || ':' || lower(x) AS entity, unnest([greatest(0, a - {CONTEXT}), z]) AS origin, unnest([least(a, {CONTEXT}), {CONTEXT}]) AS n FROM base),
pieces AS (SELECT s.doc_id, entity, origin, n, substr(text, CAST(origin + 1 AS BIGINT), CAST(n AS BIGINT)) AS piece FROM sides s JOIN d USING (doc_id)),
split AS (SELECT *, regexp_extract_all(piece, '\p{{L}}+') AS m, string_split_regex(piece, '\p{{L}}+') AS g FROM pieces),
runs AS (SELECT doc_id, entity, origin, n, piece, m[i] AS x, {_PLACES.format(g="g", m="m")} AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM split)),
near AS (
  SELECT r.doc_id, entity, piece, lower(x) AS term, CAST(origin + place AS BIGINT) AS a, CAST(origin + place + length(x) AS BIGINT) AS z
  FROM runs r JOIN lists l ON r.doc_id = l.doc_id
  WHERE (place > 0 OR origin + place = 0) AND place + length(x) < n AND length(x) > 1
    AND len(list_filter(l.spans, lambda b: b.a <= origin + place + length(x) AND origin + place <= b.z)) = 0),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS n_te FROM near GROUP BY entity, term HAVING count(DISTINCT piece) >= {SUPPORT}),
entities AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM near GROUP BY entity),
terms AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{{L}}+'))) AS term FROM d) GROUP BY term),
revealing AS (
  SELECT entity, term FROM pairs JOIN entities USING (entity) LEFT JOIN terms USING (term), (SELECT count(*) AS docs FROM d)
  WHERE docs > n_e AND log2(docs * n_te::DOUBLE / (greatest(coalesce(n_t, n_te), n_te) * n_e)) >= {ALPHA} * log2(docs::DOUBLE / n_e)),
every_span AS (
  SELECT doc_id, kind, a, z FROM base UNION ALL SELECT DISTINCT doc_id, {KINDS.index("term")}, a, z FROM near JOIN revealing USING (entity, term) WHERE doc_id IS NOT NULL),
named AS (SELECT *, {list(KINDS)}[kind + 1] || ':' || a || ':' || z AS name FROM every_span),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
    count(*) FILTER (WHERE kind = 4) AS n_term, string_agg(name, ',' ORDER BY a, kind, z) FILTER (WHERE kind < 4) AS base, string_agg(name, ',' ORDER BY a, kind, z) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN per USING (doc_id)
"""
