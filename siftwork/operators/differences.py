"""Material differences between claims and what their sources say, as joins within each pair.

Both sides are annotated once: amounts, clauses, names and roles become rows of their pair, and each kind of difference is what a
join of both sides leaves over. A pair is never held in one row beyond its own texts. Pairs are dealt out by their keys first, and
sides of pairs are always merged: rows of words and stems are far larger than the compressed files by which Spark would choose a
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import NEGATIONS, STOPWORDS, content_of, is_negation, is_number, is_qualifier, match_form, negated, nfc, nfc_words, qualifier_groups, stem_list, tokens
from siftwork.operators import entities, similarity

# Words and endings by meaning, and the days and months in the forms in which they appear.
PLANS = (
    "পারে", "পারেন", "সম্ভাবনা", "আশঙ্কা", "পরিকল্পনা", "পরিকল্পনায়", "প্রস্তাব", "প্রস্তাবিত", "উদ্যোগ", "সম্ভবত", "নাকি", "বিবেচনা",
    "চিন্তা", "ভাবছে", "ভাবছেন", "চায়", "চান", "সম্ভাব্য", "প্রস্তুতি", "যাচ্ছে", "যাচ্ছেন",
)
DONE = ("হলো", "হল", "করল", "দিল", "গেল", "ঘটল", "বলল", "হয়েছিল", "মারা", "পাস")
DONE_ENDINGS = ("েছে", "েছেন", "েছিল", "েছিলেন", "েছিলো", "লেন")
FUTURE_ENDINGS = ("বে", "বেন", "বো")
NO_FUTURE = ("তবে", "কবে", "সবে", "যবে")
NO_FUTURE_ENDINGS = ("ভাবে", "জবাবে", "হিসেবে", "হিসাবে")
DENIALS = ("গুজব", "মিথ্যা", "ভুয়া", "অসত্য", "বানোয়াট", "ভিত্তিহীন")
DENIED = "(?:সত্য|সঠিক)\\s+(?:নয়|না)"
ALLEGED = r"(?:দাবি|অভিযোগ)\s+(?:কর|তোল|তুল|জানা|উঠেছে|ওঠে)|বলে\s+(?:দাবি|অভিযোগ)|(?:দাবি|অভিযোগ)\s*[:：]"
ALLEGING = "দাবি|অভিযোগ|গুজব"
OBJECT_ENDINGS, SUBJECT_ENDINGS = ("দেরকে", "কে", "দের"), ("েরা", "রা", "গণ")
CONFLICTS = (("UNIVERSAL", "PARTIAL"), ("LOWER_BOUND", "UPPER_BOUND"))
CLAUSE_ENDS = r"\s*(?:,(?![0-9০-৯])|:(?![0-9০-৯])|[;—–])\s*|\s+-\s+|\s+(?:কিন্তু|তবে|অথচ|যদিও|এবং)\s+"
NUMBER_WORDS = {
    "দুই": 2, "তিন": 3, "চার": 4, "পাঁচ": 5, "ছয়": 6, "সাত": 7, "আট": 8, "দশ": 10, "বিশ": 20, "ত্রিশ": 30, "চল্লিশ": 40, "পঞ্চাশ": 50,
}
MAGNITUDES = {"শত": 100, "হাজার": 1_000, "লাখ": 100_000, "লক্ষ": 100_000, "কোটি": 10_000_000}
UNITS = (
    "কিলোমিটার", "মেগাওয়াট", "শতাংশ", "টাকা", "ডলার", "রুপি", "ইউরো", "কেজি", "টন", "লিটার", "একর", "মিটার", "জন", "বছর", "মাস", "দিন",
    "ঘণ্টা", "মিনিট", "টি", "বার", "%",
)
PERCENT, CURRENCIES = "শতাংশ", ("টাকা", "ডলার", "রুপি", "ইউরো")
ROLES = (
    "নিহত", "মৃত্যু", "মারা", "আহত", "নিখোঁজ", "আক্রান্ত", "গ্রেপ্তার", "আটক", "উদ্ধার", "বরাদ্দ", "ব্যয়", "খরচ", "ঋণ", "জরিমানা", "আয়", "বেতন",
    "শুল্ক", "দাম", "মূল্য", "ভাড়া", "বাজেট", "রপ্তানি", "আমদানি", "প্রবৃদ্ধি", "মূল্যস্ফীতি", "ভোট", "আসন",
)
DAYS = {
    "জানুয়ারি": ("জানুয়ারি", "january"), "ফেব্রুয়ারি": ("ফেব্রুয়ারি", "february"), "মার্চ": ("মার্চ", "march"), "এপ্রিল": ("এপ্রিল", "april"),
    "মে": ("may",), "জুন": ("জুন", "june"), "জুলাই": ("জুলাই", "july"), "আগস্ট": ("আগস্ট", "আগষ্ট", "august"),
    "সেপ্টেম্বর": ("সেপ্টেম্বর", "september"), "অক্টোবর": ("অক্টোবর", "october"), "নভেম্বর": ("নভেম্বর", "november"), "ডিসেম্বর": ("ডিসেম্বর", "december"),
    "শনিবার": ("শনিবার",), "রবিবার": ("রবিবার", "রোববার"), "সোমবার": ("সোমবার",), "মঙ্গলবার": ("মঙ্গলবার",), "বুধবার": ("বুধবার",),
    "বৃহস্পতিবার": ("বৃহস্পতিবার",), "শুক্রবার": ("শুক্রবার",), "আজ": ("আজ", "আজকে"), "গতকাল": ("গতকাল",), "আগামীকাল": ("আগামীকাল",),
}
#: A clause has a counterpart if so much of it is there; roles of a number are looked for so many words away.
ALIGNED, ROLE_WORDS = 0.6, 4


def _one_of(token: Column, words: tuple[str, ...]) -> Column:
    return token.isin(nfc_words(words))


def _either(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(nfc_words(words)) + ")"


def modality(words: Column) -> Column:
    """NOT_COMPLETED for plans and futures, COMPLETED for what is said to have happened, else UNKNOWN."""
    future = lambda t: (F.length(t) >= 3) & t.rlike(_either(FUTURE_ENDINGS) + "$") & ~_one_of(t, NO_FUTURE) & ~t.rlike(_either(NO_FUTURE_ENDINGS) + "$")
    done = lambda t: _one_of(t, DONE) | (F.length(t) >= 4) & t.rlike(_either(DONE_ENDINGS) + "$")
    return F.when(F.exists(words, lambda t: _one_of(t, PLANS) | future(t)), "NOT_COMPLETED").when(F.exists(words, done), "COMPLETED").otherwise("UNKNOWN")


def day_words(words: Column) -> Column:
    """Canonical names of months and days among tokens, also with a case ending."""
    named = [(nfc_words((form,))[0], name) for name, forms in DAYS.items() for form in forms]
    known = F.create_map(*[F.lit(x) for pair in named for x in pair])
    bare = F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), F.try_element_at(known, F.regexp_replace(t, "(?:ের|র|ে|তে)$", ""))))
    return F.array_sort(F.array_distinct(F.array_compact(bare)))


def _value(surface: Column) -> Column:
    """The number of a surface, with its magnitude multiplied in."""
    times = F.coalesce(*[F.when(surface.rlike(rf"^[0-9.,]+\s*{nfc_words((name,))[0]}(?![ঀ-৿])"), F.lit(float(by))) for name, by in MAGNITUDES.items()], F.lit(1.0))
    return F.replace(F.regexp_extract(surface, "^[0-9.,]*[0-9]", 0), F.lit(","), F.lit("")).cast("double") * times


def quantities(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, at, surface, value, unit, role): a row per number of a text (in NFC), with its unit, and its role if one stands near.

    Roles are looked for in the words after the number, up to the next one, and in those before it if there is none; two are none.
    """
    form = match_form(F.col(text), compose=False)
    for word, number in NUMBER_WORDS.items():
        form = F.regexp_replace(form, rf"(?<!\S){nfc_words((word,))[0]}(?=\s)", str(number))
    number = r"(?<![0-9.,])[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?"
    pattern = rf"{number}(?:\s*{_either(tuple(MAGNITUDES))}(?![ঀ-৿]))?(?:\s*{_either(UNITS)})?"
    found = rows.select(*keys, form.alias("form")).select(*keys, F.regexp_extract_all("form", F.lit(pattern), F.lit(0)).alias("found"), F.split("form", pattern, -1).alias("between"))
    each = found.select(*keys, "between", F.posexplode("found").alias("at", "surface"))
    side = lambda i: F.regexp_extract_all(F.get("between", i), F.lit(r"[ঀ-৿A-Za-z]+"), F.lit(0))
    each = each.select(*keys, "at", "surface", F.slice(side(F.col("at") + 1), 1, ROLE_WORDS).alias("after"), F.reverse(F.slice(F.reverse(side(F.col("at"))), 1, ROLE_WORDS)).alias("before"))
    each = each.withColumns({"after_stems": stem_list(F.col("after")), "before_stems": stem_list(F.col("before"))})
    roles = F.array(*map(F.lit, nfc_words(ROLES)))
    near = lambda side: F.filter(roles, lambda r: F.array_contains(side, r) | F.array_contains(f"{side}_stems", r))
    each = each.withColumn("roles", F.when(F.size(near("after")) > 0, near("after")).otherwise(near("before")))
    unit = F.regexp_extract("surface", _either(UNITS) + "$", 0)
    unit = F.when(unit == "%", nfc_words((PERCENT,))[0]).otherwise(unit)
    return each.select(*keys, "at", F.trim("surface").alias("surface"), _value(F.col("surface")).alias("value"), unit.alias("unit"), F.when(F.size("roles") == 1, F.col("roles")[0]).otherwise("").alias("role"))


def _found(rows: DataFrame, keys: list[str], kind: str, detail: Column) -> DataFrame:
    return rows.select(*keys, F.lit(kind).alias("kind"), detail.alias("detail"))


def number_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of claims that their source doesn't state: a number of compatible unit and role, and equal value."""
    mine, theirs = quantities(pairs, keys, "claim"), quantities(pairs, keys, "source").withColumnsRenamed({c: f"s_{c}" for c in ("at", "surface", "value", "unit", "role")})
    same = F.abs(F.col("value") - F.col("s_value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value"))
    money = F.col("unit").isin(nfc_words(CURRENCIES)) & F.col("s_unit").isin(nfc_words(CURRENCIES))
    open_or_equal = lambda c: (F.col(c) == "") | (F.col(f"s_{c}") == "") | (F.col(c) == F.col(f"s_{c}"))
    fits = open_or_equal("role") & (open_or_equal("unit") | money)
    both = mine.join(theirs.hint("merge"), keys, "left").groupBy(*keys, "at", "value").agg(F.coalesce(F.bool_or(same & fits), F.lit(False)).alias("stated"))
    return _found(both.where("not stated"), keys, "numbers", F.col("value").cast("string"))


def _clauses(pairs: DataFrame, keys: list[str], text: str, place: str) -> DataFrame:
    parts = F.filter(F.split(text, CLAUSE_ENDS), lambda c: F.trim(c) != "")
    rows = pairs.select(*keys, F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(text))).alias(place, "clause"))
    return rows.select(*keys, place, tokens(F.col("clause"), compose=False).alias("words"))


def clause_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Negation, modality and scope of claim clauses against the source clause that holds most of their content words.

    A clause needs two content words and a counterpart with ALIGNED of them; counterparts of equal share that differ among
    themselves leave it open.
    """
    plain = F.filter(content_of(F.col("words")), lambda t: ~(is_number(t) | is_negation(t) | is_qualifier(t)))
    mine = _clauses(pairs, keys, "claim", "i").withColumn("content", plain)
    mine = mine.withColumn("stems", stem_list(F.col("content"))).withColumn("units", similarity.units(F.col("content"), F.col("stems"))).where(F.size("units") >= 2)
    theirs = _clauses(pairs, keys, "source", "j").select(*keys, "j", F.col("words").alias("s_words"), similarity.evidence_keys(F.col("words")).alias("s_keys"))
    joined = mine.join(theirs.hint("merge"), keys).select(*keys, "i", "j", "words", "s_words", similarity.coverage(F.col("units"), F.col("s_keys")).alias("share")).where(F.col("share") >= ALIGNED)
    said = joined.select(*keys, "i", "words", "share", F.struct("j", F.col("s_words").alias("words"), negated(F.col("s_words")).alias("negated"), modality(F.col("s_words")).alias("modality")).alias("s"))
    best = said.groupBy(*keys, "i", "words").agg(F.max("share").alias("best"), F.collect_list(F.struct("share", "s")).alias("all"))  # the clauses of one source
    tops = F.transform(F.filter("all", lambda x: x["share"] >= F.col("best") - 1e-9), lambda x: x["s"])
    best = best.select(*keys, "words", F.array_sort(tops).alias("tops"))
    sure = (F.size(F.array_distinct(F.transform("tops", lambda s: s["negated"]))) == 1) & (F.size(F.array_distinct(F.transform("tops", lambda s: s["modality"]))) == 1)
    rows = best.where(sure).select(*keys, "words", F.col("tops")[0]["words"].alias("s_words"), negated(F.col("words")).alias("no"), F.col("tops")[0]["negated"].alias("s_no"), modality(F.col("words")).alias("mode"), F.col("tops")[0]["modality"].alias("s_mode"))
    rows = rows.withColumns({"groups": qualifier_groups(F.col("words")), "s_groups": qualifier_groups(F.col("s_words"))})
    # A verb with its negation in one word negates only what the other side says with the same beginning.
    fused = lambda words: F.filter(words, lambda t: is_negation(t) & ~_one_of(t, NEGATIONS))
    echoed = lambda a, b: F.forall(fused(a), lambda t: F.exists(b, lambda o: F.startswith(o, F.substring(t, 1, 2)) & (o != t)))
    negation = (F.col("no") != F.col("s_no")) & echoed(F.col("words"), F.col("s_words")) & echoed(F.col("s_words"), F.col("words"))
    mode = F.array_sort(F.array("mode", "s_mode")) == F.array(F.lit("COMPLETED"), F.lit("NOT_COMPLETED"))
    opposed = F.lit(False)
    for p, q in CONFLICTS + tuple((q, p) for p, q in CONFLICTS):
        opposed = opposed | (F.array_contains("groups", p) & F.array_contains("s_groups", q) & ~F.array_contains("s_groups", p))
    kind = F.when(negation, "negation").when(mode, "modality").when(opposed, "scope")
    detail = F.when(negation, F.when(F.col("no"), "claim negates").otherwise("source negates")).when(mode, F.col("mode")).otherwise(F.array_join("groups", ", "))
    return rows.select(*keys, kind.alias("kind"), detail.alias("detail")).where("kind is not null")


def role_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs in which one name turns from object to subject and another one back, by their endings."""

    def roles(side: str, role: str) -> DataFrame:
        words = F.filter(tokens(F.col(side), compose=False), lambda t: (F.length(t) >= 3) & ~_one_of(t, STOPWORDS))
        each = pairs.select(*keys, F.posexplode(words).alias("at", "t"))
        cut = lambda ends: F.regexp_replace("t", _either(ends) + "$", "")
        is_object = (cut(OBJECT_ENDINGS) != F.col("t")) & (F.length(cut(OBJECT_ENDINGS)) >= 2)
        bare = F.when(is_object, cut(OBJECT_ENDINGS)).when(F.length(cut(SUBJECT_ENDINGS)) >= 2, cut(SUBJECT_ENDINGS)).otherwise(F.col("t"))
        each = each.select(*keys, "at", is_object.alias("is_object"), F.array(bare).alias("bare"))
        return each.withColumn("stem", stem_list(F.col("bare"))[0]).groupBy(*keys, "stem").agg(F.min_by("is_object", "at").alias(role))

    turned = roles("claim", "a").join(roles("source", "b").hint("merge"), [*keys, "stem"]).where("a <> b").groupBy(*keys).agg(F.bool_or("a").alias("to_object"), F.bool_or("b").alias("to_subject"))
    return _found(turned.where("to_object and to_subject"), keys, "subject_object", F.lit("roles exchanged"))


def text_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Days that only the claim names, allegations told as facts, and denials left out."""
    form = {side: match_form(F.col(side), compose=False) for side in ("claim", "source")}
    rows = pairs.select(*keys, *[f.alias(s) for s, f in form.items()])
    rows = rows.select(*keys, "claim", "source", tokens(F.col("claim"), compose=False).alias("a"), tokens(F.col("source"), compose=False).alias("b"))
    denied = lambda text, words: F.exists(words, lambda t: _one_of(t, DENIALS)) | F.col(text).rlike(nfc_words((DENIED,))[0])
    days = F.array_except(day_words(F.col("a")), day_words(F.col("b")))
    hits = {
        "date": F.when(F.size(days) > 0, F.array_join(days, ", ")),
        "attribution": F.when(F.col("source").rlike(nfc_words((ALLEGED,))[0]) & ~F.col("claim").rlike(nfc_words((ALLEGING,))[0]), "stated as fact"),
        "denial": F.when(denied("source", "b") & ~denied("claim", "a"), "source denies"),
    }
    listed = F.array_compact(F.array(*[F.when(d.isNotNull(), F.struct(F.lit(k).alias("kind"), d.alias("detail"))) for k, d in hits.items()]))
    return rows.select(*keys, F.explode(listed).alias("m")).select(*keys, "m.kind", "m.detail")


def entity_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Names of claims that are in no way found in the source."""
    rows = pairs.select(*keys, F.explode(entities.matches(F.col("claim"), F.col("source"))).alias("m"))
    return _found(rows.where(~F.col("m.status").isin(*entities.MATCHED)), keys, "entity", F.col("m.mention"))


def material(pairs: DataFrame, keys: list[str], claim: str = "claim", source: str = "source", names: bool = False) -> DataFrame:
    """(keys, kind, detail) of the ways in which a claim differs from its source in substance; names of entities only if asked for."""
    rows = pairs.select(*keys, nfc(F.coalesce(F.col(claim), F.lit(""))).alias("claim"), nfc(F.coalesce(F.col(source), F.lit(""))).alias("source")).repartition(*[F.col(k) for k in keys])
    out = number_differences(rows, keys).union(clause_differences(rows, keys)).union(role_differences(rows, keys)).union(text_differences(rows, keys))
    return (out.union(entity_differences(rows, keys)) if names else out).distinct()

