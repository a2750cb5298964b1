"""Names in texts: stand-in mentions, and how a claimed name is found in evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import match_form, nfc_words, once

# Names of one thing in several forms.
ALIASES = (
    ("ঢাকা", "dhaka"), ("বাংলাদেশ", "bangladesh"), ("ভারত", "ইন্ডিয়া", "india"), ("যুক্তরাষ্ট্র", "মার্কিন যুক্তরাষ্ট্র", "আমেরিকা", "usa", "us"),
    ("জাতিসংঘ", "united nations", "un"), ("বিএনপি", "বাংলাদেশ জাতীয়তাবাদী দল", "bnp"), ("আওয়ামী লীগ", "awami league"),
    ("চট্টগ্রাম", "চিটাগাং", "chittagong"), ("সিলেট", "sylhet"), ("রাজশাহী", "rajshahi"),
)
MENTION = r"(?:^|[^\p{L}])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"
MATCHED = ("exact", "alias", "span", "text")


def mentions(text: Column) -> Column:
    """A stand-in for a model of names: different runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)))


def key(mention: Column) -> Column:
    """A name as its words, each between spaces, so that one name holds another as a substring of whole words."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(match_form(mention, compose=False), F.lit(r"[ঀ-৿0-9A-Za-z]+"), F.lit(0)), " "), F.lit(" "))


def _alias(name: Column) -> Column:
    """The number of the thing that a key names; null if it has no other forms."""
    forms = {f" {form} ": i for i, all_ in enumerate(ALIASES) for form in nfc_words(all_)}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in forms.items() for x in pair]), name)


def match(claimed: Column, evidence: Column, text: Column) -> Column:
    """How a claimed key is found among the keys of evidence and in its text (a key, too): exact, alias, span, ambiguous, text or
    unmatched. A single word that is only part of longer names is ambiguous: it need not be the same."""
    several = F.contains(F.trim(claimed), F.lit(" "))
    forms = F.array(*[F.array(*[F.lit(f" {f} ") for f in nfc_words(all_)]) for all_ in ALIASES])
    known = F.element_at(forms, _alias(claimed) + 1)
    holding = F.filter(evidence, lambda e: F.contains(e, claimed) & (e != claimed))
    held = F.filter(evidence, lambda e: F.contains(claimed, e) & (e != claimed) & (F.trim(e) != ""))
    alias = F.coalesce(F.exists(known, lambda f: F.array_contains(evidence, f) | F.contains(text, f)), F.lit(False))
    long_held = F.exists(held, lambda e: F.contains(F.trim(e), F.lit(" ")))
    return (
        F.when(F.trim(claimed) == "", "unmatched").when(F.array_contains(evidence, claimed), "exact").when(alias, "alias")
        .when(several & ((F.size(holding) > 0) | long_held), "span").when(~several & (F.size(holding) > 0), "ambiguous")
        .when(F.contains(text, claimed), "text").when(several & (F.size(held) > 0), "ambiguous").otherwise("unmatched")
    )


def matches(claim: Column, source: Column) -> Column:
    """array<struct<mention, status>> of the names in a claim; both texts are in NFC."""
    keys = F.transform(mentions(source), key)
    return once(F.struct(keys.alias("keys"), key(source).alias("text")), lambda s: F.transform(mentions(claim), lambda m: F.struct(m.alias("mention"), once(key(m), lambda k: match(k, s["keys"], s["text"])).alias("status"))))
