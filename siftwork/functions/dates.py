"""Publication dates, whole-day ranges and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import nfc, nfc_words, normalize_digits

ZONE = "Asia/Dhaka"
# Bengali month names in order of the year, and the forms in which dates are written.
MONTHS = ("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর")
ENGLISH = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FORMS = {
    r"^[A-Za-z]{4,} \d{1,2}, \d{4}$": "MMMM d, yyyy",
    r"^May \d{1,2}, \d{4}$": "MMMM d, yyyy",
    r"^\d{1,2} [A-Za-z]{4,} \d{4}$": "d MMMM yyyy",
    r"^\d{1,2} May \d{4}$": "d MMMM yyyy",
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": "MMM d, yyyy",
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": "d MMM yyyy",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy",
    r"^\d{1,2}-\d{1,2}-\d{4}$": "d-M-yyyy",
}
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def publication(raw: Column) -> Column:
    """struct<local_date, published_at, has_time, tz_assumed> of a date as published, null if it can't be read.

    Times without an offset are local to ZONE; the date is the local day.
    """
    text = normalize_digits(F.trim(raw))
    for local, english in zip(MONTHS, ENGLISH):
        text = F.replace(text, F.lit(local), F.lit(english))
    day, clock, offset = (F.regexp_extract(text, ISO, i) for i in (1, 2, 3))
    offset = F.regexp_replace(F.regexp_replace(offset, "^Z$", "+00:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    stamp = F.concat(day, F.lit("T"), clock)
    assumed = F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), ZONE)
    exact = F.try_to_timestamp(F.concat(stamp, offset), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    at = F.when(clock != "", F.when(offset == "", assumed).otherwise(exact))
    written = F.coalesce(*[F.when(text.rlike(pattern), F.to_date(F.try_to_timestamp(text, F.lit(form)))) for pattern, form in FORMS.items()])
    date = F.when(text.rlike(ISO), F.when(clock != "", F.to_date(F.from_utc_timestamp(at, ZONE))).otherwise(F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))))).otherwise(written)
    return F.when(date.isNotNull(), F.struct(date.alias("local_date"), at.alias("published_at"), at.isNotNull().alias("has_time"), (at.isNotNull() & (offset == "")).alias("tz_assumed")))


# Names of the months as photo cards write them, and endings of day numbers.
CARD_MONTHS = (
    ("জানুয়ারি", "জানুয়ারী", "january", "jan"), ("ফেব্রুয়ারি", "ফেব্রুয়ারী", "ফেব্রুযারি", "february", "feb"), ("মার্চ", "march", "mar"),
    ("এপ্রিল", "april", "apr"), ("মে", "may"), ("জুন", "june", "jun"), ("জুলাই", "july", "jul"), ("আগস্ট", "অগাস্ট", "আগষ্ট", "august", "aug"),
    ("সেপ্টেম্বর", "september", "sept", "sep"), ("অক্টোবর", "october", "oct"), ("নভেম্বর", "november", "nov"), ("ডিসেম্বর", "december", "dec"),
)
DAY_ENDINGS = ("st", "nd", "rd", "th", "লা", "রা", "ঠা", "ই", "শে")


def card_date(raw: Column) -> Column:
    """The one date that a card's text holds, in whatever form; null if there is none, or more than one.

    Day, month name and year; month name, day and year; year, month and day in figures; day, month and year in figures. What is
    no day of the calendar doesn't count.
    """
    text = normalize_digits(nfc(raw))
    numbers = {name: i for i, names in enumerate(CARD_MONTHS, 1) for name in nfc_words(names)}
    month = "(" + "|".join(sorted(numbers, key=len, reverse=True)) + ")"
    day, between = rf"(\d{{1,2}})(?:{'|'.join(nfc_words(DAY_ENDINGS))})?", r"[\s,.\-/]*"
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    by_name = lambda m: F.try_element_at(known, F.lower(m)).cast("string")
    forms = [
        (rf"(?i)(?<!\d){day}{between}{month}\.?{between}(\d{{4}})(?!\d)", (3, 2, 1), by_name),
        (rf"(?i){month}\.?{between}{day}{between}(\d{{4}})(?!\d)", (3, 1, 2), by_name),
        (r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", (1, 2, 3), lambda m: m),
        (r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)", (3, 2, 1), lambda m: m),
    ]

    def days(pattern: str, groups: tuple[int, int, int], number) -> Column:
        found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in zip(groups, "ymd")])
        two = lambda c: F.lpad(c, 2, "0")
        return F.transform(found, lambda z: F.to_date(F.try_to_timestamp(F.concat_ws("-", z["y"], two(number(z["m"])), two(z["d"])), F.lit("yyyy-MM-dd"))))

    all_ = F.array_distinct(F.array_compact(F.concat(*[days(*f) for f in forms])))
    return F.when(F.size(all_) == 1, all_[0])


def on_days(stamp: Column, first: str | None, last: str | None) -> Column:
    """Whether a timestamp lies in whole days, both included."""
    out = F.lit(True)
    if first:
        out = out & (stamp >= F.lit(first).cast("timestamp_ntz"))
    if last:
        out = out & (stamp < (F.lit(last).cast("date") + 1).cast("timestamp_ntz"))
    return out


def retry_delay(attempts: Column, base: int = 30, most: int = 3600, doublings: int = 7) -> Column:
    """Seconds until the next attempt: doubled each time, up to a bound."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(doublings))))


def only_date(text: Column, pattern: str = r"\d{4}-\d{2}-\d{2}") -> Column:
    """The one date that a text holds; null if it holds none or different ones."""
    found = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(normalize_digits(text), F.lit(pattern), F.lit(0)), lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))))))
    return F.when(F.size(found) == 1, found[0])
