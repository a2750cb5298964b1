"""Shortcuts of text functions against the plain way: what they leave out changes nothing."""

import re
import unicodedata

from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.plans import claims


def test_composed_characters_need_no_python(spark):
    """No composition touches them: none is a mark, none changes, none is what a pair ends in."""
    safe = [c for c in map(chr, range(0x300, 0x3000)) if re.match(f"[{text.COMPOSED}]", c)] + list(map(chr, range(0x300)))
    ends = {d.split()[1] for d in map(unicodedata.decomposition, map(chr, range(0x30000))) if d and d[0] != "<" and " " in d}
    assert all(unicodedata.combining(c) == 0 and unicodedata.normalize("NFC", c) == c and f"{ord(c):04X}" not in ends for c in safe)
    rows = spark.createDataFrame([("Señor – “é”…",), ("é Ω",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.nfc(F.col("t"))).collect()] == ["Señor – “é”…", "é Ω", None]
    # Python sees the second row alone.
    assert rows.where(F.col("t").rlike(f"[^{text.COMPOSED}]")).count() == 1


def test_white_space_collapses_as_unicode_has_it(spark):
    blank = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(r"\s", c) and c not in "\x1c\x1d\x1e\x1f")
    made = [a + x + b + y + a for x in blank for y in (" ", "  ", x, f"{x} ") for a, b in (("a", "b"), (" ", "b"), ("", "")) ] + ["", " ", "a b", "a  b ", "\x1c a"]
    rows = spark.createDataFrame([(m,) for m in made], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", "")
    assert rows.where(plain != text.collapse(F.col("t"))).count() == 0


def test_boilerplate_goes_where_it_stands(spark):
    phrases = ["Subscribe  to our newsletter", "FOLLOW us on", "download our app", "Copyright ©", "all rights RESERVED", "\ntags :", "\nKeyword:", "\ncategory :", "বিজ্ঞাপন", "আরও পড়ুন:", "শেয়ার করুন", "কুকি নীতি", "nothing of it"]
    rows = spark.createDataFrame([("long enough " * 12 + p + " <b>and</b> more",) for p in phrases], "t string")
    bare = F.regexp_replace("t", "<[^>]+>", " ")
    for pattern in text.BOILERPLATE:
        bare = F.regexp_replace(bare, "(?i)" + pattern, "")
    got = [(r[0], r[1]) for r in rows.select(text.clean_extracted(F.col("t")), F.regexp_replace(F.trim(F.regexp_replace(bare, r"[ \t]+", " ")), " +", " ")).collect()]
    assert all(a == b for a, b in got) and got[-1][0].count("nothing of it") == 1
    # Every pattern has Bengali letters or one of the words.
    assert all(re.search("[ঀ-৿]", p) or any(w in p.lower() for w in text.BOILERPLATE_WORDS) for p in text.BOILERPLATE)


def test_no_text_is_a_key_of_a_join(spark, sf):
    plan = claims.ud_models(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan
