"""Source names against plain searches of all aliases, the registry's steps, and modes by value."""

import random

from pyspark.sql import functions as F

from siftwork.operators import resolution


def test_many_aliases_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcd é") for _ in range(n))
    aliases = sorted({word(r.randint(1, 3)) for _ in range(20)} | {word(r.randint(4, 14)) for _ in range(100_000)})
    r.shuffle(aliases)
    listed = [(i, a, f"d{i % 997}") for i, a in enumerate(aliases)]
    names = [word(r.randint(1, 30)) for _ in range(150)] + [r.choice(aliases) + word(3) for _ in range(50)] + [r.choice(aliases) for _ in range(20)] + ["", None, "zzz"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame([*listed, (200_000, "", "empty"), (200_001, None, "none")], "place int, alias string, domain string")
    found = {x["name"]: (x["exact"], x["prefix"], x["within"]) for x in resolution.by_alias(rows, table).collect()}
    want = {}
    for name in {n for n in names if n}:
        first = lambda test: next((d for _, a, d in listed if test(a)), None)
        row = first(lambda a: a == name), first(name.startswith), first(lambda a: a in name)
        if row[2] is not None:
            want[name] = row
    assert found == want and any(w[0] for w in want.values()) and any(w[0] is None and w[1] is None for w in want.values())


def test_steps_and_modes(spark):
    aliases = spark.createDataFrame([(1, "Daily Star", "star.example"), (0, "star", "other.example"), (2, "ডেইলি", "daily.example")], "place int, alias string, domain string")
    registry = spark.createDataFrame([("herald", ["The Herald", "H"], True), ("gazette", ["Gaz"], False), ("star.example", [], False)], "canonical_name string, aliases array<string>, is_active boolean")
    cases = {
        "https://www.News.example/a?b=c": ("news.example", "domain", "SOURCE_SELECTED"),
        "paper.example": ("paper.example", "domain", "SOURCE_SELECTED"),
        " DAILY star ": (None, None, "SOURCE_INACTIVE"),  # the exact alias goes before the first one held
        "Star weekly": ("other.example", "prefix", "SOURCE_SELECTED"),
        "the daily star": ("other.example", "within", "SOURCE_SELECTED"),
        "ডেইলি খবর": ("daily.example", "prefix", "SOURCE_SELECTED"),
        "Herald": ("herald", "registered", "SOURCE_SELECTED"),
        "The Herald": ("herald", "alias", "SOURCE_SELECTED"),
        "the herald": (None, None, "SOURCE_UNRECOGNIZED"),  # aliases of the registry are taken as written
        "GAZETTE": (None, None, "SOURCE_INACTIVE"),
        "Gaz": (None, None, "SOURCE_UNRECOGNIZED"),
        "nobody": (None, None, "SOURCE_UNRECOGNIZED"),
        "  ": (None, None, "SOURCE_NOT_SUPPLIED"),
        None: (None, None, "SOURCE_NOT_SUPPLIED"),
    }
    claims = spark.createDataFrame([(n, i) for i, n in enumerate(cases)] + [("Herald", 99)], "name string, i int")
    rows = resolution.with_mode(resolution.resolved(claims, "name", aliases, registry), "name", registry).collect()
    assert len(rows) == len(cases) + 1
    for row in rows:
        assert (row["canonical"], row["step"], row["reason"]) == cases[row["name"]], row
        assert row["mode"] == ("CLAIMED_SOURCE" if row["canonical"] else "VERIFIED_SOURCES")
    blank = resolution.with_mode(resolution.resolved(claims.where("name IS NULL OR name = 'Herald'"), "name", aliases, registry), "name", registry, detected=True)
    assert {r["reason"] for r in blank.collect()} == {"SOURCE_NOT_DETECTED", "SOURCE_DETECTED"}


def test_percent_is_no_hundred(spark):
    from siftwork.operators import differences

    rows = spark.createDataFrame([(1, "দাম ৫ শতাংশ বেড়েছে"), (2, "৫ শত জন"), (3, "২ হাজার টাকা"), (4, "5%")], "id int, claim string")
    got = {r["id"]: (r["value"], r["unit"]) for r in differences.quantities(rows, ["id"], "claim").collect()}
    assert got[1][0] == 5.0 and got[2][0] == 500.0 and got[3][0] == 2000.0 and got[4][0] == 5.0


def test_tier_changes_count_as_a_whole(spark):
    from siftwork.operators import votes

    tiers = spark.createDataFrame([(1, 0.0, 50.0), (2, 50.0, 100.0)], "tier int, low double, high double")
    row = lambda *t: spark.createDataFrame(list(t), tiers.schema)
    kept, faults = votes.changed_ranges(tiers, "tier", row((2, 50.0, 80.0), (3, 80.0, 100.0)), [], "low", "high")
    assert sorted(map(tuple, kept.collect())) == [(1, 0.0, 50.0), (2, 50.0, 80.0), (3, 80.0, 100.0)] and faults.isEmpty()
    kept, faults = votes.changed_ranges(tiers, "tier", row((2, 60.0, 100.0)), [9], "low", "high")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, tiers.collect())) and [tuple(f) for f in faults.collect()] == [(50.0, "gap")]
    kept, _ = votes.changed_ranges(tiers, "tier", tiers.limit(0), [2], "low", "high")
    assert kept.count() == 2
