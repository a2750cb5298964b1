"""Quality rules: learned decision lists over text statistics, as ordered Spark conditions.

Only DataFrame functions. Statistics are computed per row with array functions; rules are grown and pruned by
sequential covering, where each step aggregates labelled rows into counts per (feature, bin, label): at most
features x bins numbers reach the driver, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import stored

MIN_WORDS = 50
FEATURES = ("n_words", "symbol_rate", "dup_line_rate", "repeat_rate", "mean_word", "upper_rate", "line_words", "distinct_rate")
BINS = 24


def statistics(docs: DataFrame) -> DataFrame:
    """docs with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and the features of FEATURES.

    Words lie between ASCII white space; null and empty texts have none, and all counts 0. n_repeat_words: three-word
    windows are hashed, sorted with their places, and those equal to a neighbour are repeated; sorted places then give
    the number of words covered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    grams = F.when(n >= 3, F.zip_with(F.slice("_hash", 1, n - 2), F.zip_with(F.slice("_hash", 2, n - 2), F.slice("_hash", 3, n - 2), lambda b, c: F.xxhash64(b, c)), lambda a, bc: F.xxhash64(a, bc))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_grams", grams)
    sorted_ = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), sorted_))
    # Each sorted gram beside the one before it and the one after it.
    m = F.size("_sorted")
    none = F.struct(F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("int").alias("i"))
    before = F.concat(F.array(none), F.slice("_sorted", 1, m - 1))
    after = F.concat(F.slice("_sorted", 2, m - 1), F.array(none))
    same = F.filter(F.zip_with("_sorted", F.zip_with(before, after, lambda p, q: F.struct(p["g"].alias("p"), q["g"].alias("q"))), lambda x, n: F.struct(x["g"].alias("g"), x["i"].alias("i"), n["p"].alias("p"), n["q"].alias("q"))), lambda z: z["g"].eqNullSafe(z["p"]) | z["g"].eqNullSafe(z["q"]))
    rows = rows.withColumn("_at", F.when(m > 0, F.array_sort(F.transform(same, lambda z: z["i"]))))
    k = F.size("_at")
    gaps = F.zip_with(F.slice("_at", 2, k - 1), F.slice("_at", 1, k - 1), lambda later, earlier: F.least(later - earlier, F.lit(3)))
    covered = F.when(k > 0, F.aggregate(F.when(k > 1, gaps).otherwise(F.array().cast("array<int>")), F.lit(3), lambda t, g: t + g)).otherwise(0)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = rows.withColumn("_lines", lines)
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "_upper": F.length(bare) - F.length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    })
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    rows = rows.withColumns({
        "symbol_rate": rate("n_symbols", F.col("n_words")),
        "dup_line_rate": rate("n_dup_lines", F.size("_lines")),
        "repeat_rate": rate("n_repeat_words", F.col("n_words")),
        "mean_word": rate("word_chars", F.col("n_words")),
        "upper_rate": rate("_upper", F.col("word_chars")),
        "line_words": rate("n_words", F.size("_lines")),
        "distinct_rate": F.coalesce(F.try_divide(F.size(F.array_distinct("_hash")).cast("double"), F.col("n_words")), F.lit(1.0)),
    })
    return rows.drop("_words", "_hash", "_grams", "_sorted", "_at", "_lines", "_upper")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    conditions: list[Condition]
    precision: float = 0.0
    covered: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in order: the first that holds rejects the row; a row for which none holds is kept."""

    rules: list[Rule] = field(default_factory=list)

    def first_rule(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        return F.coalesce(*[F.when(r.column(), i) for i, r in enumerate(self.rules, 1)], F.lit(None).cast("int")) if self.rules else F.lit(None).cast("int")

    def keeps(self) -> Column:
        return self.first_rule().isNull()

    def __str__(self) -> str:
        return "\n".join([f"{i}. reject if {r} (precision {r.precision:.3f} on {r.covered} held-out rows)" for i, r in enumerate(self.rules, 1)] + ["else keep"])


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, bins: int = BINS, most_rules: int = 6, most_conditions: int = 3, least_precision: float = 0.9, least_rows: int = 5) -> DecisionList:
    """A decision list for the rows of labelled (features, doc_id, bad 0/1) with bad = 1.

    Two thirds of the rows (by hash) grow a rule, one third prunes it: a rule takes the condition of most FOIL gain
    until it covers no good rows, then drops last conditions while (p - n) / (p + n) of the others doesn't fall. Rows
    that a rule covers leave before the next one. A rule that isn't precise enough on the pruning rows ends the list.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))
    rows = labelled.select("bad", (part == 0).alias("prune"), *features).where("bad is not null")
    cuts = dict(zip(features, rows.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.001)))
    cuts = {f: sorted(set(v)) for f, v in cuts.items()}
    found = DecisionList()
    binned = F.array(*[F.struct(F.lit(f).alias("feature"), sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("bin")) for f in features])

    def counts(where: DataFrame) -> dict[str, list[tuple[int, int]]]:
        """(bad, good) rows per bin of each feature."""
        out = {f: [(0, 0)] * (len(cuts[f]) + 1) for f in features}
        for r in where.select("bad", F.explode(binned).alias("x")).groupBy("x.feature", "x.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect():
            out[r["feature"]][r["bin"]] = (r["p"], r["n"] - r["p"])
        return out

    left = rows
    while len(found.rules) < most_rules:
        grow, prune = left.where("not prune"), left.where("prune")
        conditions: list[Condition] = []
        covered = grow
        while len(conditions) < most_conditions:
            table = counts(covered)
            p0, n0 = (sum(x[i] for x in table[features[0]]) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f in features:
                p = n = 0
                for i, c in enumerate(cuts[f]):
                    p, n = p + table[f][i][0], n + table[f][i][1]
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if a >= least_rows:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, above, c))
            if best[1] is None:
                break
            conditions.append(best[1])
            covered = covered.where(best[1].column())
        if not conditions:
            break
        tests = [F.struct(F.sum(F.when(Rule(conditions[:i]).column(), F.col("bad"))).alias("p"), F.count(F.when(Rule(conditions[:i]).column(), 1)).alias("all")).alias(f"r{i}") for i in range(1, len(conditions) + 1)]
        row = prune.agg(*tests).first()
        worth = lambda x: (2 * (x["p"] or 0) - x["all"]) / x["all"] if x["all"] else -1.0
        size = max(range(1, len(conditions) + 1), key=lambda i: (worth(row[f"r{i}"]), -i))
        rule, x = Rule(conditions[:size]), row[f"r{size}"]
        rule.precision, rule.covered = (x["p"] or 0) / x["all"] if x["all"] else 0.0, x["all"]
        if rule.precision < least_precision or rule.covered < 3:
            break
        found.rules.append(rule)
        left = left.where(~rule.column())
    return found


def judged(docs: DataFrame, labels: DataFrame, **settings) -> tuple[DataFrame, DecisionList]:
    """Per row of docs (doc_id, text): statistics, features, base_failed, rule, kept; and the list learned from labels.

    labels: doc_id, quality (1 good, 0 bad, null unused); no labels, or none bad: no rules. Rows that the base rules
    reject take no part in learning.
    """
    stats, _ = stored(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    labelled, _ = stored(stats.where(~base_failed()).join(marks, "doc_id").select("doc_id", "bad", *FEATURES), "labelled")
    rules = learn(labelled, **settings)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.first_rule())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    out, _ = judged(docs, labels, **settings)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
