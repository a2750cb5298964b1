"""Claimed sources to outlets: many aliases searched in many names by joins, the registry, and the mode that follows.

Each alias is filed under its head, its first HEAD characters. Names are cut into all their runs of that length, and runs
that are a head are lengthened to the aliases' own lengths and joined by equality. So no name meets the list of aliases:
the work grows with the text of the different names, and joins choose their own form by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import urls

HEAD = 4
CLAIMED, VERIFIED = "CLAIMED_SOURCE", "VERIFIED_SOURCES"


def _head(text: Column, n: Column) -> Column:
    return F.left(text, F.least(F.lit(HEAD), n))


def alias_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, alias, place, domain, at) for every place (from 1) of names at which one of aliases stands.

    names: name; aliases: alias, place, domain. Both are compared as they are; empty and null ones match nothing.
    """
    filed = aliases.where("alias <> ''").withColumn("n", F.length("alias")).withColumn("head", _head(F.col("alias"), F.col("n")))
    heads = filed.groupBy("head").agg(F.collect_set("n").alias("sizes"))  # different lengths of the aliases of one head
    known = names.select("name").where("name <> ''").distinct()
    sizes = F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("name"))), lambda h: F.transform(F.sequence(F.lit(1), F.length("name") - h + 1), lambda at: F.struct(at.alias("at"), F.substr("name", at, h).alias("head"))))
    runs = known.select("name", F.explode(F.flatten(sizes)).alias("run")).select("name", "run.at", "run.head")
    grown = runs.join(heads, "head").select("name", "at", F.explode("sizes").alias("n")).where("at + n - 1 <= length(name)")
    grown = grown.withColumn("alias", F.substr("name", F.col("at"), F.col("n")))
    return grown.join(filed.select("alias", "place", "domain"), "alias").select("name", "alias", "place", "domain", "at")


def by_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, exact, prefix, within): the domain of the alias that is the name, of the first (by place) that begins it, and of
    the first that it holds; names without any alias are left out."""
    first = lambda test: F.min(F.when(test, F.struct("place", "alias", "domain")))["domain"]
    start = F.col("at") == 1
    found = alias_matches(names, aliases)
    return found.groupBy("name").agg(first(start & (F.col("alias") == F.col("name"))).alias("exact"), first(start).alias("prefix"), first(F.lit(True)).alias("within"))


def resolved(claims: DataFrame, name: str, aliases: DataFrame, registry: DataFrame) -> DataFrame:
    """claims with canonical and step: how a source name was recognised, null where it wasn't.

    In order: the host of a URL or domain; an alias that is the name, begins it, or stands in it (lower case); the canonical
    name of a registered source (lower case); an alias of an active one, as written. aliases: alias, place, domain;
    registry: canonical_name, aliases, is_active. Each different name is looked up once.
    """
    raw = F.trim(F.col(name))
    names = claims.select(raw.alias("_raw")).where("_raw <> ''").distinct().withColumn("_low", F.lower("_raw"))
    lower = aliases.select(F.lower("alias").alias("alias"), "place", "domain")
    known = by_alias(names.select(F.col("_low").alias("name")), lower).withColumnRenamed("name", "_low")
    listed = registry.select(F.col("canonical_name").alias("_low"), F.lit(True).alias("_listed")).distinct()
    also = registry.where("is_active").select(F.explode("aliases").alias("_raw"), "canonical_name").groupBy("_raw").agg(F.min("canonical_name").alias("_also"))
    rows = names.join(known, "_low", "left").join(listed, "_low", "left").join(also, "_raw", "left")
    steps = [("domain", urls.host(F.col("_raw"))), ("exact", F.col("exact")), ("prefix", F.col("prefix")), ("within", F.col("within")), ("registered", F.when(F.col("_listed"), F.col("_low"))), ("alias", F.col("_also"))]
    found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("canonical"), F.lit(k).alias("step"))) for k, v in steps])
    answers = rows.select("_raw", found.alias("_found"))
    out = claims.withColumn("_raw", raw).join(answers, "_raw", "left")
    return out.select(*claims.columns, F.col("_found.canonical").alias("canonical"), F.col("_found.step").alias("step"))


def with_mode(rows: DataFrame, name: str, registry: DataFrame, detected: bool = False) -> DataFrame:
    """resolved() rows with mode and reason, and canonical only where the claimed source is to be searched.

    No name: SOURCE_NOT_SUPPLIED, or SOURCE_NOT_DETECTED where names are read off cards; a name that nothing recognises:
    SOURCE_UNRECOGNIZED; a registered source that is not active: SOURCE_INACTIVE. All these search the verified sources.
    """
    state = registry.groupBy(F.col("canonical_name").alias("canonical")).agg(F.bool_or("is_active").alias("_active"))
    blank = F.coalesce(F.trim(name) == "", F.lit(True))
    reason = (
        F.when(blank, "SOURCE_NOT_DETECTED" if detected else "SOURCE_NOT_SUPPLIED")
        .when(F.col("canonical").isNull(), "SOURCE_UNRECOGNIZED")
        .when(F.coalesce(~F.col("_active"), F.lit(False)), "SOURCE_INACTIVE")
        .otherwise("SOURCE_DETECTED" if detected else "SOURCE_SELECTED")
    )
    out = rows.join(state, "canonical", "left").withColumn("reason", reason)
    claimed = F.col("reason").isin("SOURCE_DETECTED", "SOURCE_SELECTED")
    return out.select(*[F.when(claimed, F.col(c)).alias(c) if c in ("canonical", "step") else c for c in rows.columns], F.when(claimed, CLAIMED).otherwise(VERIFIED).alias("mode"), "reason")
