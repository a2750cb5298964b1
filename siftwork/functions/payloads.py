"""Answers of outside services, given as JSON, and what is rendered for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAILY_BLOCK_S, MINUTE_BLOCK_S = 3600.0, 60.0
_ERROR = "struct<error:struct<details:array<struct<violations:array<struct<quotaId:string>>,retryDelay:string>>>>"
_ANSWER = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>>"


def quota(body: Column) -> Column:
    """struct<daily, delay> of an error answer: whether a daily quota is used up, and how many seconds to wait.

    The last delay given counts; without one, or without JSON, an hour for a daily quota and a minute else.
    """
    details = F.coalesce(F.from_json(body, _ERROR)["error"]["details"], F.array().cast("array<struct<violations:array<struct<quotaId:string>>,retryDelay:string>>"))
    ids = F.flatten(F.transform(details, lambda d: F.coalesce(F.transform(d["violations"], lambda v: F.lower(v["quotaId"])), F.array().cast("array<string>"))))
    daily = F.exists(ids, lambda i: F.coalesce(F.contains(i, F.lit("perday")), F.lit(False)))
    delays = F.array_compact(F.transform(details, lambda d: F.regexp_extract(d["retryDelay"], r"^([0-9.]+)s$", 1).try_cast("double")))
    delay = F.when(F.size(delays) > 0, F.element_at(delays, -1)).otherwise(F.when(daily, DAILY_BLOCK_S).otherwise(MINUTE_BLOCK_S))
    return F.struct(daily.alias("daily"), delay.alias("delay"))


def answer_text(body: Column) -> Column:
    """The text parts of the first candidate, one behind the other, without those that are thoughts."""
    parts = F.coalesce(F.get(F.from_json(body, _ANSWER)["candidates"], F.lit(0))["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>"))
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].isNotNull()), lambda p: p["text"]), "")


def catalogue(names: Column, between: str = "; ") -> Column:
    """Distinct names in the order given, without blanks."""
    return F.array_join(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")), between)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def merged(body: Column, put: dict[str, Column], drop: tuple[str, ...] = (), skip_nulls: bool = False) -> Column:
    """A JSON object with some keys put and some dropped, the others and their order as they were; values keep their JSON types.

    put: key to JSON text (to_json() of a struct, "12", '"x"'). A key that is there keeps its place, new ones follow in order;
    null is JSON's null, or, with skip_nulls, no change. What is no object, null included, counts as an empty one.
    """
    fields = F.try_parse_json(body).try_cast("map<string,variant>")
    old = F.when(fields.isNotNull(), F.json_object_keys(body))
    old = F.array_distinct(F.coalesce(old, F.array().cast("array<string>")))
    new = F.create_map(*[x for k, v in put.items() for x in (F.lit(k), F.coalesce(v, F.lit(None if skip_nulls else "null")))]) if put else F.create_map().cast("map<string,string>")
    changed = F.map_filter(new, lambda k, v: v.isNotNull())
    kept = F.filter(old, lambda k: ~k.isin(*drop)) if drop else old
    value = lambda k: F.coalesce(F.try_element_at(changed, k), F.to_json(F.try_element_at(fields, k)), F.lit("null"))
    keys = F.array_union(kept, F.map_keys(changed))
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), value(k))), ","), F.lit("}"))
