"""Hosts, canonical forms and article heuristics of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters dropped from canonical URLs; addresses that are no articles.
DROPPED = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "source", "from", "_ga", "cid")
NO_ARTICLE = r"(?i)/tags?/|/author/|/category/|/categories/|/feed|\.rss$|\.xml$|\.atom$|/amp/$|\?s=|#comments$|google\.com/search|/search\?[^/]*$|/archive/?$|/archive/\d{4}-\d{2}-\d{2}/?$|/epaper"
DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"


def host(url: Column) -> Column:
    """The host in lower case without www., scheme and port; null if it isn't a domain."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*", 0), r"^.*@|:[0-9]*$", ""), r"^www\.", "")
    return F.when(name.rlike(DOMAIN), name)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """https, lower-case host, no /amp, closing slash, fragment or dropped parameters; the others sorted."""
    place = F.regexp_replace(F.regexp_replace(path(url), "/amp/?$", ""), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]+=.+$") & ~F.lower(F.split(p, "=")[0]).isin(*DROPPED) & ~F.lower(p).startswith("__cf_")))
    netloc = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.concat(F.lit("https://"), netloc, F.when(place == "", "/").otherwise(place), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def unwrapped(url: Column) -> Column:
    """The target of a redirect that carries it as url=, without a closing /amp."""
    target = F.url_decode(F.regexp_extract(url, r"[?&]url=([^&#]+)", 1))
    return F.regexp_replace(F.when(url.rlike(r"^https?://(www\.)?google\.[a-z.]+/url\?") & (target != ""), target).otherwise(url), "/amp/?$", "")


def evidence_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(url), "/+$", ""))


def on_domain(name: Column, domains: Column) -> Column:
    """Whether a host is one of domains or below one."""
    return F.exists(domains, lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))


def probable_article(url: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether a URL looks like an article: a source's own pattern, a date in the path, or a segment like an id."""
    segment = lambda s: s.rlike(r"^[0-9]{4,}$|^[a-zA-Z]+-[0-9]{3,}$") | ((F.length(s) >= 8) & s.rlike("^[A-Za-z0-9]+$") & s.rlike("[0-9]"))
    own = url.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    return ~url.rlike(NO_ARTICLE) & (own | path(url).rlike(r"/\d{4}/\d{2}/\d{2}(/|$)") | F.exists(F.split(path(url), "/"), segment))
