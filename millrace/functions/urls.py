"""URLs as column expressions: parts, normal form, crawler traps, URL rules of classification, resolution."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.lazy import pandas_udf
from millrace.settings import DEFAULT, Settings

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, k)


def scheme(url: Column) -> Column:
    return _part(url, 1)


def netloc(url: Column) -> Column:
    """Host with port and user, as written."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def domain(url: Column, without: str = "") -> Column:
    """What stands between the second and third slash if there is '://', else `without` (F2)."""
    return F.when(F.contains(url, F.lit("://")), F.coalesce(F.get(F.split(url, "/"), F.lit(2)), F.lit(""))).otherwise(F.lit(without))


def _decoded(s: Column) -> Column:
    plain = F.replace(s, F.lit("+"), F.lit(" "))
    return F.when(F.contains(s, F.lit("%")), F.coalesce(F.try_url_decode(s), plain)).otherwise(plain)


def _encoded(s: Column) -> Column:
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def params(url: Column) -> Column:
    """Query parameters with a value, decoded, in order: array of (k, v)."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.length(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)) > 0)
    return F.transform(pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))


def path_depth(url: Column) -> Column:
    """Segments that are not empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def normalize(url: Column, settings: Settings = DEFAULT) -> Column:
    """Normal form of a URL (F1)."""
    kept = F.array_sort(F.filter(params(url), lambda p: ~F.lower(p["k"]).isin(*settings.tracking_params)))
    line = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    # Each prefix may be there once, in this order; nested conditions would name the path 27 times.
    p = F.regexp_replace(path(url), "^" + "".join(f"(?:{re.escape(x)})?" for x in settings.path_prefixes), "")
    p = F.regexp_replace(p, "/+$", "")
    p = F.when(p == "", "/").when((netloc(url) != "") & ~F.startswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(p)
    head = F.concat(F.when(scheme(url) != "", F.concat(F.lower(scheme(url)), F.lit(":"))).otherwise(""), F.when(netloc(url) != "", F.concat(F.lit("//"), F.lower(netloc(url)))).otherwise(""))
    return F.concat(head, p, F.when(line != "", F.concat(F.lit("?"), line)).otherwise(""))


def trap_reason(url: Column, settings: Settings = DEFAULT) -> Column:
    """Why a URL is a crawler trap, or null; the first rule that holds."""
    p, ps = path(url), params(url)
    keys = F.transform(ps, lambda x: x["k"])

    def over(digits: Column, most: int) -> Column:
        short = F.regexp_replace(digits, "^0+", "")  # of any length: numbers are not cut to a type's range
        return F.coalesce((F.length(short) > 9) | (short.try_cast("int") > most), F.lit(False))

    page = F.regexp_extract(p, r"(?i)/page/(\d+)", 1)
    asked = F.regexp_extract(F.trim(F.get(F.filter(ps, lambda x: x["k"] == "page"), F.lit(0))["v"]), r"^\+?(\d+)$", 1)
    archive = p.rlike(r"(?i)/archive/\d{4}/\d{2}")
    return (
        F.when(over(page, settings.max_pagination), "pagination_depth_too_high")
        .when(over(asked, settings.max_pagination), "pagination_depth_too_high")
        .when(archive & over(page, 1), "calendar_archive_trap")
        .when(archive & p.rlike(r"/page/\d{3,}"), "pagination_depth_too_high")
        .when(p.rlike(r"(?i)/comment-page-\d+"), "comment_pagination_trap")
        .when(F.exists(keys, lambda k: F.lower(k).isin(*settings.filter_params)), "filter_url_trap")
        .when(F.size(F.array_distinct(keys)) > settings.max_query_params, "filter_url_trap")
        .when(path_depth(url) > settings.max_path_depth, "path_too_deep")
    )


def trap(url: Column, settings: Settings = DEFAULT) -> Column:
    """(crawl_decision, reason)."""
    reason = trap_reason(url, settings)
    return F.struct(F.when(reason.isNull(), "crawl").otherwise("skip").alias("crawl_decision"), reason.alias("reason"))


def url_skip(url: Column, settings: Settings = DEFAULT) -> Column:
    """(confidence, reason) if a URL alone says that a page is not an article, else null."""
    p, q = F.lower(path(url)), F.lower(query(url))
    full = F.concat(p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    said = lambda c, r: F.struct(F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    rules = F.when(p.isin("", "/"), said(0.95, "homepage"))
    for pattern, reason in settings.skip_url_rules:
        rules = rules.when(full.rlike(pattern), said(0.92, f"url_pattern:{reason}"))
    return rules.when(F.contains(full, F.lit("?q=")) | F.contains(full, F.lit("search?")), said(0.90, "url_pattern:search_page"))


def url_boost(url: Column, settings: Settings = DEFAULT) -> Column:
    """The page type that a URL suggests, or null (C4)."""
    p = F.lower(path(url))
    rules = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, kind in settings.boost_url_rules:
        rules = rules.when(p.rlike(pattern), kind)
    return rules


@pandas_udf("string")
def resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A link against its base, by RFC 3986."""
    from urllib.parse import urljoin

    for base, link in parts:
        out = []
        for b, h in zip(base, link, strict=True):
            try:
                out.append(urljoin(b, h) if b is not None and h is not None else None)
            except ValueError:
                out.append(None)
        yield pd.Series(out, dtype=object)
