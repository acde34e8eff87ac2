"""Freshness and recrawl times; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.settings import DEFAULT, Settings


def published(date: Column) -> Column:
    """The first 19 characters as a date or a time, in UTC, or null."""
    s = F.substring(date, 1, 19)
    forms = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in forms))


def freshness(date: Column, as_of: Column) -> Column:
    """By age in whole days; .2 without a date, .3 with one that cannot be read."""
    at = published(date)
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)
    aged = F.when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.6).when(days <= 365, 0.4).otherwise(0.2)
    return F.when(F.coalesce(date, F.lit("")) == "", 0.2).when(at.isNull(), 0.3).otherwise(aged)


def base_ttl(page_type: Column, settings: Settings = DEFAULT) -> Column:
    """Hours until a recrawl by page type."""
    found = F.lit(settings.ttl_hours["other"])
    for kind, hours in settings.ttl_hours.items():
        found = F.when(page_type == kind, hours).otherwise(found)
    return found


def next_ttl(page_type: Column, changed: Column, current: Column | None = None, settings: Settings = DEFAULT) -> Column:
    """Half the hours, 6 at least, after a change; else half as many again, 720 at most."""
    base = base_ttl(page_type, settings)
    if current is not None:
        base = F.coalesce(F.nullif(current, F.lit(0)), base)
    return F.when(changed, F.greatest(F.lit(settings.min_ttl_hours), F.floor(base * 0.5).cast("int"))).otherwise(F.least(F.lit(settings.max_ttl_hours), F.floor(base * 1.5).cast("int")))


def ttl_reason(changed: Column) -> Column:
    return F.when(changed, "content_changed_ttl_halved").otherwise("content_unchanged_ttl_extended")


def next_recrawl(as_of: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, as_of)


def backoff_seconds(attempt: Column, base: float = 1.5) -> Column:
    """Wait before a retry, without the random part."""
    return F.pow(F.lit(base), attempt)
