"""Predicates: windows of days, quality rules, classifiers of tags and addresses.  Null is false throughout."""
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec"


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def after_within(day: Column, start: Column, days: int) -> Column:
    """In ``(start, start + days]``."""
    return known((day > start) & (day <= F.date_add(start, days)))


def before_within(day: Column, end: Column, days: int) -> Column:
    """In ``(end - days, end]``."""
    return known((day > F.date_sub(end, days)) & (day <= end))


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf"))


def skipped(tag: Column, title: Column, tags=(), titles=(), pattern: str | None = None) -> Column:
    """A tag that contains one of some words, a title among some, or one that a pattern finds."""
    out = F.lit(False)
    for t in tags:
        out = out | known(F.contains(F.lower(tag), F.lit(t.lower())))
    if titles:
        out = out | known(F.lower(F.trim(title)).isin(*[t.lower() for t in titles]))
    return out | known(title.rlike("(?i)" + pattern)) if pattern else out


def is_metadata(text: Column, indicators=("single", "album", "remix", "version", "live", "demo", "unreleased", "bonus")) -> Column:
    """Whether a bracketed text describes (dates, kinds) and doesn't name."""
    words = known(text.rlike(r"(?i)\b(?:" + "|".join(indicators) + r")\b"))
    return words | known(text.rlike(r"\b(?:19|20)\d{2}\b")) | known(text.rlike(rf"(?i)\b(?:{MONTHS})\b\.?\s+\d{{1,2}}\b"))


def over_floor(value: Column, metric: Column, floors: dict) -> Column:
    """Whether a magnitude is over its metric's floor (0 if it has none)."""
    floor = F.when(F.lit(False), 0.0)
    for k, v in floors.items():
        floor = floor.when(metric == k, float(v))
    return known(F.abs(value) > floor.otherwise(0.0))


def plausible_address(url: Column, title: Column, least_share: float = 0.5) -> Column:
    """Whether an address's last part has the title, or enough of its words."""
    slug = F.lower(F.regexp_replace(F.regexp_extract(url, r"/([^/]*)/?$", 1), r"[^A-Za-z0-9]+", " "))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " ")), " "), lambda w: w != "")
    shared = F.size(F.filter(words, lambda w: F.array_contains(F.split(slug, " "), w)))
    return known(F.contains(slug, F.array_join(words, " ")) | (shared >= least_share * F.size(words)))


def distinct_share_filter(words: Column, least: int = 6, distinct: int = 4, share: float = 0.5) -> Column:
    return (F.size(words) >= least) & (F.size(F.array_distinct(words)) >= distinct) & (F.size(F.array_distinct(words)) >= share * F.size(words))
