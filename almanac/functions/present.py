"""Columns for display: labels, date parts, images, addresses, relative ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import CATEGORY_COLORS, CATEGORY_IMAGES, CATEGORY_LABELS, IMAGE_RULES, ORG_LABELS
from .text import percent_encode, truthy


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A constant map's value, null where the key is missing."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def category_label(category: Column) -> Column:
    return lookup(category, CATEGORY_LABELS)


def category_color(category: Column) -> Column:
    return lookup(category, CATEGORY_COLORS)


def org_label(org_slug: Column) -> Column:
    """The organisation's label, its slug where it has none."""
    return F.coalesce(lookup(org_slug, ORG_LABELS), org_slug)


def image(name: Column, venue: Column, category: Column, override: Column | None = None) -> Column:
    """The first rule that matches, then the category's image; an override wins."""
    text = {"name": F.lower(name), "venue_name": F.lower(venue)}
    rule = F.when(F.lit(False), F.lit(None).cast("string")) if override is None else F.when(truthy(override).isNotNull(), override)
    for column, words, only, path in IMAGE_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text[column], F.lit(w))
        rule = rule.when(hit if only is None else hit & (category == only), F.lit(path))
    return rule.otherwise(lookup(category, CATEGORY_IMAGES))


def group_label(date: Column, as_of: Column) -> Column:
    """Today, Tomorrow, a weekday of the same week (from Sunday), or the full date."""
    day = F.date_format(date, "MMMM d")
    week = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    return (
        F.when(date == as_of, F.concat(F.lit("Today — "), day))
        .when(date == F.date_add(as_of, 1), F.concat(F.lit("Tomorrow — "), day))
        .when(week(date) == week(as_of), F.concat(F.lit("This "), F.date_format(date, "EEEE"), F.lit(" — "), day))
        .otherwise(F.date_format(date, "EEEE, MMMM d, yyyy"))
    )


def date_badge(start: Column, end: Column) -> Column:
    """'MMM d' or, with an end, 'MMM d–d' and 'MMM d–MMM d' across months (the year doesn't count)."""
    last = F.when(F.date_format(start, "MMM") == F.date_format(end, "MMM"), F.date_format(end, "d")).otherwise(F.date_format(end, "MMM d"))
    return F.concat(F.date_format(start, "MMM d"), F.coalesce(F.concat(F.lit("–"), last), F.lit("")))


def directions(address: Column, venue: Column, town: Column) -> Column:
    return percent_encode(F.concat(F.coalesce(truthy(address), venue), F.lit(", "), town, F.lit(", CA")))


def feet(elevation: Column) -> Column:
    return F.concat(F.format_number(elevation, 0), F.lit(" ft"))


def events_word(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " event").otherwise(" events"))


def iso_time(date: Column, time: Column) -> Column:
    """The date, and the time after a T where there is one."""
    return F.concat(date, F.coalesce(F.concat(F.lit("T"), truthy(time)), F.lit("")))


def relative_age(seconds: Column) -> Column:
    """An age in words, by the public thresholds of the usual date library (30 s, 44.5 min, 89.5 min, 24 h, 42 h, 30 d, …)."""
    minutes = F.round(seconds / 60).cast("long")
    hours, days, months = F.round(minutes / 60).cast("long"), F.round(minutes / 1440).cast("long"), F.round(minutes / 43200).cast("long")
    plural = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    return (
        F.when(seconds < 30, F.lit("less than a minute ago"))
        .when(minutes < 45, plural(minutes, "minute"))
        .when(minutes < 90, F.lit("about 1 hour ago"))
        .when(minutes < 1440, F.concat(F.lit("about "), plural(hours, "hour")))
        .when(minutes < 2520, F.lit("1 day ago"))
        .when(minutes < 43200, plural(days, "day"))
        .when(minutes < 86400, F.concat(F.lit("about "), plural(months, "month")))
        .otherwise(plural(months, "month"))
    )
