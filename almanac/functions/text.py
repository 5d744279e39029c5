"""Text functions with JavaScript's rules for white space, truth and matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript's white space, inside a character class.
WS = r"\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{WS}]+", ""), rf"[{WS}]+\z", "")


def truthy(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def slug(name: Column, date: Column, town: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, date, town))
    text = F.regexp_replace(text, rf"[^\w{WS}-]", "")
    text = F.regexp_replace(text, f"[{WS}]+", "-")
    return F.regexp_replace(F.regexp_replace(text, "-+", "-"), r"^-|-\z", "")


def dedup_key(name: Column, date: Column, town: Column) -> Column:
    key = F.concat(F.lower(js_trim(name)), F.lit("|"), date, F.lit("|"), F.lower(js_trim(town)))
    return F.substring(F.sha2(key, 256), 1, 32)


def series_key(name: Column) -> Column:
    """The name without ' - Day N', '(through …)' and '(Opening Day)' at its end, each once and in this order."""
    for pattern in (rf"[{WS}]*-[{WS}]*Day[{WS}]*\d+", rf"[{WS}]*\(through[^)]*\)", rf"[{WS}]*\(Opening Day\)"):
        name = F.regexp_replace(name, rf"(?i){pattern}\z", "")
    return js_trim(name)


def time_12h(time: Column) -> Column:
    """13:30 as 1:30 PM; null where the time is null, empty or has no minutes."""
    hour = F.try_to_number(F.regexp_extract(time, r"^\s*(\d{1,9})", 1), F.lit("999999999")).cast("int")
    minutes = F.get(F.split(time, ":"), F.lit(1))
    shown = F.when(hour > 12, hour - 12).when(hour == 0, 12).otherwise(hour)
    return F.when(truthy(time).isNotNull(), F.concat(shown.cast("string"), F.lit(":"), minutes, F.when(hour >= 12, " PM").otherwise(" AM")))


def time_range(start: Column, end: Column, separator: str) -> Column:
    """Null without a start, even where there is an end."""
    a, b = time_12h(start), time_12h(end)
    return F.when(a.isNotNull(), F.concat(a, F.coalesce(F.concat(F.lit(separator), b), F.lit(""))))


def percent_encode(text: Column) -> Column:
    """As encodeURIComponent does it."""
    text = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_fence(text: Column) -> Column:
    """Without a Markdown fence at the very beginning and the very end."""
    return F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\n?", ""), r"\n?```\z", "")


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n\n")
