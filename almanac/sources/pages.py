"""Page documents: text from HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """The text of a page by native expressions: scripts, styles, comments and tags go, common entities are decoded, blanks are folded."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", "\n"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, success, markdown): a page without HTML counts as not fetched."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.col("html").isNotNull().alias("success"), html_text(F.col("html")).alias("markdown"))
