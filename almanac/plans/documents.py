"""Published documents: event lists, single events, page metadata, sitemap, FAQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..dims import SITE_NAME, SITE_URL
from ..functions.present import iso_time
from ..functions.text import iso, truthy
from ..operators.serve import with_slug

SCHEMA = "https://schema.org"


def event_url(slug: Column, site: str = SITE_URL) -> Column:
    return F.concat(F.lit(f"{site}/events/"), slug)


def offer_price(price: Column) -> Column:
    return F.when(truthy(price).isNotNull(), F.when(price == "Free", "0").otherwise(price))


def event_status(status: Column) -> Column:
    return F.when(status == "tentative", f"{SCHEMA}/EventPostponed").otherwise(f"{SCHEMA}/EventScheduled")


def _ends(date: Column, end: Column) -> Column:
    return F.when(truthy(end).isNotNull(), F.concat(date, F.lit("T"), end))


def _typed(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *(c.alias(k) for k, c in fields.items()))


def _place(street: Column | None) -> Column:
    street = {} if street is None else {"streetAddress": street}
    return _typed("Place", name=F.col("venue_name"), address=_typed("PostalAddress", **street, addressLocality=F.col("town"), addressRegion=F.lit("CA"), addressCountry=F.lit("US")))


def list_items(events: DataFrame, limit: int = 50) -> DataFrame:
    """The list document's items as flat rows: the first `limit` public events and the number of all of them."""
    public = events.where(F.col("visibility") == "public")
    total = public.agg(F.count(F.lit(1)).alias("number_of_items"))
    key = [F.col("date"), F.col("start_time").asc_nulls_last(), F.col("id")]
    first = public.orderBy(*key).limit(limit)  # the limit is the document's own
    first = first.withColumn("position", F.row_number().over(W.orderBy(*key)).cast("long"))
    day = iso(F.col("date"))
    return with_slug(first).join(F.broadcast(total)).select(
        "position", "number_of_items", event_url(F.col("slug")).alias("url"), "name", iso_time(day, F.col("start_time")).alias("start_date"),
        _ends(day, F.col("end_time")).alias("end_date"), "venue_name", "town", truthy(F.col("description")).alias("description"), offer_price(F.col("price")).alias("price"),
        F.lit(f"{SCHEMA}/EventScheduled").alias("event_status"),
    )


def list_document(events: DataFrame, limit: int = 50) -> DataFrame:
    """One row with the list document as JSON; fields without a value are left out."""
    items = list_items(events, limit)
    offer = F.when(F.col("price").isNotNull(), _typed("Offer", price=F.col("price"), priceCurrency=F.lit("USD"), availability=F.lit(f"{SCHEMA}/InStock")))
    item = _typed("Event", name=F.col("name"), startDate=F.col("start_date"), endDate=F.col("end_date"), location=_place(None), description=F.col("description"), offers=offer, eventAttendanceMode=F.lit(f"{SCHEMA}/OfflineEventAttendanceMode"), eventStatus=F.col("event_status"))
    rows = items.select("position", "number_of_items", _typed("ListItem", position=F.col("position"), url=F.col("url"), item=item).alias("e"))
    listed = rows.agg(F.coalesce(F.max("number_of_items"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("position", "e"))).alias("all"))
    return listed.select(F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("ItemList").alias("@type"), F.lit("Upcoming events").alias("name"), F.col("n").alias("numberOfItems"), F.transform("all", lambda x: x["e"]).alias("itemListElement"))).alias("document"))


def event_fields(events: DataFrame) -> DataFrame:
    """The single-event document's values as flat rows."""
    day = iso(F.col("date"))
    return with_slug(events).select(
        "id", "slug", "name", truthy(F.col("description")).alias("description"), iso_time(day, F.col("start_time")).alias("start_date"), _ends(day, F.col("end_time")).alias("end_date"),
        "venue_name", truthy(F.col("address")).alias("street"), "town", offer_price(F.col("price")).alias("price"),
        F.when(offer_price(F.col("price")).isNotNull(), F.coalesce(truthy(F.col("event_url")), event_url(F.col("slug")))).alias("offer_url"),
        event_status(F.col("status")).alias("event_status"), F.when(F.size("artists") > 0, F.col("artists")).alias("performers"),
    )


def event_documents(events: DataFrame) -> DataFrame:
    """(id, slug, document): each event as JSON."""
    offer = F.when(F.col("price").isNotNull(), _typed("Offer", price=F.col("price"), priceCurrency=F.lit("USD"), availability=F.lit(f"{SCHEMA}/InStock"), url=F.col("offer_url")))
    body = F.struct(
        F.lit(SCHEMA).alias("@context"), F.lit("Event").alias("@type"), F.col("name"), F.col("description"), F.col("start_date").alias("startDate"), F.col("end_date").alias("endDate"),
        _place(F.col("street")).alias("location"), offer.alias("offers"), F.lit(f"{SCHEMA}/OfflineEventAttendanceMode").alias("eventAttendanceMode"), F.col("event_status").alias("eventStatus"),
        F.transform("performers", lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name"))).alias("performer"),
        _typed("Organization", name=F.lit(SITE_NAME), url=F.lit(SITE_URL)).alias("organizer"),
    )
    return event_fields(events).select("id", "slug", F.to_json(body).alias("document"))


# Fixed values of page metadata.
OG_TYPE, TWITTER_CARD, NOT_FOUND = "website", "summary", "Event Not Found"


def _described(events: DataFrame) -> DataFrame:
    day = F.date_format("date", "MMMM d, yyyy")
    said = F.concat("name", F.lit(" at "), "venue_name", F.lit(" in "), "town", F.lit(", CA on "), day, F.lit("."))
    return with_slug(events).select("id", "slug", "date", "start_time", F.concat("name", F.lit(" — "), day, F.lit(" in "), "town").alias("title"), F.coalesce(F.substring(truthy(F.col("description")), 1, 155), said).alias("description"))


def _cards(title: Column, description: Column, slug: Column) -> list[Column]:
    """Canonical path, and the same title and description as link previews take them."""
    return [
        F.concat(F.lit("/events/"), slug).alias("canonical"), event_url(slug).alias("url"), title.alias("og_title"), description.alias("og_description"), F.lit(OG_TYPE).alias("og_type"),
        F.lit(TWITTER_CARD).alias("twitter_card"), title.alias("twitter_title"), description.alias("twitter_description"),
    ]


def page_metadata(events: DataFrame) -> DataFrame:
    """(id, title, description, canonical, url, og_*, twitter_*) of each event's page."""
    return _described(events).select("id", "title", "description", *_cards(F.col("title"), F.col("description"), F.col("slug")))


def requested_metadata(requests: DataFrame, events: DataFrame) -> DataFrame:
    """(slug, title, description) of each request (slug): of the first event with that slug, else the not-found title alone."""
    first = F.struct(F.col("date"), F.coalesce("start_time", F.lit("~")), F.col("id"))
    pages = _described(events).groupBy("slug").agg(F.min_by(F.struct("title", "description"), first).alias("page"))
    return requests.join(pages, "slug", "left").select("slug", F.coalesce("page.title", F.lit(NOT_FOUND)).alias("title"), F.col("page.description").alias("description"))


def sitemap(spark: SparkSession, events: DataFrame, now: Column | None = None) -> DataFrame:
    """(section, url, change_frequency, priority, last_modified): the fixed pages, then a row for each event, equal slugs too; all are as of now."""
    # Fixed values.
    fixed = spark.createDataFrame([(0, SITE_URL, "daily", 1.0), (1, f"{SITE_URL}/about", "monthly", 0.7), (2, f"{SITE_URL}/faq", "monthly", 0.6)], "section int, url string, change_frequency string, priority double")
    rows = with_slug(events.select("id", "name", "date", "town")).select(F.lit(3).alias("section"), event_url(F.col("slug")).alias("url"), F.lit("weekly").alias("change_frequency"), F.lit(0.8).alias("priority"))
    return fixed.unionByName(rows).withColumn("last_modified", F.current_timestamp() if now is None else now)


def site_documents(sites: DataFrame) -> DataFrame:
    """(name, kind, document): a WebSite and an Organization document of each site (name, url, description, area)."""
    about = [F.col("name"), F.col("url"), F.col("description")]
    head = lambda kind: [F.lit(SCHEMA).alias("@context"), F.lit(kind).alias("@type"), *about]
    area = F.when(F.col("area").isNotNull(), _typed("Place", name=F.col("area")))
    kinds = F.create_map(F.lit("WebSite"), F.to_json(F.struct(*head("WebSite"))), F.lit("Organization"), F.to_json(F.struct(*head("Organization"), area.alias("areaServed"))))
    return sites.select("name", F.explode(kinds).alias("kind", "document"))


def faq_document(questions: DataFrame) -> DataFrame:
    """One row: questions (ord, question, answer) as a FAQ page in JSON."""
    entry = _typed("Question", name=F.col("question"), acceptedAnswer=_typed("Answer", text=F.col("answer")))
    rows = questions.agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("all"))
    return rows.select(F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("FAQPage").alias("@type"), F.transform("all", lambda x: x["e"]).alias("mainEntity"))).alias("document"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """One row for each page (name, path): its breadcrumb list in JSON."""
    crumb = lambda n, name, url: _typed("ListItem", position=F.lit(n), name=name, item=url)
    trail = F.array(crumb(1, F.lit("Home"), F.lit(SITE_URL)), crumb(2, F.col("name"), F.concat(F.lit(SITE_URL), F.col("path"))))
    return pages.select("path", F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("BreadcrumbList").alias("@type"), trail.alias("itemListElement"))).alias("document"))


def up_next(groups: DataFrame) -> DataFrame:
    """The first event of the first date group."""
    return groups.where(F.col("group_index") == 1).select("date", "first_id")

