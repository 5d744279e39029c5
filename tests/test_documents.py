"""JSON documents: fields without a value are left out."""

import datetime as dt
import json

from almanac.operators.serve import collapse
from almanac.plans import briefing, documents

SCHEMA = "id string, name string, description string, date date, start_time string, end_time string, venue_name string, town string, address string, category string, artists array<string>, status string, is_past boolean, price string, event_url string, visibility string, editor_pick boolean"


def event(**values):
    row = {"id": "1", "name": "Fair", "description": None, "date": dt.date(2024, 1, 15), "start_time": None, "end_time": None, "venue_name": "Hall", "town": "Arnold", "address": None, "category": "festival", "artists": None, "status": "confirmed", "is_past": False, "price": None, "event_url": None, "visibility": "public", "editor_pick": False}
    return tuple((row | values).values())


def test_event_document(spark):
    rows = [event(), event(id="2", price="Free", artists=["A"], status="tentative", start_time="19:00", end_time="20:00", address="1 Main St", description="D", event_url="")]
    one, two = (json.loads(r["document"]) for r in documents.event_documents(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect())
    assert not {"description", "offers", "performer", "endDate"} & set(one) and one["startDate"] == "2024-01-15" and one["eventStatus"].endswith("EventScheduled")
    assert two["offers"]["price"] == "0" and two["offers"]["url"].endswith("/events/fair-2024-01-15-arnold") and two["performer"] == [{"@type": "Person", "name": "A"}]
    assert two["location"]["address"]["streetAddress"] == "1 Main St" and two["endDate"] == "2024-01-15T20:00" and two["eventStatus"].endswith("EventPostponed")


def test_list_document(spark):
    rows = [event(id=str(k), start_time=f"{k % 24:02}:00") for k in range(60)] + [event(id="p", visibility="private")]
    found = json.loads(documents.list_document(spark.createDataFrame(rows, SCHEMA)).first()[0])
    assert found["numberOfItems"] == 60 and [x["position"] for x in found["itemListElement"]] == list(range(1, 51))
    none = json.loads(documents.list_document(spark.createDataFrame([], SCHEMA)).first()[0])
    assert none["numberOfItems"] == 0 and none["itemListElement"] == []


def test_static_documents(spark):
    faq = json.loads(documents.faq_document(spark.createDataFrame([(2, "b?", "B"), (1, "a?", "A")], "ord int, question string, answer string")).first()[0])
    assert [x["name"] for x in faq["mainEntity"]] == ["a?", "b?"]
    crumbs = json.loads(documents.breadcrumbs(spark.createDataFrame([("About", "/about")], "name string, path string")).first()["document"])
    assert [x["position"] for x in crumbs["itemListElement"]] == [1, 2]


def test_briefing(spark):
    rows = spark.createDataFrame([event(artists=[], price=""), event(id="2", date=dt.date(2024, 1, 16), editor_pick=True, artists=["x", "y"])], SCHEMA)
    lines = {r["block"]: r["lines"] for r in briefing.blocks(rows, dt.date(2024, 1, 15)).collect()}
    assert lines["today"] == "Fair at Hall (Arnold) — on 2024-01-15 — [festival] — Artists: "
    assert lines["upcoming"].endswith(f"— {briefing.PICK} — Artists: x, y")
    empty = {r["block"]: (r["n"], r["lines"]) for r in briefing.blocks(rows.limit(0), dt.date(2024, 1, 15)).collect()}
    assert empty == {"today": (0, "No events today."), "upcoming": (0, "No events listed for the rest of the week.")}


def test_collapse(spark):
    rows = [event(id="1", name="Fair - Day 1", artists=None), event(id="2", name="Fair - Day 2", date=dt.date(2024, 1, 16), artists=["b", "a"]), event(id="3", name="Fair (Opening Day)", date=dt.date(2024, 1, 14), artists=["a", "c"]), event(id="4", name="Solo - Day 1", artists=[])]
    got = {r["name"]: r for r in collapse(spark.createDataFrame(rows, SCHEMA)).collect()}
    fair = got["Fair"]
    assert (fair["id"], fair["end_date"], fair["day_count"], fair["is_collapsed"], fair["artists"]) == ("3", dt.date(2024, 1, 16), 3, True, ["a", "c", "b"])
    assert got["Solo - Day 1"]["is_collapsed"] is None and got["Solo - Day 1"]["artists"] == []
