"""Fixed dimension tables and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import ORG, SOURCE, TOWN

# Towns from west to east, with their place in the filter's list.
TOWNS = [
    ("Angels Camp", 1300, "Gold Rush gateway town", "25 min down the hill", 38.0685, -120.5396, 0, 0),
    ("Murphys", 2100, "Wine country in the pines", "15 min down the hill", 38.1372, -120.4610, 1, 1),
    ("Avery", 2800, "Quiet stop on the way up", "5 min", 38.1860, -120.3870, 2, 3),
    ("White Pines", 3500, "Just below Arnold", "3 min", 38.1970, -120.3590, 3, 7),
    ("Arnold", 4000, "Heart of the corridor", "You're here", 38.2144, -120.3510, 4, 2),
    ("Dorrington", 4800, "Quiet mountain hamlet", "10 min up the hill", 38.2280, -120.2960, 5, 6),
    ("Camp Connell", 5000, "Deep in the pines", "15 min up the hill", 38.2340, -120.2750, 6, 4),
    ("Bear Valley", 7000, "Alpine resort at the summit", "30 min to the top", 38.2810, -120.0420, 7, 5),
]
# The towns in the order of the filter's list.
FILTER_TOWNS = ["Angels Camp", "Murphys", "Arnold", "Avery", "Camp Connell", "Bear Valley", "Dorrington", "White Pines"]
# Towns that the county-wide source may list.
CORRIDOR = ["angels camp", "murphys", "arnold", "avery", "camp connell", "dorrington", "white pines", "bear valley", "copperopolis", "san andreas", "valley springs", "west point", "mokelumne hill"]
# Organisations, in the order of their seeds.
ORGS = [
    ("bear-valley", "Bear Valley Mountain Resort"),
    ("camp-connell-general-store", "Camp Connell General Store"),
    ("lube-room", "The Lube Room Saloon"),
    ("branding-iron", "Branding Iron Saloon"),
    ("murphys-irish-pub", "Murphys Irish Pub"),
    ("mystic-saloon", "Howard's Mystic Saloon"),
    ("watering-hole", "The Watering Hole"),
    ("gocalaveras", "GoCalaveras"),
    ("visit-murphys", "Visit Murphys"),
]
# Sources in the order they run, with what an event without its own place gets.
SOURCES = [
    (0, "bear-valley", "Bear Valley Mountain Resort", "Bear Valley Mountain Resort", "Bear Valley", None, False),
    (1, "branding-iron", "Branding Iron Saloon", "Branding Iron Saloon", "Murphys", "75 Big Trees Rd, Murphys, CA 95247", False),
    (2, "camp-connell-general-store", "Camp Connell General Store", "Camp Connell General Store", "Camp Connell", "4036 Old Highway 4, Camp Connell, CA 95223", False),
    (3, "gocalaveras", "GoCalaveras", "Calaveras County", "Angels Camp", None, True),
    (4, "lube-room", "The Lube Room Saloon", "The Lube Room Saloon", "Dorrington", "3431 Highway 4, Dorrington, CA 95223", False),
    (5, "murphys-irish-pub", "Murphys Irish Pub", "Murphys Irish Pub", "Murphys", "415 Main St, Murphys, CA 95247", False),
    (6, "mystic-saloon", "Howard's Mystic Saloon", "Howard's Mystic Saloon", "Avery", "4529 Hwy 4, Avery, CA 95224", False),
    (7, "visit-murphys", "Visit Murphys", "Downtown Murphys", "Murphys", None, False),
    (8, "watering-hole", "The Watering Hole", "The Watering Hole", "Murphys", "223 Big Trees Rd, Murphys, CA 95247", False),
]
# Labels, images and colours.
CATEGORY_LABELS = {"live_music": "Live Music", "festival": "Festival", "civic": "Community", "resort": "Resort", "lodge": "Lodge", "other": "Other"}
ORG_LABELS = {"moose-lodge": "Moose Lodge", "sequoia-woods": "Sequoia Woods", "bear-valley": "Bear Valley", "watering-hole": "The Watering Hole", "gocalaveras": "GoCalaveras", "visit-murphys": "Visit Murphys"}
CATEGORY_COLORS = {"live_music": "#D4855C", "festival": "#8B9E7E", "civic": "#5A8FA8", "resort": "#A09484", "lodge": "#6B4226", "other": "#C4B8AA"}
CATEGORY_IMAGES = {c: f"/images/{c}.jpg" for c in CATEGORY_LABELS}
# Fixed values: (column, words of which it contains one, category it must have, image), the first match wins.
IMAGE_RULES = [
    ("venue_name", ("ironstone",), None, "/images/ironstone.jpg"),
    ("venue_name", ("bear valley",), None, "/images/bear_valley.jpg"),
    ("venue_name", ("sequoia woods",), None, "/images/sequoia_woods.jpg"),
    ("venue_name", ("moose lodge",), None, "/images/lodge.jpg"),
    ("venue_name", ("fairgrounds",), None, "/images/fairgrounds.jpg"),
    ("venue_name", ("watering hole",), None, "/images/brewery.svg"),
    ("name", ("car show", "classic car"), None, "/images/car_show.svg"),
    ("name", ("parade",), None, "/images/parade.svg"),
    ("venue_name", ("winery", "vineyard"), "live_music", "/images/wine_glasses.jpg"),
    ("venue_name", ("",), "live_music", "/images/acoustic_guitar.jpg"),
]
SITE_URL, SITE_NAME = "https://events.example", "Almanac"


def towns(spark: SparkSession) -> DataFrame:
    """Eight rows, small enough to broadcast."""
    return spark.createDataFrame(TOWNS, TOWN)


def orgs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"org-{k}", *o) for k, o in enumerate(ORGS, 1)], ORG)


def sources(spark: SparkSession, slug: str | None = None) -> DataFrame:
    """The registry in running order, or the one source named; an unknown name raises."""
    rows = [s for s in SOURCES if slug in (None, s[1])]
    if not rows:
        raise ValueError(f"unknown source {slug}")
    return spark.createDataFrame(rows, SOURCE)
