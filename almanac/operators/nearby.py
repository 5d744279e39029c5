"""Places within a distance of each other, by a join on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: A cell with more places than this is split; so at most one cell for each so many places is broadcast.
CELL_ROWS = 100_000


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres between two places in degrees, by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    x = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), x)))


class Grid:
    """Bands of latitude as high as the distance, cut into cells about as wide; bands nearer a pole have fewer."""

    def __init__(self, km: float):
        if not 0 < km < math.pi * EARTH_KM / 2:
            raise ValueError("km must be above 0 and below a quarter of the circumference")
        self.reach = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
        self.bands = max(1, math.floor(180 / self.reach))
        self.high = 180 / self.bands

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.high), F.lit(self.bands - 1)).cast("long")

    def cells(self, band: Column) -> Column:
        """How many cells the band has: by its edge farther from the equator, at least one."""
        south = band * self.high - 90
        edge = F.greatest(F.abs(south), F.abs(south + self.high))
        return F.greatest(F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / self.high), F.lit(1)).cast("long")

    def column(self, lng: Column, cells: Column) -> Column:
        """The cell that lng would be in, counted on beyond the date line."""
        return F.floor((lng + 180) * cells / 360).cast("long")

    def of(self, rows: DataFrame, lat: str, lng: str) -> DataFrame:
        """rows with the one cell, _band and _cell, that each lies in."""
        band = self.band(F.col(lat))
        return rows.withColumn("_band", band).withColumn("_cell", F.pmod(self.column(F.col(lng), self.cells(F.col("_band"))), self.cells(F.col("_band"))))

    def around(self, rows: DataFrame, lat: str, lng: str) -> DataFrame:
        """rows once for each cell, _band and _cell, with places within reach: about nine, each once."""
        up, down = self.band(F.least(F.col(lat) + self.reach, F.lit(90.0))), self.band(F.greatest(F.col(lat) - self.reach, F.lit(-90.0)))
        wide = F.when(F.abs(F.col(lat)) + self.reach < 90, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(self.reach))) / F.cos(F.radians(F.col(lat))))))).otherwise(180.0) + 1e-9
        rows = rows.withColumn("_wide", wide).withColumn("_band", F.explode(F.sequence(down, up))).withColumn("_cells", self.cells(F.col("_band")))
        west, east = self.column(F.col(lng) - F.col("_wide"), F.col("_cells")), self.column(F.col(lng) + F.col("_wide"), F.col("_cells"))
        rows = rows.withColumn("_cell", F.explode(F.sequence(west, F.least(east, west + F.col("_cells") - 1))))
        return rows.withColumn("_cell", F.pmod("_cell", F.col("_cells"))).drop("_wide", "_cells")


def within(asks: DataFrame, places: DataFrame, km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(ask, place, km): each ask with each place at most km away, as structs of their rows.

    An ask goes to the cells around it and a place to its own, so they meet by
    an equal key and a pair is found once. Asks should be the smaller side. Cells with many places are split,
    each ask then meets each part. Beyond the date line and at the poles the
    neighbours are right too. Rows without a place, or not on the globe, find nothing.
    """
    grid = Grid(km)

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)
        rows = df.select(F.col(lat).cast("double").alias(f"_{name}_lat"), F.col(lng).cast("double").alias(f"_{name}_lng"), whole)
        return rows.where(F.col(f"_{name}_lat").between(-90, 90) & F.col(f"_{name}_lng").between(-180, 180))

    a, p = grid.around(side(asks, "ask"), "_ask_lat", "_ask_lng"), grid.of(side(places, "place"), "_place_lat", "_place_lng")
    cell = ["_band", "_cell"]
    hot = p.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    p = p.join(F.broadcast(hot), cell, "left").withColumn("_part", F.pmod(F.xxhash64("place"), parts)).drop("_parts")
    a = a.join(F.broadcast(hot), cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    far = great_circle(F.col("_ask_lat"), F.col("_ask_lng"), F.col("_place_lat"), F.col("_place_lng"))
    return a.join(p, [*cell, "_part"]).withColumn("km", far).where(F.col("km") <= km).select("ask", "place", "km")


def nearest(asks: DataFrame, places: DataFrame, km: float, key: str, order: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(ask key, place, km): for each ask key the nearest place within km, of equally near ones that with the smallest order.

    Places should be the smaller side here: they go to the cells around them, and an
    ask to its own. Pairs carry the ask's key alone and are dealt by it before
    they are sorted, so no task sorts what its part of the asks gives.
    """
    few = asks.select(key, lat, lng)
    pairs = within(places, few, km, lat, lng).select(F.col(f"place.{key}").alias(key), F.struct("km", F.col(f"ask.{order}").alias("o")).alias("_k"), F.col("ask").alias("place"))
    best = pairs.repartition(key).groupBy(key).agg(F.min_by("place", "_k").alias("place"), F.min("_k").alias("_k"))
    return best.select(key, "place", F.col("_k.km").alias("km"))
