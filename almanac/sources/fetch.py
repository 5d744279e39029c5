"""Pages over HTTP: a data source for a registry of sites, and a fetch of a table of URLs.

Each page has a time limit and is tried again after failures that may pass
(time-outs, broken connections, busy or failing servers). A page that can't be
had is a row with its error. A site that fails several times running is left
alone for the rest of the task: its other pages get the last error at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..shipping import ship

#: The time limit of a page in seconds; tries, seconds before the second one (doubled each time), failures running after which a site is down.
TIMEOUT, TRIES, PAUSE, DOWN = 30.0, 3, 0.5, 3
#: Bytes of a page beyond which it counts as failed.
LARGEST = 16_000_000
#: What a page came to.
PAGE = "html string, error string, tries int"


class Lasting(Exception):
    """A failure that another try would meet again."""


def http_get(url: str, timeout: float = TIMEOUT) -> str:
    """The body of a page as text; Lasting where the server says so for good."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "almanac"}), timeout=timeout) as reply:
            body = reply.read(LARGEST + 1)
            if len(body) > LARGEST:
                raise Lasting(f"more than {LARGEST} bytes")
            return body.decode(reply.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code in (408, 425, 429) or e.code >= 500:
            raise
        raise Lasting(f"HTTP {e.code}") from None
    except ValueError as e:  # no URL at all
        raise Lasting(str(e)) from None


class Fetcher:
    """Fetches one page after another; keeps only each site's failures running and last error."""

    def __init__(self, get: Callable[..., str | None], tries: int = TRIES, pause: float = PAUSE, down: int = DOWN):
        self.get, self.tries, self.pause, self.down = get, tries, pause, down
        self.failed: dict[str | None, tuple[int, str]] = {}

    def __call__(self, site: str | None, *args) -> tuple[str | None, str | None, int]:
        """(html, error, tries) of a page of the site; args go to get()."""
        running, error = self.failed.get(site, (0, ""))
        if running >= self.down:
            return None, error, 0
        for n in range(1, self.tries + 1):
            try:
                html = self.get(*args)
                self.failed.pop(site, None)
                return html, None, n
            except Lasting as e:  # the site itself answers
                self.failed.pop(site, None)
                return None, str(e), n
            except Exception as e:  # whatever a site does, its row says so
                error = f"{type(e).__name__}: {e}"
                if n < self.tries:
                    time.sleep(self.pause * 2 ** (n - 1))
        self.failed[site] = (running + 1, error)
        return None, error, self.tries


def fetch_pages(rows: DataFrame, site: str, args: list[str], get: Callable[..., str | None] = http_get, tries: int = TRIES, pause: float = PAUSE, down: int = DOWN) -> DataFrame:
    """rows with html, error and tries (0: not tried, as the site is down). get(*args) is called with the columns `args` of each row.

    A site's pages are spread over tasks, and each task finds out by itself
    that a site is down. Columns html, error and tries that rows have are replaced.
    """
    ship(rows.sparkSession)
    rows = rows.drop("error", "tries").repartition(site, F.pmod(F.xxhash64(*args), F.lit(8)))

    def run(batches):
        fetch = Fetcher(get, tries, pause, down)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # so few pages are held at once
                part = batch.slice(k, 64)
                found = [fetch(s, *own) for s, *own in zip(*(part[c].to_pylist() for c in (site, *args)))]
                new = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *new], names=[*names, "html", "error", "tries"])

    names = [c for c in rows.columns if c != "html"]
    out = StructType([*(rows.schema[c] for c in names), StructField("html", StringType()), StructField("error", StringType()), StructField("tries", IntegerType())])
    return rows.mapInArrow(run, out)


def site_outcomes(fetched: DataFrame, site: str) -> DataFrame:
    """Per site: pages, failed ones, those that took more than one try, and one of the errors."""
    again = F.count(F.when(F.col("error").isNull() & (F.col("tries") > 1), 1))
    return fetched.groupBy(site).agg(F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed"), again.alias("retried"), F.min("error").alias("error"))


class _Site(InputPartition):
    def __init__(self, slug: str, urls: list[str]):
        self.slug, self.urls = slug, urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sites = json.loads(options["sites"])
        self.settings = {"timeout": float(options.get("timeout", TIMEOUT)), "tries": int(options.get("tries", TRIES)), "pause": float(options.get("pause", PAUSE)), "down": int(options.get("down", DOWN))}

    def partitions(self) -> list[InputPartition]:
        return [_Site(slug, urls) for slug, urls in self.sites]

    def read(self, partition: _Site) -> Iterator[tuple]:
        own = dict(self.settings)
        timeout = own.pop("timeout")
        fetch = Fetcher(lambda url: http_get(url, timeout), **own)
        for url in partition.urls:
            yield (partition.slug, url, *fetch(partition.slug, url))


class SitePages(DataSource):
    """spark.read.format("site_pages"): the pages of the sites of a registry, a partition for each site, so no site's failure stops another's.

    Options: sites (JSON: [[slug, [url, …]], …]; a registry, so of a size for the
    driver: a table of URLs goes through fetch_pages), timeout, tries, pause, down.
    """

    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return f"source_slug string, url string, {PAGE}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def site_pages(spark: SparkSession, sites: list[tuple[str, list[str]]], **settings) -> DataFrame:
    """(source_slug, url, html, error, tries) of the sites' pages."""
    ship(spark)
    spark.dataSource.register(SitePages)
    return spark.read.format("site_pages").option("sites", json.dumps(sites)).options(**settings).load()
