"""A table with one row for each key, of which a change rewrites only the buckets that it touches.

    path/rows/bucket=7/version=3/…     the rows of bucket 7 since change 3
    path/heads/version=3/…             for each bucket the version to read

A bucket is a range of hashes of the key, so a change meets the table by a join
of the touched buckets alone. Files are never replaced in place: a change adds
folders and then, in one small file, the heads that point to them. Readers see
a change whole or not at all, a change that failed half-way can be made again,
and one that is made again after it succeeded does nothing. vacuum() deletes
what no recent head points to.

Within a bucket, rows are sorted by key and written with a Bloom filter of each
row group's keys, so a lookup reads the row groups that may hold its keys.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Keys of a batch lookup that are broadcast; more meet the table in a join by shuffle.
BROADCAST_KEYS = 1_000_000
#: Buckets of a new table; one should hold what a task reads well (some 100 MB), and their number bounds the heads.
BUCKETS = 64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where that is unset, only a local master gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="almanac-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/almanac-{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of their own, for steps that read them more than once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("int") % buckets).cast("int")


class KeyedTable:
    """The table under path. Rows with a null key are one key, as equal keys are. The first change fixes the number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType([f for f in schema.fields if f.name not in ("bucket", "version")])
        self.buckets = buckets
        heads = self._heads()
        if heads is not None and (row := heads.select("of").first()):
            self.buckets = row["of"]

    def _heads(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, at int, of int, version int").parquet(f"{self.path}/heads")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self, version: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version, or the one asked for, and the version of each bucket that has rows: a number for each of the table's buckets."""
        heads = self._heads()
        if heads is None:
            return -1, {}
        if version is not None:
            heads = heads.where(F.col("version") == version)
        row = heads.groupBy("version").agg(F.collect_list(F.struct("bucket", "at")).alias("all")).agg(F.max("version").alias("version"), F.max_by("all", "version").alias("all")).first()
        return (-1, {}) if row["version"] is None else (row["version"], {b: v for b, v in row["all"] if b >= 0})

    def version(self) -> int:
        """The newest version; -1 for a table without any."""
        return self._newest()[0]

    def _read(self, at: dict[int, int]) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
        if not at:
            return self.spark.createDataFrame([], full).drop("version")
        folders = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in sorted(at.items())]  # only these are listed and read
        return self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(*folders).drop("version")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, with their bucket, as of a version; the newest by default."""
        return self._read(self._newest(version)[1])

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.coalesce(F.col(self.key).cast("string"), F.lit("\0null")), self.buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows; at most as many as the table has."""
        return sorted(r["bucket"] for r in self.bucketed(rows).select("bucket").distinct().collect())

    def get(self, *values: str) -> DataFrame:
        """The rows of a few keys: of their buckets' files, the row groups whose bounds and Bloom filters admit one."""
        at = self._newest()[1]
        asked = self.spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("string") for v in values))).alias(self.key)) if values else None
        touched = set(self.touched(asked)) if values else set()
        return self._read({b: v for b, v in at.items() if b in touched}).where(F.col(self.key).isin(*values)).drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys (a column of the key's name, any others) with the table's columns, null where it has no such row.

        Only the buckets that a key falls in are read. Up to BROADCAST_KEYS keys
        are first broadcast to leave only wanted rows; with more, Spark can send a Bloom
        filter of the keys ahead of the shuffle (spark.sql.optimizer.runtime.bloomFilter).
        Repeated keys each get the row. Null keys find nothing. Keys are read
        several times, so they should be cheap to read.
        """
        keys = keys.select(*(F.col(c).alias(f"_asked_{c}") if c in self.schema.names and c != self.key else F.col(c) for c in keys.columns))
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        rows = self.read_touched(keys.where(F.col(self.key).isNotNull())).drop("bucket")
        if few:
            rows = rows.join(F.broadcast(keys.select(self.key).distinct()), self.key, "left_semi")
        else:
            rows = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        return keys.join(rows, self.key, "left")

    def read_touched(self, rows: DataFrame) -> DataFrame:
        """The buckets in which a key of rows falls."""
        at, touched = self._newest()[1], set(self.touched(rows))
        return self._read({b: v for b, v in at.items() if b in touched})

    def put(self, rows: DataFrame, version: int | None = None) -> list[int]:
        """Put rows (at most one for each key) in place of those with their keys; the buckets written.

        A version that the table already has is not made again. Only touched
        buckets are read and written, each by one task. Extra columns go.
        """
        newest, at = self._newest()
        version = newest + 1 if version is None else version
        if version <= newest:
            return []
        # Staged, as rows are read twice; what a failed change left is written over.
        path, rows = f"{self.path}/staged/version={version}", self.bucketed(rows.select(*self.schema.names))
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        held = {b: v for b, v in at.items() if b in set(touched)}
        if touched:
            # One shuffle and one sort by bucket and key: of a key's rows the new ones stay.
            both = self._read(held).withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1))) if held else rows
            full = both.withColumn("version", F.lit(version)).repartition(len(touched), "bucket")
            if held:
                full = full.withColumn("_rank", F.rank().over(W.partitionBy("bucket", self.key).orderBy(F.desc("_new")))).where("_rank = 1").drop("_rank", "_new")
            full = full.sortWithinPartitions("bucket", self.key)
            full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
        heads = [(b, v, self.buckets) for b, v in (at | dict.fromkeys(touched, version)).items()] or [(-1, version, self.buckets)]
        self.spark.createDataFrame(heads, "bucket int, at int, of int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/version={version}")
        drop_folder(self.spark, path)
        return touched

    def vacuum(self, keep: int = 1) -> list[tuple[int, int]]:
        """Delete the folders that none of the newest `keep` versions reads, and older heads; the (bucket, version) deleted."""
        heads = self._heads()
        if heads is None:
            return []
        versions = sorted(r["version"] for r in heads.select("version").distinct().collect())
        used = {(r["bucket"], r["at"]) for r in heads.where(F.col("version").isin(versions[-keep:])).select("bucket", "at").distinct().collect()}
        gone = sorted({(r["bucket"], r["at"]) for r in heads.select("bucket", "at").distinct().collect() if r["bucket"] >= 0} - used)
        for folder in [f"rows/bucket={b}/version={v}" for b, v in gone] + [f"heads/version={v}" for v in versions[:-keep]]:
            drop_folder(self.spark, f"{self.path}/{folder}")
        return gone
