"""Shared folder, staged tables and word rules used by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word, for Spark's and for Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is set for local masters (tests);
    on a cluster that is an error, as executors would not see the folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="almanac-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/almanac-{sc.applicationId}"


_SHIPPED: dict[str, str] = {}


def shipped(df: DataFrame) -> DataFrame:
    """df, after this package has been sent to the executors: their Python workers import it from there, wherever they start."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="almanac-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(path))  # Spark's file server hands it out, so the driver's folder is enough
        _SHIPPED[sc.applicationId] = str(path)
    return df


_SENT: set[tuple[str, str]] = set()


def shipped_file(spark: SparkSession, path: str) -> str:
    """The name by which workers find a driver's file with SparkFiles.get(), after it has been sent to the executors."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SENT:
        sc.addFile(path)
        _SENT.add((sc.applicationId, path))
    return os.path.basename(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that is read no more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_once(docs: DataFrame, keys: dict[str, Column], keep: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of docs whose keys are a row of keep; of those whose keys are in again, one for each.

    keys are columns of docs by the names in keep and again; nulls are equal.
    Rows that agree in their keys are combined in each task before they meet.
    """
    marks = {k: unused(docs, f"_{k}") for k in keys}
    own = docs.withColumns({marks[k]: c for k, c in keys.items()})

    def joined(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.select(*(F.col(k).alias(v) for k, v in marks.items()))
        condition = None
        for v in marks.values():
            same = rows[v].eqNullSafe(other[v])
            condition = same if condition is None else condition & same
        return rows.join(other, condition, how)

    found = joined(own, keep, "left_semi")
    if not again.isEmpty():
        found = joined(found, again, "left_anti").unionByName(joined(found, again, "left_semi").dropDuplicates(list(marks.values())))
    return found.drop(*marks.values())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def public_tokenizer(name: str) -> str:
    """Path of a public vocabulary file; the files stay outside the repository."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def text_slices(batch, chars: int = 1_500_000):
    """Runs of rows of about so many bytes of text: first row, end, texts. Only one run's texts are held as objects."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    text = batch["text"]
    total = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(total, (total[first - 1] if first else 0) + chars, side="left")) + 1
        end = min(max(end, first + 1), batch.num_rows)
        yield first, end, text.slice(first, end - first).to_pylist()
        first = end
