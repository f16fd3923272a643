"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator hands to every executor.
BROADCAST_ROWS = 100_000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app := spark.sparkContext.applicationId)
    if not path:
        path = _own[app] = "file://" + tempfile.mkdtemp(prefix="glossa-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a staged table is small enough to broadcast, by count."""
    return df.limit(rows + 1).count() <= rows


def spread(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` of ``rows``, those of the least hashes of ``keys``: of the whole table, and the same ones each time.

    What cannot be among them is left out by a threshold before any row moves.
    """
    h = F.xxhash64(*keys)
    n = rows.count()
    kept = rows.withColumn("_h", h)
    share = 2 * (most + 50) / max(n, 1)
    if share < 1:  # twice as many as wanted are expected below the threshold
        kept = kept.filter(F.col("_h") < F.lit(int(-(2**63) + 2**64 * share)))
    return kept.orderBy("_h", *keys).limit(most).drop("_h")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few Python objects live at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with leading underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
