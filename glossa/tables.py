"""Reading the tables that queries run on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of texts that a task of Python turns into objects at a time.
SLICE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors see; where that is unset, as in tests, in a local folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = tempfile.mkdtemp(prefix="glossa-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session(name: str = "glossa", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``scratch`` and read again: cuts lineage, survives lost executors, and gives joins a plain side."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a written table has at most ``rows`` rows, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes at most, so that few Python objects live at a time however long texts are."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_slices(df: DataFrame, scan: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(scan, schema)`` with frames of about ``SLICE`` bytes."""
    kinds = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in scan(part.to_pandas() for part in slices(batches)):
            yield from pa.Table.from_pandas(out, kinds, preserve_index=False).to_batches()

    return df.mapInArrow(run, schema)
