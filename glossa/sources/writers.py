"""Sinks: manifests, vectors, bibliographies, partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """id and vector as compressed JSON lines."""
    vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).write.mode("overwrite").option("compression", "gzip").json(path)


def read_vectors(spark, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<float>").json(path).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"))


def bibtex_entry(kind: str, key: Column, fields: dict[str, Column]) -> Column:
    """One entry; fields that are null or empty are left out, braces and backslashes escaped."""
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), F.regexp_replace(c.cast("string"), r"([{}\\])", r"\\$1"), F.lit("}"))) for name, c in fields.items()]
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris_entry(kind: str, fields: dict[str, Column]) -> Column:
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{tag}  - "), c.cast("string"))) for tag, c in fields.items()]
    return F.concat_ws("\n", F.lit(f"TY  - {kind}"), *lines, F.lit("ER  - "))


def write_corpus(df: DataFrame, path: str, partition: str, order: str) -> None:
    """Partitioned Parquet, sorted inside files so that ranges of ``order`` skip row groups."""
    df.repartition(partition).sortWithinPartitions(partition, order).write.mode("overwrite").partitionBy(partition).parquet(path)
