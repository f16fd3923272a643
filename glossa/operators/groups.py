"""Aggregations: facets, votes, duplicates, means that leave out what does not apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import header_key
from glossa.tables import few, written


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for each of ``columns`` in one pass over ``df``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def shares(df: DataFrame, key: str, score: str, order: list, most: int) -> DataFrame:
    """The ``most`` best rows of every key with their share of the key's score."""
    everything = Window.partitionBy(key)
    share = df.withColumn("share", F.col(score) / F.sum(score).over(everything)).withColumn("_n", F.row_number().over(everything.orderBy(*order)))
    return share.filter(F.col("_n") <= most).drop("_n")


def duplicate_groups(df: DataFrame, digest: Column) -> DataFrame:
    """digest, n, first_id of texts that occur more than once."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def macro_means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """metric, mean, n by ``keys`` over the rows to which a metric applies (null does not, and is not zero)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select(*keys, each.alias("m")).filter("m.value IS NOT NULL").groupBy(*keys, "m.metric").agg(F.avg("m.value").alias("mean"), F.count("*").alias("n"))


def running_headers(lines: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Header keys that stand at the top of at least ``least`` documents of a group."""
    return lines.filter("header_key <> ''").groupBy(*keys, "header_key").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") >= least)


# Lines at each end of a page that may be headers, letters that a header's key has, and pages and share of pages that carry it.
ENDS, KEY, LEAST_PAGES, SHARE = 3, 4, 4, 0.25


def without_headers(pages: DataFrame) -> DataFrame:
    """``pages`` (document_id, page, text) without running headers: lines whose key, digits and blanks aside, stands among the first or
    last three of enough pages of their document, wherever they are, and lines that are a page number. Documents of few pages stay as they are.

    Only the keys of those few lines are counted; what comes back to a document's pages is its list of headers.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    said = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")
    ends = F.array_union(F.slice(said, 1, ENDS), F.slice(said, F.greatest(F.size(said) - ENDS + 1, F.lit(1)), ENDS))
    keys = F.array_distinct(F.filter(F.transform(ends, header_key), lambda k: F.length(k) >= KEY))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= LEAST_PAGES)
    counts = pages.select("document_id", F.explode(keys).alias("key")).groupBy("document_id", "key").agg(F.count("*").alias("n"))
    often = counts.join(sizes, "document_id").filter(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("_pages") * SHARE)))
    # at most 24 keys a document: each stands on a quarter of pages with six lines
    headers = written(often.groupBy("document_id").agg(F.collect_set("key").alias("_headers")), "headers")
    joined = pages.join(F.broadcast(headers) if few(headers) else headers, "document_id", "left")

    def goes(line: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
        return (bare != "") & (F.array_contains("_headers", header_key(bare)) | bare.rlike("^[0-9]{1,4}$"))

    kept = F.array_join(F.filter(lines, lambda x: ~goes(x)), "\n")
    return joined.withColumn("text", F.when(F.col("_headers").isNull(), F.col("text")).otherwise(kept)).drop("_headers")
