"""Joins of integer ranges and of neighbours, without comparing everything with everything."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_any(value: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether ``value`` lies in one of a few literal closed ranges; reaches the scan as a filter."""
    return reduce(or_, [value.between(a, b) for a, b in ranges], F.lit(False))


def overlaps(start: Column, end: Column, a: Column | int, b: Column | int) -> Column:
    return (start <= b) & (end >= a)


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of rows whose closed ranges (l_start, l_end) and (r_start, r_end) overlap.

    Both sides go to buckets of ``width`` and meet by an equi-join on the bucket; a pair that shares several is kept in the
    bucket where its overlap begins, so no distinct is needed.
    """
    a = left.withColumn("_bucket", _buckets(F.col("l_start"), F.col("l_end"), width))
    b = right.withColumn("_bucket", _buckets(F.col("r_start"), F.col("r_end"), width))
    first = F.floor(F.greatest("l_start", "r_start") / width) == F.col("_bucket")
    return a.join(b, "_bucket").filter(overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")) & first).drop("_bucket")


def point_join(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Pairs of a ``point`` and a closed range (r_start, r_end) that holds it."""
    b = ranges.withColumn("_bucket", _buckets(F.col("r_start"), F.col("r_end"), width))
    a = points.withColumn("_bucket", F.floor(F.col("point") / width))
    return a.join(b, "_bucket").filter(F.col("point").between(F.col("r_start"), F.col("r_end"))).drop("_bucket")


def neighbours(rows: DataFrame, hits: DataFrame, key: str, order: str, radius: int) -> DataFrame:
    """Rows within ``radius`` of a hit (key, order, hit_rank), each claimed by its best hit only; hits themselves stay out."""
    near = hits.withColumn(order, F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius)))
    claimed = rows.join(near, [key, order]).join(hits.select(key, order), [key, order], "left_anti")
    best = Window.partitionBy(key, order).orderBy("hit_rank")
    return claimed.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def expand_edges(edges: DataFrame, ranges: list[tuple[int, int]], limit: int) -> DataFrame:
    """One hop from ``ranges``: best edge (src, dst, weight) to each target outside of the ranges, heaviest first."""
    found = edges.filter(in_any(F.col("src"), ranges) & ~in_any(F.col("dst"), ranges))
    once = Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
    best = found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return best.orderBy(F.desc("weight"), "src", "dst").limit(limit)
