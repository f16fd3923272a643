"""Ranking and order-dependent operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key by a total ``order``."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, order: list, limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows by a total ``order``, numbered; only these reach the numbering."""
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, list_id, rank): id, score, and where the id appeared first."""
    return rankings.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("first_seen"))


def carry_forward(value: Column, keys: list[str], order: list) -> Column:
    """The last value so far that is not null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def grouped_rows(df: DataFrame, keys: list[str], order: list, size: int, least: int) -> DataFrame:
    """Rows numbered and put in passages of ``size``; a last one of under ``least`` rows joins the one before it."""
    at = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(at) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    whole = F.floor((F.col("_n") - 1) / size)
    short = (whole > 0) & (F.col("_n") - whole * size < least)
    passage = F.floor(F.col("_i") / size)
    return numbered.withColumn("passage", F.when(short & (passage == whole), passage - 1).otherwise(passage).cast("long")).drop("_n")


def within_budget(df: DataFrame, keys: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """Rows from the best on while their costs sum to ``budget`` at most; the best one always stays."""
    at = Window.partitionBy(*keys).orderBy(*order)
    spent = F.sum(cost).over(at.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_spent", spent).withColumn("_i", F.row_number().over(at)).filter((F.col("_spent") <= budget) | (F.col("_i") == 1)).drop("_spent", "_i")


def replace_last(base: DataFrame, extra: DataFrame, order: list, size: int, channel: int) -> DataFrame:
    """``size`` rows of a ranking (rank): up to ``channel`` rows of ``extra`` take the places of the last ones."""
    extra = extra.limit(channel).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # as many as the channel
    room = F.broadcast(extra.agg((F.lit(size) - F.count("*")).alias("_room")))
    placed = extra.crossJoin(room).withColumn("rank", F.col("_room") + F.col("_n")).drop("_n", "_room")
    return base.crossJoin(room).filter(F.col("rank") <= F.col("_room")).drop("_room").unionByName(placed)


def diversify(hits: DataFrame, keys: list[str], per_group: int, k: int) -> DataFrame:
    """Greedy choice of ``k`` hits (rank, document, ord) a query: at most ``per_group`` of a document, none beside a chosen
    one; then places left are filled in rank order without the cap, still none beside a chosen one."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        rows = list(zip(pdf["document"], pdf["ord"], strict=True))
        chosen: list[int] = []
        taken: dict = {}
        for cap in (per_group, None) if per_group > 0 else (None,):
            for i, (doc, at) in enumerate(rows):
                if len(chosen) == k:
                    break
                places = taken.get(doc, set())
                if i in chosen or (cap is not None and len(places) >= cap) or (per_group > 0 and places & {at - 1, at, at + 1}):
                    continue
                chosen.append(i)
                taken.setdefault(doc, set()).add(at)
        out = pdf.iloc[chosen].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    return hits.groupBy(*keys).applyInPandas(choose, _with(hits, "place int"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])
