"""Which documents a search may see, as bits: filters on attributes and on intervals, met before anything is read or ranked.

An attribute's value has one bit for each document, ``BITS`` to a row, so a filter is a few rows where it would be many ids. A filter is a list
of groups, all of which must hold; a group holds where any of its (field, values) does, which is how access by level or by owner is
said. Document ids are longs from 0 on.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators import ranges
from glossa.tables import few

#: Documents of one row of bits.
BITS = 63


def word(doc_id: Column) -> Column:
    return F.floor(doc_id / BITS)


def bit(doc_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (doc_id % BITS).cast("int"))


def attribute_bits(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, word, bits of ``docs`` (doc_id, the columns ``fields``); an array column has each of its values, null none."""
    kinds = dict(docs.dtypes)
    values = [F.transform(F.col(f), lambda v: v.cast("string")) if kinds[f].startswith("array") else F.array(F.col(f).cast("string")) for f in fields]

    def named(field: str, held: Column) -> Column:
        return F.transform(held, lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))

    each = F.flatten(F.array(*map(named, fields, values)))
    rows = docs.select("doc_id", F.explode(each).alias("a")).select("a.*", "doc_id").filter("value IS NOT NULL")
    return rows.groupBy("field", "value", word(F.col("doc_id")).alias("word")).agg(F.bit_or(bit(F.col("doc_id"))).alias("bits"))


def allowed(bits: DataFrame, groups: list[dict[str, list[str]]], intervals: DataFrame | None = None, wanted: list[tuple[int, int]] | None = None) -> DataFrame:
    """word, bits of the documents that all ``groups`` let through and, with ``wanted``, one of whose ``intervals`` (doc_id, start, end) overlaps one of these closed ranges."""
    if not groups and wanted is None:
        raise ValueError("a filter needs a group or wanted ranges")
    parts = []
    for i, group in enumerate(groups):
        match = reduce(or_, [(F.col("field") == f) & F.col("value").isin(list(vs)) for f, vs in group.items()], F.lit(False))
        parts.append(bits.filter(match).select(F.lit(i).alias("part"), "word", "bits"))
    if wanted is not None:
        hit = reduce(or_, [ranges.overlaps(F.col("start"), F.col("end"), F.lit(a), F.lit(b)) for a, b in wanted], F.lit(False))
        parts.append(intervals.filter(hit).select(F.lit(len(groups)).alias("part"), word(F.col("doc_id")).alias("word"), bit(F.col("doc_id")).alias("bits")))
    met = reduce(DataFrame.unionByName, parts).groupBy("word", "part").agg(F.bit_or("bits").alias("bits"))
    both = met.groupBy("word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter((F.col("n") == len(parts)) & (F.col("bits") != 0)).select("word", "bits")


def keep(rows: DataFrame, let_through: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` whose document has its bit in ``let_through`` (word, bits)."""
    side = let_through.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    same = word(F.col(key)) == F.col("_word")
    return rows.join(F.broadcast(side) if few(side, 1_000_000) else side, same & (F.col("_bits").bitwiseAND(bit(F.col(key))) != 0), "left_semi")
