"""Lexical and vector retrieval."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import words

#: BM25 saturation and length normalisation.
K1, B = 1.2, 0.75


def occurrences(text: Column, term: str) -> Column:
    """How often the word ``term`` (of letters) stands in the lower-cased ``text``."""
    return F.regexp_count(text, F.lit(f"(?<![a-z]){term}(?![a-z])"))


def bm25(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``docs`` with a bm25 score for ``terms`` where any occurs.

    Words are counted in the text itself, no list of them is made; only one row of totals is gathered, as a scalar subquery.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counted = docs.withColumn("_low", low).select(
        *docs.columns, F.regexp_count("_low", F.lit("[a-z]+")).alias("_len"), *(occurrences(F.col("_low"), t).alias(f"_tf{i}") for i, t in enumerate(terms))
    )
    totals = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        tf = F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("avg")))

    # one row of totals, so this is no product of tables
    scored = counted.filter(reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(totals))
    return scored.select(*docs.columns, reduce(add, [part(i) for i in range(len(terms))]).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors most like the one of ``query`` (a row with the column query), exactly; filter before calling."""
    scored = vectors.join(F.broadcast(query.limit(1))).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("query")), 6))
    return scored.drop("query").orderBy(F.desc("similarity"), "vec_id").limit(k)


def positions(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, word, pos of the occurrences of ``terms``; other words never leave the scan."""
    all_words = F.transform(words(F.col("text")), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    wanted = F.filter(all_words, lambda x: x["word"].isin(terms))
    return docs.select("doc_id", F.explode(wanted).alias("o")).select("doc_id", "o.word", "o.pos")


def with_phrase(docs: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id, n: documents in which the words of ``phrase`` follow each other, and how often."""
    found = positions(docs, phrase)
    start = F.array(*map(F.lit, phrase))
    offsets = found.withColumn("_i", F.explode(F.transform(start, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).filter("_i.w = word")
    return (
        offsets.groupBy("doc_id", (F.col("pos") - F.col("_i.i")).alias("at"))
        .agg(F.count("*").alias("c"))
        .filter(F.col("c") == len(phrase))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"))
    )


def with_near(docs: DataFrame, a: str, b: str, gap: int) -> DataFrame:
    """doc_id, distance: documents in which ``a`` and ``b`` stand with at most ``gap`` words between, in any order.

    The nearest occurrence on either side is found by one ordered pass over a document's occurrences, not by pairs.
    """
    found = positions(docs, [a, b])
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_other = F.last(F.when(F.col("word") == a, F.col("pos")), ignorenulls=True).over(order), F.last(F.when(F.col("word") == b, F.col("pos")), ignorenulls=True).over(order)
    other = F.when(F.col("word") == a, last_other[1]).otherwise(last_other[0])
    return found.withColumn("d", F.col("pos") - other - 1).groupBy("doc_id").agg(F.min("d").alias("distance")).filter(F.col("distance") <= gap)
