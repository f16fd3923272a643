"""What goes into an answer's context: verses of a question, lists under one budget, numbered blocks with a legend."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.references import BOOKS, Canon, extract_references
from glossa.operators.ranges import point_join
from glossa.tables import few, written

#: Lists from the one that stays longest to the first to go, with what a row of each takes besides its text.
LISTS = {"chunks": 60, "patristics": 40, "ane": 20, "related": 30}
#: Characters of headings, and the signs of numbered blocks.
HEADINGS, SIGNS = 1_200, {"chunks": "", "patristics": "P", "ane": "A"}
#: Verses that a question may bring.
VERSES = 40


def fit_lists(items: DataFrame, base: DataFrame, budget: int | None, lists: dict[str, int] = LISTS) -> DataFrame:
    """``items`` (query_id, list, rank, size) with kept: what stays when the last row of the last list that has any goes until the rest fits.

    ``base`` (query_id, chars) is what stands in any case. The first row of the first list stays however long it is. Rows in the order
    in which they would stay have a running sum that only grows, so one window over a query's rows tells all of them.
    """
    place = F.coalesce(*[F.when(F.col("list") == name, i) for i, name in enumerate(lists)], F.lit(len(lists)))
    order = Window.partitionBy("query_id").orderBy("_place", "rank")
    sums = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = items.withColumn("_place", place).join(base.select("query_id", "chars"), "query_id", "left")
    fits = F.lit(True) if budget is None else T.estimate_tokens(F.coalesce("chars", F.lit(0)) + sums) <= budget
    first = (F.col("_place") == 0) & (F.row_number().over(order) == 1)
    return placed.withColumn("kept", fits | first).drop("_place", "chars")


def budget_report(fitted: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, before, after (estimates of tokens), and the rows dropped of each list."""
    sizes = fitted.groupBy("query_id").agg(
        F.sum("size").alias("all"), F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("some"), *[F.count_if((F.col("list") == name) & ~F.col("kept")).alias(f"dropped_{name}") for name in LISTS]
    )
    chars = F.coalesce("chars", F.lit(0))
    joined = sizes.join(base.select("query_id", "chars"), "query_id", "left")
    return joined.select("query_id", T.estimate_tokens(chars + F.col("all")).alias("before"), T.estimate_tokens(chars + F.col("some")).alias("after"), *[f"dropped_{name}" for name in LISTS])


def legend(refs: Column, names: dict[int, str], books: list[tuple] = BOOKS) -> Column:
    """``abbreviation = name`` of the books of an array of references, each once, in order; ``names`` are the books' by their order."""

    @F.pandas_udf("string")
    def told(lists: pd.Series) -> pd.Series:
        canon = Canon(books)

        def one(held) -> str:
            orders = dict.fromkeys(start // 1_000_000 for ref in (held if held is not None else []) for _, start, _ in canon.parse(ref)[:1])
            return "; ".join(f"{canon.named[o]} = {names[o]}" for o in orders if o in names)

        return lists.map(one)

    return told(refs)


def blocks(rows: DataFrame) -> DataFrame:
    """query_id, list, block of ``rows`` (query_id, list, rank, head, text): numbered from 1 in each list, those of one list together."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("rank")))
    sign = F.coalesce(*[F.when(F.col("list") == name, F.concat(F.lit(f"[{mark}"), F.col("n"), F.lit("] "))) for name, mark in SIGNS.items()], F.lit(""))
    gap = F.when(F.col("list") == "chunks", "\n").otherwise(": ")
    one = numbered.select("query_id", "list", F.struct("n", F.concat(sign, F.coalesce("head", F.lit("")), gap, F.coalesce("text", F.lit(""))).alias("block")).alias("b"))
    held = one.groupBy("query_id", "list").agg(F.sort_array(F.collect_list("b")).alias("b"))  # what a budget has let through
    texts = F.transform("b", lambda b: b["block"])
    return held.select("query_id", "list", F.when(F.col("list").isin("related", "verses"), F.array_join(texts, "\n")).otherwise(F.array_join(texts, "\n\n")).alias("block"))


def messages(questions: DataFrame, rows: DataFrame, titles: dict[str, str], legends: DataFrame | None = None, none: str = "(none)") -> DataFrame:
    """query_id, message of ``questions`` (query_id, question) and the kept ``rows`` of their lists, under ``titles`` in their order.

    The first two titles always stand, with ``none`` where there is nothing; the others only over something. ``legends`` (query_id, legend)
    come behind the second.
    """
    parts = blocks(rows).groupBy("query_id").pivot("list", list(titles)).agg(F.first("block"))
    joined = questions.select("query_id", "question").join(parts, "query_id", "left")
    joined = joined.join(legends.select("query_id", "legend"), "query_id", "left") if legends is not None else joined.withColumn("legend", F.lit(""))
    said = [F.coalesce("question", F.lit(""))]
    for i, (name, title) in enumerate(titles.items()):
        text = F.coalesce(F.col(name), F.lit(none)) if i < 2 else F.col(name)
        if i == 1:
            text = F.concat(text, F.when(F.coalesce("legend", F.lit("")) != "", F.concat(F.lit("\n("), F.col("legend"), F.lit(")"))).otherwise(""))
        said.append(F.concat(F.lit(f"{title}:\n"), text))
    return joined.select("query_id", F.concat_ws("\n\n", *said).alias("message"))


def question_verses(questions: DataFrame, texts: DataFrame, works: list[str], books: list[tuple] = BOOKS, limit: int = VERSES) -> DataFrame:
    """query_id, ord, ordinal, work, text: verses that a question (query_id, question) names, in ``works`` in their order.

    ``texts`` (ordinal, work, text). Of a question the first ``limit`` verses count, in order of the canon, those without a text in
    any of the works too. Only verses that some question names are joined with their texts.
    """
    found = extract_references(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), books)
    ranges = written(found.select(F.col("id").alias("query_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), "question-ranges")
    verses = texts.select(F.col("ordinal").alias("point")).distinct()
    named = point_join(verses, ranges, 1_000).select("query_id", F.col("point").alias("ordinal")).distinct()
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))).filter(F.col("rank") <= limit)
    ranked = written(ranked, "question-verses")
    place = F.array_position(F.array(*map(F.lit, works)), F.col("work"))
    own = texts.filter(F.col("work").isin(works)).join(F.broadcast(ranked) if few(ranked) else ranked, "ordinal")
    order = Window.partitionBy("query_id").orderBy("rank", place)
    return own.select("query_id", F.row_number().over(order).alias("ord"), "ordinal", "work", "text")
