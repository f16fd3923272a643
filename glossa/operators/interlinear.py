"""Verses word by word: the base text's words with glosses and forms, a translation beside it, what else there is, and the chapters around."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import editorial as E
from glossa.operators.access import work_access
from glossa.operators.corpus import greek_translit
from glossa.operators.ranges import point_join
from glossa.tables import few, written

#: Verses that one request shows.
VERSES = 200


def base_works(requests: DataFrame, books: DataFrame, originals: dict[str, str]) -> DataFrame:
    """``requests`` (request_id, start, end, asked) with base: the original asked for, else that of the first book's part of the canon.

    ``books`` (order, part) says which part a book belongs to, ``originals`` which work is the original of a part.
    """
    first = F.min_by(F.floor(F.col("start") / 1_000_000), F.col("place"))
    part = requests.groupBy("request_id").agg(first.alias("order"), F.first("asked", ignorenulls=True).alias("asked")).join(F.broadcast(books), "order", "left")
    of = F.create_map(*[F.lit(x) for pair in originals.items() for x in pair])
    asked = F.upper(F.coalesce("asked", F.lit("")))
    return part.select("request_id", F.when(asked.isin(*originals.values()), asked).otherwise(of[F.col("part")]).alias("base"))


def _glossed(tokens: DataFrame, lexemes: DataFrame) -> DataFrame:
    """``tokens`` (.., strong, lemma_norm) with the lexeme of their number, of the number without homograph letter, or, without a number, of their folded lemma."""
    entry = F.struct("strong", "lemma", "gloss")
    sides = [
        (lexemes.select(F.col("strong").alias("_k1"), entry.alias("_l1")), F.col("strong") == F.col("_k1")),
        (lexemes.select(F.col("strong").alias("_k2"), entry.alias("_l2")), F.regexp_replace("strong", "[a-z]+$", "") == F.col("_k2")),
        (lexemes.filter("lemma_norm <> ''").groupBy(F.col("lemma_norm").alias("_k3")).agg(F.min_by(entry, F.col("strong")).alias("_l3")), (F.coalesce("strong", F.lit("")) == "") & (F.col("lemma_norm") == F.col("_k3"))),
    ]
    for side, same in sides:
        held = written(side, "lexemes")
        tokens = tokens.join(F.broadcast(held) if few(held) else held, same, "left")
    return tokens.withColumn("lexeme", F.when(F.coalesce("strong", F.lit("")) != "", F.coalesce("_l1", "_l2")).otherwise(F.col("_l3"))).drop("_k1", "_k2", "_k3", "_l1", "_l2", "_l3")


def transliterated(surface: Column) -> Column:
    """Greek words in Latin letters."""

    @F.pandas_udf("string")
    def each(words: pd.Series) -> pd.Series:
        return words.map(lambda w: w if w is None else greek_translit(w))

    return each(surface)


def described(language: Column, pos: Column, morph: Column) -> Column:
    told = F.when(language.isin("hbo", "arc"), E.hebrew_morphology(morph)).when((language == "grc") & (F.coalesce(pos, F.lit("")) != ""), E.greek_morphology(pos, morph))
    return F.coalesce(F.nullif(told, F.lit("")), morph, F.lit(""))


def interlinear(
    requests: DataFrame, texts: DataFrame, works: DataFrame, lexemes: DataFrame, books: DataFrame, originals: dict[str, str], translations: list[str], levels: list[str] | None = None, limit: int = VERSES
) -> DataFrame:
    """request_id, ord, ordinal, base, words, translation, truncated of the verses that ``requests`` (request_id, place, start, end, asked, translation) name.

    ``texts`` (ordinal, work, text, tokens): tokens are (position, surface, lemma, lemma_norm, strong, morph, pos, gloss). Words have the
    context's gloss or the first of their lexeme's (from_dictionary), a transliteration in Greek, and their form told in words. The
    translation is the one asked for or the first of ``translations`` that may be seen. Only works whose access ``levels`` allow are shown;
    a request whose base may not be seen has no verses.
    """
    seen = works.filter(work_access(F.col("access"), F.col("code"), levels))
    based = base_works(requests, books, originals).join(F.broadcast(seen.select(F.col("code").alias("base"), "language")), "base")
    known = [r.code for r in seen.filter(F.col("code").isin(translations)).select("code").collect()]  # at most as many as ``translations``
    usable = [t for t in translations if t in known]
    wanted = requests.groupBy("request_id").agg(F.first(F.upper("translation"), ignorenulls=True).alias("t"))
    shown = wanted.select("request_id", (F.when(F.col("t").isin(usable), F.col("t")).otherwise(usable[0]) if usable else F.lit(None).cast("string")).alias("shown"))
    ranges = written(requests.select("request_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")).join(based, "request_id").join(shown, "request_id"), "interlinear-ranges")
    own = point_join(texts.select(F.col("ordinal").alias("point"), "work").filter(F.col("work").isin(*originals.values())), ranges, 1_000).filter("work = base")
    own = own.select("request_id", F.col("point").alias("ordinal"), "base", "language", "shown").distinct()
    at = Window.partitionBy("request_id").orderBy("ordinal")
    ranked = own.withColumn("ord", F.row_number().over(at)).withColumn("truncated", F.count("*").over(Window.partitionBy("request_id")) > limit).filter(F.col("ord") <= limit)
    ranked = written(ranked, "interlinear-verses")
    verses = ranked.join(texts.select("ordinal", F.col("work").alias("base"), "tokens"), ["ordinal", "base"])
    each = verses.select("request_id", "ordinal", "language", F.explode_outer("tokens").alias("t")).filter("t IS NOT NULL").select("request_id", "ordinal", "language", "t.*")
    told = _glossed(each, lexemes).withColumn("_latin", transliterated(F.when(F.col("language") == "grc", F.col("surface"))))
    first_gloss = F.trim(F.get(F.split(F.coalesce("lexeme.gloss", F.lit("")), ","), F.lit(0)))
    has_own = F.coalesce("gloss", F.lit("")) != ""
    word = F.struct(
        "position",
        "surface",
        F.coalesce("lexeme.strong", "strong", F.lit("")).alias("strong"),
        F.when(F.col("language") == "grc", F.col("_latin")).otherwise("").alias("translit"),
        F.when(has_own, F.col("gloss")).otherwise(first_gloss).alias("gloss"),
        (~has_own & (first_gloss != "")).alias("from_dictionary"),
        described(F.col("language"), F.col("pos"), F.col("morph")).alias("morph"),
        F.coalesce(F.nullif("lemma", F.lit("")), "lexeme.lemma", F.lit("")).alias("lemma"),
    )
    words = told.groupBy("request_id", "ordinal").agg(F.sort_array(F.collect_list(word)).alias("words"))  # of one verse
    beside = texts.filter(F.col("work").isin(usable)).select(F.col("ordinal").alias("_o"), F.col("work").alias("_w"), F.col("text").alias("translation"))
    joined = ranked.join(words, ["request_id", "ordinal"], "left").join(beside, (F.col("ordinal") == F.col("_o")) & (F.col("shown") == F.col("_w")), "left")
    return joined.select("request_id", "ord", "ordinal", "base", "words", F.coalesce("translation", F.lit("")).alias("translation"), "truncated")


def alternatives(requests: DataFrame, texts: DataFrame, works: DataFrame, books: DataFrame, originals: dict[str, str], levels: list[str] | None = None) -> DataFrame:
    """request_id, code: other originals that may be seen and have a verse of the request's first range."""
    seen = works.filter(work_access(F.col("access"), F.col("code"), levels)).select("code")
    based = base_works(requests, books, originals)
    first = requests.groupBy("request_id").agg(F.min_by("start", "place").alias("r_start"), F.min_by("end", "place").alias("r_end")).join(based, "request_id")
    there = texts.filter(F.col("work").isin(*originals.values())).select(F.col("ordinal").alias("point"), "work")
    met = point_join(there, written(first, "first-ranges"), 1_000).filter("work <> base").select("request_id", F.col("work").alias("code")).distinct()
    return met.join(F.broadcast(seen), "code", "left_semi").select("request_id", "code")


def chapters_around(requests: DataFrame, verses: DataFrame) -> DataFrame:
    """request_id, before, after: the chapters (their ordinals without a verse) next to the first range's beginning and the last one's end that ``verses`` (ordinal) have.

    Chapters that requests name are looked up once each, among those of their book, or else in the nearest book that has any; books are a
    canon's dimension, and go as one sorted list.
    """
    book = F.floor(F.col("c") / 1_000_000)
    held = written(verses.select((F.col("ordinal") - F.col("ordinal") % 1_000).alias("c")).distinct(), "chapters")
    ends = requests.groupBy("request_id").agg(F.min_by("start", "place").alias("s"), F.max_by("end", "place").alias("e"))
    ends = ends.select("request_id", (F.col("s") - F.col("s") % 1_000).alias("first"), (F.col("e") - F.col("e") % 1_000).alias("last"))
    named = ends.select(F.explode(F.array("first", "last")).alias("c")).filter("c IS NOT NULL").distinct()
    every = held.select("c", F.col("c").alias("own")).unionByName(named.select("c", F.lit(None).cast("long").alias("own"))).groupBy("c").agg(F.max("own").alias("own"), F.count_if(F.col("own").isNull()).alias("named"))
    order = Window.partitionBy(book).orderBy("c")
    inner = every.select("c", "named", F.max("own").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("own").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    books = F.broadcast(held.groupBy(book.alias("book")).agg(F.min("c").alias("low"), F.max("c").alias("high")).agg(F.sort_array(F.collect_list(F.struct("book", "low", "high"))).alias("_books")))
    earlier = F.array_max(F.transform(F.filter("_books", lambda b: b["book"] < book), lambda b: b["high"]))
    later = F.array_min(F.transform(F.filter("_books", lambda b: b["book"] > book), lambda b: b["low"]))
    near = inner.filter("named > 0").crossJoin(books).select("c", F.coalesce("before", earlier).alias("before"), F.coalesce("after", later).alias("after"))
    near = written(near, "chapters-near")
    side = F.broadcast(near) if few(near) else near
    got = ends.join(side.select(F.col("c").alias("first"), "before"), "first", "left").join(side.select(F.col("c").alias("last"), "after"), "last", "left")
    return got.select("request_id", "before", "after")
