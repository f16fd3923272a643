"""Operators on verses, tokens, lexemes and names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.tables import written


def parallel(verses: DataFrame, texts: DataFrame, works: list[str]) -> DataFrame:
    """A row per verse (ordinal), a column per work with its text; verses without any text stay."""
    wanted = texts.filter(F.col("work").isin(works)).groupBy("ordinal").pivot("work", works).agg(F.first("text"))
    return verses.join(wanted, "ordinal", "left")


def occurrences(tokens: DataFrame, by: Column) -> DataFrame:
    """book, n, total of the tokens that meet ``by``."""
    counts = tokens.filter(by).groupBy("book").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))


def with_lexemes(tokens: DataFrame, lexemes: DataFrame) -> DataFrame:
    """Tokens with the gloss of their Strong number, else of the number without homograph letter, else of their lemma."""
    exact = lexemes.select("strong", F.col("gloss").alias("_g1"))
    base = lexemes.groupBy(F.regexp_replace("strong", "[a-z]$", "").alias("_base")).agg(F.min_by("gloss", "strong").alias("_g2"))
    lemma = lexemes.groupBy("lemma").agg(F.min_by("gloss", "strong").alias("_g3"))
    joined = tokens.withColumn("_base", F.regexp_replace("strong", "[a-z]$", "")).join(exact, "strong", "left").join(base, "_base", "left").join(lemma, "lemma", "left")
    # the lemma counts only for tokens without a number
    gloss = F.when(F.col("strong").isNotNull(), F.coalesce("_g1", "_g2")).otherwise(F.col("_g3"))
    return joined.withColumn("gloss", gloss).drop("_base", "_g1", "_g2", "_g3")


def named_in(words: DataFrame, names: DataFrame, suffix: int = 3, least: int = 4) -> DataFrame:
    """id, word, name: a word is a name, or a name of at least ``least`` letters and up to ``suffix`` more.

    Both sides meet by the first ``least`` letters; a word that is a name itself matches no other.
    """
    exact = words.join(names, F.col("word") == F.col("name"))
    key = F.left("word", F.lit(least))
    long_names = names.filter(F.length("name") >= least).withColumn("_k", F.left("name", F.lit(least)))
    near = words.join(names, F.col("word") == F.col("name"), "left_anti").withColumn("_k", key).join(long_names, "_k")
    more = F.length("word") - F.length("name")
    inflected = near.filter(F.startswith("word", "name") & more.between(1, suffix)).drop("_k")
    return exact.unionByName(inflected).select("id", "word", "name").distinct()


def by_transliteration(words: DataFrame, lexemes: DataFrame, limit: int) -> DataFrame:
    """id, word, strong, how: lexemes whose canonical transliteration is the word's (how = 0), two at most, and others that begin with its
    stem (1), shortest first: one beside an exact one, else two; ``limit`` a word in all.
    """
    key = T.canonical_translit(F.col("word"))
    keyed = words.select("id", "word").distinct().withColumn("key", key).filter(F.length("key") >= 3).withColumn("stem", T.translit_stem(F.col("key")))
    lex = lexemes.select("strong", T.canonical_translit(F.col("transliteration")).alias("lkey"))
    order = Window.partitionBy("id", "word").orderBy(F.length("lkey"), "strong")
    exact = keyed.join(lex, F.col("key") == F.col("lkey")).withColumn("n", F.row_number().over(order)).filter("n <= 2").select("id", "word", "strong", F.lit(0).alias("how"), "n")
    by_stem = keyed.filter("stem <> ''").join(lex, F.left("stem", F.lit(4)) == F.left("lkey", F.lit(4))).filter(F.startswith("lkey", "stem"))
    more = by_stem.join(exact.select("id", "word", "strong"), ["id", "word", "strong"], "left_anti").withColumn("n", F.row_number().over(order))
    has = exact.select("id", "word", F.lit(True).alias("has")).distinct()
    more = more.join(has, ["id", "word"], "left").filter(F.col("n") <= F.when(F.col("has"), 1).otherwise(2)).select("id", "word", "strong", F.lit(1).alias("how"), "n")
    rank = Window.partitionBy("id", "word").orderBy("how", "n")
    return exact.unionByName(more).withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= limit).select("id", "word", "strong", "how")


def working_translation(chunks: DataFrame, translations: DataFrame, allowed: Column) -> DataFrame:
    """Chunks with their translation where ``allowed``; otherwise the original and a flag that one was held back."""
    joined = chunks.join(translations, ["document_id", "ord"], "left")
    return joined.withColumn("shown", F.when(allowed, F.coalesce("translation", "text")).otherwise(F.col("text"))).withColumn("blocked", F.col("translation").isNotNull() & ~allowed).drop("translation")


def rerank(hits: DataFrame, score: Column, k: int, threshold: float | None = None) -> DataFrame:
    """The ``k`` best hits a query by an outside score; hits without one keep their order behind the scored ones."""
    scored = hits.withColumn("_s", score)
    if threshold is not None:
        scored = scored.filter(F.col("_s").isNull() | (F.col("_s") >= threshold))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_s"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_s")


def batches(rows: DataFrame, keys: list[str], order: str, words: str, most_words: int, most_rows: int) -> DataFrame:
    """Rows in order with the number of their batch: as many as fit ``most_words`` and ``most_rows``, one at least."""

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        found, batch, spent, held = [], 0, 0, 0
        for n in pdf[words]:
            if held and (spent + n > most_words or held == most_rows):
                batch, spent, held = batch + 1, 0, 0
            spent, held = spent + n, held + 1
            found.append(batch)
        return pdf.assign(batch=found)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "batch long"])
    return rows.groupBy(*keys).applyInPandas(number, schema)


def fan_back(df: DataFrame, column: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` done once for each distinct value of ``column`` (it adds columns), joined back to all rows."""
    return df.join(work(df.select(column).distinct()), column)


def fingerprint(df: DataFrame, key: str, columns: list[str], width: int = 1000) -> DataFrame:
    """One sha256 of all rows, a tree of digests: of buckets of ``width`` keys in order, then of as many buckets, until there is one.

    Keys are whole numbers, each of a row or few, so no task holds more than ``width`` digests.
    """
    row = F.struct(F.col(key).alias("k"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    buckets = df.groupBy(F.floor(F.col(key) / width).alias("b")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))

    def joined(rows: Column) -> Column:
        return F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), ","), 256)

    digests = written(buckets.select("b", "n", joined(F.col("rows")).alias("h")), "digests")
    ends = digests.agg(F.min("b"), F.max("b")).first()
    while ends[0] is not None and ends[1] - ends[0] >= width:
        up = digests.groupBy(F.floor(F.col("b") / width).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "h"))).alias("rows"), F.sum("n").alias("n"))
        digests = written(up.select("b", "n", joined(F.col("rows")).alias("h")), "digests")
        ends = digests.agg(F.min("b"), F.max("b")).first()
    return digests.groupBy().agg(joined(F.array_sort(F.collect_list(F.struct("b", "h")))).alias("sha256"), F.sum("n").alias("n"))


def merged_names(current: Column, new: Column, exclude: Column, most: int = 12) -> Column:
    """Names of both lists, folded repeats and the excluded once left out, of 2 to 80 characters, at most ``most``."""
    both = F.filter(F.concat(current, new), lambda n: F.length(n).between(2, 80) & (F.lower(n) != F.lower(exclude)))
    first = F.filter(both, lambda n, i: F.array_position(F.transform(both, F.lower), F.lower(n)) == i + 1)
    return F.slice(first, 1, most)


def sse_payloads(body: Column) -> Column:
    """Data of server-sent events: several data lines of an event joined, events ended by [DONE] or without data left out."""
    blocks = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda d: (d != "") & (d != "[DONE]"))


def caption_paragraphs(events: DataFrame, seconds: int = 60) -> DataFrame:
    """video_id, start, text: caption events (video_id, start, text) in paragraphs that begin ``seconds`` after the last began."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for video, start, text in sorted(zip(pdf["video_id"], pdf["start"], pdf["text"], strict=True)):
            if not out or start - out[-1][1] >= seconds:
                out.append([video, start, text])
            else:
                out[-1][2] += " " + text
        return pd.DataFrame(out, columns=["video_id", "start", "text"])

    return events.groupBy("video_id").applyInPandas(pack, "video_id string, start double, text string")


# Greek letters and what they become (fixed values).
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a b g d e z ē th i k l m n x o p r s t y ph ch ps ō s".split(), strict=True))
#: Marks of the decomposed form as signs behind a letter: rough breathing, diaeresis, iota subscript. "^" goes before a capital.
SIGNS = {"\u0314": "'", "\u0308": ":", "\u0345": "_"}
#: Rules over letters with signs, in order. A breathing on a diphthong's second vowel stands before its first.
RULES = [
    (r"γ(?=\^?[γκξχ])", "n"),
    (r"(\^?[αεηιουω])(\^?[αεηιουω])([:_]*)'", r"'\1\2\3"),
    (r"(\^?)([αεηιουω])([:_]*)'", r"\1h\2\3"),
    (r"'(\^?)", r"\1h"),
    (r"(?<=[αεηο])([:_]*)υ(?!:)", r"\1u"),
    (r"υ(?=[:_]*\^?ι(?!:))(?!:)", "u"),
    (r"ρh|ρ'", "rh"),
    ("_", "i"),
    (":", ""),
]


def greek_translit(word: str) -> str:
    """Latin letters of a Greek word: h for a rough breathing, n for gamma before a guttural, u in diphthongs, case kept."""
    signed = ""
    for c in unicodedata.normalize("NFD", word):
        low = c.lower()
        signed += SIGNS.get(c, "") if unicodedata.combining(c) else ("^" if c != low else "") + low if low in GREEK else ""
    # the breathing of a letter before its other signs or after them is the same
    signed = re.sub(r"'([:_]+)", r"\1'", signed).replace("ρ'", "rh")
    for pattern, becomes in RULES:
        signed = re.sub(pattern, becomes, signed)
    latin = "".join(GREEK.get(c, c) for c in signed)
    return re.sub(r"\^(.)", lambda m: m[1].upper(), latin)


def transliterated(words: DataFrame) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(translit=[greek_translit(w) for w in pdf["word"]])

    return words.select("word").mapInPandas(scan, "word string, translit string")
