"""Sources of a library: dictionaries in scripts, entity labels, plain documents, excerpts, verses without numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T


def script_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """number, definition, derivation, rendering, pronunciation of a dictionary that a script assigns to a variable."""
    body = F.regexp_extract("value", r"(?s)^[^=]*=[^{]*(\{.*\})", 1)
    entry = "map<string,struct<strongs_def:string,derivation:string,kjv_def:string,pron:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(body, entry)).alias("number", "e"))

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"e.{name}"), F.lit("")))

    return rows.select(
        "number", field("strongs_def").alias("definition"), F.left(field("derivation"), F.lit(300)).alias("derivation"), field("kjv_def").alias("rendering"), F.left(field("pron"), F.lit(64)).alias("pronunciation")
    )


def entity_labels(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """id, label, aliases, description, wiki of entities, one JSON object a line, in one language; what lacks is empty."""
    named = "map<string,struct<value:string>>"
    raw = spark.read.schema(f"id string, labels {named}, aliases map<string,array<struct<value:string>>>, descriptions {named}, sitelinks map<string,struct<url:string,title:string>>").json(path)

    def value(column: str) -> Column:
        return F.trim(F.coalesce(F.col(column)[language]["value"], F.lit("")))

    site = F.col("sitelinks")[language + "wiki"]
    # form encoding differs from that of paths in these three characters
    title = F.url_encode(F.replace(site["title"], F.lit(" "), F.lit("_")))
    for coded, plain in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        title = F.replace(title, F.lit(coded), F.lit(plain))
    made = F.when(site["title"] != "", F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), title))
    aliases = F.transform(F.coalesce(F.col("aliases")[language], F.array().cast("array<struct<value:string>>")), lambda a: F.trim(a["value"]))
    return raw.select(
        "id",
        value("labels").alias("label"),
        F.filter(aliases, lambda a: a != "").alias("aliases"),
        value("descriptions").alias("description"),
        F.coalesce(F.nullif(site["url"], F.lit("")), made, F.lit("")).alias("wiki"),
    )


def plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, page, text of the .txt and .md files below ``path``, cleaned; a form feed ends a page."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    pages = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\f")).alias("at", "text"))
    return pages.select("file", (F.col("at") + 1).alias("page"), T.clean_text(F.col("text")).alias("text"))


def excerpt(text: Column, start: str = "", end: str = "", strict: bool = True) -> Column:
    """From the first ``start`` to the first ``end`` behind its beginning, both included, trimmed; any white space stands for any.

    Where a marker is missing the query fails, or the excerpt is null if not ``strict``; null texts stay null.
    """

    def marker(words: str) -> str:
        return r"\s+".join(map(re.escape, words.split()))

    pattern = "(?s)" + (f"(?={marker(start)})" if start else r"\A") + (f".*?{marker(end)}" if end else ".*")
    missing = F.raise_error(F.lit(f"no excerpt from {start!r} to {end!r}")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text.isNull(), None).when(text.rlike(pattern), F.btrim(F.regexp_extract(text, pattern, 0), F.lit(" \t\n\r\f"))).otherwise(missing)


def bare(text: Column) -> Column:
    """``text`` without notes and tags, with single blanks; what verses are compared by."""
    unnoted = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<RF(?:\s+q=[^>]*)?>.*?<Rf>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(unnoted, "<[^>]*>", " "), r"\s+", " "))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (book, chapter, verse, text) with a verse for each and a note.

    A row without verse goes if its text repeats a verse of its chapter; it takes the chapter's only gap, with the note "gap"; it goes
    if there is none or more than one. Rows without book or chapter go.
    """
    chapter = ["book", "chapter"]
    placed = rows.filter("book IS NOT NULL AND chapter IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    own, loose = placed.filter("verse IS NOT NULL"), placed.filter("verse IS NULL").drop("verse")
    once = own.select(*chapter, bare(F.col("text")).alias("_bare")).distinct()
    new = loose.withColumn("_bare", bare(F.col("text"))).join(once, [*chapter, "_bare"], "left_anti").drop("_bare")
    # a chapter's gap by sums, so that no list of its verses is made
    verses = own.filter("verse >= 1").select(*chapter, F.col("verse").cast("long").alias("v")).distinct()
    gaps = verses.groupBy(*chapter).agg(F.max("v").alias("m"), F.count("*").alias("n"), F.sum("v").alias("s")).filter("m = n + 1")
    gaps = gaps.select(*chapter, (F.expr("m * (m + 1) div 2") - F.col("s")).cast(own.schema["verse"].dataType).alias("verse"))
    filled = new.join(gaps, chapter).withColumn("note", F.lit("gap"))
    return own.withColumn("note", F.lit(None).cast("string")).unionByName(filled)


def selected_works(passages: DataFrame, pattern: str) -> DataFrame:
    """``passages`` (work, title, author, section, ..) of the works that ``pattern``, without regard to case, selects.

    A work whose title matches stays whole; of others, passages with a matching level in the path of their section ("a / b / c") make a
    work of the first such level, named by it, its author the work's or else its title. ``path`` tells the new works of one apart.
    """
    rule = f"(?i){pattern}"
    levels = F.split("section", " / ", -1)
    found = passages.withColumn("_whole", F.coalesce(F.col("title").rlike(rule), F.lit(False)))
    found = found.withColumn("_at", F.coalesce(F.array_position(F.transform(levels, lambda x: x.rlike(rule)), True), F.lit(0)).cast("int")).filter("_whole OR _at > 0")

    def new(column: str, value: Column) -> Column:
        return F.when(F.col("_whole"), F.col(column)).otherwise(value)

    return found.select(
        *(c for c in passages.columns if c not in ("title", "author", "section")),
        F.when(~F.col("_whole"), F.array_join(F.slice(levels, 1, F.col("_at")), " / ")).alias("path"),
        new("title", F.rtrim(F.get(levels, F.col("_at") - 1), F.lit(". "))).alias("title"),
        new("author", F.coalesce(F.nullif("author", F.lit("")), "title")).alias("author"),
        new("section", F.array_join(F.slice(levels, F.col("_at") + 1, F.size(levels)), " / ")).alias("section"),
    )
