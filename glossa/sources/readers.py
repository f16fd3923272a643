"""Sources, each a DataFrame declared over Spark's own readers wherever these express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = (
    "source string, source_id string, title string, authors array<string>, doc_type string, journal string, year int, doi string, url string, pdf_url string, license string, "
    "license_url string, access string, language string, note string, register string, perspective string, abstract string, local_file string"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON entry a line, by an explicit schema; broken lines have their text in ``broken``."""
    return spark.read.schema(MANIFEST + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def continue_manifest(known: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of ``new`` whose (source, source_id) is not known, each once."""
    return new.dropDuplicates(["source", "source_id"]).join(known.select("source", "source_id"), ["source", "source_id"], "left_anti")


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """Verses of a tagged word list: seven columns between spaces, the first a key of book, chapter and verse (BBCCVV).

    ordinal, words: array of (position, surface, lemma, pos, morph) in file order.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("at")).filter(F.size("c") >= 7)
    key = F.col("c")[0]
    ordinal = key.substr(1, 2).cast("long") * 1_000_000 + key.substr(3, 2).cast("long") * 1_000 + key.substr(5, 2).cast("long")
    surface = F.regexp_replace(F.col("c")[4], "[⸀⸁⸂⸃⸄⸅]", "")
    word = F.struct("at", surface.alias("surface"), F.col("c")[6].alias("lemma"), F.col("c")[1].alias("pos"), F.col("c")[2].alias("morph"))
    verses = lines.groupBy(ordinal.alias("ordinal")).agg(F.array_sort(F.collect_list(word)).alias("w"))
    numbered = F.transform("w", lambda x, i: F.struct((i + 1).alias("position"), x["surface"].alias("surface"), x["lemma"].alias("lemma"), x["pos"].alias("pos"), x["morph"].alias("morph")))
    return verses.select("ordinal", numbered.alias("words"))


def xml_verses(spark: SparkSession, path: str, row_tag: str = "verse") -> DataFrame:
    """Verses of an XML text: id and the words directly under the verse with lemma and morph."""
    word = "array<struct<_VALUE:string,_lemma:string,_morph:string>>"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(f"_osisID string, w {word}").load(path)
    words = F.transform("w", lambda x: F.struct(F.replace(x["_VALUE"], F.lit("/"), F.lit("")).alias("surface"), x["_lemma"].alias("lemma"), x["_morph"].alias("morph")))
    return raw.select(F.col("_osisID").alias("osis"), words.alias("words"))


def nested_bible(spark: SparkSession, path: str) -> DataFrame:
    """Books of chapters of verses as nested arrays, the place 0 of each being unused."""
    raw = spark.read.schema("abbr string, chapters array<array<string>>").option("multiLine", True).json(path)
    chapters = raw.select("abbr", F.posexplode("chapters").alias("chapter", "verses")).filter("chapter > 0")
    return chapters.select("abbr", "chapter", F.posexplode("verses").alias("verse", "text")).filter("verse > 0 AND text IS NOT NULL")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lexicon with free text before its rows; the first row of a number stands."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.monotonically_increasing_id().alias("at")).filter(F.col("c")[0].rlike("^[GH][0-9]") & (F.size("c") >= 7))
    names = ["strong", "base", "note", "lemma", "transliteration", "morph", "gloss", "meaning"]
    rows = lines.select("at", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))
    first = F.row_number().over(Window.partitionBy("strong").orderBy("at"))
    language = F.when(F.col("strong").startswith("G"), "grc").when(F.col("morph").startswith("A:"), "arc").otherwise("hbo")
    return rows.withColumn("n", first).filter("n = 1").drop("n", "at").withColumn("language", language)


def cross_references(spark: SparkSession, path: str, books: DataFrame, least_votes: int = -999) -> DataFrame:
    """from_ordinal, to_start, to_end, votes of a tab-separated edge list in dotted notation; broken rows are left out.

    ``books`` (alias, ord) is a dimension of less than a hundred rows.
    """
    raw = spark.read.option("sep", "\t").option("header", True).schema("source string, target string, votes int").csv(path)
    ends = F.split("target", "-")
    cols = raw.filter(F.col("votes") >= least_votes).select("votes", F.split("source", r"\.").alias("s"), F.split(ends[0], r"\.").alias("a"), F.split(F.element_at(ends, -1), r"\.").alias("b"))

    def placed(df: DataFrame, side: str, name: str) -> DataFrame:
        at = F.col("ord") * 1_000_000 + F.get(side, F.lit(1)).try_cast("long") * 1_000 + F.get(side, F.lit(2)).try_cast("long")
        return df.join(books, F.get(side, F.lit(0)) == F.col("alias")).withColumn(name, at).drop("alias", "ord")

    for side, name in (("s", "from_ordinal"), ("a", "to_start"), ("b", "to_end")):
        cols = placed(cols, side, name)
    return cols.filter("from_ordinal IS NOT NULL AND to_start <= to_end").select("from_ordinal", "to_start", "to_end", "votes")


def places(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """place_id, name, lon, lat, confidence, rank: candidate locations, the best ``most``, with their share of the votes."""
    resolution = "struct<lonlat:string,lonlat_type:string,best_path_score:int,type:string,special:string>"
    schema = f"id string, friendly_id string, identifications array<struct<id_source:string,resolutions array<{resolution}>>>".replace("resolutions array", "resolutions:array")
    raw = spark.read.schema(schema).json(path)
    found = raw.select(F.col("id").alias("place_id"), F.col("friendly_id").alias("name"), F.explode("identifications").alias("i"))
    each = found.select("place_id", "name", F.explode("i.resolutions").alias("r")).filter("r.special IS NULL AND r.lonlat IS NOT NULL")
    once = each.groupBy("place_id", "name", "r.lonlat").agg(F.max("r.best_path_score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("score"), "lonlat"))
    best = once.withColumn("rank", rank).filter(F.col("rank") <= most)
    share = F.round(F.col("score") / F.sum("score").over(Window.partitionBy("place_id")), 3)
    lonlat = F.split("lonlat", ",")
    return best.select("place_id", "name", lonlat[0].cast("double").alias("lon"), lonlat[1].cast("double").alias("lat"), share.alias("confidence"), "rank")


def abstract(inverted: Column) -> Column:
    """Text of an inverted index (map of word to its positions)."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def bibtex(text: Column) -> Column:
    """Entries of a BibTeX text: array of (kind, key, fields as a map with lower-case names)."""
    entries = F.regexp_extract_all(text, F.lit(r"(?s)@\w+\s*\{.*?\n\}"), F.lit(0))

    def entry(e: Column) -> Column:
        pattern = r'(?s)(\w+)\s*=\s*(?:\{([^{}]*)\}|"([^"]*)"|(\d+))'
        names = F.transform(F.regexp_extract_all(e, F.lit(pattern), F.lit(1)), F.lower)
        values = [F.regexp_extract_all(e, F.lit(pattern), F.lit(i)) for i in (2, 3, 4)]
        fields = F.map_from_arrays(names, F.transform(F.arrays_zip(*(v.alias(f"v{i}") for i, v in enumerate(values))), lambda z: F.concat(z["v0"], z["v1"], z["v2"])))
        return F.struct(F.lower(F.regexp_extract(e, r"@(\w+)", 1)).alias("kind"), F.regexp_extract(e, r"\{\s*([^,\s]+)", 1).alias("key"), fields.alias("fields"))

    return F.transform(entries, entry)


def html_text(html: Column) -> Column:
    """Plain text of a page: headings with #, list items with -, quotations with >, white space collapsed, no scripts,
    styles, menus or footers. Entities of the basic set are decoded."""
    steps = [
        (r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|noscript|head)\b.*?(?:</\1\s*>|\z)", " "),
        (r"(?i)<h[1-6][^>]*>", "\n# "),
        (r"(?i)<li[^>]*>", "\n- "),
        (r"(?i)<blockquote[^>]*>", "\n> "),
        (r"(?i)</?(p|div|br|tr|ul|ol|table|section|article|h[1-6])\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
        ("&nbsp;|\\u00a0", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&amp;", "&"),
        (r"[ \t]+", " "),
        (r" ?\n[ \n]*", "\n"),
    ]
    for pattern, value in steps:
        html = F.regexp_replace(html, pattern, value)
    return F.trim(F.btrim(html, F.lit("\n ")))


def _windows(body: Column) -> Column:
    """Bytes by the Windows code page: Latin-1 but for the controls from 80 to 9F."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return F.translate(F.decode(body, "ISO-8859-1"), "".join(a for a, b in pairs if b), "".join(b for _, b in pairs))


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else the Windows code page that servers mean by latin1."""
    latin = F.lower(content_type).rlike("charset=(iso-8859-1|latin1|windows-1252)")
    return F.when(latin, _windows(body)).otherwise(F.coalesce(F.try_validate_utf8(body.cast("string")), _windows(body)))
