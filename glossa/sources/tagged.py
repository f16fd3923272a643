"""A tagged Greek text in lines of (book, chapter, verse, words with marks), renumbered, with lemmas by lists of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.references import ordinal
from glossa.tables import few

#: A word, the id of its lexeme, its form, and numbers behind it.
WORD = r"(\S+?)<S>([0-9]{6})</S><m>([^<]+)</m>((?:<S>[0-9]+</S>)*)"
#: Numbers from here on are of another list.
LAST_NUMBER = 9_999

# Psalms of the Greek numbering by chapter and verse, and what is added to each for the Hebrew one.
PSALMS = [
    (1, 8, 0, 999, 0, 0), (9, 9, 0, 21, 0, 0), (9, 9, 22, 999, 1, -21), (10, 112, 0, 999, 1, 0), (113, 113, 0, 8, 1, 0), (113, 113, 9, 999, 2, -8),
    (114, 114, 0, 999, 2, 0), (115, 115, 0, 999, 1, 9), (116, 145, 0, 999, 1, 0), (146, 146, 0, 999, 1, 0), (147, 147, 0, 999, 0, 11), (148, 150, 0, 999, 0, 0),
]
MAP = "order int, from_chapter int, to_chapter int, from_verse int, to_verse int, chapters int, verses int"


def psalm_map(spark: SparkSession, order: int) -> DataFrame:
    return spark.createDataFrame([(order, *row) for row in PSALMS], MAP)


def renumbered(verses: DataFrame, pieces: DataFrame) -> DataFrame:
    """``verses`` (order, chapter, verse, ..) by another numbering: ``pieces`` (``MAP``) say what is added in which ranges.

    Books without pieces stay; a verse of a book with pieces that lies in none of them goes. Pieces are a dimension of few rows.
    """
    if not few(pieces):
        raise ValueError("pieces of a numbering are a dimension")
    listed = F.broadcast(pieces.select(F.col("order").alias("_o")).distinct())
    inside = (F.col("order") == F.col("_p.order")) & F.col("chapter").between(F.col("_p.from_chapter"), F.col("_p.to_chapter")) & F.col("verse").between(F.col("_p.from_verse"), F.col("_p.to_verse"))
    side = F.broadcast(pieces.select(F.struct("*").alias("_p")))
    found = verses.join(listed, F.col("order") == F.col("_o"), "left").join(side, inside, "left").filter("_o IS NULL OR _p IS NOT NULL")
    moved = {c: (F.col(c) + F.coalesce(F.col(f"_p.{c}s"), F.lit(0))).cast(verses.schema[c].dataType) for c in ("chapter", "verse")}
    return found.withColumns(moved).drop("_o", "_p")


def lexeme_list(spark: SparkSession, ids: str, lemmas: str) -> DataFrame:
    """lexeme, lemma: the second columns of two lists whose lines go together; of an id in several lines the first one counts.

    Both are dictionaries' lists, read as wholes so that their lines keep their places.
    """

    def second(path: str, name: str) -> DataFrame:
        lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
        return lines.select(F.posexplode("lines").alias("line", "text")).select("line", F.get(F.split("text", "\t"), 1).alias(name))

    both = second(ids, "lexeme").join(second(lemmas, "lemma"), "line").filter("lexeme IS NOT NULL AND lemma IS NOT NULL")
    return both.groupBy("lexeme").agg(F.min_by("lemma", "line").alias("lemma"))


def words_of(text: Column) -> Column:
    """Array of (position, surface, lexeme, strong, morph, pos) of a line's marked words; the first number of the common list counts."""
    found = [F.regexp_extract_all(text, F.lit(WORD), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*(f.alias(c) for f, c in zip(found, ("surface", "lexeme", "morph", "numbers"), strict=True)))

    def word(z: Column, i: Column) -> Column:
        numbers = F.filter(F.transform(F.regexp_extract_all(z["numbers"], F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long")), lambda n: n <= LAST_NUMBER)
        morph = F.regexp_replace(z["morph"], r"^lxx\.", "")
        strong = F.coalesce(F.concat(F.lit("G"), F.get(numbers, F.lit(0)).cast("string")), F.lit(""))
        return F.struct((i + 1).alias("position"), z["surface"].alias("surface"), z["lexeme"].alias("lexeme"), strong.alias("strong"), morph.alias("morph"), F.split(morph, r"\.")[0].alias("pos"))

    return F.transform(zipped, word)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_order, book, chapter, verse, text of the lines with four columns. Order is by file, place of the split, and place in it, however the file is cut."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    parts = F.split("value", "\t", 4)
    order = F.struct("file_path", "file_block_start", "at").alias("line_order")
    numbers = [F.expr(f"try_cast(parts[{i}] AS int)").alias(c) for i, c in enumerate(("book", "chapter", "verse"))]
    return lines.select(order, parts.alias("parts")).filter(F.size("parts") == 4).select("line_order", *numbers, F.col("parts")[3].alias("text"))


def tagged_verses(lines: DataFrame, books: DataFrame, pieces: DataFrame, lexemes: DataFrame) -> DataFrame:
    """order, chapter, verse, ordinal, text, tokens of ``lines`` (line_order, book, chapter, verse, text).

    ``books`` (book, order, chapter_is) has the books' numbers; where chapter_is is given the book is that chapter of its order and only
    its first chapter counts. Of lines that come to the same verse the first counts; lines without marked words are left out. ``lexemes``
    (lexeme, lemma) gives words their lemmas.
    """
    own = lines.join(F.broadcast(books), "book").filter("chapter_is IS NULL OR chapter = 1")
    placed = renumbered(own.withColumn("chapter", F.coalesce("chapter_is", "chapter")).drop("chapter_is", "book"), pieces)
    first = Window.partitionBy("order", "chapter", "verse").orderBy("line_order")
    once = placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "line_order")
    marked = once.select("order", "chapter", "verse", F.explode(words_of(F.col("text"))).alias("t")).select("order", "chapter", "verse", "t.*")
    named = marked.join(F.broadcast(lexemes) if few(lexemes) else lexemes, "lexeme", "left")
    token = F.struct("position", "surface", F.coalesce("lemma", F.lit("")).alias("lemma"), "strong", "morph", "pos")
    verses = named.groupBy("order", "chapter", "verse").agg(F.sort_array(F.collect_list(token)).alias("tokens"))  # the words of one verse
    text = F.array_join(F.transform("tokens", lambda t: t["surface"]), " ")
    return verses.select("order", "chapter", "verse", ordinal(F.col("order"), F.col("chapter"), F.col("verse")).alias("ordinal"), text.alias("text"), "tokens")
