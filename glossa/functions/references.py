"""References as integer ordinals: ``book order * 1,000,000 + chapter * 1,000 + verse``.

A reference is a closed range of ordinals; a whole chapter is verses 0 to 999 and "nn" (and following) ends at verse 999.
Books come as a table, so any corpus brings its own; ``BOOKS`` is a short one for tests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.ranges import point_join
from glossa.tables import few, map_slices, written

#: Guards of the grammar.
MOST_CHAPTERS, MOST_VERSES = 150, 176

# A few books for tests and examples: order, display name, aliases, aliases that free text may mean otherwise, and spoken forms (fixed values).
BOOKS = [
    (1, "Rdz", ["Gen", "Genesis", "1 Mojż"], ["Gn"], ["księg* rodzaju", "rodzaju", "1 księg* mojżeszow*"]),
    (2, "Wj", ["Exod", "2 Mojż"], ["Ex"], ["księg* wyjścia", "wyjścia", "2 księg* mojżeszow*"]),
    (5, "Pwt", ["Deut", "5 Mojż"], ["Dt"], ["powtórzonego prawa", "księg* powtórzonego prawa", "5 księg* mojżeszow*"]),
    (9, "1 Sm", ["1Sm", "1 Sam"], [], ["1 księg* samuela", "1 samuela"]),
    (23, "Ps", ["Psalm"], [], ["psalm*"]),
    (25, "Koh", ["Kazn"], [], ["księg* koheleta", "koheleta"]),
    (47, "Mt", ["Matt"], [], ["ewangeli* mateusza", "ewangeli* według mateusza"]),
    (48, "Mk", ["Mark"], [], ["ewangeli* marka", "ewangeli* według świętego marka", "marka"]),
    (49, "Łk", ["Luke"], [], ["ewangeli* łukasza", "łukasza"]),
    (50, "J", ["Jan", "John", "Jn"], ["Ja"], ["ewangeli* jana"]),
    (52, "Rz", ["Rom"], ["Ro"], ["list* do rzymian", "do rzymian"]),
    (53, "1 Kor", ["1Kor", "I Kor", "1 Cor"], [], ["1 list* do koryntian"]),
    (69, "1 J", ["1J", "I J"], [], ["1 list* jana"]),
    (73, "Ap", ["Obj", "Rev"], ["Re"], ["apokalips*"]),
]

# Words of spoken references: ordinals by stem, and what may stand before a chapter, before a verse and in a range (fixed values).
ORDINALS = {"pierwsz": 1, "drug": 2, "trzeci": 3, "czwart": 4, "piąt": 5, "piat": 5}
SPOKEN_CHAPTER, SPOKEN_VERSE, SPOKEN_TO = "rozdzia", ("wers", "w."), ("-", "–", "do")

DASH = "[-–—]"


def ordinal(book: Column, chapter: Column, verse: Column) -> Column:
    return (book * 1_000_000 + chapter * 1_000 + verse).cast("long")


def book_of(ordinal: Column) -> Column:
    return F.floor(ordinal / 1_000_000)


def chapter_of(ordinal: Column) -> Column:
    return F.floor(ordinal % 1_000_000 / 1_000)


def format_range(name: Column, start: Column, end: Column) -> Column:
    """``Name 3``, ``Name 3,4``, ``Name 3,4-6`` or ``Name 3,4-4,2``."""
    c1, v1, c2, v2 = chapter_of(start), start % 1_000, chapter_of(end), end % 1_000
    head = F.concat_ws(" ", name, c1.cast("string"))
    whole = (v1 == 0) & (v2 == 999)
    return (
        F.when(whole & (c1 == c2), head)
        .when(whole, F.concat(head, F.lit("-"), c2.cast("string")))
        .when(start == end, F.concat(head, F.lit(","), v1.cast("string")))
        .when(c1 != c2, F.concat(head, F.lit(","), v1.cast("string"), F.lit("-"), c2.cast("string"), F.lit(","), v2.cast("string")))
        .when(v2 == 999, F.concat(head, F.lit(","), v1.cast("string"), F.lit("nn")))
        .otherwise(F.concat(head, F.lit(","), v1.cast("string"), F.lit("-"), v2.cast("string")))
    )


#: A number of a place, with a part of a verse and "and following".
NUMBER = r"\d+[ab]?(?:nn?)?"
TAIL = re.compile(rf"{NUMBER}(?:(?:[,:.]|\s*;\s*|\s*{DASH}\s*){NUMBER})*")
FREE_TAIL = re.compile(TAIL.pattern + r"(?!\w)")
ITEM = re.compile(rf"(\d+)[ab]?(?:\s*{DASH}\s*(\d+)(?:[,:](\d+))?[ab]?)?(nn?)?")


def places(order: int, tail: str) -> list[tuple[int, int]]:
    """Ranges of what stands behind a book: chapters, ranges of chapters, a chapter's verses and lists of them, and after ";" more of these.

    Numbers above the guards and ranges that run backwards are no references (footnote numbers and pages stand there).
    """
    base, found = order * 1_000_000, []
    for part in filter(None, map(str.strip, tail.split(";"))):
        chapters = re.fullmatch(rf"(\d+)(?:\s*{DASH}\s*(\d+))?", part)
        if chapters:
            first, last = int(chapters[1]), int(chapters[2] or chapters[1])
            if first <= last <= MOST_CHAPTERS:
                found.append((base + first * 1_000, base + last * 1_000 + 999))
            continue
        split = re.match(r"(\d+)\s*[,:]\s*(.+)", part)
        if not split or int(split[1]) > MOST_CHAPTERS:
            continue
        chapter = int(split[1])
        at_chapter = base + chapter * 1_000
        for a, b, c, after in ITEM.findall(split[2]):
            verse = int(a)
            if verse > MOST_VERSES or b and not c and int(b) > MOST_VERSES:
                continue
            if c:
                end = base + int(b) * 1_000 + int(c) if int(b) >= chapter else -1
            elif b:
                end = at_chapter + int(b) if int(b) >= verse else -1
            else:
                end = at_chapter + {"": verse, "n": verse + 1, "nn": 999}[after]
            if end >= 0:
                found.append((at_chapter + verse, end))
    return found


class Canon:
    """The books that a caller lists, found in text: (order, name, aliases, ambiguous aliases, spoken forms) each.

    A word is looked up in a table of the words that aliases begin with, so a text is read once, however many books there are.
    """

    def __init__(self, books: list[tuple]) -> None:
        self.named = {book[0]: book[1] for book in books}
        self.free, self.strict, self.spoken = {}, {}, {}
        for order, name, aliases, *more in books:
            loose, spoken = [*more, [], []][:2]
            for alias in {name, *aliases}:
                self._put(self.free, alias, order)
            for alias in {name, *aliases, *loose}:
                self.strict.setdefault(alias[0].lower(), []).append((alias.lower(), order))
            for form in spoken:
                here = self.spoken
                for word in form.lower().split():
                    here = here.setdefault(word, {})
                here[""] = order
        for held in (*self.free.values(), *self.strict.values()):
            held.sort(key=lambda x: -len(x[0]))

    @staticmethod
    def _put(held: dict, alias: str, order: int) -> None:
        held.setdefault(re.match(r"\w+", alias)[0], []).append((alias, order))

    def parse(self, text: str | None) -> list[tuple[str, int, int]]:
        """(as written, start, end) of text that is a reference or a list of them: without regard to case, ambiguous aliases too."""
        text, at, found = (text or "").replace("\xa0", " "), 0, []
        low = text.lower()
        while at < len(text):
            for alias, order in self.strict.get(low[at], []):
                if low.startswith(alias, at):
                    end = at + len(alias)
                    end += text.startswith(".", end)
                    tail = TAIL.match(text, end + len(text[end:]) - len(text[end:].lstrip()))
                    if tail:
                        found += [(text[at : tail.end()], a, b) for a, b in places(order, tail[0])]
                        at = tail.end() - 1
                        break
            at += 1
        return found

    def extract(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(as written, start, end, position) in free text: aliases as they are written and whole, a space, and a place that ends where a word ends."""
        text, at, found = (text or "").replace("\xa0", " "), 0, []
        for m in re.finditer(r"\w+", text):
            if m.start() < at:
                continue
            for alias, order in self.free.get(m[0], []):
                if not text.startswith(alias, m.start()):
                    continue
                end = m.start() + len(alias)
                end += text.startswith(".", end)
                gap = end
                while gap < len(text) and text[gap].isspace():
                    gap += 1
                tail = gap > end and FREE_TAIL.match(text, gap)
                if tail:
                    at = tail.end()
                    found += [(text[m.start() : at], a, b, m.start()) for a, b in places(order, tail[0])]
                    break
        return found

    def with_spoken(self, text: str) -> str:
        """``text`` with the canonical form in brackets behind every spoken reference, unless it stands there already."""
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        out, at, i = [], 0, 0
        while i < len(words):
            found = self._named(words, i)
            place = found and self._spoken_place(text, words[found[0] - 1][2])
            if not place:
                i += 1
                continue
            end, where = place
            form = f"{self.named[found[1]]} {where}"
            out.append(text[at:end])
            if form not in text[end : end + len(form) + 4]:
                out.append(f" ({form})")
            at = end
            while i < len(words) and words[i][1] < end:
                i += 1
        return "".join([*out, text[at:]])

    def _named(self, words: list[tuple[str, int, int]], i: int) -> tuple[int, int] | None:
        """Number of the word after the longest spoken name that begins with word ``i``, and its book."""
        best, open_ = None, [self.spoken]
        for k in range(i, len(words)):
            word = words[k][0]
            also = {str(n) for stem, n in ORDINALS.items() if word.startswith(stem)}
            open_ = [node[key] for node in open_ for key in node if key and (key == word or key in also or key.endswith("*") and word.startswith(key[:-1]))]
            if not open_:
                break
            for node in open_:
                if "" in node:
                    best = (k + 1, node[""])
        return best

    @staticmethod
    def _spoken_place(text: str, at: int) -> tuple[int, str] | None:
        verse = "|".join(rf"{re.escape(v)}\w*" if v[-1] != "." else re.escape(v) for v in SPOKEN_VERSE)
        to = "|".join(map(re.escape, SPOKEN_TO))
        m = re.compile(rf"(?:\s+{SPOKEN_CHAPTER}\w+)?\s+(\d{{1,3}})(?:\s*,\s*|\s+(?:{verse})\s+|\s+)(\d{{1,3}})(?:\s*(?:{to})\s*(\d{{1,3}}))?(?![\d,])", re.I).match(text, at)
        return m and (m.end(), f"{m[1]},{m[2]}" + (f"-{m[3]}" if m[3] else ""))

    def pattern(self) -> str:
        """A pattern of references in free text, without groups."""
        names = sorted((re.escape(a) for held in self.free.values() for a, _ in held), key=len, reverse=True)
        return rf"(?<!\w)(?:{'|'.join(names)})\.?\s+{FREE_TAIL.pattern}"


def canon_rows(books: DataFrame) -> list[tuple]:
    """A table of books (order, name, aliases, loose, spoken) as ``Canon`` takes it: a dimension."""
    if not few(books, 10_000):
        raise ValueError("a canon has at most 10,000 books")
    return [(r.order, r.name, list(r.aliases or []), list(r.loose or []), list(r.spoken or [])) for r in books.collect()]


def extract_references(texts: DataFrame, books: list[tuple] = BOOKS) -> DataFrame:
    """id, ref, start, end, pos: references in (id, text), each range once a text (its first place). The whole text is read.

    Texts without a digit behind a space never reach Python.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(books)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                once = {(a, b): (i, ref, a, b, pos) for ref, a, b, pos in reversed(canon.extract(text))}
                rows += sorted(once.values(), key=lambda r: (r[4], r[2]))
            yield pd.DataFrame(rows, columns=["id", "ref", "start", "end", "pos"])

    return map_slices(texts.select("id", "text").filter(F.col("text").rlike(r"[\s\xa0][0-9]")), scan, f"id {id_type}, ref string, start long, end long, pos long")


def register(spark: SparkSession, books: list[tuple] = BOOKS, name: str = "extract_refs") -> None:
    """A table function for SQL: ``SELECT d.id, r.* FROM d, LATERAL extract_refs(d.text) r`` gives ref, start, end, pos."""

    class ExtractRefs:
        def __init__(self) -> None:
            self.canon = Canon(books)

        def eval(self, text: str):
            once = {(a, b): (ref, a, b, pos) for ref, a, b, pos in reversed(self.canon.extract(text))}
            yield from sorted(once.values(), key=lambda r: (r[3], r[1]))

    spark.udtf.register(name, F.udtf(ExtractRefs, returnType="ref string, start long, end long, pos long"))


def with_spoken(text: Column, books: list[tuple] = BOOKS) -> Column:
    """``text`` with canonical forms behind spoken references."""

    @F.pandas_udf("string")
    def add(texts: pd.Series) -> pd.Series:
        canon = Canon(books)
        return texts.map(lambda t: t if t is None else canon.with_spoken(t))

    return add(text)


def verified_references(answers: DataFrame, verses: DataFrame, books: list[tuple] = BOOKS) -> DataFrame:
    """id, ref, start, end, known: references of ``answers`` (id, text), and whether any of ``verses`` (ordinal) lies in the range.

    Distinct ranges meet the verses in buckets of a chapter or so, so a range of many chapters is one row in each.
    """
    cited = written(extract_references(answers, books).select("id", "ref", "start", "end"), "cited")
    ranges = cited.select(F.col("start").alias("r_start"), F.col("end").alias("r_end")).distinct()
    met = point_join(verses.select(F.col("ordinal").alias("point")).distinct(), ranges, 1_000).select(F.col("r_start").alias("start"), F.col("r_end").alias("end")).distinct()
    return cited.join(met.withColumn("known", F.lit(True)), ["start", "end"], "left").select("id", "ref", "start", "end", F.coalesce("known", F.lit(False)).alias("known"))
