"""Hebrew that old fonts drew from the left, key by key, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of letters, of letters with a point inside, of vowels that stand before their letter when read from the right, and of one behind it.
LETTERS = dict(zip("abgdhwzxjyk$lm~n![sp@c#qrt", "אבגדהוזחטיכךלמםנןעספףצץקרת", strict=True)) | {"s": "ס", "[": "ע", "v": "שׁ", "f": "שׂ"}
POINTED = {k: c + "ּ" for k, c in zip("BGDKMPTW", "בגדכמפתו", strict=True)}
BEFORE = {
    ";": "ַ", ":": "ַ", ",": "ֶ", "'": "ָ", '"': "ָ", "e": "ֵ", "E": "ֵ", "i": "ִ", "I": "ִ", "u": "ֻ", "U": "ֻ",
    ">": "ְ", ".": "ְ", "]": "ֲ", "}": "ֱ", "{": "ֳ", "o": "ֹ", "O": "ֹ",
}
BEHIND = {"A": "ֹ"}
MARKS = "֑-ׇ"
FONT = r"(?i)bwhebb|bwhebl"


def is_visual_font(name: Column) -> Column:
    return name.rlike(FONT)


def _table(held: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in held.items() for x in pair])


def _word(word: Column) -> Column:
    """One reversed word: a fold over its keys with what is written, vowels that wait for their letter, and whether a letter was written last."""
    letters, before, behind = _table(LETTERS | POINTED), _table(BEFORE), _table(BEHIND)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("waiting"), F.lit(False).alias("letter"))

    def step(s: Column, key: Column) -> Column:
        letter, vowel, late = letters[key], before[key], behind[key]
        return (
            F.when(letter.isNotNull(), F.struct(F.concat(s["out"], letter, s["waiting"]).alias("out"), F.lit("").alias("waiting"), (s["waiting"] == "").alias("letter")))
            .when(vowel.isNotNull(), F.struct(s["out"].alias("out"), F.concat(s["waiting"], vowel).alias("waiting"), s["letter"].alias("letter")))
            .when(late.isNotNull() & s["letter"], F.struct(F.concat(s["out"], late).alias("out"), s["waiting"].alias("waiting"), F.lit(True).alias("letter")))
            .when(late.isNotNull(), F.struct(s["out"].alias("out"), F.concat(s["waiting"], late).alias("waiting"), s["letter"].alias("letter")))
            .otherwise(F.struct(F.concat(s["out"], key).alias("out"), s["waiting"].alias("waiting"), F.lit(False).alias("letter")))
        )

    keys = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(keys, start, step, lambda s: F.concat(s["out"], s["waiting"]))


def decode_visual(text: Column) -> Column:
    """``text`` as drawn from the left, in reading order: letters turned round, vowels behind their letters, marks of a letter in canonical order.

    Unknown signs stay. Words are turned one by one, so the work grows with the text.
    """
    words = F.regexp_extract_all(F.reverse(text), F.lit(r"\s+|\S+"), F.lit(0))
    turned = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\s"), w).otherwise(_word(w))), "")
    clusters = F.regexp_extract_all(turned, F.lit(rf"(?s)[{MARKS}]+|[^{MARKS}][{MARKS}]*"), F.lit(0))

    def ordered(cluster: Column) -> Column:
        # the marks' canonical classes grow with their numbers
        marks = F.filter(F.split(F.regexp_replace(cluster, f"^[^{MARKS}]", ""), ""), lambda c: c != "")
        return F.concat(F.regexp_extract(cluster, f"(?s)^([^{MARKS}]?)", 1), F.array_join(F.array_sort(marks), ""))

    return F.array_join(F.transform(clusters, lambda c: F.when(F.length(c) > 2, ordered(c)).otherwise(c)), "")
