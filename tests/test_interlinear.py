"""Interlinear verses against plain Python."""

import random

import pytest

from glossa.operators import interlinear as I

TOKEN = "struct<position:int,surface:string,lemma:string,lemma_norm:string,strong:string,morph:string,pos:string,gloss:string>"
ORIGINALS, TRANSLATIONS = {"NT": "GNT", "OT": "WLC", "DC": "LXX"}, ["SNP", "BG"]


@pytest.fixture(scope="module")
def corpus(spark):
    token = lambda i, s, **k: (i, s, k.get("lemma", ""), k.get("norm", ""), k.get("strong", ""), k.get("morph", ""), k.get("pos", ""), k.get("gloss"))
    texts = [
        (50_002_006, "GNT", "ἁρπαγμὸν ἡγήσατο", [token(2, "ἡγήσατο", strong="G9", gloss=""), token(1, "ἁρπαγμὸν", strong="G725", gloss="grabieżą", morph="----ASM-", pos="N-", lemma="ἁρπαγμός")]),
        (50_002_007, "GNT", "ἐκένωσεν", [token(1, "ἐκένωσεν", norm="κενοω", morph="3AAI-S--", pos="V-")]), (50_002_008, "GNT", "x", [token(1, "x", strong="G2758b"), token(2, "y", strong="H1")]), (50_002_009, "GNT", "", []),
        (50_002_006, "BG", "Który będąc", None), (50_002_006, "SNP", "closed", None), (50_002_007, "LXX", "z", []), (50_001_001, "BG", "a", None), (50_004_001, "BG", "b", None), (51_001_001, "BG", "c", None), (1_001_001, "WLC", "h", [token(1, "h", morph="HNcmsa")]),
    ]
    works = [("GNT", "grc", "open"), ("WLC", "hbo", "open"), ("LXX", "grc", "open"), ("BG", "pl", "open"), ("SNP", "pl", "private")]
    lexemes = [("G725", "ἁρπαγμός", "αρπαγμοσ", "grabież, zdobycz"), ("G2758", "κενόω", "κενοω", "opróżnić, ogołocić"), ("G9999", "κενόω", "κενοω", "other")]
    return (
        spark.createDataFrame(texts, f"ordinal long, work string, text string, tokens array<{TOKEN}>"), spark.createDataFrame(works, "code string, language string, access string"),
        spark.createDataFrame(lexemes, "strong string, lemma string, lemma_norm string, gloss string"), spark.createDataFrame([(50, "NT"), (51, "NT"), (1, "OT")], "order long, part string"),
    )


REQUEST = "request_id int, place int, start long, end long, asked string, translation string"


def test_words_glosses_and_translation(spark, corpus):
    texts, works, lexemes, books = corpus
    asked = spark.createDataFrame([(1, 0, 50_002_006, 50_002_007, None, None), (1, 1, 50_002_007, 50_002_009, None, None), (2, 0, 1_001_001, 1_001_001, None, "snp"), (3, 0, 50_002_007, 50_002_007, "lxx", None), (4, 0, 99_001_001, 99_001_009, None, None)], REQUEST)
    got = {(r.request_id, r.ordinal): r for r in I.interlinear(asked, texts, works, lexemes, books, ORIGINALS, TRANSLATIONS).collect()}
    assert sorted(got) == [(1, 50_002_006), (1, 50_002_007), (1, 50_002_008), (1, 50_002_009), (2, 1_001_001), (3, 50_002_007)]
    first, second = got[1, 50_002_006].words
    assert (first.surface, first.gloss, first.from_dictionary, first.translit, first.strong) == ("ἁρπαγμὸν", "grabieżą", False, "harpagmon", "G725")
    assert first.morph == "noun, accusative, singular, masculine" and (second.gloss, second.strong) == ("", "G9")
    (third,) = got[1, 50_002_007].words
    assert (third.gloss, third.from_dictionary, third.strong, third.lemma) == ("opróżnić", True, "G2758", "κενόω")
    assert [(w.strong, w.gloss) for w in got[1, 50_002_008].words] == [("G2758", "opróżnić"), ("H1", "")] and got[1, 50_002_009].words is None
    assert got[1, 50_002_006].translation == "Który będąc" and got[1, 50_002_007].translation == "" and got[3, 50_002_007].base == "LXX"
    assert got[2, 1_001_001].words[0].morph == "noun, common, masculine, singular, absolute" and not got[1, 50_002_006].truncated
    closed = {(r.request_id, r.ordinal): r.translation for r in I.interlinear(asked, texts, works, lexemes, books, ORIGINALS, TRANSLATIONS, ["open", "work:SNP"]).collect()}
    assert closed[1, 50_002_006] == "closed"
    few = I.interlinear(asked, texts, works, lexemes, books, ORIGINALS, TRANSLATIONS, limit=2).filter("request_id = 1").orderBy("ord").collect()
    assert [r.ordinal for r in few] == [50_002_006, 50_002_007] and all(r.truncated for r in few)
    assert I.interlinear(asked, texts, works, lexemes, books, ORIGINALS, TRANSLATIONS, []).count() == 0


def test_what_else_there_is(spark, corpus):
    texts, works, _, books = corpus
    asked = spark.createDataFrame([(1, 0, 50_002_006, 50_002_007, None, None), (2, 0, 50_002_006, 50_002_006, None, None), (3, 0, 1_001_001, 1_001_001, None, None)], REQUEST)
    assert [tuple(r) for r in I.alternatives(asked, texts, works, books, ORIGINALS).collect()] == [(1, "LXX")]
    around = {r.request_id: (r.before, r.after) for r in I.chapters_around(asked, texts.select("ordinal")).collect()}
    assert around == {1: (50_001_000, 50_004_000), 2: (50_001_000, 50_004_000), 3: (None, 50_001_000)}


def test_chapters_against_a_scan(spark):
    rng = random.Random(8)
    verses = sorted({rng.randrange(1, 4) * 1_000_000 + rng.randrange(1, 6) * 1_000 + rng.randrange(1, 9) for _ in range(40)})
    rows = [(i, p, s, s + rng.randrange(0, 2_000), None, None) for i in range(30) for p, s in enumerate(rng.choices(verses, k=2))]
    got = {r.request_id: (r.before, r.after) for r in I.chapters_around(spark.createDataFrame(rows, REQUEST), spark.createDataFrame([(v,) for v in verses], "ordinal long")).collect()}
    chapters = sorted({v // 1_000 * 1_000 for v in verses})
    for i in range(30):
        own = [r for r in rows if r[0] == i]
        first, last = own[0][2] // 1_000 * 1_000, own[-1][3] // 1_000 * 1_000
        assert got[i] == (max((c for c in chapters if c < first), default=None), min((c for c in chapters if c > last), default=None))
