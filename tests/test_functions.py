"""Scalar functions by literal goldens."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import references
from glossa.functions import text as T


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("lang", "given", "wanted"),
    [("grc", "Ἐν ἀρχῇ ἦν ὁ λόγος", "εν αρχη ην ο λογοσ"), ("hbo", "בְּ/רֵאשִׁ֖ית", "בראשית"), ("pl", "  Słowo,  BOŻE! ", "słowo boże")],
)
def test_normalize(spark, lang, given, wanted):
    assert value(spark, T.normalize(F.col("t"), F.col("l")), t=given, l=lang) == wanted


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.fold_accents, "Éàç œß łø", "Eac œß łø"),
        (T.canonical_translit, "Shabbath", "sabat"),
        (T.script, "λόγος", "grc"),
        (T.script, "שלום", "hbo"),
        (T.clean_text, "hy-\nphen  and12 \n\n\n\n end ", "hyphen and \n\n end"),
        (T.header_key, " Page 12  of 30", "page of"),
        (T.strong_number, "g0025A", "G25a"),
        (T.strong_number, "x25", None),
        (T.seconds_mark, "at [1:02:03] of", 3723),
        (T.seconds_mark, "at [02:03] of", 123),
        (T.seconds_mark, "none", None),
        (T.license_label, "Under CC BY-NC-ND 4.0", "CC BY-NC-ND"),
        (T.name_key, "Müller, Anna Maria", "muller|anna"),
        (T.name_key, "Anna Maria Müller", "muller|anna"),
        (T.json_block, 'Sure: ```json\n{"a": [1]}\n``` done', '{"a": [1]}'),
        (T.json_block, "nothing", None),
        (T.redact_urls, "see https://x.example/a b", "see [url] b"),
        (T.refusal, "I cannot answer that.", True),
        (T.title_key, "Über Éa: on. Rest", "uber ea on"),
        (T.translit_stem, "tartaros", "tartar"),
        (T.detect_language, "the cat and the dog is in the house", "en"),
        (T.detect_language, "", None),
    ],
)
def test_text(spark, function, given, wanted):
    assert value(spark, function(F.col("t")), t=given) == wanted


def test_snippet_and_highlight(spark):
    text = "a" * 50 + " word " + "b" * 50
    assert value(spark, T.snippet(F.col("t"), "word", 20), t=text) == "…" + text[41:61] + "…"
    assert value(spark, T.snippet(F.col("t"), "absent", 20), t=text) is None
    assert value(spark, T.highlight(F.col("t"), "word"), t="<Word>") == "&lt;<mark>Word</mark>&gt;"


def test_translation_needs_a_free_licence(spark):
    given = [("CC BY", "open", True), ("CC BY-ND", "open", False), ("all rights", "open", False), ("all rights", "personal", True), (None, "open", False)]
    df = spark.createDataFrame(given, "l string, a string, w boolean")
    assert all(r.v == r.w for r in df.select("w", T.translation_allowed(F.col("l"), F.col("a")).alias("v")).collect())


@pytest.mark.parametrize(("start", "end", "wanted"), [(47005003, 47005003, "Mt 5,3"), (47005003, 47005012, "Mt 5,3-12"), (47005000, 47005999, "Mt 5"), (47005003, 47006002, "Mt 5,3-6,2"), (47005003, 47005999, "Mt 5,3nn")])
def test_ranges_are_written_as_read(spark, start, end, wanted):
    df = spark.createDataFrame([("Mt", start, end)], "n string, a long, b long")
    assert df.select(references.format_range(F.col("n"), F.col("a"), F.col("b")).alias("v")).first().v == wanted
    assert references.Canon(references.BOOKS).extract(wanted)[0][1:3] == (start, end)


def test_reference_grammar_rejects():
    canon = references.Canon(references.BOOKS)
    assert canon.extract("Mt 9,8-3") == [] and canon.extract("Mt 151") == [] and canon.extract("Mtx 5") == [] and canon.extract(None) == []


def test_query_language():
    from glossa.functions.query import Every, Near, Term, Without, page_number, parse

    w = lambda t: Term("word", t)
    q = parse('grace NEAR/3 truth "In the  beginning" -law g0026B lemma:Logos NEAR')
    assert q == Every((Near(w("grace"), w("truth"), 3), Term("phrase", "in the beginning"), Without(w("law")), Term("number", "G26b"), Term("lemma", "logos"), w("near")))
    assert parse("NEAR/2 x") == Every((w("near/2"), w("x")))
    assert parse('"a b" near c') == Every((Near(Term("phrase", "a b"), w("c"), 2),))
    assert parse("") == parse("  ") == Every(())
    for bad in ("x" * 5000, "a NEAR/1001 b", None):
        with pytest.raises(ValueError, match="query|NEAR"):
            parse(bad)
    assert [page_number(x) for x in ("3", "0", "x", None, 10**9)] == [3, 1, 1, 1, 1_000_000]


def test_query_conditions_against_plain_python(spark):
    import random

    from glossa.functions import query

    rng, words = random.Random(5), ["a", "b", "c", "d", "e"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, w array<string>")

    def near(w, a, b, gap):
        return any(w[i : i + len(a)] == a and w[j : j + len(b)] == b and i != j and 0 <= (j - i - len(a) if i < j else i - j - len(b)) <= gap for i in range(len(w)) for j in range(len(w)))

    cases = {
        "a b": lambda w: "a" in w and "b" in w,
        "a -b": lambda w: "a" in w and "b" not in w,
        '"a b c"': lambda w: any(w[i : i + 3] == ["a", "b", "c"] for i in range(len(w))),
        "a NEAR/0 b": lambda w: near(w, ["a"], ["b"], 0),
        "a NEAR c -d": lambda w: near(w, ["a"], ["c"], 2) and "d" not in w,
        "a NEAR/1 a": lambda w: near(w, ["a"], ["a"], 1),
        '"a b" NEAR/1 e': lambda w: near(w, ["a", "b"], ["e"], 1),
        "": lambda w: True,
    }
    for text, meets in cases.items():
        found = {r.i for r in df.filter(query.condition(query.parse(text), F.col("w"))).collect()}
        assert found == {i for i, w in rows if meets(w)}, text
    for text in ("G1", "lemma:x"):
        with pytest.raises(ValueError, match="rows have no"):
            query.condition(query.parse(text), F.col("w"))


@pytest.mark.parametrize(("word", "key"), [("chesed", "hesed"), ("ḥesed", "hesed"), ("hessed", "hesed"), ("che.sed", "hesed"), ("szalom", "salom"), ("shalom", "salom"), ("torah", "tora"), ("qodesh", "kodes"), ("YHWH", "jhv")])
def test_canonical_transliteration(spark, word, key):
    from glossa.functions import text as T

    assert spark.createDataFrame([(word,)], "w string").select(T.canonical_translit(F.col("w")).alias("k")).first().k == key


def test_snippets_at_the_first_hit(spark):
    text = "W początku " * 12 + "był λόγος i Λόγον potem " + "dalszy ciąg tekstu " * 30
    place = lambda *a: value(spark, T.hit_place(F.col("t"), *a), t=text)
    assert place(["λογον"], "grc") == text.index("Λόγον") and place(["λογοσ", "λογον"], "grc") == text.index("λόγος")
    assert place(["θεοσ"], "grc") is None and place(["θεοσ"], "grc", ["absent", "POCZATKU"]) == text.index("początku")
    at = text.index("λόγος")
    assert value(spark, T.snippet_at(F.col("t"), F.lit(at), 100), t=text) == "… " + text[at - 50 : at + 100].strip() + " …"
    assert value(spark, T.snippet_at(F.col("t"), F.lit(None).cast("int"), 40), t="short") == "short"
    assert value(spark, T.highlight_words(F.col("t"), ["ala", "", "<b>"]), t="Ala <B> x") == "<mark>Ala</mark> <mark>&lt;B&gt;</mark> x"
    hebrew = "בְּרֵאשִׁ֖ית בָּרָ֣א אֱלֹהִ֑ים"
    assert value(spark, T.hit_place(F.col("t"), ["ברא"], "hbo"), t=hebrew) == hebrew.index("בָּרָ֣א")


def test_a_fingerprint_is_a_tree(spark):
    from glossa.operators import corpus

    rows = [(i, f"t{i}") for i in range(130)]
    import hashlib
    import json

    level = [(i, hashlib.sha256(json.dumps({"k": k, "t": t}, separators=(",", ":")).encode()).hexdigest()) for i, (k, t) in enumerate(rows)]
    first = True
    while first or level[-1][0] - level[0][0] >= 5:
        groups = {}
        for b, h in level:
            groups.setdefault(b // 5, []).append(h)
        level = [(b, hashlib.sha256(",".join(hs).encode()).hexdigest()) for b, hs in sorted(groups.items())]
        first = False
    wanted = hashlib.sha256(",".join(h for _, h in level).encode()).hexdigest()
    got = corpus.fingerprint(spark.createDataFrame(rows, "k long, t string").repartition(4), "k", ["k", "t"], 5).first()
    assert (got.sha256, got.n) == (wanted, 130)


def test_hebrew_codes(spark):
    from glossa.functions import editorial as E

    told = {
        "HC/Vqw3ms": "conjunction + verb, qal, sequential imperfect, 3rd person, masculine, singular", "HR/Ncmsa": "preposition + noun, common, masculine, singular, absolute", "HNpl": "noun, proper, place", "HNp": "noun, proper",
        "HTd/Aafpd": "particle, definite article + adjective, feminine, plural, determined", "ANcmsd": "Aramaic: noun, common, masculine, singular, determined", "HVhc": "verb, hiphil, infinitive construct",
        "HPp3ms": "pronoun, personal, 3rd person, masculine, singular", "AVap3fs": "Aramaic: verb, aphel, perfect, 3rd person, feminine, singular", "HRd/To": "preposition, with article + particle, direct object marker", "HSp1cp": "suffix, pronominal, 1st person, common, plural",
        "HX": "", "": "", "HD": "adverb", "HC": "conjunction",
    }
    got = spark.createDataFrame([(c,) for c in told], "c string").select("c", E.hebrew_morphology(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in got} == told
