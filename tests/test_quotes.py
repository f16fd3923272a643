"""Quotations: extraction, attachment, verification and location, against plain Python over all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import quotes, seeds, verify

ANSWER = (
    "First „In the beginning was the word” [1], later. Then \"a second saying of length\" is told in [2; P1] and more. "
    "See [3]: «a third one that stands behind» ends. “one without a citation at all” here.\n"
    "„joined with the next one” and „the next one of these” [P2]. Mt 5,3 ABC: blessed are they who mourn [4] Mk 1,2 XYZ: a voice that cries out\n"
    "ἐν ἀρχῇ ἦν ὁ λόγος. „short”"
)


def test_passages_and_what_cites_them(spark):
    df = spark.createDataFrame([(7, ANSWER, ["1", "2", "3", "P1", "P2"]), (8, None, ["1"]), (9, "", [])], "answer_id long, text string, available array<string>")
    rows = quotes.extracted(df).orderBy("ord").collect()
    assert [(r.quote, list(r.refs), r.reason, r.tradition) for r in rows] == [
        ("In the beginning was the word", ["1"], None, False),
        ("a second saying of length", ["2", "P1"], None, False),
        ("a third one that stands behind", ["3"], None, False),
        ("one without a citation at all", [], None, False),
        ("joined with the next one", ["P2"], None, True),
        ("the next one of these", ["P2"], None, True),
        ("blessed are they who mourn", ["4"], "missing_source", False),
        ("a voice that cries out", ["4"], "missing_source", False),
        ("ἐν ἀρχῇ ἦν ὁ λόγος", [], None, False),
        ("short", [], None, False),
    ]
    for r in rows:
        assert ANSWER[r.start : r.end].strip("„”\"«»“ ").startswith(r.quote[:5])


def test_verdicts(spark):
    df = spark.createDataFrame([(7, ANSWER, ["1", "2", "3", "P1", "P2"])], "answer_id long, text string, available array<string>")
    sources = [
        (7, "1", "So: in the BEGINNING, was the Word of old."), (7, "2", "a second saying of length, here"), (7, "P1", "nothing like it"), (7, "3", "x y z"),
        (7, "P2", "he joined with the next ones"), (7, "9", "one without a citation at all is here"), (8, "1", "ἐν ἀρχῇ ἦν ὁ λόγος"),
    ]
    found = {r.ord: (r.status, r.reason) for r in quotes.verified(quotes.extracted(df), spark.createDataFrame(sources, "answer_id long, label string, text string")).collect()}
    assert found[0] == ("ok", None)
    assert found[1] == ("unverified", "source_mismatch")  # every source that is cited must have it
    assert found[2] == ("unverified", "source_mismatch")
    assert found[3] == ("ok", None)
    assert found[4][0] == "ok" and found[5][1] == "translation_or_mismatch"
    assert found[6] == ("unverified", "invalid_citation")
    assert found[8] == ("unverified", "no_matching_source")
    assert 9 not in found  # short and without a citation


@pytest.mark.parametrize("seed", range(3))
def test_rare_words_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(d, rng.choices(pool, weights, k=rng.randrange(0, 30))) for d in range(60)]
    asked = [(q, rng.choices(pool, weights, k=rng.randrange(1, 12)), rng.randrange(0, 4)) for q in range(30)] + [(30, ["nowhere", "w1"], 0), (31, ["nowhere", "w1"], 1)]
    wanted = {(q, d) for q, w, lose in asked for d, held in docs if len(set(w) & set(held)) >= max(len(set(w)) - lose, 0) and (set(w) & set(held))}
    pairs = seeds.rare_word_pairs(spark.createDataFrame(asked, "quote_id long, words array<string>, may_lose int"), spark.createDataFrame(docs, "doc_id long, text array<string>"), lambda words: words)
    found = {(r.quote_id, r.doc_id) for r in pairs.collect()}
    # texts that may lose all their words would be in every document: pairs without a common word are left out
    assert found == {(q, d) for q, d in wanted}


def _texts(rng, n):
    pool = [f"{a}{b}" for a in ("river", "stone", "lamp", "cloud", "grain", "tower") for b in ("", "s", "ing", "ed", "er")] + ["the", "of", "and"] * 8
    return [" ".join(rng.choices(pool, k=rng.randrange(30, 160))) for _ in range(n)]


def test_places_of_exact_and_shortened_quotations(spark):
    rng = random.Random(5)
    texts = _texts(rng, 25) + ["Mixed – CASE and «marks»\n\nand   spaces 'here'", "", None]
    asked = []
    for t in texts[:20]:
        a = rng.randrange(0, len(t) // 2)
        b = a + rng.randrange(3, 60)
        asked += [t[a:b], f"{t[a:b]} … {t[b + 5 : b + 40]}", f"{t[b + 5 : b + 40]} (...) {t[a:b]}"]
    asked += ["mixed - case and \"marks\" and spaces", "river", "a", "…", "", None, "nowhere to be found in these"]
    found = {(r.quote_id, r.doc_id): (r.start, r.end, r.kind, r.before, r.after) for r in quotes.located(spark.createDataFrame(list(enumerate(asked)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = {}
    for q, quote in enumerate(asked):
        for d, text in enumerate(texts):
            place = quotes.locate(quote, text) if quote and text else None
            if place and place[2] in ("exact", "elided"):
                wanted[q, d] = (*place, *quotes.around(text, *place[:2]))
    assert found == wanted and len(wanted) > 60
    for (q, d), (start, end, kind, *_) in found.items():
        if kind == "exact":
            assert quotes.fold_places(texts[d][start:end])[0].strip() == quotes.shortened(asked[q])[0]


def best_of_all_windows(quote, text):
    whole, hay = " ".join(quotes.shortened(quote)), quotes.fold_places(text)[0]
    n, best, begin = len(whole), 0.0, -1
    for j in range(0, max(len(hay) - n, 0) + 1, max(n // 4, 8)):
        r = difflib.SequenceMatcher(None, whole, hay[j : j + n], autojunk=False).ratio()
        if r > best:
            best, begin = r, j
    return (best, begin) if best >= verify.ALTERED else None


def test_near_places_are_those_of_all_windows(spark):
    rng = random.Random(11)
    texts = _texts(rng, 30)
    asked, cases = [], 0
    for t in texts:
        words = t.split()
        a = rng.randrange(0, len(words) - 14)
        said = words[a : a + 14]
        for k in rng.sample(range(14), 3):
            said[k] = rng.choice(["zebra", "quilt", said[k] + "x"])
        asked.append(" ".join(said))
    found = {(r.quote_id, r.doc_id): (r.start, r.kind) for r in quotes.located(spark.createDataFrame(list(enumerate(asked)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=0.65).collect()}
    for q, quote in enumerate(asked):
        best = best_of_all_windows(quote, texts[q])
        own = set(quote.split())
        if best and len(own & set(texts[q].split())) >= 0.65 * len(own):
            cases += 1
            assert found[q, q][0] - best[1] in (0, 1) and found[q, q][1] == "near"  # a space at a window's edge is no part of the place
    assert cases > 20


def test_similarity_is_that_of_all_windows():
    rng = random.Random(3)
    texts = _texts(rng, 8)
    for quote, text in [(rng.choice(texts)[10:60], rng.choice(texts)) for _ in range(30)] + [("abc", ""), ("", "abc"), ("long" * 30, "short")]:
        n = len(quote)
        if quote in text:
            wanted = 1.0
        elif len(text) <= 2 * n:
            wanted = difflib.SequenceMatcher(None, quote, text).ratio()
        else:
            wanted = max(difflib.SequenceMatcher(None, quote, text[i : i + n + n // 4]).ratio() for i in range(0, len(text) - n + 1, max(n // 4, 8)))
        assert verify.similarity(quote, text) == wanted


def test_empty_tables(spark):
    none = spark.createDataFrame([], "quote_id long, quote string")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert quotes.located(none, docs).count() == 0
    assert quotes.located(spark.createDataFrame([(1, "a quote of some words")], "quote_id long, quote string"), docs.filter(F.lit(False))).count() == 0
    assert quotes.extracted(spark.createDataFrame([], "answer_id long, text string, available array<string>")).count() == 0
