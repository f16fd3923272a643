"""Contexts under a budget, outside work, running headers, old fonts, stems and cleaning, against plain Python."""

import os
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import visual
from glossa.operators import context, groups, outside


def fitted_by_a_loop(sizes, base, budget):
    """Rows that stay: while the estimate is too long, the last row of the last list that may lose one goes."""
    lists = {name: list(sizes.get(name, [])) for name in context.LISTS}

    def tokens():
        return int((base + sum(map(sum, lists.values()))) / 2.8) + 1

    for name in reversed(context.LISTS):
        while budget is not None and tokens() > budget and len(lists[name]) > (name == "chunks"):
            lists[name].pop()
    return {name: len(held) for name, held in lists.items()}, tokens()


@pytest.mark.parametrize("budget", [None, 50, 400, 2_000])
def test_lists_under_one_budget(spark, budget):
    rng = random.Random(7)
    queries = {q: ({name: [rng.randrange(0, 500) for _ in range(rng.randrange(0, 6))] for name in context.LISTS}, rng.randrange(0, 900)) for q in range(40)}
    items = spark.createDataFrame([(q, name, i, s) for q, (lists, _) in queries.items() for name, held in lists.items() for i, s in enumerate(held)], "query_id long, list string, rank int, size int")
    base = spark.createDataFrame([(q, b) for q, (_, b) in queries.items()], "query_id long, chars int")
    kept = context.fit_lists(items, base, budget)
    got = {(r.query_id, r.list): r.n for r in kept.filter("kept").groupBy("query_id", "list").agg(F.count("*").alias("n")).collect()}
    report = {r.query_id: r for r in context.budget_report(kept, base).collect()}
    for q, (lists, chars) in queries.items():
        wanted, after = fitted_by_a_loop(lists, chars, budget)
        assert {name: got.get((q, name), 0) for name in context.LISTS} == wanted
        if any(lists.values()):
            assert report[q].after == after
            assert [report[q][f"dropped_{n}"] for n in context.LISTS] == [len(lists[n]) - wanted[n] for n in context.LISTS]


def test_verses_of_questions(spark):
    questions = spark.createDataFrame([(1, "What of Mt 5,3-4 and Ps 2?"), (2, "none"), (3, None), (4, "Mt 5,4")], "query_id long, question string")
    texts = [(47_005_003, "A", "a3"), (47_005_004, "B", "b4"), (47_005_004, "A", "a4"), (47_005_004, "C", "c4"), (23_002_001, "C", "c1"), (1_001_001, "A", "no")]
    got = context.question_verses(questions, spark.createDataFrame(texts, "ordinal long, work string, text string"), ["B", "A"], limit=3)
    assert sorted((r.query_id, r.ord, r.text) for r in got.collect()) == [(1, 1, "a3"), (1, 2, "b4"), (1, 3, "a4"), (4, 1, "b4"), (4, 2, "a4")]


def test_messages_without_rows(spark):
    questions = spark.createDataFrame([(1, "Q?")], "query_id long, question string")
    rows = spark.createDataFrame([], "query_id long, list string, rank int, head string, text string")
    assert context.messages(questions, rows, {"chunks": "SOURCES", "verses": "VERSES", "ane": "MORE"}).first().message == "Q?\n\nSOURCES:\n(none)\n\nVERSES:\n(none)"


def flaky(folder, limit=None):
    """A call that refuses some payloads once, some for good, and all beyond a limit of payloads; it counts its calls in files."""

    def call(payload):
        seen = f"{folder}/{payload}"
        first = not os.path.exists(seen)
        with open(seen, "a") as f:
            f.write("x")
        if limit is not None and len(os.listdir(folder)) > limit:
            raise outside.UsageLimitError
        if payload.endswith("7"):
            raise ValueError("never")
        if first and payload.endswith("3"):
            raise outside.TryAgainError
        time.sleep(0.002)
        return payload.upper()

    return call


def test_a_run_that_is_cut_ends_with_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "id long, payload string")
    path, calls = f"file://{tmp_path}/out", tmp_path / "calls"
    calls.mkdir()
    assert outside.finished(spark, path) is None
    assert not outside.work_off(rows, flaky(str(calls), limit=60), path, round_rows=50, first_wait=0.01)
    early = outside.finished(spark, path).count()
    assert 0 < early < 200
    before = {f: os.path.getsize(calls / f) for f in os.listdir(calls)}
    held = {f"p{r.id}" for r in outside.finished(spark, path).collect()}
    assert outside.work_off(rows, flaky(str(calls)), path, round_rows=70, first_wait=0.01)
    assert all(os.path.getsize(calls / f) == before[f] for f in held)  # what is done is not asked again
    got = {r.id: (r.result, r.error) for r in outside.finished(spark, path).collect()}
    assert got == {i: (None, "ValueError: never") if i % 10 == 7 else (f"P{i}", None) for i in range(200)}
    assert outside.work_off(rows, flaky(str(calls)), path) and outside.finished(spark, path).count() == 200
    assert outside.work_off(rows, str.upper, path, again=True)  # failed ones once more
    assert outside.finished(spark, path).filter("error IS NOT NULL").count() == 0


def test_waits_double_up_to_a_limit():
    waits, calls = [], []

    def call(payload):
        calls.append(payload)
        raise outside.TryAgainError

    with pytest.raises(outside.TryAgainError):
        outside.patient(call, "x", 6, 5.0, 30.0, waits.append)
    assert waits == [5.0, 10.0, 20.0, 30.0, 30.0] and len(calls) == 6
    with pytest.raises(outside.UsageLimitError):
        outside.patient(lambda _: (_ for _ in ()).throw(outside.UsageLimitError()), "x", 5, 1, 1, waits.append)
    assert len(waits) == 5


def test_few_calls_are_handed_out_at_a_time(spark, tmp_path):
    folder = str(tmp_path)

    def call(payload):
        mine = f"{folder}/{payload}"
        open(mine, "w").close()
        n = len(os.listdir(folder))
        time.sleep(0.01)
        os.remove(mine)
        return str(n)

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id long, payload string").coalesce(1)
    got = outside.results(rows, call, f"file://{tmp_path}-flag", workers=3).collect()
    assert max(int(r.result) for r in got) <= 3 and len(got) == 60


def headers_by_a_loop(pages):
    key = lambda line: re.sub(r"[0-9\s]+", " ", line.lower()).strip(" ")
    docs, out = {}, {}
    for d, p, text in pages:
        docs.setdefault(d, []).append((p, text or ""))
    for d, held in docs.items():
        counts = {}
        for _, text in held:
            said = [x.strip() for x in text.split("\n") if x.strip()]
            for k in {key(x) for x in said[:3] + said[-3:]}:
                counts[k] = counts.get(k, 0) + (len(k) >= 4)
        headers = {k for k, n in counts.items() if n >= max(4, int(len(held) * 0.25))} if len(held) >= 4 else set()
        for p, text in held:
            lines = text.split("\n")
            out[d, p] = "\n".join(x for x in lines if not (x.strip() and (key(x.strip()) in headers or re.fullmatch("[0-9]{1,4}", x.strip())))) if headers else text
    return out


def test_running_headers(spark):
    rng = random.Random(1)
    bits = ["CHAPTER one 12", "Chapter  one", "7", "12345", "the text goes on", "more text here", "", "  ", "ab", "Author of it 3", "a unique line "]
    pages = [(d, p, "\n".join(rng.choice(bits) + (str(p) if rng.random() < 0.2 else "") for _ in range(rng.randrange(0, 12)))) for d in range(12) for p in range(rng.choice([2, 3, 4, 9, 30]))]
    df = spark.createDataFrame(pages, "document_id long, page long, text string")
    got = {(r.document_id, r.page): r.text for r in groups.without_headers(df).collect()}
    assert got == headers_by_a_loop(pages)


HEBREW = {
    "~s;q'": "קָסַם", "~s,q,": "קֶסֶם", 'hw"hy>': "יְהוָה", "~aun>": "נְאֻם", "~yMituw>": "וְתֻמִּים", "~yrIWa": "אוּרִים", "l[;B;": "בַּעַל", "tl;[]B;": "בַּעֲלַת", "tyrIB.": "בְּרִית",
    "lb;G>": "גְּבַל", "lm,r>K;": "כַּרְמֶל", "!Amr>x,": "חֶרְמֹן", "!Adyci": "צִידֹן", "la;v'": "שָׁאַל", "af'n\"": "נָשָׂא", "rm'T'": "תָּמָר", "rA[P.": "פְּעֹר", "bWbz>": "זְבוּב", "!v,xo": "חֹשֶׁן",
    "dApae": "אֵפֹד", "lr'AG": "גֹּרָל", "btk": "כתב", "$na": "אנך",
}


def test_hebrew_of_old_fonts(spark):
    df = spark.createDataFrame([*HEBREW.items(), ("~s;q'  (btk)\n$na", "אנך\n)כתב(  קָסַם"), ("", ""), (None, None)], "raw string, wanted string")
    for r in df.select("raw", "wanted", visual.decode_visual(F.col("raw")).alias("got")).collect():
        assert r.got == (r.wanted and unicodedata.normalize("NFC", r.wanted)), r.raw


def test_hebrew_comes_back_from_its_keys(spark):
    """Words written as keys from the left, vowels before their letter seen from the right, and decoded again."""
    rng, rows = random.Random(9), []
    letters, vowels = {v: k for k, v in visual.LETTERS.items()}, {}
    for k, v in visual.BEFORE.items():
        vowels.setdefault(v, k)
    for _ in range(200):
        word = [(rng.choice(list(letters)), rng.choice(["", *vowels])) for _ in range(rng.randrange(1, 9))]
        keys = "".join(vowels.get(v, "") + letters[c] for c, v in word)[::-1]
        rows.append((keys, unicodedata.normalize("NFC", "".join(c + v for c, v in word))))
    got = spark.createDataFrame(rows, "raw string, wanted string").select("raw", "wanted", visual.decode_visual(F.col("raw")).alias("got")).collect()
    assert all(r.got == r.wanted for r in got)
    assert spark.range(1).select(visual.is_visual_font(F.lit("ABCDEF+BWHEBB")).alias("a"), visual.is_visual_font(F.lit("ACaslon")).alias("b")).first() == (True, False)


def test_stems_and_cleaning(spark):
    stems = {"tartaros": "tartar", "tartar": "tartar", "logos": "", "pneuma": "pneuma", "hesed": "", "ekklesia": "ekklesi", "abcdefos": "abcdef", "abcdeos": "abcdeo" if False else "abcdeos"}
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in stems], "k string").select("k", T.translit_stem(F.col("k")).alias("s")).collect()}
    for key in stems:
        wanted = next((key[: -len(e)] for e in T.STEM_ENDINGS if key.endswith(e) and len(key) - len(e) >= 6), key if len(key) >= 6 else "")
        assert got[key] == wanted
    texts = {"według Marka12 w Mk 16,8 i J 3:16": "według Marka w Mk 16,8 i J 3:16", "prze-\nniesienie": "przeniesienie", " a  \t b\n\n\n\nc ": "a b\n\nc", "end.3": "end.", "in 2010 r.": "in 2010 r.", "x)12 y]3\nz": "x) y]\nz"}
    clean = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text(F.col("t")).alias("c")).collect()}
    assert clean == texts
