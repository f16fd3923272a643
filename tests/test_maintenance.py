"""Upkeep of a corpus against plain Python."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import references as R
from glossa.operators import maintenance as M
from glossa.operators.loads import Store

ENTRY = "index long, doi string, title string, authors array<string>, access string"


def duplicates_plainly(entries, least):
    def key(title):
        return " ".join(re.sub(r"[^\w\s]", " ", (title or "").split(".")[0].lower()).split())

    dup, seen, keys = {}, {}, []
    for i, doi, title, authors in entries:
        if doi and doi in seen:
            dup[i] = seen[doi]
        elif doi:
            seen[doi] = i
        k = key(title)
        if i not in dup and k:
            mine = {a.lower() for a in authors or []}
            for j, kj, theirs in keys:
                if kj and j not in dup and difflib.SequenceMatcher(None, k, kj, autojunk=False).ratio() >= least and (not mine or not theirs or mine & theirs):
                    dup[i] = j
                    break
        keys.append((i, k, {a.lower() for a in authors or []}))
    return dup


@pytest.mark.parametrize("seed", range(3))
def test_duplicates(spark, seed):
    rng = random.Random(seed)
    base = ["The book of Job and its speeches", "Exegesis of the second psalm", "On wisdom in the sapiential books", "Law", "A review of recent work on Isaiah. Part 2"]

    def title():
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abc e")
        return "".join(t)

    entries = [(i, rng.choice([None, "", "", f"10/{rng.randrange(20)}"]), rng.choice([title(), title(), title(), None, "..."]), rng.choice([[], ["A"], ["a", "B"], ["C"], None])) for i in range(80)]
    df = spark.createDataFrame([(*e, "open") for e in entries], ENTRY)
    got = {r["index"]: r.duplicate_of for r in M.title_duplicates(df).collect()}
    assert got == duplicates_plainly(entries, 0.9) and len(got) > 15


def test_curation(spark):
    df = spark.createDataFrame([(0, "", "Report from Rome", ["A"], "open"), (1, "", "A study of Job and his friends", ["A"], "open"), (2, "", "A study of Job and his friend", ["A"], "licensed"), (3, "", "Left", ["A"], "skip"), (4, "", "A study of Job and his friends", ["Z"], "open")], ENTRY)
    got = {r["index"]: (r.decision.access, r.decision.reason) for r in M.curated(df).collect()}
    assert got == {0: ("skip", "title of a report"), 1: ("open", None), 2: ("skip", "duplicate of 1"), 3: ("skip", "left out"), 4: ("open", None)}


def test_documents_in_and_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    body = "The words of the text go on and on in the line. " * 10
    pages = lambda rows: spark.createDataFrame(rows, "document_id long, page long, text string")
    first = pages([(1, 1, f"{body} See Mt 5,3."), (1, 2, "the end of it, with the rest of the words that are in the text."), (2, 1, body), (3, 1, body)])
    got = {r.document_id: (r.state, r.language) for r in M.ingest(first, store).collect()}
    assert got == {1: ("new", "en"), 2: ("new", "en"), 3: ("copy", "en")}
    held = store.read()
    assert sorted({r.work for r in held.collect()}) == ["1", "2"]
    again = {r.document_id: r.state for r in M.ingest(pages([(2, 1, "other"), (7, 1, body), (8, 1, "short one")]), store).collect()}
    assert again == {2: "known", 7: "copy", 8: "new"}
    version = M.reingest(pages([(2, 1, "now Ps 2 here")]), store)
    assert version == store.newest() == 3
    assert [r.text for r in store.read().filter("work = '2'").collect()] == ["now Ps 2 here"]
    assert [len(r.refs) for r in store.read().filter("work = '2'").collect()] == [1]
    assert {r.work for r in held.collect()} == {"1", "2"}  # a reader's version stays
    books = [b if b[1] != "Ps" else (99, *b[1:]) for b in R.BOOKS]
    version, n = M.update_references(store, books)
    assert (version, n) == (4, 1) and store.read().filter("work = '2'").first().refs[0].start == 99_002_000
    assert M.update_references(store, books) == (4, 0)


def test_a_corpus_is_updated_from_a_stream(spark, tmp_path):
    known = spark.createDataFrame([("s", "1", "", "A study of Job and his friends", ["A"], "open")], "source string, source_id string, doi string, title string, authors array<string>, access string")
    rows = [("2024-01-01 00:00:00", "s", "1", "", "A study of Job and his friends", ["A"], "open"), ("2024-01-01 01:00:00", "s", "2", "", "A study of Job, and his friend", ["A"], "open"), ("2024-01-01 02:00:00", "s", "3", "", "Something else", ["A"], "open"), ("2024-01-01 03:00:00", "s", "3", "", "Something else", ["A"], "open")]
    schema = "seen_at timestamp, source string, source_id string, doi string, title string, authors array<string>, access string"
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = {r.source_id: r.decision.access for r in M.updated(stream, known, f"file://{tmp_path}/work").collect()}
    assert got == {"2": "skip", "3": "open"}


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "x", ["1:0", "1:5"]), ("b", "x", ["2:3"]), ("c", "y", ["9:9"]), ("d", "y", [])], "id string, type string, relevant array<string>")
    hits = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 0, 2), ("a", 1, 5, 9), ("b", 2, 4, 1), ("b", 2, 3, 3)], "id string, document long, ord long, rank int")
    got = {(r.type, r.metric): (round(r["mean"], 4), r.n) for r in M.evaluated(cases, hits, 5).collect()}
    assert got["x", "recall_at_k"] == (0.75, 2) and got["x", "mrr_at_k"] == (round((1 / 2 + 1 / 3) / 2, 4), 2)
    assert got["x", "near_at_k"] == (1.0, 2) and got["x", "hit_at_1"] == (0.0, 2) and got["y", "recall_at_k"] == (0.0, 1) and got["all", "near_at_k"] == (round(2 / 3, 4), 3)
