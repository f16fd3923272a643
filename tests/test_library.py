"""The word index and a library's sources on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from glossa.operators import index, search
from glossa.sources import library


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def scores(df):
    return {r.doc_id: round(r.bm25, 9) for r in df.collect()}


def test_index_grows_and_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "A dog, a Dog"), (3, None), (4, "nothing here"), (5, "")], "doc_id long, text string")
    path = "file://" + str(tmp_path / "words")
    index.index_words(docs.filter("doc_id < 3"), path)
    index.index_words(docs, path)
    terms = ["dog", "the", "absent"]
    assert scores(index.bm25_indexed(spark, path, terms)) == scores(search.bm25(docs, terms).filter("bm25 > 0"))
    # postings of a run that was lost before its totals are not read
    index.postings(docs).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    assert scores(index.bm25_indexed(spark, path, terms)) == scores(search.bm25(docs, terms).filter("bm25 > 0"))
    scan = index.bm25_indexed(spark, path, terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and "PushedFilters: [In(term" in scan


def test_retrieval_skips_closed_documents_before_it_cuts(spark):
    channel = spark.createDataFrame([(i, float(10 - i)) for i in range(10)], "id long, score double")
    now = spark.createDataFrame([(i, i >= 6 or i == 2, float(i)) for i in range(9)], "id long, is_open boolean, quality double")
    found = index.retrieve([channel], now, F.col("is_open"), 2, 3).orderBy("rank")
    assert [r.id for r in found.collect()] == [2, 6]
    again = index.retrieve([channel], now, F.col("is_open"), 2, 3, F.col("quality")).orderBy("rank")
    assert [r.id for r in again.collect()] == [7, 6]


def test_script_dictionary(spark, tmp_path):
    path = write(tmp_path / "d.js", '// a = note\nvar words = {"G1": {"strongs_def": " alpha ", "kjv_def": "Alpha"},\n "H2": {"derivation": "' + "x" * 400 + '"}};\nmodule.exports = words;')
    rows = {r.number: r for r in library.script_dictionary(spark, path.replace("d.js", "*.js")).collect()}
    assert rows["G1"].definition == "alpha" and rows["G1"].pronunciation == "" and len(rows["H2"].derivation) == 300


def test_entity_labels(spark, tmp_path):
    full = {"id": "Q1", "labels": {"en": {"value": " Town "}}, "aliases": {"en": [{"value": "T"}, {"value": " "}]}, "descriptions": {}, "sitelinks": {"enwiki": {"title": "Old Town/é*~"}}}
    path = write(tmp_path / "e.jsonl", json.dumps(full) + "\n" + json.dumps({"id": "Q2"}) + "\n")
    rows = {r.id: r for r in library.entity_labels(spark, path).collect()}
    assert (rows["Q1"].label, rows["Q1"].aliases, rows["Q1"].wiki) == ("Town", ["T"], "https://en.wikipedia.org/wiki/Old_Town/%C3%A9%2A~")
    assert (rows["Q2"].label, rows["Q2"].aliases, rows["Q2"].wiki) == ("", [], "")


def test_plain_documents(spark, tmp_path):
    write(tmp_path / "a.md", "one  two\n\n\n\nthree")
    write(tmp_path / "b.txt", "first\fsecond")
    write(tmp_path / "c.pdf", "no")
    rows = {(r.file, r.page): r.text for r in library.plain_documents(spark, str(tmp_path)).collect()}
    assert rows == {("a.md", 1): "one two\n\nthree", ("b.txt", 1): "first", ("b.txt", 2): "second"}


def test_excerpt(spark):
    texts = spark.createDataFrame([("x Begin\n here. More. End  it now End it",), (None,)], "text string")
    cut = lambda *a, **k: [r[0] for r in texts.select(library.excerpt(F.col("text"), *a, **k)).collect()]
    assert cut("Begin here.", "End it") == ["Begin\n here. More. End  it", None]
    assert cut(end="More.") == ["x Begin\n here. More.", None] and cut("now") == ["now End it", None] and cut("absent", strict=False) == [None, None]
    with pytest.raises(Exception, match="no excerpt"):
        cut("absent")


def test_numbers_of_verses(spark):
    rows = [(1, 1, 1, "a"), (1, 1, 3, "c"), (1, 1, None, "<i>c</i>"), (1, 1, None, "b"), (1, 2, 1, "x"), (1, 2, None, "y"), (1, 3, 4, "z"), (1, 3, None, "w"), (None, 1, 1, "n"), (1, 4, None, None)]
    found = library.numbered(spark.createDataFrame(rows, "book int, chapter int, verse int, text string"))
    assert sorted((r.chapter, r.verse, r.text, r.note) for r in found.collect()) == [(1, 1, "a", None), (1, 2, "b", "gap"), (1, 3, "c", None), (2, 1, "x", None), (3, 4, "z", None)]


def test_works_of_sections(spark):
    rows = [(1, "Sermons", "", "Part I / On Hope. / 1"), (1, "Sermons", "", "Part I / Faith"), (2, "On hope", "B", "x"), (3, "Letters", "C", None)]
    found = library.selected_works(spark.createDataFrame(rows, "work int, title string, author string, section string"), "hope")
    assert sorted(((r.work, r.path, r.title, r.author, r.section) for r in found.collect()), key=str) == [(1, "Part I / On Hope.", "On Hope", "Sermons", "1"), (2, None, "On hope", "B", "x")]
