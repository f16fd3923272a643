"""Versions of works, keys in batches, the word index under change, and filters as bits."""

import random
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from glossa.operators import bitmaps, index, loads, search

ROWS = "work string, ordinal long, text string"


def rows_of(df):
    return sorted((r.work, r.ordinal, r.text) for r in df.collect())


def test_readers_keep_their_version(spark, tmp_path):
    store = loads.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    a = [("007", 1, "one"), ("007", 2, "two"), ("1e5", 1, "uno")]
    first = store.replace(spark.createDataFrame(a, ROWS))
    held = store.read()
    second = store.replace(spark.createDataFrame([("007", 2, "TWO"), ("007", 9, "nine")], ROWS))
    assert (first, second) == (1, 2)
    assert rows_of(held) == sorted(a)  # planned before the change, run after it
    now = [("007", 2, "TWO"), ("007", 9, "nine"), ("1e5", 1, "uno")]
    assert rows_of(store.read()) == now and rows_of(store.read(1)) == sorted(a)
    assert sorted(r.ordinal for r in store.verses().collect()) == [1, 2, 9]
    # what a lost load left
    spark.createDataFrame([("007", 5, "lost")], ROWS).withColumn("folder", F.lit("work-007")).write.partitionBy("folder").parquet(f"{store.path}/rows/load=load-lost")
    assert rows_of(store.read()) == now
    third = store.remove(["007"])
    assert rows_of(store.read(third)) == [("1e5", 1, "uno")] and rows_of(store.read(2)) == now
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load" in plan or "PartitionFilters: [load" in plan


def test_two_writers_get_two_versions(spark, tmp_path):
    store = loads.Store(spark, f"file://{tmp_path}/s")
    store.replace(spark.createDataFrame([("z", 1, "z")], ROWS))
    got = []
    writers = [threading.Thread(target=lambda w=w: got.append(store.replace(spark.createDataFrame([(w, 1, w)], ROWS)))) for w in "abc"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == [2, 3, 4]
    assert rows_of(store.read()) == [(w, 1, w) for w in "abcz"]


def test_records_become_numbered_and_cut_tokens(spark):
    token = "struct<surface:string,lemma:string,strong:string,morph:string,pos:string,prefixes:string>"
    rows = [("W", "Rdz", 1, 2, "Ala ma, kota!", [("Ala" * 40, None, "H00", "m", "N" * 20, ""), ("Kota", "kot", "G7225a", "x", "N", "")]), ("W", "nowhere", 1, 1, "x", []), ("W", "Wj", 3, 4, None, None)]
    records = spark.createDataFrame(rows, f"work string, book string, chapter int, verse int, text string, tokens array<{token}>")
    books, works = spark.createDataFrame([("Rdz", 1), ("Wj", 2)], "book string, order int"), spark.createDataFrame([("W", "pl")], "work string, language string")
    found = {r.ordinal: r for r in loads.verse_texts(records, works, books).collect()}
    assert sorted(found) == [1_001_002, 2_003_004]
    one = found[1_001_002]
    assert one.text_norm == "ala ma kota" and [t.position for t in one.tokens] == [1, 2]
    assert len(one.tokens[0].surface) == 64 and len(one.tokens[0].pos) == 8 and one.tokens[0].lemma == ""
    assert found[2_003_004].tokens == [] and found[2_003_004].text == ""


def test_lemmas_come_from_the_lexicon(spark):
    texts = spark.createDataFrame([("w", 1, [(1, "G7225a", ""), (2, "g07225b", None), (3, "H1", "own"), (4, "H9", "")]), ("w", 2, [])], "work string, ordinal long, tokens array<struct<position:int,strong:string,lemma:string>>")
    lexemes = spark.createDataFrame([("G7225a", "first"), ("G7225", "plain"), ("H1", "no")], "strong string, lemma string")
    found = {r.ordinal: [t.lemma for t in r.tokens] for r in loads.with_lemmas(texts, lexemes).collect()}
    assert found == {1: ["first", "plain", "own", ""], 2: []}


def test_lexemes_are_updated_in_place(spark):
    held = spark.createDataFrame([("H1", "a", "note"), ("H2", "b", None)], "strong string, gloss string, note string")
    fresh = spark.createDataFrame([("H2", "B"), ("H3", "c"), ("H1", None)], "strong string, gloss string")
    assert sorted(tuple(r) for r in loads.upsert_lexemes(held, fresh).collect()) == [("H1", "a", "note"), ("H2", "B", None), ("H3", "c", None)]


def test_batches_of_keys(spark):
    rng = random.Random(2)
    keys = rng.sample(range(10_000), 503)
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string").repartition(5)
    batches = loads.in_batches(rows, ["k"], 50)
    got = {}
    for r in batches.collect():
        got.setdefault(r.batch, []).append(r.k)
    ordered = sorted(keys)
    assert [sorted(got[b]) for b in sorted(got)] == [ordered[i : i + 50] for i in range(0, 503, 50)]
    later = rows.filter(F.col("k") != ordered[3])
    assert [r.k for r in loads.rows_of(later, batches, 0).collect()] == [k for k in ordered[:50] if k != ordered[3]]
    assert loads.in_batches(rows.limit(0), ["k"], 50).count() == 0


def scores(df):
    return {r.doc_id: round(r.bm25, 9) for r in df.collect()}


def test_an_index_after_changes_equals_a_new_one(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(1, 30))) for i in range(40)}
    held = index.Words(spark, f"file://{tmp_path}/w")
    terms = ["alpha", "gamma", "the"]

    def frame(d):
        return spark.createDataFrame(sorted(d.items()), "doc_id long, text string")

    held.add(frame(texts))
    for step in range(4):
        changed = {i: " ".join(rng.choices(words, k=5)) for i in rng.sample(range(45), 6)}
        gone = rng.sample(sorted(texts), 3)
        held.replace(frame(changed))
        texts |= changed
        held.delete(spark.createDataFrame([(g,) for g in gone] + [(99,)], "doc_id long"))
        texts = {i: t for i, t in texts.items() if i not in gone}
        if step == 2:
            held.compact()
        back = {g: "alpha again" for g in gone[:1]}
        held.add(frame(back | dict(list(texts.items())[:2])))
        texts |= back
        now = frame(texts)
        assert scores(held.bm25(terms)) == scores(search.bm25(now, terms).filter("bm25 > 0"))
        assert sorted(r.doc_id for r in held.documents().collect()) == sorted(texts)
    stored = now.select("doc_id", F.regexp_count("text", F.lit("[a-z]+")).cast("long").alias("stored"))
    assert held.missing(stored).count() == 0
    more = stored.unionByName(spark.createDataFrame([(500, 0)], "doc_id long, stored long")).withColumn("stored", F.when(F.col("doc_id") == 7, 3).otherwise(F.col("stored")))
    assert sorted(r.doc_id for r in held.missing(more).collect()) == [i for i in (7, 500) if i == 500 or texts.get(7) and len(texts[7].split()) != 3]
    # a change that was lost before its last row
    index.postings(frame({1: "alpha alpha"})).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("bucket").parquet(f"{held.path}/postings")
    spark.createDataFrame([(1, "lost")], "doc_id long, run string").write.mode("append").parquet(f"{held.path}/tombstones")
    assert scores(held.bm25(terms)) == scores(search.bm25(now, terms).filter("bm25 > 0"))


@pytest.mark.parametrize("seed", range(3))
def test_filters_as_bits(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["open", "private", None]), rng.choice(["x", "y"]), rng.sample(["p", "q", "r"], rng.randrange(0, 3)), rng.randrange(100), rng.randrange(60)) for i in rng.sample(range(5_000), 400)]
    df = spark.createDataFrame(docs, "doc_id long, level string, owner string, authors array<string>, start long, more long")
    bits = bitmaps.attribute_bits(df, ["level", "owner", "authors"])
    intervals = df.select("doc_id", "start", (F.col("start") + F.col("more") % 7).alias("end"))
    groups = [{"level": ["open"], "owner": ["y"]}, {"authors": ["p", "q"]}]
    wanted = [(10, 40), (80, 81)]

    def fits(d, with_ranges):
        ok = (d[1] == "open" or d[2] == "y") and set(d[3]) & {"p", "q"}
        return ok and (not with_ranges or any(d[4] <= b and d[4] + d[5] % 7 >= a for a, b in wanted))

    for with_ranges in (False, True):
        let = bitmaps.allowed(bits, groups, intervals, wanted if with_ranges else None)
        assert sorted(r.doc_id for r in bitmaps.keep(df, let).collect()) == sorted(d[0] for d in docs if fits(d, with_ranges))
    assert bitmaps.keep(df, bitmaps.allowed(bits, [{"level": []}])).count() == 0
    with pytest.raises(ValueError):
        bitmaps.allowed(bits, [])


def test_an_index_that_is_not_there(spark, tmp_path):
    held = index.Words(spark, f"file://{tmp_path}/none")
    assert held.documents() is None and held.runs() is None
    assert held.missing(spark.createDataFrame([(1, 5)], "doc_id long, stored long")).collect()[0].indexed == 0
    held.compact()
    with pytest.raises(AnalysisException):
        spark.read.parquet(held.path)
