"""Faults that a review found on odd inputs and larger tables, each by a small input."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def same(spark, name, folder, **views):
    """Whether a query gives what its SQL gives of the ``views``' files in ``folder``."""
    con = duckdb.connect()
    for t, files in views.items():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    wanted = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(folder)).toPandas()[list(wanted.columns)]
    key = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))
    return key(got) == key(wanted)


def test_chapters_are_looked_up_not_listed(spark):
    from glossa.operators import interlinear as I

    verses = spark.createDataFrame([(b * 1_000_000 + c * 1_000 + 1,) for b in (1, 2, 7) for c in (3, 4)], "ordinal long")
    asked = [(0, 0, 1_004_002, 1_004_002), (1, 0, 4_001_001, 5_001_001), (2, 0, 7_004_000, 7_004_009), (3, 0, 1_003_001, 2_003_001)]
    found = I.chapters_around(spark.createDataFrame(asked, "request_id int, place int, start long, end long"), verses)
    assert {r.request_id: (r.before, r.after) for r in found.collect()} == {0: (1_003_000, 2_003_000), 1: (2_004_000, 7_003_000), 2: (7_003_000, None), 3: (None, 2_004_000)}
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_heads_that_speak_of_a_licence_are_notes(spark, tmp_path):
    rows = [(1, "Licensed under CC BY-NC 4.0.\nAnd more"), (4, " in the public domain"), (3, "CC0"), (2, "CC BY"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, "rights_labels", tmp_path, documents=f"{tmp_path}/documents.parquet/*.parquet")


def test_session_gaps_go_by_the_nearest_second(spark, tmp_path):
    con = duckdb.connect()
    times = ["00:00:00.4", "06:00:00.6", "12:00:00.7", "18:00:01.4"]
    con.sql("COPY (SELECT i AS event_id, 1 AS user_id, ts::TIMESTAMP AS ts FROM (VALUES " + ", ".join(f"({i}::BIGINT, '2024-01-01 {t}')" for i, t in enumerate(times)) + f") x(i, ts)) TO '{tmp_path}/events.parquet'")
    assert same(spark, "sessions", tmp_path, events=f"{tmp_path}/events.parquet")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_streams_read_a_table_of_several_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, "stream_without_tag", tmp_path, conversations=f"{tmp_path}/conversations.parquet/*.parquet")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_interlinear_gives_every_word(spark):
    found = entry.queries()["interlinear"](spark, SF)
    assert {"doc_id", "line", "pos", "word", "gloss"} <= set(found.columns)
    words = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(size(regexp_extract_all(lower(text), '[a-z]+', 0))) AS n").first().n
    assert found.count() == words


def test_near_copies_have_golay_keys_among_their_candidates(spark, monkeypatch):
    from glossa.llm import simhash

    words = [f"w{i}" for i in range(2_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    monkeypatch.setattr(simhash, "band_keys", lambda h: h[:: max(len(h) // simhash.BANDS, 1)][: simhash.BANDS] ^ simhash.np.uint64(len(h) * 7 + int(h[0] % 1_000)))
    nodes = simhash.sketches(docs.selectExpr("doc_id AS id", "doc_id AS t", "text"), 5).selectExpr("id AS node", "a AS fp")
    assert {frozenset((r.u, r.v)) for r in simhash.golay_candidates(nodes).collect()} == {frozenset((1, 2))}
    asked = []
    held = simhash.golay_candidates
    monkeypatch.setattr(simhash, "golay_candidates", lambda *a: asked.append(1) or held(*a))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3] and asked


def test_rounds_of_outside_work_are_bounded(spark, tmp_path):
    from glossa.operators import outside

    rows = spark.range(300).selectExpr("id", "CAST(id AS STRING) AS payload")
    assert outside.work_off(rows, lambda p: p + "!", f"file://{tmp_path}/out", round_rows=1, tries=1)
    held = spark.read.parquet(f"{tmp_path}/out/results")
    assert held.count() == 300 and held.select("asked_at").distinct().count() <= outside.MOST_ROUNDS
    assert outside.finished(spark, f"file://{tmp_path}/out").filter("result = id || '!'").count() == 300


def test_postings_move_nothing(spark):
    from glossa.operators import index

    found = index.postings(spark.createDataFrame([(1, "The the cat, ÉA aİ"), (2, None), (3, "THE")], "doc_id long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.doc_id, r.tf, r.len) for r in found.collect()) == [("a", 1, 1, 5), ("ai", 1, 1, 5), ("cat", 1, 1, 5), ("the", 1, 2, 5), ("the", 3, 1, 1)]


def test_python_takes_texts_in_slices(spark):
    from glossa import tables

    docs = spark.range(40).selectExpr("id", "repeat('x', 1000000) AS text").coalesce(1)

    def scan(frames):
        for f in frames:
            yield f.assign(n=f["text"].str.len().sum())[["id", "n"]]

    assert max(r.n for r in tables.map_slices(docs, scan, "id long, n long").collect()) <= 2 * tables.SLICE


def test_citations_are_read_once(spark):
    from pyspark.sql import functions as F

    from glossa.operators import verify

    plan = spark.createDataFrame([("[1]",)], "t string").select(verify.citation_checks(F.col("t"), F.array(F.lit("1"))).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1


def test_held_quotations_are_not_compared(spark):
    from glossa.operators import quotes

    found = spark.createDataFrame([(1, 0, "a quotation of some length", [], None, False, 0), (1, 1, "another one that is not there", ["2"], None, False, 1)], "answer_id long, ord int, quote string, refs array<string>, reason string, tradition boolean, cited int")
    sources = spark.createDataFrame([(1, "1", "here is a quotation of some length"), (1, "2", "another one that was not here")], "answer_id long, label string, text string")
    met = {}
    real = quotes.ratios
    quotes.ratios = lambda pairs: real(met.setdefault("pairs", pairs))
    try:
        got = {r.ord: (r.ratio, r.status) for r in quotes.verified(found, sources).collect()}
    finally:
        quotes.ratios = real
    assert got[0] == (1.0, "ok") and 0.6 < got[1][0] < 1 and met["pairs"].count() == 1


def test_languages_are_told_once(spark):
    for name in ("lang_vote_by_source", "language_changes"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[^a-zà-ÿœ]+") == 1
