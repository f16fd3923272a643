"""Payloads, works, event streams, reports, map data and small keys, against plain Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

from glossa.functions import editorial as E
from glossa.operators import serving as S

PAYLOADS = [
    ("{}", None), ('{"question": "x", "authors": ["a"], "works": [], "mode": "popular", "personal_only": true, "conversation_id": 5}', None), ("[]", "object"), ("not json", "object"), ("null", "object"),
    ('{"question": 5}', "question"), ('{"question": null}', "question"), ('{"authors": "a"}', "authors"), ('{"authors": [1]}', "authors"), (json.dumps({"authors": ["x" * 301]}), "authors"), (json.dumps({"works": ["w"] * 101}), "works"),
    ('{"works": {}}', "works"), ('{"mode": "other"}', "mode"), ('{"mode": 1}', "mode"), ('{"mode": null}', None), ('{"personal_only": 1}', "personal_only"), ('{"include_ane": "yes"}', "include_ane"), ('{"include_patristics": null}', None),
    ('{"conversation_id": 0}', "conversation_id"), ('{"conversation_id": -3}', "conversation_id"), ('{"conversation_id": 1.5}', "conversation_id"), ('{"conversation_id": "7"}', "conversation_id"), ('{"conversation_id": true}', "conversation_id"),
    ('{"conversation_id": 9223372036854775807}', None), ('{"conversation_id": 9223372036854775808}', "conversation_id"), ('{"conversation_id": null}', None), ('{"mode": "x", "question": 1}', "question"), (json.dumps({"authors": ["x" * 300] * 100}), None),
]


def test_payloads(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string").select("i", S.payload_fault(F.col("p")).alias("f")).collect()
    assert {r.i: r.f for r in rows} == {i: f for i, (_, f) in enumerate(PAYLOADS)}


def test_cases(spark):
    rows = [
        ("a", "q", "pl", ["1:0", "22:5"], "popular", None), ("a", " ", None, None, None, "q"), ("a", "q", " All ", None, None, "type"), ("a", "q", None, ["0:1"], None, "relevant"), ("a", "q", None, ["1:x"], None, "relevant"),
        ("a", "q", None, None, "loud", "mode"), (" ", "q", None, None, None, "id"), (None, "q", None, [], None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, id string, q string, type string, relevant array<string>, mode string, wanted string")
    assert all(r.f == r.wanted for r in df.select("wanted", S.case_fault(df).alias("f")).collect())
    assert [r.f for r in df.filter("n IN (0, 7)").orderBy("n").select(S.case_fault(df, "retrieval").alias("f")).collect()] == [None, "relevant"]


def test_works(spark):
    works = spark.createDataFrame([("B", "translation", "open"), ("A", "translation", "private"), ("Z", "original", "open"), ("C", "translation", "private")], "code string, kind string, access string")
    codes = lambda df: [r.code for r in df.orderBy("place").collect()]
    assert codes(S.usable_works(works, None, None)) == ["Z", "B"]
    assert codes(S.usable_works(works, None, ["open", "work:C"])) == ["Z", "B", "C"]
    assert codes(S.usable_works(works, [], ["open"])) == [] and codes(S.usable_works(works, ["A", "B", "none"], None)) == ["B"]
    asked = spark.createDataFrame([("A", 1), ("B", 2), ("Z", 3), ("gone", 4)], "code string, place int")
    assert [r.code for r in S.still_usable(asked, works, ["open"]).collect()] == ["B", "Z"]


def test_answers_as_events(spark):
    rows = spark.createDataFrame([(1, '[{"n":1}]', "Two words", None), (2, None, "x", "broken"), (3, "[]", None, None)], "answer_id int, sources string, text string, error string")
    got = {}
    for r in S.answer_events(rows).orderBy("answer_id", "seq").collect():
        got.setdefault(r.answer_id, []).append((r.event, json.loads(r.data)))
    assert got[1] == [("sources", [{"n": 1}]), ("delta", {"content": "Two "}), ("delta", {"content": "words "}), ("done", {})]
    assert got[2] == [("sources", []), ("error", {"detail": "broken"})] and got[3] == [("sources", []), ("done", {})]
    one = spark.range(1).select(S.frame(F.lit("delta"), F.lit("a\nb")).alias("f"), S.echo(F.lit("x\n[1] a\n[2] b")).alias("e"), S.echo(F.lit("none")).alias("n")).first()
    assert one.f == "event: delta\ndata: a\ndata: b\n\n" and "Found 2 passages of literature [1]" in one.e and "Found 0 passages of literature and" in one.n


def test_ends_of_streams(spark):
    rows = [
        ('data: {"a":1}\n\ndata: [DONE]\n\n', "complete"), ('data: {"choices":[{"finish_reason":"stop"}]}\r\n\r\n', "complete"), ('data: {"choices":[{"delta":{}}]}\n\n', "early"), ("", "early"),
        ('event: error\ndata: {"detail":"x"}\n\ndata: [DONE]\n\n', "error"), ('data: {"error":{"message":"m"}}\n\n', "error"), ('data: {"choices":\ndata: [{"finish_reason":"stop"}]}\n\n', "complete"),
    ]
    df = spark.createDataFrame(rows, "b string, w string")
    assert all(r.e == r.w for r in df.select("b", "w", S.stream_end(F.col("b")).alias("e")).collect())


def test_reports(spark):
    results = spark.createDataFrame([("a", "x", {"recall": 0.5, "bad": math.nan}, None), ("b", "x", {"recall": 1.0}, None), ("c", "y", {"mrr": 0.25}, None), ("d", "y", {"mrr": 1.0}, "failed")], "id string, type string, metrics map<string,double>, error string")
    means = {(r.type, r.metric): (r["mean"], r.n) for r in S.report_means(S.report_cases(results)).collect()}
    assert means == {("x", "recall"): (0.75, 2), ("y", "mrr"): (0.25, 1), ("all", "recall"): (0.75, 2), ("all", "mrr"): (0.25, 1)}
    held = spark.createDataFrame([({"api_key": "k", "note": "see https://x/y now", "plain": "ok", "PassWord": None, "none": None},)], "m map<string,string>")
    assert held.select(S.redacted(F.col("m")).alias("m")).first().m == {"api_key": "[redacted]", "note": "[redacted]", "plain": "ok", "PassWord": "[redacted]", "none": None}
    assert spark.range(1).select(S.without_addresses(F.lit("at postgres://u:p@h/d and http://a.b/c.")).alias("t")).first().t == "at [redacted] and [redacted]"


def test_map_data(spark):
    places = spark.createDataFrame([(1, "Bethel", "Betel", "town"), (2, "Nowhere", "", "town"), (3, "Ai", "", "town")], "place_id int, name string, label string, kind string")
    locations = spark.createDataFrame([(1, 1, 2.0, 3.0, 0.1), (1, 0, 35.2, 31.9, 0.9), (3, 0, 1.0, 1.0, 1.0)], "place_id int, ord int, lon double, lat double, confidence double")
    got = {r.place_id: json.loads(r.json) for r in S.map_places(places, locations).collect()}
    assert got[1]["name"] == "Betel" and [x["lon"] for x in got[1]["locations"]] == [35.2, 2.0] and got[3]["name"] == "Ai" and 2 not in got


def test_keys_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(E.slug(F.lit("Łukasz Żółw, cz. 2!"))) == "lukasz-zolw-cz-2"
    assert one(E.part_markers(F.lit("Księga Hioba, część III, t. 2 (2010)"))) == ["2", "2010", "iii"]
    for name, wanted in (("Jan Kowalski", "Kowalski, Jan"), ("Kowalski,  Jan", "Kowalski, Jan"), ("Homer", "Homer"), ("Jan van Eyck", "Eyck, Jan van")):
        assert one(E.canonical_name(F.lit(name))) == wanted
    assert one(E.citation_key(F.lit("Żak"), F.lit(2001), F.lit("The Book with Łaska"))) == "zak2001book"
    assert one(E.citation_key(F.lit("王"), F.lit(None).cast("int"), F.lit("a b"))) == "anonwork"
    assert one(E.name_variants(F.lit("Kim jest Maryja?"))) == "Kim jest Maryja? Maria Marii" and one(E.name_variants(F.lit("Maria"))) == "Maria"
    assert one(E.clean_translation(F.lit("Here is the translation:\n\n**Text** of *it*"), F.lit("src"))) == "Text of it"
    assert one(E.clean_translation(F.lit("*kept*"), F.lit("a *b*"))) == "*kept*"


@pytest.mark.parametrize(
    ("title", "access", "dup", "wanted"),
    [("Any", "skip", 3, ("skip", None, "left out")), ("Any", "open", 3, ("skip", None, "duplicate of 3")), ("Report from Rome", "open", None, ("skip", "report", "title of a report")),
     ("Rec. of a book", "open", None, ("open", "review", "title of a review")), ("Wstęp", "review", None, ("skip", "report", "title of a report")), ("Wstęp do Hioba", "open", None, ("open", None, None)), (None, "open", None, ("open", None, None))],
)
def test_rules_of_titles(spark, title, access, dup, wanted):
    df = spark.createDataFrame([(title, access, dup)], "t string, a string, d int")
    assert tuple(df.select(E.rule_decision(F.col("t"), F.col("a"), F.col("d")).alias("r")).first().r) == wanted
