"""Chunks of documents and streams run to their end, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import chunks
from glossa.streaming import events


def packed_plainly(text, most, least, overlap):
    """Every paragraph, then every cut, by looking at whole lists again."""
    units = []
    for para in [re.sub(r"\s*\n\s*", " ", p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]:
        if len(para) <= most:
            units.append(para)
            continue
        todo, run = chunks.SENTENCE.split(para), []
        while todo:
            if run and len("".join(run)) + len(todo[0]) > most:
                units.append(" ".join(run))
                run = run[len(run) - min(overlap, len(run)) :] if overlap else []
            run.append(todo.pop(0))
        units.append(" ".join(run))
    out = []
    while units:
        n = 1
        while n < len(units) and len("\n".join(units[: n + 1])) <= most:
            n += 1
        out.append("\n".join(units[:n]))
        units = units[n:]
    if len(out) > 1 and len(out[-1]) < least:
        out = [*out[:-2], out[-2] + "\n" + out[-1]]
    return out


@pytest.mark.parametrize(("most", "least", "overlap"), [(200, 40, 2), (80, 30, 1), (60, 0, 0), (1_400, 300, 2)])
def test_packing(spark, most, least, overlap):
    rng = random.Random(most)
    word = lambda: rng.choice(["alpha", "be", "gammas", "d", "epsilon"])
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 12))).capitalize() + rng.choice(".!?")
    texts = ["\n\n".join(rng.choice([" ", "\n"]).join(sentence() for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 8))) for _ in range(60)] + ["", None, "x" * 5_000, "\n \n"]
    got = {}
    for r in chunks.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most, least, overlap).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: p for i, t in enumerate(texts) if (p := packed_plainly(t or "", most, least, overlap))}


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("3. Title of it", True), ("2.1 Title", True), ("2.1.3. Title here", True), ("1010 W. Brueggemann, Theology", False), ("# marked", True), ("INTRODUCTION AND AIM", True), ("A short line", False),
        ("3. A sentence that ends.", False), ("12 Por. Kowalski, s. 5", False), ("X" * 95, False), ("THIS IS A LINE OF MANY WORDS IN CAPITALS SO MANY THAT IT IS NO HEADING", False), ("", False),
    ],
)
def test_headings(line, wanted):
    assert chunks.is_heading(line) is wanted


def test_documents_in_chunks(spark):
    body = "A sentence of the text that goes on. " * 12
    pages = [(1, 1, f"# First\n\n{body}"), (1, 2, f"{body}\n\n## Short\n\nfew words"), (1, 3, f"# Second\n\n{body} See Mt 5,3 and Mt 5,3; Ps 2."), (2, 1, "no heading"), (3, 1, ""), (4, 5, "# only\n# titles")]
    df = spark.createDataFrame(pages, "document_id long, page long, text string").repartition(3)
    rows = chunks.with_references(chunks.document_chunks(df, 500, 100)).orderBy("document_id", "ord").collect()
    one = [r for r in rows if r.document_id == 1]
    assert [r.section for r in one] == ["First", "First", "Second"]
    assert one[0].text.startswith("First\nA sentence") and (one[0].page_from, one[0].page_to) == (1, 2)
    assert one[2].text.startswith("Short\n\nfew words\nSecond") and one[2].page_from == 3
    assert [(x.ref, x.start) for x in one[2].refs] == [("Mt 5,3", 47_005_003), ("Ps 2", 23_002_000)] or [x.start for x in one[2].refs] == [47_005_003, 23_002_000]
    assert [(r.document_id, r.text) for r in rows if r.document_id > 1] == [(2, "no heading"), (4, "only\ntitles")]
    held = spark.createDataFrame([(1, 0, "Mt 5,3", []), (1, 1, "Mt 5", [("Mt 5", 47_005_000, 47_005_999)]), (1, 2, "none", [])], "document_id long, ord int, text string, refs array<struct<ref:string,start:long,end:long>>")
    assert [(r.ord, r.refs[0].start) for r in chunks.changed_references(held).collect()] == [(0, 47_005_003)]


def test_streams_are_written_by_trigger(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("g", F.col("id") % 3).coalesce(1).write.parquet(f"{source}/part{k}")
    stream = spark.readStream.schema("id long, g long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    rows = events.drained(stream.filter("id % 2 = 0"), "append", f"file://{tmp_path}/a")
    assert sorted(r.id for r in rows.collect()) == list(range(0, 30, 2)) and rows.columns == ["id", "g"]
    counts = events.drained(stream.groupBy("g").count(), "complete", f"file://{tmp_path}/b")
    assert {r.g: r["count"] for r in counts.collect()} == {0: 10, 1: 10, 2: 10}
    nothing = events.drained(stream.filter("id < 0"), "append", f"file://{tmp_path}/c")
    assert nothing.count() == 0
