"""Quality rules against plain Python and against their SQL."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, measure string, bucket long, _lang string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", 2, "x", 3) for r in rows], SCHEMA).repartition(3)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def cut(value):
    shift = max(value.bit_length() - 10, 0) if value else 0
    return value >> shift << shift


def judged(rows, least):
    """doc_id, measures and verdicts row by row, quartiles from sorted lists."""
    out, held = [], []
    for _, text, lang, source in rows:
        n, chars, symbols, lines, dup, rep = base(text)
        failed = n < 50 or 100 * rep > 50 * n
        values = [chars * 1000 // n if n else 0, symbols * 1000 // n if n else 0, dup * 1000 // lines if lines else 0, rep * 1000 // n if n else 0]
        out.append((n, chars, symbols, dup, rep, failed, values))
        if not failed:
            held.append((lang, source, values))
    kept = []
    for (_, _, lang, source), (*_, failed, values) in zip(rows, out, strict=True):
        fits = not failed
        for m, slack in enumerate((100, 50, 150, 150)):
            groups = [[cut(v[m]) for a, b, v in held if (a, b) == (lang, source)], [cut(v[m]) for a, _, v in held if a == lang], [cut(v[m]) for _, _, v in held]]
            group = sorted(next((g for g in groups if len(g) >= least), groups[-1]))
            if fits and group:
                low, high = group[math.ceil(len(group) / 4) - 1], group[math.ceil(len(group) * 3 / 4) - 1]
                spread = 3 * max(high - low, slack)
                fits = low - spread <= values[m] <= high + spread
        kept.append(fits)
    return sorted(((r[0], *o[:6], k) for r, o, k in zip(rows, out, kept, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)


def made(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["of", "the", "words", "longer", "syllables", "élan", "x"]) + rng.choice(["", "a", "bc"]) + str(rng.randrange(40)) for _ in range(rng.choice([10, 60, 120]))]
        kind = rng.randrange(9)
        if kind == 0:
            words = [w + "***" for w in words]
        if kind == 1:
            words = ["again", "and", "again"] * 30
        if kind == 2:
            words = [w.upper() * 3 for w in words]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words)
        if kind == 3:
            text += "\nthe same line of it\n" * 12
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", None])))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 200), (2, 12), (3, 40)])
def test_against_plain_python(spark, seed, least):
    rows = made(random.Random(seed), 160) + [(900, None, "en", "a"), (901, "", None, None), (902, " \n\t", "de", "b"), (5, "x" * 30_000, "en", "a"), (5, "x" * 30_000, "en", "a"), (None, "word " * 30_000, "en", "a")]
    assert found(quality.judged(frame(spark, rows), least_group=least)) == judged(rows, least)


def test_no_rows_and_no_row_that_passes(spark):
    assert quality.judged(frame(spark, [])).count() == 0
    assert found(quality.judged(frame(spark, [(1, "few words", "en", "a")]))) == [(1, 2, 8, 0, 0, 0, True, False)]


def test_sketches_merge_and_keep_their_width(spark):
    rng = random.Random(4)
    values = [rng.randrange(10 ** rng.randrange(1, 13)) for _ in range(3_000)] + [0, 1, 1023, 1024, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    for r in df.select("v", quality.bucket_value(F.col("b")).alias("low")).collect():
        assert r.low == cut(r.v) and r.low <= r.v and (r.v - r.low) * 512 <= r.v
    parts = [df.filter(F.col("v") % 2 == k).groupBy("b").count() for k in (0, 1)]
    merged = parts[0].unionByName(parts[1]).groupBy("b").agg(F.sum("count").alias("count"))
    assert sorted(merged.collect()) == sorted(df.groupBy("b").count().collect())


def test_query_and_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    wanted = con.sql(quality.ORACLE_SQL["op13_quality_rules"]).df()
    got = quality.op13_quality_rules(spark, folder).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert got.sort_values("doc_id")[columns].values.tolist() == wanted.sort_values("doc_id")[columns].values.tolist()


def test_no_python_runs_in_tasks(spark):
    plan = quality.judged(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
