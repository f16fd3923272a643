"""Line dedup with null ids, equal ids and repeated rows against plain Python."""

import random
from collections import defaultdict

import pytest

from glossa.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_brute_force(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    keyed = []
    for doc_id, text in rows:
        lines = [(line, line.strip(SPACE).translate(LOWER)) for line in (text or "").split("\n")]
        keyed.append((doc_id, lines))
        for _, key in lines:
            if len(key) >= min_chars:
                holders[key].add(doc_id)
    keeper = {k: max(h, key=lambda x: (x is not None, x or 0)) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for doc_id, lines in keyed:
        kept = [line for line, key in lines if key not in keeper or keeper[key] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, text string, t long, keep string, pos long").repartition(3)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=str)


LINE = "a line that is long enough to be looked at, and common"


def test_lines_of_another_text_of_the_same_id_stay(spark):
    rows = [(i, f"{LINE}\nown {i}") for i in range(6)] + [(1, "unrelated first line\nkeep2"), (1, f"other\n{LINE}")]
    got = found(spark, rows)
    assert got == by_brute_force(rows)
    assert (1, 2, 0, "unrelated first line\nkeep2") in got and (1, 2, 1, "other") in got


def test_rows_without_an_id_are_one_holder(spark):
    rows = [(None, f"{LINE}\n{LINE}\n{LINE}"), (None, LINE), (1, LINE), (2, f"{LINE}\nrest")]
    got = found(spark, rows)
    assert got == by_brute_force(rows)
    assert (1, 1, 0, LINE) in got  # three holders are fewer than five
    more = [*rows, (3, LINE), (4, LINE)]
    got = found(spark, more)
    assert got == by_brute_force(more)
    assert (None, 1, 1, "") in got and (4, 1, 0, LINE) in got


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} that goes on for more than forty characters" for i in range(12)] + ["short", "", "  padded line that goes on for more than forty characters\t"]
    ids = [None, *range(9)]
    rows = [(rng.choice(ids), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 90)))) for _ in range(25)]
    rows += rows[:3] + [(5, None), (6, "")]
    assert found(spark, rows) == by_brute_force(rows)
