"""The trie of conversation prefixes against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from glossa.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d long, p1 string, path long"


def by_brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(x for x, _ in below) or 1, saved + sum(x for _, x in below))
        ends = ",".join(map(str, sorted(c for c in members[node] if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 9, "x", 9) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str)


def made(seed, n, words=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(330), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", "assistant", None]) if c % 7 == 0 else "user", rng.choice(["a", "bb", "ccc", "", None][:words])))
    return rows


@pytest.mark.parametrize(("seed", "n", "words", "longest"), [(1, 120, 2, 9), (2, 150, 5, 6), (3, 40, 1, 12)])
def test_against_plain_python(spark, seed, n, words, longest):
    rows = made(seed, n, words, longest)
    assert found(spark, rows) == by_brute_force(rows)


def test_one_conversation_of_many_turns_and_many_copies(spark):
    rows = [(7, t, "user", f"text {t % 5}") for t in range(2_000)] + [(c, t, "user", f"text {t}") for c in range(200, 300) for t in range(3)]
    assert found(spark, rows) == by_brute_force(rows)


def test_defined_cases(spark):
    rows = [(None, 1, "user", "no conversation"), (3, None, None, None), (3, 1, "user", "x" * 100_000), (105, 0, "user", ""), (104, 0, None, "")]
    assert found(spark, rows) == by_brute_force(rows)
    assert found(spark, []) == []
    twice = [(4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    assert found(spark, twice) == by_brute_force(twice)


def test_ids_of_one_node_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    df = spark.createDataFrame([(1, 2, 3, c) for c in range(500)] + [(1, 2, 4, -5)], "d long, p1 long, p2 long, conv_id long")
    got = {r.p2: r.ends_sha256 for r in prefix_trie.ends_hashes(df).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), 4: hashlib.sha256(b"-5").hexdigest()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == by_brute_force(rows)
