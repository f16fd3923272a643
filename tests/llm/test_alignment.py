"""Token alignment against encoding and aligning every whole text by itself."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from glossa.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "One two three, it's  a test. One two three.",
    "One two three, it's  a test. One two three.",
    "line one\nline two\n\n\tindented\r\nwindows line;\r\n  end \n",
    " \n\t ",
    " ",
    "\n",
    "a\x0bb\x0cc d e　f g  h \x1c i\x85 j",
    "no﻿break \x00 zero <|endoftext|> <s>x</s> <0x0A> ﬁ ＡＢ",
    "日本語の文章は空白なしで続く。😀 emoji 😀😀",
    "lower one eighth ▁ block is lost",
    "",
    None,
    "x" * 20_000,
    "word " * 3_000,
    "mixed\r words\r\r and ;\r tails\r",
]


def by_brute_force(texts):
    """Per text: n_a, n_b, groups, links; over all: links of each pair."""
    both = alignment.Vocabularies(A, B)
    out, pairs = [], Counter()
    for text in texts:
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        raw = b" " + (text or "").encode()
        if not text or b"".join(both.bytes_a[x] for x in a) != raw or b"".join(both.bytes_b[x] for x in b) != raw:
            out.append((0, 0, [], []))
            continue
        spans = []
        for ids, of in ((a, both.bytes_a), (b, both.bytes_b)):
            at, here = 0, []
            for x in ids:
                here.append((at, at + len(of[x]), x))
                at += len(of[x])
            spans.append(here)
        links, start = [], 0
        for s, e, x in spans[0]:
            while spans[1][start][1] <= s:
                start += 1
            j = start
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((x, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            part = [[], []]
            while i < len(a) and spans[0][i][1] <= cut:
                part[0].append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                part[1].append(str(b[j]))
                j += 1
            groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
        out.append((len(a), len(b), groups, links))
        pairs.update(links)
    return out, pairs


def expected(texts):
    out, pairs = by_brute_force(texts)
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, len(g), len(k), sum(pairs[x] == most[x[1]] for x in k), sum(pairs[x] for x in k), ";".join(g)) for n_a, n_b, g, k in out]


def found(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()}


@pytest.mark.parametrize(("most_pairs", "block_segments", "places"), [(500_000, 500_000, 4_096), (1, 7, 2)])
def test_against_whole_texts(spark, most_pairs, block_segments, places):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = found(alignment.align_tokens(docs, A, B, most_pairs, block_segments, places))
    assert got == dict(enumerate(expected(TEXTS)))


def test_cuts_are_found_in_the_vocabularies():
    both = alignment.Vocabularies(A, B)
    assert "\r" not in both.cuts and " " in both.cuts and "\n" in both.cuts
    for text in TEXTS:
        if text:
            assert "".join(both.segment.findall(" " + text)) == " " + text


def test_tokenizers_without_proof_take_whole_texts(monkeypatch, spark):
    both = alignment.Vocabularies(A, B)
    both.kept_whole, both.segment = True, alignment.re.compile(r"(?s:.+)")
    for text in TEXTS:
        if text and text != " ":
            assert both.gives_back(text) == ("▁" not in text)
    assert both.segment.findall(" a\nb") == [" a\nb"]


def test_defined_cases(spark):
    schema = "doc_id string, text string, block long, kind int, data binary, segment string"
    rows = [(None, "one two", 1, 2, b"", "s"), (None, "one two", 1, 2, b"", "s"), ("a", None, None, None, None, None), ("a", "", 0, 0, b"x", "")]
    docs = spark.createDataFrame(rows, schema)
    got = alignment.align_tokens(docs, A, B).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_groups) for r in got) == [("None", 2, 2), ("None", 2, 2), ("a", 0, 0), ("a", 0, 0)]
    assert alignment.align_tokens(docs.limit(0), A, B).count() == 0


@pytest.mark.skipif(not alignment.public_tokenizers, reason="no tokenizers")
def test_query(spark):
    got = {r.doc_id: r for r in alignment.op12_align_tokens(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = expected([d.text for d in docs])
    for d, w in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
