"""Every stage of the pipeline on its predecessor's documents, against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossa.llm import decontamination, toxicity
from glossa.llm.shared import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A farmer has 12 sheep and buys 7 more at the market; how many sheep does the farmer own after he sells 3 of them?"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("sf")), random.Random(21)
    words = [f"w{i}" for i in range(400)]
    made, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.choice([20, 60, 200]))]
        if toxic := i % 6 == 0:
            text[3:5] = ["vile" + rng.choice("abc"), "nasty"]
        labels.append((i, i % 2, int(toxic)))
        if i % 10 == 7:
            text = made[rng.randrange(i)][1].split()
            text[-1] = "changed"
        if i % 25 == 1:
            text[5:5] = ITEM.replace("12", "40").split() if i % 50 == 1 else ITEM.split()
        made.append((i, " ".join(text), "en", rng.choice(["a", "a", "b", None]), 0))
    made += [(300, None, None, None, None), (301, "", "en", "b", 0), (None, "a text of no id", "en", "a", 1), (5, made[5][1], "en", "a", 1)]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    found = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(staged(stage(spark, found[-1], sf_dir), name))
    return [f.collect() for f in found]


def key(r):
    return str(r.doc_id), r.text or ""


def test_toxicity(stages, sf_dir):
    before, after = stages[0], stages[1]
    text = {r.doc_id: r.text for r in before}
    rows = [(sorted({f for w in toxicity.distinct_words(text[i]) for f in toxicity.word_features(w)}), 0 if i % 6 else (1 if i % 2 else 2)) for i in range(200)]
    places, weights, t = toxicity.fit([np.array(r, np.int64) for r, _ in rows], np.array([g for _, g in rows]))
    weight = dict(zip(places.tolist(), weights.tolist(), strict=True))

    def kept(s):
        score = sum(weight.get(f, 0.0) for f in {f for w in toxicity.distinct_words(s) for f in toxicity.word_features(w)})
        return 1 / (1 + np.exp(-(score - t[0]))) < toxicity.THRESHOLD

    assert sorted(map(key, after)) == sorted(key(r) for r in before if kept(r.text))
    assert sum(r.doc_id is not None and r.doc_id % 6 == 0 and r.doc_id % 10 != 7 and r.doc_id < 300 for r in after) == 0
    assert len(after) > 200


def test_near_copies(stages):
    before, after = stages[1], stages[2]

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(r.text) for r in before]
    root = list(range(len(before)))
    for a in range(len(sets)):
        for b in range(a):
            if not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for r, g in zip(before, root, strict=True):
        rank = -(2**63) if r.doc_id is None else r.doc_id
        least[g] = min(least.get(g, (2**63,)), (rank,))
    assert len(after) == len(least)
    assert sorted(-(2**63) if r.doc_id is None else r.doc_id for r in after) == sorted(x for (x,) in least.values())


def test_decontamination(stages):
    before, after = stages[2], stages[3]
    v, made = decontamination.templates(ITEM)

    def holds(text):
        tv, tm = decontamination.templates(text)
        windows = {int(h) for _, hs, _ in decontamination.all_windows(v, made, 5) for h in hs}
        hit = {int(h) for _, hs, _ in decontamination.all_windows(tv, tm, 5) for h in hs}
        return len(windows & hit) / len(windows) >= 0.8

    assert sorted(map(key, after)) == sorted(key(r) for r in before if not holds(r.text))
    assert len(after) < len(before)


def test_mixing(stages):
    before, after = stages[3], stages[4]

    def size(r):
        return len((r.text or "").split())

    total = {s: sum(size(r) for r in before if r.source == s) for s in ("a", "b", None)}
    weight, target, open_ = {"a": 3, "b": 1, None: 2}, {}, {"a", "b", None}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in total if s not in open_)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            break
        open_ -= over
    target = {s: share[s] if s in open_ else 2 * total[s] for s in total}
    for s in total:
        took = sum(size(r) for r in after if r.source == s)
        assert target[s] - 200 <= took <= target[s] + 1e-6
    copies = {}
    for r in after:
        copies[key(r)] = copies.get(key(r), 0) + 1
    assert set(copies) <= set(map(key, before)) and max(copies.values()) <= 2


def test_token_output(stages):
    before, after = stages[4], stages[5]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in after) == sorted((str(r.doc_id), crc(r.text)) for r in before)
    at = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(after, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
