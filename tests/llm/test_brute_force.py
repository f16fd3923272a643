"""Operators that SQL cannot express, against plain Python on small tables."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossa.llm import decontamination, fingerprints, html_text, mixing, simhash, suffix_dedup, token_counts, token_output, tokens, toxicity
from glossa.llm.shared import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def noisy_copies(seed: int, n: int, length: int, alphabet: str) -> list[str]:
    rng = random.Random(seed)
    base = "".join(rng.choice(alphabet) for _ in range(length))
    found = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(length)] = rng.choice("xyz")
        found.append("".join(text))
    return [*found, base * 2, base[: length // 2], base[10 : length // 3]]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "Straße", "don't", "x_y", "3.5", "éthe", "and", "run", "it's", "ﬁne", "“q”", "<|endoftext|>", "a", "日本"]
    made = [rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    return pd.DataFrame({"doc_id": range(44), "text": [*made, made[5], made[5].upper(), None, ""]})


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(zip(texts["doc_id"].tolist(), [None if pd.isna(t) else t for t in texts["text"]], strict=True)), "doc_id long, text string").repartition(3)


def by_id(df) -> pd.DataFrame:
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def test_token_counts_and_output(spark, texts, docs):
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts["text"].fillna("")]
    assert by_id(token_counts.count_tokens(docs, PATH))["n_tokens"].tolist() == list(map(len, ids))
    found = by_id(token_output.read_tokens(token_output.write_tokens(docs, PATH, 2, new_path(spark, "t"), sequence=32, rows=2)))
    ended = [[*i, 2] for i in ids]
    assert found["n_tokens"].tolist() == list(map(len, ended))
    assert found["start"].tolist() == [0, *np.cumsum(list(map(len, ended)))[:-1].tolist()]
    assert found["ids_crc32"].tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ended]


def test_sentencepiece(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert by_id(token_counts.count_tokens(docs, path))["n_tokens"].tolist() == [len(library.encode(t)) for t in texts["text"].fillna("")]


def test_words_are_cut_as_the_library_cuts():
    library, pieces, rng = Tokenizer.from_file(PATH), tokens.Pieces(PATH), random.Random(1)
    parts = ["a", "B", "é", "1", "'s", " ", "\n", "_", ".", ",", "'", "ll", "\t", "²", "ª", "̀", "ß", "€", "­", "-", "’", "t", "д", "漢", "ا", "\u0558", "😀", "\u3000", "٣", "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(pieces.ids(text), pieces.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_length_table():
    lengths = {f" w{i}": i % 300 for i in range(2000)} | {"é": 2, "漢": 3}
    held = tokens.LengthTable(lengths)
    assert {w: held.get(w) for w in lengths} == {w: n if n < 256 else None for w, n in lengths.items()}
    assert held.get("w1") is None and tokens.LengthTable({}).get("a") is None


def test_fingerprints(texts, docs):
    def form(t):
        return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())

    t = texts["text"].fillna("").tolist()
    following = [t[-1], *t[:-1]]
    changed = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(t, following, strict=True)]
    found = by_id(fingerprints.compared(docs, fingerprints.fingerprint_pairs(docs)))
    assert found["fingerprint"].tolist() == [xxhash.xxh3_128_hexdigest(form(x)) for x in t]
    assert found["edited_sha256"].tolist() == [hashlib.sha256(x.encode()).hexdigest() for x in changed]
    assert found["near_edited"].tolist() == [float(form(a) == form(b)) for a, b in zip(t, changed, strict=True)]
    assert found["near_next"].tolist() == [float(form(a) == form(b)) for a, b in zip(t, following, strict=True)]


def test_equal_digests_of_different_texts_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda form: "same")
    found = docs.select("doc_id", F.lit("same").alias("fingerprint"))
    forms = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toPandas()["text"].map(fingerprints.canonical).nunique()

    def same_forms(batches):
        import pyarrow as pa

        for batch in batches:
            made = [fingerprints.canonical(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(["same"] * len(made)), pa.array(made, pa.string())], names=["doc_id", "fingerprint", "form"])

    monkeypatch.setattr(fingerprints, "_forms", same_forms)
    assert fingerprints.compared(docs, found).select("fingerprint").distinct().count() == forms


@pytest.mark.parametrize("hot", [4096, 8])
def test_simhash(spark, hot):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(300)]
    made = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 40])):
            words[rng.randrange(300)] = f"n{rng.randrange(900)}"
        made.append((i, " ".join(words)))
    found = by_id(simhash.near_groups(spark.createDataFrame(made, "doc_id long, text string"), hot=hot))
    value = []
    for _, text in made:
        w = text.split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
        value.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(value)))
    for _ in value:  # smallest reachable, by repeated relaxation
        for i, a in enumerate(value):
            root[i] = min(root[j] for j, b in enumerate(value) if (a ^ b).bit_count() <= 3)
    assert (found["fp"].to_numpy().view(np.uint64)).tolist() == value
    assert found["component_id"].tolist() == root


@pytest.mark.parametrize(("hot", "group"), [(4096, 1_000_000), (8, 2_000)])
def test_similar_groups_by_kind_of_edit(spark, hot, group):
    rng = random.Random(11)
    made, word = [], lambda: f"w{rng.randrange(5000)}"
    for i in range(60):
        base = [word() for _ in range(rng.choice([60, 200, 400]))]
        made.append(base)
        for share in (0.05, 0.1, 0.15, 0.18, 0.24):
            n = int(share * len(base))
            at = rng.randrange(len(base) - n)
            replaced, half = [*base[:at], *(word() for _ in range(n // 2)), *base[at + n // 2 :]], base[:-n]
            scattered = list(base)
            for k in rng.sample(range(len(base)), max(1, n // 10)):
                scattered[k] = word()
            made.append([replaced, base + [word() for _ in range(n)], half, scattered][i % 4])
    made += [["one", "two"], ["one", "two"], [], []]
    texts = [" ".join(w) for w in made]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in made]
    root = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.id: r.component_id for r in simhash.similar_groups(docs, hot=hot, group=group).collect()}
    assert [found.get(i, i) for i in range(len(made))] == root
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))


def test_golay_code():
    code, rng = simhash.golay(), np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500)
    for bit in range(23):  # of two words at one differing bit, one's codeword is near the other
        row, index = code.near(words)
        other = code.decode(words ^ 1 << bit)
        assert all(other[i] in index[row == i] for i in range(0, 500, 25))


@pytest.mark.parametrize("hot", [200, 20, 2])
def test_suffix_dedup(spark, hot):
    made = noisy_copies(5, 60, 240, "abcd é\n") + ["q" * 500, "", None, "ab" * 200]
    length = 80
    raw = [(t or "").encode() for t in made]
    starts: dict[bytes, list] = {}
    for n, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            starts.setdefault(t[i : i + length], []).append((n, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in starts.values():
        if len(places) > 1:
            for n, i in places:
                gone[n][i : i + length] = True
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    found = by_id(suffix_dedup.dedup_substrings(df, length, 20, hot))
    assert [bytes(k) for k in found["kept"]] == [bytes(np.frombuffer(t, np.uint8)[~g]) for t, g in zip(raw, gone, strict=True)]
    assert found["n_removed"].tolist() == [int(g.sum()) for g in gone]


def test_mixing(spark):
    rng = random.Random(4)
    made = [(i, "w " * rng.randint(0, 80), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    found = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string")).toPandas()
    size = pd.DataFrame(made, columns=["doc_id", "text", "source"]).assign(size=lambda d: d["text"].str.split().map(len)).groupby("source", dropna=False)["size"].sum()
    names = ["a", "b", "c", None]
    total = [size[n] if n else size[size.index.isna()].iloc[0] for n in names]
    weight, target, open_ = [3, 1, 2, 3], [0.0] * 4, set(range(4))
    budget = 1.5 * sum(total)
    while True:
        left = budget - sum(2 * total[i] for i in range(4) if i not in open_)
        share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * total[i]}
        if not over:
            break
        open_ -= over
    target = [share[i] if i in open_ else 2.0 * total[i] for i in range(4)]
    by = found.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    for t, want in zip(total, target, strict=True):
        assert by.loc[t, "target"] == pytest.approx(want)
        assert abs(by.loc[t, "taken"] - want) <= 1
    assert (found["taken"] <= 2 * found["size"]).all()


def test_decontamination_finds_new_parameters(spark):
    item = "A train leaves Berlin at 9 and travels 120 km to Hamburg at a speed of 80 kmh; how long does the journey take it?"
    cases = {
        0: f"Before. {item} After.",
        1: "Text before. " + item.replace("120", "300").replace("80", "75").replace("Hamburg", "Munich") + " And after.",
        2: item.lower().replace("train", "horse").replace("journey", "ride").replace("travels", "runs").replace("speed", "pace").replace("leaves", "quits"),
        3: "A train is late. The speed of light is known to all who travel to Hamburg.",
        4: item.replace("A train leaves Berlin at 9 and", "Some words that differ wholly from it here and"),
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id for r in decontamination.contaminated(df, items).collect()}
    assert {0, 1} <= found and not found & {2, 3}


def test_decontamination_finds_names_that_begin_sentences_and_number_words(spark):
    tom = "Tom has 3 red apples. Tom buys 4 more apples. Tom eats 2 of them. How many apples does Tom have?"
    box = "Ken packed a box. Ken added 2 pounds of rice to it. Ken then carried the box home. How heavy was it?"
    bag = "A bag holds three apples and a boy puts four more into it before he eats two of them at home."
    texts = {
        0: tom.replace("Tom", "Ann").replace("3", "5").replace("4", "9").replace("2", "6"),
        1: box.replace("Ken", "Maria").replace("2", "7"),
        2: bag.replace("three", "five").replace("four", "nine").replace("two", "six"),
        3: bag.upper(),
        4: tom.lower(),
        5: "Ann has 3 red cats. Tom sells 4 old boats. Max sees 2 of us. How many dogs does Ida want?",
    }
    items = spark.createDataFrame([(0, tom), (1, box), (2, bag)], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), items).collect()
    assert {(0, 0), (1, 1), (2, 2), (4, 0)} <= {(r.doc_id, r.item_id) for r in found}
    assert 5 not in {r.doc_id for r in found}


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_decontamination_against_all_pairs(spark, similarity):
    """Every region of every document against every item, without keys, filter and joins."""
    rng = random.Random(9)
    words = ["the", "box", "holds", "apples", "3", "7", "kg", "Tom", "Ann", "runs", "to", "Berlin", "five", "and"]

    def made(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))

    items = [(i, made(rng.choice([3, 8, 20, 40]))) for i in range(12)]
    items += [(12, "Tom Ann Bob Max Ida Leo"), (13, "1 2 3 4 5 6 7"), (14, "the box holds the box holds the box"), (15, ""), (16, None), (None, items[2][1])]
    names = [f"N{i}" for i in range(40)]
    docs = [(i, " ".join([made(rng.randint(0, 30)), items[i % 14][1] if i % 2 else "", made(10)]).replace("Tom", rng.choice(["Tom", "Kim"])).replace("3", rng.choice("39"))) for i in range(60)]
    docs += [(60, " ".join(rng.choice(names) for _ in range(200))), (61, "Ann Tom Bob Ida Max Leo and Tom Ann Bob Max Ida Leo"), (None, items[5][1]), (63, None), (64, made(900) + " " + items[6][1])]
    wanted = {}
    for item_id, item in items:
        v, t = decontamination.templates(item)
        n, size = min(5, len(v)), len(v)
        own = {(int(h), *decontamination._slots(v, slot, i, n)): None for at, hs, slot in (decontamination.all_windows(v, t, n) if n else ()) for i, h in zip(at.tolist(), hs.tolist(), strict=True)}
        places = {k: [i for at, hs, slot in decontamination.all_windows(v, t, n) for i, h in zip(at.tolist(), hs.tolist(), strict=True) if (int(h), *decontamination._slots(v, slot, i, n)) == k] for k in own}
        step = -(-size * 5 // 4)
        for doc_id, doc in docs if n else ():
            dv, dt = decontamination.templates(doc)
            regions: dict[int, set] = {}
            for at, hs, slot in decontamination.all_windows(dv, dt, n):
                for i, h in zip(at.tolist(), hs.tolist(), strict=True):
                    for k in places:
                        slots = decontamination._slots(dv, slot, i, n)
                        if k[0] == h and len(k) - 1 == len(slots):
                            for r in (i // step, i // step - 1):
                                regions.setdefault(r, set()).add((tuple(places[k]), k[1:], tuple(slots)))
            best = max((decontamination._covered(size, [{"places": list(p), "n": n, "item_slots": list(a), "doc_slots": list(b)} for p, a, b in m]) for m in regions.values()), default=0)
            if best >= similarity:
                wanted[doc_id, item_id] = max(best, wanted.get((doc_id, item_id), 0))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), similarity=similarity).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.coverage) for r in found} == wanted
    assert len(found) == len(wanted) > 20
    assert (60, 12) not in wanted and (61, 12) in wanted


def test_ordinal_likelihood():
    """The fit is where the likelihood's slope, taken by differences, is zero; likelihoods are summed by hand."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 4, 3)) for _ in range(300)]
    grade = np.array([min(2, int(rng.random() < 0.2 + 0.2 * (0 in r)) + int(1 in r and rng.random() < 0.4)) for r in rows])
    places, weights, t = toxicity.fit(rows, grade)

    def loss(x):
        w = dict(zip(places.tolist(), x[:-2], strict=True))
        total = 0.0
        for r, g in zip(rows, grade, strict=True):
            s = sum(w.get(int(f), 0.0) for f in r)
            p1, p2 = (1 / (1 + np.exp(-(s - x[k]))) for k in (-2, -1))
            total -= np.log([1 - p1, p1 - p2, p2][g]) / len(rows)
        return total + toxicity.PENALTY / 2 * float(np.sum(x[:-2] ** 2))

    x = np.concatenate([weights, t])
    assert len(places) > 0 and t[0] < t[1]
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-4
        assert abs(loss(x + step) - loss(x - step)) / 2e-4 < 2e-3


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    made, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [rng.choice(plain) for _ in range(60)] + (["vile" + rng.choice("abcdef"), "nasty"] if toxic else [])
        rng.shuffle(words)
        made.append((i, " ".join(words)))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    df, known = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    found = by_id(toxicity.score(df, toxicity.train(df, known)))[400:]
    assert (found["toxic"] == (found["doc_id"] % 6 == 0)).mean() > 0.98
    assert found["severity"].between(0, 2).all()


def test_main_text():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies on this site, and this notice is a long sentence.</div>"
        "<article><h1>Title</h1><p>First &amp; <b>bold</b> paragraph.<p>Short<br>line.<div class=ad>Buy now, the best there is.</div><p>Last paragraph, which is longer.</article>"
        "<section id=comments><p>A reader says that it is a very good article indeed.</p></section><aside>More</aside><form>Sign up</form><footer>&copy; 2020</footer>"
    )
    assert html_text.main_text(page) == "Title First & bold paragraph. Short line. Last paragraph, which is longer."


def bare_page(rng, word) -> tuple[str, list[bool]]:
    """A page of plain divisions and whether each block is main text: names and kinds of elements say nothing."""

    def text(n):
        return " ".join(word() for _ in range(n)).capitalize() + "."

    link = lambda: f"<a href=x>{word()}</a>"
    head = [f"<div>{text(9) if rng.random() < 0.2 else link()}</div>" for _ in range(rng.randint(3, 8))]
    body = [link() if rng.random() < 0.2 else text(rng.choice([3, 12, 30, 60])) for _ in range(rng.randint(4, 9))]
    more = [text(rng.choice([4, 9, 14])) for _ in range(2)]
    page = f"<div>{''.join(head)}</div><div>{more[0]}</div><div><div>{'</div><div>'.join(body)}</div></div><div>© {more[1]}</div>"
    return page, [False] * (len(head) + 1) + [True] * len(body) + [False]


def test_the_cut_is_better_than_the_classifier_alone():
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "of", "the"])
    x, y, near, differ = [], [], np.zeros(html_text.FAR + 1), np.zeros(html_text.FAR + 1)
    for _ in range(150):
        source, gold = bare_page(rng, word)
        page = html_text.Page(source)
        x.append(html_text.features(page))
        y += gold
        for i, j, steps in page.edges():
            near[steps] += 1
            differ[steps] += gold[i] != gold[j]
    model = html_text.Model(html_text.fitted_weights(np.concatenate(x), np.array(y, float)), html_text.fitted_ties(near, differ))
    right, alone, n, changed = 0, 0, 0, 0
    for _ in range(150):
        source, gold = bare_page(rng, word)
        page = html_text.Page(source)
        costs = html_text.costs(page, model)
        kept, by_cost = html_text.least_cut(costs, html_text.links(page, model)), [a > b for a, b in costs]
        assert len(kept) == len(gold)
        right, alone, n = right + sum(map(bool.__eq__, kept, gold)), alone + sum(map(bool.__eq__, by_cost, gold)), n + len(gold)
        changed += sum(a != b for a, b in zip(kept, by_cost, strict=True))
    assert changed > 0 and right / n > 0.85 and right / n > alone / n + 0.05, (right / n, alone / n, changed)


def test_fit_on_a_table(spark):
    """Of pages whose names tell, the fit on the table is the fit by hand."""
    made = [(i, f"u{i}", f"<nav><a href=x>Home {i}</a></nav><article><p>{'A word, and more. ' * (i + 1)}</p><p>Short.</p></article><footer>© {i}</footer>") for i in range(30)]
    x, y, near, differ = [], [], np.zeros(html_text.FAR + 1), np.zeros(html_text.FAR + 1)
    for _, _, source in made:
        page = html_text.Page(source)
        seeds = page.seeds()
        x.append(html_text.features(page))
        y += seeds
        for i, j, steps in page.edges():
            near[steps] += 1
            differ[steps] += seeds[i] != seeds[j]
    model = html_text.fit(spark.createDataFrame(made, "page_id long, url string, html string").repartition(3))
    assert model.weights == pytest.approx(html_text.fitted_weights(np.concatenate(x), np.array(y, float)), abs=1e-4)
    assert model.ties == pytest.approx(html_text.fitted_ties(near, differ))


def test_least_cut_is_least():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 8)
        costs = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        links = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(b if s else a for s, (a, b) in zip(side, costs, strict=True)) + sum(w for i, j, w in links if side[i] != side[j])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.least_cut(costs, links)) == best
