"""Every operator on nulls, empty and very long texts, ties, repeated rows, no rows, and clashing further columns."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossa.llm import decontamination, fingerprints, html_text, line_dedup, mixing, simhash, suffix_dedup, token_counts, token_output, toxicity
from glossa.llm.shared import new_path

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, h long, toxic boolean, fp long, key long, word string, keep string, "
    "grade int, _id long, _times int, _copy int, _gone long, _a long, t long, id long, node long"
)
MORE = (7, 8, 9, 10, 11, 12, 13, 14, 15)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows(*pairs):
    return [(i, t, None, s, None, -1, -1, None, 5, 6, "w", "k", *MORE) for i, t, s in pairs]


CASES = rows(
    (0, "One two three four five six seven.", "a"),
    (1, None, "a"),
    (2, "", None),
    (3, " \n\t ", "b"),
    (4, "One two three four five six seven.", "b"),
    (4, "One two three four five six seven.", "b"),
    (5, "x" * 20_000, "c"),
    (6, "word " * 30_000, "c"),
    (None, "An id that is null, with words.", "a"),
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CASES, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, None), (4, 0, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "two three four five six"), (1, None), (2, ""), (3, "One two"), (3, "One two")], "item_id long, text string")


def test_mixing(docs, nothing):
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(CASES)
    assert (found["taken"] <= 2 * found["size"]).all()
    assert found.groupby("target")["taken"].sum().sub(found.groupby("target")["target"].first() * 1).abs().max() < 30_000
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(nothing).count() == 0


def test_fingerprints(docs, nothing):
    found = fingerprints.compared(docs, fingerprints.fingerprint_pairs(docs)).toPandas()
    assert len(found) == len(CASES)
    same = found[found["doc_id"].isin([0, 4])]["fingerprint"]
    assert same.nunique() == 1
    assert found[found["doc_id"].isin([1, 2, 3])]["fingerprint"].nunique() == 1  # null, empty and white space
    assert fingerprints.compared(nothing, fingerprints.fingerprint_pairs(nothing)).count() == 0


def test_decontamination(docs, nothing, items):
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(0, 0), (4, 0), (0, 3), (4, 3)}
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.without_benchmark(docs, items).columns == docs.columns


def test_token_counts(docs, nothing):
    found = token_counts.count_tokens(docs, TOKENIZER).toPandas()
    assert len(found) == len(CASES)
    assert found[found["doc_id"].isin([1, 2])]["n_tokens"].tolist() == [0, 0]
    assert token_counts.count_tokens(nothing, TOKENIZER).count() == 0


def test_simhash(docs, nothing):
    found = simhash.near_groups(docs).toPandas()
    assert len(found) == len(CASES)
    groups = found.dropna().groupby("component_id")["doc_id"].apply(set).tolist()
    assert {0, 4} in [{int(x) for x in g} for g in groups]
    assert {1, 2, 3} in [{int(x) for x in g} for g in groups]
    assert simhash.near_groups(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert simhash.one_of_each(nothing).count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "5", "6", "None"]


def test_near_copies_of_equal_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    made = rows((1, long, "a"), (1, long, "b"), (1, "another text of the same id", "c"), (2, long, "d"), (None, "no id", "e"), (None, "no id", "f"), (None, "none either", "g"))
    found = sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(spark.createDataFrame(made, SCHEMA)).collect())
    assert found == sorted([("1", long), ("1", "another text of the same id"), ("None", "no id"), ("None", "none either")])


def test_suffix_dedup(docs, nothing):
    found = suffix_dedup.dedup_substrings(docs).toPandas().set_index("doc_id")
    assert len(found) == len(CASES)
    assert found.loc[5, "n_removed"] == 20_000
    assert found.loc[6, "n_removed"] == 150_000
    assert found.loc[0, "n_removed"] == 0
    assert suffix_dedup.dedup_substrings(nothing).count() == 0


def test_line_dedup(spark, nothing, docs):
    line = "A line that is long enough to be counted as one."
    held = spark.createDataFrame(rows(*((i, f"{line}\nown {i}\n  {line.upper()}\t", "s") for i in range(6)), (6, None, "s"), (7, "", "s"), (5, line, "s")), SCHEMA)
    found = {(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(held).collect()}
    assert (0, "own 0") in found and (6, "") in found and (7, "") in found
    assert (5, f"{line}\nown 5\n  {line.upper()}\t") in found and (5, line) in found
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(CASES)


def test_toxicity(docs, nothing, labels):
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(CASES)
    assert toxicity.score(nothing, model).count() == 0
    unlabelled = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, unlabelled).collect())
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_token_output(spark, docs, nothing):
    manifest = token_output.write_tokens(docs, TOKENIZER, 2, new_path(spark, "t"), sequence=64, rows=4)
    found = token_output.read_tokens(manifest).toPandas().sort_values("start")
    assert len(found) == len(CASES)
    assert found["start"].tolist() == [0, *found["n_tokens"].cumsum().tolist()[:-1]]
    assert found[found["doc_id"] == 2]["n_tokens"].tolist() == [1]
    for shard in manifest.collect():
        total = 0
        for i in range(-(-shard["n_tokens"] // 64)):
            ids, mask = token_output.read_sequence(shard, i)
            assert len(ids) == len(mask) == 64
            total += mask.true_count
            if shard["ids_file"].startswith("file:"):  # both are views of the mapped file
                assert not ids.flags.owndata and not mask.buffers()[1].is_mutable
        assert total == shard["n_tokens"]
    assert token_output.read_tokens(token_output.write_tokens(nothing, TOKENIZER, 2, new_path(spark, "t"))).count() == 0


def test_html_text(spark):
    pages = [(0, "u", None, "x"), (1, None, "", "x"), (2, "u", "<article><p>" + "Long text. " * 20_000, "x"), (None, "u", "<p>No end &amp; no start", "x"), (4, "u", "<<<>>&#xZ;", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(found) == 5 and found[0].text == "" and found[1].n_chars == 0
    assert found[2].n_chars == len("Long text. ") * 20_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_deep_and_broken_pages_take_linear_time():
    deep = html_text.Page("<div>" * 20_000 + "A text." + "<b>" * 20_000 + "<h1>t</h1>" * 2_000 + "</i>" * 20_000)
    assert len(deep.blocks) == 2_001 and max(deep.depth) > 20_000
    assert len(html_text.Page("<table>" * 2_000 + "<tr>" * 5_000 + "<td>x" * 5_000).blocks) == 5_000
    assert html_text.main_text("<article>text " + "<a " * 100_000).startswith("text")


def test_hashes_are_of_the_whole_text(docs):
    found = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert hashlib.sha256(bytes(found[0].kept)).hexdigest() == hashlib.sha256(b"One two three four five six seven.").hexdigest()


def test_components_of_one_star(spark):
    """One node with 100,000 neighbours, in a chain with others."""
    edges = spark.range(100_000).selectExpr("id + 10 AS u", "5L AS v").unionByName(spark.createDataFrame([(5, 3), (3, 1), (200_000, 200_001), (7, 7)], "u long, v long"))
    found = simhash.components(edges)
    assert found.groupBy("root").count().orderBy("root").collect() == [(1, 100_002), (200_000, 1)]


def test_a_large_group_is_compared_by_its_parts(spark):
    """Copies of one text in a group of many parts are linked, and what is apart in the same group stays apart."""
    words = [f"w{i}" for i in range(300)]
    made = [(i, " ".join([*words[: 250 + i % 3], f"own{i}"]), None) for i in range(120)] + [(500 + i, " ".join(f"x{i}y{k}" for k in range(300)), None) for i in range(3)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    small = simhash.similar_groups(docs, group=1_000)
    assert kept == [0, 500, 501, 502]
    assert small.select("component_id").distinct().collect() == [(0,)] and small.count() == 120


def test_equal_prints_of_different_texts_are_told_apart(spark, monkeypatch):
    """With a digest of one letter, rows of null and equal ids keep one row each and different texts different fingerprints."""
    monkeypatch.setattr(fingerprints, "digest", lambda form: form[:1])
    df = spark.createDataFrame([(None, "ab"), (1, "ac"), (1, "xy"), (2, "AB "), (3, "zz")], "doc_id long, text string")
    found = spark.createDataFrame([(None, "a"), (1, "a"), (1, "x"), (2, "a"), (3, "z")], "doc_id long, fingerprint string")
    forms = fingerprints.compared(df, found).collect()
    assert len(forms) == 5


def test_benchmark_items_are_found_by_row(spark):
    """Of two texts of one doc_id each is judged by itself, and windows of both never make one item together."""
    words = [f"word{i}" for i in range(30)]
    item = " ".join(words)
    made = [(1, f"before {item} after"), (1, "a clean text of the same id"), (2, " ".join(words[:16])), (2, " ".join(words[14:])), (None, item), (None, "clean")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(1, 7), (None, 7)}
    kept = sorted((str(r.doc_id), r.text) for r in decontamination.without_benchmark(docs, items).collect())
    assert kept == sorted([("1", made[1][1]), ("2", made[2][1]), ("2", made[3][1]), ("None", "clean")])


def test_number_words_of_other_languages(spark):
    said = "Anna hat {} Äpfel im Korb und kauft noch {} Birnen auf dem Markt bevor sie nach Hause geht und alles zählt"
    docs = spark.createDataFrame([(1, said.format("drei", "sieben"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, said.format("vier", "neun"))], "item_id long, text string")
    assert decontamination.contaminated(docs, items).count() == 1


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_token_files_of_any_kind_of_id(spark, tmp_path, kind):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = token_output.op9_token_output(spark, str(tmp_path)).orderBy("start")
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert [(str(r.doc_id), r.n_tokens) for r in found.collect()] == [("1", 3), ("2", 1), ("3", 2)]
