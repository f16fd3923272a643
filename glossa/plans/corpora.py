"""Queries of corpus operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import query
from glossa.operators import corpus, verify, windows
from glossa.tables import table

NAMES = ["thing", "with", "ander", "reed", "lychen"]


def _searched(spark, sf_dir, text):
    """Documents that meet a query of the search box, words without final s standing for lemmas and the source for a number."""
    words = table(spark, sf_dir, "documents").select("doc_id", "lang", T.words(F.col("text")).alias("w"), F.array(F.concat(F.lit("G"), F.regexp_extract("source", "([0-9]+)", 1))).alias("numbers"))
    lemmas = F.transform("w", lambda x: F.regexp_replace(x, "s$", ""))
    return words.filter(query.condition(query.parse(text), F.col("w"), F.col("numbers"), lemmas)).select("doc_id", "lang")


def query_search(spark, sf_dir):
    """Words, a phrase, nearness and an exclusion in one query."""
    return _searched(spark, sf_dir, 'the "of the" with NEAR/8 from -which').select("doc_id")


def lemma_search(spark, sf_dir):
    """A lemma and a number, with an exclusion."""
    return _searched(spark, sf_dir, "lemma:thi G04 -shall")


def query_facets(spark, sf_dir):
    """How many documents of each language meet a query, and of all."""
    return _searched(spark, sf_dir, "of NEAR and").groupingSets([["lang"], []], "lang").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("*")).alias("lang"), "n")


def names_in_text(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return corpus.named_in(words, names)


def parallel_orders(spark, sf_dir):
    """Orders as verses, line statuses as works, quantities as texts; orders without lines stay."""
    verses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"))
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ordinal"), F.col("l_linestatus").alias("work")).agg(F.sum("l_quantity").cast("string").alias("text"))
    return corpus.parallel(verses, texts, ["F", "O"]).select("ordinal", F.col("F").alias("text_f"), F.col("O").alias("text_o"))


def book_counts(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.explode(T.words(F.col("text"))).alias("form"))
    return corpus.occurrences(tokens, F.col("form") == "with")


def translation_gate(spark, sf_dir):
    """Documents with a translation by label: shown where the language may be, else held back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ord"), "lang", F.md5("text").alias("text"))
    translations = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ord"), F.concat(F.lit("t"), F.col("quality")).alias("translation"))
    return corpus.working_translation(docs, translations, F.col("lang") != "de").select("document_id", "shown", "blocked")


def rerank_labels(spark, sf_dir):
    """The five longest documents of each language reordered by label, unlabelled ones last."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    hits = docs.select(F.col("lang").alias("query_id"), "doc_id", "quality", rank.alias("rank")).filter("rank <= 20")
    return corpus.rerank(hits, F.col("quality"), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def distinct_work(spark, sf_dir):
    """Word counts worked out once for each distinct text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.fan_back(docs, "text", lambda texts: texts.withColumn("n_words", F.size(T.words(F.col("text"))).cast("long"))).select("doc_id", "n_words")


def corpus_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("t"))
    return corpus.fingerprint(docs, "doc_id", ["doc_id", "t"])


def word_batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("words"))
    return corpus.batches(turns, ["conv_id"], "turn", "words", 60, 3).select("conv_id", "turn", "batch")


def unknown_citations(spark, sf_dir):
    """Markers that an answer cites without the source being at hand, and sources it leaves out."""
    ids = F.concat(F.lit("See ["), F.col("event_id") % 7, F.lit("] and [P"), F.col("event_id") % 5, F.lit("]"))
    cited, available = verify.markers(ids), F.array(*map(F.lit, ("1", "2", "3", "P1", "P2")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(F.array_except(cited, available), " ").alias("unknown"), F.size(F.array_except(available, cited)).cast("long").alias("left_out")
    )


def history(spark, sf_dir):
    """The latest four turns of every conversation, latest first."""
    return windows.first_per(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), "role"], 4).select("conv_id", "turn", "role")


QUERIES = {
    f.__name__: f
    for f in (
        query_search, lemma_search, query_facets, names_in_text, parallel_orders, book_counts, translation_gate, rerank_labels, distinct_work, corpus_fingerprint, word_batches, unknown_citations, history,
    )
}

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_NAMES = ", ".join(f"('{n}')" for n in NAMES)
ORACLE_SQL = {
    "query_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
n AS (SELECT DISTINCT a.doc_id FROM t a JOIN t b USING (doc_id) WHERE a.word = 'with' AND b.word = 'from' AND abs(a.pos - b.pos) - 1 <= 8)
SELECT doc_id FROM d WHERE list_contains(w, 'the') AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'which') AND doc_id IN (SELECT doc_id FROM n)""",
    "lemma_search": f"""
SELECT doc_id, lang FROM documents WHERE list_contains(list_transform({_WORDS}, lambda x: regexp_replace(x, 's$', '')), 'thi') AND regexp_extract(source, '([0-9]+)', 1) = '4' AND NOT list_contains({_WORDS}, 'shall')""",
    "query_facets": f"""
WITH t AS (SELECT doc_id, lang, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM documents),
m AS (SELECT DISTINCT a.doc_id, a.lang FROM t a JOIN t b ON a.doc_id = b.doc_id WHERE a.word = 'of' AND b.word = 'and' AND abs(a.pos - b.pos) - 1 <= 2)
SELECT lang, count(*) AS n FROM m GROUP BY lang UNION ALL SELECT '*', count(*) FROM m""",
    "names_in_text": f"""
WITH n AS (SELECT * FROM (VALUES {_NAMES}) AS t(name)), w AS (SELECT DISTINCT doc_id AS id, unnest({_WORDS}) AS word FROM documents)
SELECT id, word, name FROM w JOIN n ON word = name OR (length(name) >= 4 AND starts_with(word, name) AND length(word) - length(name) BETWEEN 1 AND 3 AND word NOT IN (SELECT name FROM n))""",
    "parallel_orders": """
SELECT o_orderkey AS ordinal, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS VARCHAR) AS text_f, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS VARCHAR) AS text_o
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "book_counts": f"""
WITH t AS (SELECT source AS book, unnest({_WORDS}) AS form FROM documents), c AS (SELECT book, count(*) AS n FROM t WHERE form = 'with' GROUP BY book)
SELECT book, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM c""",
    "translation_gate": """
SELECT doc_id AS document_id, CASE WHEN lang <> 'de' THEN coalesce('t' || quality, md5(text)) ELSE md5(text) END AS shown, quality IS NOT NULL AND lang = 'de' AS blocked FROM documents LEFT JOIN labels USING (doc_id)""",
    "rerank_labels": """
WITH h AS (SELECT lang AS query_id, doc_id, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC NULLS LAST, r) AS rank FROM h WHERE r <= 20)
SELECT query_id, doc_id, rank FROM s WHERE rank <= 5""",
    "distinct_work": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents",
    "corpus_fingerprint": """
WITH r AS (SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"t":"' || md5(text) || '"}') AS h FROM documents),
b AS (SELECT doc_id // 1000 AS b, sha256(string_agg(h, ',' ORDER BY doc_id, h)) AS h, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY b)) AS sha256, CAST(sum(n) AS BIGINT) AS n FROM b""",
    "unknown_citations": """
SELECT event_id, concat_ws(' ', CASE WHEN event_id % 7 NOT IN (1, 2, 3) THEN CAST(event_id % 7 AS VARCHAR) END, CASE WHEN event_id % 5 NOT IN (1, 2) THEN 'P' || event_id % 5 END) AS unknown,
       5 - (event_id % 7 IN (1, 2, 3))::BIGINT - (event_id % 5 IN (1, 2))::BIGINT AS left_out FROM events""",
    "history": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) <= 4",
}
