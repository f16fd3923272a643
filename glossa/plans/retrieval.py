"""Search queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import query
from glossa.functions import text as T
from glossa.operators import search, windows
from glossa.tables import table

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


def hybrid_topk(spark, sf_dir):
    """Lexical and vector rankings of the documents that have a vector, fused."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    both = docs.join(vectors, docs.doc_id == vectors.vec_id).join(F.broadcast(query.limit(1)))
    scored = both.select(
        F.col("doc_id").alias("id"), T.word_prefix_count(F.col("text"), "the").alias("lexical"), F.round(search.dot(F.col("embedding"), F.col("query")), 6).alias("vector")
    )
    lists = [
        windows.ranked(scored, [F.desc(column), "id"], 50).select("id", F.lit(i).alias("list_id"), "rank") for i, column in enumerate(("lexical", "vector"))
    ]
    fused = windows.fuse(lists[0].unionByName(lists[1])).select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score"))
    return windows.ranked(fused, [F.desc("score"), "doc_id"], 8).withColumn("rank", F.col("rank").cast("long"))


def lexical_fallback_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    score = sum((T.word_prefix_count(F.col("text"), p) for p in ("the", "and")), F.lit(0)).cast("long")
    return docs.select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


def bm25_topk(spark, sf_dir):
    scored = search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), ["with", "from", "shall", "not"])
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


def _knn(vectors, spark, sf_dir, k):
    query = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("query"))
    return search.nearest(vectors, query, k).select("vec_id", "similarity")


def knn_topk(spark, sf_dir):
    return _knn(table(spark, sf_dir, "embeddings"), spark, sf_dir, 10)


def knn_filtered(spark, sf_dir):
    return _knn(table(spark, sf_dir, "embeddings").filter("label = 3"), spark, sf_dir, 10)


def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", T.word_prefix_count(F.col("text"), "th").alias("hits"))
    lists = [windows.ranked(docs, [F.desc(c), "id"], 100).select("id", F.lit(i).alias("list_id"), "rank") for i, c in enumerate(("n_chars", "hits"))]
    fused = windows.fuse(lists[0].unionByName(lists[1]))
    return fused.select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score"))


def diversify_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.word_prefix_count(F.col("text"), "the").cast("long").alias("score"))
    capped = windows.first_per(docs, ["source"], [F.desc("score"), "doc_id"], 3)
    return capped.orderBy(F.desc("score"), "doc_id").limit(20)


def diversify_greedy(spark, sf_dir):
    """Greedy diversification of each language's best hits, a source being a document and the length its place."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("document"), (F.col("n_chars") % 40).alias("ord"), "doc_id", T.word_prefix_count(F.col("text"), "th").alias("score"))
    hits = windows.first_per(docs, ["lang"], [F.desc("score"), "doc_id"], 60)
    from pyspark.sql import Window

    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")))
    return windows.diversify(hits, ["lang"], 2, 10).select("lang", "place", "doc_id", "document", "ord")


def register_preference(spark, sf_dir):
    weight = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 1.5).when(F.col("lang") == "fr", 0.8).otherwise(1.2)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.round(weight * F.col("n_chars"), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


def replace_last_channel(spark, sf_dir):
    """The best eight documents, the last two of which make room for the best documents not toxic by label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    clean = docs.join(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"), "doc_id", "left_semi")
    order = [F.desc("n_chars"), "doc_id"]
    base = windows.ranked(docs, order, 8)
    extra = clean.orderBy(*order).limit(40).join(base.select("doc_id"), "doc_id", "left_anti").orderBy(*order)
    return windows.replace_last(base, extra, order, 8, 2).select("doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def channel_fill(spark, sf_dir):
    """Ten documents: the longest German ones first, then others in order of length."""
    docs = table(spark, sf_dir, "documents").withColumn("channel", F.when((F.col("lang") == "de") & (F.col("n_chars") > 5000), 0).otherwise(1))
    return windows.ranked(docs.select("doc_id", "channel", "n_chars"), ["channel", F.desc("n_chars"), "doc_id"], 10).select("doc_id", "channel", F.col("rank").cast("long").alias("rank"))


def phrase_search(spark, sf_dir):
    return search.with_phrase(table(spark, sf_dir, "documents"), ["of", "the"])


def near_search(spark, sf_dir):
    return search.with_near(table(spark, sf_dir, "documents"), "with", "from", 3).select("doc_id", F.col("distance").cast("long").alias("distance"))


def bool_not(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.words(F.col("text")).alias("w"))
    return docs.filter(query.condition(query.parse('the with "of the" -from'), F.col("w"))).select("doc_id", "lang")


def term_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.array_contains(T.words(F.col("text")), "with"))
    return windows.first_per(docs.select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"])


def paged_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").contains("with"))
    return docs.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").offset(20).limit(15)


def priority_search(spark, sf_dir):
    """Parts named exactly so first, then those that contain the name."""
    name = F.lower("p_name")
    rank = F.when(name == "small ring", 0).when(name.startswith("small"), 1).otherwise(2)
    return table(spark, sf_dir, "part").filter(name.contains("ring")).select("p_partkey", rank.alias("priority"), "p_name").orderBy("priority", "p_name", "p_partkey").limit(30)


def snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").contains("with"))
    return docs.select("doc_id", T.snippet(F.col("text"), "with", 80).alias("snippet"))


def highlight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").contains("with"))
    return docs.select("doc_id", F.md5(T.highlight(F.col("text"), "with")).alias("marked_md5"))


def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", T.estimate_tokens(F.col("n_chars")).alias("tokens"))
    return windows.within_budget(docs, ["source"], [F.desc("tokens"), "doc_id"], F.col("tokens"), 20_000)


def recall_mrr(spark, sf_dir):
    """Recall at 20, reciprocal rank and first hit by language, good documents being relevant to a lexical ranking."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.word_prefix_count(F.col("text"), "th").alias("score"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    by = labelled.withColumn("rank", rank).groupBy("lang").agg(
        F.count_if((F.col("quality") == 1) & (F.col("rank") <= 20)).alias("found"),
        F.count_if(F.col("quality") == 1).alias("relevant"),
        F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first"),
    )
    return by.select(
        "lang",
        F.round(F.try_divide(F.col("found").cast("double"), F.col("relevant")), 6).alias("recall_20"),
        F.round(1.0 / F.col("first"), 6).alias("mrr"),
        F.coalesce(F.col("first") == 1, F.lit(False)).alias("hit_1"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_topk, lexical_fallback_topk, bm25_topk, knn_topk, knn_filtered, rrf_fusion, diversify_per_source, diversify_greedy, register_preference, replace_last_channel,
        channel_fill, phrase_search, near_search, bool_not, term_mentions, paged_search, priority_search, snippet, highlight, context_budget, recall_mrr,
    )
}


def _prefix(p: str) -> str:
    return f"len(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z]){p}[a-z]*'))"


_KNN = """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings {where} ORDER BY similarity DESC, vec_id LIMIT 10"""

ORACLE_SQL = {
    "hybrid_topk": f"""
WITH s AS (SELECT doc_id AS id, {_prefix('the')} AS lexical,
       round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS vector
       FROM documents JOIN embeddings ON doc_id = vec_id),
r AS (SELECT id, row_number() OVER (ORDER BY lexical DESC, id) AS rank FROM s UNION ALL SELECT id, row_number() OVER (ORDER BY vector DESC, id) FROM s),
f AS (SELECT id AS doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM r WHERE rank <= 50 GROUP BY id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 8""",
    "lexical_fallback_topk": f"SELECT * FROM (SELECT doc_id, CAST({_prefix('the')} + {_prefix('and')} AS BIGINT) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_topk": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT avg(len(w)) AS avgdl, count(*) AS n FROM d),
t AS (SELECT unnest(['with', 'from', 'shall', 'not']) AS term),
f AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS dl FROM d, t),
k AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
FROM f JOIN k USING (term), s WHERE tf > 0 GROUP BY doc_id ORDER BY bm25 DESC, doc_id LIMIT 20""",
    "knn_topk": _KNN.format(where=""),
    "knn_filtered": _KNN.format(where="WHERE label = 3"),
    "rrf_fusion": f"""
WITH s AS (SELECT doc_id, n_chars, {_prefix('th')} AS hits FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM s UNION ALL SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) FROM s)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM r WHERE rank <= 100 GROUP BY doc_id""",
    "diversify_per_source": f"""
WITH s AS (SELECT doc_id, source, CAST({_prefix('the')} AS BIGINT) AS score FROM documents)
SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 3 ORDER BY score DESC, doc_id LIMIT 20""",
    "register_preference": """
SELECT doc_id, lang, round(CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 1.5::DOUBLE WHEN 'fr' THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END * n_chars, 4) AS score
FROM documents ORDER BY score DESC, doc_id LIMIT 25""",
    "replace_last_channel": """
WITH b AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 8),
e AS (SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY n_chars DESC, doc_id LIMIT 40),
x AS (SELECT * FROM e WHERE doc_id NOT IN (SELECT doc_id FROM b) ORDER BY n_chars DESC, doc_id LIMIT 2)
SELECT doc_id, n_chars, rank FROM b WHERE rank <= 8 - (SELECT count(*) FROM x)
UNION ALL SELECT doc_id, n_chars, 8 - (SELECT count(*) FROM x) + row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM x""",
    "channel_fill": """
SELECT doc_id, channel, row_number() OVER (ORDER BY channel, n_chars DESC, doc_id) AS rank
FROM (SELECT doc_id, n_chars, CASE WHEN lang = 'de' AND n_chars > 5000 THEN 0 ELSE 1 END AS channel FROM documents) ORDER BY rank LIMIT 10""",
    "phrase_search": f"""
WITH t AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents)
SELECT a.doc_id, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the' GROUP BY a.doc_id""",
    "near_search": f"""
WITH t AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents)
SELECT a.doc_id, CAST(min(abs(a.pos - b.pos) - 1) AS BIGINT) AS distance FROM t a JOIN t b ON a.doc_id = b.doc_id
WHERE a.word = 'with' AND b.word = 'from' GROUP BY a.doc_id HAVING min(abs(a.pos - b.pos) - 1) <= 3""",
    "bool_not": f"""
WITH d AS (SELECT doc_id, lang, {WORDS} AS w FROM documents)
SELECT doc_id, lang FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'with') AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'from')""",
    "term_mentions": f"""
SELECT source, doc_id, n_chars FROM documents WHERE list_contains({WORDS}, 'with') QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1""",
    "paged_search": "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'with') ORDER BY n_chars, doc_id LIMIT 15 OFFSET 20",
    "priority_search": """
SELECT p_partkey, CASE WHEN lower(p_name) = 'small ring' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1 ELSE 2 END AS priority, p_name
FROM part WHERE contains(lower(p_name), 'ring') ORDER BY priority, p_name, p_partkey LIMIT 30""",
    "snippet": """
WITH d AS (SELECT doc_id, text, strpos(lower(text), 'with') AS p FROM documents WHERE contains(lower(text), 'with')), s AS (SELECT *, greatest(p - 40, 1) AS b FROM d)
SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, 80) || CASE WHEN b + 79 < length(text) THEN '…' ELSE '' END AS snippet FROM s""",
    "highlight": """
SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(with)', '<mark>\\1</mark>', 'gi')) AS marked_md5
FROM documents WHERE contains(lower(text), 'with')""",
    "context_budget": """
WITH d AS (SELECT source, doc_id, CAST(floor(n_chars / 2.8::DOUBLE) + 1 AS BIGINT) AS tokens FROM documents),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY tokens DESC, doc_id) AS spent, row_number() OVER (PARTITION BY source ORDER BY tokens DESC, doc_id) AS i FROM d)
SELECT source, doc_id, tokens FROM w WHERE spent <= 20000 OR i = 1""",
    "recall_mrr": f"""
WITH d AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang ORDER BY {_prefix('th')} DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id))
SELECT lang, round(count(*) FILTER (WHERE quality = 1 AND rank <= 20) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 6) AS recall_20,
       round(1.0::DOUBLE / min(rank) FILTER (WHERE quality = 1), 6) AS mrr, coalesce(min(rank) FILTER (WHERE quality = 1) = 1, false) AS hit_1 FROM d GROUP BY lang""",
}
