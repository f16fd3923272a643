"""Queries of the word index, retrieval in channels, and a library's sources over the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import bitmaps, index, loads, search
from glossa.plans import retrieval
from glossa.sources import library
from glossa.tables import scratch, table, written


def bm25_index_topk(spark, sf_dir):
    """The same ranking as ``bm25_topk``, of an index written once."""
    path = scratch(spark, "words")
    index.index_words(table(spark, sf_dir, "documents"), path)
    scored = index.bm25_indexed(spark, path, ["with", "from", "shall", "not"])
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


def _changed_index(spark, sf_dir):
    """An index of the documents after changes: some come in other words, some go, one run is merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = index.Words(spark, scratch(spark, "words"))
    held.add(docs.filter("doc_id % 5 <> 1"))
    held.replace(docs.filter("doc_id % 7 = 3").select("doc_id", F.concat(F.lit("the shall "), F.coalesce("text", F.lit(""))).alias("text")))
    held.delete(docs.filter("doc_id % 11 = 4").select("doc_id"))
    held.compact()
    held.add(docs.filter("doc_id % 5 = 1 AND doc_id % 3 = 0"))
    return held


def bm25_index_updates(spark, sf_dir):
    """Ranking by an index that was changed: equal to that by a new index of what it holds."""
    scored = _changed_index(spark, sf_dir).bm25(["with", "from", "shall", "not"])
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


def index_missing(spark, sf_dir):
    """Documents that the index holds in other words, or not at all, by numbers of words."""
    stored = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("stored"))
    return _changed_index(spark, sf_dir).missing(stored)


def bm25_filtered(spark, sf_dir):
    """The best of the index among documents of two languages or one owner, of ten sources, with an interval that overlaps one of two."""
    docs = table(spark, sf_dir, "documents")
    held = index.Words(spark, scratch(spark, "words"))
    held.add(docs)
    bits = written(bitmaps.attribute_bits(docs.withColumn("owner", F.col("doc_id") % 50), ["lang", "source", "owner"]), "bits")
    intervals = docs.select("doc_id", F.col("n_chars").alias("start"), (F.col("n_chars") + F.col("doc_id") % 300).alias("end"))
    let = bitmaps.allowed(bits, [{"lang": ["en", "fr"], "owner": ["7"]}, {"source": [f"src{i}" for i in range(10)]}], intervals, [(300, 900), (1500, 4000)])
    scored = held.bm25(["with", "from", "shall", "not"], written(let, "allowed"))
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


def knn_bitmap(spark, sf_dir):
    """The vectors most like vector 3 among documents of English and odd sources, filtered before any is compared."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    bits = written(bitmaps.attribute_bits(docs, ["lang", "source"]), "bits")
    let = written(bitmaps.allowed(bits, [{"lang": ["en"]}, {"source": [f"src{i}" for i in range(1, 20, 2)]}]), "allowed")
    query = vectors.filter("vec_id = 3").select(F.col("embedding").alias("query"))
    return search.nearest(bitmaps.keep(vectors, let, "vec_id"), query, 10).select("vec_id", "similarity")


def replaced_works(spark, sf_dir):
    """Sources as works, loaded, some replaced by fewer and other texts, one taken away: each version as its readers see it."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    rows = docs.select(F.col("source").alias("work"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    store = loads.Store(spark, scratch(spark, "store"))
    first = store.replace(rows)
    held = store.read(first)
    second = store.replace(rows.filter("work IN ('src1', 'src12') AND ordinal % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text")))
    third = store.remove(["src3"])
    seen = [held.withColumn("version", F.lit(1)), store.read(second).withColumn("version", F.lit(2)), store.read(third).withColumn("version", F.lit(3))]
    every = reduce(DataFrame.unionByName, seen)
    return every.groupBy("version", "work").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.min(F.md5("text")).alias("least_md5"))


def batched_keys(spark, sf_dir):
    """Orders in batches of 1,000 by date and key, as they are read in turn."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    found = loads.in_batches(orders, ["day", "o_orderkey"], 1000)
    return found.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max(F.date_format("day", "yyyy-MM-dd")).alias("last_day"))


def retrieve_channels(spark, sf_dir):
    """Three channels, words and two vectors, of open documents, fused and ordered anew by an outside score."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    words = docs.select(F.col("doc_id").alias("id"), T.word_prefix_count(F.col("text"), "the").alias("score"))
    channels = [words]
    for of in (0, 7):
        query = vectors.filter(F.col("vec_id") == of).select(F.col("embedding").alias("query"))
        # one vector, the query's
        channels.append(vectors.join(F.broadcast(query)).select(F.col("vec_id").alias("id"), F.round(search.dot(F.col("embedding"), F.col("query")), 6).alias("score")))
    now = docs.select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    quality = F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 101).cast("double"))
    found = index.retrieve(channels, now, F.col("lang") != "de", 8, 40, quality)
    return found.select("id", "source", "fused", F.col("rank").cast("long").alias("rank"))


def text_excerpts(spark, sf_dir):
    """From the first "the" in a text to the first "and" behind it; null where there is none."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", library.excerpt(F.col("text"), " the ", " and ", strict=False).alias("part"))


def repaired_numbers(spark, sf_dir):
    """Lines of orders as verses of chapters, every fourth without its number."""
    verse = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 4 > 0, F.col("l_linenumber"))
    text = F.concat("l_returnflag", F.lit(" <b>"), "l_linestatus", F.lit("</b>  "), (F.col("l_suppkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("book"), F.col("l_orderkey").alias("chapter"), verse.alias("verse"), text.alias("text"))
    return library.numbered(rows).select("chapter", "verse", "text", "note")


def section_works(spark, sf_dir):
    """Parts as passages: works by brand, sections by type and colour."""
    words = F.split("p_name", " ")
    section = F.concat_ws(" / ", F.initcap("p_type"), F.concat(words[0], F.lit(".")), words[1])
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("work"), F.col("p_brand").alias("title"), F.lit("").alias("author"), section.alias("section"))
    return library.selected_works(parts, "^(small|red)|#1$").select("p_partkey", "path", "title", "author", "section")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_index_topk, bm25_index_updates, index_missing, bm25_filtered, knn_bitmap, replaced_works, batched_keys, retrieve_channels, text_excerpts, repaired_numbers, section_works,
    )
}

_VECTOR = "round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {of})), 6)"

#: What the changed index holds, and BM25 of four words over the view ``held`` (doc_id, text).
_CHANGED = """held AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 AND doc_id % 11 <> 4 THEN 'the shall ' || coalesce(text, '') ELSE text END AS text FROM documents
         WHERE CASE WHEN doc_id % 11 = 4 THEN doc_id % 5 = 1 AND doc_id % 3 = 0 ELSE doc_id % 7 = 3 OR doc_id % 5 <> 1 OR doc_id % 3 = 0 END)"""
_BM25 = """
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS words FROM held),
t AS (SELECT count(*) AS n, avg(len(words)) AS avg FROM w),
c AS (SELECT doc_id, len(words) AS len, term, len(list_filter(words, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['with', 'from', 'shall', 'not']) AS term)),
f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY term),
scored AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS bm25 FROM c JOIN f USING (term), t WHERE tf > 0 GROUP BY doc_id)"""

ORACLE_SQL = {
    "bm25_index_updates": f"WITH {_CHANGED}, {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY bm25 DESC, doc_id LIMIT 20",
    "index_missing": f"""
WITH {_CHANGED}, s AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS BIGINT) AS stored FROM documents),
i AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS BIGINT) AS indexed FROM held)
SELECT doc_id, stored, coalesce(indexed, 0) AS indexed FROM s LEFT JOIN i USING (doc_id) WHERE stored IS DISTINCT FROM indexed""",
    "bm25_filtered": f"""
WITH held AS (SELECT doc_id, text FROM documents), {_BM25}
SELECT doc_id, round(bm25, 6) AS bm25 FROM scored JOIN documents d USING (doc_id)
WHERE (lang IN ('en', 'fr') OR doc_id % 50 = 7) AND source IN ({', '.join(f"'src{i}'" for i in range(10))})
  AND ((n_chars <= 900 AND n_chars + doc_id % 300 >= 300) OR (n_chars <= 4000 AND n_chars + doc_id % 300 >= 1500))
ORDER BY bm25 DESC, doc_id LIMIT 20""",
    "knn_bitmap": f"""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS similarity
FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND source IN ({', '.join(f"'src{i}'" for i in range(1, 20, 2))}) ORDER BY similarity DESC, vec_id LIMIT 10""",
    "replaced_works": """
WITH d AS (SELECT source AS work, doc_id, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL),
second AS (SELECT * FROM d WHERE work NOT IN ('src1', 'src12') UNION ALL SELECT work, doc_id, 'new ' || text FROM d WHERE work IN ('src1', 'src12') AND doc_id % 3 = 0),
v AS (SELECT 1 AS version, * FROM d UNION ALL SELECT 2, * FROM second UNION ALL SELECT 3, * FROM second WHERE work <> 'src3')
SELECT version, work, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(md5(text)) AS least_md5 FROM v GROUP BY version, work""",
    "batched_keys": """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, (row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1) // 1000 AS batch FROM orders)
SELECT batch, count(*) AS n, min(o_orderkey) AS least, max(strftime(day, '%Y-%m-%d')) AS last_day FROM o GROUP BY batch""",
    "bm25_index_topk": retrieval.ORACLE_SQL["bm25_topk"],
    "retrieve_channels": f"""
WITH now AS (SELECT doc_id AS id, source, n_chars, CASE WHEN n_chars % 3 > 0 THEN n_chars % 101 END AS q FROM documents WHERE lang <> 'de'),
c AS (SELECT 0 AS l, doc_id AS id, {retrieval._prefix('the')} AS score FROM documents
      UNION ALL SELECT 1, vec_id, {_VECTOR.format(of=0)} FROM embeddings UNION ALL SELECT 2, vec_id, {_VECTOR.format(of=7)} FROM embeddings),
r AS (SELECT id, row_number() OVER (PARTITION BY l ORDER BY score DESC, id) AS rank FROM c SEMI JOIN now USING (id)),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused FROM r WHERE rank <= 40 GROUP BY id),
b AS (SELECT id, fused, row_number() OVER (ORDER BY fused DESC, id) AS place FROM f QUALIFY place <= 40)
SELECT id, source, fused, row_number() OVER (ORDER BY q DESC NULLS LAST, place) AS rank FROM b JOIN now USING (id) QUALIFY rank <= 8""",
    "text_excerpts": r"""
SELECT doc_id, nullif(trim(regexp_extract(text, '(?s)the.*?and'), E' \t\n\r\f'), '') AS part FROM documents""",
    "repaired_numbers": """
WITH v AS (SELECT l_orderkey AS chapter, CASE WHEN (l_orderkey + l_linenumber) % 4 > 0 THEN l_linenumber END AS verse,
       l_returnflag || ' <b>' || l_linestatus || '</b>  ' || l_suppkey % 5 AS text FROM lineitem),
own AS (SELECT * FROM v WHERE verse IS NOT NULL),
g AS (SELECT chapter, list_filter(range(1, max(verse) + 1), lambda x: NOT list_contains(list(verse), x)) AS gaps FROM own GROUP BY chapter)
SELECT chapter, verse, text, NULL AS note FROM own
UNION ALL SELECT chapter, gaps[1], text, 'gap' FROM v JOIN g USING (chapter) WHERE verse IS NULL AND len(gaps) = 1
  AND NOT EXISTS (SELECT 1 FROM own WHERE own.chapter = v.chapter AND own.text = v.text)""",
    "section_works": """
WITH p AS (SELECT p_partkey, p_brand, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c FROM part)
SELECT p_partkey, NULL AS path, p_brand AS title, '' AS author, a || ' / ' || b || '. / ' || c AS section FROM p WHERE p_brand LIKE '%#1'
UNION ALL SELECT p_partkey, a, a, p_brand, b || '. / ' || c FROM p WHERE p_brand NOT LIKE '%#1' AND a LIKE 'Small%'
UNION ALL SELECT p_partkey, a || ' / ' || b || '.', b, p_brand, c FROM p WHERE p_brand NOT LIKE '%#1' AND a NOT LIKE 'Small%' AND (b LIKE 'red%' OR b LIKE 'small%')""",
}
