"""Queries on text structure: references, pages, chunks, streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import references
from glossa.functions import text as T
from glossa.operators import chunks
from glossa.sources import readers
from glossa.streaming import events as streams
from glossa.tables import scratch, table

def _referring(spark, sf_dir):
    """Documents with references before, in and behind their text: verse ranges, chapters, lists, and what only looks like references."""
    i = F.col("doc_id")
    c, v = (i % 20 + 1).cast("string"), (i % 15 + 1).cast("string")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    before = F.when(i % 3 == 0, F.concat(F.lit("See Mt "), c, F.lit(","), v, F.lit("-"), (i % 15 + 4).cast("string"), F.lit(". "))).when(
        i % 3 == 1, F.concat(F.lit("(Rdz "), c, F.lit(") "))).otherwise(F.concat(F.lit("J 3,"), v, F.lit(".30; 4,2n. ")))
    inside = F.concat(F.lit(" [1 Kor 13,"), v, F.lit("nn; Ja mam 3, Ps "), (i % 200 + 1).cast("string"), F.lit("] "))
    behind = F.concat(F.lit(" Ap 9–"), c, F.lit(", Mt 5,9-3 and Łk 1,1–2,"), v)
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(before, F.left(text, half), inside, F.substr(text, half + 1, F.lit(2_000_000_000)), behind).alias("text"))


def extract_refs(spark, sf_dir):
    """All references in the documents, each range once."""
    return references.extract_references(_referring(spark, sf_dir)).select("id", "start", "end")


def refs_lateral(spark, sf_dir):
    """References by book, of a table function in SQL."""
    references.register(spark)
    _referring(spark, sf_dir).createOrReplaceTempView("referring")
    return spark.sql("SELECT CAST(floor(r.start / 1000000) AS BIGINT) AS book, count(*) AS n, count(DISTINCT d.id) AS texts, max(r.`end`) AS last FROM referring d, LATERAL extract_refs(d.text) r GROUP BY 1")


def known_refs(spark, sf_dir):
    """References of the documents, and whether any order, taken as a verse, lies in them."""
    verses = table(spark, sf_dir, "orders").select((F.lit(47_000_000) + F.col("o_orderkey") % 60 * 1_000 + F.col("o_custkey") % 20).cast("long").alias("ordinal"))
    found = references.verified_references(_referring(spark, sf_dir), verses)
    return found.groupBy("start", "end", "known").agg(F.count("*").alias("n"))


def spoken_refs(spark, sf_dir):
    """Conversations that speak of a chapter and a verse, with the canonical form behind."""
    c, v = (F.col("conv_id") % 50 + 1).cast("string"), (F.col("turn") % 30 + 1).cast("string")
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("piąta Księga Mojżeszowa "), c, F.lit(" wers "), v, F.lit(" do "), (F.col("turn") % 30 + 3).cast("string"))).when(
        F.col("turn") % 4 == 1, F.concat(F.lit("pierwszy list do Koryntian "), c, F.lit(" "), v)).when(
        F.col("turn") % 4 == 2, F.concat(F.lit("w Ewangelii Marka rozdział "), c, F.lit(" werset "), v)).otherwise(F.concat(F.lit("miał "), c, F.lit(" lata i "), v, F.lit(" dzieci")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.left("text", F.lit(40)), said, F.lit("i dalej")).alias("text"))
    return turns.select("conv_id", "turn", references.with_spoken(F.col("text")).alias("text"))


def html_to_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.let(readers.html_text(F.col("html")), lambda t: F.struct(F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))).alias("t"))
    return pages.select("page_id", "t.text_md5", "t.n_chars")


def chunking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = chunks.packed(docs, paragraph=r"\n")
    return packed.select("doc_id", "ord", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def document_chunks(spark, sf_dir):
    """Documents of two pages, the second under a heading, in chunks with the references that each has."""
    texts = _referring(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    first = texts.select(F.col("id").alias("document_id"), F.lit(1).alias("page"), F.left("text", half).alias("text"))
    second = texts.select(F.col("id").alias("document_id"), F.lit(2).alias("page"), F.concat(F.lit("# Part two of "), F.col("id").cast("string"), F.lit("\n\n"), F.substr("text", half + 1, F.lit(2_000_000_000))).alias("text"))
    found = chunks.with_references(chunks.document_chunks(first.unionByName(second)))
    return found.select("document_id", "ord", "section", "page_from", "page_to", F.md5("text").alias("text_md5"), F.size("refs").cast("long").alias("n_refs"))


def changed_refs(spark, sf_dir):
    """Chunks whose stored references, those of all but some texts, are not what is read in them now."""
    now = chunks.with_references(_referring(spark, sf_dir).select(F.lit(0).alias("document_id"), F.col("id").alias("ord"), "text"))
    held = now.withColumn("refs", F.when(F.col("ord") % 9 == 4, F.slice("refs", 2, 99)).otherwise(F.col("refs")))
    return chunks.changed_references(held).select(F.col("ord").alias("doc_id"), F.size("refs").cast("long").alias("n_refs"))


def _drained(df, mode):
    """A stream run to the end of its input, its output written where all executors see it."""
    return streams.drained(df, mode, scratch(df.sparkSession, "stream"))


def _stream(spark, sf_dir, name):
    """A table as a stream of its files, be it one file or a folder of them: a pattern, as a stream takes no path of one file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def _event_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly_requests(spark, sf_dir):
    """The hourly counts of the event stream, read to its end; equals the batch grouping."""
    counts = _drained(streams.hourly_requests(_event_stream(spark, sf_dir)), "complete")
    return counts.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "user_id", "n")


def stream_sliding_counts(spark, sf_dir):
    counts = _drained(streams.sliding_counts(_event_stream(spark, sf_dir)), "complete")
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    """Sessions of users, by gaps of six hours, of the event stream read to its end."""
    counts = _drained(streams.session_counts(_event_stream(spark, sf_dir)), "complete")
    return counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def stream_new_entries(spark, sf_dir):
    """Users' first event of each kind, as entries of a manifest that come again and again."""
    manifest = _event_stream(spark, sf_dir).select(F.col("ts").alias("seen_at"), F.col("event_type").alias("source"), F.col("user_id").alias("source_id"))
    return _drained(streams.new_entries(manifest, "60 days"), "append").select("source", "source_id")


def stream_status(spark, sf_dir):
    """Results of revisions that come in any order, those of old ones marked stale."""
    results = _event_stream(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 7 % 11).alias("revision"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return _drained(streams.current_status(results, None), "append").groupBy("doc_id", "stale").agg(F.count("*").alias("n"), F.max("revision").alias("newest"))


def stream_without_tag(spark, sf_dir):
    """Turns of conversations as deltas that cut a tag anywhere; what stands in it is gone at the end."""
    turns = _stream(spark, sf_dir, "conversations")
    payload = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" <thi"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("nk>"), "text", F.lit("</th"))).otherwise(F.concat(F.lit("ink> "), "text"))
    deltas = turns.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), payload.alias("payload"), (F.col("turn") == 7).alias("last"))
    out = _drained(streams.without_tag(deltas, forget=None), "append")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("stream_id").agg(F.md5(text).alias("text_md5"), F.count("*").alias("deltas"))


QUERIES = {
    f.__name__: f
    for f in (extract_refs, refs_lateral, known_refs, spoken_refs, document_chunks, changed_refs, html_to_text, chunking, stream_hourly_requests, stream_sliding_counts, stream_sessions, stream_new_entries, stream_status, stream_without_tag)
}

#: What stands in the documents by ``_referring``; a text's own words hold no reference of these books.
_REFS = """d AS (SELECT doc_id AS id, doc_id % 3 AS k, doc_id % 20 + 1 AS c, doc_id % 15 AS m, doc_id % 200 + 1 AS p FROM documents),
r AS (SELECT id, 47000000 + c * 1000 + m + 1 AS start, 47000000 + c * 1000 + m + 4 AS "end" FROM d WHERE k = 0
UNION ALL SELECT id, 1000000 + c * 1000, 1000000 + c * 1000 + 999 FROM d WHERE k = 1
UNION ALL SELECT id, 50003000 + m + 1, 50003000 + m + 1 FROM d WHERE k = 2 UNION ALL SELECT id, 50003030, 50003030 FROM d WHERE k = 2 UNION ALL SELECT id, 50004002, 50004003 FROM d WHERE k = 2
UNION ALL SELECT id, 53013000 + m + 1, 53013999 FROM d
UNION ALL SELECT id, 23000000 + p * 1000, 23000000 + p * 1000 + 999 FROM d WHERE p <= 150
UNION ALL SELECT id, 73009000, 73000000 + c * 1000 + 999 FROM d WHERE c >= 9
UNION ALL SELECT id, 49001001, 49002000 + m + 1 FROM d)"""

ORACLE_SQL = {
    "extract_refs": f'WITH {_REFS} SELECT DISTINCT id, start, "end" FROM r',
    "refs_lateral": f'WITH {_REFS}, o AS (SELECT DISTINCT id, start, "end" FROM r) SELECT start // 1000000 AS book, count(*) AS n, count(DISTINCT id) AS texts, max("end") AS last FROM o GROUP BY 1',
    "known_refs": f"""
WITH {_REFS}, v AS (SELECT DISTINCT 47000000 + o_orderkey % 60 * 1000 + o_custkey % 20 AS ordinal FROM orders), o AS (SELECT DISTINCT id, start, "end" FROM r)
SELECT start, "end", EXISTS (SELECT 1 FROM v WHERE ordinal BETWEEN start AND "end") AS known, count(*) AS n FROM o GROUP BY 1, 2""",
    "changed_refs": f'WITH {_REFS}, o AS (SELECT DISTINCT id, start, "end" FROM r) SELECT id AS doc_id, count(*) AS n_refs FROM o WHERE id % 9 = 4 GROUP BY 1',
    "spoken_refs": """
WITH t AS (SELECT conv_id, turn, left(text, 40) AS text, conv_id % 50 + 1 AS c, turn % 30 + 1 AS v, turn % 30 + 3 AS w FROM conversations)
SELECT conv_id, turn, concat_ws(' ', text, CASE turn % 4
  WHEN 0 THEN format('piąta Księga Mojżeszowa {} wers {} do {} (Pwt {},{}-{})', c, v, w, c, v, w)
  WHEN 1 THEN format('pierwszy list do Koryntian {} {} (1 Kor {},{})', c, v, c, v)
  WHEN 2 THEN format('w Ewangelii Marka rozdział {} werset {} (Mk {},{})', c, v, c, v)
  ELSE format('miał {} lata i {} dzieci', c, v) END, 'i dalej') AS text FROM t""",
    "stream_hourly_requests": "SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding_counts": """
WITH e AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2000-01-01') AS b FROM events)
SELECT start, event_type, count(*) AS n FROM (SELECT b AS start, event_type FROM e UNION ALL SELECT b - INTERVAL '3 hours', event_type FROM e) GROUP BY 1, 2""",
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN gap > INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_new_entries": "SELECT DISTINCT event_type AS source, user_id AS source_id FROM events",
    "stream_status": """
WITH r AS (SELECT user_id AS doc_id, event_id * 7 % 11 AS revision, event_id FROM events),
m AS (SELECT *, coalesce(revision < max(revision) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM r)
SELECT doc_id, stale, count(*) AS n, max(revision) AS newest FROM m GROUP BY 1, 2""",
    "stream_without_tag": r"""
WITH d AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' <thi' WHEN 1 THEN 'nk>' || text || '</th' ELSE 'ink> ' || text END AS p FROM conversations),
w AS (SELECT conv_id, string_agg(p, '' ORDER BY turn) AS t, count(*) AS deltas, max(turn) = 7 AS ended FROM d GROUP BY conv_id),
c AS (SELECT *, regexp_replace(t, '(?s)<think>.*?(?:</think>|\z)', '', 'g') AS kept FROM w)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, md5(CASE WHEN ended THEN kept ELSE regexp_replace(kept, ' <thi\z', ' ') END) AS text_md5, deltas FROM c""",
}
