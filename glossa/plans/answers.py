"""Queries on what answers are made of: context under a budget, verses of questions, outside work, pages and old fonts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import visual
from glossa.operators import context, groups, outside
from glossa.plans import texts
from glossa.tables import scratch, table

#: Tokens of a context.
BUDGET = 900


def _items(spark, sf_dir):
    """Turns of conversations as rows of four lists, in order of their turns."""
    name = F.element_at(F.array(*map(F.lit, context.LISTS)), (F.col("turn") % 4 + 1).cast("int"))
    cost = F.element_at(F.create_map(*[F.lit(x) for pair in context.LISTS.items() for x in pair]), name)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), name.alias("list"), F.col("turn").alias("rank"), "role", "text", cost.alias("cost"))
    return turns.withColumn("size", F.length("text") + F.length("role") + F.col("cost"))


def _base(items):
    return items.select("query_id").distinct().withColumn("chars", F.lit(context.HEADINGS) + F.col("query_id") % 400)


def context_lists(spark, sf_dir):
    """How many rows of each list stay within the budget of a context, and its estimate before and after."""
    items = _items(spark, sf_dir)
    return context.budget_report(context.fit_lists(items, _base(items), BUDGET), _base(items))


def context_messages(spark, sf_dir):
    """The message of each context: its question, numbered blocks of what stays, and the legend of a list of references."""
    items = _items(spark, sf_dir)
    kept = context.fit_lists(items, _base(items), BUDGET).filter("kept").select("query_id", "list", "rank", F.col("role").alias("head"), "text")
    questions = items.select("query_id").distinct().withColumn("question", F.concat(F.lit("Question "), F.col("query_id")))
    refs = F.array(F.lit("Mt 5,3"), F.concat(F.lit("Ps "), F.col("query_id") % 150 + 1), F.lit("Mt 7"), F.when(F.col("query_id") % 2 == 0, F.lit("1 Kor 2")), F.lit("no reference"))
    legends = questions.select("query_id", context.legend(F.filter(refs, lambda r: r.isNotNull()), {47: "Matthew", 23: "Psalms", 53: "First Corinthians"}).alias("legend"))
    titles = {"chunks": "SOURCES", "related": "RELATED", "ane": "COMPARED", "patristics": "TRADITION"}
    return context.messages(questions, kept, titles, legends).select("query_id", F.md5("message").alias("message_md5"))


def question_verses(spark, sf_dir):
    """Verses that documents refer to, in three works in their order, at most twelve a document."""
    ordinal = F.lit(47_000_000) + F.col("l_orderkey") % 30 * 1_000 + F.col("l_partkey") % 25
    verses = table(spark, sf_dir, "lineitem").select(ordinal.alias("ordinal"), F.col("l_returnflag").alias("work"), F.col("l_suppkey").cast("string").alias("t")).groupBy("ordinal", "work").agg(F.min("t").alias("text"))
    questions = texts._referring(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    return context.question_verses(questions, verses, ["R", "A", "N"], limit=12).select("query_id", F.col("ord").cast("long").alias("ord"), "ordinal", "work", "text")


def _told(piece: str) -> str:
    """Stands for a service that works on one piece."""
    if "***" in piece:
        raise ValueError("refused")
    return f"{len(piece)}:{piece}"


def reassembled(spark, sf_dir):
    """Lines that went out one by one and came back, in order; a document one of whose lines failed is not whole."""
    path = scratch(spark, "outside")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "piece"))
    rows = lines.select(F.concat_ws("-", "doc_id", "i").alias("id"), F.col("piece").alias("payload"))
    outside.work_off(rows, _told, path, tries=1)
    back = outside.finished(spark, path).select("id", "result").join(lines.select(F.concat_ws("-", "doc_id", "i").alias("id"), "doc_id", "i"), "id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "result"))), lambda x: x["result"])  # a document's lines
    whole = back.groupBy("doc_id").agg(F.count_if(F.col("result").isNull()).alias("failed"), ordered.alias("pieces"))
    return whole.select("doc_id", "failed", F.when(F.col("failed") == 0, F.md5(F.array_join("pieces", "\n"))).alias("text_md5"))


def headers_stripped(spark, sf_dir):
    """Sources as documents, their texts as pages with a running header above and a page number below."""
    page = F.concat_ws("\n", F.concat(F.lit("Header of "), "source", F.lit("  page "), F.col("doc_id").cast("string")), "text", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")))
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), page.alias("text"))
    return groups.without_headers(pages).select("document_id", "page", F.md5("text").alias("text_md5"))


def visual_hebrew(spark, sf_dir):
    """Names of parts as keys of an old font, decoded: how many there are, by their first word."""
    keys = F.regexp_replace(F.translate("p_name", "aeiou", "abgdh"), "[^abgdhklmnrstp ]", "")
    decoded = visual.decode_visual(keys)
    return table(spark, sf_dir, "part").groupBy(F.substring_index(decoded, " ", 1).alias("first")).agg(F.count("*").alias("n"), F.max(F.length(decoded)).cast("long").alias("longest"))


QUERIES = {f.__name__: f for f in (context_lists, context_messages, question_verses, reassembled, headers_stripped, visual_hebrew)}
_ITEMS = f"""
i AS (SELECT conv_id AS query_id, turn AS rank, turn % 4 AS place, role, text,
             length(text) + length(role) + [{', '.join(str(x) for x in context.LISTS.values())}][CAST(turn % 4 + 1 AS INT)] AS size FROM conversations),
f AS (SELECT *, floor(({context.HEADINGS} + query_id % 400 + sum(size) OVER w) / 2.8) + 1 <= {BUDGET} OR (place = 0 AND row_number() OVER w = 1) AS kept FROM i WINDOW w AS (PARTITION BY query_id ORDER BY place, rank))"""


def _blocks(place: int, sign: str, gap: str, between: str) -> str:
    head = f"'[{sign}' || n || '] ' || " if sign is not None else ""
    return f"string_agg({head}role || {gap} || text, {between} ORDER BY n) FILTER (WHERE place = {place}) AS b{place}"


ORACLE_SQL = {
    "context_lists": f"""
WITH {_ITEMS} SELECT query_id, CAST(floor(({context.HEADINGS} + query_id % 400 + sum(size)) / 2.8) + 1 AS BIGINT) AS before,
  CAST(floor(({context.HEADINGS} + query_id % 400 + coalesce(sum(size) FILTER (WHERE kept), 0)) / 2.8) + 1 AS BIGINT) AS after,
  {', '.join(f"count(*) FILTER (WHERE place = {p} AND NOT kept) AS dropped_{name}" for p, name in enumerate(context.LISTS))}
FROM f GROUP BY query_id""",
    "context_messages": f"""
WITH {_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY rank) AS n FROM f WHERE kept),
b AS (SELECT query_id, {_blocks(0, '', 'chr(10)', 'chr(10) || chr(10)')}, {_blocks(1, 'P', "': '", 'chr(10) || chr(10)')}, {_blocks(2, 'A', "': '", 'chr(10) || chr(10)')}, {_blocks(3, None, "': '", 'chr(10)')} FROM k GROUP BY query_id),
q AS (SELECT DISTINCT conv_id AS query_id FROM conversations)
SELECT query_id, md5(concat_ws(chr(10) || chr(10), 'Question ' || query_id, 'SOURCES:' || chr(10) || coalesce(b0, '(none)'),
  'RELATED:' || chr(10) || coalesce(b3, '(none)') || chr(10) || '(Mt = Matthew; Ps = Psalms' || CASE WHEN query_id % 2 = 0 THEN '; 1 Kor = First Corinthians' ELSE '' END || ')',
  'COMPARED:' || chr(10) || b2, 'TRADITION:' || chr(10) || b1)) AS message_md5 FROM q LEFT JOIN b USING (query_id)""",
    "question_verses": f"""
WITH {texts._REFS}, t AS (SELECT 47000000 + l_orderkey % 30 * 1000 + l_partkey % 25 AS ordinal, l_returnflag AS work, min(CAST(l_suppkey AS VARCHAR)) AS text FROM lineitem GROUP BY 1, 2),
n AS (SELECT DISTINCT id, ordinal FROM r JOIN (SELECT DISTINCT ordinal FROM t) ON ordinal BETWEEN start AND "end"),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rank FROM n)
SELECT id AS query_id, row_number() OVER (PARTITION BY id ORDER BY rank, list_position(['R', 'A', 'N'], work)) AS ord, ordinal, work, text FROM k JOIN t USING (ordinal) WHERE rank <= 12""",
    "reassembled": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS piece, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
SELECT doc_id, count(*) FILTER (WHERE contains(piece, '***')) AS failed,
  CASE WHEN count(*) FILTER (WHERE contains(piece, '***')) = 0 THEN md5(string_agg(length(piece) || ':' || piece, chr(10) ORDER BY i)) END AS text_md5 FROM l GROUP BY doc_id""",
    "headers_stripped": r"""
WITH p AS (SELECT source, doc_id, concat_ws(chr(10), 'Header of ' || source || '  page ' || doc_id, text, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END) AS t FROM documents),
l AS (SELECT source, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare, trim(regexp_replace(lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), '[0-9\s]+', ' ', 'g')) AS key FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY i DESC) AS z FROM b WHERE bare <> ''),
s AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
h AS (SELECT source, key FROM o JOIN s USING (source) WHERE (a <= 3 OR z <= 3) AND length(key) >= 4 AND pages >= 4 GROUP BY source, key, pages HAVING count(DISTINCT doc_id) >= greatest(4, floor(pages * 0.25))),
k AS (SELECT b.*, s.pages >= 4 AND EXISTS (SELECT 1 FROM h WHERE h.source = b.source) AND bare <> '' AND (h.key IS NOT NULL OR regexp_full_match(bare, '[0-9]{1,4}')) AS goes
      FROM b JOIN s USING (source) LEFT JOIN h ON h.source = b.source AND h.key = b.key)
SELECT source AS document_id, doc_id AS page, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS text_md5 FROM k GROUP BY source, doc_id""",
    "visual_hebrew": """
WITH k AS (SELECT reverse(translate(regexp_replace(translate(p_name, 'aeiou', 'abgdh'), '[^abgdhklmnrstp ]', '', 'g'), 'abgdhklmnrstp', 'אבגדהכלמנרסתפ')) AS t FROM part)
SELECT split_part(t, ' ', 1) AS first, count(*) AS n, max(length(t)) AS longest FROM k GROUP BY 1""",
}
