"""Queries on quotations: found in answers, tied to sources, compared, located in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import quotes, verify
from glossa.tables import table


def _answers(spark, sf_dir):
    """Conversations as answers that quote their turns, with a citation behind the mark, later in the sentence, or none."""
    said = F.concat(F.lit("„"), F.left("text", F.lit(200)), F.lit("”"))
    label = F.when(F.col("turn") % 5 == 4, F.col("turn")).otherwise(F.col("turn") + 1).cast("string")
    cited = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("He said "), said, F.lit(" ["), label, F.lit("] then. "))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("Also "), said, F.lit(" as in ["), label, F.lit("]. "))).otherwise(F.concat(F.lit("Last "), said, F.lit(" came up. ")))
    turns = table(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", F.struct("turn", cited.alias("part"), (F.col("turn") + 1).cast("string").alias("label")).alias("t"))
    ordered = turns.groupBy(F.col("conv_id").alias("answer_id")).agg(F.sort_array(F.collect_list("t")).alias("ts"))  # the turns of one answer
    return ordered.select("answer_id", F.array_join(F.transform("ts", lambda t: t["part"]), "").alias("text"), F.transform("ts", lambda t: t["label"]).alias("available"))


def quoted_passages(spark, sf_dir):
    """Every quotation of the answers, in order, with the labels that its sentence cites."""
    found = quotes.extracted(_answers(spark, sf_dir))
    return found.select("answer_id", "ord", F.md5("quote").alias("quote_md5"), F.array_join("refs", ",").alias("refs"), "reason")


def quote_verdicts(spark, sf_dir):
    """Whether the turns that are cited, or any turn where none is, hold the quotations of the answers word by word."""
    sources = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), (F.col("turn") + 1).cast("string").alias("label"), "text")
    found = quotes.verified(quotes.extracted(_answers(spark, sf_dir)), sources)
    return found.select("answer_id", "ord", (F.col("ratio") == 1).alias("verbatim"))


def _said(text):
    return F.lower(F.translate(F.regexp_replace(text, r"\s+", " "), "„”“«»’‘–—", "\"\"\"\"\"''--"))


def quote_places(spark, sf_dir):
    """Benchmark items, whole and with their middle left out, in every document that holds them."""
    third = (F.length("text") / 3).cast("int")
    whole = table(spark, sf_dir, "benchmark").select((2 * F.col("item_id")).alias("quote_id"), F.col("text").alias("quote"))
    parts = table(spark, sf_dir, "benchmark").select((2 * F.col("item_id") + 1).alias("quote_id"), F.concat(F.left("text", third), F.lit(" [...] "), F.right("text", third)).alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quotes.located(whole.unionByName(parts), docs).join(docs, "doc_id")
    place = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("quote_id", "doc_id", "kind", F.md5(_said(place)).alias("place_md5"))


def quote_candidates(spark, sf_dir):
    """Benchmark items with words exchanged, and the documents that still have 65 % of their distinct words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    changed = F.regexp_replace("text", r"(\S+ \S+ \S+ \S+) \S+", "$1 exchanged")
    pairs = verify.quote_sources(items.select(F.col("item_id").alias("quote_id"), changed.alias("quote")), docs.select("doc_id", F.col("text").alias("source")))
    return pairs.select("quote_id", "doc_id")


QUERIES = {f.__name__: f for f in (quoted_passages, quote_verdicts, quote_places, quote_candidates)}
_TURNS = """
turns AS (SELECT conv_id AS answer_id, turn, text, left(text, 200) AS said, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord,
                 CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 5 = 4 THEN turn ELSE turn + 1 END AS cited FROM conversations WHERE text <> '')"""
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SAID = "lower(translate(regexp_replace({}, '\\s+', ' ', 'g'), '„”“«»’‘–—', '\"\"\"\"\"''''--'))"
ORACLE_SQL = {
    "quoted_passages": f"""
WITH {_TURNS} SELECT t.answer_id, t.ord, md5(regexp_replace(said, '^\\s+|\\s+$', '', 'g')) AS quote_md5, coalesce(CAST(cited AS VARCHAR), '') AS refs,
       CASE WHEN cited IS NOT NULL AND NOT EXISTS (SELECT 1 FROM turns o WHERE o.answer_id = t.answer_id AND o.turn + 1 = t.cited) THEN 'missing_source' END AS reason
FROM turns t""",
    "quote_verdicts": f"""
WITH {_TURNS} SELECT t.answer_id, t.ord, coalesce(bool_or(contains({_NORM.format('o.text')}, {_NORM.format('t.said')})), false) AS verbatim
FROM turns t LEFT JOIN turns o ON o.answer_id = t.answer_id AND (t.cited IS NULL OR o.turn + 1 = t.cited)
WHERE length({_NORM.format('t.said')}) >= 15 OR t.cited IS NOT NULL GROUP BY t.answer_id, t.ord""",
    "quote_places": f"""
WITH d AS (SELECT doc_id, {_SAID.format('text')} AS t FROM documents),
q AS (SELECT item_id, {_SAID.format('text')} AS whole, trim({_SAID.format("left(text, length(text) // 3)")}) AS a, trim({_SAID.format("right(text, length(text) // 3)")}) AS b FROM benchmark),
p AS (SELECT *, strpos(t, a) AS at_a, strpos(substr(t, strpos(t, a) + length(a)), b) AS then_b FROM q JOIN d ON contains(t, a))
SELECT 2 * item_id AS quote_id, doc_id, 'exact' AS kind, md5(whole) AS place_md5 FROM q JOIN d ON contains(t, whole)
UNION ALL
SELECT 2 * item_id + 1, doc_id, 'elided', md5(substr(t, at_a, length(a) + then_b - 1 + length(b))) FROM p WHERE then_b > 0""",
    "quote_candidates": r"""
WITH q AS (SELECT item_id AS quote_id, list_distinct(regexp_extract_all(lower(regexp_replace(text, '(\S+ \S+ \S+ \S+) \S+', '\1 exchanged', 'g')), '[\p{L}\p{N}]+')) AS words FROM benchmark),
w AS (SELECT quote_id, len(words) AS n, unnest(words) AS word FROM q),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM documents)
SELECT quote_id, doc_id FROM w JOIN d USING (word) GROUP BY quote_id, doc_id, n HAVING count(*) >= 0.65 * n - 1e-9""",
}
