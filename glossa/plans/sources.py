"""Queries on what sources give: markup of verses and definitions, volumes, tagged texts, numbers of lemmas, modules in SQLite."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import interlinear, lemmas
from glossa.sources import markup, tagged, volumes
from glossa.tables import table


def module_verses(spark, sf_dir):
    """Documents as verses of a module: a title, words, a note, added words in the middle of an unknown element."""
    t = F.coalesce("text", F.lit(""))
    raw = F.concat(F.lit("<TS><em>"), F.left(t, F.lit(20)), F.lit("</em><Ts><CM>"), F.substr(t, F.lit(21), F.lit(60)), F.lit(" <RF q=["), F.col("doc_id").cast("string"), F.lit("]>"), F.substr(t, F.lit(81), F.lit(40)),
                   F.lit("<Rf> <blink>"), F.substr(t, F.lit(121), F.lit(50)), F.lit(" <FI>"), F.substr(t, F.lit(171), F.lit(2_000_000_000)), F.lit("<Fi></blink>"))
    rows = table(spark, sf_dir, "documents").select(F.lit(1).alias("book"), F.lit(1).alias("chapter"), F.col("doc_id").alias("verse"), raw.alias("scripture"))
    found = markup.module_verses(rows, ["Rdz"])
    note = F.get("notes", F.lit(0))
    return found.select("verse", F.md5("text").alias("text_md5"), note["label"].alias("label"), F.md5(note["text"]).alias("note_md5"), F.size("notes").cast("long").alias("n_notes"))


def definitions(spark, sf_dir):
    """Conversation turns as definitions with breaks, letters, references and other elements."""
    t = F.coalesce("text", F.lit(""))
    raw = F.concat(F.lit("<B>"), F.left(t, F.lit(30)), F.lit("</B><BR /> <span class='x'>__1. "), F.substr(t, F.lit(31), F.lit(40)), F.lit("</span>, <ref='Gen.1."), F.col("turn").cast("string"), F.lit("'>Gen <i>1</i></ref><br>"), F.substr(t, F.lit(71), F.lit(100)))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return turns.select("conv_id", "turn", F.md5(markup.definition(F.col("raw"))).alias("definition_md5"), F.md5(markup.meaning(F.col("raw"))).alias("meaning_md5"))


def volume_passages(spark, sf_dir):
    """Documents as volumes of one work each, their lines as paragraphs on pages of three; each paragraph a passage."""
    def mark(line, i):
        safe = F.replace(F.replace(F.regexp_replace(line, "[^\\x20-\\x{D7FF}]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        page = F.when(i % 3 == 0, F.concat(F.lit('<pb n="'), F.floor(i / 3).cast("string"), F.lit('"/>'))).otherwise("")
        return F.concat(page, F.lit("<p>"), safe, F.lit("<note>left out</note></p>"))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), mark)
    xml = F.concat(F.lit('<ThML><ThML.body><div1 title="Index"><p>Nothing of an index is read as a passage, long or short.</p></div1><div1 title="Work '), F.col("doc_id").cast("string"), F.lit('"><div2 title="Part">'), F.array_join(lines, ""), F.lit("</div2></div1></ThML.body></ThML>"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("volume"), F.encode(xml, "UTF-8").alias("content"))
    found = volumes.volumes(files, {}, most=1)
    return found.select("volume", "title", "section", "ord", "page", F.md5("text").alias("text_md5"))


def tagged_psalms(spark, sf_dir):
    """Orders as lines of psalms in the Greek numbering, of which several may be the same verse."""
    word = F.concat(F.lit("w"), F.col("o_custkey").cast("string"), F.lit("<S>"), F.lpad((F.col("o_custkey") % 500).cast("string"), 6, "0"), F.lit("</S><m>lxx.N.N"), (F.col("o_orderkey") % 7).cast("string"), F.lit("</m><S>71000</S><S>"), (F.col("o_orderkey") % 5000 + 1).cast("string"), F.lit("</S> and plain"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_order"), F.lit(230).alias("book"), (F.col("o_custkey") % 152 + 1).cast("int").alias("chapter"), (F.col("o_orderkey") % 40 + 1).cast("int").alias("verse"), word.alias("text"))
    books = spark.createDataFrame([(230, 23, None)], "book int, order int, chapter_is int")
    lexemes = table(spark, sf_dir, "customer").filter("c_custkey < 500 AND c_custkey % 3 > 0").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("lexeme"), F.col("c_name").alias("lemma"))
    found = tagged.tagged_verses(lines, books, tagged.psalm_map(spark, 23), lexemes)
    one = F.col("tokens")[0]
    return found.select("ordinal", "text", one["lemma"].alias("lemma"), one["strong"].alias("strong"), one["morph"].alias("morph"))


_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπθρστυωχζςϋ")


def _interlinear(spark, sf_dir, words=True):
    """Orders as verses of three originals and two translations, their lines as words, parts as a lexicon, customers' orders as requests."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ordinal = (F.lit(47_000_000) + F.floor(F.col("o_orderkey") / 50) * 1_000 + F.col("o_orderkey") % 50).cast("long")
    word = F.struct(
        F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("surface"), F.lit("").alias("lemma"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("n"), F.col("l_partkey") % 50)).otherwise("").alias("lemma_norm"),
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("G"), F.col("l_partkey") % 200, F.when(F.col("l_partkey") % 3 == 2, "a").otherwise(""))).otherwise("").alias("strong"), F.col("l_linestatus").alias("morph"), F.lit("").alias("pos"),
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("own"), F.col("l_suppkey"))).alias("gloss"),
    )
    tokens = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(word)).alias("tokens"))
    verses = (orders.join(tokens, "o_orderkey", "left") if words else orders.withColumn("tokens", F.lit(None).cast(tokens.schema["tokens"].dataType))).withColumn("ordinal", ordinal)
    texts = verses.select("ordinal", F.explode(F.array(F.lit("GNT"), F.lit("BG"), F.when(F.col("o_orderkey") % 5 == 0, "LXX"))).alias("work"), F.col("o_orderpriority").alias("text"), "tokens").filter("work IS NOT NULL")
    texts = texts.withColumn("tokens", F.when(F.col("work") != "BG", F.col("tokens")))
    works = spark.createDataFrame([("GNT", "lat", "open"), ("LXX", "lat", "open"), ("WLC", "hbo", "open"), ("BG", "pl", "open"), ("SNP", "pl", "private")], "code string, language string, access string")
    books = spark.createDataFrame([(47, "NT")], "order long, part string")
    lexemes = table(spark, sf_dir, "part").filter("p_partkey BETWEEN 1 AND 180").select(F.concat(F.lit("G"), "p_partkey").alias("strong"), F.col("p_brand").alias("lemma"), F.concat(F.lit("n"), F.col("p_partkey") % 50).alias("lemma_norm"), F.replace("p_name", F.lit(" "), F.lit(", ")).alias("gloss"))
    asked = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0")
    start = (F.lit(47_000_000) + F.col("c_custkey") % 290 * 1_000 + F.col("c_nationkey")).cast("long")
    requests = asked.select(F.col("c_custkey").alias("request_id"), F.lit(0).alias("place"), start.alias("start"), (start + F.col("c_custkey") % 7).alias("end"), F.when(F.col("c_custkey") % 30 == 0, "lxx").alias("asked"), F.lit("snp").alias("translation"))
    return requests, texts, works, lexemes, books, {"NT": "GNT", "OT": "WLC", "DC": "LXX"}


def interlinear_verses(spark, sf_dir):
    """What each request shows: verses of the base text with their words' glosses, from the text or the lexicon, and the translation."""
    found = interlinear.interlinear(*_interlinear(spark, sf_dir), ["SNP", "BG"])
    words = F.coalesce("words", F.array().cast(found.schema["words"].dataType))
    glosses = F.array_join(F.transform(words, lambda w: F.concat_ws("/", w["surface"], w["strong"], w["gloss"], w["from_dictionary"].cast("string"), w["morph"], w["lemma"])), " ")
    return found.select("request_id", F.col("ord").cast("long").alias("ord"), "ordinal", "base", F.md5(glosses).alias("words_md5"), "translation")


def interlinear_around(spark, sf_dir):
    """Other originals of each request's verses, and the chapters before and after."""
    requests, texts, works, _, books, originals = _interlinear(spark, sf_dir, words=False)
    others = interlinear.alternatives(requests, texts, works, books, originals).groupBy("request_id").agg(F.min("code").alias("other"))
    return interlinear.chapters_around(requests, texts).join(others, "request_id", "left").select("request_id", "before", "after", "other")


def lemma_numbers(spark, sf_dir):
    """Words of documents in Greek letters with one of several endings, against a lexicon of some of them with another ending."""
    words = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    n, stem = F.length("w"), F.translate("w", *_LETTERS)
    end = F.when(n % 4 == 0, "ομαι").when(n % 4 == 1, "ω").when(n % 4 == 2, "υμι").otherwise("ησα")
    asked = words.select(F.concat(F.lit("ᾳ"), stem, end).alias("lemma"), F.concat(stem, end).alias("norm"))
    held = words.filter(n % 3 > 0).select(F.concat(F.lit("G"), (n * 700 + F.ascii("w")).cast("string")).alias("strong"), F.concat(F.when(n % 2 == 0, F.lit("ᾳ")).otherwise(F.lit("ᾷ")), stem, F.lit("ω")).alias("lemma"), F.concat(stem, F.lit("ω")).alias("norm"))
    return lemmas.lemma_numbers(asked, held).groupBy("how").agg(F.count("*").alias("n"), F.count("strong").alias("found"), F.min("strong").alias("least"), F.max("norm").alias("last"))


QUERIES = {f.__name__: f for f in (interlinear_verses, interlinear_around, module_verses, definitions, volume_passages, tagged_psalms, lemma_numbers)}
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_ORDINAL = "47000000 + o_orderkey // 50 * 1000 + o_orderkey % 50"
_REQUESTS = "q AS (SELECT c_custkey AS request_id, 47000000 + c_custkey % 290 * 1000 + c_nationkey AS s, c_custkey % 7 AS more, CASE WHEN c_custkey % 30 = 0 THEN 'LXX' ELSE 'GNT' END AS base FROM customer WHERE c_custkey % 10 = 0)"
ORACLE_SQL = {
    "interlinear_verses": f"""
WITH {_REQUESTS}, o AS (SELECT *, {_ORDINAL} AS ordinal FROM orders),
v AS (SELECT request_id, base, ordinal, o_orderkey, o_orderpriority FROM q JOIN o ON ordinal BETWEEN s AND s + more WHERE base = 'GNT' OR o_orderkey % 5 = 0),
x AS (SELECT 'G' || p_partkey AS strong, p_partkey AS k, p_brand AS lemma, 'n' || p_partkey % 50 AS norm, split_part(p_name, ' ', 1) AS gloss FROM part WHERE p_partkey BETWEEN 1 AND 180),
m AS (SELECT norm, min(strong) AS strong FROM x GROUP BY norm),
w AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey % 3 AS kind, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 > 0 THEN 'G' || l_partkey % 200 ELSE m.strong END AS number,
             CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'G' || l_partkey % 200 || CASE WHEN l_partkey % 3 = 2 THEN 'a' ELSE '' END END AS raw,
             CASE WHEN l_suppkey % 4 = 0 THEN 'own' || l_suppkey END AS own FROM lineitem LEFT JOIN m ON l_partkey % 3 = 0 AND m.norm = 'n' || l_partkey % 50),
t AS (SELECT w.*, x.strong AS found, x.lemma, concat_ws('/', l_returnflag, coalesce(x.strong, raw), coalesce(own, x.gloss, ''), CASE WHEN own IS NULL AND x.gloss IS NOT NULL THEN 'true' ELSE 'false' END, l_linestatus, coalesce(x.lemma, '')) AS word,
             CASE WHEN l_partkey % 3 = 0 THEN 'n' || l_partkey % 50 ELSE '' END AS norm FROM w LEFT JOIN x ON x.strong = w.number),
g AS (SELECT l_orderkey, md5(string_agg(word, ' ' ORDER BY l_linenumber, l_returnflag, coalesce(found, raw), word)) AS words_md5 FROM t GROUP BY l_orderkey)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS ord, ordinal, base, coalesce(words_md5, md5('')) AS words_md5, o_orderpriority AS translation FROM v LEFT JOIN g ON l_orderkey = o_orderkey""",
    "interlinear_around": f"""
WITH {_REQUESTS}, o AS (SELECT o_orderkey, {_ORDINAL} AS ordinal FROM orders), c AS (SELECT DISTINCT ordinal - ordinal % 1000 AS c FROM o)
SELECT request_id, (SELECT max(c) FROM c WHERE c < s - s % 1000) AS before, (SELECT min(c) FROM c WHERE c > s + more - (s + more) % 1000) AS after,
  CASE WHEN base = 'LXX' AND EXISTS (SELECT 1 FROM o WHERE ordinal BETWEEN s AND s + more) THEN 'GNT' WHEN base = 'GNT' AND EXISTS (SELECT 1 FROM o WHERE ordinal BETWEEN s AND s + more AND o_orderkey % 5 = 0) THEN 'LXX' END AS other FROM q""",
    "module_verses": f"""
WITH d AS (SELECT doc_id AS verse, coalesce(text, '') AS t FROM documents),
v AS (SELECT verse, {_CLEAN.format("substr(t, 21, 60) || ' ' || ' ' || substr(t, 121, 50) || ' ' || substr(t, 171)")} AS text, {_CLEAN.format('substr(t, 81, 40)')} AS note FROM d)
SELECT verse, md5(text) AS text_md5, left(CAST(verse AS VARCHAR), 16) AS label, md5(note) AS note_md5, 1 AS n_notes FROM v WHERE text <> ''""",
    "definitions": r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
r AS (SELECT conv_id, turn, '<b>' || left(t, 30) || '</b>' || chr(10) || '  1. ' || substr(t, 31, 40) || ' , [[Gen.1.' || turn || '|Gen 1]]' || chr(10) || substr(t, 71, 100) AS d,
             ' ' || left(t, 30) || ' ; ' || '  __1. ' || substr(t, 31, 40) || ' ,  Gen  1  ; ' || substr(t, 71, 100) AS m FROM t),
c AS (SELECT conv_id, turn, regexp_replace(d, '[ \t\r\f\v]+', ' ', 'g') AS d, regexp_replace(m, '\s+', ' ', 'g') AS m FROM r)
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(d, ' *\n *', chr(10), 'g'), '\n{2,}', chr(10), 'g'), ' ;:' || chr(10))) AS definition_md5, md5(left(trim(m, ' ;'), 600)) AS meaning_md5 FROM c""",
    "volume_passages": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(line, '[^\x20-\x{D7FF}]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l)
SELECT doc_id AS volume, 'Work ' || doc_id AS title, 'Part' AS section, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, CAST(i // 3 AS VARCHAR) AS page, md5(text) AS text_md5 FROM p WHERE length(text) > 40""",
    "tagged_psalms": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, o_custkey % 152 + 1 AS c, o_orderkey % 40 + 1 AS v FROM orders),
m AS (SELECT *, CASE WHEN c <= 8 OR c BETWEEN 147 AND 150 OR (c = 9 AND v <= 21) THEN c WHEN (c = 113 AND v > 8) OR c = 114 THEN c + 2 WHEN c = 151 OR c = 152 THEN NULL ELSE c + 1 END AS chapter,
             CASE WHEN c = 9 AND v > 21 THEN v - 21 WHEN c = 113 AND v > 8 THEN v - 8 WHEN c = 115 THEN v + 9 WHEN c = 147 THEN v + 11 ELSE v END AS verse FROM o),
f AS (SELECT * FROM m WHERE chapter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chapter, verse ORDER BY k) = 1)
SELECT 23000000 + chapter * 1000 + verse AS ordinal, 'w' || u AS text, CASE WHEN u % 500 % 3 > 0 THEN coalesce(c_name, '') ELSE '' END AS lemma, 'G' || (k % 5000 + 1) AS strong, 'N.N' || k % 7 AS morph
FROM f LEFT JOIN customer ON c_custkey = u % 500""",
    "lemma_numbers": f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en'),
s AS (SELECT w, length(w) AS n, translate(w, '{_LETTERS[0]}', '{_LETTERS[1]}') AS stem FROM w),
a AS (SELECT *, stem || CASE n % 4 WHEN 0 THEN 'ομαι' WHEN 1 THEN 'ω' WHEN 2 THEN 'υμι' ELSE 'ησα' END AS norm FROM s),
h AS (SELECT CASE WHEN n % 2 = 0 THEN 'ᾳ' ELSE 'ᾷ' END || stem || 'ω' AS lemma, stem || 'ω' AS norm, min(n * 700 + ascii(w)) AS number FROM s WHERE n % 3 > 0 GROUP BY 1, 2),
x AS (SELECT DISTINCT norm, 'ᾳ' || norm AS lemma FROM a),
e AS (SELECT * FROM (VALUES (0, 'εομαι', 'εω'), (1, 'αομαι', 'αω'), (2, 'οομαι', 'οω'), (3, 'ομαι', 'ω'), (8, 'υμαι', 'υμι'), (11, 'υμι', 'υω'), (12, 'υω', 'υμι'), (16, 'ω', 'ομαι')) t(i, a, b)),
v AS (SELECT lemma, norm, a, b, i FROM x JOIN e ON norm LIKE '%' || a),
-- how many variants there are before one: those of earlier endings that fit the word
t AS (SELECT lemma, norm, left(norm, length(norm) - length(a)) || b AS form, 1 + row_number() OVER (PARTITION BY norm ORDER BY i) AS how FROM v),
c AS (SELECT x.lemma, x.norm, 0 AS how, number FROM x JOIN h ON x.lemma = h.lemma
      UNION ALL SELECT x.lemma, x.norm, 1, number FROM x JOIN h ON x.norm = h.norm
      UNION ALL SELECT t.lemma, t.norm, how, number FROM t JOIN h ON t.form = h.norm),
b AS (SELECT lemma, norm, min(struct_pack(how := how, later := number > 5624, number := number)) AS b FROM c GROUP BY ALL)
SELECT CAST(b.how AS INT) AS how, count(*) AS n, count(b.number) AS found, min('G' || b.number) AS least, max(x.norm) AS last FROM x LEFT JOIN b USING (lemma, norm) GROUP BY b.how""",
}
