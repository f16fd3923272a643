"""Queries of editorial operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import editorial as E
from glossa.functions import text as T
from glossa.operators import verify, windows
from glossa.plans.relations import VOTE
from glossa.tables import table

GREEK = ["V-", "N-", "A-", "RA", "C-", "??"]
CODES = ["3AAI-S--", "----NSM-", "----DPFC", "--------", "-PAPNSM-", None]
LEXICON = ["G:N-M", "H:V", "N-L", "H:N-F-P", "G:Adv", "G:X-M", "H:A-N"]


def _pick(column: str, values: list) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def greek_morphology(spark, sf_dir):
    """Codes dealt to the lines of orders, decoded and counted."""
    rows = table(spark, sf_dir, "lineitem").select(_pick("l_partkey", GREEK).alias("pos"), _pick("l_suppkey", CODES).alias("code"))
    return rows.groupBy(E.greek_morphology(F.col("pos"), F.col("code")).alias("told")).agg(F.count("*").alias("n"))


def _of_keys(names, column: str):
    """One of the keys of a table of codes, by a column's number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.col(column) % len(names) + 1).cast("int"))


def hebrew_morphology(spark, sf_dir):
    """Codes of all kinds, stems and forms that numbers of lines make, with prefixes, told in words."""
    aramaic = F.col("l_linenumber") % 2 == 0
    stem = F.when(aramaic, _of_keys(E.ARAMAIC_STEMS, "l_suppkey")).otherwise(_of_keys(E.HEBREW_STEMS, "l_suppkey"))
    form = F.concat(_of_keys(E.HEBREW_PERSON, "l_suppkey"), _of_keys(E.HEBREW_GENDER, "l_partkey"), _of_keys(E.HEBREW_NUMBER, "l_orderkey"), _of_keys(E.HEBREW_STATE, "l_suppkey"))
    kind = _of_keys(E.HEBREW_KINDS, "l_partkey")
    proper = F.concat(kind, _of_keys(E.PROPER_KINDS, "l_suppkey"))
    body = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("V"), stem, _of_keys(E.HEBREW_VERBS, "l_partkey"), form)).when(kind == "Np", proper).when(F.substr(kind, F.lit(1), F.lit(1)).isin("T", "R"), kind).otherwise(F.concat(kind, form))
    code = F.concat(F.when(aramaic, "A").otherwise("H"), F.when(F.col("l_orderkey") % 4 == 1, "C/").otherwise(""), F.when(F.col("l_orderkey") % 5 == 2, "R/").otherwise(""), body)
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"))
    return rows.groupBy("code", E.hebrew_morphology(F.col("code")).alias("told")).agg(F.count("*").alias("n"))


def lexicon_pos(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(_pick("p_partkey", LEXICON).alias("code"))
    return rows.groupBy("code", E.lexicon_pos(F.col("code")).alias("told")).agg(F.count("*").alias("n"))


def original_terms(spark, sf_dir):
    """Greek and Hebrew words in texts that quote some."""
    text = F.concat(F.col("text"), F.lit(" λόγος και "), _pick("doc_id", ["Λόγος", "ἐν", "α"]), F.lit(" "), _pick("doc_id", ["בְּרֵאשִׁית", "ה", "אור אור"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.array_join(E.original_terms(F.col("text"), "grc"), " ").alias("greek"), F.array_join(E.original_terms(F.col("text"), "hbo"), " ").alias("hebrew"))


def question_triggers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return turns.select("conv_id", "turn", E.wants(F.col("text"), ("the", "wh"), ("er", "an")).alias("wanted"))


def heading_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(E.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("headings"), F.min("pos").cast("long").alias("first_at"))


def time_marks(spark, sf_dir):
    said = F.concat(F.lit("At ["), (F.col("event_id") % 60).cast("string"), F.lit(":05] and [1:"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit(":30], not [5]"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(E.time_marks(said), lambda s: s.cast("string")), " ").alias("seconds"))


def metric_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", E.metric_name(F.col("p_type")).alias("name"))


def stable_case_id(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text").select("item_id", E.stable_id("item_id", "text").alias("case_id"))


def citation_strings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pages = F.when(F.col("p_size") > 10, F.concat(F.col("p_size").cast("string"), F.lit("–"), (F.col("p_size") + 9).cast("string")))
    journal = F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))
    return part.select("p_partkey", E.citation(F.array("p_brand"), F.col("p_name"), journal, F.col("p_size") + 1950, pages).alias("citation"))


def author_identity(spark, sf_dir):
    """Names with other case and blanks have one key."""
    names = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))).alias("name"))
    return names.groupBy(E.identity_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"))


def text_direction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.direction(F.when(F.col("doc_id") % 7 == 0, "hbo").otherwise(F.col("lang"))).alias("dir"))


def osis_ranges(spark, sf_dir):
    """References in dotted notation made of order dates; a bad one gives none."""
    c, v = F.col("o_orderkey") % 50 + 1, F.col("o_custkey") % 30 + 1
    ref = F.concat(F.lit("Gen."), c.cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), v.cast("string"))), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("-Exod."), (c + 1).cast("string"), F.lit(".2"))).when(F.col("o_orderkey") % 4 == 1, F.lit("-x")).otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    found = E.osis_range(F.col("ref"), F.lit(1).cast("long"), F.when(F.contains("ref", F.lit("Exod")), 2).cast("long"))
    return rows.select("o_orderkey", found.alias("r")).select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


#: Signs of a numeral's units, tens and hundreds by their digit, from 0 on.
_UNITS = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]


def _place(digit, one: str, five: str, ten: str):
    signs = F.element_at(F.array(*map(F.lit, _UNITS)), (digit + 1).cast("int"))
    return F.translate(signs, "ivx", one + five + ten)


def roman_numerals(spark, sf_dir):
    """Keys of parts written as numerals, in capitals or not, and read again; others are no numerals."""
    n = F.col("p_partkey") % 3999 + 1
    digit = lambda d: F.floor(n / d) % 10
    written_ = F.concat(F.repeat(F.lit("m"), (n / 1000).cast("int")), _place(digit(100), "c", "d", "m"), _place(digit(10), "x", "l", "c"), _place(digit(1), "i", "v", "x"))
    numeral = F.when(F.col("p_partkey") % 7 == 3, F.concat(written_, F.lit("?"))).when(F.col("p_partkey") % 2 == 0, F.upper(written_)).otherwise(written_)
    return table(spark, sf_dir, "part").select("p_partkey", E.roman(numeral).alias("value"))


def citation_checks(spark, sf_dir):
    """Markers of answers with lists, ranges and faults, checked against the sources at hand."""
    i = F.col("event_id")
    answer = F.concat(F.lit("So [P1, 2-"), (i % 4 + 1).cast("string"), F.lit("] and ["), (i % 6).cast("string"), F.lit("; x] or [A1-P2] or [9-"), (i % 12).cast("string"), F.lit("]."))
    checks = F.explode(verify.citation_checks(answer, F.array(*map(F.lit, ("1", "P1", "P2", "P3", "9", "10")))))
    rows = table(spark, sf_dir, "events").select("event_id", checks.alias("c"))
    return rows.select("event_id", "c.marker", F.array_join("c.refs", " ").alias("refs"), F.array_join("c.missing", " ").alias("missing"), F.coalesce("c.reason", F.lit("ok")).alias("status"))


def access_recheck(spark, sf_dir):
    """Hits of an index joined with the documents as they are now: gone or closed ones leave before the rank is given."""
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") * 7919 % 1009).alias("score"))
    now = table(spark, sf_dir, "documents").filter((F.col("lang") != "de") & (F.col("n_chars") > 0)).select("doc_id", "source")
    return windows.ranked(hits.join(now, "doc_id"), [F.desc("score"), "doc_id"], 20).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def unknown_labels(spark, sf_dir):
    """Labels whose document is not in the open corpus."""
    is_open = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return table(spark, sf_dir, "labels").join(is_open, "doc_id", "left_anti").select("doc_id", "quality")


def with_notes(spark, sf_dir):
    """Documents with the note of their label, none where they have none."""
    note = F.when(F.col("toxic") == 1, "closed").when(F.col("quality") == 1, "reviewed").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", note.alias("note")), "doc_id", "left")


def curation_counts(spark, sf_dir):
    decided = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    access = F.when(F.col("toxic") == 1, "private").when(F.col("quality") == 0, "licensed").when(F.col("quality") == 1, "open").otherwise("undecided")
    return decided.groupBy("source", access.alias("access")).agg(F.count("*").alias("n"))


def language_changes(spark, sf_dir):
    """Languages as declared and as told from the text, where both are known and differ or not."""
    told = table(spark, sf_dir, "documents").select(F.col("lang").alias("old"), T.detect_language(F.col("text")).alias("new"))
    return told.groupBy("old", "new").agg(F.count("new").alias("n")).filter("n > 0")  # a filter on the language itself would tell it twice


def lexicon_profile(spark, sf_dir):
    """A word's uses by source and by language, with its share in each, and its commonest forms: facets in one pass."""
    words = table(spark, sf_dir, "documents").select("source", "lang", F.explode(T.words(F.col("text"), "[A-Za-z]+")).alias("form")).filter(F.col("form").startswith("wh"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "lang", "form"))))
    counts = words.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))
    return windows.first_per(counts, ["facet"], [F.desc("n"), "value"], 20)


def occurrence_sample(spark, sf_dir):
    """The first five documents of each source that use a word, each once."""
    used = table(spark, sf_dir, "documents").filter(F.array_contains(T.words(F.col("text")), "with")).select("source", "doc_id").distinct()
    return windows.first_per(used, ["source"], ["doc_id"], 5)


def interlinear(spark, sf_dir):
    """Every word of every line of each document with its gloss: of the word (exact), else of its stem, else none."""
    glosses = table(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, ["the", "and", "of", "to", "in"])), F.col("n_nationkey") % 5 + 1).alias("w"), F.col("n_name").alias("g")).groupBy("w").agg(F.min("g").alias("g"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).select("doc_id", "line", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    stem = F.regexp_replace("word", "(ed|s)$", "")
    exact, loose = glosses.toDF("w1", "g1"), glosses.toDF("w2", "g2")
    glossed = lines.join(F.broadcast(exact), F.col("word") == F.col("w1"), "left").join(F.broadcast(loose), stem == F.col("w2"), "left")  # five glosses
    return glossed.select("doc_id", "line", F.col("pos").cast("long").alias("pos"), "word", F.coalesce("g1", "g2").alias("gloss"), F.col("g1").isNotNull().alias("exact"))


def answer_metrics(spark, sf_dir):
    """Rates of answers by language, over those they apply to: valid markers, refusals as expected, required words there."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    required = F.array(F.lit("the"), F.lit("with"), F.lit("zzz"))
    covered = F.size(F.array_intersect(required, T.words(F.col("text")))) / F.lit(3.0)
    rows = docs.select("lang", F.when(F.col("quality") == 1, covered).alias("terms"), (F.col("toxic") == F.when(F.length("text") < 300, 1).otherwise(0)).cast("double").alias("refusal"))
    return rows.groupBy("lang").agg(F.round(F.avg("terms"), 6).alias("terms"), F.count("terms").alias("n_terms"), F.round(F.avg("refusal"), 6).alias("refusal"), F.count("refusal").alias("n_refusal"))


def channels_union(spark, sf_dir):
    """The best of two channels, a document once: by its first channel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    long = docs.orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", F.lit(0).alias("channel"), "n_chars")
    french = docs.filter("lang = 'fr'").orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", F.lit(1).alias("channel"), "n_chars")
    once = windows.first_per(long.unionByName(french), ["doc_id"], ["channel"])
    return windows.ranked(once, ["channel", F.desc("n_chars"), "doc_id"], 20).select("doc_id", "channel", F.col("rank").cast("long").alias("rank"))


def merged_names(spark, sf_dir):
    """Part names of each brand without repeats in other case, of 2 to 80 letters."""
    from glossa.operators import corpus

    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    return lists.select("p_brand", F.array_join(corpus.merged_names(F.slice("names", 1, 8), F.transform("names", F.upper), F.lit("red plate"), 500), "|").alias("names"))


def quota(spark, sf_dir):
    """Uploads of each owner in order: taken while the sum of sizes stays in the quota and the content is new to the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner"), "n_chars", F.md5("text").alias("h"))
    by_owner = Window.partitionBy("owner")
    fresh = F.row_number().over(Window.partitionBy("owner", "h").orderBy("doc_id")) == 1
    spent = F.sum(F.when(F.col("fresh"), F.col("n_chars")).otherwise(0)).over(by_owner.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    marked = docs.withColumn("fresh", fresh).withColumn("spent", spent)
    return marked.select("doc_id", "owner", F.when(~F.col("fresh"), "known").when(F.col("spent") > 100_000, "full").otherwise("taken").alias("status"))


def consent_state(spark, sf_dir):
    """Whether a user's consent holds: the latest of given and withdrawn, of append-only evidence."""
    evidence = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "logout", "click"))
    last = evidence.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
    return last.select("user_id", (F.col("last") != "logout").alias("holds"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        greek_morphology, hebrew_morphology, lexicon_pos, original_terms, question_triggers, heading_lines, time_marks, metric_names, stable_case_id, citation_strings, author_identity,
        text_direction, osis_ranges, roman_numerals, citation_checks, access_recheck, unknown_labels, with_notes, curation_counts, language_changes,
        lexicon_profile, occurrence_sample, interlinear, answer_metrics, channels_union, merged_names, quota, consent_state,
    )
}


def _of(column: str, values: list) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][CAST({column} % {len(values)} + 1 AS INT)]"


def _key_of(names, column: str) -> str:
    return _of(column, list(names))


def _case(of: str, names: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
  # fmt: skip
_LEXICON_TOLD = {"G:N-M": "noun, masculine", "H:V": "verb", "N-L": "place name", "H:N-F-P": "proper name", "G:Adv": "adverb", "G:X-M": "masculine", "H:A-N": "adjective, neuter"}

ORACLE_SQL = {
    "greek_morphology": f"""
WITH r AS (SELECT {_of('l_partkey', GREEK)} AS pos, rpad(coalesce({_of('l_suppkey', CODES)}, ''), 8, '-') AS c FROM lineitem)
SELECT concat_ws(', ', {_case('pos', E.GREEK_POS)}, {', '.join(_case(f'substr(c, {i + 1}, 1)', E.GREEK_PLACES[i]) for i in E.GREEK_ORDER)}) AS told, count(*) AS n FROM r GROUP BY 1""",
    "hebrew_morphology": f"""
WITH k AS (SELECT l_linenumber % 2 = 0 AS aramaic, l_orderkey, {_key_of(E.ARAMAIC_STEMS, 'l_suppkey')} AS a, {_key_of(E.HEBREW_STEMS, 'l_suppkey')} AS h, {_key_of(E.HEBREW_VERBS, 'l_partkey')} AS v, {_key_of(E.HEBREW_PERSON, 'l_suppkey')} AS p,
             {_key_of(E.HEBREW_GENDER, 'l_partkey')} AS g, {_key_of(E.HEBREW_NUMBER, 'l_orderkey')} AS n, {_key_of(E.HEBREW_STATE, 'l_suppkey')} AS s, {_key_of(E.HEBREW_KINDS, 'l_partkey')} AS k, {_key_of(E.PROPER_KINDS, 'l_suppkey')} AS r FROM lineitem),
t AS (SELECT *, concat_ws(', ', {_case('p', E.HEBREW_PERSON)}, {_case('g', E.HEBREW_GENDER)}, {_case('n', E.HEBREW_NUMBER)}, {_case('s', E.HEBREW_STATE)}) AS form FROM k),
w AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 'V' || CASE WHEN aramaic THEN a ELSE h END || v || p || g || n || s WHEN k = 'Np' THEN k || r WHEN left(k, 1) IN ('T', 'R') THEN k ELSE k || p || g || n || s END AS body,
             CASE WHEN l_orderkey % 3 = 0 THEN concat_ws(', ', 'verb', CASE WHEN aramaic THEN {_case('a', E.ARAMAIC_STEMS)} ELSE {_case('h', E.HEBREW_STEMS)} END, {_case('v', E.HEBREW_VERBS)}, form)
                  WHEN k = 'Np' THEN concat_ws(', ', 'noun', 'proper', {_case('r', E.PROPER_KINDS)})
                  ELSE concat_ws(', ', {_case('left(k, 1)', E.HEBREW_POS)}, {_case('k', E.HEBREW_KINDS)}, CASE WHEN left(k, 1) NOT IN ('T', 'R') THEN form END) END AS told FROM t)
SELECT CASE WHEN aramaic THEN 'A' ELSE 'H' END || CASE WHEN l_orderkey % 4 = 1 THEN 'C/' ELSE '' END || CASE WHEN l_orderkey % 5 = 2 THEN 'R/' ELSE '' END || body AS code,
  CASE WHEN aramaic THEN 'Aramaic: ' ELSE '' END || CASE WHEN l_orderkey % 4 = 1 THEN 'conjunction + ' ELSE '' END || CASE WHEN l_orderkey % 5 = 2 THEN 'preposition + ' ELSE '' END || told AS told, count(*) AS n FROM w GROUP BY 1, 2""",
    "lexicon_pos": f"SELECT {_of('p_partkey', LEXICON)} AS code, {_case(_of('p_partkey', LEXICON), _LEXICON_TOLD)} AS told, count(*) AS n FROM part GROUP BY 1, 2",
    "original_terms": """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'και λογοσ' WHEN 1 THEN 'εν και λογοσ' ELSE 'και λογοσ' END AS greek, CASE doc_id % 3 WHEN 0 THEN 'בראשית' WHEN 1 THEN '' ELSE 'אור' END AS hebrew FROM documents""",
    "question_triggers": "SELECT conv_id, turn, regexp_matches(text, '(?i)(?:^|[^a-z])(?:(?:the|wh)|(?:er|an)(?:[^a-z]|$))') AS wanted FROM conversations WHERE text IS NOT NULL",
    "heading_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, count(*) AS headings, CAST(min(pos) AS BIGINT) AS first_at FROM l WHERE length(line) <= 80 AND regexp_matches(line, '^(?:\d+(?:\.\d+)*\.?\s+)?\p{Lu}') AND NOT regexp_matches(line, '[.,;:!?]$') GROUP BY doc_id""",
    "time_marks": "SELECT event_id, (event_id % 60 * 60 + 5) || ' ' || (3600 + user_id % 60 * 60 + 30) AS seconds FROM events",
    "metric_names": """
WITH t AS (SELECT DISTINCT p_type FROM part)
SELECT p_type, array_to_string(list_transform(string_split(p_type, ''), lambda c: CASE WHEN regexp_matches(c, '^[a-z0-9]$') THEN c ELSE '_' || lower(hex(c)) || '_' END), '') AS name FROM t""",
    "stable_case_id": "SELECT item_id, sha256('{\"item_id\":' || item_id || ',\"text\":' || CAST(to_json(text) AS VARCHAR) || '}') AS case_id FROM benchmark",
    "citation_strings": """
SELECT p_partkey, concat_ws(', ', p_brand, '“' || p_name || '”', CASE WHEN p_partkey % 3 > 0 THEN p_type END, CAST(p_size + 1950 AS VARCHAR), 'p. ' || CASE WHEN p_size > 10 THEN p_size || '–' || (p_size + 9) END) AS citation FROM part""",
    "author_identity": "SELECT lower(c_mktsegment) || '-' || left(sha256(lower(c_mktsegment)), 12) AS key, count(*) AS n FROM customer GROUP BY 1",
    "text_direction": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'rtl' ELSE 'ltr' END AS dir FROM documents",
    "osis_ranges": """
WITH r AS (SELECT o_orderkey, o_orderkey % 50 + 1 AS c, o_custkey % 30 + 1 AS v, o_orderkey % 3 = 0 AS w, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k <> 1 THEN 1000000 + c * 1000 + CASE WHEN w THEN 0 ELSE v END END AS start,
       CASE WHEN k = 1 THEN NULL WHEN k = 0 THEN 2000000 + (c + 1) * 1000 + 2 ELSE 1000000 + c * 1000 + CASE WHEN w THEN 999 ELSE v END END AS "end" FROM r""",
    "roman_numerals": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 3 THEN p_partkey % 3999 + 1 END AS value FROM part",
    "citation_checks": """
WITH e AS (SELECT event_id, event_id % 4 + 1 AS b, event_id % 6 AS o, event_id % 12 AS z FROM events),
p AS (SELECT event_id, '[P1, 2-' || b || ']' AS marker, CASE b WHEN 1 THEN 'P1' WHEN 2 THEN 'P1 P2' WHEN 3 THEN 'P1 P2 P3' ELSE 'P1 P2 P3 P4' END AS refs, CASE b WHEN 4 THEN 'P4' ELSE '' END AS missing,
      CASE b WHEN 1 THEN 'invalid_range' WHEN 4 THEN 'missing_source' ELSE 'ok' END AS status FROM e
UNION ALL SELECT event_id, '[' || o || '; x]', CAST(o AS VARCHAR), CASE WHEN o = 1 THEN '' ELSE CAST(o AS VARCHAR) END, 'invalid_marker' FROM e
UNION ALL SELECT event_id, '[A1-P2]', '', '', 'cross_family_range' FROM e
UNION ALL SELECT event_id, '[9-' || z || ']', CASE WHEN z < 9 THEN '' WHEN z = 9 THEN '9' WHEN z = 10 THEN '9 10' ELSE '9 10 11' END, CASE WHEN z = 11 THEN '11' ELSE '' END,
      CASE WHEN z < 9 THEN 'invalid_range' WHEN z = 11 THEN 'missing_source' ELSE 'ok' END FROM e)
SELECT * FROM p""",
    "access_recheck": """
WITH h AS (SELECT vec_id AS doc_id, vec_id * 7919 % 1009 AS score FROM embeddings)
SELECT doc_id, source, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h JOIN documents USING (doc_id) WHERE lang <> 'de' AND n_chars > 0 QUALIFY rank <= 20""",
    "unknown_labels": "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "with_notes": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'closed' WHEN quality = 1 THEN 'reviewed' ELSE 'plain' END AS note FROM documents d LEFT JOIN labels l USING (doc_id)",
    "curation_counts": """
SELECT source, CASE WHEN toxic = 1 THEN 'private' WHEN quality = 0 THEN 'licensed' WHEN quality = 1 THEN 'open' ELSE 'undecided' END AS access, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "language_changes": f"WITH {VOTE} SELECT d.lang AS old, v.lang AS new, count(*) AS n FROM v JOIN documents d USING (doc_id) WHERE v.lang IS NOT NULL GROUP BY 1, 2",
    "lexicon_profile": """
WITH w AS (SELECT source, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+')) AS form FROM documents), f AS (SELECT * FROM w WHERE starts_with(form, 'wh')),
c AS (SELECT 'source' AS facet, source AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'form', form, count(*) FROM f GROUP BY 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 20""",
    "occurrence_sample": f"SELECT source, doc_id FROM documents WHERE list_contains({_WORDS}, 'with') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
    "interlinear": """
WITH g AS (SELECT ['the', 'and', 'of', 'to', 'in'][n_nationkey % 5 + 1] AS w, min(n_name) AS g FROM nation GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT doc_id, CAST(line AS INT) AS line, regexp_extract_all(lower(t), '[a-z]+') AS ws FROM l),
t AS (SELECT doc_id, line, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)
SELECT doc_id, line, CAST(pos AS BIGINT) AS pos, word, coalesce(a.g, b.g) AS gloss, a.g IS NOT NULL AS exact
FROM t LEFT JOIN g a ON word = a.w LEFT JOIN g b ON regexp_replace(word, '(ed|s)$', '') = b.w""",
    "answer_metrics": f"""
WITH d AS (SELECT lang, CASE WHEN quality = 1 THEN (list_contains({_WORDS}, 'the')::INT + list_contains({_WORDS}, 'with')::INT + list_contains({_WORDS}, 'zzz')::INT) / 3.0::DOUBLE END AS terms,
       CAST(toxic = CASE WHEN length(text) < 300 THEN 1 ELSE 0 END AS DOUBLE) AS refusal FROM documents JOIN labels USING (doc_id))
SELECT lang, round(avg(terms), 6) AS terms, count(terms) AS n_terms, round(avg(refusal), 6) AS refusal, count(refusal) AS n_refusal FROM d GROUP BY lang""",
    "channels_union": """
WITH a AS (SELECT doc_id, 0 AS channel, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15), b AS (SELECT doc_id, 1 AS channel, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 15),
u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY channel) = 1)
SELECT doc_id, channel, row_number() OVER (ORDER BY channel, n_chars DESC, doc_id) AS rank FROM u QUALIFY rank <= 20""",
    "merged_names": """
WITH l AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY p_brand),
m AS (SELECT p_brand, list_concat(names[1:8], list_transform(names[9:], lambda n: upper(n))) AS names FROM l)
SELECT p_brand, array_to_string(list_filter(names, lambda n: lower(n) <> 'red plate'), '|') AS names FROM m""",
    "quota": """
WITH d AS (SELECT doc_id, source AS owner, n_chars, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) = 1 AS fresh FROM documents),
s AS (SELECT *, sum(CASE WHEN fresh THEN n_chars ELSE 0 END) OVER (PARTITION BY owner ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM d)
SELECT doc_id, owner, CASE WHEN NOT fresh THEN 'known' WHEN spent > 100000 THEN 'full' ELSE 'taken' END AS status FROM s""",
    "consent_state": """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type IN ('purchase', 'logout', 'click'))
SELECT user_id, event_type <> 'logout' AS holds, n FROM e WHERE i = 1""",
}
