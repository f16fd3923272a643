"""Range, join, grouping and window queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import access, groups, ranges, verify, windows
from glossa.sources import writers
from glossa.tables import table

#: Literal ordinal ranges that queries ask for.
ASKED = [(100, 180), (1000, 1050), (5000, 5003), (12000, 12600)]


def _n(c):
    return F.count("*").alias(c)


def _intervals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_custkey", F.col("o_orderkey").alias("l_start"), (F.col("o_orderkey") + F.col("o_totalprice").cast("long") % 50).alias("l_end"))


def _asked(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ASKED)], "range_id int, r_start long, r_end long")


def ordinal_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey").between(1000, 1100)).select("o_orderkey", "o_custkey")


def multi_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(ranges.in_any(F.col("o_orderkey"), ASKED)).select("o_orderkey", "o_orderstatus")


def interval_overlap_join(spark, sf_dir):
    return ranges.overlap_join(_intervals(spark, sf_dir), _asked(spark), 64).select("range_id", "l_start", "l_end")


def point_in_range_join(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"), "o_custkey")
    return ranges.point_join(points, _asked(spark), 64).select("range_id", "point", "o_custkey")


def span_weight_best(spark, sf_dir):
    spans = _intervals(spark, sf_dir)
    return spans.groupBy("o_custkey").agg(F.round(F.max(1.0 / (F.col("l_end") - F.col("l_start") + 1)), 6).alias("best"))


def related_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return ranges.expand_edges(edges, [(10, 30), (70, 75)], 40)


def parallel_pivot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).select("l_orderkey", *(F.round(c, 4).alias(f"qty_{c.lower()}") for c in "ANR"))


def nested_collect(spark, sf_dir):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    shown = F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_suppkey"].cast("string")))
    return rows.select("l_orderkey", F.array_join(shown, ",").alias("lines"))


def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def dimension_join(spark, sf_dir):
    """Customers under their nation and region: the small dimensions join by broadcast as the planner sees fit."""
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(_n("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def fallback_join(spark, sf_dir):
    """A part's supplier of the same key, else supplier 0, else none: two left joins and coalesce."""
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    exact = parts.join(suppliers.withColumnRenamed("s_name", "exact_name"), F.col("p_partkey") == F.col("s_suppkey"), "left").drop("s_suppkey")
    loose = exact.join(suppliers.withColumnRenamed("s_name", "loose_name"), F.col("p_partkey") % 100 == F.col("s_suppkey"), "left")
    return loose.select("p_partkey", F.coalesce("exact_name", "loose_name").alias("supplier"), F.col("exact_name").isNotNull().alias("exact"))


def denorm_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


def neighbors_context(spark, sf_dir):
    """Turns beside the longest turn of each conversation, each claimed once."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    hits = windows.first_per(turns, ["conv_id"], [F.desc("chars"), "turn"], 2)
    hit_rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("chars"), "turn"))
    return ranges.neighbours(turns, hits.select("conv_id", "turn", hit_rank.alias("hit_rank")), "conv_id", "turn", 1).select("conv_id", "turn", F.col("hit_rank").cast("long").alias("hit_rank"))


def concordance(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("source", F.explode(T.words(F.col("text"))).alias("word"))
    return words.filter(F.col("word").isin("with", "from", "this", "der", "les")).groupBy("word", "source").agg(_n("n"))


def facets_grouping_sets(spark, sf_dir):
    return groups.facets(table(spark, sf_dir, "documents").filter(F.lower("text").contains("with")), ["source", "lang"])


def forms_two_stage(spark, sf_dir):
    """Raw forms counted, then merged without the punctuation around them."""
    raw = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("form")).groupBy("form").agg(_n("n"))
    bare = F.regexp_replace(F.lower("form"), r"^[.,;:!?|]+|[.,;:!?|]+$", "")
    return raw.groupBy(bare.alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("variants")).filter("n >= 50 AND form <> ''")


def conditional_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(_n("n"), F.count_if(F.col("toxic") == 1).alias("toxic_n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good_n")).filter("n > 0")


def distinct_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("l_partkey").alias("parts"))


def alias_rollup(spark, sf_dir):
    alias = F.when(F.col("source").isin("src1", "src10", "src11"), "group-a").when(F.col("source").isin("src2", "src12"), "group-b").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").groupBy(alias.alias("journal")).agg(_n("n"), F.sum("n_chars").alias("chars"))


def vote_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return groups.shares(orders, "o_custkey", "o_totalprice", [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey", F.round("share", 4).alias("share"))


def lang_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(T.detect_language(F.col("text")), F.lit("?")).alias("detected"))


def lang_vote_by_source(spark, sf_dir):
    """The language that 60 % of a source's decided documents have."""
    votes = table(spark, sf_dir, "documents").select("source", T.detect_language(F.col("text")).alias("lang"))
    votes = votes.groupBy("source", "lang").agg(F.count("lang").alias("n")).filter("n > 0")  # a filter on the language itself would tell it twice
    share = votes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return share.filter("share >= 0.6").select("source", "lang", F.round("share", 6).alias("share"))


def running_headers(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select("source", "doc_id", T.header_key(F.split("text", "\n")[0]).alias("header_key"))
    return groups.running_headers(first, ["source"], 2)


def hash_duplicates(spark, sf_dir):
    return groups.duplicate_groups(table(spark, sf_dir, "documents"), F.md5("text"))


def author_merge(spark, sf_dir):
    """Authors, written "Last, First" or "First Last", merged by folded last and first name; a form without comma stands, of most rows."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    last, given = F.initcap(F.split_part("c_mktsegment", F.lit(" "), F.lit(1))), F.regexp_replace("n_name", "[^A-Za-z]", "")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(", ", F.upper(last), given)).when(F.col("c_custkey") % 3 == 1, F.concat_ws(" ", given, last)).otherwise(F.concat_ws(" ", given, F.lower(last)))
    forms = people.groupBy(name.alias("name")).agg(_n("n")).withColumn("key", T.name_key(F.col("name")))
    best = F.min_by("name", F.struct(F.contains("name", F.lit(",")), -F.col("n"), "name"))
    return forms.groupBy("key").agg(best.alias("name"), F.sum("n").alias("n"), F.count("*").alias("forms"))


def macro_means(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic_share = F.when(F.col("quality") == 1, F.col("toxic"))
    means = groups.macro_means(docs.select("lang", "quality", toxic_share.alias("toxic_if_good"), "n_chars"), ["lang"], ["quality", "toxic_if_good", "n_chars"])
    return means.select("lang", "metric", F.round("mean", 6).alias("mean"), "n")


def latency_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("p50"), F.round(F.max("value"), 6).alias("most"), _n("n"))


def passage_concat(spark, sf_dir):
    """Passages of 3 turns, a last one under 2 joined to the one before, with their text."""
    turns = windows.grouped_rows(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3, 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n")
    return turns.groupBy("conv_id", "passage").agg(_n("turns"), F.md5(joined).alias("text_md5"))


def first_per_key(spark, sf_dir):
    return windows.first_per(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def prev_next(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(order).alias("prev_key"), F.lead("o_orderkey").over(order).alias("next_key"))


def first_occurrence_order(spark, sf_dir):
    """Parts in order of their first order, with their first six orders."""
    firsts = windows.first_per(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct(), ["l_partkey"], ["l_orderkey"], 6)
    lines = firsts.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"), F.array_sort(F.collect_list("l_orderkey")).alias("o"))
    return lines.select("l_partkey", "first_order", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("orders"))


def cap_per_name(spark, sf_dir):
    return windows.first_per(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 2)


def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string"))).alias("h"))
    return windows.first_per(docs, ["source"], ["h", "doc_id"], 3).select("source", "doc_id")


def carry_forward(spark, sf_dir):
    """The last large order so far of each customer."""
    large = F.when(F.col("o_totalprice") > 300000, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.carry_forward(large, ["o_custkey"], ["o_orderdate", "o_orderkey"]).alias("last_large"))


def _two_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'").select("source", "lang"), docs.filter("n_chars > 4000").select("source", "lang")


def set_union(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return a.union(b).distinct()


def set_intersect(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return a.intersect(b)


def set_diff(spark, sf_dir):
    a, b = _two_sets(spark, sf_dir)
    return b.subtract(a)


def fold_accents(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"), "[^ \n.,|]+")).alias("word")).filter(F.col("word").rlike("[à-ÿ]"))
    return words.groupBy(T.fold_accents(F.col("word")).alias("folded")).agg(_n("n"), F.countDistinct("word").alias("forms"))


def canonical_translit(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"), "[^ \n.,|]+")).alias("word")).distinct()
    return words.select("word", T.canonical_translit(F.col("word")).alias("key"))


def clean_text(spark, sf_dir):
    """Texts with some words split at line ends, cleaned."""
    broken = F.regexp_replace("text", r"([a-z]{4})([a-z]{4} )", "$1-\n$2 \t")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(broken)).alias("text_md5"))


def quote_exact(spark, sf_dir):
    return verify.exact_quotes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quote_fuzzy(spark, sf_dir):
    """Benchmark items, one word changed, against every document that shares three words in a row with them."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    quotes = items.select(F.col("item_id").alias("quote_id"), F.regexp_replace("text", "^(\\S+) \\S+", "$1 other").alias("quote"))
    return verify.check_all_quotes(quotes, docs.select("doc_id", F.col("text").alias("source")))


def citation_markers(spark, sf_dir):
    """References of markers with lists and ranges."""
    ids = F.concat(F.lit("As said [P"), F.col("event_id") % 9, F.lit(", "), F.col("event_id") % 4, F.lit("–"), F.col("event_id") % 4 + 2, F.lit("] and ["), F.col("user_id"), F.lit("; A7]."))
    found = table(spark, sf_dir, "events").select("event_id", verify.markers(ids).alias("m"))
    return found.select("event_id", F.array_join("m", " ").alias("markers"))


def fuzzy_dedup(spark, sf_dir):
    """Names of parts whose sequence ratio is 0.8 or more, each pair of different names once."""
    return verify.near_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 0.8)


def license_rules(spark, sf_dir):
    label = T.license_label(F.concat(F.lit("Licensed under "), F.element_at(F.array(*map(F.lit, ("CC BY-NC-ND 4.0", "CC-BY-SA", "CC0", "public domain", "all rights reserved"))), (F.col("doc_id") % 5 + 1).cast("int"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(label, F.lit("none")).alias("label"))
    return docs.groupBy("label", T.translation_allowed(F.col("label"), F.lit("open")).alias("allowed")).agg(_n("n"))


def noise_rules(spark, sf_dir):
    text = F.col("text")
    reason = F.when(text.rlike("[%&#$*]{3}"), "symbols").when(text.contains(" | "), "table").when(F.length(text) < 200, "short").otherwise("keep")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


def json_extract(spark, sf_dir):
    """The object that an answer holds between words and code fences."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    k = F.get_json_object(T.json_block(answer), "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def acl_filter(spark, sf_dir):
    visible = access.document_access(F.when(F.col("lang") == "en", "open").when(F.col("lang") == "de", "personal").otherwise("private"), F.col("source"), ["open"], "src3")
    return table(spark, sf_dir, "documents").filter(visible).select("doc_id", "lang", "source")


def rate_windows(spark, sf_dir):
    """Requests within one an hour and user."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events.select("event_id", (F.row_number().over(order) <= 1).alias("allowed"))


def sessions(spark, sf_dir):
    """Sessions of users with gaps of over 6 hours between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long")  # the nearest
    gap = F.col("second") - F.lag("second").over(order)
    marked = table(spark, sf_dir, "events").withColumn("second", second).withColumn("s", F.sum(F.when(gap > 6 * 3600, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", F.col("s").alias("session")).agg(_n("n"))


def revision_guard(spark, sf_dir):
    """The state of each user's latest event of each kind; older results that come late do not count."""
    key = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", key).alias("event_id"), F.round(F.max_by("value", key), 6).alias("value"))


def export_bibtex(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("part"), F.col("p_partkey"))
    fields = {"title": F.col("p_name"), "publisher": F.concat(F.lit("{"), F.col("p_brand"), F.lit("}")), "note": F.lit(""), "year": F.col("p_size") + 1950}
    return part.select("p_partkey", writers.bibtex_entry("book", key, fields).alias("entry"))


def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), _n("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ordinal_range, multi_range, interval_overlap_join, point_in_range_join, span_weight_best, related_edges, parallel_pivot, nested_collect, semi_join, anti_join, dimension_join,
        fallback_join, denorm_sets, neighbors_context, concordance, facets_grouping_sets, forms_two_stage, conditional_counts, distinct_counts, alias_rollup, vote_share, lang_vote,
        lang_vote_by_source, running_headers, hash_duplicates, author_merge, macro_means, latency_summary, passage_concat, first_per_key, prev_next, first_occurrence_order, cap_per_name,
        stratified_sample, carry_forward, set_union, set_intersect, set_diff, fold_accents, canonical_translit, clean_text, quote_exact, quote_fuzzy, citation_markers, fuzzy_dedup,
        license_rules, noise_rules, json_extract, acl_filter, rate_windows, sessions, revision_guard, export_bibtex, pricing_summary,
    )
}

_ASKED = "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(ASKED)) + ") AS a(range_id, r_start, r_end)"
_SPANS = "(SELECT o_custkey, o_orderkey AS l_start, o_orderkey + CAST(trunc(o_totalprice) AS BIGINT) % 50 AS l_end FROM orders)"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


def _stop(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in T.STOP_WORDS[lang])
    return f"len(list_filter(w, lambda x: x IN ({listed})))"


VOTE = f"""
w AS (SELECT doc_id, source, string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿœ]+') AS w FROM documents),
h AS ({' UNION ALL '.join(f"SELECT doc_id, source, '{lang}' AS lang, {_stop(lang)} AS n FROM w" for lang in T.STOP_WORDS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS i FROM h),
v AS (SELECT a.doc_id, a.source, CASE WHEN a.n >= 5 AND a.n >= 1.5::DOUBLE * greatest(b.n, 1) THEN a.lang END AS lang FROM r a JOIN r b ON a.doc_id = b.doc_id WHERE a.i = 1 AND b.i = 2)"""


def _rewritten(column: str) -> str:
    for a, b in T.REWRITES:
        column = f"replace({column}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        column = f"regexp_replace({column}, '{c}+', '{c}', 'g')"
    return f"regexp_replace({column}, 'h$', '')"


_SETS = "(SELECT source, lang FROM documents WHERE lang = 'en') {op} (SELECT source, lang FROM documents WHERE n_chars > 4000)"

ORACLE_SQL = {
    "ordinal_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1100",
    "multi_range": "SELECT o_orderkey, o_orderstatus FROM orders WHERE " + " OR ".join(f"o_orderkey BETWEEN {a} AND {b}" for a, b in ASKED),
    "interval_overlap_join": f"SELECT range_id, l_start, l_end FROM {_SPANS} s JOIN {_ASKED} ON l_start <= r_end AND l_end >= r_start",
    "point_in_range_join": f"SELECT range_id, o_orderkey AS point, o_custkey FROM orders JOIN {_ASKED} ON o_orderkey BETWEEN r_start AND r_end",
    "span_weight_best": f"SELECT o_custkey, round(max(1.0::DOUBLE / (l_end - l_start + 1)), 6) AS best FROM {_SPANS} s GROUP BY o_custkey",
    "related_edges": """
WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight FROM lineitem WHERE (l_partkey BETWEEN 10 AND 30 OR l_partkey BETWEEN 70 AND 75)
  AND NOT (l_suppkey BETWEEN 10 AND 30 OR l_suppkey BETWEEN 70 AND 75))
SELECT src, dst, weight FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) = 1) ORDER BY weight DESC, src, dst LIMIT 40""",
    "parallel_pivot": "SELECT l_orderkey, " + ", ".join(f"round(sum(l_quantity) FILTER (WHERE l_returnflag = '{c}'), 4) AS qty_{c.lower()}" for c in "ANR") + " FROM lineitem GROUP BY l_orderkey",
    "nested_collect": """
SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lines FROM lineitem GROUP BY l_orderkey""",
    "semi_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "anti_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "dimension_join": """
SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "fallback_join": """
SELECT p_partkey, coalesce(a.s_name, b.s_name) AS supplier, a.s_name IS NOT NULL AS exact FROM part LEFT JOIN supplier a ON p_partkey = a.s_suppkey LEFT JOIN supplier b ON p_partkey % 100 = b.s_suppkey""",
    "denorm_sets": "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey",
    "neighbors_context": """
WITH t AS (SELECT conv_id, turn, length(text) AS chars FROM conversations), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chars DESC, turn) AS hit_rank FROM t QUALIFY hit_rank <= 2)
SELECT t.conv_id, t.turn, min(h.hit_rank) AS hit_rank FROM t JOIN h ON t.conv_id = h.conv_id AND abs(t.turn - h.turn) = 1
WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = t.conv_id AND x.turn = t.turn) GROUP BY t.conv_id, t.turn""",
    "concordance": f"SELECT word, source, count(*) AS n FROM (SELECT source, unnest({_WORDS}) AS word FROM documents) WHERE word IN ('with', 'from', 'this', 'der', 'les') GROUP BY word, source",
    "facets_grouping_sets": """
WITH d AS (SELECT source, lang FROM documents WHERE contains(lower(text), 'with'))
SELECT 'source' AS facet, source AS value, count(*) AS n FROM d GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM d GROUP BY lang""",
    "forms_two_stage": r"""
WITH r AS (SELECT form, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS form FROM documents) GROUP BY form)
SELECT regexp_replace(lower(form), '^[.,;:!?|]+|[.,;:!?|]+$', '', 'g') AS form, CAST(sum(n) AS BIGINT) AS n, count(*) AS variants FROM r GROUP BY 1 HAVING sum(n) >= 50 AND regexp_replace(lower(form), '^[.,;:!?|]+|[.,;:!?|]+$', '', 'g') <> ''""",
    "conditional_counts": """
SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic_n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS good_n FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "distinct_counts": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "alias_rollup": """
SELECT CASE WHEN source IN ('src1', 'src10', 'src11') THEN 'group-a' WHEN source IN ('src2', 'src12') THEN 'group-b' ELSE source END AS journal, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""",
    "vote_share": """
SELECT o_custkey, o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS share FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5""",
    "lang_vote": f"WITH {VOTE} SELECT doc_id, coalesce(lang, '?') AS detected FROM v",
    "lang_vote_by_source": f"""
WITH {VOTE}, c AS (SELECT source, lang, count(*) AS n FROM v WHERE lang IS NOT NULL GROUP BY source, lang), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM c)
SELECT source, lang, round(share, 6) AS share FROM s WHERE share >= 0.6""",
    "running_headers": r"""
SELECT source, header_key, count(DISTINCT doc_id) AS n FROM (SELECT source, doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[0-9\s]+', ' ', 'g')) AS header_key FROM documents)
WHERE header_key <> '' GROUP BY source, header_key HAVING count(DISTINCT doc_id) >= 2""",
    "hash_duplicates": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1",
    "author_merge": """
WITH p AS (SELECT c_custkey % 3 AS k, upper(left(split_part(c_mktsegment, ' ', 1), 1)) || lower(substr(split_part(c_mktsegment, ' ', 1), 2)) AS l, regexp_replace(n_name, '[^A-Za-z]', '', 'g') AS g FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT CASE k WHEN 0 THEN upper(l) || ', ' || g WHEN 1 THEN g || ' ' || l ELSE g || ' ' || lower(l) END AS name, lower(l) || '|' || lower(g) AS key, count(*) AS n FROM p GROUP BY 1, 2)
SELECT key, CAST(sum(n) AS BIGINT) AS n, count(*) AS forms, first(name ORDER BY contains(name, ','), n DESC, name) AS name FROM f GROUP BY key""",
    "macro_means": """
WITH d AS (SELECT lang, n_chars, quality, CASE WHEN quality = 1 THEN toxic END AS t FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT lang, 'quality' AS metric, CAST(quality AS DOUBLE) AS v FROM d UNION ALL SELECT lang, 'toxic_if_good', t FROM d UNION ALL SELECT lang, 'n_chars', n_chars FROM d)
SELECT lang, metric, round(avg(v), 6) AS mean, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY lang, metric""",
    "latency_summary": "SELECT event_type, round(median(value), 6) AS p50, round(max(value), 6) AS most, count(*) AS n FROM events GROUP BY event_type",
    "passage_concat": """
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, CASE WHEN i // 3 = (n - 1) // 3 AND (n - 1) // 3 > 0 AND n - (n - 1) // 3 * 3 < 2 THEN i // 3 - 1 ELSE i // 3 END AS passage FROM t)
SELECT conv_id, CAST(passage AS BIGINT) AS passage, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM p GROUP BY conv_id, passage""",
    "first_per_key": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "prev_next": """
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "first_occurrence_order": """
SELECT l_partkey, min(l_orderkey) AS first_order, array_to_string(list_sort(list(DISTINCT l_orderkey))[1:6], ',') AS orders FROM lineitem GROUP BY l_partkey""",
    "cap_per_name": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2",
    "stratified_sample": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7-' || doc_id), doc_id) <= 3",
    "carry_forward": """
SELECT o_orderkey, last_value(CASE WHEN o_totalprice > 300000 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_large FROM orders""",
    "set_union": _SETS.format(op="UNION"),
    "set_intersect": _SETS.format(op="INTERSECT"),
    "set_diff": "(SELECT source, lang FROM documents WHERE n_chars > 4000) EXCEPT (SELECT source, lang FROM documents WHERE lang = 'en')",
    "fold_accents": r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[^ \n.,|]+')) AS word FROM documents)
SELECT strip_accents(word) AS folded, count(*) AS n, count(DISTINCT word) AS forms FROM w WHERE regexp_matches(word, '[à-ÿ]') GROUP BY 1""",
    "canonical_translit": f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[^ \\n.,|]+')) AS word FROM documents)
SELECT word, {_rewritten("regexp_replace(strip_accents(word), '[^a-z]', '', 'g')")} AS key FROM w""",
    "clean_text": r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '([a-z]{4})([a-z]{4} )', '\1-' || chr(10) || '\2 ' || chr(9), 'g') AS t FROM documents),
j AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '([a-ząćęłńóśźż.)\]])[0-9]{1,3}(\s|$)', '\1\2', 'g') AS t FROM b)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text_md5 FROM j""",
    "quote_exact": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "citation_markers": """
SELECT event_id, array_to_string(refs, ' ') || ' ' || user_id || ' A7' AS markers
FROM (SELECT event_id, user_id, list_prepend('P' || event_id % 9, list_filter(['P' || event_id % 4, 'P' || (event_id % 4 + 1), 'P' || (event_id % 4 + 2)], lambda x: x <> 'P' || event_id % 9)) AS refs FROM events)""",
    "license_rules": """
SELECT CASE doc_id % 5 WHEN 0 THEN 'CC BY-NC-ND' WHEN 1 THEN 'CC BY-SA' WHEN 2 THEN 'CC0' WHEN 3 THEN 'public domain' ELSE 'none' END AS label, doc_id % 5 IN (1, 2, 3) AS allowed, count(*) AS n FROM documents GROUP BY 1, 2""",
    "noise_rules": """
SELECT doc_id, CASE WHEN regexp_matches(text, '[%&#$*]{3}') THEN 'symbols' WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 200 THEN 'short' ELSE 'keep' END AS reason FROM documents""",
    "json_extract": """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS INT)) AS k_max FROM events GROUP BY event_type""",
    "acl_filter": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' OR source = 'src3'",
    "rate_windows": "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events",
    "sessions": """
WITH g AS (SELECT user_id, ts, event_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, session""",
    "revision_guard": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id, event_type",
    "export_bibtex": r"""
SELECT p_partkey, '@book{part' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  publisher = {\{' || p_brand || '\}},' || chr(10) || '  year = {' || (p_size + 1950) || '}' || chr(10) || '}' AS entry FROM part""",
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
}
