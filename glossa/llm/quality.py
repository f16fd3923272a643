"""Quality rules with thresholds that follow the data (DataFrame functions only).

Base rules reject short and repetitive texts. Beyond them there is no fixed cutoff: each measure (mean word length, symbols a
word, share of repeated lines, share of repeated words) is judged against its distribution in the document's own language and
source. A distribution is a quantile sketch: counts in buckets whose width is 1/512 of their value or less, so sketches of parts merge
by adding counts, in any order, and reruns agree. A group of few documents takes the sketch merged over its language's sources, a
language of few documents the one over everything. A document stays if every measure lies within ``FENCE`` times the spread
of the middle half (never less than the measure's least spread) beyond the quartiles. Thresholds come back to documents by a join.

Nothing is exploded by word: windows of three words are hashed in the row, and only rows with equal hashes sort them.

Defined cases: a null or empty text has no words and fails the base rules; a null language or source is a group of its own;
equal doc_ids are judged row by row; documents that fail the base rules do not enter the sketches; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import small, staged, table

SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Base rules: least number of words, and largest share of repeated words in per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Measures in thousandths, and the least spread that counts for each.
MEASURES = {"word_length": 100, "symbol_share": 50, "dup_line_share": 150, "repeat_share": 150}
#: Spreads beyond the quartiles that are still accepted, documents below which a group takes a merged sketch, bits of a bucket.
FENCE, LEAST_GROUP, BITS = 3, 200, 10


def _shared(column: str, of: str) -> Column:
    """``column`` in thousandths of ``of``, as a whole number."""
    return F.when(F.col(of) > 0, F.floor(F.col(column) * 1000 / F.col(of))).otherwise(0).cast("long")


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows of three whose hash comes twice or more; ``hashes`` has one entry per window."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    # a one-element transform binds a value once, where a plain reference would compute it again for each element
    bound = F.transform(F.array(placed), starts)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.transform(bound, covered)[0])


def measured(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the columns ``by``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    cut = docs.select("doc_id", *by, F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words.alias("_words"), lines.alias("_lines"))
    window = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    hashed = cut.select("*", F.slice(window, 1, F.greatest(F.size("_words") - 2, F.lit(0))).alias("_windows"))
    return hashed.select(
        "doc_id",
        *by,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
    )


def bucket(value: Column) -> Column:
    """Bucket of a whole number of at least 0: itself below 2^BITS, else its leading BITS bits and the number of the others."""
    shift = F.greatest(F.char_length(F.bin(value)) - BITS, F.lit(0))
    return (F.call_function("shiftleft", shift, F.lit(BITS - 1)) + F.call_function("shiftright", value, shift)).cast("long")


def bucket_value(at: Column) -> Column:
    """The least number in a bucket."""
    shift = F.greatest(F.shiftright(at, BITS - 1) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", at - F.call_function("shiftleft", shift.cast("long"), F.lit(BITS - 1)), shift)


def sketches(base: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The columns ``by``, measure, bucket, n: mergeable quantile sketches of all measures, summed map-side first."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return base.select(*by, each.alias("_m")).groupBy(*by, "_m.measure", "_m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The columns ``by``, measure, rows, low, high: quartiles of the sketch merged over all but ``by``."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select("*", upto.alias("upto"), F.sum("n").over(whole).alias("rows"))
    value = bucket_value(F.col("bucket"))
    return ranked.groupBy(*by, "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), value)).alias("low"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, value)).alias("high"),
    )


def thresholds(sketch: DataFrame, by: tuple[str, ...], least_group: int = LEAST_GROUP) -> DataFrame:
    """The columns ``by`` and for each measure its least and largest accepted value, one row per group.

    Groups with fewer than ``least_group`` documents take the quartiles of the sketch merged over all but the first column.
    """
    levels = [quartiles(sketch, by[:n]).withColumnsRenamed({c: f"_{n}{c}" for c in (*by[:n], "rows", "low", "high")}) for n in range(len(by), -1, -1)]
    found = levels[0].withColumnsRenamed({f"_{len(by)}{c}": c for c in by})
    for n in range(len(by) - 1, -1, -1):
        level = levels[len(by) - n].withColumnRenamed("measure", f"_{n}measure")
        same = F.col("measure") == F.col(f"_{n}measure")
        for c in by[:n]:
            same &= F.col(c).eqNullSafe(F.col(f"_{n}{c}"))
        found = found.join(level, same)
    picked = F.struct(F.col("_0low").alias("low"), F.col("_0high").alias("high"))
    for n in range(1, len(by) + 1):
        picked = F.when(F.col(f"_{n}rows") >= least_group, F.struct(F.col(f"_{n}low").alias("low"), F.col(f"_{n}high").alias("high"))).otherwise(picked)
    found = found.select(*by, "measure", picked.alias("_q"))
    out = []
    for m, least in MEASURES.items():
        here = F.col("measure") == m
        spread = F.greatest(F.col("_q.high") - F.col("_q.low"), F.lit(least)) * FENCE
        out += [F.max(F.when(here, F.col("_q.low") - spread)).alias(f"{m}_least"), F.max(F.when(here, F.col("_q.high") + spread)).alias(f"{m}_most")]
    return found.groupBy(*by).agg(*out)


def judged(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), least_group: int = LEAST_GROUP) -> DataFrame:
    """What ``measured`` gives, the measures in thousandths, base_failed, each threshold, and kept, for every document."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    shares = {
        "word_length": _shared("word_chars", "n_words"),
        "symbol_share": _shared("n_symbols", "n_words"),
        "dup_line_share": _shared("n_dup_lines", "n_lines"),
        "repeat_share": _shared("n_repeat_words", "n_words"),
    }
    base = staged(measured(docs, by).withColumn("base_failed", failed).withColumns(shares), "quality")
    sketch = staged(sketches(base.filter(~F.col("base_failed")), by), "quality-sketch")
    limits = staged(thresholds(sketch, by, least_group), "quality-limits").withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = ~F.col("base_failed")
    for m in MEASURES:
        within &= F.coalesce(F.col(m).between(F.col(f"{m}_least"), F.col(f"{m}_most")), F.lit(False))
    return base.join(F.broadcast(limits) if small(limits) else limits, same, "left").drop(*(f"_{c}" for c in by)).withColumn("kept", within)


def op13_quality_rules(spark, sf_dir):
    """Every document of ``documents`` by the base rules and by thresholds of its language and source."""
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLE_SQL = {
    "op13_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, w, CAST(w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS INT) AS again FROM g),
c AS (SELECT r, w, greatest(again, lag(again, 1, 0) OVER o, lag(again, 2, 0) OVER o) AS covered FROM s WINDOW o AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(covered) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT t.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
         FROM t LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
m AS (SELECT r, lang, source, unnest([1, 2, 3, 4]) AS measure,
             unnest([word_chars * 1000 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words]) AS value
      FROM judged WHERE NOT base_failed),
b AS (SELECT *, greatest(length(bin(value)) - 10, 0) AS shift FROM m),
k AS (SELECT lang, source, measure, (value >> shift) << shift AS value FROM b),
q AS (SELECT 2 AS level, lang, source, measure, count(*) AS n, quantile_disc(value, 0.25) AS low, quantile_disc(value, 0.75) AS high FROM k GROUP BY lang, source, measure
      UNION ALL SELECT 1, lang, NULL, measure, count(*), quantile_disc(value, 0.25), quantile_disc(value, 0.75) FROM k GROUP BY lang, measure
      UNION ALL SELECT 0, NULL, NULL, measure, count(*), quantile_disc(value, 0.25), quantile_disc(value, 0.75) FROM k GROUP BY measure),
best AS (SELECT a.lang, a.source, a.measure,
                CASE WHEN a.n >= 200 THEN a.low WHEN x.n >= 200 THEN x.low ELSE y.low END AS low,
                CASE WHEN a.n >= 200 THEN a.high WHEN x.n >= 200 THEN x.high ELSE y.high END AS high
         FROM q a JOIN q x ON a.level = 2 AND x.level = 1 AND a.lang IS NOT DISTINCT FROM x.lang AND a.measure = x.measure
         JOIN q y ON y.level = 0 AND y.measure = a.measure),
limits AS (SELECT lang, source, measure, low - 3 * greatest(high - low, [100, 50, 150, 150][measure]) AS least,
                  high + 3 * greatest(high - low, [100, 50, 150, 150][measure]) AS most FROM best),
verdict AS (SELECT r, bool_and(value BETWEEN least AND most) AS fits FROM m JOIN limits l
            ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source AND m.measure = l.measure GROUP BY r)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, coalesce(fits, false) AS kept
FROM judged LEFT JOIN verdict USING (r)
"""
}
