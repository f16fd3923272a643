"""Line dedup across documents (DataFrame functions only).

A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least ``min_chars`` code
points that at least ``min_docs`` documents hold keep their lines in one document, the one of the largest id.

Key hashes of 128 bits are range-partitioned together with a salt from the document, sorted inside by document and
position, and the first occurrence under each (key, salt) streams out with the number of documents; a second, small
aggregation joins the salts of a key, so a line that a third of all documents hold never meets in one task. What comes
back to a document is a bitmap of kept lines (63 to a long, none for documents that keep everything), not text.

Defined cases: a null or empty text is one empty line and stays so (kept text empty); a line repeated inside the keeping
document stays there each time; documents with equal ids count as one holder and keep a line together, but each text loses its own
lines only (bitmaps belong to doc_id and a hash of the text); rows without an id count as one holder, of the smallest id; an
empty table gives an empty result; further input columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import small, staged, table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts of a key: documents of a key spread over so many ranges.
SALTS = 64
#: Kept-line bits in one long of a bitmap.
BITS = 63


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def line_hash(stripped: Column) -> Column:
    key = F.translate(stripped, UPPER, LOWER)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (a hash of the text), pos, a, b (the key) of every line long enough."""
    # the code point test comes first, so that short lines are neither folded nor hashed
    stripped = F.transform(lines(F.col("text")), _stripped)
    kept = F.filter(
        F.transform(stripped, lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(i.alias("pos"), line_hash(x).alias("key")))),
        lambda x: x.isNotNull(),
    )
    each = docs.select("doc_id", text_hash(), F.explode(kept).alias("l"))
    return each.select("doc_id", "t", F.col("l.pos").alias("pos"), F.col("l.key.a").alias("a"), F.col("l.key.b").alias("b"))


def verdicts(occ: DataFrame, min_docs: int, partitions: int) -> DataFrame:
    """a, b, keeper of every key that loses lines."""
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ranged = salted.repartitionByRange(partitions, "a", "b", "salt").sortWithinPartitions("a", "b", "salt", F.desc("doc_id"), "pos")
    group = Window.partitionBy("a", "b", "salt").orderBy(F.desc("doc_id"), "pos")
    another = (F.row_number().over(group) == 1) | ~F.lag("doc_id").over(group).eqNullSafe(F.col("doc_id"))
    fresh = ranged.select("a", "b", "doc_id", another.alias("first"))
    return (
        fresh.filter("first")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("a", "b", "keeper")
    )


def drop_bitmaps(occ: DataFrame, bad: DataFrame) -> DataFrame:
    """doc_id, t, keep: array of (word, bits), the words of the keep bitmap that have a cleared bit."""
    side = F.broadcast(bad) if small(bad) else bad
    gone = occ.join(side, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    word = F.floor(F.col("pos") / BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % BITS).cast("int"))
    words = gone.groupBy("doc_id", "t", word.alias("word")).agg(F.bit_or(bit).alias("drop"))
    return words.groupBy("doc_id", "t").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not(F.col("drop")).bitwiseAND(F.lit(2**BITS - 1)).alias("keep")))).alias("keep")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents' columns doc_id, n_lines, n_dropped, keep (bitmap, null: everything) and kept_text."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    occ = staged(occurrences(docs, min_chars), "line-hashes")
    bad = staged(verdicts(occ, min_docs, partitions), "line-verdicts")
    # always by shuffle: the bitmaps grow with the documents
    maps = staged(drop_bitmaps(occ, bad), "line-bitmaps").withColumnsRenamed({"doc_id": "_id", "t": "_t"}).hint("merge")
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    joined = docs.select("doc_id", "text", text_hash()).join(maps, own, "left").withColumn("_lines", lines(F.col("text")))
    whole = F.lit(2**BITS - 1)

    def stays(_, i: Column) -> Column:
        words = F.coalesce(F.col("keep")[F.floor(i / BITS).cast("int")], whole)
        return F.call_function("shiftright", words, (i % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1

    kept = F.when(F.col("keep").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays))
    return (
        joined.withColumn("_kept", kept)
        .select(
            "doc_id",
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
            "keep",
            F.array_join("_kept", "\n").alias("kept_text"),
        )
    )


def op7_line_dedup(spark, sf_dir):
    """Lines of at least 40 code points in at least 5 ``documents`` stay in the largest doc_id only."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
v AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, v.key IS NULL OR v.keeper = k.doc_id AS stays FROM k LEFT JOIN v ON k.key = v.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
