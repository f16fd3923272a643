"""Which of many documents may hold a text: meeting by rare words.

A text that may lose or change at most t of its n distinct words keeps at least one of any t + 1 of them, so its t + 1 rarest
words, by the number of documents that hold them, find every document that keeps n - t. Two scans of the documents: the
first counts how many hold each wanted word, the second looks for the chosen ones. In both a Bloom filter of fixed size
stands in front, so only words that are wanted (and one in some thousands besides) leave the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.tables import few, slices, written

#: Bits of the Bloom filter, a power of two (1 MB), and probes of a hash.
BLOOM_BITS, PROBES = 1 << 23, 3
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_hashes(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of ``hashes`` (h) as longs; its bits are set in tasks, and what comes to the driver is bounded by its size."""
    width = BLOOM_BITS.bit_length() - 1
    places = F.array(*[F.shiftrightunsigned("h", k * 20).bitwiseAND(F.lit(BLOOM_BITS - 1)) for k in range(PROBES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    set_bits = hashes.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = set_bits.toArrow()
    out = np.zeros(1 << width - 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def wanted_hashes(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """doc_id, h: the distinct words of ``docs`` (doc_id, hashes) that are among ``hashes`` (h)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(hashes))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches):
            lists = batch.column("hashes")
            h = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            may = np.ones(len(h), bool)
            for k in range(PROBES):
                at = (h.view(np.uint64) >> np.uint64(k * 20)).astype(np.int64) & (BLOOM_BITS - 1)
                may &= bits[at >> 6] >> (at & 63) & 1 == 1
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row[may])), pa.array(h[may])], names=["doc_id", "h"])

    met = docs.select("doc_id", "hashes").mapInArrow(scan, f"doc_id {id_type}, h long")
    return met.join(F.broadcast(hashes) if few(hashes) else hashes, "h", "left_semi")


def rare_word_pairs(asked: DataFrame, docs: DataFrame, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """quote_id, doc_id: ``docs`` (doc_id, text) that hold at least all but ``may_lose`` distinct words of ``asked`` (quote_id, words, may_lose).

    Exactly those: candidates come from the rarest words, and all words are counted then. A word that no document holds counts as
    lost. Both ids tell rows apart; texts without words meet nothing.
    """
    own = written(asked.select("quote_id", "may_lose", F.explode(word_hashes(F.col("words"))).alias("h")), "asked-words")
    hashes = word_hashes(words(F.col("text"))).alias("hashes")
    hashed = docs.select("doc_id", hashes)
    held = written(wanted_hashes(hashed, own.select("h").distinct()).groupBy("h").agg(F.count("*").alias("df")), "word-counts")
    counted = own.join(held, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("quote_id").orderBy("df", "h"))  # a quotation's own words
    size = F.count("*").over(Window.partitionBy("quote_id"))
    seeds = counted.select("quote_id", "h", "df", "may_lose", rank.alias("rank"), size.alias("n"))
    seeds = written(seeds.filter("rank <= may_lose + 1 AND df > 0").select("quote_id", "h", "n", "may_lose"), "seeds")
    found = wanted_hashes(hashed, seeds.select("h").distinct())
    pairs = found.join(F.broadcast(seeds) if few(seeds) else seeds, "h").select("quote_id", "doc_id", "n", "may_lose").distinct()
    pairs = written(pairs, "seed-pairs")
    # all words of a quotation in one row, against those of the documents that it met
    whole = own.groupBy("quote_id").agg(F.collect_list("h").alias("all"))
    some = pairs.join(F.broadcast(whole) if few(whole, 10_000) else whole, "quote_id").join(met_only(docs, pairs).select("doc_id", hashes), "doc_id")
    return some.filter(F.size(F.array_intersect("all", "hashes")) >= F.col("n") - F.col("may_lose")).select("quote_id", "doc_id")


def met_only(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a doc_id among ``pairs``; they alone move."""
    ids = pairs.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if few(ids, 1_000_000) else ids, "doc_id", "left_semi")
