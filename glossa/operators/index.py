"""A word index as a table, BM25 over it, and retrieval in several channels with access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import bitmaps, corpus, windows
from glossa.operators.search import K1, B
from glossa.tables import few, slices

#: Folders of the index; a search reads those of its terms only.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(docs: DataFrame) -> DataFrame:
    """bucket, term, docs, tfs, lens: the words of ``docs`` (doc_id, text), one row for each word of some hundred texts, so that a word moves once for many of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = pc.split_pattern_regex(batch.column("low"), "[^a-z]+")
            words, row = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
            real = pc.not_equal(words, "")
            coded, row = words.filter(real).dictionary_encode(), row[real.to_numpy(zero_copy_only=False)]
            n = batch.num_rows
            length = np.bincount(row, minlength=n).astype(np.int32)
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + row, return_counts=True)
            term, row = np.divmod(pairs, n)
            ends = pa.array(np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term)).astype(np.int32))
            lists = (batch.column("doc_id").take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row]))
            yield pa.record_batch([coded.dictionary, *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=["term", "docs", "tfs", "lens"])

    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return low.mapInArrow(count, f"term string, docs array<{kind}>, tfs array<int>, lens array<int>").withColumn("bucket", bucket(F.col("term")))


def _opened(blocks: DataFrame) -> DataFrame:
    each = blocks.select("bucket", "term", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("p"))
    return each.select("bucket", "term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.lens").alias("len"))


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    """``rows`` (bucket, ..) dealt by bucket and a part of ``by``, so one word that every document has goes to many tasks."""
    parts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    return rows.repartition(BUCKETS * parts, "bucket", F.pmod(F.xxhash64(by), F.lit(parts)))


def postings(docs: DataFrame) -> DataFrame:
    """bucket, term, doc_id, tf, len of the words (of a to z, lower-cased) of ``docs`` (doc_id, text); ids are unique. Nothing moves."""
    return _opened(_blocks(docs))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or none with files
            return None
        raise


class Words:
    """A word index below ``path``: postings, documents, tombstones, and the runs that wrote them. One writer at a time.

    Every change is a run of its own number. Its postings are dealt by bucket and parts of the documents, so one word that every
    document has is written by many tasks, and the terms of a file lie together. A tombstone says that a document's rows of all earlier
    runs are dead, so replacing one is a run with its tombstone and its new rows. A row of totals, written last, makes a run count: what
    a lost run left is never read. ``compact`` writes all live rows as one run, after which the runs before it are not read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def runs(self) -> DataFrame | None:
        """run, seq, kind, n, words, dead_n, dead_words of the runs that count: a row a change."""
        every = _read(self.spark, f"{self.path}/runs")
        if every is None:
            return None
        base = every.agg(F.coalesce(F.max(F.when(F.col("kind") == "compact", F.col("seq"))), F.lit(0)).alias("base"))
        return every.join(F.broadcast(base), F.col("seq") >= F.col("base")).drop("base")

    def _of_runs(self, table: str) -> DataFrame | None:
        rows, runs = _read(self.spark, f"{self.path}/{table}"), self.runs()
        return None if rows is None or runs is None else rows.join(F.broadcast(runs.select("run", "seq")), "run")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` (doc_id, seq, ..) that no later run's tombstone kills."""
        dead = self._of_runs("tombstones")
        if dead is None:
            return rows
        dead = dead.groupBy("doc_id").agg(F.max("seq").alias("dead"))
        return rows.join(F.broadcast(dead) if few(dead, 1_000_000) else dead, "doc_id", "left").filter("dead IS NULL OR dead <= seq").drop("dead")

    def documents(self) -> DataFrame | None:
        """doc_id, len, run, seq of the documents that the index holds."""
        rows = self._of_runs("documents")
        return None if rows is None else self._live(rows)

    def _commit(self, kind: str, run: str, new: DataFrame | None, dead: DataFrame | None) -> None:
        """``new`` (bucket, term, doc_id, tf, len), dealt, is written; ``dead`` are the ids whose earlier rows go."""
        held, runs = self.documents(), self.runs()
        lost = held.join(dead, "doc_id", "left_semi") if dead is not None and held is not None else None
        totals = (lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first() if lost is not None else None) or {"n": 0, "words": 0}
        if dead is not None:
            dead.select("doc_id", F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/tombstones")
        if new is not None:
            self._write_postings(new, run)
        seq = (runs.agg(F.max("seq")).first()[0] if runs is not None else 0) + 1
        added = _read(self.spark, f"{self.path}/documents")
        size = (F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("words"))
        got = added.filter(F.col("run") == run).agg(*size).first() if added is not None else {"n": 0, "words": 0}
        row = [(run, seq, kind, got["n"], got["words"], totals["n"], totals["words"])]
        done = self.spark.createDataFrame(row, "run string, seq long, kind string, n long, words long, dead_n long, dead_words long")
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def _write_postings(self, rows: DataFrame, run: str) -> None:
        rows.sortWithinPartitions("bucket", "term", "doc_id").withColumn("run", F.lit(run)).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _write_documents(self, docs: DataFrame, run: str) -> None:
        length = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"))
        docs.select("doc_id", length.alias("len"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/documents")

    def add(self, docs: DataFrame) -> None:
        """Those of ``docs`` (doc_id, text) that the index does not hold."""
        run, new, held = uuid.uuid4().hex, docs.select("doc_id", "text"), self.documents()
        if held is not None:
            new = new.join(held, "doc_id", "left_anti")
        # documents are written last, as what is new is told by them
        self._write_postings(_opened(_dealt(_blocks(new), F.col("docs")[0])), run)
        self._write_documents(new, run)
        self._commit("add", run, None, None)

    def replace(self, docs: DataFrame) -> None:
        """``docs`` (doc_id, text) in place of what the index holds of these ids, and new ones besides."""
        run, new = uuid.uuid4().hex, docs.select("doc_id", "text")
        self._write_documents(new, run)
        self._commit("add", run, _opened(_dealt(_blocks(new), F.col("docs")[0])), new.select("doc_id").distinct())

    def delete(self, ids: DataFrame) -> None:
        """The documents of ``ids`` (doc_id) are held no more."""
        self._commit("delete", uuid.uuid4().hex, None, ids.select("doc_id").distinct())

    def compact(self) -> None:
        """All live rows as one run, sorted anew; no text is needed. What they were merged from stays on disk until it is removed."""
        rows, held = self._of_runs("postings"), self.documents()
        if rows is None or held is None:
            return
        run = uuid.uuid4().hex
        live = self._live(rows).select("bucket", "term", "doc_id", "tf", "len")
        held.select("doc_id", "len", F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/documents")
        self._commit("compact", run, _dealt(live, F.col("doc_id")), None)

    def missing(self, stored: DataFrame) -> DataFrame:
        """doc_id, stored, indexed: documents of ``stored`` (doc_id, stored words) whose words in the index are not as many; 0 where it has none."""
        held = self.documents()
        indexed = self.spark.createDataFrame([], "doc_id long, indexed long") if held is None else held.select("doc_id", F.col("len").cast("long").alias("indexed"))
        both = stored.join(indexed, "doc_id", "left").withColumn("indexed", F.col("indexed"))
        return both.filter(~F.col("stored").eqNullSafe(F.col("indexed"))).select("doc_id", "stored", F.coalesce("indexed", F.lit(0)).alias("indexed"))

    def bm25(self, terms: list[str], allowed: DataFrame | None = None) -> DataFrame:
        """doc_id, bm25 of the documents that hold any of ``terms``; only folders of these terms are read.

        ``allowed`` (``bitmaps.allowed``) keeps other documents out before anything is scored; how rare a word is goes by all documents.
        """
        totals = self.runs().agg((F.sum("n") - F.sum("dead_n")).alias("n"), ((F.sum("words") - F.sum("dead_words")) / (F.sum("n") - F.sum("dead_n"))).alias("avg"))
        asked = self._of_runs("postings").filter(F.col("bucket").isin([bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms))
        found = self._live(asked)
        df = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))  # a row a term
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        if allowed is not None:
            found = bitmaps.keep(found, allowed)
        return found.join(df, "term").join(F.broadcast(totals)).groupBy("doc_id").agg(F.sum(score).alias("bm25"))


def index_words(docs: DataFrame, path: str) -> None:
    """Add to the index at ``path`` those of ``docs`` (doc_id, text) that it does not hold."""
    Words(docs.sparkSession, path).add(docs)


def bm25_indexed(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """doc_id, bm25 of the documents of the index that hold any of ``terms``."""
    return Words(spark, path).bm25(terms)


def retrieve(channels: list[DataFrame], documents: DataFrame, allowed: Column, k: int, pool: int, score: Column | None = None) -> DataFrame:
    """The ``k`` best documents, with rank, of several ``channels`` (id, score), among those of ``documents`` (id, ..) that are ``allowed``.

    Access is told by the documents as they are now, before any channel is cut to its ``pool`` best, so what is closed or gone takes no
    place. Ranks are fused; the pool is ordered anew by ``score``, of columns of ``documents``, where that is given.
    """
    now = documents.filter(allowed)
    lists = [
        windows.ranked(c.join(now.select("id"), "id", "left_semi"), [F.desc("score"), "id"], pool).select("id", F.lit(i).alias("list_id"), "rank")
        for i, c in enumerate(channels)
    ]
    fused = windows.fuse(reduce(DataFrame.unionByName, lists)).select("id", F.round("score", 8).alias("fused"))
    best = windows.ranked(fused, [F.desc("fused"), "id"], pool)
    found = now.join(F.broadcast(best), "id").withColumn("query_id", F.lit(0))  # as many as the pool
    return corpus.rerank(found, F.lit(None).cast("double") if score is None else score, k).drop("query_id")
