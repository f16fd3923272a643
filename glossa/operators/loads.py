"""Replacing the texts of works, and lexicons, while others read.

A work's rows lie in a folder of their own, one for each load. A load writes its rows first and then one small row of the next version,
which names the works and the load that now holds each; readers take a version, the newest or one that they keep, and read the folders
it names. So a reader never sees half a load, what a lost one left is never read, and an old version stays whole.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions.references import ordinal
from glossa.operators.index import _read
from glossa.tables import few, written

# Widths of the token fields.
WIDTHS = {"surface": 64, "lemma": 64, "strong": 12, "morph": 32, "pos": 8, "prefixes": 16}
NORMAL = 64
#: Loads that a reader names in its filter.
NAMED = 1_000


def tokens(column: Column, language: Column) -> Column:
    """An array of (surface, lemma, strong, morph, pos, prefixes) numbered from 1, cut to their widths, with folded surface and lemma."""

    def one(t: Column, i: Column) -> Column:
        fields = [F.left(F.coalesce(t[f], F.lit("")), F.lit(n)).alias(f) for f, n in WIDTHS.items()]
        norms = [F.left(T.normalize(F.coalesce(t[f], F.lit("")), language), F.lit(NORMAL)).alias(f"{f}_norm") for f in ("surface", "lemma")]
        return F.struct((i + 1).cast("int").alias("position"), *fields, *norms)

    return F.transform(F.coalesce(column, F.array().cast(f"array<struct<{', '.join(f'{f}:string' for f in WIDTHS)}>>")), one)


def verse_texts(records: DataFrame, works: DataFrame, books: DataFrame) -> DataFrame:
    """work, ordinal, text, text_norm, tokens of ``records`` (work, book, chapter, verse, text, tokens); books (book, order), works (work, language).

    Records of books or works that are not listed are left out; both lists are dimensions.
    """
    placed = records.join(F.broadcast(works), "work").join(F.broadcast(books), "book")
    return placed.select(
        "work",
        ordinal(F.col("order"), F.col("chapter"), F.col("verse")).alias("ordinal"),
        F.coalesce("text", F.lit("")).alias("text"),
        T.normalize(F.coalesce("text", F.lit("")), F.col("language")).alias("text_norm"),
        tokens(F.col("tokens"), F.col("language")).alias("tokens"),
    )


def _folder(work: Column) -> Column:
    """A name that stays a string, whatever the code of the work."""
    return F.concat(F.lit("work-"), work)


class Store:
    """Rows of works below ``path``, in versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        """version, work, load: the changes of each version; load is null where the work was taken away."""
        found = _read(self.spark, f"{self.path}/versions")
        return self.spark.createDataFrame([], "version long, work string, load string") if found is None else found.select(F.col("version").cast("long").alias("version"), "work", "load")

    def newest(self) -> int:
        """The number of the last version, 0 before the first."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def _commit(self, changed: DataFrame) -> int:
        """``changed`` (work, load) as the next version: written aside, then moved to a name that no one has, which is one step of the file system.

        A writer that was faster has that name, so the next one is tried.
        """
        jvm, aside = self.spark._jvm, f"{self.path}/versions/_aside-{uuid.uuid4().hex}"
        changed.coalesce(1).write.parquet(aside)
        path = jvm.org.apache.hadoop.fs.Path
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(aside).toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        version = self.newest() + 1
        while True:
            to = path(f"{self.path}/versions/version={version}")
            try:
                files.rename(path(aside), to, no_options)
                return version
            except Py4JJavaError:
                if not files.util().exists(to):
                    raise
                version += 1

    def replace(self, rows: DataFrame) -> int:
        """``rows`` (work, ordinal, ..) in place of all rows of their works; returns the new version.

        Works without a row in ``rows`` stay as they are. All verses of ``rows`` that no version knew are added to the verses.
        """
        load = f"load-{uuid.uuid4().hex}"
        parted = rows.withColumn("folder", _folder(F.col("work")))
        # each load in a folder of its own, as writers of one folder would clear each other's unfinished files away;
        # rows of one work may be most of all: dealt by work and ordinal, not by work
        parted.repartitionByRange("work", "ordinal").write.partitionBy("folder").parquet(f"{self.path}/rows/load={load}")
        own = self.spark.read.parquet(f"{self.path}/rows/load={load}")
        fresh = own.select("ordinal").distinct().join(self.verses(), "ordinal", "left_anti")
        fresh.write.parquet(f"{self.path}/verses/load={load}")
        return self._commit(own.select("work", F.lit(load).alias("load")).distinct())

    def remove(self, works: list[str]) -> int:
        """A version without these works."""
        return self._commit(self.spark.createDataFrame([(w, None) for w in works], "work string, load string"))

    def verses(self) -> DataFrame:
        """The distinct ordinals that any load had."""
        found = _read(self.spark, f"{self.path}/verses")
        return self.spark.createDataFrame([], "ordinal long") if found is None else found.select("ordinal").distinct()

    def current(self, version: int | None = None) -> DataFrame:
        """work, load of every work of a version: a row a work."""
        known = self.versions() if version is None else self.versions().filter(F.col("version") <= version)
        last = known.groupBy("work").agg(F.max_by("load", "version").alias("load"))
        return last.filter("load IS NOT NULL")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless told; only the folders of its loads are read.

        The version is fixed here: what is written later is not seen by a reader that runs later.
        """
        loads = written(self.current(self.newest() if version is None else version), "loads")
        rows = _read(self.spark, f"{self.path}/rows")
        if rows is None:
            raise ValueError(f"no load has been written to {self.path}")
        loads = loads.select("load", _folder(F.col("work")).alias("folder"))
        named = [r.load for r in loads.select("load").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:  # folders of other loads are not even listed for reading
            rows = rows.filter(F.col("load").isin(named))
        return rows.join(F.broadcast(loads), ["load", "folder"], "left_semi").drop("load", "folder")


def in_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """batch (from 0) and the columns ``order`` of ``rows``, written: the keys as they are now, in order, ``size`` to a batch.

    Each batch's rows are read when their turn comes (``rows_of``), so nothing stays open between, and rows that are gone by then are
    passed over. Numbers come from the place in a range of keys and the sizes of the ranges before it, so no task sees all keys.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("_part"), place.alias("_place"))
    dealt = written(dealt, "keys")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")  # a row a partition
    return written(numbered.select(F.floor((F.col("_before") + F.col("_place")) / size).alias("batch"), *order), "batches")


def rows_of(rows: DataFrame, batches: DataFrame, batch: int) -> DataFrame:
    """The rows of one batch, as ``rows`` has them now, in the batch's order."""
    keys = [c for c in batches.columns if c != "batch"]
    return rows.join(F.broadcast(batches.filter(F.col("batch") == batch).drop("batch")), keys).orderBy(*keys)


def upsert_lexemes(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """``held`` with the columns of ``fresh`` (strong, ..) where it has the number, its other columns kept, and with the new numbers.

    Both have unique numbers; a null of ``fresh`` takes nothing away.
    """
    both = held.join(fresh.withColumnsRenamed({c: f"_new_{c}" for c in fresh.columns if c != "strong"}), "strong", "full_outer")
    return both.select("strong", *[F.coalesce(f"_new_{c}", c).alias(c) if c in fresh.columns else F.col(c) for c in held.columns if c != "strong"])


def with_lemmas(texts: DataFrame, lexemes: DataFrame) -> DataFrame:
    """``texts`` (work, ordinal, tokens, ..) whose tokens without a lemma take that of their number in ``lexemes`` (strong, lemma): the whole number's, or else that without its homograph letter."""
    once = written(lexemes.filter("lemma <> ''").groupBy("strong").agg(F.min("lemma").alias("lemma")), "lemmas")
    side = F.broadcast(once) if few(once) else once
    bare = F.filter("tokens", lambda t: F.coalesce(t["lemma"], F.lit("")) == "")
    number = T.strong_number(F.col("t.strong"))
    asked = texts.select("work", "ordinal", F.explode(bare).alias("t")).select("work", "ordinal", F.col("t.position").alias("position"), number.alias("strong"))
    whole = asked.join(side, "strong", "left").withColumnRenamed("lemma", "exact").withColumn("strong", F.regexp_replace("strong", "[a-z]$", ""))
    found = whole.join(side, "strong", "left").select("work", "ordinal", F.struct("position", F.coalesce("exact", "lemma").alias("lemma")).alias("e")).filter("e.lemma IS NOT NULL")
    by_verse = found.groupBy("work", "ordinal").agg(F.map_from_entries(F.collect_list("e")).alias("_lemmas"))  # the tokens of one verse
    filled = F.transform("tokens", lambda t: t.withField("lemma", F.coalesce(F.nullif(t["lemma"], F.lit("")), F.col("_lemmas")[t["position"]], F.lit(""))))
    return texts.join(by_verse, ["work", "ordinal"], "left").withColumn("tokens", F.when(F.col("_lemmas").isNull(), F.col("tokens")).otherwise(filled)).drop("_lemmas")
