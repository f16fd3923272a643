"""Upkeep of a corpus, put together from the other operators: duplicates and rules of a manifest, documents in, again and out, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import editorial as E
from glossa.functions import text as T
from glossa.functions.references import BOOKS
from glossa.operators import chunks, serving, verify
from glossa.operators.loads import Store
from glossa.streaming.events import drained, new_entries
from glossa.tables import written

#: Sequence ratio from which titles count as the same.
SAME_TITLE = 0.9


def title_duplicates(entries: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """index, duplicate_of of those ``entries`` (index, doi, title, authors) that an earlier one has already.

    The same DOI decides; else a title whose key is near an earlier one's, with an author of both or none known on one side, where that
    earlier entry is no duplicate itself. Titles meet by pieces (``verify.near_names``), equal ones by their key. Entries are decided in
    rounds: those without an undecided or kept earlier one stay, those with a kept one go.
    """
    doi = F.nullif(F.trim(F.coalesce("doi", F.lit(""))), F.lit(""))
    rows = written(entries.select("index", doi.alias("doi"), T.title_key(F.coalesce("title", F.lit(""))).alias("k"), F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.lower(a)).alias("authors")), "entries")
    first = rows.filter("doi IS NOT NULL").groupBy("doi").agg(F.min("index").alias("duplicate_of"))
    by_doi = written(rows.join(first, "doi").filter(F.col("duplicate_of") < F.col("index")).select("index", "duplicate_of"), "by-doi")
    open_ = written(rows.filter("k <> ''").join(by_doi, "index", "left_anti"), "open-entries")
    near = verify.near_names(open_.select(F.col("k").alias("name")), least, back=True)
    # the later title's ratio to the earlier one's
    ways = near.select(F.col("a").alias("later"), F.col("b").alias("earlier"), "ratio").unionByName(near.select(F.col("b").alias("later"), F.col("a").alias("earlier"), F.col("back").alias("ratio"))).filter(F.col("ratio") >= least)
    same = open_.select(F.col("k").alias("later"), F.col("k").alias("earlier")).distinct()
    ways = written(ways.select("later", "earlier").unionByName(same), "title-pairs")
    i, j = open_.select(F.col("index").alias("i"), F.col("k").alias("later"), F.col("authors").alias("mine")), open_.select(F.col("index").alias("j"), F.col("k").alias("earlier"), F.col("authors").alias("theirs"))
    one_author = (F.size("mine") == 0) | (F.size("theirs") == 0) | F.arrays_overlap("mine", "theirs")
    edges = written(i.join(ways, "later").join(j, "earlier").filter((F.col("j") < F.col("i")) & one_author).select("i", "j"), "title-edges")
    left, kept, gone = edges, None, None
    while not left.isEmpty():
        # those that only appear as earlier ones have nothing before them that may stay
        stay = written(left.select(F.col("j").alias("index")).distinct().join(left.select(F.col("i").alias("index")), "index", "left_anti"), "kept")
        kept = stay if kept is None else kept.unionByName(stay)
        go = written(left.join(stay, F.col("j") == F.col("index"), "left_semi").select(F.col("i").alias("index")).distinct(), "gone")
        gone = go if gone is None else gone.unionByName(go)
        left = left.join(go, F.col("i") == F.col("index"), "left_anti").join(go, F.col("j") == F.col("index"), "left_anti")
        left = written(left, "title-left")
    if gone is None:
        return by_doi
    # what stays are all that did not go
    by_title = edges.join(gone, F.col("i") == F.col("index"), "left_semi").join(gone, F.col("j") == F.col("index"), "left_anti").groupBy(F.col("i").alias("index")).agg(F.min("j").alias("duplicate_of"))
    return by_doi.unionByName(by_title)


def curated(entries: DataFrame) -> DataFrame:
    """``entries`` (index, doi, title, authors, access, ..) with decision (access, kind, reason) by duplicates and rules."""
    found = title_duplicates(entries)
    joined = entries.join(found, "index", "left")
    return joined.withColumn("decision", E.rule_decision(F.col("title"), F.col("access"), F.col("duplicate_of"))).drop("duplicate_of")


def prepared(pages: DataFrame, books: list[tuple] = BOOKS) -> DataFrame:
    """work, ordinal, section, page_from, page_to, text, refs of documents' ``pages`` (document_id, page, text): running headers out, text cleaned, in chunks with references."""
    from glossa.operators.groups import without_headers

    clean = without_headers(pages).withColumn("text", T.clean_text(F.col("text")))
    found = chunks.with_references(chunks.document_chunks(clean), books)
    return found.select(F.col("document_id").cast("string").alias("work"), F.col("ord").cast("long").alias("ordinal"), "section", "page_from", "page_to", "text", "refs")


def ingest(pages: DataFrame, store: Store, books: list[tuple] = BOOKS) -> DataFrame:
    """Chunks of new documents into ``store``; document_id, state, language of all: new, known (the store has that id) or copy (of an earlier document's text in it or here).

    A document's text is its pages' in order; language is the vote over it, null where it is too close.
    """
    spark = pages.sparkSession
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n")
    docs = pages.groupBy("document_id").agg(whole.alias("text"))  # one document's pages
    docs = docs.select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), T.detect_language(F.col("text")).alias("language"))
    held = _digests(spark, store)
    first = docs.groupBy("digest").agg(F.min("document_id").alias("_first"))
    known_ids = store.current().select(F.col("work").alias("_w"), F.lit(True).alias("_known"))
    told = docs.join(first, "digest").join(held.select("digest", F.lit(True).alias("_held")).distinct(), "digest", "left").join(known_ids, F.col("document_id").cast("string") == F.col("_w"), "left")
    state = F.when(F.col("_known"), "known").when(F.col("_held") | (F.col("_first") < F.col("document_id")), "copy").otherwise("new")
    told = written(told.select("document_id", "digest", "language", state.alias("state")), "ingested")
    new = told.filter("state = 'new'")
    if not new.isEmpty():
        store.replace(prepared(pages.join(new.select("document_id"), "document_id", "left_semi"), books))
        new.select(F.col("document_id").cast("string").alias("work"), "digest").write.mode("append").parquet(f"{store.path}/digests")
    return told.select("document_id", "state", "language")


def _digests(spark: SparkSession, store: Store) -> DataFrame:
    from glossa.operators.index import _read

    found = _read(spark, f"{store.path}/digests")
    return spark.createDataFrame([], "work string, digest string") if found is None else found.join(F.broadcast(store.current().select("work")), "work", "left_semi")


def reingest(pages: DataFrame, store: Store, books: list[tuple] = BOOKS) -> int:
    """The chunks of these documents anew, in place of what the store has of them; returns the version. Others stay, readers keep theirs."""
    return store.replace(prepared(pages, books))


def update_references(store: Store, books: list[tuple] = BOOKS) -> tuple[int, int]:
    """References of all chunks by another list of books: the version, and how many chunks changed. Only works with a changed chunk are written."""
    now = written(store.read(), "store-now")
    held = now.select(F.col("work").alias("document_id"), F.col("ordinal").alias("ord"), "text", "refs")
    changed = written(chunks.changed_references(held, books), "changed")
    n = changed.count()
    if not n:
        return store.newest(), 0
    works = changed.select(F.col("document_id").alias("work")).distinct()
    fresh = changed.select(F.col("document_id").alias("work"), F.col("ord").alias("ordinal"), F.col("refs").alias("_refs"))
    rows = now.join(works, "work", "left_semi").join(fresh, ["work", "ordinal"], "left").withColumn("refs", F.coalesce("_refs", "refs")).drop("_refs")
    return store.replace(rows), n


def updated(manifest: DataFrame, known: DataFrame, path: str, late: str = "30 days") -> DataFrame:
    """Entries of a manifest stream (seen_at, source, source_id, doi, title, authors, access) that ``known`` (the same) does not have, curated with it."""
    fresh = drained(new_entries(manifest, late), "append", path).join(known.select("source", "source_id"), ["source", "source_id"], "left_anti")
    columns = ["source", "source_id", "doi", "title", "authors", "access"]
    both = known.select(F.lit(0).alias("_new"), *columns).unionByName(fresh.select(F.lit(1).alias("_new"), *columns))
    # known ones first, then in an order by hash of their names that does not change between runs (62 bits)
    order = F.col("_new").cast("long") * F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("source", "source_id"), 2)
    return curated(both.withColumn("index", order)).filter("_new = 1").drop("_new", "index")


def evaluated(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """type, metric, mean, n over ``cases`` (id, type, relevant) and their ``hits`` (id, document, ord, rank): recall, near (one place beside counts), reciprocal rank, first hit.

    Labels are ``document:ord``. Cases without labels have no metrics.
    """
    asked = cases.filter(F.size("relevant") > 0).select("id", "type", F.array_distinct("relevant").alias("relevant"))
    label = F.concat_ws(":", "document", "ord")
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat_ws(":", F.col("document"), F.col("ord") + d))
    top = hits.filter(F.col("rank") <= k).select("id", "rank", label.alias("label"), beside.alias("beside"))
    met = asked.join(top, "id", "left")
    hit = F.array_contains("relevant", F.col("label"))
    by_case = met.groupBy("id", "type").agg(
        (F.count_distinct(F.when(hit, F.col("label"))) / F.first(F.size("relevant"))).alias("recall"),
        F.coalesce(F.bool_or(F.arrays_overlap("relevant", "beside")), F.lit(False)).cast("double").alias("near"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    metrics = F.create_map(
        F.lit("recall_at_k"), F.col("recall"), F.lit("near_at_k"), F.col("near"), F.lit("mrr_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)), F.lit("hit_at_1"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))
    )
    return serving.report_means(serving.report_cases(by_case.select("id", "type", metrics.alias("metrics"), F.lit(None).cast("string").alias("error"))))
