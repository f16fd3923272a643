"""Document fingerprints: canonical exact digests.

A text's canonical form is NFKC, case-folded, with white space runs as one space and none at the ends; its fingerprint
is the 128-bit xxhash of that form. Equal fingerprints of different canonical forms would be told apart: buckets of
more than one document are grouped again by the canonical bytes themselves, and where a bucket has several, a rank in
byte order is appended. So equal fingerprints mean equal canonical texts, and likeness is 1 or 0.

``next document`` pairs need one order over all rows: documents are range-partitioned by descending id, pairs inside a
partition stream by, and only each partition's last document is matched with the first one of the next in a second,
small step.

Defined cases: a null text is the empty text; equal ids are ordered by a hash of their text; a null id comes last; a lone document is
its own next one; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import small, staged, table


#: Documents of shared buckets (ids only) up to which their texts are picked by broadcast.
MEMBERS = 1_000_000


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


class _Pairs:
    """Result columns for one text and the next; a text's own form is kept for its turn as the next one."""

    def __init__(self) -> None:
        self.known: tuple[str, str, str] | None = None

    def form(self, text: str) -> tuple[str, str, str]:
        if self.known is None or self.known[0] is not text:
            self.known = (text, form := canonical(text), digest(form))
        return self.known

    def row(self, text: str, following: str) -> tuple:
        _, form, own = self.form(text)
        changed = edited(text, following)
        other = canonical(changed)
        _, next_form, _ = self.form(following)
        sha = hashlib.sha256(changed.encode()).hexdigest()
        return len(text), sha, own, digest(other), float(form == other), float(form == next_form)


def _rows_batch(ids: list, rows: list[tuple], id_type: pa.DataType, **more: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]
    return pa.record_batch([pa.array(ids, id_type), *columns, *more.values()], names=["doc_id", *_NAMES, *more])


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of RESULT for every document and the next in descending doc_id order."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal ids in order of a hash: the keys of a range partitioning are sampled to the driver, texts must not be
    order = [F.desc_nulls_last("doc_id"), F.asc("_t")]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_t", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairs, held = TaskContext.get().partitionId(), _Pairs(), None
        id_type = None

        def edge(role: str, doc_id, text: str) -> pa.RecordBatch:
            more = {"part": pa.array([part], pa.int32()), "role": pa.array([role]), "text": pa.array([text])}
            return _rows_batch([doc_id], [(None,) * len(_TYPES)], id_type, **more)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, rows = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held is None:
                    yield edge("head", doc_id, text)
                else:
                    ids.append(held[0])
                    rows.append(pairs.row(held[1], text))
                held = (doc_id, text)
            n = len(rows)
            yield _rows_batch(ids, rows, id_type, part=pa.array([part] * n, pa.int32()), role=pa.array([None] * n, pa.string()), text=pa.array([None] * n, pa.string()))
        if held is not None:
            yield edge("tail", *held)

    first = staged(ranged.mapInArrow(inside, f"doc_id {kind}, {RESULT}, part int, role string, text string"), "fingerprints")
    heads = first.filter("role = 'head'")
    # one number per partition; texts come by a join
    everyone, by_part = Window.partitionBy(), Window.orderBy("part")
    order = heads.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(everyone)).alias("next"))
    following = heads.select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = first.filter("role = 'tail'").select("part", "doc_id", "text").join(order, "part").join(following, "next").select("doc_id", "text", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _Pairs()
            rows = [pairs.row(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
            yield _rows_batch(batch.column("doc_id").to_pylist(), rows, batch.schema.field("doc_id").type)

    done = first.filter("role IS NULL").select("doc_id", *_NAMES)
    return done.unionByName(ends.mapInArrow(across, f"doc_id {kind}, {RESULT}"))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(map(digest, forms), pa.string()), pa.array(forms, pa.string())], names=["doc_id", "fingerprint", "form"])


def compared(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (doc_id, fingerprint, ...) with a rank appended to fingerprints that several canonical texts share."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # written first, so that both sides of the join are plain exchanges and a hot bucket's rows can be dealt to many tasks
    several = staged(found.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "fingerprint-several")
    members = staged(found.join(several, "fingerprint", "left_semi").select(F.col("doc_id").alias("_id")), "fingerprint-buckets")
    side = F.broadcast(members) if small(members, MEMBERS) else members
    shared = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(side, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    forms = shared.mapInArrow(_forms, f"doc_id {kind}, fingerprint string, form string")
    # grouping by the form compares its bytes; copies of one text meet before the shuffle
    classes = forms.groupBy("fingerprint", "form").count()
    unequal = staged(classes.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"), "fingerprint-collisions")
    if unequal.isEmpty():
        return found
    clash = forms.join(unequal, "fingerprint", "left_semi")
    ranks = clash.select("fingerprint", "form").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")))
    of = clash.join(ranks, ["fingerprint", "form"]).groupBy(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_f")).agg(F.min("rank").alias("rank"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fingerprint") == F.col("_f"))
    return found.join(of, same, "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", "rank")).drop("_id", "_f", "rank")


def op2_fingerprints(spark, sf_dir):
    """Fingerprints of all ``documents``, of their edited texts, and likeness to these and to the next document."""
    docs = table(spark, sf_dir, "documents")
    return compared(docs, staged(fingerprint_pairs(docs), "fingerprint-pairs"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE_SQL: dict[str, str] = {}
