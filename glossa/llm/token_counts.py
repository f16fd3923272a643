"""Token counts by a two-tier look-up of pre-token lengths, map-side throughout.

Tier one is a broadcast compact table of the lengths of frequent pre-tokens, taken from a bounded sample spread over all documents
by hash; it only decides what is looked up where, never a count. Tier two is each worker's cache, filled by encoding misses
with the library. Nothing is shuffled. Texts are cut by the library's own pattern, in all scripts; those with a special string or an
unassigned character, and tokenizers that are not plain byte-level ones, are encoded whole by the library.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as the library's
default does; ties, repeated rows and further columns have no influence; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import spread, table
from glossa.llm.tokens import LONGEST, PRE_TOKEN, LengthTable, Lookup, pieces

#: Documents and characters of each from which frequent pre-tokens are taken, and entries of the table (under 2 MB).
SAMPLE, SAMPLE_CHARS, FREQUENT = 1_000, 4_000, 30_000

_lookups: dict[str, Lookup] = {}


def frequent_lengths(docs: DataFrame, path: str) -> LengthTable:
    heads = spread(docs.select("doc_id", F.left("text", F.lit(SAMPLE_CHARS)).alias("head")), ["doc_id"], SAMPLE)
    seen = Counter(w for row in heads.collect() for w in PRE_TOKEN.findall(row.head or "") if len(w) <= LONGEST)
    model = pieces(path)
    return LengthTable({w: len(model.encode(w)) for w, _ in seen.most_common(FREQUENT)})


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document for the tokenizer file at ``path``."""
    frequent = docs.sparkSession.sparkContext.broadcast(LengthTable({}) if pieces(path).by_library else frequent_lengths(docs, path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = pieces(path), frequent.value

        def length(part: str) -> int:
            found = known.get(part)
            return len(model.encode(part)) if found is None else found

        if path not in _lookups and not model.by_library:
            _lookups[path] = Lookup(length, sum)
        lookup = _lookups.get(path)
        for batch in batches:
            n = [0 if not t else len(model.encode(t)) if model.whole(t) else sum(lookup(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = read.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir):
    """Tokens of every whole text of ``documents``, by byte_bpe_50k.json."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
