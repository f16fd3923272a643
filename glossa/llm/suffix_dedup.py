"""Exact removal of repeated byte strings of ``length`` bytes, by column-wise multi-document construction.

Every string of 400 bytes has an anchor, its smallest 100-byte window by hash (the leftmost of equals). Equal strings have equal
anchors at equal distance, so all places where a string starts meet under the anchor's hash. Strings that follow each
other and share an anchor form a run; a run's bytes are its context. Only anchors seen twice are looked at further.

Contexts of an anchor are laid over each other so that the anchor is in one column, and their collection is sorted column
by column from the right: each round puts one symbol before every context's suffix, which sorts the suffixes that start
in this column from those that start in the next (stable by the new symbol), gives the next segment of the
collection's Burrows-Wheeler transform and of its common prefixes (one more than the least prefix between both
suffixes in the round before), and appends the segment to a sequential file. Symbols of different columns are different
letters, so a segment is final once written. Read back, neighbours with a common prefix of 400 are strings that occur twice.

Contexts that are equal are one row with a count, merged before any shuffle by anchor. An anchor with more than ``HOT``
different contexts is split by distance, with the bytes that all strings of a range of distances share as part of the key,
and once more down to single strings; so no group is unbounded, and nothing is dropped.

Defined cases: null is the empty text; texts shorter than ``length`` keep everything; overlaps within a document count;
equal documents lose all of their bytes; rows of one doc_id with different texts are different documents; ids are whole numbers or null; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import slices, staged, table

LENGTH, ANCHOR = 400, 100
#: Different contexts of a key beyond which it is split, and ranges of distances at the first split.
HOT, RANGES = 200, 8
#: Stands for a null doc_id inside.
NO_ID = -(2**63)
#: Strings of a document looked at in one piece, and contexts sorted together at least.
PIECE, TOGETHER = 1 << 20, 600

BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes of ``data``."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * _power(BASE, n), dtype=np.uint64, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _power(INVERSE, n - size + 1)
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` values, the leftmost of equals; at most 2**21 values."""
    n = len(values)
    key = values >> np.uint64(21) << np.uint64(21) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def runs(data: bytes, length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, anchor, first start, last start) of the runs of strings that share an anchor, piece by piece."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, PIECE):
        part = whole[at : at + PIECE + length - 1]
        h = window_hashes(part, anchor)
        place = leftmost_least(h, length - anchor + 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        where = place[first]
        yield h[where].view(np.int64), where + at, first + at, last + at


KEY = ["h", "o1", "o2", "d1", "d2"]
RUN = "h long, o1 int, o2 int, d1 long, d2 long"


def scan_runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """RUN columns with doc, t, start: distances o1..o2 from starts to the anchor, digest of the context, and the place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
            digests = []
            for doc, t, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "t")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text or len(text) < length:
                    continue
                for h, where, first, last in runs(text, length, anchor):
                    for column, values in zip(found, (h, where - last, where - first, first, np.full(len(h), doc), np.full(len(h), t)), strict=True):
                        column.append(values)
                    digests += [xxhash.xxh3_128_digest(text[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            h, o1, o2, start, doc, t = map(np.concatenate, found)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [h, o1.astype(np.int32), o2.astype(np.int32), d[:, 0].copy(), d[:, 1].copy(), doc, t, start]
            yield pa.record_batch(list(map(pa.array, columns)), names=[*KEY, "doc", "t", "start"])

    return docs.mapInArrow(scan, f"{RUN}, doc long, t long, start long")


def packed(docs: DataFrame) -> DataFrame:
    """doc, t and the text as zstd-compressed bytes: what moves in a shuffle by document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [None if t is None else press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc"), batch.column("t"), pa.array(texts, pa.binary())], names=["doc", "t", "packed"])

    return docs.select("doc", "t", "text").mapInArrow(pack, "doc long, t long, packed binary")


def contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """RUN columns with n and context for ``wanted`` (RUN columns, n, doc, t, start)."""
    of = wanted.groupBy("doc", "t").agg(F.collect_list(F.struct("h", "o1", "o2", "d1", "d2", "n", "start")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows, cuts = [], []
            for data, asked in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                text = press.decompress(data)
                rows += asked
                cuts += [text[r["start"] : r["start"] + r["o2"] - r["o1"] + length] for r in asked]
            kinds = {"h": pa.int64(), "o1": pa.int32(), "o2": pa.int32(), "d1": pa.int64(), "d2": pa.int64(), "n": pa.int64()}
            yield pa.record_batch({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()} | {"context": pa.array(cuts, pa.binary())})

    return texts.join(of.hint("merge"), ["doc", "t"]).select("packed", "wanted").mapInArrow(cut, f"{RUN}, n long, context binary")


def construct(symbols: np.ndarray, file) -> None:
    """Sort the collection column by column from the right; append each column's segment to ``file``.

    ``symbols``: a row for each context, 0 where it has no byte, else the byte + 1. A segment is the rows in the order of
    their suffixes from this column, the symbols before them (the transform) and each one's common prefix with the one before.
    """
    rows, columns = symbols.shape
    by_column = np.ascontiguousarray(symbols.T)
    order = np.arange(rows)
    common = np.zeros(rows + 1, np.int32)
    for j in range(columns - 1, -1, -1):
        symbol = by_column[j][order]
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        order = order[turn]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        fresh = np.zeros(rows + 1, np.int32)
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[::2], bounds[1::2] = turn[same - 1] + 1, turn[same] + 1
            fresh[same] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = fresh
        before = by_column[j - 1][order] if j else np.zeros(rows, symbols.dtype)
        file.write(order.astype("<u4").tobytes())
        file.write(before.astype("<u2").tobytes())
        file.write(common[:rows].astype("<u4").tobytes())


def repeated(group: list[dict], length: int, anchor: int) -> list[list[int]]:
    """For each context of ``group`` the distances at which a string starts that occurs twice, as [low, high, ...]."""
    reach = length - anchor
    symbols = np.zeros((len(group), reach + length), np.uint16)
    for row, g in zip(symbols, group, strict=True):
        data = np.frombuffer(g["context"], np.uint8)
        at = reach - g["o2"]
        row[at : at + len(data)] = data
        row[at : at + len(data)] += 1
    twice = np.zeros((len(group), reach + 3), np.int8)
    rows, columns = symbols.shape
    with tempfile.TemporaryFile() as file:
        construct(symbols, file)
        file.seek(0)
        for j in range(columns - 1, -1, -1):
            order = np.frombuffer(file.read(4 * rows), "<u4")
            file.seek(2 * rows, 1)
            common = np.frombuffer(file.read(4 * rows), "<u4")
            if j <= reach:
                hit = np.flatnonzero(common >= length)
                twice[order[hit], reach - j + 1] = 1
                twice[order[hit - 1], reach - j + 1] = 1
    found = []
    for row, g in zip(twice, group, strict=True):
        if g["n"] > 1:
            found.append([g["o1"], g["o2"]])
        else:
            change = np.flatnonzero(np.diff(row))
            found.append((change - np.tile([0, 1], len(change) // 2)).tolist())
    return found


def sort_groups(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """RUN columns and spans (array of distances) for contexts whose key has at least two different ones."""

    def batch_of(group: list[dict]) -> pa.RecordBatch:
        spans = repeated(group, length, anchor)
        kinds = {"h": pa.int64(), "o1": pa.int32(), "o2": pa.int32(), "d1": pa.int64(), "d2": pa.int64()}
        return pa.record_batch({k: pa.array([g[k] for g in group], t) for k, t in kinds.items()} | {"spans": pa.array(spans, pa.list_(pa.int32()))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if len(group) >= TOGETHER and row["h"] != group[-1]["h"]:
                    yield batch_of(group)
                    group = []
                group.append(row)
        if group:
            yield batch_of(group)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(scan, f"{RUN}, spans array<int>")


def split(rows: DataFrame, length: int, anchor: int, ranges: int) -> DataFrame:
    """Rows (RUN columns, n, context) cut into ranges of distances: RUN of the row as k_*, RUN of the part, n, context."""
    reach = length - anchor + 1
    width = -(-reach // ranges)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                for low in range(r["o1"] // width * width, r["o2"] + 1, width):
                    o1, o2 = max(low, r["o1"]), min(low + width - 1, r["o2"])
                    part = r["context"][r["o2"] - o2 : r["o2"] - o1 + length]
                    # what all strings at distances low..low+width-1 have: from low before the anchor on
                    at = r["o2"] - low
                    core = r["context"][at : r["o2"] - (low + width - 1) + length]
                    h = xxhash.xxh64_intdigest(core, r["h"] + low & (1 << 64) - 1)
                    d = np.frombuffer(xxhash.xxh3_128_digest(part), np.int64)
                    key = np.array([h], np.uint64).view(np.int64)[0]
                    out.append((r["h"], r["o1"], r["o2"], r["d1"], r["d2"], int(key), o1, o2, int(d[0]), int(d[1]), r["n"], part))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] * 2 + [pa.int64(), pa.binary()]
            names = [*(f"k_{c}" for c in KEY), *KEY, "n", "context"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 12, kinds, strict=True)], names=names)

    keys = ", ".join(f"k_{c}" for c in RUN.split(", "))
    return rows.mapInArrow(scan, f"{keys}, {RUN}, n long, context binary")


def verdicts(rows: DataFrame, length: int, anchor: int, hot: int, ranges: int = RANGES) -> DataFrame:
    """RUN columns and spans for different contexts ``rows`` (RUN columns, n, context), n: how often each occurs."""
    several = staged(rows.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "suffix-keys")
    placed = rows.join(several, "h", "left")
    alone = placed.filter("m IS NULL AND n > 1").select(*KEY, F.array("o1", "o2").alias("spans"))
    found = alone.unionByName(sort_groups(placed.filter(F.col("m") <= hot).drop("m"), length, anchor))
    crowded = staged(placed.filter(F.col("m") > hot).drop("m"), "suffix-hot")
    if crowded.isEmpty():
        return found
    parts = staged(split(crowded, length, anchor, ranges), "suffix-parts")
    classes = staged(parts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.first("context").alias("context")), "suffix-classes")
    finer = verdicts(classes, length, anchor, hot, length)
    back = parts.select(*KEY, *(f"k_{c}" for c in KEY)).join(finer, KEY).groupBy(*(f"k_{c}" for c in KEY))
    return found.unionByName(back.agg(F.flatten(F.collect_list("spans")).alias("spans")).toDF(*KEY, "spans"))


def removed_spans(docs: DataFrame, length: int, anchor: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc, t, spans: first and last starts of repeated strings) and the packed texts; ``docs`` has doc, t, text."""
    every = staged(scan_runs(docs, length, anchor), "suffix-runs")
    # written first, so that both sides of the join are plain exchanges and a hot anchor's rows can be dealt to many tasks
    twice = staged(every.groupBy("h").count().filter("count > 1").select("h"), "suffix-twice")
    seen = staged(every.join(twice, "h", "left_semi"), "suffix-seen")
    classes = staged(seen.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc", "t", "start")).alias("at")), "suffix-classes")
    keys = staged(classes.groupBy("h").agg(F.count("*").alias("m")), "suffix-keys")
    joined = classes.join(keys, "h")
    texts = packed(docs)
    wanted = joined.filter("m > 1").select(*KEY, "n", "at.doc", "at.t", "at.start")
    cut = staged(contexts(texts, wanted, length), "suffix-contexts")
    sorted_ = staged(verdicts(cut, length, anchor, hot), "suffix-verdicts")
    # a context that is its anchor's only one occurs at least twice
    lone = joined.filter("m = 1").select(*KEY, F.array("o1", "o2").alias("spans"))
    # written before the join, so that both of its sides are plain exchanges and the rows of a hot context are dealt to many tasks
    told = staged(lone.unionByName(sorted_).filter(F.size("spans") > 0).dropDuplicates(KEY), "suffix-told")
    anchor_at = F.col("start") + F.col("o2")
    at = F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int"))
    pairs = F.transform(at, lambda i: F.struct((anchor_at - F.col("spans")[2 * i + 1]).alias("a"), (anchor_at - F.col("spans")[2 * i]).alias("b")))
    spans = seen.join(told, KEY).select("doc", "t", pairs.alias("pairs"))
    return spans.groupBy("doc", "t").agg(F.flatten(F.collect_list("pairs")).alias("spans")), texts


def covered(pairs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges of strings starting at a..b."""
    merged: list[list[int]] = []
    for a, b in sorted((p["a"], p["b"] + length) for p in pairs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of first and end byte), kept (bytes) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # documents are told apart by id and text hash, so that equal ids or null ones do no harm
    text = F.coalesce("text", F.lit(""))
    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans, texts = removed_spans(numbered, length, anchor, hot)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for doc, data, pairs in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "spans")), strict=True):
                text = press.decompress(data)
                gone = covered(pairs or [], length)
                ends = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((doc, len(text), len(text) - len(kept), [list(s) for s in gone], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=names)

    joined = texts.join(spans.hint("merge"), ["doc", "t"], "left")
    out = joined.mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)).cast(kind))


def op6_suffix_dedup(spark, sf_dir):
    """Bytes of all ``documents`` covered by a 400-byte string that starts anywhere else, removed."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    digests = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return digests.withColumn("removed", F.col("n_removed") > 0)


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
