"""Two tokenizers' tokens aligned over whole texts, each distinct segment tokenised and aligned once.

A text, with a space before it, is cut before runs of white space wherever both vocabularies verifiably cannot merge across: no
token of either holds a character that is no white space followed by the run's first one (``Vocabularies.cuts``; carriage returns
are no cut for vocabularies with pieces such as ``;\\r``). So tokens, byte offsets and links of a text are those of its segments in
a row, and every cut is a place where tokens of both sides end. A pair of vocabularies for which this cannot be shown has whole
texts as segments.

Tasks number the distinct segments of a block of documents, and write the documents as such numbers beside the block's list. The
lists meet by segment, where each distinct segment is tokenised and aligned; links are summed corpus-wide by id pair; alignments go
back to the blocks by a shuffle on the block, where documents are composed as they stream past. A block ends at a number of distinct
segments, so neither lists nor blocks grow with the corpus, and no text is shuffled.

Defined cases: null and empty texts, and texts that either tokenizer's bytes do not give back, have no tokens and count nowhere;
equal doc_ids and repeated rows are aligned row by row and all counted; null ids stay null; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import new_path, slices, small, table

#: Distinct segments of a block and their characters; id pairs that are broadcast (24 bytes each); places of a segment in one row.
BLOCK_SEGMENTS, BLOCK_CHARS, PAIRS, PLACES = 500_000, 32_000_000, 500_000, 4_096
#: Entries that a task holds before it hands them out by block, pairs that a task sums, and documents of a result batch.
ENTRIES, SUMS, DOCS = 200_000, 1_000_000, 256
WHITE = " \t\n\x0b\x0c\r"
LINK = np.int64(1) << 32


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes as: printable ones for themselves, the others from 256 on."""
    out, after = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(after)] = b
            after += 1
    return out


class Vocabularies:
    """Tokenizers A (byte-level ``.json``) and B (``.model``) with the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        spell = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(alphabet[c] for c in spell.get(i, "") if c in alphabet) for i in range(max(spell) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space_b = self.b.piece_to_id("▁")
        self.kept_whole = not (self._plain_a(path_a) and self._plain_b())
        self.cuts = "" if self.kept_whole else self._cuts()
        cut = re.escape(self.cuts)
        self.segment = re.compile(rf"\s*\S+(?:(?![{cut}])\s+\S*)*|\s+" if cut else r"(?s:.+)")
        self.len_a, self.len_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]

    def _plain_a(self, path: str) -> bool:
        """Whether A cuts texts before white space by itself and changes nothing."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")

    def _plain_b(self) -> bool:
        """Whether B gives back all texts without U+2581: no normalisation, a space put before, a piece for every byte."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        n = model.normalizer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
        t = model.trainer_spec
        every = {bytes([x]) for x in range(256)} <= {self.bytes_b[i] for i in range(len(self.bytes_b)) if self.b.is_byte(i)}
        user = any(p.type == p.USER_DEFINED for p in model.pieces)
        return plain and t.byte_fallback and t.model_type == t.BPE and every and not user and not t.treat_whitespace_as_suffix

    def _cuts(self) -> str:
        """White space characters that follow no other character inside any token, nor (but for spaces) B's leading space."""
        out, tokens = "", [x.decode(errors="replace") for x in (*self.bytes_a, *self.bytes_b)]
        for w in WHITE:
            after = re.compile(r"\S" + w)
            joined = w != " " and any(b" " + w.encode() in x for x in self.bytes_b)
            if not joined and not any(map(after.search, tokens)):
                out += w
        return out if " " in out else ""

    def ids_b(self, segment: str) -> list[int]:
        """B's ids of ``segment``; the space that B puts before it is either the segment's own or taken away."""
        if segment[0] == " ":
            return self.b.encode(segment[1:], num_threads=1) if len(segment) > 1 else [self.space_b]
        first, *ids = self.b.encode(segment, num_threads=1)
        if first != self.space_b:
            raise ValueError(f"the space before {segment[:40]!r} is part of a token")
        return ids

    def gives_back(self, text: str) -> bool:
        """Whether the tokens of both sides, joined, are the text."""
        if not self.kept_whole:
            return "▁" not in text
        raw = b" " + text.encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        return all(b"".join(map(of.__getitem__, x)) == raw for of, x in zip((self.bytes_a, self.bytes_b), ids, strict=True))

    def align(self, segments: list[str]) -> Iterator[tuple[str, int, int, list[int]]]:
        """Groups as text, numbers of A and B tokens, and links (A id * 2^32 + B id) in order, of each segment."""
        len_a, len_b, text_a, text_b = self.len_a, self.len_b, self.text_a, self.text_b
        for segment, coded in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), strict=True):
            a, b = coded.ids, self.ids_b(segment)
            raw = segment.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                raise ValueError(f"tokens do not give back the segment {segment[:40]!r}")
            links, groups = [], []
            i = j = from_a = from_b = 0
            end_a, end_b = len_a[a[0]], len_b[b[0]]
            while True:
                links.append(a[i] << 32 | b[j])
                if end_a < end_b:
                    i += 1
                    end_a += len_a[a[i]]
                elif end_b < end_a:
                    j += 1
                    end_b += len_b[b[j]]
                else:
                    i, j = i + 1, j + 1
                    groups.append(",".join([text_a[x] for x in a[from_a:i]]) + "|" + ",".join([text_b[x] for x in b[from_b:j]]))
                    if i == len(a):
                        break
                    from_a, from_b = i, j
                    end_a += len_a[a[i]]
                    end_b += len_b[b[j]]
            yield ";".join(groups), len(a), len(b), links


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path_a, path_b] = Vocabularies(path_a, path_b)
    return _loaded[path_a, path_b]


def _staged(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``, with the compression that suits numbers and short strings."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Numbers(dict):
    """Segment to its number in the block, in order of first sight."""

    chars = 0

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.chars += len(segment)
        return n


def numbered(docs: DataFrame, path_a: str, path_b: str, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """Documents (block, doc_id, codes: their segments' numbers) and the blocks' lists (block, segment, code, n), in one table."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {id_type}, codes binary, segment string, code int, n long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, press = vocabularies(path_a, path_b), zstandard.ZstdCompressor(level=3)
        block, known, seen = TaskContext.get().partitionId() << 24, _Numbers(), np.zeros(1024, np.int64)

        def listed() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for at in range(0, len(words), 50_000):
                part = pa.array(words[at : at + 50_000], pa.string())
                n = len(part)
                code = pa.array(np.arange(at, at + n, dtype=np.int32))
                yield pa.record_batch([pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), part, code, pa.array(seen[at : at + n])], names=names)

        names, kind = ["block", "doc_id", "codes", "segment", "code", "n"], None
        for piece in slices(batches, 128):
            kind = piece.column("doc_id").type
            coded = []
            for text in piece.column("text").to_pylist():
                if text and both.gives_back(text):
                    coded.append(np.fromiter(map(known.__getitem__, both.segment.findall(" " + text)), np.uint32))
                else:
                    coded.append(np.zeros(0, np.uint32))
            n = piece.num_rows
            packed = [press.compress(x.tobytes()) if len(x) else b"" for x in coded]
            yield pa.record_batch(
                [pa.array([block] * n, pa.int64()), piece.column("doc_id"), pa.array(packed, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                names=names,
            )
            if len(seen) < len(known):
                seen = np.concatenate([seen, np.zeros(max(len(seen), len(known) - len(seen)), np.int64)])
            if n:
                counts = np.bincount(np.concatenate(coded))
                seen[: len(counts)] += counts
            if len(known) >= block_segments or known.chars >= BLOCK_CHARS:
                yield from listed()
                block, known, seen = block + 1, _Numbers(), np.zeros(1024, np.int64)
        if known:
            yield from listed()

    return docs.select("doc_id", "text").mapInArrow(number, schema)


def aligned(lists: DataFrame, path_a: str, path_b: str, places: int = PLACES) -> DataFrame:
    """Distinct segments' alignments with their places (id, groups, n_a, n_b, links, blocks, codes), and pairs' links (pair, n), in one table."""
    schema = "id long, groups string, n_a int, n_b int, links array<long>, blocks array<long>, codes array<int>, pair long, n long"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, sums = vocabularies(path_a, path_b), {}
        fresh, held = TaskContext.get().partitionId() << 40, None  # the last segment's places may go on in the next batch

        def summed() -> pa.RecordBatch:
            n = len(sums)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            out = pa.record_batch([*(pa.nulls(n, k) for k in kinds), pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=names)
            sums.clear()
            return out

        def rows(runs: list[tuple[str, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
            nonlocal fresh
            found = []
            for (_, blocks, codes, n), (groups, n_a, n_b, links) in zip(runs, both.align([r[0] for r in runs]), strict=True):
                for pair in links:
                    sums[pair] = sums.get(pair, 0) + n
                for at in range(0, len(blocks), places):
                    found.append((fresh, groups, n_a, n_b, links, blocks[at : at + places], codes[at : at + places]))
                    fresh += 1
            columns = [list(c) for c in zip(*found, strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.record_batch([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], names=names)

        names = ["id", "groups", "n_a", "n_b", "links", "blocks", "codes", "pair", "n"]
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("segment")
            block, code, n = (batch.column(k).to_numpy() for k in ("block", "code", "n"))
            edges = np.flatnonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(block)]])
            totals = np.add.reduceat(n, starts)
            runs = [(w, block[s:e], code[s:e], int(t)) for w, s, e, t in zip(word.take(pa.array(starts)).to_pylist(), starts, ends, totals, strict=True)]
            if held and held[0] == runs[0][0]:
                runs[0] = (held[0], np.concatenate([held[1], runs[0][1]]), np.concatenate([held[2], runs[0][2]]), held[3] + runs[0][3])
            elif held:
                runs.insert(0, held)
            held = runs.pop()
            if runs:
                yield rows(runs)
            if len(sums) >= SUMS:
                yield summed()
        if held:
            yield rows([held])
            yield summed()

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.select("segment", "block", "code", "n").repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(align, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, links (corpus-wide), best (whether no pair of the same B id has more). A B id has at most as many pairs as A has ids."""
    counted = rows.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    return counted.select("pair", "links", (F.col("links") == most).alias("best"))


def scored(rows: DataFrame, pairs: DataFrame, most_pairs: int = PAIRS) -> DataFrame:
    """Alignments with n_best and count_sum of their links: pairs are broadcast as two arrays up to ``most_pairs``, joined beyond."""
    segments = rows.filter("pair IS NULL").select("id", "groups", "n_a", "n_b", "links", "blocks", "codes")
    if not small(pairs, most_pairs):
        each = segments.select("id", F.explode("links").alias("pair"))
        sums = each.join(pairs, "pair").groupBy("id").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("links").alias("count_sum"))
        return segments.join(sums, "id")
    got = pairs.toArrow().sort_by("pair")
    shared = pairs.sparkSession.sparkContext.broadcast(tuple(got.column(k).to_numpy() for k in ("pair", "links", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("links")
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            sums = [np.add.reduceat(x[at].astype(np.int64), starts) for x in (best, links)]
            yield pa.record_batch([*batch.columns, *map(pa.array, sums)], names=[*batch.schema.names, "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInArrow(score, f"{kinds}, n_best long, count_sum long")


def handed_out(segments: DataFrame) -> DataFrame:
    """block, entries: packed alignments for the block's list, many to a row where a task has many for a block."""

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        blocks = table.column("blocks").combine_chunks()
        times = np.diff(blocks.offsets.to_numpy())
        block = blocks.flatten().to_numpy()
        code = table.column("codes").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(table.num_rows), times)
        order = np.argsort(block, kind="stable")
        groups = table.column("groups").to_pylist()
        numbers = [table.column(k).to_numpy() for k in ("n_a", "n_b", "n_best", "count_sum")]
        edges = np.flatnonzero(np.diff(block[order])) + 1
        ids, packed = [], []
        for part in np.split(order, edges):
            at = row[part]
            head = np.stack([code[part], *(x[at] for x in numbers)]).astype("<i8")
            ids.append(block[part[0]])
            packed.append(press.compress(len(part).to_bytes(8, "little") + head.tobytes() + "\n".join([groups[x] for x in at]).encode()))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["block", "entries"])

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in slices(batches, 2_000):
            if not piece.num_rows:
                continue
            held.append(piece)
            n += len(piece.column("blocks").flatten())
            if n >= ENTRIES:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from pack(pa.Table.from_batches(held))

    return segments.select("groups", "n_a", "n_b", "blocks", "codes", "n_best", "count_sum").mapInArrow(hand, "block long, entries binary")


def composed(documents: DataFrame, entries: DataFrame, id_type: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: documents put together from their block's alignments."""
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, current, packed, numbers, texts = zstandard.ZstdDecompressor(), None, [], None, []

        def tables() -> tuple[np.ndarray, list[str]]:
            heads, words = [], []
            for raw in map(open_.decompress, packed):
                n = int.from_bytes(raw[:8], "little")
                heads.append(np.frombuffer(raw, "<i8", 5 * n, 8).reshape(5, n))
                words.append(raw[8 + 40 * n :].decode().split("\n"))
            packed.clear()
            size = max(int(h[0].max()) for h in heads) + 1
            by_code, text = np.zeros((5, size), np.int64), [""] * size
            for h, ws in zip(heads, words, strict=True):
                by_code[:2, h[0]], by_code[3:, h[0]] = h[1:3], h[3:]
                by_code[2, h[0]] = [w.count("|") for w in ws]
                for c, w in zip(h[0].tolist(), ws, strict=True):
                    text[c] = w
            return by_code, text

        for piece in slices(batches, DOCS):
            ids, rows, groups = [], [], []
            for k, (block, kind, data) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("block", "kind", "data")), strict=True)):
                if block != current:
                    current, numbers = block, None
                    packed.clear()
                if kind == 0:
                    packed.append(data)
                    continue
                ids.append(k)
                if not data:
                    rows.append(np.zeros(5, np.int64))
                    groups.append("")
                    continue
                if numbers is None:
                    numbers, texts = tables()
                codes = np.frombuffer(open_.decompress(data), np.uint32)
                rows.append(numbers[:, codes].sum(1))
                groups.append(";".join(map(texts.__getitem__, codes.tolist())))
            if not ids:
                continue
            n_a, n_b, n_groups, n_best, count_sum = np.stack(rows).T
            columns = [n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum]
            yield pa.record_batch([piece.column("doc_id").take(pa.array(ids)), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(groups, pa.string())], names=names)

    none = F.lit(None).cast(id_type).alias("doc_id")
    both = entries.select("block", F.lit(0).alias("kind"), F.col("entries").alias("data"), none)
    both = both.unionByName(documents.select("block", F.lit(1).alias("kind"), F.col("codes").alias("data"), "doc_id"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(compose, schema)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = PAIRS, block_segments: int = BLOCK_SEGMENTS, places: int = PLACES) -> DataFrame:
    """Alignment of A's and B's tokens in every document of ``docs`` (doc_id, text).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair no pair of the same B id exceeds corpus-wide), count_sum
    (corpus-wide links of each link's pair, summed) and groups: ``a1,a2|b1;a3|b2,b3``, empty without tokens.
    """
    table = _staged(numbered(docs, path_a, path_b, block_segments), "segment-numbers")
    rows = _staged(aligned(table.filter("code IS NOT NULL"), path_a, path_b, places), "segment-alignments")
    pairs = _staged(pair_counts(rows), "pair-counts")
    entries = handed_out(scored(rows, pairs, most_pairs))
    return composed(table.filter("code IS NULL"), entries, docs.schema["doc_id"].dataType.simpleString())


def op12_align_tokens(spark, sf_dir):
    """Tokens of byte_bpe_50k.json and piece_bpe_32k.model aligned over every whole text of ``documents``."""
    out = align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))


QUERIES = {"op12_align_tokens": op12_align_tokens}
ORACLE_SQL: dict[str, str] = {}
