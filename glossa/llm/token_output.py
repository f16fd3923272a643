"""Token ids in Arrow stream files of fixed-size-list batches.

Documents in ascending doc_id order, each followed by an end id, make one stream of ids. A shard (one range of doc_id)
cuts its part into sequences of equal length and writes them as ``fixed_size_list`` batches with a mask beside the ids;
only a shard's last sequence is padded. All full batches have the same number of bytes, so sequence i is found by
arithmetic and read from a memory map without copying, its mask as an Arrow array over the map's own bits. A second stream file has doc_id, start and n_tokens of the
shard's documents. The shard's row in the manifest names both files.

Files are written to names of their own under the shared folder and count only once their task's manifest row is
committed; what a lost or repeated task leaves is never read.

Defined cases: a null or empty text is just the end id; equal doc_ids stay side by side, in order of a hash of their texts; null
doc_ids come first, likewise; an empty table gives an empty result; further columns are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import new_path, slices, staged, table
from glossa.llm.tokens import many, pieces

#: Ids of a sequence, sequences of a batch, and bytes of text from which on there are more shards than shuffle partitions.
SEQUENCE, ROWS, SHARD = 2048, 64, 256 << 20
#: Documents that are encoded together.
TOGETHER = 1_024
MANIFEST = "shard int, n_docs long, n_tokens long, sequence int, rows int, first_at long, batch_bytes long, ids_file string, docs_file string"


def _open(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


def _create(folder: str, name: str):
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}")


class ShardWriter:
    """Writes one shard's ids; ``add`` takes a document's ids as bytes of ``kind``."""

    def __init__(self, folder: str, kind: np.dtype, sequence: int, rows: int) -> None:
        self.kind, self.sequence, self.rows = kind, sequence, rows
        self.name = uuid.uuid4().hex
        self.ids_file, self.docs_file = f"{folder}/ids-{self.name}.arrows", f"{folder}/docs-{self.name}.arrows"
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = _create(folder, f"ids-{self.name}.arrows")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        # the writer puts the schema before the first batch
        self.first_at = self.batch_bytes = self.schema.serialize().size
        self.folder, self.held, self.held_bytes, self.total, self.batches = folder, [], 0, 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.total += len(ids) // self.kind.itemsize
        full = self.sequence * self.rows * self.kind.itemsize
        if self.held_bytes >= full:
            data = b"".join(self.held)
            at = 0
            while len(data) - at >= full:
                self._batch(np.frombuffer(data, self.kind, self.sequence * self.rows, at), self.sequence * self.rows)
                at += full
            self.held = [data[at:]]
            self.held_bytes = len(data) - at

    def _batch(self, ids: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(ids)) < used)
        columns = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (pa.array(ids), mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        if not self.batches:
            self.batch_bytes = self.sink.tell() - self.first_at
        self.batches += 1

    def close(self) -> None:
        if self.held_bytes:
            ids = np.frombuffer(b"".join(self.held), self.kind)
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.kind)
            padded[: len(ids)] = ids
            self._batch(padded, len(ids))
        self.out.close()
        self.sink.close()


def read_sequence(manifest_row, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of a shard, without reading what comes before it; both are views of the mapped file."""
    source = _open(manifest_row["ids_file"])
    schema = pa.ipc.open_stream(source).schema
    source.seek(manifest_row["first_at"] + i // manifest_row["rows"] * manifest_row["batch_bytes"])
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    row = i % manifest_row["rows"]
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values


def text_bytes(docs: DataFrame) -> int:
    """About how many bytes of text there are: twice the size that Spark knows of files, else counted."""
    known = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 * known if known < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, sequence: int = SEQUENCE, rows: int = ROWS, partitions: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; returns the manifest, one row per shard that has documents."""
    if partitions is None:
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // SHARD))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoded, out = pieces(path), many(path), None
        end = np.asarray([end_id], model.kind).tobytes()
        doc_ids, lengths = [], []
        for batch in slices(batches, TOGETHER):
            out = out or ShardWriter(folder, model.kind, sequence, rows)
            doc_ids.append(batch.column("doc_id"))
            for ids in encoded(batch.column("text").to_pylist()):
                ids += end
                lengths.append(len(ids) // model.kind.itemsize)
                out.add(ids)
        if out is None:
            return
        out.close()
        n = np.asarray(lengths, np.int64)
        index = pa.record_batch([pa.concat_arrays(doc_ids), pa.array(np.cumsum(n) - n), pa.array(n)], names=["doc_id", "start", "n_tokens"])
        with _create(folder, f"docs-{out.name}.arrows") as sink, pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_batch(index)
        row = {"shard": TaskContext.get().partitionId(), "n_docs": len(n), "n_tokens": out.total, "sequence": sequence, "rows": rows}
        row |= {"first_at": out.first_at, "batch_bytes": out.batch_bytes, "ids_file": out.ids_file, "docs_file": out.docs_file}
        kinds = dict(zip(row, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))
        yield pa.record_batch({k: pa.array([v], kinds[k]) for k, v in row.items()})

    # a hash of the text as second key, so that many rows of one id or of none are dealt to several shards
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; ``id_type`` is the kind of doc_id that was written."""
    base = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    placed = manifest.withColumn("base", F.coalesce(base, F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for b in batches for row in b.to_pylist()):
            index = pa.ipc.open_stream(_open(shard["docs_file"])).read_all()
            sums, at, need, crc = [], 0, iter(index.column("n_tokens").to_numpy()), 0
            left = next(need, None)
            for batch in pa.ipc.open_stream(_open(shard["ids_file"])):
                ids = batch.column(0).values.to_numpy().astype("<u4")
                at = 0
                while left is not None and left <= len(ids) - at:
                    sums.append(zlib.crc32(ids[at : at + left].data, crc))
                    at, crc, left = at + left, 0, next(need, None)
                if left is None:
                    break
                crc, left = zlib.crc32(ids[at:].data, crc), left - (len(ids) - at)
            start = pa.array(index.column("start").to_numpy() + shard["base"])
            doc_id, n = (index.column(k).combine_chunks() for k in ("doc_id", "n_tokens"))
            yield pa.record_batch([doc_id, start, n, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(spread).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark, sf_dir):
    """``documents`` as byte_bpe_50k.json ids with end id 2, written to Arrow stream files and read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, new_path(spark, "tokens"))
    return read_tokens(manifest, docs.schema["doc_id"].dataType.simpleString())


QUERIES = {"op9_token_output": op9_token_output}
ORACLE_SQL: dict[str, str] = {}
