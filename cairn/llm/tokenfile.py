"""Token ids in Arrow's IPC file format: fixed-size-list batches of equal-length sequences and their masks.

Documents are dealt out by ranges of their id, sorted within, and encoded; each task writes one shard to the shared
folder: ``ids`` and ``mask`` as fixed-size lists of ``SEQUENCE`` entries, every batch but the last of ``ROWS`` rows,
so that token k of a shard is found at once and slices of a memory-mapped file are zero-copy. The last sequence is
padded, with mask false. A second file holds doc_id, offset and length. File names are unique to the attempt and
only those of the attempt that succeeded are in the manifest, so retried tasks do no harm.

Defined results: a null text is an empty one and has the end id alone; null ids come first; rows with the same id
stand in the order of a hash of their text; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, scratch, settle
from .encoder import encoder_of, with_ends

SEQUENCE = 1024
ROWS = 1024
#: Rows and bytes of a part: distinct pieces are looked up once a part, and its bytes are held some twenty times over.
PART_ROWS = 20_000
PART_BYTES = 2 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Fills sequences with ids and writes them in batches."""

    def __init__(self, uri: str, dtype: np.dtype) -> None:
        system, path = _open(uri)
        self.dtype = dtype
        ids = pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= SEQUENCE * ROWS:
            flat = np.concatenate(self.rest)
            full = len(flat) // (SEQUENCE * ROWS) * SEQUENCE * ROWS
            for i in range(0, full, SEQUENCE * ROWS):
                self._write(flat[i : i + SEQUENCE * ROWS], SEQUENCE * ROWS)
            self.rest, self.waiting = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.rest)
            self._write(np.r_[flat, np.zeros(-len(flat) % SEQUENCE, self.dtype)], len(flat))
        self.writer.close()
        self.sink.close()


class Shard:
    """Random access to the ids of a shard."""

    def __init__(self, uri: str) -> None:
        system, path = _open(uri)
        source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of a sequence."""
        batch = self.reader.get_batch(k // ROWS)
        return batch.column(0)[k % ROWS].values.to_numpy(), batch.column(1)[k % ROWS].values

    def slices(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Zero-copy parts of the ids from start to stop."""
        size = SEQUENCE * ROWS
        while start < stop:
            k = start // size
            end = min(stop, (k + 1) * size)
            yield self.reader.get_batch(k).column(0).values.to_numpy()[start - k * size : end - k * size]
            start = end


def write_tokens(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards; their manifest: shard, ids_file, docs_file, n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"{folder}/{shard:08d}-{uuid.uuid4().hex}"
        writer = index = sink = None
        n = 0
        for batch in parts(batches, rows=PART_ROWS, size=PART_BYTES):
            if writer is None:
                encoder = encoder_of(tokenizer_path)
                system, path = _open(f"{name}-ids.arrow")
                system.create_dir(os.path.dirname(path), recursive=True)
                writer = ShardWriter(f"{name}-ids.arrow", encoder.dtype)
                sink = system.open_output_stream(_open(f"{name}-docs.arrow")[1])
                index = pa.ipc.new_file(sink, index_schema(batch))
            ids, at = with_ends(*encoder.encode(batch.column(1)), end_id)
            offsets, lengths = writer.total + at[:-1], np.diff(at)
            writer.add(ids)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets), pa.array(lengths)], schema=index_schema(batch)))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "ids_file": f"{name}-ids.arrow", "docs_file": f"{name}-docs.arrow", "n_docs": n, "n_tokens": writer.total}], schema=MANIFEST)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = picked.repartitionByRange(F.col("doc_id").asc(), F.col("tie").asc()).sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return settle(ordered.mapInArrow(run, "shard long, ids_file string, docs_file string, n_docs long, n_tokens long"), "manifest")


MANIFEST = pa.schema([("shard", pa.int64()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def index_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("doc_id", batch.column(0).type), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def read_documents(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the shards' files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["ids_file"])
                system, path = _open(row["docs_file"])
                with system.open_input_file(path) as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        docs = reader.get_batch(k)
                        sums = []
                        for a, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            crc = 0
                            for part in shard.slices(a, a + n):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        start = pa.array(docs.column(1).to_numpy() + row["start"])
                        yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.agg(F.max("shard")).first()[0]
    n = 0 if shards is None else shards + 1
    # A row for each shard: small enough for one window and one broadcast, whatever the shards hold.
    placed = manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))
    each = spark.range(0, n, 1, max(1, n)).withColumnRenamed("id", "shard").join(F.broadcast(placed), "shard")
    return each.select("ids_file", "docs_file", "start").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token shards and read every document back."""
    manifest = write_tokens(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return read_documents(docs.sparkSession, manifest, dict(docs.dtypes)[id_col]).withColumnRenamed("doc_id", id_col)
