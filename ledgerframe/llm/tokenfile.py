"""Operator 1: token ids in Arrow stream files of equal-length sequences.

A shard file is one Arrow IPC stream.  Each record batch holds up to ``rows``
sequences of ``length`` ids (``ids``: fixed-size list of the smallest unsigned type
that holds the vocabulary) and as many mask bytes (``mask``: fixed-size list of
bytes, 0 on the padding after the shard's last token).  All batches but the last have
the same size in bytes, so sequence ``i`` and its mask are found by arithmetic and read
from a memory map without a copy (``Shard.sequence``).  A second, small stream beside
it has each document's id and place in the shard.

Shards hold consecutive documents in doc_id order, so a document's place among
all tokens is its place in the shard plus the token counts of the shards before.
A task writes under a name of its own and reports it in the manifest table, which
Spark commits; files of lost or repeated attempts are never named there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, work_path
from .words import library_encoder

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def filesystem(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard from documents' ids; holds at most one batch of sequences."""

    def __init__(self, path: str, length: int, rows: int, kind: pa.DataType) -> None:
        self.fs, self.path = filesystem(path)
        self.length, self.rows, self.kind = length, rows, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.docs_out = self.fs.open_output_stream(self.path + ".docs")
        self.docs = pa.ipc.new_stream(self.docs_out, DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.index: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_tokens, len(ids)))
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= self.rows * self.length:
            self._flush(False)
        if len(self.index) >= 10_000:
            self._flush_index()

    def _flush_index(self) -> None:
        if self.index:
            columns = [pa.array(list(x), pa.int64()) for x in zip(*self.index)]
            self.docs.write_batch(pa.RecordBatch.from_arrays(columns, schema=DOCS))
            self.index = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        block = self.rows * self.length
        whole = len(flat) // block * block
        for at in range(0, whole, block):
            self._batch(flat[at : at + block], block)
        flat = flat[whole:]
        if last and len(flat):
            n = len(flat)
            padded = np.zeros(-(-n // self.length) * self.length, flat.dtype)
            padded[:n] = flat
            self._batch(padded, n)
            flat = flat[:0]
        self.held, self.n_held = [flat], len(flat)

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        mask = pa.array((np.arange(len(flat)) < valid).astype(np.uint8))
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.writer, self.out, self.docs, self.docs_out):
            x.close()


class Shard:
    """Reads a shard; batches are views of the memory map where the store has one."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, at = filesystem(path)
        self.store, self.path = store, at
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(at) if local else store.open_input_file(at)
        reader = pa.ipc.open_stream(self.source)
        self.schema, self.begin = reader.schema, self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.batch_bytes = self.rows = 0
        try:
            self.rows = reader.read_next_batch().num_rows
            self.batch_bytes = self.source.tell() - self.begin
        except StopIteration:
            pass

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of each batch, flat."""
        self.source.seek(0)
        for batch in pa.ipc.open_stream(self.source):
            yield _flat(batch)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i``, by arithmetic: no other batch is read, neither ids nor mask are copied."""
        if not self.rows or i < 0:
            raise IndexError(i)
        self.source.seek(self.begin + i // self.rows * self.batch_bytes)
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        except EOFError:
            raise IndexError(i) from None
        k = i % self.rows
        if k >= batch.num_rows:
            raise IndexError(i)
        return tuple(c.values.slice(k * self.length, self.length).to_numpy(zero_copy_only=True) for c in batch.columns)

    def documents(self) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
        """(doc_id, start in the shard, number of tokens, ids), in order; holds a batch and a document."""
        held, at, blocks = np.empty(0, self.schema.field("ids").type.value_type.to_pandas_dtype()), 0, self.batches()
        with self.store.open_input_stream(self.path + ".docs") as f:
            for batch in pa.ipc.open_stream(f):
                for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                    parts, have = [held[start - at :]], len(held) - (start - at)
                    while have < n:
                        ids, mask = next(blocks)
                        ids = ids[: int(mask.sum())] if not mask[-1] else ids
                        parts.append(ids)
                        have += len(ids)
                    if len(parts) > 1:
                        held, at = np.concatenate(parts), start
                    yield doc_id, start, n, held[start - at : start - at + n]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(c.values.to_numpy(zero_copy_only=True) for c in batch.columns)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, directory: str, length: int = 2048, rows: int = 64) -> DataFrame:
    """Encode whole texts in ascending doc_id order into shards below ``directory``.

    Returns the manifest (one row per shard, in order).  One range shuffle of the
    compressed texts by doc_id; each task encodes and writes its own range, with bounded memory.
    Null text counts as empty (its end id alone); a null doc_id comes first; rows
    with the same doc_id are ordered by their compressed text; an empty table gives no shard; other
    columns are ignored.
    """
    def run(batches):
        import os

        encoder = library_encoder(tokenizer)
        kind = id_type(max(end_id + 1, encoder.tokenizer.get_vocab_size()))
        end, writer, shard = np.array([end_id], np.uint32), None, 0
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for doc_id, text, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    path = f"{directory}/shard-{shard:06d}-{uuid.uuid4().hex}.arrows"
                    store, at = filesystem(path)
                    store.create_dir(os.path.dirname(at), recursive=True)
                    writer = ShardWriter(path, length, rows, kind)
                text = unzip(text).decode() if text is not None else None
                writer.add(doc_id, np.concatenate([np.frombuffer(encoder.ids(text), "<u4"), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    def zipped(batches):
        zip_ = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = [None if x is None else zip_(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(zipped, "doc_id long, text binary")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return cut(ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start among all documents, n_tokens, ids_crc32.

    ``ids_crc32`` is the crc32 of the ids as little-endian unsigned 32-bit integers.
    The window runs over one small row per shard, not over documents.
    """
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, start, n, ids in Shard(path).documents():
                    rows.append((doc_id, base + start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    shards = max(1, manifest.count())  # one row of the manifest is one file
    return based.select("path", "base", "shard").repartition(shards, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, work_path(docs.sparkSession, "tokens"), length))
