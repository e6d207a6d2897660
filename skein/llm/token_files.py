"""Token-id files: blocks of ids as byte or bit planes, each compressed, with a chunk index.

A file holds whole documents in order. Layout, little-endian:

    b"SKNPLN01"
    for each block of up to ``block`` ids: its planes, each a zstandard frame,
        least significant first (4 byte planes or 32 bit planes)
    document table: a zstandard frame of int64 doc ids, int64 token counts, uint8 null flags
    index: int64 [blocks, planes + 2]: offset of the block, its ids, each plane's bytes
    footer: int64 document table offset, its bytes, documents, index offset, blocks, planes, block size
    b"SKNPLN01"
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ensure_workers, materialize, new_path, partitions_for, slices
from .tokenizing import encoder, tokenizer_path

MAGIC = b"SKNPLN01"


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The block's planes: byte k of every id, or bit k of every id packed eight to a byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel() if n else np.zeros(0, "<u4")
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel() if n else np.zeros(0, "<u4")


class PlaneWriter:
    """Writes one file; holds one block of ids and its documents' table."""

    def __init__(self, sink, block: int, bits: bool, level: int) -> None:
        self.sink, self.block, self.bits = sink, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held, self.n_ids = 0, [], 0, 0
        self.index: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self, ids: np.ndarray) -> None:
        at = self.at
        planes = [self.zstd.compress(p) for p in split_planes(ids, self.bits)]
        for p in planes:
            self._put(p)
        self.index.append([at, len(ids), *map(len, planes)])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, n))
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n
        if self.n_held >= self.block:
            every = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(every) // self.block * self.block
            for a in range(0, whole, self.block):
                self._flush(every[a : a + self.block])
            self.held, self.n_held = [every[whole:].tobytes()], len(every) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(np.frombuffer(b"".join(self.held), "<u4"))
        table = self.at
        parts = (np.array([d or 0 for d, _ in self.docs], "<i8"), np.array([n for _, n in self.docs], "<i8"), np.array([d is None for d, _ in self.docs], np.uint8))
        self._put(self.zstd.compress(b"".join(p.tobytes() for p in parts)))
        index, planes = self.at, 32 if self.bits else 4
        self._put(np.array(self.index, "<i8").tobytes())
        self._put(np.array([table, index - table, len(self.docs), index, len(self.index), planes, self.block], "<i8").tobytes() + MAGIC)


class PlaneReader:
    """Random access to a file's blocks by its index, and its documents in order, one block in memory."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 64)
        tail = source.read(64)
        if tail[56:] != MAGIC:
            raise ValueError("not a complete token-id file")
        table, bytes_, n, index, blocks, planes, self.block = np.frombuffer(tail[:56], "<i8").tolist()
        self.zstd = zstandard.ZstdDecompressor()
        source.seek(table)
        raw = self.zstd.decompress(source.read(bytes_), max_output_size=17 * n)
        self.doc_ids, self.counts = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 16 * n], "<i8")
        self.null = np.frombuffer(raw[16 * n :], np.uint8).astype(bool)
        source.seek(index)
        self.index = np.frombuffer(source.read(8 * blocks * (planes + 2)), "<i8").reshape(blocks, planes + 2)

    def ids(self, k: int) -> np.ndarray:
        """Block ``k``."""
        at, n, *sizes = self.index[k].tolist()
        self.source.seek(at)
        raw, out, a = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            out.append(self.zstd.decompress(raw[a : a + s], max_output_size=max(n, 1)))
            a += s
        return join_planes(out, n)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc id, ids before it in this file, its ids)."""
        held, at, k, start = b"", 0, 0, 0
        for doc_id, n, null in zip(self.doc_ids.tolist(), self.counts.tolist(), self.null.tolist(), strict=True):
            parts, need = [], 4 * n
            while need > 0:
                if at == len(held):
                    held, at, k = self.ids(k).tobytes(), 0, k + 1
                parts.append(held[at : at + need])
                at += len(parts[-1])
                need -= len(parts[-1])
            yield (None if null else doc_id), start, b"".join(parts)
            start += n


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _folder_uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as pyarrow's file systems want it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


FILES = "part int, shard int, name string, n_docs long, n_ids long, ids_before long"


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, block: int = 1 << 16, shard_ids: int = 1 << 22, bits: bool = False, level: int = 3) -> tuple[str, DataFrame]:
    """Encode ``docs(doc_id, text)`` and write token-id files in ascending doc_id order.

    Whole texts (null as empty), no special tokens, ``end_id`` after each document.
    Documents are dealt out by ranges of doc_id; each task sorts its range (equal
    ids by text, nulls first), encodes and writes files of about ``shard_ids`` ids
    with whole documents. The folder must be one that all executors reach through
    a file system pyarrow knows; default: in the shared folder. A task writes
    under a name of its attempt and then moves the file, so a task that runs
    again replaces its files whole.

    Returns the folder and the table of files in order: ``part, shard, name,
    n_docs, n_ids, ids_before`` (ids of all files before it). Only one number per
    range reaches the driver. Empty input: no files.
    """
    spark = docs.sparkSession
    ensure_workers(spark)
    folder = _folder_uri(spark, folder or new_path(spark, "tokens"))
    path, end = tokenizer_path(tokenizer), np.uint32(end_id).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (fs, base), task = encoder(path), _open(folder), TaskContext.get()
        part, shard, before, out = task.partitionId(), 0, 0, None

        def done():
            nonlocal shard, before, out
            out.close()
            out.sink.close()
            name = f"part-{part:06d}-{shard:06d}.ids"
            fs.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "name": name, "n_docs": len(out.docs), "n_ids": out.n_ids, "ids_before": before}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids_before", pa.int64())]))
            shard, before, out = shard + 1, before + out.n_ids, None
            return row

        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = PlaneWriter(fs.open_output_stream(f"{base}/.part-{part:06d}-{shard:06d}.ids.{task.taskAttemptId()}"), block, bits, level)
                out.add(doc_id, ids + end)
                if out.n_ids >= shard_ids:
                    yield done()
        if out is not None:
            yield done()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions_for(spark, docs), "doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(write, FILES), "files")
    total, start = 0, []
    for part, n in files.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        start.append((part, total))
        total += n
    first = spark.createDataFrame(start, "part int, first long")  # a row for each range
    return folder, files.join(F.broadcast(first), "part").select("part", "shard", "name", "n_docs", "n_ids", (F.col("ids_before") + F.col("first")).alias("ids_before"))


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files; start: ids of all documents before it."""
    spark = files.sparkSession
    ensure_workers(spark)
    folder = _folder_uri(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "start", "ids"])

        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    rows, size = [], 0
                    for doc_id, start, ids in PlaneReader(source).documents():
                        rows.append((doc_id, before + start, ids))
                        size += len(ids)
                        if len(rows) >= 2048 or size >= 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    return files.select("name", "ids_before").repartition(partitions_for(spark)).mapInArrow(read, "doc_id long, start long, ids binary")
