"""Best-fit packing of documents into fixed-length token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .cluster import ensure_workers, slices
from .tokenizing import encoder, tokenizer_path


class OpenBins:
    """Bounded-space online best-fit.

    At most ``most`` bins are open, keyed by free space in a bitset: bit f is set
    if some open bin has f tokens free, so the tightest bin that fits is the
    lowest set bit from the piece's length up. When one bin too many is open, the
    fullest closes.
    """

    def __init__(self, size: int, most: int, first_id: int) -> None:
        self.size, self.most, self.next_id = size, most, first_id
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.n_open = 0

    def _take(self, space: int) -> int:
        stack = self.free[space]
        out = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.n_open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        """(bin id, offset in the bin) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            where = self._take(space)
        else:
            space, where = self.size, self.next_id
            self.next_id += 1
        left = space - length
        if left:
            if not self.free[left]:
                self.bits |= 1 << left
            self.free[left].append(where)
            self.n_open += 1
            if self.n_open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return where, self.size - space


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones after a first that may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def _fewer(docs: DataFrame, least_rows: int) -> DataFrame:
    """The rows in no more partitions than two for each core or one for ``least_rows`` rows, whichever is more; without a shuffle."""
    most = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // least_rows), 1)
    return docs.coalesce(most) if docs.rdd.getNumPartitions() > most else docs


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 2048, open_bins: int = 16384, least_rows: int = 1 << 16) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``length`` tokens.

    A document's ids (whole text, null as empty, no special tokens) end with
    ``end_id``. One longer than ``length`` is cut into full pieces after a first
    that may be shorter. Every task packs what it reads, without a shuffle: a
    batch's pieces, the longest first, go to the fullest open bin that takes them
    (:class:`OpenBins`). Bins stay open from batch to batch, at most
    ``open_bins`` of them, so memory doesn't depend on the input. A task leaves its
    last bins part-filled, most of a sequence in all; so that this doesn't add up, small
    partitions are read together by one task (:func:`_fewer`).

    Returns one row per piece: ``doc_id, piece, start, length, ids`` (little-endian
    unsigned 32-bit), ``sequence_id`` (unique, not dense) and ``offset`` (gapless
    from 0 in each sequence). Other columns of ``docs`` are ignored. Null ids and
    repeated rows are packed like any other row; an empty table gives no rows.
    """
    ensure_workers(docs.sparkSession)
    path = tokenizer_path(tokenizer)
    end = np.uint32(end_id).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bins = OpenBins(length, open_bins, TaskContext.get().partitionId() << 33)
        for batch in slices(batches, "text", rows=16384):
            ids = [x + end for x in enc.ids([t or "" for t in batch.column(1).to_pylist()])]
            cut = [(row, k, s, n) for row, x in enumerate(ids) for k, (s, n) in enumerate(pieces_of(len(x) // 4, length))]
            where: list[tuple[int, int]] = [(0, 0)] * len(cut)
            for i in sorted(range(len(cut)), key=lambda i: -cut[i][3]):
                where[i] = bins.put(cut[i][3])
            for a in range(0, len(cut), 4096):
                part, at = cut[a : a + 4096], where[a : a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()).take(pa.array([c[0] for c in part], pa.int64())),
                        pa.array([c[1] for c in part], pa.int32()),
                        pa.array([c[2] for c in part], pa.int64()),
                        pa.array([c[3] for c in part], pa.int64()),
                        pa.array([ids[r][4 * s : 4 * (s + n)] for r, _, s, n in part], pa.binary()),
                        pa.array([w[0] for w in at], pa.int64()),
                        pa.array([w[1] for w in at], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return _fewer(docs.select("doc_id", "text"), least_rows).mapInArrow(pack, SCHEMA)
