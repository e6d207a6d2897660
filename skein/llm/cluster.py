"""What the operators share: durable intermediate tables, bounded groups, connected components.

Intermediates are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: they outlive executors, cut the lineage and are
readable everywhere (:mod:`skein.plans.runtime`).
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import runtime
from ..plans.runtime import discard, new_path
from ..plans.runtime import durable as materialize

__all__ = ["BATCH_BYTES", "Forest", "bytes_of", "connected_components", "discard", "ensure_workers", "materialize", "new_path", "partitions_for", "runs", "slices", "worker_cache"]

_kept: dict[str, dict] = {}
#: Bytes of text in one Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep their batches small: else thousands of very long texts are one batch."""
    runtime.ensure_workers(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator. Workers serve many operators in turn: when the owner changes, the former's memory goes back to the system."""
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform.startswith("linux"):
            ctypes.CDLL(None).malloc_trim(0)
        _kept[owner] = {}
    return _kept[owner]


def partitions_for(spark: SparkSession, source: DataFrame | None = None, most_bytes: int = 256 << 20) -> int:
    """How many partitions to deal out to: the session's number of shuffle partitions, or more if those of ``source``, by the size of its files, would be over ``most_bytes``."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if source is None:
        return n
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, min(-(-size // most_bytes), 1 << 20))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each string, empty for null; skips the detour over Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 4096, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``rows`` rows and about ``most`` bytes of column ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = min(at + rows, int(np.searchsorted(size, base + most, side="right")), batch.num_rows)
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal ``keys`` from batches sorted by them. Groups must be of bounded size: one is held at a time."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            this = tuple(c[a].item() for c in cols)
            if key is not None and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if key is not None:
        yield key, pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 whose links arrive as arrays; the smallest member is each tree's root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that isn't its own root: a star for each tree."""
        all_ = np.arange(len(self.parent))
        root = self.roots(all_)
        inner = root != all_
        return all_[inner], root[inner]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Distributed components of an undirected graph ``edges(src, dst)`` of longs.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    every node hangs directly on its component's smallest node; rounds grow with
    the logarithm of the longest chain. Each step is a minimum per key (combined
    before the shuffle) joined back, so no node's neighbours are ever gathered in
    one place, and each round's links, never more than the first, are a table in
    the shared folder. Loops, repeated links and nulls are ignored.

    Returns ``node, component`` for every node with a link to another node.
    """
    e = materialize(
        edges.filter("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        nxt = materialize(small.select("x.a", "x.b").filter("a != b").distinct(), "links")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
