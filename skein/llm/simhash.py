"""SimHash near-duplicates by tiled exact comparison of all fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Forest, bytes_of, connected_components, ensure_workers, materialize, partitions_for, runs, slices, worker_cache

BITS = 64


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text over word shingles: a bit is set if over half the shingles' hashes have it; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1])).tolist()
        last = (ends - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, last[shingle - 1 :], strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the 64-bit hashes have. Blocks of hashes keep memory small for long texts."""
    count = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 8192):
        part = hashes[a : a + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row of ``docs(doc_id, text)``; null text as empty."""
    ensure_workers(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle, seed) for t in bytes_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


def _segments(fp: np.ndarray, width: int) -> np.ndarray:
    """Population counts of each fingerprint's segments of ``width`` bits."""
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & mask) for s in range(0, BITS, width)], axis=1).astype(np.int16)


def _cells(fp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by segment counts, the distinct count vectors and where each one's run starts (and the end)."""
    counts = _segments(fp, width)
    order = np.lexsort(counts.T)
    run, starts = np.unique(counts[order], axis=0, return_index=True) if len(fp) else (counts, np.zeros(0, np.int64))
    by = np.argsort(starts)
    return order, run[by], np.append(starts[by], len(fp))


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) that connect what pairs within ``radius`` bits connect, among ``a`` or across ``a`` and ``b``.

    Positions count through a, then b. Fingerprints within a tile are split by the
    population counts of their halves or quarters: the sum of the differences of
    two such vectors is at most the Hamming distance, so pairs of cells beyond the
    radius are skipped and the rest compared by exclusive-or and bit counts.
    """
    both = a if b is None else np.concatenate((a, b))
    forest, off = Forest(len(both)), 0 if b is None else len(a)
    width = 32 if len(both) < 1 << 14 else 16
    oa, ca, sa = _cells(a, width)
    ob, cb, sb = (oa, ca, sa) if b is None else _cells(b, width)
    va, vb = a[oa], (a if b is None else b)[ob]
    for i in range(len(ca)):
        near = np.flatnonzero(np.abs(cb[i if b is None else 0 :] - ca[i]).sum(axis=1) <= radius) + (i if b is None else 0)
        if not len(near):
            continue
        cols = np.concatenate([np.arange(sb[j], sb[j + 1]) for j in near])
        right = vb[cols]
        left = va[sa[i] : sa[i + 1]]
        step = max(1, 262_144 // len(right))
        for r in range(0, len(left), step):
            hit = np.bitwise_count(left[r : r + step, None] ^ right) <= radius
            if hit.any():
                x, y = np.nonzero(hit)
                forest.link(oa[sa[i] + r + x], off + ob[cols[y]])
    return forest.edges()


def simhash_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tiles: int = 24, least_tile: int = 2048, most_tile: int = 1 << 17) -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or by others, at ``radius`` or fewer differing bits.

    Takes ``docs(doc_id, text)``, other columns ignored. Equal fingerprints are one
    class first, so copies cost nothing further. The distinct fingerprints are cut
    into tiles in order of population count: about ``tiles`` of them, of
    ``least_tile`` to ``most_tile`` fingerprints, a frequent count split by hash.
    A tile meets the later ones whose counts lie within the radius and itself; the
    rest, which cannot hold links, never meet. Each meeting sends a spanning star of
    its links, not the pairs, to distributed connected components. To the driver
    come the 65 population counts only.

    Returns ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id`` (the
    smallest doc_id of the group), a row per input row. Texts without words have
    fingerprint zero and link like any other. Null ids never name a group; a group
    of null ids only has a null component_id. Empty input: no rows.
    """
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, shingle, seed), "fingerprints", few_files=True)
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("ones", F.bit_count("fp")), "classes")
    edges = _class_links(classes, radius, tiles, least_tile, most_tile)
    member = connected_components(edges)  # of fp, by any label: the root is turned into the smallest doc_id below
    labelled = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns, without the documents that a smaller doc_id of their group stands for.

    Of rows with the same id one stays; documents without an id stay. The texts move
    once, to where the kept ids are, in the same way at every size, and aren't sorted.
    """
    first = simhash_groups(docs, **options).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_doc_id")).agg(F.count("*").alias("times"))
    first = materialize(first, "kept")
    key = docs["doc_id"] == F.col("kept_doc_id")
    out = docs.join(first.filter("times = 1").hint("shuffle_hash"), key, "left_semi").union(docs.filter(docs["doc_id"].isNull()))
    again = first.filter("times > 1")
    return out if again.isEmpty() else out.union(docs.join(again.hint("shuffle_hash"), key, "left_semi").dropDuplicates(["doc_id"]))


def _class_links(classes: DataFrame, radius: int, tiles: int, least_tile: int, most_tile: int) -> DataFrame:
    spark = classes.sparkSession
    counts = {ones: n for ones, n in classes.groupBy("ones").count().collect()}
    size = min(max(sum(counts.values()) // tiles, least_tile), most_tile)
    # tile numbers ascend with the population count: [first tile, tiles] of each count
    place: dict[int, tuple[int, int]] = {}
    tile, room = 0, size
    for ones in sorted(counts):
        if counts[ones] > room and room < size:
            tile, room = tile + 1, size
        split = -(-counts[ones] // size)
        place[ones] = (tile, split)
        if split > 1:
            tile, room = tile + split, size
        else:
            room -= counts[ones]
    rows = []
    for ones, (first, split) in place.items():
        own = [o for o, t in place.items() if t == (first, split)]  # counts that share the tile
        lo, hi = min(own), max(own)
        met = [t for o, t in place.items() if lo - radius <= o <= hi + radius]
        rows.append((ones, first, split, min(f for f, _ in met), max(f + s - 1 for f, s in met)))
    if not rows:
        return spark.createDataFrame([], "src long, dst long")
    table = F.broadcast(spark.createDataFrame(rows, "ones int, first int, split int, lo int, hi int"))  # 65 rows at most
    tiled = classes.select("fp", "ones").join(table, "ones").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("split"))).cast("int"))
    met = tiled.select("fp", "tile", F.explode(F.sequence("lo", "hi")).alias("other"))
    pairs = met.select(F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "fp")
    n = partitions_for(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for (left, right), group in runs(batches, ["left", "right"]):
            tile, fp = np.asarray(group.column("tile")), np.asarray(group.column("fp")).view(np.uint64)
            a, b = fp[tile == left], None if left == right else fp[tile == right]
            if not len(a) or b is not None and not len(b):
                continue
            every = a if b is None else np.concatenate((a, b))
            x, y = link_tiles(a, b, radius)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(every[x].view(np.int64)), pa.array(every[y].view(np.int64))], names=["src", "dst"])

    return pairs.repartition(n, "left", "right").sortWithinPartitions("left", "right").mapInArrow(compare, "src long, dst long")
