"""Embedding near-duplicates: random-hyperplane hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Forest, connected_components, ensure_workers, materialize, partitions_for, runs


def usable(column: str = "embedding") -> F.Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def plan_tables(n: int, cosine: float, bucket: int = 1024, recall: float = 0.998) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` among ``n`` scattered vectors, and enough tables that a pair at exactly ``cosine`` shares a bucket of one with probability ``recall``."""
    bits = min(max(round(math.log2(max(n, 1) / bucket)), 4), 30)
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - alike))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """[rows, tables] bucket numbers: the signs of the products with each table's hyperplanes."""
    signs = (v @ planes(v.shape[1], bits, tables, seed)).reshape(len(v), tables, bits) > 0
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit integers of one step for each vector, and that step; see :func:`unpack`."""
    step = np.abs(v).max(axis=1) / 32767
    return np.rint(v / step[:, None]).astype("<i2"), step


def unpack(q: np.ndarray, step: np.ndarray) -> np.ndarray:
    return q * step[:, None]


def error(dim: int) -> float:
    """How far the cosine of two packed unit vectors can be from that of the vectors: each is off by half a step in every component, at most 1 / 65534."""
    e = math.sqrt(dim) / 65534
    return 2 * e + e * e + 1e-12


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, bucket: int = 1024, recall: float = 0.998, tile: int = 4096, seed: int = 7) -> DataFrame:
    """Link vectors with cosine >= ``cosine``; count links and name each one's component.

    Takes ``vectors(vec_id, embedding)``, other columns ignored. Equal vectors are
    one class first. Each class goes to one bucket in each of several tables of
    sign hashes (:func:`plan_tables`; nothing caps a bucket: one with more than
    ``tile`` classes is split into tiles, each pair of which is compared). Buckets get
    the unit vectors as 16-bit integers with each table's bucket beside; all cosines of
    a tile pair are computed from those, with a bound on the rounding. Pairs that the
    bound leaves open, a few in a million, are decided by the vectors themselves in
    double precision; a pair that several tables find counts in the first. Tile pairs
    send each class's number of links and a spanning star of them, never the pairs.
    Vectors of different lengths don't link.

    Returns a row per input row: ``vec_id, n_links`` (other vectors linked
    directly), ``component_id`` (smallest vec_id reachable, itself included),
    ``kept`` (vec_id = component_id). Null, empty, zero vectors and those with null
    or non-finite components link with nothing: n_links 0, a component of their
    own. A null vec_id never names a component. Empty input: no rows.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), usable().alias("ok"))
    rows = rows.withColumn("ok", F.col("ok") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    # equal vectors: -0.0 and 0.0 are the same number
    keyed = rows.select("vec_id", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0).cast("float" if "float" in dict(rows.dtypes)["v"] else "double"))).alias("v"))
    hashed = keyed.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    members = materialize(hashed.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("ok")), "members")
    grouped = hashed.filter("v is not null").groupBy("h1", "h2", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = materialize(grouped.withColumn("class", F.xxhash64("h1", "h2")), "classes")
    n = classes.count()
    bits, tables = plan_tables(n, cosine, bucket, recall)
    kind = np.dtype("<u1") if bits <= 8 else np.dtype("<u2") if bits <= 16 else np.dtype("<u4")

    def by_length(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            sizes = np.asarray(batch.column(column).value_lengths())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for a in range(0, part.num_rows, 1024):
                    yield dim, part.slice(a, 1024)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes of a task's parts of the buckets."""
        for dim, part in by_length(batches, 0):
            sig = signatures(_unit(matrix(part.column(0))), bits, tables, seed)
            for t in range(tables):
                at, c = np.unique(sig[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(np.full(len(at), dim, np.int32)), pa.array(c)], names=["table", "bucket", "dim", "n"])

    place = ["table", "bucket", "dim"]
    sizes = classes.select("v").mapInArrow(count, "table int, bucket long, dim int, n long").groupBy(*place).agg(F.sum("n").alias("n"))
    big = materialize(sizes.filter(F.col("n") > tile).select(*place, F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "tiles", few_files=True)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in by_length(batches, 1):
            v = _unit(matrix(part.column(1)))
            sig, (q, step) = signatures(v, bits, tables, seed), pack(v)
            k = part.num_rows
            own = pa.array([x.tobytes() + s.tobytes() for x, s in zip(q, sig.astype(kind), strict=True)], pa.binary())
            take = pa.array(np.repeat(np.arange(k), tables))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(tables, dtype=np.int32), k)), pa.array(sig.ravel()), pa.array(np.full(k * tables, dim, np.int32)), part.column(0).take(take), part.column(2).take(take), pa.array(step).take(take), own.take(take)],
                names=[*place, "class", "copies", "step", "q"],
            )

    spots = classes.select("class", "v", "copies").mapInArrow(bucketed, "table int, bucket long, dim int, class long, copies long, step double, q binary")
    placed = spots.join(big, place, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))) if not big.isEmpty() else spots.withColumn("tiles", F.lit(1))
    placed = placed.withColumn("tile", F.pmod("class", "tiles").cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = met.select(*place, F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "class", "copies", "step", "q")
    key = [*place, "left", "right"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of links and stars, and of open pairs (``other``)."""
        out: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == a), pa.array(c), pa.array(d, mask=c >= 0)], names=["class", "root", "links", "other"])

        for (table, _, dim, left, right), group in runs(batches, key):
            if group.num_rows < 2:
                continue
            raw = b"".join(group.column("q").to_pylist())
            own = np.frombuffer(raw, np.uint8).reshape(group.num_rows, -1)
            v = unpack(np.ascontiguousarray(own[:, : 2 * dim]).view("<i2"), np.asarray(group.column("step")))
            sig = np.ascontiguousarray(own[:, 2 * dim :]).view(kind)[:, :table]
            ids, tiles, copies = np.asarray(group.column("class")), np.asarray(group.column("tile")), np.asarray(group.column("copies"))
            one, two = np.flatnonzero(tiles == left), np.flatnonzero(tiles == right)
            forest, links, slack = Forest(len(ids)), np.zeros(len(ids), np.int64), error(dim)
            step = max(1, (1 << 20) // max(len(two), 1))
            for a in range(0, len(one), step):
                i = one[a : a + step]
                c = v[i] @ v[two].T
                hit = c >= cosine - slack
                if left == right:
                    hit &= i[:, None] < two  # each pair once
                r, s = np.nonzero(hit)
                if not len(r):
                    continue
                x, y, sure = i[r], two[s], c[r, s] >= cosine + slack
                first = ~(sig[x] == sig[y]).any(axis=1)
                open_ = first & ~sure
                if open_.any():
                    k = int(open_.sum())
                    out.append((ids[x[open_]], ids[x[open_]], np.full(k, -1), ids[y[open_]]))
                    held += k
                x, y = x[first & sure], y[first & sure]
                links += np.bincount(x, weights=copies[y], minlength=len(ids)).astype(np.int64) + np.bincount(y, weights=copies[x], minlength=len(ids)).astype(np.int64)
                forest.link(x, y)
            some = np.flatnonzero(links)
            if len(some):
                out.append((ids[some], ids[forest.roots(some)], links[some], ids[some]))
                held += len(some)
            if held >= 20_000:
                yield flush()
                held = 0
        if out:
            yield flush()

    found = materialize(pairs.repartition(partitions_for(spark), *key).sortWithinPartitions(*key).mapInArrow(compare, "class long, root long, links long, other long"), "links")
    vector = classes.select("class", "v", "copies")
    asked = found.filter("other is not null").select("class", "other")
    both = asked.join(vector.toDF("class", "v1", "c1"), "class").join(vector.toDF("other", "v2", "c2"), "other").select("class", "other", "v1", "v2", "c1", "c2")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in by_length(batches, 2):
            yield part.filter(pa.array(np.einsum("ij,ij->i", _unit(matrix(part.column(2))), _unit(matrix(part.column(3)))) >= cosine)).select([0, 1, 4, 5])

    near = materialize(both.mapInArrow(decide, "class long, other long, c1 long, c2 long"), "near", few_files=True)
    sure = found.filter("other is null")
    stars = sure.filter("root is not null").select(F.col("class").alias("src"), F.col("root").alias("dst")).union(near.select("class", "other"))
    component = connected_components(stars)
    links = sure.select("class", "links").union(near.select("class", "c2")).union(near.select("other", "c1")).groupBy("class").agg(F.sum("links").alias("links"))
    labelled = (
        classes.select("class", "h1", "h2", "copies", "first_id")
        .join(links, "class", "left")
        .join(component.withColumnRenamed("node", "class"), "class", "left")
        .select("h1", "h2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("root"))
    )
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("h1", "h2", "n_links", "component_id")
    out = members.filter("ok").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = members.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
