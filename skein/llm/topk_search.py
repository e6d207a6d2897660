"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import meet
from .cluster import discard, ensure_workers, materialize
from .embedding_dedup import usable

#: Every integer up to this is a double, so products of doubles below it are exact.
EXACT = 2**53
#: Scores are signed 64-bit integers.
MOST = 2**63


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component, as whole doubles; only vectors with finite components and an id."""
    good = vectors.filter(usable()).filter("vec_id is not null")
    # floor of a double is a long: numbers beyond one are whole already
    whole = lambda x: F.when(F.abs(x) < float(EXACT), F.floor(F.when(F.abs(x) < float(EXACT), x).otherwise(0.0)).cast("double")).otherwise(x)
    return good.select("vec_id", F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"))


def scores(q: np.ndarray, c: np.ndarray, bound: int) -> np.ndarray:
    """Integer inner products, exact: as doubles if none can reach 2**53 (``bound``: the largest possible size), else as 64-bit integers."""
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _number(largest: float) -> np.dtype:
    return np.dtype(next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", MOST)) if largest < top))


BLOCK = "dim int, n int, ids binary, v binary"


def _blocks(rows: DataFrame, number: np.dtype, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``dim, n, ids, v, ...``: up to ``size`` vectors ``rows(vec_id, v, ...)`` of one length in a row, as packed integers; ``extra`` are columns of longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int):
            ids, v, *more = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([v.tobytes()]), *[pa.array([m.tobytes()]) for m in more]], names=["dim", "n", "ids", "v", *extra])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                for a in range(0, part.num_rows, size):
                    sub = part.slice(a, size)
                    v = np.asarray(sub.column(1).flatten()).reshape(-1, dim).astype(number)
                    held.setdefault(dim, []).append((np.asarray(sub.column(0), "<i8"), v, *[np.asarray(sub.column(2 + k), "<i8") for k in range(len(extra))]))
                    if sum(len(h[0]) for h in held[dim]) >= size:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return rows.select("vec_id", "v", *extra).mapInArrow(pack, ", ".join([BLOCK, *[f"{e} binary" for e in extra]]))


def _meet(blocks: DataFrame, queries: DataFrame, number: np.dtype, query_block: int, query_bytes: int, most_bytes: int) -> DataFrame:
    """Each block of candidates beside each block of queries of its length. The packed queries go to every task if they are at most ``most_bytes``; beyond that both sides are dealt out to blocks of an equi-join."""
    packed = _blocks(queries, number, query_block, ("lo", "hi", "need")).select("dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("v").alias("qv"), "lo", "hi", "need")
    if query_bytes <= most_bytes:
        return blocks.join(F.broadcast(packed), "dim")
    both = meet(blocks, "ids", packed.withColumnRenamed("dim", "qdim"), "qids")
    return both.filter("dim = qdim").drop("qdim")


def _read(batches: Iterator[pa.RecordBatch], number: np.dtype, bound: int, step: int = 2048):
    """From rows of :func:`_meet`: the queries' columns, candidates' ids and scores, candidates in parts of up to ``step``."""
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            get = lambda name: batch.column(at[name])[i].as_py()  # noqa: E731, B023
            dim = get("dim")
            q = {"vec_id": np.frombuffer(get("qids"), "<i8"), **{k: np.frombuffer(get(k), "<i8") for k in ("lo", "hi", "need")}}
            qv = np.frombuffer(get("qv"), number).reshape(-1, dim)
            ids, v = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("v"), number).reshape(-1, dim)
            for a in range(0, len(ids), step):
                yield q, ids[a : a + step], scores(qv, v[a : a + step], bound)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, buckets: int = 512, query_block: int = 1024, block: int = 4096, most_bytes: int = 32 << 20) -> DataFrame:
    """The ``k`` best candidates of every query, exactly, ties to the smaller id.

    Takes ``vectors(vec_id, embedding)``; ``is_query`` is a condition on them.
    Candidates of a query are all other rows. A score is the integer inner product
    of the vectors' :func:`quantize` forms; vectors whose scores might not fit 64 bits
    raise an error. The candidates are packed once into blocks of up to ``block``
    vectors in a row, in the smallest integers that hold them, and stay where they are:
    each round sends the packed queries (:func:`_meet`, by a check of their size),
    scores everything and sums per query a histogram of ``buckets`` equal buckets over
    the range that still holds its kth score. A task sends only the buckets from the
    top down to its own kth score, as the global one isn't lower: k + 1 rows for a query
    at most. The bucket with the kth score is the next range, until it is one number
    wide; the last round scores once more, keeps what isn't below, and at the kth score
    the smaller ids. Rounds are the logarithm of the score range to the base
    ``buckets``.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``; fewer than k rows where
    fewer candidates exist. Null vectors, ones with null or non-finite components,
    and null ids take no part; vectors of other lengths don't meet; rows with the
    query's id are its own. Repeated ids are separate candidates, and one query
    (the smallest vector counts). Empty input: no rows.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    rest = quantize(vectors.select("vec_id", "embedding"), scale).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    largest = rest.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    top, dim = largest[0] or 0.0, largest[1] or 0
    if top >= MOST or (bound := int(top) ** 2 * dim + 1) >= MOST:
        raise ValueError(f"scores of {dim} components up to {top} may not fit 64 bits")
    number = _number(top + 1)
    blocks = materialize(_blocks(rest, number, block), "blocks")
    queries = materialize(rest.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    query_bytes = queries.count() * (dim * number.itemsize + 32)
    # the kth score lies in [lo, hi); `need` candidates of that range are still to find
    state = materialize(queries.select("vec_id", F.lit(-bound).cast("long").alias("lo"), F.lit(bound + 1).cast("long").alias("hi"), F.lit(k).cast("long").alias("need")), "state")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[dict, np.ndarray]] = {}  # sums over a task's candidates, for some blocks of queries at a time

        def done():
            for q, hist in held.values():
                upto = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # from this bucket to the top
                x, y = np.nonzero((hist > 0) & (upto - hist < np.minimum(q["need"], k)[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(q["vec_id"][x]), pa.array(y.astype(np.int32)), pa.array(hist[x, y])], names=["vec_id", "bucket", "n"])
            held.clear()

        for q, ids, s in _read(batches, number, bound):
            name = q["vec_id"].tobytes()
            if name not in held:
                if len(held) >= 8:
                    yield from done()
                held[name] = q, np.zeros((len(q["vec_id"]), buckets), np.int64)
            hist = held[name][1]
            lo, hi = q["lo"][:, None], q["hi"][:, None]
            # in unsigned numbers, so that the width of the whole range fits
            width = np.maximum(((hi.astype(np.uint64) - lo.astype(np.uint64)) + np.uint64(buckets - 1)) // np.uint64(buckets), np.uint64(1))
            r, c = np.nonzero((s >= lo) & (s < hi) & (ids != q["vec_id"][:, None]))
            b = ((s[r, c].astype(np.uint64) - q["lo"][r].astype(np.uint64)) // width[r, 0]).astype(np.int64)
            hist += np.bincount(r * buckets + b, minlength=hist.size).reshape(hist.shape)
        yield from done()

    while True:
        widest = state.agg(F.max(F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)"))).first()[0]
        if widest is None or widest <= 1:
            break
        met = _meet(blocks, queries.join(state, "vec_id"), number, query_block, query_bytes, most_bytes)
        counts = met.mapInArrow(histogram, "vec_id long, bucket int, n long").groupBy("vec_id", "bucket").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bucket"))  # a row for each bucket at most
        span = F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)")
        found = (
            counts.join(state, "vec_id")
            .withColumn("upto", F.sum("n").over(down))
            .withColumn("before", F.col("upto") - F.col("n"))
            .filter("before < need and upto >= need")
            .withColumn("width", F.greatest(F.floor((span + (buckets - 1)) / buckets).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")))
            .select(
                "vec_id",
                (F.col("lo") + F.col("bucket") * F.col("width")).cast("long").alias("new_lo"),
                F.least(F.col("hi").cast("decimal(38,0)"), F.col("lo") + (F.col("bucket") + 1) * F.col("width")).cast("long").alias("new_hi"),
                (F.col("need") - F.col("before")).alias("left"),
            )
        )
        # fewer than `need` candidates in all: everything counts
        nxt = state.join(found, "vec_id", "left").select("vec_id", F.coalesce("new_lo", "lo").alias("lo"), F.when(F.col("new_lo").isNull(), F.col("lo")).otherwise(F.col("new_hi")).alias("hi"), F.coalesce("left", "need").alias("need"))
        before, state = state, materialize(nxt, "state")
        discard(before)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part of candidates what reaches the kth score; of equal scores at most k, the smallest ids."""
        for q, ids, s in _read(batches, number, bound):
            x, y = np.nonzero((s >= q["lo"][:, None]) & (ids != q["vec_id"][:, None]))
            if not len(x):
                continue
            val, cand = s[x, y], ids[y]
            order = np.lexsort((cand, -val, x))
            x, val, cand = x[order], val[order], cand[order]
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
            keep = place < k
            yield pa.RecordBatch.from_arrays([pa.array(q["vec_id"][x[keep]]), pa.array(cand[keep]), pa.array(val[keep])], names=["query_id", "vec_id", "score"])

    hits = _meet(blocks, queries.join(state, "vec_id"), number, query_block, query_bytes, most_bytes).mapInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
