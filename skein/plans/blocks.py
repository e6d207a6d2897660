"""Building blocks of the measures: safe ratios, histograms, ranks, runs, durable steps of iterations."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, durable, ensure_workers

__all__ = ["cumulative", "discard", "durable", "histogram", "in_one_task", "length_distribution", "meet", "order_statistic", "per_group", "positional_rank", "positions", "ratio", "run_lengths", "series_pairs"]


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b as a double; ``default`` where b is 0 or null."""
    out = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return out if default is None else F.coalesce(out, F.lit(default))


def histogram(values: DataFrame, column: str, n_bins: int | Column, interval: tuple[float, float] | None = None) -> DataFrame:
    """``bin, lower, n, share`` of equal-width bins; half-open, the last closed; empty bins have rows.

    Without ``interval`` the range is that of the values (a single value: half a
    unit to either side). ``n_bins`` may be an aggregate of the values.
    """
    v = values.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    bins = n_bins if isinstance(n_bins, Column) else F.lit(int(n_bins))
    lo, hi = (F.min("v"), F.max("v")) if interval is None else (F.lit(float(interval[0])), F.lit(float(interval[1])))
    edges = v.agg(lo.alias("lo0"), hi.alias("hi0"), bins.cast("int").alias("bins")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
        F.greatest("bins", F.lit(1)).alias("bins"),
    )
    one = F.broadcast(edges.withColumn("one", F.lit(1)))  # a single row
    placed = v.withColumn("one", F.lit(1)).join(one, "one").filter("v between lo and hi")
    counts = placed.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    total = Window.partitionBy(F.lit(0))
    out = every.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.col("bins")).alias("lower"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(total)))


def cumulative(hist: DataFrame) -> DataFrame:
    """A histogram with ``cdf``: the share of values in this bin or a higher one."""
    return hist.withColumn("cdf", F.sum("share").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))


def positional_rank(by: str, value: str, position: str) -> Column:
    """Rank from 0 within ``by``; ties by position."""
    return F.row_number().over(Window.partitionBy(by).orderBy(value, position)) - 1


def run_lengths(points: DataFrame, line: list[str], at: str) -> DataFrame:
    """Lengths of the runs of consecutive ``at`` on each line: ``line..., len``."""
    w = Window.partitionBy(*line).orderBy(at)
    return points.withColumn("_island", F.col(at) - F.row_number().over(w)).groupBy(*line, "_island").agg(F.count("*").alias("len")).drop("_island")


def length_distribution(runs: DataFrame, factor: int = 1) -> DataFrame:
    """``len, cnt``: how many runs have each length, times ``factor``."""
    return runs.groupBy("len").agg((F.count("*") * factor).alias("cnt"))


def meet(left: DataFrame, left_key: str, right: DataFrame, right_key: str, blocks: int | None = None) -> DataFrame:
    """All pairs of two tables whose pair table is itself the result, as an equi-join of blocks: every row is sent ``blocks`` times and no side is broadcast.

    By default a block has about 4,096 rows of the larger side, so that the number of
    meetings grows with the tables and none outgrows a task.
    """
    if blocks is None:
        n = max(left.count(), right.count())
        blocks = max(2, math.ceil(n / 4096))
    every = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = left.withColumn("_meet1", F.pmod(F.xxhash64(left_key), F.lit(blocks))).withColumn("_meet2", every())
    b = right.withColumn("_meet2", F.pmod(F.xxhash64(right_key), F.lit(blocks))).withColumn("_meet1", every())
    return a.join(b, ["_meet1", "_meet2"]).drop("_meet1", "_meet2")


def order_statistic(values: DataFrame, column: str, place: Callable[[int], int], buckets: int = 1024) -> float | None:
    """The value at ``place(count)`` (from 0, held to the range) of the sorted values, nulls aside; None without values.

    Histogram refinement: each round counts the values in equal buckets between the
    least and the largest value still in question and goes on with the bucket that
    holds the place, until it holds one value. Rounds are the logarithm of the
    values' spread to the base ``buckets``; the driver gets a row a bucket, no task
    orders the values. Once a bucket has a hundredth of many values or less, these are
    written, so that later rounds don't compute all of them again.
    """
    v = values.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    row = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not row.n:
        return None
    lo, hi, left, want = row.lo, row.hi, row.n, min(max(int(place(row.n)), 0), row.n - 1)
    whole = True
    while lo < hi:
        if whole and row.n > 1_000_000 and 100 * left <= row.n:
            v, whole = durable(v.filter(F.col("v").between(lo, hi)), "in_question", few_files=True), False
        width = hi / buckets - lo / buckets
        b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)) if width > 0 else (F.col("v") > F.lit(lo)).cast("long")
        found = v.filter(F.col("v").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(found, key=lambda r: r.b):
            if want < r.n:
                lo, hi, left = r.lo, r.hi, r.n
                break
            want -= r.n
    if not whole:
        discard(v)
    return lo


def positions(df: DataFrame, by: list[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``by``, which must tell rows apart.

    Rows are dealt out by ranges and written once; places are counted within the
    ranges and moved by the rows before, of which the driver gets a number a range.
    """
    spark = df.sparkSession
    parts = durable(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(parts.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return parts.withColumn("_own", own).join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_part", "_own", "_before")


def per_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``applyInPandas`` with workers that can import this package."""
    ensure_workers(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(f, schema)


def in_one_task(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most_rows: int = 20_000_000) -> DataFrame:
    """An inherently sequential function of a whole table in one task; raises beyond ``most_rows`` rows, never cuts any off."""
    n = df.count()
    if n > most_rows:
        raise ValueError(f"{n} rows in one task; the limit is {most_rows}")
    return per_group(df.withColumn("_all", F.lit(0)), ["_all"], lambda x: f(x.drop(columns="_all")), schema)


def series_pairs(obs: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, symmetric: bool = True, block_bytes: int = 16 << 20) -> DataFrame:
    """``i, j, ...`` for all pairs of the series ``obs(node, t, x)``, computed in blocks of series.

    ``f(a, b)`` gets two matrices (series by times, the same times; NaN where a series
    has none) and gives a matrix for each further column of ``schema``. Each series
    becomes one array; blocks of about ``block_bytes`` meet, each pair of blocks once,
    so that a product of matrices replaces a row for each pair and time. With
    ``symmetric`` blocks meet in one order and the transposed results are the other
    orientation. Rows with a null time or value are left out; of several rows of one
    node and time the largest value counts.
    """
    spark = obs.sparkSession
    ensure_workers(spark)
    clean = obs.filter("node is not null and t is not null and x is not null").groupBy("node", "t").agg(F.max(F.col("x").cast("double")).alias("x"))
    kind = dict(clean.dtypes)
    times = clean.select("t").distinct().count()
    rows = durable(clean.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).select("node", F.col("s.t").alias("t"), F.col("s.x").alias("x")), "series")
    blocks = max(1, math.ceil(rows.count() * times * 8 / block_bytes))
    mine = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    sent = rows.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if symmetric:
        sent = sent.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "t", "x")
    else:
        one = sent.select(F.col("own").alias("p"), F.col("other").alias("q"), F.lit(0).alias("side"), "node", "t", "x")
        sent = one.unionByName(sent.select(F.col("other").alias("p"), F.col("own").alias("q"), F.lit(1).alias("side"), "node", "t", "x"))
    names = [c.strip().split()[0] for c in schema.split(",")]

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(np.concatenate(g.t.tolist()))

        def matrix(part: pd.DataFrame) -> np.ndarray:
            m = np.full((len(part), len(every)), np.nan)
            for r, (t, x) in enumerate(zip(part.t, part.x, strict=True)):
                m[r, np.searchsorted(every, t)] = x
            return m

        if symmetric:
            p, q = g.p.iloc[0], g.q.iloc[0]
            a, b = g[g.own == p], g[g.own == q]
        else:
            a, b = g[g.side == 0], g[g.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("i", "j", *names)})
        got = f(matrix(a), matrix(b))
        i, j = np.repeat(a.node.to_numpy(), len(b)), np.tile(b.node.to_numpy(), len(a))
        out = pd.DataFrame({"i": i, "j": j, **{c: got[c].reshape(len(i), -1).tolist() if got[c].ndim > 2 else got[c].ravel() for c in names}})
        return out if not symmetric or p == q else pd.concat([out, out.rename(columns={"i": "j", "j": "i"})])

    return sent.groupBy("p", "q").applyInPandas(compare, f"i {kind['node']}, j {kind['node']}, {schema}")
