"""Fields of time series ``obs(node, t, x)``: windows, phases, anomalies, similarity measures and the networks they make."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import histogram, in_one_task, order_statistic, positional_rank, ratio, series_pairs
from .graph import Graph

# data ------------------------------------------------------------------------------------------


def window_select(obs: DataFrame, t_min: float | None = None, t_max: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    out = obs
    if t_min is not None:
        out = out.filter(F.col("t") >= t_min)
    if t_max is not None:
        out = out.filter(F.col("t") <= t_max)
    return out if nodes is None else out.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")


def normalize(obs: DataFrame) -> DataFrame:
    """Zero mean and unit variance per node; constant series only lose their mean."""
    w = Window.partitionBy("node")
    s = F.stddev_pop("x").over(w)
    return obs.withColumn("x", (F.col("x") - F.avg("x").over(w)) / F.when(s == 0, 1.0).otherwise(s))


def small_field(spark) -> DataFrame:
    """Six test series of ten values: sin(t pi / 10 + node pi / 2)."""
    return spark.range(60).select((F.col("id") % 6).alias("node"), F.floor(F.col("id") / 6).alias("t")).withColumn("x", F.sin(F.col("t") * math.pi / 10 + F.col("node") * math.pi / 2))


def rescale(obs: DataFrame, kind: str) -> DataFrame:
    """``node, t, x, scale_factor, add_offset`` with x packed into the range of ``int32``, ``int16`` or ``uint8`` (towards zero), as it is for ``float64``, ``float32``; x is the packed value times the factor plus the offset, to within the factor. A constant field has factor 1."""
    if kind in ("float64", "float32"):
        return obs.select("node", "t", F.col("x").cast("double" if kind == "float64" else "float").alias("x"), F.lit(1.0).alias("scale_factor"), F.lit(0.0).alias("add_offset"))
    if kind not in ("int32", "int16", "uint8"):
        raise ValueError(f"data type {kind} not supported")
    span = F.broadcast(obs.agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi")))  # one row
    steps = {"int32": 2.0**32 - 2, "int16": 2.0**16 - 2, "uint8": 2.0**8 - 1}[kind]
    factor = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / steps).otherwise(1.0)
    offset = F.col("lo") if kind == "uint8" else (F.col("hi") + F.col("lo")) / 2
    packed = obs.crossJoin(span).withColumns({"scale_factor": factor, "add_offset": offset})
    v = (F.col("x") - F.col("add_offset")) / F.col("scale_factor")
    return packed.select("node", "t", F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int").alias("x"), "scale_factor", "add_offset")


def next_power_2(n: float) -> int:
    """The smallest power of two that is n or more, 2 at least."""
    return max(2, 1 << max(0, math.ceil(math.log2(n)) if n > 0 else 0))


def zero_pad(obs: DataFrame, step: int = 1) -> DataFrame:
    """Each series with zeros before and after its values so that its length is a power of two; of an odd number of zeros one more comes after. Times are ``step`` apart."""
    n = obs.groupBy("node").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    size = F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))), F.lit(2.0)).cast("long")
    extra = n.withColumn("m", size - F.col("n")).withColumn("front", F.floor(F.col("m") / 2))
    offsets = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("k")
    zeros = extra.filter("m > 0").select("node", "lo", "hi", "front", offsets).select("node", F.when(F.col("k") <= F.col("front"), F.col("lo") - F.col("k") * step).otherwise(F.col("hi") + (F.col("k") - F.col("front")) * step).alias("t"), F.lit(0.0).alias("x"))
    return obs.select("node", "t", "x").unionByName(zeros)


def cos_window(obs: DataFrame, gamma: float) -> DataFrame:
    """``node, t, taper``: 1 but for the first and last int(gamma n / 2) values of each series, where it rises and falls as a cosine."""
    w = Window.partitionBy("node")
    r, n = F.row_number().over(w.orderBy("t")) - 1, F.count("*").over(w)
    d = F.floor(F.lit(float(gamma)) * n / 2)
    at = F.least(r, n - 1 - r)
    return obs.select("node", "t", F.when(at < d, 0.5 * (1 + F.cos(at * math.pi / d + math.pi))).otherwise(1.0).alias("taper"))


def phase_indices(times: DataFrame, cycle: int) -> DataFrame:
    """``phase, t`` over the whole cycles of time indices ``times(t)``."""
    last = F.broadcast(times.agg((F.floor((F.max("t") + 1) / cycle) * cycle).alias("whole")))  # one row
    return times.select("t").distinct().crossJoin(last).filter("t < whole").select((F.col("t") % cycle).alias("phase"), "t")


def selected_phases(times: DataFrame, cycle: int, phases: list[int]) -> DataFrame:
    """``t`` of the given phases over the whole cycles."""
    return phase_indices(times, cycle).filter(F.col("phase").isin(phases)).select("t")


def selected_months(times: DataFrame, cycle: int, months: list[int]) -> DataFrame:
    """``t`` of the given months: of cycles of 12 steps, or of 360 (30 days a month)."""
    if cycle not in (12, 360):
        raise ValueError("months need a cycle of 12 or 360 steps")
    return selected_phases(times, cycle, months if cycle == 12 else [30 * m + d for m in months for d in range(30)])


def phase_mean(obs: DataFrame, cycle: int) -> DataFrame:
    return obs.groupBy("node", (F.col("t") % cycle).alias("phase")).agg(F.avg("x").alias("mean"))


def anomaly(obs: DataFrame, cycle: int, phases: list[int] | None = None) -> DataFrame:
    """Deviation from the phase mean; only the given phases, if any."""
    out = obs.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("node", F.col("t") % cycle)))
    return out if phases is None else out.filter((F.col("t") % cycle).isin(phases))


def shuffled(obs: DataFrame, seed: int = 1) -> DataFrame:
    """Each node's values at permuted times."""
    order = obs.select("node", "t", F.row_number().over(Window.partitionBy("node").orderBy("t")).alias("r"))
    mixed = obs.select("node", "x", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), "node", "t"), "t")).alias("r"))
    return order.join(mixed, ["node", "r"]).select("node", "t", "x")


def ranks(obs: DataFrame) -> DataFrame:
    """Values replaced by their ranks from 0, ties by time."""
    return obs.select("node", "t", positional_rank("node", "x", "t").cast("double").alias("x"))


# similarity: (i, j, s) -------------------------------------------------------------------------


def correlation_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of every row of ``a`` with every row of ``b`` over the columns where both have values; NaN without variance."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        if ma.all() and mb.all():
            za, zb = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            norm = np.sqrt(np.outer((za * za).sum(1), (zb * zb).sum(1)))
            return np.where(norm > 0, za @ zb.T / norm, np.nan)
        # means first, so that the sums of squares don't cancel
        x = np.where(ma, a - np.nanmean(a, axis=1, keepdims=True), 0.0)
        y = np.where(mb, b - np.nanmean(b, axis=1, keepdims=True), 0.0)
        fa, fb = ma.astype(float), mb.astype(float)
        n, sx, sy = fa @ fb.T, x @ fb.T, fa @ y.T
        vx, vy = (x * x) @ fb.T - sx * sx / n, fa @ (y * y).T - sy * sy / n
        return np.where((vx > 0) & (vy > 0), (x @ y.T - sx * sy / n) / np.sqrt(vx * vy), np.nan)


def pearson(obs: DataFrame) -> DataFrame:
    """``i, j, s``: correlation of every pair over their common times; null for constant series."""
    return series_pairs(obs, lambda a, b: {"s": correlation_of(a, b)}, "s double")


def spearman(obs: DataFrame) -> DataFrame:
    return pearson(ranks(obs))


def partial_correlation(obs: DataFrame, most_bytes: int = 2 << 30) -> DataFrame:
    """``i, j, s``: correlation given all other nodes, from the inverse of the correlation matrix (nodes squared numbers in one task; raises if its matrices are over ``most_bytes``)."""
    n = obs.select("node").distinct().count()
    if 8 * n * n * 5 > most_bytes:
        raise ValueError(f"{n} nodes need matrices of over {most_bytes} bytes")
    c = pearson(obs).select("i", "j", F.coalesce("s", F.lit(0.0)).alias("s"))

    def invert(g: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(g.i.unique())
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, g.i), np.searchsorted(ids, g.j)] = g.s
        inv = np.linalg.pinv(m, hermitian=True)
        d = np.sqrt(np.abs(np.outer(np.diag(inv), np.diag(inv))))
        s = -np.divide(inv, d, out=np.zeros_like(inv), where=d > 0)
        i, j = np.meshgrid(ids, ids, indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": s.ravel()})

    kind = dict(c.dtypes)
    return in_one_task(c, invert, f"i {kind['i']}, j {kind['j']}, s double", n * n)


def binned(obs: DataFrame, n_bins: int) -> DataFrame:
    """``node, t, b``: equal-width bins over all nodes' common range, the last closed."""
    r = F.broadcast(obs.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    place = F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * n_bins)
    return obs.crossJoin(r).select("node", "t", F.least(F.coalesce(place, F.lit(0)), F.lit(n_bins - 1)).cast("int").alias("b"))


def quantile_binned(obs: DataFrame, n_bins: int) -> DataFrame:
    """``node, t, b``: bins of equal occupation per node; equal values share the highest bin whose edge they reach."""
    w = Window.partitionBy("node")
    step = F.ceil(F.count("*").over(w) / n_bins)
    ranked = obs.withColumns({"r": F.row_number().over(w.orderBy("x", "t")) - 1, "step": step})
    return ranked.select("node", "t", F.floor((F.max("r").over(Window.partitionBy("node", "x"))) / F.col("step")).cast("int").alias("b"))


def joint_information(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of p ln(p / (p_i p_j)) over the joint symbols of every row of ``a`` and of ``b`` (small whole numbers, NaN: none), by products of their indicators."""
    size = int(max(np.nanmax(a, initial=0), np.nanmax(b, initial=0))) + 1
    cols = np.arange(size)
    out = np.empty((len(a), len(b)))
    step = max(1, (4 << 20) // max(size * a.shape[1], 1))
    for q in range(0, len(b), step):
        y = (b[q : q + step, None, :] == cols[:, None]).astype(np.float32)
        for p in range(len(a)):
            x = (a[p] == cols[:, None]).astype(np.float32)
            n = np.einsum("kt,jlt->jkl", x, y, optimize=True).astype(float)
            total = n.sum((1, 2), keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                term = n / total * np.log(n * total / (n.sum(2, keepdims=True) * n.sum(1, keepdims=True)))
            out[p, q : q + step] = np.nansum(term, axis=(1, 2))
    return out


def mutual_information(bins: DataFrame, tau: int = 0) -> DataFrame:
    """``i, j, s``: mutual information of the symbols ``bins(node, t, b)`` of i and of j ``tau`` steps later."""
    obs = bins.select("node", "t", F.col("b").cast("double").alias("x"))
    if not tau:
        return series_pairs(obs, lambda a, b: {"s": joint_information(a, b)}, "s double")
    return series_pairs(obs, lambda a, b: {"s": joint_information(a[:, :-tau], b[:, tau:])}, "s double", symmetric=False)


def summed_lags(cc: DataFrame) -> DataFrame:
    return cc.groupBy("i", "j").agg(F.sum(F.abs("s")).alias("s"))


def symmetrize_by_absmax(m: DataFrame) -> DataFrame:
    """Both orientations of a pair get the value of larger size; the lag's sign turns with the orientation it came from."""
    back = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("s2"), F.col("lag").alias("lag2"))
    take = F.abs("s") >= F.abs("s2")
    return m.join(back, ["i", "j"]).select("i", "j", F.when(take, F.col("s")).otherwise(F.col("s2")).alias("s"), F.when(take, F.col("lag")).otherwise(-F.col("lag2")).alias("lag"))


# networks from similarity ------------------------------------------------------------------------


def threshold_network(sim: DataFrame, threshold: float | DataFrame, nodes: DataFrame | None = None) -> Graph:
    """Links where the similarity is above the threshold; no loops. Attribute ``s``."""
    e = sim.select(F.col("i").alias("src"), F.col("j").alias("dst"), "s").filter("src != dst")
    if isinstance(threshold, DataFrame):
        e = e.crossJoin(F.broadcast(threshold.select("threshold"))).filter("s > threshold").drop("threshold")  # one row
    else:
        e = e.filter(F.col("s") > threshold)
    n = (sim.select(F.col("i").alias("id")).distinct() if nodes is None else nodes).select("id").withColumn("w", F.lit(1.0))
    return Graph(n, e, False)


def threshold_from_link_density(sim: DataFrame, density: float) -> DataFrame:
    """One row ``threshold``: the similarity at place int((1 - density)(N^2 - N)) of all N^2 sorted ones (the diagonal included), by histogram refinement; no row without similarities."""
    t = order_statistic(sim, "s", lambda n: int((1 - density) * (n - math.isqrt(n))))
    return sim.sparkSession.createDataFrame([] if t is None else [(t,)], "threshold double")


def link_density_function(sim: DataFrame, n_bins: int) -> DataFrame:
    """``bin, lower, density``: share of similarities in lower bins, the density of links below each threshold."""
    h = histogram(sim, "s", n_bins)
    before = F.sum("share").over(Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return h.select("bin", "lower", F.coalesce(before, F.lit(0.0)).alias("density"))


def non_local(sim: DataFrame, dist: DataFrame, a: float = 20.0, d_min: float = 0.05) -> DataFrame:
    """Similarity damped where nodes are close: s (tanh(a (d - d_min)) + 1) / 2 with ``dist(i, j, d)``."""
    return sim.join(dist, ["i", "j"]).select("i", "j", (F.col("s") * 0.5 * (F.tanh(a * (F.col("d") - d_min)) + 1)).alias("s"))


def correlation_distance(sim: DataFrame, dist: DataFrame) -> DataFrame:
    return sim.join(dist, ["i", "j"]).select("i", "j", (F.col("s") * F.col("d")).alias("value"))


def inverse_correlation_distance(sim: DataFrame, dist: DataFrame) -> DataFrame:
    """``i, j, value``: one over similarity times distance, 0 on the diagonal."""
    return correlation_distance(sim, dist).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(ratio(F.lit(1.0), F.col("value"), None)).alias("value"))


def non_local_network(sim: DataFrame, dist: DataFrame, threshold: float, a: float = 20.0, d_min: float = 0.05) -> Graph:
    """:func:`threshold_network` of the similarities damped where nodes are close."""
    return threshold_network(non_local(sim, dist, a, d_min), threshold)


def correlation_distance_network(g: Graph, sim: DataFrame, dist: DataFrame) -> Graph:
    """The graph with link attribute ``inv``: one over similarity times distance, a length for weighted paths."""
    v = inverse_correlation_distance(sim, dist).toDF("src", "dst", "inv")
    return Graph(g.nodes, g.edges.select("src", "dst").join(v, ["src", "dst"]), g.directed)
