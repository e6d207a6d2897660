"""Surrogate series of ``obs(node, t, x)``: a node's whole series is one task's."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import histogram, per_group, ratio, series_pairs
from .recurrence import recurrences
from .series import joint_information, normalize
from .series import shuffled as white_noise


def _per_node(obs: DataFrame, f, seed: int) -> DataFrame:
    kind = dict(obs.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        rng = np.random.default_rng([seed, len(g), *str(g.node.iloc[0]).encode()])
        return pd.DataFrame({"node": g.node, "t": g.t, "x": f(g.x.to_numpy(float), rng)})

    return per_group(obs.select("node", "t", "x"), ["node"], run, f"node {kind['node']}, t {kind['t']}, x double")


def _phases(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    s = np.fft.rfft(x)
    turn = np.exp(2j * np.pi * rng.random(len(s)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(s * turn, len(x))


def _remap(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.sort(values)[np.argsort(np.argsort(order))]


def fourier(obs: DataFrame, seed: int = 1) -> DataFrame:
    """Random phases, the same spectrum."""
    return _per_node(obs, lambda x, rng: _phases(x, rng), seed)


def aaft(obs: DataFrame, seed: int = 1) -> DataFrame:
    """Amplitude-adjusted: the same values, nearly the same spectrum."""

    def f(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        normal = _remap(rng.standard_normal(len(x)), x)
        return _remap(x, _phases(normal, rng))

    return _per_node(obs, f, seed)


def refined_aaft(obs: DataFrame, iterations: int = 10, true_spectrum: bool = False, seed: int = 1) -> DataFrame:
    """Amplitudes and spectrum imposed in turn; ends with the true amplitudes or, if asked, with the true spectrum."""

    def f(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        size, r = np.abs(np.fft.rfft(x)), rng.permutation(x)
        s = r
        for _ in range(iterations):
            s = np.fft.irfft(size * np.exp(1j * np.angle(np.fft.rfft(r))), len(x))
            r = _remap(x, s)
        return s if true_spectrum else r

    return _per_node(obs, f, seed)


def twin_surrogates(obs: DataFrame, threshold: float, dimension: int = 1, delay: int = 1, min_dist: int = 7, seed: int = 1) -> DataFrame:
    """Walks along the series that may jump between twins: states with the same neighbours."""

    def f(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(x) - (dimension - 1) * delay
        e = np.stack([x[k * delay : k * delay + n] for k in range(dimension)], axis=1)
        near = [np.flatnonzero((np.abs(e - e[i]) <= threshold).all(axis=1)).tobytes() for i in range(n)]
        groups: dict[bytes, list[int]] = {}
        for i, s in enumerate(near):
            groups.setdefault(s, []).append(i)
        out, at = [], int(rng.integers(n))
        while len(out) < len(x):
            out.append(x[at])
            twins = [j for j in groups[near[at]] if abs(j - at) > min_dist or j == at]
            at = twins[rng.integers(len(twins))] + 1
            if at >= n:
                at = int(rng.integers(n))
        return np.array(out)

    return _per_node(obs, f, seed)


def spectrum(obs: DataFrame) -> DataFrame:
    """``node, k, re, im``: the one-sided discrete Fourier transform of each series."""
    kind = dict(obs.dtypes)["node"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        z = np.fft.rfft(g.sort_values("t").x.to_numpy(float))
        return pd.DataFrame({"node": g.node.iloc[0], "k": np.arange(len(z)), "re": z.real, "im": z.imag})

    return per_group(obs.select("node", "t", "x"), ["node"], run, f"node {kind}, k long, re double, im double")


def recurrence_of(emb: DataFrame, threshold: float) -> DataFrame:
    """``i, j`` of states no component of which differs by more than the threshold."""
    return recurrences(emb, float(np.nextafter(threshold, np.inf)))


def small_series(spark) -> DataFrame:
    """Six test series of 200 values: sin(t pi / 15 + node pi / 2) + sin(t pi / 30)."""
    return spark.range(1200).select((F.col("id") % 6).alias("node"), F.floor(F.col("id") / 6).alias("t")).withColumn("x", F.sin(F.col("t") * math.pi / 15 + F.col("node") * math.pi / 2) + F.sin(F.col("t") * math.pi / 30))


# significance ------------------------------------------------------------------------------------


def test_pearson(original: DataFrame, surrogates: DataFrame) -> DataFrame:
    """``i, j, s``: mean product of original i and surrogate j, 0 on the diagonal: their correlation if both are normalised."""
    return _against(original, surrogates, lambda a, b: a @ b.T / max(a.shape[1], 1))


def test_mutual_information(original: DataFrame, surrogates: DataFrame, n_bins: int = 32) -> DataFrame:
    """``i, j, s``: mutual information of original i and surrogate j, binned in equal widths over the range of all values of both, 0 on the diagonal."""
    lo, hi = original.select("x").union(surrogates.select("x")).agg(F.min("x"), F.max("x")).first()
    scale = 1 / (hi - lo) if lo is not None and hi > lo else 0.0

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = lambda m: np.minimum(np.floor(scale * (m - (lo or 0.0)) * n_bins), n_bins - 1)
        return joint_information(place(a), place(b))

    return _against(original, surrogates, f)


def _against(original: DataFrame, surrogates: DataFrame, f) -> DataFrame:
    """``i, j, s`` of a function of originals and surrogates. Both halves of one table of series (``+name``, ``-name``) meet in blocks."""
    kind = dict(original.dtypes)["node"]
    mark = lambda df, sign: df.select(F.concat(F.lit(sign), F.col("node").cast("string")).alias("node"), "t", "x")
    both = series_pairs(mark(original, "+").unionByName(mark(surrogates, "-")), lambda a, b: {"s": f(a, b)}, "s double", symmetric=False).filter("i like '+%' and j like '-%'")
    out = both.select(F.substring("i", 2, 1 << 20).cast(kind).alias("i"), F.substring("j", 2, 1 << 20).cast(kind).alias("j"), "s")
    return out.withColumn("s", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("s")))


def original_distribution(obs: DataFrame, measure=test_pearson, n_bins: int = 100) -> DataFrame:
    """``bin, lower, n, share``: histogram of the absolute values of ``measure(obs, obs)`` of the normalised series."""
    z = normalize(obs)
    return histogram(measure(z, z).select(F.abs("s").alias("s")), "s", n_bins)


def threshold_significance(obs: DataFrame, surrogate=white_noise, measure=test_pearson, realizations: int = 1, n_bins: int = 100, interval: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """``bin, lower, share``: histogram over an interval of the absolute values of ``measure(original, surrogate(original, seed))`` over all realizations, each of the same weight; values beyond the interval don't count."""
    z = normalize(obs)
    parts = None
    for r in range(realizations):
        one = measure(z, surrogate(z, seed=r + 1)).select(F.lit(r).alias("r"), F.abs("s").alias("s"))
        parts = one if parts is None else parts.union(one)
    lo, hi = interval
    inside = parts.filter(F.col("s").between(lo, hi))
    b = F.least(F.floor((F.col("s") - lo) / (hi - lo) * n_bins), F.lit(n_bins - 1)).cast("int")
    counts = inside.groupBy("r", b.alias("bin")).agg(F.count("*").alias("c"))
    each = counts.join(counts.groupBy("r").agg(F.sum("c").alias("of")), "r").groupBy("bin").agg(F.sum(F.col("c") / F.col("of")).alias("d"))
    every = obs.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(each, "bin", "left").select("bin", (F.lit(lo) + F.lit((hi - lo) / n_bins) * F.col("bin")).alias("lower"), F.coalesce("d", F.lit(0.0)).alias("d"))
    return out.select("bin", "lower", ratio(F.col("d"), F.sum("d").over(Window.partitionBy(F.lit(0)))).alias("share"))  # a row for each bin


for _f in (test_pearson, test_mutual_information):
    _f.__test__ = False  # not tests
