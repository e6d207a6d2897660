"""Lagged coupling of all pairs of series ``obs(node, t, x)``: cross-correlation, mutual information, information transfer.

Series have the same times, in steps of one; lags are steps. Each pair of blocks of
series is one task's; results are long tables ``i, j, tau, s``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import series_pairs
from .series import correlation_of, shuffled
from .surrogates import fourier

ESTIMATORS = ("knn", "binning", "gauss")


def digamma(n: np.ndarray) -> np.ndarray:
    """Of positive numbers, by recurrence to 6 and the asymptotic series."""
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    while (n < 6).any():
        low = n < 6
        out[low] -= 1 / n[low]
        n = np.where(low, n + 1, n)
    return out + np.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)


def neighbor_counts(rows: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column of ``rows`` (x, y, conditions...): how many points lie nearer than its kth neighbour (max-norm of all standardised rows), in x with the conditions, in y with them, in the conditions alone; itself included."""
    z = (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True)
    z = z + 1e-10 * np.random.default_rng(seed).random(z.shape)
    n = z.shape[1]
    out = np.zeros((3, n), np.int64)
    for a in range(0, n, 512):
        d = np.abs(z[:, a : a + 512, None] - z[:, None, :])
        dz = d[2:].max(0) if len(z) > 2 else np.zeros(d.shape[1:])
        eps = np.partition(np.maximum(np.maximum(d[0], d[1]), dz), k, axis=1)[:, k : k + 1]
        near = dz < eps
        out[0, a : a + 512], out[1, a : a + 512], out[2, a : a + 512] = ((d[0] < eps) & near).sum(1), ((d[1] < eps) & near).sum(1), near.sum(1)
    return out[0], out[1], out[2]


def knn_estimate(rows: np.ndarray, k: int, seed: int = 0) -> float:
    """Nearest-neighbour estimate of the (conditional) mutual information of the first two rows given the others; NaN for a constant row or k points or fewer."""
    if rows.shape[1] <= k or (rows.std(1) == 0).any():
        return float("nan")
    kx, ky, kz = neighbor_counts(rows, k, seed)
    return float(digamma(np.array([k]))[0] + (digamma(kz) - digamma(kx) - digamma(ky)).mean())


def gauss_estimate(rows: np.ndarray) -> float:
    """-ln(1 - r^2) / 2 of the partial correlation r of the first two rows given the others; infinite at r = 1, NaN for a constant row."""
    z = rows - rows.mean(1, keepdims=True)
    if (z.std(1) == 0).any():
        return float("nan")
    z = z / z.std(1, keepdims=True)
    x, y = z[0], z[1]
    if len(z) > 2:
        q = np.linalg.qr(z[2:].T)[0].T
        x, y = x - (q @ x) @ q, y - (q @ y) @ q
    r = x @ y / np.sqrt((x @ x) * (y @ y))
    with np.errstate(divide="ignore"):
        return float(-0.5 * np.log(max(1 - r * r, 0.0) if abs(r) < 1 - 1e-14 else 0.0))


def quantile_symbols(a: np.ndarray, bins: int) -> np.ndarray:
    """Symbols of equal occupation for each row: how many of the edges (each ceil(T / bins)th sorted value) a value reaches, less one."""
    step = -(-a.shape[1] // bins)
    edges = np.sort(a, axis=1)[:, ::step]
    return np.stack([np.searchsorted(e, x, side="right") for e, x in zip(edges, a, strict=True)]) - 1.0


def _lags(obs: DataFrame, f, lags: range) -> DataFrame:
    """``i, j, tau, s`` from a function of two blocks that gives values by pair and lag."""
    wide = series_pairs(obs, lambda a, b: {"v": f(a, b)}, "v array<double>", symmetric=False)
    out = wide.select("i", "j", F.posexplode("v").alias("k", "s"))
    return out.select("i", "j", (F.col("k") + lags.start).cast("int").alias("tau"), F.when(F.isnan("s"), None).otherwise(F.col("s")).alias("s"))


def cross_correlation(obs: DataFrame, tau_max: int, two_sided: bool = False) -> DataFrame:
    """``i, j, tau, s``: correlation of i at t - tau with j at t for tau 0..tau_max, each lag standardised on its own, over the times that allow every lag; 0 without variance.

    ``two_sided``: i at t with j at t + tau for tau -tau_max..tau_max, over the times
    that have tau_max steps on both sides.
    """
    if not two_sided:

        def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            n = a.shape[1]
            return np.stack([np.nan_to_num(correlation_of(a[:, tau_max - tau : n - tau], b[:, tau_max:])) for tau in range(tau_max + 1)], axis=2)

        return _lags(obs, f, range(tau_max + 1))

    def g(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a.shape[1] - 2 * tau_max
        return np.stack([np.nan_to_num(correlation_of(a[:, tau_max : tau_max + n], b[:, t : t + n])) for t in range(2 * tau_max + 1)], axis=2)

    return _lags(obs, g, range(-tau_max, tau_max + 1))


def _samples(a: np.ndarray, b: np.ndarray, i: int, j: int, tau: int, back: int, past: int, mode: str) -> np.ndarray:
    """Rows i at t - tau, j at t and the conditions, over the times that allow ``back`` steps."""
    n = a.shape[1]
    at = lambda x, lag: x[back - lag : n - lag]
    rows = [at(a[i], tau), at(b[j], 0)]
    rows += [at(b[j], p) for p in range(1, past + 1)]
    if mode == "mit":
        rows += [at(a[i], tau + p) for p in range(1, past + 1)]
    return np.stack(rows)


def mutual_information(obs: DataFrame, tau_max: int = 0, estimator: str = "knn", knn: int = 10, bins: int = 6) -> DataFrame:
    """``i, j, tau, s``: mutual information of i at t - tau and j at t, by nearest neighbours (``knn``), symbols of equal occupation (``binning``) or correlation (``gauss``, infinite for a series with itself); null for a constant series."""
    if estimator not in ESTIMATORS:
        raise ValueError('estimator must be "knn", "binning" or "gauss"')

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a.shape[1]
        out = np.empty((len(a), len(b), tau_max + 1))
        for tau in range(tau_max + 1):
            x, y = a[:, tau_max - tau : n - tau], b[:, tau_max:]
            if estimator == "binning":
                # the established results take the whole record's length for that of the samples in the entropies
                m = x.shape[1]
                out[..., tau] = _plogp_information(quantile_symbols(x, bins), quantile_symbols(y, bins), n) if m else np.nan
            else:
                for i in range(len(a)):
                    for j in range(len(b)):
                        out[i, j, tau] = knn_estimate(np.stack((x[i], y[j])), knn) if estimator == "knn" else gauss_estimate(np.stack((x[i], y[j])))
        return out

    return _lags(obs, f, range(tau_max + 1))


def _plogp_information(x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """H(x) + H(y) - H(x, y) - H() with entropies (T ln T - sum c ln c) / T for T = ``length``."""
    kx, ky = int(x.max()) + 1, int(y.max()) + 1
    plogp = lambda c: np.where(c > 0, c * np.log(np.maximum(c, 1)), 0.0)
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        for j in range(len(y)):
            h = np.bincount((x[i] * ky + y[j]).astype(np.int64), minlength=kx * ky).reshape(kx, ky)
            out[i, j] = (plogp(h).sum() - plogp(h.sum(1)).sum() - plogp(h.sum(0)).sum() + plogp(h.sum())) / length
    return out


def information_transfer(obs: DataFrame, tau_max: int = 1, estimator: str = "knn", knn: int = 10, past: int = 1, mode: str = "ity") -> DataFrame:
    """``i, j, tau, s``: information transfer from i at t - tau to j at t given j's past (``ity``) or both pasts (``mit``) of ``past`` steps, by nearest neighbours or partial correlation (``gauss``); 0 from a series to itself, null for a constant series."""
    if estimator not in ("knn", "gauss"):
        raise ValueError('estimator must be "knn" or "gauss"')
    if mode not in ("ity", "mit"):
        raise ValueError('mode must be "ity" or "mit"')

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b), tau_max + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                for tau in range(tau_max + 1):
                    if np.array_equal(a[i], b[j], equal_nan=True) and tau == 0:
                        out[i, j, tau] = 0.0
                        continue
                    rows = _samples(a, b, i, j, tau, tau_max + past, past, mode)
                    out[i, j, tau] = knn_estimate(rows, knn) if estimator == "knn" else gauss_estimate(rows)
        return out

    t = _lags(obs, f, range(tau_max + 1))
    return t.withColumn("s", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("s")))


def strongest_lag(cc: DataFrame) -> DataFrame:
    """``i, j, s, lag`` with the largest absolute value; of equal ones the largest lag (correlations)."""
    best = F.max_by(F.struct("s", "tau"), F.struct(F.round(F.abs("s"), 12), F.col("tau")))
    return cc.groupBy("i", "j").agg(best.alias("b")).select("i", "j", F.col("b.s").alias("s"), F.col("b.tau").alias("lag"))


def most_information(m: DataFrame) -> DataFrame:
    """``i, j, s, lag`` with the largest positive value; of equal ones the smallest lag; 0 at lag 0 if none is positive."""
    best = F.max_by(F.struct("s", "tau"), F.struct(F.round("s", 12), -F.col("tau")))
    top = m.filter("s > 0").groupBy("i", "j").agg(best.alias("b"))
    return m.select("i", "j").distinct().join(top, ["i", "j"], "left").select("i", "j", F.coalesce("b.s", F.lit(0.0)).alias("s"), F.coalesce("b.tau", F.lit(0)).alias("lag"))


def sided_sums(m: DataFrame) -> DataFrame:
    """``i, j, forward, backward``: sums of absolute values over the lags from 0 up and from 0 down."""
    part = lambda c: F.sum(F.when(c, F.abs("s")).otherwise(0.0))
    return m.groupBy("i", "j").agg(part(F.col("tau") >= 0).alias("forward"), part(F.col("tau") <= 0).alias("backward"))


def normalized_information(obs: DataFrame, bins: int = 16, tau_max: int = 0) -> DataFrame:
    """``i, j, tau, s``: (2 ln B - H) / ln B of symbols of equal occupation, H their joint entropy, B their number; i at t, j at t + tau for tau -tau_max..tau_max over the times with tau_max steps on both sides."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a.shape[1] - 2 * tau_max
        x = a[:, tau_max : tau_max + n]
        return np.stack([_uniform_information(x, b[:, t : t + n], bins) for t in range(2 * tau_max + 1)], axis=2)

    return _lags(obs, f, range(-tau_max, tau_max + 1))


def _uniform_information(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """(2 ln B - H) / ln B of every row of ``x`` with every row of ``y``."""
    n = x.shape[1]
    used = -(-n // -(-n // bins))
    xs, ys = quantile_symbols(x, bins), quantile_symbols(y, bins)
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        for j in range(len(y)):
            c = np.bincount((xs[i] * used + ys[j]).astype(np.int64)).astype(float)
            c = c[c > 0]
            out[i, j] = (2 * np.log(used) - np.log(n) + (c * np.log(c)).sum() / n) / np.log(used)
    return out


def quantile_edges(obs: DataFrame, bins: int = 16) -> DataFrame:
    """``node, bin, edge``: the lower edges of bins of equal occupation: each ceil(T / bins)th sorted value."""
    s = obs.groupBy("node").agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("s"))
    step = F.ceil(F.size("s") / bins).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / step).cast("int")), lambda k: F.get("s", (k * step).cast("int")))
    return s.select("node", F.posexplode(at).alias("bin", "edge"))


def shuffled_surrogate(obs: DataFrame, measure, tau_max: int = 1, by_fourier: bool = False, seed: int = 1) -> DataFrame:
    """``i, j, tau, s`` of surrogates shuffled (or with random phases) each on its own: the value at lag 0 over the first T - 2 tau_max steps, for every lag. ``measure(obs)`` gives ``i, j, tau, s`` at tau 0."""
    mixed = fourier(obs) if by_fourier else shuffled(obs, seed)
    lo, hi = obs.agg(F.min("t"), F.max("t")).first()
    zero = measure(mixed.filter(F.col("t") < (hi or 0) + 1 - 2 * tau_max)).filter("tau = 0")
    return zero.select("i", "j", F.explode(F.sequence(F.lit(-tau_max), F.lit(tau_max))).alias("tau"), "s")


def time_surrogate(obs: DataFrame, measure: str = "cc", sample: int = 100, tau_max: int = 1, bins: int = 16, seed: int = 1) -> DataFrame:
    """``i, j, tau, s`` over ``sample`` random times, the same for all pairs: i at the time, j at the time + tau, by correlation (``cc``) or :func:`normalized_information` (``mi``)."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.random.default_rng(seed).permutation(np.arange(tau_max, a.shape[1] - tau_max))[:sample]
        out = []
        for t in range(-tau_max, tau_max + 1):
            x, y = a[:, at], b[:, at + t]
            if measure == "cc":
                out.append(np.nan_to_num(correlation_of(x, y)))
            else:
                out.append(_uniform_information(x, y, bins))
        return np.stack(out, axis=2)

    return _lags(obs, f, range(-tau_max, tau_max + 1))


def test_series(spark: SparkSession, length: int = 1000, seed: int = 42) -> DataFrame:
    """``node, t, x`` of four coupled autoregressive series from the seed's normal noise, as established test data."""
    data = np.random.RandomState(seed).randn(length, 4)
    for t in range(2, length):
        # each assignment doubles the noise of its cell, as the noise is the array itself
        data[t, 0] = 0.8 * data[t - 1, 0] + data[t, 0]
        data[t, 1] = 0.8 * data[t - 1, 1] + 0.5 * data[t - 2, 0] + data[t, 1]
        data[t, 2] = 0.7 * data[t - 1, 0] + data[t, 2]
        data[t, 3] = 0.7 * data[t - 2, 0] + data[t, 3]
    return spark.createDataFrame([(k, t, float(data[t, k])) for t in range(length) for k in range(4)], "node long, t long, x double")


test_series.__test__ = False  # not a test
