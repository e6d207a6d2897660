"""Networks of fields by other similarities, of coupled fields, and measures weighted by similarity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import order_statistic, ratio, series_pairs
from . import events
from . import interacting as I
from .graph import Graph
from .paths import average_path_length, closeness, local_vulnerability, path_lengths
from .series import next_power_2, pearson, threshold_network


def tapered(a: np.ndarray, gamma: float) -> np.ndarray:
    """Rows normalised, tapered by a cosine over the first and last int(gamma n / 2) columns and padded with zeros to a power of two."""
    n = a.shape[1]
    sd = a.std(1, keepdims=True)
    z = (a - a.mean(1, keepdims=True)) / np.where(sd == 0, 1.0, sd)
    d = int(gamma * n / 2)
    rise = 0.5 * (1 + np.cos(np.arange(d) * np.pi / max(d, 1) + np.pi))
    z = z * np.concatenate((rise, np.ones(n - 2 * d), rise[::-1]))
    size = next_power_2(n)
    front = (size - n) // 2
    return np.pad(z, ((0, 0), (front, size - n - front)))


def correlation_strength(obs: DataFrame, max_delay: int, gamma: float = 0.2) -> DataFrame:
    """``i, j, s, lag``: the largest absolute circular cross-correlation over the lags -max_delay..-2 and 0..max_delay - 1, over the standard deviation of the absolute values; null for a constant series.

    Series are normalised, tapered and padded (:func:`tapered`) and correlated by their
    Fourier transforms in blocks of pairs. ``lag`` is the place of the first largest
    value less max_delay, as established: negative lags as they are, others less one.
    """

    def f(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        x, y = np.fft.ifft(tapered(a, gamma), axis=1), np.fft.ifft(tapered(b, gamma), axis=1)
        s, lag = np.empty((len(a), len(b))), np.empty((len(a), len(b)), np.int64)
        for i in range(len(a)):
            c = np.real(np.fft.fft(np.conj(x[i]) * y, axis=1))
            c = np.abs(np.concatenate((c[:, -max_delay:-1], c[:, :max_delay]), axis=1))
            sd = c.std(1)
            s[i] = np.where(sd > 1e-15, c.max(1) / np.where(sd > 1e-15, sd, 1), np.nan)
            lag[i] = c.argmax(1) - max_delay
        return {"s": s, "lag": lag}

    return series_pairs(obs, f, "s double, lag long", symmetric=False)


def analytic(a: np.ndarray) -> np.ndarray:
    """Analytic signal of each row: the one-sided spectrum, doubled."""
    n = a.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(a, axis=1) * h, axis=1)


def hilbert_coherence(obs: DataFrame) -> DataFrame:
    """``i, j, s, phase``: modulus and argument of the complex correlation of the analytic signals, z_i conj(z_j) summed over T - 1; 0 for a constant series."""

    def f(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        def signal(m: np.ndarray) -> np.ndarray:
            z = analytic(m)
            z = z - z.mean(1, keepdims=True)
            size = np.sqrt((np.abs(z) ** 2).mean(1, keepdims=True))
            return np.where(size > 1e-15, z / np.where(size > 1e-15, size, 1), 0)

        c = signal(a) @ np.conj(signal(b)).T / max(a.shape[1] - 1, 1)
        return {"s": np.abs(c), "phase": np.angle(c)}

    return series_pairs(obs, f, "s double, phase double", symmetric=False)


def hilbert_network(coherence: DataFrame, threshold: float, directed: bool = True) -> Graph:
    """Links where the coherence is above the threshold; directed ones only where the phase is positive: i before j."""
    g = threshold_network(coherence, threshold)
    if not directed:
        return g
    e = g.edges.join(coherence.select(F.col("i").alias("src"), F.col("j").alias("dst"), "phase"), ["src", "dst"]).filter("phase > 0").drop("phase")
    return Graph(g.nodes, e, True)


def rainfall(obs: DataFrame, scale: float = 37265.0, offset: float = 1e-7) -> DataFrame:
    return obs.withColumn("x", (F.col("x") + offset) * scale)


def top_events(obs: DataFrame, low: float = 0.0, high: float = 1.0, per_node: bool = False) -> DataFrame:
    """``node, t, hit``: whether x isn't 0 and lies between the values at places int(low m) and int(high m) - 1 of the m sorted values of all nodes; ``per_node``: of the node's own."""
    if per_node:
        s = obs.groupBy("node").agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("s"))
        m = F.size("s")
        at = lambda k: F.get("s", F.greatest(F.least(k, m - 1), F.lit(0)).cast("int"))
        limits = s.select("node", at(F.floor(m * F.lit(low))).alias("lo"), at(F.floor(m * F.lit(high)) - 1).alias("hi"))
        placed = obs.join(limits, "node")
    else:
        lo = order_statistic(obs, "x", lambda m: int(m * low))
        hi = order_statistic(obs, "x", lambda m: int(m * high) - 1)
        placed = obs.withColumns({"lo": F.lit(lo).cast("double"), "hi": F.lit(hi).cast("double")})
    hit = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")) & (F.col("x") != 0)
    return placed.select("node", "t", F.coalesce(hit, F.lit(False)).alias("hit"))


def rainfall_similarity(obs: DataFrame, anomaly: DataFrame, low: float = 0.0, high: float = 1.0, per_node: bool = False) -> DataFrame:
    """``i, j, s``: correlation of the anomalies' ranks over the n of T times when either node has an event (:func:`top_events` of ``obs``).

    Ranks of the whole series, from 1 and less T - n, are taken from their mean (n + 1) / 2
    over the last n of them, as established; null without variance.
    """
    w = Window.partitionBy("node")
    r = anomaly.select("node", "t", F.row_number().over(w.orderBy("x", "t")).cast("double").alias("x"))
    marked = r.join(top_events(obs, low, high, per_node), ["node", "t"]).select("node", "t", F.when(F.col("hit"), F.col("x")).otherwise(-F.col("x")).alias("x"))

    def f(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        # a rank's sign says whether it is an event
        ra, rb, ea, eb = np.abs(a), np.abs(b), a > 0, b > 0
        t = a.shape[1]
        out = np.full((len(a), len(b)), np.nan)
        for i in range(len(a)):
            u = ea[i] | eb
            n = u.sum(1, keepdims=True)
            shift = t - n + (n + 1) / 2
            x, y = np.where(u, ra[i] - shift, 0.0), np.where(u, rb - shift, 0.0)
            size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
            out[i] = np.where(size > 0, (x * y).sum(1) / np.where(size > 0, size, 1), np.nan)
        return {"s": out}

    return series_pairs(marked, f, "s double")


def event_network(ev: DataFrame, threshold: float = 0.0, method: str = "ES", taumax: float = math.inf, how: str = "directed", window: str = "symmetric", lag: float = 0.0, p_value: float | None = None, times: DataFrame | None = None, n_surrogates: int = 1000, seed: int = 1) -> Graph:
    """Links where event synchronization (``ES``) or coincidence (``ECA``) is above the threshold; attribute ``s``.

    ``ES_pval`` and ``ECA_pval`` take the significance level (:func:`events.shuffle_significance`
    over the record's ``times``) for the measure; with a ``p_value`` pairs whose level
    is under 1 - p_value have no link. Nodes are those with events.
    """
    kind = method.removesuffix("_pval")
    level = lambda: events.shuffle_significance(ev, times, kind, how, window, taumax, lag, n_surrogates, seed)
    if method.endswith("_pval"):
        m = level().withColumnRenamed("level", "value")
    else:
        m = events.analysis(ev, kind, how, window, taumax, lag)
        if p_value is not None:
            if not 0 <= p_value <= 1:
                raise ValueError("p_value must lie in the unit interval")
            m = m.join(level().filter(F.col("level") >= 1 - p_value).select("i", "j"), ["i", "j"], "left_semi")
    e = m.filter(F.col("value") > threshold).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("s"))
    return Graph(ev.select(F.col("node").alias("id")).distinct().withColumn("w", F.lit(1.0)), e, how == "directed")


def coupled_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """``i, j, s``: correlations of the first field's nodes with the second's; the sets of node ids are disjoint."""
    a, b = first.select("node").distinct(), second.select("node").distinct()
    every = pearson(first.unionByName(second))
    return every.join(a.withColumnRenamed("node", "i"), "i", "left_semi").join(b.withColumnRenamed("node", "j"), "j", "left_semi").select("i", "j", "s")


def coupled_network(first: DataFrame, second: DataFrame, threshold: float) -> Graph:
    """One network of both fields' nodes; the groups of the interacting measures are the fields' nodes."""
    every = first.unionByName(second)
    e = pearson(every).filter((F.col("s") > threshold) & (F.col("i") != F.col("j"))).select(F.col("i").alias("src"), F.col("j").alias("dst"), "s")
    return Graph(every.select(F.col("node").alias("id")).distinct().withColumn("w", F.lit(1.0)), e, False)


def cross_average_link_distance(g: Graph, a: DataFrame, b: DataFrame, dist: DataFrame) -> DataFrame:
    """``id, value`` of group a: mean distance ``dist(i, j, d)`` over its links to b."""
    from .interacting import cross_links

    m = cross_links(g, a, b).join(dist.toDF("src", "dst", "d"), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.avg("d").alias("value"))
    return a.select("id").join(m, "id", "left").fillna(0.0, ["value"])


def layers(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups ``(id)`` of two fields' nodes."""
    return tuple(f.select(F.col("node").alias("id")).distinct() for f in (first, second))


def layer_network(g: Graph, layer: DataFrame) -> Graph:
    """One layer's nodes and the links among them."""
    return g.subgraph(layer)


def layer_similarity(sim: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, j, s`` from nodes of layer ``a`` to those of layer ``b``."""
    return sim.join(a.select(F.col("id").alias("i")), "i", "left_semi").join(b.select(F.col("id").alias("j")), "j", "left_semi")


def coupled_measures(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``measure, layer, value`` of the whole coupled network: numbers and densities of links, clustering, transitivity, path lengths, of each layer and across (``layer`` 1, 2, 12, 21)."""
    rows = []
    for name, f in (("number_internal_links", lambda x: I.number_internal_links(g, x)), ("internal_link_density", lambda x: I.internal_link_density(g, x)), ("internal_global_clustering", lambda x: I.internal_global_clustering(g, x)), ("internal_average_path_length", lambda x: I.internal_average_path_length(g, x))):
        rows += [(name, "1", f(a)), (name, "2", f(b))]
    for name, f in (("number_cross_links", I.number_cross_links), ("cross_link_density", I.cross_link_density), ("cross_global_clustering", I.cross_global_clustering), ("cross_transitivity", I.cross_transitivity), ("cross_average_path_length", I.cross_average_path_length)):
        rows += [(name, "12", f(g, a, b)), (name, "21", f(g, b, a))]
    out = None
    for name, layer, df in rows:
        one = df.select(F.lit(name).alias("measure"), F.lit(layer).alias("layer"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return out


def coupled_sequences(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``layer, id, cross_degree, internal_degree, cross_local_clustering, cross_closeness, internal_closeness, cross_betweenness, internal_betweenness`` of every node: internal ones in its own layer, cross ones with the other; both betweennesses count ordered pairs."""
    across = I.cross_betweenness(g, a, b).withColumnRenamed("value", "cross_betweenness")
    out = None
    for name, x, y in (("1", a, b), ("2", b, a)):
        one = x.select(F.lit(name).alias("layer"), "id")
        for col, df in (("cross_degree", I.cross_degree(g, x, y)), ("internal_degree", I.internal_degree(g, x)), ("cross_local_clustering", I.cross_local_clustering(g, x, y)), ("cross_closeness", I.cross_closeness(g, x, y)), ("internal_closeness", I.internal_closeness(g, x)), ("internal_betweenness", I.internal_betweenness(g, x))):
            one = one.join(df.withColumnRenamed("value", col), "id")
        one = one.join(across, "id")
        out = one if out is None else out.unionByName(one)
    return out


def weighted_average_path_length(g: Graph, attribute: str) -> DataFrame:
    return average_path_length(g, path_lengths(g, attribute))


def weighted_closeness(g: Graph, attribute: str) -> DataFrame:
    return closeness(g, path_lengths(g, attribute), "n")


def weighted_vulnerability(g: Graph, attribute: str) -> DataFrame:
    return local_vulnerability(g, attribute)
