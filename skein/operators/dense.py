"""Measures that need dense linear algebra: one task holds one graph's matrices, nodes squared numbers each.

That is inherent in inverses and eigenvalues; ``most_bytes`` guards the memory by
the number of matrices a measure holds and raises instead of cutting anything off.
Isolated nodes have value 0; an empty graph gives no rows. Repeated links count
once (the last value), null ends are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import per_group, ratio
from .clustering import both_ways, corners
from .graph import Graph, degree


def _on_matrix(g: Graph, f: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, attribute: str | None = None, matrices: int = 4, most_bytes: int = 2 << 30, imaginary: str | None = None) -> DataFrame:
    """``f(ids, weights, matrix)`` of the whole graph, links and nodes sent to one task that holds about ``matrices`` matrices."""
    n = g.nodes.count()
    if 8 * n * n * matrices > most_bytes:
        raise ValueError(f"{n} nodes need {matrices} dense matrices of {8 * n * n} bytes; the limit is {most_bytes} bytes")
    v = F.lit(1.0) if attribute is None else F.col(attribute).cast("double")
    im = F.lit(0.0) if imaginary is None else F.col(imaginary).cast("double")
    none = F.lit(None)
    rows = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), none.cast("long").alias("b"), F.col("w").alias("v"), F.lit(0.0).alias("im")).union(g.edges.filter("src is not null and dst is not null").select(F.lit(0), "src", "dst", v, im))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        nodes = x[x.b.isna()].sort_values("a")
        links = x[x.b.notna()]
        ids = nodes.a.to_numpy()
        m = np.zeros((len(ids), len(ids)), complex if imaginary else float)
        m[np.searchsorted(ids, links.a), np.searchsorted(ids, links.b.astype(np.int64))] = links.v + 1j * links.im if imaginary else links.v
        return f(ids, nodes.v.to_numpy(), m)

    return per_group(rows, ["k"], run, schema)


def _components(a: np.ndarray) -> list[np.ndarray]:
    left, out = set(range(len(a))), []
    while left:
        part, front = set(), {min(left)}
        while front:
            part |= front
            front = set(np.flatnonzero(a[sorted(front)].any(axis=0)).tolist()) - part
        out.append(np.array(sorted(part)))
        left -= part
    return out


def _pair_sum(x: np.ndarray, w: np.ndarray | None = None) -> float:
    """Sum over unordered pairs of |x_s - x_t| (times w_s w_t), by sorting."""
    order = np.argsort(x)
    x = x[order]
    if w is None:
        return float((x * (2 * np.arange(len(x)) - len(x) + 1)).sum())
    w = w[order]
    before = np.cumsum(w) - w
    return float((w * (x * before - (np.cumsum(w * x) - w * x))).sum())


def newman_betweenness(g: Graph) -> DataFrame:
    """``id, value``: random-walk betweenness per component: twice its N - 1 own pairs and the sum over the other pairs of nodes of the current's absolute differences along the node's links, over N - 1."""

    def f(ids: np.ndarray, _: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        out = np.zeros(len(ids))
        for c in _components(a):
            n = len(c)
            if n < 2:
                continue
            s = a[np.ix_(c, c)]
            v = np.zeros((n, n))
            v[:-1, :-1] = np.linalg.inv((np.diag(s.sum(1)) - s)[:-1, :-1])
            for i in range(n):
                total = sum(_pair_sum(np.delete(v[i] - v[j], i)) for j in np.flatnonzero(s[i]))
                out[c[i]] = (total + 2 * (n - 1)) / (n - 1)
        return pd.DataFrame({"id": ids, "value": out})

    return _on_matrix(g, f, "id long, value double")


def nsi_newman_betweenness(g: Graph, add_local_ends: bool = False) -> DataFrame:
    """``id, value``: the node-weighted form, from walks that neither start nor end at the node or its neighbours; ``add_local_ends`` adds (2 W - k*) k* for those."""

    def f(ids: np.ndarray, weights: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        out = np.zeros(len(ids))
        for c in _components(a):
            n = len(c)
            if n < 2:
                continue
            s, w = a[np.ix_(c, c)], weights[c]
            plus = s + np.eye(n)
            k = plus @ w
            inverse = np.zeros((n, n))
            inverse[:-1, :-1] = np.linalg.inv((np.diag(k) - w[:, None] * plus)[:-1, :-1])
            v = ((plus / k[:, None]) @ inverse).T
            for i in range(n):
                far = plus[i] == 0
                out[c[i]] = sum(w[j] * _pair_sum((v[i] - v[j])[far], w[far]) for j in np.flatnonzero(s[i]))
            if add_local_ends:
                out[c] += (2 * w.sum() - k) * k
        return pd.DataFrame({"id": ids, "value": out})

    return _on_matrix(g, f, "id long, value double", matrices=6)


def arenas_betweenness(g: Graph) -> DataFrame:
    """``id, value``: expected visits of random walks after their start until they reach their target, summed over all starts and targets of the component."""

    def f(ids: np.ndarray, _: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        out = np.zeros(len(ids))
        for c in _components(a):
            if len(c) < 2:
                continue
            s = a[np.ix_(c, c)]
            p = s / s.sum(1, keepdims=True)
            for j in range(len(c)):
                q = p.copy()
                q[j] = 0
                out[c] += np.linalg.inv(np.eye(len(c)) - q).sum(axis=0) - 1
        return pd.DataFrame({"id": ids, "value": out})

    return _on_matrix(g, f, "id long, value double", matrices=6)


def nsi_arenas_betweenness(g: Graph, exclude_neighbors: bool = True, stopping_mode: str = "neighbors") -> DataFrame:
    """``id, value``: the node-weighted form. A walk stops at the target's neighbours (``neighbors``) or in each step with the twinness of where it is and the target (``twinness``). ``exclude_neighbors``: only starts and targets that aren't linked to the node count."""
    if stopping_mode not in ("neighbors", "twinness"):
        raise ValueError('stopping_mode must be "neighbors" or "twinness"')

    def f(ids: np.ndarray, weights: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        out = np.zeros(len(ids))
        for c in _components(a):
            n = len(c)
            if n < 2:
                continue
            w, plus = weights[c], a[np.ix_(c, c)] + np.eye(n)
            k = plus @ w
            p = plus * w / k[:, None]
            twins = plus * ((plus * w) @ plus) / np.maximum(k[:, None], k)
            total = np.zeros(n)
            for i in range(n):
                near = plus[i] > 0
                q = p.copy()
                q[near] *= (1 - twins[i, near])[:, None] if stopping_mode == "twinness" else 0
                v = np.linalg.solve(np.eye(n) - q, q)
                total += w[i] * ((w * ~near) @ v * ~near if exclude_neighbors else w @ v)
            out[c] = total / w
        return pd.DataFrame({"id": ids, "value": out})

    return _on_matrix(g, f, "id long, value double", matrices=8)


def msf_synchronizability(g: Graph) -> DataFrame:
    """One row: largest over smallest positive eigenvalue of the Laplacian."""

    def f(ids: np.ndarray, _: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        e = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
        e = e[e > 1e-9 * max(e.max(), 1)]
        return pd.DataFrame({"value": [e.max() / e.min() if len(e) else np.nan]})

    return _on_matrix(g, f, "value double")


def expm(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor series and squaring."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(axis=1).max(), 1e-300)))) + 1)
    x = m / 2**k
    term = out = np.eye(len(m))
    for n in range(1, 20):
        term = term @ x / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def spreading(g: Graph, alpha: float | None = None, nsi: bool = False) -> DataFrame:
    """``id, value``: column sums of exp(ln 2 (alpha A - I)), alpha by default one over the mean degree. ``nsi``: weighted column sums of exp(ln 2 (alpha A+ D_w - I)) A+, alpha by default the total weight over the weighted sum of n.s.i. degrees."""

    def f(ids: np.ndarray, w: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        eye = np.eye(len(a))
        if not nsi:
            al = alpha if alpha is not None else 1 / max(a.sum(1).mean(), 1e-300)
            return pd.DataFrame({"id": ids, "value": expm(np.log(2) * (al * a - eye)).sum(0)})
        plus = a + eye
        al = alpha if alpha is not None else w.sum() / ((plus @ w) @ w)
        return pd.DataFrame({"id": ids, "value": (expm(np.log(2) * (plus * al * w - eye)) @ plus * w[:, None]).sum(0)})

    return _on_matrix(g, f, "id long, value double", matrices=6)


# resistive networks: attribute = resistance of each link -----------------------------------------


def small_circuit(spark, reactive: bool = False) -> Graph:
    """Five nodes and links with resistances ``r`` (and, if ``reactive``, reactances ``x``)."""
    rows = [(0, 1, 2.0, 4.0), (1, 2, 8.0, 8.0), (1, 3, 2.0, 2.0), (2, 3, 8.0, 8.0), (3, 4, 10.0, 10.0)]
    e = spark.createDataFrame(rows, "src long, dst long, r double, x double")
    return Graph.of(e if reactive else e.drop("x"))


def _admittance(resistance: str, reactance: str | None = None) -> tuple[Column, Column]:
    r = F.col(resistance).cast("double")
    if reactance is None:
        return 1 / F.nullif(r, F.lit(0.0)), F.lit(0.0)
    x = F.col(reactance).cast("double")
    size = F.nullif(r * r + x * x, F.lit(0.0))
    return r / size, -x / size


def admittance(g: Graph, resistance: str, reactance: str | None = None) -> DataFrame:
    """``i, j, value``: inverse resistances of the links; with reactances ``i, j, re, im`` of the inverse impedances."""
    re, im = _admittance(resistance, reactance)
    ends = [F.col("src").alias("i"), F.col("dst").alias("j")]
    return g.edges.select(*ends, re.alias("value")) if reactance is None else g.edges.select(*ends, re.alias("re"), im.alias("im"))


def admittance_laplacian(g: Graph, resistance: str) -> DataFrame:
    """``i, j, value``: admittive degrees on the diagonal, minus the admittances elsewhere."""
    own = admittive_degree(g, resistance).select(F.col("id").alias("i"), F.col("id").alias("j"), "value")
    return own.union(admittance(g, resistance).select("i", "j", -F.col("value")))


def admittive_degree(g: Graph, resistance: str) -> DataFrame:
    return g.per_node(g.edges.groupBy(F.col("src").alias("id")).agg(F.sum(1 / F.nullif(F.col(resistance).cast("double"), F.lit(0.0))).alias("value")), "value", 0.0)


def neighbors_admittive_degree(g: Graph, resistance: str) -> DataFrame:
    """``id, value``: the sum of the neighbours' admittive degrees over the node's own."""
    k = admittive_degree(g, resistance)
    s = g.edges.join(k.toDF("dst", "kj"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("kj").alias("s"))
    return k.join(s, "id", "left").select("id", ratio(F.coalesce("s", F.lit(0.0)), F.col("value")).alias("value"))


def local_admittive_clustering(g: Graph, resistance: str) -> DataFrame:
    """``id, value``: sum of a_ij a_ik a_jk over ordered pairs of neighbours, over the admittive degree times the degree less one; 0 with one neighbour or none."""
    y = Graph(g.nodes, g.edges.select("src", "dst", _admittance(resistance)[0].alias("y")), False)
    tri = corners(both_ways(y, "y"))
    v = 2 * F.col("ab") * F.col("bc") * F.col("ca")
    t = tri.select(F.explode(F.array("a", "b", "c")).alias("id"), v.alias("v")).groupBy("id").agg(F.sum("v").alias("t"))
    k = admittive_degree(g, resistance).join(degree(g), "id").join(t, "id", "left")
    return k.select("id", F.when(F.col("k") > 1, ratio(F.coalesce("t", F.lit(0.0)), F.col("value") * (F.col("k") - 1))).otherwise(0.0).alias("value"))


def global_admittive_clustering(g: Graph, resistance: str) -> DataFrame:
    return local_admittive_clustering(g, resistance).agg(F.avg("value").alias("value"))


def pseudo_inverse(g: Graph, resistance: str) -> DataFrame:
    """``i, j, value`` of all pairs: the pseudo-inverse of the admittance Laplacian."""

    def f(ids: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        r = np.linalg.pinv(np.diag(y.sum(1)) - y, hermitian=True)
        i, j = np.meshgrid(ids, ids, indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": r.ravel()})

    inv = Graph(g.nodes, g.edges.withColumn("_y", _admittance(resistance)[0]), g.directed)
    return _on_matrix(inv, f, "i long, j long, value double", "_y", matrices=8)


def effective_impedance(g: Graph, resistance: str, reactance: str) -> DataFrame:
    """``i, j, re, im`` of all pairs of one component, from the pseudo-inverse of the complex admittance Laplacian."""

    def f(ids: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        r = np.linalg.pinv(np.diag(y.sum(1)) - y)
        d = np.diag(r)
        e = d[:, None] + d - r - r.T
        parts = []
        for c in _components(np.abs(y) > 0):
            i, j = np.meshgrid(c, c, indexing="ij")
            part = e[np.ix_(c, c)].ravel()
            parts.append(pd.DataFrame({"i": ids[i.ravel()], "j": ids[j.ravel()], "re": part.real, "im": part.imag}))
        return pd.concat(parts)

    re, im = _admittance(resistance, reactance)
    inv = Graph(g.nodes, g.edges.withColumns({"_y": re, "_z": im}), g.directed)
    return _on_matrix(inv, f, "i long, j long, re double, im double", "_y", matrices=12, imaginary="_z")


def effective_resistance(g: Graph, resistance: str) -> DataFrame:
    """``i, j, value`` of all pairs of one component, from the pseudo-inverse of the admittance Laplacian."""
    inv = Graph(g.nodes, g.edges.withColumn("_y", _admittance(resistance)[0]), g.directed)

    def f(ids: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        r = np.linalg.pinv(np.diag(y.sum(1)) - y, hermitian=True)
        d = np.diag(r)
        e = d[:, None] + d - 2 * r
        parts = []
        for c in _components(y > 0):
            i, j = np.meshgrid(c, c, indexing="ij")
            parts.append(pd.DataFrame({"i": ids[i.ravel()], "j": ids[j.ravel()], "value": e[np.ix_(c, c)].ravel()}))
        return pd.concat(parts)

    return _on_matrix(inv, f, "i long, j long, value double", "_y", matrices=8)


def average_effective_resistance(er: DataFrame) -> DataFrame:
    return er.filter("i < j").agg(F.avg("value").alias("value"))


def diameter_effective_resistance(er: DataFrame) -> DataFrame:
    return er.agg(F.max("value").alias("value"))


def effective_resistance_closeness(er: DataFrame) -> DataFrame:
    """``id, value``: N - 1 over the sum of the node's effective resistances, N its component's nodes."""
    return er.groupBy(F.col("i").alias("id")).agg(ratio(F.count("*") - 1, F.sum("value"), None).alias("value"))


def vertex_current_flow_betweenness(g: Graph, resistance: str) -> DataFrame:
    """``id, value``: mean current through a node over all pairs of others, per 2 / (N (N - 1))."""
    inv = Graph(g.nodes, g.edges.withColumn("_y", _admittance(resistance)[0]), g.directed)

    def f(ids: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        n = len(ids)
        r = np.linalg.pinv(np.diag(y.sum(1)) - y, hermitian=True)
        out = [sum(_pair_sum(np.delete(y[i, j] * (r[i] - r[j]), i)) for j in np.flatnonzero(y[i])) / max(n * (n - 1), 1) for i in range(n)]
        return pd.DataFrame({"id": ids, "value": np.array(out, float)})

    return _on_matrix(inv, f, "id long, value double", "_y", matrices=8)


def edge_current_flow_betweenness(g: Graph, resistance: str) -> DataFrame:
    """``src, dst, value``: mean current along each link over all pairs."""
    inv = Graph(g.nodes, g.edges.withColumn("_y", _admittance(resistance)[0]), g.directed)

    def f(ids: np.ndarray, _: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        n = len(ids)
        r = np.linalg.pinv(np.diag(y.sum(1)) - y, hermitian=True)
        rows = [(ids[i], ids[j], 2 / (n * (n - 1)) * _pair_sum(y[i, j] * (r[i] - r[j]))) for i, j in zip(*np.nonzero(y), strict=True)]
        return pd.DataFrame(rows, columns=["src", "dst", "value"])

    return _on_matrix(inv, f, "src long, dst long, value double", "_y", matrices=8)
