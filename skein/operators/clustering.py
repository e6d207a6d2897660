"""Clustering, motifs, cliques."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import ratio
from .graph import Graph, bilateral_degree, degree, in_degree, nsi_bilateral_degree, nsi_degree, nsi_in_degree, nsi_out_degree, out_degree


def oriented(g: Graph) -> DataFrame:
    """Each undirected link once, from the end of smaller degree: no node has more than sqrt(2 links) of them, so hubs make no quadratic wedges."""
    k = degree(g)
    e = g.edges.select("src", "dst").join(k.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    return e.filter("a < b or (a = b and src < dst)").select("src", "dst")


def cliques(g: Graph, order: int) -> DataFrame:
    """Each clique of ``order`` nodes once: columns v0, v1, ..."""
    e = oriented(g)
    out = e.toDF("v0", "v1")
    for n in range(2, order):
        out = out.join(e.toDF("v0", f"v{n}"), "v0")
        for m in range(1, n):
            out = out.join(e.toDF(f"v{m}", f"v{n}"), [f"v{m}", f"v{n}"], "left_semi")
    return out


def _members(c: DataFrame, order: int) -> DataFrame:
    return c.select(F.explode(F.array(*[f"v{k}" for k in range(order)])).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def local_cliquishness(g: Graph, order: int = 3) -> DataFrame:
    """``id, value``: share of the node's sets of order - 1 neighbours that are cliques; order 3 is local clustering."""
    if order < 3:
        raise ValueError("not defined below order 3")
    counts = g.per_node(_members(cliques(g, order), order), "n")
    sets: Column = F.lit(1.0)
    for k in range(order - 1):
        sets = sets * (F.col("k") - k) / (k + 1)
    return counts.join(degree(g), "id").select("id", F.when(F.col("k") >= order - 1, ratio(F.col("n"), sets)).otherwise(0.0).alias("value"))


def local_clustering(g: Graph) -> DataFrame:
    return local_cliquishness(g.undirected() if g.directed else g, 3)


def global_clustering(g: Graph) -> DataFrame:
    return local_clustering(g).agg(F.avg("value").alias("value"))


def transitivity(g: Graph) -> DataFrame:
    """One row: closed share of all wedges."""
    u = g.undirected() if g.directed else g
    t = cliques(u, 3).agg(F.count("*").alias("t"))
    w = degree(u).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("w"))
    return t.crossJoin(F.broadcast(w)).select(ratio(3 * F.col("t"), F.col("w")).alias("value"))  # one row each


def higher_order_transitivity(g: Graph, order: int = 4, share: float = 1.0, seed: int = 1) -> DataFrame:
    """One row; order 3: transitivity, order 4: four times the 4-cliques over the 4-stars.

    ``share`` below 1 estimates both counts from the cliques and stars around that
    share of the nodes, chosen by the hash of their id. Other orders raise.
    """
    if order < 3:
        raise ValueError("not defined below order 3")
    if order == 3:
        return transitivity(g)
    if order > 4:
        raise NotImplementedError("orders above 4")
    u = g.undirected() if g.directed else g
    k = degree(u).withColumn("w", F.col("k") * (F.col("k") - 1) * (F.col("k") - 2) / 6)
    if share >= 1:
        t = cliques(u, 4).agg((4 * F.count("*")).alias("t"))
    else:
        chosen = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))
        k = k.filter(chosen)
        t = _members(cliques(u, 4), 4).filter(chosen).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    return t.crossJoin(F.broadcast(k.agg(F.sum("w").alias("w")))).select(ratio(F.col("t"), F.col("w")).alias("value"))  # one row each


#: For each motif the orientation of the links (i, j), (j, k), (k, i): +1 as written, -1 against.
MOTIFS = {"cycle": (1, 1, 1), "mid": (1, -1, 1), "in": (-1, 1, 1), "out": (1, 1, -1)}


def both_ways(g: Graph, attribute: str | None = None, power: float = 1.0) -> DataFrame:
    """``src, dst, f, r``: every pair linked in either direction, in both orders, with the values of the links src -> dst and dst -> src (0 where there is none; 1 without an attribute)."""
    v = F.lit(1.0) if attribute is None else F.pow(F.col(attribute).cast("double"), F.lit(power)) if power != 1 else F.col(attribute).cast("double")
    e = g.edges.select("src", "dst", v.alias("v"))
    turned = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("f"), F.col("v").alias("r"))
    return e.select("src", "dst", F.col("v").alias("f"), F.lit(0.0).alias("r")).union(turned).groupBy("src", "dst").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))


def corners(pairs: DataFrame) -> DataFrame:
    """``a, b, c, ab, ba, bc, cb, ca, ac``: each triangle of :func:`both_ways` once, with the values of its six links.

    Links are oriented from the end of smaller degree, so a hub makes no quadratic wedges.
    """
    k = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    e = pairs.join(k.select(F.col("id").alias("src"), F.col("k").alias("p")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").alias("q")), "dst")
    e = e.filter("p < q or (p = q and src < dst)").select("src", "dst", "f", "r")
    return e.toDF("a", "b", "ab", "ba").join(e.toDF("a", "c", "ac", "ca"), "a").join(e.toDF("b", "c", "bc", "cb"), ["b", "c"])


def _closed(g: Graph, motif: str, attribute: str | None = None, power: float = 1.0, weighted: bool = False, loops: bool = False) -> DataFrame:
    """``id, t``: sum over the closed walks i, j, k in the motif's orientation of the links' values; ``weighted``: times the weights of j and k; ``loops``: with a link from each node to itself."""
    pairs = both_ways(g, attribute, power)
    s0, s1, s2 = MOTIFS[motif]
    tri = corners(pairs)
    w = g.nodes.select("id", "w")
    if weighted:
        for n in "abc":
            tri = tri.join(w.toDF(n, f"w{n}"), n)
    rows = []
    for i, j, k in ("abc", "acb", "bac", "bca", "cab", "cba"):
        way = lambda x, y, s: F.col(x + y if s > 0 else y + x)
        v = way(i, j, s0) * way(j, k, s1) * way(k, i, s2)
        rows.append(F.struct(F.col(i).alias("id"), (v * F.col(f"w{j}") * F.col(f"w{k}") if weighted else v).alias("t")))
    out = tri.select(F.explode(F.array(*rows)).alias("x")).select("x.id", "x.t")
    if loops:
        # walks that stay: at i throughout, at i before or after j, or at j
        link = lambda s: F.col("f") if s > 0 else F.col("r")
        back = lambda s: F.col("r") if s > 0 else F.col("f")
        e = pairs.join(w.toDF("src", "wi"), "src").join(w.toDF("dst", "wj"), "dst")
        two = link(s1) * back(s2) * F.col("wi") * F.col("wj") + link(s0) * back(s1) * F.col("wi") * F.col("wj") + link(s0) * back(s2) * F.col("wj") * F.col("wj")
        out = out.union(e.select(F.col("src").alias("id"), two.alias("t"))).union(w.select("id", (F.col("w") * F.col("w")).alias("t")))
    return out.groupBy("id").agg(F.sum("t").alias("t"))


def local_motif_clustering(g: Graph, motif: str, attribute: str | None = None) -> DataFrame:
    """``id, value``: share of the wedges at a node that the motif (cycle, mid, in, out) closes; with a link attribute each closing triangle counts by the geometric mean of its links' values."""
    t = g.per_node(_closed(g, motif, attribute, 1 / 3), "t", 0.0)
    k = out_degree(g).join(in_degree(g), "id").join(bilateral_degree(g), "id")
    wedges = {"in": F.col("k_in") * (F.col("k_in") - 1), "out": F.col("k_out") * (F.col("k_out") - 1)}.get(motif, F.col("k_in") * F.col("k_out") - F.col("k_bil"))
    return t.join(k, "id").select("id", ratio(F.col("t"), wedges).alias("value"))


def nsi_local_motif_clustering(g: Graph, motif: str, attribute: str | None = None, typical_weight: float | None = None) -> DataFrame:
    """``id, value``: node-weighted; with a typical weight the bias-corrected form (null where its denominator is 0)."""
    t = g.per_node(_closed(g, motif, attribute, 1 / 3, True, attribute is None), "t", 0.0)
    k = nsi_out_degree(g, typical_weight).join(nsi_in_degree(g, typical_weight), "id").join(nsi_bilateral_degree(g, typical_weight), "id")
    a, b = {"in": ("k_in", "k_in"), "out": ("k_out", "k_out")}.get(motif, ("k_in", "k_out"))
    wedges, ends = F.col(a) * F.col(b), F.col(a) + F.col(b)
    if typical_weight is None:
        return t.join(k, "id").select("id", ratio(F.col("t"), wedges).alias("value"))
    n = F.col("t") / typical_weight**2 - 3.0 * F.col("k_bil") - 1.0
    return t.join(k, "id").select("id", ratio(n, wedges - ends / typical_weight - F.col("k_bil") + 2, None).alias("value"))


def _weighted_walks(g: Graph, motif: str) -> DataFrame:
    return _closed(g, motif, None, 1.0, True, True)


def nsi_local_clustering(g: Graph, typical_weight: float | None = None) -> DataFrame:
    """``id, value``; with a typical weight the bias-corrected form."""
    t = _weighted_walks(g, "cycle").join(nsi_degree(g), "id").join(g.nodes, "id")
    if typical_weight is None:
        return t.select("id", ratio(F.col("t"), F.col("k") ** 2).alias("value"))
    k, n = F.col("k") / typical_weight - 1, F.col("t") / typical_weight**2
    return t.select("id", ratio(n - 3 * k - 1, k * (k - 1), None).alias("value"))


def nsi_global_clustering(g: Graph) -> DataFrame:
    return nsi_local_clustering(g).join(g.nodes, "id").agg(ratio(F.sum(F.col("value") * F.col("w")), F.sum("w")).alias("value"))


def nsi_transitivity(g: Graph) -> DataFrame:
    t = _weighted_walks(g, "cycle").join(nsi_degree(g), "id").join(g.nodes, "id")
    return t.agg(ratio(F.sum(F.col("t") * F.col("w")), F.sum(F.col("w") * F.col("k") ** 2)).alias("value"))


def nsi_local_soffer_clustering(g: Graph) -> DataFrame:
    k = nsi_degree(g)
    most = g.plus().join(k.toDF("src", "ki"), "src").join(k.toDF("dst", "kj"), "dst").join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.least("ki", "kj")).alias("m"))
    return _weighted_walks(g, "cycle").join(most, "id").select("id", ratio(F.col("t"), F.col("m")).alias("value"))


def weighted_local_clustering(g: Graph, attribute: str) -> DataFrame:
    """``id, value``: sum of w_ij w_jk w_ki over the largest weight times sum_j w_ij sum_j w_ji."""
    e = g.edges.select("src", "dst", F.col(attribute).alias("a"))
    s = e.groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("so")).join(e.groupBy(F.col("dst").alias("id")).agg(F.sum("a").alias("si")), "id")
    top = F.broadcast(e.agg(F.max("a").alias("top")))  # one row
    t = _closed(g, "cycle", attribute)
    return g.per_node(t.join(s, "id").crossJoin(top).select("id", ratio(F.col("t"), F.col("top") * F.col("so") * F.col("si")).alias("value")), "value", 0.0)
