"""Measures between and within groups of nodes. A group is a table ``(id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import ratio
from .clustering import local_clustering
from .graph import Graph
from .paths import betweenness, nsi_betweenness, path_lengths


def cross_links(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """Links from group ``a`` to group ``b``, attributes included."""
    return g.edges.join(a.select(F.col("id").alias("src")), "src", "left_semi").join(b.select(F.col("id").alias("dst")), "dst", "left_semi")


def _one(df: DataFrame, name: str) -> DataFrame:
    return F.broadcast(df.agg(F.count("*").alias(name)))  # one row


def _fill(group: DataFrame, values: DataFrame, default: float | int = 0) -> DataFrame:
    return group.select("id").join(values, "id", "left").select("id", F.coalesce("value", F.lit(default)).alias("value"))


def cross_degree(g: Graph, a: DataFrame, b: DataFrame, attribute: str | None = None, direction: str = "both") -> DataFrame:
    """``id, value`` of group a's nodes: links to b (``out``), from b (``in``) or, in a directed graph, both."""
    value = F.count("*") if attribute is None else F.sum(attribute)
    out = cross_links(g, a, b).groupBy(F.col("src").alias("id")).agg(value.alias("value"))
    into = cross_links(g, b, a).groupBy(F.col("dst").alias("id")).agg(value.alias("value"))
    got = {"out": out, "in": into}.get(direction) or (out.union(into).groupBy("id").agg(F.sum("value").alias("value")) if g.directed else out)
    return _fill(a, got, 0 if attribute is None else 0.0)


def internal_degree(g: Graph, a: DataFrame, attribute: str | None = None, direction: str = "both") -> DataFrame:
    return cross_degree(g, a, a, attribute, direction)


def number_cross_links(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return cross_links(g, a, b).agg(F.count("*").alias("value"))


def number_internal_links(g: Graph, a: DataFrame) -> DataFrame:
    """One row: links within the group, an undirected one once."""
    return cross_links(g, a, a).agg((F.count("*") if g.directed else F.floor(F.count("*") / 2)).alias("value"))


def total_cross_degree(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean cross degree of group a's nodes."""
    return cross_degree(g, a, b).agg(F.avg("value").alias("value"))


def cross_link_density(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return number_cross_links(g, a, b).crossJoin(_one(a, "na")).crossJoin(_one(b, "nb")).select(ratio(F.col("value"), F.col("na") * F.col("nb")).alias("value"))


def internal_link_density(g: Graph, a: DataFrame) -> DataFrame:
    return number_cross_links(g, a, a).crossJoin(_one(a, "n")).select(ratio(F.col("value"), F.col("n") * (F.col("n") - 1)).alias("value"))


def cross_degree_density(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return cross_degree(g, a, b).crossJoin(_one(b, "nb")).select("id", ratio(F.col("value"), F.col("nb")).alias("value"))


def internal_global_clustering(g: Graph, a: DataFrame) -> DataFrame:
    """One row: mean over the group of local clustering in the whole graph."""
    return local_clustering(g).join(a.select("id"), "id", "left_semi").agg(F.avg("value").alias("value"))


def _cross_triangles(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, t``: unordered pairs of b-neighbours of a node in a that are linked themselves."""
    c = cross_links(g, a, b).select("src", "dst")
    inner = cross_links(g, b, b).select(F.col("src").alias("p"), F.col("dst").alias("q")).filter("p < q")
    return c.select(F.col("src").alias("id"), F.col("dst").alias("p")).join(inner, "p").join(c.select(F.col("src").alias("id"), F.col("dst").alias("q")), ["id", "q"], "left_semi").groupBy("id").agg(F.count("*").alias("t"))


def cross_local_clustering(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    k = cross_degree(g, a, b, direction="out").withColumnRenamed("value", "k")
    return k.join(_cross_triangles(g, a, b), "id", "left").select("id", ratio(2 * F.coalesce("t", F.lit(0)), F.col("k") * (F.col("k") - 1)).alias("value"))


def cross_global_clustering(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return cross_local_clustering(g, a, b).agg(F.avg("value").alias("value"))


def cross_transitivity(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    k = cross_degree(g, a, b, direction="out").withColumnRenamed("value", "k")
    return k.join(_cross_triangles(g, a, b), "id", "left").agg(ratio(F.sum(F.coalesce("t", F.lit(0))), F.sum(F.col("k") * (F.col("k") - 1) / 2)).alias("value"))


def cross_path_lengths(g: Graph, a: DataFrame, b: DataFrame, attribute: str | None = None) -> DataFrame:
    """``src, dst, d`` over the whole graph from group a to group b."""
    return path_lengths(g, attribute, a).join(b.select(F.col("id").alias("dst")), "dst", "left_semi")


def internal_path_lengths(g: Graph, a: DataFrame, attribute: str | None = None) -> DataFrame:
    """``src, dst, d`` among the group's nodes over the whole graph: paths may leave the group."""
    return cross_path_lengths(g, a, a, attribute)


def cross_average_path_length(g: Graph, a: DataFrame, b: DataFrame, attribute: str | None = None) -> DataFrame:
    return cross_path_lengths(g, a, b, attribute).filter("src != dst").agg(F.avg("d").alias("value"))


def internal_average_path_length(g: Graph, a: DataFrame, attribute: str | None = None) -> DataFrame:
    return internal_path_lengths(g, a, attribute).filter("src != dst").agg(F.avg("d").alias("value"))


def cross_closeness(g: Graph, a: DataFrame, b: DataFrame, attribute: str | None = None) -> DataFrame:
    """``id, value`` of group a: size of b over the sum of distances to it; N - 1 of the whole graph for unreachable ones."""
    d = cross_path_lengths(g, a, b, attribute).groupBy(F.col("src").alias("id")).agg(F.sum("d").alias("s"), F.count("*").alias("r"))
    every = a.select("id").join(d, "id", "left").crossJoin(_one(b, "nb")).crossJoin(_one(g.nodes, "n"))
    far = (F.col("n") - 1) * (F.col("nb") - F.coalesce("r", F.lit(0)))
    return every.select("id", ratio(F.col("nb"), F.coalesce("s", F.lit(0.0)) + far).alias("value"))


def average_cross_closeness(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return cross_closeness(g, a, b).agg(F.avg("value").alias("value"))


def local_efficiency(g: Graph, a: DataFrame, b: DataFrame, attribute: str | None = None) -> DataFrame:
    """``id, value`` of group a: mean inverse distance to b."""
    d = cross_path_lengths(g, a, b, attribute).filter("d > 0").groupBy(F.col("src").alias("id")).agg(F.sum(1 / F.col("d")).alias("s"))
    return a.select("id").join(d, "id", "left").crossJoin(_one(b, "nb")).select("id", ratio(F.coalesce("s", F.lit(0.0)), F.col("nb")).alias("value"))


def cross_global_efficiency(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return local_efficiency(g, a, b).agg(ratio(F.lit(1.0), F.avg("value")).alias("value"))


def cross_betweenness(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return betweenness(g, a, b)


def internal_betweenness(g: Graph, a: DataFrame) -> DataFrame:
    return betweenness(g, a, a)


def nsi_cross_betweenness(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return nsi_betweenness(g, a, b)


def internal_closeness(g: Graph, a: DataFrame, attribute: str | None = None) -> DataFrame:
    """``id, value``: the group's size less one over the sum of distances within it (paths over the whole graph), N - 1 of the whole graph for unreachable nodes."""
    d = internal_path_lengths(g, a, attribute).groupBy(F.col("src").alias("id")).agg(F.sum("d").alias("s"), F.count("*").alias("r"))
    every = a.select("id").join(d, "id").crossJoin(_one(a, "m")).crossJoin(_one(g.nodes, "n"))
    return every.select("id", ratio(F.col("m") - 1, F.col("s") + (F.col("n") - 1) * (F.col("m") - F.col("r"))).alias("value"))


# node-weighted -----------------------------------------------------------------------------------


def _plus_between(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, j, w``: b's nodes linked to (or equal to) a node of a, with their weights."""
    p = g.plus().join(a.select(F.col("id").alias("src")), "src", "left_semi").join(b.select(F.col("id").alias("dst")), "dst", "left_semi")
    return p.join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("j"), "w")


def nsi_cross_degree(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return _fill(a, _plus_between(g, a, b).groupBy("id").agg(F.sum("w").alias("value")), 0.0)


def nsi_internal_degree(g: Graph, a: DataFrame) -> DataFrame:
    return nsi_cross_degree(g, a, a)


def _total(g: Graph, a: DataFrame, name: str) -> DataFrame:
    return F.broadcast(g.nodes.join(a.select("id"), "id", "left_semi").agg(F.sum("w").alias(name)))  # one row


def nsi_cross_mean_degree(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return nsi_cross_degree(g, a, b).join(g.nodes.select("id", "w"), "id").agg(ratio(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def nsi_cross_edge_density(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    s = nsi_cross_degree(g, a, b).join(g.nodes.select("id", "w"), "id").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    return s.crossJoin(_total(g, a, "wa")).crossJoin(_total(g, b, "wb")).select(ratio(F.col("s"), F.col("wa") * F.col("wb")).alias("value"))


def _nsi_cross_triangles(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    p, q = _plus_between(g, a, b), _plus_between(g, b, b)
    return p.join(q.select(F.col("id").alias("j"), F.col("j").alias("h"), F.col("w").alias("wh")), "j").join(p.select("id", F.col("j").alias("h")), ["id", "h"], "left_semi").groupBy("id").agg(F.sum(F.col("w") * F.col("wh")).alias("t"))


def nsi_cross_local_clustering(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    k = nsi_cross_degree(g, a, b).withColumnRenamed("value", "k")
    return k.join(_nsi_cross_triangles(g, a, b), "id", "left").select("id", ratio(F.coalesce("t", F.lit(0.0)), F.col("k") ** 2).alias("value"))


def nsi_internal_local_clustering(g: Graph, a: DataFrame) -> DataFrame:
    return nsi_cross_local_clustering(g, a, a)


def nsi_cross_global_clustering(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    return nsi_cross_local_clustering(g, a, b).join(g.nodes.select("id", "w"), "id").agg(ratio(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def nsi_cross_transitivity(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    k = nsi_cross_degree(g, a, b).withColumnRenamed("value", "k").join(g.nodes.select("id", "w"), "id")
    return k.join(_nsi_cross_triangles(g, a, b), "id", "left").agg(ratio(F.sum(F.col("w") * F.coalesce("t", F.lit(0.0))), F.sum(F.col("w") * F.col("k") ** 2)).alias("value"))


def nsi_cross_closeness(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, value`` of group a: weight of b over the weighted distances to it, a node at 1 from itself, N - 1 if unreachable."""
    d = cross_path_lengths(g, a, b).withColumn("d", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("d"))).join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.sum("w").alias("r"))
    every = a.select("id").join(d, "id", "left").crossJoin(_total(g, b, "wb")).crossJoin(_one(g.nodes, "n"))
    return every.select("id", ratio(F.col("wb"), F.coalesce("s", F.lit(0.0)) + (F.col("n") - 1) * (F.col("wb") - F.coalesce("r", F.lit(0.0)))).alias("value"))


def nsi_cross_average_path_length(g: Graph, a: DataFrame, b: DataFrame, documented: bool = False) -> DataFrame:
    """One row. By default both weights of the normaliser are group a's, as the established results have it; ``documented``: a's and b's."""
    d = cross_path_lengths(g, a, b).withColumn("d", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("d")))
    d = d.join(g.nodes.select(F.col("id").alias("src"), F.col("w").alias("wi")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("w").alias("wj")), "dst")
    s = d.agg(F.sum(F.col("wi") * F.col("wj") * F.col("d")).alias("s"))
    return s.crossJoin(_total(g, a, "wa")).crossJoin(_total(g, b if documented else a, "wb")).select(ratio(F.col("s"), F.col("wa") * F.col("wb")).alias("value"))


def nsi_internal_closeness(g: Graph, a: DataFrame) -> DataFrame:
    return nsi_cross_closeness(g, a, a)
