"""Graphs as tables: degrees, neighbours, distributions, matrices as long tables.

``Graph.nodes(id, w)`` and ``Graph.edges(src, dst, ...)``; an undirected graph has
both orientations of every link. Other edge columns are link attributes. Node
weights make the n.s.i. measures, which count a node as its own neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import cumulative, histogram, meet, ratio


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> Graph:
        """From any list of links: repeated ones and loops go; undirected links get both orientations."""
        e = edges.filter("src != dst")
        if not directed:
            rest = [c for c in e.columns if c not in ("src", "dst")]
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
        e = e.dropDuplicates(["src", "dst"])
        if nodes is None:
            nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if "w" not in nodes.columns:
            nodes = nodes.withColumn("w", F.lit(1.0))
        return Graph(nodes.withColumn("w", F.col("w").cast("double")), e, directed)

    @staticmethod
    def small(spark: SparkSession, directed: bool = False) -> Graph:
        """Six-node test graphs with node and link weights."""
        links = [(0, 3, 1.3), (0, 4, 2.5), (0, 5, 1.1), (1, 2, 2.3), (1, 3, 2.9), (1, 4, 2.7), (2, 4, 1.5)]
        if directed:
            links = [(0, 1, 1.3), (0, 3, 2.5), (1, 2, 1.9), (1, 4, 1.0), (3, 1, 3.0), (4, 0, 2.1), (4, 2, 2.7), (5, 0, 1.5)]
        return Graph.of(spark.createDataFrame(links, "src long, dst long, weight double"), spark.createDataFrame([(i, 1.5 + 0.2 * i) for i in range(6)], "id long, w double"), directed)

    def undirected(self) -> Graph:
        return Graph.of(self.edges.select("src", "dst"), self.nodes, False)

    def permuted(self, mapping: DataFrame) -> Graph:
        """Nodes renamed by ``mapping(old, new)``."""
        m1, m2 = mapping.select(F.col("old").alias("src"), F.col("new").alias("a")), mapping.select(F.col("old").alias("dst"), F.col("new").alias("b"))
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        e = self.edges.join(m1, "src").join(m2, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)
        n = self.nodes.join(mapping.withColumnRenamed("old", "id"), "id").drop("id").withColumnRenamed("new", "id")
        return Graph(n, e, self.directed)

    def splitted(self, node: int, new: int, proportion: float = 0.5) -> Graph:
        """``node`` split in two linked twins, the second named ``new`` with that share of the weight. Links keep their attributes; the link between the twins has none (null)."""
        own = self.nodes.filter(F.col("id") == node)
        n = self.nodes.withColumn("w", F.when(F.col("id") == node, F.col("w") * (1 - proportion)).otherwise(F.col("w"))).unionByName(own.withColumns({"id": F.lit(new).cast("long"), "w": F.col("w") * proportion}))
        e = self.edges
        twin = e.filter(F.col("src") == node).withColumn("src", F.lit(new).cast("long")).unionByName(e.filter(F.col("dst") == node).withColumn("dst", F.lit(new).cast("long")))
        pair = own.select(F.lit(node).cast("long").alias("src"), F.lit(new).cast("long").alias("dst"))
        links = pair.union(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return Graph(n, e.unionByName(twin).unionByName(links, allowMissingColumns=True), self.directed)

    def subgraph(self, keep: DataFrame) -> Graph:
        """Induced by the nodes ``keep(id)``."""
        e = self.edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.nodes.join(keep.select("id"), "id", "left_semi"), e, self.directed)

    def plus(self) -> DataFrame:
        """Links and a loop at every node: ``src, dst``."""
        return self.edges.select("src", "dst").union(self.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))

    def per_node(self, values: DataFrame, name: str, default: float | int | None = 0) -> DataFrame:
        """``id, name`` for every node; ``default`` where ``values`` have none."""
        out = self.nodes.select("id").join(values.select("id", name), "id", "left")
        return out if default is None else out.select("id", F.coalesce(name, F.lit(default)).alias(name))


# degrees ---------------------------------------------------------------------------------------


def _sum_by(g: Graph, end: str, name: str, attribute: str | None) -> DataFrame:
    value = F.count("*") if attribute is None else F.sum(attribute)
    return g.per_node(g.edges.groupBy(F.col(end).alias("id")).agg(value.alias(name)), name, 0 if attribute is None else 0.0)


def out_degree(g: Graph, attribute: str | None = None) -> DataFrame:
    return _sum_by(g, "src", "k_out", attribute)


def in_degree(g: Graph, attribute: str | None = None) -> DataFrame:
    return _sum_by(g, "dst", "k_in", attribute)


def degree(g: Graph, attribute: str | None = None) -> DataFrame:
    """``id, k``: links, or the sum of an attribute; in and out together if directed."""
    if not g.directed:
        return out_degree(g, attribute).withColumnRenamed("k_out", "k")
    return out_degree(g, attribute).join(in_degree(g, attribute), "id").select("id", (F.col("k_out") + F.col("k_in")).alias("k"))


def bilateral_degree(g: Graph, attribute: str | None = None) -> DataFrame:
    """``id, k_bil``: neighbours linked in both directions; with an attribute the sum of the products of both links' values."""
    if attribute is not None:
        there = g.edges.select("src", "dst", F.col(attribute).alias("a"))
        back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(attribute).alias("b"))
        both = there.join(back, ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("a") * F.col("b")).alias("k_bil"))
        return g.per_node(both, "k_bil", 0.0)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = g.edges.select("src", "dst").join(back, ["src", "dst"], "left_semi")
    return g.per_node(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k_bil")), "k_bil")


def _nsi_sum(g: Graph, own: str, other: str, name: str, attribute: str | None = None) -> DataFrame:
    w = g.nodes.select(F.col("id").alias(other), "w")
    if attribute is not None:
        got = g.edges.join(w, other).groupBy(F.col(own).alias("id")).agg(F.sum(F.col("w") * F.col(attribute)).alias(name))
        return g.per_node(got, name, 0.0)
    return g.plus().join(w, other).groupBy(F.col(own).alias("id")).agg(F.sum("w").alias(name))


def _typical(df: DataFrame, name: str, typical_weight: float | None) -> DataFrame:
    return df if typical_weight is None else df.select("id", (F.col(name) / typical_weight - 1).alias(name))


def nsi_out_degree(g: Graph, typical_weight: float | None = None, attribute: str | None = None) -> DataFrame:
    return _typical(_nsi_sum(g, "src", "dst", "k_out", attribute), "k_out", typical_weight)


def nsi_in_degree(g: Graph, typical_weight: float | None = None, attribute: str | None = None) -> DataFrame:
    return _typical(_nsi_sum(g, "dst", "src", "k_in", attribute), "k_in", typical_weight)


def nsi_degree(g: Graph, typical_weight: float | None = None, attribute: str | None = None) -> DataFrame:
    """``id, k``: weight of the node and its neighbours; directed: in plus out; with an attribute the neighbours' weights times it, without the node itself."""
    if g.directed:
        both = nsi_out_degree(g, None, attribute).join(nsi_in_degree(g, None, attribute), "id").select("id", (F.col("k_out") + F.col("k_in")).alias("k"))
    else:
        both = nsi_out_degree(g, None, attribute).withColumnRenamed("k_out", "k")
    return _typical(both, "k", typical_weight)


def nsi_bilateral_degree(g: Graph, typical_weight: float | None = None) -> DataFrame:
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = Graph(g.nodes, g.edges.select("src", "dst").join(back, ["src", "dst"], "left_semi"), True)
    return _typical(nsi_out_degree(both).withColumnRenamed("k_out", "k_bil"), "k_bil", typical_weight)


def degree_distribution(g: Graph, kind: str = "degree") -> DataFrame:
    """Histogram of degrees; bins: the largest degree, one more for ``out``."""
    f, name, more = {"degree": (degree, "k", 0), "in": (in_degree, "k_in", 0), "out": (out_degree, "k_out", 1)}[kind]
    return histogram(f(g), name, F.max("v").cast("int") + more)


def degree_cdf(g: Graph, kind: str = "degree") -> DataFrame:
    f, name, more = {"degree": (degree, "k", 0), "in": (in_degree, "k_in", 1), "out": (out_degree, "k_out", 1)}[kind]
    return cumulative(histogram(f(g), name, F.max("v").cast("int") + more))


def nsi_degree_histogram(g: Graph, typical_weight: float | None = None) -> DataFrame:
    return cumulative(histogram(nsi_degree(g, typical_weight), "k", F.floor(F.max("v") / F.min("v")).cast("int") + 1))


# neighbours ------------------------------------------------------------------------------------


def neighbor_degrees(g: Graph) -> DataFrame:
    """``id, k_mean, k_max`` of the neighbours' degrees, links taken as undirected."""
    u = g.undirected() if g.directed else g
    k = degree(g).withColumnRenamed("id", "dst")
    own = degree(u).withColumnRenamed("k", "n")
    got = u.edges.join(k, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("k").alias("s"), F.max("k").alias("m"))
    return own.join(got, "id", "left").select("id", ratio(F.coalesce("s", F.lit(0)), F.col("n")).alias("k_mean"), F.coalesce("m", F.lit(0)).alias("k_max"))


def nsi_neighbor_degrees(g: Graph) -> DataFrame:
    """``id, k_mean, k_max``: weighted mean and maximum of n.s.i. degrees over the neighbourhood."""
    k = nsi_degree(g)
    other = k.join(g.nodes, "id").select(F.col("id").alias("dst"), F.col("k").alias("kj"), "w")
    got = g.plus().join(other, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("kj")).alias("s"), F.max("kj").alias("k_max"))
    return got.join(k, "id").select("id", ratio(F.col("s"), F.col("k")).alias("k_mean"), "k_max")


def assortativity(g: Graph) -> DataFrame:
    """One row, ``r``: correlation of the degrees at the links' ends."""
    k = degree(g)
    e = g.edges.select("src", "dst") if g.directed else g.edges.filter("src < dst").select("src", "dst")
    e = e.join(k.select(F.col("id").alias("src"), F.col("k").cast("double").alias("a")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").cast("double").alias("b")), "dst")
    m = e.agg(F.avg(F.col("a") * F.col("b")).alias("ab"), F.avg((F.col("a") + F.col("b")) / 2).alias("mean"), F.avg((F.col("a") * F.col("a") + F.col("b") * F.col("b")) / 2).alias("square"))
    return m.select(ratio(F.col("ab") - F.col("mean") ** 2, F.col("square") - F.col("mean") ** 2, None).alias("r"))


def link_density(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.edges.agg(F.count("*").alias("m")).crossJoin(F.broadcast(n)).select(ratio(F.col("m"), F.col("n") * (F.col("n") - 1)).alias("link_density"))  # one row each


def common_neighbors(g: Graph) -> DataFrame:
    """``i, j, common`` of pairs with a common neighbour: a row for each pair is the result, combined before the shuffle."""
    a, b = g.edges.select(F.col("src").alias("i"), F.col("dst").alias("h")), g.edges.select(F.col("src").alias("h"), F.col("dst").alias("j"))
    return a.join(b, "h").groupBy("i", "j").agg(F.count("*").alias("common"))


def matching_index(g: Graph, all_pairs: bool = False) -> DataFrame:
    """``i, j, value``: common over all neighbours of the two; pairs without common ones have no row, or with ``all_pairs`` 0."""
    if all_pairs:
        every = meet(g.nodes.select(F.col("id").alias("i")), "i", g.nodes.select(F.col("id").alias("j")), "j")
        return every.join(matching_index(g), ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
    k = degree(g)
    return common_neighbors(g).join(k.select(F.col("id").alias("i"), F.col("k").alias("ki")), "i").join(k.select(F.col("id").alias("j"), F.col("k").alias("kj")), "j").select("i", "j", ratio(F.col("common"), F.col("ki") + F.col("kj") - F.col("common")).alias("value"))


def nsi_twinness(g: Graph) -> DataFrame:
    """``i, j, value`` of linked pairs and each node itself: weight of the common neighbourhood over the larger one's."""
    p = g.plus()
    via = p.join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").select(F.col("src").alias("i"), F.col("dst").alias("h"), "w")
    both = via.join(p.select(F.col("src").alias("h"), F.col("dst").alias("j")), "h").groupBy("i", "j").agg(F.sum("w").alias("c")).join(p.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"], "left_semi")
    k = nsi_degree(g)
    return both.join(k.select(F.col("id").alias("i"), F.col("k").alias("ki")), "i").join(k.select(F.col("id").alias("j"), F.col("k").alias("kj")), "j").select("i", "j", ratio(F.col("c"), F.greatest("ki", "kj")).alias("value"))


def laplacian(g: Graph, direction: str = "out", attribute: str | None = None) -> DataFrame:
    """``i, j, value``: degrees on the diagonal, minus the links elsewhere."""
    if direction not in ("in", "out"):
        raise ValueError('direction must be "in" or "out"')
    k = (out_degree if direction == "out" else in_degree)(g, attribute).toDF("i", "k")
    v = F.lit(1.0) if attribute is None else F.col(attribute).cast("double")
    return k.select("i", F.col("i").alias("j"), F.col("k").cast("double").alias("value")).union(g.edges.select("src", "dst", -v))


def nsi_laplacian(g: Graph) -> DataFrame:
    p = g.plus().join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("value"))
    k = nsi_degree(g).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("k").alias("value"))
    return p.union(k).groupBy("i", "j").agg(F.sum("value").alias("value"))


def hamming_distance(g: Graph, other: Graph) -> DataFrame:
    """One row, ``distance``: share of ordered pairs that only one graph links."""
    a, b = g.edges.select("src", "dst", F.lit(1).alias("a")), other.edges.select("src", "dst", F.lit(1).alias("b"))
    odd = a.join(b, ["src", "dst"], "full").filter("a is null or b is null").agg(F.count("*").alias("m"))
    return odd.crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n")))).select(ratio(F.col("m"), F.col("n") * (F.col("n") - 1)).alias("distance"))  # one row each


def average_link_attribute(g: Graph, attribute: str) -> DataFrame:
    """``id, value``: sum of an attribute over the node's links, by the number of nodes."""
    n = F.broadcast(g.nodes.agg(F.count("*").alias("n")))  # one row
    return out_degree(g, attribute).crossJoin(n).select("id", (F.col("k_out") / F.col("n")).alias("value"))


def with_attribute(g: Graph, values: DataFrame) -> Graph:
    """Links with further attributes from ``values(src, dst, ...)``."""
    return Graph(g.nodes, g.edges.join(values, ["src", "dst"], "left"), g.directed)


def summary(g: Graph) -> str:
    """Kind, numbers of nodes and links, link density."""
    n, m = g.nodes.count(), g.edges.count()
    links = m if g.directed else m // 2
    return f"{'directed' if g.directed else 'undirected'}, {n} nodes, {links} links, link density {m / (n * (n - 1)) if n > 1 else 0:.3f}"
