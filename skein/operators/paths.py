"""Shortest paths, closeness, efficiency, betweenness and other iterated measures.

Every level of a search and every step of an iteration is a table in the shared
folder: plans stay short and lost executors cost one step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import discard, durable, meet, ratio
from .graph import Graph


def path_lengths(g: Graph, attribute: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, d`` of every reachable pair, (i, i, 0) included; from ``sources(id)`` only, if given.

    Hops: breadth-first, a join per level; levels are written once and never
    rewritten, and in an undirected graph a level meets only the last two of them.
    With a link attribute (values >= 0): relaxation of the distances that the last
    round lowered, until none falls. Repeated and null source ids count once or not
    at all; an empty graph gives no rows.
    """
    start = (g.nodes if sources is None else sources).filter("id is not null").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d")).distinct()
    e = g.edges.select(F.col("src").alias("dst"), F.col("dst").alias("nxt"), (F.lit(1.0) if attribute is None else F.col(attribute).cast("double")).alias("len"))
    fresh = durable(start)
    if attribute is None:
        levels = [fresh]
        while True:
            step = fresh.join(e, "dst").select("src", F.col("nxt").alias("dst"), F.lit(float(len(levels))).alias("d")).distinct()
            for old in levels if g.directed else levels[-2:]:
                step = step.join(old.select("src", "dst"), ["src", "dst"], "left_anti")
            fresh = durable(step)
            if fresh.isEmpty():
                return reduce(lambda x, y: x.union(y), levels)
            levels.append(fresh)
    seen = fresh
    while True:
        step = fresh.join(e, "dst").groupBy("src", F.col("nxt").alias("dst")).agg(F.min(F.col("d") + F.col("len")).alias("d"))
        old = seen.select("src", "dst", F.col("d").alias("old"))
        fresh = durable(step.join(old, ["src", "dst"], "left").filter("old is null or d < old").select("src", "dst", "d"))
        if fresh.isEmpty():
            return seen
        before, seen = seen, durable(seen.union(fresh).groupBy("src", "dst").agg(F.min("d").alias("d")))
        discard(before)


def _size(g: Graph) -> DataFrame:
    return F.broadcast(g.nodes.agg(F.count("*").alias("n"), F.sum("w").alias("total")))  # one row


def average_path_length(g: Graph, dist: DataFrame) -> DataFrame:
    return dist.filter("src != dst").agg(F.avg("d").alias("value"))


def _weighted(g: Graph, dist: DataFrame) -> DataFrame:
    """Distances with the diagonal at 1 and the weights of both ends."""
    d = dist.withColumn("d", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("d")))
    return d.join(g.nodes.select(F.col("id").alias("src"), F.col("w").alias("wi")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("w").alias("wj")), "dst")


def nsi_average_path_length(g: Graph, dist: DataFrame) -> DataFrame:
    p = F.col("wi") * F.col("wj")
    return _weighted(g, dist).agg(ratio(F.sum(p * F.col("d")), F.sum(p), None).alias("value"))


def diameter(dist: DataFrame, g: Graph | None = None) -> DataFrame:
    """The longest of the shortest paths. With the graph given, the number of its nodes if some pair has no path."""
    if g is None:
        return dist.agg(F.max("d").alias("value"))
    m = dist.agg(F.max("d").alias("d"), F.count("*").alias("r")).crossJoin(_size(g))
    return m.select(F.when(F.col("r") < F.col("n") * F.col("n"), F.col("n").cast("double")).otherwise(F.col("d")).alias("value"))


def closeness(g: Graph, dist: DataFrame, unreachable: str = "component") -> DataFrame:
    """``id, value``: reached nodes over the sum of distances; ``"n"``: N - 1 over it with N for unreachable ones."""
    s = dist.groupBy(F.col("src").alias("id")).agg((F.count("*") - 1).alias("r"), F.sum("d").alias("s")).crossJoin(_size(g))
    if unreachable == "component":
        return s.select("id", ratio(F.col("r"), F.col("s")).alias("value"))
    return s.select("id", ratio(F.col("n") - 1, F.col("s") + F.col("n") * (F.col("n") - 1 - F.col("r"))).alias("value"))


def nsi_closeness(g: Graph, dist: DataFrame, kind: str = "plain") -> DataFrame:
    """``id, value``: ``plain`` (0 where something is unreachable), ``harmonic`` or ``exponential``."""
    d = _weighted(g, dist)
    by = F.col("src").alias("id")
    if kind == "plain":
        s = d.groupBy(by).agg(F.sum(F.col("wj") * F.col("d")).alias("s"), F.count("*").alias("r")).crossJoin(_size(g))
        return s.select("id", F.when(F.col("r") == F.col("n"), ratio(F.col("total"), F.col("s"))).otherwise(0.0).alias("value"))
    term = F.col("wj") / F.col("d") if kind == "harmonic" else F.col("wj") * F.pow(F.lit(2.0), -F.col("d"))
    return d.groupBy(by).agg(F.sum(term).alias("s")).crossJoin(_size(g)).select("id", ratio(F.col("s"), F.col("total")).alias("value"))


def global_efficiency(g: Graph, dist: DataFrame) -> DataFrame:
    s = dist.filter("src != dst and d > 0").agg(F.coalesce(F.sum(1 / F.col("d")), F.lit(0.0)).alias("s"))
    return s.crossJoin(_size(g)).select(ratio(F.col("s"), F.col("n") * (F.col("n") - 1)).alias("value"))


def nsi_global_efficiency(g: Graph, dist: DataFrame) -> DataFrame:
    s = _weighted(g, dist).agg(F.sum(F.col("wi") * F.col("wj") / F.col("d")).alias("s"))
    return s.crossJoin(_size(g)).select(ratio(F.col("s"), F.col("total") ** 2).alias("value"))


def distance_based_measures(g: Graph, dist: DataFrame, unreachable: float | None = None) -> DataFrame:
    """``id, closeness, harmonic, exponential, nsi_closeness, nsi_harmonic, nsi_exponential`` in one pass; unreachable pairs count as far as ``unreachable`` (default: the number of nodes). In the n.s.i. forms a node is at 1 from itself."""
    far = F.col("n").cast("double") if unreachable is None else F.lit(float(unreachable))
    w = g.nodes.select(F.col("id").alias("dst"), F.col("w").alias("wj"))
    d, other, half = F.col("d"), F.col("src") != F.col("dst"), lambda x: F.pow(F.lit(0.5), x)
    own = F.when(other, d).otherwise(1.0)
    sums = dist.join(w, "dst").groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("r"), F.sum("wj").alias("rw"), F.sum("d").alias("s"),
        F.coalesce(F.sum(F.when(other, 1 / F.nullif(d, F.lit(0.0)))), F.lit(0.0)).alias("h"), F.coalesce(F.sum(F.when(other, half(d))), F.lit(0.0)).alias("e"),
        F.sum(F.col("wj") * own).alias("ns"), F.sum(F.col("wj") / F.nullif(own, F.lit(0.0))).alias("nh"), F.sum(F.col("wj") * half(own)).alias("ne"),
    )
    m, mw = F.col("n") - F.col("r"), F.col("total") - F.col("rw")
    return sums.crossJoin(_size(g)).select(
        "id",
        ratio(F.col("n") - 1, F.col("s") + m * far).alias("closeness"),
        ratio(F.col("h") + m / far, F.col("n") - 1).alias("harmonic"),
        ratio(F.col("e") + m * half(far), F.col("n") - 1).alias("exponential"),
        ratio(F.col("total"), F.col("ns") + mw * far).alias("nsi_closeness"),
        ratio(F.col("nh") + mw / far, F.col("total")).alias("nsi_harmonic"),
        ratio(F.col("ne") + mw * half(far), F.col("total")).alias("nsi_exponential"),
    )


def distance_based_totals(g: Graph, measures: DataFrame) -> DataFrame:
    """One row of the whole graph's measures from :func:`distance_based_measures`: ``average_path_length, global_efficiency, nsi_average_path_length, nsi_global_efficiency``."""
    m = measures.join(g.nodes.select("id", "w"), "id").crossJoin(_size(g))
    return m.agg(
        F.avg(ratio(F.lit(1.0), F.col("closeness"))).alias("average_path_length"),
        F.avg("harmonic").alias("global_efficiency"),
        F.sum(F.col("w") / F.col("total") * ratio(F.lit(1.0), F.col("nsi_closeness"))).alias("nsi_average_path_length"),
        F.sum(F.col("w") / F.col("total") * F.col("nsi_harmonic")).alias("nsi_global_efficiency"),
    )


def local_vulnerability(g: Graph, attribute: str | None = None, most_rows: int = 200_000_000) -> DataFrame:
    """``id, value``: relative loss of efficiency without the node.

    The searches without some of the nodes run together, keyed by the removed node,
    in as many batches as keep one at about ``most_rows`` rows (removed, source,
    target); a batch's table goes when its sums are taken. 0 where the whole graph
    has no path.
    """
    base = global_efficiency(g, path_lengths(g, attribute)).withColumnRenamed("value", "e0")
    e = g.edges.select("src", "dst", (F.lit(1.0) if attribute is None else F.col(attribute).cast("double")).alias("len"))
    hop = e.select(F.col("src").alias("dst"), F.col("dst").alias("nxt"), "len")
    n = g.nodes.count()
    batches = max(1, -(-(n**3) // most_rows))
    sums = None
    for k in range(batches):
        gone = g.nodes.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select(F.col("id").alias("gone"))
        seen = fresh = durable(meet(gone, "gone", g.nodes.select(F.col("id").alias("src")), "src").filter("gone != src").select("gone", "src", F.col("src").alias("dst"), F.lit(0.0).alias("d")))
        while True:
            step = fresh.join(hop, "dst").filter("nxt != gone").groupBy("gone", "src", F.col("nxt").alias("dst")).agg(F.min(F.col("d") + F.col("len")).alias("d"))
            fresh = durable(step.join(seen.withColumnRenamed("d", "old"), ["gone", "src", "dst"], "left").filter("old is null or d < old").select("gone", "src", "dst", "d"))
            if fresh.isEmpty():
                break
            before, seen = seen, durable(seen.union(fresh).groupBy("gone", "src", "dst").agg(F.min("d").alias("d")))
            discard(before)
        part = durable(seen.filter("src != dst").groupBy(F.col("gone").alias("id")).agg(F.sum(1 / F.nullif(F.col("d"), F.lit(0.0))).alias("s")))
        discard(seen)
        sums = part if sums is None else sums.union(part)
    rest = g.per_node(sums, "s", 0.0).crossJoin(_size(g)).crossJoin(F.broadcast(base))  # one row each
    return rest.select("id", ratio(F.col("e0") - F.coalesce(F.col("s") / F.nullif((F.col("n") - 1) * (F.col("n") - 2), F.lit(0)), F.lit(0.0)), F.col("e0")).alias("value"))


# betweenness -----------------------------------------------------------------------------------


def _search(g: Graph, sources: DataFrame, nsi: bool) -> tuple[DataFrame, int]:
    """``src, id, level, sigma`` by breadth-first search from ``sources(id)``: numbers of shortest paths, or with n.s.i. weights their weighted form."""
    own = sources.select(F.col("id").alias("src"), "id", F.lit(0).alias("level"), F.lit(1.0).alias("sigma"))
    seen = last = durable(own)
    e = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("nxt"))
    w = g.nodes.select("id", "w")
    level = 0
    while True:
        level += 1
        if nsi and level > 1:
            last = last.join(w, "id").withColumn("sigma", F.col("sigma") * F.col("w"))
        step = last.join(e, "id").groupBy("src", F.col("nxt").alias("id")).agg(F.sum("sigma").alias("sigma"))
        last = durable(step.join(seen.select("src", "id"), ["src", "id"], "left_anti").select("src", "id", F.lit(level).alias("level"), "sigma"))
        if last.isEmpty():
            return seen, level - 1
        seen = durable(seen.union(last))


def _dependencies(g: Graph, found: DataFrame, top: int, target: Column, nsi: bool = False) -> tuple[DataFrame, DataFrame]:
    """Back-propagation: (``src, id, delta``, ``src, a, b, flow`` along links); n.s.i.: what a node passes back counts by its weight."""
    w = g.nodes.select(F.col("id").alias("b"), "w")
    e = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    delta, flows = None, None
    for level in range(top, 0, -1):
        here = found.filter(F.col("level") == level)
        if delta is not None:
            here = here.join(delta, ["src", "id"], "left")
        here = here.select("src", F.col("id").alias("b"), F.col("sigma").alias("sb"), (target + (F.coalesce("delta", F.lit(0.0)) if delta is not None else F.lit(0.0))).alias("push"))
        if nsi:
            here = here.join(w, "b").withColumn("push", F.col("push") * F.col("w"))
        up = found.filter(F.col("level") == level - 1).select("src", F.col("id").alias("a"), F.col("sigma").alias("sa"))
        flow = durable(here.join(e, "b").join(up, ["src", "a"]).select("src", "a", "b", (F.col("sa") / F.col("sb") * F.col("push")).alias("flow")))
        flows = flow if flows is None else flows.union(flow)
        now = flow.groupBy("src", F.col("a").alias("id")).agg(F.sum("flow").alias("delta"))
        delta = durable(now if delta is None else delta.union(now))
    return delta, flows


def betweenness(g: Graph, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``id, value``: shortest paths through a node, between ordered pairs of ``sources(id)`` and ``targets(id)``; over all nodes each unordered pair once if undirected."""
    s = (g.nodes if sources is None else sources).select("id").distinct()
    found, top = _search(g, s, False)
    if targets is None:
        hit = F.lit(1.0)
    else:
        found = found.join(targets.select("id", F.lit(1.0).alias("t")).distinct(), "id", "left").select("src", "id", "level", "sigma", F.coalesce("t", F.lit(0.0)).alias("t"))
        hit = F.col("t")
    delta, _ = _dependencies(g, found, top, hit)
    half = 0.5 if sources is None and targets is None and not g.directed else 1.0
    if delta is None:
        return g.nodes.select("id", F.lit(0.0).alias("value"))
    return g.per_node(delta.filter("src != id").groupBy("id").agg((F.sum("delta") * half).alias("value")), "value", 0.0)


def nsi_betweenness(g: Graph, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``id, value``: weight of ordered pairs whose shortest paths pass a node, each path by the product of its inner nodes' weights; undirected graphs only."""
    if g.directed:
        raise ValueError("defined for undirected graphs")
    s = (g.nodes if sources is None else sources).select("id").distinct()
    found, top = _search(g, s, True)
    hit = F.lit(1.0)
    if targets is not None:
        found = found.join(targets.select("id", F.lit(1.0).alias("t")).distinct(), "id", "left").select("src", "id", "level", "sigma", F.coalesce("t", F.lit(0.0)).alias("t"))
        hit = F.col("t")
    delta, _ = _dependencies(g, found, top, hit, True)
    if delta is None:
        return g.nodes.select("id", F.lit(0.0).alias("value"))
    own = g.nodes.select(F.col("id").alias("src"), "w")
    return g.per_node(delta.filter("src != id").join(own, "src").groupBy("id").agg(F.sum(F.col("delta") * F.col("w")).alias("value")), "value", 0.0)


def link_betweenness(g: Graph) -> DataFrame:
    """``src, dst, value``: shortest paths along each link; undirected: both orientations carry the link's value."""
    found, top = _search(g, g.nodes, False)
    _, flows = _dependencies(g, found, top, F.lit(1.0))
    if flows is None:
        return g.edges.select("src", "dst", F.lit(0.0).alias("value"))
    v = flows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("flow").alias("value"))
    out = g.edges.select("src", "dst").join(v, ["src", "dst"], "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))
    if g.directed:
        return out
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("value").alias("b"))
    return out.join(back, ["src", "dst"]).select("src", "dst", ((F.col("value") + F.col("b")) / 2).alias("value"))


# spectral and other iterations -------------------------------------------------------------------


def _iterate(x: DataFrame, step, rounds: int, tolerance: float, chunk: int = 5) -> DataFrame:
    """``x(id, x)`` under ``step`` until no value moves by more than ``tolerance``; a durable table every few rounds. Raises if they don't settle in ``rounds``."""
    x = durable(x)
    for _ in range(0, rounds, chunk):
        y = x
        for _ in range(chunk):
            y = step(y)
        y = durable(y)
        moved = y.join(x.withColumnRenamed("x", "o"), "id").agg(F.max(F.abs(F.col("x") - F.col("o")))).first()[0] or 0.0
        discard(x)
        x = y
        if moved <= tolerance:
            return x
    raise RuntimeError(f"values still move by {moved} after {rounds} rounds")


def pagerank(g: Graph, damping: float = 0.85, attribute: str | None = None, rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """``id, value``, summing to 1; nodes without outgoing links spread evenly."""
    e = g.edges.select("src", "dst", (F.lit(1.0) if attribute is None else F.col(attribute).cast("double")).alias("a"))
    share = durable(e.withColumn("p", F.col("a") / F.sum("a").over(Window.partitionBy("src"))).select(F.col("src").alias("id"), "dst", "p"))
    n = g.nodes.count()
    sinks = g.nodes.join(share.select("id").distinct(), "id", "left_anti").select("id")
    has_sinks = not sinks.isEmpty()

    def step(x: DataFrame) -> DataFrame:
        got = x.join(share, "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("p")).alias("s"))
        out = g.nodes.select("id").join(got, "id", "left")
        lost = F.lit(0.0)
        if has_sinks:
            out = out.crossJoin(F.broadcast(x.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))))  # one row
            lost = F.col("lost")
        return out.select("id", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + lost / n)).alias("x"))

    return _iterate(g.nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x")), step, rounds, tolerance).withColumnRenamed("x", "value")


def eigenvector_centrality(g: Graph, nsi: bool = False, rounds: int = 5000, tolerance: float = 1e-9) -> DataFrame:
    """``id, value``, the largest 1; power iteration on A + I, which has A's leading vector; n.s.i.: on the weighted A+."""
    w = g.nodes.select(F.col("id").alias("dst"), F.sqrt("w").alias("w"))

    def step(x: DataFrame) -> DataFrame:
        v = x.withColumnRenamed("id", "dst")
        if nsi:
            got = g.plus().join(v, "dst").join(w, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("s")).join(w.withColumnRenamed("dst", "id"), "id").select("id", (F.col("s") * F.col("w")).alias("x"))
        else:
            got = g.plus().join(v, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        return got.crossJoin(F.broadcast(got.agg(F.max("x").alias("top")))).select("id", (F.col("x") / F.col("top")).alias("x"))  # one row

    out = _iterate(g.nodes.select("id", F.lit(1.0).alias("x")), step, rounds, tolerance, chunk=2)
    if nsi:
        out = out.join(w.withColumnRenamed("dst", "id"), "id").select("id", (F.col("x") / F.col("w")).alias("x"))
        out = out.crossJoin(F.broadcast(out.agg(F.max("x").alias("top")))).select("id", (F.col("x") / F.col("top")).alias("x"))  # one row
    return out.withColumnRenamed("x", "value")


def coreness(g: Graph) -> DataFrame:
    """``id, value``: the largest k whose k-core has the node, by peeling."""
    left = durable(g.undirected().edges.select("src", "dst") if g.directed else g.edges.select("src", "dst"))
    alive, k, out = durable(g.nodes.select("id")), 0, None
    while not alive.isEmpty():
        k_of = alive.join(left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "id", "left").fillna(0, ["k"])
        weak = durable(k_of.filter(F.col("k") <= k).select("id"))
        if weak.isEmpty():
            k = max(k + 1, k_of.agg(F.min("k")).first()[0])
            continue
        now = weak.select("id", F.lit(k).cast("long").alias("value"))
        out = now if out is None else out.union(now)
        alive = durable(alive.join(weak, "id", "left_anti"))
        left = durable(left.join(weak.withColumnRenamed("id", "src"), "src", "left_anti").join(weak.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return out if out is not None else g.nodes.select("id", F.lit(0).cast("long").alias("value"))


