"""Visibility graphs of time series ``ts(i, t, x)``: states see each other over all between.

A null or NaN value is a missing one: it sees nothing, and nothing sees past it.
With a column ``node`` there are many series, each one task's; an empty series has
no states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import in_one_task, per_group, ratio
from .graph import Graph
from .paths import path_lengths


def _natural(t: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Visible pairs of one series without gaps. Nothing sees past the highest state, so it sees for itself, by running maxima of slopes, and both sides are series of their own."""
    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        m = lo + int(np.argmax(x[lo:hi]))
        for k in (np.arange(m + 1, hi), np.arange(m - 1, lo - 1, -1)):
            if len(k):
                slope = (x[k] - x[m]) / np.abs(t[k] - t[m])
                before = np.concatenate(([-np.inf], np.maximum.accumulate(slope)[:-1]))
                seen = k[slope > before]
                out.append(np.stack([np.full(len(seen), m), seen]))
        todo += [(lo, m), (m + 1, hi)]
    return out


def _horizontal(x: np.ndarray) -> list[np.ndarray]:
    """Visible pairs by a stack of falling values: each state sees those it takes from the stack and the one that stops it."""
    pairs, stack = [], []
    for j, v in enumerate(x.tolist()):
        while stack and x[stack[-1]] < v:
            pairs.append((stack.pop(), j))
        if stack:
            pairs.append((stack[-1], j))
            if x[stack[-1]] == v:
                stack.pop()
        stack.append(j)
    return [np.array(pairs, np.int64).reshape(-1, 2).T]


def visible(ts: DataFrame, horizontal: bool = False, most_rows: int = 20_000_000) -> DataFrame:
    """``src, dst``, both orientations (and ``node``, if given). i sees j if the line between them passes above all values between (horizontal: both are above them); neighbours see each other.

    One task holds one series; a single one of more than ``most_rows`` states raises.
    """

    def see(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        i, t, x = g.i.to_numpy(), g.t.to_numpy(float), g.x.to_numpy(float)
        gap = np.flatnonzero(np.isnan(x))
        found = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip([0, *(gap + 1).tolist()], [*gap.tolist(), len(x)], strict=True):
            found += [lo + p for p in (_horizontal(x[lo:hi]) if horizontal else _natural(t[lo:hi], x[lo:hi]))]
        a, b = np.concatenate(found, axis=1)
        out = pd.DataFrame({"src": i[np.concatenate((a, b))], "dst": i[np.concatenate((b, a))]})
        return out.assign(node=g.node.iloc[0]) if "node" in g.columns else out

    if "node" in ts.columns:
        return per_group(ts.select("node", "i", "t", F.col("x").cast("double").alias("x")), ["node"], see, f"src long, dst long, node {dict(ts.dtypes)['node']}")
    return in_one_task(ts.select("i", "t", F.col("x").cast("double").alias("x")), see, "src long, dst long", most_rows)


def graph(ts: DataFrame, horizontal: bool = False) -> Graph:
    return Graph(ts.select(F.col("i").alias("id"), F.lit(1.0).alias("w")), visible(ts, horizontal), False)


def directional_degree(g: Graph) -> DataFrame:
    """``id, retarded, advanced``: neighbours before and after."""
    got = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum((F.col("dst") < F.col("src")).cast("long")).alias("r"), F.sum((F.col("dst") > F.col("src")).cast("long")).alias("a"))
    return g.nodes.select("id").join(got, "id", "left").select("id", F.coalesce("r", F.lit(0)).alias("retarded"), F.coalesce("a", F.lit(0)).alias("advanced"))


def directional_clustering(g: Graph, side: str) -> DataFrame:
    """``id, value``: share of linked pairs among the neighbours in the past (``retarded``) or future (``advanced``). A state has few neighbours on one side that see each other, so its pairs meet directly."""
    e = g.edges.filter("dst < src" if side == "retarded" else "dst > src").select(F.col("src").alias("id"), F.col("dst").alias("p"))
    links = g.edges.filter("src < dst").select(F.col("src").alias("p"), F.col("dst").alias("q"))
    t = e.join(links, "p").join(e.withColumnRenamed("p", "q"), ["id", "q"], "left_semi").groupBy("id").agg(F.count("*").alias("t"))
    k = e.groupBy("id").agg(F.count("*").alias("k"))
    return g.per_node(k.join(t, "id", "left").select("id", ratio(2 * F.coalesce("t", F.lit(0)), F.col("k") * (F.col("k") - 1)).alias("value")), "value", 0.0)


def _one_side(g: Graph) -> DataFrame:
    """``id, n``: all states, numbered from 0 in order, beside their number."""
    return g.nodes.select("id").crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n"))))  # one row


def directional_closeness(g: Graph, dist: DataFrame, side: str) -> DataFrame:
    """``id, value``: one over the mean path length to all states before (``retarded``) or after; 0 if one of them can't be reached, null where there are none. Ids number the states from 0."""
    d = dist.filter("dst < src" if side == "retarded" else "dst > src").groupBy(F.col("src").alias("id")).agg(F.avg("d").alias("m"), F.count("*").alias("r"))
    all_ = F.col("id") if side == "retarded" else F.col("n") - 1 - F.col("id")
    value = F.when(all_ > 0, F.when(F.coalesce("r", F.lit(0)) == all_, ratio(F.lit(1.0), F.col("m"))).otherwise(0.0))
    return _one_side(g).join(d, "id", "left").select("id", value.alias("value"))


def directional_betweenness(g: Graph, side: str) -> DataFrame:
    """``id, value``: shortest paths through a state between ordered pairs of others, both before it (``retarded``), both after it (``advanced``) or from before to after (``trans``).

    Numbers of shortest paths come from the distances, level by level; a state's pairs
    are the ends of paths that meet at it.
    """
    cond = {"retarded": "s < id and t < id", "advanced": "s > id and t > id", "trans": "s < id and t > id"}[side]
    dist = path_lengths(g)
    paths = _path_counts(g, dist)
    a, b = paths.toDF("s", "id", "da", "na"), paths.toDF("id", "t", "db", "nb")
    met = a.filter("s != id").join(b.filter("id != t"), "id").filter(cond).filter("s != t")
    through = met.join(paths.toDF("s", "t", "d", "n"), ["s", "t"]).filter("da + db = d")
    return g.per_node(through.groupBy("id").agg(F.sum(F.col("na") * F.col("nb") / F.col("n")).alias("value")), "value", 0.0)


def _path_counts(g: Graph, dist: DataFrame) -> DataFrame:
    """``src, dst, d, n``: with the number of shortest paths, by levels."""
    from ..plans.blocks import durable

    longest = int(dist.agg(F.max("d")).first()[0] or 0)
    e = g.edges.select(F.col("src").alias("dst"), F.col("dst").alias("nxt"))
    out = last = durable(dist.filter("d = 0").withColumn("n", F.lit(1.0)))
    for level in range(1, longest + 1):
        step = last.join(e, "dst").groupBy("src", F.col("nxt").alias("dst")).agg(F.sum("n").alias("n"))
        last = durable(step.join(dist.filter(F.col("d") == level), ["src", "dst"]).select("src", "dst", "d", "n"))
        out = out.union(last)
    return out


def boundary_corrected_degree(g: Graph) -> DataFrame:
    """``id, value``: (retarded x states before + advanced x states after) / (N - 1), ids numbered from 0."""
    n = F.broadcast(g.nodes.agg(F.count("*").alias("n")))  # one row
    return directional_degree(g).crossJoin(n).select("id", ratio(F.col("retarded") * F.col("id") + F.col("advanced") * (F.col("n") - 1 - F.col("id")), F.col("n") - 1).alias("value"))


def boundary_corrected_closeness(g: Graph, dist: DataFrame) -> DataFrame:
    """``id, value``: (N - 1) (retarded closeness / states before + advanced closeness / states after); null at both ends."""
    r, a = directional_closeness(g, dist, "retarded").toDF("id", "r"), directional_closeness(g, dist, "advanced").toDF("id", "a")
    before, after = F.nullif(F.col("id"), F.lit(0)), F.nullif(F.col("n") - 1 - F.col("id"), F.lit(0))
    return _one_side(g).join(r, "id").join(a, "id").select("id", ((F.col("n") - 1) * (F.col("r") / before + F.col("a") / after)).alias("value"))
