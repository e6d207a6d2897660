"""Recurrence plots as sparse pairs, their line statistics, cross and joint forms, and networks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import entropy
from ..plans.blocks import ensure_workers, in_one_task, length_distribution, meet, order_statistic, ratio, run_lengths
from .graph import Graph

EPS = 1e-8


def embed(ts: DataFrame, dim: int, tau: int) -> DataFrame:
    """``i, v`` from ``ts(i, x)`` with consecutive numbers i: delay vectors (x_i, x_i+tau, ...); the last (dim - 1) tau points have none. With a column ``node``, per node.

    Each value is sent to the vectors that hold it, so no task sees a whole series. A
    null value stays in its vectors as null (a missing value, see
    :func:`missing_states`).
    """
    by = ["node"] if "node" in ts.columns else []
    if dim == 1:
        return ts.select(*by, "i", F.array(F.col("x").cast("double")).alias("v"))
    sent = ts.select(*by, F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("k"), "i", F.col("x").cast("double").alias("x")).select(*by, (F.col("i") - F.col("k") * tau).alias("i"), "k", "x")
    got = sent.groupBy(*by, "i").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s")).filter(F.size("s") == dim)
    return got.select(*by, "i", F.transform("s", lambda r: r["x"]).alias("v"))


def missing_states(emb: DataFrame) -> DataFrame:
    """``i`` of the states with a null or NaN component."""
    return emb.filter(F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("i")


def legendre(ts: DataFrame, dim: int = 3, p: int | None = None, tau_w: float | None = None, rounds: int = 5) -> DataFrame:
    """``i, v``: phase-space coordinates of ``ts(i, t, x)`` (consecutive i) by orthogonal polynomial filters over p points before and after: estimates of the 0th to (dim - 1)th derivatives.

    ``p`` None: by the window width ``tau_w``, the smallest p whose windows are on
    average as long, at most a quarter of the series; ``tau_w`` None: estimated in
    ``rounds`` rounds from sqrt(3 var(x) / mean(x'^2)). Each window is one row's array;
    a window's filter is computed where the row is.
    """
    spark = ts.sparkSession
    ensure_workers(spark)
    n, lo, hi, var = ts.agg(F.count("*"), F.min("t").cast("double"), F.max("t").cast("double"), F.var_pop("x")).first()
    if p is None:

        def width(tau: float) -> int:
            out = 1
            # mean length of the windows of 2 out + 1 steps: the ends telescope
            while out < n / 4:
                m = 2 * out + 1
                ends = ts.filter((F.col("i") >= F.lit(first + n - m)) | (F.col("i") < F.lit(first + m))).agg(F.sum(F.when(F.col("i") >= first + n - m, F.col("t"))).alias("b"), F.sum(F.when(F.col("i") < first + m, F.col("t"))).alias("a")).first()
                if n <= m or (ends.b - ends.a) / (n - m) >= tau:
                    break
                out += 1
            return out

        first = ts.agg(F.min("i")).first()[0]
        if tau_w is None:
            tau_w = 4 * (hi - lo) / (n - 1)
            for _ in range(rounds):
                slope = legendre(ts, 2, width(tau_w)).agg(F.avg(F.get("v", F.lit(1)) ** 2)).first()[0]
                tau_w = math.sqrt(3 * var / slope) if slope else tau_w
        p = width(tau_w)
    m = 2 * p + 1
    sent = ts.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k"), "i", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"))
    windows = sent.groupBy((F.col("i") - F.col("k")).alias("i")).agg(F.sort_array(F.collect_list(F.struct("k", "t", "x"))).alias("s")).filter(F.size("s") == m).select("i", F.col("s.t").alias("t"), F.col("s.x").alias("x"))

    def fit(frames):
        for f in frames:
            if not len(f):
                continue
            t, x = np.stack(f.t.to_numpy()), np.stack(f.x.to_numpy())
            dt = t - t[:, p : p + 1]
            basis: list[np.ndarray] = []
            for j in range(dim):
                power = dt**j
                r = power - sum(((power * b).sum(1, keepdims=True) * b for b in basis), np.zeros_like(power))
                basis.append(r / np.sqrt((r * r).sum(1, keepdims=True)))
            cols = [(b * x).sum(1) * math.factorial(j) / (b * dt**j).sum(1) for j, b in enumerate(basis)]
            yield pd.DataFrame({"i": f.i, "v": np.stack(cols, axis=1).tolist()})

    return windows.mapInPandas(fit, "i long, v array<double>")


def distance(a: str, b: str, metric: str, dim: int | None = None) -> Column:
    """Of two array columns: ``supremum``, ``manhattan`` or ``euclidean``. Up to 16 components (``dim``, if known) are written out, so that generated code computes them."""
    if dim and dim <= 16:
        parts = [F.abs(F.get(a, F.lit(k)) - F.get(b, F.lit(k))) for k in range(dim)]
        if metric == "supremum":
            return F.greatest(*parts) if dim > 1 else parts[0]
        if metric == "manhattan":
            return reduce(lambda s, x: s + x, parts)
        return F.sqrt(reduce(lambda s, x: s + x, [x * x for x in parts]))
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "supremum":
        return F.array_max(d)
    if metric == "manhattan":
        return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def pair_distances(x: DataFrame, y: DataFrame, metric: str = "supremum", blocks: int | None = None) -> DataFrame:
    """``i, j, d`` of all pairs: the distance matrix itself is the result; null where a component is missing."""
    pairs = meet(x.select("i", F.col("v").alias("a")), "i", y.select(F.col("i").alias("j"), F.col("v").alias("b")), "j", blocks)
    dim = max((r.n or 0 for v in (x, y) for r in v.agg(F.max(F.size("v")).alias("n")).collect()), default=0)  # a row each
    return pairs.select("i", "j", distance("a", "b", metric, dim).alias("d"))


def recurrences(x: DataFrame, threshold: float, metric: str = "supremum", y: DataFrame | None = None) -> DataFrame:
    """``i, j`` closer than the threshold. Only points in the same or neighbouring cells of width ``threshold`` of the two components of the widest range meet, so a constant component doesn't put all in one cell; large cells are joined by sort-merge, which splits them. States with missing values and thresholds of 0 or less give no pairs."""
    y = x if y is None else y
    whole = lambda df: df.filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    x, y = whole(x), whole(y)
    if threshold <= 0:
        return x.select("i", F.col("i").alias("j")).limit(0)
    ranges = x.select(F.posexplode("v").alias("k", "c")).groupBy("k").agg((F.max("c") - F.min("c")).alias("r")).collect()  # a row for each component
    wide = [r.k for r in sorted(ranges, key=lambda r: (-r.r, r.k)) if r.r >= threshold][:2] or [0]
    cell = lambda c, k: F.floor(F.get(c, F.lit(k)) / threshold)
    a = x.select("i", F.col("v").alias("a"))
    b = y.select(F.col("i").alias("j"), F.col("v").alias("b"))
    for n, k in enumerate(wide):
        a = a.withColumn(f"_c{n}", F.explode(F.array(cell("a", k) - 1, cell("a", k), cell("a", k) + 1)))
        b = b.withColumn(f"_c{n}", cell("b", k))
    return a.join(b.hint("merge"), [f"_c{n}" for n in range(len(wide))]).filter(distance("a", "b", metric, len(ranges)) < threshold).select("i", "j")


def threshold_of_std(x: DataFrame, factor: float) -> DataFrame:
    """One row ``threshold``: a factor times the standard deviation over all components."""
    return x.select(F.explode("v").alias("c")).agg((F.stddev_pop("c") * factor).alias("threshold"))


def threshold_of_rate(d: DataFrame, rate: float) -> DataFrame:
    """One row ``threshold``: the distance at place int(rate (n - 1)) of all n sorted ones, by histogram refinement; no row without distances."""
    t = order_statistic(d, "d", lambda n: int(rate * (n - 1)))
    return d.sparkSession.createDataFrame([] if t is None else [(t,)], "threshold double")


def by_rate(x: DataFrame, rate: float, metric: str = "supremum", y: DataFrame | None = None) -> DataFrame:
    """``i, j`` at the threshold whose recurrence rate is ``rate``."""
    t = threshold_of_rate(pair_distances(x, x if y is None else y, metric), rate).first()
    return recurrences(x, t[0] if t else 0.0, metric, y)


def by_std(x: DataFrame, factor: float, metric: str = "supremum") -> DataFrame:
    """``i, j`` at a threshold of ``factor`` standard deviations of all components."""
    return recurrences(x, threshold_of_std(x, factor).first()[0] or 0.0, metric)


def below(d: DataFrame, threshold: DataFrame) -> DataFrame:
    return d.crossJoin(F.broadcast(threshold)).filter("d < threshold").select("i", "j")  # one row


def fixed_local_rate(d: DataFrame, rate: float) -> DataFrame:
    """``i, j`` with j closer to i than the distance at place int(rate (N - 1)) of i's sorted ones."""
    w = Window.partitionBy("i")
    r = d.withColumns({"r": F.row_number().over(w.orderBy("d", "j")) - 1, "place": F.floor(rate * (F.count("*").over(w) - 1))})
    limit = F.max(F.when(F.col("r") == F.col("place"), F.col("d"))).over(w)
    return r.withColumn("limit", limit).filter("d < limit").select("i", "j")


def recurrence_rate(rp: DataFrame, n: int, m: int | None = None) -> DataFrame:
    return rp.agg(F.count("*").alias("c")).select(ratio(F.col("c"), F.lit(n * (m or n))).alias("value"))


def recurrence_probability(rp: DataFrame, n: int, lag: int) -> DataFrame:
    return rp.filter(F.col("j") - F.col("i") == lag).agg(F.count("*").alias("c")).select(ratio(F.col("c"), F.lit(n - lag)).alias("value"))


def diagonal_lines(rp: DataFrame, missing: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """``len, cnt``, both triangles; without the main diagonal. With ``missing(i)`` (and all states ``points(i)``) lines that touch a state with missing values don't count."""
    if missing is not None:
        upper = rp.filter("j > i").select((F.col("j") - F.col("i")).alias("line"), "i")
        # the cells of a missing state: one on each diagonal, as row and as column
        cells = meet(missing.select(F.col("i").alias("m")), "m", points.select(F.col("i").alias("p")), "p").select(F.abs(F.col("m") - F.col("p")).alias("line"), F.least("m", "p").alias("i")).filter("line > 0").distinct()
        return length_distribution(_clear_of(upper, "line", "i", cells), 2)
    upper = rp.filter("j > i").select((F.col("j") - F.col("i")).alias("line"), "i")
    return length_distribution(run_lengths(upper, ["line"], "i"), 2)


def _clear_of(lines: DataFrame, line: str, at: str, cut: DataFrame) -> DataFrame:
    """Runs ``line, at`` of consecutive points without those whose first or last point is next to a cell of ``cut(line, at)`` on the same line."""
    w = Window.partitionBy(line).orderBy(at)
    run = lines.withColumn("_g", F.col(at) - F.row_number().over(w)).groupBy(line, "_g").agg(F.count("*").alias("len"), F.min(at).alias("a"), F.max(at).alias("b"))
    for c, d in (("a", -1), ("b", 1)):
        run = run.join(cut.select(F.col(line), (F.col(at) - d).alias(c)), [line, c], "left_anti")
    return run.select("len")


def vertical_lines(rp: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """``len, cnt``; with ``missing(i)`` lines that touch a state with missing values don't count."""
    if missing is not None:
        rows = rp.select("i").distinct()
        cells = meet(rows, "i", missing.select(F.col("i").alias("j")), "j")
        return length_distribution(_clear_of(rp.select("i", "j"), "i", "j", cells))
    return length_distribution(run_lengths(rp.select("i", "j"), ["i"], "j"))


def white_lines(rp: DataFrame, points: DataFrame) -> DataFrame:
    """``len, cnt`` of the gaps between recurrences of a row, those at its ends included; ``points(i)`` are all states."""
    ends = points.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    stops = rp.select("i", "j").union(points.crossJoin(F.broadcast(ends)).select("i", F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("j")))  # one row
    gap = F.lead("j").over(Window.partitionBy("i").orderBy("j")) - F.col("j") - 1
    return length_distribution(stops.select(gap.alias("len")).filter("len > 0"))


def line_measures(dist: DataFrame, least: int = 2) -> DataFrame:
    """One row: ``share`` of points on lines of ``least`` or more, ``mean`` length, ``longest``, ``entropy``."""
    long = F.col("len") >= least
    return dist.agg(
        (F.sum(F.when(long, F.col("len") * F.col("cnt")).otherwise(0)) / (F.sum(F.col("len") * F.col("cnt")) + EPS)).alias("share"),
        (F.sum(F.when(long, F.col("len") * F.col("cnt")).otherwise(0)) / (F.sum(F.when(long, F.col("cnt")).otherwise(0)) + EPS)).alias("mean"),
        F.max("len").alias("longest"),
        F.coalesce(entropy(F.when(long, F.col("cnt"))), F.lit(0.0)).alias("entropy"),
    )


def rqa_summary(rp: DataFrame, n: int, l_min: int = 2, v_min: int = 2) -> DataFrame:
    """One row: ``rr, det, l, lam``."""
    d = line_measures(diagonal_lines(rp), l_min).select(F.col("share").alias("det"), F.col("mean").alias("l"))
    v = line_measures(vertical_lines(rp), v_min).select(F.col("share").alias("lam"))
    return recurrence_rate(rp, n).withColumnRenamed("value", "rr").crossJoin(F.broadcast(d)).crossJoin(F.broadcast(v))  # one row each


def cross_balance(crp: DataFrame) -> DataFrame:
    u, lo = F.sum((F.col("j") > F.col("i")).cast("long")), F.sum((F.col("j") < F.col("i")).cast("long"))
    return crp.agg(ratio(u - lo, u + lo).alias("value"))


def joint(rp_x: DataFrame, rp_y: DataFrame, lag: int = 0) -> DataFrame:
    """``i, j`` that recur in both, y's ``lag`` later."""
    y = rp_y.select((F.col("i") - lag).alias("i"), (F.col("j") - lag).alias("j"))
    return rp_x.join(y, ["i", "j"], "left_semi")


def network(rp: DataFrame, points: DataFrame, directed: bool = False) -> Graph:
    """The recurrence network: states ``points(i)`` linked by recurrence, without loops; directed for a fixed local rate. States with missing values are left out by leaving them out of ``points``."""
    e = rp.filter("i != j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return Graph(points.select(F.col("i").alias("id"), F.lit(1.0).alias("w")), e, directed)


def system_offset(x: DataFrame) -> int:
    """Where the second system's numbers start: one more than the first's largest."""
    return int(x.agg(F.max("i")).first()[0] or 0) + 1


def inter_system_network(x: DataFrame, y: DataFrame, rp_x: DataFrame, rp_y: DataFrame, crp: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph of both systems' states, and each one's group ``(id)`` for the measures between groups."""
    at = system_offset(x)
    a, b = x.select(F.col("i").alias("id")), y.select((F.col("i") + at).alias("id"))
    return Graph(a.union(b).withColumn("w", F.lit(1.0)), inter_system(rp_x, rp_y, crp, at), False), a, b


def inter_system(rp_x: DataFrame, rp_y: DataFrame, crp: DataFrame, offset: int) -> DataFrame:
    """``src, dst``: both systems' recurrences and the cross ones, y's states numbered from ``offset``."""
    y = rp_y.select((F.col("i") + offset).alias("i"), (F.col("j") + offset).alias("j"))
    c = crp.select("i", (F.col("j") + offset).alias("j"))
    return rp_x.select("i", "j").union(y).union(c).union(c.select(F.col("j").alias("i"), F.col("i").alias("j"))).filter("i != j").toDF("src", "dst")


def single_scale_dimension(clustering: DataFrame) -> DataFrame:
    """ln(value) / ln(3/4) of a transitivity or local clustering; null where it is 0."""
    return clustering.withColumn("value", F.when(F.col("value") > 0, F.log("value") / F.log(F.lit(0.75))))


def twins(rp: DataFrame, min_dist: int = 7) -> DataFrame:
    """``i, j``: states with the same, nonempty neighbourhood at least ``min_dist`` apart. Neighbourhoods are equal if their sizes and two 64-bit sums of hashes are."""
    sig = rp.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.xxhash64("j").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(9), "j").cast("decimal(38,0)")).alias("h2"))
    a, b = sig.toDF("i", "n", "h", "h2"), sig.toDF("j", "n", "h", "h2")
    return a.join(b, ["n", "h", "h2"]).filter(F.abs(F.col("i") - F.col("j")) > min_dist).select("i", "j")


def ordinal_patterns(emb: DataFrame) -> DataFrame:
    """``pattern, n``: order of the components of each delay vector, ties by position."""
    indexed = F.transform("v", lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return emb.groupBy(F.transform(F.array_sort(indexed), lambda s: s["k"]).alias("pattern")).agg(F.count("*").alias("n"))


def permutation_entropy(emb: DataFrame, dim: int, normalize: bool = True) -> DataFrame:
    top = math.log(math.factorial(dim)) if normalize else math.log(2)
    return ordinal_patterns(emb).agg((entropy(F.col("n")) / top).alias("value"))


def complexity_entropy(emb: DataFrame, dim: int) -> DataFrame:
    """One row: normalised permutation entropy times the Jensen-Shannon divergence from the uniform distribution over its largest value."""
    n = math.factorial(dim)
    u = 1 / n
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    mix = (F.col("p") + u) / 2
    s = ordinal_patterns(emb).withColumn("p", p).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.sum(-mix * F.log2(mix)).alias("m"), F.count("*").alias("seen"))
    rest = (F.lit(n) - F.col("seen")) * (-(u / 2) * math.log2(u / 2))
    top = -0.5 * ((n + 1) / n * math.log2(n + 1) - 2 * math.log2(2 * n) + math.log2(n))
    return s.select((F.col("h") / math.log2(n) * (F.col("m") + rest - F.col("h") / 2 - math.log2(n) / 2) / top).alias("value"))


def fixed_neighbors(d: DataFrame, k: int) -> DataFrame:
    """``i, j``: each state's ``k`` nearest others (ties by number), made symmetric."""
    near = d.filter("i != j").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("r") <= k).select("i", "j")
    return near.union(near.select("j", "i")).distinct()


def adaptive_neighbors(d: DataFrame, k: int, order: list[int] | None = None, most_rows: int = 20_000_000) -> DataFrame:
    """``i, j`` by the adaptive neighbourhood algorithm: in each of ``k`` rounds every state, in ``order`` (default: by number), is linked with its nearest state that isn't linked with it yet, from the round's place among its sorted distances on (place 0 is itself; ties by number).

    Each link changes what later states choose, so the rounds run in one task, over
    each state's nearest ones; raises if the distances have more than ``most_rows`` rows.
    """

    def grow(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["i", "d", "j"], kind="stable")
        near = {i: g.j.to_numpy() for i, g in x.groupby("i")}
        linked: dict = {i: set() for i in near}
        for r in range(k):
            for i in order if order is not None else sorted(near):
                at = r + 1
                while at < len(near[i]) and near[i][at] in linked[i]:
                    at += 1
                if at < len(near[i]):
                    j = near[i][at]
                    linked[i].add(j)
                    linked[j].add(i)
        rows = [(i, j) for i, s in linked.items() for j in sorted(s)]
        return pd.DataFrame(rows, columns=["i", "j"])

    return in_one_task(d.filter("d is not null").select("i", "j", "d"), grow, "i long, j long", most_rows)


def bootstrap_distances(x: DataFrame, n: int, metric: str = "supremum", seed: int = 1) -> DataFrame:
    """``k, d``: distances of ``n`` random pairs of states ``x(i, v)`` numbered from 0."""
    size = x.count()
    pick = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "k"), F.lit(max(size, 1)))
    draws = x.sparkSession.range(n).toDF("k").select("k", pick(1).alias("p"), pick(2).alias("q"))
    a, b = x.select(F.col("i").alias("p"), F.col("v").alias("a")), x.select(F.col("i").alias("q"), F.col("v").alias("b"))
    return draws.join(a, "p").join(b, "q").select("k", distance("a", "b", metric).alias("d"))


def fast_threshold_of_rate(x: DataFrame, rate: float, n: int = 10_000, metric: str = "supremum") -> DataFrame:
    """One row ``threshold``: the rate's quantile of bootstrapped distances."""
    return bootstrap_distances(x, n, metric).agg(F.percentile("d", F.lit(rate)).alias("threshold"))


def resampled_lines(dist: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``len, cnt`` of ``n`` draws from a line distribution, by where hashed uniform numbers fall in its cumulative shares."""
    w = Window.orderBy("len")  # one row for each length
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    bounds = F.broadcast(dist.select("len", (F.sum("cnt").over(w) / total).alias("hi"), ((F.sum("cnt").over(w) - F.col("cnt")) / total).alias("lo")))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    draws = dist.sparkSession.range(n).select(u.alias("u")).groupBy(F.floor(F.col("u") * 65536).alias("cell")).agg(F.count("*").alias("c"), F.min("u").alias("u"))
    return draws.join(bounds, F.expr("u >= lo and u < hi")).groupBy("len").agg(F.sum("c").alias("cnt"))
