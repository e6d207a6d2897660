"""Event series ``ev(node, idx, ts)``: thresholding, event synchronization, event coincidence analysis, significance.

Null nodes and times are no events, a repeated event of a node counts once. Rates
whose normaliser is zero are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import durable, ensure_workers, meet, positions, ratio

HOWS = {"ES": ("directed", "symmetric", "antisym", "mean", "max", "min"), "ECA": ("directed", "mean", "max", "min")}


def event_matrix(obs: DataFrame, quantile: float | None = None, value: float | None = None, above: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """``node, t, flag``: 1 where x is strictly beyond the node's quantile (linear interpolation; default the median) or a value; 0 for a null x.

    ``rules(node, method, threshold, above)`` gives each node its own: method
    ``quantile`` or ``value``.
    """
    if rules is not None:
        r = rules.select("node", F.col("method").alias("_m"), F.col("threshold").cast("double").alias("_v"), F.col("above").alias("_up"))
        with_q = obs.join(r.filter("_m = 'quantile'"), "node").groupBy("node", "_v").agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("s"))
        at = F.col("_v") * (F.size("s") - 1)
        low, high = F.get("s", F.floor(at).cast("int")), F.get("s", F.ceil(at).cast("int"))
        limits = with_q.select("node", (low + (high - low) * (at - F.floor(at))).alias("limit"))
        every = r.join(limits, "node", "left").select("node", "_up", F.coalesce("limit", "_v").alias("limit"))
        hit = F.when(F.col("_up"), F.col("x") > F.col("limit")).otherwise(F.col("x") < F.col("limit"))
        return obs.join(every, "node").select("node", "t", F.coalesce(hit, F.lit(False)).cast("int").alias("flag"))
    if value is None:
        limits = obs.groupBy("node").agg(F.percentile("x", F.lit(0.5 if quantile is None else quantile)).alias("limit"))
        obs = obs.join(limits, "node")
    else:
        obs = obs.withColumn("limit", F.lit(float(value)))
    hit = F.col("x") > F.col("limit") if above else F.col("x") < F.col("limit")
    return obs.select("node", "t", F.coalesce(hit, F.lit(False)).cast("int").alias("flag"))


def events_of(matrix: DataFrame) -> DataFrame:
    """``node, idx, ts``: each node's events in order."""
    some = matrix.filter("flag = 1 and node is not null and t is not null").select("node", F.col("t").cast("double").alias("ts")).distinct()
    return some.select("node", F.row_number().over(Window.partitionBy("node").orderBy("ts")).cast("long").alias("idx"), "ts")


def _by(ev: DataFrame) -> list[str]:
    """Events with a column ``surrogate`` are many records in one table: only events of one surrogate meet, and results have that column too."""
    return ["surrogate"] if "surrogate" in ev.columns else []


def _pairs_of_nodes(sizes: DataFrame, by: list[str]) -> DataFrame:
    """``i, j, ni, nj`` of ordered pairs of different nodes: the result's own table, met in blocks (or for each surrogate)."""
    if by:
        return sizes.select(*by, F.col("node").alias("i"), F.col("n").alias("ni")).join(sizes.select(*by, F.col("node").alias("j"), F.col("n").alias("nj")), by).filter("i != j")
    return meet(sizes.select(F.col("node").alias("i"), F.col("n").alias("ni")), "i", sizes.select(F.col("node").alias("j"), F.col("n").alias("nj")), "j").filter("i != j")


def event_synchronization(ev: DataFrame, taumax: float = math.inf, lag: float = 0.0) -> DataFrame:
    """``i, j, value``: events of i shortly after ones of j, directed, over sqrt((l_i - 2)(l_j - 2)).

    A pair counts if its difference is positive and at most half the smallest of the
    four gaps around both (and taumax); simultaneous events count half in both
    directions; a pair of which an event also counts the other way round loses half
    (double counting). First and last events have no gap and take no part. Of two
    nodes the events of the larger one are moved by ``lag``. 0 with one or two
    events; nodes without events have no rows.

    Events meet at the scale of the smaller of their own gaps, in cells of that
    width, so that one long pause doesn't make everything meet.
    """
    by = _by(ev)
    w = Window.partitionBy(*by, "node").orderBy("ts")
    gaps = ev.withColumns({"before": F.col("ts") - F.lag("ts").over(w), "after": F.lead("ts").over(w) - F.col("ts")}).filter("before is not null and after is not null")
    half = F.least(F.least("before", "after") / 2, F.lit(float(taumax)))
    gaps = gaps.select(*by, "node", "ts", half.alias("half")).withColumn("level", F.ceil(F.log2(F.greatest("half", F.lit(1e-12)))).cast("int"))
    gaps = durable(gaps, "gaps")
    levels = [r.level for r in gaps.select("level").distinct().collect()]  # powers of two: a few hundred at most
    sizes = ev.groupBy(*by, "node").agg(F.count("*").alias("n"))
    every = _pairs_of_nodes(sizes, by)
    norm = F.sqrt(((F.col("ni") - 2) * (F.col("nj") - 2)).cast("double"))
    value = lambda c: F.when((F.col("ni") > 2) & (F.col("nj") > 2), ratio(F.coalesce(c, F.lit(0.0)), norm)).otherwise(0.0)
    if not levels:
        return every.select(*by, "i", "j", F.lit(0.0).alias("value"))
    # the event with the smaller scale looks into its own and both neighbouring cells at that scale
    width = F.pow(F.lit(2.0), F.col("at"))
    # lag moves the larger node's events: both kinds of shift meet, the right ones stay
    shifts = [0.0] if lag == 0 else [-lag, lag]
    small = gaps.select(*by, F.col("node").alias("a"), F.col("ts").alias("ta"), F.col("half").alias("ha"), F.col("level").alias("at"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    small = small.withColumn("cell", F.explode(F.array(*[F.floor((F.col("ta") + F.col("shift")) / width) + k for k in (-1, 0, 1)])))
    large = gaps.select(*by, F.col("node").alias("b"), F.col("ts").alias("tb"), F.col("half").alias("hb"), F.col("level").alias("lb"), F.explode(F.filter(F.array(*[F.lit(x) for x in sorted(levels)]), lambda x: x <= F.col("level"))).alias("at"))
    large = large.withColumn("cell", F.floor(F.col("tb") / width))
    met = small.join(large, [*by, "at", "cell"]).filter("a != b and (lb > at or a < b)")
    x_first = F.col("a") < F.col("b")
    if lag:
        # a's events are moved by `shift`: +lag if a is the larger node, as -lag if b's would be
        met = met.filter(F.when(x_first, F.col("shift") == -lag).otherwise(F.col("shift") == lag))
    tx, ty = F.when(x_first, F.col("ta")).otherwise(F.col("tb")), F.when(x_first, F.col("tb")).otherwise(F.col("ta"))
    pair = met.select(*by, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), tx.alias("tx"), (ty + lag).alias("ty"), F.least("ha", "hb").alias("lim"))
    delta = F.col("tx") - F.col("ty")
    pair = pair.withColumn("d", delta).filter(F.abs("d") <= F.col("lim")).withColumns({"xy": F.col("d") > 0, "yx": F.col("d") < 0})
    own, other = Window.partitionBy(*by, "x", "y", "tx"), Window.partitionBy(*by, "x", "y", "ty")
    any_ = lambda c: F.max(c).over(own) | F.max(c).over(other)
    pair = pair.withColumns({"any_yx": any_("yx"), "any_xy": any_("xy")})
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    sums = pair.groupBy(*by, "x", "y").agg(
        F.sum(one(F.col("xy")) + 0.5 * one(F.col("d") == 0) - 0.5 * one(F.col("xy") & F.col("any_yx"))).alias("cxy"),
        F.sum(one(F.col("yx")) + 0.5 * one(F.col("d") == 0) - 0.5 * one(F.col("yx") & F.col("any_xy"))).alias("cyx"),
    )
    both = sums.select(*by, F.col("x").alias("i"), F.col("y").alias("j"), F.col("cxy").alias("c")).union(sums.select(*by, "y", "x", "cyx"))
    return every.join(both, [*by, "i", "j"], "left").select(*by, "i", "j", value(F.col("c")).alias("value"))


def _near(a: DataFrame, b: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """Events of different nodes within ``reach``: cells of that width, each event of b in its own and both neighbours."""
    left = a.withColumn("cell", F.floor(F.col("ts_x") / reach))
    right = b.withColumn("cell", F.explode(F.array(*[F.floor(F.col("ts_y") / reach) + k for k in (-1, 0, 1)])))
    return left.join(right, [*by, "cell"]).filter("i != j").drop("cell")


def _coincidences(ev: DataFrame, taumax: float, lag: float, symmetric: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of events ``i, j, ts_x, ts_y`` with ts_x - ts_y - lag in [0, taumax] (symmetric: [-taumax, taumax]), and each node's ``first, last, n``. Bounds of windows are inclusive."""
    if not math.isfinite(taumax):
        raise ValueError("taumax must be finite")
    by = _by(ev)
    a = ev.select(*by, F.col("node").alias("i"), F.col("ts").alias("ts_x"))
    b = ev.select(*by, F.col("node").alias("j"), F.col("ts").alias("ts_0"), (F.col("ts") + lag).alias("ts_y"))
    d = F.col("ts_x") - F.col("ts_0") - lag
    low = -taumax if symmetric else 0.0
    near = _near(a, b, max(taumax, 1e-9), by).filter((d >= low) & (d <= taumax)).select(*by, "i", "j", "ts_x", F.col("ts_0").alias("ts_y"))
    return near, ev.groupBy(*by, "node").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def coincidence_rate(ev: DataFrame, taumax: float, window: str = "symmetric", lag: float = 0.0) -> DataFrame:
    """``i, j, value``: event coincidence rate of i and j.

    ``advanced``: share of i's events with one of j at most taumax before (after the
    lag), ``retarded``: share of j's events with one of i at most taumax after,
    ``symmetric``: share of i's events with one of j within taumax on either side.
    Events whose window leaves the node's own record don't count: those up to
    first + lag + taumax (advanced, symmetric) and from last - lag - taumax on
    (retarded, symmetric), unless lag and taumax are both 0. Null if none is left.
    """
    if window not in ("advanced", "retarded", "symmetric"):
        raise ValueError("window must be 'advanced', 'retarded' or 'symmetric'")
    by = _by(ev)
    near, span = _coincidences(ev, taumax, lag, window == "symmetric")
    owner, ts = ("j", "ts_y") if window == "retarded" else ("i", "ts_x")
    none = lag == 0 and taumax == 0
    start, end = F.col("first") + lag + taumax, F.col("last") - lag - taumax
    keep: Callable[[str], Column] = lambda t: F.lit(True) if none else {"advanced": F.col(t) > start, "retarded": F.col(t) < end, "symmetric": (F.col(t) > start) & (F.col(t) < end)}[window]
    cut = F.lit(False) if none else {"advanced": F.col("ts") <= start, "retarded": F.col("ts") >= end, "symmetric": F.lit(False)}[window]
    left = ev.join(span, [*by, "node"])
    if window == "symmetric" and not none:  # each end counts on its own, so a short record may count below zero
        left = left.groupBy(*by, "node").agg((F.count("*") - F.sum((F.col("ts") <= start).cast("long")) - F.sum((F.col("ts") >= end).cast("long"))).alias("left"))
    else:
        left = left.groupBy(*by, "node").agg(F.sum((~cut).cast("long")).alias("left"))
    hits = near.join(span.withColumnRenamed("node", owner), [*by, owner]).filter(keep(ts)).groupBy(*by, "i", "j").agg(F.countDistinct(ts).alias("c"))
    every = _pairs_of_nodes(span.select(*by, "node", "n"), by).join(left.withColumnRenamed("node", owner), [*by, owner])
    return every.join(hits, [*by, "i", "j"], "left").select(*by, "i", "j", ratio(F.coalesce("c", F.lit(0)), F.col("left"), None).alias("value"))


def event_coincidence(ev: DataFrame, taumax: float, lag: float = 0.0) -> DataFrame:
    """``i, j, precursor, trigger``: :func:`coincidence_rate` of the advanced and the retarded window."""
    p = coincidence_rate(ev, taumax, "advanced", lag).withColumnRenamed("value", "precursor")
    return p.join(coincidence_rate(ev, taumax, "retarded", lag).withColumnRenamed("value", "trigger"), ["i", "j"])


def symmetrize(m: DataFrame, how: str) -> DataFrame:
    """``i, j, value``: ``directed``, ``symmetric`` (a + b), ``antisym`` (a - b), ``mean``, ``max`` or ``min`` of both orientations."""
    if how == "directed":
        return m
    by = _by(m)
    back = m.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("b"))
    a, b = F.col("value"), F.col("b")
    v = {"symmetric": a + b, "antisym": a - b, "mean": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[how]
    return m.join(back, [*by, "i", "j"]).select(*by, "i", "j", v.alias("value"))


def analysis(ev: DataFrame, method: str = "ES", how: str = "directed", window: str = "symmetric", taumax: float = math.inf, lag: float = 0.0) -> DataFrame:
    """``i, j, value``: event synchronization (``ES``) or coincidence (``ECA``), symmetrised."""
    if method not in HOWS or how not in HOWS[method]:
        raise ValueError(f"method must be ES or ECA, and symmetrisation of ES one of {HOWS['ES']}, of ECA one of {HOWS['ECA']}")
    return symmetrize(event_synchronization(ev, taumax, lag) if method == "ES" else coincidence_rate(ev, taumax, window, lag), how)


def shuffled_events(ev: DataFrame, times: DataFrame, n_surrogates: int, seed: int = 1, by_index: bool = False) -> DataFrame:
    """``surrogate, node, idx, ts``: each node's number of events at random distinct ones of the record's ``times(t)``, for every surrogate; ``by_index``: ts is the place among the times, not the time.

    A task draws places among the sorted times for one surrogate and node; the places
    are then joined to the times.
    """
    spark = ev.sparkSession
    ensure_workers(spark)
    n = ev.groupBy("node").agg(F.count("*").alias("n"))
    moments = times.filter("t is not null").select(F.col("t").cast("double").alias("ts")).distinct()
    placed = durable(positions(moments, ["ts"], "place"), "times")
    total = placed.count()
    kind = dict(n.dtypes)["node"]

    def draw(frames):
        for f in frames:
            rows = [(s, v, np.sort(np.random.default_rng([seed, s, *str(v).encode()]).choice(total, min(k, total), replace=False))) for s, v, k in zip(f.surrogate, f.node, f.n, strict=True)]
            yield pd.DataFrame({"surrogate": [r[0] for r in rows], "node": [r[1] for r in rows], "place": [r[2].tolist() for r in rows]})

    drawn = n.select(F.explode(F.sequence(F.lit(1), F.lit(n_surrogates))).alias("surrogate"), "node", "n").mapInPandas(draw, f"surrogate int, node {kind}, place array<long>")
    at = drawn.select("surrogate", "node", F.posexplode("place").alias("idx", "place"))
    if by_index:
        return at.select("surrogate", "node", (F.col("idx") + 1).cast("long").alias("idx"), F.col("place").cast("double").alias("ts"))
    return at.join(placed, "place").select("surrogate", "node", (F.col("idx") + 1).cast("long").alias("idx"), "ts")


def significance(observed: DataFrame, surrogates: DataFrame) -> DataFrame:
    """``i, j, level``: share of surrogate values ``(surrogate, i, j, value)`` below the observed one (null values aren't below)."""
    o = observed.withColumnRenamed("value", "o")
    return surrogates.join(o, ["i", "j"]).groupBy("i", "j").agg(F.avg(F.coalesce((F.col("value") < F.col("o")).cast("double"), F.lit(0.0))).alias("level"))


def shuffle_significance(ev: DataFrame, times: DataFrame, method: str = "ES", how: str = "directed", window: str = "symmetric", taumax: float = math.inf, lag: float = 0.0, n_surrogates: int = 1000, seed: int = 1, by_index: bool = False) -> DataFrame:
    """``i, j, level``: share of the surrogates (:func:`shuffled_events`) whose measure is below the observed one. All surrogates go through one analysis, keyed by their number. The established results measure surrogates with places for times (``by_index``)."""
    shuffled = durable(shuffled_events(ev, times, n_surrogates, seed, by_index), "surrogates")
    return significance(analysis(ev, method, how, window, taumax, lag), analysis(shuffled, method, how, window, taumax, lag))


def analytic_significance(ev: DataFrame, last: float, taumax: float, window: str = "advanced", lag: float = 0.0) -> DataFrame:
    """``i, j, level`` of coincidence rates under independent Poisson processes: 1 less the binomial probability of as many coincidences or more.

    ``last`` is the record's last time. ``advanced``: of l_i events, each coinciding
    with probability 1 - (1 - p)^l_j, p = taumax / (last - lag); ``retarded``: of l_j,
    with l_i, the sum leaving out the last term (all events), as established.
    """
    if window not in ("advanced", "retarded"):
        raise ValueError("window must be 'advanced' or 'retarded'")
    ensure_workers(ev.sparkSession)
    rates = coincidence_rate(ev, taumax, window, lag)
    n = ev.groupBy("node").agg(F.count("*").alias("n"))
    m = rates.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    p = taumax / (last - lag)
    kind = dict(m.dtypes)["i"]

    def tail(frames):
        for f in frames:
            out = []
            for rate, a, b in zip(f.value, f.ni, f.nj, strict=True):
                trials, others = (a, b) if window == "advanced" else (b, a)
                q = 1.0 - (1.0 - p) ** others
                if rate is None or math.isnan(rate):
                    out.append(None)
                    continue
                k = np.arange(int(rate * trials + 1e-9), trials + (window == "advanced"))
                if q <= 0 or q >= 1:
                    mass = (k == (0 if q <= 0 else trials)).sum()
                else:
                    logs = np.array([math.lgamma(trials + 1) - math.lgamma(x + 1) - math.lgamma(trials - x + 1) for x in k.tolist()])
                    mass = np.exp(logs + k * math.log(q) + (trials - k) * math.log1p(-q)).sum()
                out.append(1.0 - float(mass))
            yield pd.DataFrame({"i": f.i, "j": f.j, "level": pd.Series(out, dtype="float64")})

    return m.mapInPandas(tail, f"i {kind}, j {kind}, level double")
