"""Registered queries of the network and time-series operators, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climate as K
from ..operators import clustering as C
from ..operators import coupling as Q
from ..operators import dense as N
from ..operators import events as E
from ..operators import graph as G
from ..operators import interacting as I
from ..operators import models as M
from ..operators import paths as P
from ..operators import recurrence as R
from ..operators import series as S
from ..operators import spatial as X
from ..operators import surrogates as U
from ..operators import visibility as V
from ..streaming.events import windowed_counts
from . import derive as D
from .blocks import durable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, make: Query, sql: str | None = None, base: str = "") -> None:
    """Floating results are rounded to six places on both sides."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(spark, sf_dir)
        return out.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in out.dtypes])

    QUERIES[name] = query
    if sql is not None:
        SQL[name] = f"WITH {base}, r AS ({sql}) SELECT * FROM r" if base else sql


def on_trade(name: str, f: Callable, sql: str | None = None, directed: bool = False, more: str = "") -> None:
    add(name, lambda spark, sf: f(D.trade(spark, sf, directed)), sql, D.TRADE + more if sql else "")




def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


# degrees ---------------------------------------------------------------------------------------

on_trade("degree_undirected", G.degree, "SELECT id, k FROM du")
on_trade("degree_out", G.out_degree, "SELECT id, k_out FROM ko", True)
on_trade("degree_in", G.in_degree, "SELECT id, k_in FROM ki", True)
on_trade("degree_directed", G.degree, "SELECT id, k_out + k_in AS k FROM ko JOIN ki USING (id)", True)
on_trade("degree_bilateral", G.bilateral_degree, "SELECT id, count(a.dst) AS k_bil FROM n LEFT JOIN (SELECT d.src, d.dst FROM d JOIN d e ON d.src = e.dst AND d.dst = e.src) a ON a.src = id GROUP BY id", True)
on_trade("degree_weighted", lambda g: G.out_degree(g, "v").withColumnRenamed("k_out", "strength"), f"SELECT id, {r6('coalesce(sum(v), 0)')} AS strength FROM n LEFT JOIN d ON src = id GROUP BY id", True)
on_trade("nsi_degree", G.nsi_degree, f"SELECT id, {r6('k')} AS k FROM ks")
on_trade("nsi_degree_corrected", lambda g: G.nsi_degree(g, 2.0), f"SELECT id, {r6('k / 2.0 - 1')} AS k FROM ks")
on_trade("nsi_degree_out_in", lambda g: G.nsi_out_degree(g).join(G.nsi_in_degree(g), "id"), f"SELECT id, {r6('k_out')} AS k_out, {r6('k_in')} AS k_in FROM (SELECT src AS id, sum(w) AS k_out FROM dp JOIN n ON dst = id GROUP BY src) JOIN (SELECT dst AS id, sum(w) AS k_in FROM dp JOIN n ON src = id GROUP BY dst) USING (id)", True)
on_trade("nsi_degree_bilateral", G.nsi_bilateral_degree, f"SELECT a.src AS id, {r6('sum(w)')} AS k_bil FROM dp a JOIN dp b ON a.src = b.dst AND a.dst = b.src JOIN n ON id = a.dst GROUP BY a.src", True)


def hist_sql(source: str, value: str, bins: str) -> str:
    return f"""SELECT b.bin AS bin, {r6('lo + (hi - lo) * b.bin / bins')} AS lower, count(v) AS n, {r6('count(v) / max(total)')} AS share
FROM (SELECT min(v) AS lo, max(v) AS hi, {bins} AS bins, CAST(count(*) AS DOUBLE) AS total FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source})) e,
LATERAL (SELECT unnest(range(0, CAST(bins AS BIGINT))) AS bin) b
LEFT JOIN (SELECT CAST({value} AS DOUBLE) AS v FROM {source}) x ON least(floor((v - lo) / (hi - lo) * bins), bins - 1) = b.bin
GROUP BY b.bin, lo, hi, bins"""


on_trade("degree_distribution", G.degree_distribution, hist_sql("du", "k", "greatest(max(v), 1)"))
on_trade("degree_distribution_out", lambda g: G.degree_distribution(g, "out"), hist_sql("ko", "k_out", "max(v) + 1"), True)
on_trade("degree_cdf", G.degree_cdf, f"SELECT bin, lower, n, share, {r6('sum(n) OVER (ORDER BY bin DESC) / (SELECT count(*) FROM du)')} AS cdf FROM ({hist_sql('du', 'k', 'greatest(max(v), 1)')})")
on_trade("nsi_degree_histogram", G.nsi_degree_histogram, f"SELECT bin, lower, n, share, {r6('sum(n) OVER (ORDER BY bin DESC) / (SELECT count(*) FROM ks)')} AS cdf FROM ({hist_sql('ks', 'k', 'floor(max(v) / min(v)) + 1')})")
on_trade("neighbor_degrees", G.neighbor_degrees, f"SELECT n.id AS id, {r6('coalesce(avg(b.k), 0)')} AS k_mean, coalesce(max(b.k), 0) AS k_max FROM n LEFT JOIN u ON src = n.id LEFT JOIN du b ON b.id = dst GROUP BY n.id")
on_trade("nsi_neighbor_degrees", G.nsi_neighbor_degrees, f"SELECT src AS id, {r6('sum(n.w * b.k) / max(a.k)')} AS k_mean, {r6('max(b.k)')} AS k_max FROM up JOIN ks a ON a.id = src JOIN ks b ON b.id = dst JOIN n ON n.id = dst GROUP BY src")
on_trade("assortativity", G.assortativity, f"SELECT {r6('corr(a.k, b.k)')} AS r FROM u JOIN du a ON a.id = src JOIN du b ON b.id = dst")
on_trade("link_density", G.link_density, f"SELECT {r6('(SELECT count(*) FROM d) / (count(*) * (count(*) - 1))')} AS link_density FROM n", True)
on_trade("matching_index", G.matching_index, f"SELECT i, j, {r6('c / (a.k + b.k - c)')} AS value FROM (SELECT x.src AS i, y.dst AS j, count(*) AS c FROM u x JOIN u y ON x.dst = y.src GROUP BY 1, 2) JOIN du a ON a.id = i JOIN du b ON b.id = j")
on_trade("nsi_twinness", G.nsi_twinness, f"SELECT i, j, {r6('c / greatest(a.k, b.k)')} AS value FROM (SELECT x.src AS i, y.dst AS j, sum(w) AS c FROM up x JOIN up y ON x.dst = y.src JOIN n ON n.id = x.dst GROUP BY 1, 2) JOIN up z ON z.src = i AND z.dst = j JOIN ks a ON a.id = i JOIN ks b ON b.id = j")
on_trade("laplacian", G.laplacian, "SELECT id AS i, id AS j, CAST(k_out AS DOUBLE) AS value FROM ko UNION ALL SELECT src, dst, -1.0 FROM d", True)
on_trade("nsi_laplacian", G.nsi_laplacian, f"SELECT i, j, {r6('sum(value)')} AS value FROM (SELECT src AS i, dst AS j, -w AS value FROM up JOIN n ON id = dst UNION ALL SELECT id, id, k FROM ks) GROUP BY 1, 2")
on_trade("hamming_distance", lambda g: G.hamming_distance(g, G.Graph(g.nodes, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), True)), f"SELECT {r6('(SELECT count(*) FROM (SELECT src, dst FROM d EXCEPT SELECT dst, src FROM d)) * 2 / (count(*) * (count(*) - 1))')} AS distance FROM n", True)
on_trade("average_link_attribute", lambda g: G.average_link_attribute(g, "v"), f"SELECT id, {r6('coalesce(sum(v), 0) / (SELECT count(*) FROM n)')} AS value FROM n LEFT JOIN d ON src = id GROUP BY id", True)
on_trade("undirected_copy", lambda g: g.undirected().edges.select("src", "dst"), "SELECT src, dst FROM u", True)
on_trade("permuted_copy", lambda g: g.permuted(g.nodes.select(F.col("id").alias("old"), (24 - F.col("id")).alias("new"))).edges.select("src", "dst"), "SELECT 24 - src AS src, 24 - dst AS dst FROM u")
on_trade("splitted_copy_degree", lambda g: G.nsi_degree(g.splitted(3, 99, 0.25)).filter("id != 99"), f"SELECT id, {r6('k')} AS k FROM ks")

# clustering ------------------------------------------------------------------------------------

TRI = "SELECT a.src AS id, count(*) AS t FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src"
NTRI = "SELECT a.src AS id, sum(x.w * y.w) AS t FROM up a JOIN up b ON a.dst = b.src JOIN up c ON c.src = b.dst AND c.dst = a.src JOIN n x ON x.id = a.dst JOIN n y ON y.id = b.dst GROUP BY a.src"
LC = f"SELECT id, coalesce(t / nullif(k * (k - 1), 0), 0) AS value FROM du LEFT JOIN ({TRI}) USING (id)"
on_trade("local_clustering", C.local_clustering, f"SELECT id, {r6('value')} AS value FROM ({LC})")
on_trade("global_clustering", C.global_clustering, f"SELECT {r6('avg(value)')} AS value FROM ({LC})")
on_trade("transitivity", C.transitivity, f"SELECT {r6(f'(SELECT sum(t) FROM ({TRI})) / sum(k * (k - 1))')} AS value FROM du")
K4 = "SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, c.dst AS v3 FROM u a JOIN u b ON b.src = a.src AND b.dst > a.dst JOIN u c ON c.src = a.src AND c.dst > b.dst JOIN u d1 ON d1.src = a.dst AND d1.dst = b.dst JOIN u d2 ON d2.src = a.dst AND d2.dst = c.dst JOIN u d3 ON d3.src = b.dst AND d3.dst = c.dst"
on_trade("cliquishness4", lambda g: C.local_cliquishness(g, 4), f"SELECT id, {r6('coalesce(t / nullif(k * (k - 1) * (k - 2) / 6, 0), 0)')} AS value FROM du LEFT JOIN (SELECT v0 AS id, count(*) AS t FROM ({K4}) GROUP BY 1) USING (id)")
on_trade("cliquishness5", lambda g: C.local_cliquishness(g, 5), f"SELECT id, {r6('coalesce(t / nullif(k * (k - 1) * (k - 2) * (k - 3) / 24, 0), 0)')} AS value FROM du LEFT JOIN (SELECT v0 AS id, count(*) AS t FROM ({K4}) q JOIN u e ON e.src = v0 AND e.dst > v3 JOIN u f ON f.src = v1 AND f.dst = e.dst JOIN u g ON g.src = v2 AND g.dst = e.dst JOIN u h ON h.src = v3 AND h.dst = e.dst GROUP BY 1) USING (id)")
on_trade("higher_order_transitivity4", C.higher_order_transitivity, f"SELECT {r6(f'(SELECT count(*) FROM ({K4})) / sum(k * (k - 1) * (k - 2) / 6)')} AS value FROM du")
_PATTERNS = {"cycle": ("b.src = a.dst", "c.src = b.dst AND c.dst = a.src", "a.src", "a.dst", "b.dst"), "mid": ("b.dst = a.dst", "c.src = b.src AND c.dst = a.src", "a.src", "a.dst", "b.src"), "in": ("b.src = a.src", "c.src = b.dst AND c.dst = a.dst", "a.dst", "a.src", "b.dst"), "out": ("b.src = a.dst", "c.src = a.src AND c.dst = b.dst", "a.src", "a.dst", "b.dst")}
for _m, (_b, _c, _i, _j, _k) in _PATTERNS.items():
    _wedges = {"in": "k_in * (k_in - 1)", "out": "k_out * (k_out - 1)"}.get(_m, "k_in * k_out - kb")
    on_trade(f"motif_{_m}", lambda g, m=_m: C.local_motif_clustering(g, m), f"SELECT id, {r6(f'coalesce(t / nullif({_wedges}, 0), 0)')} AS value FROM ko JOIN ki USING (id) LEFT JOIN (SELECT d.src AS id, count(*) AS kb0 FROM d JOIN d e ON d.src = e.dst AND d.dst = e.src GROUP BY 1) USING (id) LEFT JOIN (SELECT {_i} AS id, count(*) AS t FROM d a JOIN d b ON {_b} JOIN d c ON {_c} GROUP BY 1) USING (id), LATERAL (SELECT coalesce(kb0, 0) AS kb)", True)
    _wedges = {"in": "si * si", "out": "so * so"}.get(_m, "si * so")
    on_trade(f"nsi_motif_{_m}", lambda g, m=_m: C.nsi_local_motif_clustering(g, m), f"SELECT id, {r6(f't / nullif({_wedges}, 0)')} AS value FROM (SELECT {_i} AS id, sum(x.w * y.w) AS t FROM dp a JOIN dp b ON {_b} JOIN dp c ON {_c} JOIN n x ON x.id = {_j} JOIN n y ON y.id = {_k} GROUP BY 1) JOIN (SELECT src AS id, sum(w) AS so FROM dp JOIN n ON dst = id GROUP BY src) USING (id) JOIN (SELECT dst AS id, sum(w) AS si FROM dp JOIN n ON src = id GROUP BY dst) USING (id)", True)
on_trade("nsi_local_clustering", C.nsi_local_clustering, f"SELECT id, {r6('t / (k * k)')} AS value FROM ks JOIN ({NTRI}) USING (id)")
on_trade("nsi_global_clustering", C.nsi_global_clustering, f"SELECT {r6('sum(w * t / (k * k)) / sum(w)')} AS value FROM ks JOIN ({NTRI}) USING (id) JOIN n USING (id)")
on_trade("nsi_transitivity", C.nsi_transitivity, f"SELECT {r6('sum(w * t) / sum(w * k * k)')} AS value FROM ks JOIN ({NTRI}) USING (id) JOIN n USING (id)")
on_trade("nsi_soffer_clustering", C.nsi_local_soffer_clustering, f"SELECT id, {r6('t / m')} AS value FROM ({NTRI}) JOIN (SELECT src AS id, sum(w * least(a.k, b.k)) AS m FROM up JOIN ks a ON a.id = src JOIN ks b ON b.id = dst JOIN n ON n.id = dst GROUP BY src) USING (id)")
on_trade("weighted_clustering", lambda g: C.weighted_local_clustering(g, "v"), f"SELECT n.id AS id, {r6('coalesce(t / ((SELECT max(v) FROM d) * so * si), 0)')} AS value FROM n LEFT JOIN (SELECT a.src AS id, sum(a.v * b.v * c.v) AS t FROM d a JOIN d b ON a.dst = b.src JOIN d c ON c.src = b.dst AND c.dst = a.src GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, sum(v) AS so FROM d GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, sum(v) AS si FROM d GROUP BY 1) USING (id)", True)

# paths -----------------------------------------------------------------------------------------


def bfs(e: str) -> str:
    """Distances of all pairs by levels; with as many nodes none is longer than N - 1."""
    return f", walk(src, dst, h) AS (SELECT id, id, 0 FROM n UNION SELECT walk.src, e.dst, h + 1 FROM walk JOIN {e} e ON e.src = walk.dst WHERE h < 24), dist AS (SELECT src, dst, CAST(min(h) AS DOUBLE) AS d FROM walk GROUP BY 1, 2), dn AS (SELECT src, dst, CASE WHEN src = dst THEN 1.0 ELSE d END AS d, a.w AS wi, b.w AS wj FROM dist JOIN n a ON a.id = src JOIN n b ON b.id = dst)"


def on_paths(name: str, f: Callable, sql: str, directed: bool = False) -> None:
    def make(spark: SparkSession, sf: str) -> DataFrame:
        g = D.trade(spark, sf, directed)
        return f(g, P.path_lengths(g))

    add(name, make, f"WITH RECURSIVE {D.TRADE}{bfs('d' if directed else 'u')} {sql}")


on_paths("path_lengths", lambda g, d: d, "SELECT src, dst, d FROM dist")
on_paths("path_lengths_directed", lambda g, d: d, "SELECT src, dst, d FROM dist", True)
on_paths("average_path_length", P.average_path_length, f"SELECT {r6('avg(d)')} AS value FROM dist WHERE src <> dst")
on_paths("nsi_average_path_length", P.nsi_average_path_length, f"SELECT {r6('sum(wi * wj * d) / sum(wi * wj)')} AS value FROM dn")
on_paths("diameter", lambda g, d: P.diameter(d), "SELECT max(d) AS value FROM dist")
on_paths("closeness", P.closeness, f"SELECT src AS id, {r6('coalesce((count(*) - 1) / nullif(sum(d), 0), 0)')} AS value FROM dist GROUP BY src")
on_paths("nsi_closeness", P.nsi_closeness, f"SELECT src AS id, {r6('CASE WHEN count(*) = (SELECT count(*) FROM n) THEN (SELECT sum(w) FROM n) / sum(wj * d) ELSE 0 END')} AS value FROM dn GROUP BY src")
on_paths("nsi_harmonic_closeness", lambda g, d: P.nsi_closeness(g, d, "harmonic"), f"SELECT src AS id, {r6('sum(wj / d) / (SELECT sum(w) FROM n)')} AS value FROM dn GROUP BY src")
on_paths("nsi_exponential_closeness", lambda g, d: P.nsi_closeness(g, d, "exponential"), f"SELECT src AS id, {r6('sum(wj * pow(2.0, -d)) / (SELECT sum(w) FROM n)')} AS value FROM dn GROUP BY src")
on_paths("global_efficiency", P.global_efficiency, f"SELECT {r6('sum(1 / d) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1))')} AS value FROM dist WHERE src <> dst")
on_paths("nsi_global_efficiency", P.nsi_global_efficiency, f"SELECT {r6('sum(wi * wj / d) / pow((SELECT sum(w) FROM n), 2)')} AS value FROM dn")
FAR = "(SELECT count(*) FROM n)"
ALLD = f"SELECT a.id AS src, b.id AS dst, a.w AS wi, b.w AS wj, coalesce(d, {FAR}) AS d, CASE WHEN a.id = b.id THEN 1.0 ELSE coalesce(d, {FAR}) END AS e FROM n a CROSS JOIN n b LEFT JOIN dist ON dist.src = a.id AND dist.dst = b.id"
TW = "(SELECT sum(w) FROM n)"
DBM = f"SELECT src AS id, max(wi) AS w, ({FAR} - 1) / sum(d) AS closeness, sum(CASE WHEN src <> dst THEN 1 / d END) / ({FAR} - 1) AS harmonic, sum(CASE WHEN src <> dst THEN pow(0.5, d) END) / ({FAR} - 1) AS exponential, {TW} / sum(wj * e) AS nsi_closeness, sum(wj / e) / {TW} AS nsi_harmonic, sum(wj * pow(0.5, e)) / {TW} AS nsi_exponential FROM ({ALLD}) GROUP BY src"
_dbm = ["closeness", "harmonic", "exponential", "nsi_closeness", "nsi_harmonic", "nsi_exponential"]
on_paths("distance_based_measures", P.distance_based_measures, "SELECT id, " + ", ".join(f"{r6(c)} AS {c}" for c in _dbm) + f" FROM ({DBM})")
on_paths("distance_based_totals", lambda g, d: P.distance_based_totals(g, P.distance_based_measures(g, d)), f"SELECT {r6('avg(1 / closeness)')} AS average_path_length, {r6('avg(harmonic)')} AS global_efficiency, {r6(f'sum(w / {TW} / nsi_closeness)')} AS nsi_average_path_length, {r6(f'sum(w / {TW} * nsi_harmonic)')} AS nsi_global_efficiency FROM ({DBM})")
on_trade("coreness", P.coreness)

# interacting networks --------------------------------------------------------------------------


def on_layers(name: str, f: Callable, sql: str | None = None, directed: bool = False) -> None:
    add(name, lambda spark, sf: f(D.trade(spark, sf, directed), *D.layers(spark, sf)), sql, D.TRADE if sql else "")


CL = "SELECT src, dst FROM u WHERE src IN (SELECT id FROM la) AND dst IN (SELECT id FROM lb)"
on_layers("cross_degree", I.cross_degree, f"SELECT id, count(dst) AS value FROM la LEFT JOIN ({CL}) ON src = id GROUP BY id")
on_layers("cross_out_degree", lambda g, a, b: I.cross_degree(g, a, b, direction="out"), "SELECT la.id AS id, count(lb.id) AS value FROM la LEFT JOIN d ON src = la.id LEFT JOIN lb ON dst = lb.id GROUP BY la.id", True)
on_layers("cross_link_density", I.cross_link_density, f"SELECT {r6(f'(SELECT count(*) FROM ({CL})) / ((SELECT count(*) FROM la) * count(*))')} AS value FROM lb")
on_layers("internal_degree", lambda g, a, b: I.internal_degree(g, a), "SELECT la.id AS id, count(x.id) AS value FROM la LEFT JOIN u ON src = la.id LEFT JOIN la x ON dst = x.id GROUP BY la.id")
on_layers("internal_link_density", lambda g, a, b: I.internal_link_density(g, a), f"SELECT {r6('(SELECT count(*) FROM u WHERE src IN (SELECT id FROM la) AND dst IN (SELECT id FROM la)) / (count(*) * (count(*) - 1))')} AS value FROM la")
on_layers("internal_global_clustering", lambda g, a, b: I.internal_global_clustering(g, a), f"SELECT {r6('avg(value)')} AS value FROM ({LC}) WHERE id IN (SELECT id FROM la)")
CT = f"SELECT a.src AS id, count(*) AS t FROM ({CL}) a JOIN ({CL}) b ON a.src = b.src AND a.dst < b.dst JOIN u ON u.src = a.dst AND u.dst = b.dst GROUP BY 1"
CK = f"SELECT id, count(dst) AS k FROM la LEFT JOIN ({CL}) ON src = id GROUP BY id"
on_layers("cross_local_clustering", I.cross_local_clustering, f"SELECT id, {r6('coalesce(2 * t / nullif(k * (k - 1), 0), 0)')} AS value FROM ({CK}) LEFT JOIN ({CT}) USING (id)")
on_layers("cross_global_clustering", I.cross_global_clustering, f"SELECT {r6('avg(coalesce(2 * t / nullif(k * (k - 1), 0), 0))')} AS value FROM ({CK}) LEFT JOIN ({CT}) USING (id)")
on_layers("cross_transitivity", I.cross_transitivity, f"SELECT {r6('sum(coalesce(t, 0)) / sum(k * (k - 1) / 2)')} AS value FROM ({CK}) LEFT JOIN ({CT}) USING (id)")
NCD = "SELECT la.id AS id, sum(CASE WHEN lb.id IS NULL THEN 0 ELSE n.w END) AS value FROM la LEFT JOIN up ON src = la.id LEFT JOIN lb ON dst = lb.id LEFT JOIN n ON n.id = dst GROUP BY la.id"
on_layers("nsi_cross_degree", I.nsi_cross_degree, f"SELECT id, {r6('value')} AS value FROM ({NCD})")
on_layers("nsi_cross_mean_degree", I.nsi_cross_mean_degree, f"SELECT {r6('sum(w * value) / sum(w)')} AS value FROM ({NCD}) JOIN n USING (id)")
on_layers("nsi_cross_edge_density", I.nsi_cross_edge_density, f"SELECT {r6('sum(w * value) / (sum(w) * (SELECT sum(w) FROM n JOIN lb USING (id)))')} AS value FROM ({NCD}) JOIN n USING (id)")
NCT = "SELECT a.src AS id, sum(x.w * y.w) AS t FROM up a JOIN up b ON a.dst = b.src JOIN up c ON c.src = a.src AND c.dst = b.dst JOIN n x ON x.id = a.dst JOIN n y ON y.id = b.dst WHERE a.src IN (SELECT id FROM la) AND a.dst IN (SELECT id FROM lb) AND b.dst IN (SELECT id FROM lb) GROUP BY 1"
on_layers("nsi_cross_local_clustering", I.nsi_cross_local_clustering, f"SELECT id, {r6('coalesce(t / nullif(value * value, 0), 0)')} AS value FROM ({NCD}) LEFT JOIN ({NCT}) USING (id)")
on_layers("nsi_cross_transitivity", I.nsi_cross_transitivity, f"SELECT {r6('sum(w * coalesce(t, 0)) / sum(w * value * value)')} AS value FROM ({NCD}) LEFT JOIN ({NCT}) USING (id) JOIN n USING (id)")
on_layers("subnetwork", lambda g, a, b: g.subgraph(a).edges.select("src", "dst"), "SELECT src, dst FROM u WHERE src IN (SELECT id FROM la) AND dst IN (SELECT id FROM la)")


def on_cross_paths(name: str, f: Callable, sql: str) -> None:
    add(name, lambda spark, sf: f(D.trade(spark, sf, False), *D.layers(spark, sf)), f"WITH RECURSIVE {D.TRADE}{bfs('u')}, cd AS (SELECT * FROM dist WHERE src IN (SELECT id FROM la) AND dst IN (SELECT id FROM lb)) {sql}")


on_cross_paths("cross_average_path_length", I.cross_average_path_length, f"SELECT {r6('avg(d)')} AS value FROM cd")
on_cross_paths("cross_closeness", I.cross_closeness, f"SELECT id, {r6('(SELECT count(*) FROM lb) / (coalesce(sum(d), 0) + ((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM lb) - count(d)))')} AS value FROM la LEFT JOIN cd ON src = id GROUP BY id")
on_cross_paths("cross_local_efficiency", I.local_efficiency, f"SELECT id, {r6('coalesce(sum(1 / d), 0) / (SELECT count(*) FROM lb)')} AS value FROM la LEFT JOIN cd ON src = id GROUP BY id")
# fields of series ------------------------------------------------------------------------------


def on_months(name: str, f: Callable, sql: str | None = None, more: str = "") -> None:
    add(name, lambda spark, sf: f(D.nation_months(spark, sf)), sql, D.MONTHS + more if sql else "")


ANOM = ", an AS (SELECT node, t, x - avg(x) OVER (PARTITION BY node, t % 12) AS x FROM obs)"
CORR = ANOM + ", pc AS (SELECT a.node AS i, b.node AS j, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END AS s FROM an a JOIN an b USING (t) GROUP BY 1, 2)"
on_months("nation_months", lambda o: o, "SELECT node, t, x FROM obs")
on_months("phase_mean", lambda o: S.phase_mean(o, 12), f"SELECT node, t % 12 AS phase, {r6('avg(x)')} AS mean FROM obs GROUP BY 1, 2")
on_months("phase_indices", lambda o: S.phase_indices(o.select("t"), 12), "SELECT t % 12 AS phase, t FROM (SELECT DISTINCT t FROM obs) WHERE t < (SELECT floor((max(t) + 1) / 12) * 12 FROM obs)")
on_months("anomaly", lambda o: S.anomaly(o, 12), f"SELECT node, t, {r6('x')} AS x FROM an", ANOM)
on_months("anomaly_winter", lambda o: S.anomaly(o, 12, [0, 1, 11]), f"SELECT node, t, {r6('x')} AS x FROM an WHERE t % 12 IN (0, 1, 11)", ANOM)
on_months("normalize", S.normalize, f"SELECT node, t, {r6('(x - avg(x) OVER (PARTITION BY node)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY node) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY node) END')} AS x FROM obs")
on_months("window_select", lambda o: S.window_select(o, 6, 29), "SELECT node, t, x FROM obs WHERE t BETWEEN 6 AND 29")
on_months("ranks", S.ranks, "SELECT node, t, CAST(row_number() OVER (PARTITION BY node ORDER BY x, t) - 1 AS DOUBLE) AS x FROM obs")
on_months("pearson_similarity", lambda o: S.pearson(S.anomaly(o, 12)), f"SELECT i, j, {r6('s')} AS s FROM pc", CORR)
on_months("spearman_similarity", S.spearman, f"SELECT a.node AS i, b.node AS j, {r6('corr(a.x, b.x)')} AS s FROM rk a JOIN rk b USING (t) GROUP BY 1, 2", ", rk AS (SELECT node, t, CAST(row_number() OVER (PARTITION BY node ORDER BY x, t) AS DOUBLE) AS x FROM obs)")
on_months("partial_correlation", lambda o: S.partial_correlation(S.anomaly(o, 12)))


def climate(o: DataFrame) -> G.Graph:
    sim = durable(S.pearson(S.anomaly(o, 12)).select("i", "j", F.abs("s").alias("s")), "similarity")
    return S.threshold_network(sim, 0.2)


on_months("pearson_network", lambda o: climate(o).edges.select("src", "dst"), "SELECT i AS src, j AS dst FROM pc WHERE abs(s) > 0.2 AND i <> j", CORR)
on_months("pearson_network_degree", lambda o: G.degree(climate(o)), "SELECT o.id AS id, count(p.j) AS k FROM (SELECT DISTINCT node AS id FROM obs) o LEFT JOIN pc p ON p.i = o.id AND p.i <> p.j AND abs(p.s) > 0.2 GROUP BY 1", CORR)
on_months("threshold_from_link_density", lambda o: S.threshold_from_link_density(S.pearson(S.anomaly(o, 12)).select("i", "j", F.round(F.abs("s"), 9).alias("s")), 0.1), f"SELECT {r6('s')} AS threshold FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM (SELECT round(abs(s), 9) AS s FROM pc)) WHERE r = (SELECT floor(0.9 * (c * c - c)) FROM (SELECT count(DISTINCT i) AS c FROM pc))", CORR)
on_months("link_density_function", lambda o: S.link_density_function(S.pearson(S.anomaly(o, 12)).select("i", "j", F.round(F.abs("s"), 7).alias("s")), 10), f"SELECT bin, lower, {r6('coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()')} AS density FROM ({hist_sql('(SELECT round(abs(s), 7) AS s FROM pc)', 's', 'CAST(10 AS DOUBLE)')})", CORR)
BINS = ", bn AS (SELECT node, t, least(floor((x - lo) / (hi - lo) * 8), 7) AS b FROM obs, (SELECT min(x) AS lo, max(x) AS hi FROM obs)), jt AS (SELECT a.node AS i, b.node AS j, a.b AS p, b.b AS q, count(*) AS n FROM bn a JOIN bn b USING (t) GROUP BY 1, 2, 3, 4), jm AS (SELECT *, sum(n) OVER (PARTITION BY i, j, p) AS np, sum(n) OVER (PARTITION BY i, j, q) AS nq, sum(n) OVER (PARTITION BY i, j) AS tt FROM jt)"
on_months("mutual_information", lambda o: S.mutual_information(S.binned(o, 8)), f"SELECT i, j, {r6('sum(n / tt * ln(n * tt / (np * nq)))')} AS s FROM jm GROUP BY 1, 2", BINS)
LAG = ", lg AS (SELECT a.node AS i, b.node AS j, k.tau, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) ELSE 0 END AS s FROM (SELECT unnest(range(0, 4)) AS tau) k, obs a JOIN obs b ON b.t = a.t + k.tau WHERE b.t >= 3 GROUP BY 1, 2, 3)"
on_months("cross_correlation_all", lambda o: Q.cross_correlation(o, 3), f"SELECT i, j, tau, {r6('s')} AS s FROM lg", LAG)
on_months("cross_correlation_lag_max", lambda o: Q.strongest_lag(Q.cross_correlation(o, 3)), f"SELECT i, j, {r6('s')} AS s, lag FROM (SELECT i, j, s, tau AS lag, row_number() OVER (PARTITION BY i, j ORDER BY round(abs(s), 12) DESC, tau DESC) AS r FROM lg) WHERE r = 1", LAG)
on_months("cross_correlation_sum", lambda o: S.summed_lags(Q.cross_correlation(o, 3)), f"SELECT i, j, {r6('sum(abs(s))')} AS s FROM lg GROUP BY 1, 2", LAG)
on_months("quantile_bins", lambda o: S.quantile_binned(o, 6), "SELECT node, t, CAST(floor(max(r) OVER (PARTITION BY node, x) / ceil(c / 6.0)) AS BIGINT) AS b FROM (SELECT node, t, x, row_number() OVER (PARTITION BY node ORDER BY x, t) - 1 AS r, count(*) OVER (PARTITION BY node) AS c FROM obs)")
on_months("knn_information", lambda o: Q.most_information(Q.mutual_information(o, 1, "knn", 5)))
on_months("information_transfer", lambda o: Q.most_information(Q.information_transfer(o, 1, "knn", 5)))
on_months("shuffled_surrogate", S.shuffled)

RAIN = ANOM + """, so AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS m FROM obs), li AS (SELECT max(CASE WHEN r = floor(m * 0.5) THEN x END) AS lo, max(CASE WHEN r = floor(m * 0.9) - 1 THEN x END) AS hi FROM so),
mk AS (SELECT node, t, x >= lo AND x <= hi AND x <> 0 AS hit FROM obs, li), rr AS (SELECT an.node, an.t, CAST(row_number() OVER (PARTITION BY an.node ORDER BY an.x, an.t) AS DOUBLE) AS r, hit FROM (SELECT node, t, round(x, 9) AS x FROM an) an JOIN mk ON mk.node = an.node AND mk.t = an.t),
rp AS (SELECT a.node AS i, b.node AS j, a.r AS p, b.r AS q, a.hit OR b.hit AS hit, sum(CASE WHEN a.hit OR b.hit THEN 1 ELSE 0 END) OVER (PARTITION BY a.node, b.node) AS n, tt FROM rr a JOIN rr b USING (t), (SELECT count(DISTINCT t) AS tt FROM obs))"""
on_months("top_events", lambda o: K.top_events(o, 0.5, 0.9).select("node", "t", F.col("hit").cast("int").alias("hit")), "SELECT node, t, CAST(hit AS BIGINT) AS hit FROM mk", RAIN)
on_months("top_events_spearman", lambda o: K.rainfall_similarity(o, S.anomaly(o, 12).withColumn("x", F.round("x", 9)), 0.5, 0.9), f"SELECT i, j, {r6('sum(CASE WHEN hit THEN (p - sh) * (q - sh) END) / nullif(sqrt(sum(CASE WHEN hit THEN (p - sh) * (p - sh) END) * sum(CASE WHEN hit THEN (q - sh) * (q - sh) END)), 0)')} AS s FROM (SELECT i, j, p, q, hit, tt - n + (n + 1) / 2.0 AS sh FROM rp) GROUP BY 1, 2", RAIN)
on_months("coupled_similarity", lambda o: K.coupled_similarity(S.anomaly(o.filter("node < 12"), 12), S.anomaly(o.filter("node >= 12"), 12)), f"SELECT i, j, {r6('s')} AS s FROM pc WHERE i < 12 AND j >= 12", CORR)

# space -----------------------------------------------------------------------------------------

ANG = "acos(greatest(-1.0, least(1.0, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon) - radians(b.lon)))))"
ANGLE = D.GRID + f", ad AS (SELECT a.node AS i, b.node AS j, CASE WHEN a.node = b.node THEN 0 ELSE {ANG} END AS d FROM grid a, grid b)"
add("angular_distance", lambda spark, sf: X.angular_distance(D.nation_grid(spark, sf)), f"SELECT i, j, {r6('d')} AS d FROM ad", ANGLE)
add("grid_boundaries", lambda spark, sf: X.boundaries(D.nation_grid(spark, sf)), "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM grid", D.GRID)
add("nearest_node", lambda spark, sf: X.nearest_node(D.nation_grid(spark, sf), 10.0, 20.0), f"SELECT a.node AS node, {r6(ANG)} AS d FROM grid a, (SELECT 10.0 AS lat, 20.0 AS lon) b ORDER BY d, node LIMIT 1", D.GRID)


def on_geo(name: str, f: Callable, sql: str, directed: bool = False, more: str = "") -> None:
    add(name, lambda spark, sf: f(D.trade(spark, sf, directed), D.nation_grid(spark, sf)), sql, f"{D.TRADE}, {ANGLE}, ld AS (SELECT src, dst, d FROM u JOIN ad ON i = src AND j = dst), dd AS (SELECT src, dst, d FROM d JOIN ad ON i = src AND j = dst){more}")


on_geo("average_link_distance", X.average_link_distance, f"SELECT id, {r6('coalesce(avg(ld.d), 0)')} AS value FROM n LEFT JOIN ld ON src = id GROUP BY id")
on_geo("max_link_distance", X.max_link_distance, f"SELECT id, {r6('coalesce(max(ld.d), 0)')} AS value FROM n LEFT JOIN ld ON src = id GROUP BY id")


def bins_to(source: str, value: str, bins: int, top: str) -> str:
    """Histogram from 0 to a given end as SQL: ``bin, lower, n``."""
    return f"SELECT b.bin AS bin, top * b.bin / {bins}.0 AS lower, count(v) AS n FROM (SELECT ({top}) AS top) e, (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN (SELECT {value} AS v FROM {source}) x ON least(floor((v - 0.0) / (top - 0.0) * {bins}), {bins - 1}) = b.bin GROUP BY b.bin, top"


TOP = "SELECT max(d) FROM ad"
LDD = bins_to("ld", "d", 7, TOP)
GDD = bins_to("(SELECT d FROM ad WHERE i <> j)", "d", 7, TOP)
on_geo("link_distance_distribution", lambda g, x: X.link_distance_distribution(g, x, 7), f"SELECT bin, {r6('lower')} AS lower, {r6('n / sum(n) OVER ()')} AS share FROM ({LDD})")
on_geo("link_distance_distribution_corrected", lambda g, x: X.link_distance_distribution(g, x, 7, True), f"SELECT a.bin AS bin, {r6('a.lower')} AS lower, {r6('coalesce(a.n / nullif(b.n, 0), 0) / sum(coalesce(a.n / nullif(b.n, 0), 0)) OVER ()')} AS share FROM ({LDD}) a JOIN ({GDD}) b USING (bin)")
add("geometric_distance_distribution", lambda spark, sf: X.geometric_distance_distribution(D.nation_grid(spark, sf), 7), f"SELECT bin, {r6('lower')} AS lower, {r6('n / sum(n) OVER ()')} AS share FROM ({GDD})", ANGLE)
AWC = "SELECT n.id AS id, coalesce(sum(m.w), 0) / (SELECT sum(w) FROM n) AS value FROM n LEFT JOIN u ON src = n.id LEFT JOIN n m ON m.id = dst GROUP BY n.id"
on_geo("area_weighted_connectivity", lambda g, x: X.area_weighted_connectivity(g), f"SELECT id, {r6('value')} AS value FROM ({AWC})")
on_geo("total_link_distance", X.total_link_distance, f"SELECT id, {r6('value * coalesce((SELECT avg(ld.d) FROM ld WHERE src = id), 0)')} AS value FROM ({AWC})")
on_geo("neighbor_connectivity", lambda g, x: X.neighbor_connectivity(g), f"SELECT n.id AS id, {r6('coalesce(avg(a.value), 0)')} AS mean, {r6('coalesce(max(a.value), 0)')} AS largest FROM n LEFT JOIN u ON src = n.id LEFT JOIN ({AWC}) a ON a.id = dst GROUP BY n.id")
CWD = "SELECT n.id AS id, {0} AS value FROM n LEFT JOIN {1} ON {2} = n.id LEFT JOIN n m ON m.id = {3} GROUP BY n.id"
_cwd = r6("coalesce(sum(l.d * m.w) / (count(l.d) * (SELECT sum(w) FROM n)), 0)")
on_geo("connectivity_weighted_distance", X.connectivity_weighted_distance, CWD.format(_cwd, "ld l", "l.src", "l.dst"))
for _way, (_own, _other) in {"in": ("dst", "src"), "out": ("src", "dst")}.items():
    on_geo(f"connectivity_weighted_distance_{_way}", lambda g, x, w=_way: X.connectivity_weighted_distance(g, x, w), CWD.format(_cwd, "dd l", f"l.{_own}", f"l.{_other}"), True)
    on_geo(f"average_link_distance_{_way}", lambda g, x, w=_way: X.average_link_distance(g, x, w), f"SELECT id, {r6('coalesce(avg(dd.d), 0)')} AS value FROM n LEFT JOIN dd ON {_own} = id GROUP BY id", True)
    _awc = f"SELECT n.id AS id, coalesce(sum(m.w), 0) / (SELECT sum(w) FROM n) AS value FROM n LEFT JOIN d ON {_own} = n.id LEFT JOIN n m ON m.id = {_other} GROUP BY n.id"
    on_geo(f"area_weighted_connectivity_{_way}", lambda g, x, w=_way: X.area_weighted_connectivity(g, w), f"SELECT id, {r6('value')} AS value FROM ({_awc})", True)
    on_geo(f"total_link_distance_{_way}", lambda g, x, w=_way: X.total_link_distance(g, x, w), f"SELECT id, {r6(f'value * coalesce((SELECT avg(dd.d) FROM dd WHERE {_own} = id), 0)')} AS value FROM ({_awc})", True)
on_geo("average_link_distance_corrected", lambda g, x: X.average_link_distance(g, x, geometry_corrected=True), f"SELECT id, {r6('coalesce(avg(ld.d), 0) / (SELECT avg(d) FROM ad WHERE i = id)')} AS value FROM n LEFT JOIN ld ON src = id GROUP BY id")
GEO = "SELECT bin, lower, coalesce(sum(w) / max(total), 0) AS share FROM (SELECT b.bin AS bin, lo + (hi - lo) * b.bin / {1} AS lower, x.w AS w, total FROM (SELECT min(value) AS lo, max(value) AS hi, sum(w) AS total FROM ({0}) JOIN n USING (id)) e, (SELECT unnest(range(0, {1})) AS bin) b LEFT JOIN (SELECT value, w FROM ({0}) JOIN n USING (id)) x ON floor({1} - 1) >= 0 AND floor(({1} - 1) * (1 / (hi - lo)) * (x.value - lo)) = b.bin) GROUP BY bin, lower"
_geo = GEO.format(AWC, 6)
on_geo("geographical_distribution", lambda g, x: X.weighted_distribution(g, X.area_weighted_connectivity(g), 6), f"SELECT bin, {r6('lower')} AS lower, {r6('share')} AS share FROM ({_geo})")
on_geo("geographical_cumulative_distribution", lambda g, x: X.cumulative_weighted_distribution(g, X.area_weighted_connectivity(g), 6), f"SELECT bin, {r6('lower')} AS lower, {r6('share')} AS share, {r6('sum(share) OVER (ORDER BY bin DESC)')} AS cdf FROM ({_geo})")
on_geo("local_geographical_clustering", X.local_geographical_clustering, f"SELECT n.id AS id, {r6('coalesce(max(t) / ((SELECT max(1 / d) FROM ld WHERE d > 0) * max(si) * max(si)), 0)')} AS value FROM n LEFT JOIN (SELECT a.src AS id, sum(1 / (a.d * b.d * c.d)) AS t FROM ld a JOIN ld b ON b.src = a.dst JOIN ld c ON c.src = b.dst AND c.dst = a.src WHERE a.d > 0 AND b.d > 0 AND c.d > 0 GROUP BY 1) USING (id) LEFT JOIN (SELECT src AS id, sum(1 / d) AS si FROM ld WHERE d > 0 GROUP BY 1) USING (id) GROUP BY n.id")

# recurrence ------------------------------------------------------------------------------------


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return durable(R.embed(D.daily(spark, sf), 2, 1), "embedding")


EMB = D.SIX + ", em AS (SELECT i, x AS a, lead(x) OVER (ORDER BY i) AS b FROM six), ep AS (SELECT i, a, b FROM em WHERE b IS NOT NULL)"
RPS = EMB + ", rp AS (SELECT p.i AS i, q.i AS j FROM ep p, ep q WHERE greatest(abs(p.a - q.a), abs(p.b - q.b)) < 6), nn AS (SELECT count(*) AS n FROM ep)"


def plot(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    x = embedded(spark, sf)
    return durable(R.recurrences(x, 6.0), "plot"), x, x.count()


def on_plot(name: str, f: Callable, sql: str | None, more: str = "") -> None:
    add(name, lambda spark, sf: f(*plot(spark, sf)), sql, RPS + more if sql else "")


DIAG = ", dl AS (SELECT len, 2 * count(*) AS cnt FROM (SELECT line, g, count(*) AS len FROM (SELECT j - i AS line, i - row_number() OVER (PARTITION BY j - i ORDER BY i) AS g FROM rp WHERE j > i) GROUP BY 1, 2) GROUP BY 1)"
VERT = ", vl AS (SELECT len, count(*) AS cnt FROM (SELECT i, g, count(*) AS len FROM (SELECT i, j - row_number() OVER (PARTITION BY i ORDER BY j) AS g FROM rp) GROUP BY 1, 2) GROUP BY 1)"
WHITE = ", wl AS (SELECT len, count(*) AS cnt FROM (SELECT lead(j) OVER (PARTITION BY i ORDER BY j) - j - 1 AS len FROM (SELECT i, j FROM rp UNION ALL SELECT i, (SELECT min(i) FROM ep) - 1 FROM ep UNION ALL SELECT i, (SELECT max(i) FROM ep) + 1 FROM ep)) WHERE len > 0 GROUP BY 1)"


def lines_sql(table: str, least: int) -> str:
    return f"SELECT {r6(f'sum(CASE WHEN len >= {least} THEN len * cnt ELSE 0 END) / (sum(len * cnt) + 1e-8)')} AS share, {r6(f'sum(CASE WHEN len >= {least} THEN len * cnt ELSE 0 END) / (sum(CASE WHEN len >= {least} THEN cnt ELSE 0 END) + 1e-8)')} AS mean, max(len) AS longest, {r6(f'coalesce(sum(CASE WHEN len >= {least} THEN -cnt / t * ln(cnt / t) END), 0)')} AS entropy FROM {table}, (SELECT sum(cnt) AS t FROM {table} WHERE len >= {least})"


add("delay_embedding", lambda spark, sf: embedded(spark, sf).select("i", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")), "SELECT i, a, b FROM ep", EMB)
on_plot("recurrence_plot", lambda rp, x, n: rp, "SELECT i, j FROM rp")
on_plot("rqa_recurrence_rate", lambda rp, x, n: R.recurrence_rate(rp, n), f"SELECT {r6('count(*) / pow((SELECT n FROM nn), 2)')} AS value FROM rp")
on_plot("recurrence_probability", lambda rp, x, n: R.recurrence_probability(rp, n, 4), f"SELECT {r6('count(*) / ((SELECT n FROM nn) - 4)')} AS value FROM rp WHERE j - i = 4")
on_plot("rqa_diagonal_lines", lambda rp, x, n: R.diagonal_lines(rp), "SELECT len, cnt FROM dl", DIAG)
on_plot("rqa_vertical_lines", lambda rp, x, n: R.vertical_lines(rp), "SELECT len, cnt FROM vl", VERT)
on_plot("rqa_white_lines", lambda rp, x, n: R.white_lines(rp, x.select("i")), "SELECT len, cnt FROM wl", WHITE)
on_plot("rqa_diagonal_measures", lambda rp, x, n: R.line_measures(R.diagonal_lines(rp)), lines_sql("dl", 2), DIAG)
on_plot("rqa_vertical_measures", lambda rp, x, n: R.line_measures(R.vertical_lines(rp)), lines_sql("vl", 2), VERT)
on_plot("rqa_white_measures", lambda rp, x, n: R.line_measures(R.white_lines(rp, x.select("i")), 1), lines_sql("wl", 1), WHITE)
on_plot("rqa_summary", lambda rp, x, n: R.rqa_summary(rp, n), f"SELECT {r6('(SELECT count(*) FROM rp) / pow((SELECT n FROM nn), 2)')} AS rr, a.share AS det, a.mean AS l, b.share AS lam FROM ({lines_sql('dl', 2)}) a, ({lines_sql('vl', 2)}) b", DIAG + VERT)
on_plot("recurrence_network_degree", lambda rp, x, n: G.degree(R.network(rp, x.select("i"))), "SELECT ep.i AS id, count(rp.j) AS k FROM ep LEFT JOIN rp ON rp.i = ep.i AND rp.i <> rp.j GROUP BY 1")
on_plot("recurrence_network_transitivity_dimension", lambda rp, x, n: R.single_scale_dimension(C.transitivity(R.network(rp, x.select("i")))), f"SELECT {r6('ln((SELECT count(*) FROM e a JOIN e b ON a.j = b.i JOIN e c ON c.i = b.j AND c.j = a.i) / (SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM e GROUP BY i))) / ln(0.75)')} AS value", ", e AS (SELECT i, j FROM rp WHERE i <> j)")
on_plot("twins", lambda rp, x, n: R.twins(rp, 7), "SELECT a.i AS i, b.i AS j FROM nb a JOIN nb b ON a.l = b.l AND abs(a.i - b.i) > 7", ", nb AS (SELECT i, list(j ORDER BY j) AS l FROM rp GROUP BY i)")
add("permutation_entropy", lambda spark, sf: R.permutation_entropy(R.embed(D.daily(spark, sf), 3, 1), 3), f"SELECT {r6('-sum(n / t * log2(n / t)) / log2(6)')} AS value FROM (SELECT (a <= b) AS p, (a <= c) AS q, (b <= c) AS s, count(*) AS n FROM (SELECT x AS a, lead(x) OVER (ORDER BY i) AS b, lead(x, 2) OVER (ORDER BY i) AS c FROM six) WHERE c IS NOT NULL GROUP BY 1, 2, 3), (SELECT count(*) - 2 AS t FROM six)", D.SIX)


def two_plots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recurrences of the hourly counts of the two event types of smallest name, summed to half days; and both series."""
    o = D.event_hours(spark, sf)
    half = durable(o.groupBy("node", F.floor(F.col("t") / 12).alias("i")).agg(F.sum("x").alias("x")), "half")
    first = half.agg(F.min("node")).first()[0]
    second = half.filter(F.col("node") > first).agg(F.min("node")).first()[0]
    x, y = (half.filter(F.col("node") == k).select("i", F.array("x").alias("v")) for k in (first, second))
    return x, y, R.recurrences(x, 5.0), R.recurrences(y, 5.0), R.recurrences(x, 5.0, y=y)


HALF = D.HOURS + ", hf AS (SELECT node, CAST(floor(t / 12) AS BIGINT) AS i, sum(x) AS x FROM obs GROUP BY 1, 2), k1 AS (SELECT min(node) AS k FROM hf), k2 AS (SELECT min(node) AS k FROM hf, k1 WHERE node > k1.k), xs AS (SELECT i, x FROM hf, k1 WHERE node = k), ys AS (SELECT i, x FROM hf, k2 WHERE node = k), rx AS (SELECT a.i AS i, b.i AS j FROM xs a, xs b WHERE abs(a.x - b.x) < 5), ry AS (SELECT a.i AS i, b.i AS j FROM ys a, ys b WHERE abs(a.x - b.x) < 5), rc AS (SELECT a.i AS i, b.i AS j FROM xs a, ys b WHERE abs(a.x - b.x) < 5)"
add("cross_recurrence_rate", lambda spark, sf: (lambda t: R.recurrence_rate(t[4], t[0].count(), t[1].count()))(two_plots(spark, sf)), f"SELECT {r6('count(*) / ((SELECT count(*) FROM xs) * (SELECT count(*) FROM ys))')} AS value FROM rc", HALF)
add("cross_recurrence_balance", lambda spark, sf: R.cross_balance(two_plots(spark, sf)[4]), f"SELECT {r6('(sum(CASE WHEN j > i THEN 1 ELSE 0 END) - sum(CASE WHEN j < i THEN 1 ELSE 0 END)) / sum(CASE WHEN j <> i THEN 1 ELSE 0 END)')} AS value FROM rc", HALF)
add("joint_recurrence", lambda spark, sf: (lambda t: R.joint(t[2], t[3]))(two_plots(spark, sf)), "SELECT i, j FROM rx INTERSECT SELECT i, j FROM ry", HALF)
OFF = "(SELECT max(i) + 1 FROM xs)"
add("inter_system_network", lambda spark, sf: (lambda t: R.inter_system(t[2], t[3], t[4], R.system_offset(t[0])))(two_plots(spark, sf)), f"SELECT i AS src, j AS dst FROM rx WHERE i <> j UNION ALL SELECT i + {OFF}, j + {OFF} FROM ry WHERE i <> j UNION ALL SELECT i, j + {OFF} FROM rc UNION ALL SELECT j + {OFF}, i FROM rc", HALF)

# visibility ------------------------------------------------------------------------------------

VIS = {"natural": "NOT EXISTS (SELECT 1 FROM six k WHERE k.i > a.i AND k.i < b.i AND (k.x - a.x) * (b.i - a.i) >= (b.x - a.x) * (k.i - a.i))", "horizontal": "NOT EXISTS (SELECT 1 FROM six k WHERE k.i > a.i AND k.i < b.i AND k.x >= least(a.x, b.x))"}
for _kind, _where in VIS.items():
    _vis = D.SIX + f", up1 AS (SELECT a.i AS src, b.i AS dst FROM six a JOIN six b ON a.i < b.i WHERE {_where}), v AS (SELECT src, dst FROM up1 UNION ALL SELECT dst, src FROM up1)"
    add(f"visibility_{_kind}", lambda spark, sf, k=_kind: V.visible(D.daily(spark, sf).withColumn("t", F.col("i").cast("double")), k == "horizontal"), "SELECT src, dst FROM v", _vis)
    add(f"visibility_{_kind}_degrees", lambda spark, sf, k=_kind: V.directional_degree(V.graph(D.daily(spark, sf).withColumn("t", F.col("i").cast("double")), k == "horizontal")), "SELECT i AS id, count(CASE WHEN dst < i THEN 1 END) AS retarded, count(CASE WHEN dst > i THEN 1 END) AS advanced FROM six LEFT JOIN v ON src = i GROUP BY i", _vis)
_nat = D.SIX + f", up1 AS (SELECT a.i AS src, b.i AS dst FROM six a JOIN six b ON a.i < b.i WHERE {VIS['natural']})"
add("visibility_retarded_clustering", lambda spark, sf: V.directional_clustering(V.graph(D.daily(spark, sf).withColumn("t", F.col("i").cast("double"))), "retarded"), f"SELECT six.i AS id, {r6('coalesce(2 * max(t) / nullif(max(k) * (max(k) - 1), 0), 0)')} AS value FROM six LEFT JOIN (SELECT dst AS id, count(*) AS k FROM up1 GROUP BY 1) a ON a.id = six.i LEFT JOIN (SELECT a.dst AS id, count(*) AS t FROM up1 a JOIN up1 b ON a.dst = b.dst AND a.src < b.src JOIN up1 c ON c.src = a.src AND c.dst = b.src GROUP BY 1) b ON b.id = six.i GROUP BY six.i", _nat)

# events ----------------------------------------------------------------------------------------


def hours_events(spark: SparkSession, sf: str) -> DataFrame:
    return durable(E.events_of(E.event_matrix(D.event_hours(spark, sf), quantile=0.9)), "events")


EVM = D.HOURS + ", em AS (SELECT node, t, CASE WHEN x > q THEN 1 ELSE 0 END AS flag FROM obs JOIN (SELECT node, quantile_cont(x, 0.9) AS q FROM obs GROUP BY node) USING (node)), ev AS (SELECT node, CAST(t AS DOUBLE) AS ts FROM em WHERE flag = 1), nv AS (SELECT node, count(*) AS n FROM ev GROUP BY 1)"
add("event_matrix", lambda spark, sf: E.event_matrix(D.event_hours(spark, sf), quantile=0.9), "SELECT node, t, flag FROM em", EVM)
GAPS = ", gp AS (SELECT node, ts, least(ts - lag(ts) OVER w, lead(ts) OVER w - ts) / 2 AS half, lag(ts) OVER w AS p, lead(ts) OVER w AS q FROM ev WINDOW w AS (PARTITION BY node ORDER BY ts)), gg AS (SELECT * FROM gp WHERE p IS NOT NULL AND q IS NOT NULL), pr AS (SELECT x.node AS i, y.node AS j, x.ts AS tx, y.ts AS ty, x.ts - (y.ts + {lag}) AS d FROM gg x JOIN gg y ON x.node < y.node AND abs(x.ts - (y.ts + {lag})) <= least(x.half, y.half, {tau})), pd AS (SELECT *, max(d < 0) OVER own OR max(d < 0) OVER other AS back, max(d > 0) OVER own OR max(d > 0) OVER other AS forth FROM pr WINDOW own AS (PARTITION BY i, j, tx), other AS (PARTITION BY i, j, ty)), cn AS (SELECT i, j, sum(CASE WHEN d > 0 THEN CASE WHEN back THEN 0.5 ELSE 1.0 END WHEN d = 0 THEN 0.5 ELSE 0 END) AS c FROM pd GROUP BY 1, 2 UNION ALL SELECT j, i, sum(CASE WHEN d < 0 THEN CASE WHEN forth THEN 0.5 ELSE 1.0 END WHEN d = 0 THEN 0.5 ELSE 0 END) FROM pd GROUP BY 1, 2)"
ESV = "SELECT a.node AS i, b.node AS j, CASE WHEN a.n > 2 AND b.n > 2 THEN coalesce(c, 0) / sqrt((a.n - 2) * (b.n - 2)) ELSE 0 END AS value FROM nv a JOIN nv b ON a.node <> b.node LEFT JOIN cn s ON s.i = a.node AND s.j = b.node"
for _how, _v in {"directed": "a.value", "symmetric": "a.value + b.value", "antisym": "a.value - b.value", "mean": "(a.value + b.value) / 2", "max": "greatest(a.value, b.value)", "min": "least(a.value, b.value)"}.items():
    _name = "event_synchronization" if _how == "directed" else f"event_synchronization_{_how}"
    add(_name, lambda spark, sf, h=_how: E.analysis(hours_events(spark, sf), "ES", h), f"SELECT a.i AS i, a.j AS j, {r6(_v)} AS value FROM ({ESV}) a JOIN ({ESV}) b ON a.i = b.j AND a.j = b.i", EVM + GAPS.format(lag="0", tau="1e300"))
add("event_synchronization_lagged", lambda spark, sf: E.event_synchronization(hours_events(spark, sf), 2.0, 1.0), f"SELECT i, j, {r6('value')} AS value FROM ({ESV})", EVM + GAPS.format(lag="1.0", tau="2.0"))
add("event_network", lambda spark, sf: K.event_network(hours_events(spark, sf), 0.1, "ES").edges.select("src", "dst"), f"SELECT i AS src, j AS dst FROM ({ESV}) WHERE value > 0.1", EVM + GAPS.format(lag="0", tau="1e300"))


def eca_sql(window: str, tau: float, lag: float) -> str:
    """Coincidence rates as SQL: ``i, j, value``."""
    own, time = ("y", "y") if window == "retarded" else ("x", "x")
    start, end = f"f.lo + {lag} + {tau}", f"f.hi - {lag} - {tau}"
    keep = {"advanced": f"{time}.ts > {start}", "retarded": f"{time}.ts < {end}", "symmetric": f"{time}.ts > {start} AND {time}.ts < {end}"}[window]
    left = {"advanced": f"count(*) - count(CASE WHEN ts <= {start} THEN 1 END)", "retarded": f"count(*) - count(CASE WHEN ts >= {end} THEN 1 END)", "symmetric": f"count(*) - count(CASE WHEN ts <= {start} THEN 1 END) - count(CASE WHEN ts >= {end} THEN 1 END)"}[window]
    low = -tau if window == "symmetric" else 0
    hits = f"SELECT x.node AS i, y.node AS j, count(DISTINCT {time}.ts) AS c FROM ev x JOIN ev y ON x.node <> y.node AND x.ts - y.ts - {lag} BETWEEN {low} AND {tau} JOIN sp f ON f.node = {own}.node WHERE {keep} GROUP BY 1, 2"
    norm = f"SELECT ev.node AS node, {left} AS l FROM ev JOIN sp f ON f.node = ev.node GROUP BY 1"
    return f"SELECT a.node AS i, b.node AS j, coalesce(c, 0) / nullif(l, 0) AS value FROM nv a JOIN nv b ON a.node <> b.node LEFT JOIN ({hits}) h ON h.i = a.node AND h.j = b.node JOIN ({norm}) z ON z.node = {'b' if window == 'retarded' else 'a'}.node"


SPAN = ", sp AS (SELECT node, min(ts) AS lo, max(ts) AS hi FROM ev GROUP BY 1)"
add("event_coincidence", lambda spark, sf: E.event_coincidence(hours_events(spark, sf), 3.0), f"SELECT a.i AS i, a.j AS j, {r6('a.value')} AS precursor, {r6('b.value')} AS trigger FROM ({eca_sql('advanced', 3.0, 0.0)}) a JOIN ({eca_sql('retarded', 3.0, 0.0)}) b USING (i, j)", EVM + SPAN)
for _window in ("retarded", "advanced", "symmetric"):
    add(f"event_coincidence_{_window}", lambda spark, sf, w=_window: E.coincidence_rate(hours_events(spark, sf), 3.0, w), f"SELECT i, j, {r6('value')} AS value FROM ({eca_sql(_window, 3.0, 0.0)})", EVM + SPAN)
    add(f"event_coincidence_{_window}_lagged", lambda spark, sf, w=_window: E.coincidence_rate(hours_events(spark, sf), 2.0, w, 1.0), f"SELECT i, j, {r6('value')} AS value FROM ({eca_sql(_window, 2.0, 1.0)})", EVM + SPAN)
for _how, _v in {"mean": "(a.value + b.value) / 2", "max": "greatest(a.value, b.value)", "min": "least(a.value, b.value)"}.items():
    add(f"event_coincidence_{_how}", lambda spark, sf, h=_how: E.analysis(hours_events(spark, sf), "ECA", h, "symmetric", 3.0), f"SELECT a.i AS i, a.j AS j, {r6(_v)} AS value FROM ({eca_sql('symmetric', 3.0, 0.0)}) a JOIN ({eca_sql('symmetric', 3.0, 0.0)}) b ON a.i = b.j AND a.j = b.i", EVM + SPAN)
#: Binomial tails of coincidences of rare events: the last hour is the record's end.
TAIL = "SELECT i, j, 1 - sum(exp(lgamma(k.m + 1) - lgamma(k.x + 1) - lgamma(k.m - k.x + 1) + k.x * ln(k.p) + (k.m - k.x) * ln(1 - k.p))) AS level FROM (SELECT i, j, m, 1 - pow(1 - 0.5 / last, o) AS p, unnest(range(CAST(floor(value * m + 1e-9) AS BIGINT), m + {0})) AS x FROM (SELECT r.i AS i, r.j AS j, value, CASE WHEN {1} THEN a.n ELSE b.n END AS m, CASE WHEN {1} THEN b.n ELSE a.n END AS o, last FROM ({2}) r JOIN nv a ON a.node = i JOIN nv b ON b.node = j, (SELECT max(t) AS last FROM em))) k GROUP BY 1, 2"
for _window, _first in {"advanced": True, "retarded": False}.items():
    add(f"event_significance_analytic_{_window}", lambda spark, sf, w=_window: (lambda h: E.analytic_significance(E.events_of(E.event_matrix(h, quantile=0.9)), float(h.agg(F.max("t")).first()[0]), 0.5, w))(D.event_hours(spark, sf)), f"SELECT i, j, {r6('level')} AS level FROM ({TAIL.format(int(_first), str(_first).upper(), eca_sql(_window, 0.5, 0.0))})", EVM + SPAN)
add("event_significance_shuffled", lambda spark, sf: (lambda h: E.shuffle_significance(E.events_of(E.event_matrix(h, quantile=0.9)), h.select("t"), "ECA", "directed", "symmetric", 1.0, n_surrogates=20))(D.event_hours(spark, sf)))
add("event_matrix_rules", lambda spark, sf: (lambda h: E.event_matrix(h, rules=h.select("node").distinct().select("node", F.when(F.length("node") % 2 == 0, "value").otherwise("quantile").alias("method"), F.when(F.length("node") % 2 == 0, 2.0).otherwise(0.4).alias("threshold"), (F.length("node") % 3 > 0).alias("above"))))(D.event_hours(spark, sf)), "SELECT node, t, CAST(CASE WHEN length(node) % 3 > 0 THEN x > lim ELSE x < lim END AS BIGINT) AS flag FROM obs JOIN (SELECT node, CASE WHEN length(node) % 2 = 0 THEN 2.0 ELSE quantile_cont(x, 0.4) END AS lim FROM obs GROUP BY node) USING (node)", D.HOURS)


# dense and random: checked by rows here, by properties in the tests ------------------------------

on_trade("newman_betweenness", N.newman_betweenness)
on_trade("arenas_betweenness", N.arenas_betweenness)
on_trade("msf_synchronizability", N.msf_synchronizability)
on_trade("spreading", N.spreading)
on_trade("nsi_spreading", lambda g: N.spreading(g, nsi=True))


def circuit(g: G.Graph) -> G.Graph:
    """The trade network, each link's resistance one over the smaller degree of its ends."""
    k = G.degree(g)
    r = g.edges.select("src", "dst").join(k.toDF("src", "a"), "src").join(k.toDF("dst", "b"), "dst").select("src", "dst", (1 / F.least("a", "b")).alias("r"))
    return G.Graph(g.nodes, r, False)


ADM = ", y AS (SELECT src, dst, CAST(least(a.k, b.k) AS DOUBLE) AS y FROM u JOIN du a ON a.id = src JOIN du b ON b.id = dst)"
on_trade("admittive_degree", lambda g: N.admittive_degree(circuit(g), "r"), f"SELECT id, {r6('coalesce(sum(y), 0)')} AS value FROM n LEFT JOIN y ON src = id GROUP BY id", more=ADM)
on_trade("neighbors_admittive_degree", lambda g: N.neighbors_admittive_degree(circuit(g), "r"), f"SELECT n.id AS id, {r6('coalesce(sum(s.s) / max(o.s), 0)')} AS value FROM n LEFT JOIN u ON src = n.id LEFT JOIN (SELECT src AS id, sum(y) AS s FROM y GROUP BY 1) s ON s.id = dst LEFT JOIN (SELECT src AS id, sum(y) AS s FROM y GROUP BY 1) o ON o.id = n.id GROUP BY n.id", more=ADM)
LAC = "SELECT n.id AS id, coalesce(max(t) / (max(o.s) * nullif(max(k) - 1, 0)), 0) AS value FROM n JOIN du USING (id) LEFT JOIN (SELECT a.src AS id, sum(a.y * b.y * c.y) AS t FROM y a JOIN y b ON b.src = a.dst JOIN y c ON c.src = b.dst AND c.dst = a.src GROUP BY 1) t ON t.id = n.id LEFT JOIN (SELECT src AS id, sum(y) AS s FROM y GROUP BY 1) o ON o.id = n.id GROUP BY n.id"
on_trade("local_admittive_clustering", lambda g: N.local_admittive_clustering(circuit(g), "r"), f"SELECT id, {r6('value')} AS value FROM ({LAC})", more=ADM)
on_trade("global_admittive_clustering", lambda g: N.global_admittive_clustering(circuit(g), "r"), f"SELECT {r6('avg(value)')} AS value FROM ({LAC})", more=ADM)
on_trade("admittance_laplacian", lambda g: N.admittance_laplacian(circuit(g), "r"), f"SELECT src AS i, dst AS j, {r6('-y')} AS value FROM y UNION ALL SELECT id, id, {r6('coalesce(sum(y), 0)')} FROM n LEFT JOIN y ON src = id GROUP BY id", more=ADM)
on_trade("pseudo_inverse", lambda g: N.pseudo_inverse(circuit(g), "r"))
on_trade("effective_impedance", lambda g: N.effective_impedance(G.Graph(g.nodes, circuit(g).edges.withColumn("x", F.col("r") * 2), False), "r", "x"))
on_trade("nsi_newman_betweenness", N.nsi_newman_betweenness)
on_trade("nsi_arenas_betweenness", N.nsi_arenas_betweenness)
on_trade("admittance", lambda g: N.admittance(circuit(g), "r"), f"SELECT src AS i, dst AS j, {r6('y')} AS value FROM y", more=ADM)
on_trade("effective_resistance", lambda g: N.effective_resistance(circuit(g), "r"))
on_trade("average_effective_resistance", lambda g: N.average_effective_resistance(N.effective_resistance(circuit(g), "r")))
on_trade("diameter_effective_resistance", lambda g: N.diameter_effective_resistance(N.effective_resistance(circuit(g), "r")))
on_trade("effective_resistance_closeness", lambda g: N.effective_resistance_closeness(N.effective_resistance(circuit(g), "r")))
on_trade("vertex_current_flow_betweenness", lambda g: N.vertex_current_flow_betweenness(circuit(g), "r"))
on_trade("edge_current_flow_betweenness", lambda g: N.edge_current_flow_betweenness(circuit(g), "r"))
on_trade("randomly_rewire", lambda g: M.randomly_rewire(g, 50).edges.select("src", "dst"))
on_trade("configuration_model", lambda g: M.configuration(G.degree(g)).edges.select("src", "dst"))
add("erdos_renyi", lambda spark, sf: M.erdos_renyi(spark, 200, 0.05).edges.select("src", "dst"))
add("watts_strogatz", lambda spark, sf: M.watts_strogatz(spark, 200, 3, 0.1).edges.select("src", "dst"))
add("barabasi_albert", lambda spark, sf: M.barabasi_albert(spark, 200, 3).edges.select("src", "dst"))
on_months("surrogate_fourier", U.fourier)
on_months("surrogate_aaft", U.aaft)
on_months("surrogate_refined_aaft", U.refined_aaft)
on_months("surrogate_twin", lambda o: U.twin_surrogates(o, 3.0))
add("windowed_event_counts", lambda spark, sf: windowed_counts(D.table(spark, sf, "events")).select("node", F.unix_timestamp("start").alias("start"), "n"), "SELECT event_type AS node, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of nations whose monthly shipping anomalies correlate: degree of each."""
    return QUERIES["pearson_network_degree"](spark, sf_dir)
