"""More registered queries of graphs, paths, groups, grids and models, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climate as K
from ..operators import clustering as C
from ..operators import graph as G
from ..operators import interacting as I
from ..operators import models as M
from ..operators import paths as P
from ..operators import series as S
from ..operators import spatial as X
from . import derive as D
from .blocks import durable
from .catalog import ANGLE, CORR, add, bfs, hist_sql, on_geo, on_layers, on_months, on_paths, on_trade, r6

# degrees, motifs -------------------------------------------------------------------------------

on_trade("degree_distribution_in", lambda g: G.degree_distribution(g, "in"), hist_sql("ki", "k_in", "greatest(max(v), 1)"), True)
on_trade("degree_cdf_in", lambda g: G.degree_cdf(g, "in").select("bin", "lower", "cdf"), f"SELECT bin, lower, {r6('sum(n) OVER (ORDER BY bin DESC) / (SELECT count(*) FROM ki)')} AS cdf FROM ({hist_sql('ki', 'k_in', 'max(v) + 1')})", True)
on_trade("degree_cdf_out", lambda g: G.degree_cdf(g, "out").select("bin", "lower", "cdf"), f"SELECT bin, lower, {r6('sum(n) OVER (ORDER BY bin DESC) / (SELECT count(*) FROM ko)')} AS cdf FROM ({hist_sql('ko', 'k_out', 'max(v) + 1')})", True)
on_trade("degree_weighted_in", lambda g: G.in_degree(g, "v").withColumnRenamed("k_in", "strength"), f"SELECT id, {r6('coalesce(sum(v), 0)')} AS strength FROM n LEFT JOIN d ON dst = id GROUP BY id", True)
on_trade("degree_bilateral_weighted", lambda g: G.bilateral_degree(g, "v"), f"SELECT n.id AS id, {r6('coalesce(sum(a.v * b.v), 0)')} AS k_bil FROM n LEFT JOIN (d a JOIN d b ON a.src = b.dst AND a.dst = b.src) ON a.src = n.id GROUP BY n.id", True)
on_trade("nsi_degree_weighted", lambda g: G.nsi_degree(g, None, "v"), f"SELECT id, {r6('a + b')} AS k FROM (SELECT n.id AS id, coalesce(sum(m.w * v), 0) AS a FROM n LEFT JOIN d ON src = n.id LEFT JOIN n m ON m.id = dst GROUP BY n.id) JOIN (SELECT n.id AS id, coalesce(sum(m.w * v), 0) AS b FROM n LEFT JOIN d ON dst = n.id LEFT JOIN n m ON m.id = src GROUP BY n.id) USING (id)", True)
on_trade("laplacian_in", lambda g: G.laplacian(g, "in"), "SELECT id AS i, id AS j, CAST(k_in AS DOUBLE) AS value FROM ki UNION ALL SELECT src, dst, -1.0 FROM d", True)
on_trade("matching_index_all", lambda g: G.matching_index(g, True), f"SELECT a.id AS i, b.id AS j, {r6('coalesce(c / (a.k + b.k - c), 0)')} AS value FROM du a CROSS JOIN du b LEFT JOIN (SELECT x.src AS i, y.dst AS j, count(*) AS c FROM u x JOIN u y ON x.dst = y.src GROUP BY 1, 2) ON i = a.id AND j = b.id")
on_trade("link_density_undirected", G.link_density, f"SELECT {r6('(SELECT count(*) FROM u) / (count(*) * (count(*) - 1))')} AS link_density FROM n")
for _m, (_b, _c, _i, _j, _k) in {"cycle": ("b.src = a.dst", "c.src = b.dst AND c.dst = a.src", "a.src", "a.dst", "b.dst"), "mid": ("b.dst = a.dst", "c.src = b.src AND c.dst = a.src", "a.src", "a.dst", "b.src"), "in": ("b.src = a.src", "c.src = b.dst AND c.dst = a.dst", "a.dst", "a.src", "b.dst"), "out": ("b.src = a.dst", "c.src = a.src AND c.dst = b.dst", "a.src", "a.dst", "b.dst")}.items():
    _wedges = {"in": "k_in * (k_in - 1)", "out": "k_out * (k_out - 1)"}.get(_m, "k_in * k_out - kb")
    on_trade(f"motif_{_m}_weighted", lambda g, m=_m: C.local_motif_clustering(g, m, "v"), f"SELECT id, {r6(f'coalesce(t / nullif({_wedges}, 0), 0)')} AS value FROM ko JOIN ki USING (id) LEFT JOIN (SELECT d.src AS id, count(*) AS kb0 FROM d JOIN d e ON d.src = e.dst AND d.dst = e.src GROUP BY 1) USING (id) LEFT JOIN (SELECT {_i} AS id, sum(cbrt(a.v) * cbrt(b.v) * cbrt(c.v)) AS t FROM d a JOIN d b ON {_b} JOIN d c ON {_c} GROUP BY 1) USING (id), LATERAL (SELECT coalesce(kb0, 0) AS kb)", True)
    _wedges = {"in": "si * si", "out": "so * so"}.get(_m, "si * so")
    on_trade(f"nsi_motif_{_m}_weighted", lambda g, m=_m: C.nsi_local_motif_clustering(g, m, "v"), f"SELECT id, {r6(f'coalesce(t, 0) / nullif({_wedges}, 0)')} AS value FROM (SELECT src AS id, sum(w) AS so FROM dp JOIN n ON dst = id GROUP BY src) JOIN (SELECT dst AS id, sum(w) AS si FROM dp JOIN n ON src = id GROUP BY dst) USING (id) LEFT JOIN (SELECT {_i} AS id, sum(cbrt(a.v) * cbrt(b.v) * cbrt(c.v) * x.w * y.w) AS t FROM d a JOIN d b ON {_b} JOIN d c ON {_c} JOIN n x ON x.id = {_j} JOIN n y ON y.id = {_k} GROUP BY 1) USING (id)", True)
on_trade("higher_order_transitivity4_sampled", lambda g: C.higher_order_transitivity(g, 4, 0.5))

# paths -----------------------------------------------------------------------------------------

#: Each shortest path once, as it is walked: numbers of paths and the weights of their inner nodes.
WALKS = ", sp(src, dst, h, p) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM n UNION ALL SELECT sp.src, e.dst, sp.h + 1, sp.p * CASE WHEN sp.h > 0 THEN m.w ELSE 1 END FROM sp JOIN {e} e ON e.src = sp.dst JOIN dist z ON z.src = sp.src AND z.dst = e.dst AND z.d = sp.h + 1 JOIN n m ON m.id = sp.dst), sg AS (SELECT src, dst, CAST(h AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS s, sum(p) AS ps FROM sp GROUP BY 1, 2, 3)"
THROUGH = "SELECT a.dst AS id, a.src AS x, b.dst AS y, a.s * b.s / c.s AS share, a.ps * b.ps / c.ps AS wide FROM sg a JOIN sg b ON b.src = a.dst JOIN sg c ON c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d WHERE a.src <> a.dst AND b.src <> b.dst"


def on_walks(name: str, f: Callable, sql: str, layers: bool = False) -> None:
    make = (lambda spark, sf: f(D.trade(spark, sf, False), *D.layers(spark, sf))) if layers else (lambda spark, sf: f(D.trade(spark, sf, False)))
    add(name, make, f"WITH RECURSIVE {D.TRADE}{bfs('u')}{WALKS.format(e='u')}, th AS ({THROUGH}) {sql}")


def passing(value: str, where: str = "TRUE") -> str:
    return f"SELECT n.id AS id, {r6(f'coalesce(sum({value}), 0)')} AS value FROM n LEFT JOIN (SELECT * FROM th WHERE {where}) t ON t.id = n.id LEFT JOIN n a ON a.id = t.x LEFT JOIN n b ON b.id = t.y GROUP BY n.id"


IN_A, IN_B = "IN (SELECT id FROM la)", "IN (SELECT id FROM lb)"
on_walks("betweenness", P.betweenness, passing("t.share / 2"))
on_walks("nsi_betweenness", P.nsi_betweenness, passing("t.wide * a.w * b.w"))
on_walks("link_betweenness", P.link_betweenness, f"SELECT u.src AS src, u.dst AS dst, {r6('coalesce(sum(a.s * b.s / c.s), 0)')} AS value FROM u LEFT JOIN (sg a JOIN sg b ON TRUE JOIN sg c ON c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d + 1) ON a.dst = u.src AND b.src = u.dst GROUP BY 1, 2")
on_walks("interregional_betweenness", lambda g, a, b: P.betweenness(g, a, b), passing("t.share", f"x {IN_A} AND y {IN_B}"), True)
on_walks("cross_betweenness", I.cross_betweenness, passing("t.share", f"x {IN_A} AND y {IN_B}"), True)
on_walks("internal_betweenness", lambda g, a, b: I.internal_betweenness(g, a), passing("t.share", f"x {IN_A} AND y {IN_A}"), True)
on_walks("nsi_cross_betweenness", I.nsi_cross_betweenness, passing("t.wide * a.w * b.w", f"x {IN_A} AND y {IN_B}"), True)

TRANS = ", nn AS (SELECT count(*) AS m FROM n), tm AS (SELECT a.id AS src, b.id AS dst, 0.15 / m + 0.85 * CASE WHEN ko.k_out = 0 THEN 1.0 / m ELSE coalesce(l, 0) / ko.k_out END AS p FROM n a CROSS JOIN n b CROSS JOIN nn JOIN ko ON ko.id = a.id LEFT JOIN (SELECT src, dst, 1 AS l FROM d) e ON e.src = a.id AND e.dst = b.id)"
add("pagerank", lambda spark, sf: P.pagerank(D.trade(spark, sf, True)), f"WITH RECURSIVE {D.TRADE}{TRANS}, pr(k, id, v) AS (SELECT 0, id, 1.0 / m FROM n, nn UNION ALL SELECT k + 1, tm.dst, sum(v * p) FROM pr JOIN tm ON tm.src = pr.id WHERE k < 150 GROUP BY k, tm.dst) SELECT id, {r6('v')} AS value FROM pr WHERE k = 150")
add("eigenvector_centrality", lambda spark, sf: P.eigenvector_centrality(D.trade(spark, sf, False)), f"WITH RECURSIVE {D.TRADE}, pw(k, id, v) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM n UNION ALL SELECT k + 1, up.src, sum(v) / 10 FROM pw JOIN up ON up.dst = pw.id WHERE k < 250 GROUP BY k, up.src) SELECT id, {r6('v / max(v) OVER ()')} AS value FROM pw WHERE k = 250")
add("nsi_eigenvector_centrality", lambda spark, sf: P.eigenvector_centrality(D.trade(spark, sf, False), True), f"WITH RECURSIVE {D.TRADE}, pw(k, id, v) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM n UNION ALL SELECT k + 1, up.src, sum(v * m.w) / (SELECT avg(k) FROM ks) FROM pw JOIN up ON up.dst = pw.id JOIN n m ON m.id = up.dst WHERE k < 250 GROUP BY k, up.src) SELECT id, {r6('v / max(v) OVER ()')} AS value FROM pw WHERE k = 250")


def min_plus(edges: str, doublings: int = 5) -> str:
    """Weighted distances ``wd(src, dst, d)`` by squaring the table of shortest ways so far: after five squarings of up to 32 links."""
    out = f", w0 AS (SELECT src, dst, min(len) AS d FROM ({edges} UNION ALL SELECT id, id, CAST(0 AS DOUBLE) FROM n) GROUP BY 1, 2)"
    for k in range(doublings):
        out += f", w{k + 1} AS (SELECT a.src AS src, b.dst AS dst, min(a.d + b.d) AS d FROM w{k} a JOIN w{k} b ON b.src = a.dst GROUP BY 1, 2)"
    return out + f", wd AS (SELECT * FROM w{doublings})"


WCLOSE = f"SELECT a.id AS id, {r6('((SELECT count(*) FROM n) - 1) / nullif(sum(coalesce(d, (SELECT count(*) FROM n))), 0)')} AS value FROM n a CROSS JOIN n b LEFT JOIN wd ON wd.src = a.id AND wd.dst = b.id GROUP BY 1"
on_trade("path_lengths_weighted", lambda g: P.path_lengths(g, "v"), f"SELECT src, dst, {r6('d')} AS d FROM wd", True, min_plus("SELECT src, dst, v AS len FROM d"))
on_trade("average_path_length_weighted", lambda g: P.average_path_length(g, P.path_lengths(g, "v")), f"SELECT {r6('avg(d)')} AS value FROM wd WHERE src <> dst", True, min_plus("SELECT src, dst, v AS len FROM d"))
on_trade("closeness_weighted", lambda g: P.closeness(g, P.path_lengths(g, "v"), "n"), WCLOSE, True, min_plus("SELECT src, dst, v AS len FROM d"))
on_trade("global_efficiency_weighted", lambda g: P.global_efficiency(g, P.path_lengths(g, "v")), f"SELECT {r6('sum(1 / d) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1))')} AS value FROM wd WHERE src <> dst", True, min_plus("SELECT src, dst, v AS len FROM d"))
on_paths("diameter_all_pairs", lambda g, d: P.diameter(d, g), "SELECT CASE WHEN count(*) < pow((SELECT count(*) FROM n), 2) THEN CAST((SELECT count(*) FROM n) AS DOUBLE) ELSE max(d) END AS value FROM dist")
GONE = "gw(gone, src, dst, h) AS (SELECT a.id, b.id, b.id, 0 FROM n a, n b WHERE a.id <> b.id UNION SELECT gone, gw.src, u.dst, h + 1 FROM gw JOIN u ON u.src = gw.dst AND u.dst <> gone WHERE h < 8), gd AS (SELECT gone, src, dst, min(h) AS h FROM gw GROUP BY 1, 2, 3), ge AS (SELECT gone AS id, sum(CASE WHEN h > 0 THEN 1.0 / h ELSE 0 END) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)) AS e FROM gd GROUP BY 1), e0 AS (SELECT sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)) AS e FROM dist)"
on_trade("local_vulnerability", P.local_vulnerability)
from .catalog import SQL as _SQL  # noqa: E402

_SQL["local_vulnerability"] = f"WITH RECURSIVE {D.TRADE}{bfs('u')}, {GONE} SELECT ge.id AS id, {r6('(e0.e - ge.e) / e0.e')} AS value FROM ge, e0"

# groups ----------------------------------------------------------------------------------------

on_layers("cross_in_degree", lambda g, a, b: I.cross_degree(g, a, b, direction="in"), "SELECT la.id AS id, count(lb.id) AS value FROM la LEFT JOIN d ON dst = la.id LEFT JOIN lb ON src = lb.id GROUP BY la.id", True)
on_layers("internal_in_degree", lambda g, a, b: I.internal_degree(g, a, direction="in"), "SELECT la.id AS id, count(x.id) AS value FROM la LEFT JOIN d ON dst = la.id LEFT JOIN la x ON src = x.id GROUP BY la.id", True)
on_layers("internal_out_degree", lambda g, a, b: I.internal_degree(g, a, direction="out"), "SELECT la.id AS id, count(x.id) AS value FROM la LEFT JOIN d ON src = la.id LEFT JOIN la x ON dst = x.id GROUP BY la.id", True)
on_layers("cross_degree_weighted", lambda g, a, b: I.cross_degree(g, a, b, "v", "out"), f"SELECT la.id AS id, {r6('coalesce(sum(CASE WHEN lb.id IS NOT NULL THEN v END), 0)')} AS value FROM la LEFT JOIN d ON src = la.id LEFT JOIN lb ON dst = lb.id GROUP BY la.id", True)
CD = f"SELECT la.id AS id, CAST(count(lb.id) AS DOUBLE) AS value FROM la LEFT JOIN u ON src = la.id LEFT JOIN lb ON dst = lb.id GROUP BY la.id"
on_layers("cross_degree_density", I.cross_degree_density, f"SELECT id, {r6('value / (SELECT count(*) FROM lb)')} AS value FROM ({CD})")
on_layers("total_cross_degree", I.total_cross_degree, f"SELECT {r6('avg(value)')} AS value FROM ({CD})")
on_layers("number_cross_links", I.number_cross_links, f"SELECT CAST(sum(value) AS BIGINT) AS value FROM ({CD})")
on_layers("number_internal_links", lambda g, a, b: I.number_internal_links(g, a), f"SELECT count(*) // 2 AS value FROM u WHERE src {IN_A} AND dst {IN_A}")
on_layers("cross_links", lambda g, a, b: I.cross_links(g, a, b).select("src", "dst"), f"SELECT src, dst FROM u WHERE src {IN_A} AND dst {IN_B}")
on_layers("cross_link_attribute", lambda g, a, b: I.cross_links(g, a, b), f"SELECT src, dst, {r6('v')} AS v FROM d WHERE src {IN_A} AND dst {IN_B}", True)
PLUS = "SELECT a.src AS id, a.dst AS j FROM up a WHERE a.src {0} AND a.dst {1}"
NID = f"SELECT p.id AS id, sum(n.w) AS value FROM ({PLUS.format(IN_A, IN_A)}) p JOIN n ON n.id = p.j GROUP BY p.id"
NIT = f"SELECT a.src AS id, sum(x.w * y.w) AS t FROM up a JOIN up b ON a.dst = b.src JOIN up c ON c.src = a.src AND c.dst = b.dst JOIN n x ON x.id = a.dst JOIN n y ON y.id = b.dst WHERE a.src {IN_A} AND a.dst {IN_A} AND b.dst {IN_A} GROUP BY 1"
on_layers("nsi_internal_degree", lambda g, a, b: I.nsi_internal_degree(g, a), f"SELECT id, {r6('value')} AS value FROM ({NID})")
on_layers("nsi_internal_local_clustering", lambda g, a, b: I.nsi_internal_local_clustering(g, a), f"SELECT id, {r6('t / (value * value)')} AS value FROM ({NID}) JOIN ({NIT}) USING (id)")
from .catalog import NCD, NCT  # noqa: E402

on_layers("nsi_cross_global_clustering", I.nsi_cross_global_clustering, f"SELECT {r6('sum(w * coalesce(t / nullif(value * value, 0), 0)) / sum(w)')} AS value FROM ({NCD}) LEFT JOIN ({NCT}) USING (id) JOIN n USING (id)")


def on_group_paths(name: str, f: Callable, sql: str) -> None:
    more = f", cd AS (SELECT * FROM dn WHERE src {IN_A} AND dst {IN_B}), ci AS (SELECT * FROM dn WHERE src {IN_A} AND dst {IN_A})"
    add(name, lambda spark, sf: f(D.trade(spark, sf, False), *D.layers(spark, sf)), f"WITH RECURSIVE {D.TRADE}{bfs('u')}{more} {sql}")


M1 = "((SELECT count(*) FROM n) - 1)"
CCL = f"SELECT la.id AS id, (SELECT count(*) FROM lb) / (coalesce(sum(d), 0) + {M1} * ((SELECT count(*) FROM lb) - count(d))) AS value FROM la LEFT JOIN cd ON src = la.id GROUP BY la.id"
on_group_paths("cross_path_lengths", I.cross_path_lengths, "SELECT src, dst, d FROM cd")
on_group_paths("internal_path_lengths", lambda g, a, b: I.internal_path_lengths(g, a), "SELECT src, dst, CASE WHEN src = dst THEN 0.0 ELSE d END AS d FROM ci")
on_group_paths("average_cross_closeness", I.average_cross_closeness, f"SELECT {r6('avg(value)')} AS value FROM ({CCL})")
on_group_paths("cross_global_efficiency", I.cross_global_efficiency, f"SELECT {r6('1 / avg(value)')} AS value FROM (SELECT la.id AS id, coalesce(sum(1 / d), 0) / (SELECT count(*) FROM lb) AS value FROM la LEFT JOIN cd ON src = la.id GROUP BY la.id)")
on_group_paths("internal_average_path_length", lambda g, a, b: I.internal_average_path_length(g, a), f"SELECT {r6('avg(d)')} AS value FROM ci WHERE src <> dst")
on_group_paths("internal_closeness", lambda g, a, b: I.internal_closeness(g, a), f"SELECT la.id AS id, {r6(f'((SELECT count(*) FROM la) - 1) / (coalesce(sum(CASE WHEN src <> dst THEN d END), 0) + {M1} * ((SELECT count(*) FROM la) - count(d)))')} AS value FROM la LEFT JOIN ci ON src = la.id GROUP BY la.id")
NCL = "SELECT la.id AS id, {0} AS value FROM la LEFT JOIN {1} ON src = la.id, (SELECT sum(w) AS wb FROM n JOIN {2} USING (id)) GROUP BY la.id"
_ncl = r6(f"max(wb) / (coalesce(sum(wj * d), 0) + {M1} * (max(wb) - coalesce(sum(wj), 0)))")
on_group_paths("nsi_cross_closeness", I.nsi_cross_closeness, NCL.format(_ncl, "cd", "lb"))
on_group_paths("nsi_internal_closeness", lambda g, a, b: I.nsi_internal_closeness(g, a), NCL.format(_ncl, "ci", "la"))
on_group_paths("nsi_cross_average_path_length", I.nsi_cross_average_path_length, f"SELECT {r6('sum(wi * wj * d) / pow((SELECT sum(w) FROM n JOIN la USING (id)), 2)')} AS value FROM cd")
on_group_paths("nsi_cross_average_path_length_documented", lambda g, a, b: I.nsi_cross_average_path_length(g, a, b, True), f"SELECT {r6('sum(wi * wj * d) / ((SELECT sum(w) FROM n JOIN la USING (id)) * (SELECT sum(w) FROM n JOIN lb USING (id)))')} AS value FROM cd")

# space -----------------------------------------------------------------------------------------

GEOW = min_plus("SELECT src, dst, d AS len FROM ld")
on_geo("average_distance_weighted_path_length", X.average_distance_weighted_path_length, f"SELECT {r6('avg(d)')} AS value FROM wd WHERE src <> dst", more=GEOW)
on_geo("distance_weighted_closeness", X.distance_weighted_closeness, WCLOSE, more=GEOW)
on_geo("local_distance_weighted_vulnerability", X.local_distance_weighted_vulnerability, None)


def on_grid(name: str, f: Callable, sql: str) -> None:
    add(name, lambda spark, sf: f(D.nation_grid(spark, sf)), sql, D.GRID)


on_grid("grid_sequence", lambda g: X.sequence(g, 1), "SELECT node, lon AS value FROM grid")
on_grid("grid_node_coordinates", lambda g: X.node_coordinates(g, 7), "SELECT node, lat, lon FROM grid WHERE node = 7")
on_grid("grid_size", lambda g: X.grid_size(g, g.select((F.col("node") % 10).alias("t"))), "SELECT count(*) AS space, count(DISTINCT node % 10) AS time FROM grid")
on_grid("convert_longitude", lambda g: X.convert_lon(g.withColumn("lon", F.col("lon") + 180)), "SELECT node, lat, CASE WHEN lon + 180 > 180 THEN lon - 180 ELSE lon + 180 END AS lon FROM grid")
on_grid("grid_window", lambda g: X.window(g, -30, 20, -100, 100), "SELECT node AS id FROM grid WHERE lat BETWEEN -30 AND 20 AND lon BETWEEN -100 AND 100")
on_grid("grid_region", lambda g: X.region(g, [(-40.5, -130.5), (-40.5, 60.5), (30.5, 60.5), (30.5, -130.5)]).select("node", F.col("inside").cast("int").alias("inside")), "SELECT node, CAST(lat BETWEEN -40.5 AND 30.5 AND lon BETWEEN -130.5 AND 60.5 AS BIGINT) AS inside FROM grid")
on_grid("grid_trigonometry", lambda g: g.select("node", F.cos(F.radians("lat")).alias("cos_lat"), F.sin(F.radians("lat")).alias("sin_lat"), F.cos(F.radians("lon")).alias("cos_lon"), F.sin(F.radians("lon")).alias("sin_lon")), f"SELECT node, {r6('cos(radians(lat))')} AS cos_lat, {r6('sin(radians(lat))')} AS sin_lat, {r6('cos(radians(lon))')} AS cos_lon, {r6('sin(radians(lon))')} AS sin_lon FROM grid")
on_grid("grid_cartesian", lambda g: g.select("node", X.cartesian(F.col("lat"), F.col("lon")).alias("p")).select("node", "p.x", "p.y", "p.z"), f"SELECT node, {r6('cos(radians(lat)) * sin(radians(lon))')} AS x, {r6('cos(radians(lat)) * cos(radians(lon))')} AS y, {r6('sin(radians(lat))')} AS z FROM grid")
on_grid("node_weights_irrigation", lambda g: X.surface_weights(g, "irrigation"), f"SELECT node AS id, {r6('pow(cos(radians(lat)), 2)')} AS w FROM grid")
on_grid("regular_grid", lambda g: X.regular_grid(g.select("lat"), g.select(F.round("lon", -2).alias("lon"))), "SELECT row_number() OVER (ORDER BY a.lat, b.lon) - 1 AS node, a.lat AS lat, b.lon AS lon FROM (SELECT DISTINCT lat FROM grid) a, (SELECT DISTINCT round(lon, -2) AS lon FROM grid) b")
FLAT = "fl AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey % 7 AS DOUBLE) AS a, CAST(n_nationkey % 5 AS DOUBLE) AS b FROM nation)"
_flat = lambda spark, sf: D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.array((F.col("n_nationkey") % 7).cast("double"), (F.col("n_nationkey") % 5).cast("double")).alias("x"))
add("euclidean_distance", lambda spark, sf: X.euclidean_distance(_flat(spark, sf)), f"SELECT p.node AS i, q.node AS j, {r6('sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2))')} AS d FROM fl p, fl q", FLAT)
add("nearest_point", lambda spark, sf: X.nearest_point(_flat(spark, sf), [3.2, 2.1]), f"SELECT node, {r6('sqrt(pow(a - 3.2, 2) + pow(b - 2.1, 2))')} AS d FROM fl ORDER BY d, node LIMIT 1", FLAT)
add("grid_boundaries_flat", lambda spark, sf: X.boundaries(_flat(spark, sf)), "SELECT 0 AS dimension, min(a) AS min, max(a) AS max FROM fl UNION ALL SELECT 1, min(b), max(b) FROM fl", FLAT)

# networks of fields ----------------------------------------------------------------------------

CNET = CORR + ", n AS (SELECT DISTINCT node AS id FROM obs), ce AS (SELECT i AS src, j AS dst, abs(s) AS len FROM pc WHERE abs(s) > 0.2 AND i <> j)"


def climate_network(o: DataFrame) -> G.Graph:
    sim = durable(S.pearson(S.anomaly(o, 12)).select("i", "j", F.abs("s").alias("s")), "similarity")
    g = S.threshold_network(sim, 0.2)
    return G.Graph(durable(g.nodes, "nodes"), durable(g.edges, "links"), False)


on_months("correlation_weighted_average_path_length", lambda o: K.weighted_average_path_length(climate_network(o), "s"), f"SELECT {r6('avg(d)')} AS value FROM wd WHERE src <> dst", CNET + min_plus("SELECT src, dst, len FROM ce"))
on_months("correlation_weighted_closeness", lambda o: K.weighted_closeness(climate_network(o), "s"), WCLOSE, CNET + min_plus("SELECT src, dst, len FROM ce"))
on_months("correlation_weighted_vulnerability", lambda o: K.weighted_vulnerability(climate_network(o), "s"))


def similarity_and_distance(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    sim = durable(S.pearson(S.anomaly(o, 12)).select("i", "j", F.abs("s").alias("s")), "similarity")
    grid = sim.select(F.col("i").alias("node")).distinct().select("node", (-60.0 + 5 * F.col("node")).alias("lat"), (-180.0 + 14 * F.col("node")).alias("lon"))
    return sim, durable(X.angular_distance(grid), "distance")


PLACED = CORR + ", " + ANGLE + ", sd AS (SELECT pc.i AS i, pc.j AS j, abs(s) AS s, d FROM pc JOIN ad USING (i, j))"
DAMP = "s * 0.5 * (tanh(20 * (d - 0.05)) + 1)"
on_months("non_local_similarity", lambda o: S.non_local(*similarity_and_distance(o)), f"SELECT i, j, {r6(DAMP)} AS s FROM sd", PLACED)
on_months("non_local_network", lambda o: S.non_local_network(*similarity_and_distance(o), 0.2).edges.select("src", "dst"), f"SELECT i AS src, j AS dst FROM sd WHERE i <> j AND {DAMP} > 0.2", PLACED)
on_months("correlation_distance", lambda o: S.correlation_distance(*similarity_and_distance(o)), f"SELECT i, j, {r6('s * d')} AS value FROM sd", PLACED)
on_months("inverse_correlation_distance", lambda o: S.inverse_correlation_distance(*similarity_and_distance(o)), f"SELECT i, j, {r6('CASE WHEN i = j THEN 0 ELSE 1 / (s * d) END')} AS value FROM sd", PLACED)
INVW = PLACED + ", n AS (SELECT DISTINCT node AS id FROM obs)" + min_plus("SELECT i AS src, j AS dst, 1 / (s * d) AS len FROM sd WHERE i <> j AND s > 0.2")
on_months("correlation_distance_weighted_closeness", lambda o: (lambda s, d: K.weighted_closeness(S.correlation_distance_network(S.threshold_network(s, 0.2), s, d), "inv"))(*similarity_and_distance(o)), WCLOSE, INVW)
on_months("pearson_network_by_density", lambda o: (lambda s: S.threshold_network(s, S.threshold_from_link_density(s, 0.1)).edges.select("src", "dst"))(durable(S.pearson(S.anomaly(o, 12)).select("i", "j", F.round(F.abs("s"), 9).alias("s")), "similarity")), "SELECT i AS src, j AS dst FROM pr, (SELECT s AS lim FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM pr) WHERE r = (SELECT floor(0.9 * (c * c - c)) FROM (SELECT count(DISTINCT i) AS c FROM pr))) WHERE i <> j AND s > lim", CORR + ", pr AS (SELECT i, j, round(abs(s), 9) AS s FROM pc)")
COUPLED = CORR + ", u AS (SELECT i AS src, j AS dst FROM pc WHERE s > 0.1 AND i <> j), n AS (SELECT DISTINCT node AS id, 1.0 AS w FROM obs), la AS (SELECT id FROM n WHERE id < 12), lb AS (SELECT id FROM n WHERE id >= 12)"


def coupled(o: DataFrame) -> tuple[G.Graph, DataFrame, DataFrame]:
    first, second = S.anomaly(o.filter("node < 12"), 12), S.anomaly(o.filter("node >= 12"), 12)
    g = K.coupled_network(first, second, 0.1)
    a, b = K.layers(first, second)
    return G.Graph(durable(g.nodes, "nodes"), durable(g.edges, "links"), False), durable(a, "layer"), durable(b, "layer")


def on_coupled(name: str, f: Callable, sql: str, recursive: str = "") -> None:
    add(name, lambda spark, sf: f(*coupled(D.nation_months(spark, sf))), f"WITH {'RECURSIVE ' if recursive else ''}{D.MONTHS}{COUPLED}{recursive} {sql}")


on_coupled("coupled_network", lambda g, a, b: g.edges.select("src", "dst"), "SELECT src, dst FROM u")
on_coupled("coupled_layer_1", lambda g, a, b: K.layer_network(g, a).edges.select("src", "dst"), f"SELECT src, dst FROM u WHERE src {IN_A} AND dst {IN_A}")
on_coupled("coupled_layer_2", lambda g, a, b: K.layer_network(g, b).edges.select("src", "dst"), f"SELECT src, dst FROM u WHERE src {IN_B} AND dst {IN_B}")
on_coupled("coupled_cross_adjacency", lambda g, a, b: I.cross_links(g, a, b).select("src", "dst"), f"SELECT src, dst FROM u WHERE src {IN_A} AND dst {IN_B}")
on_coupled("coupled_cross_degree", I.cross_degree, "SELECT la.id AS id, count(lb.id) AS value FROM la LEFT JOIN u ON src = la.id LEFT JOIN lb ON dst = lb.id GROUP BY la.id")
on_coupled("coupled_internal_degree", lambda g, a, b: I.internal_degree(g, b), "SELECT lb.id AS id, count(x.id) AS value FROM lb LEFT JOIN u ON src = lb.id LEFT JOIN lb x ON dst = x.id GROUP BY lb.id")
on_coupled("coupled_internal_link_density", lambda g, a, b: I.internal_link_density(g, b), f"SELECT {r6(f'(SELECT count(*) FROM u WHERE src {IN_B} AND dst {IN_B}) / (count(*) * (count(*) - 1))')} AS value FROM lb")
on_coupled("coupled_cross_link_density", I.cross_link_density, f"SELECT {r6(f'(SELECT count(*) FROM u WHERE src {IN_A} AND dst {IN_B}) / ((SELECT count(*) FROM la) * count(*))')} AS value FROM lb")
on_coupled("coupled_number_cross_links", I.number_cross_links, f"SELECT count(*) AS value FROM u WHERE src {IN_A} AND dst {IN_B}")
on_coupled("coupled_number_internal_links", lambda g, a, b: I.number_internal_links(g, b), f"SELECT count(*) // 2 AS value FROM u WHERE src {IN_B} AND dst {IN_B}")
_cl = "SELECT src, dst FROM u WHERE src IN (SELECT id FROM la) AND dst IN (SELECT id FROM lb)"
_ct = f"SELECT a.src AS id, count(*) AS t FROM ({_cl}) a JOIN ({_cl}) b ON a.src = b.src AND a.dst < b.dst JOIN u ON u.src = a.dst AND u.dst = b.dst GROUP BY 1"
_ck = f"SELECT la.id AS id, count(dst) AS k FROM la LEFT JOIN ({_cl}) ON src = la.id GROUP BY la.id"
on_coupled("coupled_cross_local_clustering", I.cross_local_clustering, f"SELECT id, {r6('coalesce(2 * t / nullif(k * (k - 1), 0), 0)')} AS value FROM ({_ck}) LEFT JOIN ({_ct}) USING (id)")
on_coupled("coupled_cross_global_clustering", I.cross_global_clustering, f"SELECT {r6('avg(coalesce(2 * t / nullif(k * (k - 1), 0), 0))')} AS value FROM ({_ck}) LEFT JOIN ({_ct}) USING (id)")
on_coupled("coupled_cross_transitivity", I.cross_transitivity, f"SELECT {r6('coalesce(sum(coalesce(t, 0)) / nullif(sum(k * (k - 1) / 2), 0), 0)')} AS value FROM ({_ck}) LEFT JOIN ({_ct}) USING (id)")
_dist = bfs("u")
on_coupled("coupled_cross_path_lengths", I.cross_path_lengths, f"SELECT src, dst, d FROM dist WHERE src {IN_A} AND dst {IN_B}", _dist)
on_coupled("coupled_internal_path_lengths", lambda g, a, b: I.internal_path_lengths(g, b), f"SELECT src, dst, d FROM dist WHERE src {IN_B} AND dst {IN_B}", _dist)
on_coupled("coupled_cross_average_path_length", I.cross_average_path_length, f"SELECT {r6('avg(d)')} AS value FROM dist WHERE src {IN_A} AND dst {IN_B}", _dist)
on_coupled("coupled_internal_average_path_length", lambda g, a, b: I.internal_average_path_length(g, b), f"SELECT {r6('avg(d)')} AS value FROM dist WHERE src {IN_B} AND dst {IN_B} AND src <> dst", _dist)
on_coupled("coupled_cross_closeness", I.cross_closeness, f"SELECT la.id AS id, {r6('(SELECT count(*) FROM lb) / (coalesce(sum(d), 0) + ((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM lb) - count(d)))')} AS value FROM la LEFT JOIN (SELECT * FROM dist WHERE dst {IN_B}) ON src = la.id GROUP BY la.id", _dist)
on_coupled("coupled_internal_closeness", lambda g, a, b: I.internal_closeness(g, a), f"SELECT la.id AS id, {r6('((SELECT count(*) FROM la) - 1) / (coalesce(sum(d), 0) + ((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM la) - count(d)))')} AS value FROM la LEFT JOIN (SELECT * FROM dist WHERE dst {IN_A}) ON src = la.id GROUP BY la.id", _dist)
_bt = _dist + WALKS.format(e="u") + f", th AS ({THROUGH})"
on_coupled("coupled_cross_betweenness", I.cross_betweenness, passing("t.share", f"x {IN_A} AND y {IN_B}"), _bt)
on_coupled("coupled_internal_betweenness", lambda g, a, b: I.internal_betweenness(g, b), passing("t.share", f"x {IN_B} AND y {IN_B}"), _bt)
on_months("coupled_similarity_1", lambda o: (lambda a, b: K.layer_similarity(S.pearson(S.anomaly(o, 12)), *([K.layers(a, b)[0]] * 2)))(o.filter("node < 12"), o.filter("node >= 12")), f"SELECT i, j, {r6('s')} AS s FROM pc WHERE i < 12 AND j < 12", CORR)
on_months("coupled_similarity_2", lambda o: (lambda a, b: K.layer_similarity(S.pearson(S.anomaly(o, 12)), *([K.layers(a, b)[1]] * 2)))(o.filter("node < 12"), o.filter("node >= 12")), f"SELECT i, j, {r6('s')} AS s FROM pc WHERE i >= 12 AND j >= 12", CORR)


def _link_distance(spark: SparkSession, sf: str) -> DataFrame:
    g, a, b = coupled(D.nation_months(spark, sf))
    return K.cross_average_link_distance(g, a, b, X.angular_distance(D.nation_grid(spark, sf)))


add("coupled_cross_average_link_distance", _link_distance, f"WITH {D.MONTHS}{COUPLED}, {ANGLE} SELECT la.id AS id, {r6('coalesce(avg(d), 0)')} AS value FROM la LEFT JOIN (SELECT u.src AS src, d FROM u JOIN ad ON i = src AND j = dst WHERE dst {IN_B}) ON src = la.id GROUP BY la.id")

# models ----------------------------------------------------------------------------------------

on_trade("grow_weights", lambda g: M.grow_weights(g.nodes.sparkSession, g.nodes.count()))
on_trade("set_cross_links", lambda g: M.set_cross_links(g, g.nodes.filter("id < 10"), g.nodes.filter("id >= 10"), 0.2).edges.select("src", "dst"))
on_trade("rewired_cross_links", lambda g: M.rewired_cross_links(g, g.nodes.filter("id < 10"), g.nodes.filter("id >= 10"), 20).edges.select("src", "dst"))
for _k in (1, 2, 3):
    on_geo(f"rewire_by_distance_{_k}", lambda g, x, k=_k: M.rewire_by_distance(g, x, 10, 1.0, k).edges.select("src", "dst"), None)
add("links_by_distance", lambda spark, sf: M.links_by_distance(X.angular_distance(D.nation_grid(spark, sf)), 0.0, -2.0))
add("erdos_renyi_links", lambda spark, sf: M.erdos_renyi(spark, D.table(spark, sf, "nation").count(), n_links=60).edges.select("src", "dst"))
