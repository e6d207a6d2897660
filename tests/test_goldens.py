"""Established values of the six-node graphs, grids, circuits, fields and series; fixed values, as given."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import climate as K
from skein.operators import clustering as C
from skein.operators import coupling as Q
from skein.operators import dense as N
from skein.operators import events as E
from skein.operators import graph as G
from skein.operators import interacting as I
from skein.operators import models as M
from skein.operators import paths as P
from skein.operators import recurrence as R
from skein.operators import series as S
from skein.operators import spatial as X
from skein.operators import surrogates as U
from skein.operators import visibility as V


def col(df, name="value", key="id"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r[key])]


def one(df, name="value"):
    return df.first()[name]


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def matrix(df, n, name="value", rows=("i", "j")):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r[rows[0]], r[rows[1]]] = r[name]
    return out


def near(got, want, tol=1e-4):
    assert np.allclose(np.array(got, float), np.array(want, float), atol=tol), (got, want)


@pytest.fixture(scope="module")
def g(spark):
    return G.Graph.small(spark)


@pytest.fixture(scope="module")
def d(spark):
    return G.Graph.small(spark, directed=True)


def test_degrees(g, d):
    near(col(G.nsi_degree(g), "k"), [8.4, 8.0, 5.9, 5.3, 7.4, 4.0])
    near(col(G.nsi_degree(g, 2.0), "k"), [3.2, 3.0, 1.95, 1.65, 2.7, 1.0])
    near(col(G.nsi_in_degree(d), "k_in"), [6.3, 5.3, 5.9, 3.6, 4.0, 2.5])
    near(col(G.nsi_out_degree(d, 2.0), "k_out"), [1.65, 1.95, -0.05, 0.9, 1.85, 1.0])
    near(col(G.nsi_bilateral_degree(d), "k_bil"), [1.5, 1.7, 1.9, 2.1, 2.3, 2.5])
    near(matrix(G.nsi_laplacian(g), 6)[1], [0, 6.3, -1.9, -2.1, -2.3, 0])
    near(col(G.degree_distribution(g), "share", "bin"), [0.16666667, 0.33333333, 0.5])
    near(col(G.degree_distribution(g, "in"), "share", "bin"), [0.16666667, 0.33333333, 0.5])
    near(col(G.degree_distribution(g, "out"), "share", "bin"), [0.16666667, 0.0, 0.33333333, 0.5])
    near(col(G.degree_cdf(g), "cdf", "bin"), [1.0, 0.83333333, 0.5])
    near(col(G.degree_cdf(g, "in"), "cdf", "bin"), [1.0, 0.83333333, 0.83333333, 0.5])
    near(col(G.nsi_degree_histogram(g), "share", "bin"), [0.33333333, 0.16666667, 0.5])
    near(col(G.nsi_degree_histogram(g), "lower", "bin"), [4.0, 5.46666667, 6.93333333])
    near(col(G.neighbor_degrees(g), "k_mean"), [2.0, 2.33333333, 3.0, 3.0, 2.66666667, 3.0])
    near(col(G.nsi_neighbor_degrees(g), "k_mean"), [6.0417, 6.62, 7.0898, 7.0434, 7.3554, 5.65])
    assert one(G.assortativity(g), "r") == pytest.approx(-0.47368421)
    assert G.summary(g) == "undirected, 6 nodes, 7 links, link density 0.467"
    with pytest.raises(ValueError):
        G.laplacian(g, "some_other")


def test_pairs(g, d):
    want = [[1, 0.5, 0.25, 0, 0, 0], [0.5, 1, 0.25, 0, 0.2, 0], [0.25, 0.25, 1, 1 / 3, 0.25, 0], [0, 0, 1 / 3, 1, 2 / 3, 0.5], [0, 0.2, 0.25, 2 / 3, 1, 1 / 3], [0, 0, 0, 0.5, 1 / 3, 1]]
    near(matrix(G.matching_index(g), 6), want)
    assert G.matching_index(g, all_pairs=True).count() == 36
    want = [[0.12931034, 0.45689655, 0, 0.31034483, 0, 0], [0, 0.15178571, 0.52678571, 0, 0.35714286, 0], [0, 0, 0.24358974, 0, 0, 0], [0, 0.33928571, 0, 0.28378378, 0, 0], [0.32758621, 0, 0.43298969, 0, 0.2371134, 0], [0.34482759, 0, 0, 0, 0, 0.38461538]]
    near(matrix(G.nsi_twinness(d), 6), want)


MOTIFS = {"cycle": [0.25, 0.25, 0, 0, 0.5, 0], "mid": [0, 0, 0, 1, 0.5, 0], "in": [0, 0.5, 0.5, 0, 0, 0], "out": [0.5, 0.5, 0, 0, 0, 0]}
NSI_MOTIFS = {
    "cycle": [0.18448637, 0.20275024, 0.3220339, 0.32236842, 0.34385965, 0.625],
    "mid": [0.45372866, 0.51646946, 1, 1, 0.88815789, 1],
    "in": [0.52884858, 0.66998932, 0.66934789, 0.75694444, 0.755625, 1],
    "out": [0.66998932, 0.66934789, 1, 0.75277008, 0.58387196, 0.765625],
}


@pytest.mark.parametrize("motif", list(MOTIFS))
def test_motifs(d, motif):
    near(col(C.local_motif_clustering(d, motif)), MOTIFS[motif])
    near(col(C.nsi_local_motif_clustering(d, motif)), NSI_MOTIFS[motif])
    # against products of matrices, with link values
    a = matrix(d.edges, 6, "weight", ("src", "dst"))
    m, w = np.cbrt(a), 1.5 + 0.2 * np.arange(6)
    ways = {"cycle": lambda x, y: x @ x @ x, "mid": lambda x, y: x @ y @ x, "in": lambda x, y: y @ x @ x, "out": lambda x, y: x @ x @ y}
    plain = (a > 0).astype(float)
    k_in, k_out, k_bil = plain.sum(0), plain.sum(1), np.diag(plain @ plain)
    wedges = {"in": k_in * (k_in - 1), "out": k_out * (k_out - 1)}.get(motif, k_in * k_out - k_bil)
    t = np.diag(ways[motif](m, m.T))
    near(col(C.local_motif_clustering(d, motif, "weight")), np.divide(t, wedges, out=np.zeros(6), where=wedges > 0))
    t = np.diag(ways[motif](m * w, m.T * w)) / w
    plus = plain + np.eye(6)
    n_in, n_out = w @ plus, plus @ w
    wedges = {"in": n_in**2, "out": n_out**2}.get(motif, n_in * n_out)
    near(col(C.nsi_local_motif_clustering(d, motif, "weight")), t / wedges)


def test_clustering(g, d):
    near(col(C.nsi_local_motif_clustering(d, "cycle", None, 2.0)), [0.3309814, 0.29011913, 0.05236908, -0.0260989, 0.22417582, -0.13636364])
    near(col(C.nsi_local_motif_clustering(d.splitted(4, 6), "mid").filter("id in (3, 5)")), [1, 1])
    near(col(C.local_motif_clustering(d.splitted(4, 6), "mid")), [0, 0, 0, 1, 0.8, 0, 0.8])
    assert one(C.transitivity(g)) == pytest.approx(0.27272727)
    near(col(C.nsi_local_clustering(g)), [0.55130385, 0.724375, 1, 0.81844073, 0.80277575, 1])
    near(col(C.nsi_local_clustering(g, 3.0)), [-1.44290123, -0.764, 1, 4.16770186, -0.75324675, 1])
    assert one(C.nsi_global_clustering(g)) == pytest.approx(0.83529192)
    near(col(C.nsi_local_soffer_clustering(g)), [0.76650246, 0.87537764, 1, 0.81844073, 0.84685032, 1])
    a = [(0, 3, 0.55), (0, 4, 0.65), (0, 5, 0.75), (1, 2, 0.63), (1, 3, 0.77), (1, 4, 0.91), (2, 4, 1.17)]
    weighted = G.Graph.of(g.nodes.sparkSession.createDataFrame(a, "src long, dst long, a double"))
    near(col(C.weighted_local_clustering(weighted, "a")), [0, 0.21487603, 0.35388889, 0, 0.15384615, 0])
    with pytest.raises(ValueError):
        C.higher_order_transitivity(g, 2)
    with pytest.raises(NotImplementedError):
        C.higher_order_transitivity(g, 5)


def test_higher_order_transitivity(spark):
    # two 4-cliques sharing a node, and a tail
    e = [(a, b) for q in ((0, 1, 2, 3), (3, 4, 5, 6)) for a in q for b in q if a < b] + [(6, 7)]
    h = G.Graph.of(spark.createDataFrame(e, "src long, dst long"))
    k = [3, 3, 3, 6, 3, 3, 4, 1]
    assert one(C.higher_order_transitivity(h)) == pytest.approx(8 / sum(x * (x - 1) * (x - 2) / 6 for x in k))
    assert 0 <= one(C.higher_order_transitivity(h, 4, 0.5)) <= 1


def test_paths(g):
    dist = P.path_lengths(g)
    near(matrix(P.link_betweenness(g), 6, "value", ("src", "dst")), [[0, 0, 0, 3.5, 5.5, 5], [0, 0, 2, 3.5, 2.5, 0], [0, 2, 0, 0, 3, 0], [3.5, 3.5, 0, 0, 0, 0], [5.5, 2.5, 3, 0, 0, 0], [5, 0, 0, 0, 0, 0]])
    near(col(P.eigenvector_centrality(g)), [0.7895106, 0.97303126, 0.77694188, 0.69405519, 1, 0.31089413])
    near(col(P.eigenvector_centrality(g, True)), [0.80454492, 1, 0.80931481, 0.61787145, 0.98666885, 0.28035747])
    near(col(P.nsi_closeness(g, dist)), [0.76923077, 0.64864865, 0.58252427, 0.64171123, 0.72289157, 0.50847458])
    near(col(P.nsi_closeness(g, dist, "harmonic")), [0.85, 0.79861111, 0.71111111, 0.72083333, 0.80833333, 0.61666667])
    near(col(P.nsi_closeness(g, dist, "exponential")), [0.425, 0.390625, 0.346875, 0.36041667, 0.40416667, 0.29583333])
    assert one(P.global_efficiency(g, dist)) == pytest.approx(0.71111111)
    assert one(P.nsi_global_efficiency(g, dist)) == pytest.approx(0.74152777)
    near(col(P.local_vulnerability(g)), [0.296875, 0.0625, -0.03125, -0.0078125, 0.09765625, -0.125])
    near(col(P.local_vulnerability(g, most_rows=100)), [0.296875, 0.0625, -0.03125, -0.0078125, 0.09765625, -0.125])
    assert one(P.diameter(dist)) == one(P.diameter(dist, g)) == 3
    m = P.distance_based_measures(g, dist)
    near(col(m, "nsi_harmonic"), [0.85, 0.79861111, 0.71111111, 0.72083333, 0.80833333, 0.61666667])
    t = P.distance_based_totals(g, m).first()
    assert (t.average_path_length, t.global_efficiency, t.nsi_average_path_length, t.nsi_global_efficiency) == pytest.approx((1.66666667, 0.71111111, 1.60027778, 0.74152777))


def test_random_walks(g):
    near(col(N.arenas_betweenness(g)), [50.18181818, 50.18181818, 33.45454545, 33.45454545, 50.18181818, 16.72727273])
    near(col(N.newman_betweenness(g)), [4.1818182, 3.41818185, 2.5090909, 3.0181818, 3.60000002, 2.0])
    near(col(N.newman_betweenness(g.splitted(5, 6))), [5.2626, 3.5152, 2.5455, 3.2121, 3.8182, 2.5556, 2.5556])
    want = [20.58135241, 29.21033898, 27.00747741, 19.5433536, 25.28490117, 24.84826305]
    near(col(N.nsi_arenas_betweenness(g)), want)
    near(col(N.nsi_arenas_betweenness(g.splitted(5, 6))), [*want, 24.84826305])
    near(col(N.nsi_arenas_betweenness(g, exclude_neighbors=False)), [44.53512333, 37.40578733, 27.00747741, 21.77360559, 31.32557606, 24.84826305])
    near(col(N.nsi_arenas_betweenness(g, stopping_mode="twinness")), [22.61533156, 41.23139296, 38.64105931, 28.61953314, 38.58242175, 30.29941829])
    near(col(N.nsi_newman_betweenness(g)), [0.40476082, 0, 0.85212808, 3.33573728, 1.36618345, 0])
    near(col(N.nsi_newman_betweenness(g.splitted(5, 6), True)), [131.44476082, 128, 107.64212808, 102.44573728, 124.20618345, 80, 80])
    assert one(N.msf_synchronizability(g)) == pytest.approx(6.77842586)
    near(col(N.spreading(g, nsi=True)), [8.31, 8.39, 6.42, 5.67, 8.17, 3.76], 1e-2)


def test_circuits(spark):
    c = N.small_circuit(spark)
    r = [[2.28444444, 0.68444444, -0.56, -0.20444444, -2.20444444], [0.68444444, 1.08444444, -0.16, 0.19555556, -1.80444444], [-0.56, -0.16, 3.04, -0.16, -2.16], [-0.20444444, 0.19555556, -0.16, 1.08444444, -0.91555556], [-2.20444444, -1.80444444, -2.16, -0.91555556, 7.08444444]]
    near(matrix(N.pseudo_inverse(c, "r"), 5), r)
    near(matrix(N.admittance_laplacian(c, "r"), 5), [[0.5, -0.5, 0, 0, 0], [-0.5, 1.125, -0.125, -0.5, 0], [0, -0.125, 0.25, -0.125, 0], [0, -0.5, -0.125, 0.725, -0.1], [0, 0, 0, -0.1, 0.1]])
    near(col(N.admittive_degree(c, "r")), [0.5, 1.125, 0.25, 0.725, 0.1])
    near(col(N.neighbors_admittive_degree(c, "r")), [2.25, 1.31111111, 7.4, 2.03448276, 7.25])
    near(col(N.local_admittive_clustering(c, "r")), [0, 0.00694444, 0.0625, 0.01077586, 0])
    assert one(N.global_admittive_clustering(c, "r")) == pytest.approx(0.016, abs=1e-4)
    er = N.effective_resistance(c, "r")
    near(matrix(er, 5)[1, 1:3], [0, 4.4444])
    assert one(N.average_effective_resistance(er)) == pytest.approx(7.2889, abs=1e-4)
    assert one(N.diameter_effective_resistance(er)) == pytest.approx(14.4444, abs=1e-4)
    near(np.array(col(N.effective_resistance_closeness(er)))[[0, 4]], [0.1538, 0.08])
    near(np.array(col(N.vertex_current_flow_betweenness(c, "r")))[1:3], [0.3889, 0.0444])
    near(matrix(N.edge_current_flow_betweenness(c, "r"), 5, "value", ("src", "dst")), [[0, 0.4, 0, 0, 0], [0.4, 0, 0.2444, 0.5333, 0], [0, 0.2444, 0, 0.2444, 0], [0, 0.5333, 0.2444, 0, 0.4], [0, 0, 0, 0.4, 0]])
    z = N.small_circuit(spark, True)
    y = N.admittance(z, "r", "x")
    near(matrix(y, 5, "re"), [[0, 0.1, 0, 0, 0], [0.1, 0, 0.0625, 0.25, 0], [0, 0.0625, 0, 0.0625, 0], [0, 0.25, 0.0625, 0, 0.05], [0, 0, 0, 0.05, 0]])
    near(matrix(y, 5, "im"), [[0, -0.2, 0, 0, 0], [-0.2, 0, -0.0625, -0.25, 0], [0, -0.0625, 0, -0.0625, 0], [0, -0.25, -0.0625, 0, -0.05], [0, 0, 0, -0.05, 0]])
    e = {(x.i, x.j): (x.re, x.im) for x in N.effective_impedance(z, "r", "x").collect()}
    assert e[0, 1] == pytest.approx((2, 4)) and e[3, 4] == pytest.approx((10, 10))


def test_interacting(spark):
    w = spark.createDataFrame([(i, 0.6 + 0.2 * i) for i in range(6)], "id long, w double")
    g = G.Graph(w, G.Graph.small(spark).edges, False)
    d = G.Graph(w, G.Graph.small(spark, True).edges, True)
    i = lambda *x: ids(spark, *x)
    a, b, c, e = i(0, 3, 5), i(1, 2, 4), i(0, 5), i(1, 2, 3, 4)
    assert (one(I.number_cross_links(g, a, b)), one(I.number_internal_links(g, a)), one(I.number_internal_links(g, b))) == (2, 2, 3)
    assert (one(I.total_cross_degree(g, a, b)), one(I.total_cross_degree(g, c, e))) == pytest.approx((2 / 3, 1.0))
    near(col(I.cross_degree_density(g, a, b)), [1 / 3, 1 / 3, 0])
    assert (one(I.cross_link_density(g, a, b)), one(I.internal_link_density(g, e))) == pytest.approx((2 / 9, 2 / 3))
    assert (one(I.internal_global_clustering(g, b)), one(I.cross_global_clustering(g, i(3, 4), i(1, 2))), one(I.cross_transitivity(g, i(2), i(1, 3, 4)))) == pytest.approx((5 / 9, 0.5, 1.0))
    near(matrix(I.internal_path_lengths(g, a), 6, "d", ("src", "dst"))[5, [0, 3, 5]], [1, 2, 0])
    assert (one(I.cross_average_path_length(g, a, b)), one(I.internal_average_path_length(g, a))) == pytest.approx((2.0, 4 / 3))
    assert (one(I.average_cross_closeness(g, c, e)), one(I.cross_global_efficiency(g, c, e))) == pytest.approx((0.5333, 1.7143), abs=1e-4)
    near(col(I.cross_degree(d, i(1, 2), i(0, 3, 4), direction="in")), [2, 1])
    near(col(I.cross_degree(d, i(1, 2), i(0, 3, 4), direction="out")), [1, 0])
    near(col(I.internal_degree(d, a)), [2, 1, 1])
    near(col(I.internal_degree(d, i(0, 1, 3), direction="in")), [0, 2, 1])
    near(col(I.cross_local_clustering(g, i(3, 4), i(1, 2))), [0, 1])
    near(col(I.internal_closeness(g, a)), [1, 2 / 3, 2 / 3])
    near(col(I.internal_betweenness(g, i(*range(6)))), [9, 3, 0, 2, 6, 0])
    near(col(I.local_efficiency(g, c, e)), [0.75, 0.41666667])
    f, h = i(0, 1, 2), i(3, 4, 5)
    near(col(I.nsi_cross_degree(g, f, h)), [4.2, 2.6, 1.4])
    assert (one(I.nsi_cross_mean_degree(g, f, h)), one(I.nsi_cross_mean_degree(g, i(0, 2, 5), i(1, 4)))) == pytest.approx((2.5, 0.95))
    near(col(I.nsi_internal_degree(g, i(0, 1, 3, 5))), [3.4, 2.0, 2.6, 2.2])
    near(col(I.nsi_cross_local_clustering(g, f, h)), [0.33786848, 0.50295858, 1])
    near(col(I.nsi_cross_closeness(g, f, h)), [1, 0.56756757, 0.48837209])
    near(col(I.nsi_internal_closeness(g, i(0, 1, 3, 5))), [0.84, 0.525, 0.72413793, 0.6])
    assert one(I.nsi_cross_global_clustering(g, f, h)) == pytest.approx(0.6688, abs=1e-4)
    near(col(I.nsi_internal_local_clustering(g, i(1, 2, 3, 5))), [0.73333333, 1, 1, 1])
    near(col(I.nsi_cross_betweenness(g, i(0, 4, 5), i(1, 3))), [6.5333, 1.2, 0, 0.6769, 0.6769, 0])
    assert (one(I.nsi_cross_edge_density(g, i(1, 2, 3), c)), one(I.nsi_cross_edge_density(g, i(0), i(1, 4, 5)))) == pytest.approx((0.1091, 0.7895), abs=1e-4)
    assert (one(I.nsi_cross_transitivity(g, i(1, 2), i(0, 3, 4, 5))), one(I.nsi_cross_transitivity(g, i(0, 2, 3), i(1)))) == pytest.approx((0.6352, 1.0), abs=1e-4)


def test_geography(spark):
    grid = X.small_grid(spark)
    g = G.Graph(X.surface_weights(grid), G.Graph.small(spark).edges.select("src", "dst"), False)
    near(col(X.geometric_distance_distribution(grid, 3), "share", "bin"), [0.3333, 0.4667, 0.2])
    near(col(X.geometric_distance_distribution(grid, 3), "lower", "bin"), [0, 0.1616, 0.3231])
    for way in ("both", "in", "out"):
        near(col(X.area_weighted_connectivity(g, way)), [0.48540673, 0.4989577, 0.33418113, 0.34459165, 0.51459336, 0.17262428])
        near(col(X.average_link_distance(g, grid, way)), [0.3884563, 0.19434186, 0.14557932, 0.24325928, 0.29118925, 0.48467883])
        near(col(X.total_link_distance(g, grid, way)), [0.1885593, 0.09696837, 0.04864986, 0.08382512, 0.14984406, 0.08366733])
        near(col(X.connectivity_weighted_distance(g, grid, way)), [0.0625227, 0.03207134, 0.02408994, 0.04192858, 0.0500332, 0.08366733])
    near(col(X.average_link_distance(g, grid, geometry_corrected=True))[:-1], [1.5987561, 1.0920637, 1.00011046, 1.67081917, 1.63841055], 2e-3)  # the established ones are in single precision
    near(col(X.max_link_distance(g, grid)), [0.48467883, 0.2911402, 0.19376467, 0.2920272, 0.38866287, 0.48467883])
    n = X.neighbor_connectivity(g)
    near(col(n, "mean"), [0.3439364, 0.39778873, 0.5067755, 0.4921822, 0.4395152, 0.48540673])
    near(col(n, "largest"), [0.51459336, 0.51459336, 0.51459336, 0.49895769, 0.49895769, 0.48540673])
    k = G.degree(g).select("id", F.col("k").cast("double").alias("value"))
    near(col(X.weighted_distribution(g, k, 3), "share", "bin"), [0.15645071, 0.33674395, 0.50680541])
    near(col(X.cumulative_weighted_distribution(g, k, 3), "cdf", "bin"), [1.0, 0.84354936, 0.50680541])
    near(col(X.weighted_distribution(g, X.area_weighted_connectivity(g), 4), "share", "bin"), [0.15645071, 0.33674395, 0.34459165, 0.16221375])
    for h in (grid, X.small_grid(spark, False)):
        near(col(X.link_distance_distribution(g, h, 4), "share", "bin"), [0.14285714, 0.28571429, 0.28571429, 0.28571429])
        near(col(X.link_distance_distribution(g, h, 4, True), "share", "bin"), [0.09836066, 0.24590164, 0.32786885, 0.32786885])
    assert one(X.average_distance_weighted_path_length(g, grid)) == pytest.approx(0.49846491, abs=1e-4)
    near(col(X.distance_weighted_closeness(g, grid)), [2.23782229, 2.45008978, 2.23956348, 2.45008978, 2.2396005, 1.19817005])
    near(col(X.local_distance_weighted_vulnerability(g, grid)), [0.03252519, 0.3136603, 0.20562718, 0.02799094, -0.02828809, -0.28798557])
    near(col(X.local_geographical_clustering(g, grid)), [0, 0.0998, 0.1489, 0, 0.2842, 0])
    flat = X.small_grid(spark, False)
    near(col(X.average_link_distance(g, flat, geometry_corrected=True))[:-1], [1.6, 1.09090909, 1, 1.66666667, 1.63636357])


def test_grids(spark):
    grid, flat = X.small_grid(spark), X.small_grid(spark, False)
    assert one(X.nearest_node(grid, 14.0, 9.0), "node") == one(X.nearest_point(flat, [14.0, 9.0]), "node") == 3
    assert X.node_coordinates(flat, 3).first().x == [15.0, 10.0]
    near(matrix(X.euclidean_distance(flat), 6, "d")[0], [0, 5.59, 11.18, 16.77, 22.36, 27.95], 0.01)
    near(matrix(X.angular_distance(grid), 6, "d")[0], [0, 0.1, 0.19, 0.29, 0.39, 0.48], 0.01)
    axis = lambda *v: spark.createDataFrame(list(enumerate(v)), "position long, x double")
    assert [r.x for r in X.axis_product(axis(0.0, 5.0), axis(1.0, 2.0)).orderBy("node").collect()] == [[0, 1], [0, 2], [5, 1], [5, 2]]
    r = X.regular_grid(spark.createDataFrame([(0.0,), (5.0,)], "lat double"), spark.createDataFrame([(1.0,), (2.0,)], "lon double"))
    assert (col(r, "lat", "node"), col(r, "lon", "node")) == ([0, 0, 5, 5], [1, 2, 1, 2])
    assert X.grid_size(grid, spark.range(10).toDF("t")).first().asDict() == {"space": 6, "time": 10}
    assert [x.inside for x in X.region(grid, [(0.0, 0.0), (11.0, 0.0), (11.0, 11.0), (0.0, 11.0)]).orderBy("node").collect()][3:] == [False] * 3
    p = grid.select(X.geographic(X.cartesian(F.col("lat"), F.col("lon"))).alias("p"), "lat", "lon").collect()
    assert all(q.p.lat == pytest.approx(q.lat, abs=1e-9) and q.p.lon == pytest.approx(q.lon) for q in p)
    assert X.named_region(grid, "NINO34").filter("inside").count() == 0
    assert [x.id for x in X.window(grid, 10, 20, 5, 10).orderBy("id").collect()] == [2, 3]


SIM = [[1, 0.1, 0.2, 0.6, 0.7, 0.55], [0.1, 1, 0.55, 0.9, 1.0, 0.3], [0.2, 0.55, 1, 0.1, 0.8, 0.1], [0.6, 0.9, 0.1, 1, 0.1, 0.3], [0.7, 1.0, 0.8, 0.1, 1, 0.4], [0.55, 0.3, 0.1, 0.3, 0.4, 1]]


def test_climate(spark):
    f = S.small_field(spark)
    pc = S.pearson(S.anomaly(f, 5))
    near(matrix(pc, 6, "s")[0], [1, -0.2538, -1, 0.2538, 1, -0.2538])
    net = S.threshold_network(pc.select("i", "j", F.abs("s").alias("s")), 0.5)
    assert one(K.weighted_average_path_length(net, "s")) == pytest.approx(1.0, abs=1e-4)
    near(col(K.weighted_closeness(net, "s")), [0.25] * 6)
    near(col(K.weighted_vulnerability(net, "s")), [0.0] * 6)
    mean = {(r.node, r.phase): r["mean"] for r in S.phase_mean(f, 5).collect()}
    near([mean[0, p] for p in range(5)], [0.5, 0.63, 0.6984, 0.6984, 0.63])
    assert [r.t for r in S.selected_phases(f.select("t"), 5, [0, 1, 4]).orderBy("t").collect()] == [0, 1, 4, 5, 6, 9]
    with pytest.raises(ValueError):
        S.selected_months(f.select("t"), 5, [0])
    assert S.next_power_2(253) == 256
    z = S.zero_pad(spark.createDataFrame([(0, t, float(t + 1)) for t in range(5)], "node long, t long, x double")).orderBy("t")
    assert [r.x for r in z.collect()] == [0, 1, 2, 3, 4, 5, 0, 0]
    c = S.cos_window(spark.range(12).select(F.lit(0).alias("node"), F.col("id").alias("t")), 0.75).orderBy("t")
    near([r.taper for r in c.collect()], [0, 0.14644661, 0.5, 0.85355339, 1, 1, 1, 1, 0.85355339, 0.5, 0.14644661, 0])
    for kind in ("int32", "int16", "uint8"):
        for r, x in zip(S.rescale(f, kind).orderBy("node", "t").collect(), f.orderBy("node", "t").collect(), strict=True):
            assert abs(r.x * r.scale_factor + r.add_offset - x.x) <= r.scale_factor
    h = K.hilbert_coherence(f)
    near(np.diag(matrix(h, 6, "s")), [10 / 9] * 6)
    assert K.hilbert_network(h, 0.5).edges.count() <= 30


def test_similarity_networks(spark):
    sim = spark.createDataFrame([(i, j, float(SIM[i][j])) for i in range(6) for j in range(6)], "i long, j long, s double")
    grid = X.small_grid(spark)
    dist = X.angular_distance(grid)
    assert one(S.threshold_from_link_density(sim, 0.5), "threshold") == pytest.approx(0.4)
    near(col(S.link_density_function(sim, 5), "density", "bin"), [0, 0.2778, 0.4444, 0.6111, 0.7222])
    g = S.threshold_network(sim, 0.5)
    assert S.non_local_network(sim, dist, 0.5).edges.count() <= g.edges.count()
    v = S.correlation_distance_network(g, sim, dist)
    assert len(col(K.weighted_closeness(v, "inv"))) == 6


def test_correlation_strength():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3, 50))
    z = K.tapered(x, 0.2)
    n, m = z.shape[1], 6
    assert n == 64
    circular = lambda a, b, k: sum(a[t] * b[(t + k) % n] for t in range(n)) / n
    lags = [*range(-m, -1), *range(m)]
    c = np.abs([circular(z[0], z[1], k) for k in lags])
    y = np.fft.ifft(z, axis=1)
    got = np.real(np.fft.fft(np.conj(y[0]) * y[1]))
    near(np.abs(np.concatenate((got[-m:-1], got[:m]))), c, 1e-9)


def test_rainfall(spark):
    rng = np.random.default_rng(1)
    x = np.maximum(rng.standard_normal((4, 30)), 0)
    obs = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(4) for t in range(30)], "node long, t long, x double")
    s = np.sort(x.ravel())
    want = (x >= s[int(120 * 0.6)]) & (x <= s[int(120 * 0.95) - 1]) & (x != 0)
    got = np.zeros((4, 30), bool)
    for r in K.top_events(obs, 0.6, 0.95).collect():
        got[r.node, r.t] = r.hit
    assert (got == want).all()
    ranks = np.stack([np.lexsort((np.arange(30), v)).argsort() + 1.0 for v in x])
    sim = matrix(K.rainfall_similarity(obs, obs, 0.6, 0.95), 4, "s")
    for i in range(4):
        for j in range(4):
            u = want[i] | want[j]
            zero = 30 - u.sum()
            a, b = ranks[i] - zero, ranks[j] - zero
            ma, mb = (v[v >= 0].sum() / (30 - zero) for v in (a, b))
            a, b = (a - ma)[u], (b - mb)[u]
            assert sim[i, j] == pytest.approx((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
    assert K.top_events(obs, 0.5, 1.0, per_node=True).filter("hit").count() > 0


def rows_of(df, n, name="s"):
    return matrix(df, n, name)


def test_coupling(spark):
    x = Q.test_series(spark)
    cc = Q.strongest_lag(Q.cross_correlation(x, 5))
    near(matrix(cc, 4, "s"), [[1, 0.7570, 0.7790, 0.7536], [0.4847, 1, 0.4502, 0.5197], [0.6219, 0.5844, 1, 0.5992], [0.4827, 0.5509, 0.4996, 1]])
    near(matrix(cc, 4, "lag"), [[0, 4, 1, 2], [0, 0, 0, 0], [0, 3, 0, 1], [0, 2, 0, 0]])
    s = S.symmetrize_by_absmax(Q.strongest_lag(Q.cross_correlation(x, 2)))
    near(matrix(s, 4, "lag"), [[0, 2, 1, 2], [-2, 0, -2, -2], [-1, 2, 0, 1], [-2, 2, -1, 0]])
    all_ = {(r.i, r.j, r.tau): r.s for r in Q.cross_correlation(x, 1).collect()}
    near([all_[0, 1, 1], all_[1, 1, 1], all_[3, 2, 1]], [0.5804, 0.9362, 0.4092])
    mi = Q.most_information(Q.mutual_information(x, 5, "binning"))
    near(matrix(mi, 4, "s"), [[1.7828, 0.3765, 0.3551, 0.3288], [0.1326, 1.7828, 0.1140, 0.1498], [0.1951, 0.1784, 1.7828, 0.1918], [0.1139, 0.1681, 0.1266, 1.7828]])
    near(matrix(mi, 4, "lag"), [[0, 4, 1, 2], [0, 0, 0, 0], [0, 3, 0, 1], [0, 2, 0, 0]])
    ga = matrix(Q.most_information(Q.mutual_information(x, 5, "gauss")), 4, "s")
    near(ga[0, 1:], [0.4255, 0.4668, 0.4196])
    assert np.isinf(ga[2, 2])
    it = Q.most_information(Q.information_transfer(x, 5, "gauss"))
    near(matrix(it, 4, "s"), [[0, 0.1732, 0.3256, 0.3148], [0.0006, 0, 0.0324, 0.0755], [0.0012, 0.0754, 0, 0.1365], [0.0008, 0.0753, 0.0442, 0]])
    near(matrix(it, 4, "lag")[0], [0, 2, 1, 2])
    with pytest.raises(ValueError):
        Q.mutual_information(x, estimator="some_other")


def test_nearest_neighbours():
    rng = np.random.RandomState(42)
    from pyspark.sql import SparkSession

    x = {(r.node, r.t): r.x for r in Q.test_series(SparkSession.getActiveSession()).collect()}
    a = np.array([[x[k, t] for t in range(1000)] for k in range(4)])
    assert Q.knn_estimate(np.stack((a[0, 1:996], a[1, 5:])), 10) == pytest.approx(0.4387, abs=2e-3)
    assert Q.knn_estimate(np.stack((a[3, 5:], a[0, 5:])), 10) == pytest.approx(0.1209, abs=2e-3)
    rows = Q._samples(a, a, 0, 2, 1, 6, 1, "ity")
    assert Q.knn_estimate(rows, 10) == pytest.approx(0.3261, abs=2e-3)
    assert Q._samples(a, a, 0, 2, 1, 6, 1, "mit").shape == (4, 994)
    assert np.isnan(Q.knn_estimate(np.ones((2, 50)), 3))
    del rng


def es_brute(ex, ey, taumax, lag):
    """Both directions of one pair by loops over events."""
    ey = [t + lag for t in ey]
    lx, ly = len(ex), len(ey)
    if lx < 3 or ly < 3:
        return 0.0, 0.0
    xy, yx, same = set(), set(), 0
    for m in range(1, lx - 1):
        for n in range(1, ly - 1):
            tau = min(ex[m + 1] - ex[m], ex[m] - ex[m - 1], ey[n + 1] - ey[n], ey[n] - ey[n - 1]) / 2
            dt = ex[m] - ey[n]
            if abs(dt) <= min(tau, taumax):
                same += dt == 0
                if dt > 0:
                    xy.add((m, n))
                elif dt < 0:
                    yx.add((m, n))
    twice = lambda a, b: sum(any(p[0] == q[0] or p[1] == q[1] for q in b) for p in a)
    norm = math.sqrt((lx - 2) * (ly - 2))
    return (len(xy) + same / 2 - twice(xy, yx) / 2) / norm, (len(yx) + same / 2 - twice(yx, xy) / 2) / norm


def eca_brute(a, b, t, lag, window):
    none = t == 0 and lag == 0
    early = lambda e: 0 if none else sum(x <= e[0] + lag + t for x in e)
    late = lambda e: 0 if none else sum(x >= e[-1] - lag - t for x in e)
    inside = lambda x, y, lo: lo <= x - y - lag <= t
    if window == "advanced":
        use, n = a[early(a) :], len(a) - early(a)
        c = sum(any(inside(x, y, 0) for y in b) for x in use)
    elif window == "retarded":
        use, n = b[: len(b) - late(b)], len(b) - late(b)
        c = sum(any(inside(x, y, 0) for x in a) for y in use)
    else:
        use, n = a[early(a) : len(a) - late(a)], len(a) - early(a) - late(a)
        c = sum(any(inside(x, y, -t) for y in b) for x in use)
    return None if n == 0 else c / n


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    ev = {0: np.flatnonzero(rng.random(80) < 0.5).astype(float), 1: np.flatnonzero(rng.random(80) < 0.4).astype(float), 2: np.cumsum(rng.random(40)) * 2, 3: np.array([3.0, 30.0])}
    rows = [(k, n + 1, float(t)) for k, v in ev.items() for n, t in enumerate(v)]
    return {k: v.tolist() for k, v in ev.items()}, spark.createDataFrame(rows, "node long, idx long, ts double")


@pytest.mark.parametrize(("taumax", "lag"), [(math.inf, 0.0), (1.0, 0.0), (5.0, 1.5)])
def test_event_synchronization(events, taumax, lag):
    ev, df = events
    got = {(r.i, r.j): r.value for r in E.event_synchronization(df, taumax, lag).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            assert (got[i, j], got[j, i]) == pytest.approx(es_brute(ev[i], ev[j], taumax, lag)), (i, j)


@pytest.mark.parametrize("window", ["advanced", "retarded", "symmetric"])
def test_event_coincidence(events, window):
    ev, df = events
    for t, lag in ((2.0, 0.0), (5.0, 1.5), (0.0, 0.0)):
        got = {(r.i, r.j): r.value for r in E.coincidence_rate(df, t, window, lag).collect()}
        for i in range(3):
            for j in range(3):
                if i != j:
                    want = eca_brute(ev[i], ev[j], t, lag, window)
                    assert got[i, j] == (None if want is None else pytest.approx(want)), (i, j, t, lag)


def test_event_double_counts(spark):
    rows = [(0, float(t)) for t in (0, 10, 20, 30, 40)] + [(1, float(t)) for t in (0, 15, 25, 45, 60)]
    ev = E.events_of(spark.createDataFrame(rows, "node long, t double").withColumn("flag", F.lit(1)))
    got = {(r.i, r.j): r.value for r in E.event_synchronization(ev).collect()}
    assert got[0, 1] == pytest.approx(1 / 3)


def test_event_significance(spark):
    t = np.linspace(0.0, 99.9, 1000)
    x = np.stack([np.sin(t * np.pi), np.sin((t - 0.2) * np.pi)])
    obs = spark.createDataFrame([(k, float(t[n]), float(x[k, n])) for k in range(2) for n in range(1000)], "node long, t double, x double")
    ev = E.events_of(E.event_matrix(obs, value=0.98)).cache()
    times = obs.select("t")
    as_matrix = lambda df: matrix(df, 2, "level").tolist()
    assert as_matrix(E.shuffle_significance(ev, times, "ES", n_surrogates=40)) == [[0, 0], [1, 0]]
    assert as_matrix(E.shuffle_significance(ev, times, "ECA", "mean", "advanced", 1.0, n_surrogates=40, by_index=True)) == [[0, 1], [1, 0]]
    for w in ("advanced", "retarded"):
        near(as_matrix(E.analytic_significance(ev, 99.9, 1.0, w)), [[0, 0], [1, 0]])
    net = K.event_network(ev, 0.0, "ES", p_value=0.05, times=times, n_surrogates=40)
    assert [(r.src, r.dst) for r in net.edges.collect()] == [(1, 0)]
    rules = spark.createDataFrame([(0, "value", 0.99, True), (1, "quantile", 0.3, False)], "node long, method string, threshold double, above boolean")
    flags = {(r.node, round(r.t, 3)): r.flag for r in E.event_matrix(obs, rules=rules).collect()}
    q = np.quantile(x[1], 0.3)
    assert all(flags[0, round(float(v), 3)] == (x[0, n] > 0.99) and flags[1, round(float(v), 3)] == (x[1, n] < q) for n, v in enumerate(t))


FIELD = np.array([[math.sin(t * math.pi / 10 + i * math.pi / 2) for i in range(6)] for t in range(10)])


def states(spark, x):
    return spark.createDataFrame([(t, [float(v) for v in row]) for t, row in enumerate(x)], "i long, v array<double>")


def test_recurrence_thresholds(spark):
    x = states(spark, FIELD)
    plot = lambda df: ["".join(str(int(v)) for v in r) for r in matrix(df.withColumn("one", F.lit(1)), 10, "one")]
    assert plot(R.recurrences(states(spark, FIELD[:, :3]), 1.2, "euclidean")) == ["1110000000", "1111100000", "1111110000", "0111111100", "0111111100", "0011111110", "0001111111", "0001111111", "0000011111", "0000001111"]
    assert plot(R.recurrences(x, 3.5, "manhattan")) == ["1110000000", "1111000000", "1111100000", "0111111000", "0011111100", "0001111100", "0001111110", "0000111111", "0000001111", "0000000111"]
    assert plot(R.by_std(x, 0.8)) == ["1100000000", "1111000000", "0111100000", "0111100000", "0011110000", "0000111000", "0000011110", "0000001111", "0000001111", "0000000111"]
    d = R.pair_distances(x, x)
    local = plot(R.fixed_local_rate(d, 0.6))
    assert all(abs(a.count("1") - 5) <= 1 for a in local)
    assert len(plot(R.by_rate(x, 0.4))) == 10
    assert R.recurrences(x, 0.0).count() == 0 and R.recurrences(x, 2.0001).count() == 100


def test_adaptive_neighbours(spark):
    rng = np.random.default_rng(2)
    p = rng.standard_normal((12, 2))
    x = states(spark, p)
    dist = np.abs(p[:, None] - p).max(2)
    order, linked = np.argsort(dist, axis=1, kind="stable"), np.zeros((12, 12), int)
    for r in range(3):
        for i in range(12):
            k = r + 1
            while linked[i, order[i, k]]:
                k += 1
            linked[i, order[i, k]] = linked[order[i, k], i] = 1
    got = matrix(R.adaptive_neighbors(R.pair_distances(x, x), 3).withColumn("one", F.lit(1)), 12, "one")
    assert (got == linked).all()


def test_missing_values(spark):
    """Lines next to a missing state don't count."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 25).astype(float)
    gone = {6, 7, 15}
    ts = spark.createDataFrame([(i, None if i in gone else float(v)) for i, v in enumerate(x)], "i long, x double")
    e = R.embed(ts, 1, 1)
    missing, points = R.missing_states(e), e.select("i")
    rp = R.recurrences(e, 0.5)
    m = np.abs(x[:, None] - x) < 0.5
    for k in gone:
        m[k] = m[:, k] = False

    def runs(cells):  # of (recurrent, missing)
        out, n, flag = [], 0, False
        for line, miss in cells:
            if miss:
                flag, n = True, 0
            elif flag and not line:
                flag = False
            if flag:
                continue
            if line:
                n += 1
            elif n:
                out.append(n)
                n = 0
        return out + [n] * (n > 0 and not flag)

    vert = [r for i in range(25) for r in runs([(m[i, j], i in gone or j in gone) for j in range(25)])]
    diag = [r for k in range(1, 25) for r in runs([(m[i, i + k], i in gone or i + k in gone) for i in range(25 - k)])]
    count = lambda v, f=1: {n: f * v.count(n) for n in set(v)}
    assert {r.len: r.cnt for r in R.vertical_lines(rp, missing).collect()} == count(vert)
    assert {r.len: r.cnt for r in R.diagonal_lines(rp, missing, points).collect()} == count(diag, 2)


def test_legendre(spark):
    t = np.arange(60) * 0.1
    ts = spark.createDataFrame([(i, float(a), float(a * a + 2 * a)) for i, a in enumerate(t)], "i long, t double, x double")
    got = sorted(R.legendre(ts, 3, p=4).collect(), key=lambda r: r.i)
    assert len(got) == 52
    assert [r.v[1] for r in got] == pytest.approx([2 * t[r.i + 4] + 2 for r in got])
    assert [r.v[2] for r in got] == pytest.approx([2.0] * 52)
    assert R.legendre(ts, 2).count() > 0


def visibility(x, t, horizontal):
    out = set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if any(math.isnan(v) for v in x[i : j + 1]):
                continue
            if all(x[k] < min(x[i], x[j]) if horizontal else (x[k] - x[i]) / (t[k] - t[i]) < (x[j] - x[i]) / (t[j] - t[i]) for k in range(i + 1, j)):
                out |= {(i, j), (j, i)}
    return out


@pytest.mark.parametrize("horizontal", [False, True])
def test_visibility(spark, horizontal):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, 60).astype(float)
    x[[20, 21, 40]] = np.nan
    t = np.cumsum(rng.random(60) + 0.1)
    ts = spark.createDataFrame([(i, float(a), None if math.isnan(v) else float(v)) for i, (a, v) in enumerate(zip(t, x))], "i long, t double, x double")
    assert {(r.src, r.dst) for r in V.visible(ts, horizontal).collect()} == visibility(x, t, horizontal)
    assert V.visible(ts.filter("false"), horizontal).count() == 0


def test_visibility_measures(spark):
    x = [3.0, 1.0, 2.0, 5.0, 4.0, 4.5, 0.5, 6.0]
    g = V.graph(spark.createDataFrame([(i, float(i), v) for i, v in enumerate(x)], "i long, t double, x double"))
    every = range(8)
    for side, pick in {"retarded": lambda i: ([s for s in every if s < i],) * 2, "advanced": lambda i: ([s for s in every if s > i],) * 2, "trans": lambda i: ([s for s in every if s < i], [s for s in every if s > i])}.items():
        got = col(V.directional_betweenness(g, side))
        i = {"retarded": 5, "advanced": 3, "trans": 3}[side]
        s, t = pick(i)
        assert got[i] == pytest.approx(dict(P.betweenness(g, ids(spark, *s), ids(spark, *t)).collect())[i])
    dist = P.path_lengths(g)
    m = matrix(dist, 8, "d", ("src", "dst"))
    r, a = col(V.directional_closeness(g, dist, "retarded")), col(V.directional_closeness(g, dist, "advanced"))
    assert r[0] is None and a[7] is None and r[5] == pytest.approx(1 / m[5, :5].mean())
    c = col(V.boundary_corrected_closeness(g, dist))
    assert c[0] is None and c[5] == pytest.approx(7 * (r[5] / 5 + a[5] / 2))


def test_surrogate_tests(spark):
    obs = S.normalize(U.small_series(spark))
    a = np.array([[math.sin(t * math.pi / 15 + k * math.pi / 2) + math.sin(t * math.pi / 30) for t in range(200)] for k in range(6)])
    want = np.corrcoef(a)
    np.fill_diagonal(want, 0)
    near(matrix(U.test_pearson(obs, obs), 6, "s"), want)
    mi = matrix(U.test_mutual_information(obs, obs, 16), 6, "s")
    assert (np.diag(mi) == 0).all() and mi[0, 1] > 0
    h = U.original_distribution(obs, U.test_mutual_information, 10).collect()
    assert sum(r.share for r in h) == pytest.approx(1) and len(h) == 10
    h = U.threshold_significance(obs, U.white_noise, U.test_pearson, 2, 10, (0.0, 2.0)).collect()
    assert sum(r.share for r in h) == pytest.approx(1) and len(h) == 10
    e = R.embed(U.small_series(spark).select("node", F.col("t").alias("i"), "x"), 3, 2).filter("node = 0").orderBy("i").limit(2).collect()
    near([r.v for r in e], [[0, 0.61464833, 1.14988147], [0.31244015, 0.89680225, 1.3660254]])
    s = {(r.node, r.k): abs(complex(r.re, r.im)) for r in U.spectrum(U.small_series(spark)).collect()}
    near([s[2, k] for k in range(101)], np.abs(np.fft.rfft(a[2])))


def test_models(spark, g):
    m = M.model(spark, "erdos_renyi", n=10, n_links=18)
    assert m.edges.count() == 36
    assert M.model(spark, "watts_strogatz", n=100, k=2, p=0.1).edges.count() == 400
    assert round(one(G.degree(M.model(spark, "configuration", degrees=[3] * 1000)).agg(F.avg("k").alias("value")))) == 3
    assert G.link_density(M.model(spark, "barabasi_albert", n=100, m=1)).first()[0] == pytest.approx(0.02, abs=1e-3)
    w = [r.w for r in M.grow_weights(spark, 10).collect()]
    assert len(w) == 10 and min(w) >= 0
    near(sorted(col(M.model(spark, "erdos_renyi", n=6, n_links=5, grid=X.small_grid(spark)).nodes, "w")), sorted(math.cos(math.radians(5 * i)) for i in range(6)))
    for model in (1, 2, 3):
        for grid, eps in ((X.small_grid(spark), 1.0), (X.small_grid(spark, False), 100)):
            r = M.rewire_by_distance(g, grid, 20, eps, model)
            assert col(G.degree(r), "k") == [3, 3, 2, 2, 3, 1]
    a, b = ids(spark, 0, 3, 5), ids(spark, 1, 2, 4)
    n = M.set_cross_links(g, a, b, density=0.5)
    assert I.number_cross_links(n, a, b).first()[0] == 4 and one(I.number_internal_links(n, b)) == 3
    s = M.rewired_cross_links(g, a, b, 5)
    assert sorted(col(I.cross_degree(s, a, b))) == sorted(col(I.cross_degree(g, a, b)))
    assert 0 <= M.links_by_distance(X.angular_distance(X.small_grid(spark)), 0.0, -4.0).count() <= 15


def test_coupled_layers(spark):
    f = S.anomaly(S.small_field(spark), 5)
    first, second = f.filter("node < 3"), f.filter("node >= 3")
    g = K.coupled_network(first, second, 0.2)
    a, b = K.layers(first, second)
    m = {(r.measure, r.layer): r.value for r in K.coupled_measures(g, a, b).collect()}
    assert len(m) == 18 and 0 <= m["internal_link_density", "1"] <= 1 and m["number_cross_links", "12"] == m["number_cross_links", "21"]
    s = K.coupled_sequences(g, a, b).collect()
    assert len(s) == 6 and all(0 <= r.cross_local_clustering <= 1 for r in s)
    assert K.layer_similarity(S.pearson(f), a, b).count() == 9 and K.layer_network(g, a).nodes.count() == 3


def test_nothing(spark):
    """Empty tables give empty or zero results, nulls and repeats no errors."""
    nodes = spark.createDataFrame([], "id long, w double")
    none = G.Graph(nodes, spark.createDataFrame([], "src long, dst long"), False)
    for f in (G.degree, C.local_clustering, P.betweenness, N.newman_betweenness, G.nsi_twinness, P.coreness):
        assert f(none).count() == 0
    assert P.path_lengths(none).count() == 0
    obs = spark.createDataFrame([], "node long, t long, x double")
    assert S.pearson(obs).count() == 0 and Q.cross_correlation(obs, 2).count() == 0 and S.threshold_from_link_density(S.pearson(obs), 0.1).count() == 0
    odd = spark.createDataFrame([(1, 0, 1.0), (1, 0, 1.0), (1, 1, 2.0), (2, 0, None), (2, 1, 5.0), (None, 0, 1.0), (3, 0, 4.0), (3, 1, 3.0)], "node long, t long, x double")
    got = {(r.i, r.j): r.s for r in S.pearson(odd).collect()}
    assert got[1, 3] == pytest.approx(-1) and got[1, 2] is None and len(got) == 9
    loops = G.Graph.of(spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "src long, dst long"))
    assert col(G.degree(loops), "k") == [1, 1]
