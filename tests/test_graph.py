"""Known values of the six-node test graphs, and invariances."""

import pytest
from pyspark.sql import functions as F

from skein.operators import clustering as C
from skein.operators import graph as G
from skein.operators import interacting as I
from skein.operators import paths as P


def col(df, name="value", key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def g(spark):
    return G.Graph.small(spark)


@pytest.fixture(scope="module")
def dg(spark):
    return G.Graph.small(spark, directed=True)


@pytest.fixture(scope="module")
def dist(g):
    return P.path_lengths(g)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def test_degrees(g, dg):
    assert col(G.degree(g), "k") == [3, 3, 2, 2, 3, 1]
    assert col(G.in_degree(dg), "k_in") == [2, 2, 2, 1, 1, 0]
    assert col(G.out_degree(dg), "k_out") == [2, 2, 0, 1, 2, 1]
    assert col(G.bilateral_degree(dg), "k_bil") == [0] * 6
    assert col(G.bilateral_degree(g), "k_bil") == [3, 3, 2, 2, 3, 1]


def test_nsi_max_neighbors_degree(g):
    assert col(G.nsi_neighbor_degrees(g), "k_max") == pytest.approx([8.4, 8.0, 8.0, 8.4, 8.4, 8.4])


def test_clustering(g):
    assert col(C.local_clustering(g)) == pytest.approx([0, 1 / 3, 1, 0, 1 / 3, 0])
    assert col(C.global_clustering(g), key="value") == pytest.approx([0.27777777])


def test_path_lengths(g, dist):
    want = [[0, 2, 2, 1, 1, 1], [2, 0, 1, 1, 1, 3], [2, 1, 0, 2, 1, 3], [1, 1, 2, 0, 2, 2], [1, 1, 1, 2, 0, 2], [1, 3, 3, 2, 2, 0]]
    assert {(r.src, r.dst): r.d for r in dist.collect()} == {(i, j): float(want[i][j]) for i in range(6) for j in range(6)}
    assert col(P.average_path_length(g, dist), key="value") == pytest.approx([1.66666667])
    assert col(P.nsi_average_path_length(g, dist), key="value") == pytest.approx([1.60027778], abs=1e-6)
    assert col(P.closeness(g, dist)) == pytest.approx([0.71428571, 0.625, 0.55555556, 0.625, 0.71428571, 0.45454545])


def test_betweenness(spark, g):
    assert col(P.betweenness(g)) == pytest.approx([4.5, 1.5, 0, 1, 3, 0])
    every = ids(spark, *range(6))
    assert col(P.betweenness(g, every, every)) == pytest.approx([9, 3, 0, 2, 6, 0])
    assert col(P.betweenness(g, ids(spark, 2), ids(spark, 3, 5))) == pytest.approx([1, 1, 0, 0, 1, 0])


def test_nsi_betweenness(spark, g):
    assert col(P.nsi_betweenness(g)) == pytest.approx([29.68541738, 7.7128677, 0, 3.09090906, 9.69960462, 0], abs=1e-5)
    assert col(P.nsi_betweenness(g, ids(spark, 2), ids(spark, 3, 5))) == pytest.approx([3.16666689, 2.34705893, 0, 0, 2.06521743, 0], abs=1e-5)


def test_pagerank(g):
    assert col(P.pagerank(g)) == pytest.approx([0.21836231, 0.20440819, 0.14090543, 0.14478497, 0.20466978, 0.08686932], abs=1e-6)


def test_coreness(g):
    assert col(P.coreness(g)) == [2, 2, 2, 2, 2, 1]


def test_interacting(spark):
    g = G.Graph.small(spark)
    a, b = ids(spark, 0, 3, 5), ids(spark, 1, 2, 4)
    assert col(I.cross_degree(g, a, b)) == [1, 1, 0]
    assert col(I.cross_closeness(g, a, b)) == pytest.approx([0.6, 0.6, 0.375])
    w = spark.createDataFrame([(i, 0.6 + 0.2 * i) for i in range(6)], "id long, w double")
    h = G.Graph(w, g.edges, False)
    assert col(I.nsi_cross_average_path_length(h, ids(spark, 0, 5), b), key="value") == pytest.approx([3.3306], abs=1e-4)
    assert col(I.nsi_cross_average_path_length(h, ids(spark, 1, 3, 4, 5), ids(spark, 2)), key="value") == pytest.approx([0.376], abs=1e-4)


@pytest.mark.parametrize("measure", [G.nsi_degree, C.nsi_local_clustering, C.nsi_local_soffer_clustering])
def test_node_splitting_leaves_nsi_measures(g, measure):
    name = "k" if measure is G.nsi_degree else "value"
    assert col(measure(g.splitted(2, 99, 0.3)).filter("id < 6"), name) == pytest.approx(col(measure(g), name))


def test_permutation(spark, g):
    m = spark.createDataFrame([(i, (i * 5 + 2) % 6) for i in range(6)], "old long, new long")
    got = dict(C.local_clustering(g.permuted(m)).collect())
    want = dict(C.local_clustering(g).collect())
    assert all(got[(i * 5 + 2) % 6] == pytest.approx(v) for i, v in want.items())


def test_star_degrees(spark):
    n = 2000
    star = G.Graph.of(spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    assert dict(G.degree(star).groupBy("k").count().collect()) == {1: n - 1, n - 1: 1}
