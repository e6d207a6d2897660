"""Random models keep what they promise; files give back what they took; dense measures obey circuit laws."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import dense as N
from skein.operators import graph as G
from skein.operators import models as M
from skein.operators import spatial as X
from skein.sources import files, netcdf


@pytest.fixture(scope="module")
def g(spark):
    return G.Graph.small(spark)


def links(g):
    return sorted((r.src, r.dst) for r in g.edges.select("src", "dst").collect())


def test_rewiring_keeps_degrees(g):
    assert sorted(G.degree(M.randomly_rewire(g, 20)).collect()) == sorted(G.degree(g).collect())


def test_models(spark):
    er = M.erdos_renyi(spark, 300, 0.1)
    assert 0.08 < G.link_density(er).first()[0] < 0.12 and links(er) == links(M.erdos_renyi(spark, 300, 0.1))
    ba = M.barabasi_albert(spark, 100, 3)
    assert ba.edges.count() == 2 * 3 * 97
    ws = M.watts_strogatz(spark, 100, 2, 0.0)
    assert set(dict(G.degree(ws).collect()).values()) == {4}
    assert dict(G.degree(M.configuration(G.degree(ba))).agg(F.sum("k")).collect()[0].asDict())["sum(k)"] <= ba.edges.count()


@pytest.mark.parametrize("kind", ["graphml", "gml", "pajek"])
def test_text_formats(spark, g, tmp_path, kind):
    files.save_text(g, str(tmp_path / kind), kind)
    assert links(files.load_text(spark, str(tmp_path / kind), kind)) == links(g)


def test_lists_and_parquet(spark, g, tmp_path):
    files.save_edge_list(g, str(tmp_path / "e"), "weight")
    back = files.load_edge_list(spark, str(tmp_path / "e"), attribute="weight")
    assert sorted((r.src, r.dst, r.weight) for r in back.edges.collect()) == sorted((r.src, r.dst, r.weight) for r in g.edges.collect())
    files.save_parquet(g, str(tmp_path / "p"))
    again = files.load_parquet(spark, str(tmp_path / "p"))
    assert links(again) == links(g) and not again.directed


def test_resistors(spark):
    series = G.Graph.of(spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (2, 3, 6.0), (1, 3, 6.0)], "src long, dst long, r double"))
    er = {(x.i, x.j): x.value for x in N.effective_resistance(series, "r").collect()}
    assert er[0, 1] == pytest.approx(2.0)
    assert er[1, 3] == pytest.approx(1 / (1 / 6 + 1 / 9))
    assert er[0, 3] == pytest.approx(2 + 1 / (1 / 6 + 1 / 9))
    assert dict(N.admittive_degree(series, "r").collect())[1] == pytest.approx(1 / 2 + 1 / 3 + 1 / 6)


def test_dense_measures(g):
    with pytest.raises(ValueError):
        N._on_matrix(g, None, "id long", most_bytes=100)


FOREIGN = {
    "graphml": """<?xml version="1.0"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="w" attr.type="double"/>
  <key id="d1" for="edge" attr.name="weight" attr.type="float"/>
  <key id="d2" for="node" attr.name="label" attr.type="string"/>
  <graph edgedefault="undirected">
    <node id="0">
      <data key="d0">
        2.5
      </data>
      <data key="d2">a &amp; b</data>
    </node>
    <node id="1"/><node id="2"/>
    <edge source="0" target="1"><data key="d1">1.5</data></edge>
    <edge source="1" target="2"/>
  </graph>
</graphml>""",
    "gml": """# by hand
graph [
  directed 0
  node [
    id 0
    label "a & b"
    w 2.5
  ]
  node [ id 1 label "c" ]
  node [ id 2 label "d"
    graphics [ x 1.0 y 2.0 ] ]
  edge [
    source 0
    target 1
    weight 1.5
  ]
  edge [ source 1 target 2 ]
]""",
    "pajek": "*Vertices 3\n*Edges\n1 2 1.5\n2 3\n",
    "lgl": "# 0\n1 1.5\n# 1\n2\n# 2\n",
    "dimacs": "c by hand\np edge 3 2\ne 1 2\ne 2 3\n",
    "dot": 'graph g {\n  node [shape=box];\n  0 [w=2.5, label="a & b"];\n  0 -- 1 [weight=1.5];\n  1 -- 2;\n}',
}


@pytest.mark.parametrize("kind", list(FOREIGN))
def test_foreign_files(spark, tmp_path, kind):
    path = tmp_path / f"g.{kind}"
    path.write_text(FOREIGN[kind])
    g = files.load_text(spark, str(path), kind)
    assert links(g) == [(0, 1), (1, 0), (1, 2), (2, 1)] and not g.directed and g.nodes.count() == 3
    if kind != "dimacs":
        assert {(r.src, r.dst): r.weight for r in g.edges.collect()}[0, 1] == 1.5
    if kind in ("graphml", "gml", "dot"):
        node = g.nodes.filter("id = 0").first()
        assert node.w == 2.5 and node.label == "a & b"
    with gzip.open(tmp_path / f"z.{kind}", "wt") as f:
        f.write(FOREIGN[kind])
    assert links(files.load_text(spark, str(tmp_path / f"z.{kind}"), kind)) == links(g)


def test_named_nodes_and_nothing(spark, tmp_path):
    (tmp_path / "n.dot").write_text("digraph { alpha -> beta; beta -> gamma }")
    g = files.load_text(spark, str(tmp_path / "n.dot"), "dot")
    names = {r.id: r.name for r in g.nodes.collect()}
    assert g.directed and {(names[a], names[b]) for a, b in links(g)} == {("alpha", "beta"), ("beta", "gamma")}
    (tmp_path / "x.gml").write_text("nothing here")
    with pytest.raises(ValueError):
        files.load_text(spark, str(tmp_path / "x.gml"), "gml")


@pytest.mark.parametrize("kind", ["graphml", "gml", "pajek", "lgl", "dot"])
def test_link_attributes_come_back(spark, g, tmp_path, kind):
    files.save_text(g, str(tmp_path / kind), kind)
    back = files.load_text(spark, str(tmp_path / kind), kind)
    get = lambda x: sorted((r.src, r.dst, r.weight) for r in x.edges.collect())
    assert get(back) == get(g)
    if kind in ("graphml", "gml", "dot"):
        assert sorted((r.id, r.w) for r in back.nodes.collect()) == sorted((r.id, r.w) for r in g.nodes.collect())


def test_adjacency_lists(spark, g, tmp_path):
    files.save_adjacency_lists(g, str(tmp_path / "a"))
    assert links(files.load_adjacency_lists(spark, str(tmp_path / "a"))) == links(g)


def test_grids_in_files(spark, g, tmp_path):
    grid = X.small_grid(spark)
    files.save_spatial(g, grid, str(tmp_path / "s"), spark.createDataFrame([(0, 1, 0.5)], "i long, j long, s double"))
    h, back = files.load_spatial(spark, str(tmp_path / "s"))
    assert links(h) == links(g) and sorted(back.collect()) == sorted(grid.collect()) and files.load_similarity(spark, str(tmp_path / "s")).count() == 1
    files.save_grid_text(grid, spark.range(3).toDF("t"), str(tmp_path / "t"))
    back, times = files.load_grid_text(spark, str(tmp_path / "t"))
    assert sorted((r.node, r.lat, r.lon) for r in back.collect()) == sorted((r.node, r.lat, r.lon) for r in grid.collect()) and times.count() == 3
    files.save_for_viewer(g, grid, str(tmp_path / "v"), "graphml")
    seen = files.load_text(spark, str(tmp_path / "v"), "graphml")
    assert {"lat", "lon"} <= set(seen.nodes.columns) and "ang_dist" in seen.edges.columns


def test_netcdf(spark, tmp_path):
    air = np.arange(3 * 2 * 2).reshape(3, 2, 2)
    axis = lambda name, v: {"dimensions": [name], "array": np.array(v, float), "type": "f4", "attributes": {}}
    d = {"dimensions": {"time": 3, "lat": 2, "lon": 2}, "global_attributes": {"title": "small", "n": 3, "r": 0.5}, "variables": {"time": axis("time", [0, 1, 2]), "lat": axis("lat", [10, 0]), "lon": axis("lon", [5, 6]), "air": {"dimensions": ["time", "lat", "lon"], "type": "i2", "array": air, "attributes": {"scale_factor": 0.5, "add_offset": 1.0, "missing_value": 7}}}}
    (tmp_path / "a.nc").write_bytes(netcdf.write_dictionary(d))
    back = netcdf.read_dictionary((tmp_path / "a.nc").read_bytes())
    assert back["global_attributes"] == {"title": "small", "n": 3, "r": 0.5} and back["dimensions"] == d["dimensions"]
    obs, grid = netcdf.load_field(spark, str(tmp_path / "a.nc"), "air")
    got = {(r.t, r.node): r.x for r in obs.collect()}
    assert got == {(t, n): (None if air[t, n // 2, n % 2] == 7 else air[t, n // 2, n % 2] * 0.5 + 1) for t in range(3) for n in range(4)}
    assert [(r.lat, r.lon) for r in grid.orderBy("node").collect()] == [(10, 5), (10, 6), (0, 5), (0, 6)]
    with pytest.raises(ValueError):
        netcdf.read_dictionary(b"\x89HDF....")
