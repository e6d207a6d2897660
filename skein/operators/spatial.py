"""Grids and networks embedded in space: ``grid(node, lat, lon)`` in degrees or ``grid(node, x ARRAY)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import cumulative, histogram, meet, ratio
from .clustering import weighted_local_clustering
from .graph import Graph, degree
from .paths import average_path_length, closeness, local_vulnerability, path_lengths


def angular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in radians of coordinates in degrees."""
    r = F.radians
    c = F.sin(r(lat1)) * F.sin(r(lat2)) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.cos(r(lon1) - r(lon2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angular_distance(grid: DataFrame) -> DataFrame:
    """``i, j, d`` of all pairs of grid points: the distance matrix."""
    a = grid.select(F.col("node").alias("i"), F.col("lat").alias("a1"), F.col("lon").alias("o1"))
    b = grid.select(F.col("node").alias("j"), F.col("lat").alias("a2"), F.col("lon").alias("o2"))
    return meet(a, "i", b, "j").select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(angular(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2"))).alias("d"))


def euclidean_distance(grid: DataFrame) -> DataFrame:
    """``i, j, d`` of all pairs of points ``grid(node, x ARRAY)``."""
    a, b = grid.select(F.col("node").alias("i"), F.col("x").alias("a")), grid.select(F.col("node").alias("j"), F.col("x").alias("b"))
    s = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    return meet(a, "i", b, "j").select("i", "j", F.sqrt(s).alias("d"))


def pairwise_distance(grid: DataFrame) -> DataFrame:
    """``i, j, d``: angular for a grid with ``lat, lon``, else Euclidean."""
    return angular_distance(grid) if "lat" in grid.columns else euclidean_distance(grid)


def axis_product(*axes: DataFrame) -> DataFrame:
    """``node, x ARRAY`` of a rectangular grid: every point of each axis ``(position, x)`` with those of the others, numbered row by row (the last axis fastest). Nodes are numbered by arithmetic on the positions, so no task orders them."""
    sizes = [a.count() for a in axes]
    out = None
    for axis, n in zip(axes, sizes, strict=True):
        here = axis.select(F.col("position").cast("long").alias("_p"), F.col("x").cast("double").alias("_x"))
        if out is None:
            out = here.select(F.col("_p").alias("node"), F.array("_x").alias("x"))
        else:
            out = meet(out, "node", here, "_p").select((F.col("node") * n + F.col("_p")).alias("node"), F.concat("x", F.array("_x")).alias("x"))
    return out


def regular_grid(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """``node, lat, lon``: every latitude ``lats(lat)`` with every longitude ``lons(lon)``, numbered in that order. Repeated values are points of their own only once."""
    place = lambda df, c: df.select(c).distinct().select((F.row_number().over(Window.orderBy(c)) - 1).cast("long").alias("position"), F.col(c).alias("x"))  # noqa: E731  an axis, not the grid
    return axis_product(place(lats, "lat"), place(lons, "lon")).select("node", F.get("x", F.lit(0)).alias("lat"), F.get("x", F.lit(1)).alias("lon"))


def small_grid(spark, geographic: bool = True) -> DataFrame:
    """Six test points: ``node, lat, lon`` or ``node, x ARRAY``."""
    rows = [(i, 5.0 * i, 2.5 * (i + 1)) for i in range(6)]
    g = spark.createDataFrame(rows, "node long, lat double, lon double")
    return g if geographic else g.select("node", F.array("lat", "lon").alias("x"))


def sequence(grid: DataFrame, dimension: int) -> DataFrame:
    """``node, value``: coordinates of one dimension."""
    return grid.select("node", F.get("x", F.lit(dimension)).alias("value") if "x" in grid.columns else F.col(["lat", "lon"][dimension]).alias("value"))


def node_coordinates(grid: DataFrame, node: int) -> DataFrame:
    return grid.filter(F.col("node") == node)


def grid_size(grid: DataFrame, times: DataFrame) -> DataFrame:
    """One row: ``space, time``."""
    return grid.agg(F.count("*").alias("space")).crossJoin(F.broadcast(times.select("t").distinct().agg(F.count("*").alias("time"))))  # one row each


def nearest_point(grid: DataFrame, x: list[float]) -> DataFrame:
    """``node, d``: the point closest to ``x``, ties to the smaller node."""
    s = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in x]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    return grid.select("node", F.sqrt(s).alias("d")).orderBy("d", "node").limit(1)


def nearest_node(grid: DataFrame, lat: float, lon: float) -> DataFrame:
    d = angular(F.col("lat"), F.col("lon"), F.lit(float(lat)), F.lit(float(lon)))
    return grid.select("node", d.alias("d")).orderBy("d", "node").limit(1)


def geometric_distance_distribution(grid: DataFrame, n_bins: int) -> DataFrame:
    """``bin, lower, share`` of the distances of all ordered pairs of different points, from 0 to the largest."""
    d = pairwise_distance(grid)
    top = d.agg(F.max("d")).first()[0] or 0.0
    h = histogram(d.filter("i != j"), "d", n_bins, (0.0, top))
    return h.select("bin", "lower", "share")


def cartesian(lat: Column, lon: Column) -> Column:
    """Unit vector ``struct<x, y, z>`` of degrees: x towards 90 degrees east, y towards 0."""
    c = F.cos(F.radians(lat))
    return F.struct((c * F.sin(F.radians(lon))).alias("x"), (c * F.cos(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z"))


def geographic(v: Column) -> Column:
    """``struct<lat, lon>`` in degrees of a unit vector ``struct<x, y, z>``."""
    return F.struct(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["z"])))).alias("lat"), F.degrees(F.atan2(v["x"], v["y"])).alias("lon"))


#: Corners (lon, lat) of regions by name; fixed values.
REGIONS = {
    "ENSO": [(-79.28273150749884, -10.49311965331937), (-79.29849791038734, 10.12527300655218), (-174.9221853596061, 10.07293121423917), (-174.8362810586096, -10.46407198776264), (-80.13229308153623, -10.36724072894785)],
    "NINO34": [(-118.6402427933005, 7.019906838300821), (-171.0067408177714, 6.215022481004243), (-171.0364908514962, -5.768616252424354), (-119.245702264066, -5.836385150138187)],
}


def named_region(grid: DataFrame, name: str) -> DataFrame:
    """``node, inside`` one of :data:`REGIONS`; on grids whose longitudes are all 0 or more its western corners are moved by 360 degrees."""
    east = (grid.agg(F.min("lon")).first()[0] or 0.0) >= 0
    return region(grid, [(lat, lon + 360 if east and lon < 0 else lon) for lon, lat in REGIONS[name]])


def boundaries(grid: DataFrame) -> DataFrame:
    """One row: least and largest value of each coordinate."""
    if "lat" in grid.columns:
        return grid.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    each = grid.select(F.posexplode("x").alias("dimension", "v")).groupBy("dimension").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return each


def window(grid: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """``id`` of the points within the bounds, ends included; bounds of equal ends don't restrict."""
    out = grid
    if lat_min != lat_max:
        out = out.filter(F.col("lat").between(lat_min, lat_max))
    if lon_min != lon_max:
        out = out.filter(F.col("lon").between(lon_min, lon_max))
    return out.select(F.col("node").alias("id"))


def convert_lon(grid: DataFrame) -> DataFrame:
    """Longitudes in -180 to 180."""
    return grid.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))


def region(grid: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """``node, inside`` the polygon of (lat, lon) corners, by the number of its edges that a meridian crosses."""
    odd: Column = F.lit(0)
    for (a1, o1), (a2, o2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if a1 != a2:
            spans = (F.lit(a1) > F.col("lat")) != (F.lit(a2) > F.col("lat"))
            odd = odd + F.when(spans & (F.col("lon") < (o2 - o1) * (F.col("lat") - a1) / (a2 - a1) + o1), 1).otherwise(0)
    return grid.select("node", (odd % 2 == 1).alias("inside"))


def surface_weights(grid: DataFrame, kind: str = "surface") -> DataFrame:
    """``id, w``: ``surface``: cosine of latitude, ``irrigation``: its square, else 1."""
    c = F.cos(F.radians("lat"))
    return grid.select(F.col("node").alias("id"), {"surface": c, "irrigation": c * c}.get(kind, F.lit(1.0)).alias("w"))


def link_distances(g: Graph, grid: DataFrame) -> DataFrame:
    """``src, dst, d`` of the links only: angular for a grid with ``lat, lon``, else Euclidean."""
    if "lat" in grid.columns:
        a = grid.select(F.col("node").alias("src"), F.col("lat").alias("a1"), F.col("lon").alias("o1"))
        b = grid.select(F.col("node").alias("dst"), F.col("lat").alias("a2"), F.col("lon").alias("o2"))
        d = angular(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2"))
    else:
        a, b = grid.select(F.col("node").alias("src"), F.col("x").alias("a")), grid.select(F.col("node").alias("dst"), F.col("x").alias("b"))
        d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", d.alias("d"))


def link_distance_distribution(g: Graph, grid: DataFrame, n_bins: int, geometry_corrected: bool = False) -> DataFrame:
    """``bin, lower, share`` of the links' distances from 0 to the grid's largest distance; ``geometry_corrected``: over the share of all pairs in that bin (0 where there are none), normalised again."""
    top = pairwise_distance(grid).agg(F.max("d")).first()[0] or 0.0
    h = histogram(link_distances(g, grid), "d", n_bins, (0.0, top)).select("bin", "lower", "share")
    if not geometry_corrected:
        return h
    all_ = geometric_distance_distribution(grid, n_bins).select("bin", F.col("share").alias("every"))
    q = h.join(all_, "bin").select("bin", "lower", ratio(F.col("share"), F.col("every")).alias("share"))
    return q.withColumn("share", ratio(F.col("share"), F.sum("share").over(Window.partitionBy(F.lit(0)))))  # a row for each bin


def _turned(g: Graph, direction: str) -> Graph:
    """The graph whose links ``src -> dst`` lead from a node to those that count for it: ``both`` (undirected), ``in`` or ``out``."""
    if direction == "both":
        return g.undirected() if g.directed else g
    if direction == "out" or not g.directed:
        return g
    return Graph(g.nodes, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), True)


def average_link_distance(g: Graph, grid: DataFrame, direction: str = "both", geometry_corrected: bool = False) -> DataFrame:
    """``id, value``: mean distance along the node's links (``both``: undirected ones, over its degree; ``in``; ``out``); ``geometry_corrected``: over its mean distance to all points, itself included."""
    t = _turned(g, direction)
    s = link_distances(t, grid).groupBy(F.col("src").alias("id")).agg(F.sum("d").alias("s"), F.count("*").alias("k"))
    if direction == "both" and g.directed:
        s = s.drop("k").join(degree(g), "id")
    out = g.per_node(s.select("id", ratio(F.col("s"), F.col("k")).alias("value")), "value", 0.0)
    if not geometry_corrected:
        return out
    mean = pairwise_distance(grid).groupBy(F.col("i").alias("id")).agg(F.avg("d").alias("m"))
    return out.join(mean, "id").select("id", ratio(F.col("value"), F.col("m")).alias("value"))


def max_link_distance(g: Graph, grid: DataFrame) -> DataFrame:
    """``id, value``: the longest link of either direction, 0 without links."""
    return g.per_node(link_distances(_turned(g, "both"), grid).groupBy(F.col("src").alias("id")).agg(F.max("d").alias("value")), "value", 0.0)


def area_weighted_connectivity(g: Graph, direction: str = "both") -> DataFrame:
    """``id, value``: share of the total weight that the neighbours have: those that link to the node (``in``), that it links to (``out``) or, in a directed graph, the sum of the two (``both``)."""
    if direction == "both" and g.directed:
        both = area_weighted_connectivity(g, "in").union(area_weighted_connectivity(g, "out"))
        return both.groupBy("id").agg(F.sum("value").alias("value"))
    total = F.broadcast(g.nodes.agg(F.sum("w").alias("total")))  # one row
    e = _turned(g, direction).edges
    s = e.select(F.col("src").alias("id"), F.col("dst").alias("j")).join(g.nodes.select(F.col("id").alias("j"), "w"), "j").groupBy("id").agg(F.sum("w").alias("s"))
    return g.per_node(s.crossJoin(total).select("id", ratio(F.col("s"), F.col("total")).alias("value")), "value", 0.0)


def total_link_distance(g: Graph, grid: DataFrame, direction: str = "both", geometry_corrected: bool = False) -> DataFrame:
    """``id, value``: average link distance times area weighted connectivity."""
    a = average_link_distance(g, grid, direction, geometry_corrected).withColumnRenamed("value", "a")
    return a.join(area_weighted_connectivity(g, direction), "id").select("id", (F.col("a") * F.col("value")).alias("value"))


def connectivity_weighted_distance(g: Graph, grid: DataFrame, direction: str = "both") -> DataFrame:
    """``id, value``: sum over the node's links of the other end's weight times the distance, over the node's degree times all nodes' weight; weights are the cosines of latitude (:func:`surface_weights`)."""
    t = _turned(g, direction)
    k = degree(g) if direction == "both" else degree(Graph(t.nodes, t.edges, False))
    total = F.broadcast(g.nodes.agg(F.sum("w").alias("total")))  # one row
    s = link_distances(t, grid).join(g.nodes.select(F.col("id").alias("dst"), "w"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("d")).alias("s"))
    return g.per_node(s.join(k, "id").crossJoin(total).select("id", ratio(F.col("s"), F.col("k") * F.col("total")).alias("value")), "value", 0.0)


def local_geographical_clustering(g: Graph, grid: DataFrame) -> DataFrame:
    """``id, value``: clustering weighted by the inverse distances of the links; links without distance don't count."""
    near = link_distances(g, grid).filter("d > 0").select("src", "dst", (1 / F.col("d")).alias("near"))
    return weighted_local_clustering(Graph(g.nodes, near, g.directed), "near")


def neighbor_connectivity(g: Graph) -> DataFrame:
    """``id, mean, largest`` area weighted connectivity of the neighbours of either direction; the mean is the sum over the degree, 0 without neighbours."""
    a = area_weighted_connectivity(g).toDF("dst", "a")
    s = _turned(g, "both").edges.join(a, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("s"), F.max("a").alias("largest")).join(degree(g), "id")
    out = s.select("id", ratio(F.col("s"), F.col("k")).alias("mean"), "largest")
    return g.nodes.select("id").join(out, "id", "left").fillna(0.0, ["mean", "largest"])


def weighted_distribution(g: Graph, values: DataFrame, n_bins: int) -> DataFrame:
    """``bin, lower, share``: distribution of a node measure ``values(id, value)`` by the nodes' weights.

    A value's bin is the whole part of (n_bins - 1) times its place between the least
    and the largest value, so the last bin holds the largest only; ``lower`` are equal
    steps of the range, as established.
    """
    v = values.join(g.nodes, "id")
    r = F.broadcast(v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("w").alias("total")))  # one row
    place = (n_bins - 1) * (1 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) * (F.col("value") - F.col("lo"))
    got = v.crossJoin(r).groupBy(F.coalesce(F.floor(place), F.lit(0)).cast("int").alias("bin")).agg(F.sum(F.col("w") / F.col("total")).alias("share"))
    every = r.filter("total is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(got, "bin", "left").select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / n_bins).alias("lower"), F.coalesce("share", F.lit(0.0)).alias("share"))


def cumulative_weighted_distribution(g: Graph, values: DataFrame, n_bins: int) -> DataFrame:
    return cumulative(weighted_distribution(g, values, n_bins))


def distance_network(g: Graph, grid: DataFrame) -> Graph:
    """The graph with link attribute ``d``, for distance-weighted paths, closeness and vulnerability."""
    return Graph(g.nodes, g.edges.join(link_distances(g, grid), ["src", "dst"]), g.directed)


def average_distance_weighted_path_length(g: Graph, grid: DataFrame) -> DataFrame:
    d = distance_network(g, grid)
    return average_path_length(d, path_lengths(d, "d"))


def distance_weighted_closeness(g: Graph, grid: DataFrame) -> DataFrame:
    d = distance_network(g, grid)
    return closeness(d, path_lengths(d, "d"), "n")


def local_distance_weighted_vulnerability(g: Graph, grid: DataFrame) -> DataFrame:
    return local_vulnerability(distance_network(g, grid), "d")
