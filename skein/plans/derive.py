"""Inputs of the registered queries, derived from whole relational tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from .blocks import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Nations linked where the revenue from customers of one to suppliers of the other is above the mean of all pairs; weight: suppliers and customers; attribute ``v``: revenue in millions."""
    t = lambda n: table(spark, sf_dir, n)
    # one row for each order first: the join with lineitem then carries nations only
    buyer = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").cast("long").alias("src"))
    seller = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    sold = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    flow = durable(sold.join(seller, "l_suppkey").join(buyer, "l_orderkey").groupBy("src", "dst").agg((F.sum("v") / 1e6).alias("v")), "trade")
    mean = F.broadcast(flow.agg(F.avg("v").alias("mean")))  # one row
    links = durable(flow.crossJoin(mean).filter("v > mean and src != dst").select("src", "dst", "v"), "trade")
    own = t("supplier").select(F.col("s_nationkey").cast("long").alias("id")).union(t("customer").select(F.col("c_nationkey").cast("long"))).groupBy("id").agg(F.count("*").cast("double").alias("w"))
    nodes = durable(t("nation").select(F.col("n_nationkey").cast("long").alias("id")).join(own, "id", "left").fillna(0.0, ["w"]), "trade")
    if directed:
        return Graph(nodes, links, True)
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    return Graph(nodes, durable(both, "trade"), False)


TRADE = """flow AS (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), d AS (SELECT src, dst, v FROM flow WHERE v > (SELECT avg(v) FROM flow) AND src <> dst),
u AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d),
n AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(coalesce(c, 0) AS DOUBLE) AS w FROM nation LEFT JOIN (
    SELECT k, count(*) AS c FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY k) ON n_nationkey = k
),
du AS (SELECT id, count(dst) AS k FROM n LEFT JOIN u ON src = id GROUP BY id),
ko AS (SELECT id, count(dst) AS k_out FROM n LEFT JOIN d ON src = id GROUP BY id),
ki AS (SELECT id, count(src) AS k_in FROM n LEFT JOIN d ON dst = id GROUP BY id),
up AS (SELECT src, dst FROM u UNION ALL SELECT id, id FROM n),
dp AS (SELECT src, dst FROM d UNION ALL SELECT id, id FROM n),
ks AS (SELECT src AS id, sum(w) AS k FROM up JOIN n ON dst = id GROUP BY src),
la AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey IN (0, 1)),
lb AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey NOT IN (0, 1))"""


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations of the first two regions, and the others."""
    n = table(spark, sf_dir, "nation")
    pick = lambda c: n.filter(c).select(F.col("n_nationkey").cast("long").alias("id"))
    return pick("n_regionkey in (0, 1)"), pick("n_regionkey not in (0, 1)")


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, t, x``: lines shipped by each nation's suppliers in each month from the first, zeros included."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("long").alias("m"))
    seller = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("node"))
    counts = durable(line.join(seller, "l_suppkey").groupBy("node", "m").agg(F.count("*").cast("double").alias("x")), "months")
    span = F.broadcast(counts.agg(F.min("m").alias("lo"), F.max("m").alias("hi")))  # one row
    grid = counts.select("node").distinct().crossJoin(span).select("node", "lo", F.explode(F.sequence("lo", "hi")).alias("m"))
    return durable(grid.join(counts, ["node", "m"], "left").select("node", (F.col("m") - F.col("lo")).alias("t"), F.coalesce("x", F.lit(0.0)).alias("x")), "months")


MONTHS = """mc AS (
  SELECT CAST(s_nationkey AS BIGINT) AS node, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS m, count(*) AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), ms AS (SELECT min(m) AS lo, max(m) AS hi FROM mc),
obs AS (
  SELECT g.node, g.m - lo AS t, CAST(coalesce(c, 0) AS DOUBLE) AS x
  FROM (SELECT node, unnest(range(lo, hi + 1)) AS m, lo FROM (SELECT DISTINCT node FROM mc), ms) g LEFT JOIN mc ON mc.node = g.node AND mc.m = g.m
)"""


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, t, x``: events of each type in each hour from the first, zeros included."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    counts = durable(e.groupBy("node", "h").agg(F.count("*").cast("double").alias("x")), "hours")
    span = F.broadcast(counts.agg(F.min("h").alias("lo"), F.max("h").alias("hi")))  # one row
    grid = counts.select("node").distinct().crossJoin(span).select("node", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return durable(grid.join(counts, ["node", "h"], "left").select("node", (F.col("h") - F.col("lo")).alias("t"), F.coalesce("x", F.lit(0.0)).alias("x")), "hours")


HOURS = """hc AS (SELECT event_type AS node, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS c FROM events GROUP BY 1, 2),
hs AS (SELECT min(h) AS lo, max(h) AS hi FROM hc),
obs AS (
  SELECT g.node, g.h - lo AS t, CAST(coalesce(c, 0) AS DOUBLE) AS x
  FROM (SELECT node, unnest(range(lo, hi + 1)) AS h, lo FROM (SELECT DISTINCT node FROM hc), hs) g LEFT JOIN hc ON hc.node = g.node AND hc.h = g.h
)"""


def hourly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, x``: events in each hour from the first, zeros included."""
    return event_hours(spark, sf_dir).groupBy(F.col("t").alias("i")).agg(F.sum("x").alias("x"))


TOTALS = HOURS + ", ts AS (SELECT t AS i, sum(x) AS x FROM obs GROUP BY t)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, x``: events in each six hours from the first."""
    return hourly_total(spark, sf_dir).groupBy(F.floor(F.col("i") / 6).alias("i")).agg(F.sum("x").alias("x"))


SIX = TOTALS + ", six AS (SELECT CAST(floor(i / 6) AS BIGINT) AS i, sum(x) AS x FROM ts GROUP BY 1)"


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, lat, lon`` of the nations, placed by their keys."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("node"), (-60.0 + 5 * k).alias("lat"), (-180.0 + 14 * k).alias("lon"))


GRID = "grid AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(-60.0 + 5 * n_nationkey AS DOUBLE) AS lat, CAST(-180.0 + 14 * n_nationkey AS DOUBLE) AS lon FROM nation)"
