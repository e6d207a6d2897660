"""More registered queries of series, coupling, recurrence, visibility and surrogates, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climate as K
from ..operators import clustering as C
from ..operators import coupling as Q
from ..operators import graph as G
from ..operators import interacting as I
from ..operators import paths as P
from ..operators import recurrence as R
from ..operators import series as S
from ..operators import surrogates as U
from ..operators import visibility as V
from . import derive as D
from .blocks import durable
from .catalog import ANOM, EMB, HALF, RPS, VIS, add, embedded, hist_sql, on_months, on_plot, r6, two_plots

# data ------------------------------------------------------------------------------------------

for _kind, (_steps, _offset) in {"int16": ("65534.0", "(hi + lo) / 2"), "uint8": ("255.0", "lo")}.items():
    on_months(f"rescale_{_kind}", lambda o, k=_kind: S.rescale(o, k), f"SELECT node, t, CAST(trunc((x - {_offset}) / ((hi - lo) / {_steps})) AS BIGINT) AS x, {r6(f'(hi - lo) / {_steps}')} AS scale_factor, {r6(_offset)} AS add_offset FROM obs, (SELECT min(x) AS lo, max(x) AS hi FROM obs)")
PADDED = ", ln AS (SELECT count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM (SELECT DISTINCT t FROM obs))"
on_months("zero_padded", S.zero_pad, "SELECT node, t, x FROM obs UNION ALL SELECT node, k AS t, 0.0 AS x FROM (SELECT DISTINCT node FROM obs), (SELECT unnest(range(-((size - n) // 2), 0)) AS k FROM ln) UNION ALL SELECT node, k, 0.0 FROM (SELECT DISTINCT node FROM obs), (SELECT unnest(range(n, size - (size - n) // 2)) AS k FROM ln)", PADDED)
TAPER = "CASE WHEN least(t, n - 1 - t) < floor({0} * n / 2) THEN 0.5 * (1 + cos(least(t, n - 1 - t) * pi() / floor({0} * n / 2) + pi())) ELSE 1 END"
on_months("cosine_window", lambda o: S.cos_window(o, 0.4), f"SELECT node, t, {r6(TAPER.format('0.4'))} AS taper FROM obs, ln", PADDED)
on_months("selected_months", lambda o: S.selected_months(o.select("t"), 12, [0, 1, 11]), "SELECT DISTINCT t FROM obs WHERE t % 12 IN (0, 1, 11) AND t < (SELECT floor((max(t) + 1) / 12) * 12 FROM obs)")
on_months("selected_phases", lambda o: S.selected_phases(o.select("t"), 5, [1, 3]), "SELECT DISTINCT t FROM obs WHERE t % 5 IN (1, 3) AND t < (SELECT floor((max(t) + 1) / 5) * 5 FROM obs)")
on_months("shuffled_anomaly_deviation", lambda o: S.shuffled(S.anomaly(o, 12)).groupBy("node").agg(F.stddev_pop("x").alias("sd")), f"SELECT node, {r6('stddev_pop(x)')} AS sd FROM an GROUP BY 1", ANOM)

# coupling --------------------------------------------------------------------------------------

#: i at t - tau beside j at t over the times that allow every lag, as ranks' symbols of six bins, and their information over the whole record's length.
SYM = ", tm AS (SELECT max(t) + 1 AS tt FROM obs), tl AS (SELECT unnest(range(0, 3)) AS tau), xs AS (SELECT node, tau, t + tau AS t, x FROM obs, tl WHERE t + tau >= 2 AND t + tau < (SELECT tt FROM tm)), sy AS (SELECT node, tau, t, floor(max(r) OVER (PARTITION BY node, tau, x) / ceil(c / 6.0)) AS b FROM (SELECT node, tau, t, x, row_number() OVER (PARTITION BY node, tau ORDER BY x, t) - 1 AS r, count(*) OVER (PARTITION BY node, tau) AS c FROM xs)), jh AS (SELECT a.node AS i, b.node AS j, a.tau AS tau, a.b AS p, b.b AS q, count(*) AS n FROM sy a JOIN sy b ON a.t = b.t AND b.tau = 0 GROUP BY 1, 2, 3, 4, 5), mi AS (SELECT i, j, tau, (sum(n * ln(n)) - max(hp) - max(hq) + max(s * ln(s))) / max(tt) AS s FROM (SELECT jh.*, sum(n) OVER (PARTITION BY i, j, tau) AS s FROM jh) JOIN (SELECT i, j, tau, sum(n * ln(n)) AS hp FROM (SELECT i, j, tau, p, sum(n) AS n FROM jh GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (i, j, tau) JOIN (SELECT i, j, tau, sum(n * ln(n)) AS hq FROM (SELECT i, j, tau, q, sum(n) AS n FROM jh GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (i, j, tau), tm GROUP BY 1, 2, 3)"
on_months("lagged_information_binning", lambda o: Q.mutual_information(o, 2, "binning"), f"SELECT i, j, tau, {r6('s')} AS s FROM mi", SYM)
on_months("lagged_information_binning_max", lambda o: Q.most_information(Q.mutual_information(o, 2, "binning")), f"SELECT i, j, {r6('s')} AS s, tau AS lag FROM (SELECT i, j, s, tau, row_number() OVER (PARTITION BY i, j ORDER BY round(s, 12) DESC, tau) AS r FROM mi) WHERE r = 1", SYM)
LAGS = ", tl AS (SELECT unnest(range(0, 3)) AS tau), gx AS (SELECT a.node AS i, b.node AS j, tau, corr(a.x, b.x) AS c FROM tl, obs a JOIN obs b ON b.t = a.t + tau WHERE b.t >= 2 GROUP BY 1, 2, 3)"
on_months("lagged_information_gauss", lambda o: Q.mutual_information(o, 2, "gauss").filter("i != j"), f"SELECT i, j, tau, {r6('-0.5 * ln(1 - c * c)')} AS s FROM gx WHERE i <> j", LAGS)
TRANSFER = ", tl AS (SELECT unnest(range(0, 3)) AS tau), tr AS (SELECT a.node AS i, b.node AS j, tau, corr(a.x, b.x) AS xy, corr(a.x, z.x) AS xz, corr(b.x, z.x) AS yz FROM tl, obs a JOIN obs b ON b.t = a.t + tau JOIN obs z ON z.node = b.node AND z.t = b.t - 1 WHERE b.t >= 3 AND a.node <> b.node GROUP BY 1, 2, 3), te AS (SELECT i, j, tau, -0.5 * ln(1 - pow(xy - xz * yz, 2) / ((1 - xz * xz) * (1 - yz * yz))) AS s FROM tr)"
on_months("information_transfer_gauss", lambda o: Q.information_transfer(o, 2, "gauss"), f"SELECT i, j, tau, {r6('s')} AS s FROM te UNION ALL SELECT node, node, tau, 0.0 FROM (SELECT DISTINCT node FROM obs), tl", TRANSFER)
on_months("information_transfer_gauss_max", lambda o: Q.most_information(Q.information_transfer(o, 2, "gauss")).filter("i != j"), f"SELECT i, j, {r6('s')} AS s, tau AS lag FROM (SELECT i, j, s, tau, row_number() OVER (PARTITION BY i, j ORDER BY round(s, 12) DESC, tau) AS r FROM te) WHERE r = 1", TRANSFER)
on_months("information_transfer_momentary", lambda o: Q.information_transfer(o, 1, "gauss", mode="mit"))
TWO = ", tl AS (SELECT unnest(range(-2, 3)) AS tau), tm AS (SELECT max(t) AS hi FROM obs), cc AS (SELECT a.node AS i, b.node AS j, tau, coalesce(corr(a.x, b.x), 0) AS s FROM tl, tm, obs a JOIN obs b ON b.t = a.t + tau WHERE a.t BETWEEN 2 AND hi - 2 GROUP BY 1, 2, 3)"
on_months("cross_correlation_two_sided", lambda o: Q.cross_correlation(o, 2, True), f"SELECT i, j, tau, {r6('s')} AS s FROM cc", TWO)
on_months("cross_correlation_sided_sums", lambda o: Q.sided_sums(Q.cross_correlation(o, 2, True)), f"SELECT i, j, {r6('sum(CASE WHEN tau >= 0 THEN abs(s) ELSE 0 END)')} AS forward, {r6('sum(CASE WHEN tau <= 0 THEN abs(s) ELSE 0 END)')} AS backward FROM cc GROUP BY 1, 2", TWO)
_lag = ", lg AS (SELECT a.node AS i, b.node AS j, tau, coalesce(corr(a.x, b.x), 0) AS s FROM (SELECT unnest(range(0, 4)) AS tau), obs a JOIN obs b ON b.t = a.t + tau WHERE b.t >= 3 GROUP BY 1, 2, 3), bs AS (SELECT i, j, s, tau AS lag FROM (SELECT i, j, s, tau, row_number() OVER (PARTITION BY i, j ORDER BY round(abs(s), 12) DESC, tau DESC) AS r FROM lg) WHERE r = 1)"
on_months("symmetrized_correlation", lambda o: S.symmetrize_by_absmax(Q.strongest_lag(Q.cross_correlation(o, 3))), f"SELECT a.i AS i, a.j AS j, {r6('CASE WHEN abs(a.s) >= abs(b.s) THEN a.s ELSE b.s END')} AS s, CASE WHEN abs(a.s) >= abs(b.s) THEN a.lag ELSE -b.lag END AS lag FROM bs a JOIN bs b ON a.i = b.j AND a.j = b.i", _lag)
NORMED = ", tl AS (SELECT unnest(range(-1, 2)) AS tau), tm AS (SELECT max(t) AS hi FROM obs), xs AS (SELECT node, tau, t - tau AS t, x FROM obs, tl, tm WHERE t - tau BETWEEN 1 AND hi - 1), sy AS (SELECT node, tau, t, floor(max(r) OVER (PARTITION BY node, tau, x) / ceil(c / 8.0)) AS b, c FROM (SELECT node, tau, t, x, row_number() OVER (PARTITION BY node, tau ORDER BY x, t) - 1 AS r, count(*) OVER (PARTITION BY node, tau) AS c FROM xs)), jh AS (SELECT a.node AS i, b.node AS j, b.tau AS tau, max(a.c) AS c, count(*) AS n FROM sy a JOIN sy b ON a.t = b.t AND a.tau = 0 GROUP BY 1, 2, 3, a.b, b.b)"
on_months("normalized_information", lambda o: Q.normalized_information(o, 8, 1), f"SELECT i, j, tau, {r6('(2 * ln(max(u)) - ln(max(c)) + sum(n * ln(n)) / max(c)) / ln(max(u))')} AS s FROM (SELECT *, ceil(c / ceil(c / 8.0)) AS u FROM jh) GROUP BY 1, 2, 3", NORMED)
on_months("quantile_edges", lambda o: Q.quantile_edges(o, 6), "SELECT node, CAST(r / ceil(c / 6.0) AS BIGINT) AS bin, x AS edge FROM (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY node) AS c FROM obs) WHERE r % ceil(c / 6.0) = 0")
on_months("shuffled_surrogate_correlation", lambda o: Q.shuffled_surrogate(o, lambda x: Q.cross_correlation(x, 0), 2))
on_months("time_surrogate_correlation", lambda o: Q.time_surrogate(o, "cc", 40, 1))
on_months("time_surrogate_information", lambda o: Q.time_surrogate(o, "mi", 40, 1, 6))
on_months("mutual_information_lagged", lambda o: S.mutual_information(S.binned(o, 5), 2), f"SELECT i, j, {r6('sum(n / tt * ln(n * tt / (np * nq)))')} AS s FROM jm GROUP BY 1, 2", ", bn AS (SELECT node, t, least(floor((x - lo) / (hi - lo) * 5), 4) AS b FROM obs, (SELECT min(x) AS lo, max(x) AS hi FROM obs)), jt AS (SELECT a.node AS i, b.node AS j, a.b AS p, b.b AS q, count(*) AS n FROM bn a JOIN bn b ON b.t = a.t + 2 GROUP BY 1, 2, 3, 4), jm AS (SELECT *, sum(n) OVER (PARTITION BY i, j, p) AS np, sum(n) OVER (PARTITION BY i, j, q) AS nq, sum(n) OVER (PARTITION BY i, j) AS tt FROM jt)")

# other similarities ----------------------------------------------------------------------------

#: Normalised, tapered and padded series, correlated around the circle.
CIRCLE = ANOM + PADDED + f", zz AS (SELECT node, t + (size - n) // 2 AS t, (x - avg(x) OVER w) / stddev_pop(x) OVER w * {TAPER.format('0.2')} AS z, size FROM an, ln WINDOW w AS (PARTITION BY node)), ks AS (SELECT unnest(range(-6, 6)) AS k), cr AS (SELECT a.node AS i, b.node AS j, k, abs(sum(a.z * b.z)) AS c FROM ks, zz a JOIN zz b ON b.t = (a.t + k + a.size) % a.size WHERE k <> -1 GROUP BY 1, 2, 3)"
on_months("correlation_strength", lambda o: K.correlation_strength(S.anomaly(o, 12), 6), f"SELECT i, j, {r6('max(c) / stddev_pop(c)')} AS s, arg_max(CASE WHEN k < 0 THEN k ELSE k - 1 END, round(c, 9) - 1e-10 * k) AS lag FROM cr GROUP BY 1, 2", CIRCLE)
HILB = ANOM + PADDED.replace("ln AS", "hn AS") + ", hk AS (SELECT m, sum(CASE WHEN f = 0 THEN 1 WHEN 2 * f < n THEN 2 WHEN 2 * f = n THEN 1 ELSE 0 END * sin(2 * pi() * f * m / n)) / max(n) AS h FROM hn, (SELECT unnest(range(0, (SELECT n FROM hn))) AS m), (SELECT unnest(range(0, (SELECT n FROM hn))) AS f) GROUP BY m), zi AS (SELECT a.node AS node, a.t AS t, sum(b.x * h) AS im FROM an a JOIN an b ON a.node = b.node, hn JOIN hk ON TRUE WHERE m = (a.t - b.t + n) % n GROUP BY 1, 2), zc AS (SELECT an.node AS node, an.t AS t, x - avg(x) OVER w AS re, im - avg(im) OVER w AS im FROM an JOIN zi ON zi.node = an.node AND zi.t = an.t WINDOW w AS (PARTITION BY an.node)), zn AS (SELECT node, t, re / sz AS re, im / sz AS im FROM (SELECT *, sqrt(avg(re * re + im * im) OVER (PARTITION BY node)) AS sz FROM zc)), hc AS (SELECT a.node AS i, b.node AS j, sum(a.re * b.re + a.im * b.im) / (count(*) - 1) AS re, sum(a.im * b.re - a.re * b.im) / (count(*) - 1) AS im FROM zn a JOIN zn b USING (t) GROUP BY 1, 2)"
on_months("hilbert_coherence", lambda o: K.hilbert_coherence(S.anomaly(o, 12)).filter("i != j"), f"SELECT i, j, {r6('sqrt(re * re + im * im)')} AS s, {r6('atan2(im, re)')} AS phase FROM hc WHERE i <> j", HILB)
on_months("hilbert_network", lambda o: K.hilbert_network(K.hilbert_coherence(S.anomaly(o, 12)), 0.2).edges.select("src", "dst"), "SELECT i AS src, j AS dst FROM hc WHERE i <> j AND sqrt(re * re + im * im) > 0.2 AND atan2(im, re) > 0", HILB)
NORM = ", nz AS (SELECT node, t, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM obs WINDOW w AS (PARTITION BY node))"
on_months("surrogate_test_pearson", lambda o: (lambda z: U.test_pearson(z, z))(S.normalize(o)), f"SELECT a.node AS i, b.node AS j, {r6('CASE WHEN a.node = b.node THEN 0 ELSE avg(a.x * b.x) END')} AS s FROM nz a JOIN nz b USING (t) GROUP BY 1, 2", NORM)
TMI = ", bn AS (SELECT node, t, least(floor((x - lo) * (1 / (hi - lo)) * 8), 7) AS b FROM obs, (SELECT min(x) AS lo, max(x) AS hi FROM obs)), jt AS (SELECT a.node AS i, b.node AS j, a.b AS p, b.b AS q, count(*) AS n FROM bn a JOIN bn b USING (t) GROUP BY 1, 2, 3, 4), jm AS (SELECT *, sum(n) OVER (PARTITION BY i, j, p) AS np, sum(n) OVER (PARTITION BY i, j, q) AS nq, sum(n) OVER (PARTITION BY i, j) AS tt FROM jt)"
on_months("surrogate_test_information", lambda o: U.test_mutual_information(o, o, 8), f"SELECT i, j, {r6('CASE WHEN i = j THEN 0 ELSE sum(n / tt * ln(n * tt / (np * nq))) END')} AS s FROM jm GROUP BY 1, 2", TMI)
on_months("surrogate_original_distribution", lambda o: U.original_distribution(o, lambda a, b: U.test_pearson(a, b).withColumn("s", F.round("s", 7)), 10), hist_sql("(SELECT abs(round(CASE WHEN a.node = b.node THEN 0 ELSE avg(a.x * b.x) END, 7)) AS s FROM nz a JOIN nz b USING (t) GROUP BY a.node, b.node)", "s", "CAST(10 AS DOUBLE)"), NORM)
on_months("surrogate_threshold_significance", lambda o: U.threshold_significance(o, U.white_noise, U.test_pearson, 3, 10, (0.0, 1.0)))
on_months("surrogate_spectrum", U.spectrum, f"SELECT node, k, {r6('sum(x * cos(2 * pi() * k * t / n))')} AS re, {r6('-sum(x * sin(2 * pi() * k * t / n))')} AS im FROM obs, ln, (SELECT unnest(range(0, (SELECT n // 2 + 1 FROM ln))) AS k) GROUP BY 1, 2", PADDED)
on_months("surrogate_fourier_power", lambda o: U.spectrum(U.fourier(o)).select("node", "k", F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 4).alias("size")).filter("k between 1 and 40"), f"SELECT node, k, round(sqrt(pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2)), 4) AS size FROM obs, ln, (SELECT unnest(range(1, 41)) AS k) GROUP BY 1, 2", PADDED)
on_months("surrogate_white_noise_values", lambda o: U.white_noise(o).groupBy("node", "x").agg(F.count("*").alias("n")), "SELECT node, x, count(*) AS n FROM obs GROUP BY 1, 2")
on_months("surrogate_aaft_values", lambda o: U.aaft(o).groupBy("node", "x").agg(F.count("*").alias("n")), "SELECT node, x, count(*) AS n FROM obs GROUP BY 1, 2")
on_months("surrogate_refined_aaft_values", lambda o: U.refined_aaft(o).groupBy("node", "x").agg(F.count("*").alias("n")), "SELECT node, x, count(*) AS n FROM obs GROUP BY 1, 2")
on_months("delay_embedding_series", lambda o: R.embed(o.select("node", F.col("t").alias("i"), "x"), 3, 2).select("node", "i", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), F.get("v", F.lit(2)).alias("c")), "SELECT node, t AS i, x AS a, b, c FROM (SELECT node, t, x, lead(x, 2) OVER w AS b, lead(x, 4) OVER w AS c FROM obs WINDOW w AS (PARTITION BY node ORDER BY t)) WHERE c IS NOT NULL")

# recurrence ------------------------------------------------------------------------------------

DIST = {"supremum": "greatest(abs(p.a - q.a), abs(p.b - q.b))", "manhattan": "abs(p.a - q.a) + abs(p.b - q.b)", "euclidean": "sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2))"}
for _metric, _d in DIST.items():
    add(f"distance_{_metric}", lambda spark, sf, m=_metric: (lambda x: R.pair_distances(x, x, m))(embedded(spark, sf)), f"SELECT p.i AS i, q.i AS j, {r6(_d)} AS d FROM ep p, ep q", EMB)
    add(f"recurrence_{_metric}", lambda spark, sf, m=_metric: R.recurrences(embedded(spark, sf), 7.5, m), f"SELECT p.i AS i, q.i AS j FROM ep p, ep q WHERE {_d} < 7.5", EMB)
PAIRS = EMB + f", pq AS (SELECT p.i AS i, q.i AS j, {DIST['supremum']} AS d FROM ep p, ep q)"
add("recurrence_by_std", lambda spark, sf: R.by_std(embedded(spark, sf), 0.5), "SELECT i, j FROM pq WHERE d < (SELECT 0.5 * stddev_pop(v) FROM (SELECT a AS v FROM ep UNION ALL SELECT b FROM ep))", PAIRS)
RATE = "(SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM pq) WHERE r = CAST(floor({0} * (n - 1)) AS BIGINT))"
add("threshold_from_recurrence_rate", lambda spark, sf: (lambda x: R.threshold_of_rate(R.pair_distances(x, x), 0.2))(embedded(spark, sf)), f"SELECT {RATE.format('0.2')} AS threshold", PAIRS)
add("recurrence_by_rate", lambda spark, sf: R.by_rate(embedded(spark, sf), 0.2), f"SELECT i, j FROM pq WHERE d < {RATE.format('0.2')}", PAIRS)
LOCAL = "SELECT i, j FROM pq JOIN (SELECT i, d AS lim FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS r, count(*) OVER (PARTITION BY i) AS n FROM pq) WHERE r = CAST(floor(0.3 * (n - 1)) AS BIGINT)) USING (i) WHERE d < lim"
add("recurrence_by_local_rate", lambda spark, sf: (lambda x: R.fixed_local_rate(R.pair_distances(x, x), 0.3))(embedded(spark, sf)), LOCAL, PAIRS)
add("recurrence_adaptive", lambda spark, sf: (lambda x: R.adaptive_neighbors(R.pair_distances(x, x), 4))(embedded(spark, sf)))
add("legendre_coordinates", lambda spark, sf: (lambda t: R.legendre(t, 3, 4))(D.daily(spark, sf).withColumn("t", F.col("i").cast("double"))).select("i", *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(3)]))


def network_of(make: Callable, sql: str, name: str) -> None:
    add(f"recurrence_network_{name}", lambda spark, sf: (lambda x: G.degree(R.network(make(x), x.select("i"))))(embedded(spark, sf)), f"SELECT ep.i AS id, count(r0.j) AS k FROM ep LEFT JOIN ({sql}) r0 ON r0.i = ep.i AND r0.i <> r0.j GROUP BY 1", PAIRS)


network_of(lambda x: R.by_std(x, 0.5), "SELECT i, j FROM pq WHERE d < (SELECT 0.5 * stddev_pop(v) FROM (SELECT a AS v FROM ep UNION ALL SELECT b FROM ep))", "by_std")
network_of(lambda x: R.by_rate(x, 0.2), f"SELECT i, j FROM pq WHERE d < {RATE.format('0.2')}", "by_rate")
add("recurrence_network_by_local_rate", lambda spark, sf: (lambda x: G.out_degree(R.network(R.fixed_local_rate(R.pair_distances(x, x), 0.3), x.select("i"), True)))(embedded(spark, sf)), f"SELECT ep.i AS id, count(r0.j) AS k_out FROM ep LEFT JOIN ({LOCAL}) r0 ON r0.i = ep.i AND r0.i <> r0.j GROUP BY 1", PAIRS)
add("recurrence_network_adaptive", lambda spark, sf: (lambda x: G.degree(R.network(R.adaptive_neighbors(R.pair_distances(x, x), 4), x.select("i"))))(embedded(spark, sf)))
TRIS = "SELECT a.i AS id, count(*) AS t FROM e a JOIN e b ON a.j = b.i JOIN e c ON c.i = b.j AND c.j = a.i GROUP BY 1"
on_plot("recurrence_network_local_dimension", lambda rp, x, n: R.single_scale_dimension(C.local_clustering(R.network(rp, x.select("i")))), f"SELECT ep.i AS id, {r6('CASE WHEN t > 0 AND k > 1 THEN ln(t / (k * (k - 1))) / ln(0.75) END')} AS value FROM ep LEFT JOIN (SELECT i, count(*) AS k FROM e GROUP BY 1) k ON k.i = ep.i LEFT JOIN ({TRIS}) t ON t.id = ep.i", ", e AS (SELECT i, j FROM rp WHERE i <> j)")

#: Every ninth state without a value: no recurrences there, no lines that touch it.
GAPPED = RPS + ", ms AS (SELECT i FROM ep WHERE i % 9 = 4), rm AS (SELECT i, j FROM rp WHERE i NOT IN (SELECT i FROM ms) AND j NOT IN (SELECT i FROM ms))"


def gapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = embedded(spark, sf).select("i", F.when(F.col("i") % 9 == 4, F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))).otherwise(F.col("v")).alias("v"))
    return durable(R.recurrences(x, 6.0), "plot"), R.missing_states(x), x.select("i")


add("recurrence_missing", lambda spark, sf: gapped(spark, sf)[0], "SELECT i, j FROM rm", GAPPED)
add("rqa_vertical_lines_missing", lambda spark, sf: (lambda t: R.vertical_lines(t[0], t[1]))(gapped(spark, sf)), "SELECT len, count(*) AS cnt FROM (SELECT i, g, count(*) AS len, min(j) AS a, max(j) AS b FROM (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS g FROM rm) GROUP BY 1, 2) WHERE (a - 1) NOT IN (SELECT i FROM ms) AND (b + 1) NOT IN (SELECT i FROM ms) GROUP BY 1", GAPPED)
add("rqa_diagonal_lines_missing", lambda spark, sf: (lambda t: R.diagonal_lines(*t))(gapped(spark, sf)), "SELECT len, 2 * count(*) AS cnt FROM (SELECT line, g, count(*) AS len, min(i) AS a, max(i) AS b FROM (SELECT j - i AS line, i, i - row_number() OVER (PARTITION BY j - i ORDER BY i) AS g FROM rm WHERE j > i) GROUP BY 1, 2) WHERE NOT (a > 0 AND ((a - 1) IN (SELECT i FROM ms) OR (a - 1 + line) IN (SELECT i FROM ms))) AND NOT (b + 1 + line <= (SELECT max(i) FROM ep) AND ((b + 1) IN (SELECT i FROM ms) OR (b + 1 + line) IN (SELECT i FROM ms))) GROUP BY 1", GAPPED)
add("rqa_recurrence_summary_lines", lambda spark, sf: (lambda x: R.line_measures(R.diagonal_lines(R.by_rate(x, 0.2))))(embedded(spark, sf)))
CE = D.SIX + ", op AS (SELECT (a <= b) AS p, (a <= c) AS q, (b <= c) AS s, count(*) AS n FROM (SELECT x AS a, lead(x) OVER (ORDER BY i) AS b, lead(x, 2) OVER (ORDER BY i) AS c FROM six) WHERE c IS NOT NULL GROUP BY 1, 2, 3), pp AS (SELECT n / (SELECT sum(n) FROM op) AS p FROM op), hh AS (SELECT -sum(p * log2(p)) AS h, -sum((p + 1.0 / 6) / 2 * log2((p + 1.0 / 6) / 2)) - (6 - count(*)) * (1.0 / 12) * log2(1.0 / 12) AS m FROM pp)"
add("complexity_entropy", lambda spark, sf: R.complexity_entropy(R.embed(D.daily(spark, sf), 3, 1), 3), f"SELECT {r6('h / log2(6) * (m - h / 2 - log2(6) / 2) / (-0.5 * (7.0 / 6 * log2(7) - 2 * log2(12) + log2(6)))')} AS value FROM hh", CE)

# two systems -----------------------------------------------------------------------------------

NX, NY = "(SELECT count(*) FROM xs)", "(SELECT count(*) FROM ys)"
CROSS = HALF + ", dx AS (SELECT a.i AS i, b.i AS j, abs(a.x - b.x) AS d FROM xs a, xs b), dy AS (SELECT a.i AS i, b.i AS j, abs(a.x - b.x) AS d FROM ys a, ys b), dc AS (SELECT a.i AS i, b.i AS j, abs(a.x - b.x) AS d FROM xs a, ys b)"
add("cross_distance", lambda spark, sf: (lambda t: R.pair_distances(t[0], t[1]))(two_plots(spark, sf)), "SELECT i, j, d FROM dc", CROSS)


def rate_of(table: str, rate: float) -> str:
    return f"(SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM {table}) WHERE r = CAST(floor({rate} * (n - 1)) AS BIGINT))"


def std_of(table: str, factor: float) -> str:
    return f"(SELECT {factor} * stddev_pop(x) FROM {table})"


add("cross_recurrence_by_rate", lambda spark, sf: (lambda t: R.by_rate(t[0], 0.3, y=t[1]))(two_plots(spark, sf)), f"SELECT i, j FROM dc WHERE d < {rate_of('dc', 0.3)}", CROSS)
JR = f"SELECT i, j FROM dx WHERE d < {rate_of('dx', 0.4)} INTERSECT SELECT i, j FROM dy WHERE d < {rate_of('dy', 0.4)}"
JS = f"SELECT i, j FROM dx WHERE d < {std_of('xs', 0.8)} INTERSECT SELECT i, j FROM dy WHERE d < {std_of('ys', 0.8)}"
_by_rate = lambda t: R.joint(R.by_rate(t[0], 0.4), R.by_rate(t[1], 0.4))
_by_std = lambda t: R.joint(R.by_std(t[0], 0.8), R.by_std(t[1], 0.8))
add("joint_recurrence_by_rate", lambda spark, sf: _by_rate(two_plots(spark, sf)), JR, CROSS)
add("joint_recurrence_by_std", lambda spark, sf: _by_std(two_plots(spark, sf)), JS, CROSS)
add("joint_recurrence_lagged", lambda spark, sf: (lambda t: R.joint(t[2], t[3], 2))(two_plots(spark, sf)), "SELECT rx.i AS i, rx.j AS j FROM rx JOIN ry ON ry.i = rx.i + 2 AND ry.j = rx.j + 2", HALF)
for _name, _make, _sql in (("", lambda t: R.joint(t[2], t[3]), "SELECT i, j FROM rx INTERSECT SELECT i, j FROM ry"), ("_by_rate", _by_rate, JR), ("_by_std", _by_std, JS)):
    add(f"joint_recurrence_network{_name}", lambda spark, sf, m=_make: (lambda t: G.degree(R.network(m(t), t[0].select("i"))))(two_plots(spark, sf)), f"SELECT xs.i AS id, count(r0.j) AS k FROM xs LEFT JOIN ({_sql}) r0 ON r0.i = xs.i AND r0.i <> r0.j GROUP BY 1", CROSS)
OFF = "(SELECT max(i) + 1 FROM xs)"
ISN = CROSS + f", u AS (SELECT i AS src, j AS dst FROM rx WHERE i <> j UNION ALL SELECT i + {OFF}, j + {OFF} FROM ry WHERE i <> j UNION ALL SELECT i, j + {OFF} FROM rc UNION ALL SELECT j + {OFF}, i FROM rc), la AS (SELECT i AS id FROM xs), lb AS (SELECT i + {OFF} AS id FROM ys)"
_isn = lambda t: R.inter_system_network(t[0], t[1], t[2], t[3], t[4])


def between(a: str, b: str) -> tuple[str, str]:
    cl = f"SELECT src, dst FROM u WHERE src IN (SELECT id FROM {a}) AND dst IN (SELECT id FROM {b})"
    return f"SELECT {a}.id AS id, count(dst) AS k FROM {a} LEFT JOIN ({cl}) ON src = {a}.id GROUP BY 1", f"SELECT a.src AS id, count(*) AS t FROM ({cl}) a JOIN ({cl}) b ON a.src = b.src AND a.dst < b.dst JOIN u ON u.src = a.dst AND u.dst = b.dst GROUP BY 1"


for _way, (_a, _b) in {"xy": ("la", "lb"), "yx": ("lb", "la")}.items():
    _k, _t = between(_a, _b)
    _swap = _way == "yx"
    add(f"inter_system_cross_clustering_{_way}", lambda spark, sf, s=_swap: (lambda g, a, b: I.cross_global_clustering(g, *((b, a) if s else (a, b))))(*_isn(two_plots(spark, sf))), f"SELECT {r6('avg(coalesce(2 * t / nullif(k * (k - 1), 0), 0))')} AS value FROM ({_k}) LEFT JOIN ({_t}) USING (id)", ISN)
    add(f"inter_system_cross_transitivity_{_way}", lambda spark, sf, s=_swap: (lambda g, a, b: I.cross_transitivity(g, *((b, a) if s else (a, b))))(*_isn(two_plots(spark, sf))), f"SELECT {r6('sum(coalesce(t, 0)) / sum(k * (k - 1) / 2)')} AS value FROM ({_k}) LEFT JOIN ({_t}) USING (id)", ISN)
add("inter_system_internal_rates", lambda spark, sf: (lambda t: R.recurrence_rate(t[2], t[0].count()).select(F.lit("x").alias("system"), "value").union(R.recurrence_rate(t[3], t[1].count()).select(F.lit("y"), "value")))(two_plots(spark, sf)), f"SELECT 'x' AS system, {r6(f'count(*) / pow({NX}, 2)')} AS value FROM rx UNION ALL SELECT 'y', {r6(f'count(*) / pow({NY}, 2)')} FROM ry", HALF)
add("inter_system_by_rate", lambda spark, sf: (lambda t: R.inter_system(R.by_rate(t[0], 0.3), R.by_rate(t[1], 0.3), R.by_rate(t[0], 0.2, y=t[1]), R.system_offset(t[0])))(two_plots(spark, sf)), f"SELECT i AS src, j AS dst FROM dx WHERE i <> j AND d < {rate_of('dx', 0.3)} UNION ALL SELECT i + {OFF}, j + {OFF} FROM dy WHERE i <> j AND d < {rate_of('dy', 0.3)} UNION ALL SELECT i, j + {OFF} FROM dc WHERE d < {rate_of('dc', 0.2)} UNION ALL SELECT j + {OFF}, i FROM dc WHERE d < {rate_of('dc', 0.2)}", CROSS)

# visibility ------------------------------------------------------------------------------------

VBASE = D.SIX + f", up1 AS (SELECT a.i AS src, b.i AS dst FROM six a JOIN six b ON a.i < b.i WHERE {VIS['natural']}), v AS (SELECT src, dst FROM up1 UNION ALL SELECT dst, src FROM up1), nm AS (SELECT count(*) AS n FROM six), walk(src, dst, h) AS (SELECT i, i, 0 FROM six UNION SELECT walk.src, v.dst, h + 1 FROM walk JOIN v ON v.src = walk.dst WHERE h < 12), dist AS (SELECT src, dst, CAST(min(h) AS DOUBLE) AS d FROM walk GROUP BY 1, 2)"


def vgraph(spark: SparkSession, sf: str) -> G.Graph:
    g = V.graph(D.daily(spark, sf).withColumn("t", F.col("i").cast("double")))
    return G.Graph(durable(g.nodes, "nodes"), durable(g.edges, "links"), False)


def on_visibility(name: str, f: Callable, sql: str) -> None:
    add(name, lambda spark, sf: f(vgraph(spark, sf)), f"WITH RECURSIVE {VBASE} {sql}")


on_visibility("visibility_advanced_clustering", lambda g: V.directional_clustering(g, "advanced"), f"SELECT six.i AS id, {r6('coalesce(2 * max(t) / nullif(max(k) * (max(k) - 1), 0), 0)')} AS value FROM six LEFT JOIN (SELECT src AS id, count(*) AS k FROM up1 GROUP BY 1) a ON a.id = six.i LEFT JOIN (SELECT a.src AS id, count(*) AS t FROM up1 a JOIN up1 b ON a.src = b.src AND a.dst < b.dst JOIN up1 c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) b ON b.id = six.i GROUP BY six.i")
on_visibility("visibility_boundary_corrected_degree", V.boundary_corrected_degree, f"SELECT six.i AS id, {r6('(count(CASE WHEN dst < i THEN 1 END) * i + count(CASE WHEN dst > i THEN 1 END) * (max(n) - 1 - i)) / (max(n) - 1)')} AS value FROM six LEFT JOIN v ON src = i, nm GROUP BY i")
VC = "SELECT i AS id, max(n) AS n, 1 / avg(CASE WHEN dst < i THEN d END) AS r, 1 / avg(CASE WHEN dst > i THEN d END) AS a FROM six JOIN dist ON src = i, nm GROUP BY i"
on_visibility("visibility_retarded_closeness", lambda g: V.directional_closeness(g, P.path_lengths(g), "retarded"), f"SELECT id, {r6('r')} AS value FROM ({VC})")
on_visibility("visibility_advanced_closeness", lambda g: V.directional_closeness(g, P.path_lengths(g), "advanced"), f"SELECT id, {r6('a')} AS value FROM ({VC})")
on_visibility("visibility_boundary_corrected_closeness", lambda g: V.boundary_corrected_closeness(g, P.path_lengths(g)), f"SELECT id, {r6('(n - 1) * (r / nullif(id, 0) + a / nullif(n - 1 - id, 0))')} AS value FROM ({VC})")
VSP = ", sp(src, dst, h) AS (SELECT i, i, 0 FROM six UNION ALL SELECT sp.src, v.dst, sp.h + 1 FROM sp JOIN v ON v.src = sp.dst JOIN dist z ON z.src = sp.src AND z.dst = v.dst AND z.d = sp.h + 1), sg AS (SELECT src, dst, CAST(h AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS s FROM sp GROUP BY 1, 2, 3)"
for _side, _cond in {"retarded": "a.src < a.dst AND b.dst < a.dst", "advanced": "a.src > a.dst AND b.dst > a.dst", "trans": "a.src < a.dst AND b.dst > a.dst"}.items():
    add(f"visibility_{_side}_betweenness", lambda spark, sf, s=_side: V.directional_betweenness(vgraph(spark, sf), s), f"WITH RECURSIVE {VBASE}{VSP} SELECT six.i AS id, {r6('coalesce(sum(p), 0)')} AS value FROM six LEFT JOIN (SELECT a.dst AS id, a.s * b.s / c.s AS p FROM sg a JOIN sg b ON b.src = a.dst JOIN sg c ON c.src = a.src AND c.dst = b.dst AND c.d = a.d + b.d WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst AND {_cond}) t ON t.id = six.i GROUP BY six.i")
GAPV = D.SIX + ", sx AS (SELECT i, CASE WHEN i % 13 = 5 THEN NULL ELSE x END AS x FROM six), up1 AS (SELECT a.i AS src, b.i AS dst FROM sx a JOIN sx b ON a.i < b.i WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sx k WHERE k.i > a.i AND k.i < b.i AND (k.x IS NULL OR (k.x - a.x) * (b.i - a.i) >= (b.x - a.x) * (k.i - a.i))))"
add("visibility_missing", lambda spark, sf: V.visible(D.daily(spark, sf).select("i", F.col("i").cast("double").alias("t"), F.when(F.col("i") % 13 != 5, F.col("x")).alias("x"))), "SELECT src, dst FROM up1 UNION ALL SELECT dst, src FROM up1", GAPV)
