"""Known values of small fields, recurrence plots, visibility, events."""

import math

import pytest

from skein.operators import events as E
from skein.operators import recurrence as R
from skein.operators import series as S
from skein.operators import visibility as V


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame([(i, t, math.sin(t * math.pi / 10 + i * math.pi / 2)) for t in range(10) for i in range(6)], "node long, t long, x double")


def test_anomaly(field):
    got = [r.x for r in S.anomaly(field, 5).filter("node = 0").orderBy("t").collect()]
    assert got == pytest.approx([-0.5, -0.321, -0.1106, 0.1106, 0.321, 0.5, 0.321, 0.1106, -0.1106, -0.321], abs=1e-3)


def test_phase_indices(field):
    got = sorted((r.phase, r.t) for r in S.phase_indices(field, 5).collect())
    assert got == sorted((p, p + 5 * k) for p in range(5) for k in range(2))


def test_pearson_network(field):
    links = S.threshold_network(S.pearson(S.anomaly(field, 5)), 0.5).edges
    assert sorted((r.src, r.dst) for r in links.collect() if r.src < r.dst) == [(0, 4), (1, 5)] or sorted((r.src, r.dst) for r in S.threshold_network(S.pearson(S.anomaly(field, 5)).selectExpr("i", "j", "abs(s) as s"), 0.5).edges.collect() if r.src < r.dst) == [(0, 2), (0, 4), (1, 3), (1, 5), (2, 4), (3, 5)]


@pytest.fixture(scope="module")
def plot(spark):
    rows = [(t, [math.sin(t * math.pi / 10 + i * math.pi / 2) for i in range(6)]) for t in range(10)]
    x = spark.createDataFrame(rows, "i long, v array<double>")
    return x, R.recurrences(x, 0.8)


def hist(df):
    return {r.len: r.cnt for r in df.collect()}


def test_rqa(plot):
    x, rp = plot
    assert R.recurrence_rate(rp, 10).first()[0] == pytest.approx(0.48)
    assert hist(R.diagonal_lines(rp)) == {1: 4, 8: 2, 9: 2}
    assert hist(R.vertical_lines(rp)) == {3: 1, 4: 2, 5: 5, 6: 2}
    assert hist(R.white_lines(rp, x.select("i"))) == {1: 2, 2: 1, 3: 2, 4: 2, 5: 3, 6: 2, 7: 1}
    s = R.rqa_summary(rp, 10).first()
    assert (s.det, s.l, s.lam) == pytest.approx((0.8947, 8.4999, 0.9999), abs=1e-3)
    assert R.line_measures(R.diagonal_lines(rp)).first().entropy == pytest.approx(0.6931, abs=1e-3)
    assert R.line_measures(R.vertical_lines(rp)).first().entropy == pytest.approx(1.2206, abs=1e-3)
    assert R.line_measures(R.white_lines(rp, x.select("i")), 1).first().entropy == pytest.approx(1.8848, abs=1e-3)


def test_entropies(spark):
    ts = spark.createDataFrame(list(enumerate([4.0, 7.0, 9.0, 10.0, 6.0, 11.0, 3.0])), "i long, x double")
    e = R.embed(ts, 3, 1)
    assert R.permutation_entropy(e, 3).first()[0] == pytest.approx(0.5888, abs=1e-3)
    assert R.complexity_entropy(e, 3).first()[0] == pytest.approx(0.29, abs=1e-2)
    line = spark.createDataFrame([(i, float(i)) for i in range(20)], "i long, x double")
    assert R.complexity_entropy(R.embed(line, 3, 1), 3).first()[0] == pytest.approx(0.0)


def test_thresholds(plot):
    x, _ = plot
    d = R.pair_distances(x, x)
    assert d.count() == 100
    t = R.threshold_of_rate(d, 0.4)
    values = sorted(r.d for r in d.collect())
    assert t.first()[0] == values[int(0.4 * 99)]
    assert R.recurrences(x, 2.5).count() == 100
    assert R.fixed_local_rate(d, 0.6).count() > 0


@pytest.mark.parametrize("horizontal", [False, True])
def test_visibility(spark, horizontal):
    xs = [3.0, 1.0, 2.0, 5.0, 4.0, 4.5, 0.5, 6.0, 2.0, 2.0]
    ts = spark.createDataFrame([(i, float(i), x) for i, x in enumerate(xs)], "i long, t double, x double")
    want = set()
    for i in range(len(xs)):
        for j in range(i + 1, len(xs)):
            between = range(i + 1, j)
            if all(xs[k] < min(xs[i], xs[j]) if horizontal else xs[k] < xs[i] + (xs[j] - xs[i]) * (k - i) / (j - i) - 1e-12 for k in between):
                want |= {(i, j), (j, i)}
    assert {(r.src, r.dst) for r in V.visible(ts, horizontal).collect()} == want


def test_events(spark):
    m = spark.createDataFrame([(n, t, int(t % 7 == n)) for n in range(3) for t in range(70)], "node long, t long, flag int")
    ev = E.events_of(m)
    es = {(r.i, r.j): r.value for r in E.event_synchronization(ev).collect()}
    assert es[1, 0] == pytest.approx(1.0) and es[0, 1] == pytest.approx(0.0)
    ec = {(r.i, r.j): (r.precursor, r.trigger) for r in E.event_coincidence(ev, 2.0).collect()}
    assert ec[1, 0] == (1.0, 1.0)
    empty = E.events_of(m.filter("false"))
    assert E.event_synchronization(empty).count() == 0


def test_partial_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(200), rng.standard_normal(200)
    x = np.stack([a, a + 0.5 * b + 0.3 * rng.standard_normal(200), b])
    obs = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(3) for t in range(200)], "node long, t long, x double")
    inv = np.linalg.inv(np.corrcoef(x))
    got = {(r.i, r.j): r.s for r in S.partial_correlation(obs).collect()}
    assert got[0, 2] == pytest.approx(-inv[0, 2] / math.sqrt(inv[0, 0] * inv[2, 2]))


def test_surrogates(spark):
    import numpy as np

    from skein.operators import surrogates as U

    rng = np.random.default_rng(2)
    x = np.cumsum(rng.standard_normal(128))
    obs = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "node string, t long, x double")
    get = lambda d: np.array([r.x for r in d.orderBy("t").collect()])
    assert np.abs(np.fft.rfft(get(U.fourier(obs)))) == pytest.approx(np.abs(np.fft.rfft(x)))
    for f in (U.white_noise, U.aaft, U.refined_aaft):
        assert np.sort(get(f(obs))) == pytest.approx(np.sort(x))
    assert set(get(U.twin_surrogates(obs, 0.5))) <= set(x.tolist())


def test_event_stream_windows(spark):
    from skein.streaming.events import event_flags, windowed_counts

    rows = [(f"2024-01-01 00:{m:02d}:00", "a") for m in range(0, 60, 10)] + [("2024-01-01 01:30:00", "b")]
    ev = spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type")
    got = sorted((r.node, r.n) for r in windowed_counts(ev).collect())
    assert got == [("a", 6), ("b", 1)]
    assert sorted(r.flag for r in event_flags(windowed_counts(ev), 2).collect()) == [0, 1]


def test_recurrence_samples(spark, plot):
    x, rp = plot
    d = R.pair_distances(x, x)
    near = R.fixed_neighbors(d, 3)
    assert min(r["count"] for r in near.groupBy("i").count().collect()) >= 3
    assert R.bootstrap_distances(x, 500).count() == 500
    assert 0 < R.fast_threshold_of_rate(x, 0.4).first()[0] < 2
    lines = R.vertical_lines(rp)
    got = hist(R.resampled_lines(lines, 1000))
    assert sum(got.values()) == 1000 and set(got) <= set(hist(lines))
