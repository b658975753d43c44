"""Learned operators: accuracy floors, brute-force comparison, skew."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cluster, forecast as X, forest, kernels
from pulsegrid.operators.stats import correlations

T0 = datetime(2025, 1, 6)


def labelled(spark):
    rng = np.random.default_rng(42)
    pts = np.r_[rng.normal(0, 1, (1000, 2)), rng.normal(5, 1, (50, 2))]
    return spark.createDataFrame([(i, "s", float(x), float(y), i < 1000) for i, (x, y) in enumerate(pts)],
                                 "id int, k string, x double, y double, is_normal boolean").repartition(4)


def test_forest_accuracy_and_share(spark):
    d = forest.isolation_forest(labelled(spark), ["k"], ["x", "y"], ["id"], 0.05)
    r = d.agg(F.avg((F.col("is_anomaly") != F.col("is_normal")).cast("int")).alias("acc"), F.count_if("is_anomaly").alias("n")).first()
    assert r.acc > 0.9 and 45 <= r.n <= 55


def test_forest_does_not_depend_on_layout_or_path(spark):
    d = labelled(spark)
    a = forest.isolation_forest(d, ["k"], ["x", "y"], ["id"], 0.05, trees=20)
    b = forest.isolation_forest(d.repartition(7, "x"), ["k"], ["x", "y"], ["id"], 0.05, trees=20, limit=100)
    fit = forest.fit_forest(d, ["k"], ["x", "y"], ["id"], 20)
    c = forest.score_forest(d, fit, ["k"], ["x", "y"], limit=100, broadcast_keys=0)
    got = {r.id: (round(r.score, 9), r.is_anomaly) for r in a.collect()}
    assert got == {r.id: (round(r.score, 9), r.is_anomaly) for r in b.collect()}
    assert {k: v[0] for k, v in got.items()} == {r.id: round(r.score, 9) for r in c.collect()}


def test_trees_draw_at_most_the_sample(spark):
    f = forest.fit_forest(labelled(spark), ["k"], ["x"], ["id"], 30).collect()
    assert len(f) == 30 and {r.drawn for r in f} == {kernels.SAMPLE}
    assert len({tuple(r.cut) for r in f}) == 30
    assert max(max(r.path) for r in f) < 30


def test_expected_path():
    # 2 H(n-1) - 2 (n-1)/n with the harmonic number by its logarithm
    assert kernels.expected_path([0, 1, 2])[2] == 1.0 and not kernels.expected_path([0, 1]).any()
    assert abs(kernels.expected_path([256])[0] - 10.244) < 0.01


def test_forest_copes_with_equal_values(spark):
    d = spark.createDataFrame([(i, "c", 5.0) for i in range(40)] + [(i, "few", float(i)) for i in range(5)], "id int, k string, v double")
    r = forest.isolation_forest(d, ["k"], ["v"], ["id"], trees=10)
    assert r.count() == 40 and r.where("is_anomaly").isEmpty()


def test_intervals_and_row_anomalies(spark):
    rng = np.random.default_rng(42)
    rows = [(T0 + timedelta(minutes=5 * i), float(45 + rng.normal(0, 2)) + (60 if 300 <= i < 304 else 0), float(60 + rng.normal(0, 1))) for i in range(577)]
    d = spark.createDataFrame(rows, "ts timestamp, cpu double, memory double")
    runs = forest.anomaly_intervals(d, ["cpu", "memory"], ["ts"], threshold=-0.15)
    spike = [r for r in runs.collect() if r.start <= T0 + timedelta(minutes=1500) <= r.end]
    assert len(spike) == 1 and spike[0].anomalies >= 4 and spike[0].cpu_max > 90
    holes = d.withColumn("cpu", F.when(F.minute("ts") % 10 == 0, F.col("cpu")))
    hits = forest.forest_anomalies(holes, ["cpu", "memory"], ["ts"])
    assert 40 < hits.count() < 75
    assert hits.agg(F.max("cpu")).first()[0] > 90


# --- clustering -----------------------------------------------------------

def brute_dbscan(pts, eps, k):
    n = len(pts)
    near = [[j for j in range(n) if ((pts[i] - pts[j]) ** 2).sum() <= eps * eps] for i in range(n)]
    core = [len(x) >= k for x in near]
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(n):
        if core[i]:
            for j in near[i]:
                if core[j]:
                    a, b = find(i), find(j)
                    comp[max(a, b)] = min(a, b)
    own = [frozenset([find(i)]) if core[i] else frozenset(find(j) for j in near[i] if core[j]) for i in range(n)]
    return core, own


@pytest.mark.parametrize("dims,eps,k,limit,leaf", [(1, 0.3, 4, None, 2000), (2, 0.5, 5, None, 2000), (2, 0.35, 5, 20, 3), (2, 0.5, 5, None, 1), (3, 0.9, 6, None, 2000)])
def test_dbscan_equals_brute_force(spark, dims, eps, k, limit, leaf):
    rng = np.random.default_rng(dims)
    pts = np.r_[rng.normal(0, 0.6, (120, dims)), rng.normal(4, 0.4, (60, dims)), rng.uniform(-6, 8, (40, dims)), np.full((30, dims), 2.05)]
    cols = [f"c{i}" for i in range(dims)]
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.id: (r.cluster, r.is_core) for r in cluster.dbscan(d, cols, eps, k, limit, leaf).collect()}
    core, own = brute_dbscan(pts, eps, k)
    assert len(got) == len(pts)
    names = {}
    for i in range(len(pts)):
        c, is_core = got[i]
        assert is_core == core[i]
        assert (c == -1) == (not own[i])
        if core[i]:
            names.setdefault(c, set()).add(next(iter(own[i])))
    assert all(len(v) == 1 for v in names.values()) and len(set().union(*names.values())) == len(names)
    back = {next(iter(v)): c for c, v in names.items()}
    for i in range(len(pts)):
        if own[i]:
            assert got[i][0] in {back[o] for o in own[i]}
    assert sorted(names) == list(range(len(names)))


def test_dense_cells_link_only_within_eps(spark):
    """Two dense groups whose cells touch: joined at eps, apart just beyond."""
    def run(gap):
        pts = [(i, 0.001 * (i % 8), 0.0) for i in range(8)] + [(8 + i, 0.007 + gap + 0.001 * (i % 8), 0.0) for i in range(8)]
        d = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in pts], "id int, x double, y double")
        return len({r.cluster for r in cluster.dbscan(d, ["x", "y"], 0.5, 5).collect()})
    assert run(0.499) == 1 and run(0.501) == 2


def test_close_sets():
    for seed in range(200):
        g = np.random.default_rng(seed)
        d = int(g.integers(1, 4))
        p, q = g.random((int(g.integers(1, 300)), d)), g.random((int(g.integers(1, 300)), d)) + g.random(d) * 1.2
        least = ((p[:, None] - q[None]) ** 2).sum(axis=2).min()
        assert kernels.closer_than(p, q, least) and not kernels.closer_than(p, q, np.nextafter(least, 0))


@pytest.mark.parametrize("leaf", [2000, 2])
def test_cells_far_finer_than_any_level(spark, leaf):
    """Two points of dense cells that miss eps by less than a cell quartered fifteen times is wide."""
    for gap, clusters in ((0.5, 1), (0.5 * (1 + 1e-12), 2)):
        left = [(-0.01 * k, 0.3 * (k % 2)) for k in range(6)]
        pts = left + [(gap + 0.01 * k, 0.3 * (1 - k % 2)) for k in range(6)]
        pts[0], pts[6] = (0.0, 0.0), (gap, 0.0)
        d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, x double, y double")
        d = d.where("x <= 0 and y < 0.1 or x > 0.1 and y < 0.1")
        n = len({r.cluster for r in cluster.dbscan(d, ["x", "y"], 0.5, 3, leaf=leaf).collect()})
        assert n == clusters


def test_point_sets_take_no_more_than_their_bytes():
    """Pairs of large sets come many to a batch, whose points are never objects of their own."""
    import tracemalloc
    g = np.random.default_rng(0)
    sets = [g.random((2000, 2)) + [3 * (k % 2), 0] for k in range(60)]
    flat = pa.array([x.ravel() for x in sets], pa.list_(pa.float64()))
    ids = pa.array(range(60), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, flat, flat], ["a", "b", "ax", "bx"])
    for part, want in ((batch, list(range(60))), (batch.slice(7, 5), list(range(7, 12)))):
        tracemalloc.start()
        got = [x for b in cluster._touch(0.0, 2)(iter([part])) for x in b.column("a").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == want and peak < batch.nbytes / 2
    apart = pa.RecordBatch.from_arrays([ids[:59], ids[1:], flat[:59], flat[1:]], ["a", "b", "ax", "bx"])
    assert [b.num_rows for b in cluster._touch(0.01, 2)(iter([apart]))] == [0]


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    rand = [(int(a), int(b)) for a, b in rng.integers(200, 260, (35, 2))]
    edges = chain + star + rand
    nodes = sorted(set(itertools.chain(*edges)) | {999})
    got = cluster.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    want = kernels.union_find(edges)
    assert {r.node: r.component for r in got.collect()} == {n: want.get(n, n) for n in nodes}


# --- forecasts ------------------------------------------------------------

def test_forest_regression_floor(spark):
    rng = np.random.default_rng(42)
    rows = [(T0 + timedelta(hours=i), 50 + 10 * np.sin(2 * np.pi * i / 24) + 0.01 * i + rng.normal(0, 1)) for i in range(1000)]
    d = spark.createDataFrame([(t, float(y)) for t, y in rows], "ts timestamp, y double")
    forecast, quality = X.rf_forecast(d, "y", trees=30)
    q = quality.first()
    assert 1 - q.accuracy < 0.3 and q.n > 100
    f = forecast.orderBy("step").collect()
    assert [r.step for r in f] == list(range(1, 25)) and f[0]["at"] == T0 + timedelta(hours=1000)
    assert all(30 < r.predicted < 90 for r in f)
    assert X.growth_alert(forecast).isEmpty()
    up = forecast.withColumn("predicted", F.col("current") * 1.6)
    assert X.growth_alert(up).first().severity == "warning"
    assert X.rf_forecast(d.limit(50), "y") is None


@pytest.mark.parametrize("piece", [50_000, 30])
def test_sequence_forecast_follows_a_wave(spark, piece):
    rows = [("a", i, T0 + timedelta(minutes=5 * i), float(50 + 10 * np.sin(2 * np.pi * i / 12))) for i in range(240)] + \
           [("short", i, T0, 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "metric string, pos int, ts timestamp, value double").repartition(5)
    r = X.sequence_forecast(d, ["metric"], ["ts", "pos"], lookback=24, horizon=12, piece=piece)
    got = sorted((x.step, x["at"], x.predicted, x.test_rmse) for x in r.collect())
    assert len(got) == 12 and got[0][1] == T0 + timedelta(minutes=5 * 240)
    for step, _, p, err in got:
        assert abs(p - (50 + 10 * np.sin(2 * np.pi * (239 + step) / 12))) < 0.05 and err < 1e-3


def test_correlations_cut_to_the_shorter(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 1, 80)
    b = a[:50] * 2 + rng.normal(0, 0.5, 50)
    rows = [("a", i, float(v)) for i, v in enumerate(a)] + [("b", i, float(v)) for i, v in enumerate(b)] + [("c", i, float(i)) for i in range(2)]
    r = correlations(spark.createDataFrame(rows, "metric string, pos int, value double"), order=["pos"]).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].strength) == ("a", "b", "strong")
    assert abs(r[0].correlation - np.corrcoef(a[:50], b)[0, 1]) < 1e-9
