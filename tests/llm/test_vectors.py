"""Hard negatives and near copies of vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import descent, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, weight string, anchor string, r string, group string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, l, "u", "w", "a", "r", None) for i, v, l in rows], schema)


def clusters(seed=3, dim=16):
    """Lone vectors, pairs, a tight group, exact copies, and a group around the threshold."""
    g = np.random.default_rng(seed)
    lone = g.standard_normal((150, dim))
    pairs = np.repeat(g.standard_normal((30, dim)), 2, axis=0) + 0.08 * g.standard_normal((60, dim))
    tight = g.standard_normal(dim) + 0.03 * g.standard_normal((120, dim))
    same = np.repeat(g.standard_normal((1, dim)), 60, axis=0)
    loose = g.standard_normal(dim) + 0.33 * g.standard_normal((150, dim))
    x = np.concatenate([lone, pairs, tight, same, 3 * same[:20], loose]).astype(np.float32)
    order = g.permutation(len(x))
    return [(int(i), [float(v) for v in x[k]], int(k) % 4) for i, k in enumerate(order)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [1.0, None] + [0.0] * 14, 1), (9005, [math.nan] * 16, 1),
       (9006, [math.inf] + [0.0] * 15, 2), (9007, [1.0, 2.0], 2), (9008, [0.5, 1.0, 0.0], 3), (None, [1.0] * 16, 1), (9009, [1.0] * 16, None),
       (9007, [1.0, 2.0], 2), (9010, [1e30] * 16, 1)]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def links(rows, least):
    """n_links and component_id of each vec_id."""
    first = {}
    for i, v, _ in rows:
        if i is not None and (i not in first or (not whole(first[i]), first[i] or []) > (not whole(v), v or [])):
            first[i] = v
    ids = sorted(i for i in first if whole(first[i]) and any(first[i]))
    dim = max((len(first[i]) for i in ids), default=1)
    x = np.array([list(first[i]) + [0.0] * (dim - len(first[i])) for i in ids]).reshape(len(ids), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while len(ids):
        new = np.minimum(label, np.where(near, label, 1 << 62).min(axis=1))
        if (new == label).all():
            break
        label = new
    found = {i: (0, i) for i in first} | {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
    return sorted((i, n, c, i == c) for i, (n, c) in found.items())


@pytest.mark.parametrize("sizes", [{}, dict(most=4, chunk=16), dict(most=6, orders=1, block=8, chunk=32)])
def test_near_copies(spark, sizes):
    rows = clusters() + ODD[:-1]
    got = [tuple(r) for r in descent.near(frame(spark, rows), **sizes).collect()]
    assert sorted(r for r in got if r[0] is not None) == links(rows, 0.9)
    assert [r[1:] for r in got if r[0] is None] == [(0, None, False)]


def test_near_copies_of_long_vectors(spark):
    rows = [(i, [x * 1e30 for x in v], l) for i, v, l in clusters(5)[:80]]
    assert sorted(map(tuple, descent.near(frame(spark, rows)).collect())) == links(rows, 0.9)


def test_near_copies_of_none(spark):
    assert descent.near(frame(spark, [])).collect() == []
    rows = ODD[:6]
    assert sorted(map(tuple, descent.near(frame(spark, rows)).collect())) == [(i, 0, i, True) for i, *_ in rows]


def test_recall_without_structure(spark):
    """Vectors of one wide cloud, where lists are all that holds the graph together."""
    g = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(g.standard_normal((600, 4)).astype(np.float32))]
    want = links(rows, 0.9)
    got = sorted(map(tuple, descent.near(frame(spark, rows), most=8, orders=2, block=64).collect()))
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_transfer_of_members(spark):
    """Balls that meet give way to one, whose members all lie within its radius."""
    g = np.random.default_rng(1)
    x = g.standard_normal(8) + 0.02 * g.standard_normal((300, 8))
    x = np.concatenate([x, g.standard_normal((100, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, unit binary")
    half = math.acos(0.9) / 2
    got = descent.cover(points, 8, 400, half, block=32).collect()
    assert len(got) == 400
    assert all(abs(r.cos - float(x[r.id] @ x[r.centre])) < 1e-12 and r.cos >= math.cos(half) for r in got if r.centre != r.id)
    assert len({r.centre for r in got if r.id < 300}) < 12


def mined(rows, every, positives=5, negatives_=10):
    first = {}
    for i, v, l in rows:
        if i is not None and l is not None and whole(v):
            first[i] = min(first.get(i, (l, v)), (l, v))
    dim = max((len(v) for _, v in first.values()), default=1)
    ints = {i: [math.floor(256 * x) for x in v] + [0] * (dim - len(v)) for i, (_, v) in first.items()}
    out = []
    for a in sorted(i for i in first if i % every == 0):
        scores = sorted((-sum(x * y for x, y in zip(ints[a], ints[b])), b) for b in first if b != a)
        for s, p in [x for x in scores if first[x[1]][0] == first[a][0]][:positives]:
            fit = [(t, b) for t, b in scores if first[b][0] != first[a][0] and 30 * -s <= 100 * -t <= 90 * -s][:negatives_]
            out += [(a, p, k, b, -s, -t) for k, (t, b) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, dict(UNIT=32, GROUP=2, ANCHORS=8)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(negatives, k, v)
    rows = clusters(4) + ODD[:-1]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 7 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 7)


def test_hard_negatives_of_ties(spark):
    """Equal vectors of several labels: smaller ids come first."""
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(40)] + [(100 + i, [0.5, 0.5, 0.0], i % 3) for i in range(40)]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()))
    assert got == mined(rows, 5) and got


def test_hard_negatives_of_none(spark):
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 7 == 0).collect() == []
    assert negatives.mine(frame(spark, ODD[:6]), F.col("vec_id") % 7 == 0).collect() == []


def test_large_integers(spark):
    """Products beyond what doubles hold exactly."""
    g = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(g.integers(1, 1 << 22, (40, 5)) / 2)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 4 == 0)
    assert sorted(map(tuple, got.collect())) == mined([(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows], 4)


def test_intervals_hold():
    g = np.random.default_rng(6)
    ints, queries = g.integers(-300, 300, (200, 24)), g.integers(-300, 300, (20, 24))
    ints[0] = 0
    mean = ints.mean(axis=0)
    codes = negatives.Codes.of(np.arange(200), np.zeros(200, np.int64), ints, mean)
    middle, least, greatest = negatives.Codes.load(codes.save()).bounds(queries, mean)
    score = queries @ ints.T
    assert (least <= score).all() and (score <= greatest).all()
    assert np.corrcoef(middle.ravel(), score.ravel())[0, 1] > 0.7
