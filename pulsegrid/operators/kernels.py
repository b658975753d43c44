"""Numeric kernels that run inside Python tasks; kept apart so that workers load only numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SAMPLE = 256


def expected_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


LEAF_PATH = expected_path(np.arange(SAMPLE + 1)).tolist()


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """One isolation tree over the rows of ``x`` as parallel node arrays."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, split, low, high, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        at, depth, parent, is_high = todo.pop()
        node = len(feature)
        if parent >= 0:
            (high if is_high else low)[parent] = node
        f, c = -1, 0.0
        if depth < limit and len(at) > 1:
            here = x[at]
            lo, hi = here.min(axis=0), here.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable):
                f = int(usable[rng.integers(len(usable))])
                c = lo[f] + (hi[f] - lo[f]) * rng.random()
                c = float(c if c < hi[f] else lo[f])  # close bounds can round up
        leaf = f < 0
        feature.append(f)
        split.append(c)
        low.append(-1)
        high.append(-1)
        path.append(depth + LEAF_PATH[len(at)] if leaf else 0.0)
        if not leaf:
            below = here[:, f] <= c
            todo += [(at[~below], depth + 1, node, True), (at[below], depth + 1, node, False)]
    return feature, split, low, high, path


def mean_path(x: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """Mean leaf path of every row over the trees."""
    total = np.zeros(len(x))
    for feature, split, low, high, path in trees:
        feature, split, low, high, path = map(np.asarray, (feature, split, low, high, path))
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[node]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                break
            n = node[live]
            goes_low = x[live, f[live]] <= split[n]
            node[live] = np.where(goes_low, low[n], high[n])
        total += path[node]
    return total / len(trees)


def as_trees(rows) -> tuple[list, float]:
    """(trees, norm) of one forest from its rows in tree order."""
    trees = [tuple(np.asarray(getattr(r, c)) for c in ("feature", "cut", "low", "high", "path")) for r in rows]
    return trees, float(expected_path([max(max(int(r.drawn) for r in rows), 2)])[0])


def score(x: np.ndarray, model: tuple[list, float]) -> np.ndarray:
    """Minus the anomaly measure of every row."""
    trees, norm = model
    return -np.exp2(-mean_path(x, trees) / norm)


def normal_sums(windows, targets) -> tuple[np.ndarray, np.ndarray]:
    """Normal-equation sums of windows with a constant term."""
    w = np.c_[np.asarray(windows, dtype=float), np.ones(len(windows))]
    return w.T @ w, w.T @ np.asarray(targets, dtype=float)


def solve_normal(a, b, ridge: float) -> list[float]:
    n = len(b)
    return np.linalg.solve(np.asarray(a, dtype=float).reshape(n, n) + ridge * np.eye(n), np.asarray(b, dtype=float)).tolist()


def rmse(a, b, yy: float, n: float, w) -> float | None:
    """Root mean squared error of weights ``w`` from the sums of the rows they are judged on."""
    if not n:
        return None
    w, b = np.asarray(w), np.asarray(b, dtype=float)
    a = np.asarray(a, dtype=float).reshape(len(b), len(b))
    return float(np.sqrt(max(0.0, (yy - 2 * w @ b + w @ a @ w) / n)))


def union_find(pairs) -> dict:
    """Smallest member of each node's component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def kd_leaves(x: np.ndarray, size: int = 48) -> list[np.ndarray]:
    """Rows of ``x`` in groups of at most ``size``, halved at the median of the widest axis."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(x[rows], axis=0)))
        rows = rows[np.argsort(x[rows, axis], kind="stable")]
        todo += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    return out


def closer_than(p: np.ndarray, q: np.ndarray, eps2: float) -> bool:
    """Do a point of ``p`` and one of ``q`` have a squared distance of at most ``eps2``?  Leaves are
    compared in order of their boxes' distance."""
    a, b = kd_leaves(p), kd_leaves(q)
    box = lambda x, rows: (np.array([x[r].min(axis=0) for r in rows]), np.array([x[r].max(axis=0) for r in rows]))
    (alo, ahi), (blo, bhi) = box(p, a), box(q, b)
    gap = np.maximum(0, np.maximum(blo[None] - ahi[:, None], alo[:, None] - bhi[None]))
    gap = (gap * gap).sum(axis=2)
    i, j = np.nonzero(gap <= eps2)
    for k in np.argsort(gap[i, j], kind="stable").tolist():
        apart = p[a[i[k]]][:, None] - q[b[j[k]]][None]
        if ((apart * apart).sum(axis=2) <= eps2).any():
            return True
    return False
