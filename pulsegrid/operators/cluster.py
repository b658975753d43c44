"""Density clustering by grid cells.

Cells have side eps/sqrt(d), so all points of one cell are within eps of each other: a
cell with ``min_samples`` points is all core and is handled as one node, however many
points it holds.  Only the points of thin cells are compared with their surroundings.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators import kernels
from pulsegrid.scale import GROUP_LIMIT, positions
from pulsegrid.session import cut

#: Points of a box that is decided by its points.
LEAF = 2000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components as (node, component): the smallest node of each.

    Each task first joins what a batch of its edges connects, which leaves an edge a node; then large-star
    and small-star steps alternate, which need a number of rounds logarithmic in the graph's size."""
    def local(batches):
        for pdf in batches:
            found = kernels.union_find(zip(pdf["u"].tolist(), pdf["v"].tolist()))
            yield pd.DataFrame([x for x in found.items() if x[0] != x[1]], columns=["u", "v"]).astype("int64")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = cut(e.mapInPandas(local, "u long, v long").distinct())

    def mark(d):
        return tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["node"] == root["u"], "left") \
        .select("node", F.coalesce("component", "node").alias("component"))


def _dist2(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _box_gap2(lo_a, hi_a, lo_b, hi_b, d: int) -> Column:
    """Squared least distance of two boxes."""
    parts = [F.greatest(F.lit(0.0), F.get(lo_b, F.lit(i)) - F.get(hi_a, F.lit(i)), F.get(lo_a, F.lit(i)) - F.get(hi_b, F.lit(i)))
             for i in range(d)]
    return sum((p * p for p in parts), F.lit(0.0))


def _box_reach2(lo_a, hi_a, lo_b, hi_b, d: int) -> Column:
    """Squared largest distance of two boxes."""
    parts = [F.greatest(F.abs(F.get(hi_a, F.lit(i)) - F.get(lo_b, F.lit(i))), F.abs(F.get(hi_b, F.lit(i)) - F.get(lo_a, F.lit(i))))
             for i in range(d)]
    return sum((p * p for p in parts), F.lit(0.0))


def _box(d: int) -> list[Column]:
    at = [F.get("x", F.lit(i)) for i in range(d)]
    return [F.array(*[F.min(a) for a in at]).alias("lo"), F.array(*[F.max(a) for a in at]).alias("hi")]


def _offsets(d: int) -> list[tuple]:
    r = math.ceil(math.sqrt(d))
    # a neighbour cell can hold points within eps only if its nearest corner is that close
    return [o for o in itertools.product(range(-r, r + 1), repeat=d)
            if sum(max(0, abs(i) - 1) ** 2 for i in o) <= d]


def _shift(cell, offsets) -> Column:
    return F.array(*[F.array(*[F.get(cell, F.lit(i)) + F.lit(v) for i, v in enumerate(o)]) for o in offsets])


def _touch(eps2: float, d: int):
    """Of pairs of point sets (a, b, ax, bx) those with two points within eps, each set sorted into a
    kd-tree of small leaves whose boxes rule most of the other set out.

    A set is one list of all its numbers, which are read where they lie: a batch takes no more than its bytes."""
    def sets(column):
        bounds, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return (flat[i:j].reshape(-1, d) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()))

    def run(batches):
        for batch in batches:
            hit = [kernels.closer_than(p, q, eps2) for p, q in zip(sets(batch.column("ax")), sets(batch.column("bx")))]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
    return run


def _linked_cells(dense: DataFrame, points: DataFrame, side: float, eps2: float, d: int, leaf: int = LEAF) -> DataFrame:
    """Pairs (a, b) of neighbouring dense cells that have two points within eps.

    Boxes around the points decide most pairs.  Of the others those with at most ``leaf`` points in
    either box are decided by their points; larger ones are quartered, and only box pairs that are
    still open go on, until all are that small."""
    half = [o for o in _offsets(d) if o > tuple([0] * d)]
    size = F.col("members").alias("n")
    left = dense.select(F.col("node").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), size.alias("an"),
                        F.explode(_shift("cell", half)).alias("cell"))
    none = F.lit(None).cast("array<bigint>")
    pairs = left.join(dense.select("cell", F.col("node").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), size.alias("bn")), "cell") \
        .select("a", "b", "alo", "ahi", "blo", "bhi", "an", "bn", none.alias("asub"), none.alias("bsub"))
    boxes = (F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi"), d)
    found, level, subs = None, 0, points.select("node", none.alias("sub"), "x")
    while True:
        judged = cut(pairs.withColumns({"gap": _box_gap2(*boxes), "reach": _box_reach2(*boxes)}).where(F.col("gap") <= eps2))
        hit = judged.where(F.col("reach") <= eps2).select("a", "b").distinct()
        open_ = judged.where(F.col("reach") > eps2).join(hit, ["a", "b"], "left_anti")
        few = (F.col("an") <= leaf) & (F.col("bn") <= leaf)
        near = open_.where(few)
        used = near.select(F.col("a").alias("node"), F.col("asub").alias("sub")).union(near.select("b", "bsub")).distinct()
        same = F.col("l.node").eqNullSafe(F.col("r.node")) & F.col("l.sub").eqNullSafe(F.col("r.sub"))
        sets = subs.alias("l").join(used.alias("r"), same, "left_semi").groupBy("node", "sub").agg(F.flatten(F.collect_list("x")).alias("x"))
        of = lambda p: sets.select(F.col("node").alias(f"{p}node"), F.col("sub").alias(f"{p}key"), F.col("x").alias(f"{p}x"))
        on = lambda p: (F.col(p) == F.col(f"{p}node")) & F.col(f"{p}sub").eqNullSafe(F.col(f"{p}key"))
        met = near.join(of("a"), on("a")).join(of("b"), on("b")).select("a", "b", "ax", "bx").mapInArrow(_touch(eps2, d), "a long, b long")
        hit = cut(hit.unionByName(met).distinct())
        found = hit if found is None else found.unionByName(hit)
        open_ = cut(open_.where(~few).join(hit, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            return found.distinct()
        level += 1
        cells = open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct()
        sub = F.transform("x", lambda v: F.floor(v / (side / 4 ** level)))
        subs = cut(points.join(cells, "node", "left_semi").select("node", sub.alias("sub"), "x"))
        grid = subs.groupBy("node", "sub").agg(*_box(d), F.count(F.lit(1)).alias("n")) \
            .withColumn("up", F.transform("sub", lambda v: F.shiftright(v, 2)))

        def side_of(p):
            return grid.select(F.col("node").alias(p), F.col("up").alias(f"{p}sub"), F.col("sub").alias(f"{p}new"),
                               F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi"), F.col("n").alias(f"{p}n"))

        narrow = open_.select("a", "b", "asub", "bsub")
        if level == 1:
            grown = narrow.select("a", "b").join(side_of("a").drop("asub"), "a").join(side_of("b").drop("bsub"), "b")
        else:
            grown = narrow.join(side_of("a"), ["a", "asub"]).join(side_of("b"), ["b", "bsub"])
        pairs = grown.select("a", "b", "alo", "ahi", "blo", "bhi", "an", "bn", F.col("anew").alias("asub"), F.col("bnew").alias("bsub"))


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5, limit: int | None = None,
           leaf: int = LEAF) -> DataFrame:
    """Adds ``cluster`` (−1 for noise) and ``is_core`` to the rows of ``df``.

    A border point that several clusters reach goes to the one with the smallest number.
    """
    cols, d = list(cols), len(cols)
    if d > 4:
        raise ValueError("reduce to at most four columns first: neighbour cells grow exponentially")
    limit = GROUP_LIMIT if limit is None else limit
    side, eps2 = eps / math.sqrt(d), eps * eps
    inner_cols = [f"__d{i}" for i in range(d)]
    x = F.array(*[F.col(c).cast("double") for c in inner_cols])
    # equal points count together
    pts = df.dropna(subset=cols).groupBy(*[F.col(c).alias(i) for c, i in zip(cols, inner_cols)]) \
        .agg(F.count(F.lit(1)).alias("w")).withColumn("x", x) \
        .withColumn("cell", F.transform("x", lambda v: F.floor(v / side)))
    pts = cut(pts.withColumn("pid", F.monotonically_increasing_id()))
    cells = cut(pts.groupBy("cell").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("members"),
                                        F.min("pid").alias("node"), *_box(d)))
    dense = cells.where(F.col("cw") >= min_samples)
    full = pts.join(dense.select("cell", "node"), "cell", "left")
    full = cut(full.withColumn("dense", F.col("node").isNotNull()).withColumn("node", F.coalesce("node", "pid")))

    # points of thin cells against the cells around them
    members = cells.agg(F.max("members")).first()[0] or 1
    salts = -(-members // limit)
    thin = full.where(~F.col("dense")).select("pid", F.col("x").alias("px"), F.explode(_shift("cell", _offsets(d))).alias("cell")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    other = full.select("cell", "x", "w", "dense", F.col("node").alias("to"), F.pmod("pid", F.lit(salts)).alias("salt"))
    near = cut(thin.join(other, ["cell", "salt"]).where(_dist2(F.col("px"), F.col("x")) <= eps2)
               .groupBy("pid", "to", "dense").agg(F.sum("w").alias("w")))
    core = cut(near.groupBy("pid").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples).select("pid"))

    nodes = dense.select("node").unionByName(core.select(F.col("pid").alias("node")))
    core_to = core.select(F.col("pid").alias("to"))
    to_core = near.where("dense").select("pid", "to").unionByName(
        near.where(~F.col("dense")).join(core_to, "to", "left_semi").select("pid", "to"))
    to_core = cut(to_core)
    edges = _linked_cells(dense, full.where("dense").select("node", "x"), side, eps2, d, leaf).unionByName(
        to_core.join(core, "pid", "left_semi").select(F.col("pid").alias("a"), F.col("to").alias("b")))
    comp = cut(components(nodes, edges))
    number = positions(comp.select("component").distinct().withColumn("__all", F.lit(0)), ["__all"], [F.col("component")], "cluster", limit) \
        .select("component", "cluster")
    comp = cut(comp.join(number, "component").select("node", "cluster"))

    inner = full.join(comp, "node").select("pid", "cluster", F.lit(True).alias("is_core"))
    border = to_core.join(core, "pid", "left_anti").join(comp, F.col("to") == F.col("node")) \
        .groupBy("pid").agg(F.min("cluster").alias("cluster")).withColumn("is_core", F.lit(False))
    labels = full.select("pid", *inner_cols).join(inner.unionByName(border), "pid", "left").select(
        *[F.col(i).alias(c) for c, i in zip(cols, inner_cols)], F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return df.join(labels, cols)


def cluster_stats(labelled: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Size, mean and sample deviation per cluster; noise has its own row, with its size only."""
    noise = F.col("cluster") == -1
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[
        x for c in cols for x in (F.avg(F.when(~noise, F.col(c))).alias(f"{c}_mean"),
                                  F.stddev_samp(F.when(~noise, F.col(c))).alias(f"{c}_std"))])
