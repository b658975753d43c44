"""Near copies among vectors by NN-descent on a graph of neighbour lists.

Vectors crowded within half the threshold's angle of a centre form a ball: all of them are linked, so
that a group of copies, however large, is one node; any other vector is a node by itself.  Nodes are
put in several random orders (signs of random projections) and compared within blocks of each order,
which gives first neighbour lists.  Lists are then refined through neighbours of neighbours until
that adds hardly any.  A bounded sample of nodes is compared with all nodes; while the lists lack too
much of what the sample shows, there are more orders, of larger blocks, and more refinement.

A list is saturated when its last entry may still hold a link.  Saturated nodes of one component
are compared in blocks, those that the triangle inequality with a pivot keeps apart excepted; only
counts and a spanning forest of links leave a block.  Pairs of nodes that are linked in part are
decided by their vectors, a bounded chunk of either ball at a time.

So n_links is exact for the pairs that the graph has found; what it has not found is what the audit
measures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm import vectors
from pulsegrid.llm.graph import components
from pulsegrid.llm.scoring import dump, undump
from pulsegrid.scale import positions
from pulsegrid.session import cut

#: Least vectors of a ball, vectors of a chunk or block of comparisons, nodes of an audit, and the share of pairs it asks for.
CROWD, CHUNK, AUDIT, TARGET = 8, 512, 1024, 0.98
SLACK = 1e-9
NODE = "id long, weight long, radius double, unit binary"
EDGE = "u long, v long, cos double, gap double"


def units(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), "<f8") for x in batch.column("unit")])


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _unit(dim: int):
    """id and the vector over its length, of vectors that have one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, _ = vectors.dense(batch.column("embedding"), dim)
            top = np.abs(v).max(axis=1, initial=0)
            on = np.flatnonzero(top > 0)
            v = v[on] / top[on, None]
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_pydict({"id": batch.column("vec_id").take(pa.array(on)),
                                              "unit": pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary())})
    return run


def sweep(nodes: DataFrame, dim: int, n: int, orders: range, block: int, overlap: bool,
          work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Runs ``work(ids, weights, radii, units)`` on blocks of neighbours in each of the random orders; with
    ``overlap`` each block begins with the second half of the one before."""
    spark = nodes.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng([13, t]).standard_normal((dim, 62)) for t in orders]
        for batch in batches:
            x = units(batch)
            for t, plane in zip(orders, planes):
                code = (x @ plane >= 0) @ (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), *batch.columns],
                                                 ["t", "code", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, fresh = None, 0

        def done(last: bool):
            nonlocal held, fresh
            some = [np.concatenate(x) for x in zip(*held)]
            while some and (len(some[0]) >= block or last and fresh):
                here = [x[:block] for x in some]
                found = work(*here)
                if len(next(iter(found.values()))):
                    yield pa.RecordBatch.from_pydict(found)
                step = block // 2 if overlap and len(some[0]) >= block else len(here[0])
                some = [x[step:] for x in some]
                fresh = max(0, len(some[0]) - (block - step if overlap else 0))
            held = [] if last else [tuple(some)] if some else []

        for batch in batches:
            order = batch.column("t").to_numpy()
            edges = np.flatnonzero(np.diff(order)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
                if a == b:
                    continue
                if order[a] != now:
                    yield from done(True)
                    now = order[a]
                part = batch.slice(a, b - a)
                held.append((part.column("id").to_numpy(), part.column("weight").to_numpy(), part.column("radius").to_numpy(), units(part)))
                fresh += b - a
                yield from done(False)
        yield from done(True)

    # partitions of many blocks, since a block ends with its partition
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = n * len(orders)
    parts = max(1, min(rows // (8 * block), max(shuffles * len(orders), rows // 1_000_000)))
    key = ["t", "code", F.xxhash64("id")]
    coded = nodes.mapInArrow(place, "t int, code long, " + NODE)
    return coded.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _crowds(half: float):
    """Which nodes of a block move to which centre."""
    def work(ids, weights, radii, x):
        cos = x @ x.T
        near = cos >= np.cos(half)
        crowd = near.astype(float) @ weights
        free, target, best = np.ones(len(ids), bool), np.full(len(ids), -1), np.zeros(len(ids))
        for i in np.lexsort((ids, -weights, -crowd)).tolist():
            if crowd[i] < CROWD:
                break
            mine = near[i] & free
            if free[i] and weights[mine].sum() >= CROWD:
                free[mine] = False
                mine[i] = False
                target[mine], best[mine] = i, cos[i][mine]
        on = np.flatnonzero(target >= 0)
        return {"id": pa.array(ids[on], pa.int64()), "centre": pa.array(ids[target[on]], pa.int64()), "cos": pa.array(best[on])}
    return work


def cover(points: DataFrame, dim: int, n: int, half: float, block: int = CHUNK) -> DataFrame:
    """id, centre and cos for every point: the centre of its ball, which is itself outside of balls.

    Centres near each other give way to one of them; the members of the others move where they fit."""
    member = points.select("id", F.col("id").alias("centre"), F.lit(1.0).alias("cos"))
    seed, count, first = 1000, n, True
    while True:
        ball = member.groupBy("centre").agg(F.count(F.lit(1)).alias("weight"))
        nodes = points.join(ball, F.col("id") == F.col("centre")).select("id", "weight", F.lit(0.0).alias("radius"), "unit")
        moves = cut(sweep(nodes, dim, count, range(seed, seed + 1), block, False, _crowds(half), "id long, centre long, cos double"))
        moved = moves.count()
        if not moved:
            return member
        if first:  # every point is its own centre: those that move are near their target
            member = cut(points.select("id").join(moves, "id", "left").select(
                "id", F.coalesce("centre", "id").alias("centre"), F.coalesce("cos", F.lit(1.0)).alias("cos")))
        else:
            salt = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")
            to = moves.select(F.col("id").alias("centre"), F.col("centre").alias("target"))
            going = member.join(to, "centre").join(points, "id").withColumn("salt", salt)
            aims = (to.select("target").distinct().join(points.withColumnRenamed("id", "target"), "target")
                    .withColumnRenamed("unit", "aim").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))))

            def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    aim = np.stack([np.frombuffer(x.as_py(), "<f8") for x in batch.column("aim")]) if batch.num_rows else np.zeros((0, dim))
                    cos = (units(batch) * aim).sum(axis=1) if batch.num_rows else np.zeros(0)
                    fits = cos >= np.cos(half)
                    centre, target = batch.column("centre").to_numpy(), batch.column("target").to_numpy()
                    yield pa.RecordBatch.from_pydict({
                        "id": batch.column("id"), "centre": pa.array(np.where(fits, target, centre), pa.int64()),
                        "cos": pa.array(np.where(fits, cos, batch.column("cos").to_numpy()))})

            gone = (going.join(aims, ["target", "salt"]).select("id", "centre", "target", "cos", "unit", "aim")
                    .mapInArrow(test, "id long, centre long, cos double"))
            member = cut(member.join(to, "centre", "left_anti").select("id", "centre", "cos").union(gone))
        before, count, seed, first = count, member.select("centre").distinct().count(), seed + 1, False
        if count > 0.9 * before:
            return member


def _near(reach: float, most: int):
    """Each node's entries in a block: the ``most`` least gaps, of angles up to ``reach``.  The gap of two
    nodes is their angle less both radii, the least angle that vectors of theirs can have."""
    def work(ids, weights, radii, x):
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        gap = np.where(cos >= np.cos(reach), angle(cos) - radii[:, None] - radii, np.inf)
        keep = min(most, len(ids))
        place = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
        row = np.repeat(np.arange(len(ids)), keep)
        col = place.reshape(-1)
        on = np.isfinite(gap[row, col]) & (ids[row] != ids[col])
        row, col = row[on], col[on]
        return {"u": pa.array(ids[row], pa.int64()), "v": pa.array(ids[col], pa.int64()), "cos": pa.array(cos[row, col]),
                "gap": pa.array(gap[row, col])}
    return work


def _lists(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries of least gap of every node, once each."""
    order = Window.partitionBy("u").orderBy("gap", "v")
    return (edges.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.min("gap").alias("gap"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place"))


def refine(lists: DataFrame, nodes: DataFrame, reach: float, most: int, number: int) -> DataFrame:
    """Lists with what neighbours of neighbours add: the neighbours of a node, in either direction, are
    compared with each other, of more than twice a list's length a part that changes with ``number``."""
    both = lists.select(F.col("u").alias("c"), F.col("v").alias("id")).union(lists.select("v", "u")).distinct()
    some = Window.partitionBy("c").orderBy(F.xxhash64("id", F.lit(number)))
    both = both.withColumn("place", F.row_number().over(some)).where(F.col("place") <= 2 * most).drop("place")
    work = _near(reach, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last node may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            c = held.column("c").to_numpy()
            last = int(np.searchsorted(c, c[-1]))
            yield from compare(held.slice(0, last))
            held = held.slice(last)
        if held is not None:
            yield from compare(held)

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        c, ids, w, r, x = (*(batch.column(k).to_numpy() for k in ("c", "id", "weight", "radius")), units(batch))
        edges = np.flatnonzero(np.diff(c)) + 1
        found = [work(ids[a:b], w[a:b], r[a:b], x[a:b]) for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(c)]) if b - a > 1]
        if found:
            yield pa.RecordBatch.from_pydict({k: pa.concat_arrays([f[k] for f in found]) for k in found[0]})

    found = both.join(nodes, "id").select("c", "id", "weight", "radius", "unit")
    key = F.col("c")
    shuffles = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = found.repartition(shuffles, key).sortWithinPartitions("c").mapInArrow(run, EDGE)
    return cut(_lists(lists.union(new), most))


def audit(nodes: DataFrame, lists: DataFrame, full: DataFrame, theta: float, size: int) -> float:
    """The share of the pairs that a sample of nodes has within the threshold which the lists have, or
    which are between saturated nodes."""
    some = nodes.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(size).toPandas()  # bounded by ``size``
    x = np.stack([np.frombuffer(u, "<f8") for u in some["unit"]])
    ids, radii = some["id"].to_numpy(), some["radius"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = part.column("id").to_numpy()
                gap = angle(units(part) @ x.T) - part.column("radius").to_numpy()[:, None] - radii
                i, j = np.nonzero((gap <= theta) & (own[:, None] != ids))
                yield pa.RecordBatch.from_pydict({"v": pa.array(own[i], pa.int64()), "u": pa.array(ids[j], pa.int64())})

    there = nodes.mapInArrow(run, "v long, u long")
    known = lists.select("u", "v").union(lists.select("v", "u")).distinct().withColumn("known", F.lit(1))
    mark = lambda name: full.select(F.col("u").alias(name), F.lit(1).alias("full_" + name))
    n, got = (there.join(known, ["u", "v"], "left").join(mark("u"), "u", "left").join(mark("v"), "v", "left")
              .agg(F.count(F.lit(1)), F.sum(F.when(F.col("known").isNotNull() | (F.col("full_u").isNotNull() & F.col("full_v").isNotNull()), 1)))
              .first())
    return (got or 0) / n if n else 1.0


def graph(nodes: DataFrame, dim: int, n: int, theta: float, most: int, orders: int, block: int, target: float,
          sample: int) -> tuple[DataFrame, DataFrame, bool]:
    """Neighbour lists (u, v, cos, gap), saturated nodes (u), and whether these are all nodes, because no
    number of orders short of comparing all would reach the target."""
    reach, first, lists = min(2 * theta, np.pi), 0, None
    while True:
        found = sweep(nodes, dim, n, range(first, first + orders), block, True, _near(reach, most), EDGE)
        lists = cut(_lists(found if lists is None else lists.union(found), most))
        state, number = lists.agg(F.count(F.lit(1)), F.sum("gap")).first(), 0
        while state[0]:
            lists = refine(lists, nodes, reach, most, first + number)
            before, state, number = state, lists.agg(F.count(F.lit(1)), F.sum("gap")).first(), number + 1
            if state[0] <= 1.001 * before[0] and abs(state[1] - before[1]) <= 0.001 * abs(before[1]):
                break
        full = cut(lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("last"))
                   .where((F.col("n") >= most) & (F.col("last") <= theta + SLACK)).select("u"))
        if audit(nodes, lists, full, theta, sample) >= target:
            return lists, full, False
        first, orders, block = first + orders, 2 * orders, min(2 * block, 2048)
        if orders * block >= n:  # as much work as to compare all nodes, so all count as saturated
            return lists, nodes.select(F.col("id").alias("u")), True


def _chunk(table: pa.Table) -> pa.Table:
    """The rows of a chunk as one row."""
    ids, weights, radii = (table.column(k).to_numpy() for k in ("id", "weight", "radius"))
    x = np.stack([np.frombuffer(v.as_py(), "<f8") for v in table.column("unit")])
    payload = dump([ids.astype("<i8"), weights.astype("<i8"), radii.astype("<f8"), x.reshape(-1)])
    out = {"node": table.column("node")[:1], "chunk": table.column("chunk")[:1], "payload": pa.array([payload], pa.binary())}
    for k in ("low", "high"):
        side = table.column("turn").to_numpy()
        out[k] = pa.array([side.min() if k == "low" else side.max()])
    return pa.table(out | {"wide": pa.array([float(radii.max())])})


CHUNKS = "node long, chunk long, payload binary, low double, high double, wide double"


def opened(payload) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, weights, radii, x = undump(payload.as_py())
    return ids, weights, radii, x.reshape(len(ids), -1)


def forest(linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what a block has linked: each row to the least id that it reaches by links."""
    a, b = one.copy(), two.copy()
    top = np.iinfo(np.int64).max
    while True:
        x = np.minimum(a, np.where(linked, b, top).min(axis=1, initial=top))
        y = np.minimum(b, np.where(linked, x[:, None], top).min(axis=0, initial=top))
        if (x == a).all() and (y == b).all():
            break
        a, b = x, y
    u, v = np.concatenate([one, two]), np.concatenate([a, b])
    return u[u != v], v[u != v]


def crowded(full: DataFrame, lists: DataFrame, nodes: DataFrame, theta: float, least: float, everything: bool,
            chunk: int) -> DataFrame:
    """Among the saturated nodes of a component: rows (u, null, weight) with the weight of a node's whole
    links, (u, v, 0) of links that span them, (u, v, null) of pairs linked in part."""
    sat = full.join(nodes, F.col("u") == F.col("id")).drop("u")
    if everything:
        sat = sat.withColumn("node", F.lit(0).cast("long"))
    else:
        part = components(lists.where(F.col("gap") <= theta + SLACK).select(F.col("u").alias("a"), F.col("v").alias("b")))
        sat = sat.join(part.select(F.col("node").alias("id"), F.col("label").alias("node")), "id")
    sat = cut(sat)
    pivot = sat.groupBy("node").agg(F.min("id").alias("id")).join(sat.select("id", F.col("unit").alias("pivot")), "id").drop("id")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.stack([np.frombuffer(x.as_py(), "<f8") for x in batch.column("pivot")])
                yield batch.drop_columns(["pivot"]).append_column("turn", pa.array(angle((units(batch) * p).sum(axis=1))))

    turned = sat.join(pivot, "node").select("node", "id", "weight", "radius", "unit", "pivot").mapInArrow(
        turn, "node long, id long, weight long, radius double, unit binary, turn double")
    placed = positions(cut(turned), ["node"], ["turn", "id"], "place")
    chunks = cut(placed.withColumn("chunk", F.floor(F.col("place") / chunk)).groupBy("node", "chunk").applyInArrow(_chunk, CHUNKS))
    one, two = (chunks.select("node", *[F.col(c).alias(f"{c}_{k}") for c in ("chunk", "payload", "low", "high", "wide")]) for k in "ab")
    meet = ((F.col("chunk_a") <= F.col("chunk_b"))
            & (F.col("low_b") - F.col("high_a") <= theta + F.col("wide_a") + F.col("wide_b") + SLACK))
    pairs = one.join(two, "node").where(meet).select("chunk_a", "chunk_b", "payload_a", "payload_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (p, w, r, x), (q, z, s, y) = (opened(batch.column(k)[i]) for k in ("payload_a", "payload_b"))
                cos = x @ y.T
                turn_, same = angle(cos), batch.column("chunk_a")[i].as_py() == batch.column("chunk_b")[i].as_py()
                plain = (r[:, None] + s) == 0
                linked = np.where(plain, cos >= least, turn_ + r[:, None] + s <= theta - SLACK)
                partly = ~linked & ~plain & (turn_ - r[:, None] - s <= theta + SLACK)
                if same:
                    np.fill_diagonal(linked, False)
                    partly = np.triu(partly, 1)
                counts = [(p, linked @ z)] + ([] if same else [(q, linked.T @ w)])
                u, v = forest(linked, p, q)
                a, b = np.nonzero(partly)
                zero = [np.zeros(len(u), np.int64)]
                out_u = np.concatenate([*[c[0] for c in counts], u, p[a]])
                blank = sum(len(c[0]) for c in counts)
                out_v = np.concatenate([np.zeros(blank, np.int64), v, q[b]])
                weight = np.concatenate([*[c[1] for c in counts], *zero, np.zeros(len(a), np.int64)])
                yield pa.RecordBatch.from_pydict({
                    "u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64(), mask=np.arange(len(out_v)) < blank),
                    "weight": pa.array(weight, pa.int64(), mask=np.arange(len(weight)) >= blank + len(u))})

    return pairs.repartition("chunk_a", "chunk_b").mapInArrow(compare, "u long, v long, weight long")


def partly(pairs: DataFrame, member: DataFrame, points: DataFrame, balls: DataFrame, least: float, chunk: int) -> DataFrame:
    """For pairs of nodes (u, v) that are linked in part: rows (id, null, n) with the links of a vector to
    vectors of the other node, and (u, v, 0) where there are any."""
    used = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    wide = used.join(balls.select("id", "weight"), "id").select(
        F.col("id").alias("node"), F.ceil(F.col("weight") / chunk).cast("long").alias("chunks"))
    rows = (member.join(wide, F.col("centre") == F.col("node")).join(points, "id")
            .select("node", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), "id", F.lit(1).cast("long").alias("weight"),
                    F.lit(0.0).alias("radius"), "unit", F.lit(0.0).alias("turn")))
    chunks = cut(rows.groupBy("node", "chunk").applyInArrow(_chunk, CHUNKS)).select("node", "chunk", "payload")
    count = lambda c, k: wide.select(F.col("node").alias(c), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias(k))
    side = lambda c, k, p: chunks.select(F.col("node").alias(c), F.col("chunk").alias(k), F.col("payload").alias(p))
    work = (pairs.join(count("u", "i"), "u").join(count("v", "j"), "v")
            .join(side("u", "i", "a"), ["u", "i"]).join(side("v", "j", "b"), ["v", "j"]).select("u", "v", "a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (p, _, _, x), (q, _, _, y) = opened(batch.column("a")[i]), opened(batch.column("b")[i])
                linked = x @ y.T >= least
                if not linked.any():
                    continue
                n = [linked.sum(axis=1), linked.sum(axis=0)]
                ids, n = np.concatenate([p, q, [batch.column("u")[i].as_py()]]), np.concatenate([*n, [0]])
                edge = np.arange(len(ids)) == len(ids) - 1
                other = np.full(len(ids), batch.column("v")[i].as_py())
                on = (n > 0) | edge
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[on], pa.int64()), "v": pa.array(other[on], pa.int64(), mask=~edge[on]),
                                                  "n": pa.array(n[on].astype(np.int64))})

    return work.mapInArrow(compare, "id long, v long, n long")


def near(rows: DataFrame, least: float = 0.9, most: int = 16, orders: int = 6, block: int = 256, target: float = TARGET,
         sample: int = AUDIT, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector of (vec_id, embedding): vectors link when
    their cosine is ``least`` or more; component_id is the least vec_id reached by links, kept says
    whether that is the vector itself.

    ``most``: entries of a neighbour list; ``orders`` and ``block``: random orders to begin with, and nodes
    compared together in one; ``sample`` nodes are audited for a recall of ``target``.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing.
    Shorter vectors count as padded with zeros.  Of rows that share a vec_id the one of the least whole
    vector counts, and one is returned; a row with a null vec_id links with nothing, has a null
    component and isn't kept.  An empty table gives none; other columns are ignored."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = vectors.is_vector(F.col("embedding"))
    given = cut(rows.where("vec_id is not null").groupBy("vec_id")
                .agg(F.min(F.struct((~whole).alias("broken"), "embedding")).alias("r")).select("vec_id", "r.*"))
    there = given.where("not broken")
    n, dim = vectors.extent(there)
    points = cut(there.select("vec_id", "embedding").mapInArrow(_unit(dim), "id long, unit binary"))
    theta = float(np.arccos(least))
    member = cover(points, dim, n, theta / 2 - SLACK)
    balls = cut(member.groupBy("centre").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"), F.min("cos").alias("cos"))
                .select(F.col("centre").alias("id"), "weight", "first",
                        F.when(F.col("cos") >= 1, 0.0).otherwise(F.acos("cos")).alias("radius")))
    nodes = cut(balls.join(points, "id").select("id", "weight", "radius", "unit"))
    count = nodes.count()
    if not count:
        found = spark.createDataFrame([], "id long, n long, least long")
    else:
        found = _links(nodes, member, points, balls, dim, count, theta, least, most, orders, block, target, sample, chunk)
    out = given.join(found, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    lost = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    return out.union(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(nodes, member, points, balls, dim, count, theta, least, most, orders, block, target, sample, chunk) -> DataFrame:
    """id, n (links) and least (of its component) of every point."""
    lists, full, everything = graph(nodes, dim, count, theta, most, orders, block, target, sample)
    close = lists.where(F.col("gap") <= theta + SLACK)
    pairs = (close.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
             .agg(F.max("cos").alias("cos"), F.min("gap").alias("gap")))
    mark = lambda c: full.select(F.col("u").alias(c), F.lit(1).alias("full_" + c))
    # a whole angle is that of vectors; gap = angle - radii
    turn = F.acos(F.least("cos", F.lit(1.0)))
    plain = F.abs(turn - F.col("gap")) <= 1e-12
    pairs = cut(pairs.join(mark("u"), "u", "left").join(mark("v"), "v", "left")
                .withColumn("whole", F.when(plain, F.col("cos") >= least).otherwise(2 * turn - F.col("gap") <= theta - SLACK))
                .withColumn("part", ~plain & ~F.col("whole"))
                .withColumn("later", F.col("full_u").isNotNull() & F.col("full_v").isNotNull())
                .where("whole or part").select("u", "v", "whole", "part", "later"))
    weight = balls.select(F.col("id").alias("v"), "weight")
    now = pairs.where("whole and not later")
    counts = now.select("u", "v").union(now.select("v", "u")).join(weight, "v").select(F.col("u").alias("node"), "weight")
    edges = pairs.where("whole").select(F.col("u").alias("a"), F.col("v").alias("b"))
    half = pairs.where("part and not later").select("u", "v")
    if not full.isEmpty():
        dense = cut(crowded(full, lists, nodes, theta, least, everything, chunk))
        counts = counts.union(dense.where("v is null").select("u", "weight"))
        edges = edges.union(dense.where("weight = 0 and v is not null").select("u", "v"))
        half = half.union(dense.where("weight is null").select("u", "v")).distinct()
    counts = counts.groupBy("node").agg(F.sum("weight").alias("links"))
    if half.isEmpty():
        own = None
    else:
        own = cut(partly(cut(half), member, points, balls, least, chunk))
        edges = edges.union(own.where("v is not null").select("id", "v"))
    label = components(edges).select("node", "label")
    ball = balls.join(label, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")
    firsts = ball.groupBy("label").agg(F.min("first").alias("least"))
    ball = (ball.join(firsts, "label").join(counts.withColumnRenamed("node", "id"), "id", "left")
            .select(F.col("id").alias("centre"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "least"))
    out = member.select("id", "centre").join(ball, "centre").select("id", "n", "least")
    if own is not None:
        more = own.where("v is null").groupBy("id").agg(F.sum("n").alias("more"))
        out = out.join(more, "id", "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "least")
    return out
