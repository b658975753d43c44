"""Hard negatives by one-bit codes of rotated vectors.

A vector v, as integers and less the mean c of all, is rotated; its code has the sign of each
component, and with the code are stored the length of v - c and the alignment, the cosine of the
vector to its code vector (signs over the root of the dimension).  With a rotated query q the part of
v - c along the code vector is known from bit counts of the code with the bit-planes of q; by
Cauchy-Schwarz the rest is at most the residual's length times the length of what q has off the
code vector.  So each pair has an interval that holds its score for certain.  Pairs whose interval
can't reach what is already found go no further; all others get their integer scores.

Rows are held in groups of bounded size; each anchor visits every group once, a block of anchors at
a time, and leaves its best rows of the group, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm import vectors
from pulsegrid.llm.scoring import dump, undump
from pulsegrid.llm.tokens import spread
from pulsegrid.session import cut

U = np.uint64
#: Rows of a unit, units of a group, anchors of a block, bits of a query's component.
UNIT, GROUP, ANCHORS, PLANES = 10_000, 12, 128, 8
NONE = np.iinfo(np.int64).min
FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
VISIT = "group int, kind int, anchor_id long, label long, payload binary, positive_ids array<long>, positive_scores array<long>"


@lru_cache(4)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """The last axis of bits as 64-bit words."""
    raw = np.packbits(bits, axis=-1)
    wide = -(-raw.shape[-1] // 8) * 8
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, wide - raw.shape[-1])])).view(U)


class Codes:
    """Rows by ascending id with codes, lengths and alignments."""

    def __init__(self, ids, labels, ints, codes, length, align):
        self.ids, self.labels, self.ints, self.codes, self.length, self.align = ids, labels, ints, codes, length, align

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, mean: np.ndarray) -> Codes:
        turned = (ints - mean) @ rotation(ints.shape[1])
        length = np.linalg.norm(turned, axis=1)
        align = np.abs(turned).sum(axis=1) / (np.sqrt(ints.shape[1]) * np.where(length > 0, length, 1))
        return cls(ids, labels, ints, packed(turned >= 0), length, np.where(length > 0, np.minimum(align, 1), 1))

    def save(self) -> bytes:
        return dump([self.ids, self.labels, self.ints.astype("<i8").reshape(-1), self.codes.reshape(-1),
                     self.length, self.align])

    @classmethod
    def load(cls, raw: bytes) -> Codes:
        ids, labels, ints, codes, length, align = undump(raw)
        n = len(ids)
        return cls(ids, labels, ints.reshape(n, -1), codes.reshape(n, -1), length, align)

    def bounds(self, queries: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, least and greatest value of every query's score with every row."""
        dim = queries.shape[1]
        turned = queries @ rotation(dim)
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2 ** PLANES - 1), 1e-300)
        level = np.rint((turned - low) / step).astype(np.int64)
        off = np.abs(turned - (low + step * level)).sum(axis=1, keepdims=True) / np.sqrt(dim)
        counts = np.zeros((len(queries), len(self.ids)))
        ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        for k in range(PLANES):
            plane = packed((level >> k & 1).astype(bool))
            for w in range(plane.shape[1]):
                counts += np.bitwise_count(plane[:, w, None] & self.codes[None, :, w]) * float(1 << k)
        signed = (2 * (low * ones + step * counts) - (low * dim + step * level.sum(axis=1, keepdims=True))) / np.sqrt(dim)
        norm = (queries.astype(float) ** 2).sum(axis=1, keepdims=True)
        along = np.maximum(np.abs(signed) - off, 0)
        rest = np.sqrt(np.maximum(1 - self.align ** 2, 0)) * np.sqrt(np.maximum(norm - along ** 2, 0))
        middle = self.length * self.align * signed + queries @ mean[:, None]
        # some room for rounding in the sums above
        half = self.length * (self.align * off + rest) + 1e-9 * (np.abs(middle) + self.length * np.sqrt(norm)) + 1e-6
        return middle, middle - half, middle + half


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; by doubles where their sums are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 2 ** 53 else a @ b.T


class Best:
    """For each query and window the first ``most`` rows by score, then by smaller id."""

    def __init__(self, queries: int, windows: int, most: int):
        self.most = most
        self.scores = np.full((queries, windows, most), NONE)
        self.ids = np.full((queries, windows, most), np.iinfo(np.int64).max)

    def add(self, unit: Codes, middle, least, greatest, allowed: np.ndarray, queries: np.ndarray,
            low: np.ndarray, high: np.ndarray):
        """Rows of a unit whose score can lie between ``low`` and ``high`` of a window and can still
        be among the first; ``allowed`` says which rows a query may take at all."""
        def open_() -> np.ndarray:
            last = self.scores[:, :, -1]
            reach = np.maximum(low, last)
            return [(allowed & (greatest >= reach[:, w, None]) & (least <= high[:, w, None])) for w in range(low.shape[1])]

        # the rows of the best estimates first, so that the others have more to reach
        first = min(4 * self.most, len(unit.ids))
        guess = np.argpartition(np.where(allowed, -middle, np.inf), first - 1, axis=1)[:, :first]
        some = np.zeros(allowed.shape, bool)
        np.put_along_axis(some, guess, True, axis=1)
        self._score(unit, queries, [x & some for x in open_()], low, high)
        self._score(unit, queries, [x & ~some for x in open_()], low, high)

    def _score(self, unit: Codes, queries: np.ndarray, masks: list[np.ndarray], low, high):
        columns = np.flatnonzero(np.logical_or.reduce([m.any(axis=0) for m in masks]))
        if not len(columns):
            return
        score = products(queries, unit.ints[columns])
        ids = unit.ids[columns]
        for w, mask in enumerate(masks):
            fits = mask[:, columns] & (score >= low[:, w, None]) & (score <= high[:, w, None])
            rows = np.flatnonzero(fits.any(axis=1))
            if not len(rows):
                continue
            now = np.where(fits[rows], score[rows], NONE)
            keep = min(self.most, len(columns))
            edge = -np.partition(-np.maximum(now, NONE + 1), keep - 1, axis=1)[:, keep - 1, None]
            r, c = np.nonzero((now >= edge) & (now > NONE))
            order = np.lexsort((ids[c], -now[r, c], r))
            r, c = r[order], c[order]
            place = spread(np.bincount(r, minlength=len(rows)))
            r, c, place = (x[place < keep] for x in (r, c, place))
            both = np.full((len(rows), 2 * self.most), NONE)
            names = np.full((len(rows), 2 * self.most), np.iinfo(np.int64).max)
            both[:, :self.most], names[:, :self.most] = self.scores[rows, w], self.ids[rows, w]
            both[r, self.most + place], names[r, self.most + place] = now[r, c], ids[c]
            order = np.lexsort((names, -np.maximum(both, NONE + 1)), axis=1)[:, :self.most]
            self.scores[rows, w] = np.take_along_axis(both, order, axis=1)
            self.ids[rows, w] = np.take_along_axis(names, order, axis=1)


def _index(mean: np.ndarray, groups: int):
    """Units of the rows: a group number and the codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            values, _ = vectors.dense(batch.column("embedding"), len(mean))
            ints = np.floor(256 * values).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(order), UNIT):
                o = order[at:at + UNIT]
                unit = Codes.of(ids[o].astype(np.int64), labels[o].astype(np.int64), ints[o], mean)
                # the place of a unit follows from its rows alone
                group = int((int(unit.ids[0]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) % groups)
                yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()),
                                                  "payload": pa.array([unit.save()], pa.binary())})
    return run


def _visit(mean: np.ndarray, most: int, low: int, high: int, same: bool):
    """Of each group of units (kind 0) and for each of its visiting anchors (kind 1) the first rows: of
    the anchor's label, or of other labels in the windows of its positives."""
    def answer(units: list[Codes], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, ANCHORS):
            some = rows.slice(at, ANCHORS)
            ids, labels = some.column("anchor_id").to_numpy(), some.column("label").to_numpy()
            queries = np.stack([np.frombuffer(x.as_py(), "<i8") for x in some.column("payload")])
            if same:
                names, scores = np.full((len(ids), 1), NONE), np.zeros((len(ids), 1), np.int64)
                floor, ceiling = np.full((len(ids), 1), NONE + 1), np.full((len(ids), 1), -NONE - 1)
            else:
                pids, pscores = some.column("positive_ids").to_pylist(), some.column("positive_scores").to_pylist()
                wide = max(map(len, pids))
                names = np.array([p + [NONE] * (wide - len(p)) for p in pids], np.int64)
                scores = np.array([p + [-1] * (wide - len(p)) for p in pscores], np.int64)  # below zero nothing fits
                hundreds, rest = scores // 100, scores % 100  # products with scores may pass 64 bits
                floor, ceiling = low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100
                ceiling[scores < 0] = NONE + 1
            best = Best(len(ids), names.shape[1], most)
            for unit in units:
                allowed = ((unit.labels[None, :] == labels[:, None]) == same) & (unit.ids[None, :] != ids[:, None])
                best.add(unit, *unit.bounds(queries, mean), allowed, queries, floor, ceiling)
            a, w, k = np.nonzero(best.scores > NONE)
            yield pa.RecordBatch.from_pydict({
                "anchor_id": pa.array(ids[a], pa.int64()), "positive_id": pa.array(names[a, w], pa.int64()),
                "positive_score": pa.array(scores[a, w], pa.int64()),
                "other_id": pa.array(best.ids[a, w, k], pa.int64()), "score": pa.array(best.scores[a, w, k], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, units = None, []
        for batch in batches:
            numbers, kind = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(numbers) | np.diff(kind)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if numbers[a] != group:
                    group, units = numbers[a], []
                if kind[a] == 0:
                    units += [Codes.load(x.as_py()) for x in batch.column("payload").slice(a, b - a)]
                else:
                    yield from answer(units, batch.slice(a, b - a))
    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding).

    A component is floor(256 x), a score the integer inner product, which has to fit a long; higher
    scores come first, ties by smaller vec_id.  An anchor's positives are its first other rows of its
    label; with each, the first rows of other labels whose score is from ``low`` to ``high`` hundredths
    of the positive's are negatives.  ``anchor`` says which rows are anchors (null: not one).

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.  Of
    rows that share a vec_id the one of the least label, then of the least vector, takes part.  Shorter
    vectors count as padded with zeros, an empty one is all zeros.  Anchors without positives, positives
    of a score below zero, and an empty table give no rows.  Other columns are ignored."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding"), anchor.alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.is_vector(F.col("embedding")))
    rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r")).select("vec_id", "r.*"))
    n, dim = vectors.extent(rows)
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    # the middle of the rows shortens what codes must describe; any value keeps the intervals right
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            total += np.floor(256 * vectors.dense(batch.column("embedding"), dim)[0]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(dim), pa.int32()), "s": pa.array(total)})

    sums = (rows.select("embedding").mapInArrow(add, "place int, s double").groupBy("place")
            .agg(F.sum("s").alias("s")).collect())  # a row for each component
    mean = np.zeros(dim)
    for r in sums:
        mean[r.place] = r.s / n
    groups = -(-n // (UNIT * GROUP))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(groups, min(shuffles, -(-n // UNIT)))
    units = cut(rows.select("vec_id", "label", "embedding").mapInArrow(_index(mean, groups), "group int, payload binary"))
    none = F.lit(None).cast("array<long>")
    held = units.select("group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor_id"),
                        F.lit(None).cast("long").alias("label"), "payload", none.alias("positive_ids"), none.alias("positive_scores"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, _ = vectors.dense(batch.column("embedding"), dim)
            ints = np.floor(256 * values).astype("<i8")
            yield pa.RecordBatch.from_pydict({"anchor_id": batch.column("vec_id"), "label": batch.column("label"),
                                              "payload": pa.array([x.tobytes() for x in ints], pa.binary())})

    asked = cut(rows.where("anchor").select("vec_id", "label", "embedding")
                .mapInArrow(bytes_of, "anchor_id long, label long, payload binary"))

    def visits(anchors: DataFrame, most: int, same: bool) -> DataFrame:
        going = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
            "group", F.lit(1).alias("kind"), "anchor_id", "label", "payload", "positive_ids", "positive_scores")
        return (held.union(going).repartition(groups, "group").sortWithinPartitions("group", "kind")
                .mapInArrow(_visit(mean, most, low, high, same), FOUND))

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    near = (visits(asked.withColumns({"positive_ids": none, "positive_scores": none}), positives, True)
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives))
    near = cut(near.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("p"))
               .select("anchor_id", F.col("p.other_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    return (visits(asked.join(near, "anchor_id"), negatives, False)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
