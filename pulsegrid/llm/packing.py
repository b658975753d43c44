"""Packing pieces of documents into sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver, one number for each length up to the
capacity.  There a pattern says how many pieces of which lengths share a sequence.  The linear
program over patterns is solved by multiplicative weights: lengths that are behind in coverage
weigh more, and a knapsack by dynamic programming prices the best pattern around each length.
Its solution is rounded down, and what is left goes by best fit into the patterns' gaps.
Pieces are then matched to patterns by their rank within their length, on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm import tokens
from pulsegrid.session import cut

#: Most pieces of one length that are ranked in one task.
LOT = 250_000


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each room up to ``capacity`` the best total value of lengths, each any number of
    times, and the index of a length to take first (-1: none)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], take[room] = best[room - 1], take[room - 1]
        k = int(np.searchsorted(lengths, room, "right"))
        if k:
            total = best[room - lengths[:k]] + values[:k]
            i = int(np.argmax(total))
            if total[i] > best[room]:
                best[room], take[room] = total[i], i
    # rooms where nothing more is taken inherit the choice of a smaller room, whose length still fits
    return best, take


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """Patterns, as ((index, times), ...), and how often each is used: a cover of the counts."""
    used: dict[tuple, float] = defaultdict(float)
    done = np.zeros(len(lengths))
    for t in range(rounds):
        behind = np.exp(-4.0 * (done / counts - t / rounds))
        values = np.where(done < counts, behind, 1e-6) * lengths / capacity
        _, take = price(lengths, values, capacity)
        goal = counts * (t + 1) / rounds
        for i in range(len(lengths) - 1, -1, -1):
            if done[i] >= goal[i]:
                continue
            pattern, room = defaultdict(int, {i: 1}), capacity - lengths[i]
            while room > 0 and take[room] >= 0:
                pattern[int(take[room])] += 1
                room -= lengths[take[room]]
            k, times = np.array(list(pattern)), np.array(list(pattern.values()))
            step = min((goal[i] - done[i]) / pattern[i], float((np.maximum(counts[k] - done[k], 0) / times).min()))
            if step > 0:
                used[tuple(sorted(pattern.items()))] += step
                done[k] += step * times
    return used


def best_fit(lengths: np.ndarray, left: np.ndarray, bins: list[tuple[dict, int]], capacity: int) -> list[tuple[dict, int]]:
    """Put the counts ``left``, longest first, into the fullest bins that take them, many equal bins at
    a time; open new ones where none does."""
    by_room: dict[int, list] = defaultdict(list)
    for pattern, n in bins:
        by_room[capacity - sum(int(lengths[i]) * k for i, k in pattern.items())].append((pattern, n))
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(left[i])
        for room in range(size, capacity + 1):
            while n and by_room.get(room):
                pattern, many = by_room[room].pop()
                some = min(n, many)
                if many > some:
                    by_room[room].append((pattern, many - some))
                by_room[room - size].append((pattern | {i: pattern.get(i, 0) + 1}, some))
                n -= some
            if not n:
                break
        each = capacity // size
        for k, many in ((each, n // each), (n % each, 1)):
            if k and many:
                by_room[capacity - k * size].append(({i: k}, many))
    return [x for group in by_room.values() for x in group]


def solve(histogram: dict[int, int], capacity: int, rounds: int = 48) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces} with the number of sequences of each; every piece has its place."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths])
    used = fractional(lengths, counts.astype(float), capacity, rounds)
    left, bins = counts.copy(), []
    fill = lambda p: sum(int(lengths[i]) * k for i, k in p)
    for pattern in sorted(used, key=lambda p: (-fill(p), p)):
        k, times = np.array([i for i, _ in pattern]), np.array([n for _, n in pattern])
        n = min(int(used[pattern] + 1e-6), int((left[k] // times).min()))
        if n:
            left[k] -= n * times
            bins.append((dict(pattern), n))
    return [({int(lengths[i]): k for i, k in p.items()}, n) for p, n in best_fit(lengths, left, bins, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every row of (doc_id, text)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(tokenizer)
        for batch in batches:
            for some in tokens.slices(batch):
                ids, bounds = code(some.column("text"))
                ids, lengths = np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1
                n = -(-lengths // capacity)
                k = tokens.spread(n)
                start = k * capacity
                size = np.minimum(capacity, np.repeat(lengths, n) - start)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))),
                    "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(tokens.crc32s(ids, np.concatenate([[0], np.cumsum(size)])), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row.

    A null or empty text is its end id alone.  Repeated rows are packed each; equal pieces take any
    order among themselves.  An empty table gives none; other columns are ignored."""
    spark = docs.sparkSession
    slim = cut(pieces(docs, tokenizer, capacity))
    histogram = {int(r[0]): int(r[1]) for r in slim.groupBy("length").count().collect()}  # at most ``capacity`` rows
    lots = F.broadcast(spark.createDataFrame(  # at most ``capacity`` rows
        [(k, -(-n // LOT)) for k, n in histogram.items()], "length bigint, lots bigint"))
    slim = slim.join(lots, "length").withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("lots")))
    counts = sorted(map(tuple, slim.groupBy("length", "lot").count().collect()))  # capacity + pieces / LOT rows at most
    first: dict[tuple, int] = {}
    total: dict[int, int] = defaultdict(int)
    for length, lot, n in counts:
        first[length, lot] = total[length]
        total[length] += n
    # for each length the ranks where a pattern begins, its first sequence, copies and offset
    at: dict[int, list] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in solve(histogram, capacity):
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            at[length].append((filled[length], sequence, k, offset))
            filled[length] += n * k
            offset += length * k
        sequence += n
    plan = spark.sparkContext.broadcast(  # the solution's patterns by length, some thousands
        ({k: np.array(v, np.int64).T for k, v in at.items()}, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals, before = plan.value
        for batch in batches:
            length, lot = (batch.column(c).to_numpy() for c in ("length", "lot"))
            rank = batch.column("rank").to_numpy() - 1 + np.array(
                [before[x] for x in zip(length.tolist(), lot.tolist())], np.int64)
            ids, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                begin, seq, copies, offset = intervals[size]
                k = np.searchsorted(begin, rank[rows], "right") - 1
                inside = rank[rows] - begin[k]
                ids[rows] = seq[k] + inside // copies[k]
                offsets[rows] = offset[k] + inside % copies[k] * size
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(ids), "offset": pa.array(offsets)})

    inside = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")
    return slim.withColumn("rank", F.row_number().over(inside).cast("bigint")).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
