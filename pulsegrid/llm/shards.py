"""Sharding by vector bin packing on bytes, tokens and rows together.

What is packed are units: lots, many per shard, to which groups of equal texts are dealt by hash,
and by themselves the heavy groups, over twice a lot's share: a bounded table, whatever the number
of groups.  Each unit goes to the shard where the dot product of its vector with the residual
capacity is highest.  A heavy group stays whole where a shard has room for it, and is cut by
document only if none has, so copies stay together as far as balance allows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window

from pulsegrid.session import cut

#: Lots for each shard, and most lots in all: the tables on the driver stay under 70 MB.
PER_SHARD, MOST_LOTS = 256, 262_144
#: Share of a shard by which a group of copies may go over its capacity rather than be cut.
SLACK = 1 / 128
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors``, ascending by unit: the rows of a unit together, largest unit
    first, by the dot product of its vector with what each shard has left, both as shares of a shard's
    capacity; ties go to the first shard.  Rows of a unit that fits no shard are placed singly."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total / shards, 1)
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    item = lambda rows: (-share[rows].sum(axis=0).max(), int(rows[0]), rows)
    heap = [item(rows) for rows in np.split(np.arange(len(units)), np.flatnonzero(np.diff(units)) + 1) if len(rows)]
    heapq.heapify(heap)
    while heap:
        _, _, rows = heapq.heappop(heap)
        size = share[rows].sum(axis=0)
        # a shard that would go over its capacity in the law's dimension comes after those that don't
        fits = left[:, 0] >= size[0]
        if len(rows) > 1:
            room = (left >= size - SLACK).all(axis=1)
            if not room.any():
                for r in rows:
                    heapq.heappush(heap, item(np.array([r])))
                continue
            fits = room & fits if (room & fits).any() else room
        k = int(np.argmax(np.where(fits, left @ size, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        out[rows] = k
        left[k] -= size
    return out


def shard(docs: DataFrame, shards: int = 24, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), tokens for every
    row of (doc_id, text).

    size: UTF-8 bytes of the text plus 8; a null text has none and the crc32 of nothing.  Slots of a
    shard run without a gap from 0, by unit, part and doc_id; equal rows take any order among themselves.
    Repeated rows are placed each; an empty table gives none; other columns are ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = cut(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"), F.xxhash64(text).alias("group")))
    lots = min(MOST_LOTS, shards * per_shard)
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = slim.agg(*sums).first()
    mean = {x: max(1.0, (total[x] or 0) / lots) for x in ("bytes", "rows")}
    # groups over twice a lot's share, at most as many as lots, are units after the lots.  Their rows are
    # numbered in parts of about a lot, by document
    heavy = (slim.groupBy("group").agg(*sums).where(" or ".join(f"{x} > {2 * n!r}" for x, n in mean.items()))
             .toPandas().sort_values("group"))
    parts = np.minimum(np.maximum(*[np.ceil(heavy[x] / n) for x, n in mean.items()]), heavy["rows"]).astype(int)
    table = F.broadcast(spark.createDataFrame(
        [(int(g), lots + i, int(n)) for i, (g, n) in enumerate(zip(heavy["group"], parts))], "group long, heavy int, parts int"))
    slim = slim.join(table, "group", "left").select(
        *slim.columns, F.coalesce("heavy", F.pmod("group", F.lit(lots)).cast("int")).alias("unit"),
        F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    items = slim.groupBy("unit", "part").agg(*sums).toPandas().sort_values(["unit", "part"]).reset_index(drop=True)
    items["shard"] = pack(items[list(DIMENSIONS)].to_numpy(float), items["unit"].to_numpy(), shards)
    items["first"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    places = F.broadcast(spark.createDataFrame(  # lots plus the parts of heavy groups: at most 4 * lots rows
        [tuple(map(int, r)) for r in items[["unit", "part", "shard", "first"]].itertuples(index=False)],
        "unit int, part int, shard int, first bigint"))
    inside = Window.partitionBy("unit", "part").orderBy("doc_id", "group")
    return (slim.join(places, ["unit", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.row_number().over(inside) - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "tokens"))
