"""Token ids on disk as wavelet matrices: bit-planes that answer access, count and lookup.

Documents are ordered by doc_id over range partitions.  A partition writes its documents in
shards of about ``shard_ids`` ids, each one compressed blob that holds a whole matrix, so that
neither a partition nor the corpus is ever in one memory; a single document is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import tokens
from pulsegrid.session import scratch_path

MAGIC = b"WVM2"
SHARD_IDS = 1 << 20
BLOCK = 512  # bits between stored counts of ones
WIDTH = BLOCK // 8
CHUNK = 1 << 13  # bytes of a plane that are compressed together


def squeeze(raw) -> bytes:
    raw = bytes(raw)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(saved) -> bytes:
    return pa.Codec("zstd").decompress(saved[8:], struct.unpack_from("<Q", saved)[0], asbytes=True)


class Plane:
    """The bits of a plane, padded to whole chunks; of a file only the chunks that are asked for are inflated."""

    def __init__(self, bits: np.ndarray, chunks: list | None = None):
        self.bits, self.chunks = bits, chunks

    @classmethod
    def of(cls, one: np.ndarray) -> Plane:
        raw = np.packbits(one)
        bits = np.zeros(-(-(len(raw) + 1) // CHUNK) * CHUNK, np.uint8)
        bits[:len(raw)] = raw
        return cls(bits)

    @classmethod
    def stored(cls, chunks: list) -> Plane:
        return cls(np.zeros(len(chunks) * CHUNK, np.uint8), list(chunks))

    def need(self, chunks) -> None:
        for c in chunks if self.chunks else ():
            if self.chunks[c] is not None:
                self.bits[c * CHUNK:(c + 1) * CHUNK] = np.frombuffer(pa.Codec("zstd").decompress(self.chunks[c], CHUNK, asbytes=True), np.uint8)
                self.chunks[c] = None

    def rows(self, blocks: np.ndarray) -> np.ndarray:
        """The bytes of blocks, a row each."""
        self.need(np.unique(blocks * WIDTH // CHUNK).tolist())
        return self.bits.reshape(-1, WIDTH)[blocks]

    def whole(self, n: int) -> np.ndarray:
        self.need(range(len(self.chunks or ())))
        return np.unpackbits(self.bits, count=n).view(bool)

    def save(self) -> list[bytes]:
        self.need(range(len(self.chunks or ())))
        codec = pa.Codec("zstd", compression_level=1)
        return [codec.compress(self.bits[at:at + CHUNK], asbytes=True) for at in range(0, len(self.bits), CHUNK)]


class WaveletMatrix:
    """A sequence of ids below 2**bits.  Plane k holds bit k from the top, in the order that the
    planes above have sorted the sequence to: zeros first, both stably."""

    def __init__(self, n: int, planes: list[Plane], zeros: np.ndarray, ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        now = np.ascontiguousarray(ids, np.uint32)
        bits = max(1, int(now.max(initial=0)).bit_length())
        now = now.astype(np.uint16) if bits <= 16 else now
        planes, zeros, ranks = [], np.zeros(bits, np.int64), []
        for k in range(bits):
            one = (now & now.dtype.type(1 << (bits - 1 - k))).astype(bool)
            planes.append(Plane.of(one))
            ranks.append(cls._ranks(planes[-1].bits))
            low = now[~one]
            zeros[k] = len(low)
            now = np.concatenate([low, now[one]])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _ranks(bits: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, WIDTH // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def _bits(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit of plane k at each position, and the ones before it."""
        block, within = i // BLOCK, i % BLOCK
        rows = self.planes[k].rows(block)
        left = within[:, None] - np.arange(WIDTH) * 8
        mask = np.where(left >= 8, 255, np.where(left <= 0, 0, 256 - (1 << np.clip(8 - left, 0, 8)))).astype(np.uint8)
        ones = self.ranks[k][block].astype(np.int64) + np.bitwise_count(rows & mask).sum(axis=1, dtype=np.int64)
        bit = rows[np.arange(len(i)), within >> 3] >> (7 - (within & 7)).astype(np.uint8) & 1
        return bit.astype(np.int64), ones

    def _select(self, k: int, bit: int, j: np.ndarray) -> np.ndarray:
        """Where the ones, or zeros, of plane k stand that have ``j`` like them before: the block by the
        stored counts, the place by the block's bits."""
        before = self.ranks[k].astype(np.int64)
        before = before if bit else np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, j, "right") - 1
        out = np.empty(len(j), np.int64)
        for at in range(0, len(j), 4096):
            b = block[at:at + 4096]
            own, place = np.unique(b, return_inverse=True)
            like = np.unpackbits(self.planes[k].rows(own), axis=1) == bit
            upto = np.cumsum(like, axis=1, dtype=np.int16)[place]
            out[at:at + 4096] = b * BLOCK + (upto <= (j[at:at + 4096] - before[b])[:, None]).sum(axis=1)
        return out

    def access(self, i) -> np.ndarray:
        """The ids at positions ``i``."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.uint32)
        for k in range(len(self.planes)):
            bit, ones = self._bits(k, i)
            out = (out << 1) | bit.astype(np.uint32)
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` within [a, b) stand below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            x, y = self._bits(k, np.array([a, b]))[1].tolist()
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (len(self.planes) - 1 - k) & 1 else (a - x, b - y)
        return int(a), int(b)

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token in [a, b)."""
        x, y = self._range(int(token), a, self.n if b is None else b)
        return y - x

    def find(self, token: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Positions of a token in [a, b), in order: select, from the last plane up."""
        x, y = self._range(int(token), a, self.n if b is None else b)
        at = np.arange(x, y)
        for k in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            one = self.planes[k].whole(self.n)
            above = np.empty_like(now)
            above[~one] = now[:self.zeros[k]]
            above[one] = now[self.zeros[k]:] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = above
        return now.astype(np.uint32)

    def to_bytes(self) -> bytes:
        """Length, planes, zeros of each, compressed counts, and the planes' chunks after their lengths."""
        chunks = [c for plane in self.planes for c in plane.save()]
        counts = squeeze(np.concatenate(self.ranks).astype("<u4").tobytes())
        return b"".join([struct.pack("<QIIQ", self.n, len(self.planes), len(chunks), len(counts)), self.zeros.astype("<i8").tobytes(),
                         counts, np.array([len(c) for c in chunks], "<u4").tobytes(), *chunks])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, bits, chunks, counts = struct.unpack_from("<QIIQ", raw)
        at = struct.calcsize("<QIIQ")
        zeros = np.frombuffer(raw, "<i8", bits, at)
        at += 8 * bits
        ranks = np.frombuffer(unsqueeze(raw[at:at + counts]), "<u4").reshape(bits, -1)
        at += counts
        ends = at + 4 * chunks + np.cumsum(np.frombuffer(raw, "<u4", chunks, at), dtype=np.int64)
        starts = [at + 4 * chunks, *ends[:-1].tolist()]
        saved = [raw[a:b] for a, b in zip(starts, ends.tolist())]
        per = chunks // bits
        return cls(n, [Plane.stored(saved[k * per:(k + 1) * per]) for k in range(bits)], zeros, list(ranks))


def to_blob(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file: magic, compressed document table, and the matrix."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8")
    docs = squeeze(b"".join([struct.pack("<Q", len(doc_ids)), known.tobytes(), table.tobytes(), np.asarray(lengths, "<i8").tobytes()]))
    return MAGIC + struct.pack("<Q", len(docs)) + docs + WaveletMatrix.of(ids).to_bytes()


def from_blob(blob: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of a shard file, whose planes are still compressed."""
    if blob[:4] != MAGIC:
        raise ValueError("not a shard file")
    at = 12 + struct.unpack_from("<Q", blob, 4)[0]
    raw = unsqueeze(blob[12:at])
    (n,) = struct.unpack_from("<Q", raw)
    known, table = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, "<i8", n, 8 + n)
    lengths = np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    return [d if k else None for d, k in zip(table.tolist(), known)], lengths, WaveletMatrix.from_bytes(blob[at:])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts and write the shards to the table ``path``: part, seq, first (ids of the part
    before the shard), n_ids and blob, in ascending doc_id order by (part, seq).

    Null and empty texts are the end id alone.  A null doc_id comes first.  Repeated rows are written
    each.  Other columns are ignored."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        seq = first = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard():
            nonlocal seq, first, held
            doc_ids, ids = [d for h in held for d in h[0]], np.concatenate([h[2] for h in held])
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "blob": pa.array([to_blob(doc_ids, np.concatenate([h[1] for h in held]), ids)], pa.binary())})
            seq, first, held = seq + 1, first + len(ids), []
            return row

        for batch in batches:
            for some in tokens.slices(batch):
                ids, bounds = code(some.column("text"))
                lengths = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
                doc_ids, ends, a = some.column("doc_id").to_pylist(), np.cumsum(lengths), 0
                while a < len(doc_ids):  # up to the document that fills the shard
                    begin = int(ends[a] - lengths[a])
                    room = shard_ids - sum(len(h[2]) for h in held)
                    b = min(len(doc_ids), int(np.searchsorted(ends, begin + room)) + 1)
                    held.append((doc_ids[a:b], lengths[a:b], ids[begin:ends[b - 1]]))
                    if sum(len(h[2]) for h in held) >= shard_ids:
                        yield shard()
                    a = b
        if held:
            yield shard()

    order = [F.col("doc_id").cast("bigint").asc_nulls_first(), F.xxhash64("text")]
    (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(encode, "part int, seq int, first bigint, n_ids bigint, blob binary")
     .write.option("compression", "none").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that ``write`` left."""
    shards = spark.read.parquet(path)
    totals = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect()))  # a row for each part written
    before = dict(zip((p for p, _ in totals), np.cumsum([0] + [n for _, n in totals]).tolist()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                doc_ids, lengths, matrix = from_blob(row.column("blob")[0].as_py())
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                start = before[row.column("part")[0].as_py()] + row.column("first")[0].as_py() + bounds[:-1]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(tokens.crc32s(matrix.decode(), bounds), pa.int64())})

    return (shards.select("part", "first", "blob")
            .mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "wavelet")
    write(docs, path, tokenizer)
    return read(spark, path)
