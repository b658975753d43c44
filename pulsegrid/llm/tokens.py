"""Words, hashes and token ids of whole Arrow columns of texts, by numpy inside tasks.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  All bytes of a batch are handled at
once: a polynomial of a word's bytes is the difference of two running sums, so that the cost
is a few array operations per byte and no Python per word.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space other than space and line feed, where chunks of byte-level BPE can't be cut.
RARE_SPACE = re.compile("[%s]" % "".join(map(chr, (
    9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))

#: Bytes hashed at once; longer words are hashed in pieces of as many.
HASHED = 1 << 17
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and inverse powers 0 to ``HASHED``."""
    if not _powers:
        _powers[:] = [tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(HASHED, b, U)]))
                            for b in (base, pow(base, -1, 1 << 64))) for base in BASES]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence with hash ``a``, longer by ``b``."""
    return mix(a * U(0xA24BAED4963EE407) + b)


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the bounds of its texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a column of texts, of one row at least."""
    _, bounds = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a text's bounds end a run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~inside[:-1]
    fresh[bounds] = True
    starts = np.flatnonzero(fresh[:n] & inside)
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    cuts = bounds[(bounds > 0)] - 1
    last[cuts] = True
    return starts, np.flatnonzero(last & inside) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in order; blocks of bytes keep the running sums in cache."""
    out = mix((ends - starts).astype(U))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED)))
        first, last = int(starts[at]), int(ends[to - 1])
        a, b, n = starts[at:to] - first, ends[at:to] - first, last - first
        for base, (power, inverse), odd in zip(BASES, powers(), (1, 0x8EBC6AF09C88C6E3)):
            if n <= HASHED:
                sums = np.zeros(n + 1, U)
                np.cumsum((data[first:last].astype(U) + U(1)) * power[:n], out=sums[1:])
                value = (sums[b] - sums[a]) * inverse[a]
            else:  # one long word
                value = np.zeros(1, U)
                for k in range(first, last, HASHED):
                    piece = data[k:min(k + HASHED, last)].astype(U) + U(1)
                    value += (piece * power[:len(piece)]).sum(keepdims=True) * U(pow(base, k - first, 1 << 64))
            out[at:to] = mix(out[at:to] + value * U(odd))
        at = to
    return out


def words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and for each text the bounds of its words."""
    data, bounds = flat(texts)
    data = LOWER[data]
    starts, ends = runs(~SPACE[data], bounds)
    return hashes(data, starts, ends), np.searchsorted(starts, bounds)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)


def crc32s(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each range of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())),
                       np.int64, len(bounds) - 1)


class Encoder:
    """Token ids of texts by a tokenizers file, each distinct chunk encoded once.

    A chunk is what byte-pair merging can't cross: a word, for a file that drops white space;
    a word with the spaces and line feeds before it, for byte-level BPE, where a text with any
    other white space is encoded whole.  So is, for both, a text that holds an added token's string,
    which the library finds before anything else and may take with what is around it.  Chunks new
    to a worker are encoded many at a time as one text, and its ids dealt back: by their known
    bytes, or at a mark between words.
    ``room``: bytes of the table of known chunks, kept between batches."""

    def __init__(self, path: str, room: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = [t.content.encode() for t in added]
        # one looked for in normalized text may be in any text
        self.anywhere = self.tokenizer.normalizer is not None and any(t.normalized for t in added)
        self.spaced = len(self.one(" ")) > 0
        self.mark = next(((m.encode(), self.one(m)[0]) for m in "¶§~0" if len(self.one(m)) == 1), None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # byte-level files write each byte as one character
        self.forget()

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def holds(self, text: bytes) -> bool:
        """May the library find an added token in a text?"""
        return self.anywhere or any(x in text for x in self.added)

    def forget(self):
        """Known chunks: hashes in order, and of each where its ids begin and how many there are."""
        self.keys, self.begin, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                together: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks, byte ranges in order, in the order encoded; how many ids each has; all ids in that order."""
        gap = np.zeros(256, bool)
        gap[[10, 32]] = True
        raw, mark = data.tobytes(), self.mark[0] if self.mark else b""
        fits = np.zeros(len(starts), bool)
        if self.spaced:
            fits = gap[data[starts]] & ~gap[data[ends - 1]]
        elif mark:
            fits[:] = True
            at = raw.find(mark)
            while at >= 0:
                i = int(np.searchsorted(starts, at, "right")) - 1
                if i >= 0 and ends[i] > at:
                    fits[i] = False
                at = raw.find(mark, at + 1)
        joined, order, counts, ids = np.flatnonzero(fits), [], [], []

        def alone(some: np.ndarray):
            for i in some.tolist():
                ids.append(np.array(self.one(raw[starts[i]:ends[i]].decode()), np.uint32))
                order.append(np.array([i]))
                counts.append(np.array([len(ids[-1])]))

        alone(np.flatnonzero(~fits))
        groups = [joined[i:i + together] for i in range(0, len(joined), together)]
        between = b"" if self.spaced else b" " + mark + b" "
        for k in range(0, len(groups), 32):
            texts, some = [], []
            for g in groups[k:k + 32]:
                text = between.join(raw[a:b] for a, b in zip(starts[g].tolist(), ends[g].tolist()))
                if self.holds(text):  # these can't be dealt back
                    alone(g)
                else:
                    texts.append(text.decode())
                    some.append(g)
            for g, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                if self.spaced:
                    upto = np.searchsorted(np.cumsum(self.size[found]), np.cumsum(ends[g] - starts[g])) + 1
                else:
                    marks = np.flatnonzero(found == self.mark[1])
                    found = np.delete(found, marks)
                    upto = np.append(marks - np.arange(len(marks)), len(found))
                if len(upto) != len(g):
                    raise ValueError("the tokenizer doesn't split at white space")
                order.append(g)
                counts.append(np.diff(upto, prepend=0))
                ids.append(found)
        if not order:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.concatenate(order), np.concatenate(counts), np.concatenate(ids)

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        order, counts, ids = self.encoded(data, starts, ends)
        keys, begin = keys[order], len(self.ids) + np.cumsum(counts) - counts
        into = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[into])
        self.keys = np.insert(self.keys, place, keys[into])
        self.begin = np.insert(self.begin, place, begin[into])
        self.count = np.insert(self.count, place, counts[into].astype(np.int32))
        self.ids = np.concatenate([self.ids, ids])

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the table, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text's ids."""
        data, bounds = flat(texts)
        if not self.spaced:
            starts, ends = runs(~SPACE[data], bounds)
        else:
            gap = (data == 32) | (data == 10)
            first = np.zeros(len(data) + 1, bool)
            first[1:len(data)] = gap[1:] & ~gap[:-1]
            first[bounds] = True
            starts = np.flatnonzero(first[:len(data)])
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
        codes, keys = pd.factorize(hashes(data, starts, ends))
        place = self.known(keys)
        if (fresh := np.flatnonzero(place < 0)).size:
            if self.keys.nbytes + self.begin.nbytes + self.count.nbytes + self.ids.nbytes > self.room:
                self.forget()  # the table starts anew with the chunks of this batch
                fresh = np.arange(len(keys))
            at = np.zeros(len(keys), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            self.learn(keys[fresh], data, starts[at[fresh]], ends[at[fresh]])
            place = self.known(keys)
        lengths = self.count[place][codes]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        step = np.ones(total[-1], np.int64)  # where each id lies: one further, but for the first of a chunk
        some = lengths > 0
        begin = self.begin[place][codes][some]
        step[total[:-1][some]] = np.diff(begin, prepend=0) - np.concatenate([[0], lengths[some][:-1] - 1]) if len(begin) else begin
        ids = self.ids[np.cumsum(step, out=step)]
        cut = total[np.searchsorted(starts, bounds)]
        return self._whole(data, bounds, ids, cut)

    def _whole(self, data, bounds, ids, cut):
        """Encode anew, whole, the texts that have rare white space, for byte-level BPE, or an added token."""
        again = np.full(len(bounds) - 1, self.anywhere)
        again[self._adding(data, bounds)] = True
        if self.spaced:
            odd = ((data < 32) & (data != 10)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
            count = np.concatenate([[0], np.cumsum(odd)])
            maybe = np.flatnonzero((count[bounds[1:]] > count[bounds[:-1]]) & ~again)
            again[[i for i in maybe.tolist() if RARE_SPACE.search(data[bounds[i]:bounds[i + 1]].tobytes().decode())]] = True
        if not again.any():
            return ids, cut
        parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
        for i in np.flatnonzero(again).tolist():
            parts[i] = np.array(self.one(data[bounds[i]:bounds[i + 1]].tobytes().decode()), np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _adding(self, data, bounds) -> list[int]:
        """Texts that hold an added token's string."""
        raw, out = data.tobytes() if self.added else b"", []
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                i = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(x) <= bounds[i + 1]:
                    out.append(i)
                at = raw.find(x, at + 1)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
