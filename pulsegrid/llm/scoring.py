"""Scores of texts under a smoothed n-gram model, as a weighted backoff automaton.

A state is a history that the training texts have.  A word that has followed the history is an
arc with its probability; any other word takes the failure arc, with the history's backoff
weight, to the state of the history without its first word.  Probabilities are interpolated:

    p(w | h) = (c(h w) + t(h) p(w | h')) / (c(h) + t(h)),   t(h) = c(h) ** growth,

where ``t`` stands for the number of different words after ``h`` by a growth law, which makes
the failure arc of h weigh t(h) / (c(h) + t(h)).  At the root
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The automaton grows with the corpus and is nowhere whole.  Tasks read blocks of documents and
send each distinct n-gram with its count to the bucket of its hash, one row for each block and
bucket; buckets add up and answer each block with the corpus counts of what it has sent.  So a
block gets just the states and arcs that its documents can reach, builds that part of the automaton
and traverses it with all its documents side by side.  The documents are read once more for that,
which moves them through one shuffle only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm import tokens

U = np.uint64
END, BEGIN = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)  # words are hashed, these two are not
#: Tokens of a block, unless one document has more; of a bucket's share of all tokens; and of a piece of a traversal.
BLOCK, SHARE, PIECE = 1_000_000, 2_000_000, 128
REQUEST = "bucket long, block long, payload binary"


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """Is the remainder of the id's crc32 that part?  A null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


class Block:
    """Documents with their token hashes, each with an end token."""

    def __init__(self, doc_ids: pa.Array, held: np.ndarray, words: np.ndarray, bounds: np.ndarray):
        self.doc_ids, self.held, self.words, self.bounds = doc_ids, held, words, bounds

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        h, bounds = tokens.words(batch.column("text"))
        return cls(batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False),
                   np.insert(h, bounds[1:], END), bounds + np.arange(len(bounds)))

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        shift = np.cumsum([0] + [len(b.words) for b in blocks])
        return cls(pa.concat_arrays([b.doc_ids for b in blocks]), np.concatenate([b.held for b in blocks]),
                   np.concatenate([b.words for b in blocks]),
                   np.concatenate([[0], *[b.bounds[1:] + s for b, s in zip(blocks, shift)]]))

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For orders 1 to ``order`` the key at each token, and where there is one.  An n-gram may start
        with the begin of its text, which the first token follows.  Keys of words have 64 bits, others 56."""
        place = tokens.spread(np.diff(self.bounds))
        h = self.words
        yield h, np.ones(len(h), bool)
        for k in range(2, order + 1):
            before = np.concatenate([[BEGIN], h[:-1]]).astype(U)
            if k == 2:
                before[place == 0] = BEGIN
            h = tokens.chain(before, self.words)
            yield h >> U(8), place >= k - 2

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, np.diff(self.bounds))

    def save(self) -> bytes:
        known, local, count = np.unique(self.words, return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")  # small numbers for frequent words
        place = np.empty(len(known), "<u4")
        place[often] = np.arange(len(known))
        ids = [self.doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
               self.doc_ids.fill_null(0).to_numpy().astype("<i8")]
        return dump([*ids, self.held.astype(np.uint8), np.diff(self.bounds).astype("<i8"), known[often], place[local]])

    @classmethod
    def load(cls, raw: bytes) -> Block:
        valid, ids, held, lengths, known, local = undump(raw)
        return cls(pa.array(ids, pa.int64(), mask=valid == 0), held.astype(bool), known[local],
                   np.concatenate([[0], np.cumsum(lengths)]))


def dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays as compressed bytes, all first bytes of an array before all second ones, and so on."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), a.nbytes)], "<i8")
    raw = b"".join([head.tobytes(), *[
        np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def undump(saved: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(saved[8:], int(np.frombuffer(saved, "<i8", 1)[0]), asbytes=True)
    (n,) = np.frombuffer(raw, "<i8", 1)
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * int(n), []
    for kind, size in head.reshape(-1, 2).tolist():
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes, which take fewer bytes; undone by a running sum."""
    return np.diff(ascending, prepend=U(0))


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, Block]]:
    """Blocks of about ``most`` tokens with their numbers, the same whenever a partition's rows come in the same order."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for some in tokens.slices(batch):
            held.append(Block.of(some))
            size += len(held[-1].words)
            if size >= most:
                yield (part << 32) + seq, Block.joined(held)
                seq, held, size = seq + 1, [], 0
    if held:
        yield (part << 32) + seq, Block.joined(held)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once.  Sorting numbers takes a fraction of the time of the hash table of ``np.unique``."""
    found = np.sort(hashes)
    first = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return found[first]


def cuts(sorted_hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Bounds of each bucket's share of sorted hashes."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([r[0] for r in found], pa.int64()), "block": pa.array([r[1] for r in found], pa.int64()),
        "payload": pa.array([r[2] for r in found], pa.binary())})


def totals(docs: DataFrame, buckets: int, block: int) -> tuple[int, int, int]:
    """Training tokens, different training tokens, and all tokens of (doc_id, text, held)."""
    def send(batches):
        for number, b in blocks(batches, block):
            trained = b.trained()
            known = distinct(b.words[trained])
            at = cuts(known, buckets)
            size = dump([np.array([trained.sum(), len(trained)], "<i8")])
            yield rows([(k, -1, dump([gaps(known[at[k]:at[k + 1]])])) for k in range(buckets) if at[k] < at[k + 1]] + [(-1 - number % buckets, -1, size)])

    def add(table: pa.Table) -> pa.Table:
        got = [undump(x.as_py())[0] for x in table.column("payload")]
        if table.column("bucket")[0].as_py() < 0:
            n, m = np.sum(got, axis=0).tolist()
            return pa.table({"n": [n], "v": [0], "m": [m]})
        return pa.table({"n": [0], "v": [len(distinct(np.concatenate([np.cumsum(x, dtype=U) for x in got])))], "m": [0]})

    found = (docs.mapInArrow(send, REQUEST).groupBy("bucket").applyInArrow(add, "n long, v long, m long")
             .agg(F.sum("n"), F.sum("v"), F.sum("m")).first())
    return tuple(x or 0 for x in found)


def score(docs: DataFrame, order: int = 2, growth: float = 0.95, held: Column | None = None,
          block: int = BLOCK, share: int = SHARE, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of
    (doc_id, text), learning from the rows that aren't held out.

    A null or empty text is its end alone.  Repeated rows count and are scored each.  Without any
    training row all probabilities are the root's for an unseen token.  An empty table gives no rows.
    Other columns are ignored.  ``docs`` is read more than once and has to give its rows in the same
    partitions and order, as a table does (see ``session.cut``); else this raises an error."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, v, every = totals(docs, buckets, block)
    buckets = max(buckets, -(-every // share))

    def send(batches):
        for number, b in blocks(batches, block):
            trained, out = b.trained(), [[] for _ in range(buckets)]
            for k, (h, there) in enumerate(b.grams(order)):
                known, seen = distinct(h[there]), np.sort(h[there & trained])
                count = np.searchsorted(seen, known, "right") - np.searchsorted(seen, known)
                if k == 0:  # the begin of texts is a history too
                    i = int(np.searchsorted(known, BEGIN))
                    known, count = np.insert(known, i, BEGIN), np.insert(count, i, int((~b.held).sum()))
                at = cuts(known, buckets, 56 if k else 64)
                for x in range(buckets):
                    out[x] += [gaps(known[at[x]:at[x + 1]]), count[at[x]:at[x + 1]].astype("<u4")]
            yield rows([(x, number, dump(a)) for x, a in enumerate(out) if any(len(y) for y in a)])

    def answer(table: pa.Table) -> pa.Table:
        numbers, asked = table.column("block").to_pylist(), [undump(x.as_py()) for x in table.column("payload")]
        replies: list[list[np.ndarray]] = [[] for _ in asked]
        for k in range(order):
            keys = [np.cumsum(a[2 * k], dtype=U) for a in asked]
            _, local = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(local, weights=np.concatenate([a[2 * k + 1] for a in asked]))
            total = total.astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")
            at = 0
            for reply, x in zip(replies, keys):
                reply.append(total[local[at:at + len(x)]])
                at += len(x)
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches([rows([(bucket, i, dump(r)) for i, r in zip(numbers, replies)])])

    def bring(batches):
        for number, b in blocks(batches, block):
            yield rows([(-1, number, b.save())])

    def traverse(answers: pa.Table, brought: pa.Table) -> pa.Table:
        if answers.num_rows == 0 or brought.num_rows != 1:
            raise ValueError("the documents have not come in the same order again")
        b = Block.load(brought.column("payload")[0].as_py())
        place = np.argsort(answers.column("bucket").to_numpy())
        replies = [undump(answers.column("payload")[i].as_py()) for i in place.tolist()]
        counts = [np.concatenate([r[k] for r in replies]) for k in range(order)]
        base, score, n_known = walk(b, counts, n, v, growth, piece)
        return pa.table({
            "doc_id": b.doc_ids, "held_out": pa.array(b.held), "n_tokens": pa.array(np.diff(b.bounds), pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(b.held), n), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    replies = docs.mapInArrow(send, REQUEST).groupBy("bucket").applyInArrow(answer, REQUEST)
    return (replies.groupBy("block").cogroup(docs.mapInArrow(bring, REQUEST).groupBy("block"))
            .applyInArrow(traverse, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                    "train_tokens bigint, base_score double, score double"))


class Automaton:
    """The part of the automaton that a block can reach.  State 0 is the root, state 1 the begin of a
    text; ``arcs`` are sorted numbers state * words + word, with their ``weights`` and ``targets``."""

    def __init__(self, b: Block, counts: list[np.ndarray], n: int, v: int, growth: float):
        self.words = max(1, len(counts[0]) - 1)
        arcs, weights, targets, fails, below = [], [], [], [np.zeros(1)], [np.zeros(1, np.int32)]
        first, states, order = b.bounds[:-1], 2, len(counts)
        state = p = last = None
        for k, (h, there) in enumerate(b.grams(order)):
            where = np.flatnonzero(there).astype(np.int32)
            known, local = np.unique(h[there], return_inverse=True)
            local, begin, known = local.astype(np.int32), int(np.searchsorted(known, BEGIN)), len(known)
            at = np.zeros(known, np.int32)  # a place of each
            at[local] = where
            count = counts[k].astype(float)
            if k == 0:
                begins, count = count[begin], np.delete(count, begin)
                self.word = local
                self.base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                self.known = count > 0
            if len(count) != known:
                raise ValueError("the documents have not come in the same order again")
            here = np.zeros(len(h))
            here[where] = count[local]
            if k == 0:
                p = (here + 0.5) / (n + 0.5 * (v + 1))
                fails.append(self._failure(np.array([begins]), growth))
                below.append(np.zeros(1, np.int32))
            else:
                last[1:] = last[:-1]  # now the counts of histories
                if k == 1:
                    last[first] = begins
                else:
                    last[0] = 0
                    last[~there] = 0
                new = last ** growth
                new[last == 0] = 1
                last += new
                new *= p
                new += here
                new /= last
                p = new
            on = np.flatnonzero(count > 0)
            before = state
            if k + 1 < order:  # what has been counted is a history too
                number = np.zeros(known, np.int32)
                number[on] = states + np.arange(len(on))
                states += len(on)
                state = np.zeros(len(h), np.int32)
                state[where] = number[local]
                fails.append(self._failure(count[on], growth))
                below.append(np.zeros(len(on), np.int32) if before is None else before[at[on]])
            # a word that is unknown has an arc at the root all the same
            some = at if k == 0 else at[on]
            if k == 0:
                origin = np.zeros(len(some), np.int64)
            else:
                origin = np.where(some > 0, before[some - 1], 0).astype(np.int64)
            if k == 1:
                origin[np.isin(some, first)] = 1
            arcs.append(origin * self.words + self.word[some])
            weights.append(np.log10(p[some]))
            targets.append(np.zeros(len(some), np.int32) if state is None else state[some])
            last = here
            del local, where, at, h, there
        self.arcs = np.concatenate(arcs)
        by = np.argsort(self.arcs).astype(np.int32)
        self.arcs = self.arcs[by]
        self.weights, self.targets = np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.fails, self.below = np.concatenate(fails), np.concatenate(below)

    @staticmethod
    def _failure(count: np.ndarray, growth: float) -> np.ndarray:
        """Logarithms of the failure weights of histories of these counts."""
        new = np.where(count > 0, count ** growth, 1.0)
        return np.log10(new / (count + new))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and the log-probabilities on the way: failure arcs until a state has
        an arc for the word."""
        gain, after = np.zeros(len(state)), np.zeros(len(state), np.int32)
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            there = todo[hit]
            gain[there] += self.weights[at[hit]]
            after[there] = self.targets[at[hit]]
            todo = todo[~hit]
            gain[todo] += self.fails[state[todo]]
            state[todo] = self.below[state[todo]]
        return after, gain


def walk(b: Block, counts: list[np.ndarray], n: int, v: int, growth: float, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base score, score and known tokens of each document of a block.

    Documents are cut into pieces that are traversed from left to right, all at once; a state does not
    reach back over more than order - 1 tokens, so a piece starts with those before it, unscored."""
    if not len(b.held):
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
    machine, back = Automaton(b, counts, n, v, growth), len(counts) - 1
    pieces = -(-np.diff(b.bounds) // piece)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    own = b.bounds[doc] + piece * tokens.spread(pieces)
    end = np.minimum(own + piece, b.bounds[doc + 1])
    at = np.maximum(own - back, b.bounds[doc])
    long_first = np.argsort(at - end, kind="stable")
    doc, own, end, at = (x[long_first] for x in (doc, own, end, at))
    state = ((at == b.bounds[doc]) & (back > 0)).astype(np.int32)
    total, length = np.zeros(len(doc)), end - at
    for k in range(int(length.max())):
        some = int(np.searchsorted(-length, -k))  # the pieces that are longer than k
        i = at[:some] + k
        state[:some], gain = machine.step(state[:some], machine.word[i])
        total[:some] += np.where(i >= own[:some], gain, 0)
    score = np.bincount(doc, weights=total, minlength=len(pieces))
    add = lambda x: np.add.reduceat(x, b.bounds[:-1])
    return add(machine.base[machine.word]), score, add(machine.known[machine.word].astype(np.int64))
