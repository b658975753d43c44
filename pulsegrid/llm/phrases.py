"""Phrases that occur more often than their parts let expect, by weighted acyclic automata.

A count transducer is an acyclic automaton over paths (language, word, word, ...) whose arcs weigh
how often the path up to them occurs; states with equal arcs are one state.  Tasks sort the n-grams
of a block of documents and build its transducer.  Paths are dealt by ranges of the hash of their
prefix of two words, so that neither a frequent language nor a frequent first word lands in one
place, and a range's transducers are united, weights added, a few at a time.  What a phrase's parts
count is found by composing the transducer of a range with the acceptor of the parts asked of it.

With more ranges than ``FAN`` a block's paths go to as many coarse ones, so that messages stay large
and their number in proportion to the corpus; a coarse range's task deals them on to its finer ranges
by itself, out of memory, and unites those one by one.  Beyond ``WITHIN`` finer ranges in a coarse one
there are several exchanges, of which the first has ``FAN`` ranges already.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm import tokens
from pulsegrid.llm.scoring import dump, gaps, undump
from pulsegrid.llm.tokens import LOWER, U, chain, mix
from pulsegrid.session import cut

#: Words of a block, and of a range's share of all words; paths united at once; ranges dealt to in one step,
#: and by a task to itself; bytes of messages that such a task keeps in memory.
BLOCK, SHARE, AT_ONCE, FAN, WITHIN, KEPT = 1_000_000, 1_000_000, 1_500_000, 512, 64, 32 << 20
BETWEEN = np.zeros(256, bool)  # between words
BETWEEN[[9, 32]] = True
BREAK = np.zeros(256, bool)  # between pieces
BREAK[[*b".,;:!?", *range(10, 14)]] = True
NO_LANGUAGE = "und"


def first_of(values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted arrays begin."""
    new = np.ones(len(values), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (values, *more)])
    return np.flatnonzero(new)


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at) if len(at) else values[:0]


class Transducer:
    """Weights of paths of symbols.  Level d holds the arcs that read the symbol d of a path: states
    are runs of arcs, ``begin`` has their bounds, and an arc's ``target`` is a state of the next
    level, or -1 where no path goes on.  The root is the only state of level 0."""

    def __init__(self, symbols: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.symbols, self.levels = symbols, levels

    @classmethod
    def of(cls, symbols: np.ndarray, paths: list[np.ndarray], weights: list[np.ndarray]) -> Transducer:
        """From paths by length 1, 2, ... as rows of places in the sorted ``symbols``; equal paths add up."""
        wide = np.int64(max(len(symbols), 1))
        rank = [np.zeros(len(p), np.int64) for p in paths]
        found = []
        for d in range(len(paths)):
            keys = [rank[m] * wide + paths[m][:, d] for m in range(d, len(paths))]
            known, local = np.unique(np.concatenate(keys), return_inverse=True)
            cut_at = np.cumsum([0] + [len(k) for k in keys])
            for m in range(d, len(paths)):
                rank[m] = local[cut_at[m - d]:cut_at[m - d + 1]]
            weight = np.zeros(len(known), np.int64)
            np.add.at(weight, rank[d], weights[d])
            found.append((known // wide, (known % wide).astype(np.int32), weight))
        return cls(symbols, cls._shared(symbols, found))

    @staticmethod
    def _shared(symbols, found):
        """States with equal arcs become one, from the last level up."""
        levels, target = [], None
        for d in reversed(range(len(found))):
            parent, label, weight = found[d]
            target = np.full(len(parent), -1, np.int64) if target is None else target
            at = first_of(parent)
            size = np.diff(np.append(at, len(parent)))
            place = tokens.spread(size).astype(U)
            arc = chain(chain(chain(mix(place), symbols[label]), weight.astype(U)), target.astype(U))
            sign = [summed(mix(arc ^ U(odd)), at) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            order = np.lexsort((sign[1], sign[0], size))
            one = first_of(*(x[order] for x in (size, *sign)))
            kind = np.zeros(len(at), np.int64)
            kind[order] = np.repeat(np.arange(len(one)), np.diff(np.append(one, len(order))))
            chosen = order[one]  # a state of each kind
            arcs = np.repeat(at[chosen], size[chosen]) + tokens.spread(size[chosen])
            begin = np.concatenate([[0], np.cumsum(size[chosen])])
            levels.append((begin, label[arcs], weight[arcs], target[arcs]))
            if d:
                target = np.full(len(found[d - 1][0]), -1, np.int64)
                target[parent[at]] = kind
        return levels[::-1]

    def paths(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All paths that weigh anything, by length, in order, and their weights."""
        paths, weights = [], []
        state, before = np.zeros(1, np.int64), np.zeros((1, 0), np.int32)
        for begin, label, weight, target in self.levels:
            if len(begin) == 1:
                state, before = state[:0], before[:0]
            size = np.diff(begin)[state] if len(state) else state
            arc = np.repeat(begin[state], size) + tokens.spread(size) if len(state) else state
            path = np.column_stack([np.repeat(before, size, axis=0), label[arc]])
            there = weight[arc] > 0
            paths.append(path[there])
            weights.append(weight[arc][there])
            on = target[arc] >= 0
            state, before = target[arc][on], path[on]
        return paths, weights

    def compose(self, asked: Transducer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length the paths, as symbols, that both weigh, with the weights here: pairs of states are
        followed together from the roots."""
        wide = np.int64(max(len(self.symbols), 1))
        place = np.searchsorted(self.symbols, asked.symbols)
        known = np.append(self.symbols, U(0))[place] == asked.symbols
        known[place == len(self.symbols)] = False
        mine, its = np.zeros(1, np.int64), np.zeros(1, np.int64)
        before = np.zeros((1, 0), U)
        for (begin, label, weight, target), (its_begin, its_label, its_weight, its_target) in zip(self.levels, asked.levels):
            if len(begin) == 1 or len(its_begin) == 1:
                return
            size = np.diff(its_begin)[its]
            arc = np.repeat(its_begin[its], size) + tokens.spread(size)
            state, path = np.repeat(mine, size), np.repeat(before, size, axis=0)
            key = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * wide + label  # ascending
            want = state * wide + place[its_label[arc]]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            met = known[its_label[arc]] & (key[at] == want)
            arc, at = arc[met], at[met]
            path = np.column_stack([path[met], asked.symbols[its_label[arc]]])
            both = (its_weight[arc] > 0) & (weight[at] > 0)
            yield path[both], weight[at][both]
            on = (its_target[arc] >= 0) & (target[at] >= 0)
            mine, its, before = target[at][on], its_target[arc][on], path[on]

    @classmethod
    def union(cls, some: list[Transducer]) -> Transducer:
        """One transducer with all paths, weights added."""
        if len(some) == 1:
            return some[0]
        return cls.of(*joined([(t.symbols, *t.paths()) for t in some]))

    def size(self) -> int:
        return sum(len(label) for _, label, _, _ in self.levels)

    def arrays(self) -> list[np.ndarray]:
        out = [gaps(self.symbols)]
        for begin, label, weight, target in self.levels:
            narrow = "<u4" if weight.max(initial=0) < 1 << 32 else "<u8"
            out += [np.diff(begin).astype("<u4"), label.astype("<u4"), weight.astype(narrow), (target + 1).astype("<u4")]
        return out

    @classmethod
    def load(cls, arrays: list[np.ndarray]) -> Transducer:
        levels = []
        for k in range(1, len(arrays), 4):
            size, label, weight, target = arrays[k:k + 4]
            levels.append((np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), label.astype(np.int32),
                           weight.astype(np.int64), target.astype(np.int64) - 1))
        return cls(np.cumsum(arrays[0], dtype=U), levels)


def joined(some: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Symbols, and paths and weights by length, of all of some one after the other."""
    symbols = np.unique(np.concatenate([x for x, _, _ in some]))
    at = [np.searchsorted(symbols, x).astype(np.int32) for x, _, _ in some]
    paths = [np.concatenate(x) for x in zip(*[[place[p] for p in paths] for place, (_, paths, _) in zip(at, some)])]
    return symbols, paths, [np.concatenate(x) for x in zip(*[w for _, _, w in some])]


def by_range(paths: list[np.ndarray], symbols: np.ndarray, ranges: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The ranges that have any of the paths, and which, by length."""
    where = route(paths, symbols, ranges)
    order = [np.argsort(w, kind="stable") for w in where]
    bounds = [np.searchsorted(w[o], np.arange(ranges + 1)) for w, o in zip(where, order)]
    for k in np.flatnonzero(sum(np.diff(b) for b in bounds)).tolist():
        yield k, [o[b[k]:b[k + 1]] for o, b in zip(order, bounds)]


def route(paths: list[np.ndarray], symbols: np.ndarray, ranges: int) -> list[np.ndarray]:
    """The range of each path: of the hash of its language and first two words, or of what it has of them."""
    out = []
    for p in paths:
        h = reduce(chain, [symbols[p[:, d]] for d in range(min(3, p.shape[1]))], np.full(len(p), U(1)))
        out.append(((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64))
    return out


def dealt(t: Transducer, names: dict, ranges: int) -> Iterator[tuple[int, bytes]]:
    """A transducer cut into those of ranges, each with the names of the languages and words counted in it."""
    paths, weights = t.paths()
    for k, some in by_range(paths, t.symbols, ranges):
        rows = [p[s] for p, s in zip(paths, some)]
        used = np.unique(np.concatenate([r.reshape(-1) for r in rows]))
        part = Transducer.of(t.symbols[used], [np.searchsorted(used, r).astype(np.int32) for r in rows],
                             [w[s] for w, s in zip(weights, some)])
        named = np.unique(t.symbols[np.concatenate([r[:, -1] for r in rows[:2]])])
        spelled = [names[x] for x in named.tolist()]
        yield k, dump([*part.arrays(), named, np.array([len(x) for x in spelled], "<u4"),
                       np.frombuffer(b"".join(spelled), np.uint8)])


def undealt(payload: bytes) -> tuple[Transducer, dict]:
    arrays = undump(payload)
    named, lengths, raw = arrays[-3:]
    ends, raw = np.cumsum(lengths, dtype=np.int64), raw.tobytes()
    return Transducer.load(arrays[:-3]), {h: raw[e - n:e] for h, n, e in zip(named.tolist(), lengths.tolist(), ends.tolist())}


class Words:
    """The words of a column of texts with their hashes, and how many words each piece has from each on."""

    def __init__(self, langs, texts):
        data, bounds = tokens.flat(texts)
        self.data = LOWER[data]
        gap = BREAK[self.data]
        starts, ends = tokens.runs(~(gap | BETWEEN[self.data]), bounds)
        self.starts, self.ends, self.hash = starts, ends, tokens.hashes(self.data, starts, ends)
        piece = np.cumsum(gap)[starts] if len(starts) else starts
        doc = np.searchsorted(bounds, starts, "right") - 1
        at = first_of(piece, doc) if len(starts) else starts
        size = np.diff(np.append(at, len(starts)))
        self.left = np.repeat(size, size) - tokens.spread(size)
        names, self.names = langs.dictionary_encode(), {}
        spelled = [x.encode() for x in names.dictionary.to_pylist()]
        codes = np.array([hash_of(x) for x in spelled], U)
        self.lang = codes[names.indices.to_numpy()][doc] if len(spelled) else np.zeros(0, U)
        self.names = dict(zip(codes.tolist(), spelled))

    def spell(self, names: dict):
        """Add the words that ``names`` has not got."""
        known, at = np.unique(self.hash, return_index=True)
        raw = self.data.tobytes()
        for h, a, b in zip(known.tolist(), self.starts[at].tolist(), self.ends[at].tolist()):
            if h not in names:
                names[h] = raw[a:b]
        names.update(self.names)


def hash_of(name: bytes) -> int:
    data = np.frombuffer(name, np.uint8)
    return int(tokens.hashes(data, np.array([0]), np.array([len(data)]))[0])


def counted(lang: np.ndarray, word: np.ndarray, left: np.ndarray, most: int) -> Transducer:
    """The transducer of a block: languages, words and the n-grams of ``most`` words, each by its count."""
    symbols, local = np.unique(np.concatenate([lang, word]), return_inverse=True)
    wide, n = np.int64(max(len(symbols), 1)), len(word)
    lang, word = local[:n], local[n:]
    at, key, found, rank = np.arange(n), lang, [], None
    for d in range(most + 1):
        if d:
            on = left[at] >= d
            at, rank = at[on], rank[on]
            key = rank * wide + word[at + d - 1]
        known, rank, count = np.unique(key, return_inverse=True, return_counts=True)
        found.append(((known // wide if d else np.zeros(len(known), np.int64)), (known % wide).astype(np.int32), count))
    return Transducer(symbols, Transducer._shared(symbols, found))


def _blocks(most: int, ranges: int, block: int):
    """Messages (range, payload) of the transducers of blocks of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Words] = []
        names: dict = {}
        size = 0

        def send() -> pa.RecordBatch:
            t = counted(*(np.concatenate([getattr(w, k) for w in held]) for k in ("lang", "hash", "left")), most)
            held.clear()
            found = list(dealt(t, names, ranges))
            names.clear()
            return message(found)

        for batch in batches:
            for some in tokens.slices(batch, most=1 << 22):
                words = Words(some.column("lang"), some.column("text"))
                if not len(words.hash):
                    continue
                words.spell(names)
                words.data = None
                held.append(words)
                size += len(words.hash)
                if size >= block:
                    yield send()
                    size = 0
        if held:
            yield send()
    return run


def message(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"range": pa.array([k for k, _ in found], pa.int32()),
                                       "payload": pa.array([x for _, x in found], pa.binary())})


def _united(rows: Iterator[pa.RecordBatch], at_once: int, whole: bool) -> Iterator[tuple[int, Transducer, dict]]:
    """Transducers of ranges from messages in order of range: one for each, or if not ``whole`` also
    one whenever it holds ``at_once`` paths."""
    now, names, held, size = None, {}, [], 0
    for batch in rows:
        for k, payload in zip(batch.column("range").to_pylist(), batch.column("payload")):
            if k != now and held:
                yield now, Transducer.union(held), names
                names, held, size = {}, [], 0
            now = k
            t, known = undealt(payload.as_py())
            names.update(known)
            held.append(t)
            size += t.size()
            if size >= at_once and len(held) > 1:
                held = [Transducer.union(held)]
                size = held[0].size() // 2  # a large union is not done again for each small message
                if not whole and 2 * size >= at_once:
                    yield now, held[0], names
                    names, held, size = {}, [], 0
    if held:
        yield now, Transducer.union(held), names


def _finer(ranges: int, at_once: int):
    """Messages for finer ranges, from those for coarse ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, names in _united(batches, at_once, False):
            yield message(list(dealt(t, names, ranges)))
    return run


def _divided(rows: Iterator[pa.RecordBatch], ranges: int, at_once: int) -> Iterator[tuple[int, Transducer, dict]]:
    """Transducers of ranges from messages for coarse ones, in order of those.  All of a path comes to one
    coarse range, so that a range which two of them share may come in two pieces."""
    now, names, held, size, places = None, {}, [], 0, defaultdict(list)
    with tempfile.SpooledTemporaryFile(max_size=KEPT) as kept:
        def put(arrays: list[np.ndarray]) -> tuple[int, int]:
            kept.write(payload := dump(arrays))
            return kept.tell() - len(payload), len(payload)

        def get(place: tuple[int, int]) -> list[np.ndarray]:
            kept.seek(place[0])
            return undump(kept.read(place[1]))

        def deal():
            symbols, paths, weights = joined(held)
            held.clear()
            table = put([gaps(symbols)])
            for k, some in by_range(paths, symbols, ranges):
                places[k].append((table, put([x for p, w, s in zip(paths, weights, some) for x in (p[s].reshape(-1), w[s])])))

        def done() -> Iterator[tuple[int, Transducer, dict]]:
            if held and not places:  # not dealt if there is little
                yield now, Transducer.of(*joined(held)), names
            elif held:
                deal()
            held.clear()
            for k, some in places.items():
                found, n = [], 0
                for table, place in some:
                    arrays = get(place)
                    paths = [x.reshape(-1, d + 1) for d, x in enumerate(arrays[::2])]
                    used = np.unique(np.concatenate(arrays[::2]))
                    found.append((np.cumsum(get(table)[0], dtype=U)[used], [np.searchsorted(used, p) for p in paths], arrays[1::2]))
                    n += sum(map(len, paths))
                    if n >= at_once and len(found) > 1:
                        t = Transducer.of(*joined(found))
                        found, n = [(t.symbols, *t.paths())], t.size() // 2
                yield k, Transducer.of(*joined(found)), names
            places.clear()
            kept.seek(0)
            kept.truncate()

        for batch in rows:
            for k, payload in zip(batch.column("range").to_pylist(), batch.column("payload")):
                if k != now:
                    yield from done()
                    now, names, size = k, {}, 0
                t, known = undealt(payload.as_py())
                names.update(known)
                held.append((t.symbols, *t.paths()))
                size += t.size()
                if size >= at_once:
                    deal()
                    size = 0
        yield from done()


def _counts(least: int, at_once: int, ranges: int | None = None):
    """path, f and name: the counts of a range that are at least ``least``, and those of whole languages.
    ``ranges`` are those that the messages' own are divided into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, names in _divided(batches, ranges, at_once) if ranges else _united(batches, at_once, True):
            paths, weights = t.paths()
            for d, (p, w) in enumerate(zip(paths, weights)):
                on = np.flatnonzero((w >= least) | (d == 0))
                for at in range(0, len(on), 200_000):
                    some = on[at:at + 200_000]
                    symbols = t.symbols[p[some]]
                    spelled = [names[x] for x in symbols[:, -1].tolist()] if d < 2 else [None] * len(some)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (d + 1), pa.int32()),
                                                    pa.array(symbols.view(np.int64).reshape(-1)))
                    yield pa.RecordBatch.from_pydict({"path": flat, "f": pa.array(w[some], pa.int64()),
                                                      "name": pa.array(spelled, pa.binary()).cast(pa.string())})
    return run


def steps_to(ranges: int, fan: int, within: int) -> list[int]:
    """Ranges of the exchanges on the way to so many; the last may leave up to ``within`` in one of its own."""
    last = max(min(ranges, fan), -(-ranges // within))
    steps, n = [], max(fan, 2)
    while n < last:
        steps.append(n)
        n *= max(fan, 2)
    return [*steps, last]


def counts(docs: DataFrame, most: int = 3, least: int = 10, block: int = BLOCK, share: int = SHARE,
           at_once: int = AT_ONCE, fan: int = FAN, within: int = WITHIN) -> DataFrame:
    """path (hashes of the language and of up to ``most`` words), f and name (of the path's last symbol,
    for paths of at most one word) of all that occurs ``least`` times, and of each language."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffles, -(-size // (6 * share)))  # words have some six bytes
    steps = steps_to(ranges, fan, within)
    frame = docs.select("lang", "text").mapInArrow(_blocks(most, steps[0], block), "range int, payload binary")
    for n, finer in zip(steps, steps[1:]):
        frame = frame.repartition(n, "range").sortWithinPartitions("range").mapInArrow(
            _finer(finer, at_once), "range int, payload binary")
    return (frame.repartition(steps[-1], "range").sortWithinPartitions("range")
            .mapInArrow(_counts(least, at_once, ranges if steps[-1] < ranges else None), "path array<long>, f long, name string"))


def parts(known: DataFrame, asked: DataFrame, most: int, ranges: int) -> DataFrame:
    """path and f of the asked paths (rows: path, each once) as known (path, f): the acceptor of what a
    range is asked is composed with the range's transducer."""
    def key(path):
        return F.pmod(F.xxhash64(F.slice(path, 1, 3)), F.lit(ranges)).cast("int")

    def load(table: pa.Table, weigh: bool) -> Transducer:
        path = table.column("path").combine_chunks()
        flat, length = path.flatten().to_numpy().view(U), path.value_lengths().to_numpy()
        weight = table.column("f").to_numpy() if weigh else np.ones(len(length), np.int64)
        symbols = np.unique(flat)
        place, begin = np.searchsorted(symbols, flat).astype(np.int32), np.cumsum(length) - length
        rows = [np.flatnonzero(length == d) for d in range(1, most + 2)]
        return Transducer.of(symbols, [place[begin[r][:, None] + np.arange(d)] for d, r in enumerate(rows, 1)],
                             [weight[r] for r in rows])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for path, weight in load(left, True).compose(load(right, False)):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * path.shape[1], pa.int32()),
                                                pa.array(np.ascontiguousarray(path).view(np.int64).reshape(-1)))
                out.append(pa.table({"path": flat, "f": pa.array(weight, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"path": pa.array([], pa.list_(pa.int64())), "f": pa.array([], pa.int64())})

    return (known.select("path", "f", key(F.col("path")).alias("range")).groupBy("range")
            .cogroup(asked.select("path", key(F.col("path")).alias("range")).groupBy("range"))
            .applyInArrow(look, "path array<long>, f long"))


def mine(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, covered: int = 50, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``most`` words.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at spaces and tabs
    into words.  n counts a language's words, f(phrase) its occurrences within pieces, overlaps included.
    Candidates have a = f(phrase) >= ``least``.  Cut after its first k words a candidate has l = f(first
    part), r = f(rest) and score floor(1000000 a a / (l r)); its lowest-scoring cut counts, of equal ones
    that of the smallest k.  Candidates inside a longer candidate of at least ``covered`` hundredths of
    their count go.  Order is by score and a descending, then phrase ascending by its bytes.

    A null lang is ``und``, a null text empty; empty texts and an empty table give no phrases.  Repeated
    rows count each.  Other columns are ignored.  Words and languages are known by 64-bit hashes; counts
    must fit a long, products are decimals of 38 digits."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text").where("text <> ''")
    known = cut(counts(docs, most, least, **sizes))
    langs = known.where(F.size("path") == 1).select(F.col("path")[0].alias("code"), F.col("name").alias("lang"), F.col("f").alias("n"))
    often = known.where(F.size("path") > 1).select("path", "f")
    long_ = often.where(F.size("path") > 2).select("path", F.col("f").alias("a"))
    head = F.slice("path", 1, 1)
    rest = lambda k: F.slice("path", k + F.lit(2), F.size("path") - 1 - k)
    cuts_ = long_.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("path") - 2))).select(
        "path", "a", "k", F.slice("path", F.lit(1), F.col("k") + 1).alias("first"), F.concat(head, rest(F.col("k"))).alias("rest"))
    asked = cuts_.select(F.explode(F.array("first", "rest")).alias("path")).distinct()
    n_often = often.count()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(parts(often, asked, most, max(shuffles, -(-n_often // 500_000))))
    score = F.expr("cast(a as decimal(38,0)) * a * 1000000 div (cast(l as decimal(38,0)) * r)")
    lowest = (cuts_.join(found.select(F.col("path").alias("first"), F.col("f").alias("l")), "first")
              .join(found.select(F.col("path").alias("rest"), F.col("f").alias("r")), "rest")
              .groupBy("path", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("path", "a", "c.*"))
    # contiguous parts of two words or more of longer candidates
    spans = F.expr("""flatten(transform(sequence(2, size(path) - 2), m -> transform(sequence(0, size(path) - 1 - m),
                      i -> concat(slice(path, 1, 1), slice(path, i + 2, m)))))""")
    longer = (long_.where(F.size("path") > 3).select(F.explode(spans).alias("path"), "a")
              .groupBy("path").agg(F.max("a").alias("longer")))
    alone = (lowest.join(longer, "path", "left").where(f"longer is null or 100 * longer < {covered} * a")
             .select(F.col("path")[0].alias("code"), "path", "a", "l", "r", "score"))
    # first without spelling them: those that tie with the last place stay until the phrases are known
    place = Window.partitionBy("code")
    best = cut(alone.withColumn("place", F.rank().over(place.orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top))
    spelled = known.where(F.size("path") == 2).select(F.col("path")[0].alias("code"), F.col("path")[1].alias("word"), "name")
    phrases = (best.select("code", "path", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("at", "word"))
               .join(spelled, ["code", "word"]).groupBy("path")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("phrase")))
    order = place.orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.join(phrases, "path").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(langs, "code").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
