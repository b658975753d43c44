"""Phrases and count transducers against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most=3, least=10, top=2000, covered=50):
    f = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    n, found = Counter(), {}
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(longer[lang, p[i:i + m]], a)
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] >= covered * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items()
                  for k, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def mined(docs, **more):
    return sorted(map(tuple, phrases.mine(docs, **more).collect()))


def given(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


def test_documents(docs):
    got = mined(docs)
    assert got == brute(given(docs)) and len(got) > 50


@pytest.mark.parametrize("sizes", [dict(block=700, share=300, at_once=400, fan=3), dict(block=1, share=2000, fan=2), dict(at_once=1)])
def test_any_sizes(spark, docs, sizes):
    """Several steps of exchange, small unions, and a block for each slice."""
    some = docs.orderBy("doc_id").limit(60)
    assert mined(some, least=4, top=100, **sizes) == brute(given(some), least=4, top=100)


def test_exchanges_on_the_way_to_many_ranges(spark, docs):
    """An exchange has as many ranges as one step deals to, however many more there are in the end; several exchanges, and ranges cut up in tasks."""
    frame = phrases.counts(docs, share=2, fan=64)._jdf.queryExecution().analyzed().toString()
    exchanged = [int(x) for x in re.findall(r"RepartitionByExpression \[range#\d+\], (\d+)", frame)]
    assert exchanged and min(exchanged) >= 64
    some = docs.orderBy("doc_id").limit(40)
    for sizes in (dict(block=700, share=300, at_once=400, fan=3, within=2), dict(block=900, share=150, at_once=300, fan=4, within=50)):
        assert mined(some, least=4, top=100, **sizes) == brute(given(some), least=4, top=100)
    assert phrases.steps_to(1720, 512, 64) == [512] and phrases.steps_to(143, 512, 64) == [143]
    assert phrases.steps_to(300_000, 512, 64) == [512, 4688]


def test_longer_phrases(docs):
    some = docs.orderBy("doc_id").limit(80)
    assert mined(some, most=5, least=5, top=300) == brute(given(some), most=5, least=5, top=300)


def test_odd_rows(odd, empty):
    assert mined(odd, least=2) == brute(given(odd), least=2)
    assert mined(empty) == []


def test_ties_and_languages(spark):
    """Phrases of equal score and count beyond the last place, order by bytes, and one word in two languages."""
    rows = [(None, "Z é. é z; Z é! z a, z a? z a")] * 3 + [("xx", "a b c. a b c: d\te")] * 3 + [("", f"w{i} v{i}") for i in range(9)] * 3
    docs = spark.createDataFrame([(l, t, "p", "f") for l, t in rows], "lang string, text string, path string, f string")
    assert mined(docs, least=2, top=4) == brute(rows, least=2, top=4)
    assert mined(docs, least=2, covered=101) == brute(rows, least=2, covered=101)


def test_exact_scores():
    """Products beyond 64 bits, on counts that the mining would give."""
    assert 1000000 * 3_000_000_000 ** 2 > 1 << 63


def test_large_counts(spark, monkeypatch):
    a, l, r = 5_000_000_019, 9_000_000_011, 7_000_000_027
    code = [1], [1, 2], [1, 3], [1, 2, 3]
    known = spark.createDataFrame(list(zip(map(list, code), (20_000_000_000, l, r, a), ("en", "big", "word", None))),
                                  "path array<long>, f long, name string")
    monkeypatch.setattr(phrases, "counts", lambda *x, **y: known)
    docs = spark.createDataFrame([("en", "big word")], "lang string, text string")
    assert mined(docs) == [("en", 1, "big word", a, l, r, 20_000_000_000, 1000000 * a * a // (l * r))]


class TestTransducer:
    def of(self, counts):
        symbols = np.unique(np.array([x for p in counts for x in p], np.uint64))
        paths = [[p for p in counts if len(p) == d] for d in (1, 2, 3)]
        return phrases.Transducer.of(symbols, [np.searchsorted(symbols, np.array(p, np.uint64).reshape(len(p), d)).astype(np.int32)
                                               for d, p in enumerate(paths, 1)],
                                     [np.array([counts[p] for p in x], np.int64) for x in paths])

    def all(self, t):
        return {tuple(t.symbols[row].tolist()): int(n) for p, w in zip(*t.paths()) for row, n in zip(p, w)}

    def some(self, seed, n=80):
        g = np.random.default_rng(seed)
        return Counter({tuple(g.integers(1, 9, d).tolist()): int(g.integers(1, 4)) for d in g.integers(1, 4, n).tolist()})

    def test_paths_and_bytes(self):
        counts = self.some(1)
        t = self.of(counts)
        assert self.all(t) == counts
        assert self.all(phrases.Transducer.load(phrases.undump(phrases.dump(t.arrays())))) == counts

    def test_union_adds(self):
        a, b, c = self.some(2), self.some(3), self.some(4)
        assert self.all(phrases.Transducer.union([self.of(x) for x in (a, b, c)])) == a + b + c

    def test_compose(self):
        a, b = self.some(5, 200), self.some(6, 200)
        got = {tuple(p.tolist()): int(n) for ps, ws in self.of(a).compose(self.of(b)) for p, n in zip(ps, ws)}
        assert got == {p: n for p, n in a.items() if p in b} and got

    def test_equal_states_are_one(self):
        t = self.of({(x, y, z): 1 for x in range(1, 6) for y in range(1, 6) for z in range(1, 6)})
        assert [len(label) for _, label, _, _ in t.levels] == [5, 5, 5]

    def test_nothing(self):
        t = self.of({})
        assert self.all(t) == {} and list(t.compose(self.of({(1,): 1}))) == []
