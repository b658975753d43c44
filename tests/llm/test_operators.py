"""Operators against brute force on small fixtures, and on odd and empty tables."""

import collections
import itertools
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid import scale
from pulsegrid.llm import decontam, jaccard, packing, pii, quality, queries, scoring, shards, tokens, toxicity, urls, wavelet

WORDS_FILE, BYTES_FILE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("byte_bpe_50k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1
def brute_scores(table, words, order, growth):
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, words(t) + ["</s>"]) for i, t in table]
    c = collections.Counter()
    for _, held, w in texts:
        s = ["<s>", *w]
        if not held:
            for k in range(1, order + 1):
                c.update(tuple(s[p:p + k]) for p in range(len(s) - k + 1))
    n = sum(len(w) for _, held, w in texts if not held)
    v = len({x for _, held, w in texts if not held for x in w})
    out = []
    for i, held, w in texts:
        s, base, total = ["<s>", *w], 0.0, 0.0
        for p in range(1, len(s)):
            x = (c[(s[p],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(x)
            for k in range(2, order + 1):
                h = c[tuple(s[p - k + 1:p])] if p - k + 1 >= 0 else 0
                if h:
                    x = (c[tuple(s[p - k + 1:p + 1])] + h ** growth * x) / (h + h ** growth)
            total += math.log10(x)
        out.append((i, held, len(w), sum(c[(x,)] > 0 for x in w), n, round(base, 6), round(total, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order,block,piece", [(2, 3_000_000, 128), (3, 2000, 128), (4, 2000, 5), (1, 500, 3)])
def test_scores(docs, odd, empty, words, order, block, piece):
    for df in (docs, odd, empty):
        table = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows(scoring.score(df, order, block=block, piece=piece))), key=repr)
        want = brute_scores(table, words, order, 0.95)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert not want or np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-5)


def test_words_of_any_length():
    """Long words are hashed in pieces, to what they hash to by their bytes alone."""
    long_ = "x" * 400_000 + "é" * 50_000
    texts = pa.array([f"a {long_} b", long_, long_ + "y", "y" + long_, "x" * tokens.HASHED, "x" * (tokens.HASHED - 1), None])
    h, bounds = tokens.words(texts)
    assert np.diff(bounds).tolist() == [3, 1, 1, 1, 1, 1, 0]
    assert h[1] == h[3] and len(set(h.tolist())) == len(h) - 1
    raw = long_.encode()
    place = tokens.mix(np.array([len(raw)], np.uint64))
    for base, odd in zip(tokens.BASES, (1, 0x8EBC6AF09C88C6E3)):
        value = sum((x + 1) * pow(base, k, 1 << 64) for k, x in enumerate(raw)) % (1 << 64)
        place = tokens.mix(place + np.array([value], np.uint64) * np.uint64(odd))
    assert place[0] == h[1]
    assert sum(a.nbytes for pair in tokens.powers() for a in pair) < 5 << 20


def test_distinct_hashes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        h = rng.integers(0, 1 << 64, n, np.uint64) >> np.uint64(52)
        kept = h.copy()
        assert np.array_equal(scoring.distinct(h), sorted(set(h.tolist()))) and scoring.distinct(h).dtype == np.uint64
        assert np.array_equal(h, kept)


def test_the_registered_automaton_has_order_3(spark, docs, words):
    table = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.score) for r in queries.QUERIES["op1_backoff_scores"](spark, "/root/testdata/sf0.001").collect())
    want = [(w[0], w[6]) for w in sorted(brute_scores(table, words, 3, 0.95))]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-5)


# 2
def test_decontamination_tolerates_two_changes(spark, odd, empty):
    item = [f"w{i}" for i in range(20)]

    def doc(*changed):
        return "some text before " + " ".join(f"other{i}" if i in changed else w for i, w in enumerate(item)) + " and after"
    texts = [doc(), doc(6, 9), doc(3, 7, 11, 15), " ".join(item[4:17]).upper(), " ".join(item[4:14]), "none of it", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "five plain words stand here"), (3, "too short"), (4, None)],
                                  "item_id long, text string")
    # window 13 with at most two changes: of doc 2 no window has fewer than three
    assert sorted(rows(decontam.contaminated(docs, bench).select("doc_id", "item_id"))) == [(0, 1), (1, 1), (3, 1)]
    short = spark.createDataFrame([(9, "so five plain words, stand here!"), (8, "five plain word stand here"), (7, "five plain more stand there")],
                                  "doc_id long, text string")
    assert sorted(rows(decontam.contaminated(short, bench))) == [(8, 2, 5, 4), (9, 2, 5, 5)]
    assert decontam.keep(docs, bench).count() == 5
    assert decontam.keep(odd, bench).count() == odd.count() and decontam.contaminated(empty, bench).count() == 0
    assert decontam.keep(docs, bench.limit(0)).count() == 8


def test_short_items(spark):
    """Items of 5 to 12 words with as many words changed as may be, anywhere, against brute force."""
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(4, 14)]
    docs = []
    for item in items:
        for changed in itertools.chain.from_iterable(itertools.combinations(range(len(item)), c) for c in range(4)):
            docs.append("a b " + " ".join("x" if k in changed else w for k, w in enumerate(item)) + " c")
    docs = docs[::3]
    want = sorted((i, n) for i, d in enumerate(docs) for n, item in enumerate(items, 4)
                  if n >= 5 and 100 * sum(w in d.split() for w in item) >= 80 * n)
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                                spark.createDataFrame([(len(x), " ".join(x)) for x in items], "item_id long, text string"))
    assert sorted(rows(got.select("doc_id", "item_id"))) == want
    with pytest.raises(ValueError):
        decontam.overlaps(got, got, shortest=2)


def test_every_two_changes_leave_a_seed():
    fits = [[{o + m for m in mask} for o in range(13 - mask[-1])] for mask in decontam.MASKS]
    assert all(any(not ({a, b} & s) for f in fits for s in f) for a in range(13) for b in range(a))


# 3
def test_shards(docs, odd, empty):
    for df in (docs, odd):
        got = shards.shard(df, 24).collect()
        assert len(got) == df.count()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(24))
        want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=repr)
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert shards.shard(empty).count() == 0


def test_a_hot_group_is_split(spark):
    df = spark.createDataFrame([(i, "copy" * 50 if i % 3 == 0 else f"text {i} " * 20) for i in range(6000)], "doc_id long, text string")
    sizes = [r["sum(size)"] for r in shards.shard(df, 24).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.03 * min(sizes)


def test_copies_that_fit_stay_together(spark):
    texts = [f"text {i} " * 20 for i in range(3000)] + [f"pair {i // 2} " * 20 for i in range(1000)]
    texts += [f"copy {i % 20} " * 20 for i in range(1200)] + [f"long {i} " * 200 for i in range(40)] + [""] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shards.shard(df, 24).toPandas()
    where = collections.defaultdict(set)
    for i, k in zip(got.doc_id, got.shard):
        where[texts[i]].add(k)
    assert all(len(x) == 1 for x in where.values())
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.03 * sizes.min()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)


# 4
def test_packing(docs, odd, empty):
    for df in (docs, odd):
        got = packing.pack(df, WORDS_FILE).collect()
        code, want = tokens.Encoder(WORDS_FILE), []
        for r in df.collect():
            ids = code.one(r.text or "") + [0]
            want += [(r.doc_id, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(np.array(ids[i:i + 2048], "<u4").tobytes()))
                     for i in range(0, len(ids), 2048)]
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r["length"]))
        for x in by.values():
            assert sum(n for _, n in x) <= 2048
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
        assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 3
    assert packing.pack(empty, WORDS_FILE).count() == 0


# 5
def test_quality(odd, empty, words):
    def repeat(w):
        grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        return len({j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)})
    got = {r.doc_id: r for r in quality.judge(odd).where("doc_id is not null").collect()}
    for r in odd.where("doc_id is not null").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), repeat(w))
        assert g.base_failed == (len(w) < 20 or 100 * repeat(w) > 30 * len(w)) and not (g.base_failed and g.kept)
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).count() == 0
    assert quality.keep(odd).columns == odd.columns


# 6
def test_toxicity(spark, odd, empty):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    m = toxicity.score(d, l).join(l, "doc_id").where("held_out and toxic is not null").toPandas()
    a, b = m[m.toxic == 1].score.values, m[m.toxic == 0].score.values
    assert np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b)) > 0.97
    assert ((m.score >= 0.3).astype(int) == m.predicted).all()
    for df in (odd, empty):
        got = toxicity.score(df, l.limit(0)).collect()
        assert len(got) == df.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    known = toxicity.features(pa.array([r.text for r in odd.collect()], pa.string()), {"fox": 2.0, "qui-": 1.0})
    assert len(known) == odd.count() and not known.isna().any().any()


# 7
def brute_components(table, words, k, percent):
    sets = {}
    for i, t in table:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("settings", [{}, {"tree_docs": 3}])
def test_join(spark, docs, odd, empty, words, settings):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(300)]
    table = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(60):  # a hot group of near copies, some linked only through others
        w = base[:int(rng.integers(250, 300))]
        for j in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[j] = f"x{i}"
        table.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(rows(jaccard.join(df, **settings))) == brute_components(table, words, 4, 85)
    known = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(rows(jaccard.join(known, **settings)))
    assert got == brute_components([(r.doc_id, r.text) for r in known.collect()], words, 4, 85)
    assert jaccard.join(odd).count() == odd.count() and jaccard.join(empty).count() == 0


def test_join_plan_follows_documents(spark, monkeypatch):
    """A group of many chunks: the plan has a row or two a document, and is not broadcast where it has too many."""
    plans, written = [], []

    def few(df, **more):
        plans.append(df)
        return scale.small(df, 10, **more)

    def kept(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = jaccard.cut
    monkeypatch.setattr(jaccard, "small", few)
    monkeypatch.setattr(jaccard, "cut", kept)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i // 2 * 9, i // 2 * 9 + 12 + i % 2))) for i in range(40)], "doc_id long, text string")
    large = jaccard.cut(spark.createDataFrame([(i, 7, 300) for i in range(40)], "doc_id long, part long, chunks long"))
    links = spark.createDataFrame([(0, 2), (2, 4), (4, 6)], "a long, b long")
    found = {(min(r), max(r)) for r in jaccard._rest(docs, large, links, 85, 4).collect()}
    # what the largest component has among itself is left to the chunks
    assert found == {(i, i + 1) for i in range(0, 40, 2)}
    assert plans[-1].count() <= 2 * docs.count()
    assert "SortMergeJoin" in written[-1] and "BroadcastHashJoin" not in written[-1]


def test_join_keeps_one_of_each(odd, words):
    kept = jaccard.keep(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    known = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    found = brute_components([(r.doc_id, r.text) for r in known], words, 5, 80)
    # the row that is there twice has no doc_id to itself, so that the next copy stays
    assert set(ids) <= {i for i, _, _ in found} and len(ids) == len({c for _, _, c in found})


def test_texts_that_share_a_doc_id(spark):
    """Different texts under one doc_id, or none, are documents each; one of equal rows stays."""
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    table = [(1, a, "en"), (1, b, "en"), (1, b, "fr"), (2, b, "en"), (3, c, "en"), (None, c, "en"), (None, "5 6 7 8 9", "x"), (None, "5 6 7 8 9", "y"),
             (None, "", "x"), (None, None, "x"), (4, "", "x"), (4, "", "x")]
    got = jaccard.keep(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text and r.doc_id) == [(1, a), (2, b), (3, c)]
    assert len([r for r in got if r.doc_id is None and r.text]) == 1 and len([r for r in got if not r.text]) == 4
    with pytest.raises(ValueError):
        jaccard.join(spark.createDataFrame(table, "doc_id long, text string, lang string"), percent=60)


# 8
KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text) if good(kind, m.group()))


def test_personal_data(spark, docs, odd, empty):
    texts = ["a@b.co_x@d.com é 1.2.3.4.5 256.1.1.1 +1 (555) 123-4567", "4111 1111 1111 1111, 4111-1111-1111-1112", "é@é.com x@y.z.",
             "", None, "1" * 3000 + " " + "a" * 3000 + "@", " 0000255.1.1.1 +12 5 +1....1", "😀 mail me x@y.com 😀 +33 1 23 45 67 89+"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (own, docs, odd):
        of = collections.defaultdict(list)
        for r in df.collect():
            of[r.doc_id].append(r.text or "")
        got = pii.find(df).collect()
        assert len(got) == df.count()
        for r in got:
            want = [",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in base_spans(t)) for t in of[r.doc_id]]
            assert r.base_sha256 in [hashlib.sha256(w.encode()).hexdigest() for w in want]
            n = [r.n_email, r.n_ip, r.n_card, r.n_phone]
            assert n in [[sum(k == x for _, x, _ in base_spans(t)) for k in range(4)] for t in of[r.doc_id]]
            assert any(set(filter(None, w.split(","))) <= set(r.spans.split(",")) for w in want)
    assert pii.find(empty).count() == 0 and pii.mask(odd).columns == odd.columns
    masked = {r.doc_id: r.text for r in pii.mask(own).collect()}
    assert masked[2] == "é@é.com [EMAIL]." and masked[4] is None and "[PHONE]+" in masked[7]


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "00.1.2.3", "192.168.0.1 and 127.0.0.1", "256.0.0.1", "0.0.0.256 100.020.003.000", "000.00.0.0300",
             "8.8.8.8", "0.1.2", "at 10.0.0.255, 010.0.0.00256"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: base_spans(t) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_ip, r.base_sha256) for r in pii.find(own).collect()}
    assert got == {i: (len(w), hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in w).encode()).hexdigest()) for i, w in want.items()}
    assert [len(want[i]) for i in range(6)] == [1, 1, 1, 2, 0, 1]
    assert {r.doc_id: r.text for r in pii.mask(own).collect()}[3] == "[IP] and [IP]"


def test_reliabilities_follow_agreement():
    good, bad = (1, 1, 1, -1, -1, 1), (0, 0, 0, -1, -1, 0)
    _, chance, post = pii.reliabilities([(good, (0, 1), 50), (bad, (0, 1), 50), ((0, 1, 1, -1, -1, 1), (0, 1), 3)])
    assert post[good] > 0.9 and post[bad] < 0.1 and chance[1][0] > chance[1][1]


# 9
def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (511, 7), (5000, 50_000), (3000, 200_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ids[n // 2:] = ids[n // 2:] % 3
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids).to_bytes())
        assert (m.decode() == ids).all() and (m.access(np.arange(n)) == ids).all()
        for t in (0, 1, 2, int(ids[0]) if n else 9, top + 5):
            a, b = n // 5, n - n // 7
            assert m.count(t, a, b) == (ids[a:b] == t).sum()
            assert (m.find(t, a, b) == a + np.flatnonzero(ids[a:b] == t)).all()


def test_lookups_inflate_what_they_touch():
    """Access, count and find of a rare id read a few chunks of each plane of a file."""
    ids = np.random.default_rng(2).integers(0, 40_000, 1 << 20).astype(np.uint32)
    ids[777_777] = 45_000
    blob = wavelet.to_blob([1], np.array([len(ids)]), ids)
    for look, most in ((lambda m: m.access(5)[0] == ids[5], 1), (lambda m: m.count(45_000) == 1, 2), (lambda m: m.find(45_000).tolist() == [777_777], 3)):
        matrix = wavelet.from_blob(blob)[2]
        assert look(matrix)
        assert all(sum(c is None for c in plane.chunks) <= most for plane in matrix.planes)


def test_wavelet_files(spark, docs, odd, empty):
    code = tokens.Encoder(BYTES_FILE)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        at, want = 0, []
        for r in df.orderBy("doc_id").collect():
            ids = code.one(r.text or "") + [0]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(rows(wavelet.round_trip(df, BYTES_FILE))) == want
    assert wavelet.round_trip(odd, BYTES_FILE).count() == odd.count() and wavelet.round_trip(empty, BYTES_FILE).count() == 0


# 10
def test_urls(spark):
    rules = queries.URL_RULES
    urls_ = [None, "", "no scheme", "http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "http://x.com/fr/", "http://x.com/de/a",
             "http://x.net", "http://notexample.org/es/", "a://org", "ftp://com/fr", "http://example.org/en/2", "http://é.com:80/de/\n"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]
    assert got == {i: brute(u) for i, u in enumerate(urls_)}
    cut_up = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, bound=1).collect()}
    assert cut_up == got and urls.judge(pages.limit(0), rules).count() == 0


# shared
def test_encoder_matches_the_library():
    odd = ["", "a\t b", " \n x  y\n\n", "a\t \n", "É é\xa0z 's don't  <|endoftext|> !!\x1c!", None, "end ", "Σας ΣΑΣ é x", "   ", "\n\nx",
           "word word", "Word ¶ x¶ §", "0", "one\u2003two \u3000 three"]
    for path in (WORDS_FILE, BYTES_FILE):
        code = tokens.Encoder(path, room=5)
        for _ in range(2):
            ids, bounds = code(pa.array(odd))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [code.one(x or "") for x in odd]


def test_added_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    end, begin = "<|endoftext|>", "<|startoftext|>"
    texts = [f"word {end} word", f"{begin}Word{end}{end} x", "plain word", f"a{end}\n\n b  {begin} ", end, f"\u2003{end}x",
             "<|endof", "text|> word", f"{end.upper()} word", f"x{end[:-1]} {end}s", None, "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (WORDS_FILE, BYTES_FILE):
        plain = Tokenizer.from_file(path)
        want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
        code = tokens.Encoder(path, room=20)
        for _ in range(2):
            ids, bounds = code(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
        ended = [ids + [0] for ids in want]
        crcs = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ended]
        packed = packing.pack(docs, path).select("doc_id", "start", "length", "ids_crc32")
        assert sorted(rows(packed)) == [(i, 0, len(x), c) for i, (x, c) in enumerate(zip(ended, crcs))]
        starts = np.cumsum([0, *map(len, ended)]).tolist()
        assert sorted(rows(wavelet.round_trip(docs, path))) == [(i, starts[i], len(x), c) for i, (x, c) in enumerate(zip(ended, crcs))]


def test_added_tokens_of_any_form(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    texts = ["Two words and two words", "see FOO here", "  foo  bar", "two", "words of a kind", "", "foobar", "two wordsmith"]
    for path in (WORDS_FILE, BYTES_FILE):
        for n, added in enumerate(([AddedToken("two words", normalized=False, single_word=True)],
                                   [AddedToken("foo", normalized=False, lstrip=True, rstrip=True)], [AddedToken("foo", normalized=True)])):
            plain = Tokenizer.from_file(path)
            plain.add_tokens(added)
            plain.save(file := f"{tmp_path}/{n}.json")
            ids, bounds = tokens.Encoder(file)(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
