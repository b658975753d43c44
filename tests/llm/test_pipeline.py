"""The stages against the operators' brute force, and on odd and empty tables."""

import zlib

import numpy as np
from test_operators import KINDS, WORDS_FILE, base_spans, brute_components

import corpus_pipeline
from pulsegrid.llm import decontam, quality


def test_stages(spark, docs, odd, empty, words, tmp_path):
    folder = "/root/testdata/sf0.001"
    for n, df in enumerate((docs, odd, empty)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns, name
            out.write.parquet(path := f"{tmp_path}/{n}-{name}".replace(" ", "-"))
            df = spark.read.parquet(path)
        last = corpus_pipeline.STAGES[-1][1](spark, df, folder)
        assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in df.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    full = out.groupBy("sequence_id").sum("length").collect()
    assert full and all(r["sum(length)"] <= 2048 for r in full)


def brute_quality(text):
    w, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    repeat = len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)})
    return (len(w) >= 20 and repeat <= 0.3 * len(w) and 2 <= sum(map(len, w)) / len(w) <= 14 and text.count("!") <= 0.2 * len(w)
            and sum(text.count(c) for c in quality.SYMBOLS) <= 0.1 * len(w) and sum(x in quality.STOP_WORDS for x in w) >= 0.03 * len(w)
            and len(lines) - len(set(lines)) <= 0.5 * len(lines))


def brute_overlap(text, item):
    plain = str.maketrans(dict.fromkeys(decontam.PUNCTUATION, " "))
    d, b = text.lower().translate(plain).split(), item.lower().translate(plain).split()
    for shift in range(-len(b), len(d)):
        same = [0 <= shift + j < len(d) and d[shift + j] == x for j, x in enumerate(b)]
        if any(sum(same[j:j + 13]) >= 11 for j in range(len(b) - 12)):
            return True
    return False


def brute_mask(text):
    for a, k, b in reversed(base_spans(text)):
        text = f"{text[:a]}[{KINDS[k][0].upper()}]{text[b:]}"
    return text


def test_stages_against_brute_force(spark, words, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    vocabulary = ["".join(x) for x in rng.choice(list("bcdfghjkmnpqrtvwxz"), (400, 5))]

    def text(n, at=10):
        return ["the" if i % at == 0 else str(rng.choice(vocabulary)) for i in range(n)]

    def changed(w, *places):
        return ["changed" if i in places else x for i, x in enumerate(w)]
    clean, items = [text(60) for _ in range(30)], [text(20) for _ in range(4)]
    table = [*clean, text(3000), *clean[:4], *[changed(w, 30) for w in clean[4:8]], changed(clean[8], 10, 25, 40, 55)]
    table += [text(20) + changed(items[0], *x) + text(20) for x in ((), (5, 9), (2, 6, 10, 14, 18))]
    table += [text(10), text(60, 100), [x + "!" for x in text(40)], text(12) * 5, [x + "#$" for x in text(40)], text(30) + text(12)]
    table += [[*text(40), "mail", "a@b.com", "or", "10.0.0.1", *text(5)], [*text(40), "<|endoftext|>", *text(30)]]
    now = [(i, " ".join(w)) for i, w in enumerate(table)]
    now += [(1000, "the same line of it\n" * 20), (1001, None), (1002, "")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in now], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [" ".join(w) for w in items]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [[x for x in now if x[1] and brute_quality(x[1])]]
    firsts = {i for i, _, c in brute_components(want[0], words, 5, 80) if i == c}
    want.append([x for x in want[0] if x[0] in firsts])
    want.append([x for x in want[1] if not any(brute_overlap(x[1], b) for b in bench)])
    want.append([(i, brute_mask(t)) for i, t in want[2]])
    sizes = [len(now), *map(len, want[:3])]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and want[3] != want[2]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want):
        stage(spark, df, str(tmp_path)).write.parquet(path := f"{tmp_path}/{name}".replace(" ", "-"))
        df = spark.read.parquet(path)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in df.collect()) == [(i, t, len(t)) for i, t in rows], name
    code, pieces = Tokenizer.from_file(WORDS_FILE), []
    for i, t in want[3]:
        ids = [*code.encode(t, add_special_tokens=False).ids, 0]
        pieces += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    for out in (corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        assert sorted(tuple(r) for r in out.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == pieces
