"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled training documents: words, and beginnings of words, that
toxic documents have far more often.  Features are taken in tasks, each distinct word of a
batch being looked up once.  Trees and calibration are fitted by MLlib on different parts of a
bounded sample of the training documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm import tokens
from pulsegrid.llm.scoring import held_out
from pulsegrid.session import cut

#: Labelled documents for the lexicon and the trees, and most entries of the lexicon.
SAMPLE, LEXICON = 12_000, 600
STEMS = range(3, 9)
SECOND_PERSON = frozenset((
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros").split())
PLAIN = str.maketrans("@4031!$5*7", "aaoeliss t".replace(" ", "i"))
OBFUSCATED = re.compile(r"[^\W\d_]+[@$*!#%&0-9]+[^\W\d_]|[@$*!#%&0-9]+[^\W\d_]{2}")
NEAR = 5
FEATURES = ("n_words", "hits", "hit_share", "weight", "weight_share", "kinds", "near_you", "you_share", "capital_share",
            "shout_share", "mark_share", "obfuscated_share", "obfuscated_hits")
_EDGE = ".,;:!?\"'()[]{}«»„“”‚‘’…-"


def words_of(texts) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of each word among the batch's distinct words, those as text, and bounds of texts."""
    data, bounds = tokens.flat(texts)
    starts, ends = tokens.runs(~tokens.SPACE[data], bounds)
    codes, keys = pd.factorize(tokens.hashes(data, starts, ends))
    at = np.zeros(len(keys), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = data.tobytes()
    return codes, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())], np.searchsorted(starts, bounds)


def items(word: str) -> list[str]:
    """What a word can match in the lexicon: itself, and its beginnings, marked by a dash."""
    core = word.lower().strip(_EDGE)
    return ([core] if len(core) > 2 else []) + [core[:k] + "-" for k in STEMS if len(core) > k]


def lexicon(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Log odds of the words and beginnings that mark toxic documents of (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, bounds = words_of(batch.column("text"))
            of = [items(w) for w in words]
            seen = (Counter(), Counter())
            for a, b, toxic in zip(bounds[:-1], bounds[1:], batch.column("toxic").to_pylist()):
                seen[toxic].update({x for c in np.unique(codes[a:b]).tolist() for x in of[c]})
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(both, pa.string()), "a": pa.array([seen[1][x] for x in both], pa.int64()),
                "b": pa.array([seen[0][x] for x in both], pa.int64())})

    n1, n0 = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    found = (sample.select("text", "toxic").mapInArrow(count, "item string, a long, b long").groupBy("item")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 5")
             .withColumn("odds", F.log((F.col("a") + 0.5) / (n1 + 1) / ((F.col("b") + 0.5) / (n0 + 1))))
             .where(F.col("odds") > math.log(5)).orderBy((F.col("odds") * F.col("a")).desc(), "item").limit(most).collect())
    return {r["item"]: r["odds"] for r in found}


def features(texts, known: dict[str, float]) -> pd.DataFrame:
    """FEATURES of each text; an empty one has zeros."""
    codes, words, bounds = words_of(texts)
    weight, you, obfuscated, hidden = (np.zeros(len(words)) for _ in range(4))
    capital, shout, mark, kind = (np.zeros(len(words)) for _ in range(4))
    kinds: dict[str, int] = {}
    for i, w in enumerate(words):
        best = max(((known[x], x) for x in items(w) if x in known), default=None)
        core = w.lower().strip(_EDGE)
        if OBFUSCATED.search(core):
            obfuscated[i] = 1
            plain = max(((known[x], x) for x in items(core.translate(PLAIN)) if x in known), default=None)
            if plain and (best is None or plain > best):
                best, hidden[i] = plain, 1
        if best:
            weight[i], kind[i] = best[0], kinds.setdefault(best[1], len(kinds) + 1)
        you[i] = core in SECOND_PERSON
        upper = sum(c.isupper() for c in w)
        capital[i], shout[i] = upper > 0, upper > 1 and w.upper() == w
        mark[i] = w.count("!") + w.count("?")
    n = np.diff(bounds)
    hit = weight > 0
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[bounds])
    share = lambda x: x / np.maximum(n, 1)
    seen = np.concatenate([[0], np.cumsum(you[codes])])
    at = np.flatnonzero(hit[codes])
    doc = np.searchsorted(bounds, at, "right") - 1
    close = seen[np.minimum(at + NEAR + 1, bounds[doc + 1])] > seen[np.maximum(at - NEAR, bounds[doc])]
    pairs = np.unique(np.stack([doc, kind[codes[at]]]), axis=1)[0].astype(np.int64)
    hits, weights = total(hit), total(weight)
    return pd.DataFrame(dict(zip(FEATURES, (
        np.log1p(n), hits, share(hits), weights, share(weights), np.bincount(pairs, minlength=len(n)),
        np.bincount(doc, weights=close, minlength=len(n)), share(total(you)), share(total(capital)), share(total(shout)),
        share(total(mark)), share(total(obfuscated)), total(hidden)))), dtype=float)


def featured(df: DataFrame, known: dict[str, float]) -> DataFrame:
    """The columns of ``df`` but the text, and FEATURES of the text."""
    table = df.sparkSession.sparkContext.broadcast(known)  # LEXICON entries at most
    others = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                x = features(some.column("text"), table.value)
                yield pa.RecordBatch.from_pydict({c: some.column(c) for c in others} | {c: pa.array(x[c]) for c in FEATURES})

    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "text"]
                      + [f"{c} double" for c in FEATURES])
    return df.mapInArrow(run, kinds)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of (doc_id, text).

    Learns from (doc_id, toxic) of documents whose crc32(doc_id as text) mod 4 is not 2, at most
    ``sample`` of them, taken by hash of the id.  Null labels are not used; null and empty texts are
    scored like any; repeated rows are scored each.  Without labels of both kinds the score is the
    share of toxic ones.  Other columns are ignored."""
    ids = F.col("doc_id").cast("bigint")
    part = held_out(F.col("doc_id"), 4, 2)
    docs = docs.select(ids.alias("doc_id"), "text", part.alias("held_out"))
    chosen = (labels.select(ids.alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
              .where(~held_out(F.col("id"), 4, 2)).groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    train = cut(docs.where(~F.col("held_out")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # ``sample`` rows
                .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    n, toxic = train.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic or toxic == n:
        return docs.select("doc_id", "held_out", F.lit((toxic or 0) / max(n, 1)).alias("score")).withColumn(
            "predicted", (F.col("score") >= threshold).cast("int"))
    # each step also sees documents that the one before has not: lexicon, trees and calibration take two thirds each
    third = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3))
    known = lexicon(train.where(third == 0).union(train.where(third == 1)))
    data = cut(featured(train, known).withColumn("third", third).repartition(4, "doc_id").sortWithinPartitions("doc_id"))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    boosted = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=30, maxDepth=4, stepSize=0.2, minInstancesPerNode=5,
                            seed=7, cacheNodeIds=True)
    few = data.where("third > 0").agg(F.countDistinct("toxic")).first()[0] < 2
    model = boosted.fit(assemble.transform(data if few else data.where("third > 0")))
    raw = lambda df: model.transform(assemble.transform(df)).withColumn("p", vector_to_array("probability")[1])
    some = data.where("third <> 1")
    calibrated = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="c").fit(
        raw(data if few or some.isEmpty() else some).withColumn("toxic", F.col("toxic").cast("double")).select("p", "toxic"))
    scored = calibrated.transform(raw(featured(docs, known)))
    # the trees' own order within a step of the calibration
    return scored.select("doc_id", "held_out", (0.999 * F.col("c") + 0.001 * F.col("p")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
