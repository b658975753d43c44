"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a mask of word positions; the hash of the words at its ones ignores the others, so a
changed word spoils only the seeds that look at it.  Test and training hashes are joined, and
around each hit the two texts are compared word by word on the hit's diagonal.  A window of 13
words of an item that a document has with at most two words changed holds at least one of the
two masks unspoilt, at one of its offsets, so that every such overlap is found.  Shorter items are
one window, of which four fifths must be in place, and have shorter masks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.scale import small
from pulsegrid.session import cut

#: Every choice of two of 13 places leaves one of these a place where it fits between.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: One of 5 to 9 places, or two of 10 to 12, leave one of these a place between.
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
WINDOW, PERCENT = 13, 80
#: Items of fewer words are too common a phrase to tell anything.
SHORTEST = 5
PUNCTUATION = ".,;:!?\"'()[]{}"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, punctuation taken as space."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.translate(F.coalesce(text, F.lit("")), upper + PUNCTUATION, upper.lower() + " " * len(PUNCTUATION))
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def seeds(hashes: Column, masks) -> Column:
    """All seeds of an array of word hashes, as an array of (place, hash)."""
    parts = []
    for mask in masks:
        number = (*MASKS, *SHORT_MASKS).index(mask)
        span = mask[-1] + 1
        at = lambda i: F.struct(
            i.alias("place"), F.xxhash64(F.lit(number), *[F.get(hashes, i + m) for m in mask]).alias("seed"))  # noqa: B023
        parts.append(F.when(F.size(hashes) >= span, F.transform(F.sequence(F.lit(0), F.size(hashes) - span), at))
                     .otherwise(F.array().cast("array<struct<place:int,seed:bigint>>")))
    return F.concat(*parts)


def _seeded(df: DataFrame, masks, *keep: str) -> DataFrame:
    df = df.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return df.select(*keep, F.explode(seeds(F.col("h"), masks)).alias("s")).select(*keep, "s.place", "s.seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, key (hash of doc_id and text), item_id, item_words and matched: the most words equal in
    a window of the item aligned with the document, for every document and item that overlap.

    An item overlaps a document that has one of its windows of 13 words with 80 % of the words in
    place; an item of ``shortest`` to 12 words, if the document has 80 % of its words in place; a
    shorter one never (``shortest`` is 3 at least).  Null and empty texts overlap nothing.  Repeated rows count once.  A null doc_id is a document like others.
    Other columns are ignored; an empty table gives no rows."""
    if shortest < 1 + SHORT_MASKS[0][-1]:
        raise ValueError("items need three words")
    items = cut(benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= shortest).distinct())
    docs = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("w"))
    brief = F.size("w") < WINDOW
    masks = MASKS if items.where(brief).isEmpty() else (*MASKS, *SHORT_MASKS)
    test = (_seeded(items.where(~brief), MASKS, "item_id").union(_seeded(items.where(brief), SHORT_MASKS, "item_id"))
            .groupBy("seed", "item_id").agg(F.collect_set("place").alias("at")))
    hits = (_seeded(docs, masks, "key").join(small(test), "seed")
            .select("key", "item_id", F.explode("at").alias("at"), "place")
            .select("key", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct())
    sizes = items.select("item_id", "w")
    found = cut(hits.join(small(sizes), "item_id").select("key", "item_id", "shift", F.size("w").alias("n"))
                .groupBy("key").agg(F.collect_set(F.struct("item_id", "shift", "n")).alias("hits")))
    aligned = (docs.join(small(found), "key")
               .select("doc_id", "key", F.explode(F.transform("hits", lambda h: F.struct(
                   h["item_id"].alias("item_id"), h["shift"].alias("shift"),
                   F.slice("w", F.greatest(h["shift"], F.lit(0)) + 1, h["n"]).alias("part")))).alias("x"))
               .select("doc_id", "key", "x.*"))
    from_ = F.greatest(F.col("shift"), F.lit(0))
    same = aligned.join(small(sizes), "item_id").select("doc_id", "key", "item_id", F.size("w").alias("n"), F.transform(
        "w", lambda word, j: F.coalesce((F.get("part", F.col("shift") + j - from_) == word).cast("int"), F.lit(0))).alias("e"))
    width = F.least(F.lit(WINDOW), F.col("n"))
    best = same.select("doc_id", "key", "item_id", "n", F.array_max(F.transform(
        F.sequence(F.lit(0), F.col("n") - width),
        lambda j: F.aggregate(F.slice("e", j + 1, width), F.lit(0), lambda a, b: a + b))).alias("matched"))
    good = 100 * F.col("matched") >= PERCENT * F.least(F.lit(WINDOW), F.col("n"))
    return (best.where(good).groupBy("doc_id", "key", "item_id")
            .agg(F.max("n").cast("bigint").alias("item_words"), F.max("matched").cast("bigint").alias("matched")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words and matched of every overlap, as ``overlaps``."""
    return (overlaps(docs, benchmark).groupBy("doc_id", "item_id")
            .agg(F.max("item_words").alias("item_words"), F.max("matched").alias("matched")))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns as they were.

    Rows with null or empty texts stay; repeated rows, and rows that share a doc_id, are judged each by
    its own text.  An empty table gives none."""
    bad = overlaps(docs, benchmark).select(F.col("key").alias("__bad")).distinct()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return docs.join(small(cut(bad)), key == F.col("__bad"), "left_anti")
