"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is an expression on the row's own text, so the operator is one scan without a
shuffle, and a row costs time and memory in proportion to its own text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent short words of English, French, German and Spanish, as they stand at a word's place.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from or an at "
    "le la les de des du et un une que qui dans est pour sur au par pas en "
    "der die das und ist von den mit zu ein eine nicht auf für dem im "
    "el los las del y una por con para como se su al lo").split()

#: (rule, measure, least, most): a document is kept if every measure lies within its bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("long enough", "n_words", 20, None),
    ("words not glued together", "mean_word", 2, 14),
    ("few symbols", "symbols_per_word", None, 0.1),
    ("little shouting", "shouts_per_word", None, 0.2),
    ("running text", "stop_share", 0.03, None),
    ("lines not repeated", "dup_line_share", None, 0.5),
    ("words not repeated", "repeat_share", None, 0.3),
)


def _length_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_shouts, n_stop, n_lines, n_dup_lines and
    n_repeat_words (long) of its whole texts.

    Null and empty texts measure 0.  n_dup_lines: lines that have a word and equal an earlier
    line.  n_repeat_words: words in windows of eight that the text has twice or more, the first
    included; windows are told apart by 64-bit hashes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, f"{GAP}+"), lambda x: x != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    stop = sorted({s for w in STOP_WORDS for s in (w, w.capitalize())})
    df = docs.select("*", words.alias("__w"), lines.alias("__l"))
    df = df.select("*", F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"))
    df = df.select("*", F.when(
        F.size("__h") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("__g"))
    # windows beside their like when sorted by hash; only texts that repeat one are sorted.  The id keeps
    # the optimizer from moving a filter on the measures below this step, where each look at a neighbour
    # would sort anew
    df = df.select("*", F.monotonically_increasing_id().alias("__id"), F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("__s"))
    same = lambda e, k: (F.get(F.col("__s"), k)["x"] == e["x"])
    at = F.sort_array(F.transform(
        F.filter("__s", lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False))),
        lambda e: e["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    long = lambda c, name: c.cast("bigint").alias(name)
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        long(F.size("__w"), "n_words"),
        long(_length_without(whole, " \t\n\x0b\x0c\r"), "word_chars"),
        long(F.char_length(whole) - _length_without(whole, SYMBOLS), "n_symbols"),
        long(F.char_length(whole) - _length_without(whole, "!"), "n_shouts"),
        long(F.size(F.filter("__w", lambda x: x.isin(stop))), "n_stop"),
        long(F.size("__l"), "n_lines"),
        long(F.size("__l") - F.size(F.array_distinct("__l")), "n_dup_lines"),
        F.coalesce(F.when(F.col("__s").isNotNull() & (F.col("__id") >= 0), covered), F.lit(0).cast("bigint")).alias("n_repeat_words"))


def verdict(rules: Sequence[tuple] = RULES) -> Column:
    """The table as one condition on the columns of ``measures``.  A ratio of nothing is 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    of = {"n_words": F.col("n_words"), "mean_word": share("word_chars", "n_words"),
          "symbols_per_word": share("n_symbols", "n_words"), "shouts_per_word": share("n_shouts", "n_words"),
          "stop_share": share("n_stop", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
          "repeat_share": share("n_repeat_words", "n_words")}
    good = F.lit(True)
    for _, measure, least, most in rules:
        good = good & (of[measure] >= least if least is not None else F.lit(True)) \
            & (of[measure] <= most if most is not None else F.lit(True))
    return good


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of (doc_id, text).

    Repeated rows are judged each; other columns are ignored; an empty table gives none."""
    return (measures(docs.select("doc_id", "text"))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_lines", "n_shouts", "n_stop"))


def keep(docs: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"))
    return (measures(inner, "__text").where(~base_failed() & verdict(rules)).select("__row.*"))
