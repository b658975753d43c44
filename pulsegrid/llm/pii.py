"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans.  Six labelers vote on each: the strict pattern, the shape, gazetteers,
the words before, the words after, and the variety of characters; each may abstain.
Expectation maximisation over the counts of vote patterns, a bounded table, estimates how
reliable each labeler is, without any label.  Its posteriors train a final naive Bayes
classifier on votes, kind and size, which is compiled into one expression.

Spans of the four base kinds that pass their checks always stay.  The classifier adds others,
where they overlap no base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.scale import small
from pulsegrid.session import cut

#: Kinds in order: the base kinds, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "national", "iban", "number")
BASE = 4
#: Possessive where the longest run is the only match, so that long runs take neither stack nor
#: repeated scans; a look behind instead of trying each place of a run.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
)
#: Zeros before a number are allowed, and a part may be zeros alone.
_BYTE = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
MAIL_ENDS = r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$"
CARD_STARTS = r"^(4|5[1-5]|2[2-7]|34|37|35|36|38|6011|65)"
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN_COUNTRIES = r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
CUES = (r"(?i)\b(call|phone|tel|telefon|mobile|fax|e-?mail|mail|contact|write|reach|card|visa|mastercard|ip|host|server|"
        r"address|adresse|token|key|secret|password|passwd|apikey|ssn|social|iban|account|konto|compte|cuenta)\b[^\n]{0,20}$")
COUNTER_CUES = r"(?i)\b(version|license|section|chapter|page|isbn|issn|doi|figure|table|vol|no|year|rfc)\b[^\n]{0,12}$"
UNITS = r"(?i)^\s?(%|kg|km|cm|mm|px|mb|gb|kb|eur|usd|hz|ms|\xb0)"
LABELERS = 6


def _split(text: Column, kind: int, there: Column) -> tuple[Column, Column]:
    """Pieces between a pattern's matches, and the matches."""
    return (F.when(there, F.split(text, PATTERNS[kind], -1)).otherwise(F.array(F.lit(""))),
            F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, key, and k (kind), m (match), start, end, before, after of all proposals of every
    row; a row without any has one with a null kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), text.alias("t"),
                     F.xxhash64("doc_id", text).alias("key"), text.rlike("[0-9]").alias("digit"),
                     text.contains("@").alias("at"), text.contains("+").alias("plus"))
    need = {0: F.col("at"), 3: F.col("plus") & F.col("digit")}
    for k in range(len(KINDS)):
        pieces, found = _split(F.col("t"), k, need.get(k, F.col("digit")))
        df = df.select("*", pieces.alias(f"p{k}"), found.alias(f"f{k}"))
    one = lambda k: F.transform(f"f{k}", lambda m, i: F.struct(
        F.lit(k).alias("k"), i.alias("i"), F.char_length(F.get(f"p{k}", i)).alias("gap"), m.alias("m"),
        F.right(F.get(f"p{k}", i), F.lit(40)).alias("before"), F.left(F.get(f"p{k}", i + 1), F.lit(10)).alias("after")))
    df = cut(df.select("rid", "doc_id", "key", F.explode_outer(F.concat(*[one(k) for k in range(len(KINDS))])).alias("x"))
             .select("rid", "doc_id", "key", "x.*"))
    past = Window.partitionBy("rid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("m")).over(past)
    found = df.where("k is not null").withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.char_length("m"))
    return found.unionByName(df.where("k is null").withColumn("end", F.lit(None).cast("bigint"))
                             .withColumn("start", F.lit(None).cast("bigint"))).drop("i", "gap")


def luhn(digits: Column) -> Column:
    """Does a string of at most 19 digits pass the check sum?"""
    def value(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def valid() -> Column:
    """Does a proposal of a base kind pass its checks?"""
    m, digits = F.col("m"), F.regexp_replace("m", "[^0-9]", "")
    n = F.char_length(digits)
    return (F.when(F.col("k") == 0, True).when(F.col("k") == 1, m.rlike(IP))
            .when(F.col("k") == 2, F.when((n >= 12) & (n <= 19), luhn(F.when((n >= 12) & (n <= 19), digits).otherwise("0"))).otherwise(False))
            .when(F.col("k") == 3, (n >= 9) & (n <= 15)).otherwise(False))


def votes() -> list[Column]:
    """1 for personal, 0 against, -1 abstaining, of each labeler."""
    m, k = F.col("m"), F.col("k")
    digits = F.regexp_replace("m", "[^0-9]", "")
    n, kinds = F.char_length(digits), F.size(F.array_distinct(F.split(F.lower(F.left(m, F.lit(64))), "")))
    rate = lambda good: F.when(good, 1).otherwise(0)
    return [
        F.when(k < BASE, rate(F.col("ok"))).when(k.isin(5, 6), 1).when(k == 4, rate(m.rlike("^[0-9a-fA-F]{32,}$|^[A-Za-z0-9+/_-]{24,}$"))).otherwise(-1),
        F.when(k == 2, rate(n.between(13, 16))).when(k == 3, rate(n.between(10, 13))).when(k == 4, rate(F.char_length(m) <= 128))
         .when(k.isin(5, 6, 7), 1).when(k == 1, rate(F.char_length(m) <= 15)).otherwise(rate(F.char_length(m) <= 64)),
        F.when(k == 0, rate(m.rlike(MAIL_ENDS))).when(k == 2, rate(digits.rlike(CARD_STARTS))).when(k == 3, rate(m.rlike(COUNTRY_CODES)))
         .when(k == 6, rate(m.rlike(IBAN_COUNTRIES))).when((k == 1) & m.rlike(r"^(0|127|255)\."), 0).otherwise(-1),
        F.when(F.col("before").rlike(COUNTER_CUES), 0).when(F.col("before").rlike(CUES), 1).otherwise(-1),
        F.when(F.col("after").rlike(UNITS), 0).otherwise(-1),
        F.when(kinds >= 6, 1).when(kinds <= 3, 0).otherwise(-1),
    ]


def reliabilities(counts: list[tuple[tuple, tuple, int]], rounds: int = 60) -> tuple[float, list, dict]:
    """Expectation maximisation over (votes, features, rows): share of personal spans, for each labeler
    the chance to vote 1 on a personal and on another span, and the posterior of each vote pattern."""
    by: dict[tuple, int] = {}
    for v, _, n in counts:
        by[v] = by.get(v, 0) + n
    prior, chance = 0.5, [(0.8, 0.2)] * LABELERS
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for v in by:
            a, b = math.log(prior), math.log(1 - prior)
            for (p, q), x in zip(chance, v):
                if x >= 0:
                    a, b = a + math.log(p if x else 1 - p), b + math.log(q if x else 1 - q)
            post[v] = 1 / (1 + math.exp(max(-700, min(700, b - a))))
        total = sum(by.values())
        prior = min(0.98, max(0.02, sum(n * post[v] for v, n in by.items()) / max(total, 1)))
        chance = []
        for j in range(LABELERS):
            votes_ = [(n * post[v], n * (1 - post[v]), v[j]) for v, n in by.items() if v[j] >= 0]
            of = lambda side: (sum(x[side] for x in votes_ if x[2]) + (4 if side == 0 else 1)) / (sum(x[side] for x in votes_) + 5)  # noqa: E731,B023
            chance.append((of(0), of(1)))
    return prior, chance, post


def classifier(counts: list[tuple[tuple, tuple, int]]) -> Column:
    """Log odds of a span under naive Bayes, trained on the posteriors: a sum over the values of its
    votes, kind and size."""
    prior, _, post = reliabilities(counts)
    names = [f"v{j}" for j in range(LABELERS)] + ["k", "size"]
    out = F.lit(math.log(prior / (1 - prior)))
    yes = sum(n * post[v] for v, _, n in counts) + 1
    no = sum(n * (1 - post[v]) for v, _, n in counts) + 1
    for i, name in enumerate(names):
        table: dict[int, list[float]] = {}
        for v, f, n in counts:
            t = table.setdefault((v + f)[i], [0.5, 0.5])
            t[0] += n * post[v]
            t[1] += n * (1 - post[v])
        term = F.lit(0.0)
        for value, (a, b) in sorted(table.items()):
            term = F.when(F.col(name) == value, math.log(a / yes / (b / no))).otherwise(term)
        out = out + term
    return out


def spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, key and all, an ascending array of (start, k, end), for every row of (doc_id, text);
    code points, end exclusive."""
    found = candidates(docs).withColumn("ok", F.when(F.col("k").isNotNull(), valid()))
    found = cut(found.select("*", *[v.alias(f"v{j}") for j, v in enumerate(votes())],
                             F.least(F.floor(F.log2(F.char_length("m") + 1)), F.lit(8)).cast("int").alias("size")))
    names = [f"v{j}" for j in range(LABELERS)]
    # a row for each combination of votes, kind and size: at most 3 ** 6 * 8 * 9
    counts = [(tuple(r[x] for x in names), (r["k"], r["size"]), r["count"])
              for r in found.where("k is not null").groupBy(*names, "k", "size").count().collect()]
    found = found.withColumn("odds", classifier(counts) if counts else F.lit(0.0))
    past = Window.partitionBy("rid").orderBy("start", "k")
    base = F.col("ok") & (F.col("k") < BASE)
    clear = ((F.col("start") >= F.coalesce(F.max(F.when(base, F.col("end"))).over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             & (F.col("end") <= F.coalesce(F.min(F.when(base, F.col("start"))).over(past.rowsBetween(1, Window.unboundedFollowing)), F.col("end"))))
    found = found.withColumn("take", F.coalesce(base | ((F.col("odds") > 0) & clear), F.lit(False)))
    # a base pattern whose match fails its check can only be some other number
    kind = F.when((F.col("k") < BASE) & ~F.col("ok"), KINDS.index("number")).otherwise(F.col("k"))
    one = F.when(F.col("take"), F.struct("start", kind.cast("int").alias("k"), "end"))
    return found.groupBy("rid", "doc_id", "key").agg(F.array_sort(F.array_distinct(F.collect_list(one))).alias("all"))


def _text(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat(
        F.get(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of (doc_id, text).

    Null and empty texts have no spans, and the sha256 of nothing.  Repeated rows are searched each.
    An empty table gives none; other columns are ignored."""
    base = F.filter("all", lambda s: s["k"] < BASE)
    return spans(docs).select(
        "doc_id", *[F.size(F.filter("all", lambda s: s["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(BASE)],  # noqa: B023
        F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, overlapping ones by the first's; n_chars
    follows where there is one.  All other columns, and texts without spans, are as they were."""
    found = cut(spans(docs).where(F.size("all") > 0).select(F.col("key").alias("__key"), "all").dropDuplicates(["__key"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cols = docs.columns
    joined = docs.join(small(found), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) == F.col("__key"), "left")
    cut_up = F.aggregate(
        "all", F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["t"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                     F.get(names, s["k"])).alias("t"), s["end"].alias("at"))),
        lambda a: F.concat(a["t"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))))
    joined = joined.withColumn("__text", F.when(F.col("all").isNotNull(), cut_up).otherwise(F.col("text")))
    out = {"text": F.col("__text")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.col("all").isNotNull(), F.char_length("__text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in cols])
