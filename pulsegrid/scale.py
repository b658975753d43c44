"""Ordered computation that does not depend on how rows spread over keys.

A window partitioned by a telemetry key (metric, host, edge) puts the whole key in
one task, and one metric may hold a third of all rows.  Each function here first
counts rows per key (a combined aggregate over the key columns alone).  While the
largest key stays under ``limit`` the plain window is used: one shuffle.  Beyond it
the rows are range-partitioned on (key, order), which splits a key anywhere, and
partition summaries carry state across the cuts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.session import cut

GROUP_LIMIT = 1_000_000
BROADCAST_ROWS = 100_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the fullest key; one row reaches the driver."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return n or 0


def small(df: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows, else leave the choice to the planner, or give
    it the join hint ``otherwise``."""
    seen = len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) if rows < 1000 else \
        df.limit(rows + 1).count()
    if seen <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null: a series without a host is a series too."""
    keys = list(keys)
    if not keys:
        return left.join(right, how=how)
    theirs = right.select(*[F.col(f"`{c}`").alias(f"__their_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__their_{k}")) for k in keys]
    return left.join(theirs, same, how).drop(*[f"__their_{k}" for k in keys])


def _fits(df: DataFrame, keys: Sequence[str], limit: int | None, fullest: int | None) -> bool:
    """Does every key stay within the limit?  ``fullest`` spares the count when known."""
    return (largest_group(df, keys) if fullest is None else fullest) <= (GROUP_LIMIT if limit is None else limit)


def _window(keys):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence, specs: dict[str, tuple[str, Column]],
         limit: int | None = None, fullest: int | None = None) -> DataFrame:
    """Inclusive running values per key in order; ``specs`` maps a new column to
    ``("sum" | "last" | "max" | "min", column)``.  "last" skips nulls."""
    keys, order = list(keys), list(order)

    def running(kind, c, w):
        return {"sum": F.sum(c), "last": F.last(c, ignorenulls=True), "max": F.max(c), "min": F.min(c)}[kind].over(w)

    if _fits(df, keys, limit, fullest):
        w = _window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[running(k, c, w).alias(n) for n, (k, c) in specs.items()])

    tmp = {n: f"__{n}" for n in specs}
    cols = df.columns
    ranged = (df.select("*", *[c.alias(tmp[n]) for n, (_, c) in specs.items()])
              .repartitionByRange(*[F.col(k) for k in keys], *order)
              .sortWithinPartitions(*[F.col(k) for k in keys], *order)
              .withColumn("__at", F.monotonically_increasing_id()))
    ranged = cut(ranged.withColumn("__part", F.shiftright("__at", 33)))

    def total(kind, n):
        c = F.col(tmp[n])
        return {"sum": F.sum(c), "max": F.max(c), "min": F.min(c),
                "last": F.max_by(c, F.when(c.isNotNull(), F.col("__at")))}[kind].alias(tmp[n])

    parts = ranged.groupBy(*keys, "__part").agg(*[total(k, n) for n, (k, _) in specs.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, "__part", *[
        running(k, F.col(tmp[n]), before).alias(f"__carry_{n}") for n, (k, _) in specs.items()])
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + \
        [F.col("r.__part") == F.col("c.__part")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    local = Window.partitionBy(*[F.col(f"r.{k}") for k in keys], F.col("r.__part")) \
        .orderBy("r.__at").rowsBetween(Window.unboundedPreceding, 0)

    def combined(kind, n):
        here = running(kind, F.col(f"r.{tmp[n]}"), local)
        past = F.col(f"c.__carry_{n}")
        if kind == "sum":
            return F.when(past.isNull(), here).when(here.isNull(), past).otherwise(past + here)
        return {"max": lambda: F.when(past.isNull() | (here > past), here).otherwise(past),
                "min": lambda: F.when(past.isNull() | (here < past), here).otherwise(past),
                "last": lambda: F.coalesce(here, past)}[kind]()

    return (ranged.alias("r").join(carry.alias("c"), cond, "left")
            .select(*[F.col(f"r.{c}").alias(c) for c in cols],
                    *[combined(k, n).alias(n) for n, (k, _) in specs.items()]))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "pos",
              limit: int | None = None, fullest: int | None = None) -> DataFrame:
    """Zero-based place of each row within its key."""
    return scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, limit, fullest) \
        .withColumn(name, F.col(name) - 1)


def over_rows(df: DataFrame, keys: Sequence[str], order: Sequence, before: int,
              exprs: Callable[[Window], dict[str, Column]], limit: int | None = None,
              fullest: int | None = None) -> DataFrame:
    """Window columns that look back at most ``before`` rows.

    ``exprs(w)`` gets the partitioned, ordered window and returns the new columns.  A
    key beyond ``limit`` is cut into pieces, each led by the last ``before`` rows of the
    piece before it.
    """
    limit = GROUP_LIMIT if limit is None else limit
    fullest = largest_group(df, keys) if fullest is None else fullest
    if fullest <= limit:
        w = _window(keys).orderBy(*order)
        return df.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    size = max(limit, before + 1)
    piece = F.floor(F.col("__pos") / size)
    lead = F.when(F.col("__pos") % size >= size - before, F.array(piece, piece + 1)) \
        .otherwise(F.array(piece))
    pieces = positions(df, keys, order, "__pos", limit, fullest) \
        .withColumn("__home", piece).withColumn("__piece", F.explode(lead))
    w = Window.partitionBy(*keys, "__piece").orderBy("__pos")
    return (pieces.select("*", *[c.alias(n) for n, c in exprs(w).items()])
            .where("__piece = __home").drop("__pos", "__home", "__piece"))


def over_range(df: DataFrame, keys: Sequence[str], ts: str, span_s: float,
               exprs: Callable[[Window], dict[str, Column]], limit: int | None = None,
               piece_s: float | None = None) -> DataFrame:
    """Window columns over time frames that look back at most ``span_s`` seconds.

    The window is ordered by epoch microseconds.  A key beyond ``limit`` is cut into
    time pieces of ``piece_s``; each row is also sent to the later pieces whose frames
    can still see it.
    """
    limit = GROUP_LIMIT if limit is None else limit
    us = F.unix_micros(ts)
    if largest_group(df, keys) <= limit:
        w = _window(keys).orderBy(us)
        return df.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    span = int(span_s * 1_000_000)
    size = int((piece_s or span_s * 4) * 1_000_000)
    home = F.floor(us / size)
    pieces = df.withColumn("__home", home).withColumn(
        "__piece", F.explode_outer(F.sequence(home, F.floor((us + span) / size))))  # a row without a time stays
    w = Window.partitionBy(*keys, "__piece").orderBy(us)
    return (pieces.select("*", *[c.alias(n) for n, c in exprs(w).items()])
            .where("__piece <=> __home").drop("__home", "__piece"))


def moving(df: DataFrame, keys: Sequence[str], fns: dict[str, tuple[str, str]], ts: str | None = None,
           span_s: float | None = None, closed: bool = False, order: Sequence[str] = (), n: int | None = None,
           limit: int | None = None, fullest: int | None = None) -> DataFrame:
    """Moving statistics whose cost per row does not grow with the frame.

    ``fns`` maps a new column to ("count" | "sum" | "mean" | "std" | "min" | "max", column).
    The frame is ``(t - span, t]`` over ``ts``, with ``closed`` also its left end, or the
    last ``n`` rows in ``order``.

    A sliding frame is re-read for every row.  Here the axis is cut into blocks as long as
    the frame, so a frame is the end of one block and the start of the next.  Running
    statistics from the block's border outwards give both parts, and merging them loses
    no digits.  A block and the one before it form one task's group, whatever the key's
    size.  Every row sends a probe to its frame's left edge to read the running value.
    """
    keys = list(keys)
    if ts is not None:
        d = df.withColumn("__o", F.unix_micros(ts))
        width = int(span_s * 1_000_000) + (1 if closed else 0)
    else:
        d = positions(df, keys, [F.col(o) for o in order], "__o", limit, fullest)
        width = n
    cols = sorted({c for _, c in fns.values()})
    block = F.floor(F.col("__o") / width)

    def copy(kind, at):
        return F.struct(F.lit(kind).alias("kind"), at.alias("at"))

    d = d.withColumn("__c", F.explode(F.array(copy(0, block), copy(1, block + 1), copy(2, block))))
    kind = F.col("__c.kind")
    home, halo, probe = kind == 0, kind == 1, kind == 2
    # only the home copy carries the row, and probes carry no values
    carried = [F.when(home, F.col(c)).alias(c) if c not in keys else F.col(c) for c in df.columns]
    d = d.select(*carried, "__o", F.col("__c.at").alias("__at"), kind.alias("__k"),
                 *[F.when(~probe, F.col(c)).alias(f"__v_{c}") for c in cols],
                 # running order: outwards from the border between the two blocks
                 F.when(home, 2 * F.col("__o")).when(halo, 1 - 2 * F.col("__o"))
                 .otherwise(2 * (width - F.col("__o"))).alias("__z"))
    # one exchange serves both windows below
    d = d.repartition(*keys, "__at")
    home, probe = F.col("__k") == 0, F.col("__k") == 2
    run = Window.partitionBy(*keys, "__at", home).orderBy("__z").rangeBetween(Window.unboundedPreceding, 0)
    used = {c: {f for f, x in fns.values() if x == c} for c in cols}
    parts = {}
    for c in cols:
        v, u = F.col(f"__v_{c}"), used[c]
        parts[f"n_{c}"] = F.count(v)
        if u & {"sum"}:
            parts[f"s_{c}"] = F.sum(v)
        if u & {"mean", "std"}:
            parts[f"m_{c}"] = F.avg(v)
        if u & {"std"}:
            parts[f"q_{c}"] = F.var_pop(v)
        if u & {"min"}:
            parts[f"lo_{c}"] = F.min(v)
        if u & {"max"}:
            parts[f"hi_{c}"] = F.max(v)
    d = d.withColumns({f"__h_{k}": x.over(run) for k, x in parts.items()})
    same = Window.partitionBy(*keys, "__at", "__o")
    d = d.withColumns({f"__e_{k}": F.max(F.when(probe, F.col(f"__h_{k}"))).over(same) for k in parts}).where(home)

    def both(k):
        return F.col(f"__e_{k}"), F.col(f"__h_{k}")

    def result(f, c):
        na, nb = (F.coalesce(x, F.lit(0)) for x in both(f"n_{c}"))
        cnt = na + nb
        if f == "count":
            return cnt
        if f == "sum":
            a, b = both(f"s_{c}")
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if f in ("min", "max"):
            return (F.least if f == "min" else F.greatest)(*both(f"{'lo' if f == 'min' else 'hi'}_{c}"))
        ma, mb = both(f"m_{c}")
        if f == "mean":
            return F.when(na == 0, mb).when(nb == 0, ma).otherwise(ma + (mb - ma) * nb / cnt)
        qa, qb = (F.coalesce(x, F.lit(0.0)) for x in both(f"q_{c}"))
        gap = F.when((na > 0) & (nb > 0), (mb - ma) * (mb - ma) * na * nb / cnt).otherwise(0.0)
        return F.when(cnt > 1, F.sqrt((qa * na + qb * nb + gap) / (cnt - 1)))

    return d.select(*df.columns, *[result(f, c).alias(name) for name, (f, c) in fns.items()])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence, cols: dict[str, str],
             limit: int | None = None, fullest: int | None = None) -> DataFrame:
    """``{new column: column}`` taken from the row before."""
    return over_rows(df, keys, order, 1, lambda w: {
        n: F.max(F.struct(F.col(c))).over(w.rowsBetween(-1, -1))[c] for n, c in cols.items()}, limit, fullest)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, flag: Column,
            limit: int | None = None) -> DataFrame:
    """Rows where ``flag`` holds, numbered by run: consecutive rows share ``island``."""
    fullest = largest_group(df, keys)
    marked = previous(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), keys, order,
                      {"__was": "__flag"}, limit, fullest)
    start = (F.col("__flag") & ~F.coalesce(F.col("__was"), F.lit(False))).cast("long")
    return scan(marked, keys, order, {"island": ("sum", start)}, limit, fullest) \
        .where("__flag").drop("__flag", "__was")


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         step: Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]], zero: dict,
         out: T.StructType | str, limit: int | None = None) -> DataFrame:
    """Sequential fold per key: ``step(rows, state) -> (output rows, new state)``.

    Keys up to ``limit`` rows fold in one call.  Beyond it a key is cut into pieces.  ``step.passes`` says
    how states go through a piece without its rows: a pass is ``(summarise, follow)``, where
    ``summarise(rows, entry)`` makes a small summary of a piece and ``follow(summary, state)`` takes a
    state from the piece's begin to its end.  All pieces are summarised at the same time, a key's summaries
    are followed in order, and then all pieces fold at the same time from their entries.  Later passes
    are given the entries that earlier ones have found, as far as these know them.  One table is written
    for the pieces and one for each pass, however many pieces there are.
    """
    limit = GROUP_LIMIT if limit is None else limit
    keys, order = list(keys), list(order)
    zero_text = json.dumps(zero)
    out = T._parse_datatype_string(out) if isinstance(out, str) else out

    if largest_group(df, keys) <= limit:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values(order, kind="stable").reset_index(drop=True)
            return step(rows, json.loads(zero_text))[0][out.names]
        return df.groupBy(*keys).applyInPandas(whole, out)

    pieces = cut(positions(df, keys, [F.col(o) for o in order], "__pos", limit)
                 .withColumn("__piece", F.floor(F.col("__pos") / limit)).drop("__pos"))
    on = keys + ["__piece"]
    names = pieces.columns
    text = lambda name: T.StructType([df.schema[k] for k in keys]
                                     + [T.StructField("__piece", T.LongType()), T.StructField(name, T.StringType())])

    def sorted_rows(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict | None]:
        rows = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return rows[names], json.loads(rows["__entry"].iloc[0]) if "__entry" in rows else None

    def summaries(summarise):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, entry = sorted_rows(pdf)
            return rows.loc[[0], on].assign(__summary=json.dumps(summarise(rows, entry)))
        return run

    def chain(follow):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__piece").reset_index(drop=True)
            state, entries = json.loads(zero_text), []
            for summary in pdf["__summary"]:
                entries.append(json.dumps(state))
                state = follow(json.loads(summary), state)
            return pdf[on].assign(__entry=entries)
        return run

    entered = pieces
    for summarise, follow in step.passes:
        entry = cut(entered.groupBy(*on).applyInPandas(summaries(summarise), text("__summary"))
                    .groupBy(*keys).applyInPandas(chain(follow), text("__entry")))
        entered = join_keys(pieces, entry, on)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(*sorted_rows(pdf))[0][out.names]

    return entered.groupBy(*on).applyInPandas(emit, out)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
           limit: int | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``, ranked from 1 in ``rank``.

    A key beyond ``limit`` is thinned first: the top ``n`` of every slice of the key hold
    the top ``n`` of the key.
    """
    limit = GROUP_LIMIT if limit is None else limit
    keys = list(keys)
    biggest = largest_group(df, keys)
    if biggest > limit:
        slices = -(-biggest // limit)
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*plain), F.lit(slices)))
        w = Window.partitionBy(*keys, "__slice").orderBy(*order)
        df = sliced.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n) \
            .drop("__r", "__slice")
    w = _window(keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def as_of_column(df: DataFrame, ts: str, as_of=None) -> Column:
    """The reference instant: the one given, else the newest time in ``df``."""
    if as_of is None:
        return df.agg(F.max(ts)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
