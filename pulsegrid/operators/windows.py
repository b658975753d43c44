"""Window and time-series operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.operators.aggregates import head_tail, trend_of  # noqa: F401
from pulsegrid.scale import (as_of_column, islands, largest_group, moving, newest, over_rows, positions, previous)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows() -> Column:
    return F.count(F.lit(1))


DIRECT = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def rolling(df: DataFrame, keys: Sequence[str], ts: str, col: str, span_s: int, fns: Sequence[str] = ("mean",),
            prefix: str = "rolling") -> DataFrame:
    """Statistics over ``(t - span, t]`` per row: count, sum, mean, std, min, max."""
    return moving(df, keys, {f"{prefix}_{f}": (f, col) for f in fns}, ts=ts, span_s=span_s)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, n: int,
           fns: Sequence[str] = ("mean",), prefix: str = "last", limit: int | None = None,
           fullest: int | None = None) -> DataFrame:
    """Statistics over the last ``n`` rows including this one."""
    if n > 32:
        return moving(df, keys, {f"{prefix}_{f}": (f, col) for f in fns}, order=order, n=n, limit=limit, fullest=fullest)
    # a frame of a few rows is cheaper to re-read than to take apart
    return over_rows(df, keys, [F.col(o) for o in order], n - 1, lambda w: {
        f"{prefix}_{f}": DIRECT[f](col).over(w.rowsBetween(-(n - 1), 0)) for f in fns}, limit, fullest)


def dynamic_threshold(df: DataFrame, keys: Sequence[str] = ("metric",), ts="ts", tie="event_id", value="value",
                      base="threshold", op="op", k: float = 2.0, memory: int = 1000, limit: int | None = None) -> DataFrame:
    """Threshold that follows mean ± k standard deviations of recent history.

    History is the last ``memory`` rows of the key with this one.  Under 20 rows the base
    threshold stands.  The last hour counts if it has ten rows, else the last fifty.  An
    upper threshold never falls below the base, a lower one never rises above it.
    """
    order, fullest = [ts, tie], largest_group(df, keys)
    d = over_rows(df, keys, [F.col(o) for o in order], 19, lambda w: {
        "__seen": rows().over(w.rowsBetween(-19, 0))}, limit, fullest)
    d = moving(d, keys, {"__hn": ("count", value), "__hm": ("mean", value), "__hs": ("std", value)},
               ts=ts, span_s=3600, closed=True)
    for tag, size in (("a", memory), ("f", 50)):
        d = moving(d, keys, {f"__{tag}m": ("mean", value), f"__{tag}s": ("std", value)}, order=order, n=size,
                   limit=limit, fullest=fullest)

    def choose(x):
        return F.when(F.col("__hn") > memory, F.col(f"__a{x}")).when(F.col("__hn") >= 10, F.col(f"__h{x}")) \
            .otherwise(F.col(f"__f{x}"))

    mean, std = choose("m"), F.coalesce(choose("s"), F.lit(0.0))
    b, o = _c(base), _c(op)
    moved = F.when(o.isin(">", ">="), F.greatest(b, mean + k * std)) \
        .when(o.isin("<", "<="), F.least(b, mean - k * std)).otherwise(b)
    return d.withColumn("dynamic_threshold", F.when(F.col("__seen") < 20, b).otherwise(moved)) \
        .drop(*[c for c in d.columns if c.startswith("__")])


def anomaly_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, score: str = "score",
                    features: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Runs of consecutive flagged rows as intervals with mean score and per-feature mean,
    max and sample deviation."""
    runs = islands(df, keys, [F.col(o) for o in order], flag, limit)
    extra = [x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.max(f).alias(f"{f}_max"),
                                           F.stddev_samp(f).alias(f"{f}_std"))]
    return runs.groupBy(*keys, "island").agg(
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), rows().alias("anomalies"),
        F.avg(score).alias("avg_score"), *extra)


def trend_label(df: DataFrame, keys: Sequence[str], order: Sequence[str], value="value", limit: int | None = None) -> DataFrame:
    """Slope over position, and increasing / decreasing / stable at ±0.1."""
    p = positions(df, keys, [F.col(o) for o in order], "__at", limit)
    out = p.groupBy(*keys).agg(rows().alias("n"), F.regr_slope(F.col(value), F.col("__at").cast("double")).alias("slope"))
    return out.withColumn("trend", trend_of(F.col("slope"), F.col("n")))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, by combining aggregates rather than ranking rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, length: int,
              limit: int | None = None) -> DataFrame:
    """The ``length`` values before each row as ``window``, with the row's value as ``target``;
    rows without enough history drop."""
    d = over_rows(df, keys, [F.col(o) for o in order], length, lambda w: {
        "window": F.collect_list(F.col(col)).over(w.rowsBetween(-length, -1))}, limit)
    return d.where(F.size("window") == length).withColumn("target", F.col(col))


def nth_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, n: int = 6, limit: int | None = None) -> DataFrame:
    """Last value and n-th last value (the last again when there are fewer)."""
    top = newest(df, keys, [F.desc(o) for o in order], n, limit)
    out = top.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col(col))).alias("last"),
                                 F.max(F.when(F.col("rank") == n, F.col(col))).alias("nth"))
    return out.withColumn("nth", F.coalesce("nth", "last"))


# How many backups each retention policy keeps.
KEEP = {"DAILY_7_WEEKLY_4_MONTHLY_12": 7, "HOURLY_24_DAILY_7_WEEKLY_4": 24}


def retention_plan(df: DataFrame, keys: Sequence[str], order: Sequence[str], policy="policy", default: int = 30,
                   limit: int | None = None) -> DataFrame:
    """Marks each backup ``keep`` or ``delete``: the newest N per key stay."""
    m = F.create_map(*[F.lit(x) for kv in KEEP.items() for x in kv])
    n = F.coalesce(F.element_at(m, _c(policy)), F.lit(default))
    p = positions(df, keys, [F.desc(o) for o in order], "__at", limit)
    return p.withColumn("plan", F.when(F.col("__at") < n, "keep").otherwise("delete")).drop("__at")


def age_plan(df: DataFrame, days: int, ts="ts", name: str | None = None, protected: Sequence[str] = ("latest", "last7d"),
             as_of=None) -> DataFrame:
    """Marks rows older than ``days`` for deletion, except protected names."""
    edge = F.unix_micros(as_of_column(df, ts, as_of)) - days * 86_400_000_000
    old = F.unix_micros(ts) < edge
    if name:
        old = old & ~F.col(name).isin(*protected)
    return df.withColumn("plan", F.when(old, "delete").otherwise("keep"))


def due_targets(targets: DataFrame, ops: DataFrame, as_of, key="target_id", hours: int = 24) -> DataFrame:
    """Targets without a completed operation in the last ``hours``."""
    last = ops.where("status = 'completed'").groupBy(key).agg(F.max("end_time").alias("last_backup"))
    d = targets.join(last, key, "left")
    gap = F.unix_micros(_c(as_of)) - F.unix_micros("last_backup")
    return d.where(F.col("last_backup").isNull() | (gap > hours * 3_600_000_000))


# --- counters -------------------------------------------------------------

def counter_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value="value", limit: int | None = None) -> DataFrame:
    """Growth since the previous sample in ``step``; after a reset the value itself."""
    d = previous(df, keys, [F.col(o) for o in order], {"__prev": value}, limit)
    v, p = F.col(value), F.col("__prev")
    return d.withColumn("step", F.when(p.isNull(), 0.0).when(v < p, v).otherwise(v - p)).drop("__prev")


def increase(df: DataFrame, keys: Sequence[str], ts: str, tie: str, span_s: int, value="value", out="increase",
             limit: int | None = None) -> DataFrame:
    """Counter growth over ``(t - span, t]``, without extrapolation to the window's edges."""
    d = counter_steps(df, keys, [ts, tie], value, limit)
    return moving(d, keys, {out: ("sum", "step")}, ts=ts, span_s=span_s).drop("step")


def rate(df: DataFrame, keys: Sequence[str], ts: str, tie: str, span_s: int, value="value", limit: int | None = None) -> DataFrame:
    """Counter growth per second over the window."""
    return increase(df, keys, ts, tie, span_s, value, "rate", limit).withColumn("rate", F.col("rate") / span_s)


def irate(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value="value", limit: int | None = None) -> DataFrame:
    """Growth per second between the last two samples."""
    d = previous(df, keys, [F.col(ts), F.col(tie)], {"__pv": value, "__pt": ts}, limit)
    v, p = F.col(value), F.col("__pv")
    grown = F.when(v < p, v).otherwise(v - p)
    secs = (F.unix_micros(ts) - F.unix_micros("__pt")) / 1e6
    return d.withColumn("irate", F.when(p.isNotNull(), F.try_divide(grown, secs))).drop("__pv", "__pt")


def changes(df: DataFrame, keys: Sequence[str], ts: str, tie: str, span_s: int, value="value", limit: int | None = None) -> DataFrame:
    """How often the value changed in ``(t - span, t]``."""
    d = previous(df, keys, [F.col(ts), F.col(tie)], {"__pv": value}, limit) \
        .withColumn("__ch", (F.col("__pv").isNotNull() & (F.col("__pv") != F.col(value))).cast("long"))
    return moving(d, keys, {"changes": ("sum", "__ch")}, ts=ts, span_s=span_s).drop("__ch", "__pv")


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float, le="le", count="count") -> DataFrame:
    """Quantile from cumulative bucket counts, linear inside the bucket.

    A quantile in the last, unbounded bucket is the highest finite bound.  Buckets per
    series are few, and they are summed before they are ordered."""
    b = buckets.groupBy(*keys, F.col(le).cast("double").alias("le")).agg(F.sum(count).cast("double").alias("c"))
    w = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    inf = F.lit(float("inf"))
    d = b.select(*keys, "le", "c", F.lag("le", 1).over(w).alias("lo"), F.lag("c", 1).over(w).alias("below"),
                 (F.max("c").over(whole) * q).alias("rank"), F.max(F.when(F.col("le") < inf, F.col("le"))).over(whole).alias("top"))
    hit = d.where((F.col("c") >= F.col("rank")) & (F.coalesce("below", F.lit(-1.0)) < F.col("rank")))
    lo, below = F.coalesce("lo", F.lit(0.0)), F.coalesce("below", F.lit(0.0))
    inside = lo + (F.col("le") - lo) * F.try_divide(F.col("rank") - below, F.col("c") - below)
    return hit.select(*keys, F.when(F.col("le") == inf, F.col("top")).otherwise(inside).alias("quantile"))


def absent(df: DataFrame, expected: DataFrame, on: Sequence[str], span_s: int, as_of=None, ts="ts") -> DataFrame:
    """Expected series without any sample in the window."""
    end = F.unix_micros(as_of_column(df, ts, as_of))
    alive = df.where(F.unix_micros(ts) > end - span_s * 1_000_000).select(*on).distinct()
    return expected.join(alive, list(on), "left_anti")


def held_for(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column, span_s: int,
             limit: int | None = None) -> DataFrame:
    """Intervals over which a condition held on every sample for at least ``span_s``."""
    runs = islands(df, keys, [F.col(o) for o in order], cond, limit)
    return runs.groupBy(*keys, "island").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), rows().alias("samples")) \
        .where((F.unix_micros("end") - F.unix_micros("start")) >= span_s * 1_000_000)


def ingest_lag(df: DataFrame, keys: Sequence[str], as_of=None, ts="ts", limit_s: float = 120.0) -> DataFrame:
    """Seconds since the last sample of each key and whether that is too long."""
    end = F.unix_micros(as_of_column(df, ts, as_of))
    return df.groupBy(*keys).agg(F.max(ts).alias("last")) \
        .withColumn("lag_s", (end - F.unix_micros("last")) / 1e6).withColumn("late", F.col("lag_s") > limit_s)


def export_status(summary: DataFrame, written_at, as_of, max_age_h: float = 26.0, min_events: int = 1) -> DataFrame:
    """Freshness and minimum event count of an export summary (resource, count)."""
    events = F.coalesce(F.max(F.when(F.col("resource") == "events", F.col("count"))), F.lit(0))
    age = (F.unix_micros(_c(as_of)) - F.unix_micros(_c(written_at))) / 3.6e9
    out = summary.agg(events.alias("events")).withColumn("age_h", age)
    problems = F.array_compact(F.array(F.when(F.col("age_h") > max_age_h, F.lit("stale")),
                                       F.when(F.col("events") < min_events, F.lit("few_events"))))
    return out.withColumn("problems", F.array_join(problems, ",")).withColumn("ok", F.col("problems") == "")
