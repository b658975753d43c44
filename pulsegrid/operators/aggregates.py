"""Aggregations: device and container statistics, resampling, federation, health roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.scale import (GROUP_LIMIT, as_of_column, fold, join_keys, largest_group, newest, positions, scan)
from pulsegrid.session import cut


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


N = F.count  # short name for the counts below


def rows() -> Column:
    return F.count(F.lit(1))


# --- ranks ----------------------------------------------------------------

def value_at_rank(df: DataFrame, keys: Sequence[str], col: str, picks: dict, limit: int | None = None) -> DataFrame:
    """Values at exact ranks per key: ``picks`` maps a name to ``fn(n) -> [zero-based ranks]``,
    whose mean is taken."""
    keys = list(keys)
    d = df.where(F.col(col).isNotNull()).select(*keys, col)
    n = d.groupBy(*keys).agg(rows().alias("__n"))
    if (n.agg(F.max("__n")).first()[0] or 0) <= (GROUP_LIMIT if limit is None else limit):
        w = Window.partitionBy(*keys)
        hit = d.select(*keys, col, rows().over(w).alias("__n"),
                       (F.row_number().over(w.orderBy(col)) - 1).cast("long").alias("__pos"))
    else:
        hit = join_keys(positions(d, keys, [F.col(col)], "__pos", limit), n, keys)
    return hit.groupBy(*keys).agg(*[
        F.avg(F.when(F.array_contains(F.array(*fn(F.col("__n"))), F.col("__pos")), F.col(col))).alias(name)
        for name, fn in picks.items()])


def _middle(n: Column) -> list[Column]:
    return [F.floor((n - 1) / 2), F.floor(n / 2)]


def median(df: DataFrame, keys: Sequence[str], col: str, out: str, limit: int | None = None) -> DataFrame:
    """Exact median per key, by rank."""
    return value_at_rank(df, keys, col, {out: _middle}, limit)


def trend_of(slope: Column, n: Column, bound: float = 0.1) -> Column:
    return F.when(n < 3, "insufficient_data").when(slope > bound, "increasing") \
        .when(slope < -bound, "decreasing").otherwise("stable")


def device_stats(df: DataFrame, keys: Sequence[str] = ("device", "metric"), order: Sequence[str] = ("ts", "event_id"),
                 value="value", limit: int | None = None) -> DataFrame:
    """Count, mean, median, min, max, sample deviation (zero for one value) and trend."""
    keys = list(keys)
    fullest = largest_group(df, keys)
    p = positions(df.select(*keys, *order, value), keys, [F.col(o) for o in order], "__at", limit, fullest)
    base = [rows().alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
            F.regr_slope(F.col(value), F.col("__at").cast("double")).alias("slope")]
    if fullest <= (GROUP_LIMIT if limit is None else limit):
        out = p.groupBy(*keys).agg(*base, F.median(value).alias("median"))
    else:
        out = join_keys(p.groupBy(*keys).agg(*base), median(df, keys, value, "median", limit), keys)
    return out.withColumn("trend", trend_of(F.col("slope"), F.col("n"))).drop("slope")


def container_profile(df: DataFrame, key="host", value="value") -> DataFrame:
    """Mean, peak and spread per container, with a sizing priority."""
    avg = F.col("avg_cpu")
    return df.groupBy(key).agg(F.avg(value).alias("avg_cpu"), F.max(value).alias("max_cpu"),
                               F.stddev_samp(value).alias("volatility")) \
        .withColumn("priority", F.when(avg > 80, "high").when(avg < 10, "low").otherwise("normal"))


# --- resampling -----------------------------------------------------------

STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def resample(df: DataFrame, ts="ts", freq="hour", agg="mean", keys: Sequence[str] = ("metric",), value="value") -> DataFrame:
    """Per key and hour or day: mean (null when empty) or sum (zero when empty).

    The grid runs from each key's first to its last bucket and is built from the
    aggregated buckets, not the rows.
    """
    keys = list(keys)
    fn = F.avg if agg == "mean" else F.sum
    filled = df.groupBy(*keys, F.date_trunc(freq, ts).alias("bucket")).agg(fn(value).alias("value"))
    spine = filled.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(
        *keys, F.explode(F.sequence("lo", "hi", F.expr(STEP[freq]))).alias("bucket"))
    out = join_keys(spine, filled, keys + ["bucket"], "left")
    return out if agg == "mean" else out.withColumn("value", F.coalesce("value", F.lit(0.0)))


def hour_profile(df: DataFrame, keys: Sequence[str] = ("metric",), ts="ts", value="value") -> DataFrame:
    """Peak and low hour of day, business or off hours, mean and spread of daily means."""
    keys = list(keys)
    hourly = df.groupBy(*keys, F.date_trunc("hour", ts).alias("h")).agg(F.avg(value).alias("m"))
    of_day = hourly.groupBy(*keys, F.hour("h").alias("hour")).agg(F.avg("m").alias("m"))
    peak = of_day.groupBy(*keys).agg(
        F.max_by("hour", F.struct("m", -F.col("hour"))).alias("peak_hour"),
        F.min_by("hour", F.struct("m", "hour")).alias("low_hour"))
    daily = df.groupBy(*keys, F.date_trunc("day", ts).alias("d")).agg(F.avg(value).alias("m")) \
        .groupBy(*keys).agg(F.avg("m").alias("weekly_average"), F.stddev_samp("m").alias("day_std"))
    return join_keys(peak, daily, keys).withColumns({
        "pattern": F.when(F.col("peak_hour").between(9, 17), "business_hours").otherwise("off_hours"),
        "priority": F.when(F.col("weekly_average") > 70, "high").when(F.col("day_std") > 20, "medium").otherwise("normal")})


def traffic_growth(df: DataFrame, keys: Sequence[str] = ("metric",), ts="ts", value="value") -> DataFrame:
    """Daily totals: mean, peak and growth in percent from the first to the last day."""
    keys = list(keys)
    first, last = F.min_by("value", "bucket"), F.max_by("value", "bucket")
    return resample(df, ts, "day", "sum", keys, value).groupBy(*keys).agg(
        rows().alias("days"), F.avg("value").alias("daily_average"), F.max("value").alias("peak_day"),
        F.when(first > 0, (last - first) / first * 100).otherwise(0.0).alias("growth_pct")) \
        .where("days > 1").withColumn("priority", F.when(F.col("growth_pct") > 50, "medium").otherwise("normal"))


def recent_spike(df: DataFrame, factor: float = 2.0, keys: Sequence[str] = ("metric",), ts="ts", value="value") -> DataFrame:
    """Whether the latest day's total exceeds ``factor`` times the mean day."""
    keys = list(keys)
    return resample(df, ts, "day", "sum", keys, value).groupBy(*keys).agg(
        rows().alias("days"), F.max_by("value", "bucket").alias("recent"), F.avg("value").alias("average")) \
        .where("days > 1").withColumn("spike", F.col("recent") > F.col("average") * factor)


# --- federation -----------------------------------------------------------

def _confidence(n: int):
    return F.least(F.lit(1.0), rows() / F.lit(float(n)))


# Aggregation name -> (value, confidence); ranks are handled by federate().
AGGREGATIONS: dict = {
    "sum": (lambda v, w: F.sum(v), lambda: _confidence(5)),
    "average": (lambda v, w: F.avg(v), lambda: _confidence(3)),
    "min": (lambda v, w: F.min(v), lambda: F.lit(1.0)),
    "max": (lambda v, w: F.max(v), lambda: F.lit(1.0)),
    "count": (lambda v, w: rows().cast("double"), lambda: F.lit(1.0)),
    "weighted_average": (
        lambda v, w: F.when(F.sum(w) == 0, F.lit(0.0)).otherwise(F.sum(v * w) / F.sum(w)),
        lambda: F.when(F.sum(F.coalesce(F.col("weight"), F.lit(1.0))) == 0, F.lit(0.0)).otherwise(_confidence(3))),
}


def p95_rank(n: Column) -> list[Column]:
    """Zero-based rank floor(0.95 n), at most the last."""
    return [F.least(F.floor(F.lit(0.95) * n), n - 1)]


def federate(samples: DataFrame, rules: DataFrame, limit: int | None = None, aggregations: dict | None = None) -> DataFrame:
    """One row per metric over all nodes by the rule's method (unknown means average).

    samples: (metric, node, value, weight); rules: (metric_name, method).  ``aggregations``: those that
    rules may name, see :func:`pulsegrid.operators.registry.register_aggregation`."""
    from pulsegrid.operators.joins import with_agg_rule

    aggregations = AGGREGATIONS if aggregations is None else aggregations
    known = [*aggregations, "percentile_95"]
    method = F.when(F.col("method").isin(*known), F.col("method")).otherwise("average")
    d = with_agg_rule(samples, rules).withColumn("__m", method)
    exact = not rules.where("method = 'percentile_95'").isEmpty()
    if exact:  # read by the sums, the count of ranks and the ranks, but made once
        d = cut(d.select("metric", "method", "value", "weight", "__m"))
    v, w = F.col("value"), F.coalesce(F.col("weight"), F.lit(1.0))

    def pick(i):
        out = F.lit(None).cast("double")
        for name, fns in aggregations.items():
            out = F.when(F.first("__m") == name, fns[0](v, w) if i == 0 else fns[1]()).otherwise(out)
        return out

    agg = d.groupBy("metric", "method").agg(
        pick(0).alias("value"), pick(1).alias("confidence"), rows().alias("n"), F.first("__m").alias("__m"))
    if not exact:
        return agg.drop("__m")
    p95 = value_at_rank(d.where("__m = 'percentile_95'"), ["metric"], "value", {"__p95": p95_rank}, limit)
    ranked = F.col("__m") == "percentile_95"
    return agg.join(p95, "metric", "left").select(
        "metric", "method", F.when(ranked, F.col("__p95")).otherwise(F.col("value")).alias("value"),
        F.when(ranked, F.least(F.lit(1.0), F.col("n") / 10.0)).otherwise(F.col("confidence")).alias("confidence"), "n")


def merge_labels(samples: DataFrame, key="metric", labels="labels") -> DataFrame:
    """Labels present on every sample of a metric: the one value, or ``multiple[k]``."""
    total = samples.groupBy(key).agg(rows().alias("__n"))
    pairs = samples.select(key, F.explode(labels).alias("label", "v")).groupBy(key, "label", "v").agg(rows().alias("c"))
    merged = join_keys(pairs.groupBy(key, "label").agg(F.sum("c").alias("c"), rows().alias("k"), F.max("v").alias("v")),
                       total, [key]).where("c = __n")
    return merged.select(key, "label", F.when(F.col("k") == 1, F.col("v")).otherwise(
        F.format_string("multiple[%d]", F.col("k"))).alias("value"))


def common_keys(samples: DataFrame, key="metric", labels="labels") -> DataFrame:
    """Label keys that every sample of a metric carries."""
    total = samples.groupBy(key).agg(rows().alias("__n"))
    counts = samples.select(key, F.explode(F.map_keys(labels)).alias("label")).groupBy(key, "label").agg(rows().alias("c"))
    return join_keys(counts, total, [key]).where("c = __n").select(key, "label")


def source_nodes(samples: DataFrame, key="metric", node="node") -> DataFrame:
    """Distinct contributing nodes per metric; bounded by the number of nodes."""
    return samples.select(key, node).distinct().groupBy(key).agg(
        rows().alias("node_count"), F.array_join(F.sort_array(F.collect_list(node)), ",").alias("nodes"))


# --- health roll-ups ------------------------------------------------------

def share(cond: Column) -> Column:
    """Percentage of rows where ``cond`` holds; zero without rows."""
    return F.coalesce(F.try_divide(F.count_if(cond) * 100.0, rows()), F.lit(0.0))


def health_summary(df: DataFrame, status="health_status") -> DataFrame:
    s = F.col(status)
    return df.agg(rows().alias("total"), F.count_if(s == "healthy").alias("healthy"),
                  F.count_if(s == "warning").alias("warning"), F.count_if(s == "critical").alias("critical"),
                  share(s == "healthy").alias("health_pct"))


def breakdown(df: DataFrame, col: str, domain: Sequence[str] | None = None) -> DataFrame:
    """Count per value; every value of ``domain`` appears, with zero if unused."""
    counts = df.groupBy(F.col(col).alias("value")).agg(rows().alias("n"))
    if domain is None:
        return counts
    all_values = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in domain])).alias("value"))
    return all_values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def node_health(checks: DataFrame, node="node", order: Sequence[str] = ("ts", "event_id"), status="status",
                response="response_time", last: int = 100, limit: int | None = None) -> DataFrame:
    """Uptime, mean positive response and latest state over each node's last checks."""
    recent = newest(checks, [node], [F.desc(o) for o in order], last, limit)
    when = F.struct(*[F.col(o) for o in order])
    return recent.groupBy(node).agg(
        share(F.col(status).isin("online", "degraded")).alias("uptime_pct"),
        F.coalesce(F.avg(F.when(F.col(response) > 0, F.col(response))), F.lit(0.0)).alias("avg_response"),
        F.max_by(status, when).alias("current_status"), F.max(order[0]).alias("last_check"), rows().alias("checks"))


def edge_stats(requests: DataFrame, minutes: int = 60, as_of=None, last: int = 100,
               order: Sequence[str] = ("ts", "event_id"), limit: int | None = None) -> DataFrame:
    """Per service edge, over its last requests inside the window.

    Only requests inside the window can count, so the window filter runs before the rank:
    the newest hundred of the window are the window's part of the newest hundred."""
    end = as_of_column(requests, "ts", as_of)
    inside = requests.where(F.col("ts") > F.timestamp_micros(F.unix_micros(end) - minutes * 60_000_000))
    recent = newest(inside, ["src", "dst"], [F.desc(o) for o in order], last, limit)
    ok = F.col("success")
    return recent.groupBy("src", "dst").agg(
        rows().alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("errors"),
        share(ok).alias("success_rate"), F.round(F.avg("response_time"), 3).alias("avg_response"),
        F.max("ts").alias("last_request"))


def edge_issues(stats: DataFrame, error_limit: float = 0.1, slow_limit: float = 5.0) -> DataFrame:
    """High error rates and slow edges, graded."""
    rate = F.col("errors") / F.col("requests")
    issues = F.array_compact(F.array(
        F.when(rate > error_limit, F.struct(
            F.lit("high_error_rate").alias("type"), F.round(rate * 100, 2).alias("measured"),
            F.when(rate > 0.5, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("avg_response") > slow_limit, F.struct(
            F.lit("slow_response").alias("type"), F.col("avg_response").alias("measured"),
            F.when(F.col("avg_response") > 10, "high").otherwise("medium").alias("severity")))))
    return stats.select("src", "dst", F.explode(issues).alias("i")).select("src", "dst", "i.*")


def comm_report(requests: DataFrame, as_of=None, minutes: int = 60, issue_minutes: int = 30,
                limit: int | None = None) -> DataFrame:
    """One row: edges, requests, error rate, mean of mean responses, issues, health score."""
    end = as_of_column(requests, "ts", as_of)
    stats = edge_stats(requests, minutes, end, limit=limit)
    issues = edge_issues(edge_stats(requests, issue_minutes, end, limit=limit)).agg(rows()).scalar()
    rate = F.coalesce(F.try_divide(F.col("errors") * 100.0, F.col("total_requests")), F.lit(0.0))
    return stats.agg(rows().alias("communications"), F.coalesce(F.sum("requests"), F.lit(0)).alias("total_requests"),
                     F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
                     F.coalesce(F.avg("avg_response"), F.lit(0.0)).alias("avg_response")) \
        .select("communications", "total_requests", F.round(rate, 2).alias("error_rate"),
                F.round("avg_response", 3).alias("avg_response"), issues.alias("issues"),
                F.greatest(F.lit(0.0), 100 - rate * 10 - issues * 5).alias("health_score"))


def dependency_map(requests: DataFrame) -> DataFrame:
    """Services each service calls; bounded by the number of services."""
    return requests.select("src", "dst").distinct().groupBy("src").agg(
        F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("depends_on"))


def request_stats(requests: DataFrame, service="dst", status="status_code") -> DataFrame:
    """Requests, successes (status under 400) and success rate per service."""
    ok = F.col(status) < 400
    return requests.groupBy(service).agg(
        rows().alias("requests"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        share(ok).alias("success_rate"), F.max("ts").alias("last_request"))


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], col="value", out="running_mean",
                 limit: int | None = None) -> DataFrame:
    """Mean of all rows of the key up to and including this one."""
    d = scan(df, keys, [F.col(o) for o in order], {
        "__s": ("sum", F.col(col).cast("double")), "__c": ("sum", F.col(col).isNotNull().cast("long"))}, limit)
    return d.withColumn(out, F.try_divide(F.col("__s"), F.col("__c"))).drop("__s", "__c")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], col="value", alpha: float = 0.1, out="ema",
        limit: int | None = None) -> DataFrame:
    """Exponential moving average of non-negative values, seeded by the first non-zero one."""
    def step(pdf: pd.DataFrame, state: dict):
        x = pdf[col].to_numpy(dtype=float)
        seed = state["e"]
        res = np.zeros(len(x))
        start = 0 if seed else int(np.argmax(x != 0)) if (x != 0).any() else len(x)
        if start < len(x):
            series = x[start:] if not seed else np.concatenate([[seed], x])
            e = pd.Series(series).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            res[start:] = e if not seed else e[1:]
        return pdf.assign(**{out: res}), {"e": float(res[-1])}

    def summarise(pdf: pd.DataFrame, _):
        return {"zero": step(pdf, {"e": 0.0})[1]["e"], "one": step(pdf, {"e": 1.0})[1]["e"], "left": (1 - alpha) ** len(pdf)}

    def follow(piece: dict, state: dict) -> dict:
        if not state["e"]:
            return {"e": piece["zero"]}
        # a mean that has started fades, but not to the zero that would start it anew
        return {"e": piece["one"] + piece["left"] * (state["e"] - 1) or np.finfo(float).smallest_subnormal.item()}

    step.passes = [(summarise, follow)]
    from pyspark.sql import types as T
    return fold(df, keys, order, step, {"e": 0.0},
                T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())]), limit)


# --- network events -------------------------------------------------------

def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent non-empty values; ties go by value."""
    return df.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(F.col(col).alias("value")) \
        .agg(rows().alias("cnt")).orderBy(F.desc("cnt"), "value").limit(n)


def alarm_key(key, type_, subsystem, category, msg) -> Column:
    """First non-empty of key, type, subsystem, category; else the message up to its first dot."""
    e = [F.nullif(_c(x), F.lit("")) for x in (key, type_, subsystem, category)]
    return F.coalesce(*e, F.nullif(F.substring_index(F.coalesce(_c(msg), F.lit("")), ".", 1), F.lit("")))


def top_alarms(df: DataFrame, n: int = 10) -> DataFrame:
    return top_values(df.withColumn("__k", alarm_key("key", "type", "subsystem", "category", "msg")), "__k", n)


def top_ssids_fallback(events: DataFrame, wlan: DataFrame, n: int = 10) -> DataFrame:
    """Network names by event count; when no event has one, the configured names at zero."""
    used = events.where(F.coalesce(F.col("ssid"), F.lit("")) != "").groupBy(F.col("ssid").alias("value")) \
        .agg(rows().alias("cnt"))
    seen = used.agg(rows()).scalar()
    idle = wlan.where(F.coalesce(F.col("name"), F.lit("")) != "").select(F.col("name").alias("value")).distinct() \
        .where(seen == 0).withColumn("cnt", F.lit(0).cast("long"))
    return used.unionByName(idle).orderBy(F.desc("cnt"), "value").limit(n)


def vuln_counts(findings: DataFrame, image="image") -> DataFrame:
    """High and critical findings per image, zero for clean images."""
    kept = F.col("severity").isin("HIGH", "CRITICAL")
    return findings.groupBy(image).agg(F.count_if(kept).alias("vulnerabilities"),
                                       F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def distinct_images(df: DataFrame, image="image") -> DataFrame:
    return df.where(F.trim(image) != "").select(image).distinct()


# --- metric outlooks ------------------------------------------------------

def measurement_means(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each numeric column per measurement, as (key, field, mean); all-null fields drop."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])
    return means.unpivot([key], list(cols), "field", "mean").where("mean IS NOT NULL")


def head_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, col="value",
              limit: int | None = None) -> DataFrame:
    """Mean of the first and of the last ``n`` rows per key."""
    keys = list(keys)
    d = df.where(F.col(col).isNotNull())
    head = newest(d, keys, [F.asc(o) for o in order], n, limit).groupBy(*keys).agg(F.avg(col).alias("head_mean"))
    tail = newest(d, keys, [F.desc(o) for o in order], n, limit).groupBy(*keys).agg(F.avg(col).alias("tail_mean"))
    return join_keys(head, tail, keys)


def metric_outlook(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
                   col="value", limit: int | None = None) -> DataFrame:
    """Average, population volatility, and whether the last 24 lie below the first 24."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.avg(col).alias("average"), F.stddev_pop(col).alias("volatility"))
    ht = head_tail(df, keys, order, 24, col, limit)
    return join_keys(base, ht, keys).withColumn(
        "trend", F.when(F.col("tail_mean") < F.col("head_mean"), "improving").otherwise("stable")).drop("head_mean", "tail_mean")


# --- backups --------------------------------------------------------------

def backup_metrics(ops: DataFrame) -> DataFrame:
    """Duration, success flag and compression ratio of each operation."""
    return ops.withColumns({
        "duration_s": F.coalesce((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6, F.lit(0.0)),
        "success": (F.col("status") == "completed").cast("int"),
        "compression_ratio": F.when(F.col("source_size") > 0, 1 - F.col("backup_size") / F.col("source_size")).otherwise(0.0)})


def backup_stats(ops: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return ops.agg(
        rows().alias("total"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
        F.sum(F.when(F.col("backup_size") > 0, F.col("backup_size"))).alias("total_bytes"),
        F.avg((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6).alias("avg_duration_s"),
        F.max_by("end_time", F.struct("start_time", "operation_id")).alias("last_backup"))


# --- window means, label aggregation --------------------------------------

def window_mean(df: DataFrame, keys: Sequence[str], minutes: int, as_of=None, ts="ts", value="value") -> DataFrame:
    """Mean per key over the last ``minutes``."""
    end = as_of_column(df, ts, as_of)
    return df.where(F.col(ts) > F.timestamp_micros(F.unix_micros(end) - minutes * 60_000_000)) \
        .groupBy(*keys).agg(F.avg(value).alias("mean"))


def last_value(df: DataFrame, key, order: Sequence[str], col="value", out="last") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(col, F.struct(*order)).alias(out))


def agg_by(df: DataFrame, labels: Sequence[str], fn: str = "avg", value="value", cond: Column | None = None) -> DataFrame:
    """``avg by``, ``sum by``, ``count by`` (rows where ``cond``) or ``ratio by`` in percent."""
    v = F.col(value)
    cond = F.lit(True) if cond is None else cond
    how = {"avg": lambda: F.avg(v), "sum": lambda: F.sum(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
           "count": lambda: F.count_if(cond), "ratio": lambda: share(cond)}[fn]()
    return df.groupBy(*labels).agg(how.alias("value"))


# --- summaries ------------------------------------------------------------

def insight_summary(df: DataFrame, severity="severity", kind="kind") -> DataFrame:
    s = F.col(severity)
    return df.agg(rows().alias("total_insights"), F.count_if(s == "critical").alias("critical_insights"),
                  F.count_if(s == "warning").alias("warning_insights"), F.count_distinct(kind).alias("kinds"))


def overall_health(failing: Column, critical: Column) -> Column:
    """Four levels from failing services and critical alerts."""
    f, c = _c(failing), _c(critical)
    return F.when((f == 0) & (c == 0), "healthy").when((f <= 2) & (c == 0), "degraded") \
        .when((f <= 5) & (c <= 2), "impaired").otherwise("critical")


def host_status(critical, warning, memory, disk, unhealthy) -> Column:
    """Host colour; a later rule overrides an earlier one: full disks and unhealthy
    containers turn even red into yellow."""
    crit, warn = _c(critical) > 0, _c(warning) > 0
    return F.when((_c(disk) >= 90) | (_c(unhealthy) > 0), "YELLOW") \
        .when(crit | (_c(memory) >= 95), "RED").when(warn, "YELLOW").otherwise("GREEN")


def service_status(df: DataFrame, keys: Sequence[str] = (), state="state", health="health") -> DataFrame:
    """Healthy and failing counts; only stopped or unhealthy containers fail."""
    bad = (F.col(state) != "running") | (F.coalesce(F.col(health), F.lit("")) == "unhealthy")
    return df.groupBy(*keys).agg(F.count_if(~bad).alias("healthy"), F.count_if(bad).alias("failing"))


def failing_services(df: DataFrame, name="name", state="state", health="health") -> DataFrame:
    """Failing containers with the reason."""
    bad = (F.col(state) != "running") | (F.coalesce(F.col(health), F.lit("")) == "unhealthy")
    return df.where(bad).select(name, F.when(F.col(state) != "running", F.col(state)).otherwise("unhealthy").alias("reason"))


def check_counts(df: DataFrame, status="status") -> DataFrame:
    s = F.col(status)
    return df.agg(F.count_if(s == "PASS").alias("passed"), F.count_if(s == "WARN").alias("warned"),
                  F.count_if(s == "FAIL").alias("failed"),
                  F.coalesce(F.floor(F.try_divide(F.count_if(s == "PASS") * 100, rows())), F.lit(0)).alias("pass_rate"))


def discovery_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("alive").alias("alive_devices"), rows().alias("total_devices"),
                  share(F.col("alive")).alias("availability_pct"), F.avg("security_score").alias("avg_security_score"))


def intelligence_summary(df: DataFrame) -> DataFrame:
    return df.agg(rows().alias("metrics_analyzed"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
                  F.count_if(F.col("classification").startswith("trending")).alias("trending"))


def findings_report(findings: DataFrame, severity="severity", kind="type") -> DataFrame:
    """Overall health from the worst finding, and the distinct kinds to act on."""
    s = F.col(severity)
    return findings.agg(rows().alias("findings"), F.count_if(s == "critical").alias("critical"),
                        F.count_if(s == "high").alias("high"),
                        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("act_on")) \
        .withColumn("system_health", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "warning")
                    .when(F.col("findings") > 0, "needs_attention").otherwise("good"))


def up_share(df: DataFrame, job="job", value="value") -> DataFrame:
    """Targets up, total and percent per job and overall."""
    up = F.col(value) == 1
    return df.rollup(job).agg(F.grouping(job).alias("__all"), F.count_if(up).alias("up"), rows().alias("total"),
                              share(up).alias("pct")) \
        .select(F.when(F.col("__all") == 1, "overall").otherwise(F.col(job)).alias(job), "up", "total", "pct")


def device_performance(df: DataFrame, key: str, ms: str, slow_ms: float = 5000.0) -> DataFrame:
    """Slow flag per device and its slow probes."""
    slow = F.col(ms) > slow_ms
    return df.groupBy(key).agg((F.max(ms) > slow_ms).alias("slow"), F.count_if(slow).alias("slow_probes"),
                               rows().alias("probes"))
