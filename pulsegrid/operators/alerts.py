"""One alert evaluation over a history of samples: rules, thresholds, lifecycles, correlation, outbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.joins import applicable_rules, correlate
from pulsegrid.operators.predicates import breaches
from pulsegrid.operators.windows import dynamic_threshold
from pulsegrid.scale import largest_group, previous, scan
from pulsegrid.session import cut
from pulsegrid.sources.sinks import notification_rows
from pulsegrid.streaming.streams import rate_limit


def thresholds(samples: DataFrame, rules: DataFrame, ts="ts", tie="event_id", limit: int | None = None) -> DataFrame:
    """Samples with each rule that applies and the threshold it has at that time.

    The history of a dynamic rule is that of the sample's own metric over all hosts."""
    matched = applicable_rules(samples, rules)
    fixed = matched.where(~F.coalesce("dynamic", F.lit(False)))
    moving = matched.where("dynamic")
    cols = [*matched.columns, "limit_now"]
    if moving.isEmpty():
        return fixed.withColumn("limit_now", F.col("threshold")).select(cols)
    moving = dynamic_threshold(moving, ["rule_id", "metric"], ts=ts, tie=tie, limit=limit)
    return (fixed.withColumn("limit_now", F.col("threshold")).select(cols)
            .union(moving.withColumnRenamed("dynamic_threshold", "limit_now").select(cols)))


def evaluate(samples: DataFrame, rules: DataFrame, window_s: int = 300, ts="ts", tie="event_id",
             limit: int | None = None) -> DataFrame:
    """The alerts that samples (metric, host, service, ts, event_id, value) raise under ``rules``.

    A rule has one alert per host at a time (no host: ``unknown``).  It opens at the first breach, follows
    later ones with ``last_seen`` and ``value``, and is resolved by the first sample of the rule and host that
    does not breach; ``resolved_at`` is null while it is active.  A new alert joins the correlation group of
    the earliest alert of its service, host or metric family that is still active and at most
    ``window_s`` old.  Samples without value or time take no part; of samples at the same time ``tie`` tells
    which is first."""
    usable = samples.where(F.col("value").isNotNull() & F.col(ts).isNotNull() & ~F.isnan("value"))
    usable = usable.withColumn("host", F.coalesce("host", F.lit("unknown")))
    keys, us = ["rule_id", "host"], F.unix_micros(ts)
    d = thresholds(usable, rules, ts, tie, limit).select(
        *keys, "name", "severity", "metric", "service", "value", F.col("metric_name").alias("rule_metric"), F.col("limit_now").alias("threshold"),
        us.alias("us"), F.col(tie).alias("tie"), breaches("value", "op", "limit_now").alias("breach"))
    d = cut(d)  # read by the count of keys and by each pass over them
    order, fullest = [F.col("us"), F.col("tie")], largest_group(d, keys)
    d = previous(d, keys, order, {"was": "breach"}, limit, fullest)
    opens = F.col("breach") & ~F.coalesce("was", F.lit(False))
    d = scan(d.withColumn("opens", opens), keys, order, {"number": ("sum", F.col("opens").cast("long"))}, limit, fullest)
    first = lambda c: F.min_by(c, F.when(F.col("opens"), F.struct("us", "tie")))
    at = lambda c: F.timestamp_micros(c)
    found = d.where("number > 0").groupBy(*keys, "number").agg(
        first(F.col("tie")).alias("opened_by"), first(F.col("name")).alias("title"), first(F.col("severity")).alias("severity"),
        first(F.col("rule_metric")).alias("metric"), first(F.col("service")).alias("service"), first(F.col("threshold")).alias("threshold"),
        F.max_by("value", F.when(F.col("breach"), F.struct("us", "tie"))).alias("value"),
        F.min(F.when(F.col("breach"), F.col("us"))).alias("first_us"), F.max(F.when(F.col("breach"), F.col("us"))).alias("last_us"),
        F.min(F.when(~F.col("breach"), F.col("us"))).alias("resolved_us"))
    found = cut(found.select(
        F.concat(F.lit("alert-"), "rule_id", F.lit("-"), F.col("opened_by").cast("string")).alias("alert_id"), *keys, "title", "severity",
        "metric", "service", "threshold", "value", at(F.col("first_us")).alias("first_seen"), at(F.col("last_us")).alias("last_seen"),
        at(F.col("resolved_us")).alias("resolved_at")))
    return correlate(found, window_s, resolved="resolved_at", limit=limit)


def outbox(alerts: DataFrame, channels: Sequence[str] = ("slack", "email"), period_s: float = 60.0,
           limit: int | None = None) -> DataFrame:
    """The notifications of new alerts, marked whether they go out: one per channel and rule in a period."""
    rows = notification_rows(alerts, channels).join(
        alerts.select("alert_id", "rule_id", F.unix_micros("first_seen").alias("us")), "alert_id")
    return rate_limit(rows, period_s, ["channel", "rule_id"], ["us", "alert_id"], limit)
