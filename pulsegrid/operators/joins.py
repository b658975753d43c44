"""Joins and lookups.  Rule, route and location tables are configuration; everything
that grows with the data joins on equal keys and is reduced before it is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.scalars import metric_family, short_id
from pulsegrid.scale import fold, over_range, positions, scan, small
from pulsegrid.session import cut
from pulsegrid.streaming.steps import earliest_open


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_clients(events: DataFrame, clients: DataFrame, n: int = 10, mac="mac", hostname="hostname") -> DataFrame:
    """Most active clients as ``mac (host)``.

    Events are counted per address before the join.  An address listed k times among the
    clients counts k times, as in a plain left join.
    """
    seen = events.where(F.coalesce(F.col(mac), F.lit("")) != "").groupBy(mac).agg(F.count(F.lit(1)).alias("n"))
    names = clients.groupBy(F.lower(mac).alias("__k")).agg(
        F.max(F.coalesce(F.col(hostname), F.lit(""))).alias("__host"), F.count(F.lit(1)).alias("__copies"))
    host = F.coalesce("__host", F.lit(""))
    return (seen.join(names, F.lower(mac) == F.col("__k"), "left")
            .select(F.when(host != "", F.concat(mac, F.lit(" ("), host, F.lit(")"))).otherwise(F.col(mac)).alias("label"),
                    (F.col("n") * F.coalesce("__copies", F.lit(1))).alias("cnt"))
            .orderBy(F.desc("cnt"), "label").limit(n))


def lookup_last(df: DataFrame, dim: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Left lookup of ``value``; of several rows per key the last in ``order`` wins."""
    last = dim.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(out))
    return df.join(last, key, "left")


def applicable_rules(metrics: DataFrame, rules: DataFrame, metric="metric", rule_metric="metric_name") -> DataFrame:
    """Each sample with the rules whose metric equals or begins its own.

    Every prefix of each distinct metric name is looked up by equality, so no nested loop
    over rules is needed; the resulting name-to-rule table joins back to the samples.
    """
    names = metrics.select(metric).distinct()
    prefixes = names.withColumn("__p", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(metric), F.lit(1))), lambda i: F.substr(F.col(metric), F.lit(1), i))))
    found = prefixes.join(rules, F.col("__p") == F.col(rule_metric)).drop("__p")
    return metrics.join(small(found), metric)


def with_agg_rule(samples: DataFrame, rules: DataFrame, metric="metric", rule_metric="metric_name") -> DataFrame:
    """Samples of the metrics that have an aggregation rule."""
    r = rules.withColumnRenamed(rule_metric, metric) if rule_metric != metric else rules
    return samples.join(small(r), metric)


def correlate(alerts: DataFrame, window_s: int = 300, id="alert_id", ts="first_seen", service="service",
              host="host", metric="metric", resolved: str | None = None, limit: int | None = None) -> DataFrame:
    """Correlation group of each alert.

    An alert joins the group of the earliest alert at most ``window_s`` older with its
    service, else its host, else its metric family; otherwise it starts a group named
    after itself.  ``resolved`` names the time from which an alert is no longer active (null:
    it still is) and gives its group to no other; without it all alerts stay active.

    The earliest active one is found by a sweep in order of time that keeps only alerts which
    can still be it, and that a crowded key runs in pieces at the same time; links to links are
    resolved by doubling.
    """
    kind = alerts.schema[id].dataType.simpleString()
    keys = [F.col(service), F.col(host), metric_family(metric)]
    d = alerts.select(F.col(id).alias("id"), F.unix_micros(ts).alias("us"),
                      (F.unix_micros(resolved) if resolved else F.lit(None).cast("bigint")).alias("end_us"),
                      F.posexplode(F.array(*[F.nullif(k, F.lit("")) for k in keys])).alias("kind", "key"))
    d = cut(d.where("us IS NOT NULL AND key IS NOT NULL"))
    found = fold(d, ["kind", "key"], ["us", "id"], earliest_open(window_s), {"open": [], "top": None},
                 f"id {kind}, us bigint, kind int, parent {kind}", limit)
    up = found.where("parent IS NOT NULL").groupBy("id").agg(F.min_by("parent", "kind").alias("root"), F.min("us").alias("us"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links followed as far as a batch holds them; an alert's link is to an earlier one."""
        for pdf in batches:
            pdf, root = pdf.sort_values(["us", "id"]), {}
            for i, r in zip(pdf["id"], pdf["root"]):
                root[i] = root.get(r, r)
            yield pd.DataFrame({"id": pdf["id"], "root": pd.Series(list(root.values()), index=pdf.index, dtype=pdf["root"].dtype)})

    # an alert of a group is near its link in time, so that most are followed within a batch
    links = cut(up.repartitionByRange("us", "id").sortWithinPartitions("us", "id").mapInPandas(near, f"id {kind}, root {kind}"))
    while True:
        above = links.select(F.col("id").alias("root"), F.col("root").alias("above"))
        nxt = cut(links.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        links = nxt.select("id", "root")
        if nxt.where("moved").isEmpty():
            break
    links = alerts.select(F.col(id).alias("id")).distinct().join(links, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    return alerts.join(links.select(F.col("id").alias(id), F.concat(
        F.lit("corr-"), short_id("root")).alias("correlation_group"), F.col("root").alias("group_root")), id)


# Fixed values: (source match, target match, labels that must be equal).
INHIBIT_RULES = (
    ({"alertname": "InfrastructureDown"}, {"alertname": "ServiceDown"}, ("instance",)),
    ({"alertname": "NodeDown"}, {"alertname": "(ServiceUnavailable|HighLatency|DiskSpaceWarn)"}, ("instance",)),
    ({"severity": "critical"}, {"severity": "warning"}, ("alertname", "dev", "instance")),
)


def _matches(labels: Column, want: dict) -> Column:
    out = F.lit(True)
    for k, v in want.items():
        out = out & F.coalesce(F.element_at(labels, F.lit(k)), F.lit("")).rlike(f"^(?:{v})$")
    return out


def inhibit(alerts: DataFrame, rules=INHIBIT_RULES, labels="labels") -> DataFrame:
    """Alerts that no firing source mutes.  Missing labels are equal to each other."""
    m = F.col(labels)
    out = alerts
    for source, target, equal in rules:
        vals = [F.coalesce(F.element_at(m, F.lit(k)), F.lit("")).alias(f"__e{i}") for i, k in enumerate(equal)]
        names = [f"__e{i}" for i in range(len(equal))]
        sources = alerts.where(_matches(m, source)).select(*vals).distinct().withColumn("__hit", F.lit(True))
        # an alert that is itself a source is never muted by the same rule
        is_target = _matches(m, target) & ~_matches(m, source)
        out = (out.select("*", *vals).withColumn("__t", is_target)
               .join(sources.withColumn("__t", F.lit(True)), names + ["__t"], "left")
               .where("__hit IS NULL").drop("__hit", "__t", *names))
    return out


def dependency_issues(edges: DataFrame, health: DataFrame, service="service", dep="depends_on", ok="healthy") -> DataFrame:
    """Unhealthy services: restart when every dependency is healthy, else fix those first.

    A service or dependency without a health row counts as unhealthy.  The list holds
    distinct services, so it is bounded by the size of the service graph."""
    h = health.select(F.col("name").alias("__n"), F.col(ok).alias("__ok"))
    d = (edges.select(service, dep).distinct().join(h, F.col(dep) == F.col("__n"), "left")
         .groupBy(service).agg(F.sort_array(F.collect_set(
             F.when(~F.coalesce("__ok", F.lit(False)), F.col(dep)))).alias("failed")))
    return (d.join(h, F.col(service) == F.col("__n"), "left").where(~F.coalesce("__ok", F.lit(False)))
            .select(service, F.when(F.size("failed") == 0, "restart").otherwise("fix_dependencies_first").alias("action"),
                    "failed"))


def place_backups(ops: DataFrame, locations: DataFrame, size="size", default: str = "default",
                  bound: int = 1000, margin: float = 1.2) -> DataFrame:
    """Best-priority location whose free space exceeds ``margin`` times the size.

    Up to ``bound`` locations travel as one array value.  Beyond it, operations and
    locations are ordered together by space and the best priority runs along the order.
    Locations: (location, priority, free)."""
    need = F.col(size) * margin
    if locations.limit(bound + 1).count() <= bound:
        # all locations fit one value, attached as a scalar
        table = locations.agg(F.sort_array(F.collect_list(
            F.struct("priority", "location", F.col("free").cast("double").alias("free"))))).scalar()
        fits = F.filter("__table", lambda x: x.free > need)
        return (ops.withColumn("__table", table)
                .withColumn("location", F.coalesce(F.get(fits, F.lit(0))["location"], F.lit(default))).drop("__table"))
    packed = ops.select(F.struct(*ops.columns).alias("__row"), need.cast("double").alias("__at"), F.lit(0).alias("__kind"))
    steps = locations.select(F.col("free").cast("double").alias("__at"), F.lit(1).alias("__kind"),
                             F.struct("priority", "location").alias("__loc"))
    best = scan(packed.unionByName(steps, allowMissingColumns=True).withColumn("__all", F.lit(0)), ["__all"],
                [F.desc("__at"), F.asc("__kind")], {"__best": ("min", F.col("__loc"))})
    # a null size comes after every location in the order, but fits none
    fit = F.when(F.col("__at").isNotNull(), F.col("__best.location"))
    return best.where("__kind = 0").select("__row.*", F.coalesce(fit, F.lit(default)).alias("location"))


def lag_at(df: DataFrame, keys: Sequence[str], ts: str, col: str, offset_s: int, out: str,
           limit: int | None = None) -> DataFrame:
    """The value exactly ``offset_s`` earlier, null when no row has that time."""
    off = offset_s * 1_000_000
    return over_range(df, keys, ts, offset_s, lambda w: {
        out: F.max(col).over(w.rangeBetween(-off, -off))}, limit)


def zip_series(df: DataFrame, metric: str, a: str, b: str, order: Sequence[str], value: str = "value",
               limit: int | None = None) -> DataFrame:
    """Two series side by side by position, cut to the shorter."""
    p = positions(df.where(F.col(metric).isin(a, b)), [metric], [F.col(o) for o in order], "pos", limit)
    left = p.where(F.col(metric) == a).select("pos", F.col(value).alias("a"))
    return left.join(p.where(F.col(metric) == b).select("pos", F.col(value).alias("b")), "pos")


def unseen(df: DataFrame, seen: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows whose key has not been handled yet."""
    return df.join(seen, key, "left_anti")


def resolve_alias(col, mapping: dict[str, str]) -> Column:
    """Physical name of a logical one; unknown names stay."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(col)), _c(col))


def vector_op(a: DataFrame, b: DataFrame, op: str, on: Sequence[str], value="value") -> DataFrame:
    """Arithmetic between samples with equal labels."""
    x, y = F.col("__x"), F.col("__y")
    result = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return a.select(*on, F.col(value).alias("__x")).join(b.select(*on, F.col(value).alias("__y")), list(on)) \
        .select(*on, result.alias(value))


# Routes in order (match, receiver, group wait, group interval, repeat interval in seconds).
ROUTES = (
    ({"severity": "critical"}, "critical-alerts", 30, 300, 1800),
    ({"severity": "warning"}, "warning-alerts", 120, 300, 3600),
    ({"service": "wazuh"}, "security-alerts", 60, 300, 1800),
)
DEFAULT_ROUTE = ("web.hook", 300, 300, 7200)


def route_alerts(df: DataFrame, routes=ROUTES, default=DEFAULT_ROUTE) -> DataFrame:
    """Receiver and timings of the first route whose labels match; columns carry the labels."""
    def target(r):
        return F.struct(F.lit(r[0]).alias("receiver"), F.lit(r[1]).alias("group_wait_s"),
                        F.lit(r[2]).alias("group_interval_s"), F.lit(r[3]).alias("repeat_interval_s"))

    picks = []
    for match, *rest in routes:
        cond = F.lit(True)
        for k, v in match.items():
            cond = cond & (F.coalesce(F.col(k), F.lit("")) == v)
        picks.append(F.when(cond, target(rest)))
    return df.withColumn("__r", F.coalesce(*picks, target(default))).select("*", "__r.*").drop("__r")


# What a feature name says about the services behind it.
SERVICES = {
    "cpu_percent": "all_services", "memory_percent": "memory_intensive_services",
    "disk_percent": "database_services", "network_bytes": "network_services",
    "container_cpu": "containerized_services", "response_time": "web_services",
    "error_rate": "application_services",
}


def affected_services(features, table: dict = SERVICES) -> Column:
    """Distinct service groups whose key is part of one of the feature names."""
    f = _c(features)

    def names(key):
        return F.exists(f, lambda x: F.lower(x).contains(key))

    return F.array_compact(F.array(*[F.when(names(k), F.lit(s)) for k, s in table.items()]))
