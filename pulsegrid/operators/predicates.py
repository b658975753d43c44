"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.scale import as_of_column, join_keys, largest_group, scan


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def since(df: DataFrame, ts: str, span_s: int, as_of=None, closed: bool = True) -> DataFrame:
    """Rows newer than ``as_of - span_s``; ``closed`` keeps the boundary itself."""
    edge = F.timestamp_micros(F.unix_micros(as_of_column(df, ts, as_of)) - span_s * 1_000_000)
    return df.where(F.col(ts) >= edge if closed else F.col(ts) > edge)


def available(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist."""
    return df.select(*keep, *[c for c in features if c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as doubles; unreadable values become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that hold at least one value; one row of counts reaches the driver."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    seen = df.agg(*[F.count(F.col(c)).alias(c) for c in names]).first()
    return [c for c in names if seen[c]]


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def ffill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str],
          then: str = "bfill", limit: int | None = None) -> DataFrame:
    """Fill nulls from the row before; leading nulls from the row after (``bfill``) or zero."""
    fullest = largest_group(df, keys)
    out = scan(df, keys, [F.col(o) for o in order],
               {f"__f_{c}": ("last", F.col(c)) for c in cols}, limit, fullest)
    if then == "bfill":
        out = scan(out, keys, [F.col(o).desc() for o in order],
                   {f"__b_{c}": ("last", F.col(c)) for c in cols}, limit, fullest)
        fill = {c: F.coalesce(f"__f_{c}", f"__b_{c}") for c in cols}
    else:
        fill = {c: F.coalesce(F.col(f"__f_{c}"), F.lit(0)) for c in cols}
    return out.withColumns(fill).select(*df.columns)


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def cpu_usage(idle) -> Column:
    """100 minus idle, where a missing idle counts as zero."""
    return 100 - F.coalesce(_c(idle), F.lit(0.0))


def breaches(value, op, threshold) -> Column:
    """Threshold test with the operator in a column; equality is within 0.001 and an
    unknown operator is false."""
    v, o, t = _c(value), _c(op), _c(threshold)
    near = F.abs(v - t) < 0.001
    return F.when(o == ">", v > t).when(o == ">=", v >= t).when(o == "<", v < t) \
        .when(o == "<=", v <= t).when(o == "==", near).when(o == "!=", ~near).otherwise(F.lit(False))


def min_points(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of keys that have at least ``n`` rows."""
    enough = df.groupBy(*keys).count().where(F.col("count") >= n).drop("count")
    return join_keys(df, enough, keys, "left_semi")


def match_containers(df: DataFrame, status: str | None = None, label: str | None = None,
                     regex: str | None = None, names: str = "names") -> DataFrame:
    """Containers by state (any case), label key or ``key=value``, and a name pattern that
    one of the alternative names must contain."""
    if status:
        df = df.where(F.lower("status") == status.lower())
    if label:
        pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e.key, F.lit("="), e.value))
        df = df.where(F.map_contains_key("labels", label) | F.array_contains(pairs, label))
    if regex:
        df = df.where(F.exists(names, lambda n: F.regexp_replace(n, "^/+", "").rlike(regex)))
    return df


def match_labels(df: DataFrame, matchers: Sequence[tuple[str, str, str]], labels: str = "labels") -> DataFrame:
    """Label matchers (name, ``= != =~ !~``, value); a missing label is empty text and
    patterns are anchored at both ends."""
    for name, op, want in matchers:
        have = F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))
        hit = have == want if op in ("=", "!=") else have.rlike(f"^(?:{want})$")
        df = df.where(~hit if op in ("!=", "!~") else hit)
    return df


def log_filter(df: DataFrame, present: Sequence[str] = (), regex: str | None = None,
               keyword: str | None = None, line: str = "line", labels: str = "labels") -> DataFrame:
    """Lines whose labels are present and that match a pattern or hold a keyword."""
    for name in present:
        df = df.where(F.coalesce(F.element_at(labels, F.lit(name)), F.lit("")) != "")
    if regex:
        df = df.where(F.col(line).rlike(regex))
    if keyword:
        df = df.where(F.col(line).contains(keyword))
    return df


def data_quality(value, signal=None, age_s=None) -> Column:
    """Quality class: value first, then signal, then age; the first that speaks decides."""
    v = _c(value)
    out = F.when(v.isNull() | F.isnan(v), "invalid").when(F.abs(v) > 1e6, "low")
    if signal is not None:
        s = F.coalesce(_c(signal), F.lit(-50))
        out = out.when(s < -80, "low").when(s < -60, "medium")
    if age_s is not None:
        out = out.when(_c(age_s) > 300, "low").when(_c(age_s) > 60, "medium")
    return out.otherwise("high")


def should_propagate(labels="labels") -> Column:
    """Grave enough, not about a local instance, and about a service or job."""
    m = _c(labels)
    sev = F.lower(F.coalesce(F.element_at(m, F.lit("severity")), F.lit("")))
    local = F.coalesce(F.element_at(m, F.lit("instance")).startswith("localhost"), F.lit(False))
    return sev.isin("critical", "high", "warning") & ~local & \
        (F.map_contains_key(m, "service") | F.map_contains_key(m, "job"))


def active_critical(df: DataFrame, state="state", severity="severity") -> DataFrame:
    return df.where((F.col(state) == "active") & F.lower(severity).isin("critical", "high"))


def missing_fields(cols: Sequence[str]) -> Column:
    """Names of the required fields that are absent."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))


# Warning and critical limits in percent.
HOST_LIMITS = {"cpu": (80.0, 90.0), "memory": (85.0, 95.0), "disk": (80.0, 90.0)}


def host_issues(df: DataFrame, keep: Sequence[str] = (), limits: dict = HOST_LIMITS) -> DataFrame:
    """One row per resource at or over a limit: resource, level, value."""
    rows = [F.when(F.col(r) >= warn, F.struct(
        F.lit(r).alias("resource"), F.when(F.col(r) >= crit, "critical").otherwise("warning").alias("level"),
        F.col(r).cast("double").alias("value"))) for r, (warn, crit) in limits.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("i")).select(*keep, "i.*")


def container_issues(df: DataFrame, name="name", cpu="cpu_percent", memory="memory_percent",
                     health="health_status", status="status") -> DataFrame:
    """One row per container and problem (high_cpu, high_memory, unhealthy)."""
    def issue(kind, cond, value):
        return F.when(cond, F.struct(F.lit(kind).alias("issue"), value.cast("double").alias("value")))

    rows = F.array_compact(F.array(
        issue("high_cpu", F.col(cpu) > 80, F.col(cpu)),
        issue("high_memory", F.col(memory) > 85, F.col(memory)),
        issue("unhealthy", F.col(health).isin("unhealthy", "starting")
              | (F.coalesce(F.col(status), F.lit("")) != "running"), F.lit(None))))
    return df.where(F.coalesce(F.col(status), F.lit("")) != "error") \
        .select(name, F.explode(rows).alias("i")).select(name, "i.*")


# Limit, severity above 95 and severity otherwise, per resource.
BOTTLENECKS = {"cpu": (80.0, "high", "medium"), "memory": (85.0, "high", "medium"),
               "disk": (90.0, "critical", "high")}


def bottlenecks(df: DataFrame, keep: Sequence[str] = (), restarting: str | None = None) -> DataFrame:
    """Resources over their limit with a severity, and more than five restarting containers."""
    rows = [F.when(F.col(r) > lim, F.struct(
        F.lit(r).alias("type"), F.when(F.col(r) > 95, top).otherwise(other).alias("severity"),
        F.col(r).cast("double").alias("value"))) for r, (lim, top, other) in BOTTLENECKS.items()]
    if restarting:
        rows.append(F.when(F.col(restarting) > 5, F.struct(
            F.lit("containers").alias("type"), F.lit("high").alias("severity"),
            F.col(restarting).cast("double").alias("value"))))
    return df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("b")).select(*keep, "b.*")
