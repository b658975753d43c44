"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalars import ellipsize


def by_time(df: DataFrame, asc: bool = True, ts="ts", tie: Sequence[str] = ()) -> DataFrame:
    cols = [ts, *tie]
    return df.orderBy(*[F.asc(c) if asc else F.desc(c) for c in cols])


def top_containers(df: DataFrame, by: str = "cpu_percent", n: int = 5, name="name") -> DataFrame:
    """Running containers with any CPU use, heaviest first."""
    return df.where((F.col("status") == "running") & (F.col("cpu_percent") > 0)).orderBy(F.desc(by), name).limit(n)


def recent(df: DataFrame, n: int = 10, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def next_tasks(df: DataFrame, n: int = 5, priority="priority", tie="name") -> DataFrame:
    return df.orderBy(F.desc(priority), tie).limit(n)


def top_insights(df: DataFrame, n: int = 3, severity="severity", tie: Sequence[str] = ("id",), text="description") -> DataFrame:
    """Critical before warning, text cut to 200 characters; other severities do not show."""
    s = F.col(severity)
    return df.where(s.isin("critical", "warning")).orderBy(F.when(s == "critical", 0).otherwise(1), *tie).limit(n) \
        .withColumn(text, ellipsize(text, 200))


def remediation_order(df: DataFrame, status="status", pos="pos") -> DataFrame:
    """FAIL before the rest, otherwise in their own order; ``step`` follows that order within each class."""
    return df.orderBy(F.when(F.col(status) == "FAIL", 0).otherwise(1), pos)


# Services that are never restarted for memory.
CRITICAL_SERVICES = ("influxdb", "grafana", "prometheus", "mysql", "vault")


def restart_candidate(df: DataFrame, critical: Sequence[str] = CRITICAL_SERVICES, name="name",
                      memory="memory_percent", over: float = 90.0) -> DataFrame:
    """The heaviest memory user over the limit, unless it is a critical service."""
    top = df.where(F.col(memory) > over).orderBy(F.desc(memory), name).limit(1)
    return top.where(~F.lower(name).rlike("|".join(critical)))


def all_findings(*dfs: DataFrame) -> DataFrame:
    """Bag union; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def concat_metric(dfs: Sequence[DataFrame], col: str) -> DataFrame:
    """One metric from every frame that has it, nulls dropped."""
    out = None
    for d in dfs:
        if col in d.columns:
            part = d.select(F.col(col).cast("double").alias(col)).dropna()
            out = part if out is None else out.unionAll(part)
    return out


def distinct_recs(df: DataFrame, recs="recommendations") -> DataFrame:
    """Distinct recommendations over all rows."""
    return df.select(F.explode(recs).alias("recommendation")).distinct()


def alerts_to_send(issues: DataFrame, sent: DataFrame, key="issue", critical="critical") -> DataFrame:
    """Critical issues always, others once: critical ∪ (issues − sent), without repeats."""
    new = issues.join(sent.select(key), key, "left_anti")
    return issues.where(F.col(critical)).select(key).unionByName(new.select(key)).distinct()
