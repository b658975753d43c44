"""Sinks: point stores, JSON, CSV, metric text, report lines, log and notification rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.functions.scalars import flatten
from pulsegrid.scale import as_of_column


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_points(df: DataFrame, measurement, tags: dict, fields: dict, time, text_fields: dict | None = None) -> DataFrame:
    """Rows as points; ``tags`` and ``fields`` map names to columns."""
    def mapping(cols, kind):
        if not cols:
            return F.create_map().cast(f"map<string,{kind}>")
        full = F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), _c(c).cast(kind))])
        return F.map_filter(full, lambda k, v: v.isNotNull())

    m = F.lit(measurement) if isinstance(measurement, str) else measurement
    return df.select(m.alias("measurement"), mapping(tags, "string").alias("tags"),
                     mapping(fields, "double").alias("fields"),
                     mapping(text_fields, "string").alias("text_fields"), _c(time).alias("time"))


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Write points partitioned by measurement and date, sorted by time within files.

    The rebalance hint lets AQE split a crowded measurement over many files and merge
    the small ones.
    """
    (points.withColumn("date", F.to_date("time")).hint("rebalance", "measurement", "date")
     .sortWithinPartitions("measurement", "date", "time")
     .write.mode(mode).partitionBy("measurement", "date").parquet(path))


def labels_to_tags(df: DataFrame, labels="labels", tags="tags") -> DataFrame:
    """Labels join the tags under a ``label_`` prefix."""
    extra = F.transform_keys(labels, lambda k, v: F.concat(F.lit("label_"), k))
    clash = F.map_filter(tags, lambda k, v: ~F.map_contains_key(extra, k))
    return df.withColumn(tags, F.map_concat(clash, extra))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_summary(dfs: dict[str, DataFrame]) -> DataFrame:
    """(resource, count) per frame, sorted by resource."""
    return totals(dfs).orderBy("resource")


def totals(dfs: dict[str, DataFrame]) -> DataFrame:
    """Row count of each frame."""
    out = None
    for name, d in dfs.items():
        one = d.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("resource"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Flattened records with a header; columns are the union of all keys."""
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def _escape(c) -> Column:
    return F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def prom_lines(totals_df: DataFrame, tops: dict[str, DataFrame], window: str, at=None,
               prefix: str = "export", n: int = 3) -> DataFrame:
    """Metric text lines: run time, a total per resource, and the top ``n`` of each list
    (frames with name, count) with rank labels.  ``ord`` and ``seq`` give the line order."""
    def ordered(df, ordinal, line, seq=F.lit(0)):
        return df.select(F.lit(ordinal).alias("ord"), seq.cast("long").alias("seq"), line.alias("line"))

    one = totals_df.sparkSession.range(1)
    out = ordered(one, 0, F.lit(f"# TYPE {prefix}_run_timestamp_seconds gauge"))
    if at is not None:
        out = out.unionByName(ordered(one, 1, F.format_string(
            f"{prefix}_run_timestamp_seconds %s", F.unix_seconds(_c(at)).cast("string"))))
    out = out.unionByName(ordered(one, 2, F.lit(f"# TYPE {prefix}_total gauge")))
    out = out.unionByName(ordered(totals_df, 3, F.format_string(
        f'{prefix}_total{{resource="%s",window="{window}"}} %d', _escape("resource"), F.col("count")),
        F.crc32(F.col("resource").cast("binary"))))
    for i, (label, df) in enumerate(tops.items()):
        top = top_rank(df, n)
        out = out.unionByName(ordered(top, 4 + i, F.format_string(
            f'{prefix}_top_{label}_count{{rank="%d",{label}="%s",window="{window}"}} %d',
            F.col("rank"), _escape("name"), F.col("count")), F.col("rank")))
    return out


def top_rank(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest counts with their rank; ties go by name."""
    from pyspark.sql import Window

    best = df.orderBy(F.desc("count"), "name").limit(n)
    return best.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "name")))


def write_prom(lines: DataFrame, path: str) -> None:
    """The lines, in order, as one small text file; the report is bounded by its lists."""
    lines.orderBy("ord", "seq").coalesce(1).select("line").write.mode("overwrite").text(path)


def report_lines(title: str, sections: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Markdown lines of a report; each section is (heading, frame of name, value, seq).

    A section without rows says so.
    """
    spark = sections[0][1].sparkSession
    one = spark.range(1)
    out = one.select(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("seq"), F.lit(f"# {title}").alias("line"))
    for i, (head, df) in enumerate(sections, start=1):
        out = out.unionByName(one.select(F.lit(2 * i).alias("ord"), F.lit(0).cast("long").alias("seq"),
                                         F.lit(f"## {head}").alias("line")))
        out = out.unionByName(df.select(
            F.lit(2 * i + 1).alias("ord"), F.col("seq").cast("long").alias("seq"),
            F.concat(F.lit("- "), "name", F.lit(": "), F.col("value").cast("string")).alias("line")))
        n = df.agg(F.count(F.lit(1))).scalar()
        out = out.unionByName(one.where(n == 0).select(
            F.lit(2 * i + 1).alias("ord"), F.lit(0).cast("long").alias("seq"), F.lit("- (no data)").alias("line")))
    return out


def to_log_rows(df: DataFrame, labels: dict, ts="ts", body: Sequence[str] | None = None) -> DataFrame:
    """Log push rows: label map, nanosecond time as text, JSON line."""
    cols = body or [c for c in df.columns if c != ts]
    stream = F.create_map(*[x for k, v in labels.items()
                            for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))])
    return df.select(stream.alias("stream"), (F.unix_micros(ts) * 1000).cast("string").alias("ts_ns"),
                     F.to_json(F.struct(*cols)).alias("line"))


# Retention in days by class of result.
RETENTION_DAYS = {"predictions": 30, "anomalies": 90, "model_performance": 365}


def apply_retention(df: DataFrame, days: int, as_of=None, ts="time") -> DataFrame:
    """Rows not older than ``days``."""
    end = as_of_column(df, ts, as_of)
    return df.where(F.col(ts) >= F.timestamp_micros(F.unix_micros(end) - days * 86_400_000_000))


MANIFEST = "version BIGINT, folder STRING, columns STRING, n_rows BIGINT"


def _versions(spark: SparkSession, path: str) -> list:
    """The newest line of a table's manifest, or none."""
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return lines.orderBy(F.desc("version")).limit(1).collect()


def rebuild_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` and return it.

    The rows are staged in a folder of their own, and only when that is whole does the table's
    manifest get a line that names it.  So a rebuild that fails leaves the rows that were there,
    and who reads the table meanwhile goes on reading the version it began with.  One rebuild at a time."""
    spark, last = df.sparkSession, _versions(df.sparkSession, path)
    version = last[0].version + 1 if last else 0
    folder = f"rows/{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    n = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    line = spark.createDataFrame([(version, folder, df.schema.json(), n)], MANIFEST)
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return current_table(spark, path)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the table that :func:`rebuild_table` keeps at ``path``."""
    last = _versions(spark, path)
    if not last:
        raise ValueError(f"no table at {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(last[0].columns))).parquet(f"{path}/{last[0].folder}")


# Priority mark per channel and severity, colour per severity.
PRIORITY = {
    "slack": {"critical": "<!channel>", "high": "<!here>", "medium": "", "low": "", "info": ""},
    "email": {"critical": "High", "high": "High", "medium": "Normal", "low": "Low", "info": "Low"},
}
COLOUR = {"critical": "danger", "high": "warning", "medium": "warning", "low": "good", "info": "good"}


def _lookup(table: dict, key: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def notification_rows(alerts: DataFrame, channels: Sequence[str] = ("slack", "email")) -> DataFrame:
    """Outbox rows: one per alert and channel with subject, body, priority and colour."""
    sev = F.col("severity")
    out = alerts.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    prio = F.lit("")
    for ch in channels:
        prio = F.when(F.col("channel") == ch, _lookup(PRIORITY.get(ch, {"": ""}), sev, "")).otherwise(prio)
    at = F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss")
    return out.select(
        "alert_id", "channel", sev.alias("severity"),
        F.when(F.col("channel") == "email", F.format_string("[%s] %s", F.upper(sev), F.col("title")))
        .otherwise(F.format_string("%s alert: %s", sev, F.col("title"))).alias("subject"),
        F.format_string("%s of rule %s is %s against %s since %s", F.col("metric"), F.col("rule_id"),
                        F.col("value").cast("string"), F.col("threshold").cast("string"), at).alias("body"),
        prio.alias("priority"), _lookup(COLOUR, sev, "warning").alias("colour"))


def digest(findings: DataFrame, severity="severity", kind="kind") -> DataFrame:
    """One row over many findings: counts and the worst severity."""
    s = F.col(severity)
    return findings.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"),
        F.count_if(s == "warning").alias("warning"), F.count_distinct(kind).alias("kinds"),
        F.max_by(s, _lookup_rank(s)).alias("worst"))


# How grave each severity is.
SEVERITY_RANK = {"info": 0, "low": 1, "normal": 1, "medium": 2, "warning": 3, "high": 4, "critical": 5}


def _lookup_rank(s: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.element_at(m, s), F.lit(0))
