"""Scans and parsers: text, JSON and parquet inputs to typed frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.scalars import container_cpu, pct
from pulsegrid.scale import as_of_column

POINT = "measurement STRING, tags MAP<STRING,STRING>, fields MAP<STRING,DOUBLE>, text_fields MAP<STRING,STRING>, time TIMESTAMP"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _either(*cols) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


# --- metric stores --------------------------------------------------------

def read_metrics(spark: SparkSession, path: str, measurement: str, since_s: int, as_of=None,
                 fields: Sequence[str] | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """One measurement of a point store over ``[as_of - since_s, as_of]``.

    The store is partitioned by measurement and date, so the partition filter and the
    time filter both reach the scan.  Without ``as_of`` the newest time is looked for in the
    newest date alone, which the names of the partitions tell.
    """
    store = spark.read.parquet(path)
    df = store.where(F.col("measurement") == measurement)
    if as_of is None:
        day = store.agg(F.max("date")).first()[0]
        store = store.where(F.col("date") == F.lit(day).cast(store.schema["date"].dataType))
    end = as_of_column(store.select("time"), "time", as_of)
    start = F.timestamp_micros(F.unix_micros(end) - since_s * 1_000_000)
    df = df.where((F.col("time") >= start) & (F.col("date") >= F.to_date(start)) & (F.col("time") <= end))
    if fields is None:
        return df.select("time", "tags", "fields")
    return df.select("time", *[F.element_at("tags", F.lit(x)).alias(x) for x in tags],
                     *[F.element_at("fields", F.lit(f)).alias(f) for f in fields])


def read_first_nonempty(dfs: Sequence[DataFrame]) -> DataFrame:
    """All rows of the first frame in the list that has any, with the columns of all.

    Frames are probed for one row each in order, up to the first that has it; those behind are not read."""
    chosen = next((d for d in dfs if not d.isEmpty()), dfs[-1])
    columns = None
    for d in dfs:  # what is limited to no rows is not scanned, but gives its columns
        part = d if d is chosen else d.limit(0)
        columns = part if columns is None else columns.unionByName(part, allowMissingColumns=True)
    return columns


VECTOR = ("status STRING, data STRUCT<result: ARRAY<STRUCT<metric: MAP<STRING,STRING>, "
          "value: ARRAY<STRING>>>>")


def parse_vector_json(df: DataFrame, col="body") -> DataFrame:
    """Query-API responses -> samples (name, labels, ts, value); failed queries and bad
    numbers are dropped."""
    return (df.withColumn("__b", F.from_json(col, VECTOR)).where("__b.status = 'success'")
            .withColumn("__r", F.explode("__b.data.result"))
            .where(F.size("__r.value") >= 2)
            .withColumns({
                "name": F.coalesce(F.element_at("__r.metric", F.lit("__name__")), F.lit("unknown")),
                "labels": F.col("__r.metric"),
                "ts": F.timestamp_micros(F.round(F.get("__r.value", F.lit(0)).try_cast("double") * 1e6).cast("long")),
                "value": F.get("__r.value", F.lit(1)).try_cast("double")})
            .where("value IS NOT NULL AND ts IS NOT NULL").drop("__b", "__r", col))


def parse_labels(col) -> Column:
    """``{a="x",b="y"}`` -> map; a repeated key keeps its last value."""
    inner = F.regexp_replace(_c(col), r"^[{}]+|[{}]+$", "")
    pairs = F.filter(F.split(inner, ","), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"),
        F.regexp_replace(F.trim(F.substr(p, F.instr(p, F.lit("=")) + 1)), r'^"+|"+$', "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o.key == e.key))
    return F.map_from_entries(last)


def parse_exposition(df: DataFrame, col="line") -> DataFrame:
    """Metric exposition lines -> (name, labels, value); blanks, comments and bad numbers drop."""
    line = F.trim(F.col(col))
    part = F.substring_index(line, " ", 1)
    return (df.where((line != "") & ~line.startswith("#") & line.contains(" "))
            .withColumns({
                "name": F.substring_index(part, "{", 1),
                "labels": F.when(part.contains("{"), parse_labels(F.regexp_extract(part, r"(\{.*\})", 1)))
                .otherwise(F.create_map().cast("map<string,string>")),
                "value": F.substr(line, F.instr(line, F.lit(" ")) + 1).try_cast("double")})
            .where("value IS NOT NULL").drop(col))


# --- JSON exports ---------------------------------------------------------

def split_export(col) -> Column:
    """Records of an export text, a bare list or a ``{"data": [...]}`` envelope, as JSON texts."""
    c = F.trim(_c(col))
    return F.when(c.startswith("["), F.from_json(c, "ARRAY<STRING>")) \
        .otherwise(F.from_json(c, "data ARRAY<STRING>")["data"])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Export files, each one JSON document, to one row per record in ``data``."""
    return (spark.read.text(path, wholetext=True)
            .select(F.explode(split_export("value")).alias("data")))


ID_FIELDS = ("_id", "id", "mac", "user_id", "ap_mac", "name")


def raw_resource(df: DataFrame, resource: str, col="data", keep: Sequence[str] = ()) -> DataFrame:
    """(id, ts_ms, data): the first non-empty text identifier, and the time of events."""
    v = F.try_parse_json(F.col(col))

    def text(field):
        raw = F.try_variant_get(v, f"$.{field}", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        return F.when(kind == "STRING", F.nullif(raw, F.lit("")))

    when = F.try_variant_get(v, "$.time", "double").cast("long") if resource == "events" \
        else F.lit(None).cast("long")
    return df.select(*keep, F.coalesce(*[text(f) for f in ID_FIELDS]).alias("id"),
                     when.alias("ts_ms"), F.col(col).alias("data"))


def _record(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{f}` STRING" for f in fields)
    return df.where(F.try_parse_json("data").isNotNull()).withColumn("__o", F.from_json("data", schema))


def _o(name) -> Column:
    return F.col("__o").getField(name)


def normalize_clients(raw: DataFrame) -> DataFrame:
    fields = ("mac", "ip", "network", "hostname", "name", "device_name", "first_seen", "first_seen_ms",
              "last_seen", "last_seen_ms")
    return _record(raw, fields).withColumns({
        "mac": F.lower(F.coalesce(_o("mac"), F.lit(""))),
        "ip": _either(_o("ip"), _o("network")),
        "hostname": _either(_o("hostname"), _o("name"), _o("device_name")),
        "first_seen_ms": _either(_o("first_seen"), _o("first_seen_ms")).try_cast("long"),
        "last_seen_ms": _either(_o("last_seen"), _o("last_seen_ms")).try_cast("long"),
        "raw_id": F.col("id")}).drop("__o", "data", "id", "ts_ms")


def normalize_devices(raw: DataFrame) -> DataFrame:
    fields = ("mac", "name", "device_name", "hostname", "ip", "inform_ip", "model", "type", "version", "fw_caps")
    return _record(raw, fields).withColumns({
        "mac": F.lower(F.coalesce(_o("mac"), F.lit(""))),
        "name": _either(_o("name"), _o("device_name"), _o("hostname")),
        "ip": _either(_o("ip"), _o("inform_ip")),
        "model": _either(_o("model"), _o("type")),
        "version": _either(_o("version"), _o("fw_caps")),
        "raw_id": F.col("id")}).drop("__o", "data", "id", "ts_ms")


def normalize_events(raw: DataFrame) -> DataFrame:
    fields = ("time", "user", "ap", "ap_mac", "ssid", "essid", "key", "subsystem", "event")
    return _record(raw, fields).withColumns({
        "ts_ms": _o("time").try_cast("long"),
        "mac": F.lower(F.coalesce(_o("user"), F.lit(""))),
        "ap_mac": F.lower(F.coalesce(_either(_o("ap"), _o("ap_mac")), F.lit(""))),
        "ssid": _either(_o("ssid"), _o("essid")),
        "key": _either(_o("key"), _o("subsystem"), _o("event")),
        "raw_id": F.col("id")}).drop("__o", "data", "id")


def fetch_events(df: DataFrame, start_ms: int | Column | None = None, end_ms: int | Column | None = None,
                 limit: int = 2000, ts="ts_ms", tie: Sequence[str] = ()) -> DataFrame:
    """Newest ``limit`` rows within the bounds."""
    if start_ms is not None:
        df = df.where(F.col(ts) >= start_ms)
    if end_ms is not None:
        df = df.where(F.col(ts) <= end_ms)
    return df.orderBy(F.desc(ts), *[F.desc(c) for c in tie]).limit(limit)


# --- logs and containers --------------------------------------------------

def read_logs(spark: SparkSession, glob: str, labels: dict[str, str]) -> DataFrame:
    """Lines of the matching files with static labels and the file's path."""
    return spark.read.text(glob).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
        *[F.lit(v).alias(k) for k, v in labels.items()])


def stream_logs(spark: SparkSession, glob: str, labels: dict[str, str]) -> DataFrame:
    """As :func:`read_logs`, for files that keep arriving."""
    return spark.readStream.text(glob).select(
        F.col("value").alias("line"), *[F.lit(v).alias(k) for k, v in labels.items()])


CPU = "STRUCT<total_usage: BIGINT, percpu_usage: ARRAY<BIGINT>>"
STATS = f"""cpu_stats STRUCT<cpu_usage: {CPU}, system_cpu_usage: BIGINT>,
 precpu_stats STRUCT<cpu_usage: STRUCT<total_usage: BIGINT>, system_cpu_usage: BIGINT>,
 memory_stats STRUCT<usage: BIGINT, limit: BIGINT>,
 networks MAP<STRING, STRUCT<rx_bytes: BIGINT, tx_bytes: BIGINT>>,
 blkio_stats STRUCT<io_service_bytes_recursive: ARRAY<STRUCT<op: STRING, value: BIGINT>>>"""


def io_totals(stats) -> dict[str, Column]:
    """Bytes over all interfaces and by block operation of a parsed stats struct."""
    s = _c(stats)
    zero = F.lit(0).cast("long")

    def add(arr, field):
        return F.aggregate(F.coalesce(F.transform(arr, lambda x: F.coalesce(x[field], zero)),
                                      F.array().cast("array<bigint>")), zero, lambda a, x: a + x)

    net = F.map_values(s["networks"])
    blk = s["blkio_stats"]["io_service_bytes_recursive"]
    return {"network_rx_bytes": add(net, "rx_bytes"), "network_tx_bytes": add(net, "tx_bytes"),
            "block_read_bytes": add(F.filter(blk, lambda x: x.op == "Read"), "value"),
            "block_write_bytes": add(F.filter(blk, lambda x: x.op == "Write"), "value")}


def read_container_stats(df: DataFrame, col="stats", strict: bool = False) -> DataFrame:
    """Container stats JSON -> CPU and memory percent and I/O totals."""
    s = F.col("__s")
    cpu, pre = s["cpu_stats"], s["precpu_stats"]
    cores = F.size(cpu["cpu_usage"]["percpu_usage"])
    return df.withColumn("__s", F.from_json(col, STATS)).withColumns({
        "cpu_percent": F.round(container_cpu(
            cpu["cpu_usage"]["total_usage"], pre["cpu_usage"]["total_usage"],
            cpu["system_cpu_usage"], pre["system_cpu_usage"], cores, strict), 2),
        "memory_usage_bytes": F.coalesce(s["memory_stats"]["usage"], F.lit(0)),
        "memory_limit_bytes": F.coalesce(s["memory_stats"]["limit"], F.lit(0)),
        "memory_percent": pct(F.coalesce(s["memory_stats"]["usage"], F.lit(0)),
                              F.coalesce(s["memory_stats"]["limit"], F.lit(0))),
        **io_totals("__s")}).drop("__s", col)


def parse_status_lines(df: DataFrame, col="line") -> DataFrame:
    """``name:status:state`` lines; shorter ones drop."""
    p = F.split(col, ":")
    return df.where(F.size(p) >= 3).withColumns({
        "name": F.get(p, F.lit(0)), "status": F.get(p, F.lit(1)), "state": F.get(p, F.lit(2))}).drop(col)


def read_vuln_reports(df: DataFrame, col="report") -> DataFrame:
    """Image scan reports -> one row per finding; a clean image keeps one row without an id."""
    schema = ("Results ARRAY<STRUCT<Target: STRING, Vulnerabilities: ARRAY<STRUCT<VulnerabilityID: STRING, "
              "Severity: STRING, Title: STRING>>>>")
    return (df.withColumn("__r", F.explode_outer(F.from_json(col, schema)["Results"]))
            .withColumn("__v", F.explode_outer("__r.Vulnerabilities"))
            .withColumns({"target": F.col("__r.Target"), "vulnerability_id": F.col("__v.VulnerabilityID"),
                          "severity": F.col("__v.Severity"), "title": F.col("__v.Title")})
            .drop("__r", "__v", col))


def read_targets(df: DataFrame, col="body") -> DataFrame:
    """Target lists -> one row per ``host:port`` with the block's labels."""
    schema = "ARRAY<STRUCT<targets: ARRAY<STRING>, labels: MAP<STRING,STRING>>>"
    return (df.withColumn("__b", F.explode(F.from_json(col, schema)))
            .withColumn("target", F.explode("__b.targets"))
            .withColumns({"labels": F.col("__b.labels"), "host": F.split_part("target", F.lit(":"), F.lit(1)),
                          "port": F.nullif(F.split_part("target", F.lit(":"), F.lit(2)), F.lit("")).try_cast("int")})
            .drop("__b", col))


def read_registry(df: DataFrame, col="body") -> DataFrame:
    """Service registry documents -> one row per service."""
    schema = ("service_registry STRUCT<services: MAP<STRING, STRUCT<network: STRING, ip: STRING, port: INT, "
              "dependencies: ARRAY<STRING>, timeout: STRING, retry_policy: STRUCT<max_retries: INT, retry_delay: STRING>>>>")
    return (df.withColumn("__b", F.from_json(col, schema)["service_registry"]["services"])
            .select(*[c for c in df.columns if c != col], F.explode("__b").alias("service", "__s"))
            .select(*[c for c in df.columns if c != col], "service", "__s.network", "__s.ip", "__s.port",
                    "__s.dependencies", "__s.timeout", F.col("__s.retry_policy.max_retries").alias("max_retries"),
                    F.col("__s.retry_policy.retry_delay").alias("retry_delay")))


def parse_alert_payload(df: DataFrame, col="body") -> DataFrame:
    """Webhook payloads -> firing alerts."""
    schema = "alerts ARRAY<STRUCT<status: STRING, labels: MAP<STRING,STRING>, annotations: MAP<STRING,STRING>>>"

    def label(k):
        return F.coalesce(F.element_at("__a.labels", F.lit(k)), F.lit(""))

    return (df.withColumn("__a", F.explode(F.from_json(col, schema)["alerts"])).where("__a.status = 'firing'")
            .withColumns({"alertname": label("alertname"), "host": label("host"), "service": label("service"),
                          "severity": label("severity"), "labels": F.col("__a.labels")}).drop("__a", col))


def read_threats(ids: DataFrame, flow: DataFrame, siem: DataFrame) -> DataFrame:
    """Three raw JSON sources as one frame with a source mark."""
    out = ids.withColumn("source", F.lit("ids"))
    for name, d in (("flow", flow), ("siem", siem)):
        out = out.unionByName(d.withColumn("source", F.lit(name)), allowMissingColumns=True)
    return out


def normalize_threat(df: DataFrame, source="source", col="raw") -> DataFrame:
    """Source-specific JSON -> one event shape with a confidence."""
    from pulsegrid.functions.scalars import threat_confidence

    schema = ("src_ip STRING, dest_ip STRING, src_port INT, dest_port INT, proto STRING, _path STRING, "
              "alert STRUCT<signature: STRING, severity: INT>, `id.orig_h` STRING, `id.resp_h` STRING, "
              "`id.orig_p` INT, `id.resp_p` INT, rule STRUCT<description: STRING, level: INT>, "
              "data STRUCT<srcip: STRING>")
    s, j = F.col(source), F.col("__j")

    def by(ids=None, flow=None, siem=None):
        out = F.lit(None)
        for name, c in (("siem", siem), ("flow", flow), ("ids", ids)):
            if c is not None:
                out = F.when(s == name, c).otherwise(out)
        return out

    words = by(ids=j["alert"]["signature"], siem=j["rule"]["description"])
    return df.withColumn("__j", F.from_json(col, schema)).withColumns({
        "event_kind": F.when(s == "ids", "ids_alert").when(s == "flow", "network_analysis")
        .when(s == "siem", "siem_alert").otherwise("unknown"),
        "source_ip": by(j["src_ip"], j["id.orig_h"], j["data"]["srcip"]),
        "dest_ip": by(j["dest_ip"], j["id.resp_h"]),
        "source_port": by(j["src_port"], j["id.orig_p"]),
        "dest_port": by(j["dest_port"], j["id.resp_p"]),
        "protocol": by(j["proto"], j["proto"]),
        "signature": words,
        "description": by(j["alert"]["signature"], F.concat_ws(" ", F.lit("flow"), j["_path"]), j["rule"]["description"]),
        "confidence": threat_confidence(source, j["alert"]["severity"], j["rule"]["level"])}).drop("__j")


# --- configuration --------------------------------------------------------

RULE = ("rule_id STRING, name STRING, metric_name STRING, op STRING, threshold DOUBLE, severity STRING, "
        "duration_s INT, interval_s INT, dynamic BOOLEAN, suppress_s INT")

# The default alert rules.
DEFAULT_RULES = (
    ("high_cpu_usage", "High CPU Usage", "cpu_usage", ">", 80.0, "high", 300, 60, True, 300),
    ("high_memory_usage", "High Memory Usage", "memory_usage", ">", 85.0, "high", 300, 60, True, 300),
    ("disk_space_low", "Low Disk Space", "disk_usage", ">", 90.0, "critical", 60, 300, False, 300),
    ("service_down", "Service Down", "service_status", "==", 0.0, "critical", 120, 60, False, 600),
    ("high_network_latency", "High Network Latency", "network_latency", ">", 100.0, "medium", 300, 60, True, 300),
)

# How each metric is aggregated across nodes by default.
DEFAULT_AGGREGATIONS = (
    ("cpu_usage_percent", "weighted_average"), ("memory_usage_percent", "weighted_average"),
    ("disk_usage_percent", "max"), ("network_bytes_total", "sum"), ("http_requests_total", "sum"),
    ("response_time_seconds", "percentile_95"), ("error_rate", "average"), ("uptime_seconds", "min"),
)


def rules_df(spark: SparkSession, rows=DEFAULT_RULES, schema: str = RULE) -> DataFrame:
    """A configuration table; its size is the length of ``rows``."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def add_rule(rules: DataFrame, row: tuple, key: str = "rule_id") -> DataFrame:
    """Add or replace a rule: the new row wins over one with the same id."""
    new = rules.sparkSession.createDataFrame([row], rules.schema)
    return rules.join(new.select(key), key, "left_anti").select(*rules.columns).unionByName(new)
