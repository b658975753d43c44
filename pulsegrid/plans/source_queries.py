"""Queries for sources and sinks; written outputs go to a new folder and are read back."""

from pyspark.sql import functions as F

from pulsegrid.plans.registry import NODE_SQL, PTS, Tables, query, r6, us
from pulsegrid.session import scratch_path
from pulsegrid.sources import readers as R, sinks as K


def event_points(t: Tables):
    return K.to_points(t.points, F.col("metric"), {"host": "host", "device": "device"},
                       {"value": "value", "user_id": "user_id"}, "ts")


def stored(t: Tables) -> str:
    path = scratch_path(t.spark, "points")
    K.write_points(event_points(t), path)
    return path


def quoted(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


@query("s01_read_metrics", f"""WITH {PTS} SELECT epoch_us(ts) AS time_us, host, value FROM pts
WHERE metric = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def _(t):
    return R.read_metrics(t.spark, stored(t), "click", 7 * 86400, fields=["value"], tags=["host"]) \
        .select(us("time").alias("time_us"), "host", "value")


@query("s02_read_first_nonempty", f"WITH {PTS} SELECT event_id, metric, value FROM pts")
def _(t):
    p = t.points.select("event_id", "metric", "value")
    return R.read_first_nonempty([p.where("value < 0"), p, p.where("metric = 'click'")])


def vector_bodies(t: Tables):
    """Events as query-API responses; errors come back as failed queries."""
    body = F.concat(
        F.lit('{"status":"'), F.when(F.col("metric") == "error", "error").otherwise("success"),
        F.lit('","data":{"result":[{"metric":{"__name__":"'), "metric", F.lit('","host":"'), "host",
        F.lit('"},"value":['), F.unix_seconds("ts").cast("string"), F.lit(',"'),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")), F.lit('"]}]}}'))
    return t.points.select("event_id", body.alias("body"))


@query("s03_parse_vector_json", f"""WITH {PTS} SELECT event_id, metric AS name, host, epoch_us(ts) // 1000000 AS ts_s, value FROM pts
WHERE metric <> 'error' AND event_id % 11 <> 0""")
def _(t):
    return R.parse_vector_json(vector_bodies(t)).select(
        "event_id", "name", F.element_at("labels", F.lit("host")).alias("host"),
        F.unix_seconds("ts").alias("ts_s"), "value")


def exposition(t: Tables):
    """Events as exposition lines, with comments, blanks and unreadable numbers among them."""
    labels = F.concat(F.lit('{host="'), "host", F.lit('", device="'), "device", F.lit('"}'))
    e = F.col("event_id") % 13
    return t.points.select("event_id", F.when(e == 0, F.concat(F.lit("# HELP "), "metric")).when(e == 1, "  ")
                           .when(e == 2, F.concat("metric", F.lit(" oops")))
                           .when(e == 3, F.concat("metric", F.lit(" "), F.col("value").cast("string")))
                           .otherwise(F.concat("metric", F.replace(labels, F.lit(" "), F.lit("")), F.lit(" "),
                                               F.col("value").cast("string"))).alias("line"))


@query("s04_parse_exposition", f"""WITH {PTS} SELECT event_id, metric AS name, CASE WHEN event_id % 13 > 3 THEN host END AS host,
 CASE WHEN event_id % 13 > 3 THEN 2 ELSE 0 END::INT AS label_count, value FROM pts WHERE event_id % 13 > 2""")
def _(t):
    return R.parse_exposition(exposition(t)).select(
        "event_id", "name", F.element_at("labels", F.lit("host")).alias("host"),
        F.size("labels").alias("label_count"), "value")


@query("s05_parse_labels", f"""WITH {PTS} SELECT event_id, host, device, metric AS a, 2::INT AS n_extra FROM pts""")
def _(t):
    text = F.concat(F.lit('{a="old", host = "'), "host", F.lit('",device='), "device", F.lit(',junk,a="'), "metric",
                    F.lit('",x="1=2",y=""}'))
    m = t.points.withColumn("m", R.parse_labels(text))
    return m.select("event_id", F.element_at("m", F.lit("host")).alias("host"),
                    F.element_at("m", F.lit("device")).alias("device"), F.element_at("m", F.lit("a")).alias("a"),
                    (F.when(F.element_at("m", F.lit("x")) == "1=2", 1).otherwise(0)
                     + F.when(F.element_at("m", F.lit("y")) == "", 1).otherwise(0)).alias("n_extra"))


def network_events(t: Tables):
    """Events as controller records in JSON."""
    ssid = F.when(F.col("value") > 50, F.col("metric"))
    return t.points.select("event_id", F.to_json(F.struct(
        F.concat(F.lit("e"), "event_id").alias("_id"), F.unix_millis("ts").alias("time"),
        F.upper("device").alias("user"), F.upper("host").alias("ap"), ssid.alias("ssid"),
        F.lit("guest").alias("essid"), F.col("metric").alias("key"))).alias("data"))


@query("s06_read_export", """SELECT c_custkey, c_name AS hostname, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "export")
    c = t.read("customer").select(
        F.floor(F.col("c_custkey") / 200).alias("g"),
        F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("hostname"),
                           F.col("c_mktsegment").alias("segment"))).alias("j"))
    s = t.read("supplier").select(F.to_json(F.struct(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("hostname"))).alias("j"),
        F.floor(F.col("s_suppkey") / 200).alias("g"))

    def documents(d, head, tail):
        return d.groupBy("g").agg(F.concat(F.lit(head), F.array_join(F.collect_list("j"), ",\n"), F.lit(tail)).alias("value"))

    docs = documents(c, "[", "]").unionByName(documents(s, '{"meta":{},"data":[', "]}"))
    # one document per file, as the controller writes them
    docs.drop("g").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_export(t.spark, path).select(F.from_json(
        "data", "id BIGINT, hostname STRING, segment STRING").alias("o")) \
        .select(F.col("o.id").alias("c_custkey"), "o.hostname", "o.segment")


@query("s07_raw_resource", f"""WITH {PTS} SELECT CASE WHEN event_id % 3 = 0 THEN 'e' || event_id WHEN event_id % 3 = 1 THEN host ELSE metric END AS id,
 CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 ELSE -1 END AS ts_ms, event_id FROM pts""")
def _(t):
    i = F.col("event_id") % 3
    data = F.to_json(F.struct(
        F.when(i == 0, F.concat(F.lit("e"), "event_id")).when(i == 1, "").alias("_id"),
        F.when(i == 1, F.col("event_id")).alias("id"), F.when(i == 1, F.col("host")).alias("mac"),
        F.col("metric").alias("name"), F.when(i == 0, F.unix_millis("ts")).alias("time")))
    return R.raw_resource(t.points.select("event_id", data.alias("data")), "events", keep=("event_id",)) \
        .select("event_id", "id", F.coalesce("ts_ms", F.lit(-1)).alias("ts_ms"))


@query("s08_fetch_events", """WITH m AS (SELECT max(epoch_us(ts) // 1000) AS e FROM events)
SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events, m WHERE epoch_us(ts) // 1000 BETWEEN e - 20 * 86400000 AND e - 86400000
ORDER BY 2 DESC, 1 DESC LIMIT 2000""")
def _(t):
    e = t.events.select("event_id", F.unix_millis("ts").alias("ts_ms"))
    end = e.agg(F.max("ts_ms")).scalar()
    return R.fetch_events(e, end - 20 * 86400000, end - 86400000, tie=("event_id",))


@query("s09_read_logs", """SELECT 'chat' AS job, 'local' AS host, md5(line) AS line_md5, TRUE AS has_path
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations)""")
def _(t):
    path = scratch_path(t.spark, "logs")
    t.read("conversations").select(F.col("text").alias("value")).write.text(path)
    return R.read_logs(t.spark, path + "/*.txt", {"job": "chat", "host": "local"}).select(
        "job", "host", F.md5("line").alias("line_md5"), F.col("path").isNotNull().alias("has_path"))


def container_json(t: Tables):
    """Events as container stats documents."""
    n, v = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    return t.events.select("event_id", F.to_json(F.struct(
        F.struct(F.struct(v.alias("total_usage"), F.array(n, n).alias("percpu_usage")).alias("cpu_usage"),
                 (n * 100 + 5000).alias("system_cpu_usage")).alias("cpu_stats"),
        F.struct(F.struct(F.lit(0).alias("total_usage")).alias("cpu_usage"),
                 F.lit(5000).alias("system_cpu_usage")).alias("precpu_stats"),
        F.struct(v.alias("usage"), F.lit(50000).alias("limit")).alias("memory_stats"),
        F.create_map(F.lit("eth0"), F.struct(n.alias("rx_bytes"), v.alias("tx_bytes")),
                     F.lit("eth1"), F.struct(F.lit(7).cast("long").alias("rx_bytes"), F.lit(None).cast("long").alias("tx_bytes"))).alias("networks"),
        F.struct(F.array(F.struct(F.lit("Read").alias("op"), n.alias("value")),
                         F.struct(F.lit("Write").alias("op"), v.alias("value")),
                         F.struct(F.lit("Read").alias("op"), F.lit(1).cast("long").alias("value"))).alias("io_service_bytes_recursive")).alias("blkio_stats"),
    )).alias("stats"))


STATS_SQL = """cs AS (SELECT event_id, event_id AS n, round(value * 100)::BIGINT AS v FROM events)"""


@query("s10_read_container_stats", f"""WITH {STATS_SQL} SELECT event_id, round((CASE WHEN n > 0 THEN v / (n * 100.0) * 2 * 100 ELSE 0 END)::DECIMAL(20, 10), 2)::DOUBLE AS cpu_percent,
 round((v / 50000.0 * 100)::DECIMAL(20, 10), 2)::DOUBLE AS memory_percent, v AS memory_usage_bytes FROM cs""")
def _(t):
    return R.read_container_stats(container_json(t)).select("event_id", "cpu_percent", "memory_percent", "memory_usage_bytes")


@query("s11_parse_status_lines", f"""WITH {PTS} SELECT event_id, host AS name, metric AS status, 'running' AS state FROM pts WHERE event_id % 5 <> 0""")
def _(t):
    line = F.when(F.col("event_id") % 5 == 0, F.concat_ws(":", "host", "metric")) \
        .otherwise(F.concat_ws(":", "host", "metric", F.lit("running"), F.lit("rest")))
    return R.parse_status_lines(t.points.select("event_id", line.alias("line")))


def vuln_json(t: Tables):
    """Parts as scanned images with zero to two findings."""
    n = F.col("p_partkey") % 3
    one = F.struct(F.concat(F.lit("V-"), "p_partkey").alias("VulnerabilityID"), F.lit("HIGH").alias("Severity"), F.col("p_name").alias("Title"))
    two = F.struct(F.concat(F.lit("W-"), "p_partkey").alias("VulnerabilityID"),
                   F.when(F.col("p_size") > 25, "CRITICAL").otherwise("LOW").alias("Severity"), F.col("p_type").alias("Title"))
    vs = F.when(n == 1, F.array(one)).when(n == 2, F.array(one, two))
    return t.read("part").select(
        F.concat(F.lit("img"), "p_partkey").alias("image"),
        F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("Target"), vs.alias("Vulnerabilities"))).alias("Results"))).alias("report"))


VULN_SQL = """vr AS (SELECT 'img' || p_partkey AS image, p_brand AS target, NULL AS vulnerability_id, NULL AS severity FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 'img' || p_partkey, p_brand, 'V-' || p_partkey, 'HIGH' FROM part WHERE p_partkey % 3 > 0
 UNION ALL SELECT 'img' || p_partkey, p_brand, 'W-' || p_partkey, CASE WHEN p_size > 25 THEN 'CRITICAL' ELSE 'LOW' END FROM part WHERE p_partkey % 3 = 2)"""


@query("s12_read_vuln_reports", f"WITH {VULN_SQL} SELECT * FROM vr")
def _(t):
    return R.read_vuln_reports(vuln_json(t)).select("image", "target", "vulnerability_id", "severity")


@query("s13_read_targets", """SELECT 'sup' || s_suppkey AS host, 9000 + s_nationkey AS port, s_name AS job FROM supplier
UNION ALL SELECT 'bare' || s_suppkey, 0, s_name FROM supplier""")
def _(t):
    body = F.to_json(F.array(F.struct(
        F.array(F.concat(F.lit("sup"), "s_suppkey", F.lit(":"), (F.col("s_nationkey") + 9000).cast("string")),
                F.concat(F.lit("bare"), "s_suppkey")).alias("targets"),
        F.create_map(F.lit("job"), "s_name").alias("labels"))))
    return R.read_targets(t.read("supplier").select(body.alias("body"))).select(
        "host", F.coalesce("port", F.lit(0)).alias("port"), F.element_at("labels", F.lit("job")).alias("job"))


@query("s14_read_registry", """SELECT s_name AS service, 9000 + s_nationkey AS port, 'n' || s_nationkey || ',' || 'base' AS dependencies, s_nationkey AS max_retries FROM supplier""")
def _(t):
    svc = F.struct((F.col("s_nationkey") + 9000).alias("port"),
                   F.array(F.concat(F.lit("n"), "s_nationkey"), F.lit("base")).alias("dependencies"),
                   F.struct(F.col("s_nationkey").alias("max_retries")).alias("retry_policy"))
    body = F.to_json(F.struct(F.struct(F.create_map("s_name", svc).alias("services")).alias("service_registry")))
    return R.read_registry(t.read("supplier").select(body.alias("body"))).select(
        "service", "port", F.array_join("dependencies", ",").alias("dependencies"), "max_retries")


@query("s15_parse_alert_payload", f"""WITH {PTS} SELECT event_id, metric AS alertname, host, '' AS service, 'high' AS severity FROM pts WHERE value > 50""")
def _(t):
    alert = F.struct(F.when(F.col("value") > 50, "firing").otherwise("resolved").alias("status"),
                     F.create_map(F.lit("alertname"), "metric", F.lit("host"), "host", F.lit("severity"), F.lit("high")).alias("labels"))
    return R.parse_alert_payload(t.points.select("event_id", F.to_json(F.struct(F.array(alert).alias("alerts"))).alias("body"))) \
        .drop("labels")


@query("s16_read_threats", """SELECT event_id, CASE event_type WHEN 'view' THEN 'ids' WHEN 'click' THEN 'flow' ELSE 'siem' END AS source
FROM events WHERE event_type IN ('view','click','error')""")
def _(t):
    from pulsegrid.plans.scalar_queries import raw_threats
    raw = raw_threats(t)
    part = {s: raw.where(F.col("source") == s).drop("source") for s in ("ids", "flow", "siem")}
    return R.read_threats(part["ids"], part["flow"], part["siem"]).select("event_id", "source")


METRIC_NAMES_SQL = """mn AS (SELECT event_id, ts, 'h' || (user_id % 20) AS host, value,
 CASE event_type WHEN 'view' THEN 'cpu_usage' WHEN 'click' THEN 'memory_usage_total' WHEN 'purchase' THEN 'disk_usage' WHEN 'error' THEN 'network_latency' ELSE 'other' END AS metric FROM events)"""


def named_metrics(t: Tables):
    """Samples under the metric names of the default rules."""
    m = F.col("metric")
    return t.points.withColumn("metric", F.when(m == "view", "cpu_usage").when(m == "click", "memory_usage_total")
                               .when(m == "purchase", "disk_usage").when(m == "error", "network_latency").otherwise("other"))


@query("s17_rules", f"""WITH {METRIC_NAMES_SQL} SELECT metric, CASE metric WHEN 'cpu_usage' THEN 80.0 WHEN 'disk_usage' THEN 90.0 WHEN 'network_latency' THEN 100.0 END AS threshold,
 count(*) AS samples FROM mn WHERE metric IN ('cpu_usage','disk_usage','network_latency') GROUP BY metric""")
def _(t):
    rules = R.rules_df(t.spark)
    return named_metrics(t).join(F.broadcast(rules), F.col("metric") == F.col("metric_name")) \
        .groupBy("metric", "threshold").agg(F.count(F.lit(1)).alias("samples"))


# --- sinks ----------------------------------------------------------------

@query("k01_write_points", f"""WITH {PTS} SELECT metric AS measurement, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 4) AS total,
 count(DISTINCT host) AS hosts FROM pts GROUP BY ALL""")
def _(t):
    return t.spark.read.parquet(stored(t)).groupBy("measurement", F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.element_at("fields", F.lit("value"))), 4).alias("total"),
        F.count_distinct(F.element_at("tags", F.lit("host"))).alias("hosts"))


@query("k02_to_points", f"""WITH {PTS} SELECT metric AS measurement, host, CASE WHEN value > 50 THEN value END AS value, epoch_us(ts) AS time_us,
 CASE WHEN value > 50 THEN 1 ELSE 0 END::INT AS n_fields FROM pts""")
def _(t):
    p = K.to_points(t.points, F.col("metric"), {"host": "host"}, {"value": F.when(F.col("value") > 50, F.col("value"))}, "ts")
    return p.select("measurement", F.element_at("tags", F.lit("host")).alias("host"),
                    F.element_at("fields", F.lit("value")).alias("value"), us("time").alias("time_us"),
                    F.size("fields").alias("n_fields"))


@query("k03_labels_to_tags", f"WITH {PTS} SELECT event_id, metric AS m, host AS label_host, device AS label_device FROM pts")
def _(t):
    p = t.points.select("event_id", F.create_map(F.lit("m"), "metric").alias("tags"),
                        F.create_map(F.lit("host"), "host", F.lit("device"), "device").alias("labels"))
    tags = K.labels_to_tags(p)
    return tags.select("event_id", *[F.element_at("tags", F.lit(k)).alias(k) for k in ("m", "label_host", "label_device")])


@query("k04_export_summary", """SELECT 'customer' AS resource, count(*) AS count FROM customer UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "json")
    K.write_json(t.events, path)
    back = t.spark.read.schema("event_id BIGINT").json(path)
    return K.export_summary({"events": back, "customer": t.read("customer"), "supplier": t.read("supplier")})


@query("k05_write_csv", """SELECT event_id, user_id AS who_user, event_type AS who_kind, '[1,' || event_id || ']' AS list FROM events""")
def _(t):
    path = scratch_path(t.spark, "csv")
    K.write_csv(t.events.select("event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"),
                                F.array(F.lit(1).cast("long"), "event_id").alias("list")), path)
    back = t.spark.read.option("header", True).option("escape", '"') \
        .schema("event_id BIGINT, `who.user` BIGINT, `who.kind` STRING, list STRING").csv(path)
    return back.toDF("event_id", "who_user", "who_kind", "list")


def named_counts(df, col):
    return df.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("count"))


@query("k06_write_prom", f"""WITH {PTS}, top_c AS (SELECT device AS name, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, device) AS rk FROM pts GROUP BY device),
 top_s AS (SELECT metric AS name, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, metric) AS rk FROM pts GROUP BY metric)
SELECT '# TYPE export_run_timestamp_seconds gauge' AS line
UNION ALL SELECT 'export_run_timestamp_seconds ' || (epoch_us(max(ts)) // 1000000) FROM events
UNION ALL SELECT '# TYPE export_total gauge'
UNION ALL SELECT 'export_total{{resource="events",window="7d"}} ' || count(*) FROM events
UNION ALL SELECT 'export_total{{resource="customer",window="7d"}} ' || count(*) FROM customer
UNION ALL SELECT 'export_top_ssid_count{{rank="' || rk || '",ssid="' || name || '",window="7d"}} ' || c FROM top_s WHERE rk <= 3
UNION ALL SELECT 'export_top_client_count{{rank="' || rk || '",client="' || name || '",window="7d"}} ' || c FROM top_c WHERE rk <= 3""")
def _(t):
    path = scratch_path(t.spark, "prom")
    p = t.points
    lines = K.prom_lines(K.totals({"events": p, "customer": t.read("customer")}),
                         {"ssid": named_counts(p, "metric"), "client": named_counts(p, "device")}, "7d",
                         at=p.agg(F.max("ts")).scalar())
    K.write_prom(lines, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("k07_report_lines", f"""WITH {PTS}, m AS (SELECT metric, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, metric) AS rk FROM pts GROUP BY metric)
SELECT 0::INT AS ord, 0::BIGINT AS seq, '# Weekly report' AS line UNION ALL SELECT 2, 0, '## Events' UNION ALL SELECT 3, rk, '- ' || metric || ': ' || c FROM m
UNION ALL SELECT 4, 0, '## Alarms' UNION ALL SELECT 5, 0, '- (no data)'""")
def _(t):
    counts = named_counts(t.points, "metric")
    body = K.top_rank(counts, 10).select("name", F.col("count").alias("value"), F.col("rank").alias("seq"))
    return K.report_lines("Weekly report", [("Events", body), ("Alarms", body.where("value < 0"))])


@query("k08_to_log_rows", f"""WITH {PTS} SELECT (epoch_us(ts) * 1000)::VARCHAR AS ts_ns, metric AS severity, 'ops' AS job,
 '{{"event_id":' || event_id || ',"host":"' || host || '"}}' AS line FROM pts""")
def _(t):
    rows = K.to_log_rows(t.points, {"job": "ops", "severity": F.col("metric")}, body=["event_id", "host"])
    return rows.select("ts_ns", F.element_at("stream", F.lit("severity")).alias("severity"),
                       F.element_at("stream", F.lit("job")).alias("job"), "line")


@query("k09_apply_retention", """SELECT CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'week' ELSE 'month' END AS age, count(*) AS n
FROM events GROUP BY 1""")
def _(t):
    p = t.events
    week = K.apply_retention(p, 7, ts="ts").agg(F.count(F.lit(1)).alias("n")).select(F.lit("week").alias("age"), "n")
    end = p.agg(F.max("ts")).scalar()
    month = K.apply_retention(p, K.RETENTION_DAYS["predictions"], ts="ts", as_of=end)
    return week.unionByName(month.where(F.col("ts") < F.timestamp_micros(F.unix_micros(end) - 7 * 86_400_000_000))
                            .agg(F.count(F.lit(1)).alias("n")).select(F.lit("month").alias("age"), "n"))


@query("k10_rebuild_table", """SELECT c_custkey, lower(c_name) AS mac FROM customer""")
def _(t):
    path = scratch_path(t.spark, "norm")
    c = t.read("customer")
    K.rebuild_table(c.where("c_custkey < 0").select("c_custkey", F.col("c_name").alias("mac")), path)
    return K.rebuild_table(c.select("c_custkey", F.lower("c_name").alias("mac")), path)


ALERT_SQL = """al AS (SELECT event_id, 'a' || event_id AS alert_id, 'r_' || event_type AS rule_id, 'h' || (user_id % 20) AS host,
 CASE WHEN value > 70 THEN 'svc' || (user_id % 3) END AS service,
 event_type || '_' || (user_id % 20) AS metric, value, 60.0 AS threshold, ts AS first_seen,
 CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'high' WHEN value > 80 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE value > 60)"""


def alerts(t: Tables):
    """Breaches of the value limit as alerts."""
    v = F.col("value")
    return t.points.where("value > 60").select(
        "event_id", F.concat(F.lit("a"), "event_id").alias("alert_id"), F.concat(F.lit("r_"), "metric").alias("rule_id"),
        "host", F.when(v > 70, F.concat(F.lit("svc"), F.col("user_id") % 3)).alias("service"),
        F.concat("metric", F.lit("_"), F.col("user_id") % 20).alias("metric"), "value", F.lit(60.0).alias("threshold"),
        F.col("ts").alias("first_seen"), F.col("metric").alias("title"),
        F.when(v > 150, "critical").when(v > 100, "high").when(v > 80, "medium").otherwise("low").alias("severity"))


@query("k11_notification_rows", f"""WITH {ALERT_SQL} SELECT alert_id, channel, CASE WHEN channel = 'email' THEN '[' || upper(severity) || '] ' ELSE severity || ' alert: ' END || substr(rule_id, 3) AS subject,
 CASE WHEN channel = 'slack' THEN CASE severity WHEN 'critical' THEN '<!channel>' WHEN 'high' THEN '<!here>' ELSE '' END
  ELSE CASE severity WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Normal' ELSE 'Low' END END AS priority,
 CASE severity WHEN 'critical' THEN 'danger' WHEN 'low' THEN 'good' ELSE 'warning' END AS colour,
 metric || ' of rule ' || rule_id || ' is ' || value || ' against 60.0 since ' || strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS body
FROM al, (VALUES ('slack'), ('email')) c(channel)""")
def _(t):
    return K.notification_rows(alerts(t)).drop("severity")


@query("k12_digest", f"""WITH {ALERT_SQL} SELECT count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'warning') AS warning, count(DISTINCT rule_id) AS kinds, 'critical' AS worst FROM al""")
def _(t):
    return K.digest(alerts(t), kind="rule_id")
