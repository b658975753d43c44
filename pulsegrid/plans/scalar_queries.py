"""Queries for the scalar functions."""

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.plans.registry import PTS, Tables, query, r6, us

EDGE = """edge AS (SELECT event_id, ts, 'd' || user_id AS device_id, value,
 CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'motion' WHEN 'purchase' THEN 'energy'
  WHEN 'error' THEN 'latency' ELSE 'failed_login_attempts' END AS metric_name,
 -(user_id % 100) AS signal, event_id % 400 AS age_s FROM events)"""


def edge(t: Tables):
    """Events as device readings: each event type stands for one sensor metric."""
    e = F.col("event_type")
    return t.events.select(
        "event_id", "ts", F.concat(F.lit("d"), F.col("user_id")).alias("device_id"), "value",
        F.when(e == "view", "temperature").when(e == "click", "motion").when(e == "purchase", "energy")
        .when(e == "error", "latency").otherwise("failed_login_attempts").alias("metric_name"),
        (-(F.col("user_id") % 100)).alias("signal"), (F.col("event_id") % 400).alias("age_s"))


@query("f01_parse_time", f"""WITH m AS (SELECT max(ts) AS a FROM events)
SELECT event_id, epoch_us(CASE event_type
 WHEN 'view' THEN a - (user_id % 50 + 1) * INTERVAL 1 MINUTE
 WHEN 'click' THEN a - (user_id % 30 + 1) * INTERVAL 1 HOUR
 WHEN 'purchase' THEN make_timestamp(epoch_us(ts) // 1000000 * 1000000)
 WHEN 'signup' THEN make_timestamp(epoch_us(ts) // 1000 * 1000)
 ELSE date_trunc('second', ts) END) AS parsed_us
FROM events, m""")
def _(t):
    e, ev = F.col("event_type"), t.events
    text = F.when(e == "view", F.concat(F.col("user_id") % 50 + 1, F.lit("m"))) \
        .when(e == "click", F.concat(F.col("user_id") % 30 + 1, F.lit("h"))) \
        .when(e == "purchase", F.unix_seconds("ts").cast("string")) \
        .when(e == "signup", F.unix_millis("ts").cast("string")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    newest = ev.agg(F.max("ts")).scalar()
    return ev.select("event_id", us(S.parse_time(text, newest)).alias("parsed_us"))


@query("f02_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def _(t):
    return t.events.select("event_id", S.epoch_ms("ts").alias("ts_ms"))


@query("f03_calendar", """SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week,
 (isodow(ts) >= 6)::INT AS is_weekend FROM events""")
def _(t):
    return S.calendar(t.events).select("event_id", "hour", "day_of_week", "is_weekend")


@query("f04_future_grid", """SELECT event_type AS metric, epoch_us(max(ts)) + i * 3600000000 AS at_us
FROM events, generate_series(1, 24) g(i) GROUP BY event_type, i""")
def _(t):
    return t.points.groupBy("metric").agg(F.max("ts").alias("last")) \
        .select("metric", F.explode(S.future_grid("last", 24)).alias("at")) \
        .select("metric", us("at").alias("at_us"))


@query("f05_uptime", """WITH m AS (SELECT max(ts) AS a FROM events)
SELECT event_id, CASE WHEN event_type <> 'error' THEN round((epoch_us(a) - epoch_us(ts)) / 1e6, 6) END AS uptime_s
FROM events, m""")
def _(t):
    ev = t.events
    started = F.when(F.col("event_type") == "error", "0001-01-01T00:00:00Z") \
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return ev.select("event_id", r6(S.uptime_s(started, ev.agg(F.max("ts")).scalar())).alias("uptime_s"))


@query("f06_first_nonempty", """SELECT c_custkey, lower(coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_mktsegment END), ''),
 nullif(trim(c_name), ''), 'unknown')) AS name FROM customer""")
def _(t):
    return t.read("customer").select("c_custkey", S.first_nonempty(
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment")), "c_name",
        lower=True, default="unknown").alias("name"))


@query("f07_metric_family", """SELECT event_id, event_type AS family FROM events""")
def _(t):
    return t.points.select("event_id", S.metric_family(F.concat_ws("_", "metric", "host", F.lit("total"))).alias("family"))


@query("f08_contains_any", """SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'the ')
 OR contains(lower(text), 'password')) AS hit FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", S.contains_any("text", ("license", "the ", "password")).alias("hit"))


@query("f09_ellipsize", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short,
 substr(text, 1, 50) AS tag FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", S.ellipsize("text").alias("short"), S.tag_text("text").alias("tag"))


@query("f10_alert_fingerprint", f"""WITH {PTS} SELECT event_id, md5('alertname=' || metric || '|instance=' || host ||
 CASE WHEN value > 50 THEN '|service=' || device ELSE '' END) AS fingerprint FROM pts""")
def _(t):
    labels = F.map_concat(
        F.create_map(F.lit("alertname"), "metric", F.lit("instance"), "host", F.lit("zone"), "device"),
        F.when(F.col("value") > 50, F.create_map(F.lit("service"), F.col("device")))
        .otherwise(F.create_map().cast("map<string,string>")))
    return t.points.select("event_id", S.alert_fingerprint(labels).alias("fingerprint"))


@query("f11_short_id", "SELECT event_id, substr(md5(event_id::VARCHAR), 1, 8) AS id8 FROM events")
def _(t):
    return t.events.select("event_id", S.short_id("event_id").alias("id8"))


@query("f12_checksum", """SELECT doc_id, sha256(text) AS checksum, lang <> 'fr' AS ok FROM documents""")
def _(t):
    expected = F.when(F.col("lang") == "fr", F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return t.read("documents").select("doc_id", S.checksum("text").alias("checksum"),
                                      S.checksum_ok("text", expected).alias("ok"))


@query("f13_container_cpu", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice,2) AS price,
 round(CASE WHEN l_extendedprice - 20000 > 0 THEN l_quantity / (l_extendedprice - 20000) * (l_linenumber % 4) * 100.0 ELSE 0 END, 6) AS cpu,
 round(CASE WHEN l_extendedprice - 20000 > 0 AND l_quantity - 10 > 0 THEN (l_quantity - 10) / (l_extendedprice - 20000) * greatest(l_linenumber % 4, 1) * 100.0 END, 6) AS cpu_strict
FROM lineitem""")
def _(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"),
        r6(S.container_cpu("l_quantity", F.lit(0), "l_extendedprice", F.lit(20000), F.col("l_linenumber") % 4)).alias("cpu"),
        r6(S.container_cpu("l_quantity", F.lit(10), "l_extendedprice", F.lit(20000), F.col("l_linenumber") % 4,
                           strict=True)).alias("cpu_strict"))


@query("f14_pct", """SELECT o_orderkey, round(CASE WHEN o_custkey > 0 THEN o_totalprice / o_custkey * 100.0 ELSE 0 END, 4) AS pct FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.pct("o_totalprice", "o_custkey", 4).alias("pct"))


@query("f15_comfort", """SELECT event_id, CASE WHEN value BETWEEN 68 AND 72 THEN 'optimal' WHEN value BETWEEN 65 AND 75 THEN 'comfortable'
 WHEN value BETWEEN 60 AND 80 THEN 'acceptable' ELSE 'uncomfortable' END AS level FROM events""")
def _(t):
    return t.events.select("event_id", S.comfort("value").alias("level"))


@query("f16_temp_efficiency", """SELECT event_id, round(greatest(0.0, 1.0 - abs(value - 70) / 20), 6) AS eff FROM events""")
def _(t):
    return t.events.select("event_id", r6(S.temp_efficiency("value")).alias("eff"))


@query("f17_motion_level", """SELECT event_id, CASE WHEN NOT value > 5 THEN 'none' WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'high'
 WHEN hour(ts) BETWEEN 6 AND 8 OR hour(ts) BETWEEN 17 AND 19 THEN 'low' ELSE 'medium' END AS level,
 (hour(ts) < 6 OR hour(ts) > 22) AS unusual FROM events""")
def _(t):
    return t.events.select("event_id", S.motion_level(F.col("value") - 5, "ts").alias("level"),
                           S.unusual_hour("ts").alias("unusual"))


@query("f18_energy", """SELECT event_id, CASE WHEN v < 100 THEN 'excellent' WHEN v < 500 THEN 'good' WHEN v < 1000 THEN 'fair' ELSE 'poor' END AS rating,
 round(v / 1000 * 0.12, 6) AS cost FROM (SELECT event_id, value * 10 AS v FROM events)""")
def _(t):
    return t.events.select("event_id", (F.col("value") * 10).alias("v")).select(
        "event_id", S.energy_rating("v").alias("rating"), r6(S.energy_cost("v")).alias("cost"))


@query("f19_network_rating", """SELECT event_id, CASE event_type
 WHEN 'view' THEN CASE WHEN value < 10 THEN 'excellent' WHEN value < 50 THEN 'good' WHEN value < 100 THEN 'fair' ELSE 'poor' END
 WHEN 'click' THEN CASE WHEN value > 100 THEN 'excellent' WHEN value > 50 THEN 'good' WHEN value > 10 THEN 'fair' ELSE 'poor' END
 WHEN 'error' THEN CASE WHEN value < 1 THEN 'excellent' WHEN value < 3 THEN 'good' WHEN value < 5 THEN 'fair' ELSE 'poor' END
 ELSE 'unknown' END AS rating FROM events""")
def _(t):
    e = F.col("event_type")
    m = F.when(e == "view", "latency").when(e == "click", "throughput").when(e == "error", "packet_loss").otherwise(e)
    return t.events.select("event_id", S.network_rating(m, "value").alias("rating"))


@query("f20_risk_level", """SELECT event_id, CASE WHEN value > 10 THEN 'critical' WHEN value > 5 THEN 'high' WHEN value > 1 THEN 'medium' ELSE 'low' END AS risk FROM events""")
def _(t):
    return t.events.select("event_id", S.risk_level("value").alias("risk"))


PROCESSED_SQL = f"""WITH {EDGE} SELECT event_id,
 CASE metric_name WHEN 'temperature' THEN 'temperature' WHEN 'motion' THEN 'motion' WHEN 'energy' THEN 'energy' WHEN 'latency' THEN 'network' ELSE 'security' END AS metric_class,
 CASE metric_name
  WHEN 'temperature' THEN CASE WHEN value BETWEEN 68 AND 72 THEN 'optimal' WHEN value BETWEEN 65 AND 75 THEN 'comfortable' WHEN value BETWEEN 60 AND 80 THEN 'acceptable' ELSE 'uncomfortable' END
  WHEN 'motion' THEN CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'high' WHEN hour(ts) BETWEEN 6 AND 8 OR hour(ts) BETWEEN 17 AND 19 THEN 'low' ELSE 'medium' END
  WHEN 'energy' THEN CASE WHEN value < 100 THEN 'excellent' WHEN value < 500 THEN 'good' WHEN value < 1000 THEN 'fair' ELSE 'poor' END
  WHEN 'latency' THEN CASE WHEN value < 10 THEN 'excellent' WHEN value < 50 THEN 'good' WHEN value < 100 THEN 'fair' ELSE 'poor' END
  ELSE CASE WHEN value > 10 THEN 'critical' WHEN value > 5 THEN 'high' WHEN value > 1 THEN 'medium' ELSE 'low' END END AS rating,
 round(CASE metric_name WHEN 'temperature' THEN greatest(0.0, 1.0 - abs(value - 70) / 20) WHEN 'energy' THEN value / 1000 * 0.12 ELSE value END, 6) AS score,
 CASE WHEN metric_name = 'temperature' AND value > 85 THEN 'critical:temperature_high' WHEN metric_name = 'temperature' AND value < 45 THEN 'warning:temperature_low'
  WHEN metric_name = 'motion' AND (hour(ts) < 6 OR hour(ts) > 22) THEN 'warning:motion_at_night' ELSE '' END AS alerts,
 CASE WHEN metric_name = 'motion' THEN 'lights_on,security_recording' WHEN metric_name = 'failed_login_attempts' AND value > 5 THEN 'block_ip_temporarily' ELSE '' END AS triggers,
 CASE WHEN metric_name = 'latency' AND value > 100 THEN 'high_latency' WHEN metric_name = 'failed_login_attempts' AND value > 5 THEN 'brute_force_attack' ELSE '' END AS suggestions
FROM edge"""


def processed_text(df):
    """Processed readings with their arrays as text."""
    return S.process_points(df).select(
        "event_id", "metric_class", "rating", r6("score").alias("score"),
        F.array_join(F.transform("alerts", lambda a: F.concat_ws(":", a.level, a.code)), ",").alias("alerts"),
        F.array_join("triggers", ",").alias("triggers"), F.array_join("suggestions", ",").alias("suggestions"))


@query("f21_process_points", PROCESSED_SQL)
def _(t):
    return processed_text(edge(t))


PORTS = (554, 1883, 8883, 80, 502, 22, 443, 9999)
CAPS = ("rtsp_streaming", "web_server", "mqtt_communication")
PORT_SQL = """dv AS (SELECT event_id, user_id, value, ts, event_type,
 [[554,1883,8883,80,502,22,443,9999][user_id % 8 + 1], [554,1883,8883,80,502,22,443,9999][event_id % 8 + 1]] AS ports,
 CASE event_id % 4 WHEN 3 THEN [] ELSE [['rtsp_streaming','web_server','mqtt_communication'][event_id % 4 + 1]] END AS caps FROM events)"""


def devices(t: Tables):
    """Events as scanned devices: two open ports and at most one capability."""
    ports = F.array(*[F.lit(p) for p in PORTS])
    caps = F.array(*[F.lit(c) for c in CAPS])
    pick = (F.col("event_id") % 4).cast("int")
    return t.events.select(
        "event_id", "user_id", "value", "ts", "event_type",
        F.array(F.get(ports, (F.col("user_id") % 8).cast("int")),
                F.get(ports, (F.col("event_id") % 8).cast("int"))).alias("open_ports"),
        F.when(pick == 3, F.array().cast("array<string>")).otherwise(F.array(F.get(caps, pick))).alias("capabilities"))


DTYPE_SQL = """CASE WHEN list_contains(ports, 554) OR list_contains(caps, 'rtsp_streaming') THEN 'camera'
 WHEN list_contains(ports, 1883) OR list_contains(ports, 8883) THEN 'sensor'
 WHEN list_contains(caps, 'web_server') AND list_contains(ports, 80) THEN 'smart_switch'
 WHEN list_contains(ports, 502) THEN 'sensor' ELSE 'unknown' END"""


@query("f22_device_type", f"WITH {PORT_SQL} SELECT event_id, {DTYPE_SQL} AS device_type FROM dv")
def _(t):
    return devices(t).select("event_id", S.device_type("open_ports", "capabilities").alias("device_type"))


MAKER_SQL = """CASE WHEN list_contains(ports, 9999) THEN 'TP-Link' WHEN list_contains(ports, 554) THEN 'Hikvision'
 WHEN list_contains(ports, 443) THEN 'Nest' WHEN list_contains(ports, 80) THEN 'Philips Hue'
 WHEN list_contains(ports, 22) THEN 'Raspberry Pi' END"""


@query("f23_manufacturer", f"WITH {PORT_SQL} SELECT event_id, {MAKER_SQL} AS maker FROM dv")
def _(t):
    return devices(t).select("event_id", S.manufacturer("open_ports").alias("maker"))


@query("f24_is_edge_node", """SELECT p_partkey, (regexp_matches(lower(p_name), 'raspberry|pi|edge|compute') OR lower(p_brand) IN ('raspberry','nvidia','intel')
 OR regexp_matches(lower(p_type), 'raspberry|pi|edge|compute')) AS edge FROM part""")
def _(t):
    return t.read("part").select("p_partkey", (
        S.is_edge_node("p_name", "p_brand") | S.is_edge_node("p_type", F.lit(None).cast("string"))).alias("edge"))


@query("f25_device_security", f"""WITH {PORT_SQL}, x AS (SELECT event_id, value > 60 AS a,
 list_contains(caps, 'mqtt_communication') AND list_contains(ports, 1883) AS b, event_type = 'error' AS c FROM dv)
SELECT event_id, (100 - a::INT * 30 - b::INT * 20 - c::INT * 15)::INT AS security_score,
 concat_ws(',', CASE WHEN a THEN 'default_credentials' END, CASE WHEN b THEN 'unencrypted_mqtt' END, CASE WHEN c THEN 'weak_protocols' END) AS vulnerabilities FROM x""")
def _(t):
    return S.device_security(devices(t).withColumns({
        "default_login": F.col("value") > 60, "weak_protocols": F.col("event_type") == "error"})) \
        .select("event_id", "security_score", F.array_join("vulnerabilities", ",").alias("vulnerabilities"))


@query("f26_device_performance", """SELECT 'd' || user_id AS device, max(value * 25) > 5000 AS slow, count(*) FILTER (value * 25 > 5000) AS slow_probes,
 count(*) AS probes FROM events GROUP BY user_id""")
def _(t):
    from pulsegrid.operators.aggregates import device_performance
    return device_performance(t.points.withColumn("response_ms", F.col("value") * 25), "device", "response_ms")


THREAT = """th AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'ids' WHEN 'click' THEN 'flow' WHEN 'error' THEN 'siem' ELSE 'other' END AS source,
 CASE event_type WHEN 'view' THEN (ARRAY['exploit attempt','port scan','sql attack','benign ping'])[event_id % 4 + 1]
  WHEN 'error' THEN (ARRAY['malware found','login anomaly','data breach','policy note'])[event_id % 4 + 1] END AS signature,
 (user_id % 4)::INT AS sev, (user_id % 18)::INT AS lvl, '10.0.0.' || (user_id % 250) AS src, '10.1.0.' || (event_id % 250) AS dst FROM events),
 tn AS (SELECT *, CASE source WHEN 'ids' THEN least(sev / 3.0, 1.0) WHEN 'flow' THEN 0.7 WHEN 'siem' THEN least(lvl / 15.0, 1.0) ELSE 0.5 END AS confidence FROM th),
 ts2 AS (SELECT *, CASE WHEN regexp_matches(coalesce(signature, ''), 'exploit|backdoor|trojan|malware') THEN 'critical'
  WHEN confidence > 0.8 OR regexp_matches(coalesce(signature, ''), 'attack|intrusion|breach') THEN 'high'
  WHEN confidence > 0.5 OR regexp_matches(coalesce(signature, ''), 'suspicious|anomaly|scan') THEN 'medium' ELSE 'low' END AS severity FROM tn)"""


def raw_threats(t: Tables):
    """Events as raw JSON of three security sources and one unknown."""
    e, i = F.col("event_type"), (F.col("event_id") % 4).cast("int")
    ids_words = F.array(*[F.lit(w) for w in ("exploit attempt", "port scan", "sql attack", "benign ping")])
    siem_words = F.array(*[F.lit(w) for w in ("malware found", "login anomaly", "data breach", "policy note")])
    src = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    dst = F.concat(F.lit("10.1.0."), F.col("event_id") % 250)
    ids = F.to_json(F.struct(src.alias("src_ip"), dst.alias("dest_ip"), F.struct(
        F.get(ids_words, i).alias("signature"), (F.col("user_id") % 4).cast("int").alias("severity")).alias("alert")))
    flow = F.to_json(F.struct(src.alias("id.orig_h"), dst.alias("id.resp_h"), F.lit("conn").alias("_path")))
    siem = F.to_json(F.struct(
        F.struct(F.get(siem_words, i).alias("description"), (F.col("user_id") % 18).cast("int").alias("level")).alias("rule"),
        F.struct(src.alias("srcip")).alias("data")))
    return t.events.select(
        "event_id", "ts",
        F.when(e == "view", "ids").when(e == "click", "flow").when(e == "error", "siem").otherwise("other").alias("source"),
        F.when(e == "view", ids).when(e == "click", flow).when(e == "error", siem).otherwise(F.lit("{}")).alias("raw"))


@query("f27_normalize_threat", f"""WITH {THREAT} SELECT event_id, source,
 CASE source WHEN 'ids' THEN 'ids_alert' WHEN 'flow' THEN 'network_analysis' WHEN 'siem' THEN 'siem_alert' ELSE 'unknown' END AS event_kind,
 CASE WHEN source <> 'other' THEN src END AS source_ip, CASE WHEN source IN ('ids','flow') THEN dst END AS dest_ip,
 signature, round(confidence, 6) AS confidence FROM tn""")
def _(t):
    from pulsegrid.sources.readers import normalize_threat
    return normalize_threat(raw_threats(t)).select(
        "event_id", "source", "event_kind", "source_ip", "dest_ip", "signature", r6("confidence").alias("confidence"))


@query("f28_threat_severity", f"WITH {THREAT} SELECT event_id, severity FROM ts2")
def _(t):
    from pulsegrid.sources.readers import normalize_threat
    return normalize_threat(raw_threats(t)).select("event_id", S.threat_severity("signature", "confidence").alias("severity"))


@query("f29_threat_actions", f"""WITH {THREAT} SELECT event_id, severity IN ('high','critical') AS notify,
 CASE severity WHEN 'critical' THEN 'block_ip>' || coalesce(sip, '') || ',isolate_host>' || coalesce(dip, '') || ',investigate>' || coalesce(sip, '')
 WHEN 'high' THEN 'monitor_ip>' || coalesce(sip, '') || ',investigate>' || coalesce(sip, '') WHEN 'medium' THEN 'investigate>' || coalesce(sip, '') ELSE '' END AS actions
FROM (SELECT *, CASE WHEN source <> 'other' THEN src END AS sip, CASE WHEN source IN ('ids','flow') THEN dst END AS dip FROM ts2)""")
def _(t):
    from pulsegrid.sources.readers import normalize_threat
    n = normalize_threat(raw_threats(t)).withColumn("severity", S.threat_severity("signature", "confidence"))
    return n.select("event_id", S.notify_threat("severity").alias("notify"), F.array_join(F.transform(
        S.threat_actions("severity", "source_ip", "dest_ip"),
        lambda a: F.concat(a.type, F.lit(">"), F.coalesce(a.target, F.lit("")))), ",").alias("actions"))


@query("f30_propose_action", """SELECT event_id, kind, confidence, target FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'restart_service' WHEN 'click' THEN 'scale_resources'
 WHEN 'purchase' THEN 'memory_cleanup' WHEN 'error' THEN 'disk_cleanup' ELSE 'investigate' END AS kind,
 CASE event_type WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.6 WHEN 'purchase' THEN 0.7 WHEN 'error' THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence,
 CASE event_type WHEN 'view' THEN CASE WHEN value > 50 THEN 'web' ELSE 'h' || (user_id % 20) END ELSE 'h' || (user_id % 20) END AS target FROM events)""")
def _(t):
    m = F.col("metric")
    name = F.when(m == "view", "HostDown").when(m == "click", "HighCPU").when(m == "purchase", "MemoryHigh") \
        .when(m == "error", "DiskFull").otherwise("Oddity")
    p = t.points.withColumn("p", S.propose_action(name, "host", F.when(F.col("value") > 50, "web").otherwise("")))
    return p.select("event_id", F.col("p.type").alias("kind"), F.col("p.target").alias("target"),
                    F.col("p.confidence").alias("confidence"))


SERVICE = """sv AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'exited' WHEN 1 THEN 'paused' ELSE 'running' END AS status,
 CASE user_id % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'unhealthy' END AS health, event_type = 'error' AS restarting,
 value AS usage, 100.0 AS lim, (user_id % 9)::INT AS restarts FROM events),
 sh AS (SELECT *, usage / lim * 100 AS mem,
  CASE WHEN status = 'exited' THEN 'critical' WHEN status = 'paused' THEN 'warning' WHEN restarts > 5 THEN 'warning'
  WHEN usage / lim * 100 > 95 THEN 'critical' WHEN usage / lim * 100 > 85 THEN 'warning' WHEN health = 'unhealthy' THEN 'critical'
  WHEN health IS NULL AND restarting THEN 'warning' ELSE 'healthy' END AS health_status FROM sv)"""


def services(t: Tables):
    return t.events.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, "exited").when(F.col("event_id") % 10 == 1, "paused").otherwise("running").alias("status"),
        F.when(F.col("user_id") % 3 == 0, "healthy").when(F.col("user_id") % 3 == 1, "unhealthy").alias("health"),
        (F.col("event_type") == "error").alias("restarting"), F.col("value").alias("mem_usage"),
        F.lit(100.0).alias("mem_limit"), (F.col("user_id") % 9).cast("int").alias("restart_count"))


@query("f31_service_health", f"""WITH {SERVICE} SELECT event_id, health_status, CASE WHEN status = 'exited' THEN 1 WHEN status = 'paused' THEN 1 ELSE
 coalesce((health = 'unhealthy')::INT, 0) + (health IS NULL AND restarting)::INT + (mem > 85)::INT + (restarts > 5)::INT END::INT AS issue_count FROM sh""")
def _(t):
    return S.service_health(services(t)).select("event_id", "health_status", F.size("issues").alias("issue_count"))


@query("f32_health_score", f"""WITH {SERVICE} SELECT event_id, CASE health_status WHEN 'healthy' THEN 100 WHEN 'warning' THEN 50 ELSE 0 END::INT AS score FROM sh""")
def _(t):
    return S.service_health(services(t)).select("event_id", S.health_score("health_status").alias("score"))


@query("f33_recovery_plan", f"""WITH {SERVICE} SELECT event_id, CASE WHEN status = 'exited' THEN 'start' WHEN status = 'paused' THEN 'none'
 WHEN health = 'unhealthy' THEN 'restart' WHEN mem > 85 THEN 'restart_for_memory' WHEN health IS NULL AND restarting THEN 'force_restart' ELSE 'none' END AS plan FROM sh""")
def _(t):
    return S.service_health(services(t)).select("event_id", S.recovery_plan("issues").alias("plan"))


@query("f34_recommendations", """SELECT event_id, CASE event_type WHEN 'view' THEN 'profile_cpu_hogs,look_for_runaway_process,add_cpu_capacity'
 WHEN 'click' THEN 'look_for_leak,review_memory_limits,recycle_heavy_services' WHEN 'error' THEN 'free_disk_space,review_retention,add_storage' ELSE '' END AS anomaly,
 CASE event_type WHEN 'view' THEN 'plan_cpu_scaling,rebalance_workload' WHEN 'click' THEN 'plan_memory_upgrade,rebalance_memory'
 WHEN 'error' THEN 'extend_or_archive,set_lifecycle_rules' ELSE '' END AS capacity,
 CASE WHEN value < 7 THEN 'immediate' WHEN value < 30 THEN 'near-term' ELSE 'planned' END AS urgency,
 CASE WHEN event_type = 'signup' THEN 3 ELSE 1 END::INT AS trend_steps FROM events""")
def _(t):
    e = F.col("event_type")
    m = F.when(e == "view", "cpu_percent").when(e == "click", "memory_percent").when(e == "error", "disk_percent") \
        .when(e == "signup", "response_time").otherwise("other")
    return t.events.select(
        "event_id", F.array_join(S.recommendations(m, "anomaly"), ",").alias("anomaly"),
        F.array_join(S.recommendations(m, "capacity"), ",").alias("capacity"),
        S.capacity_urgency("value").alias("urgency"),
        F.size(S.trend_recommendations(m, F.lit("increasing"), "value")).alias("trend_steps"))


CHECK_KEYS = ("C.docker_health.web", "C.docker_ps", "D.prom_ready", "D.prom_up_site", "E.grafana_home", "F.loki_query",
              "J.manifest_a", "L.mount_writable", "Z.other")
CHECK_SQL = """ck AS (SELECT event_id, (ARRAY['C.docker_health.web','C.docker_ps','D.prom_ready','D.prom_up_site','E.grafana_home','F.loki_query','J.manifest_a','L.mount_writable','Z.other'])[event_id % 9 + 1] AS check_key,
 CASE WHEN value < 30 THEN 'PASS' WHEN value < 70 THEN 'WARN' ELSE 'FAIL' END AS status FROM events)"""


def checks(t: Tables):
    keys = F.array(*[F.lit(k) for k in CHECK_KEYS])
    v = F.col("value")
    return t.events.select("event_id", F.get(keys, (F.col("event_id") % 9).cast("int")).alias("check_key"),
                           F.when(v < 30, "PASS").when(v < 70, "WARN").otherwise("FAIL").alias("status"))


@query("f35_root_cause", f"""WITH {CHECK_SQL}, c AS (SELECT *, CASE
 WHEN check_key LIKE 'C.docker_health%' OR (check_key = 'C.docker_ps' AND status = 'FAIL') THEN 'container unhealthy'
 WHEN check_key = 'D.prom_ready' THEN 'Prometheus down' WHEN check_key LIKE 'D.prom_up_%' THEN 'scrape target down'
 WHEN check_key LIKE 'E.grafana%' THEN 'dashboards not provisioned' WHEN check_key = 'F.loki_query' THEN 'Loki ingestion gap'
 WHEN check_key LIKE 'J.manifest%' THEN 'signing artifacts missing' WHEN check_key = 'L.mount_writable' AND status = 'FAIL' THEN 'segmentation misconfig'
 ELSE 'config drift' END AS category FROM ck WHERE status <> 'PASS'),
 d AS (SELECT *, CASE category WHEN 'Prometheus down' THEN 'high' WHEN 'config drift' THEN 'low' WHEN 'Loki ingestion gap' THEN 'low' WHEN 'signing artifacts missing' THEN 'low' ELSE 'med' END AS blast_radius FROM c)
SELECT event_id, check_key, status, category, blast_radius, CASE WHEN blast_radius IN ('high','med') AND status = 'FAIL' THEN 'high' ELSE 'medium' END AS remediation FROM d""")
def _(t):
    return S.root_cause(checks(t))


@query("f36_insight_band", """SELECT event_id, CASE WHEN -value / 100 < -0.3 THEN 'critical' ELSE 'warning' END AS severity, round(least(1.0, abs(-value / 100)), 6) AS confidence,
 CASE WHEN value > 45 THEN CASE WHEN value < 60 THEN 'warning' ELSE 'critical' END END AS growth FROM events""")
def _(t):
    sev, conf = S.insight_band(-F.col("value") / 100)
    return t.events.select("event_id", sev.alias("severity"), r6(conf).alias("confidence"),
                           S.growth_band(F.lit(30.0), "value").alias("growth"))


@query("f37_json_or_null", """SELECT event_id, (props->>'$.k')::BIGINT AS k, '{"event_id":' || event_id || ',"k":' || (props->>'$.k') || '}' AS again
FROM events WHERE event_type <> 'error'""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{oops"), F.col("props"))).otherwise(F.col("props"))
    return t.events.withColumn("p", S.json_or_null(text, "k BIGINT")).where("p IS NOT NULL") \
        .select("event_id", F.col("p.k").alias("k")).withColumn("again", F.to_json(F.struct("event_id", "k")))


@query("f38_normalize", f"""WITH {PTS} SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, device AS mac, host AS ap_mac,
 CASE WHEN value > 50 THEN metric ELSE 'guest' END AS ssid, metric AS key FROM pts""")
def _(t):
    from pulsegrid.sources.readers import normalize_events, raw_resource
    from pulsegrid.plans.source_queries import network_events
    return normalize_events(raw_resource(network_events(t), "events", keep=("event_id",))) \
        .select("event_id", "ts_ms", "mac", "ap_mac", "ssid", "key")


@query("f39_host_slug", """SELECT page_id, replace(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1), '.', '-') AS slug FROM pages""")
def _(t):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return t.read("pages").select("page_id", S.host_slug(F.concat(F.lit('"'), host, F.lit(':80"'))).alias("slug"))


@query("f40_flatten", """SELECT event_id AS id, user_id AS who_user, event_type AS what_kind, '{"v":' || (event_id % 7) || '}' AS what_deep,
 '[' || event_id || ',' || user_id || ']' AS "list" FROM events""")
def _(t):
    nested = t.events.select(
        F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("user")).alias("who"),
        F.struct(F.col("event_type").alias("kind"), F.struct((F.col("event_id") % 7).alias("v")).alias("deep")).alias("what"),
        F.array("event_id", "user_id").alias("list"))
    flat = S.flatten(nested)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])
