"""Queries for predicates, joins and aggregates."""

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import aggregates as G, joins as J, predicates as P
from pulsegrid.plans.registry import NODE_SQL, PTS, REQ_SQL, Tables, query, r6, us
from pulsegrid.plans.scalar_queries import (CHECK_SQL, DTYPE_SQL, EDGE, MAKER_SQL, PORT_SQL, SERVICE, checks, devices,
                                            edge, services)
from pulsegrid.plans.source_queries import (ALERT_SQL, METRIC_NAMES_SQL, STATS_SQL, VULN_SQL, alerts, container_json,
                                            named_metrics, vuln_json)
from pulsegrid.sources import readers as R, sinks as K


# --- predicates -----------------------------------------------------------

@query("p01_since", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def _(t):
    return P.since(t.events, "ts", 86400, closed=False).select("event_id")


@query("p02_available", "SELECT event_id, value FROM events")
def _(t):
    return P.available(t.events, ["cpu_percent", "value", "memory_percent"], keep=["event_id"])


@query("p03_coerce_numeric", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS reading FROM events")
def _(t):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "value")).otherwise(F.col("value").cast("string"))
    return P.coerce_numeric(t.events.select("event_id", text.alias("reading")), ["reading"])


@query("p04_numeric_columns", "SELECT round(sum(event_id), 2) AS event_id, round(sum(user_id), 2) AS user_id, round(sum(value), 2) AS value FROM events")
def _(t):
    d = t.events.withColumn("nothing", F.lit(None).cast("double"))
    return d.agg(*[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in P.numeric_columns(d)])


@query("p05_fill_zero", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value FROM events")
def _(t):
    return P.fill_zero(t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value")), ["value"])


GAPS_SQL = f"""{PTS}, gp AS (SELECT event_id, ts, metric, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM pts)"""


def gaps(t):
    return t.points.select("event_id", "ts", "metric", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


@query("p06_ffill", f"""WITH {GAPS_SQL} SELECT event_id, metric, coalesce(
 last_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
 first_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM gp""")
def _(t):
    return P.ffill(gaps(t), ["v"], ["metric"], ["ts", "event_id"]).select("event_id", "metric", "v")


@query("p07_drop_null", f"WITH {GAPS_SQL} SELECT event_id, v FROM gp WHERE v IS NOT NULL")
def _(t):
    return P.drop_null(gaps(t), ["v"]).select("event_id", "v")


@query("p08_cpu_usage", f"WITH {GAPS_SQL} SELECT event_id, round(100 - coalesce(v, 0), 6) AS usage FROM gp")
def _(t):
    return gaps(t).select("event_id", r6(P.cpu_usage("v")).alias("usage"))


OPS = (">", ">=", "<", "<=", "==", "!=", "~")


@query("p09_breaches", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN value > 50 WHEN 1 THEN value >= 50 WHEN 2 THEN value < 50 WHEN 3 THEN value <= 50
 WHEN 4 THEN abs(value - 50) < 0.001 WHEN 5 THEN abs(value - 50) >= 0.001 ELSE FALSE END AS hit FROM events""")
def _(t):
    op = F.get(F.array(*[F.lit(o) for o in OPS]), (F.col("event_id") % 7).cast("int"))
    return t.events.select("event_id", P.breaches("value", op, F.lit(50.0)).alias("hit"))


@query("p10_min_points", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def _(t):
    return P.min_points(t.events, ["user_id"], 70).select("event_id", "user_id")


@query("p11_match_containers", """SELECT p_partkey FROM part WHERE p_size > 10 AND p_type = 'ECONOMY' AND (regexp_matches(p_name, '^red') OR regexp_matches(p_brand, '^red|#1'))""")
def _(t):
    c = t.read("part").select(
        "p_partkey", F.when(F.col("p_size") > 10, "Running").otherwise("Exited").alias("status"),
        F.create_map(F.lit("type"), "p_type").alias("labels"), F.array(F.concat(F.lit("/"), "p_name"), F.col("p_brand")).alias("names"))
    return P.match_containers(c, "running", "type=ECONOMY", "^red|#1").select("p_partkey")


def labelled(t):
    return t.points.select("event_id", "ts", "value", F.create_map(F.lit("job"), "metric", F.lit("instance"), "host").alias("labels"))


@query("p12_match_labels", f"""WITH {PTS} SELECT event_id FROM pts WHERE metric <> 'error' AND regexp_full_match(host, 'h1.*') AND NOT regexp_full_match(metric, 'pur|view') AND NOT regexp_full_match('', 'x+')""")
def _(t):
    return P.match_labels(labelled(t), [("job", "!=", "error"), ("instance", "=~", "h1.*"), ("job", "!~", "pur|view"),
                                        ("zone", "!~", "x+"), ("zone", "=", "")]).select("event_id")


@query("p13_log_filter", """SELECT conv_id, turn FROM conversations WHERE role <> '' AND regexp_matches(text, '(the|an|le) ') AND contains(text, 'e')""")
def _(t):
    logs = t.read("conversations").select("conv_id", "turn", F.col("text").alias("line"),
                                          F.create_map(F.lit("role"), "role").alias("labels"))
    return P.log_filter(logs, ["role"], "(the|an|le) ", "e").select("conv_id", "turn")


QUALITY = """CASE WHEN metric_name = 'latency' AND value > 100 THEN 'low' WHEN signal < -80 THEN 'low' WHEN signal < -60 THEN 'medium' WHEN age_s > 300 THEN 'low' WHEN age_s > 60 THEN 'medium' ELSE 'high' END"""


def extreme(d):
    return d.withColumn("raw", F.when((F.col("metric_name") == "latency") & (F.col("value") > 100), F.col("value") * 1e6)
                        .otherwise(F.col("value")))


@query("p14_data_quality", f"WITH {EDGE} SELECT event_id, {QUALITY} AS quality FROM edge")
def _(t):
    return extreme(edge(t)).select("event_id", P.data_quality("raw", "signal", "age_s").alias("quality"))


@query("p15_should_propagate", f"""WITH {ALERT_SQL} SELECT alert_id, severity IN ('critical', 'high') AND host <> 'h1' AND service IS NOT NULL AS go FROM al""")
def _(t):
    m = F.map_concat(
        F.create_map(F.lit("severity"), F.upper("severity"), F.lit("instance"),
                     F.when(F.col("host") == "h1", "localhost:1").otherwise(F.col("host"))),
        F.when(F.col("service").isNotNull(), F.create_map(F.lit("service"), F.col("service")))
        .otherwise(F.create_map().cast("map<string,string>")))
    return alerts(t).select("alert_id", P.should_propagate(m).alias("go"))


@query("p16_active_critical", f"WITH {ALERT_SQL} SELECT alert_id FROM al WHERE service IS NOT NULL AND severity IN ('critical','high')")
def _(t):
    a = alerts(t).withColumns({"state": F.when(F.col("service").isNotNull(), "active").otherwise("suppressed"),
                               "severity": F.upper("severity")})
    return P.active_critical(a).select("alert_id")


@query("p17_missing_fields", f"""WITH {GAPS_SQL} SELECT event_id, CASE WHEN v IS NULL THEN 'v' ELSE '' END AS missing FROM gp""")
def _(t):
    return gaps(t).select("event_id", F.array_join(P.missing_fields(["metric", "v"]), ",").alias("missing"))


HOSTS_SQL = """ht AS (SELECT event_id, 'h' || (user_id % 20) AS host, value AS cpu, value * 0.9 AS memory, 100 - value AS disk, user_id % 10 AS restarting FROM events)"""


def host_rows(t):
    v = F.col("value")
    return t.points.select("event_id", "host", v.alias("cpu"), (v * 0.9).alias("memory"), (100 - v).alias("disk"),
                           (F.col("user_id") % 10).alias("restarting"))


@query("p18_host_issues", f"""WITH {HOSTS_SQL} SELECT event_id, resource, level, round(v, 6) AS value FROM (
 SELECT event_id, 'cpu' AS resource, CASE WHEN cpu >= 90 THEN 'critical' WHEN cpu >= 80 THEN 'warning' END AS level, cpu AS v FROM ht
 UNION ALL SELECT event_id, 'memory', CASE WHEN memory >= 95 THEN 'critical' WHEN memory >= 85 THEN 'warning' END, memory FROM ht
 UNION ALL SELECT event_id, 'disk', CASE WHEN disk >= 90 THEN 'critical' WHEN disk >= 80 THEN 'warning' END, disk FROM ht) WHERE level IS NOT NULL""")
def _(t):
    return P.host_issues(host_rows(t), ["event_id"]).withColumn("value", r6("value"))


@query("p19_container_issues", f"""WITH {SERVICE} SELECT event_id::VARCHAR AS name, issue, value FROM (
 SELECT event_id, 'high_cpu' AS issue, usage AS value, usage > 80 AS hit FROM sv UNION ALL SELECT event_id, 'high_memory', usage / 2, usage / 2 > 85 FROM sv
 UNION ALL SELECT event_id, 'unhealthy', -1, coalesce(health = 'unhealthy', FALSE) OR status <> 'running' FROM sv) WHERE hit""")
def _(t):
    d = services(t).select(F.col("event_id").cast("string").alias("name"), F.col("mem_usage").alias("cpu_percent"),
                           (F.col("mem_usage") / 2).alias("memory_percent"), F.col("health").alias("health_status"), "status")
    return P.container_issues(d).withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("p20_bottlenecks", f"""WITH {HOSTS_SQL} SELECT event_id, type, severity, round(value, 6) AS value FROM (
 SELECT event_id, 'cpu' AS type, CASE WHEN cpu > 95 THEN 'high' ELSE 'medium' END AS severity, cpu AS value FROM ht WHERE cpu > 80
 UNION ALL SELECT event_id, 'memory', CASE WHEN memory > 95 THEN 'high' ELSE 'medium' END, memory FROM ht WHERE memory > 85
 UNION ALL SELECT event_id, 'disk', CASE WHEN disk > 95 THEN 'critical' ELSE 'high' END, disk FROM ht WHERE disk > 90
 UNION ALL SELECT event_id, 'containers', 'high', restarting FROM ht WHERE restarting > 5)""")
def _(t):
    return P.bottlenecks(host_rows(t), ["event_id"], "restarting").withColumn("value", r6("value"))


# --- joins ----------------------------------------------------------------

@query("j01_top_clients", """SELECT CASE WHEN host <> '' THEN mac || ' (' || host || ')' ELSE mac END AS label, cnt FROM (
 SELECT 'M' || e.user_id AS mac, coalesce(max(c.c_name), '') AS host, count(*) AS cnt FROM events e
 LEFT JOIN customer c ON lower('M' || e.user_id) = lower('m' || c.c_custkey) GROUP BY 1) ORDER BY cnt DESC, label LIMIT 10""")
def _(t):
    ev = t.events.select(F.concat(F.lit("M"), "user_id").alias("mac"))
    cl = t.read("customer").select(F.concat(F.lit("m"), "c_custkey").alias("mac"), F.col("c_name").alias("hostname"))
    return J.top_clients(ev, cl, 10)


@query("j02_lookup_last", """SELECT event_id, c_custkey AS last_key, c_name AS name FROM events LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer) c ON user_id % 30 = c_nationkey AND rn = 1""".replace("c_custkey AS last_key, ", ""))
def _(t):
    ev = t.events.select("event_id", (F.col("user_id") % 30).cast("int").alias("c_nationkey"))
    return J.lookup_last(ev, t.read("customer"), "c_nationkey", ["c_custkey"], "c_name", "name").select("event_id", "name")


@query("j03_applicable_rules", f"""WITH {METRIC_NAMES_SQL} SELECT event_id, metric, r.id AS rule_id FROM mn JOIN (VALUES ('high_cpu_usage','cpu_usage'),('high_memory_usage','memory_usage'),
 ('disk_space_low','disk_usage'),('service_down','service_status'),('high_network_latency','network_latency')) r(id, m) ON metric = r.m OR starts_with(metric, r.m)""")
def _(t):
    return J.applicable_rules(named_metrics(t), R.rules_df(t.spark)).select("event_id", "metric", "rule_id")


AGG_RULES = (("A", "sum"), ("N", "percentile_95"))


@query("j04_with_agg_rule", f"""WITH {NODE_SQL} SELECT metric, CASE metric WHEN 'A' THEN 'sum' ELSE 'percentile_95' END AS method, count(*) AS n FROM ns WHERE metric IN ('A','N') GROUP BY 1""")
def _(t):
    rules = R.rules_df(t.spark, AGG_RULES, "metric_name STRING, method STRING")
    return J.with_agg_rule(t.node_samples, rules).groupBy("metric", "method").agg(F.count(F.lit(1)).alias("n"))


@query("j05_correlate", f"""WITH RECURSIVE {ALERT_SQL}, w AS (SELECT alert_id, event_id, service,
 min(struct_pack(t := first_seen, id := event_id)) OVER (PARTITION BY service ORDER BY first_seen RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS ps,
 min(struct_pack(t := first_seen, id := event_id)) OVER (PARTITION BY host ORDER BY first_seen RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS ph,
 min(struct_pack(t := first_seen, id := event_id)) OVER (PARTITION BY split_part(metric, '_', 1) ORDER BY first_seen RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS pm FROM al),
 lk AS (SELECT event_id, CASE WHEN service IS NOT NULL AND ps.id <> event_id THEN ps.id WHEN ph.id <> event_id THEN ph.id WHEN pm.id <> event_id THEN pm.id ELSE event_id END AS up FROM w),
 rt AS (SELECT event_id, event_id AS root FROM lk WHERE up = event_id UNION ALL SELECT lk.event_id, rt.root FROM lk JOIN rt ON lk.up = rt.event_id WHERE lk.up <> lk.event_id)
SELECT 'a' || event_id AS alert_id, 'corr-' || substr(md5(root::VARCHAR), 1, 8) AS correlation_group FROM rt""")
def _(t):
    a = alerts(t).drop("alert_id")
    return J.correlate(a, 7200, id="event_id").select(
        F.concat(F.lit("a"), "event_id").alias("alert_id"), "correlation_group")


# alerts end after up to 49 minutes, every fifth not at all
ENDED_SQL = f"""{ALERT_SQL}, en AS (SELECT al.*, split_part(metric, '_', 1) AS family, first_seen + INTERVAL 1 MINUTE * (event_id % 50) AS ended,
 row_number() OVER (ORDER BY first_seen, event_id) AS pos FROM al)"""


@query("j05_correlate_active", f"""WITH RECURSIVE {ENDED_SQL},
 lk AS (SELECT n.event_id, coalesce(min(struct_pack(p := o.pos, id := o.event_id)) FILTER (n.service = o.service), min(struct_pack(p := o.pos, id := o.event_id)) FILTER (n.host = o.host),
  min(struct_pack(p := o.pos, id := o.event_id)) FILTER (n.family = o.family)).id AS up
  FROM en n LEFT JOIN en o ON o.pos < n.pos AND o.first_seen >= n.first_seen - INTERVAL 2 HOUR AND (o.event_id % 5 = 0 OR o.ended > n.first_seen)
   AND (o.service = n.service OR o.host = n.host OR o.family = n.family) GROUP BY n.event_id),
 rt AS (SELECT event_id, event_id AS root FROM lk WHERE up IS NULL UNION ALL SELECT lk.event_id, rt.root FROM lk JOIN rt ON lk.up = rt.event_id)
SELECT event_id, 'corr-' || substr(md5(root::VARCHAR), 1, 8) AS correlation_group FROM rt""")
def _(t):
    e = F.col("event_id")
    ended = F.timestamp_micros(F.unix_micros("first_seen") + (e % 50) * 60_000_000)
    a = alerts(t).withColumn("ended", F.when(e % 5 != 0, ended))
    return J.correlate(a, 7200, id="event_id", resolved="ended").select("event_id", "correlation_group")


# two rules follow their history, one is fixed; services by host
EVAL_SQL = f"""{METRIC_NAMES_SQL}, rl(rule_id, metric_name, lim, severity, dynamic, title) AS (VALUES ('high_cpu_usage', 'cpu_usage', 80.0, 'high', TRUE, 'High CPU Usage'),
  ('high_memory_usage', 'memory_usage', 60.0, 'critical', FALSE, 'Busy'), ('disk_space_low', 'disk_usage', 90.0, 'critical', FALSE, 'Low Disk Space'),
  ('high_network_latency', 'network_latency', 100.0, 'medium', TRUE, 'High Network Latency')),
 sm AS (SELECT rl.*, mn.* FROM mn JOIN rl ON starts_with(mn.metric, rl.metric_name)),
 hs AS (SELECT *, count(*) OVER h AS hn, avg(value) OVER h AS hm, stddev_samp(value) OVER h AS hd, avg(value) OVER f AS fm, stddev_samp(value) OVER f AS fd, row_number() OVER (PARTITION BY rule_id, metric ORDER BY ts, event_id) AS seen FROM sm
  WINDOW h AS (PARTITION BY rule_id, metric ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), f AS (PARTITION BY rule_id, metric ORDER BY ts, event_id ROWS 49 PRECEDING)),
 br AS (SELECT *, value > threshold AS hit FROM (SELECT *, CASE WHEN NOT dynamic OR seen < 20 THEN lim ELSE greatest(lim, CASE WHEN hn >= 10 THEN hm + 2 * coalesce(hd, 0) ELSE fm + 2 * coalesce(fd, 0) END) END AS threshold FROM hs)),
 op AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER w, FALSE) AS opens FROM br WINDOW w AS (PARTITION BY rule_id, host ORDER BY ts, event_id)),
 nu AS (SELECT *, sum(opens::INT) OVER (PARTITION BY rule_id, host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM op),
 av AS (SELECT 'alert-' || rule_id || '-' || min(event_id) FILTER (opens) AS alert_id, rule_id, host, any_value(title) AS title, any_value(severity) AS severity, any_value(metric_name) AS metric,
  CASE WHEN host IN ('h1', 'h2', 'h3') THEN 'web' END AS service, min(threshold) FILTER (opens) AS threshold, max_by(value, struct_pack(a := ts, b := event_id)) FILTER (hit) AS value, min(ts) FILTER (hit) AS first_seen, max(ts) FILTER (hit) AS last_seen, min(ts) FILTER (NOT hit) AS resolved_at
  FROM nu WHERE number > 0 GROUP BY rule_id, host, number)"""


def evaluated(t):
    from pulsegrid.operators import alerts as A
    rules = R.add_rule(R.rules_df(t.spark), ("high_memory_usage", "Busy", "memory_usage", ">", 60.0, "critical", 300, 60, False, 300))
    samples = named_metrics(t).withColumn("service", F.when(F.col("host").isin("h1", "h2", "h3"), "web"))
    return A.evaluate(samples, rules, 3600)


@query("a01_evaluate_alerts", f"""WITH RECURSIVE {EVAL_SQL}, fa AS (SELECT *, split_part(metric, '_', 1) AS family, row_number() OVER (ORDER BY first_seen, alert_id) AS pos FROM av),
 lk AS (SELECT n.alert_id, coalesce(min(struct_pack(p := o.pos, id := o.alert_id)) FILTER (n.service = o.service), min(struct_pack(p := o.pos, id := o.alert_id)) FILTER (n.host = o.host),
  min(struct_pack(p := o.pos, id := o.alert_id)) FILTER (n.family = o.family)).id AS up
  FROM fa n LEFT JOIN fa o ON o.pos < n.pos AND o.first_seen >= n.first_seen - INTERVAL 1 HOUR AND (o.resolved_at IS NULL OR o.resolved_at > n.first_seen)
   AND (o.service = n.service OR o.host = n.host OR o.family = n.family) GROUP BY n.alert_id),
 rt AS (SELECT alert_id, alert_id AS root FROM lk WHERE up IS NULL UNION ALL SELECT lk.alert_id, rt.root FROM lk JOIN rt ON lk.up = rt.alert_id)
SELECT alert_id, rule_id, host, severity, round(threshold, 4) AS threshold, value, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, coalesce(epoch_us(resolved_at), -1) AS resolved_us,
 'corr-' || substr(md5(root), 1, 8) AS correlation_group FROM av JOIN rt USING (alert_id)""")
def _(t):
    return evaluated(t).select("alert_id", "rule_id", "host", "severity", F.round("threshold", 4).alias("threshold"), "value", us("first_seen").alias("first_us"),
                               us("last_seen").alias("last_us"), F.coalesce(us("resolved_at"), F.lit(-1)).alias("resolved_us"), "correlation_group")


@query("a02_alert_outbox", f"""WITH RECURSIVE {EVAL_SQL}, nt AS (SELECT alert_id, channel, rule_id, epoch_us(first_seen) AS us, title, severity, row_number() OVER (PARTITION BY channel, rule_id ORDER BY first_seen, alert_id) AS pos FROM av, (VALUES ('slack'), ('email')) c(channel)),
 se AS (SELECT channel, rule_id, us, pos FROM nt WHERE pos = 1 UNION ALL SELECT nt.channel, nt.rule_id, min(nt.us), min(nt.pos) FROM se JOIN nt ON nt.channel = se.channel AND nt.rule_id = se.rule_id AND nt.us > se.us + 1800000000 GROUP BY ALL)
SELECT alert_id, nt.channel, CASE WHEN nt.channel = 'email' THEN '[' || upper(severity) || '] ' || title ELSE severity || ' alert: ' || title END AS subject, se.pos IS NOT NULL AS sent
FROM nt LEFT JOIN se ON se.channel = nt.channel AND se.rule_id = nt.rule_id AND se.pos = nt.pos""")
def _(t):
    from pulsegrid.operators import alerts as A
    return A.outbox(evaluated(t), period_s=1800).select("alert_id", "channel", "subject", "sent")


@query("j06_inhibit", f"""WITH {ALERT_SQL}, x AS (SELECT alert_id, split_part(metric, '_', 1) AS alertname, host AS instance, CASE WHEN value > 200 THEN 'critical' ELSE 'warning' END AS sev FROM al)
SELECT alert_id FROM x WHERE NOT (sev = 'warning' AND EXISTS (SELECT 1 FROM x y WHERE y.sev = 'critical' AND y.alertname = x.alertname AND y.instance = x.instance))""")
def _(t):
    a = alerts(t).select("alert_id", F.create_map(
        F.lit("alertname"), F.substring_index("metric", "_", 1), F.lit("instance"), F.col("host"),
        F.lit("severity"), F.when(F.col("value") > 200, "critical").otherwise("warning")).alias("labels"))
    return J.inhibit(a).select("alert_id")


@query("j07_dependency_issues", f"""WITH {REQ_SQL}, hl AS (SELECT name, max(ts) AS m, avg(v) <= lim AS healthy FROM (
 SELECT src AS name, ts, response_time AS v, 50 AS lim FROM rq UNION ALL SELECT dst, ts, response_time, 49 FROM rq) GROUP BY name, lim),
 dp AS (SELECT src, string_agg(CASE WHEN NOT coalesce(h.healthy, FALSE) THEN dst END, ',' ORDER BY dst) AS failed FROM (SELECT DISTINCT src, dst FROM rq) e LEFT JOIN hl h ON dst = h.name GROUP BY src)
SELECT src AS service, CASE WHEN failed IS NULL THEN 'restart' ELSE 'fix_dependencies_first' END AS action, coalesce(failed, '') AS failed FROM dp LEFT JOIN hl ON src = name WHERE NOT coalesce(healthy, FALSE)""")
def _(t):
    rq = t.requests
    h = rq.groupBy(F.col("src").alias("name")).agg((F.avg("response_time") <= 50).alias("healthy")).unionByName(
        rq.groupBy(F.col("dst").alias("name")).agg((F.avg("response_time") <= 49).alias("healthy")))
    edges = rq.select(F.col("src").alias("service"), F.col("dst").alias("depends_on"))
    return J.dependency_issues(edges, h).withColumn("failed", F.array_join("failed", ","))


@query("j08_place_backups", """SELECT o_orderkey, coalesce((SELECT 'loc' || min(s_suppkey) FROM supplier WHERE s_acctbal * 50 > o_totalprice * 1.2), 'default') AS location FROM orders""")
def _(t):
    loc = t.read("supplier").select(F.concat(F.lit("loc"), "s_suppkey").alias("location"),
                                    F.col("s_suppkey").alias("priority"), (F.col("s_acctbal") * 50).alias("free"))
    return J.place_backups(t.orders.select("o_orderkey", "o_totalprice"), loc, "o_totalprice").select("o_orderkey", "location")


HOURLY = """hr AS (SELECT event_type AS metric, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL)"""


def hourly(t):
    return t.points.groupBy("metric", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))


@query("j09_lag_at", f"""WITH {HOURLY} SELECT a.metric, epoch_us(a.h) AS h_us, round(b.v, 6) AS lag_1h, round(c.v, 6) AS lag_6h FROM hr a
 LEFT JOIN hr b ON a.metric = b.metric AND b.h = a.h - INTERVAL 1 HOUR LEFT JOIN hr c ON a.metric = c.metric AND c.h = a.h - INTERVAL 6 HOUR""")
def _(t):
    d = J.lag_at(hourly(t), ["metric"], "h", "v", 3600, "lag_1h")
    d = J.lag_at(d, ["metric"], "h", "v", 6 * 3600, "lag_6h")
    return d.select("metric", us("h").alias("h_us"), r6("lag_1h").alias("lag_1h"), r6("lag_6h").alias("lag_6h"))


@query("j10_zip_series", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) - 1 AS pos FROM pts)
SELECT x.pos, x.value AS a, y.value AS b FROM p x JOIN p y ON x.pos = y.pos AND x.metric = 'click' AND y.metric = 'view'""")
def _(t):
    return J.zip_series(t.points, "metric", "click", "view", ["ts", "event_id"])


@query("j11_unseen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t):
    seen = t.events.select(F.col("user_id").alias("c_custkey")).distinct()
    return J.unseen(t.read("customer").select("c_custkey"), seen, "c_custkey")


@query("j12_resolve_alias", """SELECT event_id, CASE event_type WHEN 'click' THEN 'docker_cpu' WHEN 'view' THEN 'cpu' ELSE event_type END AS measurement FROM events""")
def _(t):
    return t.events.select("event_id", J.resolve_alias("event_type", {"click": "docker_cpu", "view": "cpu"}).alias("measurement"))


@query("j13_vector_op", f"""WITH {PTS}, a AS (SELECT host, sum(value) AS v FROM pts WHERE metric = 'click' GROUP BY host), b AS (SELECT host, sum(value) AS v FROM pts GROUP BY host)
SELECT host, round(a.v / b.v, 6) AS value FROM a JOIN b USING (host)""")
def _(t):
    used = t.points.where("metric = 'click'").groupBy("host").agg(F.sum("value").alias("value"))
    total = t.points.groupBy("host").agg(F.sum("value").alias("value"))
    return J.vector_op(used, total, "/", ["host"]).withColumn("value", r6("value"))


@query("j14_route_alerts", f"""WITH {ALERT_SQL} SELECT alert_id, CASE WHEN severity = 'critical' THEN 'critical-alerts' WHEN service = 'svc1' THEN 'security-alerts' ELSE 'web.hook' END AS receiver,
 CASE WHEN severity = 'critical' THEN 30 WHEN service = 'svc1' THEN 60 ELSE 300 END::INT AS group_wait_s FROM al""")
def _(t):
    a = alerts(t).withColumn("service", F.when(F.col("service") == "svc1", "wazuh").otherwise(F.col("service")))
    return J.route_alerts(a).select("alert_id", "receiver", "group_wait_s")


@query("j15_affected_services", f"""WITH {METRIC_NAMES_SQL} SELECT event_id, CASE metric WHEN 'cpu_usage' THEN 'all_services,web_services' WHEN 'other' THEN 'application_services,web_services' ELSE 'web_services' END AS services FROM mn""")
def _(t):
    m = F.col("metric")
    f = F.array(F.when(m == "cpu_usage", "Host_CPU_Percent").when(m == "other", "error_rate_5m").otherwise("x"), F.lit("response_time"))
    return named_metrics(t).select("event_id", F.array_join(F.sort_array(J.affected_services(f)), ",").alias("services"))


# --- aggregates -----------------------------------------------------------

@query("g01_device_stats", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY ts, event_id) - 1 AS i FROM pts),
 a AS (SELECT device, metric, count(*) AS n, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max, coalesce(stddev_samp(value), 0) AS stdev, regr_slope(value, i) AS sl FROM p GROUP BY device, metric)
SELECT device, metric, n, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(stdev, 6) AS stdev,
 CASE WHEN n < 3 THEN 'insufficient_data' WHEN sl > 0.1 THEN 'increasing' WHEN sl < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM a""")
def _(t):
    return G.device_stats(t.points).select("device", "metric", "n", r6("mean").alias("mean"), r6("median").alias("median"),
                                           "min", "max", r6("stdev").alias("stdev"), "trend")


@query("g02_container_profile", f"""WITH {PTS} SELECT host, round(avg(value), 6) AS avg_cpu, max(value) AS max_cpu, round(stddev_samp(value), 6) AS volatility,
 CASE WHEN avg(value) > 80 THEN 'high' WHEN avg(value) < 10 THEN 'low' ELSE 'normal' END AS priority FROM pts GROUP BY host""")
def _(t):
    return G.container_profile(t.points).select("host", r6("avg_cpu").alias("avg_cpu"), "max_cpu", r6("volatility").alias("volatility"), "priority")


SPINE = """sp AS (SELECT metric, unnest(generate_series(min(b), max(b), INTERVAL 1 {u})) AS b FROM f GROUP BY metric)"""


@query("g03_resample", f"""WITH {PTS}, f AS (SELECT host || metric AS metric, date_trunc('hour', ts) AS b, avg(value) AS v FROM pts GROUP BY ALL), {SPINE.format(u='HOUR')},
 f2 AS (SELECT metric, date_trunc('day', ts) AS b, sum(value) AS v FROM pts WHERE value > 150 GROUP BY ALL), sp2 AS (SELECT metric, unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS b FROM f2 GROUP BY metric)
SELECT metric, epoch_us(b) AS b_us, round(v, 6) AS v FROM sp LEFT JOIN f USING (metric, b) UNION ALL SELECT metric, epoch_us(b), round(coalesce(v, 0), 4) FROM sp2 LEFT JOIN f2 USING (metric, b)""")
def _(t):
    p = t.points
    a = G.resample(p.withColumn("metric", F.concat("host", "metric")))
    b = G.resample(p.where("value > 150"), freq="day", agg="sum")
    return a.select("metric", us("bucket").alias("b_us"), r6("value").alias("v")).unionByName(
        b.select("metric", us("bucket").alias("b_us"), r6("value", 4).alias("v")))


@query("g04_hour_profile", f"""WITH {PTS}, h AS (SELECT metric, date_trunc('hour', ts) AS h, avg(value) AS m FROM pts GROUP BY ALL), d AS (SELECT metric, hour(h) AS hr, avg(m) AS m FROM h GROUP BY ALL),
 pk AS (SELECT metric, arg_max(hr, struct_pack(m := m, r := -hr)) AS peak, arg_min(hr, struct_pack(m := m, r := hr)) AS low FROM d GROUP BY metric),
 dd AS (SELECT metric, date_trunc('day', ts) AS d, avg(value) AS m FROM pts GROUP BY ALL), da AS (SELECT metric, avg(m) AS wa, stddev_samp(m) AS ds FROM dd GROUP BY metric)
SELECT metric, peak::INT AS peak_hour, low::INT AS low_hour, round(wa, 6) AS weekly_average, round(ds, 6) AS day_std, CASE WHEN peak BETWEEN 9 AND 17 THEN 'business_hours' ELSE 'off_hours' END AS pattern,
 CASE WHEN wa > 70 THEN 'high' WHEN ds > 20 THEN 'medium' ELSE 'normal' END AS priority FROM pk JOIN da USING (metric)""")
def _(t):
    return G.hour_profile(t.points).withColumns({"weekly_average": r6("weekly_average"), "day_std": r6("day_std")})


DAILY = f"""{PTS}, f AS (SELECT metric, date_trunc('day', ts) AS b, sum(value) AS v0 FROM pts GROUP BY ALL), {SPINE.format(u='DAY')},
 dy AS (SELECT metric, b, coalesce(v0, 0) AS v FROM sp LEFT JOIN f USING (metric, b)),
 da AS (SELECT metric, count(*) AS days, avg(v) AS av, max(v) AS mx, arg_min(v, b) AS fv, arg_max(v, b) AS lv FROM dy GROUP BY metric HAVING count(*) > 1)"""


@query("g05_traffic_growth", f"""WITH {DAILY} SELECT metric, days, round(av, 4) AS daily_average, round(mx, 4) AS peak_day,
 round(CASE WHEN fv > 0 THEN (lv - fv) / fv * 100 ELSE 0 END, 4) AS growth_pct, CASE WHEN fv > 0 AND (lv - fv) / fv * 100 > 50 THEN 'medium' ELSE 'normal' END AS priority FROM da""")
def _(t):
    return G.traffic_growth(t.points).withColumns({c: r6(c, 4) for c in ("daily_average", "peak_day", "growth_pct")})


@query("g06_recent_spike", f"WITH {DAILY} SELECT metric, days, round(lv, 4) AS recent, round(av, 4) AS average, lv > av * 1.01 AS spike FROM da")
def _(t):
    return G.recent_spike(t.points, 1.01).withColumns({"recent": r6("recent", 4), "average": r6("average", 4)})


FED = {
    "g07_federate_sum": ("sum", "sum(value)", "least(1.0, count(*) / 5.0)"),
    "g08_federate_average": ("average", "avg(value)", "least(1.0, count(*) / 3.0)"),
    "g09_federate_min": ("min", "min(value)", "1.0"),
    "g10_federate_max": ("max", "max(value)", "1.0"),
    "g11_federate_count": ("count", "count(*)", "1.0"),
    "g12_federate_p95": ("percentile_95", "list_sort(list(value))[least(floor(0.95 * count(*)), count(*) - 1)::INT + 1]", "least(1.0, count(*) / 10.0)"),
    "g13_federate_weighted": ("weighted_average", "sum(value * weight) / sum(weight)", "least(1.0, count(*) / 3.0)"),
}


def _federate(name, method, expr, conf):
    @query(name, f"""WITH {NODE_SQL}, x AS (SELECT metric || '@' || node AS metric, value, weight FROM ns)
SELECT metric, '{method}' AS method, round(({expr})::DOUBLE, 2) AS value, round(({conf})::DOUBLE, 6) AS confidence, count(*) AS n FROM x GROUP BY metric""")
    def _(t: Tables):
        s = t.node_samples.withColumn("metric", F.concat_ws("@", "metric", "node"))
        rules = s.select(F.col("metric").alias("metric_name"), F.lit(method).alias("method")).distinct()
        return G.federate(s, rules).withColumns({"value": r6("value", 2), "confidence": r6("confidence")})


for _name, _spec in FED.items():
    _federate(_name, *_spec)


@query("g14_merge_labels", f"""WITH {NODE_SQL} SELECT metric || '@' || node AS metric, 'flag' AS label, metric AS value FROM ns GROUP BY metric, node
UNION ALL SELECT metric || '@' || node, 'line', CASE WHEN count(DISTINCT line) = 1 THEN max(line) ELSE 'multiple[' || count(DISTINCT line) || ']' END FROM ns GROUP BY metric, node""")
def _(t):
    s = t.node_samples.withColumn("metric", F.concat_ws("@", "metric", "node"))
    odd = F.when(F.col("weight") == 7, F.map_concat("labels", F.create_map(F.lit("odd"), F.lit("x")))).otherwise(F.col("labels"))
    return G.merge_labels(s.withColumn("labels", odd))


@query("g15_source_nodes", f"WITH {NODE_SQL} SELECT metric, count(DISTINCT node) AS node_count, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM ns GROUP BY metric")
def _(t):
    return G.source_nodes(t.node_samples)


@query("g16_health_summary", f"""WITH {SERVICE} SELECT count(*) AS total, count(*) FILTER (health_status = 'healthy') AS healthy, count(*) FILTER (health_status = 'warning') AS warning,
 count(*) FILTER (health_status = 'critical') AS critical, round(count(*) FILTER (health_status = 'healthy') * 100.0 / count(*), 6) AS health_pct FROM sh""")
def _(t):
    return G.health_summary(S.service_health(services(t))).withColumn("health_pct", r6("health_pct"))


@query("g17_breakdown", f"""WITH {PORT_SQL}, x AS (SELECT {DTYPE_SQL} AS d FROM dv) SELECT v AS value, count(d) AS n FROM (VALUES ('smart_switch'),('sensor'),('camera'),('thermostat'),('unknown')) a(v) LEFT JOIN x ON d = v GROUP BY v""")
def _(t):
    d = devices(t).select(S.device_type("open_ports", "capabilities").alias("d"))
    return G.breakdown(d, "d", ["smart_switch", "sensor", "camera", "thermostat", "unknown"])


CHK = f"""{PTS}, c AS (SELECT host AS node, ts, event_id, CASE WHEN value > 100 THEN 'offline' WHEN value > 70 THEN 'degraded' ELSE 'online' END AS status,
 CASE WHEN value > 100 THEN 0 ELSE value END AS response_time, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn FROM pts)"""


@query("g18_node_health", f"""WITH {CHK} SELECT node, round(count(*) FILTER (status IN ('online','degraded')) * 100.0 / count(*), 6) AS uptime_pct,
 round(coalesce(avg(CASE WHEN response_time > 0 THEN response_time END), 0), 6) AS avg_response, arg_max(status, ts) AS current_status, epoch_us(max(ts)) AS last_us, count(*) AS checks FROM c WHERE rn <= 100 GROUP BY node""")
def _(t):
    v = F.col("value")
    c = t.points.select(F.col("host").alias("node"), "ts", "event_id",
                        F.when(v > 100, "offline").when(v > 70, "degraded").otherwise("online").alias("status"),
                        F.when(v > 100, 0.0).otherwise(v).alias("response_time"))
    return G.node_health(c).select("node", r6("uptime_pct").alias("uptime_pct"), r6("avg_response").alias("avg_response"),
                                   "current_status", us("last_check").alias("last_us"), "checks")


def edge_sql(minutes, name):
    return f"""{name}_w AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, event_id DESC) AS rn FROM rq WHERE ts > (SELECT max(ts) FROM rq) - INTERVAL {minutes} MINUTE),
 {name} AS (SELECT src, dst, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS errors, count(*) FILTER (success) * 100.0 / count(*) AS success_rate,
 round(avg(response_time), 3) AS avg_response, max(ts) AS last_request FROM {name}_w WHERE rn <= 100 GROUP BY src, dst)"""


WEEK = 14 * 1440


@query("g19_edge_stats", f"""WITH {REQ_SQL}, {edge_sql(WEEK, 'es')} SELECT src, dst, requests, successes, errors, round(success_rate, 6) AS success_rate, avg_response, epoch_us(last_request) AS last_us FROM es""")
def _(t):
    return G.edge_stats(t.requests, WEEK).select("src", "dst", "requests", "successes", "errors", r6("success_rate").alias("success_rate"),
                                                 "avg_response", us("last_request").alias("last_us"))


ISSUE_SQL = """iss AS (SELECT src, dst, 'high_error_rate' AS type, round(errors * 100.0 / requests, 2) AS measured, CASE WHEN errors > requests * 0.5 THEN 'high' ELSE 'medium' END AS severity FROM {e} WHERE errors > requests * 0.1
 UNION ALL SELECT src, dst, 'slow_response', avg_response, CASE WHEN avg_response > 60 THEN 'high' ELSE 'medium' END FROM {e} WHERE avg_response > 55)"""


@query("g20_comm_report", f"""WITH {REQ_SQL}, {edge_sql(WEEK, 'es')}, {edge_sql(1440, 'e2')}, {ISSUE_SQL.format(e='e2').replace('> 60', '> 10').replace('> 55', '> 5')},
 a AS (SELECT count(*) AS communications, sum(requests)::BIGINT AS total_requests, sum(errors) * 100.0 / sum(requests) AS er, avg(avg_response) AS ar FROM es), i AS (SELECT count(*) AS issues FROM iss)
SELECT communications, total_requests, round(er, 2) AS error_rate, round(ar, 3) AS avg_response, issues, round(greatest(0, 100 - er * 10 - issues * 5), 6) AS health_score FROM a, i""")
def _(t):
    return G.comm_report(t.requests, minutes=WEEK, issue_minutes=1440).withColumn("health_score", r6("health_score"))


@query("g21_edge_issues", f"WITH {REQ_SQL}, {edge_sql(WEEK, 'es')}, {ISSUE_SQL.format(e='es').replace('> 60', '> 10')} SELECT * FROM iss")
def _(t):
    return G.edge_issues(G.edge_stats(t.requests, WEEK), slow_limit=55.0)


@query("g22_dependency_map", f"WITH {REQ_SQL} SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS depends_on FROM rq GROUP BY src")
def _(t):
    return G.dependency_map(t.requests)


@query("g23_running_mean", f"""WITH {PTS} SELECT event_id, metric, round(avg(sqrt(value)) OVER (PARTITION BY metric ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM pts""")
def _(t):
    return G.running_mean(t.points.withColumn("value", F.sqrt("value")), ["metric"], ["ts", "event_id"]).select("event_id", "metric", r6("running_mean").alias("running_mean"))


@query("g24_ema", f"""WITH {REQ_SQL}, l AS (SELECT src, dst, list(response_time ORDER BY ts, event_id) AS v FROM rq GROUP BY src, dst)
SELECT src, dst, round(list_reduce(v, lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.1 * x + 0.9 * a END), 6) AS ema FROM l""")
def _(t):
    e = G.ema(t.requests.select("src", "dst", "ts", "event_id", "response_time"), ["src", "dst"], ["ts", "event_id"], "response_time")
    return G.last_value(e.withColumn("edge", F.struct("src", "dst")), "edge", ["ts", "event_id"], "ema", "ema") \
        .select("edge.src", "edge.dst", r6("ema").alias("ema"))


@query("g25_request_stats", f"""WITH {REQ_SQL} SELECT dst, count(*) AS requests, count(*) FILTER (status_code < 400) AS successes, count(*) FILTER (status_code >= 400) AS failures,
 round(count(*) FILTER (status_code < 400) * 100.0 / count(*), 6) AS success_rate, epoch_us(max(ts)) AS last_us FROM rq GROUP BY dst""")
def _(t):
    return G.request_stats(t.requests).select("dst", "requests", "successes", "failures", r6("success_rate").alias("success_rate"),
                                              us("last_request").alias("last_us"))


@query("g26_top_values", f"WITH {PTS} SELECT device AS value, count(*) AS cnt FROM pts GROUP BY device ORDER BY cnt DESC, value LIMIT 10")
def _(t):
    return G.top_values(t.points, "device")


@query("g27_top_alarms", """SELECT value, count(*) AS cnt FROM (SELECT CASE event_type WHEN 'view' THEN 'k' || (user_id % 7) WHEN 'click' THEN 'typed' WHEN 'purchase' THEN 'lan'
 WHEN 'error' THEN 'cat' ELSE 'Lost ' || (user_id % 5) END AS value FROM events) GROUP BY value ORDER BY cnt DESC, value LIMIT 8""")
def _(t):
    e = F.col("event_type")
    a = t.events.select(
        F.when(e == "view", F.concat(F.lit("k"), F.col("user_id") % 7)).otherwise("").alias("key"),
        F.when(e == "click", "typed").alias("type"), F.when(e == "purchase", "lan").alias("subsystem"),
        F.when(e == "error", "cat").alias("category"), F.concat(F.lit("Lost "), F.col("user_id") % 5, F.lit(". Gone.")).alias("msg"))
    return G.top_alarms(a, 8)


@query("g28_top_ssids_fallback", """(SELECT 'used' AS case_, event_type AS value, count(*) AS cnt FROM events GROUP BY event_type ORDER BY cnt DESC, value LIMIT 4)
UNION ALL (SELECT DISTINCT 'idle', c_mktsegment, 0 FROM customer ORDER BY 2 LIMIT 4)""")
def _(t):
    ev = t.events.select(F.col("event_type").alias("ssid"))
    wl = t.read("customer").select(F.col("c_mktsegment").alias("name"))
    used = G.top_ssids_fallback(ev, wl, 4).select(F.lit("used").alias("case_"), "value", "cnt")
    none = G.top_ssids_fallback(ev.select(F.nullif("ssid", "ssid").alias("ssid")), wl, 4)
    return used.unionByName(none.select(F.lit("idle").alias("case_"), "value", "cnt"))


@query("g29_totals", """SELECT 'events' AS resource, count(*) AS count FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages""")
def _(t):
    return K.totals({n: t.read(n) for n in ("events", "orders", "pages")})


@query("g30_vuln_counts", f"WITH {VULN_SQL} SELECT image, count(*) FILTER (severity IN ('HIGH','CRITICAL')) AS vulnerabilities, count(*) FILTER (severity = 'CRITICAL') AS critical FROM vr GROUP BY image")
def _(t):
    return G.vuln_counts(R.read_vuln_reports(vuln_json(t)))


@query("g31_distinct_images", "SELECT DISTINCT p_brand || ':' || p_type AS image FROM part")
def _(t):
    return G.distinct_images(t.read("part").select(F.concat_ws(":", "p_brand", "p_type").alias("image")))


@query("g32_measurement_means", """SELECT event_type, 'user_id' AS field, round(avg(user_id), 6) AS mean FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'value', round(avg(value), 6) FROM events GROUP BY event_type""")
def _(t):
    d = t.events.select("event_type", F.col("user_id").cast("double").alias("user_id"), "value", F.lit(None).cast("double").alias("nothing"))
    return G.measurement_means(d, "event_type", P.numeric_columns(d)).withColumn("mean", r6("mean"))


@query("g33_metric_outlook", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS z FROM pts)
SELECT metric, round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS volatility, CASE WHEN avg(value) FILTER (z <= 24) < avg(value) FILTER (a <= 24) THEN 'improving' ELSE 'stable' END AS trend FROM p GROUP BY metric""")
def _(t):
    return G.metric_outlook(t.points).withColumns({"average": r6("average"), "volatility": r6("volatility")})


BACKUP_SQL = """bk AS (SELECT o_orderkey AS operation_id, o_custkey AS target_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS start_time,
 o_orderdate + (o_orderkey % 5000) * INTERVAL 1 SECOND AS end_time, round(o_totalprice * 100)::BIGINT AS source_size, round(o_totalprice * 60)::BIGINT AS backup_size FROM orders)"""


def backups(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("operation_id"), F.col("o_custkey").alias("target_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("start_time"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 5000) * 1_000_000).alias("end_time"),
        F.round(p * 100).cast("long").alias("source_size"), F.round(p * 60).cast("long").alias("backup_size"))


@query("g34_backup_stats", f"""WITH {BACKUP_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status <> 'completed') AS failed, sum(backup_size)::BIGINT AS total_bytes,
 round(avg(epoch_us(end_time) - epoch_us(start_time)) / 1e6, 4) AS avg_duration_s, epoch_us(arg_max(end_time, struct_pack(a := start_time, b := operation_id))) AS last_us FROM bk""")
def _(t):
    return G.backup_stats(backups(t)).select("total", "successful", "failed", "total_bytes", r6("avg_duration_s", 4).alias("avg_duration_s"),
                                             us("last_backup").alias("last_us"))


@query("g35_backup_metrics", f"""WITH {BACKUP_SQL} SELECT operation_id, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS duration_s, (status = 'completed')::INT AS success, round(1 - backup_size / source_size, 6) AS compression_ratio FROM bk""")
def _(t):
    return G.backup_metrics(backups(t)).select("operation_id", r6("duration_s").alias("duration_s"), "success", r6("compression_ratio").alias("compression_ratio"))


@query("g36_window_mean", f"WITH {PTS} SELECT host, metric, round(avg(value), 6) AS mean FROM pts WHERE ts > (SELECT max(ts) FROM pts) - INTERVAL 2880 MINUTE GROUP BY host, metric")
def _(t):
    return G.window_mean(t.points, ["host", "metric"], 2880).withColumn("mean", r6("mean"))


@query("g37_last_value", f"WITH {PTS} SELECT host, arg_max(value, struct_pack(a := ts, b := event_id)) AS last FROM pts GROUP BY host")
def _(t):
    return G.last_value(t.points, "host", ["ts", "event_id"])


@query("g38_agg_by", f"""WITH {PTS} SELECT 'avg' AS fn, metric AS k, round(avg(value), 6) AS value FROM pts GROUP BY metric UNION ALL SELECT 'sum', host, round(sum(value), 4) FROM pts GROUP BY host
UNION ALL SELECT 'count', metric, count(*) FILTER (value > 50) FROM pts GROUP BY metric UNION ALL SELECT 'ratio', host, round(count(*) FILTER (value > 50) * 100.0 / count(*), 6) FROM pts GROUP BY host""")
def _(t):
    p, hot = t.points, F.col("value") > 50
    out = None
    for fn, k, places in (("avg", "metric", 6), ("sum", "host", 4), ("count", "metric", 6), ("ratio", "host", 6)):
        one = G.agg_by(p, [k], fn, cond=hot).select(F.lit(fn).alias("fn"), F.col(k).alias("k"), r6("value", places).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g39_insight_summary", f"""WITH {ALERT_SQL} SELECT count(*) AS total_insights, count(*) FILTER (severity = 'critical') AS critical_insights, 0::BIGINT AS warning_insights, count(DISTINCT rule_id) AS kinds FROM al""")
def _(t):
    return G.insight_summary(alerts(t), kind="rule_id")


HOSTCOUNT = f"""{PTS}, hc AS (SELECT host, strftime(ts, '%Y-%m-%d') AS d, count(*) FILTER (value > 150) AS failing, count(*) FILTER (value > 200) AS critical, count(*) FILTER (value > 100) AS warning, max(value) / 5 AS memory, max(value) / 4 AS disk FROM pts GROUP BY ALL)"""


def host_days(t):
    v = F.col("value")
    return t.points.groupBy("host", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(
        F.count_if(v > 150).alias("failing"), F.count_if(v > 200).alias("critical"), F.count_if(v > 100).alias("warning"),
        (F.max(v) / 5).alias("memory"), (F.max(v) / 4).alias("disk"))


@query("g40_overall_health", f"""WITH {HOSTCOUNT} SELECT host, d, CASE WHEN failing = 0 AND critical = 0 THEN 'healthy' WHEN failing <= 2 AND critical = 0 THEN 'degraded' WHEN failing <= 5 AND critical <= 2 THEN 'impaired' ELSE 'critical' END AS health FROM hc""")
def _(t):
    return host_days(t).select("host", "d", G.overall_health("failing", "critical").alias("health"))


@query("g41_host_status", f"""WITH {HOSTCOUNT} SELECT host, d, CASE WHEN disk >= 90 OR failing > 2 THEN 'YELLOW' WHEN critical > 0 OR memory >= 95 THEN 'RED' WHEN warning > 0 THEN 'YELLOW' ELSE 'GREEN' END AS colour FROM hc""")
def _(t):
    return host_days(t).select("host", "d", G.host_status("critical", "warning", "memory", "disk", F.col("failing") - 2).alias("colour"))


@query("g42_service_status", f"""WITH {SERVICE} SELECT (restarts)::INT AS grp, count(*) FILTER (NOT (status <> 'running' OR coalesce(health, '') = 'unhealthy')) AS healthy, count(*) FILTER (status <> 'running' OR coalesce(health, '') = 'unhealthy') AS failing FROM sv GROUP BY 1""")
def _(t):
    return G.service_status(services(t).withColumnRenamed("restart_count", "grp"), ["grp"], state="status")


@query("g43_check_counts", f"""WITH {CHECK_SQL} SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed, (count(*) FILTER (status = 'PASS') * 100 // count(*))::BIGINT AS pass_rate FROM ck""")
def _(t):
    return G.check_counts(checks(t))


@query("g44_discovery_summary", """SELECT count(*) FILTER (value < 100) AS alive_devices, count(*) AS total_devices, round(count(*) FILTER (value < 100) * 100.0 / count(*), 6) AS availability_pct, round(avg(100 - user_id % 60), 6) AS avg_security_score FROM events""")
def _(t):
    d = t.events.select((F.col("value") < 100).alias("alive"), (100 - F.col("user_id") % 60).alias("security_score"))
    return G.discovery_summary(d).withColumns({c: r6(c) for c in ("availability_pct", "avg_security_score")})


BEHAVIOR_SQL = """ps AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY ts, event_id) - 1 AS i FROM pts),
 ba AS (SELECT device || '/' || metric AS metric, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, regr_slope(value, i) AS sl FROM ps GROUP BY device, metric),
 bc AS (SELECT metric, n, CASE WHEN n < 3 THEN 'insufficient_data' WHEN s < m * 0.1 THEN 'stable' WHEN s > m * 0.5 THEN 'volatile' WHEN abs(sl) > m * 0.1 THEN CASE WHEN sl > 0 THEN 'trending_up' ELSE 'trending_down' END ELSE 'normal' END AS classification FROM ba),
 bd AS (SELECT *, CASE classification WHEN 'insufficient_data' THEN 0.0 WHEN 'stable' THEN 0.9 WHEN 'volatile' THEN 0.8 WHEN 'normal' THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM bc)"""


@query("g45_intelligence_summary", f"""WITH {PTS}, {BEHAVIOR_SQL} SELECT count(*) AS metrics_analyzed, count(*) FILTER (confidence > 0.8) AS high_confidence, count(*) FILTER (starts_with(classification, 'trending')) AS trending FROM bd""")
def _(t):
    from pulsegrid.operators.stats import classify_behavior
    p = t.points.withColumn("metric", F.concat_ws("/", "device", "metric"))
    return G.intelligence_summary(classify_behavior(p))


@query("g46_findings_report", f"""WITH {HOSTS_SQL}, b AS (SELECT 'cpu' AS type, CASE WHEN cpu > 95 THEN 'high' ELSE 'medium' END AS severity FROM ht WHERE cpu > 80
 UNION ALL SELECT 'memory', CASE WHEN memory > 95 THEN 'high' ELSE 'medium' END FROM ht WHERE memory > 85 UNION ALL SELECT 'disk', CASE WHEN disk > 95 THEN 'critical' ELSE 'high' END FROM ht WHERE disk > 90)
SELECT count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, string_agg(DISTINCT type, ',' ORDER BY type) AS act_on, 'critical' AS system_health FROM b""")
def _(t):
    return G.findings_report(P.bottlenecks(host_rows(t)))


@query("g47_io_totals", f"WITH {STATS_SQL} SELECT event_id, n + 7 AS network_rx_bytes, v AS network_tx_bytes, n + 1 AS block_read_bytes, v AS block_write_bytes FROM cs")
def _(t):
    return R.read_container_stats(container_json(t)).select("event_id", "network_rx_bytes", "network_tx_bytes", "block_read_bytes", "block_write_bytes")


@query("g48_up_share", f"""WITH {PTS} SELECT coalesce(metric, 'overall') AS job, count(*) FILTER (value < 80) AS up, count(*) AS total, round(count(*) FILTER (value < 80) * 100.0 / count(*), 6) AS pct FROM pts GROUP BY ROLLUP (metric)""")
def _(t):
    return G.up_share(t.points.select(F.col("metric").alias("job"), (F.col("value") < 80).cast("int").alias("value"))).withColumn("pct", r6("pct"))
