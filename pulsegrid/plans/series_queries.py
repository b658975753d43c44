"""Queries for windows, ranking, set operations and statistics."""

from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as G, predicates as P, ranking as L, stats as M, windows as W
from pulsegrid.plans.registry import PTS, REQ_SQL, Tables, query, r6, us
from pulsegrid.plans.relational_queries import BACKUP_SQL, BEHAVIOR_SQL, HOSTS_SQL, backups, host_rows
from pulsegrid.plans.source_queries import ALERT_SQL, METRIC_NAMES_SQL, STATS_SQL, alerts, named_metrics
from pulsegrid.sources import sinks as K

TE = ["ts", "event_id"]


@query("w01_rolling", f"""WITH {PTS} SELECT event_id, round(avg(sqrt(value)) OVER w, 6) AS rolling_mean, round(stddev_samp(value) OVER w, 6) AS rolling_std FROM pts
WINDOW w AS (PARTITION BY metric ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW)""")
def _(t):
    d = W.rolling(t.points.withColumn("third", F.sqrt("value")), ["metric"], "ts", "third", 21600)
    d = W.rolling(d, ["metric"], "ts", "value", 21600, ["std"])
    return d.select("event_id", r6("rolling_mean").alias("rolling_mean"), r6("rolling_std").alias("rolling_std"))


@query("w02_last_100", f"""WITH {PTS} SELECT event_id, round(avg(sqrt(value)) OVER w, 6) AS last_mean, round(stddev_samp(value) OVER w, 6) AS last_std, max(value) OVER w AS last_max FROM pts
WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id ROWS 99 PRECEDING)""")
def _(t):
    d = W.last_n(t.points.withColumn("third", F.sqrt("value")), ["metric"], TE, "third", 100)
    d = W.last_n(d, ["metric"], TE, "value", 100, ["std", "max"])
    return d.select("event_id", r6("last_mean").alias("last_mean"), r6("last_std").alias("last_std"), "last_max")


@query("w03_last_10_active", f"""WITH {PTS}, x AS (SELECT event_id, avg(sqrt(value)) OVER (PARTITION BY device ORDER BY ts, event_id ROWS 9 PRECEDING) AS m, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS n FROM pts)
SELECT event_id, round(m, 6) AS last_mean FROM x WHERE n > 10""")
def _(t):
    d = W.last_n(t.points.withColumn("value", F.sqrt("value")), ["device"], TE, "value", 10)
    d = W.last_n(d, ["device"], TE, "value", 11, ["count"], "seen")
    return d.where("seen_count > 10").select("event_id", r6("last_mean").alias("last_mean"))


@query("w04_dynamic_threshold", f"""WITH {PTS}, x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '>' WHEN 1 THEN '<=' ELSE '==' END AS op,
 count(*) OVER h AS hn, avg(value) OVER h AS hm, stddev_samp(value) OVER h AS hs, avg(value) OVER f AS fm, stddev_samp(value) OVER f AS fs, row_number() OVER (ORDER BY ts, event_id) AS seen FROM pts
 WINDOW h AS (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), f AS (ORDER BY ts, event_id ROWS 49 PRECEDING)),
 y AS (SELECT *, CASE WHEN hn >= 10 THEN hm ELSE fm END AS m, CASE WHEN hn >= 10 THEN hs ELSE fs END AS s FROM x)
SELECT event_id, round(CASE WHEN seen < 20 THEN 80.0 WHEN op = '>' THEN greatest(80.0, m + 2 * s) WHEN op = '<=' THEN least(80.0, m - 2 * s) ELSE 80.0 END, 6) AS dynamic_threshold FROM y""")
def _(t):
    e = F.col("event_id") % 3
    d = t.points.withColumns({"site": F.lit("all"), "threshold": F.lit(80.0),
                              "op": F.when(e == 0, ">").when(e == 1, "<=").otherwise("==")})
    return W.dynamic_threshold(d, ["site"]).select("event_id", r6("dynamic_threshold").alias("dynamic_threshold"))


ISLAND_SQL = """is1 AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS pos FROM pts),
 is2 AS (SELECT *, pos - row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS grp FROM is1 WHERE value > 60)"""


@query("w05_anomaly_islands", f"""WITH {PTS}, {ISLAND_SQL} SELECT metric, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS anomalies, round(avg(sqrt(value)), 6) AS avg_score,
 max(user_id)::DOUBLE AS user_max FROM is2 GROUP BY metric, grp""")
def _(t):
    d = t.points.withColumns({"score": F.sqrt("value"), "user": F.col("user_id").cast("double")})
    r = W.anomaly_islands(d, ["metric"], TE, F.col("value") > 60, "score", ["user"])
    return r.select("metric", us("start").alias("start_us"), us("end").alias("end_us"), "anomalies",
                    r6("avg_score").alias("avg_score"), F.col("user_max"))


@query("w06_trend_label", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY device, metric ORDER BY ts, event_id) - 1 AS i FROM pts), a AS (SELECT device, metric, count(*) AS n, regr_slope(value, i) AS sl FROM p GROUP BY device, metric)
SELECT device, metric, n, round(sl, 6) AS slope, CASE WHEN n < 3 THEN 'insufficient_data' WHEN sl > 0.1 THEN 'increasing' WHEN sl < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM a""")
def _(t):
    return W.trend_label(t.points, ["device", "metric"], TE).withColumn("slope", r6("slope"))


@query("w07_head_tail", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS z FROM pts)
SELECT metric, round(avg(value) FILTER (a <= 24), 6) AS head_mean, round(avg(value) FILTER (z <= 24), 6) AS tail_mean FROM p GROUP BY metric""")
def _(t):
    return W.head_tail(t.points, ["metric"], TE, 24).withColumns({"head_mean": r6("head_mean"), "tail_mean": r6("tail_mean")})


@query("w08_latest", f"WITH {PTS} SELECT host, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn FROM pts) WHERE rn = 1")
def _(t):
    return W.latest(t.points.select("host", "event_id", "value", "ts"), ["host"], TE).select("host", "event_id", "value")


@query("w09_sequences", f"""WITH {PTS}, x AS (SELECT event_id, value AS target, list(value) OVER w AS l, sum(sqrt(value)) OVER w AS s, first_value(value) OVER w AS head FROM pts
 WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT event_id, target, round(s, 6) AS window_sum, head FROM x WHERE len(l) = 24""")
def _(t):
    d = W.sequences(t.points, ["metric"], TE, "value", 24)
    return d.select("event_id", "target", r6(F.aggregate("window", F.lit(0.0), lambda a, x: a + F.sqrt(x))).alias("window_sum"),
                    F.get("window", F.lit(0)).alias("head"))


@query("w10_nth_last", f"""WITH {PTS}, p AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS z FROM pts)
SELECT device, max(value) FILTER (z = 1) AS last, coalesce(max(value) FILTER (z = 6), max(value) FILTER (z = 1)) AS nth FROM p GROUP BY device""")
def _(t):
    return W.nth_last(t.points, ["device"], TE, "value", 6)


POLICY = "CASE target_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 24 ELSE 30 END"


@query("w11_retention_plan", f"""WITH {BACKUP_SQL} SELECT operation_id, CASE WHEN row_number() OVER (PARTITION BY target_id ORDER BY start_time DESC, operation_id DESC) <= {POLICY} THEN 'keep' ELSE 'delete' END AS plan FROM (SELECT * REPLACE (target_id // 10 AS target_id) FROM bk)""")
def _(t):
    b = backups(t).withColumn("target_id", F.floor(F.col("target_id") / 10))
    p = F.col("target_id") % 3
    b = b.withColumn("policy", F.when(p == 0, "DAILY_7_WEEKLY_4_MONTHLY_12").when(p == 1, "HOURLY_24_DAILY_7_WEEKLY_4").otherwise("CUSTOM"))
    return W.retention_plan(b, ["target_id"], ["start_time", "operation_id"]).select("operation_id", "plan")


@query("w12_age_plan", f"""WITH {BACKUP_SQL} SELECT operation_id, CASE WHEN start_time < (SELECT max(start_time) FROM bk) - INTERVAL 900 DAY AND status <> 'completed' THEN 'delete' ELSE 'keep' END AS plan FROM bk""")
def _(t):
    return W.age_plan(backups(t), 900, "start_time", "status", protected=("completed",)).select("operation_id", "plan")


@query("w13_due_targets", f"""WITH {BACKUP_SQL}, l AS (SELECT target_id, max(end_time) AS last FROM bk WHERE status = 'completed' GROUP BY target_id)
SELECT c_custkey AS target_id FROM customer LEFT JOIN l ON c_custkey = target_id WHERE last IS NULL OR last < (SELECT max(end_time) FROM bk) - INTERVAL 300 DAY""")
def _(t):
    b = backups(t)
    targets = t.read("customer").select(F.col("c_custkey").alias("target_id"))
    return W.due_targets(targets, b, b.agg(F.max("end_time")).scalar(), hours=300 * 24).select("target_id")


COUNTER = f"""{PTS}, ct AS (SELECT event_id, ts, host, round(value) AS v, lag(round(value)) OVER (PARTITION BY host ORDER BY ts, event_id) AS p, lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) AS pt FROM pts),
 cs AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END AS step FROM ct)"""


def counters(t):
    return t.points.select("event_id", "ts", "host", F.round("value").alias("value"))


DAY_FRAME = "(PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW)"


@query("w14_rate", f"WITH {COUNTER} SELECT event_id, sum(step) OVER {DAY_FRAME} AS increase, round(sum(step) OVER {DAY_FRAME} / 86400, 9) AS rate FROM cs")
def _(t):
    d = W.increase(counters(t), ["host"], "ts", "event_id", 86400)
    return W.rate(d, ["host"], "ts", "event_id", 86400).select("event_id", "increase", r6("rate", 9).alias("rate"))


@query("w15_irate", f"WITH {COUNTER} SELECT event_id, coalesce(round((CASE WHEN v < p THEN v ELSE v - p END) / ((epoch_us(ts) - epoch_us(pt)) / 1e6), 9), -1) AS irate FROM cs")
def _(t):
    return W.irate(counters(t), ["host"], "ts", "event_id").select("event_id", F.coalesce(r6("irate", 9), F.lit(-1.0)).alias("irate"))


@query("w16_changes", f"WITH {COUNTER}, c AS (SELECT *, (p IS NOT NULL AND p <> v)::INT AS ch FROM ct) SELECT event_id, (sum(ch) OVER {DAY_FRAME})::BIGINT AS changes FROM c")
def _(t):
    return W.changes(counters(t), ["host"], "ts", "event_id", 86400).select("event_id", "changes")


@query("w17_histogram_quantile", """WITH b AS (SELECT event_type AS metric, le, count(*) FILTER (value <= le) AS c FROM events, (VALUES (10.0), (25.0), (50.0), (100.0), (200.0), ('inf'::DOUBLE)) x(le) GROUP BY ALL),
 r AS (SELECT *, lag(le) OVER w AS lo, lag(c) OVER w AS below, max(c) OVER (PARTITION BY metric) * 0.95 AS rank FROM b WINDOW w AS (PARTITION BY metric ORDER BY le))
SELECT metric, round(CASE WHEN le = 'inf'::DOUBLE THEN 200.0 ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (rank - coalesce(below, 0)) / (c - coalesce(below, 0)) END, 6) AS quantile FROM r WHERE c >= rank AND coalesce(below, -1) < rank""")
def _(t):
    les = [10.0, 25.0, 50.0, 100.0, 200.0, float("inf")]
    b = t.points.groupBy("metric", "host").agg(F.map_from_arrays(
        F.array(*[F.lit(x) for x in les]), F.array(*[F.count_if(F.col("value") <= x) for x in les])).alias("m")) \
        .select("metric", "host", F.explode("m").alias("le", "count"))
    return W.histogram_quantile(b, ["metric"], 0.95).withColumn("quantile", r6("quantile"))


@query("w18_absent", f"WITH {PTS} SELECT DISTINCT device FROM pts WHERE device NOT IN (SELECT device FROM pts WHERE ts > (SELECT max(ts) FROM pts) - INTERVAL 8 HOUR)")
def _(t):
    return W.absent(t.points, t.points.select("device").distinct(), ["device"], 8 * 3600)


@query("w19_held_for", f"""WITH {PTS}, {ISLAND_SQL.replace('value > 60', 'value > 20')} SELECT metric, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS samples FROM is2 GROUP BY metric, grp HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 7200000000""")
def _(t):
    return W.held_for(t.points, ["metric"], TE, F.col("value") > 20, 7200).select(
        "metric", us("start").alias("start_us"), us("end").alias("end_us"), "samples")


@query("w20_ingest_lag", f"WITH {PTS} SELECT device, round((epoch_us((SELECT max(ts) FROM pts)) - epoch_us(max(ts))) / 1e6, 6) AS lag_s, epoch_us((SELECT max(ts) FROM pts)) - epoch_us(max(ts)) > 120000000 AS late FROM pts GROUP BY device")
def _(t):
    return W.ingest_lag(t.points, ["device"]).select("device", r6("lag_s").alias("lag_s"), "late")


@query("w21_export_status", """SELECT (SELECT count(*) FROM events) AS events, 48.0::DOUBLE AS age_h, 'stale' AS problems, FALSE AS ok""")
def _(t):
    newest = t.events.agg(F.max("ts")).scalar()
    written = F.timestamp_micros(F.unix_micros(newest) - 48 * 3_600_000_000)
    return W.export_status(K.export_summary({"events": t.events, "customer": t.read("customer")}), written, newest).withColumn("age_h", r6("age_h"))


# --- ranking and sets -----------------------------------------------------

@query("l01_by_time", "SELECT event_id, epoch_us(ts) AS ts_us FROM events ORDER BY ts, event_id")
def _(t):
    return L.by_time(t.events, tie=("event_id",)).select("event_id", us("ts").alias("ts_us"))


@query("l02_top_containers", """(SELECT 'cpu' AS by_, event_id::VARCHAR AS name, value AS amount FROM events WHERE event_id % 10 > 1 AND value > 0 ORDER BY value DESC, name LIMIT 5)
UNION ALL (SELECT 'memory', event_id::VARCHAR, user_id FROM events WHERE event_id % 10 > 1 AND value > 0 ORDER BY user_id DESC, 2 LIMIT 5)""")
def _(t):
    d = t.events.select(F.col("event_id").cast("string").alias("name"),
                        F.when(F.col("event_id") % 10 > 1, "running").otherwise("exited").alias("status"),
                        F.col("value").alias("cpu_percent"), F.col("user_id").cast("double").alias("memory_percent"))
    return L.top_containers(d).select(F.lit("cpu").alias("by_"), "name", F.col("cpu_percent").alias("amount")).unionByName(
        L.top_containers(d, "memory_percent").select(F.lit("memory").alias("by_"), "name", F.col("memory_percent").alias("amount")))


@query("l03_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(t):
    return L.recent(t.events).select("event_id", "event_type")


@query("l04_next_tasks", "SELECT event_id, user_id % 10 AS priority FROM events ORDER BY priority DESC, event_id LIMIT 5")
def _(t):
    return L.next_tasks(t.events.select("event_id", (F.col("user_id") % 10).alias("priority")), tie="event_id")


@query("l05_top_insights", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS description
FROM documents WHERE lang IN ('en','fr') ORDER BY lang, doc_id LIMIT 3""")
def _(t):
    d = t.read("documents").select("doc_id", F.when(F.col("lang") == "en", "critical").when(F.col("lang") == "fr", "warning").otherwise("info").alias("severity"),
                                   F.col("text").alias("description"))
    return L.top_insights(d, tie=("doc_id",))


@query("l06_remediation_order", """SELECT event_id, CASE WHEN value >= 70 THEN 'FAIL' ELSE 'WARN' END AS status, row_number() OVER (ORDER BY value < 70, event_id) AS step FROM events WHERE value >= 30""")
def _(t):
    from pulsegrid.scale import positions
    d = t.events.where("value >= 30").select("event_id", F.when(F.col("value") >= 70, "FAIL").otherwise("WARN").alias("status"), F.col("event_id").alias("pos"))
    ordered = L.remediation_order(d)
    return positions(ordered.withColumn("plan", F.lit(0)), ["plan"], [F.col("status") != "FAIL", F.col("pos")], "step") \
        .select("event_id", "status", (F.col("step") + 1).alias("step"))


@query("l07_restart_candidate", """SELECT event_id::VARCHAR AS name, value AS memory_percent FROM events WHERE value > 90 ORDER BY value DESC, name LIMIT 1""")
def _(t):
    return L.restart_candidate(t.events.select(F.col("event_id").cast("string").alias("name"), F.col("value").alias("memory_percent")))


@query("u01_all_findings", f"WITH {HOSTS_SQL} SELECT event_id, 'issue' AS src, level AS level, coalesce(severity, '-') AS severity FROM (SELECT event_id, CASE WHEN cpu >= 90 THEN 'critical' ELSE 'warning' END AS level, NULL AS severity FROM ht WHERE cpu >= 80) UNION ALL SELECT event_id, 'bottleneck', '-', CASE WHEN cpu > 95 THEN 'high' ELSE 'medium' END FROM ht WHERE cpu > 80")
def _(t):
    h = host_rows(t)
    a = P.host_issues(h, ["event_id"], {"cpu": (80.0, 90.0)}).withColumn("src", F.lit("issue"))
    b = P.bottlenecks(h, ["event_id"]).where("type = 'cpu'").withColumn("src", F.lit("bottleneck"))
    return L.all_findings(a, b).select("event_id", "src", F.coalesce("level", F.lit("-")).alias("level"),
                                       F.coalesce("severity", F.lit("-")).alias("severity"))


@query("u02_concat_metric", "SELECT value AS value FROM events UNION ALL SELECT c_acctbal FROM customer")
def _(t):
    return L.concat_metric([t.events, t.read("customer").withColumnRenamed("c_acctbal", "value"), t.read("nation")], "value")


@query("u03_distinct_recs", "SELECT unnest(['add_cpu_capacity','look_for_runaway_process','profile_cpu_hogs','add_storage','free_disk_space','review_retention']) AS recommendation WHERE (SELECT count(*) FROM events WHERE event_type IN ('view','error')) > 0")
def _(t):
    from pulsegrid.functions.scalars import recommendations
    e = F.col("event_type")
    m = F.when(e == "view", "cpu_percent").when(e == "error", "disk_percent").otherwise("other")
    return L.distinct_recs(t.events.select(recommendations(m, "anomaly").alias("recommendations")))


@query("u04_common_keys", f"WITH {PTS} SELECT host AS metric, 'a' AS label FROM pts GROUP BY host UNION ALL SELECT host, 'b' FROM pts GROUP BY host HAVING min(value) > 0.2")
def _(t):
    m = F.when(F.col("value") > 0.2, F.create_map(F.lit("a"), "device", F.lit("b"), "metric")).otherwise(F.create_map(F.lit("a"), "device"))
    return G.common_keys(t.points.select(F.col("host").alias("metric"), m.alias("labels")))


@query("u05_alerts_to_send", f"WITH {ALERT_SQL} SELECT DISTINCT metric AS issue FROM al WHERE severity = 'critical' OR metric NOT IN (SELECT metric FROM al WHERE service = 'svc1')")
def _(t):
    a = alerts(t)
    issues = a.select(F.col("metric").alias("issue"), (F.col("severity") == "critical").alias("critical"))
    return L.alerts_to_send(issues, a.where("service = 'svc1'").select(F.col("metric").alias("issue")).distinct())


# --- statistics -----------------------------------------------------------

@query("m04_sigma_outliers", f"WITH {PTS}, s AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM pts GROUP BY metric) SELECT event_id, metric, value FROM pts JOIN s USING (metric) WHERE n >= 3 AND abs(value - m) > 2 * s")
def _(t):
    return M.sigma_outliers(t.points, ["metric"]).select("event_id", "metric", "value")


@query("m05_deviation_severity", f"""WITH {PTS}, s AS (SELECT device, avg(value) AS m, count(*) FILTER (value > 60 AND value < 75) AS a, max(CASE WHEN value > 60 AND value < 75 THEN value END) AS hi, min(CASE WHEN value > 60 AND value < 75 THEN value END) AS lo FROM pts GROUP BY device)
SELECT device, a AS anomalies, round(greatest(abs(hi - m), abs(lo - m)), 6) AS max_deviation, CASE WHEN greatest(abs(hi - m), abs(lo - m)) > m * 0.5 THEN 'high' WHEN greatest(abs(hi - m), abs(lo - m)) > m * 0.2 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE a > 0""")
def _(t):
    d = t.points.withColumn("is_anomaly", (F.col("value") > 60) & (F.col("value") < 75))
    return M.deviation_severity(d, ["device"]).select("device", "anomalies", r6("max_deviation").alias("max_deviation"), "severity")


@query("m06_standard_scale", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS v, round((user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_pop(user_id) FROM events), 6) AS u FROM events")
def _(t):
    return M.standard_scale(t.events, ["value", "user_id"]).select("event_id", r6("value_scaled").alias("v"), r6("user_id_scaled").alias("u"))


@query("m07_minmax", f"WITH {PTS}, s AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM pts GROUP BY metric) SELECT event_id, round((value - lo) / (hi - lo), 6) AS s, value AS back FROM pts JOIN s USING (metric)")
def _(t):
    d = M.minmax_inverse(M.minmax_scale(t.points, ["metric"], "value", "s"), "s", "s", "back")
    return d.select("event_id", r6("s").alias("s"), r6("back", 2).alias("back"))


TREND_SQL = """tr AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'cpu_usage' WHEN 'click' THEN 'memory_usage' ELSE event_type END AS metric,
 CASE event_type WHEN 'view' THEN 40 + value / 10 + (epoch_us(ts) - 1704067200000000) / 86400000000.0 * 2 WHEN 'click' THEN 80 + value / 50 - (epoch_us(ts) - 1704067200000000) / 86400000000.0
 WHEN 'purchase' THEN 60 + value / 100 + (epoch_us(ts) - 1704067200000000) / 86400000000.0 / 2 ELSE value END AS value FROM events)"""


def trending(t: Tables):
    """Events with a rising, a falling, a slowly rising and two flat series."""
    m, v = F.col("metric"), F.col("value")
    day = (F.unix_micros("ts") - F.lit(1704067200000000)) / 86400000000.0
    return t.points.select(
        "event_id", "ts", F.when(m == "view", "cpu_usage").when(m == "click", "memory_usage").otherwise(m).alias("metric"),
        F.when(m == "view", 40 + v / 10 + day * 2).when(m == "click", 80 + v / 50 - day)
        .when(m == "purchase", 60 + v / 100 + day / 2).otherwise(v).alias("value"))


@query("m09_trend_forecast", f"""WITH {TREND_SQL}, h AS (SELECT metric, date_trunc('hour', ts) AS b, avg(value) AS v FROM tr GROUP BY ALL), e AS (SELECT metric, min(b) AS lo, max(b) AS hi, date_diff('hour', min(b), max(b)) + 1 AS hours FROM h GROUP BY metric),
 f AS (SELECT metric, hours, hi, regr_slope(v, x) AS sl, regr_intercept(v, x) AS ic, regr_r2(v, x) AS r2, var_pop(v) AS var FROM (SELECT h.metric, v, hours, hi, date_diff('hour', lo, b)::DOUBLE AS x FROM h JOIN e USING (metric)) GROUP BY metric, hours, hi),
 g AS (SELECT *, sl * (hours + i - 1) + ic AS p, sqrt(var * (1 - r2)) AS sg, greatest(sl * hours + ic, sl * (hours + 23) + ic) > 90 AND metric IN ('cpu_usage','memory_usage','disk_usage') AS alert FROM f, generate_series(1, 24) s(i))
SELECT metric, i::INT AS step, epoch_us(hi) + i * 3600000000 AS at_us, round(p, 6) AS predicted, round(p - 2 * sg, 6) AS lower, round(p + 2 * sg, 6) AS upper, round(r2, 6) AS accuracy, CASE WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, alert FROM g""")
def _(t):
    f = M.trend_forecast(trending(t))
    return f.select("metric", "step", us("at").alias("at_us"), *[r6(c).alias(c) for c in ("predicted", "lower", "upper", "accuracy")], "trend", "alert")


SPLIT = "('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000"


@query("m11_evaluate", f"""WITH {PTS}, x AS (SELECT *, {SPLIT} >= 200 AS train FROM pts), m AS (SELECT metric, avg(value) AS p FROM x WHERE train GROUP BY metric)
SELECT metric, count(*) AS n, round(avg(abs(value - p)), 6) AS mae, round(avg((value - p) * (value - p)), 6) AS mse, round(1 - avg(abs(value - p)) / avg(value), 6) AS accuracy FROM x JOIN m USING (metric) WHERE NOT train GROUP BY metric""")
def _(t):
    train, test = M.hash_split(t.points, "event_id")
    model = train.groupBy("metric").agg(F.avg("value").alias("predicted"))
    e = M.evaluate(test.join(model, "metric").withColumnRenamed("value", "actual"), ["metric"])
    return e.withColumns({c: r6(c) for c in ("mae", "mse", "accuracy")})


LINE = f"""{TREND_SQL}, ps AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) - 1 AS i, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS z FROM tr),
 ln AS (SELECT metric, count(*) AS n, regr_slope(value, i) AS sl, regr_intercept(value, i) AS ic, corr(value, i) AS r, regr_r2(value, i) AS r2, arg_max(value, i) AS cur, avg(value) FILTER (i < 10) AS h10, avg(value) FILTER (z <= 10) AS t10,
 avg(value) FILTER (i < 24) AS h24, avg(value) FILTER (z <= 24) AS t24 FROM ps GROUP BY metric)"""


@query("m12_performance_trends", f"""WITH {LINE} SELECT metric, n, round(sl, 6) AS slope, round(r, 6) AS r, TRUE AS significant, round((t10 - h10) / h10 * 100, 6) AS change_pct, CASE WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
 CASE WHEN abs((t10 - h10) / h10 * 100) > 50 THEN 'critical' ELSE 'warning' END AS severity FROM ln WHERE n >= 20 AND abs(r) > 0.7 AND abs((t10 - h10) / h10 * 100) > 20""")
def _(t):
    return M.performance_trends(trending(t)).select("metric", "n", r6("slope").alias("slope"), r6("r").alias("r"), (F.col("p_value") < 0.05).alias("significant"),
                                                    r6("change_pct").alias("change_pct"), "direction", "severity")


@query("m13_capacity_plan", f"""WITH {LINE}, g AS (SELECT *, (t24 - h24) / h24 * 100 AS gr FROM ln WHERE n >= 100)
SELECT metric, round(t24, 6) AS current, round(gr, 6) AS growth_pct, round((90 - t24) / (gr / 7), 6) AS days_to_90, round(t24 + gr * 4.28, 6) AS projected_30d, CASE WHEN (90 - t24) / (gr / 7) < 7 THEN 'critical' ELSE 'warning' END AS severity FROM g WHERE gr > 0 AND (90 - t24) / (gr / 7) < 30""")
def _(t):
    return M.capacity_plan(trending(t)).withColumns({c: r6(c) for c in ("current", "growth_pct", "days_to_90", "projected_30d")})


@query("m14_exhaustion", f"""WITH {PTS}, p AS (SELECT device || metric AS k, value, row_number() OVER (PARTITION BY device, metric ORDER BY ts, event_id) - 1 AS i FROM pts), a AS (SELECT k, count(*) AS n, regr_slope(value, i) AS sl, arg_max(value, i) AS cur FROM p GROUP BY k)
SELECT k, cur AS current, round(sl, 6) AS slope, round((95 - cur) / sl, 4) AS steps, CASE WHEN (95 - cur) / sl < 20 THEN 'critical' ELSE 'warning' END AS severity FROM a WHERE n >= 3 AND sl > 0 AND cur > 70 AND (95 - cur) / sl < 60""")
def _(t):
    d = t.points.withColumn("k", F.concat("device", "metric"))
    return M.exhaustion(d, ["k"]).withColumns({"slope": r6("slope"), "steps": r6("steps", 4)})


@query("m15_classify_behavior", f"WITH {PTS}, {BEHAVIOR_SQL} SELECT * FROM bd")
def _(t):
    return M.classify_behavior(t.points.withColumn("metric", F.concat_ws("/", "device", "metric")))


@query("m16_linear_forecast", f"WITH {LINE} SELECT metric, round(sl * (n + 24) + ic, 6) AS forecast, round(greatest(0, least(1, r2)), 6) AS confidence, round(sl, 6) AS slope FROM ln WHERE n >= 5")
def _(t):
    return M.linear_forecast(trending(t)).withColumns({c: r6(c) for c in ("forecast", "confidence", "slope")})


@query("m17_correlations", f"""WITH {TREND_SQL}, p AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS i FROM tr),
 c AS (SELECT x.metric AS a, y.metric AS b, corr(x.value, y.value) AS r FROM p x JOIN p y ON x.i = y.i AND x.metric < y.metric GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM c WHERE abs(r) > 0.7""")
def _(t):
    return M.correlations(trending(t)).withColumn("correlation", r6("correlation"))
