"""Queries for streams, which read the event file as a stream, and for the registries."""

from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as G, registry as X
from pulsegrid.plans.registry import NODE_SQL, PTS, REQ_SQL, Tables, query, r6, us
from pulsegrid.plans.relational_queries import QUALITY, extreme
from pulsegrid.plans.scalar_queries import EDGE, PROCESSED_SQL, edge, processed_text
from pulsegrid.sources import readers as R
from pulsegrid.streaming import streams as St


class Live(Tables):
    """The same shapes over a stream of the events file."""

    @property
    def events(self):
        return St.events_stream(self.spark, self.path)


def live(t: Tables) -> Live:
    return Live(t.spark, t.path)


@query("t01_ingest", f"WITH {EDGE} SELECT event_id, {QUALITY} AS quality, age_s::DOUBLE AS latency_s FROM edge")
def _(t):
    d = extreme(edge(live(t))).withColumn("received", F.timestamp_micros(F.unix_micros("ts") + F.col("age_s") * 1_000_000))
    return St.run_append(St.ingest(d, "raw", received="received").select("event_id", "quality", "latency_s"))


@query("t02_route", PROCESSED_SQL)
def _(t):
    return St.run_append(processed_text(St.route(edge(live(t)))))


TEMP_SQL = f"""{EDGE}, tp AS (SELECT event_id, ts, value / 20 + 68 AS value FROM edge WHERE metric_name = 'temperature'),
 th AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM tp WINDOW w AS (ORDER BY ts, event_id ROWS 99 PRECEDING))"""


def temperatures(t):
    return St.with_us(edge(t).where("metric_name = 'temperature'").withColumn("value", F.col("value") / 20 + 68)) \
        .select("event_id", "ts", "us", "metric_name", "value")


@query("t03_detect_temperature", f"""WITH {TEMP_SQL} SELECT event_id, CASE WHEN value < 60 OR value > 80 THEN 'threshold_violation' ELSE 'statistical_outlier' END AS kind,
 CASE WHEN value < 60 OR value > 80 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM th WHERE value < 60 OR value > 80 OR (n > 20 AND abs(value - m) > 2 * s)""")
def _(t):
    return St.temperature_stream(temperatures(live(t))).select("event_id", "kind", "confidence")


@query("t04_detect_motion", f"WITH {EDGE} SELECT event_id, 'unusual_timing' AS kind, 0.6::DOUBLE AS confidence FROM edge WHERE metric_name = 'motion' AND value > 0 AND (hour(ts) < 6 OR hour(ts) > 22)")
def _(t):
    return St.run_append(St.detect_motion(edge(live(t)).where("metric_name = 'motion'")).select("event_id", "kind", "confidence"))


@query("t05_detect_energy_network", f"""WITH {EDGE}, e AS (SELECT *, avg(value) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING) AS m, row_number() OVER (ORDER BY ts, event_id) AS n FROM edge WHERE metric_name = 'energy')
SELECT event_id, 'consumption_spike' AS kind, 0.9::DOUBLE AS confidence FROM e WHERE n > 10 AND value > m * 2 UNION ALL SELECT event_id, 'high_latency', 0.8 FROM edge WHERE metric_name = 'latency' AND value * 10 > 500""")
def _(t):
    e = St.with_us(edge(live(t)).where("metric_name = 'energy'"))
    spikes = St.energy_stream(e).select("event_id", "kind", "confidence")
    n = edge(live(t)).where("metric_name = 'latency'").withColumn("value", F.col("value") * 10)
    return spikes.unionByName(St.run_append(St.detect_network(n).select("event_id", "kind", "confidence")))


def rule_breaches(t):
    """Samples against a limit of 40, one rule per metric."""
    return St.with_us(t.points).select("event_id", "us", F.concat(F.lit("r_"), "metric").alias("rule_id"), "host",
                                       (F.col("value") > 40).alias("breach"))


@query("t06_alert_lifecycle", f"""WITH {PTS}, b AS (SELECT event_id, epoch_us(ts) AS us, 'r_' || metric AS rule_id, host, value > 40 AS hit, coalesce(lag(value > 40) OVER w, FALSE) AS was FROM pts WINDOW w AS (PARTITION BY metric, host ORDER BY ts, event_id)),
 c AS (SELECT *, last_value(CASE WHEN hit AND NOT was THEN us END IGNORE NULLS) OVER w AS first_us, last_value(CASE WHEN hit THEN us END IGNORE NULLS) OVER w AS last_us FROM b WINDOW w AS (PARTITION BY rule_id, host ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, rule_id, host, CASE WHEN hit THEN 'open' ELSE 'resolve' END AS event, first_us, last_us FROM c WHERE hit <> was""")
def _(t):
    return St.run_append(St.alert_lifecycle(rule_breaches(live(t)))).select("event_id", "rule_id", "host", "event", "first_us", "last_us")


@query("t07_rate_limit", f"""WITH RECURSIVE {PTS}, n AS (SELECT event_id, epoch_us(ts) AS us, 'r_' || metric AS rule_id FROM pts WHERE value > 60),
 s AS (SELECT rule_id, min(us) AS us FROM n GROUP BY rule_id UNION ALL SELECT n.rule_id, min(n.us) FROM s JOIN n ON n.rule_id = s.rule_id AND n.us > s.us + 14400000000 GROUP BY n.rule_id)
SELECT event_id, n.rule_id, s.us IS NOT NULL AS sent FROM n LEFT JOIN s ON n.rule_id = s.rule_id AND n.us = s.us""")
def _(t):
    n = St.with_us(live(t).points.where("value > 60")).select(
        "event_id", "us", F.concat(F.lit("r_"), "metric").alias("rule_id"), F.lit("slack").alias("channel"))
    return St.run_append(St.rate_limit(n, 4 * 3600)).select("event_id", "rule_id", "sent")


@query("t08_batch_stats", f"""WITH {PTS} SELECT host, metric, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(avg(sqrt(value)), 6) AS mean, round(min(sqrt(value)), 6) AS min, round(max(sqrt(value)), 6) AS max, round(coalesce(stddev_samp(sqrt(value)), 0), 6) AS stdev FROM pts GROUP BY ALL""")
def _(t):
    p = live(t).points.withColumn("value", F.sqrt("value"))
    s = St.run_update(St.batch_stats(p, ["host", "metric"], 60), ["host", "metric", "start"])
    return s.select("host", "metric", us("start").alias("start_us"), "n", *[r6(c).alias(c) for c in ("mean", "min", "max", "stdev")])


@query("t09_window_rules", f"""WITH {PTS}, w AS (SELECT host, epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) + (i + 1) * 60000000 AS end_us, avg(sqrt(value)) AS mean FROM pts, generate_series(0, 4) g(i) GROUP BY ALL)
SELECT host, end_us, round(mean, 6) AS mean FROM w WHERE mean > 9""")
def _(t):
    p = live(t).points.withColumn("value", F.sqrt("value"))
    return St.window_rules(p, ">", 9.0).select("host", us("end").alias("end_us"), r6("mean").alias("mean"))


@query("t10_dedupe_alerts", f"WITH {PTS} SELECT DISTINCT md5('alertname=' || metric || '|instance=' || host) AS fingerprint FROM pts WHERE value > 60")
def _(t):
    from pulsegrid.functions.scalars import alert_fingerprint
    a = live(t).points.where("value > 60").select("ts", alert_fingerprint(
        F.create_map(F.lit("alertname"), "metric", F.lit("instance"), "host")).alias("fingerprint"))
    return St.run_append(St.dedupe_alerts(a, watermark="60 days")).select("fingerprint")


@query("t11_group_alerts", f"""WITH RECURSIVE {PTS}, a AS (SELECT event_id, host, epoch_us(ts) AS us, event_id % 2 = 0 AS fresh,
  CASE WHEN value > 150 THEN 'critical-alerts' WHEN value > 90 THEN 'warning-alerts' ELSE 'web.hook' END AS receiver,
  CASE WHEN value > 150 THEN 30000000 WHEN value > 90 THEN 120000000 ELSE 300000000 END AS wait, 300000000 AS every,
  CASE WHEN value > 150 THEN 1800000000 WHEN value > 90 THEN 3600000000 ELSE 7200000000 END AS repeat FROM pts WHERE value > 60),
 q AS (SELECT *, row_number() OVER (PARTITION BY host, receiver ORDER BY us, event_id) AS pos FROM a),
 g AS (SELECT host, receiver, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::BIGINT AS flush, NULL::BIGINT AS seen, NULL::BIGINT AS sent, NULL::BIGINT AS notify_us, NULL::VARCHAR AS reason FROM q GROUP BY host, receiver
 UNION ALL SELECT host, receiver, pos, event_id, flush, us, CASE WHEN due THEN flush ELSE sent END, CASE WHEN due THEN flush ELSE -1 END,
  CASE WHEN NOT due THEN 'suppressed' WHEN begins THEN 'first' WHEN NOT fresh AND sent <> flush THEN 'repeat' ELSE 'update' END
  FROM (SELECT *, fresh OR sent IS NULL OR sent = flush OR flush - sent >= repeat AS due FROM
   (SELECT host, receiver, pos, event_id, us, fresh, repeat, begins, CASE WHEN begins THEN us + wait WHEN us > flush THEN flush + ((us - flush + every - 1) // every) * every ELSE flush END AS flush,
     CASE WHEN NOT begins THEN sent END AS sent FROM
    (SELECT q.*, g.flush, g.sent, g.flush IS NULL OR q.us > greatest(g.seen, g.flush) + 300000000 AS begins FROM g JOIN q ON q.host = g.host AND q.receiver = g.receiver AND q.pos = g.pos + 1))))
SELECT event_id, host, receiver, notify_us, reason FROM g WHERE pos > 0""")
def _(t):
    from pulsegrid.operators.joins import route_alerts
    v = F.col("value")
    a = St.with_us(live(t).points.where("value > 60")).select(
        "event_id", "us", "host", F.lit("web").alias("service"), F.col("metric").alias("alertname"),
        F.when(v > 150, "critical").when(v > 90, "warning").otherwise("info").alias("severity"), (F.col("event_id") % 2 == 0).alias("is_new"))
    return St.run_append(St.group_alerts(route_alerts(a), ["host", "receiver"])).select(
        "event_id", "host", "receiver", "notify_us", "reason")


@query("t12_breaker_states", f"""WITH RECURSIVE {REQ_SQL}, q AS (SELECT event_id, src, dst, epoch_us(ts) AS us, success, row_number() OVER (PARTITION BY src, dst ORDER BY ts, event_id) AS pos FROM rq),
 b AS (SELECT src, dst, 0::BIGINT AS pos, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS f, 0 AS s, 0::BIGINT AS last, FALSE AS executed FROM q GROUP BY src, dst
 UNION ALL SELECT src, dst, pos, event_id,
  CASE WHEN st = 'open' THEN 'open' WHEN success THEN CASE WHEN st = 'half_open' THEN CASE WHEN s0 + 1 >= 2 THEN 'closed' ELSE 'half_open' END ELSE 'closed' END ELSE CASE WHEN st = 'half_open' OR f + 1 >= 3 THEN 'open' ELSE 'closed' END END,
  CASE WHEN st = 'open' THEN f WHEN success THEN CASE WHEN st = 'half_open' THEN CASE WHEN s0 + 1 >= 2 THEN 0 ELSE f END ELSE greatest(0, f - 1) END ELSE f + 1 END,
  CASE WHEN st = 'half_open' AND success THEN s0 + 1 ELSE s0 END,
  CASE WHEN st <> 'open' AND NOT success THEN us ELSE last END, st <> 'open'
  FROM (SELECT q.*, b.f, b.last, CASE WHEN b.state = 'open' AND q.us - b.last > 28800000000 THEN 'half_open' ELSE b.state END AS st, CASE WHEN b.state = 'open' AND q.us - b.last > 28800000000 THEN 0 ELSE b.s END AS s0
   FROM b JOIN q ON q.src = b.src AND q.dst = b.dst AND q.pos = b.pos + 1))
SELECT event_id, state, executed, f::BIGINT AS failures FROM b WHERE pos > 0""")
def _(t):
    d = St.with_us(live(t).requests).drop("ts")
    return St.run_append(St.breaker_states(d, failures=3, recovery_s=8 * 3600, successes=2)) \
        .select("event_id", "state", "executed", "failures")


@query("t13_recovery_state", f"""WITH {PTS}, q AS (SELECT event_id, device, value < 80 AS ok, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS pos FROM pts),
 r AS (SELECT *, pos - coalesce(max(CASE WHEN ok THEN pos END) OVER (PARTITION BY device ORDER BY pos), 0) AS run FROM q),
 z AS (SELECT device, min(pos) AS stop FROM r WHERE run >= 3 GROUP BY device)
SELECT event_id, CASE WHEN stop IS NULL OR pos <= stop THEN 'attempt' ELSE 'blocked' END AS action, CASE WHEN stop IS NULL OR pos <= stop THEN run ELSE 3 END AS attempts FROM r LEFT JOIN z USING (device)""")
def _(t):
    d = St.with_us(live(t).points).select("event_id", "us", F.col("device").alias("service"), (F.col("value") < 80).alias("success"))
    return St.run_append(St.recovery_state(d)).select("event_id", "action", "attempts")


@query("t14_bounded_history", f"WITH {PTS} SELECT event_id, least(20, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)) AS history_size FROM pts")
def _(t):
    d = St.with_us(live(t).points).select("event_id", "us", "ts", "host")
    return St.run_append(St.bounded_history(d, ["host"], memory=20)).select("event_id", "history_size")


@query("t15_stream_stats", """SELECT count(*) AS processed, count(*) FILTER (value > 150) AS errors, round(1 - count(*) FILTER (value > 150) / count(*), 6) AS quality_score, round(avg(event_id % 400), 6) AS avg_latency FROM events""")
def _(t):
    d = live(t).events.withColumns({"latency": F.col("event_id") % 400, "k": F.lit(0)})
    s = St.stream_stats(d.groupBy("k"), F.col("value") > 150, "latency")
    return St.run_update(s, ["k"]).drop("k").withColumns({"quality_score": r6("quality_score"), "avg_latency": r6("avg_latency")})


# --- registries -----------------------------------------------------------

@query("x01_register_aggregation", f"""WITH {NODE_SQL}, x AS (SELECT metric || '@' || node AS metric, value FROM ns)
SELECT metric, CASE WHEN starts_with(metric, 'A') THEN 'spread' ELSE 'nonsense' END AS method, round(CASE WHEN starts_with(metric, 'A') THEN max(value) - min(value) ELSE avg(value) END, 2) AS value FROM x GROUP BY metric""")
def _(t):
    known = X.register_aggregation("spread", lambda v, w: F.max(v) - F.min(v))
    s = t.node_samples.withColumn("metric", F.concat_ws("@", "metric", "node"))
    rules = s.select(F.col("metric").alias("metric_name"),
                     F.when(F.col("metric").startswith("A"), "spread").otherwise("nonsense").alias("method")).distinct()
    return G.federate(s, rules, aggregations=known).select("metric", "method", r6("value", 2).alias("value"))


@query("x02_register_processor", f"""WITH {EDGE} SELECT event_id, CASE metric_name WHEN 'failed_login_attempts' THEN CASE WHEN value > 100 THEN 'loud' ELSE 'calm' END
 WHEN 'energy' THEN CASE WHEN value < 100 THEN 'excellent' WHEN value < 500 THEN 'good' WHEN value < 1000 THEN 'fair' ELSE 'poor' END END AS rating FROM edge WHERE metric_name IN ('failed_login_attempts','energy')""")
def _(t):
    known = X.register_processor("failed_login_attempts", lambda v, ts: (F.when(v > 100, "loud").otherwise("calm"), v))
    return X.process(edge(t), processors=known).where(F.col("metric_name").isin("failed_login_attempts", "energy")).select("event_id", "rating")


@query("x03_add_rule", """SELECT 'cpu_usage' AS metric, 'high_cpu_usage' AS rule_id, 50.0::DOUBLE AS threshold, count(*) AS breaches FROM events WHERE event_type = 'view' AND value > 50
UNION ALL SELECT 'other', 'odd', 10.0, count(*) FROM events WHERE event_type = 'signup' AND value > 10""")
def _(t):
    from pulsegrid.operators.joins import applicable_rules
    from pulsegrid.operators.predicates import breaches
    from pulsegrid.plans.source_queries import named_metrics
    rules = R.rules_df(t.spark)
    rules = X.add_rule(rules, ("high_cpu_usage", "Busy", "cpu_usage", ">", 50.0, "high", 300, 60, False, 300))
    rules = X.add_rule(rules, ("odd", "Odd", "other", ">", 10.0, "low", 300, 60, False, 300))
    d = applicable_rules(named_metrics(t), rules).where(F.col("rule_id").isin("high_cpu_usage", "odd"))
    return d.where(breaches("value", "op", "threshold")).groupBy("metric", "rule_id", "threshold").agg(F.count(F.lit(1)).alias("breaches"))
