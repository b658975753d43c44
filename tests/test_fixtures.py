"""Hand-computed results on small inputs (FIXTURES.md)."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import aggregates as G, joins as J, predicates as P, ranking as L, stats as M, windows as W
from pulsegrid.sources import readers as R, sinks as K
from pulsegrid.session import scratch_path

T0 = datetime(2025, 8, 7, 10, 0)


def one(df):
    return df.collect()[0].asDict()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- sensors --------------------------------------------------------------

def test_edge_points(spark):
    d = frame(spark, [("sensor-temp-01", "temperature", 72.5, T0), ("smart-plug-01", "energy", 125.7, T0),
                      ("motion-sensor-01", "motion", 1.0, T0), ("net-01", "latency", 150.0, T0),
                      ("login-01", "failed_login_attempts", 6.0, T0), ("x", "unknown", 1.0, T0)],
              "device_id string, metric_name string, value double, ts timestamp")
    r = {x.device_id: x for x in S.process_points(d).collect()}
    assert (r["sensor-temp-01"].rating, r["sensor-temp-01"].score) == ("comfortable", 0.875)
    assert r["smart-plug-01"].rating == "good" and abs(r["smart-plug-01"].score - 0.015084) < 1e-9
    assert r["motion-sensor-01"].triggers == ["lights_on", "security_recording"] and not r["motion-sensor-01"].alerts
    assert r["net-01"].suggestions == ["high_latency"] and r["net-01"].rating == "poor"
    assert r["login-01"].triggers == ["block_ip_temporarily"] and r["login-01"].rating == "high"
    assert r["x"].metric_class is None


@pytest.mark.parametrize("value,signal,age,want", [
    (72.5, -45, None, "high"), (999999999.0, -45, None, "low"), (25.0, -85, None, "low"), (None, -45, None, "invalid"),
    (25.0, -70, 400, "medium"), (25.0, -50, 400, "low"), (25.0, -50, 61, "medium"), (25.0, -50, 60, "high"), (-1e6, None, None, "high")])
def test_quality(spark, value, signal, age, want):
    d = frame(spark, [(value, signal, age)], "v double, s int, a int")
    assert d.select(P.data_quality("v", "s", "a")).first()[0] == want


@pytest.mark.parametrize("values,want", [
    ([10, 15, 20, 25, 30], "increasing"), ([30, 25, 20, 15, 10], "decreasing"), ([20, 19, 21, 20, 19, 21], "increasing"),
    ([5, 5, 5], "stable"), ([1, 2], "insufficient_data")])
def test_trend(spark, values, want):
    d = frame(spark, [("a", i, float(v)) for i, v in enumerate(values)], "k string, pos int, value double")
    r = one(W.trend_label(d, ["k"], ["pos"]))
    assert r["trend"] == want
    if len(values) == 6:
        assert abs(r["slope"] - 4 / 35) < 1e-12


# --- alerting -------------------------------------------------------------

@pytest.mark.parametrize("v,op,t,want", [
    (85.0, ">", 80.0, True), (75.0, ">", 80.0, False), (80.0, ">=", 80.0, True), (70.0, "<", 80.0, True), (90.0, "<", 80.0, False),
    (80.0005, "==", 80.0, True), (80.002, "==", 80.0, False), (80.002, "!=", 80.0, True), (1.0, "?", 0.0, False), (80.0, "<=", 80.0, True)])
def test_breaches(spark, v, op, t, want):
    assert frame(spark, [(v, op, t)], "v double, o string, t double").select(P.breaches("v", "o", "t")).first()[0] is want


def test_dynamic_threshold_needs_twenty_rows(spark):
    v = [45, 50, 48, 52, 47, 49, 51, 46, 53, 45]
    rows = [(i, "cpu", T0 + timedelta(seconds=i), float(v[i % 10]), 40.0, ">") for i in range(25)]
    d = frame(spark, rows, "event_id long, metric string, ts timestamp, value double, threshold double, op string")
    r = {x.event_id: x.dynamic_threshold for x in W.dynamic_threshold(d).collect()}
    assert r[9] == 40.0 and r[18] == 40.0
    import statistics
    h = [float(v[i % 10]) for i in range(20)]
    assert abs(r[19] - (statistics.mean(h) + 2 * statistics.stdev(h))) < 1e-9


def alert_rows(spark):
    rows = [("a1", T0, "system", "server1", "cpu_usage"), ("a2", T0 + timedelta(seconds=5), "system", "server1", "memory_usage"),
            ("a3", T0 + timedelta(minutes=5, seconds=4), "other", "server1", "disk_usage"),
            ("a4", T0 + timedelta(minutes=10, seconds=4), None, "server9", "disk_free"),
            ("a5", T0 + timedelta(minutes=30), None, None, "net_x"), ("a6", T0 + timedelta(minutes=35, seconds=1), None, None, "net_y")]
    return frame(spark, rows, "alert_id string, first_seen timestamp, service string, host string, metric string")


def test_correlate(spark):
    g = {r.alert_id: r.group_root for r in J.correlate(alert_rows(spark)).collect()}
    # a3 sees a2 (same host, 299 s) but not a1; a4 sees a3 by metric family at exactly 300 s; a6 is one second too late
    assert g == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a1", "a5": "a5", "a6": "a6"}
    cut = {r.alert_id: r.group_root for r in J.correlate(alert_rows(spark), limit=1).collect()}
    assert cut == g


def test_inhibit(spark):
    def al(i, **labels):
        return (i, labels)
    d = frame(spark, [al(1, alertname="NodeDown", instance="a"), al(2, alertname="HighLatency", instance="a"),
                      al(3, alertname="HighLatency", instance="b"), al(4, alertname="Disk", severity="critical", instance="c"),
                      al(5, alertname="Disk", severity="warning", instance="c"), al(6, alertname="Disk", severity="warning", instance="d"),
                      al(7, alertname="ServiceDown", instance="z"), al(8, alertname="InfrastructureDown", instance="z")],
              "id int, labels map<string,string>")
    assert sorted(r.id for r in J.inhibit(d).collect()) == [1, 3, 4, 6, 8]


def test_routes(spark):
    d = frame(spark, [(1, "critical", "wazuh"), (2, "warning", ""), (3, "info", "wazuh"), (4, None, None)], "id int, severity string, service string")
    r = {x.id: (x.receiver, x.group_wait_s, x.repeat_interval_s) for x in J.route_alerts(d).collect()}
    assert r == {1: ("critical-alerts", 30, 1800), 2: ("warning-alerts", 120, 3600), 3: ("security-alerts", 60, 1800), 4: ("web.hook", 300, 7200)}


def test_rules_and_prefixes(spark):
    rules = R.rules_df(spark)
    rules = R.add_rule(rules, ("service_down", "Down", "service", "<", 1.0, "low", 1, 1, False, 1))
    d = frame(spark, [("cpu_usage",), ("cpu_usage_total",), ("cpu",), ("service_status",)], "metric string")
    got = sorted((r.metric, r.rule_id, r.threshold) for r in J.applicable_rules(d, rules).collect())
    assert got == [("cpu_usage", "high_cpu_usage", 80.0), ("cpu_usage_total", "high_cpu_usage", 80.0), ("service_status", "service_down", 1.0)]


# --- containers and services ----------------------------------------------

STATS = {"cpu_stats": {"cpu_usage": {"total_usage": 110_000_000, "percpu_usage": [1, 1]}, "system_cpu_usage": 1_100_000_000},
         "precpu_stats": {"cpu_usage": {"total_usage": 100_000_000}, "system_cpu_usage": 1_000_000_000},
         "memory_stats": {"usage": 500_000_000, "limit": 1_000_000_000},
         "networks": {"eth0": {"rx_bytes": 1_000_000, "tx_bytes": 500_000}},
         "blkio_stats": {"io_service_bytes_recursive": [{"op": "Read", "value": 10_000_000}, {"op": "Write", "value": 5_000_000}]}}


def test_container_stats(spark):
    r = one(R.read_container_stats(frame(spark, [("a", json.dumps(STATS))], "name string, stats string")))
    assert (r["cpu_percent"], r["memory_percent"]) == (20.0, 50.0)
    assert (r["network_rx_bytes"], r["network_tx_bytes"], r["block_read_bytes"], r["block_write_bytes"]) == (1_000_000, 500_000, 10_000_000, 5_000_000)
    bare = one(R.read_container_stats(frame(spark, [("a", "{}")], "name string, stats string")))
    assert bare["memory_percent"] == 0.0 and bare["network_rx_bytes"] == 0


def test_resource_snapshot(spark):
    d = frame(spark, [(85.0, 90.0, 75.0)], "cpu double, memory double, disk double")
    assert sorted((r.resource, r.level) for r in P.host_issues(d).collect()) == [("cpu", "warning"), ("memory", "warning")]
    c = frame(spark, [("a", "running", 85.0, 45.0, "healthy"), ("b", "running", 25.0, 90.0, "healthy"), ("c", "running", 10.0, 20.0, "unhealthy"),
                      ("d", "error", 99.0, 99.0, "unhealthy")], "name string, status string, cpu_percent double, memory_percent double, health_status string")
    assert sorted((r.name, r.issue) for r in P.container_issues(c).collect()) == [("a", "high_cpu"), ("b", "high_memory"), ("c", "unhealthy")]
    assert [r.name for r in L.top_containers(c, n=2).collect()] == ["a", "b"]
    assert L.restart_candidate(c.where("name <> 'd'"), over=89.0).first().name == "b"
    assert L.restart_candidate(c.withColumn("name", F.concat(F.lit("My-Grafana-"), "name"))).isEmpty()


def test_service_state(spark):
    d = frame(spark, [("grafana", "running", "healthy", False, 0, 25, 100), ("prometheus", "running", "unhealthy", False, 3, 95, 100),
                      ("dead", "exited", None, False, 9, 1, 100), ("loop", "running", "unhealthy", True, 6, 99, 100)],
              "name string, status string, health string, restarting boolean, restart_count int, mem_usage long, mem_limit long")
    r = {x.name: x for x in S.service_health(d).withColumn("plan", S.recovery_plan("issues")).withColumn("score", S.health_score("health_status")).collect()}
    assert (r["grafana"].health_status, r["grafana"].score, r["grafana"].plan) == ("healthy", 100, "none")
    assert r["prometheus"].health_status == "warning" and len(r["prometheus"].issues) == 2 and r["prometheus"].plan == "restart"
    assert (r["dead"].health_status, r["dead"].plan) == ("critical", "start")
    assert r["loop"].health_status == "warning"
    w = {x.name: x.health_status for x in S.service_health(d, worst=True).collect()}
    assert w["loop"] == "critical" and w["prometheus"] == "critical"
    s = one(G.health_summary(S.service_health(d)))
    assert (s["total"], s["healthy"], s["warning"], s["critical"], s["health_pct"]) == (4, 1, 2, 1, 25.0)


def test_discovery(spark):
    d = frame(spark, [(True, 85), (True, 75)], "alive boolean, security_score int")
    r = one(G.discovery_summary(d))
    assert (r["alive_devices"], r["avg_security_score"]) == (2, 80.0)


# --- federation -----------------------------------------------------------

@pytest.mark.parametrize("n,want", [(1, 1.0), (10, 10.0), (20, 20.0), (21, 20.0)])
@pytest.mark.parametrize("limit", [None, 3])
def test_p95_rank(spark, n, want, limit):
    d = frame(spark, [("m", "n1", float(i + 1), 1.0) for i in range(n)], "metric string, node string, value double, weight double")
    rules = frame(spark, [("m", "percentile_95")], "metric_name string, method string")
    r = one(G.federate(d, rules, limit))
    assert r["value"] == want and abs(r["confidence"] - min(1, n / 10)) < 1e-9


def test_federate_methods(spark):
    d = frame(spark, [("a", "n1", 1.0, 1.0), ("a", "n2", 3.0, 3.0), ("b", "n1", 5.0, 0.0), ("c", "n1", 7.0, None), ("d", "n1", 1.0, 1.0), ("d", "n2", 2.0, 1.0)],
              "metric string, node string, value double, weight double")
    rules = frame(spark, [("a", "weighted_average"), ("b", "weighted_average"), ("c", "sum"), ("d", "who knows")], "metric_name string, method string")
    r = {x.metric: (x.value, round(x.confidence, 6)) for x in G.federate(d, rules).collect()}
    assert r == {"a": (2.5, 0.666667), "b": (0.0, 0.0), "c": (7.0, 0.2), "d": (1.5, 0.666667)}


def test_merge_labels(spark):
    d = frame(spark, [("m", {"job": "x", "zone": "1", "extra": "y"}), ("m", {"job": "x", "zone": "2"})], "metric string, labels map<string,string>")
    assert {(r.label, r.value) for r in G.merge_labels(d).collect()} == {("job", "x"), ("zone", "multiple[2]")}
    assert {r.label for r in G.common_keys(d).collect()} == {"job", "zone"}


# --- parsing --------------------------------------------------------------

def test_exposition(spark):
    lines = ["# HELP x", "", "up 1", 'http_total{code="200",path="/a=b"} 3.5', "bad abc", "no_value", "  spaced 2  ", 'e{} 1e3']
    r = {x.name: (dict(x.labels), x.value) for x in R.parse_exposition(frame(spark, [(x,) for x in lines], "line string")).collect()}
    assert r == {"up": ({}, 1.0), "http_total": ({"code": "200", "path": "/a=b"}, 3.5), "spaced": ({}, 2.0), "e": ({}, 1000.0)}


def test_vector_json(spark):
    ok = {"status": "success", "data": {"result": [{"metric": {"__name__": "up", "job": "a"}, "value": [1704067200.5, "1"]},
                                                   {"metric": {}, "value": [1, "NaNope"]}, {"metric": {"job": "b"}, "value": [2, "3"]}]}}
    d = frame(spark, [(json.dumps(ok),), (json.dumps({"status": "error"}),), ("junk",)], "body string")
    r = sorted((x.name, x.value) for x in R.parse_vector_json(d).collect())
    assert r == [("unknown", 3.0), ("up", 1.0)]


def test_raw_and_normalised_events(spark):
    objs = [{"_id": "", "id": 5, "mac": "AA", "time": 1000, "user": "AA", "ap": "", "ap_mac": "BB", "essid": "home", "subsystem": "wlan"}, {"name": "n"}]
    raw = R.raw_resource(frame(spark, [(json.dumps(o),) for o in objs] + [("{broken",)], "data string"), "events")
    r = {x.id: x.ts_ms for x in raw.collect()}
    assert r == {"AA": 1000, "n": None, None: None}
    e = {x.raw_id: x for x in R.normalize_events(raw).collect()}
    assert set(e) == {"AA", "n"}
    assert (e["AA"].ts_ms, e["AA"].mac, e["AA"].ap_mac, e["AA"].ssid, e["AA"].key) == (1000, "aa", "bb", "home", "wlan")


def test_normalised_clients_and_devices(spark):
    c = R.normalize_clients(R.raw_resource(frame(spark, [(json.dumps({"mac": "AB", "network": "lan", "device_name": "d", "last_seen_ms": 7}),)], "data string"), "clients")).first()
    assert (c.mac, c.ip, c.hostname, c.last_seen_ms, c.raw_id) == ("ab", "lan", "d", 7, "AB")
    d = R.normalize_devices(R.raw_resource(frame(spark, [(json.dumps({"mac": "X", "inform_ip": "1.2", "type": "ap", "fw_caps": 3}),)], "data string"), "devices")).first()
    assert (d.mac, d.ip, d.model, d.version) == ("x", "1.2", "ap", "3")


def test_read_export_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"meta": 1, "data": [\n {"x": 3}]}')
    assert sorted(json.loads(r.data)["x"] for r in R.read_export(spark, str(tmp_path)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("text,want", [
    ("30m", T0 - timedelta(minutes=30)), ("2h", T0 - timedelta(hours=2)), ("7d", T0 - timedelta(days=7)), ("1704067200", datetime(2024, 1, 1)),
    ("1704067200500", datetime(2024, 1, 1, 0, 0, 0, 500000)), ("2024-01-01", datetime(2024, 1, 1)), ("2024-01-01T02:00:00+02:00", datetime(2024, 1, 1)),
    ("soon", None)])
def test_parse_time(spark, text, want):
    assert frame(spark, [(text, T0)], "s string, t timestamp").select(S.parse_time("s", "t")).first()[0] == want


def test_fingerprint_is_md5_of_pairs(spark):
    d = frame(spark, [({"alertname": "A", "job": "j", "zone": "z"},)], "m map<string,string>")
    assert d.select(S.alert_fingerprint("m")).first()[0] == hashlib.md5(b"alertname=A|job=j").hexdigest()


def test_checksum_of_files(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"backup")
    want = hashlib.sha256(b"backup").hexdigest()
    f = spark.read.format("binaryFile").load(str(tmp_path))
    assert f.select(S.checksum_ok("content", F.lit(want)), S.checksum_ok("content", F.lit("x"))).first()[:] == (True, False)


def test_logs_carry_path_and_labels(spark, tmp_path):
    (tmp_path / "one.log").write_text("a\nb error\n")
    (tmp_path / "two.txt").write_text("c\n")
    r = R.read_logs(spark, str(tmp_path / "*.log"), {"job": "varlogs", "host": "h"}).collect()
    assert sorted((x.line, x.job, x.path.endswith("one.log")) for x in r) == [("a", "varlogs", True), ("b error", "varlogs", True)]


def test_first_nonempty_frame(spark):
    a = frame(spark, [(1,)], "x int")
    assert [r.x for r in R.read_first_nonempty([a.where("x > 5"), a, a.union(a)]).collect()] == [1]


def test_read_back_points(spark):
    rows = [(T0 + timedelta(minutes=5 * i), c, m) for i, (c, m) in enumerate([(45.5, 67.2), (48.1, 68.5), (52.3, 65.8)])]
    d = frame(spark, rows, "t timestamp, cpu double, memory double")
    path = scratch_path(spark, "pts")
    K.write_points(K.to_points(d, "host", {"host": F.lit("a")}, {"cpu": "cpu", "memory": "memory"}, "t"), path)
    got = R.read_metrics(spark, path, "host", 600, fields=["cpu"], as_of=T0 + timedelta(minutes=10)).orderBy("time").collect()
    assert [r.cpu for r in got] == [45.5, 48.1, 52.3] and got[0].asDict().keys() == {"time", "cpu"}
    late = R.read_metrics(spark, path, "host", 300, fields=["cpu"]).collect()
    assert sorted(r.cpu for r in late) == [48.1, 52.3]
    plan = R.read_metrics(spark, path, "host", 300, fields=["cpu"], as_of=T0)._jdf.queryExecution().executedPlan().toString()
    assert "measurement" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_clients_listed_twice_count_twice(spark):
    ev = frame(spark, [("aa",), ("aa",), ("bb",), ("",), (None,)], "mac string")
    cl = frame(spark, [("AA", "host"), ("AA", "host"), ("cc", "x")], "mac string, hostname string")
    assert [tuple(r) for r in J.top_clients(ev, cl, 5).collect()] == [("aa (host)", 4), ("bb", 1)]


def test_prom_lines_escape(spark):
    t = K.totals({"events": spark.range(3)})
    top = frame(spark, [('q"x', 4), ("b", 4), ("c", 1), ("d", 1)], "name string, count long")
    lines = [r.line for r in K.prom_lines(t, {"client": top}, "7d").orderBy("ord", "seq").collect()]
    assert lines[-3:] == ['export_top_client_count{rank="1",client="b",window="7d"} 4', 'export_top_client_count{rank="2",client="q\\"x",window="7d"} 4',
                          'export_top_client_count{rank="3",client="c",window="7d"} 1']


# --- windows, counters, capacity ------------------------------------------

def test_rolling_is_left_open(spark):
    d = frame(spark, [("a", T0, 1.0), ("a", T0 + timedelta(hours=6), 3.0), ("a", T0 + timedelta(hours=11), 5.0)], "k string, ts timestamp, v double")
    r = {x.ts: (x.rolling_mean, x.rolling_std) for x in W.rolling(d, ["k"], "ts", "v", 6 * 3600, ["mean", "std"]).collect()}
    assert r[T0] == (1.0, None)
    assert r[T0 + timedelta(hours=6)] == (3.0, None)  # the row exactly six hours older is outside
    assert r[T0 + timedelta(hours=11)][0] == 4.0


def test_lag_needs_exact_offset(spark):
    d = frame(spark, [("a", T0, 1.0), ("a", T0 + timedelta(hours=1), 2.0), ("a", T0 + timedelta(hours=2, seconds=1), 3.0)], "k string, ts timestamp, v double")
    got = {r.v: r.lag for r in J.lag_at(d, ["k"], "ts", "v", 3600, "lag").collect()}
    assert got == {1.0: None, 2.0: 1.0, 3.0: None}


def test_counter_reset(spark):
    d = frame(spark, [("c", i, T0 + timedelta(minutes=i), v) for i, v in enumerate([10.0, 15.0, 3.0, 3.0, 9.0])], "k string, event_id int, ts timestamp, value double")
    inc = {r.event_id: r.increase for r in W.increase(d, ["k"], "ts", "event_id", 240).collect()}
    assert inc == {0: 0.0, 1: 5.0, 2: 8.0, 3: 8.0, 4: 14.0}
    assert {r.event_id: r.irate for r in W.irate(d, ["k"], "ts", "event_id").collect()}[2] == 3.0 / 60
    assert {r.event_id: r.changes for r in W.changes(d, ["k"], "ts", "event_id", 3600).collect()}[4] == 3


def test_histogram_quantile(spark):
    inf = float("inf")
    d = frame(spark, [("a", 1.0, 10), ("a", 2.0, 30), ("a", inf, 40), ("b", 1.0, 1), ("b", inf, 1)], "k string, le double, count long")
    r = {x.k: x.quantile for x in W.histogram_quantile(d, ["k"], 0.5).collect()}
    assert r == {"a": 1.5, "b": 0.5}
    assert {x.k: x.quantile for x in W.histogram_quantile(d, ["k"], 0.9).collect()}["a"] == 2.0


def test_capacity_negative_days_above_ninety(spark):
    rows = [("m", i, 75 + 20 * i / 576) for i in range(577)]
    d = frame(spark, rows, "metric string, pos int, value double")
    r = one(M.capacity_plan(d, order=["pos"]))
    assert r["current"] > 90 and r["days_to_90"] < 0 and r["severity"] == "critical"
    ok = one(M.capacity_plan(d.withColumn("value", F.col("value") - 10), order=["pos"]))
    assert ok["current"] > 70 and ok["days_to_90"] > 0


def test_performance_trend_and_p_value(spark):
    d = frame(spark, [("m", i, 60 + 15 * i / 99) for i in range(100)], "metric string, pos int, value double")
    r = one(M.performance_trends(d, order=["pos"]))
    assert r["direction"] == "increasing" and r["severity"] == "warning" and r["p_value"] < 1e-12
    p = frame(spark, [(0.5, 12.0), (0.0, 10.0), (0.9, 5.0)], "r double, n double").select(M.correlation_p("r", "n")).collect()
    # reference values of the t distribution
    assert abs(p[0][0] - 0.0979) < 1e-3 and abs(p[1][0] - 1.0) < 1e-9 and abs(p[2][0] - 0.0374) < 1e-3


def test_resample_bounds_and_gaps(spark):
    d = frame(spark, [("a", T0, 1.0), ("a", T0 + timedelta(hours=2), 5.0), ("b", T0, 2.0)], "metric string, ts timestamp, value double")
    r = sorted((x.metric, x.bucket, x.value) for x in G.resample(d).collect())
    assert r == [("a", T0, 1.0), ("a", T0 + timedelta(hours=1), None), ("a", T0 + timedelta(hours=2), 5.0), ("b", T0, 2.0)]
    assert sorted(x.value for x in G.resample(d, agg="sum").collect()) == [0.0, 1.0, 2.0, 5.0]


def test_dependency_issues(spark):
    e = frame(spark, [("grafana", "influx"), ("grafana", "prom"), ("am", "prom"), ("prom", "node")], "service string, depends_on string")
    h = frame(spark, [("grafana", False), ("influx", True), ("prom", False), ("am", True), ("node", True)], "name string, healthy boolean")
    r = {x.service: (x.action, x.failed) for x in J.dependency_issues(e, h).collect()}
    assert r == {"grafana": ("fix_dependencies_first", ["prom"]), "prom": ("restart", [])}


def test_host_and_stack_status(spark):
    d = frame(spark, [(1, 0, 10.0, 10.0, 0), (1, 0, 10.0, 95.0, 0), (0, 1, 10.0, 1.0, 0), (0, 0, 96.0, 1.0, 0), (0, 0, 1.0, 1.0, 0)],
              "c int, w int, m double, d double, u int")
    assert [r[0] for r in d.select(G.host_status("c", "w", "m", "d", "u")).collect()] == ["RED", "YELLOW", "YELLOW", "RED", "GREEN"]
    f = frame(spark, [(0, 0), (2, 0), (5, 2), (6, 0), (0, 3)], "f int, c int")
    assert [r[0] for r in f.select(G.overall_health("f", "c")).collect()] == ["healthy", "degraded", "impaired", "critical", "critical"]


def test_due_and_rotation(spark):
    t = frame(spark, [(1,), (2,), (3,)], "target_id int")
    o = frame(spark, [(1, "completed", T0 - timedelta(hours=23)), (2, "completed", T0 - timedelta(hours=25)), (3, "failed", T0)], "target_id int, status string, end_time timestamp")
    assert sorted(r.target_id for r in W.due_targets(t, o, F.lit(T0)).collect()) == [2, 3]
    d = frame(spark, [("2024", T0 - timedelta(days=31)), ("latest", T0 - timedelta(days=90)), ("new", T0)], "name string, ts timestamp")
    assert {r.name: r.plan for r in W.age_plan(d, 30, name="name").collect()} == {"2024": "delete", "latest": "keep", "new": "keep"}


def test_flatten_depth(spark):
    d = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) as a, array(1, 2) as l, 'x' as s")
    assert S.flatten(d).first().asDict() == {"a.b": 1, "a.c": '{"d":2}', "l": "[1,2]", "s": "x"}
