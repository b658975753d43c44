"""Scalar functions: every one maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -----------------------------------------------------------------

def parse_time(col, as_of) -> Column:
    """Time text -> timestamp.  ``45m``/``2h``/``7d`` count back from ``as_of``; digits are
    epoch milliseconds when longer than ten, else seconds; the rest is ISO 8601.
    Unreadable text gives null."""
    s = F.trim(_c(col))
    amount = F.regexp_extract(s, r"^(\d+)[mhd]$", 1).try_cast("long")
    unit_s = F.when(F.right(s, F.lit(1)) == "m", 60).when(F.right(s, F.lit(1)) == "h", 3600).otherwise(86400)
    back = F.timestamp_micros(F.unix_micros(_c(as_of)) - amount * unit_s * 1_000_000)
    number = s.try_cast("long")
    epoch = F.when(F.length(s) > 10, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.when(s.rlike(r"^\d+[mhd]$"), back).when(s.rlike(r"^\d+$"), epoch) \
        .otherwise(s.try_cast("timestamp"))


def epoch_ms(ts) -> Column:
    return F.unix_millis(_c(ts))


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, day of week with Monday = 0, weekend flag."""
    day = F.weekday(ts)
    return df.withColumns({"hour": F.hour(ts), "day_of_week": day,
                           "is_weekend": (day >= 5).cast("int")})


def future_grid(last, n: int, step_s: int = 3600) -> Column:
    """The ``n`` instants that follow ``last`` at a fixed step, as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda i: F.timestamp_micros(F.unix_micros(_c(last)) + i.cast("long") * step_s * 1_000_000))


def uptime_s(started, as_of) -> Column:
    """Seconds since ``started``; the zero date means never started."""
    t = _c(started).try_cast("timestamp")
    return F.when(F.year(t) > 1, (F.unix_micros(_c(as_of)) - F.unix_micros(t)) / 1e6)


# --- text -----------------------------------------------------------------

def first_nonempty(*cols, lower: bool = False, default: str | None = None) -> Column:
    """The first column whose trimmed text is not empty."""
    picks = [F.nullif(F.trim(_c(c)), F.lit("")) for c in cols]
    if default is not None:
        picks.append(F.lit(default))
    out = F.coalesce(*picks)
    return F.lower(out) if lower else out


def metric_family(col) -> Column:
    return F.substring_index(_c(col), "_", 1)


def contains_any(col, words: Sequence[str]) -> Column:
    """Case-insensitive: does the text hold any of the words?  Null counts as empty."""
    text = F.lower(F.coalesce(_c(col), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def ellipsize(col, n: int = 200, mark: str = "...") -> Column:
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def tag_text(col, n: int = 50) -> Column:
    return F.substring(_c(col), 1, n)


FINGERPRINT_LABELS = ("alertname", "instance", "job", "service")


def alert_fingerprint(labels, keys: Sequence[str] = FINGERPRINT_LABELS) -> Column:
    """md5 of the present ``key=value`` pairs joined by a bar, in key order."""
    m = _c(labels)
    return F.md5(F.concat_ws("|", *[
        F.when(F.map_contains_key(m, k), F.concat(F.lit(f"{k}="), F.element_at(m, F.lit(k)))) for k in keys]))


def short_id(col) -> Column:
    return F.substring(F.md5(_c(col).cast("string")), 1, 8)


def checksum(content) -> Column:
    return F.sha2(_c(content), 256)


def checksum_ok(content, expected) -> Column:
    return F.coalesce(checksum(content) == _c(expected), F.lit(False))


def json_or_null(col, schema: str) -> Column:
    """Parsed JSON object; malformed text gives null so that callers can drop the row."""
    c = _c(col)
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


def host_slug(col) -> Column:
    """``"host.name:port"`` -> ``host-name``."""
    return F.replace(F.split_part(F.replace(_c(col), F.lit('"'), F.lit("")), F.lit(":"), F.lit(1)),
                     F.lit("."), F.lit("-"))


# --- container arithmetic -------------------------------------------------

def pct(used, total, places: int | None = 2) -> Column:
    """Percentage; zero when the total is not positive."""
    u, t = _c(used), _c(total)
    out = F.when(t > 0, u / t * 100.0).otherwise(F.lit(0.0))
    return F.round(out, places) if places is not None else out


def container_cpu(total, pre_total, system, pre_system, cores, strict: bool = False) -> Column:
    """CPU percent from two readings.  ``strict`` gives null unless both deltas are
    positive and counts a missing core list as one; otherwise a flat system clock is 0."""
    cpu, sysd = _c(total) - _c(pre_total), _c(system) - _c(pre_system)
    if strict:
        n = F.greatest(F.coalesce(_c(cores), F.lit(1)), F.lit(1))
        return F.when((sysd > 0) & (cpu > 0), cpu / sysd * n * 100.0)
    return F.when(sysd > 0, cpu / sysd * _c(cores) * 100.0).otherwise(F.lit(0.0))


# --- sensor ratings -------------------------------------------------------

def comfort(t) -> Column:
    t = _c(t)
    return F.when(t.between(68, 72), "optimal").when(t.between(65, 75), "comfortable") \
        .when(t.between(60, 80), "acceptable").otherwise("uncomfortable")


def temp_efficiency(t) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(_c(t) - 70) / 20)


def unusual_hour(ts) -> Column:
    h = F.hour(_c(ts))
    return (h < 6) | (h > 22)


def motion_level(v, ts) -> Column:
    h = F.hour(_c(ts))
    return F.when(~(_c(v) > 0), "none").when(unusual_hour(ts), "high") \
        .when(h.between(6, 8) | h.between(17, 19), "low").otherwise("medium")


def energy_rating(v) -> Column:
    v = _c(v)
    return F.when(v < 100, "excellent").when(v < 500, "good").when(v < 1000, "fair").otherwise("poor")


def energy_cost(v, per_kwh: float = 0.12) -> Column:
    return _c(v) / 1000 * per_kwh


def network_rating(metric, v) -> Column:
    """Latency and loss are better low, throughput better high."""
    m, v = _c(metric), _c(v)

    def below(a, b, c):
        return F.when(v < a, "excellent").when(v < b, "good").when(v < c, "fair").otherwise("poor")

    above = F.when(v > 100, "excellent").when(v > 50, "good").when(v > 10, "fair").otherwise("poor")
    return F.when(m == "latency", below(10, 50, 100)).when(m == "throughput", above) \
        .when(m == "packet_loss", below(1, 3, 5)).otherwise("unknown")


def risk_level(v) -> Column:
    v = _c(v)
    return F.when(v > 10, "critical").when(v > 5, "high").when(v > 1, "medium").otherwise("low")


METRIC_CLASS = {
    "temperature": "temperature", "motion": "motion", "energy": "energy",
    "latency": "network", "throughput": "network", "packet_loss": "network", "network": "network",
    "failed_login_attempts": "security", "unusual_traffic": "security", "security": "security",
}


def metric_class(metric) -> Column:
    """Which processor a metric belongs to; unknown metrics have none."""
    table = F.create_map(*[F.lit(x) for kv in METRIC_CLASS.items() for x in kv])
    return F.element_at(table, _c(metric))


def _keep(*items: Column) -> Column:
    """Array of the items that are not null."""
    return F.array_compact(F.array(*items))


def process_points(df: DataFrame, metric="metric_name", value="value", ts="ts") -> DataFrame:
    """Per-metric rating, score, alerts, triggers and suggestions in one projection."""
    m, v = _c(metric), _c(value)
    cls = metric_class(m)
    rating = F.when(cls == "temperature", comfort(v)).when(cls == "motion", motion_level(v, ts)) \
        .when(cls == "energy", energy_rating(v)).when(cls == "network", network_rating(m, v)) \
        .when(cls == "security", risk_level(v))
    score = F.when(cls == "temperature", temp_efficiency(v)).when(cls == "motion", v) \
        .when(cls == "energy", energy_cost(v)).when(cls.isin("network", "security"), v)

    def alert(cond, level, code):
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))

    alerts = _keep(
        alert((cls == "temperature") & (v > 85), "critical", "temperature_high"),
        alert((cls == "temperature") & (v < 45), "warning", "temperature_low"),
        alert((cls == "motion") & (v > 0) & unusual_hour(ts), "warning", "motion_at_night"))
    triggers = F.when((cls == "motion") & (v > 0), F.array(F.lit("lights_on"), F.lit("security_recording"))) \
        .otherwise(_keep(
            F.when((m == "failed_login_attempts") & (v > 5), F.lit("block_ip_temporarily")),
            F.when((m == "unusual_traffic") & (v > 0), F.lit("increase_monitoring"))))
    advice = _keep(
        F.when((cls == "energy") & (v > 1000), F.lit("power_saving")),
        F.when((m == "latency") & (v > 100), F.lit("high_latency")),
        F.when((m == "packet_loss") & (v > 5), F.lit("packet_loss")),
        F.when((m == "failed_login_attempts") & (v > 5), F.lit("brute_force_attack")),
        F.when((m == "unusual_traffic") & (v > 0), F.lit("suspicious_network_activity")))
    return df.withColumns({"metric_class": cls, "rating": rating, "score": score, "alerts": alerts,
                           "triggers": triggers, "suggestions": advice})


# --- devices --------------------------------------------------------------

def device_type(ports, caps) -> Column:
    p, c = _c(ports), _c(caps)

    def has(*xs):
        return F.arrays_overlap(p, F.array(*[F.lit(x) for x in xs]))

    return F.when(has(554) | F.array_contains(c, "rtsp_streaming"), "camera") \
        .when(has(1883, 8883), "sensor") \
        .when(F.array_contains(c, "web_server") & has(80), "smart_switch") \
        .when(has(502), "sensor").otherwise("unknown")


# Maker and the ports that give it away, in matching order.
SIGNATURES = (
    ("TP-Link", (9999,)),
    ("Hikvision", (554, 8000)),
    ("Nest", (443,)),
    ("Ring", (443,)),
    ("Philips Hue", (80, 443)),
    ("Sonos", (1400,)),
    ("Samsung SmartThings", (39500,)),
    ("Raspberry Pi", (22,)),
    ("Arduino", (80,)),
    ("ESP32", (80,)),
    ("ESP8266", (80,)),
)


def manufacturer(ports, signatures=SIGNATURES) -> Column:
    """Maker of the first signature that shares a port."""
    p = _c(ports)
    return F.coalesce(*[F.when(F.arrays_overlap(p, F.array(*[F.lit(x) for x in ports_of])), maker)
                        for maker, ports_of in signatures])


def is_edge_node(hostname, maker) -> Column:
    h, m = F.lower(F.coalesce(_c(hostname), F.lit(""))), F.lower(F.coalesce(_c(maker), F.lit("")))
    return h.rlike("raspberry|pi|edge|compute") | m.isin("raspberry", "nvidia", "intel")


def device_security(df: DataFrame, default_login="default_login", caps="capabilities",
                    ports="open_ports", weak="weak_protocols") -> DataFrame:
    """Score from 100 down and the findings behind it, from recorded flags."""
    login = F.coalesce(_c(default_login), F.lit(False))
    mqtt = F.coalesce(F.array_contains(_c(caps), "mqtt_communication") & F.array_contains(_c(ports), 1883),
                      F.lit(False))
    old = F.coalesce(_c(weak), F.lit(False))
    found = _keep(F.when(login, F.lit("default_credentials")), F.when(mqtt, F.lit("unencrypted_mqtt")),
                  F.when(old, F.lit("weak_protocols")))
    score = 100 - login.cast("int") * 30 - mqtt.cast("int") * 20 - old.cast("int") * 15
    return df.withColumns({"security_score": score, "vulnerabilities": found})


# --- security events ------------------------------------------------------

CRITICAL_WORDS = ("exploit", "backdoor", "trojan", "malware")
HIGH_WORDS = ("attack", "intrusion", "breach")
MEDIUM_WORDS = ("suspicious", "anomaly", "scan")


def threat_confidence(source, ids_severity, siem_level) -> Column:
    s = _c(source)
    return F.when(s == "ids", F.least(F.coalesce(_c(ids_severity), F.lit(1)) / 3, F.lit(1.0))) \
        .when(s == "flow", F.lit(0.7)) \
        .when(s == "siem", F.least(F.coalesce(_c(siem_level), F.lit(1)) / 15, F.lit(1.0))) \
        .otherwise(F.lit(0.5))


def threat_severity(signature, confidence) -> Column:
    """Words decide first; confidence lifts the rest.  Missing signatures are empty text."""
    s, c = signature, _c(confidence)
    return F.when(contains_any(s, CRITICAL_WORDS), "critical") \
        .when((c > 0.8) | contains_any(s, HIGH_WORDS), "high") \
        .when((c > 0.5) | contains_any(s, MEDIUM_WORDS), "medium").otherwise("low")


def threat_actions(severity, source_ip, dest_ip) -> Column:
    """Response steps as array of (type, target, auto)."""
    s = _c(severity)

    def act(kind, target, auto=False):
        return F.struct(F.lit(kind).alias("type"), _c(target).alias("target"), F.lit(auto).alias("auto"))

    return _keep(
        F.when(s == "critical", act("block_ip", source_ip)),
        F.when(s == "critical", act("isolate_host", dest_ip)),
        F.when(s == "high", act("monitor_ip", source_ip, True)),
        F.when(s.isin("medium", "high", "critical"), act("investigate", source_ip)))


def notify_threat(severity) -> Column:
    return _c(severity).isin("high", "critical")


def propose_action(name, host, service) -> Column:
    """(type, target, confidence) for an alert name; the first matching pattern wins."""
    n = _c(name)
    h = F.nullif(_c(host), F.lit(""))
    s = F.nullif(_c(service), F.lit(""))

    def pick(kind, target, conf):
        return F.struct(F.lit(kind).alias("type"), target.alias("target"), F.lit(conf).alias("confidence"))

    host_text = F.coalesce(h, F.lit(""))
    return F.when(n.contains("Down") | n.contains("Unreachable"),
                  pick("restart_service", F.coalesce(s, host_text), 0.8)) \
        .when(n.contains("High") & n.contains("CPU"), pick("scale_resources", host_text, 0.6)) \
        .when(n.contains("Memory") & n.contains("High"), pick("memory_cleanup", host_text, 0.7)) \
        .when(n.contains("Disk") & (n.contains("Full") | n.contains("High")),
              pick("disk_cleanup", host_text, 0.9)) \
        .otherwise(pick("investigate", F.coalesce(h, F.lit("unknown")), 0.3))


# --- service health -------------------------------------------------------

def service_health(df: DataFrame, status="status", health="health", restarting="restarting",
                   usage="mem_usage", limit="mem_limit", restarts="restart_count",
                   worst: bool = False) -> DataFrame:
    """Status and issue list of a service.

    By default a later check overwrites an earlier one (health, memory, restarts);
    ``worst=True`` keeps the gravest.
    """
    st, he = _c(status), F.coalesce(_c(health), F.lit("unknown"))
    mem = F.when(_c(limit) > 0, _c(usage) / _c(limit) * 100).otherwise(F.lit(0.0))
    often = _c(restarts) > 5
    running = st == "running"
    stuck = ~he.isin("healthy", "unhealthy") & F.coalesce(_c(restarting), F.lit(False))
    by_health = F.when(he == "unhealthy", "critical").when(stuck, "warning").otherwise("healthy")
    by_memory = F.when(mem > 95, "critical").when(mem > 85, "warning")
    by_restart = F.when(often, "warning")
    if worst:
        votes = F.array_compact(F.array(by_health, by_memory, by_restart))
        alive = F.when(F.array_contains(votes, "critical"), "critical") \
            .when(F.array_contains(votes, "warning"), "warning").otherwise("healthy")
    else:
        alive = F.coalesce(by_restart, by_memory, by_health)
    stopped = st.isin("exited", "dead")
    issues = F.when(running, _keep(
        F.when(he == "unhealthy", F.lit("health check failed")),
        F.when(stuck, F.lit("restarting")),
        F.when(mem > 95, F.concat(F.lit("critical memory usage "), F.format_number(mem, 1))),
        F.when((mem > 85) & (mem <= 95), F.concat(F.lit("high memory usage "), F.format_number(mem, 1))),
        F.when(often, F.concat(F.lit("frequent restarts "), _c(restarts).cast("string"))))) \
        .when(stopped, F.array(F.concat(F.lit("not running: "), st))) \
        .otherwise(F.array(F.concat(F.lit("unknown state: "), F.coalesce(st, F.lit("")))))
    return df.withColumns({
        "health_status": F.when(running, alive).when(stopped, "critical").otherwise("warning"),
        "issues": issues})


def health_score(status) -> Column:
    s = _c(status)
    return F.when(s == "healthy", 100).when(s == "warning", 50).otherwise(0)


def recovery_plan(issues) -> Column:
    """What to do about a service, by its first recognised kind of issue."""
    i = _c(issues)

    def some(text):
        return F.exists(i, lambda x: x.contains(text))

    return F.when(some("not running"), "start").when(some("health check failed"), "restart") \
        .when(some("memory usage"), "restart_for_memory").when(some("restarting"), "force_restart") \
        .otherwise("none")


def insight_band(score, critical_below: float = -0.3) -> tuple[Column, Column]:
    """(severity, confidence) of an anomaly score."""
    s = _c(score)
    return F.when(s < critical_below, "critical").otherwise("warning"), F.least(F.lit(1.0), F.abs(s))


def growth_band(current, predicted) -> Column:
    """Severity of predicted growth; null when it stays under one and a half times."""
    c, p = _c(current), _c(predicted)
    return F.when(p > c * 1.5, F.when(p < c * 2.0, "warning").otherwise("critical"))


# --- recommendations ------------------------------------------------------

# Advice codes by kind of finding and metric family.
ADVICE = {
    "anomaly": {"cpu": ("profile_cpu_hogs", "look_for_runaway_process", "add_cpu_capacity"),
                "memory": ("look_for_leak", "review_memory_limits", "recycle_heavy_services"),
                "disk": ("free_disk_space", "review_retention", "add_storage"),
                "network": ("study_traffic", "rule_out_flooding", "review_bandwidth")},
    "forecast": {"cpu": ("scale_out_early", "tune_cpu_paths"),
                 "memory": ("plan_memory", "watch_for_exhaustion"),
                 "disk": ("schedule_cleanup", "plan_storage")},
    "capacity": {"disk": ("extend_or_archive", "set_lifecycle_rules"),
                 "memory": ("plan_memory_upgrade", "rebalance_memory"),
                 "cpu": ("plan_cpu_scaling", "rebalance_workload")},
}


def recommendations(metric, kind: str) -> Column:
    """Advice codes for the first metric family named in ``metric``."""
    m = F.lower(_c(metric))
    out = None
    for family, codes in ADVICE[kind].items():
        arr = F.array(*[F.lit(c) for c in codes])
        out = F.when(m.contains(family), arr) if out is None else out.when(m.contains(family), arr)
    return out.otherwise(F.array().cast("array<string>"))


def trend_recommendations(metric, direction, change_pct) -> Column:
    m, d = F.lower(_c(metric)), _c(direction)
    slow = (d == "increasing") & m.contains("response_time")
    thin = (d == "decreasing") & m.contains("throughput")
    return F.concat(
        F.when(slow, F.array(F.lit("review_slow_queries"), F.lit("balance_or_cache")))
        .when(thin, F.array(F.lit("find_bottleneck"), F.lit("review_recent_changes")))
        .otherwise(F.array().cast("array<string>")),
        F.array(F.format_string("watch %s: %s%% change", _c(metric), F.format_number(F.abs(_c(change_pct)), 1))))


def capacity_urgency(days) -> Column:
    d = _c(days)
    return F.when(d < 7, "immediate").when(d < 30, "near-term").otherwise("planned")


# Check-key prefix, exact match?, status needed, category, blast radius.
CAUSES = (
    ("C.docker_health", False, None, "container unhealthy", "med"),
    ("C.docker_ps", True, "FAIL", "container unhealthy", "med"),
    ("D.prom_ready", True, None, "Prometheus down", "high"),
    ("D.prom_up_", False, None, "scrape target down", "med"),
    ("E.grafana", False, None, "dashboards not provisioned", "med"),
    ("F.loki_ready", True, None, "Loki down", "med"),
    ("F.loki_query", True, None, "Loki ingestion gap", "low"),
    ("G.alert_head", False, None, "Alertmanager down", "med"),
    ("G.rules_api", True, None, "config drift", "low"),
    ("H.lsyncd_active", True, None, "lsync lag", "low"),
    ("I.nats_connz", True, None, "NATS connz low", "med"),
    ("J.manifest", False, None, "signing artifacts missing", "low"),
    ("J.window", True, None, "window mis-set", "low"),
    ("L.mount_writable", True, "FAIL", "segmentation misconfig", "med"),
)


def root_cause(df: DataFrame, key="check_key", status="status", causes=CAUSES) -> DataFrame:
    """Category, blast radius and remediation level of each check that did not pass."""
    k, s = _c(key), _c(status)

    def hit(text, exact, need):
        cond = (k == text) if exact else k.startswith(text)
        return cond & (s == need) if need else cond

    cat = F.coalesce(*[F.when(hit(t, e, n), F.lit(c)) for t, e, n, c, _ in causes], F.lit("config drift"))
    blast = F.coalesce(*[F.when(hit(t, e, n), F.lit(b)) for t, e, n, _, b in causes], F.lit("low"))
    return df.where(s != "PASS").withColumns({
        "category": cat, "blast_radius": blast,
        "remediation": F.when(blast.isin("high", "med") & (s == "FAIL"), "high").otherwise("medium")})


def flatten(df: DataFrame, depth: int = 1) -> DataFrame:
    """Struct fields become ``a.b`` columns down to ``depth``; deeper structs, arrays and
    maps become compact JSON text."""
    from pyspark.sql import types as T

    out = []

    def walk(path, name, dtype, level):
        if isinstance(dtype, T.StructType) and level <= depth:
            for f in dtype.fields:
                walk(path.getField(f.name) if path is not None else F.col(f"`{f.name}`"),
                     f"{name}.{f.name}" if name else f.name, f.dataType, level + 1)
        elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(path).alias(name))
        else:
            out.append(path.alias(name))

    walk(None, "", df.schema, 0)
    return df.select(*out)
