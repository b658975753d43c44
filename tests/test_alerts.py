"""Correlation of active alerts and the whole evaluation against plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as A, joins as J
from pulsegrid.sources import readers as R

T0 = datetime(2025, 1, 1)
ALERT = "alert_id string, first_seen timestamp, ended timestamp, service string, host string, metric string, root string, id long"


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def grouped(rows, window):
    """alert_id -> first alert of its group, for (id, start, end, service, host, metric) in order."""
    root = {}
    for k, (i, t, _, service, host, metric) in enumerate(rows):
        open_ = [o for o in rows[:k] if t - o[1] <= window and (o[2] is None or o[2] > t)]
        picks = [next((o[0] for o in open_ if x and o[c] == x), None) for c, x in ((3, service), (4, host))]
        picks.append(next((o[0] for o in open_ if o[5].split("_")[0] == metric.split("_")[0]), None))
        up = next((p for p in picks if p), None)
        root[i] = root[up] if up else i
    return root


def frame(spark, rows):
    return spark.createDataFrame([(i, at(t), at(e), s, h, m, "x", 0) for i, t, e, s, h, m in rows], ALERT)


def test_a_resolved_alert_gives_its_group_to_none(spark):
    rows = [("a", 0, 60, "s", "h1", "cpu_x"), ("b", 30, None, "s", "h2", "mem_x"), ("c", 90, None, "s", "h3", "disk_x"), ("d", 100, None, "t", "h1", "cpu_y")]
    got = {r.alert_id: r.group_root for r in J.correlate(frame(spark, rows), resolved="ended").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"} == grouped(rows, 300)
    # without ends all stay active
    assert {r.alert_id: r.group_root for r in J.correlate(frame(spark, rows)).collect()}["d"] == "a"


@pytest.mark.parametrize("limit", [None, 7])
def test_correlation(spark, limit):
    g = np.random.default_rng(4)
    rows, t = [], 0
    for k in range(160):
        t += int(g.choice([0, 5, 30, 200, 900]))
        end = None if g.random() < 0.2 else t + int(g.choice([0, 1, 20, 100, 500, 3000]))
        rows.append((f"a{k:03d}", t, end, *(str(x) if x else None for x in (g.choice(["", "web", "db"]), g.choice(["", "h1", "h2", "h3"]))), str(g.choice(["cpu_a", "cpu", "mem_b", "net_c"]))))
    rows.append(("late", None, None, "web", "h1", "cpu_a"))
    got = {r.alert_id: r.group_root for r in J.correlate(frame(spark, rows), 300, resolved="ended", limit=limit).collect()}
    assert got.pop("late") == "late"
    assert got == grouped(rows[:-1], 300) and 1 < len(set(got.values())) < 100
    assert J.correlate(frame(spark, rows).limit(0), 300, resolved="ended").count() == 0


RULES = (("busy", "Busy", "cpu", ">", 80.0, "high", 300, 60, False, 300), ("low", "Low", "disk_free", "<=", 10.0, "critical", 300, 60, False, 300),
         ("down", "Down", "status", "==", 0.0, "critical", 300, 60, False, 300))


@pytest.mark.parametrize("limit", [None, 11])
def test_evaluation(spark, limit):
    g = np.random.default_rng(9)
    rows, t = [], 0
    for k in range(400):
        t += int(g.choice([0, 10, 60]))
        m = str(g.choice(["cpu_user", "cpu", "disk_free", "status", "other"]))
        v = {"d": float(g.integers(0, 30)), "s": float(g.integers(0, 2))}.get(m[0], float(g.integers(60, 100)))
        rows.append((k, at(t), m, str(g.choice(["h1", "h2"])) if g.random() < 0.9 else None, str(g.choice(["web", "db"])) if g.random() < 0.5 else None,
                     v if g.random() < 0.95 else None, "n", 1))
    samples = spark.createDataFrame(rows, "event_id long, ts timestamp, metric string, host string, service string, value double, was string, number long")
    rules = R.rules_df(spark, RULES)
    active, found = {}, []
    test = {">": lambda v, x: v > x, "<=": lambda v, x: v <= x, "==": lambda v, x: abs(v - x) < 0.001}
    for e, ts, m, h, s, v, *_ in rows:
        for rule, _, name, op, x, *_ in RULES:
            if not m.startswith(name) or v is None:
                continue
            key = (rule, h or "unknown")
            if test[op](v, x):
                a = active.setdefault(key, {"id": f"alert-{rule}-{e}", "first": ts, "end": None, "service": s, "host": key[1], "metric": name})
                if "last" not in a:
                    found.append(a)
                a.update(last=ts, value=v)
            elif key in active:
                active.pop(key)["end"] = ts
    sec = lambda x: None if x is None else int((x - T0).total_seconds())
    order = sorted(((a["id"], sec(a["first"]), sec(a["end"]), a["service"], a["host"], a["metric"]) for a in found), key=lambda x: (x[1], x[0]))
    root = grouped(order, 120)
    got = A.evaluate(samples, rules, 120, limit=limit)
    assert sorted((r.alert_id, r.first_seen, r.last_seen, r.resolved_at or at(10 ** 6), r.value, r.group_root) for r in got.collect()) == sorted(
        (a["id"], a["first"], a["last"], a["end"] or at(10 ** 6), a["value"], root[a["id"]]) for a in found)
    assert any(a["end"] is None for a in found) and len(set(root.values())) < len(found)
    sent, last, want = A.outbox(got, period_s=600, limit=limit).collect(), {}, set()
    for i, t, *_ in order:
        for channel in ("slack", "email"):
            key = (channel, i.split("-")[1])
            if key not in last or t - last[key] > 600:
                last[key] = t
                want.add((i, channel))
    assert {(r.alert_id, r.channel) for r in sent if r.sent} == want and len(sent) == 2 * len(found)


def test_dynamic_rules_follow_their_history(spark):
    rows = [(k, at(600 * k), "cpu", "h1", None, 50.0 + k % 3) for k in range(30)] + [(30, at(18000), "cpu", "h1", None, 70.0)]
    samples = spark.createDataFrame(rows, "event_id long, ts timestamp, metric string, host string, service string, value double")
    rule = ("busy", "Busy", "cpu", ">", 40.0, "high", 300, 60, True, 300)
    got = A.evaluate(samples, R.rules_df(spark, [rule])).collect()
    # the base threshold stands for the first 19 samples
    assert [(r.alert_id, r.resolved_at) for r in sorted(got, key=lambda r: r.first_seen)] == [("alert-busy-0", at(600 * 19)), ("alert-busy-30", None)]
    assert A.evaluate(samples.where(F.lit(False)), R.rules_df(spark, [rule])).count() == 0
