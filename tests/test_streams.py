"""A stream read in several batches must equal the batch form, which must equal a plain loop."""

import subprocess
import sys
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pulsegrid.streaming import steps, streams as St

T0 = datetime(2025, 1, 1)
SCHEMA = "event_id long, k string, ts timestamp, value double"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """300 events of three keys in five files, read one file per batch."""
    rng = np.random.default_rng(5)
    sec = np.sort(rng.integers(0, 20000, 300))
    rows = [(i, str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])), T0 + timedelta(seconds=int(s)), float(np.round(rng.gamma(2, 20), 2)))
            for i, s in enumerate(sec)]
    folder = str(tmp_path_factory.mktemp("events"))
    for n in range(5):
        spark.createDataFrame(rows[n * 60:(n + 1) * 60], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def pair(spark, data):
    """(batch frame, stream) of the same events, with epoch microseconds."""
    folder, rows = data
    batch = St.with_us(spark.createDataFrame(rows, SCHEMA))
    # files are taken in order of their modification time
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return batch, St.with_us(live)


def check(fn, spark, data, rows, cols):
    batch, live = pair(spark, data)
    want = rows(fn(batch), *cols)
    assert rows(St.run_append(fn(live)), *cols) == want and want
    return want


def test_temperature(spark, data, rows):
    got = check(lambda d: St.detect_temperature(d.withColumn("value", F.col("value") / 10 + 66), ["k"]), spark, data, rows, ["event_id", "kind", "confidence"])
    hist, want = {}, []
    import statistics
    for i, k, ts, v in data[1]:
        v = v / 10 + 66
        h = hist.setdefault(k, [])
        h.append(v)
        del h[:-100]
        if v < 60 or v > 80:
            want.append((i, "threshold_violation", 0.8))
        elif len(h) > 20 and abs(v - statistics.mean(h)) > 2 * statistics.stdev(h):
            want.append((i, "statistical_outlier", 0.7))
    assert got == sorted(want, key=repr)
    assert {w[1] for w in want} == {"threshold_violation", "statistical_outlier"}


def test_energy(spark, data, rows):
    got = check(lambda d: St.detect_energy(d, ["k"]), spark, data, rows, ["event_id"])
    hist, want = {}, []
    for i, k, ts, v in data[1]:
        h = hist.setdefault(k, [])
        h.append(v)
        if len(h) > 10 and v > sum(h[-10:]) / 10 * 2:
            want.append((i,))
    assert got == sorted(want, key=repr)


def test_lifecycle(spark, data, rows):
    got = check(lambda d: St.alert_lifecycle(d.select("event_id", "k", "us", (F.col("value") > 45).alias("breach")), ["k"]),
                spark, data, rows, ["event_id", "event", "first_us", "last_us"])
    open_, want = {}, []
    for i, k, ts, v in data[1]:
        us = int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        if v > 45:
            if k not in open_:
                open_[k] = [us, us]
                want.append((i, "open", us, us))
            open_[k][1] = us
        elif k in open_:
            want.append((i, "resolve", *open_.pop(k)))
    assert got == sorted(want, key=repr)


def test_rate_limit(spark, data, rows):
    got = check(lambda d: St.rate_limit(d, 600, ["k"]), spark, data, rows, ["event_id", "sent"])
    last, want = {}, []
    for i, k, ts, v in data[1]:
        ok = k not in last or (ts - last[k]).total_seconds() > 600
        if ok:
            last[k] = ts
        want.append((i, ok))
    assert got == sorted(want, key=repr)


def test_rate_limit_second_call_refused(spark):
    d = St.with_us(spark.createDataFrame([(1, "a", T0, 1.0), (2, "a", T0 + timedelta(seconds=60), 1.0), (3, "a", T0 + timedelta(seconds=61), 1.0)], SCHEMA))
    assert {r.event_id: r.sent for r in St.rate_limit(d, 60, ["k"]).collect()} == {1: True, 2: False, 3: True}


def test_breaker(spark, data, rows):
    got = check(lambda d: St.breaker_states(d.withColumn("success", F.col("value") < 45), ["k"], failures=3, recovery_s=300, successes=2),
                spark, data, rows, ["event_id", "state", "executed", "failures"])
    st, want = {}, []
    for i, k, ts, v in data[1]:
        s = st.setdefault(k, {"state": "closed", "f": 0, "s": 0, "t": None})
        run = True
        if s["state"] == "open":
            if (ts - s["t"]).total_seconds() > 300:
                s.update(state="half_open", s=0)
            else:
                run = False
        if run and v < 45:
            if s["state"] == "half_open":
                s["s"] += 1
                if s["s"] >= 2:
                    s.update(state="closed", f=0)
            else:
                s["f"] = max(0, s["f"] - 1)
        elif run:
            s["f"] += 1
            s["t"] = ts
            if s["state"] == "half_open" or s["f"] >= 3:
                s["state"] = "open"
        want.append((i, s["state"], run, s["f"]))
    assert got == sorted(want, key=repr)
    assert {w[1] for w in want} == {"closed", "open", "half_open"}


def test_recovery(spark, data, rows):
    got = check(lambda d: St.recovery_state(d.withColumn("success", F.col("value") < 40), ["k"]), spark, data, rows, ["event_id", "action", "attempts"])
    n, blocked, want = {}, set(), []
    for i, k, ts, v in data[1]:
        if k in blocked or n.get(k, 0) >= 3:
            blocked.add(k)
            want.append((i, "blocked", 3))
            continue
        n[k] = 0 if v < 40 else n.get(k, 0) + 1
        want.append((i, "attempt", n[k]))
    assert got == sorted(want, key=repr) and blocked


def test_history(spark, data, rows):
    got = check(lambda d: St.bounded_history(d, ["k"], memory=15, ttl_s=1500.0), spark, data, rows, ["event_id", "history_size"])
    want = [(i, min(15, sum(1 for j, q, t2, _ in data[1] if q == k and t2 <= ts and (ts - t2).total_seconds() <= 1500)))
            for i, k, ts, v in data[1]]
    assert got == sorted(want, key=repr)


def test_grouping(spark, data, rows):
    def fn(d):
        d = d.select("event_id", "k", "us", F.lit(30).alias("group_wait_s"), F.lit(120).alias("group_interval_s"),
                     F.lit(400).alias("repeat_interval_s"), (F.col("event_id") % 3 > 0).alias("is_new"))
        return St.group_alerts(d, ["k"])
    got = check(fn, spark, data, rows, ["event_id", "k", "us", "notify_us", "reason"])
    assert {r[4] for r in got} >= {"first", "update", "suppressed"}
    for _, _, us, notify, reason in got:
        assert notify == -1 if reason == "suppressed" else 0 <= notify - us <= 120_000_000


def test_grouping_by_hand():
    import pandas as pd
    s = 1_000_000
    t = [0, 10, 29, 35, 200, 1000]
    rows = pd.DataFrame({"us": [x * s for x in t], "group_wait_s": 30, "group_interval_s": 120, "repeat_interval_s": 400, "is_new": [True, True, False, True, False, True]})
    out, state = steps.grouping()(rows, {"flush": None, "seen": None, "sent": None})
    # waits 30 s; 35 goes to the tick at 150; 200 is known and the last notification is fresh; 1000 starts anew
    assert out["notify_us"].tolist() == [30 * s, 30 * s, 30 * s, 150 * s, -1, 1030 * s]
    assert out["reason"].tolist() == ["first", "update", "update", "update", "suppressed", "first"]


def test_windows_in_update_mode(spark, data, rows):
    batch, live = pair(spark, data)
    cols = ["k", "start", "n", "mean", "min", "max", "stdev"]
    want = rows(St.batch_stats(batch, ["k"], 30), *cols)
    assert rows(St.run_update(St.batch_stats(live, ["k"], 30, watermark="2 hours"), ["k", "start"]), *cols) == want


def test_sliding_rules(spark, data, rows):
    batch, live = pair(spark, data)
    want = rows(St.window_rules(batch, ">", 0.0, ["k"]), "k", "end", "mean")
    assert rows(St.window_rules(live, ">", 0.0, ["k"], watermark="2 hours"), "k", "end", "mean") == want


def test_a_breach_taken_back_is_none(spark, tmp_path):
    """Two batches of one window: the first alone breaches, both together don't."""
    schema = "k string, ts timestamp, value double"
    for n, value in enumerate((100.0, 0.0)):
        spark.sql(f"select 'a' k, timestamp'2024-01-01 00:00:0{n}' ts, {value}D value").coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/in")
        if not n:
            time.sleep(1.1)  # the order of files is that of their times
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert St.window_rules(live, ">", 60.0, ["k"], watermark="2 hours").count() == 0
    assert St.window_rules(live, ">", 40.0, ["k"], watermark="2 hours").count() == 5


def test_dedupe_keeps_first(spark, data, rows):
    batch, live = pair(spark, data)
    want = rows(St.dedupe_alerts(batch.select("ts", F.col("k").alias("fingerprint"))), "fingerprint")
    got = St.run_append(St.dedupe_alerts(live.select("ts", F.col("k").alias("fingerprint")), watermark="10 hours"))
    assert rows(got, "fingerprint") == want == [("a",), ("b",), ("c",)]


def test_ingest_and_motion(spark, data, rows):
    def fn(d):
        d = d.withColumns({"signal": F.lit(-70), "age_s": F.lit(0)})
        return St.ingest(d, received="ts")
    got = check(fn, spark, data, rows, ["event_id", "quality", "latency_s"])
    assert {g[1:] for g in got} == {("medium", 0.0)}
    check(lambda d: St.detect_motion(d), spark, data, rows, ["event_id", "kind"])


def test_network_limits(spark):
    d = spark.createDataFrame([("latency", 501.0), ("latency", 500.0), ("throughput", 0.5), ("throughput", 1.0)], "metric_name string, value double")
    assert sorted(r.kind for r in St.detect_network(d).collect()) == ["high_latency", "low_throughput"]


def test_breaker_stats(spark):
    us = [0, 10, 400, 410]
    d = spark.createDataFrame([(i, "e", u * 1_000_000, i != 2, 100.0 * i, "closed", True) for i, u in enumerate(us)],
                              "event_id long, k string, us long, success boolean, response_time double, state string, executed boolean")
    r = St.breaker_stats(d, ["k"], F.timestamp_seconds(F.lit(410))).first()
    assert (r.requests, r.success_rate, r.avg_response, r.state) == (2, 50.0, 300.0, "closed")


@pytest.mark.parametrize("size, batches", [(1, 3), (1 << 30, 1)])
def test_a_backlog_is_taken_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch, size, batches):
    monkeypatch.setattr(St, "BATCH", size)
    (spark.range(90, numPartitions=3)
     .selectExpr("id AS event_id", "timestamp_ntz'2025-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type",
                 "double(id) AS value", "'{}' AS props").write.parquet(f"{tmp_path}/in"))
    q = (St.events_stream(spark, f"{tmp_path}/in", "*.parquet").writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == batches
    assert spark.read.parquet(f"{tmp_path}/out").count() == 90


EVENTS = ("id AS event_id", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 20 * id) AS ts", "id % 3 AS user_id",
          "if(id % 7 < 3, 'view', 'click') AS event_type", "double(id * id * 37 % 211) AS value", "'{}' AS props")


def test_the_event_table_may_be_one_file(spark, tmp_path, rows):
    """Other tables beside it are no part of the stream."""
    spark.range(90, numPartitions=1).selectExpr(*EVENTS).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "events.parquet")
    spark.range(5).selectExpr(*EVENTS).write.parquet(f"{tmp_path}/other.parquet")
    assert rows(St.run_append(St.events_stream(spark, str(tmp_path)).select("event_id"))) == sorted([(i,) for i in range(90)], key=repr)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        St.events_stream(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("name", ["t06_alert_lifecycle", "t07_rate_limit", "t11_group_alerts", "t12_breaker_states", "t13_recovery_state",
                                  "t14_bounded_history"])
def test_keyed_streams_over_a_folder_of_part_files(spark, tmp_path, rows, name):
    """A large table is a folder of files; the session has Spark's own state store."""
    import duckdb

    from pulsegrid.plans import ORACLES, QUERIES
    from pulsegrid.session import PROVIDER
    spark.range(300, numPartitions=3).selectExpr(*EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    own = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        got = QUERIES[name](spark, str(tmp_path))
    finally:
        spark.conf.set(PROVIDER, own)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows(got) == sorted(want, key=repr) and want


@pytest.mark.parametrize("limit", [None, 40])
def test_history_of_a_whole_metric(spark, data, rows, limit):
    """The last rows of a key are carried from batch to batch; a crowded key is cut up in each."""
    batch, live = pair(spark, data)
    warm = lambda d: d.select("event_id", "us", F.lit("t").alias("k"), (F.col("value") / 10 + 66).alias("value"))
    cols = ["event_id", "kind", "confidence"]
    assert rows(St.temperature_stream(warm(live), ["k"], limit=limit), *cols) == rows(St.detect_temperature(warm(batch), ["k"]), *cols)
    spikes = lambda d: d.select("event_id", "us", F.lit("e").alias("k"), "value")
    want = rows(St.detect_energy(spikes(batch), ["k"]), *cols)
    assert rows(St.energy_stream(spikes(live), ["k"], limit=limit), *cols) == want and want


@pytest.mark.parametrize("ttl", [150.0, 1e6])
def test_keys_that_fall_silent_start_anew(spark, data, rows, ttl):
    calls = (
        (lambda d, **x: St.breaker_states(d.withColumn("success", F.col("value") < 45), ["k"], failures=3, recovery_s=300, successes=2, ttl_s=ttl, **x),
         ["event_id", "state", "executed", "failures"]),
        (lambda d, **x: St.recovery_state(d.withColumn("success", F.col("value") < 40), ["k"], ttl_s=ttl, **x), ["event_id", "action", "attempts"]),
        (lambda d, **x: St.alert_lifecycle(d.select("event_id", "k", "us", (F.col("value") > 45).alias("breach")), ["k"], ttl_s=ttl, **x),
         ["event_id", "event", "first_us", "last_us"]))
    for fn, cols in calls:
        want = check(fn, spark, data, rows, cols)
        batch, _ = pair(spark, data)
        assert rows(fn(batch, limit=13), *cols) == want
        plain = rows(fn(batch), *cols)
        assert plain == want
    attempts, n, blocked, last = [], {}, set(), {}
    for i, k, ts, v in data[1]:
        if k in last and (ts - last[k]).total_seconds() > ttl:
            n.pop(k, None)
            blocked.discard(k)
        last[k] = ts
        if k in blocked or n.get(k, 0) >= 3:
            blocked.add(k)
            attempts.append((i, "blocked", 3))
            continue
        n[k] = 0 if v < 40 else n.get(k, 0) + 1
        attempts.append((i, "attempt", n[k]))
    batch, _ = pair(spark, data)
    assert rows(calls[1][0](batch), *calls[1][1]) == sorted(attempts, key=repr)


@pytest.mark.parametrize("name", ["rate_limit", "group_alerts", "bounded_history", "alert_lifecycle", "breaker_states", "recovery_state"])
def test_state_of_silent_keys_is_removed(spark, tmp_path, name):
    """Twenty keys are heard once, then one key for three days: only its state is left."""
    schema = "event_id long, k string, ts timestamp, value double"
    first = [(i, f"k{i}", T0 + timedelta(seconds=i), 50.0) for i in range(20)]
    later = [[(100 + n, "last", T0 + timedelta(days=n + 1), 50.0)] for n in range(3)]
    for n, some in enumerate([first, *later]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the order of files is that of their times
    live = St.with_us(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    fn = {
        "rate_limit": lambda d: St.rate_limit(d, 600, ["k"]),
        "group_alerts": lambda d: St.group_alerts(d.withColumns({"group_wait_s": F.lit(30), "group_interval_s": F.lit(120),
                                                                 "repeat_interval_s": F.lit(400), "is_new": F.lit(True)}), ["k"]),
        "bounded_history": lambda d: St.bounded_history(d, ["k"], memory=5, ttl_s=3600.0),
        "alert_lifecycle": lambda d: St.alert_lifecycle(d.select("event_id", "k", "us", (F.col("value") > 45).alias("breach")), ["k"], ttl_s=3600.0),
        "breaker_states": lambda d: St.breaker_states(d.withColumn("success", F.lit(False)), ["k"], ttl_s=3600.0),
        "recovery_state": lambda d: St.recovery_state(d.withColumn("success", F.lit(False)), ["k"], ttl_s=3600.0)}[name]
    q = (fn(live).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    keys = spark.read.format("statestore").option("stateVarName", "value").load(f"{tmp_path}/state").select("key.k").collect()
    assert [r.k for r in keys] == ["last"]
    counts = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(counts) >= 20 and counts[-1] <= 8


def test_state_without_an_end_stays(spark, tmp_path):
    rows = [(i, f"k{i}", T0 + timedelta(days=i), 50.0) for i in range(5)]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = St.with_us(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    St.run_append(St.recovery_state(live.withColumn("success", F.lit(False)), ["k"]), f"{tmp_path}/out")
    assert spark.read.format("statestore").option("stateVarName", "value").load(f"{tmp_path}/out-state").count() == 5


def test_stateful_streams_in_a_session_without_settings(spark, data, rows):
    """The session's own state store holds no lists and timers; it is the session's again afterwards."""
    from pulsegrid.session import PROVIDER
    own, plain = spark.conf.get(PROVIDER), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(PROVIDER, plain)
    try:
        check(lambda d: St.bounded_history(d, ["k"], memory=20, ttl_s=3000), spark, data, rows, ["event_id", "history_size"])
        assert spark.conf.get(PROVIDER) == plain
    finally:
        spark.conf.set(PROVIDER, own)


def test_processors_load_without_the_package(tmp_path):
    """Spark's worker of the driver gets the pickled processor, but not the files of the session."""
    from pyspark.serializers import CPickleSerializer
    made = [St.Keyed(step, {}, ["us"], ["us"], hasattr(step, "expires")) for step in (
        steps.rate_limit(5), steps.grouping(), steps.history(20, 60), steps.forgetting(steps.breaker(3, 60, 2), steps.BREAKER_ZERO, 60))]
    (tmp_path / "p").write_bytes(CPickleSerializer().dumps(made))
    code = "import pickle; print(len(pickle.load(open('p', 'rb'))))"
    assert subprocess.run([sys.executable, "-P", "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True).stdout == "4\n"
