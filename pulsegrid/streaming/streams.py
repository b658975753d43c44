"""Streaming operators.  Functions that take a DataFrame work on streams and batches alike
unless they say otherwise; stateful ones come as a pair with one shared step."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from pulsegrid.functions import scalars as S
from pulsegrid.operators.predicates import breaches, data_quality
from pulsegrid.operators.windows import last_n, latest
from pulsegrid.scale import fold, largest_group, moving, newest, previous, scan
from pulsegrid.session import PROVIDER, ROCKSDB, cut, scratch_path
from pulsegrid.sources.sinks import current_table
from pulsegrid.streaming import steps

# Spark looks at a stateful operator in a worker of the driver too, which may not find this package
for module in (steps, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

# --- running streams ------------------------------------------------------

#: Bytes of files in a batch of a file stream.
BATCH = 256 << 20


def events_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The event files of a folder as a stream, with a zoned timestamp for watermarks.

    ``glob`` is the name of the table in the folder, one file or a folder of part files, or a pattern for
    names of files.  A batch takes ``files_per_trigger`` files, or else as many whole files as :data:`BATCH`
    bytes hold, so that a long backlog does not become one batch."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r.option("maxBytesPerTrigger", BATCH)
    if set(glob) & set("*?[{"):
        events = r.option("pathGlobFilter", glob).parquet(folder)
    else:
        # a plain path of a stream must be a folder, what a pattern matches may be a file as well; but a pattern
        # without a match is no error, so the folder is looked at here
        spark.read.schema(schema).options(pathGlobFilter=glob, recursiveFileLookup=True).parquet(folder)
        events = r.parquet(f"{folder}/{{{glob}}}")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


_starting = threading.Lock()


def run_append(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available now into a table and return the table.

    List states and timers need the RocksDB state store.  A stream keeps the settings that the session
    has when it starts, so the session's default store gives way for that moment only."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    writer = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
              .outputMode("append").trigger(availableNow=True))
    with _starting:
        store = spark.conf.get(PROVIDER)
        try:
            if store.endswith(".HDFSBackedStateStoreProvider"):
                spark.conf.set(PROVIDER, ROCKSDB)
            q = writer.start()
        finally:
            spark.conf.set(PROVIDER, store)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """As :func:`run_append` for results that change: every batch's updates are written
    under their batch number, and the newest row per key is returned."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = T.StructType(stream.schema.fields + [T.StructField("batch_no", T.IntegerType())])
    return latest(spark.read.schema(schema).parquet(path), keys, ["batch_no"]).drop("batch_no")


def run_carried(stream: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, work: Callable[[DataFrame], DataFrame],
                path: str | None = None, limit: int | None = None) -> DataFrame:
    """Everything available now through a batch operator that looks back over ``back`` rows of a key.

    Each batch is joined by the last rows of its keys, which the batch before has left as a table, and
    the operator runs on both as on any frame, so that a key that holds most of a stream is spread
    like one of a batch.  Results and rows left are written under the batch's number: a batch that is
    repeated after a failure writes the same again."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    schema = T.StructType([*stream.schema.fields, T.StructField("__new", T.BooleanType())])

    def write(batch: DataFrame, number: int) -> None:
        here = batch.withColumn("__new", F.lit(True))
        if number:
            left = spark.read.schema(stream.schema).parquet(f"{path}/left/{number - 1}")
            here = here.unionByName(left.withColumn("__new", F.lit(False)))
        here = cut(here)
        work(here).where("__new").drop("__new").write.mode("overwrite").parquet(f"{path}/out/batch_no={number}")
        newest(here, keys, [F.desc(o) for o in order], back, limit).select(stream.columns).write.mode("overwrite").parquet(f"{path}/left/{number}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    out = T.StructType([*work(spark.createDataFrame([], schema)).drop("__new").schema.fields, T.StructField("batch_no", T.IntegerType())])
    return spark.read.schema(out).parquet(f"{path}/out").drop("batch_no")


def run_with_table(stream: DataFrame, table: str, work: Callable[[DataFrame, DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Everything available now through ``work(batch, table)``, where the table is read anew for each batch.

    ``table`` is a path kept by :func:`pulsegrid.sources.sinks.rebuild_table`: rules that are replaced while
    the stream runs hold from the next batch on.  A batch that is repeated after a failure has the rules
    that are there then."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        work(batch, current_table(spark, table)).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    schema = work(spark.createDataFrame([], stream.schema), current_table(spark, table)).schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_no", T.IntegerType())])).parquet(path).drop("batch_no")


class Keyed(StatefulProcessor):
    """A step over the rows of a key, batch by batch.

    Lists of the state are list states, what else it holds is one value.  Where the step says when a
    state has run out (``step.expires``), a timer of event time removes it."""

    def __init__(self, step: Callable, zero: dict, order: Sequence[str], names: Sequence[str], timed: bool):
        self.step, self.zero, self.order, self.names, self.timed = step, zero, list(order), list(names), timed
        self.kinds = getattr(step, "lists", {})

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "state STRING, timer BIGINT")
        self.lists = {k: handle.getListState(k, f"v {kind}") for k, kind in self.kinds.items()}

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        held = self.value.get()
        state, timer = (json.loads(held[0]), held[1]) if held else (dict(self.zero), None)
        if held:
            state.update({k: [x[0] for x in v.get()] if v.exists() else [] for k, v in self.lists.items()})
        made, state = self.step(rows, state)
        if self.timed:
            ends = self.step.expires(state)
            due = None if ends is None else ends // 1000 + 1
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
                timer = due
        for k, v in self.lists.items():
            if state[k]:
                v.put([(x,) for x in state[k]])
            else:
                v.clear()
        self.value.update((json.dumps({k: x for k, x in state.items() if k not in self.lists}), timer))
        if len(made):
            yield made[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.value.clear()
        for v in self.lists.values():
            v.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, zero: dict,
               out: T.StructType | str, late: str | None = "0 seconds", clock: str = "us") -> DataFrame:
    """The streaming form of :func:`pulsegrid.scale.fold`: state per key between batches.

    State that has run out by the step's own rule goes once the watermark, ``late`` behind the newest
    ``clock`` (microseconds), has passed its end; what is later than that is dropped, as it would find
    no state.  With ``late`` None no row is dropped and no state goes."""
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    timed = late is not None and hasattr(step, "expires")
    processor = Keyed(step, zero, order, schema.names, timed)
    if timed:
        stream = stream.withColumn("__time", F.timestamp_micros(clock)).withWatermark("__time", late)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime" if timed else "None")


def _extend(df: DataFrame, extra: str) -> T.StructType:
    return T.StructType(df.schema.fields + T._parse_datatype_string(extra).fields)


def _either(df: DataFrame, keys, order, step, zero, out, limit=None, late="1 hour") -> DataFrame:
    return keyed_fold(df, keys, order, step, zero, out, late) if df.isStreaming else fold(df, keys, order, step, zero, out, limit)


def _lasting(step, zero: dict, ttl_s: float | None):
    return (step, zero) if ttl_s is None else (steps.forgetting(step, zero, ttl_s), {**zero, "at": None})


def with_us(df: DataFrame, ts="ts") -> DataFrame:
    return df.withColumn("us", F.unix_micros(ts))


# --- sensor streams -------------------------------------------------------

def ingest(points: DataFrame, value="value", signal="signal", age_s="age_s", received: str | None = None, ts="ts") -> DataFrame:
    """Adds the quality class and, given an arrival time, the latency in seconds."""
    out = points.withColumn("quality", data_quality(value, signal, age_s))
    if received:
        out = out.withColumn("latency_s", (F.unix_micros(received) - F.unix_micros(ts)) / 1e6)
    return out


def route(points: DataFrame, metric="metric_name", value="value", ts="ts") -> DataFrame:
    """Points of known metrics with their rating, alerts and triggers."""
    return S.process_points(points, metric, value, ts).where("metric_class IS NOT NULL")


def routed_alerts(points: DataFrame, keep: Sequence[str] = (), **cols) -> DataFrame:
    """One row per alert raised by the processors."""
    return route(points, **cols).select(*keep, F.explode("alerts").alias("a")).select(*keep, "a.level", "a.code")


ANOMALY = "kind STRING, confidence DOUBLE"


def detect_temperature(df: DataFrame, keys: Sequence[str] = ("metric_name",), order: Sequence[str] = ("us", "event_id"),
                       value="value", limit: int | None = None) -> DataFrame:
    """Temperature anomalies; history per metric as a rule, per device if asked.

    As a stream each key's history is one state: for keys that hold much of the stream see
    :func:`temperature_stream`."""
    if df.isStreaming:
        return keyed_fold(df, keys, order, steps.temperature(value), {"h": []}, _extend(df, ANOMALY))
    d = last_n(df, keys, order, value, 100, ["mean", "std", "count"], "__h", limit)
    v = F.col(value)
    off = (F.abs(v - F.col("__h_mean")) > 2 * F.col("__h_std")) & (F.col("__h_count") > 20)
    kind = F.when((v < 60) | (v > 80), "threshold_violation").when(off, "statistical_outlier")
    return d.withColumn("kind", kind).where("kind IS NOT NULL").withColumn(
        "confidence", F.when(F.col("kind") == "threshold_violation", 0.8).otherwise(0.7)) \
        .drop("__h_mean", "__h_std", "__h_count")


def temperature_stream(stream: DataFrame, keys: Sequence[str] = ("metric_name",), order: Sequence[str] = ("us", "event_id"),
                       limit: int | None = None, **cols) -> DataFrame:
    """Temperature anomalies of a stream whose history is that of a whole metric, over all devices."""
    return run_carried(stream, keys, order, 99, lambda d: detect_temperature(d, keys, order, limit=limit, **cols), limit=limit)


def detect_motion(df: DataFrame, value="value", ts="ts") -> DataFrame:
    """Motion at unusual hours."""
    return df.where((F.col(value) > 0) & S.unusual_hour(ts)).withColumns(
        {"kind": F.lit("unusual_timing"), "confidence": F.lit(0.6)})


def detect_energy(df: DataFrame, keys: Sequence[str] = ("metric_name",), order: Sequence[str] = ("us", "event_id"),
                  value="value", limit: int | None = None) -> DataFrame:
    """Consumption above twice the mean of the last ten values."""
    if df.isStreaming:
        return keyed_fold(df, keys, order, steps.energy(value), {"h": [], "n": 0}, _extend(df, ANOMALY))
    fullest = largest_group(df, keys)
    d = last_n(df, keys, order, value, 10, ["mean"], "__h", limit, fullest)
    d = last_n(d, keys, order, value, 11, ["count"], "__n", limit, fullest)
    return d.where((F.col("__n_count") > 10) & (F.col(value) > F.col("__h_mean") * 2)).drop("__h_mean", "__n_count").withColumns(
        {"kind": F.lit("consumption_spike"), "confidence": F.lit(0.9)})


def energy_stream(stream: DataFrame, keys: Sequence[str] = ("metric_name",), order: Sequence[str] = ("us", "event_id"),
                  limit: int | None = None, **cols) -> DataFrame:
    """Energy spikes of a stream whose history is that of a whole metric, over all devices."""
    return run_carried(stream, keys, order, 10, lambda d: detect_energy(d, keys, order, limit=limit, **cols), limit=limit)


def detect_network(df: DataFrame, metric="metric_name", value="value") -> DataFrame:
    """Latency above 500 ms or throughput below 1 Mbps."""
    slow = (F.col(metric) == "latency") & (F.col(value) > 500)
    thin = (F.col(metric) == "throughput") & (F.col(value) < 1)
    return df.where(slow | thin).withColumns({"kind": F.when(slow, "high_latency").otherwise("low_throughput"),
                                              "confidence": F.when(slow, 0.8).otherwise(0.7)})


# --- alerting -------------------------------------------------------------

def alert_lifecycle(df: DataFrame, keys: Sequence[str] = ("rule_id", "host"), order: Sequence[str] = ("us", "event_id"),
                    flag="breach", limit: int | None = None, ttl_s: float | None = None) -> DataFrame:
    """open and resolve events of each alert, with its first and last breach.

    ``ttl_s`` (streams): an alert that has no row for as long is forgotten without an event."""
    keep = [c for c in df.columns if c != flag]
    if df.isStreaming:
        out = _extend(df, "event STRING, first_us BIGINT, last_us BIGINT")
        return keyed_fold(df, keys, order, *_lasting(steps.lifecycle(flag), {"open": None, "seen": None}, ttl_s), out, "1 hour").drop(flag)
    if ttl_s is not None:
        out = _extend(df, "event STRING, first_us BIGINT, last_us BIGINT")
        return fold(df, keys, order, *_lasting(steps.lifecycle(flag), {"open": None, "seen": None}, ttl_s), out, limit).drop(flag)
    d = df.withColumn("__b", F.coalesce(flag, F.lit(False)))
    fullest = largest_group(d, keys)
    d = previous(d, keys, [F.col(o) for o in order], {"__was": "__b"}, limit, fullest)
    was = F.coalesce("__was", F.lit(False))
    d = scan(d, keys, [F.col(o) for o in order], {
        "first_us": ("last", F.when(F.col("__b") & ~was, F.col(order[0]))),
        "last_us": ("last", F.when(F.col("__b"), F.col(order[0])))}, limit, fullest)
    return d.where(F.col("__b") != was).withColumn("event", F.when(F.col("__b"), "open").otherwise("resolve")) \
        .select(*keep, "event", "first_us", "last_us")


def rate_limit(df: DataFrame, period_s: float, keys: Sequence[str] = ("channel", "rule_id"),
               order: Sequence[str] = ("us", "event_id"), limit: int | None = None) -> DataFrame:
    """Marks the notifications that may be sent: one per key and period."""
    return _either(df, keys, order, steps.rate_limit(period_s), {"last": None}, _extend(df, "sent BOOLEAN"), limit)


def group_alerts(df: DataFrame, keys: Sequence[str] = ("host", "service", "alertname"), order: Sequence[str] = ("us", "event_id"),
                 limit: int | None = None) -> DataFrame:
    """Notification time of each alert of its group; the frame carries the route's timings."""
    return _either(df, keys, order, steps.grouping(), {"flush": None, "seen": None, "sent": None},
                   _extend(df, "notify_us BIGINT, reason STRING"), limit)


def breaker_states(df: DataFrame, keys: Sequence[str] = ("src", "dst"), order: Sequence[str] = ("us", "event_id"),
                   failures: int = 5, recovery_s: float = 60.0, successes: int = 3, limit: int | None = None,
                   ttl_s: float | None = None) -> DataFrame:
    """Replays a request log through a circuit breaker per key; a key silent for ``ttl_s`` starts anew."""
    return _either(df, keys, order, *_lasting(steps.breaker(failures, recovery_s, successes), steps.BREAKER_ZERO, ttl_s),
                   _extend(df, "state STRING, executed BOOLEAN, failures BIGINT"), limit)


def breaker_stats(states: DataFrame, keys: Sequence[str], as_of: Column, minutes: int = 5) -> DataFrame:
    """Latest state per key, and success rate and mean response of the recent executed requests."""
    recent = F.col("executed") & (F.unix_micros(as_of) - F.col("us") < minutes * 60_000_000)
    good = recent & F.col("success")
    return states.groupBy(*keys).agg(
        F.max_by("state", F.struct("us", "event_id")).alias("state"), F.count_if(recent).alias("requests"),
        F.round(F.coalesce(F.try_divide(F.count_if(good) * 100.0, F.count_if(recent)), F.lit(0.0)), 2).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(good, F.col("response_time"))), F.lit(0.0)), 3).alias("avg_response"))


def recovery_state(df: DataFrame, keys: Sequence[str] = ("service",), order: Sequence[str] = ("us", "event_id"),
                   attempts: int = 3, limit: int | None = None, ttl_s: float | None = None) -> DataFrame:
    """Attempt counter per service; blocked after too many failures in a row, until silent for ``ttl_s``."""
    return _either(df, keys, order, *_lasting(steps.recovery(attempts), {"n": 0, "blocked": False}, ttl_s),
                   _extend(df, "action STRING, attempts BIGINT"), limit)


def bounded_history(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("us", "event_id"), memory: int = 1000,
                    ttl_s: float = 86400.0, ts="ts", limit: int | None = None) -> DataFrame:
    """History size per row under a row cap and a time to live."""
    if df.isStreaming:
        return keyed_fold(df, keys, order, steps.history(memory, ttl_s), {"t": []}, _extend(df, "history_size BIGINT"), "1 hour")
    d = moving(df.withColumn("__one", F.lit(1)), keys, {"history_size": ("count", "__one")}, ts=ts, span_s=ttl_s, closed=True)
    return d.withColumn("history_size", F.least(F.lit(memory).cast("long"), "history_size")).drop("__one")


# --- windows --------------------------------------------------------------

def batch_stats(df: DataFrame, keys: Sequence[str] = ("device", "metric"), minutes: int = 60, ts="ts", value="value",
                watermark: str = "10 minutes") -> DataFrame:
    """Count, mean, extremes and deviation per key and tumbling window."""
    d = df.withWatermark(ts, watermark) if df.isStreaming else df
    return d.groupBy(*keys, F.window(ts, f"{minutes} minutes")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev")).withColumn("start", F.col("window.start")).drop("window")


def window_means(df: DataFrame, keys: Sequence[str] = ("host",), minutes: int = 5, slide: int = 1,
                 ts="ts", value="value", watermark: str = "10 minutes") -> DataFrame:
    """Sliding window means."""
    d = df.withWatermark(ts, watermark) if df.isStreaming else df
    means = d.groupBy(*keys, F.window(ts, f"{minutes} minutes", f"{slide} minutes")).agg(F.avg(value).alias("mean"))
    return means.withColumn("end", F.col("window.end")).drop("window")


def window_rules(df: DataFrame, op: str, threshold: float, keys: Sequence[str] = ("host",), minutes: int = 5, slide: int = 1,
                 ts="ts", value="value", watermark: str = "10 minutes") -> DataFrame:
    """Sliding window means that breach a rule.

    A stream's means still change, so its rule is applied to the newest mean of each window, after
    the stream: a breach that a later batch takes back is none."""
    means = window_means(df, keys, minutes, slide, ts, value, watermark)
    if df.isStreaming:
        means = run_update(means, [*keys, "end"])
    return means.where(breaches("mean", F.lit(op), F.lit(threshold)))


def dedupe_alerts(df: DataFrame, key: str = "fingerprint", ts="ts", watermark: str = "1 hour", order: Sequence[str] = ()) -> DataFrame:
    """The first alert per fingerprint; a stream forgets a fingerprint after the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(ts, *order)).alias("r")).select(key, "r.*")


def stream_stats(df: DataFrame, error: Column, latency: str | None = None) -> DataFrame:
    """Points processed, errors, quality score and mean latency."""
    n, e = F.count(F.lit(1)), F.count_if(error)
    out = [n.alias("processed"), e.alias("errors"), F.greatest(F.lit(0.0), 1.0 - e / F.greatest(n, F.lit(1))).alias("quality_score")]
    if latency:
        out.append(F.avg(latency).alias("avg_latency"))
    return df.agg(*out)
