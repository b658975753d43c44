"""Registered queries: a name, a Spark callable and, where SQL can say it, SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PTS = """pts AS (SELECT event_id, ts, user_id, 'h' || (user_id % 20) AS host,
 'd' || user_id AS device, event_type AS metric, value, props FROM events)"""


class Tables:
    """The given parquet tables and the telemetry shapes derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def points(self) -> DataFrame:
        return self.events.select(
            "event_id", "ts", "user_id",
            F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"),
            F.concat(F.lit("d"), F.col("user_id")).alias("device"),
            F.col("event_type").alias("metric"), "value", "props")

    @property
    def requests(self) -> DataFrame:
        """Request log: edge src->dst, latency, outcome."""
        return self.events.select(
            "event_id", "ts", F.concat(F.lit("s"), F.col("user_id") % 10).alias("src"),
            F.col("event_type").alias("dst"), F.col("value").alias("response_time"),
            (F.col("value") <= 60).alias("success"),
            F.when(F.col("value") <= 60, 200).otherwise(500).alias("status_code"))

    @property
    def node_samples(self) -> DataFrame:
        """Federated samples: node = supplier's nation, metric = return flag."""
        s = self.read("supplier").select("s_suppkey", "s_nationkey")
        n = self.read("nation").select("n_nationkey", F.col("n_name").alias("node"))
        return (self.read("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
                .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
                .select("node", F.col("l_returnflag").alias("metric"),
                        F.col("l_shipdate").cast("timestamp").alias("ts"),
                        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight"),
                        F.create_map(F.lit("flag"), F.col("l_returnflag"),
                                     F.lit("line"), F.col("l_linestatus")).alias("labels")))

    @property
    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


NODE_SQL = """ns AS (SELECT n.n_name AS node, l.l_returnflag AS metric, l.l_shipdate AS ts,
 l.l_extendedprice AS value, l.l_quantity AS weight, l.l_linestatus AS line
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
 JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

REQ_SQL = """rq AS (SELECT event_id, ts, 's' || (user_id % 10) AS src, event_type AS dst,
 value AS response_time, value <= 60 AS success, CASE WHEN value <= 60 THEN 200 ELSE 500 END AS status_code
 FROM events)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places)


def us(c) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)
