"""Queries for learned models; they have no SQL form and are tested against brute force."""

from pyspark.sql import functions as F

from pulsegrid.operators import cluster, forecast as X, forest, stats as M
from pulsegrid.plans.registry import Tables, query, r6, us

METRICS = ["click", "error", "purchase", "signup", "view"]


def wide(t: Tables):
    """Hourly means of each event type side by side."""
    return t.points.groupBy(F.date_trunc("hour", "ts").alias("ts")).pivot("metric", METRICS).agg(F.avg("value"))


@query("m01_isolation_forest")
def _(t):
    d = t.points.select("event_id", "metric", "value")
    return forest.isolation_forest(d, ["metric"], ["value"], ["event_id"]).select(
        "event_id", "metric", "value", r6("score").alias("score"), r6("decision").alias("decision"), "is_anomaly", "severity")


@query("m02_anomaly_intervals")
def _(t):
    return forest.anomaly_intervals(wide(t).fillna(0), ["click", "view", "error"], ["ts"], threshold=-0.05)


@query("m03_forest_anomalies")
def _(t):
    return forest.forest_anomalies(wide(t), ["click", "view"], ["ts"])


@query("m08_dbscan")
def _(t):
    d = M.standard_scale(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
                         ["l_quantity", "l_extendedprice"])
    return cluster.cluster_stats(cluster.dbscan(d, ["l_quantity_scaled", "l_extendedprice_scaled"], 0.05, 5),
                                 ["l_quantity", "l_extendedprice"])


@query("m10_rf_forecast")
def _(t):
    d = t.points.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("load"))
    made = X.rf_forecast(d, "load", trees=20)
    return made[0].select("target", "step", us("at").alias("at_us"), r6("current").alias("current"), r6("predicted").alias("predicted"))


@query("m18_sequence_forecast")
def _(t):
    return X.sequence_forecast(t.points.select("metric", "ts", "event_id", "value"), ["metric"], ["ts", "event_id"])


@query("m19_unusual_volume")
def _(t):
    return forest.unusual_volume(t.points)


@query("m20_analyze")
def _(t):
    from pulsegrid.plans.series_queries import trending
    hourly = trending(t).groupBy(F.date_trunc("hour", "ts").alias("ts")).pivot(
        "metric", ["cpu_usage", "memory_usage", "purchase"]).agg(F.avg("value"))
    return X.analyze({"host_resources": (hourly, ["cpu_usage", "memory_usage", "disk_usage"]),
                      "network_summary": (hourly, ["purchase", "missing"])}, trees=30)
