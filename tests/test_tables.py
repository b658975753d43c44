"""Tables that are rebuilt while others read them, and rules that change while a stream runs."""

import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as G, registry as X
from pulsegrid.operators.joins import applicable_rules
from pulsegrid.operators.predicates import breaches
from pulsegrid.sources import readers as R, sinks as K
from pulsegrid.streaming import streams as St


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_rebuild_that_fails_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        K.current_table(spark, path)
    first = K.rebuild_table(spark.range(5), path)
    assert ids(first) == [0, 1, 2, 3, 4]
    broken = spark.range(100, 140, 1, 4).withColumn("id", F.when(F.col("id") == 137, F.raise_error(F.lit("gone")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="gone"):
        K.rebuild_table(broken, path)
    assert ids(K.current_table(spark, path)) == [0, 1, 2, 3, 4]
    second = K.rebuild_table(spark.range(7, 9).withColumn("x", F.lit("a")), path)
    assert ids(second) == [7, 8] and second.columns == ["id", "x"]
    # who has begun to read goes on with what was there
    assert ids(first) == [0, 1, 2, 3, 4]


def test_a_table_may_be_rebuilt_from_itself_and_be_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    K.rebuild_table(spark.range(4), path)
    assert ids(K.rebuild_table(K.current_table(spark, path).where("id > 1"), path)) == [2, 3]
    empty = K.rebuild_table(spark.range(0), path)
    assert ids(empty) == [] and empty.columns == ["id"] and ids(K.current_table(spark, path)) == []


def test_a_rule_replaced_while_a_stream_runs_holds_from_the_next_batch(spark, tmp_path):
    schema, rules = "id long, metric string, value double", str(tmp_path / "rules")
    for n in range(3):
        spark.createDataFrame([(n, "cpu_usage", 50.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the order of files is that of their times
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = K.rebuild_table(R.rules_df(spark), rules)  # high_cpu_usage is above 80
    seen = []

    def work(batch, table):
        out = applicable_rules(batch, table).where(breaches("value", "op", "threshold")).select("id", "rule_id", "threshold")
        seen.append(batch.count())
        if len(seen) == 2:  # between the first and the second batch with rows: after this one
            K.rebuild_table(R.add_rule(K.current_table(spark, rules), ("high_cpu_usage", "Busy", "cpu_usage", ">", 40.0, "high", 300, 60, False, 300)), rules)
        return out

    got = St.run_with_table(live, rules, work)
    assert [(r.id, r.threshold) for r in got.orderBy("id").collect()] == [(2, 40.0)]
    assert table.count() == 5


def test_registries_are_passed_on(spark):
    before = dict(G.AGGREGATIONS), dict(X.PROCESSORS)
    known = X.register_aggregation("spread", lambda v, w: F.max(v) - F.min(v))
    more = X.register_aggregation("twice", lambda v, w: 2 * F.sum(v), known=known)
    s = spark.createDataFrame([("m", "a", 1.0, None), ("m", "b", 5.0, None), ("n", "a", 3.0, None)], "metric string, node string, value double, weight double")
    rules = spark.createDataFrame([("m", "spread"), ("n", "twice")], "metric_name string, method string")
    of = lambda **k: {r.metric: r.value for r in G.federate(s, rules, **k).collect()}
    assert of(aggregations=more) == {"m": 4.0, "n": 6.0}
    assert of(aggregations=known) == {"m": 4.0, "n": 3.0}
    assert of() == {"m": 3.0, "n": 3.0}
    rated = X.register_processor("door", lambda v, ts: (F.when(v > 0, "open").otherwise("shut"), v))
    d = spark.createDataFrame([("door", 1.0)], "metric_name string, value double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert X.process(d, processors=rated).first().rating == "open" and X.process(d).first().rating is None
    assert (G.AGGREGATIONS, X.PROCESSORS) == before


def test_the_newest_time_is_looked_for_in_one_partition(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    d = spark.sql("""SELECT 'cpu' AS measurement, timestamp_seconds(1735689600 + 3600 * id) AS time, map('host', 'a') AS tags,
                     map('v', double(id)) AS fields FROM range(72)""").withColumn("date", F.to_date("time"))
    d.write.partitionBy("measurement", "date").parquet(path)
    got = R.read_metrics(spark, path, "cpu", 7200, fields=["v"])
    assert sorted(r.v for r in got.collect()) == [69.0, 70.0, 71.0]
    got.explain("formatted")
    plan = capsys.readouterr().out
    # the scan for the newest time has the date as a constant
    assert "2025-01-03" in plan or "20091" in plan
    assert R.read_metrics(spark, path, "cpu", 7200, as_of="2025-01-01 05:00:00", fields=["v"]).count() == 3


def test_the_first_frame_with_rows(spark):
    touched = spark.sparkContext.accumulator(0)

    def heard(n):
        def run(batches):
            for b in batches:
                touched.add(1)
                yield b
        return spark.range(n).repartition(1).mapInPandas(run, "id long")
    empty, full, behind = spark.range(0).select("id"), spark.range(3).select("id", F.lit(1).alias("x")), heard(4)
    got = R.read_first_nonempty([empty, full, behind])
    assert sorted((r.id, r.x) for r in got.collect()) == [(0, 1), (1, 1), (2, 1)] and touched.value == 0
    assert R.read_first_nonempty([empty, empty]).count() == 0
