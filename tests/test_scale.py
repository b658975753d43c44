"""The cut-up paths must equal the plain windows, with a key that holds most rows."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from pulsegrid import scale, session
from pulsegrid.streaming import steps

LIMIT = 37  # far below the hot key's rows, so every helper takes its cut-up path


@pytest.fixture(scope="module")
def hot(spark):
    """600 rows, two thirds in one key, ties in time, nulls in the value and a null key."""
    rng = np.random.default_rng(7)
    n = 600
    key = rng.choice(["hot", "warm", "cold", None], n, p=[0.67, 0.2, 0.1, 0.03])
    sec = np.sort(rng.integers(0, 4000, n))
    v = np.where(rng.random(n) < 0.15, None, np.round(rng.random(n) * 100, 2))
    pdf = pd.DataFrame({"id": range(n), "k": key, "sec": sec, "v": v.astype(object)})
    return spark.createDataFrame([(int(r.id), r.k, int(r.sec), None if r.v is None else float(r.v)) for r in pdf.itertuples()],
                                 "id long, k string, sec long, v double") \
        .withColumn("ts", F.timestamp_seconds(F.col("sec"))).repartition(5, "id").cache()


def both(fn, rows, cols):
    plain, cut = rows(fn(None), *cols), rows(fn(LIMIT), *cols)
    assert plain == cut
    assert len(plain) > 0
    return plain




def cols(*names):
    return [F.col(n) for n in names]


def test_scan_sum_last_max_min(hot, rows):
    both(lambda lim: scale.scan(hot, ["k"], cols("sec", "id"), {
        "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v"))}, lim),
        rows, ["id", "s", "l", "m", "n"])


def test_scan_descending(hot, rows):
    both(lambda lim: scale.scan(hot, ["k"], [F.desc("sec"), F.desc("id")], {"l": ("last", F.col("v"))}, lim), rows, ["id", "l"])


def test_positions(hot, rows):
    got = both(lambda lim: scale.positions(hot, ["k"], cols("sec", "id"), "p", lim), rows, ["id", "p"])
    want = rows(hot.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("sec", "id")).cast("long") - 1), "id", "p")
    assert got == want


@pytest.mark.parametrize("before", [1, 9, 36, 99])
def test_over_rows(hot, rows, before):
    both(lambda lim: scale.over_rows(hot, ["k"], cols("sec", "id"), before, lambda w: {
        "s": F.sum("v").over(w.rowsBetween(-before, 0)), "n": F.count("id").over(w.rowsBetween(-before, 0))}, lim),
        rows, ["id", "s", "n"])


@pytest.mark.parametrize("piece", [None, 60, 1000])
def test_over_range(hot, rows, piece):
    span = 300
    both(lambda lim: scale.over_range(hot, ["k"], "ts", span, lambda w: {
        "n": F.count("id").over(w.rangeBetween(-(span * 1_000_000 - 1), 0)),
        "m": F.max("v").over(w.rangeBetween(-span * 1_000_000, 0))}, lim, piece), rows, ["id", "n", "m"])


def test_previous_and_islands(hot, rows):
    both(lambda lim: scale.previous(hot, ["k"], cols("sec", "id"), {"p": "v"}, lim), rows, ["id", "p"])
    both(lambda lim: scale.islands(hot, ["k"], cols("sec", "id"), F.col("v") > 50, lim), rows, ["id", "island"])


def test_newest(hot, rows):
    both(lambda lim: scale.newest(hot, ["k"], [F.desc("sec"), F.desc("id")], 12, lim), rows, ["id", "rank"])


@pytest.mark.parametrize("step,zero,out,extra", [
    (steps.rate_limit(90), {"last": None}, "sent boolean", ["sent"]),
    (steps.breaker(3, 200.0, 2), steps.BREAKER_ZERO, "state string, executed boolean, failures long", ["state", "executed", "failures"]),
    (steps.recovery(3), {"n": 0, "blocked": False}, "action string, attempts long", ["action", "attempts"]),
    (steps.grouping(wait="w", interval="i", repeat="r", new="success", resolve_s=20), {"flush": None, "seen": None, "sent": None},
     "notify_us long, reason string", ["notify_us", "reason"]),
])
def test_fold(hot, rows, step, zero, out, extra):
    d = hot.select("id", "k", (F.col("sec") * 1_000_000).alias("us"), (F.coalesce("v", F.lit(0.0)) < 60).alias("success"))
    d = d.withColumns({"w": F.lit(5), "i": F.lit(7), "r": F.lit(60)})
    schema = "id long, k string, us long, success boolean, w int, i int, r int, " + out
    both(lambda lim: scale.fold(d, ["k"], ["us", "id"], step, zero, schema, lim), rows, ["id", *extra])


STEPS = {
    "rate_limit": (lambda g: steps.rate_limit(g.integers(1, 90)), {"last": None}, ["sent"]),
    "breaker": (lambda g: steps.breaker(int(g.integers(1, 5)), float(g.integers(1, 120)), int(g.integers(1, 4))), steps.BREAKER_ZERO,
                ["state", "executed", "failures"]),
    "recovery": (lambda g: steps.recovery(int(g.integers(1, 5))), {"n": 0, "blocked": False}, ["action", "attempts"]),
    "grouping": (lambda g: steps.grouping(resolve_s=float(g.integers(20, 80))), {"flush": None, "seen": None, "sent": None}, ["notify_us", "reason"]),
}

for _name, _ttl in (("breaker", 60), ("recovery", 35), ("grouping", 150)):
    STEPS[f"forgetting {_name}"] = (lambda g, m=STEPS[_name][0], z=STEPS[_name][1], t=_ttl: steps.forgetting(m(g), z, t),
                                    {**STEPS[_name][1], "at": None}, STEPS[_name][2])


@pytest.mark.parametrize("name", STEPS)
def test_summaries_follow_the_steps(name):
    """Cut anywhere, entries found from the summaries alone are those of the plain run."""
    make, zero, out = STEPS[name]
    for seed in range(60):
        g = np.random.default_rng(seed)
        n = int(g.integers(2, 120))
        t = np.cumsum(g.choice([0, 1, 3, 10, 40, 90, 200], n, p=[.1, .3, .2, .2, .1, .05, .05])) * 1_000_000 + int(g.integers(0, 999))
        rows = pd.DataFrame({"us": t, "success": g.random(n) < g.choice([0.3, 0.6, 0.9]), "is_new": g.random(n) < g.choice([0.05, 0.5]),
                             "group_wait_s": int(g.integers(0, 20)), "group_interval_s": int(g.integers(1, 40)), "repeat_interval_s": int(g.integers(1, 400))})
        step = make(g)
        whole = step(rows, dict(zero))[0][out]
        at = np.unique(np.r_[0, g.integers(1, n, int(g.integers(0, 8))), n])
        pieces = [rows.iloc[a:b].reset_index(drop=True) for a, b in zip(at, at[1:])]
        entries = [None] * len(pieces)
        for summarise, follow in step.passes:
            made, state = [json.loads(json.dumps(summarise(p, e))) for p, e in zip(pieces, entries)], dict(zero)
            for k, s in enumerate(made):
                entries[k], state = state, json.loads(json.dumps(follow(s, state)))
        got = pd.concat([step(p, dict(e))[0][out] for p, e in zip(pieces, entries)]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, whole)


def test_summaries_do_not_grow_with_pieces():
    """One alert a second in pieces of very different sizes: a summary covers one waiting time."""
    for name in STEPS:
        sizes = []
        for n in (3000, 30_000):
            g = np.random.default_rng(1)
            rows = pd.DataFrame({"us": np.arange(n) * 1_000_000, "success": g.random(n) < 0.7, "is_new": False, "group_wait_s": 10,
                                 "group_interval_s": 30, "repeat_interval_s": 600})
            state = [None, {"flush": 0, "seen": 0, "sent": None, "at": 0}]
            step = STEPS[name][0](g)
            sizes.append(sum(len(json.dumps(summarise(rows, e))) for (summarise, _), e in zip(step.passes, state)))
        assert sizes[1] < 1.5 * sizes[0] + 100, name


def test_tables_of_a_fold_do_not_grow_with_pieces(hot, monkeypatch):
    """However finely a key is cut, a fold writes its pieces and one table for each pass."""
    d = hot.select("id", "k", (F.col("sec") * 1_000_000).alias("us"), (F.coalesce("v", F.lit(0.0)) < 60).alias("success"))
    written = []
    monkeypatch.setattr(scale, "cut", lambda df: written.append(1) or session.cut(df))
    monkeypatch.setattr(scale, "positions", lambda df, keys, order, name, *_: df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1))
    for limit in (200, 20):
        written.clear()
        scale.fold(d, ["k"], ["us", "id"], steps.recovery(3), {"n": 0, "blocked": False},
                   "id long, k string, us long, success boolean, action string, attempts long", limit).count()
        assert len(written) == 2


def test_ema_cut_up(hot, rows):
    from pulsegrid.operators.aggregates import ema
    d = hot.select("id", "k", "sec", F.coalesce("v", F.lit(0.0)).alias("v"))
    got = both(lambda lim: ema(d, ["k"], ["sec", "id"], "v", limit=lim), rows, ["id", "ema"])
    e, want = {}, []
    for r in sorted(d.collect(), key=lambda r: (r.sec, r.id)):
        e[r.k] = r.v if e.get(r.k, 0.0) == 0.0 else 0.1 * r.v + 0.9 * e[r.k]
        want.append((r.id, round(e[r.k], 6)))
    assert got == sorted(want, key=repr)


def test_value_at_rank_and_median(hot, rows):
    from pulsegrid.operators.aggregates import median
    d = hot
    got = both(lambda lim: median(d, ["k"], "v", "m", lim), rows, ["k", "m"])
    assert got == rows(d.groupBy("k").agg(F.median("v").alias("m")), "k", "m")


def test_quantile_cut(hot, rows):
    from pulsegrid.operators.forest import quantile_cut
    both(lambda lim: quantile_cut(hot, ["k"], "v", 0.1, "q", lim), rows, ["k", "q"])


def test_operators_cut_up(hot, rows):
    """Operators built on the helpers, with the cut-up path forced."""
    from pulsegrid.operators import aggregates as G, joins as J, predicates as P, stats as M, windows as W
    d = hot.withColumnRenamed("k", "metric").withColumn("value", F.coalesce("v", F.lit(1.0))).withColumn("event_id", F.col("id"))
    both(lambda lim: P.ffill(d, ["v"], ["metric"], ["sec", "id"], "bfill", lim), rows, ["id", "v"])
    both(lambda lim: G.running_mean(d, ["metric"], ["sec", "id"], limit=lim), rows, ["id", "running_mean"])
    both(lambda lim: G.device_stats(d, ["metric"], limit=lim), rows, ["metric", "n", "mean", "median", "stdev", "trend"])
    both(lambda lim: G.metric_outlook(d, limit=lim), rows, ["metric", "average", "volatility", "trend"])
    both(lambda lim: W.dynamic_threshold(d.withColumn("threshold", F.lit(50.0)).withColumn("op", F.lit(">")), memory=60, limit=lim), rows, ["id", "dynamic_threshold"])
    both(lambda lim: W.sequences(d, ["metric"], ["sec", "id"], "value", 5, lim), rows, ["id", "window", "target"])
    both(lambda lim: W.increase(d, ["metric"], "ts", "id", 300, limit=lim), rows, ["id", "increase"])
    both(lambda lim: W.held_for(d, ["metric"], ["ts", "id"], F.col("value") > 30, 20, lim), rows, ["metric", "start", "samples"])
    both(lambda lim: W.retention_plan(d.withColumn("policy", F.lit("x")), ["metric"], ["sec", "id"], limit=lim), rows, ["id", "plan"])
    both(lambda lim: J.zip_series(d, "metric", "hot", "warm", ["sec", "id"], limit=lim), rows, ["pos", "a", "b"])
    both(lambda lim: M.linear_forecast(d, limit=lim), rows, ["metric", "forecast", "confidence"])
    both(lambda lim: M.correlations(d, keep=0.0, limit=lim), rows, ["a", "b", "correlation"])
    assert rows(M.correlations(d, keep=0.0, block=1), "a", "b", "correlation") == rows(M.correlations(d, keep=0.0), "a", "b", "correlation")


def test_place_backups_both_ways(spark, rows):
    from pulsegrid.operators.joins import place_backups
    loc = spark.createDataFrame([("a", 2, 100.0), ("b", 1, 50.0), ("c", 3, 1000.0), ("d", 1, 12.0)], "location string, priority int, free double")
    sizes = [1.0, 10.0, 10.5, 40.0, 41.7, 80.0, 84.0, 500.0, 5000.0, None]
    ops = spark.createDataFrame(list(enumerate(sizes)), "id int, size double")
    want = rows(place_backups(ops, loc), "id", "location")
    assert want == rows(place_backups(ops, loc, bound=1), "id", "location")
    assert dict(want) == {0: "b", 1: "b", 2: "b", 3: "b", 4: "a", 5: "a", 6: "c", 7: "c", 8: "default", 9: "default"}


def test_small_and_largest_group(spark):
    d = spark.range(50).withColumn("k", F.col("id") % 3)
    assert scale.largest_group(d, ["k"]) == 17
    assert "broadcast" in scale.small(d, 60)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in scale.small(d, 10)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("closed", [False, True])
def test_moving_over_time_equals_sliding_frames(hot, rows, closed):
    d = hot.where("k is not null").withColumn("v", F.when(F.col("sec") % 5 < 2, F.col("v")).otherwise(F.lit(7.25)))
    got = rows(scale.moving(d, ["k"], {"n": ("count", "v"), "s": ("sum", "v"), "m": ("mean", "v"), "d": ("std", "v"),
                            "lo": ("min", "v"), "hi": ("max", "v")}, ts="ts", span_s=200, closed=closed), "id", "n", "s", "m", "d", "lo", "hi")
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-200_000_000 + (0 if closed else 1), 0)
    want = rows(d.select("id", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"), F.avg("v").over(w).alias("m"),
                         F.stddev_samp("v").over(w).alias("d"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi")),
                "id", "n", "s", "m", "d", "lo", "hi")
    assert got == want and any(r[4] == 0.0 for r in want)


@pytest.mark.parametrize("n", [2, 33, 400])
@pytest.mark.parametrize("limit", [None, LIMIT])
def test_moving_over_rows_equals_sliding_frames(hot, rows, n, limit):
    d = hot.where("k is not null").withColumn("v", F.when(F.col("id") % 40 < 9, F.col("v")).otherwise(F.lit(1e6)))
    got = rows(scale.moving(d, ["k"], {"n": ("count", "v"), "m": ("mean", "v"), "d": ("std", "v")}, order=["sec", "id"], n=n, limit=limit), "id", "n", "m", "d")
    w = Window.partitionBy("k").orderBy("sec", "id").rowsBetween(-(n - 1), 0)
    want = rows(d.select("id", F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.stddev_samp("v").over(w).alias("d")), "id", "n", "m", "d")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    # the series jumps between 25 and 1e6, and small spreads inside must survive that
    for g, x in zip(got, want):
        assert g[2] == pytest.approx(x[2], rel=1e-9) and (g[3] is x[3] is None or g[3] == pytest.approx(x[3], rel=1e-9, abs=1e-9))


def test_series_without_a_key_are_series(spark, rows):
    """Operators that join statistics back keep the series whose key is null."""
    from pulsegrid.operators.aggregates import resample
    from pulsegrid.operators.forest import isolation_forest
    from pulsegrid.operators.predicates import min_points
    from pulsegrid.operators.stats import minmax_scale, sigma_outliers
    d = spark.range(60).select(
        "id", F.when(F.col("id") % 2 == 0, "a").alias("k"), F.timestamp_seconds(F.col("id") * 1800).alias("ts"),
        F.when(F.col("id").isin(20, 21), 500.0).otherwise(F.col("id") % 7).cast("double").alias("v"))
    grid = resample(d, "ts", "hour", "sum", ["k"], "v").where("k is null")
    assert grid.count() == 30 and grid.agg(F.sum("value")).first()[0] == d.where("k is null").agg(F.sum("v")).first()[0]
    assert rows(sigma_outliers(d, ["k"], "v"), "id") == [(20,), (21,)]
    assert minmax_scale(d, ["k"], "v", "s").count() == 60 and min_points(d, ["k"], 5).count() == 60
    assert isolation_forest(d, ["k"], ["v"], ["id"], trees=20).count() == 60
