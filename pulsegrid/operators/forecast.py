"""Learned forecasts and the full analysis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.functions.scalars import calendar, future_grid, growth_band
from pulsegrid.operators import kernels, stats
from pulsegrid.operators.forest import anomaly_intervals
from pulsegrid.operators.joins import lag_at
from pulsegrid.operators.predicates import ffill
from pulsegrid.operators.windows import nth_last, rolling
from pulsegrid.scale import join_keys, positions

FEATURES = ("hour", "day_of_week", "is_weekend", "rolling_mean", "rolling_std", "day_mean", "lag_1h", "lag_6h")


def forecast_features(df: DataFrame, target: str, ts: str = "ts", limit: int | None = None) -> DataFrame:
    """Calendar, rolling and exact-lag features of one series; incomplete rows drop."""
    d = df.dropna(subset=[target]).select(ts, F.col(target).cast("double").alias("y")).withColumn("__all", F.lit(0))
    d = rolling(d, ["__all"], ts, "y", 6 * 3600, ["mean", "std"])
    d = rolling(d, ["__all"], ts, "y", 24 * 3600, ["mean"], "day")
    d = lag_at(d, ["__all"], ts, "y", 3600, "lag_1h", limit)
    d = lag_at(d, ["__all"], ts, "y", 6 * 3600, "lag_6h", limit)
    return calendar(d, ts).dropna(subset=list(FEATURES))


def rf_forecast(df: DataFrame, target: str, ts: str = "ts", horizon: int = 24, trees: int = 100, depth: int = 10,
                seed: int = 42, min_rows: int = 100, limit: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(forecast, quality) of a random forest on one series, or None with too little data.

    The future rows carry the newest rolling values, the last value as one-hour lag and
    the sixth last as six-hour lag."""
    d = forecast_features(df, target, ts, limit)
    d = d.withColumn("__id", F.unix_micros(ts))
    if d.limit(min_rows).count() < min_rows:
        return None
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train, test = stats.hash_split(assemble.transform(d), "__id")
    model = RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="predicted", numTrees=trees,
                                  maxDepth=depth, seed=seed).fit(train)
    quality = stats.evaluate(model.transform(test), actual="y").withColumn("target", F.lit(target))
    newest_row = d.groupBy("__all").agg(F.max_by(F.struct(*d.columns), ts).alias("r"))
    tail = nth_last(d, ["__all"], [ts], "y", 6, limit)
    grid = (newest_row.join(tail, "__all")
            .select("r.*", "last", "nth", F.posexplode(future_grid(F.col(f"r.{ts}"), horizon)).alias("step", "at"))
            .drop("hour", "day_of_week", "is_weekend", "lag_1h", "lag_6h"))
    grid = calendar(grid, "at").withColumns({"lag_1h": F.col("last"), "lag_6h": F.col("nth")})
    forecast = model.transform(assemble.transform(grid)).select(
        F.lit(target).alias("target"), (F.col("step") + 1).alias("step"), "at", F.col("last").alias("current"), "predicted")
    return forecast, quality


def growth_alert(forecast: DataFrame) -> DataFrame:
    """Targets whose highest prediction is at least half again the current value."""
    return forecast.groupBy("target").agg(F.first("current").alias("current"), F.max("predicted").alias("predicted_max"),
                                          F.avg("predicted").alias("predicted_mean")) \
        .withColumn("severity", growth_band("current", "predicted_max")).where("severity IS NOT NULL")


def sequence_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], col="value", lookback: int = 24,
                      horizon: int = 24, step_s: int = 300, ts="ts", min_train: int = 10, slots: int = 64,
                      ridge: float = 1e-6, piece: int = 50_000, limit: int | None = None) -> DataFrame:
    """Recursive multi-step forecast of every series.

    Windows of ``lookback`` scaled values predict the next one with a linear learner
    fitted on the first four fifths and judged on the rest; each prediction is fed back
    as input.  Series are cut into pieces led by the rows their first windows need.  A
    piece adds up its normal equations, so windows are never shuffled; the sums are
    combined in ``slots`` parts and then once per series.
    """
    keys = list(keys)
    d = df.select(*keys, *order, col)
    if not d.where(F.col(col).isNull()).isEmpty():
        d = ffill(d, [col], keys, order, "bfill", limit).dropna(subset=[col])
    ends = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("s_min"), F.max(col).alias("s_max"))
    span = F.col("s_max") - F.col("s_min")
    d = join_keys(positions(d, keys, [F.col(o) for o in order], "__at", limit), ends, keys).select(
        *keys, *order, "__at", "n", "s_min", "s_max",
        ((F.col(col) - F.col("s_min")) / F.when(span > 0, span).otherwise(1.0)).alias("s"))
    here = F.floor(F.col("__at") / piece)
    lead = F.when(F.col("__at") % piece >= piece - lookback, F.array(here, here + 1)).otherwise(F.array(here))
    pieces = d.select(*keys, "__at", "n", "s", F.explode(lead).alias("__piece"))
    key_fields = [df.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    sums = T.StructType(key_fields + [T.StructField("slot", T.LongType())] + [
        T.StructField(c, doubles) for c in ("train_a", "train_b", "test_a", "test_b")] + [
        T.StructField(c, T.DoubleType()) for c in ("train_n", "test_n", "test_y")])
    names = [f.name for f in sums.fields]
    vectors, numbers = names[-7:-3], names[-3:]

    def equations(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        s, at = pdf["s"].to_numpy(float), pdf["__at"].to_numpy()
        if len(s) <= lookback:
            return pd.DataFrame(columns=names)
        x, y = np.lib.stride_tricks.sliding_window_view(s, lookback)[:-1], s[lookback:]
        edge = lookback + int((int(pdf["n"].iloc[0]) - lookback) * 0.8)
        train = at[lookback:] < edge
        a1, b1 = kernels.normal_sums(x[train], y[train])
        a2, b2 = kernels.normal_sums(x[~train], y[~train])
        row = [*(pdf[k].iloc[0] for k in keys), int(pdf["__piece"].iloc[0]) % slots, a1.ravel().tolist(), b1.tolist(),
               a2.ravel().tolist(), b2.tolist(), float(train.sum()), float((~train).sum()), float((y[~train] ** 2).sum())]
        return pd.DataFrame([row], columns=names)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[[0]].copy()
        for c in numbers:
            row[c] = float(pdf[c].sum())
        for c in vectors:
            row[c] = pd.Series([np.sum([np.asarray(v) for v in pdf[c]], axis=0).tolist()], index=row.index)
        return row

    model_schema = T.StructType(key_fields + [T.StructField("w", doubles), T.StructField("test_rmse", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t = add(pdf).iloc[0]
        if t["train_n"] < min_train:
            return pd.DataFrame(columns=[f.name for f in model_schema.fields])
        w = kernels.solve_normal(t["train_a"], t["train_b"], ridge)
        return pd.DataFrame([[*(t[k] for k in keys), w, kernels.rmse(t["test_a"], t["test_b"], t["test_y"], t["test_n"], w)]],
                            columns=[f.name for f in model_schema.fields])

    partial = pieces.groupBy(*keys, "__piece").applyInPandas(equations, sums)
    models = partial.groupBy(*keys, "slot").applyInPandas(add, sums).groupBy(*keys).applyInPandas(solve, model_schema)

    def dot(window, w):
        return F.aggregate(F.zip_with(window, F.slice(w, 1, lookback), lambda p, q: p * q), F.get(w, F.lit(lookback)),
                           lambda s, v: s + v)

    # the last window of a series: its rows are known by position
    last = d.where(F.col("__at") >= F.col("n") - lookback).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("__at", "s"))).alias("tail"), F.max(ts).alias("last"),
        F.first("s_min").alias("s_min"), F.first("s_max").alias("s_max"))
    roll = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.transform("tail", lambda t: t["s"]),
                       lambda acc, i: F.concat(acc, F.array(dot(F.slice(acc, -lookback, lookback), F.col("w")))))
    out = join_keys(last, models, keys) \
        .select(*keys, "last", "s_min", "s_max", "test_rmse", F.posexplode(F.slice(roll, lookback + 1, horizon)).alias("step", "s"))
    out = stats.minmax_inverse(out, "s", "s", "predicted")
    return out.select(*keys, (F.col("step") + 1).alias("step"),
                      F.timestamp_micros(F.unix_micros("last") + (F.col("step") + 1).cast("long") * step_s * 1_000_000).alias("at"),
                      "predicted", "test_rmse")


def analyze(measurements: dict[str, tuple[DataFrame, Sequence[str]]], order: Sequence[str] = ("ts",),
            forecast: bool = True, trees: int = 100, limit: int | None = None) -> DataFrame:
    """All analyses over several wide frames as one insight frame.

    Joint anomalies, forecasts, trends, and capacity for measurements that are resources.
    ``measurements`` maps a name to (frame, wanted features); absent features are skipped.
    """
    parts = []

    def insight(d, measurement, kind, metric, confidence):
        return d.select(F.lit(measurement).alias("measurement"), F.lit(kind).alias("kind"), metric.alias("metric"),
                        "severity", confidence.cast("double").alias("confidence"))

    for name, (df, wanted) in measurements.items():
        feats = [f for f in wanted if f in df.columns]
        if not feats:
            continue
        parts.append(insight(anomaly_intervals(df, feats, order, trees=trees, limit=limit), name, "anomaly_detection",
                             F.lit(",".join(feats)), F.col("confidence")))
        long = df.select(*order, *feats).unpivot(list(order), feats, "metric", "value")
        if forecast:
            for f in feats:
                made = rf_forecast(df, f, order[0], trees=trees, limit=limit)
                if made:
                    accuracy = made[1].select("accuracy").scalar()
                    parts.append(insight(growth_alert(made[0]), name, "predictive_analytics", F.col("target"), accuracy))
        parts.append(insight(stats.performance_trends(long, ["metric"], order, limit=limit), name, "performance_analysis",
                             F.col("metric"), F.col("confidence")))
        if "resources" in name:
            parts.append(insight(stats.capacity_plan(long, ["metric"], order, limit=limit), name, "capacity_planning",
                                 F.col("metric"), F.lit(0.7)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
