"""Statistical operators without learned models: outliers, scaling, trends, capacity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.functions.scalars import future_grid
from pulsegrid.operators.aggregates import head_tail, resample
from pulsegrid.scale import join_keys, positions
from pulsegrid.session import cut


def rows() -> Column:
    return F.count(F.lit(1))


def sigma_outliers(df: DataFrame, keys: Sequence[str], col="value", k: float = 2.0) -> DataFrame:
    """Rows more than ``k`` population deviations from the mean of their key; three rows needed."""
    s = df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), rows().alias("__n"))
    return join_keys(df, s.where("__n >= 3").drop("__n"), keys).where(F.abs(F.col(col) - F.col("mean")) > k * F.col("std"))


def deviation_severity(df: DataFrame, keys: Sequence[str], col="value", flag="is_anomaly") -> DataFrame:
    """Severity of a series' anomalies from their largest distance to the mean, relative to it."""
    keys = list(keys)
    s = df.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.count_if(F.col(flag)).alias("anomalies"),
        F.min(F.when(F.col(flag), F.col(col))).alias("__lo"), F.max(F.when(F.col(flag), F.col(col))).alias("__hi"))
    dev = F.greatest(F.abs(F.col("__lo") - F.col("mean")), F.abs(F.col("__hi") - F.col("mean")))
    return s.where("anomalies > 0").withColumn("max_deviation", dev).withColumn(
        "severity", F.when(dev > F.col("mean") * 0.5, "high").when(dev > F.col("mean") * 0.2, "medium").otherwise("low")) \
        .drop("__lo", "__hi")


def standard_scale(df: DataFrame, cols: Sequence[str], suffix="_scaled") -> DataFrame:
    """Zero mean and unit population deviation; a constant column only loses its mean."""
    s = df.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])).scalar()
    d = df.withColumn("__s", s)
    return d.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__s.{c}_m")) / F.when(
        F.col(f"__s.{c}_s") > 0, F.col(f"__s.{c}_s")).otherwise(1.0) for c in cols}).drop("__s")


def minmax_scale(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """To [0, 1] per key; keeps ``<out>_min`` and ``<out>_max`` for the inverse."""
    s = df.groupBy(*keys).agg(F.min(col).alias(f"{out}_min"), F.max(col).alias(f"{out}_max"))
    span = F.col(f"{out}_max") - F.col(f"{out}_min")
    return join_keys(df, s, keys).withColumn(out, (F.col(col) - F.col(f"{out}_min")) / F.when(span > 0, span).otherwise(1.0))


def minmax_inverse(df: DataFrame, scaled: str, prefix: str, out: str) -> DataFrame:
    span = F.col(f"{prefix}_max") - F.col(f"{prefix}_min")
    return df.withColumn(out, F.col(scaled) * F.when(span > 0, span).otherwise(1.0) + F.col(f"{prefix}_min"))


def trend_forecast(df: DataFrame, hours: int = 24, keys: Sequence[str] = ("metric",), ts="ts", value="value",
                   percent_metrics: Sequence[str] = ("cpu_usage", "memory_usage", "disk_usage")) -> DataFrame:
    """Hourly straight-line forecast with a two-sigma band, fit quality, direction and alert.

    Fifty samples and twenty hours are needed.  Hours without samples keep their place on
    the axis but do not enter the fit."""
    keys = list(keys)
    enough = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(rows().alias("__n")).where("__n >= 50")
    grid = resample(df, ts, "hour", "mean", keys, value)
    ends = grid.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), rows().alias("hours"))
    x = ((F.unix_micros("bucket") - F.unix_micros("lo")) / 3_600_000_000).cast("double")
    fit = join_keys(join_keys(grid, ends, keys).where("value IS NOT NULL").withColumn("x", x).groupBy(*keys).agg(
        F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"),
        F.coalesce(F.regr_r2("value", "x"), F.lit(0.0)).alias("r2"), F.var_pop("value").alias("var"),
        F.first("hours").alias("hours"), F.first("hi").alias("hi")).where("hours >= 20"),
        enough.select(*keys), keys, "left_semi")
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("var") * (1 - F.col("r2"))))

    def at(step):
        return F.col("slope") * (F.col("hours") + step - 1) + F.col("intercept")

    peak = F.greatest(at(F.lit(1)), at(F.lit(hours)))
    named = F.col(keys[0]).isin(*percent_metrics)
    out = fit.withColumns({"sigma": sigma, "alert": named & (peak > 90),
                           "trend": F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")}) \
        .select("*", F.posexplode(future_grid("hi", hours)).alias("__i", "at"))
    pred = at(F.col("__i") + 1)
    return out.select(*keys, (F.col("__i") + 1).alias("step"), "at", pred.alias("predicted"),
                      (pred - 2 * F.col("sigma")).alias("lower"), (pred + 2 * F.col("sigma")).alias("upper"),
                      F.col("r2").alias("accuracy"), "trend", "alert")


def hash_split(df: DataFrame, id: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a digest of the id, so the split never depends on layout."""
    h = F.conv(F.substring(F.md5(F.col(id).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    edge = int(test_share * 1000)
    return df.where(h >= edge), df.where(h < edge)


def evaluate(df: DataFrame, keys: Sequence[str] = (), actual="actual", predicted="predicted") -> DataFrame:
    """MAE, MSE and accuracy 1 − MAE / mean."""
    err = F.col(actual) - F.col(predicted)
    mae, mean = F.avg(F.abs(err)), F.avg(actual)
    return df.groupBy(*keys).agg(rows().alias("n"), mae.alias("mae"), F.avg(err * err).alias("mse"),
                                 F.when(mean > 0, 1 - mae / mean).otherwise(0.0).alias("accuracy"))


# --- straight lines over position -----------------------------------------

def line_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], value="value", limit: int | None = None) -> DataFrame:
    """Slope, intercept, r, population spread and last value of each series over position.

    One aggregate per series after its positions; nothing per series leaves Spark."""
    d = df.where(F.col(value).isNotNull())
    p = positions(d, keys, [F.col(o) for o in order], "__at", limit).withColumn("__x", F.col("__at").cast("double"))
    return p.groupBy(*keys).agg(
        rows().alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.regr_slope(value, "__x").alias("slope"), F.regr_intercept(value, "__x").alias("intercept"),
        F.corr(value, "__x").alias("r"), F.regr_r2(value, "__x").alias("r2"), F.max_by(value, "__at").alias("current"))


def _beta_cf(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz), elementwise."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def _two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    from math import lgamma

    df = np.maximum(n - 2.0, 1.0)
    r2 = np.minimum(r * r, 1.0)
    x = np.clip(1 - r2, 0.0, 1.0)  # df / (df + t^2)
    a, b = df / 2, np.full_like(df, 0.5)
    lbeta = np.array([lgamma(i) + lgamma(0.5) - lgamma(i + 0.5) for i in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - lbeta)
    swap = x >= (a + 1) / (a + b + 2)
    out = np.where(swap, 1 - front * _beta_cf(b, a, 1 - x) / b, front * _beta_cf(a, b, x) / a)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n pairs; runs on one row per series."""
    return pd.Series(_two_sided_p(r.fillna(0).to_numpy(float), n.to_numpy(float)))


def performance_trends(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
                       value="value", limit: int | None = None) -> DataFrame:
    """Series with a strong trend (|r| > 0.7, p < 0.05) whose last ten rows differ by more
    than a fifth from the first ten."""
    keys = list(keys)
    fit = line_fit(df, keys, order, value, limit).where("n >= 20").where(F.abs("r") > 0.7)
    ht = head_tail(df, keys, order, 10, value, limit)
    chg = F.when(F.col("head_mean") > 0, (F.col("tail_mean") - F.col("head_mean")) / F.col("head_mean") * 100).otherwise(0.0)
    return (join_keys(fit, ht, keys).withColumns({"change_pct": chg, "p_value": correlation_p("r", F.col("n").cast("double"))})
            .where("p_value < 0.05").where(F.abs("change_pct") > 20)
            .withColumns({"direction": F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"),
                          "severity": F.when(F.abs("change_pct") > 50, "critical").otherwise("warning"),
                          "confidence": F.abs("r")})
            .select(*keys, "n", "slope", "r", "p_value", "change_pct", "direction", "severity", "confidence"))


def capacity_plan(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
                  value="value", min_rows: int = 100, limit: int | None = None) -> DataFrame:
    """Growth from the first to the last 24 rows, days until 90 percent, 30-day projection."""
    keys = list(keys)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(rows().alias("n")).where(F.col("n") >= min_rows)
    d = join_keys(n, head_tail(df, keys, order, 24, value, limit), keys)
    growth = F.try_divide(F.col("tail_mean") - F.col("head_mean"), F.col("head_mean")) * 100
    return (d.withColumn("growth_pct", growth).where("growth_pct > 0")
            .withColumns({"current": F.col("tail_mean"), "days_to_90": (90 - F.col("tail_mean")) / (F.col("growth_pct") / 7),
                          "projected_30d": F.col("tail_mean") + F.col("growth_pct") * 4.28})
            .where("days_to_90 < 30")
            .withColumn("severity", F.when(F.col("days_to_90") < 7, "critical").otherwise("warning"))
            .select(*keys, "current", "growth_pct", "days_to_90", "projected_30d", "severity"))


def exhaustion(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
               value="value", limit: int | None = None) -> DataFrame:
    """Steps until 95 for rising series above 70; critical under 20, warning under 60."""
    fit = line_fit(df, keys, order, value, limit).where("n >= 3 AND slope > 0 AND current > 70")
    return fit.withColumn("steps", (95 - F.col("current")) / F.col("slope")).where("steps < 60").withColumn(
        "severity", F.when(F.col("steps") < 20, "critical").otherwise("warning")) \
        .select(*keys, "current", "slope", "steps", "severity")


def classify_behavior(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
                      value="value", limit: int | None = None) -> DataFrame:
    """stable, volatile, trending_up, trending_down, normal or insufficient_data, with confidence."""
    fit = line_fit(df, keys, order, value, limit)
    m, slope = F.col("mean"), F.coalesce("slope", F.lit(0.0))
    cv = F.when(m > 0, F.col("std") / m).otherwise(0.0)
    kind = F.when(F.col("n") < 3, "insufficient_data").when(cv < 0.1, "stable").when(cv > 0.5, "volatile") \
        .when(F.abs(slope) > m * 0.1, F.when(slope > 0, "trending_up").otherwise("trending_down")).otherwise("normal")
    sure = F.when(kind == "insufficient_data", 0.0).when(kind == "stable", 0.9).when(kind == "volatile", 0.8) \
        .when(kind == "normal", 0.6).otherwise(0.7)
    return fit.select(*keys, "n", kind.alias("classification"), sure.alias("confidence"))


def linear_forecast(df: DataFrame, keys: Sequence[str] = ("metric",), order: Sequence[str] = ("ts", "event_id"),
                    value="value", ahead: int = 24, limit: int | None = None) -> DataFrame:
    """Straight-line value ``ahead`` steps on, with R² clamped to [0, 1] as confidence."""
    fit = line_fit(df, keys, order, value, limit).where("n >= 5")
    flat = F.col("std") == 0
    return fit.select(*keys, (F.col("slope") * (F.col("n") + ahead) + F.col("intercept")).alias("forecast"),
                      F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))).alias("confidence"),
                      "slope")


def _pair_sums(p: DataFrame, metric: str, value: str, heads: list, first: int) -> DataFrame:
    """Sums of every pair of the metrics in ``heads``, at least one of which is among the
    first ``first``: each task adds its positions' vectors to one matrix."""
    names, centre = [h[0] for h in heads], np.array([h[1] for h in heads], dtype=float)
    m = len(names)
    vec = p.where(F.col(metric).isin(names)).groupBy("__at").agg(
        F.map_from_entries(F.collect_list(F.struct(metric, F.col(value).cast("double")))).alias("m")) \
        .select(F.array(*[F.element_at("m", F.lit(x)) for x in names]).alias("v"))

    def gram(batches):
        parts = np.zeros((4, m, m))
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=float).reshape(-1, m) - centre
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            parts += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        i, j = np.triu_indices(m, 1)
        keep = i < first
        i, j = i[keep], j[keep]
        if len(i):
            yield pd.DataFrame({"a": [names[k] for k in i], "b": [names[k] for k in j], "n": parts[0][i, j], "sx": parts[1][i, j],
                                "sy": parts[1][j, i], "sxx": parts[2][i, j], "syy": parts[2][j, i], "sxy": parts[3][i, j]})

    return vec.mapInPandas(gram, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double") \
        .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlations(df: DataFrame, metric="metric", order: Sequence[str] = ("ts", "event_id"), value="value",
                 keep: float = 0.7, strong: float = 0.8, block: int = 500, limit: int | None = None) -> DataFrame:
    """Pearson correlation of every two series aligned by position, the strong ones kept.

    The rows at one position form one short vector, and each task adds its vectors to a
    matrix of sums, so the number of rows shuffled is the number of metric pairs per
    task, never pairs per position.  More than ``block`` metrics are taken block by
    block.  The driver needs one name and mean per metric.
    """
    d = df.where(F.col(value).isNotNull())
    p = positions(d, [metric], [F.col(o) for o in order], "__at", limit)
    heads = [tuple(r) for r in d.groupBy(metric).agg(F.avg(value)).orderBy(metric).collect()]
    blocks = [heads[i:i + block] for i in range(0, len(heads), block)]
    if len(blocks) > 1:
        p = cut(p.select("__at", metric, value))
    s = None
    for i, left in enumerate(blocks):
        # a block with itself, then with each later one, counting only pairs that cross
        parts = [_pair_sums(p, metric, value, left, len(left))]
        for right in blocks[i + 1:]:
            in_left, in_right = [h[0] for h in left], [h[0] for h in right]
            parts.append(_pair_sums(p, metric, value, left + right, len(left))
                         .where(F.col("a").isin(in_left) & F.col("b").isin(in_right)))
        for part in parts:
            s = part if s is None else s.unionByName(part)
    r = F.try_divide(F.expr("n * sxy - sx * sy"), F.sqrt(F.expr("greatest(n * sxx - sx * sx, 0D)")) *
                     F.sqrt(F.expr("greatest(n * syy - sy * sy, 0D)")))
    return s.where("n >= 3").select("a", "b", r.alias("correlation")).where(F.abs("correlation") > keep) \
        .withColumn("strength", F.when(F.abs("correlation") > strong, "strong").otherwise("moderate"))
