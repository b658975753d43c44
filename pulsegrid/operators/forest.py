"""Isolation forests.

Every tree is grown from at most 256 rows drawn by hash, so fitting never gathers a
series; scoring streams over the rows with the finished trees at hand.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.operators import kernels
from pulsegrid.operators.aggregates import resample, value_at_rank
from pulsegrid.operators.kernels import SAMPLE
from pulsegrid.operators.predicates import ffill
from pulsegrid.operators.stats import standard_scale
from pulsegrid.operators.windows import anomaly_islands
from pulsegrid.scale import GROUP_LIMIT, join_keys, largest_group
from pulsegrid.session import cut, spread

SPREAD_ROWS = 5_000_000  # inputs below this may sit in too few splits to score in parallel
BROADCAST_KEYS = 32  # forests of this many keys stay under about 100 MB

TREE = "tree INT, feature ARRAY<INT>, cut ARRAY<DOUBLE>, low ARRAY<INT>, high ARRAY<INT>, path ARRAY<DOUBLE>, drawn INT"


def _rows() -> Column:
    return F.count(F.lit(1))


def fit_forest(df: DataFrame, keys: Sequence[str], cols: Sequence[str], id: Sequence[str], trees: int = 100,
               seed: int = 42) -> DataFrame:
    """One row per key and tree.

    A row's hash is a point on a circle, and each tree looks at an arc of it that holds
    about twice the sample, starting at its own angle; of the rows on the arc it uses the
    256 with the smallest hash of row and tree."""
    keys, cols = list(keys), list(cols)
    n = df.groupBy(*keys).agg(_rows().alias("__n"))
    span = 1 << 31
    arc = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("__n")) * span
    # the golden ratio spreads any number of starting angles evenly
    golden = int(span * 0.6180339887498949)
    # only the trees whose arc holds the row: none for most rows of a long series
    there = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                     lambda t: F.pmod(F.col("__u") + t.cast("long") * golden, F.lit(span)) < F.col("__arc"))
    drawn = (join_keys(df.select(*keys, *cols, *[c for c in id if c not in keys + cols]), n, keys)
             .withColumn("__u", F.pmod(F.xxhash64(*id, F.lit(seed)), F.lit(span))).withColumn("__arc", arc)
             .withColumn("tree", F.explode(there)).drop("__u", "__arc")
             .withColumn("__h", F.xxhash64(*id, "tree", F.lit(seed))))
    w = Window.partitionBy(*keys, "tree").orderBy("__h", *id)
    sample = drawn.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= SAMPLE)
    out = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(TREE).fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r")
        x = pdf[cols].to_numpy(dtype=float)
        tree = int(pdf["tree"].iloc[0])
        f, c, lo, hi, path = kernels.grow(x, np.random.default_rng([seed, tree, len(x)]))
        row = pdf[keys].iloc[[0]].copy()
        for name, v in (("tree", tree), ("drawn", len(x))):
            row[name] = v
        for name, v in (("feature", f), ("cut", c), ("low", lo), ("high", hi), ("path", path)):
            row[name] = pd.Series([v], index=row.index)
        return row[[x.name for x in out.fields]]

    return spread(sample, *keys, "tree").groupBy(*keys, "tree").applyInPandas(fit, out)


def score_forest(df: DataFrame, forest: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 limit: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Adds ``score``: minus the anomaly measure, from −1 (isolated at once) to 0.

    The forests of up to ``broadcast_keys`` keys travel to every task.  With more keys,
    rows and forests meet per key, and a crowded key is cut into slices that each get
    its forest."""
    keys, cols = list(keys), list(cols)
    schema = T.StructType(df.schema.fields + [T.StructField("score", T.DoubleType())])

    def score(pdf, model):
        return pdf.assign(score=kernels.score(pdf[cols].to_numpy(dtype=float), model))

    if len(forest.select(*keys).distinct().take(broadcast_keys + 1)) <= broadcast_keys:
        def series(k):
            return tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))

        models = {series(k): kernels.as_trees(list(g.sort_values("tree").itertuples())) for k, g in forest.toPandas().groupby(keys, dropna=False)}
        shared = df.sparkSession.sparkContext.broadcast(models)

        def run(batches):
            for pdf in batches:
                parts = [score(g, shared.value[series(k)]) for k, g in pdf.groupby(keys, sort=False, dropna=False)
                         if series(k) in shared.value]
                if parts:
                    yield pd.concat(parts)

        return df.mapInPandas(run, schema)

    limit = GROUP_LIMIT if limit is None else limit
    slices = max(1, -(-largest_group(df, keys) // limit))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*plain), F.lit(slices)))
    copies = forest.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        return score(left.drop(columns="__slice"), kernels.as_trees(list(right.sort_values("tree").itertuples())))[[f.name for f in schema.fields]]

    on = keys + ["__slice"]
    return sliced.groupBy(*on).cogroup(copies.groupBy(*on)).applyInPandas(meet, schema)


def quantile_cut(df: DataFrame, keys: Sequence[str], col: str, share: float, out: str, limit: int | None = None) -> DataFrame:
    """Linear-interpolated quantile per key; beyond ``limit`` rows by exact ranks."""
    if largest_group(df, keys) <= (GROUP_LIMIT if limit is None else limit):
        return df.groupBy(*keys).agg(F.percentile(col, F.lit(share)).alias(out))
    n = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(_rows().alias("__n"))
    at = join_keys(value_at_rank(df, keys, col, {"__lo": lambda n: [F.floor((n - 1) * share)],
                                                 "__hi": lambda n: [F.ceil((n - 1) * share)]}, limit), n, keys)
    place = (F.col("__n") - 1) * share
    return at.select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (place - F.floor(place))).alias(out))


def isolation_forest(df: DataFrame, keys: Sequence[str], cols: Sequence[str], id: Sequence[str],
                     contamination: float = 0.1, trees: int = 100, seed: int = 42, min_rows: int = 10,
                     high_below: float = -0.5, limit: int | None = None) -> DataFrame:
    """Scores every row of every series with enough rows: ``score``, ``decision`` (score
    minus the contamination quantile), ``is_anomaly`` and ``severity`` of anomalies."""
    keys = list(keys)
    d = df.dropna(subset=list(cols))
    sizes = d.groupBy(*keys).agg(_rows().alias("__n")).where(F.col("__n") >= min_rows)
    d = join_keys(d, sizes.select(*keys), keys, "left_semi")
    if (sizes.agg(F.sum("__n")).first()[0] or 0) < SPREAD_ROWS:
        d = spread(d, *id)
    forest = cut(fit_forest(d, keys, cols, id, trees, seed))
    scored = cut(score_forest(d, forest, keys, cols, limit))
    offset = quantile_cut(scored, keys, "score", contamination, "__offset", limit)
    return join_keys(scored, offset, keys).withColumn("decision", F.col("score") - F.col("__offset")).drop("__offset").withColumns({
        "is_anomaly": F.col("decision") < 0,
        "severity": F.when(F.col("decision") < 0, F.when(F.col("decision") < high_below, "high").otherwise("medium"))})


def anomaly_intervals(df: DataFrame, features: Sequence[str], order: Sequence[str], contamination: float = 0.1,
                      threshold: float = -0.1, critical: float = -0.3, min_rows: int = 100, trees: int = 100,
                      seed: int = 42, limit: int | None = None) -> DataFrame:
    """Joint anomalies of a wide frame as intervals with per-feature statistics."""
    features = list(features)
    d = standard_scale(df.dropna(subset=features), features).withColumn("__all", F.lit(0))
    scored = isolation_forest(d, ["__all"], [f"{f}_scaled" for f in features], order, contamination, trees, seed, min_rows, limit=limit)
    runs = anomaly_islands(scored, ["__all"], order, F.col("decision") < threshold, "decision", features, limit)
    return runs.drop("__all", "island").withColumns({
        "severity": F.when(F.col("avg_score") < critical, "critical").otherwise("warning"),
        "confidence": F.least(F.lit(1.0), F.abs("avg_score"))})


def forest_anomalies(df: DataFrame, features: Sequence[str], order: Sequence[str], contamination: float = 0.1,
                     high_below: float = -0.6, min_rows: int = 10, trees: int = 100, seed: int = 42,
                     limit: int | None = None) -> DataFrame:
    """Anomalous rows of a wide frame after forward fill, graded by their raw score."""
    features = list(features)
    d = ffill(df.withColumn("__all", F.lit(0)), features, ["__all"], order, "zero", limit)
    d = standard_scale(d, features)
    scored = isolation_forest(d, ["__all"], [f"{f}_scaled" for f in features], order, contamination, trees, seed, min_rows, limit=limit)
    return scored.where("is_anomaly").withColumn("severity", F.when(F.col("score") < high_below, "high").otherwise("medium")) \
        .select(*order, *features, "score", "severity")


def unusual_volume(df: DataFrame, keys: Sequence[str] = ("metric",), ts="ts", value="value", contamination: float = 0.05,
                   min_hours: int = 12, trees: int = 100, seed: int = 42) -> DataFrame:
    """Hours whose total stands out among the hourly totals of a series."""
    hourly = resample(df, ts, "hour", "sum", keys, value)
    scored = isolation_forest(hourly, keys, ["value"], ["bucket"], contamination, trees, seed, min_hours + 1)
    return scored.where("is_anomaly").select(*keys, F.col("bucket").alias("hour"), F.col("value").alias("total"), "score", "severity")
