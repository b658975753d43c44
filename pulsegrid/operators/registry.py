"""Named aggregations, processors and rules that users extend.

Registering gives a new registry, to be passed on, and leaves the one it began with as it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators.aggregates import AGGREGATIONS
from pulsegrid.sources.readers import add_rule  # noqa: F401


def register_aggregation(name: str, value: Callable[[Column, Column], Column],
                         confidence: Callable[[], Column] = lambda: F.lit(1.0), known: dict = AGGREGATIONS) -> dict:
    """The aggregations ``known`` with ``name`` for use in rules: ``value(value, weight)`` is an aggregate."""
    return {**known, name: (value, confidence)}


# Metric -> (rating, score) of a value at a time.
PROCESSORS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "temperature": lambda v, ts: (S.comfort(v), S.temp_efficiency(v)),
    "motion": lambda v, ts: (S.motion_level(v, ts), v),
    "energy": lambda v, ts: (S.energy_rating(v), S.energy_cost(v)),
    "latency": lambda v, ts: (S.network_rating(F.lit("latency"), v), v),
    "throughput": lambda v, ts: (S.network_rating(F.lit("throughput"), v), v),
    "packet_loss": lambda v, ts: (S.network_rating(F.lit("packet_loss"), v), v),
    "security": lambda v, ts: (S.risk_level(v), v),
}


def register_processor(metric: str, fn: Callable[[Column, Column], tuple[Column, Column]], known: dict = PROCESSORS) -> dict:
    """The processors ``known`` with one for ``metric``: ``fn(value, time)`` gives rating and score."""
    return {**known, metric: fn}


def process(df: DataFrame, metric="metric_name", value="value", ts="ts", processors: dict = PROCESSORS) -> DataFrame:
    """Rating and score by the processor registered for each metric; null without one."""
    m, v, t = F.col(metric), F.col(value), F.col(ts)
    rating, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, fn in processors.items():
        r, s = fn(v, t)
        rating, score = F.when(m == name, r).otherwise(rating), F.when(m == name, s.cast("double")).otherwise(score)
    return df.withColumns({"rating": rating, "score": score})
