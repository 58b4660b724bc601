"""Store statistics as Prometheus text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "tracelake_"


def exposition(stats: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(place, line) of a one-row table of numbers: a type line and a value line a column; names that end in _total are counters, others gauges."""
    lines = []
    for c in stats.columns:
        lines += [F.lit(f"# TYPE {prefix}{c} {'counter' if c.endswith('_total') else 'gauge'}"), F.concat(F.lit(f"{prefix}{c} "), F.col(c).cast("string"))]
    return stats.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def text(stats: DataFrame, prefix: str = PREFIX) -> str:
    """The whole page."""
    return "".join(r.line + "\n" for r in exposition(stats, prefix).orderBy("place").collect())


def store_stats(spans: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One row: spans, traces and services, log records and log ids."""
    per = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("span_rows_total"), F.count(F.lit(1)).alias("traces"))
    if logs is not None:
        by_id = logs.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("log_rows_total"), F.count(F.lit(1)).alias("log_ids"))
        out = out.crossJoin(by_id)  # one row each
    return out
