"""Log queries: latest row of each log id, inclusive time range, equality filters, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.fields import has_field, services_of
from tracelake.operators.traces import limited
from tracelake.request import FieldFilter, LogSearch
from tracelake.schema import LOG_COLUMNS, LOG_PSEUDO


def latest(logs: DataFrame) -> DataFrame:
    """One row a log id: the one ingested last (column ingest_seq); ties by content."""
    rest = [c for c in logs.columns if c not in ("log_id", "ingest_seq")]
    return logs.groupBy("log_id").agg(F.max(F.struct("ingest_seq", *rest)).alias("r")).select("log_id", "r.*").select(*logs.columns)


def _matches(f: FieldFilter) -> Column:
    if f.name in LOG_PSEUDO:
        return F.col(LOG_PSEUDO[f.name]).cast("string") == f.value
    return has_field(f.name, f.value)


def search_logs(logs: DataFrame, req: LogSearch) -> DataFrame:
    """Log rows, newest first, then log id. Filters see the row as given: pass latest(logs) where ids repeat."""
    rows = logs.where(F.col("time_unix_nano").between(req.start_unix_nano, req.end_unix_nano))
    for asked, found in ((req.service_name, None), (req.severity_text, F.col("severity_text"))):
        if asked is None:
            continue
        if asked in ("", "-"):
            rows = rows.where("false")
        else:
            rows = rows.where(F.array_contains(services_of(), asked) if found is None else found == asked)
    for f in req.field_filters:
        rows = rows.where(_matches(f))
    return limited(rows, req.limit, F.desc("time_unix_nano"), F.asc("log_id"))


def merge_first(parts: list[DataFrame]) -> DataFrame:
    """Rows of several stores; of equal log ids the one of the first store stays."""
    out = None
    for i, p in enumerate(parts):
        q = p.select(*LOG_COLUMNS).withColumn("store", F.lit(i))
        out = q if out is None else out.unionByName(q)
    return out.groupBy("log_id").agg(F.min(F.struct("store", *[c for c in LOG_COLUMNS if c != "log_id"])).alias("r")).select("log_id", "r.*").select(*LOG_COLUMNS)
