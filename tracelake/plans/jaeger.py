"""Jaeger-style answers: same-row search and the nested trace view."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.fields import first_value
from tracelake.operators.traces import limited, list_services, matching_traces, operations_of
from tracelake.request import MAX_JAEGER_LIMIT, TraceSearch
from tracelake.schema import RESERVED, RESOURCE, SERVICE, SPAN


def services(spans: DataFrame) -> DataFrame:
    return list_services(spans)


def operations(spans: DataFrame, service: str) -> DataFrame:
    return operations_of(spans, service)


def search(spans: DataFrame, req: TraceSearch) -> DataFrame:
    """(trace_id, start_unix_nano, end_unix_nano): traces that hold service and operation on one span, newest first."""
    return limited(matching_traces(spans, req, same_row=True), req.limit, F.desc("end_unix_nano"), F.asc("trace_id"))


def _tags(kept: Column, cut: str) -> Column:
    named = F.transform(kept, lambda f: F.struct(F.when(f["name"].startswith(cut), F.substring(f["name"], F.lit(len(cut) + 1), F.length(f["name"]))).otherwise(f["name"]).alias("key"), F.lit("string").alias("type"), f["value"].alias("value")))
    return F.sort_array(F.array_distinct(F.filter(named, lambda t: t["key"] != "")))


def process_tags() -> Column:
    """Resource attributes but the service name, as a sorted set."""
    return _tags(F.filter("fields", lambda f: f["name"].startswith(RESOURCE) & (f["name"] != SERVICE)), RESOURCE)


def span_tags() -> Column:
    """All other fields but the virtual names, as a sorted set; the span prefix is cut off."""
    return _tags(F.filter("fields", lambda f: ~f["name"].startswith(RESOURCE) & ~f["name"].isin(*RESERVED)), SPAN)


def _service() -> Column:
    return F.coalesce(first_value(SERVICE), F.lit("-")).alias("service")


def _numbered(spans: DataFrame, *tags: Column) -> DataFrame:
    """(trace_id, process_id, service, ...): services numbered p1, p2, ... as their first rows appear by end."""
    tie = "ingest_seq" if "ingest_seq" in spans.columns else "span_id"
    named = spans.select("trace_id", _service(), "end_unix_nano", tie, *tags)
    more = [F.sort_array(F.array_distinct(F.flatten(F.collect_set("t")))).alias("tags")] if tags else []
    per = named.groupBy("trace_id", "service").agg(F.min(F.struct("end_unix_nano", tie)).alias("first"), *more)
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("first", "service"))
    return per.select("trace_id", F.concat(F.lit("p"), number.cast("string")).alias("process_id"), "service", *(["tags"] if tags else []))


def processes(spans: DataFrame) -> DataFrame:
    """(trace_id, process_id, service, tags): the union of the tags of a process's spans."""
    return _numbered(spans, process_tags().alias("t"))


def span_rows(spans: DataFrame) -> DataFrame:
    """A row for each span: process, microsecond times, reference to the parent, tags.

    Numbers come from the few rows of a trace's services; the spans are joined to them by hash, unsorted, and a large
    trace can be split.
    """
    parent = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_span_id").alias("spanID"), F.col("trace_id").alias("traceID"))
    none = F.expr("array()").cast("array<struct<refType:string,spanID:string,traceID:string>>")
    named = spans.withColumn("service", _service())
    return named.join(_numbered(spans).hint("shuffle_hash"), ["trace_id", "service"]).select(
        "trace_id", "span_id", F.col("name").alias("operation_name"), "process_id",
        F.expr("start_unix_nano div 1000").alias("start_time"), F.expr("(end_unix_nano - start_unix_nano) div 1000").alias("duration"),
        F.when(F.col("parent_span_id").isNotNull(), F.array(parent)).otherwise(none).alias("references"), span_tags().alias("tags"), F.col("end_unix_nano"),
    )


def trace_view(spans: DataFrame) -> DataFrame:
    """(trace_id, processes, spans): the nested view of each trace, spans by end."""
    s = F.struct("end_unix_nano", "span_id", F.struct(F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("operation_name").alias("operationName"), F.col("process_id").alias("processID"), F.col("start_time").alias("startTime"), "duration", "references", "tags").alias("s"))
    per_span = span_rows(spans).groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list(s)), lambda x: x["s"]).alias("spans"))
    per_process = processes(spans).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("process_id", F.struct(F.col("service").alias("serviceName"), "tags")))).alias("processes"))
    return per_process.join(per_span, "trace_id")


def response(data: DataFrame, column: str, limit: int = MAX_JAEGER_LIMIT) -> DataFrame:
    """One row: the JSON envelope around the first `limit` values of an answer, in order."""
    listed = data.select(column).orderBy(column).limit(limit).agg(F.array_sort(F.collect_list(column)).alias("data"))
    body = F.struct("data", F.lit(None).cast("string").alias("errors"), F.lit(0).alias("limit"), F.lit(0).alias("offset"), F.size("data").alias("total"))
    return listed.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def trace_response(views: DataFrame, limit: int = MAX_JAEGER_LIMIT) -> DataFrame:
    """One row: the JSON envelope around at most `limit` trace views (trace_id, processes, spans), by id; not_found()'s if there is none."""
    one = F.struct("trace_id", F.to_json(F.struct(F.col("trace_id").alias("traceID"), "spans", "processes")).alias("v"))
    listed = views.orderBy("trace_id").limit(limit).agg(F.array_sort(F.collect_list(one)).alias("all"))
    body = F.concat(F.lit('{"data":['), F.array_join(F.transform("all", lambda x: x["v"]), ","), F.lit('],"errors":null,"limit":0,"offset":0,"total":'), F.size("all").cast("string"), F.lit("}"))
    return listed.select(F.when(F.size("all") > 0, body).otherwise(json.dumps(not_found(), separators=(",", ":"))).alias("json"))


def not_found() -> dict:
    """The envelope for a trace that isn't there."""
    return {"data": [], "errors": [{"code": 404, "msg": "trace not found"}], "limit": 0, "offset": 0, "total": 0}
