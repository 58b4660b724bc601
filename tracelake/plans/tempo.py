"""Tempo-style answers: TraceQL subset or substring tags, trace summaries, and the tag catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.fields import ascii_lower, first_value, span_value
from tracelake.operators.traces import limited, list_field_names, list_field_values, matching_traces
from tracelake.request import TempoSearch, tag_to_field
from tracelake.schema import RESOURCE, SERVICE, SPAN, STATUS_CODE, STATUS_MESSAGE


def _root() -> Column:
    """The first span without a parent by start, else the first span; ties by end and id."""
    return F.min(F.struct(F.col("parent_span_id").isNotNull().alias("child"), F.col("start_unix_nano").alias("s"), F.col("end_unix_nano").alias("e"), F.col("span_id").alias("i"), F.coalesce(first_value(SERVICE), F.lit("-")).alias("service"), F.col("name").alias("name"))).alias("root")


def _substring(name: str, expected: str) -> Column:
    return F.contains(ascii_lower(span_value(name)), ascii_lower(F.lit(expected)))


def _summary(found: DataFrame) -> DataFrame:
    return found.select(
        "trace_id", F.col("root.service").alias("root_service_name"), F.col("root.name").alias("root_trace_name"), F.col("start_unix_nano").cast("string").alias("start_time_unix_nano"),
        F.expr("greatest(end_unix_nano - start_unix_nano, 0L) div 1000000").alias("duration_ms"),
    )


def search(spans: DataFrame, req: TempoSearch) -> DataFrame:
    """(trace_id, root_service_name, root_trace_name, start_time_unix_nano, duration_ms), newest end first.

    One aggregate answers everything: search predicates, substrings (each on any span) and the summary.
    """
    extra = [_substring(n, v) for n, v in req.substrings]
    found = matching_traces(spans, req.search, extra=extra, aggregates=[_root()])
    return _summary(limited(found, req.limit, F.desc("end_unix_nano"), F.asc("trace_id")))


def search_body(found: DataFrame) -> DataFrame:
    """(json): one row, the answer to a search as Tempo clients read it, newest first. found must come from a limited search."""
    one = F.struct(F.col("trace_id").alias("traceID"), F.col("root_service_name").alias("rootServiceName"), F.col("root_trace_name").alias("rootTraceName"), F.col("start_time_unix_nano").alias("startTimeUnixNano"), F.col("duration_ms").alias("durationMs"))
    placed = found.select(F.monotonically_increasing_id().alias("i"), one.alias("t"))
    listed = placed.agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("all"))
    return listed.select(F.to_json(F.struct(F.transform("all", lambda x: x["t"]).alias("traces"))).alias("json"))


def trace_body(requests: DataFrame) -> DataFrame:
    """(status, json): one row for a look-up's (trace_id, resource_spans): 200 and the request, or 404 and null if there is none."""
    one = requests.agg(F.first("resource_spans").alias("resource_spans"))
    found = F.col("resource_spans").isNotNull()
    return one.select(F.when(found, 200).otherwise(404).alias("status"), F.when(found, F.to_json(F.struct("resource_spans"))).alias("json"))


def summaries(spans: DataFrame) -> DataFrame:
    """The summary of every trace."""
    return _summary(spans.groupBy("trace_id").agg(F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"), _root()))


def _scoped(names: DataFrame) -> DataFrame:
    """(scope, tag) of field names; names of other scopes are hidden."""
    n = F.col("name")
    fixed = {"name": "name", "duration": "trace:duration", STATUS_CODE: "statusCode", STATUS_MESSAGE: "statusMessage"}
    intrinsic = F.coalesce(*[F.when(n == k, v) for k, v in fixed.items()])
    cut = lambda p: F.substring(n, F.lit(len(p) + 1), F.length(n))
    scope = F.when(n.startswith(RESOURCE), "resource").when(n.startswith(SPAN), "span").when(intrinsic.isNotNull(), "intrinsic")
    tag = F.when(n.startswith(RESOURCE), cut(RESOURCE)).when(n.startswith(SPAN), cut(SPAN)).otherwise(intrinsic)
    return names.select(scope.alias("scope"), tag.alias("tag")).where("scope is not null").distinct()


def tags(spans: DataFrame, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """(tag), distinct over the asked scope (all by default)."""
    found = _scoped(list_field_names(spans))
    if scope not in (None, "all"):
        found = found.where(F.col("scope") == scope)
    return limited(found.select("tag").distinct(), limit, F.asc("tag"))


def tag_scopes(spans: DataFrame, limit: int | None = None) -> DataFrame:
    """(scope, tags): the sorted tags of each scope, at most limit of each."""
    listed = F.array_sort(F.collect_set("tag"))
    return _scoped(list_field_names(spans)).groupBy("scope").agg((listed if limit is None else F.slice(listed, 1, max(limit, 0))).alias("tags"))


def tag_values(spans: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    """(value) of a tag, distinct."""
    return limited(list_field_values(spans, tag_to_field(tag)), limit, F.asc("value"))


def typed_tag_values(spans: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    return tag_values(spans, tag, limit).select(F.lit("string").alias("type"), "value")
