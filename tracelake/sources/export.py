"""Rows back to nested requests and JSON responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.fields import sort_fields
from tracelake.schema import LOG_COLUMNS, LOG_KIND, LOG_PSEUDO, RESOURCE, SCOPE, SCOPE_NAME, SCOPE_VERSION, SPAN, SPAN_COLUMNS, STATUS_CODE, STATUS_MESSAGE


def _by_prefix(prefix: str) -> Column:
    """Key-value attributes of the fields with the prefix, by key; equal keys in their order."""
    own = F.filter("fields", lambda f: f["name"].startswith(prefix))
    keyed = F.transform(own, lambda f, i: F.struct(F.substring(f["name"], F.lit(len(prefix) + 1), F.length(f["name"])).alias("key"), i.alias("i"), f["value"].alias("v")))
    return F.transform(F.sort_array(keyed), lambda f: F.struct(f["key"].alias("key"), F.struct(F.lit("string").alias("kind"), f["v"].alias("value")).alias("value")))


def _last(name: str, keep_dash: bool = False) -> Column:
    own = F.filter("fields", lambda f: (f["name"] == name) & (F.lit(keep_dash) | (f["value"] != "-")))
    return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])


def export_parts(spans: DataFrame) -> DataFrame:
    """Per span, what groups it (resource, scope) and its record; all values are texts, `-` names and messages are left out."""
    code = _last(STATUS_CODE, keep_dash=True)
    code = F.when(code.rlike(r"^[+-]?\d+$"), code.try_cast("int"))
    status = F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce(_last(STATUS_MESSAGE), F.lit("")).alias("message")))
    record = F.struct(
        "trace_id", "span_id", "parent_span_id", "name", F.col("start_unix_nano").alias("start_time_unix_nano"), F.col("end_unix_nano").alias("end_time_unix_nano"),
        _by_prefix(SPAN).alias("attributes"), status.alias("status"),
    )
    group = F.struct(_by_prefix(RESOURCE).alias("resource_attributes"), _last(SCOPE_NAME).alias("scope_name"), _last(SCOPE_VERSION).alias("scope_version"), _by_prefix(SCOPE).alias("scope_attributes"))
    return spans.select("trace_id", "end_unix_nano", group.alias("g"), F.to_json(group).alias("group_key"), record.alias("span"))


def export_requests(spans: DataFrame) -> DataFrame:
    """(trace_id, resource_spans): one request a trace, a resource for each distinct resource and scope, groups by their JSON key, spans by end."""
    x = export_parts(spans)
    groups = x.groupBy("trace_id", "group_key").agg(F.first("g").alias("g"), F.sort_array(F.collect_list(F.struct("end_unix_nano", F.col("span.span_id").alias("id"), "span"))).alias("s"))
    scope = F.struct(F.col("g.scope_name").alias("scope_name"), F.col("g.scope_version").alias("scope_version"), F.col("g.scope_attributes").alias("scope_attributes"), F.transform("s", lambda y: y["span"]).alias("spans"))
    one = F.struct("group_key", F.struct(F.col("g.resource_attributes").alias("resource_attributes"), F.array(scope).alias("scope_spans")).alias("r"))
    return groups.groupBy("trace_id").agg(F.sort_array(F.collect_list(one)).alias("all")).select("trace_id", F.transform("all", lambda y: y["r"]).alias("resource_spans"))


def field_map(fields: str | Column = "fields") -> Column:
    """Fields as a map for responses: the last of equal names wins."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    n = F.size(fields)
    last = F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda g: g["name"] == f["name"]))
    return F.map_from_entries(last)


def trace_json(spans: DataFrame) -> DataFrame:
    """(trace_id, json): the native response object of each span."""
    return spans.select("trace_id", F.to_json(F.struct(*[c for c in SPAN_COLUMNS if c != "fields"], field_map().alias("fields")), {"ignoreNullFields": "false"}).alias("json"))


def hit_json(hits: DataFrame) -> DataFrame:
    """(trace_id, json): the native response object of each search hit."""
    return hits.select("trace_id", F.to_json(F.struct("trace_id", "start_unix_nano", "end_unix_nano", "services"), {"ignoreNullFields": "false"}).alias("json"))


def log_json(logs: DataFrame) -> DataFrame:
    """(log_id, json): the native response object of each log record."""
    return logs.select("log_id", F.to_json(F.struct(*[c for c in LOG_COLUMNS if c != "fields"], field_map().alias("fields")), {"ignoreNullFields": "false"}).alias("json"))


def log_to_span(logs: DataFrame) -> DataFrame:
    """Logs in the shape of spans: pseudo-fields carry what spans have no column for."""
    def one(name: str, value: Column) -> Column:
        some = F.array(F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))
        return F.when(value.isNotNull(), some).otherwise(F.expr("array()").cast("array<struct<name:string,value:string>>"))

    extra = [one(LOG_KIND[0], F.lit(LOG_KIND[1])), *[one(k, F.col(c)) for k, c in LOG_PSEUDO.items()]]
    return logs.select(
        F.col("log_id").alias("trace_id"), F.col("log_id").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.coalesce("severity_text", F.lit("log")).alias("name"),
        F.col("time_unix_nano").alias("start_unix_nano"), F.col("time_unix_nano").alias("end_unix_nano"), "time_unix_nano", sort_fields(F.concat("fields", *extra)).alias("fields"),
    )


def span_to_log(spans: DataFrame) -> DataFrame:
    """The logs among spans that log_to_span() made; other spans are left out."""
    from tracelake.functions.fields import first_value

    kinds = {"observed_time_unix_nano": "bigint", "severity_number": "int"}
    own = [first_value(k).try_cast(kinds.get(c, "string")).alias(c) for k, c in LOG_PSEUDO.items()]
    pseudo = [LOG_KIND[0], *LOG_PSEUDO]
    rows = spans.where(first_value(LOG_KIND[0]) == LOG_KIND[1])
    return rows.select("time_unix_nano", *own, F.filter("fields", lambda f: ~f["name"].isin(*pseudo)).alias("fields")).select("log_id", "time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text", "body", "trace_id", "span_id", "fields")
