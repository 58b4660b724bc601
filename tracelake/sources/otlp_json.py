"""OTLP/JSON requests to span and log rows, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.fields import canonical_span_id, flat_value, log_id, normalize, optional_field, prefixed
from tracelake.schema import LOG, LOG_COLUMNS, RESOURCE, RESOURCE_LOGS, RESOURCE_SPANS, SCOPE, SCOPE_NAME, SCOPE_VERSION, SPAN, SPAN_COLUMNS, STATUS_CODE, STATUS_MESSAGE


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(body): one request a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def parse_trace_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(resource_spans) of JSON texts; a text that is no request fails the job."""
    return bodies.select(F.from_json(body, f"resource_spans {RESOURCE_SPANS}", {"mode": "FAILFAST"}).alias("r")).select("r.resource_spans")


def parse_log_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(resource_logs) of JSON texts."""
    return bodies.select(F.from_json(body, f"resource_logs {RESOURCE_LOGS}", {"mode": "FAILFAST"}).alias("r")).select("r.resource_logs")


def _scopes(requests: DataFrame, resources: str, group: str, items: str) -> DataFrame:
    """(ri, si, shared, items) of each scope. What its records share is made once, and none of them carries the others along."""
    # outer, as an inner one is given a filter over its array, for which a request's JSON would be parsed once more
    r = requests.select(F.posexplode_outer(resources).alias("ri", "r")).where("ri is not null")
    r = r.select("ri", prefixed(F.col("r")["resource_attributes"], RESOURCE).alias("own"), F.col("r")[group].alias("scopes"))
    s = F.col("s")
    shared = F.concat("own", optional_field(SCOPE_NAME, s["scope_name"]), optional_field(SCOPE_VERSION, s["scope_version"]), prefixed(s["scope_attributes"], SCOPE))
    return r.select("ri", "own", F.posexplode("scopes").alias("si", "s")).select("ri", "si", shared.alias("shared"), s[items].alias("items"))


def flatten_unchecked(requests: DataFrame) -> DataFrame:
    """Span rows of (resource_spans), with ingest_seq: the place within the request. Spans may end before they begin."""
    x = _scopes(requests, "resource_spans", "scope_spans", "spans").select("ri", "si", "shared", F.posexplode("items").alias("i", "x"))
    status = F.when(
        F.col("x")["status"].isNotNull(),
        F.concat(optional_field(STATUS_CODE, F.coalesce(F.col("x")["status"]["code"], F.lit(0)).cast("string")), optional_field(STATUS_MESSAGE, F.coalesce(F.col("x")["status"]["message"], F.lit("")))),
    ).otherwise(F.expr("array()").cast("array<struct<name:string,value:string>>"))
    end = F.col("x")["end_time_unix_nano"]
    return x.select(
        F.col("x")["trace_id"].alias("trace_id"), canonical_span_id(F.col("x")["span_id"]).alias("span_id"), canonical_span_id(F.col("x")["parent_span_id"]).alias("parent_span_id"), F.col("x")["name"].alias("name"),
        F.col("x")["start_time_unix_nano"].alias("start_unix_nano"), end.alias("end_unix_nano"), end.alias("time_unix_nano"),
        # every name has a prefix or is one of the scope's or status's, so none is a reserved one that strip_reserved() would take
        F.concat("shared", prefixed(F.col("x")["attributes"], SPAN), status).alias("fields"),
        (F.shiftleft(F.col("ri").cast("bigint"), 42) + F.shiftleft(F.col("si").cast("bigint"), 24) + F.col("i")).alias("ingest_seq"),
    )


def bad_range() -> Column:
    return F.col("end_unix_nano") < F.col("start_unix_nano")


def flatten_traces(requests: DataFrame) -> DataFrame:
    """Span rows; a span that ends before it begins fails the job, as its request is refused."""
    rows = flatten_unchecked(requests)
    checked = F.when(bad_range(), F.raise_error(F.concat(F.lit("invalid time range: "), F.col("start_unix_nano"), F.lit(" > "), F.col("end_unix_nano"))).cast("bigint")).otherwise(F.col("end_unix_nano"))
    return rows.withColumn("end_unix_nano", checked).select(*SPAN_COLUMNS, "ingest_seq")


def flatten_traces_lenient(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with an invalid time range)."""
    rows = flatten_unchecked(requests)
    return rows.where(~bad_range()), rows.where(bad_range())


def flatten_logs(requests: DataFrame) -> DataFrame:
    """Log rows of (resource_logs); the id keeps the record's place in its request."""
    x = _scopes(requests, "resource_logs", "scope_logs", "log_records").select("ri", "si", "shared", F.posexplode("items").alias("i", "x"))
    rec = F.col("x")
    body = normalize(F.coalesce(flat_value(rec["body"]), F.lit("")))
    rows = x.select(
        log_id(F.col("ri"), F.col("si"), F.col("i"), rec["time_unix_nano"], body, rec["trace_id"], rec["span_id"]).alias("log_id"), rec["time_unix_nano"].alias("time_unix_nano"), rec["observed_time_unix_nano"].alias("observed_time_unix_nano"),
        rec["severity_number"].alias("severity_number"), normalize(rec["severity_text"]).alias("severity_text"), body.alias("body"), rec["trace_id"].alias("trace_id"), rec["span_id"].alias("span_id"),
        F.concat("shared", prefixed(rec["attributes"], LOG)).alias("fields"),
        (F.shiftleft(F.col("ri").cast("bigint"), 42) + F.shiftleft(F.col("si").cast("bigint"), 24) + F.col("i")).alias("ingest_seq"),
    )
    return rows.select(*LOG_COLUMNS, "ingest_seq")
