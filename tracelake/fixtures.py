"""The driver's tables as span and log relations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.schema import KV

#: Tasks that spread() makes for each core, so that the slowest of them is short, and in all where few executors are there yet.
TASKS_A_CORE, MIN_TASKS = 3, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nanos(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores by their keys.

    A row group is read by one task, however large it is, and what a plan makes of its rows before the next shuffle
    stays in that task. Where that is costly, rows are dealt out first, while they are narrow.
    """
    return df.repartition(max(MIN_TASKS, TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism), *keys)


def _padded(prefix: str, c: str, n: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), n, "0"))


def event_spans(spark: SparkSession, sf_dir: str, parents: bool = False) -> DataFrame:
    """A span for each event, a trace for each user; the first event is the parent of the others.

    The parent costs a window by user, so it is there only on request.
    """
    e = _table(spark, sf_dir, "events")
    parent = F.lit(None).cast("string")
    if parents:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = e.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("event_id").over(w))
        parent = F.when(F.col("n") > 1, _padded("span-", "first", 10))
    service = F.when(F.col("event_id") % 4 == 0, "checkout").when(F.col("event_id") % 4 == 1, "payments").when(F.col("event_id") % 4 == 2, "catalog").otherwise("-")
    end = _nanos("ts") + F.round(F.col("value") * 1000000).cast("bigint")
    return e.select(
        _padded("trace-", "user_id", 8).alias("trace_id"), _padded("span-", "event_id", 10).alias("span_id"), parent.alias("parent_span_id"), F.col("event_type").alias("name"), _nanos("ts").alias("start_unix_nano"), end.alias("end_unix_nano"), end.alias("time_unix_nano"),
        F.array(_field("resource_attr:service.name", service), _field("span_attr:k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-"))), _field("status_code", F.when(F.col("event_type") == "error", "2").otherwise("0"))).alias("fields"),
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level traces: an order and its line items."""
    o, item, s = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "supplier")
    text = lambda c: F.col(c).cast("string")

    def row(trace, span, parent, name, start, end, service, attr, code):
        return [trace.alias("trace_id"), span.alias("span_id"), parent.alias("parent_span_id"), name.alias("name"), start.alias("start_unix_nano"), end.alias("end_unix_nano"), end.alias("time_unix_nano"), F.array(_field("resource_attr:service.name", service), _field("span_attr:attr", attr), _field("status_code", code)).alias("fields")]

    roots = o.select(*row(_padded("order-", "o_orderkey", 8), F.concat(F.lit("o-"), text("o_orderkey")), F.lit(None).cast("string"), F.concat(F.lit("order "), "o_orderpriority"), _nanos("o_orderdate"), _nanos("o_orderdate") + 3600000000000, F.lit("orders"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "P", "2").otherwise("0")))
    ids = F.concat_ws("-", F.lit("l"), text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"))
    lines = item.join(s, item["l_suppkey"] == s["s_suppkey"]).select(*row(_padded("order-", "l_orderkey", 8), ids, F.concat(F.lit("o-"), text("l_orderkey")), F.concat(F.lit("ship "), "l_linestatus"), _nanos("l_shipdate"), _nanos("l_shipdate") + F.col("l_quantity").cast("bigint") * 60000000000, F.concat(F.lit("nation-"), text("s_nationkey")), F.col("l_returnflag"), F.when(F.col("l_returnflag") == "R", "2").otherwise("0")))
    return roots.unionByName(lines)


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record for each event."""
    e, kind = _table(spark, sf_dir, "events"), F.col("event_type")
    service = F.when(F.col("event_id") % 4 == 0, "checkout").when(F.col("event_id") % 4 == 1, "payments").when(F.col("event_id") % 4 == 2, "catalog").otherwise("-")
    return e.select(
        F.concat(F.lit("log-"), _nanos("ts").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("log_id"), _nanos("ts").alias("time_unix_nano"), (_nanos("ts") + 1000).alias("observed_time_unix_nano"),
        F.when(kind == "error", 17).when(kind == "signup", 13).otherwise(9).alias("severity_number"), F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity_text"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("body"), F.when(F.col("event_id") % 5 != 0, _padded("trace-", "user_id", 8)).alias("trace_id"), F.lit(None).cast("string").alias("span_id"),
        F.array(_field("resource_attr:service.name", service), _field("log_attr:type", kind)).alias("fields"),
    )


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each turn, the turn before as its parent."""
    c = _table(spark, sf_dir, "conversations")
    start = F.col("conv_id") * 60000000000 + F.col("turn") * 1000000000
    end = start + F.length("text").cast("bigint") * 1000000
    name = lambda t: F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), t.cast("string"))
    return c.select(
        _padded("conv-", "conv_id", 8).alias("trace_id"), name(F.col("turn")).alias("span_id"), F.when(F.col("turn") != 0, name(F.col("turn") - 1)).alias("parent_span_id"), F.col("role").alias("name"),
        start.alias("start_unix_nano"), end.alias("end_unix_nano"), end.alias("time_unix_nano"), F.array(_field("resource_attr:service.name", F.concat(F.lit("agent-"), "role"))).alias("fields"),
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): an OTLP/JSON request for each conversation, to exercise the JSON source."""
    c = conversation_spans(spark, sf_dir)
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit("string").alias("kind"), v.alias("value")).alias("value"))
    span = F.struct("trace_id", "span_id", "parent_span_id", "name", F.col("start_unix_nano").alias("start_time_unix_nano"), F.col("end_unix_nano").alias("end_time_unix_nano"), F.array(text("role", F.col("name"))).alias("attributes"), F.struct(F.lit(0).alias("code"), F.lit("").alias("message")).alias("status"))
    grouped = c.groupBy("trace_id", F.col("fields")[0]["value"].alias("service")).agg(F.collect_list(span).alias("spans"))
    scope = F.struct(F.lit("chat").alias("scope_name"), F.lit("").alias("scope_version"), F.array().cast("array<struct<key:string,value:struct<kind:string,value:string>>>").alias("scope_attributes"), "spans")
    resource = F.struct(F.array(text("service.name", F.col("service"))).alias("resource_attributes"), F.array(scope).alias("scope_spans"))
    return grouped.groupBy("trace_id").agg(F.to_json(F.struct(F.collect_list(resource).alias("resource_spans"))).alias("body")).select("body")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, one of this machine, and no cluster will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or '/tmp/checkpoints/tracelake'}/{name}-{uuid.uuid4().hex}"


def event_log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource_logs): a request for each event; ids of traces are hexadecimal."""
    e, kind = spread(_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", "ts", "user_id"), F.col("event_type")
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit("string").alias("kind"), v.alias("value")).alias("value"))
    service = F.when(F.col("event_id") % 4 == 0, "checkout").when(F.col("event_id") % 4 == 1, "payments").when(F.col("event_id") % 4 == 2, "catalog").otherwise("-")
    record = F.struct(
        _nanos("ts").alias("time_unix_nano"), (_nanos("ts") + 1000).alias("observed_time_unix_nano"), F.when(kind == "error", 17).when(kind == "signup", 13).otherwise(9).alias("severity_number"),
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("severity_text"), F.struct(F.lit("string").alias("kind"), F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("value")).alias("body"),
        F.when(F.col("event_id") % 5 != 0, F.lower(F.lpad(F.hex(F.col("user_id").cast("bigint")), 32, "0"))).alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.array(text("type", kind)).alias("attributes"),
    )
    scope = F.struct(F.lit("events").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"), F.array().cast(f"array<{KV}>").alias("scope_attributes"), F.array(record).alias("log_records"))
    return e.select(F.array(F.struct(F.array(text("service.name", service)).alias("resource_attributes"), F.array(scope).alias("scope_logs"))).alias("resource_logs"))
