"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import driver
from tracelake.request import TraceSearch
from tracelake.sources import otlp_json, otlp_proto
from tracelake.store import TraceStore

#: Requests of the ingest load, of five spans each.
REQUESTS = 60_000

HEADLINE = (
    "trace_search", "trace_search_orders", "trace_search_indexed", "trace_windows", "get_trace", "list_field_values", "log_search", "log_upsert", "jaeger_search_orders", "jaeger_spans", "tempo_search_q",
    "tempo_search_tags", "tempo_summaries", "otlp_export_groups", "flatten_otlp_json", "otlp_proto_round_trip",
)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON and protobuf bodies of the load generator's spans, written before anything is timed."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit("string").alias("kind"), F.lit(v).alias("value")).alias("value"))
    t, start = F.col("id"), lambda i: (F.col("id") * 10 + i) * 100
    one = lambda i: F.struct(
        F.format_string("%032x", t).alias("trace_id"), F.format_string("%016x", t * 5 + i).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("GET /checkout").alias("name"), start(i).alias("start_time_unix_nano"),
        (start(i) + 50).alias("end_time_unix_nano"), F.array(text("http.method", "GET"), text("http.route", "/checkout")).alias("attributes"), F.struct(F.lit(0).alias("code"), F.lit("OK").alias("message")).alias("status"),
    )
    none = F.expr("array()").cast("array<struct<key:string,value:struct<kind:string,value:string>>>")
    scope = F.struct(F.lit("lib").alias("scope_name"), F.lit("1.0").alias("scope_version"), none.alias("scope_attributes"), F.array(*[one(i) for i in range(5)]).alias("spans"))
    r = spark.range(REQUESTS).select(F.array(F.struct(F.array(text("service.name", "checkout")).alias("resource_attributes"), F.array(scope).alias("scope_spans"))).alias("resource_spans"))
    r.select(F.to_json(F.struct("resource_spans")).alias("body")).write.parquet(f"{path}/json")
    otlp_proto.to_trace_bodies(r).write.parquet(f"{path}/proto")
    return spark.read.parquet(f"{path}/json"), spark.read.parquet(f"{path}/proto")


def ingest_rates(spark: SparkSession) -> dict[str, float]:
    """Spans a second from bodies to flat rows, and from protobuf bodies to a store with its index, the best of three runs each."""
    path = tempfile.mkdtemp(prefix="bench-")  # the bench runs on this machine alone
    try:
        bodies, out = load(spark, path), {}
        for name, source, df in zip(("json", "proto"), (otlp_json, otlp_proto), bodies):
            took = []
            for _ in range(3):
                began = time.perf_counter()
                otlp_json.flatten_traces(source.parse_trace_requests(df)).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            out[f"ingest_{name}_spans_per_s"] = round(5 * REQUESTS / min(took))
        took = []
        for i in range(3):
            store = TraceStore(spark, f"{path}/store-{i}", buckets=8)
            began = time.perf_counter()
            store.append_spans(otlp_json.flatten_traces(otlp_proto.parse_trace_requests(bodies[1])))
            took.append(time.perf_counter() - began)
        out["ingest_proto_store_spans_per_s"] = round(5 * REQUESTS / min(took))
        out["store_search_seconds"] = searched(store)
        return out
    finally:
        shutil.rmtree(path, ignore_errors=True)


def searched(store: TraceStore) -> float:
    """Seconds of a limited search over the index of a store."""
    took = []
    for _ in range(3):
        began = time.perf_counter()
        found = store.search(TraceSearch(10_000, 50_000_000, "checkout", "GET /checkout")).collect()
        took.append(time.perf_counter() - began)
        assert len(found) == 20
    return round(min(took), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = driver.queries()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    rates = ingest_rates(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
