"""Structured Streaming ingest of OTLP files, and running state over spans.

Micro-batches stand for batching and back-pressure (files or bytes a trigger), checkpoints for recovery. A batch is
a segment of the store named by query and batch number, so a batch that is run again adds nothing twice, and the
segment brings its part of the trace index along. Late spans are always taken: a trace's window only widens, so
there is no watermark unless one is asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.traces import promoted, services_per_trace
from tracelake.sources import otlp_json, otlp_proto
from tracelake.store import TraceStore


def stream_bodies(spark: SparkSession, path: str, protobuf: bool = False, files_per_trigger: int | None = 256, bytes_per_trigger: str | None = None) -> DataFrame:
    """(body): each new file below path is one request. A trigger takes so many files, or files of so many bytes if these are given."""
    bound = {"maxBytesPerTrigger": bytes_per_trigger} if bytes_per_trigger else {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    if protobuf:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        return spark.readStream.format("binaryFile").schema(schema).options(**bound).load(path).select(F.col("content").alias("body"))
    return spark.readStream.option("wholetext", "true").options(**bound).text(path).select(F.col("value").alias("body"))


def span_stream(bodies: DataFrame, protobuf: bool = False) -> DataFrame:
    source = otlp_proto if protobuf else otlp_json
    return otlp_json.flatten_unchecked(source.parse_trace_requests(bodies))


def log_stream(bodies: DataFrame, protobuf: bool = False) -> DataFrame:
    source = otlp_proto if protobuf else otlp_json
    return otlp_json.flatten_logs(source.parse_log_requests(bodies))


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Name of a batch: the id that the query's checkpoint holds, and the batch number."""
    line = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value
    return f"{json.loads(line)['id']}-{batch_id:012d}"


def write_spans(batch: DataFrame, name: str, store: TraceStore, quarantine: str | None = None) -> None:
    """Add a batch to the store under its name; spans with an invalid range go to the quarantine path, or are dropped without one."""
    batch = batch.persist()  # one pass over the source for both
    try:
        store.append_spans(batch.where(~otlp_json.bad_range()), name)
        if quarantine:
            batch.where(otlp_json.bad_range()).write.mode("overwrite").parquet(f"{quarantine.rstrip('/')}/batch={name}")
    finally:
        batch.unpersist()


def write_logs(batch: DataFrame, name: str, batch_id: int, store: TraceStore) -> None:
    # later batches win over earlier ones, later records over earlier ones of a batch
    seq = F.lit(batch_id).cast("bigint") * F.lit(1 << 50) + F.pmod(F.col("ingest_seq"), F.lit(1 << 50))
    store.append_logs(batch.withColumn("ingest_seq", seq), name)


def ingest_spans(spans: DataFrame, store: TraceStore, checkpoint: str, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Append spans batch by batch, each once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_spans(batch, batch_name(store.spark, checkpoint, batch_id), store, quarantine)

    return spans.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def ingest_logs(logs: DataFrame, store: TraceStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Append logs, each batch once; ids are upserted on read, by latest()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_logs(batch, batch_name(store.spark, checkpoint, batch_id), batch_id, store)

    return logs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def running_windows(spans: DataFrame, watermark: str | None = None) -> DataFrame:
    """Running (trace_id, start_unix_nano, end_unix_nano, spans, services, operations), for output mode update. A watermark bounds the state, at the price of late spans."""
    if watermark:
        spans = spans.withColumn("event_time", F.timestamp_micros(F.expr("end_unix_nano div 1000"))).withWatermark("event_time", watermark)
    spans = promoted(spans)
    return spans.groupBy("trace_id").agg(
        F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"), F.count(F.lit(1)).alias("spans"),
        services_per_trace(spans), F.array_sort(F.collect_set("name")).alias("operations"),
    )
