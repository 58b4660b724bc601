"""More registered queries: sources, store, streams, responses and upkeep, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import driver as D
from tracelake import fixtures as X
from tracelake.functions.fields import field_map_text, flat_value, log_id, strip_reserved, unix_millis
from tracelake.functions.placement import placements as place
from tracelake.functions.placement import shard
from tracelake.operators import logs as L
from tracelake.operators import metrics as M
from tracelake.operators import traces as T
from tracelake.plans import jaeger, tempo
from tracelake.request import jaeger_search, native_search, tempo_search
from tracelake.schema import RESERVED
from tracelake.sources import export, otlp_json, otlp_proto
from tracelake.store import TraceStore
from tracelake.streaming import ingest

NODES, WEIGHTS, GROUPS = ["node-a", "node-b", "node-c", "node-d"], {"node-a": 2}, {"node-a": "east", "node-b": "east", "node-c": "west"}


def log_ids(spark: SparkSession, d: str) -> DataFrame:
    logs = X.event_logs(spark, d)
    zero = F.lit(0)
    return logs.select(F.col("log_id").alias("event"), log_id(zero, zero, zero, F.col("time_unix_nano"), F.col("body"), F.col("trace_id"), F.col("span_id")).alias("log_id"))


def _flat_logs(requests: DataFrame) -> DataFrame:
    rows = otlp_json.flatten_logs(requests)
    return rows.select("log_id", "time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text", "body", "trace_id", field_map_text().alias("fields"))


def flatten_otlp_logs(spark, d):
    """Logs as JSON requests, flattened."""
    return _flat_logs(otlp_json.parse_log_requests(X.event_log_requests(spark, d).select(F.to_json(F.struct("resource_logs")).alias("body"))))


def otlp_log_proto_round_trip(spark, d):
    """Logs to protobuf, back and flattened."""
    return _flat_logs(otlp_proto.parse_log_requests(otlp_proto.to_log_bodies(X.event_log_requests(spark, d))))


def grpc_frames(spark, d):
    """Logs as protobuf messages in unary gRPC frames."""
    bodies = otlp_proto.to_log_bodies(X.event_log_requests(spark, d))
    framed = bodies.select(F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.octet_length("body").cast("bigint")), 8, "0")), "body").alias("frame"))
    rows = _flat_logs(otlp_proto.parse_log_requests(framed.select(otlp_proto.unframe_grpc(F.col("frame")).alias("body"))))
    return rows.groupBy("severity_text", "trace_id").agg(F.count(F.lit(1)).alias("records"))


def _store(spark, d, parents: bool = False) -> TraceStore:
    """A new store with the spans of the events in two segments that share traces."""
    store, spans = TraceStore(spark, X.scratch(spark, "store"), buckets=8), X.event_spans(spark, d, parents)
    early = F.pmod(F.xxhash64("span_id"), F.lit(2)) == 0
    store.append_spans(spans.where(early))
    store.append_spans(spans.where(~early))
    return store


def store_search(spark, d):
    """The flagship search over the indexes of two segments."""
    return D._services(_store(spark, d).search(D.FLAGSHIP))


def store_compacted_search(spark, d):
    """The same after compaction: a filter over whole index rows."""
    store = _store(spark, d)
    store.compact()
    store.vacuum()
    return D._services(store.search(D.FLAGSHIP))


def store_trace(spark, d):
    """One trace from its bucket."""
    found = _store(spark, d, parents=True).trace("trace-00000007")
    return found.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "end_unix_nano", (F.col("end_unix_nano") - F.col("start_unix_nano")).alias("duration"), field_map_text().alias("fields"))


def store_logs(spark, d):
    """Logs in two segments, the second an upsert of the first; a repeated append of it does nothing."""
    store, logs = TraceStore(spark, X.scratch(spark, "store")), X.event_logs(spark, d)
    again = logs.where("severity_number > 9").withColumns({"ingest_seq": F.lit(2).cast("bigint"), "body": F.concat(F.lit("again: "), "body")})
    store.append_logs(logs.withColumn("ingest_seq", F.lit(1).cast("bigint")), "first")
    for _ in range(2):
        store.append_logs(again, "second")
    return D._plain_logs(L.latest(store.logs().drop("day")).drop("ingest_seq"))


def stream_ingest(spark, d):
    """Conversations as request files, streamed into a store; its index has every trace's window."""
    inbox, check = X.scratch(spark, "inbox"), X.scratch(spark, "stream")
    merged = X.conversation_requests(spark, d).select(F.from_json("body", "resource_spans array<string>").alias("r"), F.pmod(F.xxhash64("body"), F.lit(12)).alias("file"))
    whole = merged.groupBy("file").agg(F.flatten(F.collect_list("r.resource_spans")).alias("all"))
    whole.select(F.concat(F.lit('{"resource_spans":['), F.array_join("all", ","), F.lit("]}")).alias("value")).repartition(12).write.option("maxRecordsPerFile", 1).text(inbox)
    store = TraceStore(spark, X.scratch(spark, "store"), buckets=4)
    spans = ingest.span_stream(ingest.stream_bodies(spark, inbox, files_per_trigger=5))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_spans(spans, store, check).awaitTermination()
    return T.trace_windows(store.index())


def stream_running_windows(spark, d):
    """The running state over a stream of the events' spans, after its last batch."""
    inbox, name = X.scratch(spark, "inbox"), f"w{uuid.uuid4().hex}"
    spans = X.event_spans(spark, d)
    spans.repartition(6).write.parquet(inbox)
    stream = ingest.running_windows(spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 2).parquet(inbox))
    stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", X.scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumns({"services": F.array_join("services", ","), "operations": F.array_join("operations", ",")})


def sharded_decode(spark, d):
    """Protobuf logs decoded and dealt to shards by trace: no record is lost and no trace is split."""
    rows = _flat_logs(otlp_proto.parse_log_requests(otlp_proto.to_log_bodies(X.event_log_requests(spark, d)))).where("trace_id is not null")
    per = rows.withColumn("shard", shard(F.col("trace_id"), 16)).repartition("shard").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("s"))
    return per.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("traces"), F.count_if(F.col("s") > 1).alias("split"))


def jaeger_trace_views(spark, d):
    """Nested views of the traces that a search finds: processes with their services, spans in order."""
    spans = X.order_spans(spark, d)
    hits = jaeger.search(spans, jaeger_search("nation-7", limit=200)).select("trace_id")
    views = jaeger.trace_view(spans.join(F.broadcast(hits), "trace_id", "left_semi"))
    named = F.transform(F.array_sort(F.map_entries("processes")), lambda p: F.concat(p["key"], F.lit("="), p["value"]["serviceName"]))
    told = F.transform("spans", lambda s: F.concat(s["spanID"], F.lit("@"), s["processID"]))
    return views.select("trace_id", F.array_join(named, ",").alias("processes"), F.array_join(told, ",").alias("spans"))


def jaeger_process_tags(spark, d):
    """The tags of a process are the union over its spans."""
    zone = F.struct(F.lit("resource_attr:zone").alias("name"), F.concat(F.lit("z"), (F.substring("span_id", 6, 10).cast("bigint") % 3).cast("string")).alias("value"))
    rows = jaeger.processes(X.event_spans(spark, d).withColumn("fields", F.concat("fields", F.array(zone))))
    return rows.select("trace_id", "process_id", "service", F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",").alias("tags"))


def jaeger_services_body(spark, d):
    return jaeger.response(jaeger.services(X.order_spans(spark, d)), "service")


def jaeger_trace_body(spark, d):
    """Envelopes of a trace that is there and of one that is not: whether they have errors, and their totals."""
    spans = X.order_spans(spark, d)
    bodies = [jaeger.trace_response(jaeger.trace_view(spans.where(F.col("trace_id") == t))).withColumn("trace", F.lit(t)) for t in ("order-00000007", "nowhere")]
    kind = "data array<struct<traceID:string,spans:array<struct<spanID:string>>>>, errors array<struct<code:int>>, total int"
    read = bodies[0].unionByName(bodies[1]).select("trace", F.from_json("json", kind).alias("b"))
    return read.select("trace", F.get("b.errors.code", F.lit(0)).alias("code"), "b.total", F.array_join(F.flatten(F.transform("b.data", lambda v: v["spans"]["spanID"])), ",").alias("spans"))


def tempo_search_body(spark, d):
    return tempo.search_body(tempo.search(X.event_spans(spark, d, parents=True), tempo_search('{resource.service.name="checkout" && status="2"}', limit=20)))


def tempo_trace_body(spark, d):
    """Look-ups of a trace that is there and of one that is not."""
    spans = X.order_spans(spark, d)
    bodies = [tempo.trace_body(export.export_requests(spans.where(F.col("trace_id") == t))).withColumn("trace", F.lit(t)) for t in ("order-00000007", "nowhere")]
    kind = "resource_spans array<struct<resource_attributes:array<struct<value:struct<value:string>>>,scope_spans:array<struct<spans:array<struct<span_id:string>>>>>>"
    read = bodies[0].unionByName(bodies[1]).select("trace", "status", F.explode_outer(F.from_json("json", kind)["resource_spans"]).alias("r"))
    return read.select("trace", "status", F.col("r.resource_attributes")[0]["value"]["value"].alias("service"), F.array_join(F.transform(F.col("r.scope_spans")[0]["spans"], lambda s: s["span_id"]), ",").alias("spans"))


def native_trace_json(spark, d):
    return export.trace_json(X.event_spans(spark, d)).withColumnRenamed("trace_id", "id")


def native_hit_json(spark, d):
    return export.hit_json(T.search_traces(X.event_spans(spark, d), D.FLAGSHIP))


def native_log_json(spark, d):
    return export.log_json(X.event_logs(spark, d))


def native_request(spark, d):
    """A request as clients send it: texts of field filters, nanoseconds."""
    req = native_search(D.LO, D.HI, "checkout", field_filter=[" span_attr:k = 69 ", "status_code=2"], limit=30)
    return D._services(T.search_traces(X.event_spans(spark, d), req))


def metrics_page(spark, d):
    return M.exposition(M.store_stats(X.event_spans(spark, d), X.event_logs(spark, d)))


def stringified_values(spark, d):
    """Tagged values of every kind as texts."""
    e = X._table(spark, d, "events")
    tagged = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    return e.select(
        "event_id", flat_value(tagged("f64", F.col("value"))).alias("f64"), flat_value(tagged("i64", -F.col("event_id"))).alias("i64"), flat_value(tagged("bool", F.col("event_id") % 2 == 0)).alias("bool"),
        flat_value(tagged("string", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))).alias("string"),
    )


def reserved_names(spark, d):
    """Attributes with the names of columns are left out."""
    extra = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("x").alias("value")) for n in (*RESERVED, "kept")])
    spans = X.event_spans(spark, d)
    return spans.select("span_id", field_map_text(strip_reserved(F.concat(extra, "fields"))).alias("fields"))


def invalid_ranges(spark, d):
    """Requests in which some spans end before they begin: the good ones and the others."""
    e = X._table(spark, d, "events")
    start = F.col("event_id") * 1000
    end = start + F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id") % 5)
    none = F.array().cast(f"array<{X.KV}>")
    span = F.struct(F.lit("t").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("event_type").alias("name"), start.alias("start_time_unix_nano"), end.alias("end_time_unix_nano"), none.alias("attributes"), F.lit(None).cast("struct<code:int,message:string>").alias("status"))
    scope = F.struct(F.lit(None).cast("string").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"), none.alias("scope_attributes"), F.array(span).alias("spans"))
    good, bad = otlp_json.flatten_traces_lenient(e.select(F.array(F.struct(none.alias("resource_attributes"), F.array(scope).alias("scope_spans"))).alias("resource_spans")))
    both = good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return both.groupBy("name", "good").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end_unix_nano") - F.col("start_unix_nano")).alias("nanos"))


def sorted_lists(spark, d):
    """Lists come in byte order, at most as many as asked for."""
    spans = X.event_spans(spark, d)
    lists = {"services": T.list_services(spans), "names": T.list_field_names(spans), "values": T.list_field_values(spans, "span_attr:k"), "ids": T.list_trace_ids(spans)}
    placed = [T.sorted_list(df, 25).toDF("value").select(F.lit(k).alias("list"), F.monotonically_increasing_id().alias("i"), "value") for k, df in lists.items()]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.groupBy("list").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), ",").alias("listed"))


def replica_missing(spark, d):
    """Traces that a replica without every third user lacks."""
    spans = X.event_spans(spark, d)
    return T.missing(spans, spans.where(F.substring("trace_id", 7, 8).cast("bigint") % 3 != 0))


def replica_differing(spark, d):
    """Traces whose rows are not the same in two replicas: one has lost a span of some, and changed another's name."""
    a = X.event_spans(spark, d)
    number = F.substring("span_id", 6, 10).cast("bigint")
    b = a.where(number % 211 != 0).withColumn("name", F.when(number % 307 == 0, F.lit("other")).otherwise(F.col("name")))
    return T.differing(a, b.repartition(3), ["span_id", "name", "start_unix_nano", "end_unix_nano", "fields"])


def placements(spark, d):
    found = place(T.list_trace_ids(X.event_spans(spark, d)), NODES, 3, WEIGHTS, GROUPS)
    return found.withColumn("nodes", F.array_join("nodes", ","))


def system_times(spark, d):
    return X._table(spark, d, "events").select("event_id", unix_millis(F.col("ts")).alias("millis"))


def latency_buckets(spark, d):
    """Spans, errors and latency by hour of their start."""
    s = X.event_spans(spark, d)
    nanos = F.col("end_unix_nano") - F.col("start_unix_nano")
    return s.groupBy(F.expr("start_unix_nano div 3600000000000").alias("hour")).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("name") == "error").alias("errors"), F.sum(nanos).alias("nanos"), F.max(nanos).alias("longest"),
    )


def fnv_sql(text: str) -> str:
    """FNV-1a of an ASCII text in DuckDB."""
    codes = f"list_transform(generate_series(1, len({text})), lambda i: CAST(ascii(substr({text}, i, 1)) AS HUGEINT))"
    return f"lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {codes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0')"


_SEED = "'0:0:0:' || CAST(time_unix_nano AS VARCHAR) || ':' || body || ':' || coalesce({}, '-') || ':-'"
_HEXED = "CASE WHEN trace_id IS NOT NULL THEN lpad(lower(hex(CAST(substr(trace_id, 7, 8) AS BIGINT))), 32, '0') END"
_OTLP_LOGS = f"""{D._L}, h AS (SELECT *, {_HEXED} AS t FROM logs), k AS (SELECT *, {_SEED.format("t")} AS seed FROM h)
  SELECT 'log-' || CAST(time_unix_nano AS VARCHAR) || '-' || {fnv_sql("seed")} AS log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, body, t AS trace_id,
  'resource_attr:service.name=' || service || ',instrumentation_scope.name=events,log_attr:type=' || event_type AS fields FROM k"""
_SPAN_JSON = """'{"trace_id":"' || trace_id || '","span_id":"' || span_id || '","parent_span_id":null,"name":"' || name || '","start_unix_nano":' || s || ',"end_unix_nano":' || e || ',"time_unix_nano":' || e || ',"fields":{"resource_attr:service.name":"' || service || '","span_attr:k":"' || k || '","status_code":"' || code || '"}}'"""
_LOG_JSON = """'{"log_id":"' || log_id || '","time_unix_nano":' || time_unix_nano || ',"observed_time_unix_nano":' || observed_time_unix_nano || ',"severity_number":' || severity_number || ',"severity_text":"' || severity_text || '","body":"' || body || '","trace_id":' || CASE WHEN trace_id IS NULL THEN 'null' ELSE '"' || trace_id || '"' END || ',"span_id":null,"fields":{"resource_attr:service.name":"' || service || '","log_attr:type":"' || event_type || '"}}'"""
_VALUES = ", ".join(f"('{n}', {WEIGHTS.get(n, 1)}, {repr(GROUPS[n]) if n in GROUPS else 'NULL'})" for n in NODES)
_STATS = f"""{D._E}, st AS (SELECT (SELECT count(*) FROM spans) AS span_rows_total, (SELECT count(DISTINCT trace_id) FROM spans) AS traces, (SELECT count(*) FROM events) AS log_rows_total, (SELECT count(*) FROM events) AS log_ids)"""


def _page() -> str:
    lines, i = [], 0
    for c in ("span_rows_total", "traces", "log_rows_total", "log_ids"):
        lines += [f"SELECT {i} AS place, '# TYPE tracelake_{c} {'counter' if c.endswith('_total') else 'gauge'}' AS line", f"SELECT {i + 1}, 'tracelake_{c} ' || {c} FROM st"]
        i += 2
    return f"{_STATS} " + " UNION ALL ".join(lines)


ORACLE = {
    "log_ids": f"{D._L}, k AS (SELECT *, {_SEED.format('trace_id')} AS seed FROM logs) SELECT log_id AS event, 'log-' || CAST(time_unix_nano AS VARCHAR) || '-' || {fnv_sql('seed')} AS log_id FROM k",
    "flatten_otlp_logs": _OTLP_LOGS,
    "otlp_log_proto_round_trip": _OTLP_LOGS,
    "grpc_frames": f"{D._L} SELECT severity_text, {_HEXED} AS trace_id, count(*) AS records FROM logs GROUP BY 1, 2",
    "store_search": D._FLAG,
    "store_compacted_search": D._FLAG,
    "store_trace": D.ORACLE["get_trace"],
    "store_logs": D.ORACLE["log_upsert"],
    "stream_ingest": """SELECT 'conv-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS trace_id, min(conv_id * 60000000000 + turn * 1000000000) AS start_unix_nano,
      max(conv_id * 60000000000 + turn * 1000000000 + CAST(length(text) AS BIGINT) * 1000000) AS end_unix_nano FROM conversations GROUP BY conv_id""",
    "stream_running_windows": f"""{D._E} SELECT trace_id, min(s) AS start_unix_nano, max(e) AS end_unix_nano, count(*) AS spans, coalesce(string_agg(DISTINCT nullif(service, '-'), ',' ORDER BY nullif(service, '-')), '') AS services,
      string_agg(DISTINCT name, ',' ORDER BY name) AS operations FROM spans GROUP BY trace_id""",
    "sharded_decode": f"{D._L} SELECT CAST(count(*) AS BIGINT) AS records, count(DISTINCT trace_id) AS traces, CAST(0 AS BIGINT) AS split FROM logs WHERE trace_id IS NOT NULL",
    "jaeger_trace_views": f"""{D._O}, f AS ({D._FIRST}), n AS (SELECT trace_id, service, 'p' || row_number() OVER (PARTITION BY trace_id ORDER BY f, service) AS p FROM f),
      hits AS (SELECT trace_id FROM spans GROUP BY trace_id HAVING bool_or(service = 'nation-7') ORDER BY max(e) DESC, trace_id LIMIT 200),
      a AS (SELECT trace_id, string_agg(p || '=' || service, ',' ORDER BY p) AS processes FROM n GROUP BY trace_id), b AS (SELECT trace_id, string_agg(span_id || '@' || p, ',' ORDER BY e, span_id) AS spans FROM spans JOIN n USING (trace_id, service) GROUP BY trace_id)
      SELECT trace_id, processes, spans FROM hits JOIN a USING (trace_id) JOIN b USING (trace_id)""",
    "jaeger_process_tags": f"""{D._E}, f AS ({D._FIRST}), n AS (SELECT trace_id, service, 'p' || row_number() OVER (PARTITION BY trace_id ORDER BY f, service) AS process_id FROM f),
      t AS (SELECT trace_id, service, string_agg(DISTINCT 'zone=z' || CAST(substr(span_id, 6, 10) AS BIGINT) % 3, ',' ORDER BY 'zone=z' || CAST(substr(span_id, 6, 10) AS BIGINT) % 3) AS tags FROM spans GROUP BY 1, 2)
      SELECT trace_id, process_id, service, tags FROM n JOIN t USING (trace_id, service)""",
    "jaeger_services_body": f"""{D._O} SELECT '{{"data":["' || string_agg(service, '","' ORDER BY service) || '"],"errors":null,"limit":0,"offset":0,"total":' || count(*) || '}}' AS json FROM (SELECT DISTINCT service FROM spans) x""",
    "jaeger_trace_body": f"""{D._O} SELECT 'order-00000007' AS trace, CAST(CASE WHEN count(*) = 0 THEN 404 END AS INTEGER) AS code, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS total, coalesce(string_agg(span_id, ',' ORDER BY e, span_id), '') AS spans FROM spans WHERE trace_id = 'order-00000007'
      UNION ALL SELECT 'nowhere', 404, 0, ''""",
    "tempo_search_body": f"""{D._E}, r AS (SELECT trace_id, max(e) AS me, {D._ROOT} FROM spans GROUP BY trace_id HAVING bool_or(service = 'checkout') AND bool_or(code = '2') ORDER BY me DESC, trace_id LIMIT 20)
      SELECT '{{"traces":[' || coalesce(string_agg('{{"traceID":"' || trace_id || '","rootServiceName":"' || root_service_name || '","rootTraceName":"' || root_trace_name || '","startTimeUnixNano":"' || start_time_unix_nano || '","durationMs":' || duration_ms || '}}', ',' ORDER BY me DESC, trace_id), '') || ']}}' AS json FROM r""",
    "tempo_trace_body": f"""{D._O} SELECT 'order-00000007' AS trace, CAST(200 AS INTEGER) AS status, service, string_agg(span_id, ',' ORDER BY e, span_id) AS spans FROM spans WHERE trace_id = 'order-00000007' GROUP BY service
      UNION ALL SELECT 'nowhere', 404, NULL, NULL UNION ALL SELECT 'order-00000007', 404, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM spans WHERE trace_id = 'order-00000007')""",
    "native_trace_json": f"{D._E} SELECT trace_id AS id, {_SPAN_JSON} AS json FROM spans",
    "native_hit_json": f"""{D._E}, h AS (SELECT {D._HITS} HAVING bool_or(service = 'checkout') AND bool_or(name = 'error') AND bool_or(k = '69') AND max(e) >= {D.LO} AND min(s) <= {D.HI} ORDER BY end_unix_nano DESC, trace_id LIMIT 20)
      SELECT trace_id, '{{"trace_id":"' || trace_id || '","start_unix_nano":' || start_unix_nano || ',"end_unix_nano":' || end_unix_nano || ',"services":["' || replace(services, ',', '","') || '"]}}' AS json FROM h""",
    "native_log_json": f"{D._L} SELECT log_id, {_LOG_JSON} AS json FROM logs",
    "native_request": f"{D._E} SELECT {D._HITS} HAVING bool_or(service = 'checkout') AND bool_or(k = '69') AND bool_or(code = '2') AND max(e) >= {D.LO} AND min(s) <= {D.HI} ORDER BY end_unix_nano DESC, trace_id LIMIT 30",
    "metrics_page": _page(),
    "stringified_values": """SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS f64, CAST(-event_id AS VARCHAR) AS i64, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS bool,
      CASE WHEN event_id % 3 = 0 THEN '-' ELSE event_type END AS string FROM events""",
    "reserved_names": f"{D._E} SELECT span_id, 'kept=x,' || {D._FIELDS} FROM spans",
    "invalid_ranges": "SELECT event_type AS name, event_id % 7 <> 0 AS good, count(*) AS spans, CAST(sum(CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 5 END) AS BIGINT) AS nanos FROM events GROUP BY 1, 2",
    "sorted_lists": f"""{D._E}, v AS (SELECT DISTINCT 'services' AS list, service AS value FROM spans WHERE service <> '-' UNION SELECT 'values', k FROM spans UNION SELECT 'ids', trace_id FROM spans
        UNION SELECT 'names', unnest(['resource_attr:service.name', 'span_attr:k', 'status_code']) FROM spans),
      r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value) AS i FROM v) SELECT list, string_agg(value, ',' ORDER BY value) AS listed FROM r WHERE i <= 25 GROUP BY list""",
    "replica_missing": f"{D._E} SELECT DISTINCT trace_id FROM ev WHERE user_id % 3 = 0",
    "replica_differing": f"{D._E} SELECT DISTINCT trace_id FROM ev WHERE event_id % 211 = 0 OR event_id % 307 = 0 AND event_type <> 'other'",
    "placements": f"""{D._E}, n(name, weight, grp) AS (VALUES {_VALUES}), x AS (
        SELECT trace_id, name, grp, -ln((CAST('0x' || substr(md5(trace_id || '|' || name), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / weight AS t FROM (SELECT DISTINCT trace_id FROM spans) s, n),
      o AS (SELECT *, grp IS NOT NULL AND row_number() OVER (PARTITION BY trace_id, grp ORDER BY t, name) > 1 AS late FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY late, t, name) AS i FROM o)
      SELECT trace_id, string_agg(name, ',' ORDER BY i) AS nodes FROM r WHERE i <= 3 GROUP BY trace_id""",
    "system_times": "SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS millis FROM events",
    "latency_buckets": f"{D._E} SELECT s // 3600000000000 AS hour, count(*) AS spans, count(*) FILTER (name = 'error') AS errors, CAST(sum(e - s) AS BIGINT) AS nanos, max(e - s) AS longest FROM spans GROUP BY 1",
}

_QUERIES = (
    log_ids, flatten_otlp_logs, otlp_log_proto_round_trip, grpc_frames, store_search, store_compacted_search, store_trace, store_logs, stream_ingest, stream_running_windows, sharded_decode, jaeger_trace_views, jaeger_process_tags, jaeger_services_body, jaeger_trace_body,
    tempo_search_body, tempo_trace_body, native_trace_json, native_hit_json, native_log_json, native_request, metrics_page, stringified_values, reserved_names, invalid_ranges, sorted_lists, replica_missing, replica_differing,
    placements, system_times, latency_buckets,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
