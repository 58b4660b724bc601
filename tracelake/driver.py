"""Registered queries over the driver's tables, and the SQL that DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import fixtures as X
from tracelake.functions.fields import field_map_text, fnv1a64, promote
from tracelake.operators import logs as L
from tracelake.operators import traces as T
from tracelake.plans import jaeger, tempo
from tracelake.request import FieldFilter, LogSearch, TraceSearch, jaeger_search, tempo_search
from tracelake.sources import export, otlp_json, otlp_proto

LO, HI = 1704500000000000000, 1705500000000000000
FLAGSHIP = TraceSearch(LO, HI, "checkout", "error", (FieldFilter("span_attr:k", "69"),), 20)


def _services(df: DataFrame) -> DataFrame:
    return df.withColumn("services", F.array_join("services", ","))


def trace_search(spark: SparkSession, d: str) -> DataFrame:
    return _services(T.search_traces(X.event_spans(spark, d), FLAGSHIP))


def trace_search_no_filter(spark, d):
    return _services(T.search_traces(X.event_spans(spark, d), TraceSearch()))


def trace_search_time_range(spark, d):
    return _services(T.search_traces(X.event_spans(spark, d), TraceSearch(LO, HI, limit=None)))


def trace_search_orders(spark, d):
    return _services(T.search_traces(X.order_spans(spark, d), TraceSearch(0, service_name="nation-7", operation_name="ship O", limit=None)))


def trace_search_indexed(spark, d):
    return _services(T.search_index(T.trace_index(X.event_spans(spark, d)), FLAGSHIP))


def trace_windows(spark, d):
    return T.trace_windows(X.event_spans(spark, d))


def get_trace(spark, d):
    found = T.get_trace(X.event_spans(spark, d, parents=True), "trace-00000007")
    return found.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "end_unix_nano", (F.col("end_unix_nano") - F.col("start_unix_nano")).alias("duration"), field_map_text().alias("fields"))


def list_services(spark, d):
    return T.list_services(X.event_spans(spark, d))


def list_trace_ids(spark, d):
    return T.list_trace_ids(X.event_spans(spark, d))


def list_field_names(spark, d):
    return T.list_field_names(X.event_spans(spark, d))


def list_field_values(spark, d):
    return T.list_field_values(X.event_spans(spark, d), "span_attr:k")


def field_postings(spark, d):
    return T.field_postings(X.event_spans(spark, d)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("traces"))


def service_operations(spark, d):
    return T.operations_of(X.event_spans(spark, d), "payments")


def _plain_logs(df: DataFrame) -> DataFrame:
    return df.select("log_id", "time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text", "body", "trace_id", field_map_text().alias("fields"))


def log_search(spark, d):
    return _plain_logs(L.search_logs(X.event_logs(spark, d), LogSearch(LO, HI, "payments", "ERROR")))


def log_search_field(spark, d):
    return _plain_logs(L.search_logs(X.event_logs(spark, d), LogSearch(LO, HI, field_filters=(FieldFilter("log_attr:type", "signup"),), limit=50)))


def log_search_pseudo_field(spark, d):
    return _plain_logs(L.search_logs(X.event_logs(spark, d), LogSearch(field_filters=(FieldFilter("log.trace_id", "trace-00000003"), FieldFilter("log.severity_number", "9")), limit=None)))


def log_upsert(spark, d):
    logs = X.event_logs(spark, d)
    first = logs.withColumn("ingest_seq", F.lit(1).cast("bigint"))
    again = logs.where("severity_number > 9").withColumns({"ingest_seq": F.lit(2).cast("bigint"), "body": F.concat(F.lit("again: "), "body")})
    return _plain_logs(L.latest(first.unionByName(again)).drop("ingest_seq"))


def log_merge_first(spark, d):
    logs = X.event_logs(spark, d)
    return _plain_logs(L.merge_first([logs.where("severity_number > 9"), logs.withColumn("body", F.lit("second"))]))


def log_id_fnv(spark, d):
    return X.event_logs(spark, d).select("log_id", fnv1a64(F.col("body")).alias("hash"))


def jaeger_search_orders(spark, d):
    return jaeger.search(X.order_spans(spark, d), jaeger_search("nation-7", "ship O", limit=1000))


def jaeger_services(spark, d):
    return jaeger.services(X.order_spans(spark, d))


def jaeger_operations(spark, d):
    return jaeger.operations(X.order_spans(spark, d), "nation-7")


def jaeger_spans(spark, d):
    rows = jaeger.span_rows(X.order_spans(spark, d))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",")
    return rows.select("trace_id", "span_id", "operation_name", "process_id", "start_time", "duration", tags.alias("tags"))


def jaeger_processes(spark, d):
    return jaeger.processes(X.order_spans(spark, d)).select("trace_id", "process_id", "service", F.size("tags").alias("n_tags"))


def jaeger_references(spark, d):
    rows = jaeger.span_rows(X.event_spans(spark, d, parents=True))
    return rows.select("trace_id", "span_id", F.explode("references").alias("r")).select("trace_id", "span_id", F.col("r.refType").alias("ref_type"), F.col("r.spanID").alias("parent_id"))


def tempo_search_q(spark, d):
    return tempo.search(X.event_spans(spark, d, parents=True), tempo_search('{resource.service.name="checkout" && span.k="69" && status="2"}', limit=50))


def tempo_search_tags(spark, d):
    return tempo.search(X.event_spans(spark, d, parents=True), tempo_search(tags="service.name=PAY name=sign", start=1704500000, end=1705500000, limit=40))


def tempo_summaries(spark, d):
    return tempo.summaries(X.event_spans(spark, d, parents=True))


def tempo_tag_scopes(spark, d):
    return tempo.tag_scopes(X.event_spans(spark, d)).withColumn("tags", F.array_join("tags", ","))


def tempo_tags(spark, d):
    return tempo.tags(X.event_spans(spark, d), "span")


def tempo_tag_values(spark, d):
    return tempo.typed_tag_values(X.event_spans(spark, d), "status")


def otlp_export_groups(spark, d):
    x = export.export_parts(X.order_spans(spark, d))
    service = F.col("g.resource_attributes")[0]["value"]["value"]
    return x.groupBy(service.alias("service")).agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("span.status.code") == 2).alias("failed"))


def otlp_proto_round_trip(spark, d):
    """Spans to protobuf and back: hexadecimal ids are the same again."""
    s = X.event_spans(spark, d, parents=True)
    hexed = s.withColumns({"trace_id": F.lower(F.lpad(F.hex(F.substring("trace_id", 7, 8).cast("bigint")), 32, "0")), "span_id": F.lower(F.lpad(F.hex(F.substring("span_id", 6, 10).cast("bigint")), 16, "0")), "parent_span_id": F.lower(F.lpad(F.hex(F.substring("parent_span_id", 6, 10).cast("bigint")), 16, "0"))})
    back = otlp_json.flatten_traces(otlp_proto.parse_trace_requests(otlp_proto.to_trace_bodies(export.export_requests(hexed))))
    return back.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "end_unix_nano", field_map_text().alias("fields"))


def flatten_otlp_json(spark, d):
    rows = otlp_json.flatten_traces(otlp_json.parse_trace_requests(X.conversation_requests(spark, d)))
    return rows.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "end_unix_nano", field_map_text().alias("fields"))


def log_span_round_trip(spark, d):
    return _plain_logs(export.span_to_log(export.log_to_span(X.event_logs(spark, d))))


def field_type_inference(spark, d):
    return T.field_encodings(X.event_spans(spark, d))


def storage_stats(spark, d):
    return T.storage_stats(X.event_spans(spark, d))


def log_trace_join(spark, d):
    """Logs with the window of their trace (beyond the reference: it never joins the two)."""
    w = T.trace_windows(X.event_spans(spark, d))
    return X.event_logs(spark, d).join(w, "trace_id").select("log_id", "trace_id", "time_unix_nano", "start_unix_nano", "end_unix_nano")


def log_buckets(spark, d):
    """Log records and errors by hour."""
    hour = F.expr("time_unix_nano div 3600000000000")
    return X.event_logs(spark, d).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("severity_text") == "ERROR").alias("errors"))


def duration_quantiles(spark, d):
    """Nearest-rank quantiles of span durations by rounded index, for each operation."""
    return T.exact_quantiles(X.event_spans(spark, d), (0.5, 0.99))


def promoted_services(spark, d):
    return promote(X.event_spans(spark, d)).groupBy(F.coalesce("service_name", F.lit("none")).alias("service_name")).agg(F.count(F.lit(1)).alias("spans"))


_E = """
WITH ev AS (
  SELECT *, 'trace-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS trace_id, 'span-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS span_id, epoch_us(CAST(ts AS TIMESTAMP)) * 1000 AS s,
         epoch_us(CAST(ts AS TIMESTAMP)) * 1000 + CAST(round(value * 1000000) AS BIGINT) AS e,
         CASE event_id % 4 WHEN 0 THEN 'checkout' WHEN 1 THEN 'payments' WHEN 2 THEN 'catalog' ELSE '-' END AS service,
         coalesce(json_extract_string(props, '$.k'), '-') AS k, CASE WHEN event_type = 'error' THEN '2' ELSE '0' END AS code
  FROM events
), spans AS (
  SELECT trace_id, span_id, event_type AS name, s, e, service, k, code,
         CASE WHEN row_number() OVER w > 1 THEN 'span-' || lpad(CAST(first_value(event_id) OVER w AS VARCHAR), 10, '0') END AS parent_span_id
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
"""
_L = """
WITH logs AS (
  SELECT 'log-' || CAST(epoch_us(CAST(ts AS TIMESTAMP)) * 1000 AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS log_id, epoch_us(CAST(ts AS TIMESTAMP)) * 1000 AS time_unix_nano,
         epoch_us(CAST(ts AS TIMESTAMP)) * 1000 + 1000 AS observed_time_unix_nano, CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 ELSE 9 END AS severity_number,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity_text, event_type || ' by user ' || CAST(user_id AS VARCHAR) AS body,
         CASE WHEN event_id % 5 <> 0 THEN 'trace-' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS trace_id,
         CASE event_id % 4 WHEN 0 THEN 'checkout' WHEN 1 THEN 'payments' WHEN 2 THEN 'catalog' ELSE '-' END AS service, event_type
  FROM events
), plain AS (
  SELECT log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, body, trace_id, 'resource_attr:service.name=' || service || ',log_attr:type=' || event_type AS fields, service, event_type FROM logs
)
"""
_LC = "log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, body, trace_id, fields"
_O = """
WITH spans AS (
  SELECT 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS trace_id, 'o-' || CAST(o_orderkey AS VARCHAR) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'order ' || o_orderpriority AS name,
         epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS s, epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 1000 + 3600000000000 AS e, 'orders' AS service, o_orderstatus AS attr, CASE WHEN o_orderstatus = 'P' THEN '2' ELSE '0' END AS code
  FROM orders
  UNION ALL
  SELECT 'order-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0'), 'l-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR), 'o-' || CAST(l_orderkey AS VARCHAR), 'ship ' || l_linestatus,
         epoch_us(CAST(l_shipdate AS TIMESTAMP)) * 1000, epoch_us(CAST(l_shipdate AS TIMESTAMP)) * 1000 + CAST(l_quantity AS BIGINT) * 60000000000, 'nation-' || CAST(s_nationkey AS VARCHAR), l_returnflag, CASE WHEN l_returnflag = 'R' THEN '2' ELSE '0' END
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)
"""
_HITS = "trace_id, min(s) AS start_unix_nano, max(e) AS end_unix_nano, string_agg(DISTINCT CASE WHEN service <> '-' THEN service END, ',' ORDER BY CASE WHEN service <> '-' THEN service END) AS services FROM spans GROUP BY trace_id"
_FLAG = f"{_E} SELECT {_HITS} HAVING bool_or(service = 'checkout') AND bool_or(name = 'error') AND bool_or(k = '69') AND max(e) >= {LO} AND min(s) <= {HI} ORDER BY end_unix_nano DESC, trace_id LIMIT 20"
_FIELDS = "'resource_attr:service.name=' || service || ',span_attr:k=' || k || ',status_code=' || code AS fields"
_ROOT = "arg_min(service, (parent_span_id IS NOT NULL, s, e, span_id)) AS root_service_name, arg_min(name, (parent_span_id IS NOT NULL, s, e, span_id)) AS root_trace_name, CAST(min(s) AS VARCHAR) AS start_time_unix_nano, CAST(greatest(max(e) - min(s), 0) // 1000000 AS BIGINT) AS duration_ms"
_FIRST = "SELECT trace_id, service, min((e, span_id)) AS f FROM spans GROUP BY trace_id, service"
_P = f"{_E}, p AS (SELECT 'resource_attr:service.name' AS name, service AS value, trace_id FROM spans UNION SELECT 'span_attr:k', k, trace_id FROM spans UNION SELECT 'status_code', code, trace_id FROM spans)"
_SCOPE = "CASE WHEN name LIKE 'resource_attr:%' THEN 'resource' WHEN name LIKE 'span_attr:%' THEN 'span' WHEN name = 'status_code' THEN 'intrinsic' END"
_TAG = "CASE WHEN name = 'status_code' THEN 'statusCode' ELSE substr(name, position(':' IN name) + 1) END"
_CODES = "list_transform(generate_series(1, len(body)), lambda i: CAST(ascii(substr(body, i, 1)) AS HUGEINT))"

ORACLE = {
    "trace_search": _FLAG,
    "trace_search_indexed": _FLAG,
    "trace_search_no_filter": f"{_E} SELECT {_HITS} ORDER BY end_unix_nano DESC, trace_id LIMIT 20",
    "trace_search_time_range": f"{_E} SELECT {_HITS} HAVING max(e) >= {LO} AND min(s) <= {HI}",
    "trace_search_orders": f"{_O} SELECT {_HITS} HAVING bool_or(service = 'nation-7') AND bool_or(name = 'ship O') AND max(e) >= 0",
    "trace_windows": f"{_E} SELECT trace_id, min(s) AS start_unix_nano, max(e) AS end_unix_nano FROM spans GROUP BY trace_id",
    "get_trace": f"{_E} SELECT trace_id, span_id, parent_span_id, name, s AS start_unix_nano, e AS end_unix_nano, e - s AS duration, {_FIELDS} FROM spans WHERE trace_id = 'trace-00000007'",
    "list_services": f"{_E} SELECT DISTINCT service FROM spans WHERE service <> '-'",
    "list_trace_ids": f"{_E} SELECT DISTINCT trace_id FROM spans",
    "list_field_names": f"{_P} SELECT DISTINCT name FROM p",
    "list_field_values": f"{_E} SELECT DISTINCT k AS value FROM spans",
    "field_postings": f"{_P} SELECT name, value, count(*) AS traces FROM p GROUP BY 1, 2",
    "service_operations": f"{_E} SELECT DISTINCT name AS operation FROM spans WHERE service = 'payments'",
    "log_search": f"{_L} SELECT {_LC} FROM plain WHERE time_unix_nano BETWEEN {LO} AND {HI} AND service = 'payments' AND severity_text = 'ERROR' ORDER BY time_unix_nano DESC, log_id LIMIT 20",
    "log_search_field": f"{_L} SELECT {_LC} FROM plain WHERE time_unix_nano BETWEEN {LO} AND {HI} AND event_type = 'signup' ORDER BY time_unix_nano DESC, log_id LIMIT 50",
    "log_search_pseudo_field": f"{_L} SELECT {_LC} FROM plain WHERE trace_id = 'trace-00000003' AND severity_number = 9",
    "log_upsert": f"{_L} SELECT log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, CASE WHEN severity_number > 9 THEN 'again: ' || body ELSE body END AS body, trace_id, fields FROM plain",
    "log_merge_first": f"{_L} SELECT log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, CASE WHEN severity_number > 9 THEN body ELSE 'second' END AS body, trace_id, fields FROM plain",
    "log_id_fnv": f"{_L} SELECT log_id, lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {_CODES}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0') AS hash FROM logs",
    "jaeger_search_orders": f"{_O} SELECT trace_id, min(s) AS start_unix_nano, max(e) AS end_unix_nano FROM spans GROUP BY trace_id HAVING bool_or(service = 'nation-7' AND name = 'ship O') AND max(e) >= 0 ORDER BY end_unix_nano DESC, trace_id LIMIT 1000",
    "jaeger_services": f"{_O} SELECT DISTINCT service FROM spans",
    "jaeger_operations": f"{_O} SELECT DISTINCT name AS operation FROM spans WHERE service = 'nation-7'",
    "jaeger_spans": f"""{_O}, n AS (SELECT trace_id, service, row_number() OVER (PARTITION BY trace_id ORDER BY f, service) AS p FROM ({_FIRST}) x)
      SELECT trace_id, span_id, name AS operation_name, 'p' || CAST(p AS VARCHAR) AS process_id, s // 1000 AS start_time, (e - s) // 1000 AS duration, 'attr=' || attr || ',status_code=' || code AS tags FROM spans JOIN n USING (trace_id, service)""",
    "jaeger_processes": f"{_O} SELECT trace_id, 'p' || CAST(row_number() OVER (PARTITION BY trace_id ORDER BY f, service) AS VARCHAR) AS process_id, service, CAST(0 AS INTEGER) AS n_tags FROM ({_FIRST}) x",
    "jaeger_references": f"{_E} SELECT trace_id, span_id, 'CHILD_OF' AS ref_type, parent_span_id AS parent_id FROM spans WHERE parent_span_id IS NOT NULL",
    "tempo_search_q": f"{_E} SELECT trace_id, root_service_name, root_trace_name, start_time_unix_nano, duration_ms FROM (SELECT trace_id, max(e) AS me, {_ROOT} FROM spans GROUP BY trace_id HAVING bool_or(service = 'checkout') AND bool_or(k = '69') AND bool_or(code = '2') ORDER BY me DESC, trace_id LIMIT 50) x",
    "tempo_search_tags": f"{_E} SELECT trace_id, root_service_name, root_trace_name, start_time_unix_nano, duration_ms FROM (SELECT trace_id, max(e) AS me, {_ROOT} FROM spans GROUP BY trace_id HAVING bool_or(contains(lower(service), 'pay')) AND bool_or(contains(lower(name), 'sign')) AND max(e) >= {LO} AND min(s) <= {HI} ORDER BY me DESC, trace_id LIMIT 40) x",
    "tempo_summaries": f"{_E} SELECT trace_id, {_ROOT} FROM spans GROUP BY trace_id",
    "tempo_tag_scopes": f"{_P}, t AS (SELECT DISTINCT {_SCOPE} AS scope, {_TAG} AS tag FROM p) SELECT scope, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY scope",
    "tempo_tags": f"{_P} SELECT DISTINCT {_TAG} AS tag FROM p WHERE {_SCOPE} = 'span'",
    "tempo_tag_values": f"{_E} SELECT DISTINCT 'string' AS type, code AS value FROM spans",
    "otlp_export_groups": f"{_O} SELECT service, count(*) AS spans, count(*) FILTER (code = '2') AS failed FROM spans GROUP BY service",
    "otlp_proto_round_trip": f"""{_E} SELECT lpad(lower(hex(CAST(substr(trace_id, 7, 8) AS BIGINT))), 32, '0') AS trace_id, lpad(lower(hex(CAST(substr(span_id, 6, 10) AS BIGINT))), 16, '0') AS span_id, lpad(lower(hex(CAST(substr(parent_span_id, 6, 10) AS BIGINT))), 16, '0') AS parent_span_id,
      name, s AS start_unix_nano, e AS end_unix_nano, {_FIELDS[:-10]} || ',status_message=-' AS fields FROM spans""",
    "flatten_otlp_json": """SELECT 'conv-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS trace_id, 'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS span_id,
      CASE WHEN turn <> 0 THEN 'turn-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS parent_span_id, role AS name, conv_id * 60000000000 + turn * 1000000000 AS start_unix_nano,
      conv_id * 60000000000 + turn * 1000000000 + CAST(length(text) AS BIGINT) * 1000000 AS end_unix_nano,
      'resource_attr:service.name=agent-' || role || ',instrumentation_scope.name=chat,instrumentation_scope.version=-,span_attr:role=' || role || ',status_code=0,status_message=-' AS fields FROM conversations""",
    "log_span_round_trip": f"{_L} SELECT log_id, time_unix_nano, observed_time_unix_nano, severity_number, severity_text, body, trace_id, 'log_attr:type=' || event_type || ',resource_attr:service.name=' || service AS fields FROM plain",
    "field_type_inference": f"{_P} SELECT name, CASE WHEN bool_and(lower(value) IN ('true', 'false')) THEN 'bool' WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+') AND TRY_CAST(value AS BIGINT) IS NOT NULL) THEN 'i64' ELSE 'string' END AS encoding FROM p GROUP BY name",
    "storage_stats": f"{_E} SELECT count(*) AS rows_ingested, count(DISTINCT trace_id) AS traces_tracked FROM spans",
    "log_trace_join": f"{_E}, w AS (SELECT trace_id, min(s) AS start_unix_nano, max(e) AS end_unix_nano FROM spans GROUP BY trace_id) SELECT 'log-' || CAST(s AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS log_id, trace_id, s AS time_unix_nano, start_unix_nano, end_unix_nano FROM ev JOIN w USING (trace_id) WHERE event_id % 5 <> 0",
    "log_buckets": f"{_L} SELECT time_unix_nano // 3600000000000 AS hour, count(*) AS records, count(*) FILTER (severity_text = 'ERROR') AS errors FROM plain GROUP BY 1",
    "duration_quantiles": f"""{_E}, r AS (SELECT name, e - s AS d, row_number() OVER (PARTITION BY name ORDER BY e - s) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM spans)
      SELECT name, max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN d END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.99 + 0.5) THEN d END) AS p99 FROM r GROUP BY name""",
    "promoted_services": f"{_E} SELECT CASE WHEN service = '-' THEN 'none' ELSE service END AS service_name, count(*) AS spans FROM spans GROUP BY 1",
}

_QUERIES = (
    trace_search, trace_search_no_filter, trace_search_time_range, trace_search_orders, trace_search_indexed, trace_windows, get_trace, list_services, list_trace_ids, list_field_names, list_field_values,
    field_postings, service_operations, log_search, log_search_field, log_search_pseudo_field, log_upsert, log_merge_first, log_id_fnv, jaeger_search_orders, jaeger_services, jaeger_operations, jaeger_spans,
    jaeger_processes, jaeger_references, tempo_search_q, tempo_search_tags, tempo_summaries, tempo_tag_scopes, tempo_tags, tempo_tag_values, otlp_export_groups, otlp_proto_round_trip, flatten_otlp_json,
    log_span_round_trip, field_type_inference, storage_stats, log_trace_join, log_buckets, duration_quantiles, promoted_services,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
