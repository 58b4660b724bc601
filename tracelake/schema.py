"""Relations of the engine: spans, logs and the nested request types they are flattened from."""

from __future__ import annotations

FIELD = "struct<name:string,value:string>"
#: Attributes are an ordered multi-map of strings: order counts, names may repeat.
SPANS = f"trace_id string, span_id string, parent_span_id string, name string, start_unix_nano bigint, end_unix_nano bigint, time_unix_nano bigint, fields array<{FIELD}>"
LOGS = f"log_id string, time_unix_nano bigint, observed_time_unix_nano bigint, severity_number int, severity_text string, body string, trace_id string, span_id string, fields array<{FIELD}>"
SPAN_COLUMNS = [c.split()[0] for c in SPANS.split(", ")]
LOG_COLUMNS = [c.split()[0] for c in LOGS.split(", ")]

VALUE = "struct<kind:string,value:string>"
KV = f"struct<key:string,value:{VALUE}>"
SPAN_RECORD = f"struct<trace_id:string,span_id:string,parent_span_id:string,name:string,start_time_unix_nano:bigint,end_time_unix_nano:bigint,attributes:array<{KV}>,status:struct<code:int,message:string>>"
SCOPE_SPANS = f"struct<scope_name:string,scope_version:string,scope_attributes:array<{KV}>,spans:array<{SPAN_RECORD}>>"
RESOURCE_SPANS = f"array<struct<resource_attributes:array<{KV}>,scope_spans:array<{SCOPE_SPANS}>>>"
LOG_RECORD = f"struct<time_unix_nano:bigint,observed_time_unix_nano:bigint,severity_number:int,severity_text:string,body:{VALUE},trace_id:string,span_id:string,attributes:array<{KV}>>"
SCOPE_LOGS = f"struct<scope_name:string,scope_version:string,scope_attributes:array<{KV}>,log_records:array<{LOG_RECORD}>>"
RESOURCE_LOGS = f"array<struct<resource_attributes:array<{KV}>,scope_logs:array<{SCOPE_LOGS}>>>"

# fixed values: prefixes and names that queries and responses use
RESOURCE, SCOPE, SPAN, LOG = "resource_attr:", "scope_attr:", "span_attr:", "log_attr:"
SERVICE = "resource_attr:service.name"
SCOPE_NAME, SCOPE_VERSION = "instrumentation_scope.name", "instrumentation_scope.version"
STATUS_CODE, STATUS_MESSAGE = "status_code", "status_message"
RESERVED = ("_time", "duration", "end_time_unix_nano", "name", "parent_span_id", "span_id", "start_time_unix_nano", "trace_id")
NOT_INDEXED = ("_time", "duration", "end_time_unix_nano", "start_time_unix_nano")
LOG_KIND = ("record_kind", "log")
LOG_PSEUDO = {
    "log.id": "log_id", "log.body": "body", "log.observed_time_unix_nano": "observed_time_unix_nano", "log.severity_number": "severity_number",
    "log.severity_text": "severity_text", "log.trace_id": "trace_id", "log.span_id": "span_id",
}
MAX_LONG = (1 << 63) - 1
