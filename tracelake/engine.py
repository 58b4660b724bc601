"""One object with the engine's query methods over a pair of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators import logs as L
from tracelake.operators import metrics
from tracelake.operators import traces as T
from tracelake.plans import jaeger, tempo
from tracelake.request import LogSearch, TraceSearch, jaeger_search, tempo_search
from tracelake.sources import export, otlp_json, otlp_proto
from tracelake.store import TraceStore


class TraceEngine:
    """Queries over spans and logs. With a trace index, searches read it instead of the spans.

    whole_index: the index has one row a trace; else the rows of a trace count together.
    """

    def __init__(self, spark: SparkSession, spans: DataFrame, logs: DataFrame | None = None, index: DataFrame | None = None, whole_index: bool = True):
        self.spark, self.spans, self.logs, self.index, self.whole_index = spark, spans, logs, index, whole_index

    @classmethod
    def of(cls, store: TraceStore) -> TraceEngine:
        """What the store holds now."""
        return cls(store.spark, store.spans(), store.logs(), store.index(), len(store.segments()) <= 1)

    # traces
    def trace_window(self, trace_id: str) -> DataFrame:
        return T.trace_windows(self.spans.where(self.spans["trace_id"] == trace_id))

    def get_trace(self, trace_id: str) -> DataFrame:
        return T.get_trace(self.spans, trace_id)

    def search_traces(self, req: TraceSearch) -> DataFrame:
        return T.search_traces(self.spans, req) if self.index is None else T.search_index(self.index, req, self.whole_index)

    def list_trace_ids(self) -> DataFrame:
        """Sorted, like all lists here."""
        return T.sorted_list(T.list_trace_ids(self.spans))

    def list_services(self) -> DataFrame:
        return T.sorted_list(T.list_services(self.spans))

    def list_field_names(self) -> DataFrame:
        return T.sorted_list(T.list_field_names(self.spans))

    def list_field_values(self, name: str) -> DataFrame:
        return T.sorted_list(T.list_field_values(self.spans, name))

    def stats(self) -> DataFrame:
        return T.storage_stats(self.spans)

    def metrics(self) -> str:
        """What the engine holds, as Prometheus text."""
        return metrics.text(metrics.store_stats(self.spans, self.logs))

    # logs
    def search_logs(self, req: LogSearch) -> DataFrame:
        rows = L.latest(self.logs) if "ingest_seq" in self.logs.columns else self.logs
        return L.search_logs(rows, req)

    # ingest: relations grow by union; a TraceStore makes it lasting
    def ingest_traces(self, bodies: DataFrame, protobuf: bool = False) -> TraceEngine:
        requests = (otlp_proto if protobuf else otlp_json).parse_trace_requests(bodies)
        return self.append_rows(otlp_json.flatten_traces(requests))

    def ingest_logs(self, bodies: DataFrame, protobuf: bool = False) -> TraceEngine:
        rows = otlp_json.flatten_logs((otlp_proto if protobuf else otlp_json).parse_log_requests(bodies))
        return TraceEngine(self.spark, self.spans, rows if self.logs is None else self.logs.unionByName(rows, allowMissingColumns=True), self.index, self.whole_index)

    def append_rows(self, spans: DataFrame) -> TraceEngine:
        """The engine with more spans; an index gets rows for these beside the ones it has."""
        index = None if self.index is None else self.index.unionByName(T.trace_index(spans))
        return TraceEngine(self.spark, self.spans.unionByName(spans, allowMissingColumns=True), self.logs, index, False)

    # views
    def jaeger_services(self) -> DataFrame:
        return T.sorted_list(jaeger.services(self.spans))

    def jaeger_operations(self, service: str) -> DataFrame:
        return T.sorted_list(jaeger.operations(self.spans, service))

    def jaeger_search(self, service: str, operation: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
        """Views of the traces found: a semi-join with the hits, then one aggregate."""
        hits = jaeger.search(self.spans, jaeger_search(service, operation, start, end, limit)).select("trace_id")
        return jaeger.trace_view(self.spans.join(hits, "trace_id", "left_semi"))

    def jaeger_trace(self, trace_id: str) -> DataFrame:
        return jaeger.trace_view(self.spans.where(self.spans["trace_id"] == trace_id))

    def tempo_search(self, q: str | None = None, tags: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
        return tempo.search(self.spans, tempo_search(q, tags, start, end, limit))

    def tempo_tags(self, scope: str | None = None, limit: int | None = None) -> DataFrame:
        return tempo.tags(self.spans, scope, limit)

    def tempo_tag_scopes(self, limit: int | None = None) -> DataFrame:
        return tempo.tag_scopes(self.spans, limit)

    def tempo_tag_values(self, tag: str, limit: int | None = None) -> DataFrame:
        return tempo.tag_values(self.spans, tag, limit)

    def jaeger_trace_json(self, trace_id: str) -> DataFrame:
        """(json): the envelope of one trace, or of none found."""
        return jaeger.trace_response(self.jaeger_trace(trace_id))

    def tempo_trace(self, trace_id: str) -> DataFrame:
        """(status, json) of one trace; export_otlp() with protobuf has the bytes."""
        return tempo.trace_body(self.export_otlp(trace_id))

    def tempo_search_json(self, q: str | None = None, tags: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
        return tempo.search_body(self.tempo_search(q, tags, start, end, limit))

    def export_otlp(self, trace_id: str, protobuf: bool = False) -> DataFrame:
        requests = export.export_requests(self.spans.where(self.spans["trace_id"] == trace_id))
        return otlp_proto.to_trace_bodies(requests) if protobuf else requests
