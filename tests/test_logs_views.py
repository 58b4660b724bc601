import json

from helpers import log, logs_df, span, spans_df, svc
from tracelake.engine import TraceEngine
from tracelake.operators import logs as L
from tracelake.plans import jaeger, tempo
from tracelake.request import FieldFilter, LogSearch, tempo_search


def test_search_logs(spark):
    df = logs_df(spark, [log("log-1", 100, fields=[svc("checkout")]), log("log-2", 200, "ERROR", 17, "payment declined", [svc("payments")], trace="t"), log("log-3", 200, "ERROR", 17, fields=[svc("payments")])])
    find = lambda **k: [r.log_id for r in L.search_logs(df, LogSearch(**k)).collect()]
    assert find(start_unix_nano=0, end_unix_nano=1000, service_name="payments", severity_text="ERROR") == ["log-2", "log-3"]
    assert find(start_unix_nano=100, end_unix_nano=100) == ["log-1"] and find(limit=1) == ["log-2"] and find(limit=0) == [] and find(severity_text="-") == []
    assert find(field_filters=(FieldFilter("log.body", "payment declined"),)) == find(field_filters=(FieldFilter("log.trace_id", "t"), FieldFilter("log.severity_number", "17"))) == ["log-2"]


def test_upsert_keeps_the_latest(spark):
    old, new = logs_df(spark, [log("a", 1, fields=[("k", "old")])]), logs_df(spark, [log("a", 1, fields=[("k", "new")])])
    from pyspark.sql import functions as F

    both = old.withColumn("ingest_seq", F.lit(1)).unionByName(new.withColumn("ingest_seq", F.lit(2)))
    e = TraceEngine(spark, spans_df(spark, []), both)
    assert e.search_logs(LogSearch(field_filters=(FieldFilter("k", "new"),))).count() == 1 and e.search_logs(LogSearch(field_filters=(FieldFilter("k", "old"),))).count() == 0
    assert L.merge_first([old, new]).first().fields[0].value == "old"


def checkout(spark):
    return spans_df(spark, [
        span("t", "root", "GET /checkout", 100_000, 180_000, [svc("checkout"), ("resource_attr:env", "prod"), ("span_attr:http.method", "GET")]), span("t", "child", "SELECT cart_items", 120_000, 160_999, [svc("checkout"), ("resource_attr:zone", "a"), ("status_code", "0")], parent="root"),
        span("u", "x", "GET /checkout", 100_000, 170_000, [svc("payments")]), span("u", "y", "pay", 100_000, 170_000, [svc("checkout")]),
    ])


def test_jaeger(spark):
    e = TraceEngine(spark, checkout(spark))
    r = e.jaeger_trace("t").first()
    assert list(r.processes) == ["p1"] and r.processes["p1"].serviceName == "checkout" and [(t.key, t.value) for t in r.processes["p1"].tags] == [("env", "prod"), ("zone", "a")]
    child, root = r.spans
    assert (child.operationName, child.startTime, child.duration, child.references[0].spanID) == ("SELECT cart_items", 120, 40, "root") and root.references == [] and [(t.key, t.type) for t in root.tags] == [("http.method", "string")]
    assert [r.trace_id for r in e.jaeger_search("checkout", "GET /checkout", start=50, end=200).collect()] == ["t"]
    assert sorted(r[0] for r in e.jaeger_operations("checkout").collect()) == ["GET /checkout", "SELECT cart_items", "pay"]
    body = json.loads(jaeger.response(e.jaeger_services(), "service").first().json)
    assert sorted(body["data"]) == ["checkout", "payments"] and body["total"] == 2 and body["errors"] is None and jaeger.not_found()["errors"][0]["code"] == 404


def test_tempo(spark):
    e = TraceEngine(spark, checkout(spark))
    r = e.tempo_search('{resource.service.name="checkout" && span.http.method="GET"}').collect()
    assert [(x.trace_id, x.root_service_name, x.root_trace_name, x.start_time_unix_nano, x.duration_ms) for x in r] == [("t", "checkout", "GET /checkout", "100000", 0)]
    assert [x.trace_id for x in e.tempo_search(tags="name=CART service.name=CHECK").collect()] == ["t"] and [x.trace_id for x in e.tempo_search(tags="duration=40999").collect()] == ["t"]
    assert e.tempo_search('{name="pay"}').count() == 0 and e.tempo_search("{}", limit=1).count() == 1
    assert {x.scope: x.tags for x in e.tempo_tag_scopes().collect()} == {"resource": ["env", "service.name", "zone"], "span": ["http.method"], "intrinsic": ["statusCode"]}
    assert [x.tag for x in e.tempo_tags("resource", 1).collect()] == ["env"] and [x.value for x in e.tempo_tag_values("span.http.method").collect()] == ["GET"]
    assert tempo.search(e.spans, tempo_search(limit=0)).count() == 0
