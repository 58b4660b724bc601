import json

import pytest
from pyspark.sql import functions as F

from helpers import log, logs_df, span, spans_df, svc
from test_otlp import LOG_REQUEST, one, trace_request
from tracelake.engine import TraceEngine
from tracelake.operators import traces as T
from tracelake.operators.logs import latest
from tracelake.request import TraceSearch
from tracelake.store import TraceStore
from tracelake.streaming import ingest


def rows(n):
    return [span(f"t{i % 7}", f"s{i}", f"op{i % 3}", i, i + 5, [svc("a" if i % 2 else "b")]) for i in range(n)]


def test_store_index_and_compaction(spark, tmp_path):
    store, df = TraceStore(spark, str(tmp_path), buckets=4), spans_df(spark, rows(40))
    assert store.spans().count() == store.logs().count() == store.search(TraceSearch()).count() == 0
    store.append_spans(df.where("start_unix_nano < 20"))
    store.append_spans(df.where("start_unix_nano >= 20"))
    assert [r.span_id for r in store.trace("t3").collect()] == [r.span_id for r in T.get_trace(df, "t3").collect()]
    plan = store.trace("t3")._jdf.queryExecution().toString()
    assert "trace_bucket" in plan.split("PartitionFilters")[1][:80] and "EqualTo(trace_id,t3)" in plan
    before = sorted(r.span_id for r in store.spans().collect())
    reqs = [TraceSearch(service_name="a", operation_name="op1", limit=3), TraceSearch(21, 26, limit=None), TraceSearch(0, 3), TraceSearch(service_name="c"), TraceSearch(limit=2)]
    want = [[tuple(r) for r in T.search_traces(df, q).collect()] for q in reqs]
    for whole in (False, True):  # two segments that share traces, then one
        for q, w in zip(reqs, want):
            for got in (store.search(q), TraceEngine.of(store).search_traces(q), T.search_traces(store.spans(), q)):
                assert sorted(map(tuple, got.collect())) == sorted(w) if q.limit is None else list(map(tuple, got.collect())) == w
        if not whole:
            running = store.spans()
            assert store.compact() == store.segments()[0] and len(store.segments()) == 1
            assert sorted(r.span_id for r in running.collect()) == before  # a reader that has begun
            assert store.compact() is None and store.vacuum() == 4 and store.vacuum() == 0
    assert sorted(r.span_id for r in store.spans().collect()) == before
    found = store.search(TraceSearch(21, 26))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(end_unix_nano,21)" in found and "Exchange" not in found


def test_interrupted_writers_leave_nothing_behind(spark, tmp_path, monkeypatch):
    store, df = TraceStore(spark, str(tmp_path), buckets=2), spans_df(spark, rows(10))
    names = [store.append_spans(df.where(f"start_unix_nano % 2 = {k}"), f"part-{k}") for k in (0, 1)]
    before = sorted(r.span_id for r in store.spans().collect())
    state = lambda: (store.segments(), sorted(r.span_id for r in store.spans().collect()), store.index().count())
    was = state()
    with monkeypatch.context() as m:  # files are written, the manifest is not
        m.setattr(TraceStore, "_commit", lambda self, change: (_ for _ in ()).throw(RuntimeError("lost")))
        for job in (store.compact, lambda: store.append_spans(df, "late")):
            with pytest.raises(RuntimeError):
                job()
    assert state() == was
    (tmp_path / "manifest" / f"{9:012d}.json").write_text('{"spans": [')  # a manifest that was cut off
    assert state() == was
    # an append while a compaction runs, and a second compaction of the same segments
    write = TraceStore._write_spans

    def slow(self, spans, segment):
        write(self, spans, segment)
        if segment != "between":
            store.append_spans(spans_df(spark, [span("new", "new", start=1)]), "between")

    with monkeypatch.context() as m:
        m.setattr(TraceStore, "_write_spans", slow)
        assert store.compact(names) is not None
    assert store.compact(names) is None
    assert sorted(r.span_id for r in store.spans().collect()) == sorted([*before, "new"])
    assert store.append_spans(df, "part-0") == "part-0" and store.spans().count() == 11  # a repeat, also of a segment that is gone


def test_time_filters_reach_the_scan(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path), buckets=2)
    store.append_spans(spans_df(spark, rows(5)))
    plan = T.trace_windows(store.spans().where("end_unix_nano >= 7"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(end_unix_nano,7)" in plan and "fields" not in plan.split("ReadSchema")[-1]


def test_repeated_batch_adds_nothing(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "store"), buckets=2)
    batch = spans_df(spark, [*rows(6), span("bad", "bad", start=9, end=3)]).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    for _ in range(2):
        ingest.write_spans(batch, "q-000000000000", store, str(tmp_path / "bad"))
        ingest.write_logs(logs_df(spark, [log("l", 5)]).withColumn("ingest_seq", F.lit(0).cast("bigint")), "q-000000000000", 0, store)
    assert store.spans().count() == 6 and store.logs().count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    ingest.write_spans(batch, "q-000000000001", store)
    assert store.spans().count() == 12 and store.index().count() == 12 and store.search(TraceSearch(limit=None)).count() == 6


def test_streams_equal_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.json").write_text(json.dumps(trace_request([one(10 + i, 20 + i, span_id=f"s{i}"), one(9, 3, span_id="bad")])))
    store = TraceStore(spark, str(tmp_path / "store"), buckets=2)
    q = ingest.ingest_spans(ingest.span_stream(ingest.stream_bodies(spark, str(inbox), files_per_trigger=1)), store, str(tmp_path / "ck"), str(tmp_path / "bad"))
    q.awaitTermination()
    assert tuple(T.trace_windows(store.spans()).first()) == ("tr-a", 10, 22) and spark.read.parquet(str(tmp_path / "bad")).count() == 3
    running = ingest.running_windows(spark.readStream.schema(store.spans().schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "store/spans")))
    q = running.writeStream.outputMode("update").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.sql("select * from w").first()) == ("tr-a", 10, 22, 3, ["mill"], ["grind"])
    assert [r.trace_id for r in store.search(TraceSearch(12, 12, "mill")).collect()] == ["tr-a"]  # the stream's segments bring their index


def test_log_stream_upserts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = TraceStore(spark, str(tmp_path / "store"))
    for i in range(2):
        (inbox / f"{i}.json").write_text(json.dumps(LOG_REQUEST).replace("upper", f"M{i}"))
        ingest.ingest_logs(ingest.log_stream(ingest.stream_bodies(spark, str(inbox))), store, str(tmp_path / "ck")).awaitTermination()
    assert store.logs().count() == 2
    r = latest(store.logs().drop("day")).select(F.element_at("fields", -1)["value"].alias("v")).collect()
    assert [x.v for x in r] == ["M1"]
