import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import log, logs_df, span, spans_df, svc
from tracelake.functions.fields import field_map_text
from tracelake.sources import export, otlp_json, otlp_proto


def kv(k, kind, v):
    return {"key": k, "value": {"kind": kind, "value": v}}


def trace_request(spans, scope=("probe", "7"), scope_attrs=(), service="mill"):
    return {"resource_spans": [{"resource_attributes": [kv("service.name", "string", service)], "scope_spans": [{"scope_name": scope[0], "scope_version": scope[1], "scope_attributes": list(scope_attrs), "spans": spans}]}]}


def one(start=31, end=77, attrs=(), status=None, span_id="sp-a", name="grind"):
    return {"trace_id": "tr-a", "span_id": span_id, "parent_span_id": None, "name": name, "start_time_unix_nano": start, "end_time_unix_nano": end, "attributes": list(attrs), "status": status}


def flat(spark, *requests):
    df = spark.createDataFrame([(json.dumps(r),) for r in requests], "body string")
    return otlp_json.flatten_traces(otlp_json.parse_trace_requests(df)).withColumn("text", field_map_text())


def test_fields_keep_their_order_and_become_text(spark):
    attrs = [kv("grain", "string", "rye"), kv("wet", "bool", False), kv("kilos", "i64", -12), kv("rate", "f64", 2.0), kv("grain", "string", "oat")]
    r = flat(spark, trace_request([one(attrs=attrs, status={"code": 1, "message": "fine"})], scope_attrs=[kv("unit", "string", "kg")])).first()
    assert r.text.split(",") == [
        "resource_attr:service.name=mill", "instrumentation_scope.name=probe", "instrumentation_scope.version=7", "scope_attr:unit=kg",
        "span_attr:grain=rye", "span_attr:wet=false", "span_attr:kilos=-12", "span_attr:rate=2", "span_attr:grain=oat", "status_code=1", "status_message=fine",
    ]
    assert r.time_unix_nano == r.end_unix_nano == 77


def test_empty_texts_become_dashes_but_names_stay(spark):
    r = flat(spark, trace_request([one(attrs=[kv("note", "string", "")], name="", span_id="0011AABBCCDDEEFF")], scope=("", None), service="")).first()
    assert r.text == "resource_attr:service.name=-,instrumentation_scope.name=-,span_attr:note=-" and r.name == "" and r.span_id == "0011aabbccddeeff"


def test_invalid_range(spark):
    with pytest.raises(Exception, match="invalid time range"):
        flat(spark, trace_request([one(200, 100)])).collect()
    df = spark.createDataFrame([(json.dumps(trace_request([one(200, 100), one()])),)], "body string")
    good, bad = otlp_json.flatten_traces_lenient(otlp_json.parse_trace_requests(df))
    assert (good.count(), bad.count()) == (1, 1)


def test_bad_json_fails(spark):
    with pytest.raises(Exception):
        flat(spark, "x").collect()


def log_record(**changed):
    return {"time_unix_nano": 640, "observed_time_unix_nano": 655, "severity_number": 13, "severity_text": "", "body": {"kind": "string", "value": "stone is worn"}, "trace_id": "tr", "span_id": None, "attributes": [kv("stone", "string", "upper")]} | changed


LOG_REQUEST = {"resource_logs": [{"resource_attributes": [kv("service.name", "string", "mill")], "scope_logs": [{"scope_name": "ear", "scope_version": None, "scope_attributes": [kv("unit", "string", "kg")], "log_records": [log_record()]}]}]}


def test_logs(spark):
    from test_fields import fnv

    df = spark.createDataFrame([(json.dumps(LOG_REQUEST),)], "body string")
    r = otlp_json.flatten_logs(otlp_json.parse_log_requests(df)).withColumn("text", field_map_text()).first()
    assert r.log_id == "log-640-" + fnv("0:0:0:640:stone is worn:tr:-") and r.severity_text == "-" and r.body == "stone is worn" and r.severity_number == 13
    assert r.text == "resource_attr:service.name=mill,instrumentation_scope.name=ear,scope_attr:unit=kg,log_attr:stone=upper"


def test_json_is_parsed_once(spark):
    """No filter on the length of the parsed array gets below the rows, where it would parse every request again."""
    df = spark.createDataFrame([(json.dumps(LOG_REQUEST),), ('{"resource_logs":[]}',), ("{}",)], "body string")
    rows = otlp_json.flatten_logs(otlp_json.parse_log_requests(df))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 and rows.count() == 1


def test_protobuf_traces_round_trip(spark):
    p = otlp_proto
    nested = p._put(5, p._put(1, p._put(1, b"x")) + p._put(1, p._put_varint(3 << 3) + p._put_varint(-3)))  # ["x", -3]
    kvl = p._put(6, p._put(1, p._put_text(1, "b") + p._put(2, p._put(7, b"\x01\xff"))) + p._put(1, p._put_text(1, "a") + p._put(2, p._put_varint(2 << 3) + b"\1")))
    attr = lambda k, v: p._put(9, p._put_text(1, k) + p._put(2, v))
    body = p._put(1, bytes(range(16))) + p._put(2, bytes(8)) + p._put(5, b"") + p._put_fixed(7, 5) + p._put_varint(8 << 3 | 1) + b"\xff" * 8 + attr("list", nested) + attr("map", kvl) + p._put(15, p._put_int(3, 2))
    scope = p._put(1, b"")
    request = p._put(1, p._put(1, p._put_kvs(1, [kv("service.name", "string", "s")])) + p._put(2, scope + p._put(2, body)))
    df = spark.createDataFrame([(bytearray(request),)], "body binary")
    r = otlp_json.flatten_traces(p.parse_trace_requests(df)).withColumn("text", field_map_text()).first()
    assert r.trace_id == bytes(range(16)).hex() and r.span_id == "0" * 16 and r.parent_span_id is None and r.name == "-"
    assert r.start_unix_nano == 5 and r.end_unix_nano == (1 << 63) - 1
    assert r.text == 'resource_attr:service.name=s,span_attr:list=["x",-3],span_attr:map={"a":true,"b":"01ff"},status_code=2,status_message=-'


texts = st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=6)
values = st.one_of(
    st.tuples(st.just("string"), texts), st.tuples(st.just("bool"), st.sampled_from(["true", "false"])), st.tuples(st.just("i64"), st.integers(-(1 << 63), (1 << 63) - 1).map(str)),
    st.tuples(st.just("f64"), st.floats(allow_nan=False).map(repr)),
)
attributes = st.lists(st.tuples(texts, values).map(lambda x: kv(x[0], *x[1])), max_size=4)
hexes = lambda n: st.binary(min_size=n, max_size=n).map(bytes.hex)
nanos = st.integers(1, (1 << 63) - 1)
status = st.one_of(st.none(), st.fixed_dictionaries({"code": st.integers(-(1 << 31), (1 << 31) - 1), "message": texts}))
spans_ = st.fixed_dictionaries({"trace_id": hexes(16), "span_id": hexes(8), "parent_span_id": st.one_of(st.none(), hexes(8)), "name": texts, "start_time_unix_nano": nanos, "end_time_unix_nano": nanos, "attributes": attributes, "status": status})
some = st.one_of(st.none(), texts.filter(bool))
records = st.fixed_dictionaries({
    "time_unix_nano": nanos, "observed_time_unix_nano": st.one_of(st.none(), nanos), "severity_number": st.one_of(st.none(), st.integers(1, 24)), "severity_text": some, "body": values.map(lambda v: kv("", *v)["value"]),
    "trace_id": st.one_of(st.none(), hexes(16)), "span_id": st.one_of(st.none(), hexes(8)), "attributes": attributes,
})


def requests(group, items, one_):
    scopes = st.fixed_dictionaries({"scope_name": some, "scope_version": some, "scope_attributes": attributes, items: st.lists(one_, max_size=3)})
    return st.lists(st.lists(st.fixed_dictionaries({"resource_attributes": attributes, group: st.lists(scopes, max_size=2)}), max_size=2), max_size=4)


@settings(max_examples=150, deadline=None)
@given(requests("scope_spans", "spans", spans_), requests("scope_logs", "log_records", records))
def test_columns_of_requests_round_trip(traces, logs):
    p = otlp_proto
    assert p.decode_traces(pa.array([p.encode_traces(x) for x in traces], pa.binary())).to_pylist() == traces
    assert p.decode_logs(pa.array([None, *[p.encode_logs(x) for x in logs]], pa.binary())).to_pylist() == [None, *logs]


def test_odd_wire_data():
    p = otlp_proto
    unknown = p._put(99, b"x") + p._put_int(98, 1 << 63) + p._put_fixed(97, 7) + p._put_varint(96 << 3 | 5) + b"abcd"
    scope = p._put(1, p._put_text(1, "first") + p._put_kvs(3, [kv("a", "string", "1")])) + unknown + p._put(1, p._put_text(2, "v") + p._put_kvs(3, [kv("b", "i64", "2")]) + p._put_text(1, "second"))
    span_ = unknown + p._put_text(5, "old") + p._put(1, b"\1") + p._put_text(5, "new") + p._put(15, p._put_int(3, 1)) + p._put(15, p._put_text(2, "last"))
    body = unknown + p._put(1, p._put(1, p._put_kvs(1, [kv("r", "bool", "true")])) + p._put(2, p._put(2, span_) + scope) + p._put(1, unknown + p._put_kvs(1, [kv("s", "f64", "0.5")])))
    (r,), none, _ = p.decode_traces(pa.array([body, None, b""], pa.binary())).to_pylist()
    s = r["scope_spans"][0]
    assert none is None and [(a["key"], a["value"]["kind"], a["value"]["value"]) for a in r["resource_attributes"]] == [("r", "bool", "true"), ("s", "f64", "0.5")]
    assert (s["scope_name"], s["scope_version"], [a["key"] for a in s["scope_attributes"]]) == ("second", "v", ["a", "b"])
    assert s["spans"][0] | {"name": "new", "trace_id": "01", "status": {"code": 0, "message": "last"}} == s["spans"][0]
    with pytest.raises(p.WireError):
        p.decode_traces(pa.array([p._put(1, p._put(2, p._put(2, p._put(5, b"\xff\xfe"))))], pa.binary()))


def test_batches_are_converted_in_bounded_pieces(spark):
    """However many and large the requests of an Arrow batch are, a worker holds the arrays of about a MB of them."""
    p, ran = otlp_proto, []

    class Frame:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, kind: ran.append(run)

    request = [{"resource_attributes": [], "scope_spans": [{"scope_name": "n", "scope_version": None, "scope_attributes": [], "spans": [one(attrs=[kv("k", "string", "v" * 100)], status=None) | {"trace_id": "ab" * 16, "span_id": "cd" * 8} for _ in range(100)]}]}]
    requests_ = pa.array([request] * 400, p._RESOURCE_SPANS)
    for make, column in ((p.to_trace_bodies, requests_), (p.parse_trace_requests, p.encode_trace_column(requests_))):
        make(Frame())
        out = list(ran.pop()(iter([pa.RecordBatch.from_arrays([column], names=["x"])])))
        assert sum(len(b) for b in out) == 400 and len(out) > 4 and max(b.nbytes for b in out) < 4 << 20
    assert pa.concat_arrays([b.column(0) for b in out]).to_pylist() == [request] * 400


def test_log_batches_are_converted_in_bounded_pieces(spark):
    """Many small requests too; counting records makes no ids."""
    p, ran = otlp_proto, []

    class Frame:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, kind: ran.append(run)

    record = {"time_unix_nano": 1, "observed_time_unix_nano": 2, "severity_number": 9, "severity_text": "INFO", "body": {"kind": "string", "value": "b" * 100}, "trace_id": "ab" * 16, "span_id": None, "attributes": []}
    request = [{"resource_attributes": [], "scope_logs": [{"scope_name": "n", "scope_version": None, "scope_attributes": [], "log_records": [record]}]}]
    column = pa.array([request] * 20_000, p._RESOURCE_LOGS)
    for make, column in ((p.to_log_bodies, column), (p.parse_log_requests, p.encode_log_column(column))):
        make(Frame())
        out = list(ran.pop()(iter([pa.RecordBatch.from_arrays([column], names=["x"])])))
        assert sum(len(b) for b in out) == 20_000 and len(out) > 3 and max(b.nbytes for b in out) < 4 << 20
    assert all(x == request for b in out for x in b.column(0).to_pylist())


def test_ids_that_nobody_reads_are_not_made(spark):
    df = spark.createDataFrame([(json.dumps(LOG_REQUEST),)], "body string")
    plan = otlp_json.flatten_logs(otlp_json.parse_log_requests(df)).groupBy("trace_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "from_json(" in plan


def test_columns_are_written_as_messages_are():
    """Absent, odd and extreme values give the same bytes as a message put together by hand."""
    p = otlp_proto
    long = [kv(f"k{i}", "string", "x" * i) for i in range(300)]
    span_ = {"trace_id": None, "span_id": "0 ff", "parent_span_id": "ABcd", "name": "", "start_time_unix_nano": -5, "end_time_unix_nano": 1 << 62, "attributes": [{"key": None, "value": None}, kv("i", "i64", "-1"), kv("f", "f64", "1e400"), kv("b", "bool", "true"), *long], "status": {"code": -1, "message": None}}
    value = [b"\x0a\x00", p._put_varint(3 << 3) + p._put_varint(-1), p._put_varint(4 << 3 | 1) + bytes(6) + b"\xf0\x7f", b"\x10\x01"]
    attributes_ = [p._put_text(1, k) + p._put(2, v) for k, v in zip([None, "i", "f", "b"], value)]
    whole = p._put(1, b"") + p._put(2, p.id_bytes("0 ff", 8)) + p._put(4, b"\xab\xcd") + p._put_fixed(8, 1 << 62) + b"".join(p._put(9, a) for a in attributes_) + p._put_kvs(9, long) + p._put(15, p._put_int(3, -1))
    request = [{"resource_attributes": None, "scope_spans": [{"scope_name": None, "scope_version": "", "scope_attributes": None, "spans": [span_]}]}, {"resource_attributes": [], "scope_spans": None}]
    want = p._put(1, p._put(1, b"") + p._put(2, p._put(2, whole))) + p._put(1, p._put(1, b""))
    column = pa.array([request, None, request, []], p._RESOURCE_SPANS)
    assert p.encode_trace_column(column).to_pylist() == [want, b"", want, b""] and p.encode_trace_column(column.slice(1, 2)).to_pylist() == [b"", want]
    back = p.decode_traces(pa.array([want])).to_pylist()[0][0]["scope_spans"][0]["spans"][0]["attributes"]
    assert back[4:] == long and [a["value"]["value"] for a in back[:4]] == ["", "-1", "inf", "true"]


def test_records_are_written_as_messages_are():
    p = otlp_proto
    record = {"time_unix_nano": 0, "observed_time_unix_nano": 9, "severity_number": 13, "severity_text": "", "body": {"kind": "i64", "value": "-7"}, "trace_id": "", "span_id": "odd one", "attributes": [kv("k", "string", "")]}
    whole = p._put_int(2, 13) + p._put(5, p._put_varint(3 << 3) + p._put_varint(-7)) + p._put_kvs(6, [kv("k", "string", "")]) + p._put(10, p.id_bytes("odd one", 8)) + p._put_fixed(11, 9)
    bare = record | {"body": None, "severity_number": None, "observed_time_unix_nano": None, "span_id": None, "attributes": None}
    scopes = [{"scope_name": "s", "scope_version": "1", "scope_attributes": [kv("a", "bool", "false")], "log_records": [record, bare]}, {"scope_name": None, "scope_version": None, "scope_attributes": [], "log_records": None}]
    want = p._put(1, p._put(1, b"") + p._put(2, p._put(1, p._put_text(1, "s") + p._put_text(2, "1") + p._put_kvs(3, [kv("a", "bool", "false")])) + p._put(2, whole) + p._put(2, b"")) + p._put(2, b""))
    assert p.encode_log_column(pa.array([[{"resource_attributes": [], "scope_logs": scopes}], None], p._RESOURCE_LOGS)).to_pylist() == [want, b""]


def test_records_do_not_carry_their_siblings(spark):
    """The rows that come of a scope hold what they share and themselves, not the scope with all of its spans."""
    df = spark.createDataFrame([(json.dumps(trace_request([one(attrs=[kv("a", "string", "b")])])),)], "body string")
    plan = otlp_json.flatten_traces(otlp_json.parse_trace_requests(df))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().apply(0)
    kinds = {a.name(): a.dataType().sql() for a in (plan.output().apply(i) for i in range(plan.output().size()))}
    assert not any("SPANS" in k.upper() or "ARRAY<STRUCT<TRACE_ID" in k.upper() for k in kinds.values()), kinds


def test_protobuf_logs_round_trip(spark):
    df = spark.createDataFrame([(json.dumps(LOG_REQUEST).replace('"tr"', '"' + "ab" * 16 + '"'),)], "body string")
    requests = otlp_json.parse_log_requests(df)
    back = otlp_proto.parse_log_requests(otlp_proto.to_log_bodies(requests))
    a, b = otlp_json.flatten_logs(requests).first(), otlp_json.flatten_logs(back).first()
    assert b.severity_text is None and a.asDict() | {"severity_text": None} == b.asDict()


def test_other_ids_become_stable_bytes():
    named = ["left", "right", "0 ff", "abc", "naïve", "ff-0"]
    assert len({otlp_proto.id_bytes(x, 16) for x in named * 2}) == len(named) and all(len(otlp_proto.id_bytes(x, n)) == n for x in named for n in (8, 16))
    assert otlp_proto.id_bytes("C0ffee", 8) == b"\xc0\xff\xee" and otlp_proto.id_bytes(None, 8) == otlp_proto.id_bytes("", 8) == b""


def test_truncated_messages_fail():
    for bad in (b"\x0a\x05ab", b"\x09\x00", b"\xff" * 11, b"\x0b"):
        with pytest.raises(otlp_proto.WireError):
            otlp_proto.decode_traces(pa.array([b"", bad], pa.binary()))


def test_grpc_frame(spark):
    ok = bytes([0, 0, 0, 0, 3]) + b"abc"
    df = spark.createDataFrame([(bytearray(ok),)], "b binary").select(otlp_proto.unframe_grpc(F.col("b")).alias("m"))
    assert bytes(df.first().m) == b"abc"
    for bad in (bytes([1, 0, 0, 0, 3]) + b"abc", bytes([0, 0, 0, 0, 4]) + b"abc", b"\0\0"):
        with pytest.raises(Exception, match="gRPC"):
            spark.createDataFrame([(bytearray(bad),)], "b binary").select(otlp_proto.unframe_grpc(F.col("b"))).collect()


def test_export_groups_and_leaves_out_dashes(spark):
    f = [svc("a"), ("instrumentation_scope.name", "-"), ("scope_attr:z", "1"), ("span_attr:b", "2"), ("span_attr:a", "1"), ("status_code", "x"), ("status_message", "-")]
    df = spans_df(spark, [span("t", "s2", start=2, end=5, fields=f), span("t", "s1", start=1, end=3, fields=f), span("t", "s3", end=9, fields=[svc("b"), ("status_code", "2")])])
    r = export.export_requests(df).first().resource_spans
    assert [[s.span_id for s in x.scope_spans[0].spans] for x in r] == [["s1", "s2"], ["s3"]]
    assert r[0].scope_spans[0].scope_name is None and [a.key for a in r[0].scope_spans[0].spans[0].attributes] == ["a", "b"] and r[0].scope_spans[0].spans[0].status is None
    assert r[1].scope_spans[0].spans[0].status.code == 2


def test_responses_and_log_spans(spark):
    df = spans_df(spark, [span("t", "s", fields=[("k", "1"), ("j", "2"), ("k", "3")])])
    assert json.loads(export.trace_json(df).first().json)["fields"] == {"j": "2", "k": "3"}
    logs = logs_df(spark, [log("l1", 5, fields=[("b", "1"), ("a", "2")], trace="t", observed=6), log("l2", 7, severity=None, number=None)])
    back = {r.log_id: r for r in export.span_to_log(export.log_to_span(logs)).collect()}
    assert back["l1"].observed_time_unix_nano == 6 and back["l1"].trace_id == "t" and [f.name for f in back["l1"].fields] == ["a", "b"] and back["l2"].severity_text is None
    assert export.span_to_log(df).count() == 0
