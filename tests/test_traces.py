from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import span, spans_df, svc
from tracelake.engine import TraceEngine
from tracelake.operators import traces as T
from tracelake.request import FieldFilter, TraceSearch


def ids(df):
    return [r.trace_id for r in df.collect()]


def test_get_trace_by_end(spark):
    df = spans_df(spark, [span("boat", f"leg{i}", start=i, end=e) for i, e in enumerate([40, 12, 33, 12, 7])] + [span("car", "leg0")])
    assert [r.span_id for r in T.get_trace(df, "boat").collect()] == ["leg4", "leg1", "leg3", "leg2", "leg0"] and T.get_trace(df, "plane").count() == 0


def test_search_ranges_filters_and_limits(spark):
    """Nine one-span traces r0..r8 over [10 i, 10 i + 4]; colours and shapes in turns."""
    colour, shape = ["red", "blue", "green"], ["disc", "cube"]
    df = spans_df(spark, [span(f"r{i}", "s", shape[i % 2], 10 * i, 10 * i + 4, [svc(colour[i % 3]), ("span_attr:n", str(i // 3))]) for i in range(9)])
    find = lambda **k: ids(T.search_traces(df, TraceSearch(**k)))
    assert sorted(find(limit=None)) == [f"r{i}" for i in range(9)] and find(limit=2) == ["r8", "r7"] and find(limit=0) == []
    assert find(service_name="blue") == ["r7", "r4", "r1"] and find(service_name="blue", operation_name="disc") == ["r4"]
    # both ends of the range belong to it
    assert find(start_unix_nano=34, end_unix_nano=50) == ["r5", "r4", "r3"] and find(start_unix_nano=35, end_unix_nano=49) == ["r4"] and find(start_unix_nano=45, end_unix_nano=49) == []
    assert find(field_filters=(FieldFilter("span_attr:n", "2"),), operation_name="cube") == ["r7"]
    assert find(field_filters=(FieldFilter("span_attr:n", "2"), FieldFilter("span_attr:n", "1"))) == []
    # no service, and names that the search index doesn't hold
    assert find(service_name="-") == find(service_name="") == find(field_filters=(FieldFilter("name", "cube"),)) == find(field_filters=(FieldFilter("duration", "4"),)) == []


def test_predicates_hold_on_different_spans(spark):
    df = spans_df(spark, [span("t", "a", "load", fields=[svc("dock")]), span("t", "b", "sail", fields=[svc("ship"), ("wind.knots", "17")])])
    req = TraceSearch(service_name="dock", operation_name="sail", field_filters=(FieldFilter("wind.knots", "17"),))
    assert ids(T.search_traces(df, req)) == ["t"] and T.matching_traces(df, req, same_row=True).count() == 0
    assert T.search_traces(df, req).first().services == ["dock", "ship"]


def test_lists(spark):
    df = spans_df(spark, [span("t", "a", "", fields=[svc("-"), svc("x"), ("k", "-"), ("k", ""), ("", "v")]), span("u", "b", "op", fields=[svc("x")])])
    e = TraceEngine(spark, df)
    assert sorted(r[0] for r in e.list_services().collect()) == ["x"]
    assert sorted(r[0] for r in e.list_field_names().collect()) == ["k", "resource_attr:service.name"]
    assert [r[0] for r in e.list_field_values("k").collect()] == ["-"] and e.list_field_values("_time").count() == 0
    assert sorted(r[0] for r in T.operations_of(df, "x").collect()) == ["op"] and tuple(e.stats().first()) == (2, 2)


def test_encodings_keep_text(spark):
    df = spans_df(spark, [span("t", "a", fields=[("b", "TRUE"), ("i", "007"), ("s", "x"), ("m", "1")]), span("t", "b", fields=[("b", "false"), ("i", "-1"), ("m", "x")])])
    assert {r.name: r.encoding for r in T.field_encodings(df).collect()} == {"b": "bool", "i": "i64", "s": "string", "m": "string"}


def test_empty_relation(spark):
    df = spans_df(spark, [])
    assert T.search_traces(df, TraceSearch()).count() == T.list_services(df).count() == 0 and tuple(T.storage_stats(df).first()) == (0, 0)


names, values = st.sampled_from(["resource_attr:service.name", "k", "status_code"]), st.sampled_from(["a", "b", "-", ""])
rows = st.lists(st.tuples(st.sampled_from("tuv"), st.sampled_from(["x", "y", ""]), st.integers(0, 20), st.integers(0, 10), st.lists(st.tuples(names, values), max_size=3)), max_size=8)
reqs = st.builds(TraceSearch, st.integers(0, 15), st.integers(10, 30), st.sampled_from([None, "a", "b", "-"]), st.sampled_from([None, "x", ""]), st.lists(st.builds(FieldFilter, names, st.sampled_from("ab")), max_size=2).map(tuple), st.sampled_from([None, 1, 2]))


def model(data, req):
    """The search in plain Python."""
    out = []
    for t in {d[0] for d in data}:
        mine = [d for d in data if d[0] == t]
        services = {v for d in mine for n, v in d[4] if n == "resource_attr:service.name" and v not in ("", "-")}
        s, e = min(d[2] for d in mine), max(d[2] + d[3] for d in mine)
        ok = e >= req.start_unix_nano and s <= req.end_unix_nano and (req.service_name is None or req.service_name in services) and (req.operation_name is None or any(d[1] == req.operation_name for d in mine))
        if ok and all(any((f.name, f.value) in d[4] for d in mine) for f in req.field_filters):
            out.append((t, s, e, sorted(services)))
    out.sort(key=lambda x: (-x[2], x[0]))
    return out if req.limit is None else out[: req.limit]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, req=reqs)
def test_search_equals_model_and_index(spark, data, req):
    df = spans_df(spark, [span(t, f"s{i}", n, s, s + w, f) for i, (t, n, s, w, f) in enumerate(data)])
    for got in (T.search_traces(df, req), T.search_index(T.trace_index(df), req)):
        assert sorted(((r.trace_id, r.start_unix_nano, r.end_unix_nano, r.services) for r in got.collect()), key=lambda x: (-x[2], x[0])) == model(data, req)
