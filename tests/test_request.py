import pytest

from tracelake.request import BadRequest, FieldFilter, jaeger_search, native_search, parse_field_filter, parse_tags, parse_traceql, saturating, tag_to_field, tempo_search
from tracelake.schema import MAX_LONG


def test_field_filter():
    assert parse_field_filter(" a = b=c ") == FieldFilter("a", "b=c")
    for bad in ("a", "=b", "a=", " = "):
        with pytest.raises(BadRequest):
            parse_field_filter(bad)


def test_traceql():
    got = parse_traceql('{resource.service.name="checkout" && span.http.method="POST" && .x=1 && status=2}')
    assert [(f.name, f.value) for f in got] == [("resource_attr:service.name", "checkout"), ("span_attr:http.method", "POST"), ("span_attr:x", "1"), ("status_code", "2")]
    assert parse_traceql("{}") == parse_traceql("{ }") == ()
    with pytest.raises(BadRequest):
        parse_traceql("{a > 1}")


def test_traceql_reads_other_operators_as_text():
    assert parse_traceql('{a!="b"}')[0] == FieldFilter("span_attr:a!", "b")


def test_tags():
    assert parse_tags('service.name=Pay  name="x"') == (("resource_attr:service.name", "Pay"), ("name", "x"))
    for bad in ("a", "a=", 'a=""'):
        with pytest.raises(BadRequest):
            parse_tags(bad)


def test_tag_names():
    assert tag_to_field("trace:rootName") == "name" and tag_to_field("traceDuration") == "duration"
    assert tag_to_field("status.message") == "status_message" and tag_to_field("other") == "span_attr:other"


def test_units_and_limits():
    assert saturating(None, 1000, 7) == 7 and saturating(MAX_LONG, 1000, 0) == MAX_LONG and saturating(-MAX_LONG, 1000, 0) == -MAX_LONG - 1
    assert native_search().limit == 20 and native_search(limit=0).limit == 0
    j = jaeger_search("s", start=50, end=200)
    assert (j.start_unix_nano, j.end_unix_nano, j.limit) == (50_000, 200_000, 20)
    with pytest.raises(BadRequest):
        jaeger_search("")
    with pytest.raises(BadRequest):
        jaeger_search("s", limit=1001)
    t = tempo_search(q="{}", tags="a=b", start=1, end=2)
    assert t.substrings == () and t.search.start_unix_nano == 1_000_000_000 and t.limit == 20
    assert tempo_search(q=" ", tags="a=b").substrings == (("span_attr:a", "b"),)
