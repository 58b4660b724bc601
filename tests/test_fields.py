import pyarrow as pa
from pyspark.sql import functions as F

from helpers import spans_df, span, svc
from tracelake.functions import fields as X


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_fnv(spark):
    texts = ["", "a", "foobar", "é", "日本語" * 20, "x" * 500]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.fnv1a64(F.col("t"))).collect()]
    assert got == [fnv(t) for t in texts]


def test_fnv_goes_by_columns(spark):
    """The hash is no lambda over the bytes of a row; nulls, a slice and few long texts among short ones give the plain loop's digits."""
    texts = [None, "", *[f"{i}é" * (i % 7) for i in range(40)], "y" * 5000, "z" * 3000]
    for some in (pa.array(texts), pa.array(texts).slice(35), pa.array(texts[:1])):
        assert X._fnv1a64(some).to_pylist() == [fnv(t or "") for t in some.to_pylist()]
    plan = spark.createDataFrame([("a",)], "t string").select(X.fnv1a64(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan, plan


def test_float_text(spark):
    cases = {"1.0": "1", "1e20": "100000000000000000000", "0.1": "0.1", "-2.5e-7": "-0.00000025", "1.5e3": "1500", "123456789.125": "123456789.125", "1.25e10": "12500000000", "0": "0", "1.2345678912e7": "12345678.912", "NaN": "NaN"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.float_text(F.col("t").cast("double")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_usual_numbers_need_no_patterns(spark):
    """Plain digits come of cuts, the exponent's part only where there is one; the value is what Python's decimals spell."""
    from decimal import Decimal

    numbers = [0.0, -0.0, 1.0, -3.5, 0.001, 9999999.0, 1e7, -1e7, 12345678.9, 9.99e-4, -1e-3, 1.5e-300, 1.7976931348623157e308, -2.2250738585072014e-308, 1e22, 123456789012345.67]
    df = spark.createDataFrame([(x,) for x in numbers], "d double").select("d", X.float_text(F.col("d")).alias("t"), X.flat_value(F.struct(F.lit("f64").alias("kind"), F.col("d").cast("string").alias("value"))).alias("v"))
    for r in df.collect():
        plain = f"{Decimal(repr(r.d)):f}"
        assert r.t == r.v == (plain.rstrip("0").rstrip(".") if "." in plain else plain), r
    odd = spark.createDataFrame([("inf",), ("-Infinity",), ("NaN",), ("1_0",), (None,)], "t string").select(X.flat_value(F.struct(F.lit("f64").alias("kind"), F.col("t").alias("value"))))
    assert [r[0] for r in odd.collect()] == ["inf", "-inf", "NaN", "1_0", ""]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_multi_map_rules(spark):
    df = spans_df(spark, [span("t", "s", fields=[("z", "1"), svc(""), svc("a"), ("k", "x"), ("k", "y"), svc("b"), ("_time", "9")])])
    r = X.promote(df).select(X.first_value("k").alias("first"), X.has_field("k", "y").alias("any"), X.first_value("none").alias("none"), "services", "service_name", X.sort_fields(F.col("fields")).alias("s"), X.strip_reserved(F.col("fields")).alias("r")).first()
    assert (r["first"], r["any"], r["none"], r["services"], r["service_name"]) == ("x", True, None, ["a", "b"], "a")
    assert [f.name for f in r["s"]] == sorted(f[0] for f in [("z",), ("resource_attr:service.name",), ("resource_attr:service.name",), ("k",), ("k",), ("resource_attr:service.name",), ("_time",)])
    assert [f.value for f in r["s"] if f.name == "k"] == ["x", "y"] and "_time" not in [f.name for f in r["r"]]


def test_span_ids(spark):
    ids = ["ABCDEF0123456789", "ABC", None, "GBCDEF0123456789"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(X.canonical_span_id(F.col("i"))).collect()]
    assert got == ["abcdef0123456789", "ABC", None, "GBCDEF0123456789"]


def test_virtual_fields(spark):
    df = spans_df(spark, [span("trace-1", "span-1", "checkout", 1000, 1250, parent="parent-1")])
    r = df.select(*[X.span_value(n).alias(n) for n in ("_time", "name", "duration", "parent_span_id")]).first()
    assert tuple(r) == ("1250", "checkout", "250", "parent-1")


