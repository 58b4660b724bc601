"""Exact top-k against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import topk
from tracelake.llm.topk import exact_topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, every, k):
    good = [(i, tuple(v), [math.floor(256.0 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, _, qv in {(i, v): (i, v, w) for i, v, w in good if i % every == 0}.values():
        found = sorted((-sum(a * b for a, b in zip(qv, w)), i) for i, _, w in good if i != q and len(w) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    f32 = lambda x: float(memoryview(bytearray(__import__("struct").pack("<f", x))).cast("f")[0])
    rows = [(i, [f32(r.gauss(0, 1) * (1 + i % 7)) for _ in range(12)], 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(20)]  # ties
    rows += [(2000, None, 0), (2001, [], 0), (2002, [1.0, None] + [0.0] * 10, 0), (2003, [float("nan")] * 12, 0), (2004, [float("inf")] * 12, 0), (None, rows[0][1], 0), (2050, [1.0, 2.0], 0), (2051, [1.0, 3.0], 0), rows[9], rows[50]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(x) for x in exact_topk(df, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(brute(rows, 50, 5))


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert exact_topk(one, F.col("vec_id") == 0).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk(none, F.lit(True)).collect() == []
    two = spark.createDataFrame([(0, [1.0], 1), (1, [-3.0], 1)], SCHEMA)
    assert [tuple(r) for r in exact_topk(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * -768)]
    huge = spark.createDataFrame([(0, [1e10, 1.0], 1), (1, [1e3, 1.0], 1), (2, [1e3, 2.0], 1)], "vec_id long, embedding array<double>, rank int")
    got = exact_topk(huge, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in got] == [2, 1]


def test_every_row_doubled(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randint(-8, 8)) for _ in range(6)], 0) for i in range(120)] + [(7, [1.0] * 6, 0), (7, [2.0, 0.0] * 3, 0), (20, [3.0] * 6, 0)]
    rows = [x for x in rows for _ in range(2)] + [(5, [9.0] * 6, 0)] * 9
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 4):
        got = sorted(tuple(x) for x in exact_topk(df.repartition(parts), F.col("vec_id") % 20 == 0).collect())
        assert got == sorted(brute(rows, 20, 5)) and len(got) == 35


def test_repeats_do_not_push_others_out(spark):
    rows = [(50, [1.0], 0)] + [(1, [3.0], 0)] * 6 + [(i, [2.0], 0) for i in range(2, 9)]
    got = [tuple(x) for x in exact_topk(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.col("vec_id") % 50 == 0, k=7).orderBy("rank").collect()]
    assert got == brute(rows, 50, 7) and [x[2] for x in got] == [1] * 6 + [2]


def test_blocks_of_queries(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], 0) for i in range(200)]
    monkeypatch.setattr(topk, "BLOCK_BYTES", 100)
    monkeypatch.setattr(topk, "PAIRS", 64)
    got = sorted(tuple(x) for x in exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3), F.col("vec_id") % 20 == 0).collect())
    assert got == sorted(brute(rows, 20, 5))


def test_scores_of_63_bits(spark):
    x = float(1 << 23)  # 2**31 after scaling
    rows = [(0, [x, x * 0.75], 0), (1, [x, x * 0.5], 0), (2, [x, x * 0.5 - 1], 0), (3, [x, x], 0), (4, [-x, -x], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in exact_topk(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [y for y in brute(rows, 1 << 40, 5) if y[0] == 0] and got[0][3] > 1 << 62
    over = spark.createDataFrame([(0, [x * 2, x * 2], 0), (1, [x * 2, x * 2], 0)], "vec_id long, embedding array<double>, rank int")
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        exact_topk(over, F.col("vec_id") == 0).collect()
