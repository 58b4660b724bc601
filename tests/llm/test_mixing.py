"""Targets, the cube method's invariants, and mixes of small tables."""

import numpy as np
import pytest

from tracelake.llm import mixing as M


def test_targets_fill_up():
    got = M.targets([("b", 100), (None, 1000), ("a", 10)])
    assert got["a"] == 30.0 and got["b"] == pytest.approx(300.0) and got[None] == pytest.approx(1110 - 330)
    assert M.targets([]) == {} and M.targets([("x", 0)]) == {"x": 0.0}
    even = M.targets([("a", 800), ("b", 800), ("c", 800)])
    assert [round(even[k], 6) for k in "abc"] == [1500.0, 600.0, 300.0]


def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    for size in (r.integers(1, 500, 300), np.full(50, 7), np.array([5, 5, 9])):
        p = np.full(len(size), 0.37)
        q = M.flight(p, size, np.random.default_rng(2))
        assert ((q > 0) & (q < 1)).sum() <= 2 and q.min() >= 0 and q.max() <= 1
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6 * size.sum() and abs(q.sum() - p.sum()) < 1e-6 * len(size)


def test_flight_is_unbiased():
    size = np.array([3, 8, 1, 20, 5, 9, 2, 7])
    mean = np.mean([M.flight(np.full(8, 0.4), size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.04


def test_mix(spark):
    r = np.random.default_rng(3)
    rows = [(i, ["hot", "b", "c", "d"][0 if i % 3 else i % 4], " ".join(["w"] * int(r.integers(1, 60))), i % 5) for i in range(900)]
    rows += [(2000, None, "a b c", 1), (2001, "b", None, 1), (2002, "empty", "", 1), (None, "c", "x y", 2), (5, rows[5][1], rows[5][2], 0), (5, rows[5][1], rows[5][2], 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = M.mix_sources(df.repartition(4)).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.size) for x in got} == {(i, len((t or "").split())) for i, _, t, _ in rows}
    total = sum(x.size for x in got)
    assert sum(x.taken for x in got) == pytest.approx(total, rel=0.01)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        by.setdefault((x.source_size, x.target), []).append(x.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(3, 0.02 * target)
    order = lambda q: sorted(((x.doc_id or -1), x.size, x.taken) for x in q)
    assert order(M.mix_sources(df.repartition(7)).collect()) == order(got)
    kept = M.mix_sources(df, keep=df.columns)
    assert order(kept.collect()) == order(got) and set(kept.columns) >= {"text", "source", "taken"}


def test_a_row_that_repeats_often(spark):
    """A third of all rows is one row: its copies are taken in whole numbers and each row keeps its own columns."""
    rows = [(7, "s", "a b c d e", i) for i in range(300)] + [(1000 + i, "s" if i % 2 else "t", " ".join(["w"] * (1 + i % 23)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, note int")
    got = M.mix_sources(df.repartition(5), keep=df.columns).collect()
    assert sorted(x.note for x in got) == sorted(r[3] for r in rows)
    copies = sorted(x.taken // 5 for x in got if x.doc_id == 7)
    each = next(x.target / x.source_size for x in got if x.doc_id == 7)
    assert abs(sum(copies) - 300 * each) < 1 and copies[-1] - copies[0] <= 1
    for t in {x.target for x in got}:
        assert abs(sum(x.taken for x in got if x.target == t) - t) <= 25
    order = lambda q: sorted((x.doc_id, x.size, x.taken) for x in q)
    assert order(M.mix_sources(df.repartition(2)).collect()) == order(got)


def test_targets_of_many_sources_by_rounds(spark):
    r = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 7 else f"s{i % 37}", " ".join(["w"] * int(r.integers(0, 2 + (i % 37) ** 2)))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    plain, wide = ({x.doc_id: (x.size, x.source_size, x.target, x.taken) for x in M.mix_sources(df, held_sources=k).collect()} for k in (1000, 3))
    assert plain.keys() == wide.keys()
    assert all(plain[i][:2] == wide[i][:2] and plain[i][2] == pytest.approx(wide[i][2], rel=1e-9) for i in plain)


def test_small_blocks_meet_again(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "FAN", 4)
    rows = [(i, "s" if i % 2 else "t", " ".join(["w"] * (1 + i % 23))) for i in range(600)]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for t in {x.target for x in got}:
        assert abs(sum(x.taken for x in got if x.target == t) - t) <= 25


def test_empty(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
