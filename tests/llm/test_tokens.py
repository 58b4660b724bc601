"""Token counts: round trips and an allocation by brute force."""

import random

import numpy as np
import pytest

from tracelake.llm import tokens as T

TEXTS = ["Hello wörld\nsecond line\n\nlast", "", None, "\n", "a\n", "日本語テキスト\n🎉🎉 done", "x" * 30000, "  spaces  \t\n  more"]


def test_lines_round_trip(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "k")], "doc_id long, text string, name string")
    rows = T.token_counts(df).collect()
    with open(T.DEFAULT_TOKENIZER, "rb") as f:
        enc, size = T._encoder(f.read(), T.PATTERN)
    for i, t in enumerate(TEXTS):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)[:: 2 if i == 0 else 1]
        ids = enc.encode_ordinary(t or "")
        assert enc.decode(ids) == (t or "") and {r.doc_tokens for r in mine} == {len(ids)} and sum(r.n_tokens for r in mine) == len(ids)
        assert "".join((t or "")[r.start : r.end] for r in mine) == (t or "") and int(size[ids].sum()) == len((t or "").encode())


def spread(spans, secs, rule):
    total = [0.0] * len(secs)
    for a, z in spans:
        part = [max(0, min(z, e) - max(a, s)) for s, e in secs]
        if rule == "share":
            total = [x + p / (z - a) for x, p in zip(total, part)]
        elif rule == "majority" and max(part, default=0):
            total[part.index(max(part))] += 1
        elif rule in ("start", "end"):
            at = a if rule == "start" else z - 1
            for i, (s, e) in enumerate(secs):
                total[i] += s <= at < e
    return total


@pytest.mark.parametrize("rule", T.RULES)
def test_allocation_equals_brute_force(rule):
    r = random.Random(4)
    for _ in range(300):
        cuts = sorted(r.sample(range(1, 60), r.randint(0, 20)))
        spans = list(zip([0, *cuts], [*cuts, 60]))
        edges = sorted(r.sample(range(61), 2 * r.randint(0, 5)))
        secs = list(zip(edges[::2], edges[1::2]))
        got, _ = T.allocate(*(np.array(x, np.int64) for x in zip(*spans)), np.array([s for s, _ in secs], np.int64), np.array([e for _, e in secs], np.int64), rule)
        assert got.tolist() == pytest.approx(spread(spans, secs, rule))


def test_given_sections_cut_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", [("a", 0, 2), ("b", 2, 11)]), (2, "Hello", None)], "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>")
    got = {r.name: (r.n_tokens, r.n_crossing) for r in T.token_counts(df, sections_col="parts").collect()}
    assert got == {"a": (0.0, 1), "b": (2.0, 1)}
    share = {r.name: r.n_tokens for r in T.token_counts(df, sections_col="parts", rule="share").collect()}
    assert share == {"a": pytest.approx(0.4), "b": pytest.approx(1.6)}
    with pytest.raises(ValueError):
        T.token_counts(df, rule="x")
    assert T.token_counts(df.limit(0)).count() == 0


def test_odd_sections(spark):
    kind = "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>"
    odd = [("late", 6, 11), ("none", None, 3), ("early", 0, 6), ("back", 5, 2), ("far", 50, 60), None]
    got = T.token_counts(spark.createDataFrame([(1, "Hello world", odd)], kind), sections_col="parts", rule="start").orderBy("section").collect()
    assert [(r.name, r.n_tokens) for r in got] == [("late", 0.0), ("none", 0.0), ("early", 2.0), ("back", 0.0), ("far", 0.0), (None, 0.0)]
    with pytest.raises(Exception, match="sections overlap"):
        T.token_counts(spark.createDataFrame([(1, "Hello world", [("a", 0, 5), ("b", 4, 9)])], kind), sections_col="parts").collect()
