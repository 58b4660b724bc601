"""Decontamination against a brute-force window search."""

import hashlib
import random
import re

from tracelake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found, full = words(t), set(), set(), set()
        for item, x in items:
            iw = words(x)
            k = min(window, len(iw))
            wins = {tuple(iw[p : p + k]) for p in range(len(iw) - k + 1)} if iw else set()
            for p in range(len(w) - k + 1 if k else 0):
                if tuple(w[p : p + k]) in wins:
                    hit.update(range(p, p + k))
                    found.add(None if item is None else str(item))
                    full.update([p] if k == window else [])
        sha = hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w), len(full)))
    return out


def case(seed):
    r = random.Random(seed)
    text = lambda n, v="abcdefgé": " ".join(r.choice(v) + r.choice(["", ".", "X", "1"]) for _ in range(n))
    items = [(i, text(r.randint(1, 12))) for i in range(12)] + [(100, None), (101, ""), (102, "..."), (103, "a b"), (103, "c d e f g a b"), (None, text(9)), (None, "d e")]
    docs = [(i, text(r.randint(0, 60)) + " " + (r.choice(items)[1] or "") + "-" + text(r.randint(0, 9), "zq")) for i in range(40)]
    return [*docs, (40, None), (41, ""), (42, "!!"), (43, "q z " * 30000), (0, docs[1][1]), (None, docs[2][1])], items


def key(x):
    return tuple((v is None, v) for v in x)


def test_against_brute_force(spark):
    for seed in range(2):
        docs, items = case(seed)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), b, window=4).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, 4), key=key)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x A b, c d e y a b c z c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q a b c d e r")], "item_id long, text string")
    got = sorted(tuple(r) for r in D.longest_matches(docs, items, window=3).collect())
    assert got == [(1, "7", 1, 1, 5), (1, "7", 1, 7, 3), (1, "7", 3, 11, 3)]


def test_many_blocks_equal_one(spark, monkeypatch):
    docs, items = case(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contamination(d, b, window=4).collect()), key=key)
    monkeypatch.setattr(D, "BLOCK_BYTES", 30)
    assert sorted(map(tuple, D.contamination(d, b, window=4).collect()), key=key) == one


def test_any_window(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, long + " a b c d"), (2, long + " x y"), (3, "x y z"), (4, long + " a b c"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "q a b c d"), (2, "x y"), (None, "n o p q")], "item_id long, text string")
    left = lambda **o: sorted(r.doc_id for r in D.decontaminate(docs, items, window=4, **o).collect())
    assert left() == [1, 2, 4, 5] and left(any_window=True) == [2, 4, 5]


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "z z z", 6, None)], "doc_id long, text string, n_hit int, `c0` string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "z z z", 6, None)]
    assert D.decontaminate(docs, D.empty_benchmark(spark)).count() == 2 and D.decontaminate(docs.limit(0), items).count() == 0
