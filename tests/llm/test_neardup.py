"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np

from tracelake.llm import neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets]


def case(seed, groups=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                x = r.randrange(len(w))
                w[x : x + r.randint(0, 2)] = [word()] * r.randint(0, 2)
                w = w or ["x"]
            rows.append((len(rows), " ".join(w)))
    rows += [(n + len(rows), t) for n, t in enumerate([None, "", " \t ", "one", "ONE", "a b", "a  b", "b a", rows[0][1].upper(), "long " * 9000])]
    rows += [(rows[3][0], rows[20][1] if len(rows) > 20 else "x"), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    r.shuffle(rows)
    return rows


def key(x):
    return tuple((v is None, v) for v in x)


def test_against_brute_force(spark):
    for seed in range(2):
        rows = case(seed)
        df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, n string").repartition(3)
        got = [tuple(x) for x in N.near_duplicate_groups(df, shingle=3).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, 3), key=key)


def test_one_large_group_of_near_copies(spark):
    """Many copies of one text with few and with many edits: the second pivot and the rare shingles decide."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"v{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = [tuple(x) for x in N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3).collect()]
    assert sorted(got) == sorted(brute(rows, 3))


def test_ids_that_are_texts(spark):
    rows = [("b2", "a b c d e f g"), ("b10", "A b c d e f g"), ("x", "other words are here"), (None, "a b c d e f g"), ("y", None)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicate_groups(spark.createDataFrame(rows, "doc_id string, text string"), shingle=3).collect()}
    assert got == {"b2": (5, "b10", False), "b10": (5, "b10", True), "x": (2, "x", True), None: (5, None, False), "y": (0, "y", True)}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for n, both in ((50, 40), (1000, 900)):
        got = []
        for _ in range(20):
            u = r.integers(0, 2**63, size=2 * n - both).astype(np.uint64)
            s = N.superminhash(np.r_[u[:n], u[n - both :]], np.array([0, n, 2 * n]), 256)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - both / (2 * n - both)) < 0.02
    assert (N.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 8) == N._EMPTY).all()


def test_drop_keeps_columns(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words here", None), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert N.near_duplicate_groups(df.limit(0)).count() == 0
