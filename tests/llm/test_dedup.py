"""Suffix-array dedup against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

from test_pipeline import cut as cut_words

from tracelake.llm.dedup import remove_repeats

WINDOW = 40


def brute(rows, window=WINDOW):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def case(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéü ") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        t = "".join(parts)
        if r.random() < 0.3 and rows:
            t = r.choice(rows)[1] or ""
            for _ in range(r.randint(0, 3)):
                if t:
                    x = r.randrange(len(t))
                    t = t[:x] + word() + t[x + 1 :]
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "x" * 39), (63, "y" * 300), (64, "ab" * 100), (65, rows[0][1]), (65, rows[1][1]), (None, rows[2][1]), (None, None)]
    return rows


def key(x):
    return tuple((v is None, v) for v in x)


def test_digest_equals_brute_force(spark):
    for seed in range(2):
        rows = case(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(x) for x in remove_repeats(df, WINDOW, digest=True).collect()]
        assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_word_runs(spark):
    rows = [(i, t, len(t or "")) for i, t in case(5)]
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 65], "doc_id long, text string, n long").repartition(3)
    want = {x[0]: x[1] for x in cut_words([(*r, None, None) for r in rows if r[0] is not None and r[0] != 65], 6)}
    got = {r.doc_id: r.text for r in remove_repeats(df, 6, unit="words").collect()}
    assert {i: t for i, t in got.items() if t and t.strip(" ")} == {i: t for i, t in want.items() if t}
    noted = {r.doc_id: (r.n_removed, r.repeats_passage) for r in remove_repeats(df, WINDOW, digest=True, note_words=6).collect()}
    assert {i for i, (_, x) in noted.items() if x} == {i for i, t, _ in rows if i in got and got[i] != t}
    assert {i: n for i, (n, _) in noted.items()} == {x[0]: x[2] for x in brute([r[:2] for r in rows if r[0] is not None and r[0] != 65])}


def test_texts_stay_valid_and_columns_stay(spark):
    rows = [(1, "é" * 60 + "a", "k", 1), (2, "é" * 60 + "b", "l", 2), (3, None, None, 3), (4, "clean text", "m", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, k1 int")
    got = {r.doc_id: r for r in remove_repeats(df, WINDOW).collect()}
    assert remove_repeats(df, WINDOW).columns == df.columns
    assert got[1].text == "a" and got[2].text == "b" and got[3].text is None and got[4].text == "clean text"
    assert got[1].spans == "k" and got[4].k1 == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df, WINDOW, digest=True).count() == 0
    assert remove_repeats(df, WINDOW).columns == ["doc_id", "text"]
