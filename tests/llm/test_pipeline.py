"""The pipeline against a brute-force version of its stages, and its stages on odd input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from test_decontaminate import brute as windows_hit
from test_neardup import brute as groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(11)
    vocabulary = {"en": "the of and to in is that for with on was are thing other", "fr": "le la les des et une que pour dans est avec étre plus très"}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang].split()) + r.choice(["", "", "er", "on", str(r.randrange(9))]) for _ in range(n))
    passage, leak = text("en", 90), text("en", 30)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        t = text(lang, r.randint(30, 120))
        if i % 10 == 1:
            t = t + " " + passage + " " + text(lang, 25)
        if i % 15 == 2:
            t = leak + " " + t
        if i % 20 == 9:
            t = text(lang, 900) + " " + " ".join(leak.split()[8:24]) + " " + t
        rows.append((i, t, lang, f"s{i % 2}", len(t)))
    rows += [(60 + i, rows[i][1] + " end", rows[i][2], "s0", len(rows[i][1]) + 4) for i in range(0, 10, 3)]
    rows += [(80, None, None, None, None), (81, "", "en", "s1", 0), (82, "123 !!", "en", "s1", 6), (83, passage, "en", "s1", len(passage))]
    return rows, [(1, leak), (2, None)]


def cut(rows, window):
    """Passages out, brute force: from the first byte of a repeated run of words to its last."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", x[1] or "")] for x in rows]
    runs = [[tuple(x[1][a:z] for a, z in s[i : i + window]) for i in range(len(s) - window + 1)] for x, s in zip(rows, spans)]
    count = Counter(w for r in runs for w in r)
    out = []
    for x, s, r in zip(rows, spans, runs):
        gone = [False] * len(x[1] or "")
        for i, w in enumerate(r):
            if count[w] > 1:
                a, z = s[i][0], s[i + window - 1][1]
                gone[a:z] = [True] * (z - a)
        if not any(gone):
            out.append(x)
            continue
        t = "".join(c for c, g in zip(x[1], gone) if not g)
        if t.strip(" "):
            out.append((x[0], t, x[2], x[3], len(t)))
    return out


@pytest.fixture
def sf_dir(spark, tmp_path):
    docs, items = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_equals_brute_force(spark, sf_dir):
    rows, items = documents()
    want = [[x for x in rows if x[1] and any(c.isalpha() for c in x[1])]]
    kept = {i for i, _, _, k in groups([x[:2] for x in want[0]], 5) if k}
    want.append([x for x in want[0] if x[0] in kept])
    want.append(cut(want[1], 49))
    clean = {x[0] for x in windows_hit([x[:2] for x in want[2]], items, 13) if not x[5] and not x[6]}
    assert any(x[6] and not x[5] for x in windows_hit([x[:2] for x in want[2]], items, 13))  # a leak within a long document
    want.append([x for x in want[2] if x[0] in clean])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        docs = P.write_shared(stage(spark, docs, sf_dir), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(map(tuple, docs.collect())) == sorted(want[i]), name
    assert len(want[3]) < len(want[2]) < len(want[1]) < len(want[0]) or len(want[2]) <= len(want[1])
    size = {x[0]: len(x[1].split()) for x in want[3]}
    mix = P.run(spark, sf_dir).collect()
    assert {r.doc_id for r in mix} <= set(size) and all(0 < r.taken <= 3 * size[r.doc_id] and r.taken % r.size == 0 for r in mix)
    for t in {r.target for r in mix}:
        assert abs(sum(r.taken for r in mix if r.target == t) - t) <= 0.1 * t


def test_stages_on_odd_tables(spark, sf_dir):
    odd = [(None, None, None, None, None, 1, "x"), (1, "", "en", None, 0, None, None), (1, "word", None, "s", 4, 2, "y"), (2, "long " * 20000, "en", "s", 1, 2, "z"), (2, "long " * 20000, "en", "s", 1, 2, "z")]
    df = spark.createDataFrame(odd, SCHEMA + ", score int, lang_pred string")
    for table in (df, df.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == P.STAGES[-1][0] or out.columns == table.columns
            out.collect()


def test_one_of_repeated_rows_survives(spark, sf_dir):
    r = random.Random(3)
    long = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5)]
    rows = [(1, long[0])] * 3 + [(None, long[1])] * 2 + [(2, long[2]), (None, long[2]), (3, long[3]), (3, long[4]), (None, long[3] + " end"), (4, long[4] + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    kept = P.minhash_neardup(spark, df, sf_dir)
    assert kept.columns == df.columns
    cut_ = P.suffix_dedup(spark, P.write_shared(kept, "kept"), sf_dir).collect()
    assert sorted((x.doc_id or 0, x.text) for x in cut_) == sorted([(1, long[0]), (0, long[1]), (2, long[2]), (3, long[3]), (3, long[4])])


def test_short_words_repeat(spark, sf_dir):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage, less = " ".join(word(1) for _ in range(51)), " ".join(word(1) for _ in range(48))
    own = [" ".join(word(9) for _ in range(40)) for _ in range(4)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}\n", f"{own[3]} {less}", f"{less} {own[3][::-1]}"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {x.doc_id: x.text for x in P.suffix_dedup(spark, df, sf_dir).collect()}
    assert got == {0: f"{own[0]}  {own[1]}", 1: f"{own[2]}\n\n", 2: texts[2], 3: texts[3]}
