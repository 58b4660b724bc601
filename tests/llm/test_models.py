"""Held-out accuracy of the learned scores on the test tables, and their edge cases."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm import language, quality, toxicity
from tracelake.llm._spark import crc_bucket

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "!!! 123"), (5, "the " * 60000), (5, "x"), (None, "the and of"), (6, "é")]


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def accuracy(scored, labels, name, held):
    x = scored.where(held).join(labels, "doc_id").select("predicted", name).collect()
    right = {y: [r.predicted == r[name] for r in x if r[name] == y] for y in (0, 1)}
    return {y: sum(v) / len(v) for y, v in right.items()}


def test_quality(spark):
    docs, labels = tables(spark)
    held = crc_bucket(F.col("doc_id"), 3) == 1
    model = quality.fit_quality_model(docs, labels, ~held)
    got = accuracy(quality.score_quality(docs, model), labels, "quality", held)
    assert got[0] > 0.8 and got[1] > 0.97, got
    odd = quality.score_quality(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)


def test_toxicity(spark):
    docs, labels = tables(spark)
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit_toxicity_model(docs, labels, ~held)
    got = accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", held)
    assert got[0] > 0.98 and got[1] > 0.84, got
    odd = toxicity.score_toxicity(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_kneser_ney_tables():
    """Every context's probabilities sum to 1, and equal a plain count of continuations."""
    ordinary = [b"the cat sat on the mat and the dog sat on the cat", b"a dog and a cat on a mat", b""] * 9
    toxic = [b"you rat sat on the mat you rat", b"the rat and you rat on a rat"]
    m = toxicity.train(ordinary, toxic)
    n = len(m.words)
    assert np.allclose(m.low.sum(0) + m.unknown, 1)
    where = {int(x): i for i, x in enumerate(m.words)}
    pair = {int(x): i for i, x in enumerate(m.pairs)}
    for u in m.words:
        for c in (0, 1):
            at = [pair.get(int(toxicity._pair(np.array([u]), np.array([w]))[0])) for w in m.words]
            total = sum(m.keep[where[int(u)], c] * m.low[i, c] + (m.high[k, c] if k is not None else 0) for i, k in enumerate(at)) + m.keep[where[int(u)], c] * m.unknown[c]
            assert abs(total - 1) < 1e-9
    # brute force: distinct words before each word, distinct words before each pair
    name = lambda w: int(toxicity.tokens(*B.column_bytes(pa.array([w])))[0][0])
    streams = [[["<s>", *t.decode().split()] for t in x if t] for x in (ordinary, toxic)]
    bi = [{p for s in x for p in zip(s, s[1:])} for x in streams]
    words = {w for x in bi for p in x for w in p}
    assert len(words) == n
    pooled = {w: min(toxicity.SHARED, len({p[0] for p in bi[0] | bi[1] if p[1] == w})) for w in words}
    rare = max(1, sum(x == 1 for x in pooled.values()))
    for c in (0, 1):
        cont = {w: len({p[0] for p in bi[c] if p[1] == w}) for w in words}
        size = sum(cont.values()) * (1 + toxicity.COMMON)
        left = {w: max(cont[w] - toxicity.DISCOUNTS[0], 0) / size for w in words}
        for w in words - {"<s>"}:
            want = left[w] + (1 - sum(left.values())) * pooled[w] / (sum(pooled.values()) + rare)
            assert abs(m.low[where[name(w.encode())], c] - want) < 1e-12


def test_conflicting_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "one", "x"), (1, "uno", "x"), (2, "two", "x"), (3, None, "x"), (None, "none", "x"), (4, "w " * 500, "x"), (5, "five", "x"), (5, "five", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (None, 1), (4, 1), (5, 1), (5, 1), (6, 1), (7, None), (8, 3)], "doc_id long, quality int")
    for parts in (1, 4):
        got = quality.labelled_sample(docs.repartition(parts), labels.repartition(parts), F.lit(True), "quality", 10, 100)
        assert got[0] == [] and sorted(got[1]) in ([b"five", b"one"], [b"five", b"uno"])
    assert len(quality.labelled_sample(docs, labels, F.lit(True), "quality", 10, 5000)[1]) == 3


def test_long_bad_text_counts_as_a_whole():
    """What tells the quality stands in the middle or the end of long texts; all of it is in the dictionaries and in the score."""
    r = random.Random(1)
    word = lambda v: " ".join(r.choice(v) for _ in range(300))
    same, good, bad = [f"plain{i}" for i in range(400)], [f"fine{i}" for i in range(150)], [f"spam{i}" for i in range(150)]
    text = lambda v: (word(same) + " " + word(v) + " " + word(same)).encode()
    m = quality.QualityModel(quality.train_dictionary([text(good) for _ in range(40)]), quality.train_dictionary([text(bad) for _ in range(40)]), np.zeros(2))
    assert all(m.difference(text(good)) > m.difference(text(bad)) for _ in range(20)) and m.difference(b"") == 0


def test_language(spark):
    docs, _ = tables(spark)
    held = crc_bucket(F.col("doc_id"), 3) == 1
    model = language.fit_language_model(docs, ~held)
    got = language.identify(docs, model).where(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97, got
    odd = {(r.doc_id, r.text): r.lang_pred for r in language.identify(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()}
    assert [odd[k] for k in ODD[:4]] == ["und"] * 4 and odd[(6, "é")] != "und" and len(odd) == len(ODD)


def test_language_learns_from_rows_without_ids(spark):
    rows = [(None, f"the and of that {i}", "en") for i in range(9)] + [(None, f"le et la que {i}", "fr") for i in range(9)] + [(None, "the and", None), (None, None, "en"), (1, "the and of it", "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit_language_model(docs, F.lit(True), per_language=5)
    again = language.fit_language_model(docs.repartition(2), F.lit(True), per_language=5)
    assert model.langs == ["en", "fr"] and abs(model.weights - again.weights).max() < 1e-6
    got = language.identify(spark.createDataFrame([(1, "the of and"), (2, "la et que")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "fr"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_quality_model(docs, none, F.lit(True))).first().score == 0.5
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(docs, none, F.lit(True))).first().score == 0.5
    assert language.identify(docs, language.fit_language_model(docs, F.lit(True))).first().lang_pred == "und"
    one = spark.createDataFrame([(1, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_quality_model(docs, one, F.lit(True))).first().predicted == 1
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(docs, one, F.lit(True))).first().predicted == 1
    assert quality.score_quality(docs.limit(0), quality.fit_quality_model(docs, none, F.lit(True))).count() == 0
