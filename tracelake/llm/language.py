"""Language identification with blended-spectrum string kernels.

A text's features are the presence of letter n-grams of one to three bytes, hashed into fixed tables.
The kernel of two texts is the number of n-grams that both hold over the geometric mean of their own
counts. Nystroem landmarks from the training sample span the feature space and one-versus-rest kernel
ridge regression fits a score for each language. As the kernel is linear in presence, landmark weights
fold into one matrix, and a batch is scored by one matrix product over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm._spark import drop_shared, write_shared

#: Bounds of the training sample: rows a language, landmarks overall (one a language at least).
PER_LANGUAGE, LANDMARKS = 400, 256
_BITS2, _BITS3 = 13, 15
DIM = 256 + (1 << _BITS2) + (1 << _BITS3)
_ASCII = B.byte_table((65, 90), (97, 122))
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.where(B.byte_table((65, 90), (97, 122), (128, 255)), B.LOWER, np.uint8(32)).astype(np.uint8)


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of DIM zeros and ones for each document; whole texts, A-Z and Latin-1 capitals lowered, other ASCII signs as blanks."""
    n = len(offs) - 1
    p = np.zeros((n, DIM), np.uint8)
    if not len(data):
        return p
    b = _FOLD[data]
    latin = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E))
    b[latin + 1] += 32
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offs))
    flat = p.reshape(-1)
    flat[doc + b] = 1
    w = b.astype(np.uint32)
    two = w[:-1] << 8 | w[1:]
    same = doc[:-1] == doc[1:]
    flat[(doc[:-1] + 256 + (two * np.uint32(2654435761) >> np.uint32(32 - _BITS2)))[same]] = 1
    three = two[:-1] << 8 | w[2:]
    same = same[:-1] & same[1:]
    flat[(doc[:-2] + 256 + (1 << _BITS2) + (three * np.uint32(2246822519) >> np.uint32(32 - _BITS3)))[same]] = 1
    p[:, 32] = 0
    return p


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # DIM x languages

    def score(self, p: np.ndarray) -> np.ndarray:
        x = p.astype(np.float32)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def _unpacked(bits: list[bytes]) -> np.ndarray:
    """Unit rows of packed presence bits."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, :DIM].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def _smallest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows of each language that come first; every task passes on n a language at most."""
    w = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("no", F.row_number().over(w)).where(F.col("no") <= n).drop("no")


def fit_language_model(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> LanguageModel:
    """Learn from a bounded sample: the `per_language` training rows of each language with the smallest hashes of doc_id and text.

    Rows with a null text or lang are no training rows, rows with a null id are. Rows that repeat an id and a text
    are one example (they may take several places of the bound). Without any row the model knows no language.
    The sample's presence rows are a shared table; the driver holds the landmarks and sums of their kernel values.
    """
    spark = docs.sparkSession
    usable = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    keyed = usable.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("o"), F.xxhash64("text").alias("t"), "text")
    picked = write_shared(_smallest(keyed.drop("text"), per_language, "o", "t").distinct(), "language-sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(3))
            for i, j in B.chunks(offs, 1 << 19, 128):
                p = np.packbits(presence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array([r.tobytes() for r in p], pa.binary())], names=["lang", "o", "t", "bits"])

    once = keyed.join(picked, ["lang", "o", "t"], "left_semi").dropDuplicates(["lang", "o", "t"])
    rows = write_shared(once.mapInArrow(features, "lang string, o long, t long, bits binary"), "language-presence")
    drop_shared(picked)
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return LanguageModel([], np.zeros((DIM, 0), np.float32))
    marks = _smallest(rows, -(-max(landmarks, len(langs)) // len(langs)), "o", "t").orderBy("lang", "o", "t")
    bits = [bytes(r.bits) for r in marks.select("bits").toLocalIterator()]
    shared = spark.sparkContext.broadcast(bits)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = _kernel(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in k], pa.binary())], names=["lang", "k"])

    total, m = sum(count.values()), len(bits)
    gram, target = np.zeros((m, m)), np.zeros((m, len(langs)))
    held: dict[str, list] = {}

    def add(lang: str) -> None:
        k = np.frombuffer(b"".join(held.pop(lang)), np.float64).reshape(-1, m)
        weight = total / (len(langs) * count[lang])  # every language counts the same
        gram[:] += weight * (k.T @ k)
        target[:, langs.index(lang)] += weight * k.sum(0)

    for r in rows.orderBy("lang", "o", "t").select("lang", "bits").mapInArrow(kernels, "lang string, k binary").toLocalIterator():
        held.setdefault(r.lang, []).append(bytes(r.k))
        if len(held[r.lang]) >= 1024:
            add(r.lang)
    for lang in list(held):
        add(lang)
    shared.destroy()
    drop_shared(rows)
    alpha = np.linalg.solve(gram + ridge * total * _kernel(bits, bits) / m + 1e-6 * np.eye(m), target)
    weights = np.zeros((DIM, len(langs)))
    for i in range(0, m, 64):
        weights += _unpacked(bits[i : i + 64]).T @ alpha[i : i + 64]
    return LanguageModel(langs, weights.astype(np.float32))


def _kernel(x: list[bytes], z: list[bytes]) -> np.ndarray:
    """Kernel values of all pairs, in blocks of bounded size."""
    out = np.zeros((len(x), len(z)))
    for i in range(0, len(x), 128):
        a = _unpacked(x[i : i + 128])
        for j in range(0, len(z), 64):
            out[i : i + 128, j : j + 64] = a @ _unpacked(z[j : j + 64]).T
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double, 0 to 1); columns of these names are replaced.

    `und` with score 0 where the text is null or holds no letter, or where no language was learned.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            col = batch.column(at)
            data, offs = B.column_bytes(col)
            pred: list[str] = []
            prob: list[float] = []
            # an ASCII letter settles it; only texts without one are searched for other letters
            at_letter = np.flatnonzero(_ASCII[data])
            letter = np.diff(np.searchsorted(at_letter, offs)) > 0
            del at_letter
            for i in np.flatnonzero(~letter):
                letter[i] = _LETTER.search(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "ignore")) is not None
            for i, j in B.chunks(offs, 1 << 19, 128):
                if not m.langs:
                    pred += ["und"] * (j - i)
                    prob += [0.0] * (j - i)
                    continue
                s = m.score(presence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])).astype(np.float64)
                e = np.exp(6 * (s - s.max(1, keepdims=True)))
                top = s.argmax(1)
                conf = 1 / e.sum(1)
                pred += [m.langs[t] if ok else "und" for t, ok in zip(top, letter[i:j])]
                prob += [float(c) if ok else 0.0 for c, ok in zip(conf, letter[i:j])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(prob, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double" if fields else "lang_pred string, score double")
