"""Quality scores by compression: zstandard dictionaries of good and of bad text.

A dictionary is trained on the whole texts of each label. A text is cut into blocks, so that dictionaries count
throughout, and all blocks are compressed with either one. The difference of the two sizes, normalised by
their sum, tells which kind the text is made of; a logistic curve over this one number, fitted on training rows
that the dictionaries have not seen and weighted to the true share of the classes, makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B

#: Bounds of the training sample: rows and bytes a class.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20
#: Size of a dictionary, bytes that are compressed at a time, and the trainer's segment and substring sizes.
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL, SEGMENT, SUBSTRING = 1 << 19, 512, 3, 512, 8


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray  # slope and constant of the logistic curve over difference()
    _pair: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_pair": None}

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / their sum, over all blocks of the text; 0 for the empty text."""
        if self._pair is None:
            made = []
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=z, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._pair = tuple(made)
        good = bad = 0
        view = memoryview(text)
        for i in range(0, len(text), BLOCK_BYTES):
            block = view[i : i + BLOCK_BYTES]
            good += len(self._pair[0].compress(block))
            bad += len(self._pair[1].compress(block))
        return (bad - good) / (good + bad) if text else 0.0

    def score(self, text: bytes) -> float:
        x = float(self.weights[0] * self.difference(text) + self.weights[1])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (constant last) of a ridge logistic regression, by Newton steps on standardised columns."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-12)
    a = np.c_[(x - mean) / sd, np.ones(len(x))]
    sw = np.ones(len(x)) if sample_weight is None else sample_weight
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (sw * (p - y)) + ridge * w
        h = (a * (sw * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out = np.r_[w[:-1] / sd, 0.0]
    out[-1] = w[-1] - float((w[:-1] * mean / sd).sum())
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: str, rows: int, size: int) -> dict[int, list[bytes]]:
    """Texts of at most `rows` training ids and `size` bytes for each value 0 and 1 of the label, in the order of a hash of the id.

    Texts are taken in that order as long as they fit, so neither partitions nor the table's order change the sample and
    a very long text does not use up the bound. Ids that are null, have both labels or another one are left out, repeated
    labels count once, and of an id's texts the one of the smallest hash counts; null texts are no examples.
    """
    spark = docs.sparkSession
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    keyed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    out: dict[int, list[bytes]] = {}
    for y in (0, 1):
        ids = known.where(F.col("y") == y).select("doc_id", F.xxhash64(F.col("doc_id"), F.lit(3)).alias("o")).orderBy("o", "doc_id").limit(rows).collect()
        place = {r.doc_id: i for i, r in enumerate(ids)}
        out[y] = []
        if not place:
            continue
        small = F.broadcast(spark.createDataFrame([(i,) for i in place], labels.select("doc_id").schema))
        found = keyed.select("doc_id", "t", F.octet_length("text").alias("n")).join(small, "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "n")).alias("m")).select("doc_id", "m.t", "m.n").collect()
        taken, held = [], 0
        for r in sorted(found, key=lambda r: place[r.doc_id]):
            if held + r.n <= size:
                taken.append((r.doc_id, r.t))
                held += r.n
        if not taken:
            continue
        wanted = F.broadcast(spark.createDataFrame(taken, keyed.select("doc_id", "t").schema))
        texts = {r.doc_id: r.text.encode() for r in keyed.join(wanted, ["doc_id", "t"]).select("doc_id", "text").toLocalIterator()}
        out[y] = [texts[i] for i, _ in taken]
    return out


def class_share(labels: DataFrame, train: Column, label: str) -> float:
    """Share of label 1 among the training rows that have a label."""
    n = labels.where(train & F.col(label).isin(0, 1)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("k")).first()
    return n.k / n.n if n.n else 0.5


def weighted_to_share(y: np.ndarray, share: float) -> np.ndarray:
    """Weights under which the examples have the given share of label 1."""
    return np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))


def train_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary trained on all blocks of the texts; of too little text to train on, its last bytes are the dictionary."""
    parts = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 4)), parts, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:].rjust(8)


def fit_quality_model(docs: DataFrame, labels: DataFrame, train: Column) -> QualityModel:
    """Dictionaries from one half of labelled_sample(), the curve from the other. With one class or none the score is its share."""
    got = labelled_sample(docs, labels, train, "quality", SAMPLE_ROWS, SAMPLE_BYTES)
    bad, good = got[0], got[1]
    model = QualityModel(train_dictionary(good[::2]), train_dictionary(bad[::2]), np.zeros(2))
    if not bad or not good:
        model.weights[-1] = 0.0 if not bad and not good else (4.0 if good else -4.0)
        return model
    tune_bad, tune_good = bad[1::2] or bad, good[1::2] or good
    x = np.array([[model.difference(t)] for t in [*tune_bad, *tune_good]])
    y = np.r_[np.zeros(len(tune_bad)), np.ones(len(tune_good))]
    model.weights = logistic(x, y, weighted_to_share(y, class_share(labels, train, "quality")))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) of whole texts; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = B.column_bytes(batch.column(1))
            s = [m.score(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.record_batch([batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
