"""Toxicity scores from class-conditional Kneser-Ney bigram models.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, with absolute discounts. Their bigrams back off to
the class's continuation counts, and these to continuation counts that the classes share, the same in either; so an
expression that a class has hardly seen keeps little mass of its own and says little. A text is compared by the
length-normalised difference of its two log-likelihoods, over the whole text and over each passage of a few words
(a long text may be toxic in one sentence); a logistic curve fitted on training rows that the models have not
seen makes the mean and the largest passages a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tracelake.llm import _bytes as B
from tracelake.llm.quality import class_share, labelled_sample, logistic, weighted_to_share

#: Bounds of the training sample: rows and bytes a class.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
#: Absolute discounts of words and of bigrams, and backoff mass beside them: of a class, as a share of its counts; of a context, in counts.
DISCOUNTS, COMMON, CONTEXT = (3.0, 10.0), 0.2, 100.0
#: Contexts of a word that the shared counts take, at most.
SHARED = 2
#: Words of a passage, from a single expression to a sentence.
PASSAGES = (1, 3, 8)
_START = np.uint64(0xABCDEF0123456789)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): lower-cased words of letters, digits and non-ASCII characters of each document."""
    d = B.LOWER[data]
    s, e, first = B.words(d, offs, B.ALNUM)
    return B.word_hashes(d, s, e), first


def _previous(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    starts = first[:-1][np.diff(first) > 0]
    prev[starts] = _START
    return prev


def _pair(prev: np.ndarray, h: np.ndarray) -> np.ndarray:
    return B.mix(prev * np.uint64(0xD6E8FEB86659FD93) + h)


@dataclass
class ToxicityModel:
    """Sorted tables of words and bigrams; column 0 is ordinary, column 1 toxic."""

    words: np.ndarray
    low: np.ndarray  # words x 2: probability of the word by continuation counts, backed off to the shared ones
    unknown: np.ndarray  # 2: the same for all words of neither class together
    keep: np.ndarray  # words x 2: mass that a context leaves to the lower order
    pairs: np.ndarray
    high: np.ndarray  # pairs x 2: discounted share of the bigram in its context
    curve: np.ndarray

    def ratios(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P(word | toxic, previous) - log P(word | ordinary, previous) of each word."""
        if not len(h):
            return np.zeros(0)
        prev = _previous(h, first)

        def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(table):
                return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            at = np.minimum(np.searchsorted(table, x), len(table) - 1)
            return at, table[at] == x

        at, known = find(self.words, h)
        low = np.where(known[:, None], self.low[at] if len(self.words) else 0.0, self.unknown)
        ctx = np.empty(len(h), np.int64)
        ctx[1:] = at[:-1]
        seen = np.empty(len(h), bool)
        seen[1:] = known[:-1]
        begins = np.flatnonzero(prev == _START)
        s_at, s_known = find(self.words, np.array([_START]))
        ctx[begins], seen[begins] = s_at[0], s_known[0]
        keep = np.where(seen[:, None], self.keep[ctx] if len(self.words) else 1.0, 1.0)
        p = keep * low
        both = np.flatnonzero(seen & known)
        pat, there = find(self.pairs, _pair(prev[both], h[both]))
        p[both[there]] += self.high[pat[there]]
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def features(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(documents x 5): the difference of log-likelihoods over the length and over its square root, and the largest over a passage of each length."""
        c = np.r_[0.0, np.cumsum(self.ratios(h, first))]
        n = np.diff(first)
        total, size = c[first[1:]] - c[first[:-1]], np.maximum(n, 1)
        end = np.repeat(first[1:], n)
        most = np.zeros((len(n), len(PASSAGES)))
        for i, k in enumerate(PASSAGES if len(h) else ()):
            passage = (c[np.minimum(np.arange(len(h)) + k, end)] - c[: len(h)]) / k
            most[n > 0, i] = np.maximum.reduceat(passage, first[:-1][n > 0])
        return np.c_[total / size, total / np.sqrt(size), most]

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = self.features(*tokens(data, offs)) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [tokens(*B.column_bytes(pa.array(texts[i : i + 500], pa.binary()))) for i in range(0, len(texts), 500)]
    first = np.cumsum(np.r_[0, *[np.diff(f) for _, f in got]]) if got else np.zeros(1, np.int64)
    return (np.concatenate([h for h, _ in got]) if got else np.zeros(0, np.uint64)), first


def train(ordinary: list[bytes], toxic: list[bytes]) -> ToxicityModel:
    """Interpolated Kneser-Ney tables of two lists of texts; each context's probabilities sum to 1 in either class.

    All counts are continuation counts: a word by the distinct words before it, a bigram by the distinct words before
    it, so a passage that stands in many copies counts once.
    """
    streams = [_flat(ordinary), _flat(toxic)]
    some_word = any(len(h) for h, _ in streams)
    words = np.unique(np.concatenate([*(np.unique(h) for h, _ in streams), *([np.array([_START])] if some_word else [])]))
    n = len(words)
    if not n:
        return ToxicityModel(words, np.zeros((0, 2)), np.ones(2), np.zeros((0, 2)), words, np.zeros((0, 2)), np.zeros(3 + len(PASSAGES)))
    begin = int(np.searchsorted(words, _START))
    once = []
    while streams:  # class by class, so that the driver holds the arrays of one at a time
        h, f = streams.pop(0)
        starts = f[:-1][np.diff(f) > 0]
        w = np.searchsorted(words, h).astype(np.int32)
        del h
        u = np.empty_like(w)
        u[1:], u[starts] = w[:-1], begin
        before = np.empty_like(w)
        before[1:], before[starts] = u[:-1], begin
        code = u.astype(np.int64) * n + w
        del u, w
        _, at = np.unique(_pair(before.astype(np.uint64), B.mix(code.view(np.uint64))), return_index=True)
        once.append(np.unique(code[at], return_counts=True))
        del code, before, at
    code = np.union1d(once[0][0], once[1][0])
    u, w = (code // n).astype(np.int32), (code % n).astype(np.int32)
    # the shared model: in how many contexts of either class a word stands, up to SHARED, as what one class says often must not
    # become the other's backoff; unknown words weigh as much as all that stand in one context
    pooled = np.minimum(np.bincount(w, minlength=n), SHARED).astype(np.float64)
    rare = max(1.0, float((pooled == 1).sum()))
    shared, none = pooled / (pooled.sum() + rare), rare / (pooled.sum() + rare)
    low, unknown, high, keep = np.zeros((n, 2)), np.zeros(2), np.zeros((len(code), 2)), np.ones((n, 2))
    for c, (own, number) in enumerate(once):
        if not len(own):
            low[:, c], unknown[c] = shared, none
            continue
        at = np.searchsorted(code, own)
        # the class's continuation counts, backed off to the shared ones
        cont = np.bincount(w[at], minlength=n).astype(np.float64)
        left = np.maximum(cont - DISCOUNTS[0], 0)
        size = cont.sum() * (1 + COMMON)
        back = 1 - left.sum() / size
        low[:, c], unknown[c] = left / size + back * shared, back * none
        # its bigrams, backed off to these
        seen = np.bincount(u[at], weights=number, minlength=n) + CONTEXT
        high[at, c] = np.maximum(number - DISCOUNTS[1], 0) / seen[u[at]]
        keep[:, c] = 1 - np.bincount(u, weights=high[:, c], minlength=n)
    told = np.flatnonzero((high > 0).any(axis=1))  # what the discount leaves nothing of has no row
    pairs = _pair(words[u[told]], words[w[told]])
    o = np.argsort(pairs)
    return ToxicityModel(words, low, unknown, keep, pairs[o], high[told[o]], np.ones(3 + len(PASSAGES)))


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, train_rows: Column) -> ToxicityModel:
    """Models from two thirds of labelled_sample(), the curve from the rest. With one class or none the score is its share."""
    got = labelled_sample(docs, labels, train_rows, "toxic", SAMPLE_ROWS, SAMPLE_BYTES)
    part = {y: ([t for i, t in enumerate(x) if i % 3], x[::3] or x) for y, x in got.items()}
    model = train(part[0][0], part[1][0])
    if not got[0] or not got[1]:
        model.curve = np.r_[np.zeros(2 + len(PASSAGES)), 0.0 if not got[0] and not got[1] else (4.0 if got[1] else -4.0)]
        return model
    x = np.concatenate([model.features(*_flat(part[y][1])) for y in (0, 1)])
    y = np.r_[np.zeros(len(part[0][1])), np.ones(len(part[1][1]))]
    model.curve = logistic(x, y, weighted_to_share(y, class_share(labels, train_rows, "toxic")))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of whole texts; null, empty and wordless texts have no evidence and get the curve's constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = B.column_bytes(batch.column(1))
            s = [m.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in B.chunks(offs)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
