"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, so no token differs from what a model would see. Each token's
character span is joined to the sections that it overlaps (both are sorted, so the interval join is a
binary search), and a token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of the byte-level BPE vocabularies (a fixed value of the published tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: majority: the section with most of the token's characters, the earlier one on a tie; start, end: where the
#: token's first or last character stands; share: every section gets its share of the characters.
RULES = ("majority", "start", "end", "share")
_loaded: dict[int, tuple] = {}


def _encoder(vocabulary: bytes, pattern: str):
    """(encoding, byte length of each token id), once a worker."""
    key = hash((vocabulary, pattern))
    if key not in _loaded:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        _loaded[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[key]


def allocate(start: np.ndarray, end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section, for token spans and sorted sections that do not overlap.

    Tokens outside all sections count nowhere; a token is crossing in each section that it shares.
    """
    n = len(sec_start)
    total, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(start):
        return total, crossing
    first = np.searchsorted(sec_end, start, "right")  # the first section that ends behind the token's start
    last = np.searchsorted(sec_start, end - 1, "right") - 1  # the last that begins within the token
    whole = (first == last) & (start >= sec_start[np.minimum(first, n - 1)]) & (end <= sec_end[np.clip(last, 0, n - 1)])
    total += np.bincount(first[whole], minlength=n)
    for t in np.flatnonzero(~whole & (first <= last)):
        i = np.arange(first[t], last[t] + 1)
        i = i[sec_end[i] > sec_start[i]]
        part = np.minimum(sec_end[i], end[t]) - np.maximum(sec_start[i], start[t])
        i, part = i[part > 0], part[part > 0]
        if not len(i):
            continue
        crossing[i] += 1
        if rule == "share":
            total[i] += part / (end[t] - start[t])
        elif rule == "majority":
            total[i[part.argmax()]] += 1
        elif rule == "start" and sec_start[i[0]] <= start[t]:
            total[i[0]] += 1
        elif rule == "end" and sec_end[i[-1]] >= end[t]:
            total[i[-1]] += 1
    return total, crossing


def token_counts(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, pattern: str = PATTERN, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """(doc_id, section, name, start, end, n_tokens, n_crossing, doc_tokens), a row for each section of each document.

    Without sections_col the sections are the lines of the text, each with its line break, and a text
    without characters (null, empty) is one empty line of 0 tokens. sections_col names an array of
    structs (name string, start long, end long) in characters; documents with a null or empty array give no
    rows. Sections may come in any order. One that is null, lacks a bound, ends before it begins or lies outside the
    text holds nothing and gets 0 tokens; sections that overlap fail the job, as their tokens could count twice. n_tokens is fractional only under the rule "share".
    Repeated rows each give their rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))  # the size of the vocabulary file
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(sections_col).cast("array<struct<name:string,start:bigint,end:bigint>>").alias("sections")] if sections_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = _encoder(*shared.value)
        for batch in batches:
            data, offs = B.column_bytes(batch.column(1))
            texts = batch.column(1).to_pylist()
            at: list[np.ndarray] = []
            cols: list[tuple] = []
            names: list[str | None] = []
            for i, text in enumerate(texts):
                one = data[offs[i] : offs[i + 1]]
                lead = (one & 0xC0) != 0x80
                char = np.cumsum(lead) - 1  # the character of each byte
                stop = np.cumsum(size[enc.encode_to_numpy(text or "")])
                start = np.r_[0, stop[:-1]] if len(stop) else stop
                a = char[start] if len(stop) else start
                z = char[stop - 1] + 1 if len(stop) else stop
                if sections_col:
                    got = batch.column(2)[i].as_py() or []
                    sa, sz = np.array([(x or {}).get("start") or 0 for x in got], np.int64), np.array([(x or {}).get("end") or 0 for x in got], np.int64)
                    lost = np.array([x is None or x["start"] is None or x["end"] is None or x["end"] < x["start"] for x in got], bool)
                    names += [(x or {}).get("name") for x in got]
                else:
                    n = int(char[-1]) + 1 if len(char) else 0
                    breaks = char[one == 10] + 1
                    sz = breaks if len(breaks) and breaks[-1] == n else np.r_[breaks, n]
                    sa = np.r_[0, sz[:-1]]
                    names += ["line"] * len(sa)
                if sections_col:
                    total, crossing = np.zeros(len(sa)), np.zeros(len(sa), np.int64)
                    real = np.flatnonzero(~lost & (sz > sa))
                    real = real[np.argsort(sa[real], kind="stable")]
                    if (sa[real][1:] < sz[real][:-1]).any():
                        raise ValueError("sections overlap")
                    total[real], crossing[real] = allocate(a, z, sa[real], sz[real], rule)
                else:
                    total, crossing = allocate(a, z, sa, sz, rule)
                k = len(sa)
                at.append(np.full(k, i))
                cols.append((np.arange(k), sa, sz, total, crossing, np.full(k, len(stop))))
            if not cols:
                continue
            no, sa, sz, total, crossing, all_ = (np.concatenate(x) for x in zip(*cols))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(np.concatenate(at))), pa.array(no.astype(np.int32)), pa.array(names, pa.string()), pa.array(sa.astype(np.int64)), pa.array(sz.astype(np.int64)), pa.array(total.astype(np.float64)), pa.array(crossing.astype(np.int64)), pa.array(all_.astype(np.int64))],
                names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, section int, name string, start long, end long, n_tokens double, n_crossing long, doc_tokens long")
