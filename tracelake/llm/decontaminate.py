"""Benchmark decontamination with training suffix arrays.

Each shard (a bounded chunk of documents) gets a suffix array over its word sequence. Test suffixes
are binary-searched in it: the range of training suffixes that start with a window gives every
verbatim occurrence with its location, and runs of windows along one alignment give the longest
verbatim matches. Words that no benchmark item holds end a match, so they act as separators and
only runs of known words enter the array; this loses no match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B

WINDOW = 13
#: Benchmark text that one model covers; a larger benchmark is several, of which a worker holds one at a time.
BLOCK_BYTES = 8 << 20
#: First words of a window by which a chunk picks the windows that it searches.
_PREFIX = 3


@dataclass
class Items:
    """Searchable form of a block of benchmark items."""

    vocab: np.ndarray  # sorted word hashes; a word's rank is its place + 1
    gate: np.ndarray  # which low 16 bits of a hash occur, to skip most lookups
    keys: np.ndarray  # distinct windows as big-endian rank strings, sorted
    length: np.ndarray  # words of each window
    at: np.ndarray  # first entry of each window in item/pos, one more at the end
    item: np.ndarray  # number of the item in ids
    pos: np.ndarray  # word offset of the window in its item
    ids: list  # item ids as strings, None for a null id
    shortest: int

    @cached_property
    def prefix(self) -> np.ndarray:
        """The first words of each window, as many as every window has, up to _PREFIX."""
        return np.ascontiguousarray(self.keys.view(np.uint8).reshape(len(self.keys), -1)[:, : 4 * self.depth]).view(f"S{4 * self.depth}").ravel()

    @property
    def depth(self) -> int:
        return min(_PREFIX, self.shortest)


def _rank_strings(rank: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The `length` ranks from each start on as a byte string that sorts like them, filled up with zeros."""
    m = np.r_[rank, np.zeros(window, rank.dtype)][start[:, None] + np.arange(window)]
    m[np.arange(window) >= length[:, None]] = 0
    return np.ascontiguousarray(m.astype(">u4")).view(f"S{4 * window}").ravel()


def build_items(ids: list, texts: list[str], window: int = WINDOW) -> Items | None:
    """The model of some items; None if they hold no word."""
    data, offs = B.column_bytes(pa.array([(t or "").encode() for t in texts], pa.large_binary()))
    data = B.LOWER[data]
    s, e, first = B.words(data, offs, B.ALNUM)
    if not len(s):
        return None
    vocab, rank = np.unique(B.word_hashes(data, s, e), return_inverse=True)
    gate = np.zeros(1 << 16, bool)
    gate[(vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    n = np.diff(first)
    size = np.minimum(n, window)
    count = np.where(n > 0, n - size + 1, 0)
    item = np.repeat(np.arange(len(n)), count)
    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    keys, firsts, inverse = np.unique(_rank_strings(rank.astype(np.uint32) + 1, first[item] + pos, size[item], window), return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    at = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(keys)))]
    return Items(vocab, gate, keys, size[item][firsts], at, item[order], pos[order], [None if i is None else str(i) for i in ids], int(size[n > 0].min()))


def occurrences(hashes: np.ndarray, first: np.ndarray, items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window number) of each occurrence of a window in the documents' words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.zeros(len(hashes), np.uint32)
    maybe = np.flatnonzero(items.gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.vocab, hashes[maybe]), len(items.vocab) - 1)
    same = items.vocab[at] == hashes[maybe]
    rank[maybe[same]] = at[same] + 1
    if not same.any():
        return none
    # end of the run of known words in the same document that each word stands in
    stop = rank == 0
    ends = np.union1d(np.flatnonzero(stop), first[1:])
    known = np.flatnonzero(~stop)
    left = ends[np.searchsorted(ends, known, "right")] - known
    keep = left >= items.shortest
    start, left = known[keep], left[keep]
    if not len(start):
        return none
    # the suffix array: suffixes of known words, ordered to the depth of a window
    text = _rank_strings(rank, start, left, window)
    array = np.argsort(text, kind="stable")
    text = text[array]
    # the test windows that begin like some suffix of this chunk are searched, so work grows with the chunk, not with the benchmark
    d = 4 * items.depth
    begin = np.unique(np.ascontiguousarray(text.view(np.uint8).reshape(len(text), -1)[:, :d]).view(f"S{d}").ravel())
    lo, hi = np.searchsorted(items.prefix, begin, "left"), np.searchsorted(items.prefix, begin, "right")
    n = hi - lo
    win = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys = items.keys[win]
    high = keys.copy().view(np.uint8).reshape(-1, 4 * window)
    high[np.arange(4 * window) >= 4 * items.length[win][:, None]] = 255
    lo = np.searchsorted(text, keys, "left")
    hi = np.searchsorted(text, high.view(f"S{4 * window}").ravel(), "right")
    n = hi - lo
    place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    return start[array[place]], np.repeat(win, n)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list:
    """Broadcast models of the benchmark, of about BLOCK_BYTES of text each; the driver builds one at a time."""
    sc, out, ids, texts, held = benchmark.sparkSession.sparkContext, [], [], [], 0

    def flush() -> None:
        nonlocal ids, texts, held
        m = build_items(ids, texts, window) if ids else None
        if m is not None:
            out.append(sc.broadcast(m))
        ids, texts, held = [], [], 0

    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        held += len(r.t) + 16
        if held >= BLOCK_BYTES:
            flush()
    flush()
    return out


def _each(blocks: list) -> Iterator[Items]:
    """The models of the blocks, one in memory at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1 and hasattr(b, "_value"):
            del b._value


def _word_chunks(col: pa.Array) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, word hashes, first word of each row) of the chunks of a text column."""
    data, offs = B.column_bytes(col)
    out = []
    for i, j in B.chunks(offs):
        d = B.LOWER[data[offs[i] : offs[j]]]
        s, e, first = B.words(d, offs[i : j + 1] - offs[i], B.ALNUM)
        out.append((i, j, B.word_hashes(d, s, e), first))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and n_hit >= share of n_words) and n_full.

    Lower-cases A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window` consecutive
    words of an item, or the whole item if it has fewer; n_full counts the words at which a window of full length
    begins. Null or empty texts have no words and are not contaminated; null items and items without words never
    match. Items with a null id hit words like others; together they are one of n_items, and the list leaves them
    out. Repeated rows each give a row. With keep_columns all columns of docs come along (names that clash
    with the results are replaced).
    """
    blocks = _blocks(benchmark, "item_id", "text", window)
    made = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_full long"
    names = [x.split()[0] for x in made.split(", ")]
    docs = docs.select(*[c for c in docs.columns if c not in names or c in (id_col, text_col)]) if keep_columns else docs.select(id_col, text_col)
    out_cols = docs.columns if keep_columns else [id_col]
    at = docs.columns.index(text_col)
    keep = [docs.columns.index(c) for c in out_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _word_chunks(batch.column(at))
            depth = [np.zeros(len(h) + 1, np.int64) for _, _, h, _ in parts]
            full = [np.zeros(len(h), bool) for _, _, h, _ in parts]
            items: list[set] = [set() for _ in range(len(batch))]
            for m in _each(blocks):
                for (i, _, h, first), deep, whole in zip(parts, depth, full):
                    pos, win = occurrences(h, first, m, window) if len(h) else (np.zeros(0, np.int64),) * 2
                    if not len(pos):
                        continue
                    np.add.at(deep, pos, 1)
                    np.add.at(deep, pos + m.length[win], -1)
                    whole[pos[m.length[win] == window]] = True
                    doc, win = np.unique(np.stack([B.owner(first)[pos], win]), axis=1)
                    n = m.at[win + 1] - m.at[win]
                    item = m.item[np.repeat(m.at[win] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    for x, it in np.unique(np.stack([np.repeat(doc, n), item]), axis=1).T:
                        items[i + x].add(m.ids[it])
            sums = [[np.r_[0, np.cumsum(x)] for x in (np.cumsum(deep[:-1]) > 0, whole)] for deep, whole in zip(depth, full)]
            n_words, n_hit, n_full = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.diff(p[3]) for p in parts], *([s[k][p[3][1:]] - s[k][p[3][:-1]] for s, p in zip(sums, parts)] for k in (0, 1))))
            sha = [hashlib.sha256(",".join(sorted(y for y in x if y is not None)).encode()).hexdigest() for x in items]
            bad = (n_hit > 0) & (n_hit >= share * n_words - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(bad), pa.array(n_full, pa.int64())],
                names=[*out_cols, *names],
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out_cols)
    return docs.mapInArrow(run, f"{fields}, {made}")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, item_pos, doc_pos, n_words): maximal verbatim matches of at least a window, with locations in words.

    The evidence behind contamination(): where each match stands in the document and in the item. Items with a
    null id come with a null; other cases as there.
    """
    blocks = _blocks(benchmark, "item_id", "text", window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _word_chunks(batch.column(1))
            for m in _each(blocks):
                for i, j, h, first in parts:
                    if not len(h):
                        continue
                    pos, win = occurrences(h, first, m, window)
                    n = m.at[win + 1] - m.at[win]
                    entry = np.repeat(m.at[win] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    doc = np.repeat(B.owner(first)[pos], n)
                    a = np.repeat(pos, n) - first[doc]
                    z = a + np.repeat(m.length[win], n)
                    item, shift = m.item[entry], a - m.pos[entry]
                    # windows of one alignment that touch are one match
                    o = np.lexsort((a, shift, item, doc))
                    doc, item, shift, a, z = doc[o], item[o], shift[o], a[o], z[o]
                    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > z[:-1])] if len(o) else np.zeros(0, bool)
                    f = np.flatnonzero(new)
                    z = z[np.r_[f[1:] - 1, len(o) - 1]] if len(f) else z
                    doc, item, shift, a = doc[f], item[f], shift[f], a[f]
                    ids = batch.column(0).slice(i, j - i)
                    yield pa.record_batch([ids.take(pa.array(doc)), pa.array([m.ids[x] for x in item], pa.string()), pa.array(a - shift), pa.array(a), pa.array(z - a)], names=["doc_id", "item_id", "item_pos", "doc_pos", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, item_pos long, doc_pos long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, any_window: bool = False, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with.

    any_window: one occurrence of a window of full length is enough, however long the document is; items
    shorter than a window still need their share of the words, so that an item of a few common words takes
    no clean document away.
    """
    t = docs.withColumn("__text", F.col("text"))
    marked = contamination(t.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("__text")), benchmark, id_col="c0", text_col="__text", keep_columns=True, **options)
    clean = ~F.col("contaminated") & ((F.col("n_full") == 0) | F.lit(not any_window))
    return marked.where(clean).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def empty_benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, text string")
