"""Suffix-array dedup by a depth-limited radix sort: removes what stands in repeated windows of bytes or of words.

Suffixes are ordered only through `window` elements, by passes over digits from the most significant on, and
equal groups are the repeated windows. Three facts keep the passes small, and all are exact:

* First digit: the window's winnowed gram (suffixes.anchors). One row stands for a run of neighbouring
  windows, about two rows for 340 bytes. Rows whose gram is alone in the corpus hold no repeat.
* Second digit: all elements of the run. If it occurs twice, each of its windows does.
* Rows whose gram is shared but whose run differs are split: blocks of 16 windows, then single windows.
  A block's digits are what all its windows share (alone: no repeats) and all its elements (twice: all repeat).

Counts and partners flow through hash aggregates and joins, so a passage in any number of documents is
never gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm._spark import drop_shared, write_shared
from tracelake.llm.suffixes import GRAM, anchors, block_digits

WINDOW = 400
BLOCK = 16
#: Words of a run that shows a passage of over 50 words, as its first and last word may be glued to what stands beside it.
PASSAGE = 49
#: Units of a window: bytes, or words parted by ASCII white space.
BYTES, WORDS = "bytes", "words"


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Two hashes name a text; rows of equal texts share their spans."""
    return docs.withColumns({"k1": F.xxhash64(text_col), "k2": F.xxhash64(F.lit(11), text_col)})


def _codes(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit codes of the elements of some texts, offsets of the texts in them)."""
    if unit == BYTES:
        return B.BYTE_CODE[data], offs
    s, e, first = B.words(data, offs, B.NOT_SPACE)
    return B.word_hashes(data, s, e), first


def _anchor_rows(texts: DataFrame, window: int, unit: str) -> DataFrame:
    """(k1, k2, h, u, lo, hi, p) of (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(2))
            for i, j in B.chunks(offs):
                codes, o = _codes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], unit)
                px = B.prefix_sums(codes)
                pos, lo, hi, key = anchors(codes, px, o, window, max(1, min(GRAM, window // 4)))
                doc = np.searchsorted(o, lo, "right") - 1
                u = B.mix(B.span_hash(px, lo, hi + window) ^ B.mix((pos - lo).astype(np.uint64)))
                at = pa.array(doc + i)
                base = o[doc]
                yield pa.record_batch(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64)), pa.array(u.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (lo, hi, pos))],
                    names=["k1", "k2", "h", "u", "lo", "hi", "p"],
                )

    return texts.mapInArrow(run, "k1 long, k2 long, h long, u long, lo int, hi int, p int")


def _contexts(texts: DataFrame, reps: DataFrame, window: int, unit: str) -> DataFrame:
    """(u, single, lo, hi, p, ctx): the elements of each representative run, bytes or word hashes."""
    lists = reps.groupBy("k1", "k2", "doc").agg(F.collect_list(F.struct("u", "single", "lo", "hi", "p")).alias("r"))
    joined = texts.join(lists, (texts["k1"] == lists["k1"]) & (texts["k2"] == lists["k2"]) & texts["doc"].eqNullSafe(lists["doc"])).select("text", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(0))
            if unit == WORDS:
                data, offs = _codes(data, offs, unit)
            lists = batch.column(1)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            lo, hi = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
            ctx = [data[a:b].tobytes() for a, b in zip(offs[doc] + lo, offs[doc] + hi + window)]
            yield pa.record_batch([flat.field("u"), flat.field("single"), flat.field("lo"), flat.field("hi"), flat.field("p"), pa.array(ctx, pa.binary())], names=["u", "single", "lo", "hi", "p", "ctx"])

    return joined.mapInArrow(run, "u long, single boolean, lo int, hi int, p int, ctx binary")


def _block(window: int) -> int:
    """Windows of a block; all of them share some elements."""
    return min(BLOCK, max(1, window // 2))


def _digits(contexts: DataFrame, window: int, width: int, unit: str) -> DataFrame:
    """(u, single, k, c, w) for each block of `width` windows of each run; a column `ks` of contexts, if there, names the blocks of _block() windows to take."""
    some, block = "ks" in contexts.columns, _block(window)
    contexts = contexts.select("u", "single", "lo", "hi", "p", "ctx", *(["ks"] if some else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            _, all_offs = B.column_bytes(whole_batch.column(5))
            for i, j in B.chunks(all_offs, 1 << 19 if width > 1 else 1 << 18):
                batch = whole_batch.slice(i, j - i)
                data, offs = B.column_bytes(batch.column(5))
                codes, offs = (B.BYTE_CODE[data], offs) if unit == BYTES else (np.frombuffer(data.tobytes(), np.uint64), offs // 8)
                lo, hi, p = (np.asarray(batch.column(x)).astype(np.int64) for x in (2, 3, 4))
                numbers = None
                if some:
                    ks = batch.column(6)
                    row = np.repeat(np.arange(len(ks)), np.asarray(ks.value_lengths()))
                    first = np.asarray(ks.flatten()).astype(np.int64) * block
                    row, k = np.repeat(row, block), (first[:, None] + np.arange(block)).ravel()
                    there = (p[row] + k >= lo[row]) & (p[row] + k <= hi[row])
                    numbers = row[there], k[there]
                row, k, c, w = block_digits(codes, offs[:-1], lo, hi, p, window, width, numbers)
                at = pa.array(row)
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(k.astype(np.int32)), pa.array(c.view(np.int64)), pa.array(w.view(np.int64))], names=["u", "single", "k", "c", "w"])

    return contexts.mapInArrow(run, "u long, single boolean, k int, c long, w long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, unit: str = BYTES) -> DataFrame:
    """(k1, k2, spans): spans [from, to) of each text (k1, k2, doc, text) that stand in repeated windows, in bytes or words; they may overlap.

    A shared table; the tables of the passes are deleted.
    """
    rows = write_shared(_anchor_rows(docs.select("k1", "k2", "text"), window, unit), "anchors")
    # written first, so that the join below has two plain sides and Spark can split a hot gram
    shared = write_shared(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("a"), F.max("u").alias("z")).where("n > 1").select("h", (F.col("a") < F.col("z")).alias("open")), "grams")
    kept = write_shared(rows.join(shared, "h"), "shared-anchors")
    drop_shared(rows)
    span = [F.col("lo").alias("a"), (F.col("hi") + window).alias("z")]
    runs = kept.where("open").groupBy("h", "u").agg(F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("k1", "k2", "lo", "hi", "p")))
    runs = write_shared(runs.withColumn("single", F.col("n") == 1).drop("n"), "runs")
    owners = docs.groupBy("k1", "k2").agg(F.min("doc").alias("doc"))
    contexts = write_shared(_contexts(docs, runs.join(owners, ["k1", "k2"]), window, unit), "contexts")

    width = _block(window)
    blocks = _digits(contexts, window, width, unit)
    found = write_shared(blocks.groupBy("c", "w").agg(F.min("u").alias("u"), F.max("u").alias("z"), F.first("k").alias("k")), "blocks")
    twice = found.where("u < z").select("c", "w")
    whole_blocks = blocks.where("single").join(twice, ["c", "w"]).select("u", "k")
    split = found.groupBy("c").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("c")
    todo = found.join(split, "c").groupBy("u").agg(F.collect_list("k").alias("ks"))
    narrow = write_shared(contexts.join(todo, "u"), "open-contexts")
    windows = _digits(narrow, window, 1, unit)
    again = windows.groupBy("w").agg(F.min("u").alias("a"), F.max("u").alias("z")).where("a < z").select("w")
    single_windows = windows.where("single").join(again, "w").select("u", "k")

    own = runs.where("single").select("u", "k1", "k2", "lo", "hi", "p")
    first, last = F.greatest("lo", F.col("p") + F.col("k") * width), F.least("hi", F.col("p") + F.col("k") * width + width - 1)
    by_block = whole_blocks.join(own, "u").select("k1", "k2", first.alias("a"), (last + window).alias("z"))
    by_window = single_windows.join(own, "u").select("k1", "k2", (F.col("p") + F.col("k")).alias("a"), (F.col("p") + F.col("k") + window).alias("z"))
    partly = write_shared(by_block.unionByName(by_window), "partly")
    for x in (contexts, narrow, found):
        drop_shared(x)
    sure = kept.where("not open").select("k1", "k2", *span)
    repeated = kept.where("open").join(runs.where("not single").select("h", "u"), ["h", "u"]).select("k1", "k2", *span)
    # equal texts bring equal spans: one of each before they are listed, so a list is bounded by its text
    spans = sure.unionByName(repeated).unionByName(partly).distinct()
    out = write_shared(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")
    for x in (shared, kept, runs, partly):
        drop_shared(x)
    return out


def merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans [a, z); runs that touch are one."""
    o = np.argsort(a, kind="stable")
    a, z = a[o], np.maximum.accumulate(z[o])
    new = np.r_[True, a[1:] > z[:-1]] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return a[at], z[np.r_[at[1:] - 1, len(a) - 1]] if len(a) else z


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", digest: bool = False, unit: str = BYTES, note_words: int = 0) -> DataFrame:
    """docs without what stands in a window which also starts anywhere else in the corpus.

    unit="bytes": texts are UTF-8 bytes; unit="words": sequences of words parted by ASCII white space, of which a
    repeated run goes from its first byte to its last. Null texts are empty; windows never cross documents. All
    occurrences go, also overlapping ones and those within one document; windows are judged on the input. Texts
    shorter than a window stay as they are. Rows that repeat a document lose each of its windows.

    digest=False: the columns of docs, with what is left as text; a character of which only some bytes are
    covered is kept whole, so texts stay valid; untouched texts stay as they are, null ones too.
    digest=True: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), exact to the byte; with note_words also
    repeats_passage: whether the text holds a run of so many words that stands anywhere else too.
    """
    names = docs.columns
    base = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    text, ident = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    keyed = _keyed(base, text)
    source = keyed.select("k1", "k2", F.col(ident).alias("doc"), F.col(text).alias("text"))
    slim = keyed.select(ident, text, "k1", "k2") if digest else keyed
    if digest and note_words:
        noted = repeated_spans(source, note_words, WORDS).select("k1", "k2", F.lit(True).alias("noted"))
        slim = slim.join(noted, ["k1", "k2"], "left")
    spans = repeated_spans(source, window, unit)
    joined = slim.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    cols = joined.columns
    t, s = cols.index(text), cols.index("spans")
    out_cols = [ident] if digest else [c for c in cols if c != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(t))
            lists = batch.column(s)
            size = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten()
            at = np.r_[0, np.cumsum(size)]
            fa, fz = np.asarray(flat.field("a")), np.asarray(flat.field("z"))
            made: list = []
            for i in range(len(lists)):
                one = data[offs[i] : offs[i + 1]]
                a, z = merged(fa[at[i] : at[i + 1]], fz[at[i] : at[i + 1]])
                if unit == WORDS and len(a):
                    begin, end, _ = B.words(one, np.array([0, len(one)]), B.NOT_SPACE)
                    a, z = begin[a], end[z - 1]
                if digest:
                    h = hashlib.sha256()
                    for x, y in zip(np.r_[0, z], np.r_[a, len(one)]):
                        h.update(one[x:y])
                    made.append((len(one), int((z - a).sum()), len(a), h.hexdigest()))
                elif len(a):
                    made.append(_cut(one, a, z))
                else:
                    made.append(None)
            if digest:
                n, r, k, h = zip(*made) if made else ((), (), (), ())
                more = [batch.column(cols.index("noted")).fill_null(False)] if note_words else []
                yield pa.record_batch([batch.column(cols.index(ident)), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), *more], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["repeats_passage"] if more else [])])
            else:
                new = pa.array([m if m is not None else v.as_py() for m, v in zip(made, batch.column(t))], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text else batch.column(cols.index(c)) for c in out_cols], names=out_cols)

    if digest:
        return joined.mapInArrow(run, f"doc_id {joined.schema[ident].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', repeats_passage boolean' if note_words else ''}")
    fields = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in out_cols)
    cut = joined.mapInArrow(run, fields)
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _cut(one: np.ndarray, a: np.ndarray, z: np.ndarray) -> str:
    """The text without its spans; spans shrink to whole characters."""
    parts, last = [], 0
    for x, y in zip(a, z):
        while x < y and one[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(one) and one[y] & 0xC0 == 0x80:
            y -= 1
        parts.append(one[last:x].tobytes())
        last = y
    parts.append(one[last:].tobytes())
    return b"".join(parts).decode("utf-8", "ignore")
