"""MinHash near-duplicate groups: SuperMinHash signatures, banding, full verification, union-find.

1. One pass over the texts gives each document's set size, a fingerprint of the set and band hashes of
   its SuperMinHash signature. Equal sets collapse to one representative before anything is compared.
2. Documents that share a band hash form a bucket. Stars instead of all pairs: each bucket compares its
   members with one pivot, on full sets. Links make components.
3. Buckets whose members are then still in several components get a second pivot, the member with the
   fewest rare shingles (held by at most RARE open members). What is open after that is compared across
   components: pairs with a common rare shingle through an index of these, other pairs behind a bound
   that the rare shingles give. Both together are exact; nothing is dropped without proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm._spark import write_shared
from tracelake.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**6)**56 = 4e-8.
BANDS, ROWS = 56, 6
#: A shingle of at most so many open members is rare: all its pairs are looked at, and it leaves the exact bound.
RARE = 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.arange(1, 1 << 16, dtype=np.uint64) * _GOLD  # one stream of draws a level
_CHAIN = 4  # levels whose permutation is followed through its swaps; later ones keep the permutation


def superminhash(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(documents x m) SuperMinHash signatures of the documents' element hashes.

    Every element draws, level by level, a random rank and the next place of its own random permutation
    of the m places; a place takes the smallest level + rank. As level j + 1 can't beat level j, a
    document stops at the first level at which all its places are filled. Documents without elements keep
    the empty value.
    """
    n = len(first) - 1
    sig = np.full(n * m, _EMPTY)
    doc = B.owner(first)
    el, live = elements, doc * m
    swaps: list[np.ndarray] = []
    perm = None
    for j in range(m):
        if not len(el):
            break
        x = B.mix(el + _STEP[j])
        k = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64) + j
        if j < _CHAIN:
            place = k.copy()
            for i in range(j - 1, -1, -1):
                was = swaps[i]
                place = np.where(place == was, i, np.where(place == i, was, place))
            swaps.append(k)
        else:
            row = np.arange(len(el))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(el), 1))
                for i, was in enumerate(swaps):
                    a, b = perm[row, i], perm[row, was]
                    perm[row, i], perm[row, was] = b, a
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = place
        np.minimum.at(sig, live + place, (x >> np.uint64(32)) | np.uint64(j) << np.uint64(32))
        open_docs = (sig.reshape(n, m) == _EMPTY).any(axis=1)
        keep = open_docs[live // m]
        if keep.sum() < 0.8 * len(keep):  # what is done can't change any more, so copying can wait
            el, live = el[keep], live[keep]
            swaps = [s[keep] for s in swaps]
            if perm is not None:
                perm = perm[keep]
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, s.shape[:2]).copy()
    for r in range(rows):
        h = B.mix(h ^ s[:, :, r])
    return h.view(np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's distinct word shingles in order of hash; one for the whole sequence if it has fewer words."""
    d = B.LOWER[data] if lower else data
    s, e, first = B.words(d, offs, B.NOT_SPACE)
    h = B.word_hashes(d, s, e)
    sh = B.combine(h, shingle)
    out, count = [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= shingle:
            u = np.sort(sh[a : b - shingle + 1])
            u = u[np.r_[True, u[1:] != u[:-1]]]
        elif b > a:
            u = B.combine(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        out.append(u)
        count[i + 1] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(count)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)]
    return c[first[1:]] - c[first[:-1]]


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(1))
            for i, j in B.chunks(offs, 1 << 18):
                u, first = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                h = band_hashes(superminhash(u, first, bands * rows), bands, rows)
                n = np.diff(first)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(_sums(u, first).view(np.int64)), pa.array(_sums(B.mix(u ^ _GOLD), first).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands), pa.int32()), pa.array(h.ravel()))],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(cid, n, f1, shingles) of (doc_id, text): the full sets as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(1))
            for i, j in B.chunks(offs):
                u, first = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(_sums(u, first).view(np.int64)), pa.array([u[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["cid", "n", "f1", "shingles"])

    return docs.mapInArrow(run, "cid long, n long, f1 long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    joined = pairs.select("a", "b").join(left, "b").join(right, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _mixed(entries: DataFrame) -> DataFrame:
    """The rows of entries(h, cid, label, ...) whose bucket h has more than one label."""
    many = entries.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    return entries.join(many, "h")


def _labels(links: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    return connected_components(links if extra is None else links.unionByName(extra.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _with_label(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    A-Z are lowered and words are `[^\\x20\\x09-\\x0D]+`; a text with fewer words than a shingle is one
    shingle; null, empty and blank texts have none and link with nothing. Two documents are linked if
    100 * intersection >= percent * union of their full sets. component_id is the smallest id reachable,
    kept is doc_id = component_id. Rows with a null id link with nothing: component_id null, not kept.
    Rows that repeat an id are the same document, so whatever links one links all. Ids of another kind than
    integers (texts, say) are numbered in their own order and come back as they were.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return _by_rank(docs, id_col, text_col, shingle=shingle, percent=percent, bands=bands, rows=rows)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sk = write_shared(sketches(base, shingle, bands, rows), "sketches")
    # equal sets are one class, represented by its smallest id
    classes = sk.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n", "bands").agg(F.min("doc_id").alias("cid"))
    entries = classes.select("cid", F.explode("bands").alias("h"))
    # written first, so that the join below has two plain sides and Spark can split a hot bucket
    stars = write_shared(entries.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("h", "a"), "stars")
    crowded = write_shared(entries.join(stars, "h").select("h", "cid", "a"), "buckets")
    pairs = crowded.where("a < cid").select("a", F.col("cid").alias("b")).distinct()
    need = crowded.select("cid").distinct()
    full = _sets(base.join(need.withColumnRenamed("cid", "doc_id"), "doc_id", "left_semi"), shingle)
    known = classes.select("cid", "f1", "n")
    # a repeated id may have another text: the class's own set is the one with its fingerprint
    sets = write_shared(full.join(known, ["cid", "f1", "n"], "left_semi").dropDuplicates(["cid", "f1"]).select("cid", "n", "shingles"), "sets")
    labels = _labels(_linked(pairs, sets, percent))

    open_ = write_shared(_mixed(_with_label(crowded.select("h", "cid"), labels)), "open")
    if open_.limit(1).count():
        labels = _second_pivot(open_, sets, labels, percent)
    comp = classes.select("f1", "f2", "n", "cid").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("f1", "f2", "n", F.coalesce("label", "cid").alias("c"))
    # members point to their class; repeated ids tie classes together
    rows_ = sk.select("doc_id", "n", "f1", "f2").join(comp, ["f1", "f2", "n"], "left")
    rows_ = _tie_repeated(rows_)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return rows_.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _by_rank(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """near_duplicate_groups() over the ranks of ids that are no integers."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy("id").withColumn("doc_id", F.monotonically_increasing_id())
    ids = write_shared(ids, "ids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left").select("doc_id", "text")
    found = near_duplicate_groups(rows, **options)
    own = ids.select(F.col("id").alias("own"), "doc_id")
    of = ids.select(F.col("id").alias("of"), F.col("doc_id").alias("component_id"))
    return found.join(own, "doc_id", "left").join(of, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("of").alias("component_id"), "kept")


def _tie_repeated(rows: DataFrame) -> DataFrame:
    """Merge the components that rows of one id fall in; does nothing where ids are unique."""
    twice = rows.where("doc_id is not null and c is not null").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b")
    twice = write_shared(twice.select("a", "b"), "repeated")
    if not twice.limit(1).count():
        return rows
    wider = rows.where("doc_id is not null and c is not null").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
    lab = connected_components(wider)
    return rows.drop("c").join(lab.select(F.col("node").alias("doc_id"), F.col("label").alias("c")), "doc_id", "left")


def _second_pivot(open_: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels after the open buckets are settled, see the module's text."""
    members = open_.select("cid").distinct()
    mine = sets.join(members, "cid", "left_semi")
    words = F.expr("transform(sequence(0, cast(n as int) - 1), i -> substring(shingles, i * 8 + 1, 8))")
    held = mine.select("cid", F.explode(words).alias("s"))
    few = held.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE)
    rare = write_shared(held.join(few, "s"), "rare-shingles")
    own = rare.groupBy("cid").agg(F.count(F.lit(1)).alias("r"))
    info = write_shared(mine.select("cid", "n").join(own, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("c")), "shared-counts")
    # c: shingles that are not rare; two members without a common rare shingle have at most the smaller c in
    # common, and partners are at least as large as the smallest member. Those with one are paired below.
    o = open_.join(info, "cid")
    low = o.groupBy("h").agg(F.min("n").alias("least"))
    live = o.join(low, "h").where(F.col("c") * 100 >= percent * (F.col("n") + F.greatest("least", "c") - F.col("c"))).drop("least")
    live = write_shared(_mixed(live), "live")
    pivot = live.groupBy("h").agg(F.min(F.struct(F.expr("n - c").alias("r"), F.col("cid").alias("a"), F.col("label").alias("la"))).alias("p")).select("h", "p.a", "p.la")
    pairs = live.join(pivot, "h").where("label <> la").select("a", F.col("cid").alias("b")).distinct()
    links = write_shared(_linked(pairs, sets, percent), "links")
    labels = _labels(links, labels)
    tagged = _with_label(rare.where("k > 1").select("cid", "s"), labels).join(info.select("cid", "n"), "cid")
    other = tagged.select("s", F.col("cid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    close = tagged.join(other, "s").where((F.col("a") < F.col("cid")) & (F.col("label") != F.col("la")) & (F.least("n", "na") * 100 >= F.greatest("n", "na") * percent))
    by_rare = close.select("a", F.col("cid").alias("b"))
    left = _mixed(_with_label(live.drop("label"), labels))
    left = left.join(left.groupBy("cid").agg(F.collect_list("h").alias("hs")), "cid")
    # across components: the members outside a bucket's largest component against the others, behind the exact bound
    sizes = left.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("h").agg(F.max(F.struct("k", "label")).alias("m")).select("h", F.col("m.label").alias("main"))
    minor = left.join(main, "h").where("label <> main").select("h", F.col("cid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("hs").alias("ha"))
    both = F.least("c", "ca")
    once = F.col("h") == F.array_min(F.array_intersect("hs", "ha"))  # of the buckets that a pair shares, one brings it
    cross = left.join(minor, "h").where((F.col("label") != F.col("la")) & (both * 100 >= percent * (F.col("n") + F.col("na") - both)) & once)
    pairs = write_shared(cross.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).unionByName(by_rare).distinct(), "pairs")
    return _labels(_linked(pairs, sets, percent), labels)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; columns as they came.

    Rows that repeat an id and a text are one document, of which one row stays. Rows of one id with different
    texts, and rows with a null id, are documents of their own; null ids come after all others. Rows with
    neither id nor text are kept.
    """
    text = options.get("text_col", "text")
    odd = docs.where(F.col(text).isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.limit(1).count():
        return _drop_by_row(docs, text, options)
    gone = near_duplicate_groups(docs, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def _drop_by_row(docs: DataFrame, text: str, options: dict) -> DataFrame:
    """drop_near_duplicates() where ids are missing or repeated: each (id, text) gets a number in the order of ids."""
    names, empty = docs.columns, F.col("doc_id").isNull() & F.col(text).isNull()
    keys = ["__k1", "__k2"]  # two hashes name a text
    keyed = docs.where(~empty).withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(11), text)})
    once = write_shared(keyed.dropDuplicates(["doc_id", *keys]), "once")
    numbers = once.select("doc_id", *keys).orderBy(F.asc_nulls_last("doc_id"), *keys).select(F.col("doc_id").alias("__id"), *(F.col(k).alias(f"{k}n") for k in keys), F.monotonically_increasing_id().alias("__row"))
    numbers = write_shared(numbers, "row-numbers")
    same = once["doc_id"].eqNullSafe(numbers["__id"]) & (once["__k1"] == numbers["__k1n"]) & (once["__k2"] == numbers["__k2n"])
    rows = write_shared(once.join(numbers, same).select(*names, "__row"), "numbered")
    groups = near_duplicate_groups(rows.select(F.col("__row").alias("doc_id"), text), **options)
    gone = groups.where("not kept").select(F.col("doc_id").alias("__gone"))
    kept = rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").select(*names)
    return kept.unionByName(docs.where(empty))
