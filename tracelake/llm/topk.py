"""Exact top-k inner products: norm-sorted candidates with Cauchy-Schwarz pruning.

Components become floor(256 * x). Candidates are read in descending length within each
partition and compared in blocks: rotated by an SVD fitted on a bounded sample of the longest
vectors, the first few coordinates give a partial sum, and |rest of query| * |rest of candidate|
bounds what is missing. Only pairs whose bound reaches the query's k-th score so far are scored
exactly; the longest vectors of the table seed these thresholds, so pruning starts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm._spark import write_shared

SCALE = 256.0
#: Longest vectors that seed thresholds and fit the rotation: at most so many, and at most so many bytes.
SEED_ROWS, SEED_BYTES = 4096, 16 << 20
#: Queries that one pass over the candidates takes, by bytes; more queries take more passes, one after the other.
BLOCK_BYTES = 16 << 20
#: Pairs of query and candidate that are bounded at a time.
PAIRS = 1 << 22
_EXACT = float(1 << 53)
_LOW = np.iinfo(np.int64).min


def integer_vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(256 * x) as float64. Rows with null ids, null vectors, and null or non-finite components are left out."""
    ids, col = batch.column(0), batch.column(1)
    n = len(ids)
    if n == 0:
        return {}
    ok = np.asarray(ids.is_valid()) & np.asarray(col.is_valid())
    starts = np.asarray(col.offsets)[:n].astype(np.int64)
    length = np.diff(np.asarray(col.offsets).astype(np.int64))
    flat = col.values
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    key = np.asarray(ids.fill_null(0))
    out = {}
    for d in np.unique(length[ok]):
        if d == 0:
            continue
        rows = np.flatnonzero(ok & (length == d))
        m = values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(axis=1)
        out[int(d)] = (key[rows[good]].astype(np.int64), np.floor(SCALE * m[good]))
    return out


def scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are exact below 2**53, beyond that Python integers are used. Pairs marked as own get 0; other scores beyond 64 bits raise."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return np.where(own, 0, (q @ c.T).astype(np.int64))
    a = [[int(x) for x in r] for r in q]
    b = [[int(x) for x in r] for r in c]
    return np.array([[0 if o else sum(x * y for x, y in zip(r, s)) for s, o in zip(b, p)] for r, p in zip(a, own)], np.int64)  # raises OverflowError


class _Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOW)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take (query index, id, score) triples; at most k a query are kept."""
        if not len(q):
            return
        o = np.lexsort((ids, ~score, q))  # ~x falls as x rises, without overflow
        q, ids, score = q[o], ids[o], score[o]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        q, ids, score, rank = q[keep], ids[keep], score[keep], rank[keep]
        u, at = np.unique(q, return_inverse=True)
        s = np.full((len(u), self.k), _LOW)
        i = np.full((len(u), self.k), np.iinfo(np.int64).max)
        s[at, rank], i[at, rank] = score, ids
        s, i = np.hstack([self.score[u], s]), np.hstack([self.id[u], i])
        o = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.score[u], self.id[u] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


class _Model:
    """Queries of one dimension, rotated, with what the longest vectors already reach."""

    def __init__(self, no: np.ndarray, ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int):
        self.no, self.ids, self.q, self.k = no, ids, q, k
        d = q.shape[1]
        base = seed if len(seed) else q
        _, _, vt = np.linalg.svd(base[:SEED_ROWS], full_matrices=True)
        self.rot = vt.T
        self.head = max(1, min(d, d // 4))
        self.rq = q @ self.rot
        self.norm = np.sqrt((q * q).sum(1))
        self.rest = np.sqrt((self.rq[:, self.head :] ** 2).sum(1))
        self.seed_floor = np.full(len(ids), _LOW)
        if len(seed):
            step = max(1, PAIRS // len(seed))
            for i in range(0, len(ids) if len(seed) >= k else 0, step):
                own = ids[i : i + step, None] == seed_ids[None, :]
                s = scores(q[i : i + step], seed, own)
                s[own] = _LOW
                self.seed_floor[i : i + step] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def search(self, best: _Best, ids: np.ndarray, c: np.ndarray, block: int = 512) -> None:
        norm = np.sqrt((c * c).sum(1))
        order = np.argsort(-norm, kind="stable")
        a = 0
        block = min(block, max(1, PAIRS // len(self.ids)))
        while a < len(order):
            o = order[a : a + block]
            a += block
            top = norm[o[0]]
            floor = np.maximum(best.floor(), self.seed_floor).astype(np.float64)
            # floats err by far less than this slack; equal scores stay in for the tie rule
            slack = 1e-9 * (self.norm * top + np.abs(floor)) + 1e-6
            live = np.flatnonzero(self.norm * top + slack >= floor)
            if not len(live):
                return
            rc = c[o] @ self.rot
            rest = np.sqrt((rc[:, self.head :] ** 2).sum(1))
            bound = self.rq[live, : self.head] @ rc[:, : self.head].T + np.outer(self.rest[live], rest)
            qi, ci = np.nonzero(bound + slack[live][:, None] >= floor[live][:, None])
            if not len(qi):
                continue
            if 4 * len(qi) > bound.size or np.abs(self.q).max() * np.abs(c[o]).max() * c.shape[1] >= _EXACT:
                s = scores(self.q[live], c[o], self.ids[live][:, None] == ids[o][None, :])[qi, ci]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", self.q[live[x]], c[o[y]]) for x, y in zip(np.array_split(qi, len(qi) // 65536 + 1), np.array_split(ci, len(qi) // 65536 + 1))]).astype(np.int64)
            q, v = live[qi], ids[o[ci]]
            keep = (s >= np.maximum(best.floor(), self.seed_floor)[q]) & (self.ids[q] != v)
            best.add(q[keep], v[keep], s[keep])


def _norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query.

    Null ids, null or empty vectors and vectors with null or non-finite components take no part;
    vectors of other lengths than the query's are no candidates. Rows with the query's id count as its own.
    Every other row is a candidate, so one that stands in the table twice can take two places. Query rows of
    equal id and vector are one query, those of one id with different vectors several, each with its own
    ranks. Ties go to the smaller id; with fewer than k candidates all are returned. A score beyond 64 bits
    fails the job. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")).where("vec_id is not null and size(v) > 0")
    v = v.withColumn("norm", _norm(F.col("v"))).where("norm is not null and not isnan(norm)")
    dim = v.select(F.max(F.size("v"))).first()[0] or 1
    seed: dict[int, list] = {}
    rows = max(k + 1, min(SEED_ROWS, SEED_BYTES // (8 * dim)))
    top = v.where("norm < double('Infinity')").orderBy(F.desc("norm"), "vec_id").limit(rows).select("vec_id", "v").toArrow()
    for b in top.to_batches():
        for d, x in integer_vectors(b).items():
            seed.setdefault(d, []).append(x)
    seeds = {d: (np.concatenate([a for a, _ in x]), np.concatenate([m for _, m in x])) for d, x in seed.items()}
    candidates = v.select("vec_id", "v", "norm").sortWithinPartitions(F.desc("norm")).select("vec_id", "v")

    fields = "query bigint, query_id bigint, vec_id bigint, score bigint"

    def one_pass(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: dict[int, _Model] = shared.value
            best = {d: _Best(len(x.ids), k) for d, x in m.items()}
            for batch in batches:
                for d, (ids, c) in integer_vectors(batch).items():
                    if d in m and len(ids):
                        m[d].search(best[d], ids, c)
            for d, b in best.items():
                q, r = np.nonzero(b.id != np.iinfo(np.int64).max)
                for a in range(0, len(q), 50_000):
                    x, y = q[a : a + 50_000], r[a : a + 50_000]
                    yield pa.record_batch([pa.array(m[d].no[x]), pa.array(m[d].ids[x]), pa.array(b.id[x, y]), pa.array(b.score[x, y])], names=["query", "query_id", "vec_id", "score"])

        return candidates.mapInArrow(run, fields)

    parts: list[DataFrame] = []
    block: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    held = count = 0

    def flush(last: bool) -> None:
        """A pass for the queries held; unless it is the last one its results are written and its queries given up."""
        nonlocal block, held
        if held:
            models = {}
            for d, x in block.items():
                none = np.zeros(0, np.int64), np.zeros((0, d))
                models[d] = _Model(np.array([n for n, _, _ in x], np.int64), np.array([i for _, i, _ in x], np.int64), np.array([q for _, _, q in x]), *seeds.get(d, none), k)
            shared = spark.sparkContext.broadcast(models)
            if last:
                parts.append(one_pass(shared))
            else:
                parts.append(write_shared(one_pass(shared), "topk"))
                shared.destroy()
        block, held = {}, 0

    # the stated query rows, streamed to the driver a partition at a time and handled in blocks of bounded size
    for row in v.where("is_query").select("vec_id", "v").distinct().toLocalIterator():
        x = np.array([np.nan if y is None else y for y in row.v], np.float64)
        if np.isfinite(x).all():
            if held >= BLOCK_BYTES:
                flush(False)
            block.setdefault(len(x), []).append((count, row.vec_id, np.floor(SCALE * x)))
            count += 1
            held += 8 * len(x)
    flush(True)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
