"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source gets the same expected number of copies, target / source size. The whole part
is taken as it is; the fraction is an inclusion probability. The flight phase moves probabilities along the
null space of the balancing constraints (tokens and documents), three documents at a time, until at most
two of a block are still fractional. These meet again in wider blocks; the last two of a source land, with
a few short documents that waited for it, on the choice that comes nearest to what is left of its total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import _bytes as B
from tracelake.llm._spark import write_shared

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Documents of a block of the first flight, and blocks whose rest meets in the next one.
BLOCK, FAN = 4096, 1024
#: Sources whose targets the driver works out; those of more sources are worked out by rounds over a table.
HELD_SOURCES = 100_000
_EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Token targets: weights by code point of the source (null last), each at most cap times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(n for _, n in order)), dict(order)
    while free:
        total = sum(w[s] for s in free)
        full = [s for s, n in free.items() if left * w[s] / total > cap * n]
        if not full:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in full:
            out[s] = cap * free[s]
        left -= sum(cap * free.pop(s) for s in full)
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities moved until at most two are fractional; token and document totals stay."""
    p, s = p.astype(np.float64).copy(), size.astype(np.float64)
    todo = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    todo.reverse()
    live: list[int] = []
    draws = iter(rng.random(3 * len(p) + 8))
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) < 3:
            if len(live) == 2 and s[live[0]] == s[live[1]]:
                u = (1.0, -1.0)
            else:
                break
        else:
            a, b, c = (s[i] for i in live)
            u = (1.0, -1.0, 0.0) if a == b == c else (b - c, c - a, a - b)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(live, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(live, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(live, u):
            p[i] += step * x
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]
    return p


def reserve(size: np.ndarray) -> int:
    """How many of the shortest documents (sizes fall) wait for the landing: at most half, enough to make up for the longest."""
    n = len(size) // 2
    enough = np.cumsum(size[::-1][:n]) >= 2 * (size[0] if len(size) else 0)
    return int(enough.argmax()) + 1 if enough.any() else n


def land(p: np.ndarray, size: np.ndarray, held: int) -> np.ndarray:
    """Round the last fractional ones and the `held` shortest (at the end, sizes fall) to the nearest token total.

    Each choice for the fractional ones is completed by the longest shorts that still fit.
    """
    n = len(p) - held
    at = np.flatnonzero((p[:n] > 0) & (p[:n] < 1))
    goal = float((p[at] * size[at]).sum() + (p[n:] * size[n:]).sum())
    best, done = None, p
    for m in range(1 << len(at)):
        q = p.copy()
        q[at] = [float(m >> i & 1) for i in range(len(at))]
        q[n:] = 0.0
        left = goal - float((q[at] * size[at]).sum())
        for i in range(n, len(p)):
            if size[i] <= left:
                q[i], left = 1.0, left - size[i]
        if left > 0 and held and (rest := np.flatnonzero(q[n:] == 0)).size:
            i = n + int(rest[-1])  # one more, if that comes nearer
            if abs(left - size[i]) < left:
                q[i], left = 1.0, left - size[i]
        cost = (abs(left), abs(float((q - p).sum())))
        if best is None or cost < best:
            best, done = cost, q
    return done


def _flyer(last: bool):
    """What a block's flight does to its rows; the last one also lands."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fly(pdf, last)

    return fly


def _fly(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    # longest first, so what is left over at the end are short documents; ties and repeated rows in a fixed order
    o = np.lexsort((pdf["row"].to_numpy(), -pdf["size"].to_numpy()))
    pdf = pdf.iloc[o].reset_index(drop=True)
    seed = int(pd.util.hash_array(pdf["row"].to_numpy()[:1])[0]) & 0xFFFFFFFF
    p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
    held = reserve(size) if last else 0
    n = len(p) - held
    p = np.r_[flight(p[:n], size[:n], np.random.default_rng(seed)), p[n:]]
    return pdf.assign(p=land(p, size, held) if last else p)


def token_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and `size`: the number of `[^\\x20\\x09-\\x0D]+` in the text, 0 if it is null."""
    d = docs.select(text_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.column_bytes(batch.column(0))
            n = [np.diff(B.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], B.NOT_SPACE)[2]) for i, j in B.chunks(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=[*keep, "size"])

    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(run, f"{fields}, size long")


def _wide_targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """targets() for (src, n, docs) of any number of sources: (src, n, docs, target), a round of the resharing at a time."""
    spark = totals.sparkSession
    low = (1 << 33) - 1
    placed = write_shared(totals.orderBy(F.asc_nulls_last("src")).withColumn("at", F.monotonically_increasing_id()), "sources")
    per_part = {r.p: r.k for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}  # a row a partition
    before = np.cumsum([0, *[per_part[p] for p in sorted(per_part)]])
    shift = spark.createDataFrame([(int(p), int(b)) for p, b in zip(sorted(per_part), before)] or [(0, 0)], "p long, b long")
    index = F.col("b") + F.col("at").bitwiseAND(F.lit(low))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(index, F.lit(len(weights))).cast("int"))
    rows = placed.join(F.broadcast(shift), F.shiftright("at", 33) == F.col("p")).select("src", "n", "docs", weight.alias("w"), F.lit(False).alias("full"))
    left = float(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    while True:
        rows = write_shared(rows, "sources")
        total = rows.where("not full").agg(F.sum("w")).first()[0]
        over = ~F.col("full") & (F.lit(left) * F.col("w") / F.lit(total or 1.0) > cap * F.col("n"))
        took = rows.where(over).agg(F.sum("n")).first()[0]
        if took is None:
            share = F.lit(left) * F.col("w") / F.lit(total or 1.0)
            return write_shared(rows.select("src", "n", "docs", F.when(F.col("full"), cap * F.col("n")).otherwise(share).cast("double").alias("target")), "source-targets")
        left -= cap * took
        rows = rows.withColumn("full", F.col("full") | over)


def _numbered(rows: DataFrame, order: Column) -> DataFrame:
    """rows (row, rid, ...) with nth: the place of each among the rows of equal `row`, by partition and then by order.

    rid is a stored monotonically_increasing_id(), so a row that stands in a third of the table is numbered
    partition by partition, and only one count a partition meets in one place.
    """
    rows = rows.withColumn("salt", F.shiftright("rid", 33))
    counts = rows.groupBy("row", "salt").agg(F.count(F.lit(1)).alias("k"))
    so_far = Window.partitionBy("row").orderBy("salt")
    base = counts.select("row", "salt", (F.sum("k").over(so_far) - F.col("k")).alias("base"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("row", "salt").orderBy(order)))
    return own.join(base, ["row", "salt"]).withColumn("nth", F.col("base") + F.col("own")).drop("salt", "base", "own")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None, held_sources: int = HELD_SOURCES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the other columns in `keep`, a row for each row of docs.

    taken is size times the copies that the mix takes (0 to cap). Null texts have size 0 and are never
    taken; a null source is a source of its own, last in order. Rows that repeat an id with another text are
    drawn apart. Of k rows that are the same in id, source and text, the whole part of k times their probability
    is taken and the rest drawn once, so repeats cost no room. Draws depend on ids, texts and sizes alone, so
    reruns agree whatever the partitioning.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.col(id_col).cast("string"), source_col, text_col)
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.col(text_col).alias("body"), row.alias("row"))
    sized = write_shared(token_counts(named, "body", ["id", "src", "row"]).withColumn("rid", F.monotonically_increasing_id()), "sizes")
    totals = sized.groupBy("src").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    few = totals.limit(held_sources + 1).collect()
    if len(few) <= held_sources:
        goal = targets([(r.src, r.n) for r in few], weights, cap)
        plans = spark.createDataFrame([(r.src, r.n, r.docs, goal[r.src]) for r in few], "src string, n long, docs long, target double")
    else:
        plans = _wide_targets(totals, weights, cap)
    copies = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    whole = F.least(F.floor(copies + _EPS), F.lit(int(cap)))
    part = copies - whole
    plans = plans.select(F.col("src").alias("plan_src"), F.col("n").alias("source_size"), "target", whole.cast("int").alias("whole"), F.when(part < _EPS, 0.0).otherwise(part).alias("frac"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long").alias("blocks"))
    blocks = plans.agg(F.max("blocks")).first()[0] or 1
    if len(few) <= 10_000:
        plans = F.broadcast(plans)
    rows = sized.join(plans, sized["src"].eqNullSafe(plans["plan_src"])).drop("plan_src")
    draw = rows.where("size > 0 and frac > 0").groupBy("src", "blocks", "row", "size", "frac").agg(F.count(F.lit(1)).alias("same"))
    sure = F.floor(F.col("same") * F.col("frac") + _EPS)
    rest = F.col("same") * F.col("frac") - sure
    draw = write_shared(draw.select("src", F.pmod(F.col("row"), "blocks").alias("block"), "row", "size", F.when(rest < _EPS, 0.0).otherwise(rest).alias("p"), sure.alias("sure"), "same"), "draws")
    schema = "src string, block long, row long, size long, p double"
    settled = []
    flying = draw.where("p > 0").select("src", "block", "row", "size", "p")
    while True:
        last = blocks <= 1
        moved = write_shared(flying.groupBy("src", "block").applyInPandas(_flyer(last), schema), "flight")
        settled.append(moved.where("p = 1").select("src", "row"))
        if last:
            break
        blocks = -(-blocks // FAN)
        flying = moved.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {FAN}"))
    drawn = settled[0]
    for x in settled[1:]:
        drawn = drawn.unionByName(x)
    hits = drawn.withColumn("hits", F.lit(1)).unionByName(draw.where("sure > 0").select("src", "row", F.col("sure").cast("int").alias("hits")))
    hits = hits.groupBy(F.col("src").alias("t_src"), F.col("row").alias("t_row")).agg(F.sum("hits").alias("hits"))
    twins = bool(sized.groupBy("row").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count())
    if twins:
        rows = _numbered(rows, F.col("rid"))
    out = rows.join(hits, (rows["row"] == hits["t_row"]) & rows["src"].eqNullSafe(hits["t_src"]), "left")
    more = F.coalesce("hits", F.lit(0))
    if twins:  # the n-th of some rows that are the same is taken if so many are
        more = (F.col("nth") <= more).cast("int")
    out = out.withColumn("taken", (F.col("size") * (F.col("whole") + more)).cast("long"))
    if not keep:
        return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    made = out.select(F.col("row").alias("m_row"), *([F.col("nth").alias("m_nth")] if twins else []), F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    kept = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], row.alias("row"))
    on = F.col("row") == F.col("m_row")
    if twins:
        kept = _numbered(write_shared(kept.withColumn("rid", F.monotonically_increasing_id()), "kept-rows"), F.col("rid")).drop("rid")
        on = on & (F.col("nth") == F.col("m_nth"))
    return kept.join(made, on).select("doc_id", "size", "source_size", "target", "taken", *[F.col(f"k_{c}").alias(c) for c in keep if c not in ("doc_id", "size", "source_size", "target", "taken")])
