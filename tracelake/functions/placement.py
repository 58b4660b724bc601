"""Weighted rendezvous placement of traces on nodes with topology groups, for layouts outside Spark.

Spark places data itself. Where traces are dealt to stores of one's own (one store a node, say), every reader and
writer finds the nodes of a trace from its id alone: highest random weight, drawn from a digest of id and node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _draw(trace_id: Column, node: Column) -> Column:
    """A number in (0, 1] from the first 13 hexadecimal digits of a digest, 52 bits."""
    digits = F.substring(F.md5(F.concat(trace_id, F.lit("|"), node)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))


def placements(traces: DataFrame, nodes: list[str], replicas: int, weights: dict[str, int] | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """(trace_id, nodes) of (trace_id): at most `replicas` nodes, best first.

    A node's time is -ln(draw) / weight, smallest first, ties by name; weights below 1 count as 1. The first node of
    each group comes before all others of the group; nodes without a group are never held back. Adding or
    taking away a node moves only the traces that it gains or loses.
    """
    weights, groups = weights or {}, groups or {}
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(max(1, weights.get(n, 1)))).alias("weight"), F.lit(groups.get(n)).cast("string").alias("group")) for n in nodes])
    timed = F.transform(known, lambda n: F.struct((-F.log(_draw(F.col("trace_id"), n["name"])) / n["weight"]).alias("time"), n["name"].alias("name"), n["group"].alias("group")))
    ranked = traces.select("trace_id", F.array_sort(timed).alias("r"))
    # later members of a group that is served go behind the others
    late = F.transform("r", lambda n, i: F.struct(F.exists(F.slice("r", 1, i), lambda m: m["group"] == n["group"]).alias("late"), i.alias("i"), n["name"].alias("name")))
    spread = F.array_sort(F.transform(late, lambda n: F.struct(F.coalesce(n["late"], F.lit(False)).alias("late"), n["i"].alias("i"), n["name"].alias("name"))))
    return ranked.select("trace_id", F.transform(F.slice(spread, 1, replicas), lambda n: n["name"]).alias("nodes"))


def shard(trace_id: Column, shards: int) -> Column:
    """A stable shard number of a trace."""
    return F.pmod(F.xxhash64(trace_id), F.lit(max(1, shards))).cast("int")
