import hashlib
import math
from collections import Counter

from tracelake.functions import placement as P
from tracelake.operators import metrics

NODES, WEIGHTS, GROUPS = ["oak", "elm", "ash", "fir", "yew"], {"oak": 3}, {"oak": "hill", "elm": "hill", "ash": "vale", "fir": "vale"}


def chosen(trace, replicas, nodes=NODES):
    time = {n: -math.log((int(hashlib.md5(f"{trace}|{n}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / WEIGHTS.get(n, 1) for n in nodes}
    order = sorted(nodes, key=lambda n: (time[n], n))
    late = [any(GROUPS.get(m) == GROUPS.get(n) is not None for m in order[:i]) for i, n in enumerate(order)]
    return [n for _, _, n in sorted(zip(late, range(len(order)), order))][:replicas]


def test_placements(spark):
    ids = [f"t{i}" for i in range(400)]
    df = spark.createDataFrame([(i,) for i in ids], "trace_id string")
    for replicas in (1, 3, 9):
        got = {r.trace_id: r.nodes for r in P.placements(df, NODES, replicas, WEIGHTS, GROUPS).collect()}
        assert got == {i: chosen(i, replicas) for i in ids}
    first = Counter(r.nodes[0] for r in P.placements(df, NODES, 1, WEIGHTS).collect())
    assert 130 < first["oak"] < 215 and all(30 < first[n] < 90 for n in NODES[1:])  # 3 of 7 shares
    without = {r.trace_id: r.nodes[0] for r in P.placements(df, NODES[:-1], 1, WEIGHTS).collect()}
    assert all(without[r.trace_id] == r.nodes[0] for r in P.placements(df, NODES, 1, WEIGHTS).collect() if r.nodes[0] != "yew")


def test_metrics_text(spark):
    stats = spark.createDataFrame([(3, 2)], "rows_total long, traces long")
    assert metrics.text(stats).splitlines() == ["# TYPE tracelake_rows_total counter", "tracelake_rows_total 3", "# TYPE tracelake_traces gauge", "tracelake_traces 2"]
