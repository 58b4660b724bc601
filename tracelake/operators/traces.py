"""Trace queries as DataFrame plans: one aggregate by trace, predicates folded into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.fields import first_value, has_field, promote, services_of
from tracelake.request import TraceSearch
from tracelake.schema import NOT_INDEXED, SERVICE


def _services(spans: DataFrame) -> Column:
    """All valid services of a row: the promoted column if it is there."""
    return F.col("services") if "services" in spans.columns else services_of()


def promoted(spans: DataFrame) -> DataFrame:
    """Spans with their services as a column, so that predicates and sets share one look-up a row."""
    return spans if "services" in spans.columns else promote(spans)


def names_service(spans: DataFrame, service: str) -> Column:
    """Whether a row names the service. `-` and the empty text are no services."""
    if service in ("", "-"):
        return F.lit(False)
    return F.array_contains(_services(spans), service)


def indexed_field(name: str, value: str) -> Column:
    """Whether a row has the field in the search index; names outside it match nothing."""
    if not name or not value or name in NOT_INDEXED or name == "name":
        return F.lit(False)
    return has_field(name, value)


def predicates(spans: DataFrame, req: TraceSearch) -> list[Column]:
    out = []
    if req.service_name is not None:
        out.append(names_service(spans, req.service_name))
    if req.operation_name is not None:
        out.append(F.col("name") == req.operation_name)
    return out + [indexed_field(f.name, f.value) for f in req.field_filters]


def limited(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows in the order; no limit means no sort either."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def overlaps(req: TraceSearch, start: str = "start_unix_nano", end: str = "end_unix_nano") -> Column:
    return (F.col(end) >= req.start_unix_nano) & (F.col(start) <= req.end_unix_nano)


def services_per_trace(spans: DataFrame) -> Column:
    """Sorted distinct services of a group of rows. Rows with more than one service are rare: only these send arrays to the aggregate."""
    own = _services(spans)
    more = F.flatten(F.collect_set(F.when(F.size(own) > 1, own)))
    return F.sort_array(F.array_union(F.collect_set(F.get(own, F.lit(0))), more)).alias("services")


def trace_windows(spans: DataFrame) -> DataFrame:
    """(trace_id, start_unix_nano, end_unix_nano)."""
    return spans.groupBy("trace_id").agg(F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"))


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace by end; ties by ingest order or span id."""
    tie = "ingest_seq" if "ingest_seq" in spans.columns else "span_id"
    return spans.where(F.col("trace_id") == trace_id).orderBy("end_unix_nano", tie)


def _all(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def matching_traces(spans: DataFrame, req: TraceSearch, same_row: bool = False, extra: list[Column] | None = None, aggregates: list[Column] | None = None) -> DataFrame:
    """(trace_id, start_unix_nano, end_unix_nano, ...) of the traces that a search finds, without limit.

    Each predicate may hold on another span of the trace; same_row asks for service and operation on one
    span as well. One shuffle by trace; partial aggregates run before it.
    """
    flags = predicates(spans, req)
    if same_row and req.service_name is not None and req.operation_name is not None:
        flags.append(flags[0] & flags[1])
    flags += extra or []
    return _matching(spans, flags, req, aggregates or [])


def _matching(rows: DataFrame, flags: list[Column], req: TraceSearch, aggregates: list[Column]) -> DataFrame:
    """Traces whose window overlaps the range and for which every flag holds on some row."""
    marks = [F.bool_or(f).alias(f"m{i}") for i, f in enumerate(flags)]
    found = rows.groupBy("trace_id").agg(F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"), *aggregates, *marks)
    return found.where(_all([F.col(f"m{i}") for i in range(len(flags))]) & overlaps(req)).drop(*[f"m{i}" for i in range(len(flags))])


_NEWEST = (F.desc, "end_unix_nano"), (F.asc, "trace_id")
#: Hits up to this limit are broadcast to the rows that name their services.
BROADCAST_HITS = 100_000


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    return limited(df, limit, *[f(c) for f, c in _NEWEST])


def _with_services(hits: DataFrame, rows: DataFrame, limit: int | None) -> DataFrame:
    """hits with the sorted distinct services of their rows."""
    own = rows.select("trace_id", _services(rows).alias("services"))
    hits = F.broadcast(hits) if limit is not None and limit <= BROADCAST_HITS else hits
    found = own.join(hits, "trace_id").groupBy("trace_id", "start_unix_nano", "end_unix_nano").agg(services_per_trace(own))
    return _newest(found, limit)


def search_traces(spans: DataFrame, req: TraceSearch) -> DataFrame:
    """(trace_id, start_unix_nano, end_unix_nano, services): newest end first, then trace id.

    Windows cover whole traces, the range is inclusive on both ends. The first aggregate holds only numbers and
    flags, so it stays a hash aggregate; services are gathered for its hits alone. A search that asks for all traces
    takes one aggregate for both.
    """
    spans = promoted(spans)
    if req.limit is None and not predicates(spans, req):
        return matching_traces(spans, req, aggregates=[services_per_trace(spans)])
    return _with_services(_newest(matching_traces(spans, req), req.limit), spans, req.limit)


def list_trace_ids(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id").distinct()


def list_services(spans: DataFrame) -> DataFrame:
    return spans.select(F.explode(_services(spans)).alias("service")).distinct()


def list_field_names(spans: DataFrame) -> DataFrame:
    """Names in the search index: not empty, with a value, not a time."""
    pairs = spans.select(F.explode("fields").alias("f")).select("f.name", "f.value")
    return pairs.where((F.col("name") != "") & (F.col("value") != "") & ~F.col("name").isin(*NOT_INDEXED)).select("name").distinct()


def list_field_values(spans: DataFrame, name: str) -> DataFrame:
    if not name or name in NOT_INDEXED:
        return spans.select(F.lit("").alias("value")).where("false")
    own = F.filter("fields", lambda f: (f["name"] == name) & (f["value"] != ""))
    return spans.select(F.explode(F.transform(own, lambda f: f["value"])).alias("value")).distinct()


def operations_of(spans: DataFrame, service: str) -> DataFrame:
    """Distinct span names on the rows whose service it is (the first service of a row counts)."""
    if service in ("", "-"):
        return spans.select(F.col("name").alias("operation")).where("false")
    own = F.col("service_name") if "service_name" in spans.columns else first_value(SERVICE)
    return spans.where(own == service).select(F.col("name").alias("operation")).distinct()


def field_postings(spans: DataFrame) -> DataFrame:
    """(name, value, trace_id), distinct: which traces hold which field value."""
    pairs = spans.select("trace_id", F.explode("fields").alias("f")).select("f.name", "f.value", "trace_id")
    return pairs.where((F.col("name") != "") & (F.col("value") != "") & ~F.col("name").isin(*NOT_INDEXED)).distinct()


def field_encodings(spans: DataFrame) -> DataFrame:
    """(name, encoding): the narrowest type that holds all values of a field: bool, i64 or string."""
    pairs = spans.select(F.explode("fields").alias("f")).select("f.name", "f.value")
    is_bool = F.lower("value").isin("true", "false")
    is_long = F.col("value").rlike(r"^[+-]?\d+$") & F.col("value").try_cast("bigint").isNotNull()
    kinds = pairs.groupBy("name").agg(F.bool_and(is_bool).alias("b"), F.bool_and(is_long).alias("i"))
    return kinds.select("name", F.when(F.col("b"), "bool").when(F.col("i"), "i64").otherwise("string").alias("encoding"))


def storage_stats(spans: DataFrame) -> DataFrame:
    """One row: rows and distinct traces."""
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_ingested"), F.count(F.lit(1)).alias("traces_tracked"))


def trace_index(spans: DataFrame) -> DataFrame:
    """One row a trace: window, services, operations and distinct fields; searches over it need no shuffle."""
    spans = promoted(spans)
    fields = F.array_distinct(F.flatten(F.collect_set("fields")))
    return spans.groupBy("trace_id").agg(
        F.min("start_unix_nano").alias("start_unix_nano"), F.max("end_unix_nano").alias("end_unix_nano"), services_per_trace(spans),
        F.sort_array(F.collect_set("name")).alias("operations"), fields.alias("fields"),
    )


def search_index(index: DataFrame, req: TraceSearch, whole: bool = True) -> DataFrame:
    """search_traces() over a trace index.

    whole: one row a trace, so a filter does, and its range reaches the scan. Else a trace may have several rows,
    which count together.
    """
    flags = []
    if req.service_name is not None:
        flags.append(F.lit(False) if req.service_name in ("", "-") else F.array_contains("services", req.service_name))
    if req.operation_name is not None:
        flags.append(F.array_contains("operations", req.operation_name))
    flags += [indexed_field(f.name, f.value) for f in req.field_filters]
    if whole:
        return _newest(index.where(_all(flags) & overlaps(req)).select("trace_id", "start_unix_nano", "end_unix_nano", "services"), req.limit)
    hits = _newest(_matching(index, flags, req, []), req.limit)
    return _with_services(hits, index, req.limit)


def exact_quantiles(spans: DataFrame, quantiles: tuple[float, ...], slices: int = 64) -> DataFrame:
    """(name, p50, ...): exact nearest-rank quantiles of the durations of each operation, the value at the rounded index.

    Equal durations are counted first. An operation's counts are cut into slices by duration, so that its running
    sums are the sums of whole slices (few rows) plus those within one slice, and no task holds a whole operation.
    """
    d = F.col("end_unix_nano") - F.col("start_unix_nano")
    counts = spans.groupBy("name", d.alias("d")).agg(F.count(F.lit(1)).alias("k"))
    ends = spans.groupBy("name").agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.count(F.lit(1)).alias("n"))
    part = F.least(F.floor((F.col("d") - F.col("lo")).cast("double") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * slices), F.lit(slices - 1)).cast("int")
    cut = counts.join(ends.select("name", "lo", "hi"), "name").select("name", "d", "k", part.alias("part"))
    before = Window.partitionBy("name").orderBy("part")
    whole = cut.groupBy("name", "part").agg(F.sum("k").alias("s")).select("name", "part", (F.sum("s").over(before) - F.col("s")).alias("base"))
    running = cut.join(whole, ["name", "part"]).withColumn("upto", F.col("base") + F.sum("k").over(Window.partitionBy("name", "part").orderBy("d")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q + 0.5), F.col("d"))).alias(f"p{q * 100:g}")
    return running.join(ends.select("name", "n"), "name").groupBy("name").agg(*[at(q) for q in quantiles])


def missing(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(trace_id) of the traces in wanted that held has no row of."""
    return list_trace_ids(wanted).join(list_trace_ids(held), "trace_id", "left_anti")


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(trace_id) of the traces whose rows are not the same, as bags of rows over the columns, in both. Empty: the replicas are equal."""
    parts = [F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftright(F.xxhash64(F.lit(i), *columns), 20)).alias(f"s{i}") for i in range(3))]  # order-free
    x = a.groupBy("trace_id").agg(*parts)
    y = b.groupBy("trace_id").agg(*parts).toDF("other_id", "m", "t0", "t1", "t2")
    same = F.col("trace_id").eqNullSafe(F.col("other_id")) & (F.col("n") == F.col("m")) & (F.col("s0") == F.col("t0")) & (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))
    return x.join(y, same, "full").where("n is null or m is null").select(F.coalesce("trace_id", "other_id").alias("trace_id")).distinct()


def sorted_list(found: DataFrame, limit: int | None = None) -> DataFrame:
    """A list of one column in byte order, nulls left out, at most limit values."""
    c = found.columns[0]
    out = found.where(F.col(c).isNotNull()).orderBy(c)
    return out if limit is None else out.limit(limit)
