"""Parquet layout: segments of spans, trace index and logs, listed by a manifest.

A segment is written once and never changed. It counts from the moment on at which a manifest lists it, so
readers see whole appends, a writer that dies leaves nothing behind that anyone reads, and an append that is
repeated under its name does nothing. compact() swaps segments for one in a single manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.fields import promote
from tracelake.operators import traces as T
from tracelake.request import TraceSearch
from tracelake.schema import FIELD, LOGS, SPANS

BUCKETS = 64
#: Spans of one bucket and day are dealt to so many tasks, and files hold so many rows.
SPLITS, ROWS_PER_FILE = 8, 5_000_000
_SPANS = f"{SPANS}, ingest_seq bigint, services array<string>, service_name string, day date, trace_bucket int"
_LOGS = f"{LOGS}, ingest_seq bigint, day date"
_INDEX = f"trace_id string, start_unix_nano bigint, end_unix_nano bigint, services array<string>, operations array<string>, fields array<{FIELD}>"


def bucket_of(trace_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(trace_id), F.lit(buckets)).cast("int")


def _day(nanos: str) -> Column:
    return F.date_from_unix_date(F.expr(f"{nanos} div 86400000000000").cast("int"))


class TraceStore:
    """Spans, trace index and logs below one path.

    Spans are partitioned by the day of their end and by a hash of the trace id, and sorted by trace id within
    files: a look-up by id reads one bucket, a range of time some days, and row groups prune too. Every segment has
    an index of its own, one row a trace, so the index is as new as the spans.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # manifests
    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _latest(self) -> tuple[int, dict]:
        """(version, content) of the newest whole manifest; version 0 is the empty store."""
        fs, folder = self._path("manifest")
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        io = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        for name in names:
            if not name.endswith(".json"):
                continue
            stream = fs.open(self._path("manifest", name)[1])
            try:
                return int(name.removesuffix(".json")), json.loads(io.toString(stream, "UTF-8"))
            except ValueError:  # its writer has not finished, so nothing is committed by it
                continue
            finally:
                stream.close()
        return 0, {"spans": [], "logs": [], "gone": []}

    def _commit(self, change) -> bool:
        """Write the manifest that change(content) makes of the newest; again if another writer was first. False if there is no change."""
        while True:
            version, content = self._latest()
            if (new := change(content)) is None:
                return False
            fs, path = self._path("manifest", f"{max(version, self._newest_name()) + 1:012d}.json")
            try:
                out = fs.create(path, False)
            except Exception as e:
                if "exists" not in str(e).lower():
                    raise
                continue
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            return True

    def _newest_name(self) -> int:
        fs, folder = self._path("manifest")
        return max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=0) if fs.exists(folder) else 0

    def segments(self, kind: str = "spans") -> list[str]:
        return self._latest()[1][kind]

    def _add(self, kind: str, segment: str) -> None:
        self._commit(lambda m: None if segment in m[kind] + m["gone"] else m | {kind: [*m[kind], segment]})

    def _written(self, kind: str, segment: str) -> bool:
        m = self._latest()[1]
        return segment in m[kind] or segment in m["gone"]

    def _read(self, folder: str, segments: list[str], schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{folder}"
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", base).parquet(*[f"{base}/segment={s}" for s in segments]).drop("segment")

    # spans and their index
    def append_spans(self, spans: DataFrame, segment: str | None = None) -> str:
        """Add spans as a segment and return its name. An append under the name of a segment that is there does nothing."""
        segment = segment or uuid.uuid4().hex
        if not self._written("spans", segment):
            self._write_spans(spans, segment)
            self._add("spans", segment)
        return segment

    def _write_spans(self, spans: DataFrame, segment: str) -> None:
        if "ingest_seq" not in spans.columns:
            spans = spans.withColumn("ingest_seq", F.lit(None).cast("bigint"))
        rows = promote(spans).withColumns({"day": _day("end_unix_nano"), "trace_bucket": bucket_of(F.col("trace_id"), self.buckets)})
        (
            rows.repartition("day", "trace_bucket", F.pmod(F.xxhash64("trace_id", "span_id"), F.lit(SPLITS))).sortWithinPartitions("day", "trace_bucket", "trace_id", "end_unix_nano")
            .write.mode("overwrite").partitionBy("day", "trace_bucket").option("maxRecordsPerFile", ROWS_PER_FILE).option("parquet.bloom.filter.enabled#trace_id", "true").parquet(f"{self.path}/spans/segment={segment}")
        )
        T.trace_index(self._read("spans", [segment], _SPANS)).sortWithinPartitions("end_unix_nano").write.mode("overwrite").parquet(f"{self.path}/index/segment={segment}")

    def spans(self) -> DataFrame:
        return self._read("spans", self.segments(), _SPANS)

    def trace(self, trace_id: str) -> DataFrame:
        """Rows of one trace: the bucket is added to the filter, so other buckets are not read, and the id reaches the row groups."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(trace_id), self.buckets).alias("b")).first().b
        return T.get_trace(self.spans().where(F.col("trace_bucket") == bucket), trace_id)

    def index(self) -> DataFrame:
        """The trace index: one row for each trace of each segment."""
        return self._read("index", self.segments(), _INDEX)

    def search(self, req: TraceSearch) -> DataFrame:
        """Search over the index. With one segment its rows are whole traces and range and limit need no shuffle."""
        return T.search_index(self.index(), req, whole=len(self.segments()) <= 1)

    # logs
    def append_logs(self, logs: DataFrame, segment: str | None = None) -> str:
        segment = segment or uuid.uuid4().hex
        if not self._written("logs", segment):
            if "ingest_seq" not in logs.columns:
                logs = logs.withColumn("ingest_seq", F.lit(None).cast("bigint"))
            logs.withColumn("day", _day("time_unix_nano")).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/logs/segment={segment}")
            self._add("logs", segment)
        return segment

    def logs(self) -> DataFrame:
        return self._read("logs", self.segments("logs"), _LOGS)

    # upkeep
    def compact(self, segments: list[str] | None = None) -> str | None:
        """Rewrite segments (all by default) as one and return its name; appends in the meantime stay as they are.

        One manifest takes the old segments out and the new one in. Their files stay for readers that have
        begun; vacuum() deletes them. If another compaction took one of them first, nothing changes.
        """
        old = segments or self.segments()
        if len(old) < 2:
            return None
        new = uuid.uuid4().hex
        self._write_spans(self._read("spans", old, _SPANS).drop("day", "trace_bucket", "services", "service_name"), new)
        swap = lambda m: None if not set(old) <= set(m["spans"]) else m | {"spans": [*[s for s in m["spans"] if s not in old], new], "gone": [*m["gone"], *old]}
        return new if self._commit(swap) else None

    def vacuum(self) -> int:
        """Delete the files of segments that compaction replaced; returns how many folders went. Names stay known, so a late repeat of an append is still a repeat."""
        n = 0
        for segment in self._latest()[1]["gone"]:
            for folder in ("spans", "index"):
                fs, path = self._path(folder, f"segment={segment}")
                n += bool(fs.delete(path, True))
        return n
