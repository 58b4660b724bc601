"""OTLP/protobuf requests: decoded and encoded a column at a time over Arrow batches, giving the same nested requests as the JSON source.

All messages of a level are read or written together (wire.py), straight from and to Arrow arrays; only nested attribute
values (arrays, maps, bytes) are read one by one. Message and field numbers are those of the public OTLP definitions.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tracelake.schema import MAX_LONG, RESOURCE_LOGS, RESOURCE_SPANS
from tracelake.sources import wire
from tracelake.sources.wire import Fields, Spans, WireError, varint


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(body): one request a file."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("body"))


def unframe_grpc(body: Column) -> Column:
    """The message of a unary gRPC frame; compressed, short or overlong frames fail the job."""
    size = F.conv(F.hex(F.substring(body, 2, 4)), 16, 10).cast("bigint")
    ok = (F.octet_length(body) >= 5) & (F.hex(F.substring(body, 1, 1)) == "00") & (F.octet_length(body) == size + 5)
    return F.when(ok, F.substring(body, F.lit(6), F.octet_length(body))).otherwise(F.raise_error(F.lit("invalid gRPC frame")).cast("binary"))


def parts(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """(field number, wire type, value) of a message; lengths give bytes, fixed ones unsigned numbers."""
    at, n, out = 0, len(data), []
    while at < n:
        key = data[at]
        at += 1
        if key >= 0x80:
            key, at = varint(data, at - 1)
        kind = key & 7
        if kind == 2:
            if at >= n:
                raise WireError("truncated")
            size = data[at]
            at += 1
            if size >= 0x80:
                size, at = varint(data, at - 1)
            end = at + size
            value = data[at:end]
        elif kind == 0:
            value, at = varint(data, at)
            end = at
        elif kind == 1 or kind == 5:
            end = at + (8 if kind == 1 else 4)
            value = int.from_bytes(data[at:end], "little")
        else:
            raise WireError(f"wire type {kind}")
        if end > n:
            raise WireError("truncated")
        at = end
        out.append((key >> 3, kind, value))
    return out


def _signed(x: int, bits: int = 64) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def _double(x: int) -> float:
    return struct.unpack("<d", x.to_bytes(8, "little"))[0]


def any_value(data: bytes):
    """Python value of an AnyValue: text, bool, int, float, list, dict, hexadecimal text of bytes, or None."""
    out = None
    for n, _, v in parts(data):
        if n == 1:
            out = v.decode()
        elif n == 2:
            out = bool(v)
        elif n == 3:
            out = _signed(v)
        elif n == 4:
            out = _double(v)
        elif n == 5:
            out = [any_value(x) for i, _, x in parts(v) if i == 1]
        elif n == 6:
            out = dict(sorted((k, x) for k, x in (key_value(x) for i, _, x in parts(v) if i == 1)))
        elif n == 7:
            out = v.hex()
    return out


def key_value(data: bytes):
    key, value = "", None
    for n, _, v in parts(data):
        if n == 1:
            key = v.decode()
        elif n == 2:
            value = any_value(v)
    return key, value


def _clean(x):
    """JSON has no NaN and no infinities: null."""
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        return None
    if isinstance(x, list):
        return [_clean(y) for y in x]
    return {k: _clean(y) for k, y in x.items()} if isinstance(x, dict) else x


def tagged(x) -> dict:
    """A tagged value; nested ones are compact JSON text."""
    if x is None:
        return {"kind": "string", "value": ""}
    if isinstance(x, bool):
        return {"kind": "bool", "value": "true" if x else "false"}
    if isinstance(x, int):
        return {"kind": "i64", "value": str(x)}
    if isinstance(x, float):
        return {"kind": "f64", "value": repr(x)}
    if isinstance(x, (list, dict)):
        return {"kind": "string", "value": json.dumps(_clean(x), separators=(",", ":"), ensure_ascii=False)}
    return {"kind": "string", "value": x}


_KINDS = pa.array(["string", "bool", "i64", "f64"])


def _values(raw: Spans) -> pa.Array:
    """Tagged values of AnyValue messages; empty ones are the empty text."""
    f = wire.fields(raw)
    at = f.last_of_all()
    number = np.where(at >= 0, f.number[at] if len(f.number) else 0, 0)
    kind = np.where(at >= 0, f.kind[at] if len(f.kind) else 0, 0)
    number[(number > 7) | (number < 1)] = 0
    for i, k in ((1, 2), (2, 0), (3, 0), (4, 1), (5, 2), (6, 2), (7, 2)):
        if (kind[number == i] != k).any():
            raise WireError("wire type of a value")
    text = Spans(raw.data, raw.owner, f.start, f.end).take(np.where(number == 1, at, -1)) if len(f.start) else Spans(raw.data, raw.owner, np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64))
    values = text.texts()
    tag = np.choose(np.minimum(number, 5), [0, 0, 1, 2, 3, 0])
    other = np.flatnonzero(number > 1)
    if len(other):
        x, no = f.value[at[other]], number[other]
        made = np.empty(len(other), object)
        for i in (2, 3, 4):
            some = np.flatnonzero(no == i)
            if i == 2:
                made[some] = np.where(x[some] != 0, "true", "false")
            elif i == 3:
                made[some] = x[some].view(np.int64).astype(str).astype(object)
            else:
                made[some] = [repr(v) for v in x[some].view(np.float64).tolist()]
        for i in np.flatnonzero(no >= 5):
            a = raw.data[raw.start[other[i]] : raw.end[other[i]]].tobytes()
            made[i] = tagged(any_value(a))["value"]
        place = np.arange(len(raw))
        place[other] = len(raw) + np.arange(len(other))
        values = pa.concat_arrays([values, pa.array(made.tolist(), pa.string())]).take(pa.array(place))
    return pa.StructArray.from_arrays([_KINDS.take(pa.array(tag)), values], names=["kind", "value"])


def _attributes(raw: Spans, owner: np.ndarray, messages: int) -> pa.ListArray:
    """Lists of key-value attributes; owner is the message that each belongs to."""
    f = wire.fields(raw)
    pairs = pa.StructArray.from_arrays([f.last(1)[0].texts(), _values(f.last(2)[0])], names=["key", "value"])
    return wire.listed(owner, messages, pairs)


def _nanos(f: Fields, number: int) -> tuple[np.ndarray, np.ndarray]:
    value, there = f.numbers(number, 1)
    return np.minimum(value, np.uint64(MAX_LONG)).astype(np.int64), there


def _int32(f: Fields, number: int) -> np.ndarray:
    return (f.numbers(number, 0)[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _spans(raw: Spans) -> pa.StructArray:
    f = wire.fields(raw)
    (parent, _), (name, named), (status, has_status) = f.last(4), f.last(5), f.last(15)
    s = wire.fields(status)
    names = name.texts()
    if (blank := named & (name.end == name.start)).any():  # an explicit empty name, unlike an absent one
        names = pc.if_else(pa.array(blank), pa.scalar("-"), names)
    attributes = f.children(9)
    code = pa.array(_int32(s, 3), pa.int32())
    return pa.StructArray.from_arrays(
        [
            f.last(1)[0].hexes(), f.last(2)[0].hexes(), parent.hexes(parent.end == parent.start), names, pa.array(_nanos(f, 7)[0]), pa.array(_nanos(f, 8)[0]), _attributes(attributes, attributes.owner, len(raw)),
            pa.StructArray.from_arrays([code, s.last(2)[0].texts()], names=["code", "message"], mask=pa.array(~has_status)),
        ],
        names=["trace_id", "span_id", "parent_span_id", "name", "start_time_unix_nano", "end_time_unix_nano", "attributes", "status"],
    )


def _records(raw: Spans) -> pa.StructArray:
    f = wire.fields(raw)
    (text, _), (trace, _), (span, _) = f.last(3), f.last(9), f.last(10)
    observed, _ = _nanos(f, 11)
    severity = _int32(f, 2)
    attributes = f.children(6)
    return pa.StructArray.from_arrays(
        [
            pa.array(_nanos(f, 1)[0]), pa.array(observed, mask=observed == 0), pa.array(severity, mask=severity <= 0), text.texts(text.end == text.start), _values(f.last(5)[0]),
            trace.hexes(trace.end == trace.start), span.hexes(span.end == span.start), _attributes(attributes, attributes.owner, len(raw)),
        ],
        names=["time_unix_nano", "observed_time_unix_nano", "severity_number", "severity_text", "body", "trace_id", "span_id", "attributes"],
    )


def _requests(bodies: pa.Array, group: str, items: str, read, kind: pa.DataType) -> pa.Array:
    """The nested requests of a column of messages; null bodies give nulls."""
    whole = wire.column(bodies)
    resources = wire.fields(whole).children(1)
    r = wire.fields(resources)
    own, scopes = r.children(1), r.children(2)
    of_resource = wire.fields(own).children(1)
    attributes = _attributes(of_resource, own.owner[of_resource.owner], len(resources))
    s = wire.fields(scopes)
    about, rows = s.children(1), s.children(2)
    a = wire.fields(about)
    own_attributes = a.children(3)

    def told(number: int) -> pa.Array:
        """The last text of all scope messages of a group, null if none has it."""
        found = a.children(number)
        at = np.full(len(scopes), -1)
        at[about.owner[found.owner]] = np.arange(len(found))
        return found.take(at).texts(at < 0)

    scope = pa.StructArray.from_arrays([told(1), told(2), _attributes(own_attributes, about.owner[own_attributes.owner], len(scopes)), wire.listed(rows.owner, len(scopes), read(rows))], names=["scope_name", "scope_version", "scope_attributes", items])
    resource = pa.StructArray.from_arrays([attributes, wire.listed(scopes.owner, len(resources), scope)], names=["resource_attributes", group])
    out = wire.listed(resources.owner, len(bodies), resource).cast(kind)
    if bodies.null_count:
        out = pc.if_else(bodies.is_valid(), out, pa.scalar(None, kind))
    return out


def _list(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


# the nested types of schema.py as Arrow has them
_TEXT, _LONG, _INT = pa.string(), pa.int64(), pa.int32()
_VALUE = pa.struct([("kind", _TEXT), ("value", _TEXT)])
_KV = pa.struct([("key", _TEXT), ("value", _VALUE)])
_SPAN = pa.struct([("trace_id", _TEXT), ("span_id", _TEXT), ("parent_span_id", _TEXT), ("name", _TEXT), ("start_time_unix_nano", _LONG), ("end_time_unix_nano", _LONG), ("attributes", _list(_KV)), ("status", pa.struct([("code", _INT), ("message", _TEXT)]))])
_RECORD = pa.struct([("time_unix_nano", _LONG), ("observed_time_unix_nano", _LONG), ("severity_number", _INT), ("severity_text", _TEXT), ("body", _VALUE), ("trace_id", _TEXT), ("span_id", _TEXT), ("attributes", _list(_KV))])


def _resources(group: str, items: str, item: pa.DataType) -> pa.DataType:
    scope = pa.struct([("scope_name", _TEXT), ("scope_version", _TEXT), ("scope_attributes", _list(_KV)), (items, _list(item))])
    return _list(pa.struct([("resource_attributes", _list(_KV)), (group, _list(scope))]))


_RESOURCE_SPANS, _RESOURCE_LOGS = _resources("scope_spans", "spans", _SPAN), _resources("scope_logs", "log_records", _RECORD)


def decode_traces(bodies: pa.Array) -> pa.Array:
    """Nested resource spans of a column of protobuf requests."""
    return _requests(bodies, "scope_spans", "spans", _spans, _RESOURCE_SPANS)


def decode_logs(bodies: pa.Array) -> pa.Array:
    return _requests(bodies, "scope_logs", "log_records", _records, _RESOURCE_LOGS)


def _put_varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _put(number: int, data: bytes) -> bytes:
    return _put_varint(number << 3 | 2) + _put_varint(len(data)) + data


def _put_text(number: int, text: str | None) -> bytes:
    return _put(number, text.encode()) if text else b""


def _put_int(number: int, n: int | None) -> bytes:
    return _put_varint(number << 3) + _put_varint(n) if n else b""


def _put_fixed(number: int, n: int | None) -> bytes:
    return _put_varint(number << 3 | 1) + max(0, n).to_bytes(8, "little") if n and n > 0 else b""


def id_bytes(text: str | None, size: int) -> bytes:
    """Bytes of an id: what an even number of hexadecimal digits spells, else a digest, so that equal ids stay equal."""
    if not text:
        return b""
    try:
        return bytes.fromhex(text) if text.isalnum() else hashlib.blake2b(text.encode(), digest_size=size).digest()
    except ValueError:
        return hashlib.blake2b(text.encode(), digest_size=size).digest()


def _put_value(v: dict | None) -> bytes:
    kind, text = (v or {}).get("kind"), (v or {}).get("value") or ""
    if kind == "bool":
        return _put_varint(2 << 3) + (b"\1" if text == "true" else b"\0")
    if kind == "i64":
        return _put_varint(3 << 3) + _put_varint(int(text))
    if kind == "f64":
        return _put_varint(4 << 3 | 1) + struct.pack("<d", float(text))
    return _put(1, text.encode())


@lru_cache(maxsize=1 << 16)  # attributes come again and again
def _put_tagged(kind: str, value: str | None) -> bytes:
    return _put_value({"kind": kind, "value": value})


def _put_kvs(number: int, kvs) -> bytes:
    return b"".join(_put(number, _put_text(1, kv["key"]) + _put(2, _put_value(kv["value"]))) for kv in kvs or [])


def _put_values(values: pa.StructArray) -> pa.Array:
    """AnyValue messages of tagged values; null ones are the empty text."""
    v = wire.columns(values)
    out = wire.put(1, wire.raw(v["value"]))
    other = np.flatnonzero(pc.is_in(v["kind"], _KINDS[1:]).to_numpy(zero_copy_only=False))
    if len(other):
        at = pa.array(other)
        made = pa.array([_put_tagged(k, x) for k, x in zip(v["kind"].take(at).to_pylist(), v["value"].take(at).to_pylist())], out.type)
        place = np.arange(len(out))
        place[other] = len(out) + np.arange(len(other))
        out = pa.concat_arrays([out, made]).take(pa.array(place))
    return out


def _put_attributes(number: int, lists: pa.ListArray) -> pa.Array:
    offs, kvs = wire.children(lists)
    kv = wire.columns(kvs)
    return wire.grouped(wire.put(number, wire.joined(wire.put_some(1, wire.raw(kv["key"])), wire.put(2, _put_values(kv["value"])))), offs)


def _ids(texts: pa.Array, size: int) -> pa.Array:
    return wire.unhexed(texts, lambda text: id_bytes(text, size))


def _put_spans(spans: pa.StructArray) -> pa.Array:
    x = wire.columns(spans)
    status = wire.columns(x["status"])
    return wire.joined(
        wire.put(1, _ids(x["trace_id"], 16)), wire.put(2, _ids(x["span_id"], 8)), wire.put_some(4, _ids(x["parent_span_id"], 8)), wire.put_some(5, wire.raw(x["name"])), wire.put_fixed(7, x["start_time_unix_nano"]), wire.put_fixed(8, x["end_time_unix_nano"]),
        _put_attributes(9, x["attributes"]), wire.put(15, wire.joined(wire.put_some(2, wire.raw(status["message"])), wire.put_ints(3, status["code"])), x["status"].is_valid().to_numpy(zero_copy_only=False)),
    )


def _put_records(records: pa.StructArray) -> pa.Array:
    x = wire.columns(records)
    return wire.joined(
        wire.put_fixed(1, x["time_unix_nano"]), wire.put_ints(2, x["severity_number"]), wire.put_some(3, wire.raw(x["severity_text"])), wire.put(5, _put_values(x["body"]), x["body"].is_valid().to_numpy(zero_copy_only=False)),
        _put_attributes(6, x["attributes"]), wire.put_some(9, _ids(x["trace_id"], 16)), wire.put_some(10, _ids(x["span_id"], 8)), wire.put_fixed(11, x["observed_time_unix_nano"]),
    )


def _put_requests(requests: pa.ListArray, group: str, items: str, put) -> pa.Array:
    of_request, resources = wire.children(requests)
    r = wire.columns(resources)
    of_resource, scopes = wire.children(r[group])
    s = wire.columns(scopes)
    of_scope, rows = wire.children(s[items])
    about = wire.joined(wire.put_some(1, wire.raw(s["scope_name"])), wire.put_some(2, wire.raw(s["scope_version"])), _put_attributes(3, s["scope_attributes"]))
    scope = wire.put(2, wire.joined(wire.put_some(1, about), wire.grouped(wire.put(2, put(rows)), of_scope)))
    resource = wire.joined(wire.put(1, _put_attributes(1, r["resource_attributes"])), wire.grouped(scope, of_resource))
    return wire.grouped(wire.put(1, resource), of_request).cast(pa.binary())


def encode_trace_column(requests: pa.Array) -> pa.Array:
    """Protobuf requests of a column of nested resource spans; null ones are empty."""
    return _put_requests(requests, "scope_spans", "spans", _put_spans)


def encode_log_column(requests: pa.Array) -> pa.Array:
    return _put_requests(requests, "scope_logs", "log_records", _put_records)


def encode_traces(resource_spans) -> bytes:
    return encode_trace_column(pa.array([resource_spans], _RESOURCE_SPANS))[0].as_py()


def encode_logs(resource_logs) -> bytes:
    return encode_log_column(pa.array([resource_logs], _RESOURCE_LOGS))[0].as_py()


def _in_pieces(df: DataFrame, column: str, convert, name: str, kind: str) -> DataFrame:
    """convert() over a column in pieces bounded by their bytes, so that a worker's memory doesn't grow with the rows of a batch or their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in wire.pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([convert(piece)], names=[name])

    return df.select(column).mapInArrow(run, StructType().add(name, _parse_datatype_string(kind)))


def parse_trace_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(resource_spans) of protobuf bytes; bytes that are no request fail the job."""
    return _in_pieces(bodies, body, decode_traces, "resource_spans", RESOURCE_SPANS)


def parse_log_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    return _in_pieces(bodies, body, decode_logs, "resource_logs", RESOURCE_LOGS)


def to_trace_bodies(requests: DataFrame) -> DataFrame:
    """(body) of (resource_spans)."""
    return _in_pieces(requests, "resource_spans", encode_trace_column, "body", "binary")


def to_log_bodies(requests: DataFrame) -> DataFrame:
    return _in_pieces(requests, "resource_logs", encode_log_column, "body", "binary")
