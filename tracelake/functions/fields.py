"""Columns over the ordered attribute multi-map: look-up, membership, normalisation, ids and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.schema import RESERVED, SERVICE


def normalize(c: Column) -> Column:
    """An empty text is `-`."""
    return F.when(c == "", F.lit("-")).otherwise(c)


def float_text(d: Column) -> Column:
    """A double in plain digits: no exponent, no trailing .0."""
    return _plain_digits(d.cast("string"))


def _plain_digits(s: Column) -> Column:
    """Text of a double without its exponent; few have one, so the others are done with after a look for it."""
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mantissa, e = F.translate(F.substring_index(s, "E", 1), "-", ""), F.substring_index(s, "E", -1).try_cast("int")
    whole, frac = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    frac = F.when(frac == "0", "").otherwise(frac)
    digits, n = F.concat(whole, frac), F.length(frac)
    big = F.concat(digits, F.repeat(F.lit("0"), F.greatest(e - n, F.lit(0))))
    inside = F.concat(F.substring(digits, F.lit(1), F.length(whole) + e), F.lit("."), F.substring(digits, F.length(whole) + e + 1, F.lit(400)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digits)
    plain = F.when(e < 0, small).when(n > e, inside).otherwise(big)
    short = F.when(s.endswith(".0"), F.substring(s, F.lit(1), F.length(s) - 2)).when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(s)
    return F.when(s.contains("E"), F.concat(sign, plain)).otherwise(short)


def flat_value(v: Column) -> Column:
    """Text of a tagged value {kind, value}."""
    kind, text = v["kind"], F.coalesce(v["value"], F.lit(""))
    number = F.coalesce(float_text(text.try_cast("double")), text)
    return F.when(kind == "f64", number).when(kind == "bool", F.lower(text)).when(text == "", F.lit("-")).otherwise(text)


def prefixed(attributes: Column, prefix: str) -> Column:
    """Fields of key-value attributes, in their order."""
    kvs = F.coalesce(attributes, F.expr("array()").cast("array<struct<key:string,value:struct<kind:string,value:string>>>"))
    return F.transform(kvs, lambda x: F.named_struct(F.lit("name"), F.concat(F.lit(prefix), x["key"]), F.lit("value"), flat_value(x["value"])))


def optional_field(name: str, value: Column) -> Column:
    """One field if the value is there, else none."""
    one = F.array(F.struct(F.lit(name).alias("name"), normalize(value).alias("value")))
    return F.when(value.isNotNull(), one).otherwise(F.expr("array()").cast("array<struct<name:string,value:string>>"))


def first_value(name: str, fields: str | Column = "fields") -> Column:
    """Value of the first field of that name; null if there is none."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]


def has_field(name: str, value: str, fields: str | Column = "fields") -> Column:
    """Whether any field of that name has that value."""
    return F.exists(fields, lambda f: (f["name"] == name) & (f["value"] == value))


def valid_service(c: Column) -> Column:
    return F.when((c != "") & (c != "-"), c)


def services_of(fields: str | Column = "fields") -> Column:
    """All valid services that a row names."""
    return F.transform(F.filter(fields, lambda f: (f["name"] == SERVICE) & (f["value"] != "") & (f["value"] != "-")), lambda f: f["value"])


def promote(spans: DataFrame) -> DataFrame:
    """Add what searches ask for most as plain columns: service_name (first valid) and services (all)."""
    found = services_of()
    return spans.withColumn("services", found).withColumn("service_name", F.get("services", F.lit(0)))


def strip_reserved(fields: Column) -> Column:
    return F.filter(fields, lambda f: ~f["name"].isin(*RESERVED))


def sort_fields(fields: Column) -> Column:
    """Fields by name, equal names in their order."""
    placed = F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), i.alias("i"), f["value"].alias("value")))
    return F.transform(F.sort_array(placed), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))


def canonical_span_id(c: Column) -> Column:
    """Ids of exactly 16 hexadecimal digits in lower case."""
    return F.when(c.rlike("^[0-9A-Fa-f]{16}$"), F.lower(c)).otherwise(c)


def span_value(name: str) -> Column:
    """A virtual or dynamic field of a span as text."""
    virtual = {
        "_time": F.col("time_unix_nano").cast("string"), "trace_id": F.col("trace_id"), "span_id": F.col("span_id"), "parent_span_id": F.col("parent_span_id"), "name": F.col("name"),
        "duration": (F.col("end_unix_nano") - F.col("start_unix_nano")).cast("string"), "start_time_unix_nano": F.col("start_unix_nano").cast("string"), "end_time_unix_nano": F.col("end_unix_nano").cast("string"),
    }
    return virtual[name] if name in virtual else first_value(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_PRIME, _START, _FEW = 0x100000001B3, 0xCBF29CE484222325, 16


def _fnv1a64(texts: pa.Array) -> pa.Array:
    """A byte of every text that has one left at a time, longest texts first; the last few long ones by themselves."""
    values = texts.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    start, size = offs[:-1][order], size[order]
    together = int(size[_FEW]) if len(size) > _FEW else 0
    h = np.full(len(values), _START, np.uint64)
    for i, n in enumerate(np.searchsorted(-size, -np.arange(together), "left").tolist()):  # n texts are longer than i
        h[:n] ^= data[start[:n] + i]
        h[:n] *= np.uint64(_PRIME)
    for j in np.flatnonzero(size > together).tolist():
        x = int(h[j])
        for b in data[start[j] + together : start[j] + size[j]].tobytes():
            x = (x ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
        h[j] = x
    out = np.empty_like(h)
    out[order] = h
    digits = _HEX[out.byteswap().view(np.uint8)].reshape(-1)
    return pa.Array.from_buffers(pa.string(), len(out), [None, pa.py_buffer(np.arange(0, 16 * len(out) + 1, 16, dtype=np.int32)), pa.py_buffer(digits)])


_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)


def fnv1a64(c: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes as 16 hexadecimal digits; over Arrow columns, as Spark has no product modulo 2^64."""
    return F.arrow_udf(_fnv1a64, StringType())(c)


def log_id(resource: Column, scope: Column, record: Column, time: Column, body: Column, trace_id: Column, span_id: Column) -> Column:
    """Identity of a log record: its time, and a hash over its place in the request, body and ids."""
    seed = F.concat_ws(":", resource.cast("string"), scope.cast("string"), record.cast("string"), time.cast("string"), body, F.coalesce(trace_id, F.lit("-")), F.coalesce(span_id, F.lit("-")))
    return F.concat(F.lit("log-"), time.cast("string"), F.lit("-"), fnv1a64(seed))


def field_map_text(fields: str | Column = "fields") -> Column:
    """Fields in their order as name=value pairs, for flat results."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.lit("="), f["value"])), ",")


def unix_millis(c: Column) -> Column:
    """Milliseconds since the epoch of a time stamp; earlier fractions count towards the epoch's side, as time stamps do."""
    return F.unix_millis(c.cast("timestamp"))


def millis_timestamp(c: Column) -> Column:
    """The time stamp of milliseconds since the epoch."""
    return F.timestamp_millis(c)
