"""Protobuf wire format for whole columns: all messages of a level are read together, a field of each at a time.

A column of messages is one flat byte array with spans. A step reads the next field of every message that has one
left, so the Python work is that of the longest message, not of all of them; the last few long ones are read by themselves.
Messages are written likewise: a column of texts or bytes for each field, joined row by row, from the innermost level outwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: With fewer messages left than this, a step over columns costs more than reading them one by one.
FEW = 12
#: Bytes of a batch that are read or written at once; the arrays beside them take some 50 times as much.
PIECE_BYTES = 1 << 20


class WireError(ValueError):
    """The bytes are no message of this kind."""


@dataclass
class Spans:
    """Slices [start, end) of one byte array, each owned by a message of the level above."""

    data: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def take(self, at: np.ndarray) -> Spans:
        """The slices at these places; -1 stands for an empty one."""
        there = at >= 0
        pick = np.where(there, at, 0)
        if not len(self):
            z = np.zeros(len(at), np.int64)
            return Spans(self.data, z, z, z)
        return Spans(self.data, self.owner[pick], np.where(there, self.start[pick], 0), np.where(there, self.end[pick], 0))

    def gathered(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the slices one after the other."""
        size = self.end - self.start
        offs = np.r_[0, np.cumsum(size)]
        return self.data[np.repeat(self.start - offs[:-1], size) + np.arange(offs[-1])], offs

    def texts(self, mask: np.ndarray | None = None) -> pa.Array:
        """The slices as texts; mask marks nulls. Bytes that are no UTF-8 raise."""
        data, offs = self.gathered()
        out = pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid as e:
            raise WireError(str(e)) from None
        return _masked(out, mask)

    def hexes(self, mask: np.ndarray | None = None) -> pa.Array:
        """The slices as hexadecimal texts; mask marks nulls."""
        data, offs = self.gathered()
        out = pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer((2 * offs).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(_HEX[data]))])
        return _masked(out, mask)

    def items(self) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start, self.end)]


_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)


def _masked(a: pa.Array, mask: np.ndarray | None) -> pa.Array:
    return a if mask is None or not mask.any() else pc.if_else(pa.array(~mask), a, pa.scalar(None, a.type))


def column(bodies: pa.Array) -> Spans:
    """The messages of a binary column; nulls are empty ones."""
    n = len(bodies)
    bodies = bodies.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + n + 1]
    raw = bodies.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Spans(data, np.arange(n), offs[:-1].astype(np.int64), offs[1:].astype(np.int64))


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, places behind them)."""
    value = np.zeros(len(at), np.uint64)
    after = at.copy()
    todo = np.arange(len(at))
    for i in range(10):
        p = at[todo] + i
        if (p >= end[todo]).any():
            raise WireError("truncated")
        byte = data[p]
        value[todo] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * i)
        after[todo] = p + 1
        todo = todo[byte >= 0x80]
        if not len(todo):
            return value, after
    raise WireError("bad varint")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("bad varint")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def _read_one(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(field number, wire type, value, start, end) of each field of one message."""
    at, n, out = 0, len(data), []
    while at < n:
        key = data[at]
        at += 1
        if key >= 0x80:
            key, at = varint(data, at - 1)
        kind, value, start = key & 7, 0, at
        if kind == 2:
            value, start = varint(data, at)
            at = start + value
        elif kind == 0:
            value, at = varint(data, at)
        elif kind == 1 or kind == 5:
            at += 8 if kind == 1 else 4
            value = int.from_bytes(data[start:at], "little")
        else:
            raise WireError("wire type")
        if at > n:
            raise WireError("truncated")
        out.append((key >> 3, kind, value, start, at))
    return out


@dataclass
class Fields:
    """The fields of some messages, those of a message one after the other in their order."""

    data: np.ndarray
    messages: int
    owner: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    value: np.ndarray  # of varints and fixed numbers
    start: np.ndarray
    end: np.ndarray

    def _of(self, number: int, kind: int, strict: bool = True) -> np.ndarray:
        mine = self.number == number
        if strict and (self.kind[mine] != kind).any():
            raise WireError(f"field {number} has another wire type")
        return np.flatnonzero(mine & (self.kind == kind))

    def children(self, number: int) -> Spans:
        """All values of a repeated field of messages, texts or bytes."""
        at = self._of(number, 2)
        return Spans(self.data, self.owner[at], self.start[at], self.end[at])

    def last(self, number: int) -> tuple[Spans, np.ndarray]:
        """(value of a single field of each message, whether it is there)."""
        found = self.children(number)
        at = np.full(self.messages, -1)
        at[found.owner] = np.arange(len(found))
        return found.take(at), at >= 0

    def numbers(self, number: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(value of a single number of each message, whether it is there); other wire types are passed over."""
        at = self._of(number, kind, False)
        out, there = np.zeros(self.messages, np.uint64), np.zeros(self.messages, bool)
        out[self.owner[at]] = self.value[at]
        there[self.owner[at]] = True
        return out, there

    def last_of_all(self) -> np.ndarray:
        """Place of each message's last field, -1 if it has none."""
        at = np.full(self.messages, -1)
        at[self.owner] = np.arange(len(self.owner))
        return at


def fields(spans: Spans) -> Fields:
    """Read all fields of all messages."""
    data, at, end = spans.data, spans.start.copy(), spans.end
    live = np.flatnonzero(at < end)
    steps = []
    while len(live):
        if len(live) <= FEW:
            for m in live.tolist():
                number, kind, value, start, after = zip(*_read_one(data[at[m] : end[m]].tobytes()))
                steps.append((np.full(len(number), m), np.array(number, np.int64), np.array(kind, np.int8), np.array(value, np.uint64), at[m] + np.array(start, np.int64), at[m] + np.array(after, np.int64)))
            break
        stop = end[live]
        key, p = varints(data, at[live], stop)
        kind = (key & np.uint64(7)).astype(np.int8)
        value, start, after = np.zeros(len(live), np.uint64), p.copy(), p.copy()
        if not np.isin(kind, (0, 1, 2, 5)).all():
            raise WireError("wire type")
        some = np.flatnonzero((kind == 0) | (kind == 2))
        if len(some):
            value[some], after[some] = varints(data, p[some], stop[some])
        some = np.flatnonzero(kind == 2)
        start[some] = after[some]
        if (value[some] > np.uint64(len(data))).any():
            raise WireError("truncated")
        after[some] += value[some].astype(np.int64)
        for k, size in ((1, 8), (5, 4)):
            some = np.flatnonzero(kind == k)
            after[some] += size
        if (after > stop).any():
            raise WireError("truncated")
        for k, size in ((1, 8), (5, 4)):
            some = np.flatnonzero(kind == k)
            for i in range(size if len(some) else 0):
                value[some] |= data[p[some] + i].astype(np.uint64) << np.uint64(8 * i)
        steps.append((live, (key >> np.uint64(3)).astype(np.int64), kind, value, start, after))
        at[live] = after
        live = live[at[live] < stop]
    if not steps:
        z = np.zeros(0, np.int64)
        return Fields(data, len(spans), z, z, z.astype(np.int8), z.astype(np.uint64), z, z)
    owner, number, kind, value, start, after = (np.concatenate(x) for x in zip(*steps))
    o = np.argsort(owner, kind="stable")
    return Fields(data, len(spans), owner[o], number[o], kind[o], value[o], start[o], after[o])


def listed(owner: np.ndarray, messages: int, values: pa.Array) -> pa.ListArray:
    """values, in the order of their owners, as a list for each owner."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=messages))].astype(np.int32)), values)


def pieces(values: pa.Array) -> Iterator[pa.Array]:
    """The values in slices of PIECE_BYTES at most, or of one value."""
    if len(values) <= 1 or values.nbytes <= PIECE_BYTES:
        yield values
    else:
        half = len(values) // 2
        yield from pieces(values.slice(0, half))
        yield from pieces(values.slice(half))


_BINARY = pa.large_binary()
_NONE = pa.scalar(b"", _BINARY)


def raw(values: pa.Array) -> pa.Array:
    """Texts or bytes as a column of bytes; nulls are empty."""
    return values.cast(_BINARY).fill_null(b"")


def _made(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(_BINARY, len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.r_[np.int64(0), np.cumsum(size, dtype=np.int64)]


def joined(*parts: pa.Array) -> pa.Array:
    """The parts of each row one after the other."""
    return pc.binary_join_element_wise(*parts, _NONE)


def grouped(values: pa.Array, offs: np.ndarray) -> pa.Array:
    """The values between two offsets as one, for each pair of neighbours; no byte is copied."""
    s = column(values)
    return _made(s.data, np.r_[s.start, s.end[-1:] if len(s) else np.int64(0)][offs])


def children(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, values) of lists; null lists are empty."""
    return _offsets(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()


def columns(rows: pa.StructArray) -> dict[str, pa.Array]:
    """The fields of structs; those of a null struct are null."""
    return dict(zip((f.name for f in rows.type), rows.flatten()))


def _put_varints(value: np.ndarray) -> pa.Array:
    size = np.ones(len(value), np.int64)
    for i in range(1, 10):
        size += value >= np.uint64(1 << 7 * i)
    offs = _offsets(size)
    data = np.zeros(offs[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > i)
        byte = (value[some] >> np.uint64(7 * i) & np.uint64(0x7F)).astype(np.uint8)
        data[offs[some] + i] = byte | np.where(size[some] > i + 1, np.uint8(0x80), np.uint8(0))
    return _made(data, offs)


def _there(there: np.ndarray, values: pa.Array) -> pa.Array:
    return values if there.all() else pc.if_else(pa.array(there), values, _NONE)


def put(number: int, values: pa.Array, there: np.ndarray | None = None) -> pa.Array:
    """Fields of texts, bytes or messages, empty ones too; where there is none, nothing."""
    s = column(values)
    out = joined(pa.scalar(bytes([number << 3 | 2]), _BINARY), _put_varints((s.end - s.start).astype(np.uint64)), values)
    return out if there is None else _there(there, out)


def put_some(number: int, values: pa.Array) -> pa.Array:
    """Fields of texts, bytes or messages that are not empty."""
    s = column(values)
    return put(number, values, s.end > s.start)


def put_ints(number: int, values: pa.Array) -> pa.Array:
    """Fields of whole numbers other than 0."""
    n = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return _there(n != 0, joined(pa.scalar(bytes([number << 3]), _BINARY), _put_varints(n.view(np.uint64))))


def put_fixed(number: int, values: pa.Array) -> pa.Array:
    """Fields of 64-bit numbers above 0."""
    n = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    there = n > 0
    data = np.empty((int(there.sum()), 9), np.uint8)
    data[:, 0] = number << 3 | 1
    data[:, 1:] = n[there].astype("<i8").view(np.uint8).reshape(-1, 8)
    return _made(data.ravel(), _offsets(9 * there))


_DIGIT = np.full(256, 0xFF, np.uint8)
for _i, _c in enumerate(b"0123456789abcdef"):
    _DIGIT[_c] = _DIGIT[ord(chr(_c).upper())] = _i


def unhexed(texts: pa.Array, other) -> pa.Array:
    """Bytes that texts spell in hexadecimal digits; other() makes those of other texts. Nulls are empty."""
    values = raw(texts)
    s = column(values)
    size = s.end - s.start
    offs = _offsets(size)
    digits = _DIGIT[s.data[s.start[0] : s.end[-1]]] if len(s) else np.zeros(0, np.uint8)
    bad = (np.diff(np.r_[0, np.cumsum(digits == 0xFF)][offs]) > 0) | (size % 2 == 1)
    if bad.any():
        digits = digits[np.repeat(~bad, size)]
        offs = _offsets(np.where(bad, 0, size))
    out = _made(digits[0::2] << 4 | digits[1::2], offs // 2)
    if bad.any():
        at = np.flatnonzero(bad)
        place = np.arange(len(out))
        place[at] = len(out) + np.arange(len(at))
        out = pa.concat_arrays([out, pa.array([other(x) for x in texts.take(pa.array(at)).to_pylist()], _BINARY)]).take(pa.array(place))
    return out
