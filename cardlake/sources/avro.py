"""Avro records behind a five-byte frame (magic 0, big-endian schema id), as Arrow functions that work on whole columns: no code runs once a row.

For where no Avro reader for Spark is installed. Fields are strings, doubles, booleans, ints and longs, each required or a union of null and its kind."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 5
ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then the same for the others."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - before, size)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _digits(u: np.ndarray) -> np.ndarray:
    """Bytes of each number, seven bits a byte."""
    return 1 + sum((u >> np.uint64(7 * k) != 0).astype(np.int64) for k in range(1, 10))


def _put(out: np.ndarray, at: np.ndarray, u: np.ndarray, size: np.ndarray) -> None:
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        digit = (u[on] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[on] + k] = digit.astype(np.uint8) | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binary values, and where each row's begin; null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def encoded(kinds: list[tuple[str, bool]], id_: int, columns: list[pa.Array]) -> pa.Array:
    """kinds: (kind, nullable) of each column. Null where a required column is, or a double is not a number."""
    n = len(columns[0])
    whole = np.ones(n, dtype=bool)
    parts: list[tuple[str, bool, np.ndarray, object, np.ndarray]] = []
    for (kind, nullable), column in zip(kinds, columns, strict=True):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        if kind == "string":
            data, offs = _bytes(column.cast(pa.string()))
            count = _zigzag(np.diff(offs))
            value, size = (data, offs, count), _digits(count) + np.diff(offs)
        elif kind == "double":
            value = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            there, size = there & ~np.isnan(value), np.full(n, 8)
        elif kind == "boolean":
            value, size = pc.fill_null(column, False).to_numpy(zero_copy_only=False), np.ones(n, np.int64)
        else:
            value = _zigzag(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            size = _digits(value)
        if not nullable:
            whole &= there
        parts.append((kind, nullable, there, value, np.where(there, size, 0) + nullable))
    sizes = np.where(whole, HEAD + sum((p[4] for p in parts), np.zeros(n, np.int64)), 0)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if n else 0, dtype=np.uint8)
    at = (ends - sizes)[whole]
    out[at[:, None] + np.arange(HEAD)] = np.frombuffer(b"\0" + struct.pack(">I", id_), np.uint8)
    at = at + HEAD
    for kind, nullable, there, value, size in parts:
        there, size = there[whole], size[whole]
        if nullable:
            out[at] = np.where(there, 2, 0)
        to = (at + nullable)[there]
        if kind == "string":
            data, offs, count = value
            rows = np.flatnonzero(whole)[there]
            length, digits = np.diff(offs)[rows], _digits(count[rows])
            _put(out, to, count[rows], digits)
            out[_ranges(to + digits, length)] = data[_ranges(offs[rows], length)]
        elif kind == "double":
            out[to[:, None] + np.arange(8)] = value[whole][there].astype("<f8").view(np.uint8).reshape(-1, 8)
        elif kind == "boolean":
            out[to] = value[whole][there]
        else:
            u = value[whole][there]
            _put(out, to, u, _digits(u))
        at = at + size
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return pc.if_else(pa.array(whole), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


class _Reader:
    """Reads field after field of all records; rows that turn out broken are no longer ok, and stay where they are."""

    def __init__(self, framed: pa.Array, id_: int | None):
        self.data, offs = _bytes(framed)
        self.n, self.end = len(framed), offs[1:]
        self.at = offs[:-1] + HEAD
        self.ok = framed.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offs) >= HEAD)
        head = self._gather(np.where(self.ok, offs[:-1], 0), HEAD)
        want = np.frombuffer(b"\0" + struct.pack(">I", id_ or 0), np.uint8)
        self.ok &= (head == want)[:, : 1 if id_ is None else HEAD].all(axis=1)

    def _gather(self, at: np.ndarray, size: int) -> np.ndarray:
        if not len(self.data):
            return np.zeros((len(at), size), np.uint8)
        return self.data[np.minimum(at[:, None] + np.arange(size), len(self.data) - 1)]

    def _fits(self, on: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """on without the rows whose record ends before size more bytes; these are broken."""
        fits = on & (self.at + size <= self.end)
        self.ok &= fits | ~on
        return fits

    def longs(self, on: np.ndarray) -> np.ndarray:
        value, going = np.zeros(self.n, np.uint64), on & self.ok
        for k in range(10):
            going = self._fits(going, 1)
            rows = np.flatnonzero(going)
            if not len(rows):
                break
            byte = self.data[self.at[rows]].astype(np.uint64)
            if k == 9:
                self.ok[rows[byte > 1]] = False  # more than 64 bits
            value[rows] |= (byte & np.uint64(127)) << np.uint64(7 * k)
            self.at[rows] += 1
            going[rows[byte < 128]] = False
        return (value >> np.uint64(1)).view(np.int64) ^ -(value & np.uint64(1)).view(np.int64)

    def field(self, kind: str, nullable: bool) -> tuple[np.ndarray, object]:
        """Which rows have a value, and the values."""
        on = self.ok.copy()
        if nullable:
            branch = self.longs(on)
            self.ok &= ~on | (branch == 0) | (branch == 1)
            on = self.ok & (branch == 1)
        if kind == "string":
            size = self.longs(on)
            self.ok &= ~on | ((size >= 0) & (size <= len(self.data)))
            on = self._fits(on & self.ok, np.where(on & self.ok, size, 0))
            start, size = np.where(on, self.at, 0), np.where(on, size, 0)
            self.at = self.at + size
            return on, (start, size)
        if kind == "double":
            on = self._fits(on, 8)
            value = self._gather(np.where(on, self.at, 0), 8).copy().view("<f8").ravel()
            self.at = self.at + np.where(on, 8, 0)
            return on, value
        if kind == "boolean":
            on = self._fits(on, 1)
            value = self._gather(np.where(on, self.at, 0), 1).ravel() == 1
            self.at = self.at + on
            return on, value
        value = self.longs(on)
        if kind == "int":
            self.ok &= ~on | ((value >= -(2**31)) & (value < 2**31))
        return on, value

    def text(self, start: np.ndarray, size: np.ndarray) -> pa.Array:
        """Strings of spans; rows whose bytes aren't UTF-8 are broken."""
        size = np.where(self.ok, size, 0)
        raw = self.data[_ranges(start, size)] if len(self.data) else self.data
        make = lambda raw, size: pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        found = make(raw, size)
        try:
            return found.cast(pa.large_string())
        except pa.ArrowInvalid:  # rare: the rows with bytes beyond ASCII are tried one by one
            for r in np.unique(np.repeat(np.arange(self.n), size)[raw > 127]).tolist():
                try:
                    found[r].as_py().decode()
                except UnicodeDecodeError:
                    self.ok[r] = False
            size = np.where(self.ok, size, 0)
            return make(self.data[_ranges(start, size)], size).cast(pa.large_string())


def decoded(kinds: list[tuple[str, str, bool]], framed: pa.Array, id_: int | None) -> pa.StructArray:
    """kinds: (name, kind, nullable). ok and the fields; fields of what isn't ok are null."""
    read = _Reader(framed, id_)
    fields = [(name, kind, *read.field(kind, nullable)) for name, kind, nullable in kinds]
    read.ok &= read.at == read.end
    texts = {name: read.text(*value) for name, kind, _, value in fields if kind == "string"}
    columns = [pa.array(read.ok)]
    for name, kind, on, value in fields:
        there = pa.array(on & read.ok)
        plain = texts[name].cast(pa.string()) if kind == "string" else pa.array(value)
        if kind == "int":
            plain = pa.array(np.where(on & read.ok, value, 0).astype(np.int32))
        columns.append(pc.if_else(there, plain, pa.scalar(None, ARROW[kind])))
    return pa.StructArray.from_arrays(columns, names=["ok", *(k[0] for k in kinds)])


def encode(schema: T.StructType, id_: int, *columns: Column) -> Column:
    """Framed records; null where a required field is null."""
    kinds = [(f.dataType.simpleString(), f.nullable) for f in schema]

    @F.arrow_udf("binary")
    def run(*arrays: pa.Array) -> pa.Array:
        return encoded(kinds, id_, list(arrays))

    return run(*columns)


def unwritable(schema: T.StructType, *columns: Column) -> Column:
    """Why a record can't be encoded: the first required field without a value; null if it can."""
    out = F.lit(None).cast("string")
    for f, c in reversed(list(zip(schema, columns, strict=True))):
        if not f.nullable:
            none = c.isNull() | F.isnan(c) if f.dataType == T.DoubleType() else c.isNull()
            out = F.when(none, f"{f.name}: is required").otherwise(out)
    return out


def decode(schema: T.StructType, framed: Column, id_: int | None = None) -> Column:
    """Records as structs; not ok for what isn't a whole record, or (if id_ is given) of another schema."""
    kinds = [(f.name, f.dataType.simpleString(), f.nullable) for f in schema]
    inner = [T.StructField(f.name, f.dataType) for f in schema]

    @F.arrow_udf(T.StructType([T.StructField("ok", T.BooleanType()), *inner]))
    def run(column: pa.Array) -> pa.Array:
        return decoded(kinds, column, id_)

    return run(framed)
