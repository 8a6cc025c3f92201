"""NetCDF classic files (versions 1, 2 and 5) by slabs.

The header says where each variable's values are, so a task reads the bytes of
a slab, some steps of the first axis, and nothing else of the file.  Values come
as rows with their coordinates; files are combined by coordinates when
``weather.field_frames`` numbers the axes over all rows.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..session import get_session
from .streams import opened

#: Types by their number, tags of the header's lists (fixed values of the format).
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Bytes of a header that are read at first, and of a slab.
HEAD, SLAB = 1 << 16, 8 << 20

SINCE = re.compile(r"(second|minute|hour|day)s? since (\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    dtype: np.dtype
    begin: int
    step: int  #: bytes from one place of the first axis to the next
    attributes: dict[str, object]


class _Cut(Exception):
    """The bytes at hand end within the header."""


class Header:
    """The variables of a file, from its first bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or len(data) < 4 or data[3] not in (1, 2, 5):
            raise InvalidParameters("no NetCDF file of the classic format")
        self.data, self.at = data, 4
        self.size, self.offset = ("q" if data[3] == 5 else "i"), ("i" if data[3] == 1 else "q")
        records = self._number(self.size)
        dims = [(self._name(), self._number(self.size)) for _ in range(self._list(DIMENSIONS))]
        self._attributes()
        found = [self._variable(dims) for _ in range(self._list(VARIABLES))]
        growing = [v for _, v, grows in found if grows]
        # the values of growing variables alternate, record by record
        sizes = [math.prod(v.shape[1:]) * v.dtype.itemsize for v in growing]
        record = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
        for v in growing:
            v.shape[0], v.step = records, record
        self.variables = {name: v for name, v, _ in found}

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Cut
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self._take(struct.calcsize(kind)))[0]

    def _padded(self, n: int) -> bytes:
        return self._take(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number(self.size)).decode()

    def _list(self, tag: int) -> int:
        found, n = self._number("i"), self._number(self.size)
        if n and found != tag:
            raise InvalidParameters("the header of a NetCDF file is damaged")
        return n

    def _attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._number("i"), self._number(self.size)
            raw = self._padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def _variable(self, dims: list[tuple[str, int]]) -> tuple[str, Variable, bool]:
        name = self._name()
        own = [dims[self._number(self.size)] for _ in range(self._number(self.size))]
        attributes, kind = self._attributes(), self._number("i")
        self._number(self.size)  # bytes in all, which the shape tells as well
        dtype, shape = np.dtype(TYPES[kind]), [n for _, n in own]
        begin = self._number(self.offset)
        return name, Variable([d for d, _ in own], shape, dtype, begin, math.prod(shape[1:]) * dtype.itemsize, attributes), bool(own) and own[0][1] == 0


def header_of(stream) -> Header:
    """Reads more of the file until its header is whole."""
    n = HEAD
    while True:
        try:
            return Header(stream.read_at(min(n, stream.size()), 0))
        except _Cut:
            if n >= stream.size():
                raise InvalidParameters("the header of a NetCDF file is cut") from None
            n *= 4


def values(stream, v: Variable, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` places of the first axis from ``first`` on, as doubles: packed
    values scaled, missing ones NaN."""
    count = v.shape[0] - first if v.shape and count is None else count
    if not v.shape:
        raw = np.frombuffer(stream.read_at(v.dtype.itemsize, v.begin), v.dtype)
        shape: tuple[int, ...] = ()
    else:
        own = math.prod(v.shape[1:]) * v.dtype.itemsize
        shape = (count, *v.shape[1:])
        if v.step == own:
            raw = np.frombuffer(stream.read_at(own * count, v.begin + first * own), v.dtype)
        else:
            raw = np.frombuffer(b"".join(stream.read_at(own, v.begin + (first + i) * v.step) for i in range(count)), v.dtype)
    out = raw.astype(float)
    for name in ("_FillValue", "missing_value"):
        for missing in v.attributes.get(name, []):
            out[raw == missing] = np.nan
    scale, shift = (v.attributes.get(name, [default])[0] for name, default in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return (out * scale + shift).reshape(shape)


def _seconds(v: Variable, axis: np.ndarray) -> np.ndarray:
    """An axis of time as seconds since 1970, by its units."""
    m = SINCE.match(str(v.attributes.get("units", "")))
    if not m:
        return axis
    start = datetime(*(int(x or 0) for x in m.groups()[1:]), tzinfo=UTC)
    return axis * SECONDS[m.group(1)] + start.timestamp()


def load_netcdf(path: str, variable: str, spark: SparkSession | None = None) -> DataFrame:
    """A row for each value of ``variable`` in a file or folder of files: its
    coordinates by the names of its axes (doubles; an axis whose units are like
    ``hours since 1900-01-01`` in seconds since 1970; the place, where a file has
    no values for an axis) and ``variable``, null where it is missing.

    Only the first file's header is read at once, for the names of the axes.
    Files are then listed, their slabs told, and slabs dealt over the tasks.
    """
    session = get_session(spark)
    files = session.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(path).select("path")
    one = files.orderBy("path").first()
    if one is None:
        raise InvalidParameters(f"no NetCDF files in {path}")
    with opened(one.path) as stream:
        known = header_of(stream).variables
    if variable not in known:
        raise InvalidParameters(f"no variable {variable!r}, but {', '.join(known)}")
    dims = known[variable].dims

    def slabs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                with opened(p) as stream:
                    v = header_of(stream).variables.get(variable)
                if v is None or v.dims != dims:
                    raise InvalidParameters(f"{p} has no {variable} over {', '.join(dims)}")
                n = v.shape[0] if v.shape else 1
                step = max(1, SLAB // max(1, math.prod(v.shape[1:]) * 8))
                firsts = list(range(0, n, step))
                yield pd.DataFrame({"path": p, "first": firsts, "count": [min(step, n - f) for f in firsts]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, first, count in zip(frame["path"], frame["first"], frame["count"], strict=True):
                with opened(p) as stream:
                    variables = header_of(stream).variables
                    v = variables[variable]
                    block = values(stream, v, int(first), int(count))
                    axes = []
                    for i, d in enumerate(dims):
                        own = variables.get(d)
                        axis = np.arange(v.shape[i], dtype=float) if own is None or own.dims != [d] else _seconds(own, values(stream, own))
                        axes.append(axis[first : first + count] if i == 0 else axis)
                grid = np.meshgrid(*axes, indexing="ij") if axes else []
                out = pd.DataFrame({d: g.ravel() for d, g in zip(dims, grid, strict=True)})
                out[variable] = pd.Series(block.ravel()).astype(object).where(~np.isnan(block.ravel()), None)
                yield out

    told = files.mapInPandas(slabs, "path string, first long, count long")
    dealt = told.repartition(session.sparkContext.defaultParallelism, "path", "first")
    return dealt.mapInPandas(read, ", ".join(f"`{c}` double" for c in [*dims, variable]))


def encoded(axes: dict[str, tuple[np.ndarray, dict[str, object]]], name: str, data: np.ndarray, attributes: dict[str, object] | None = None, growing: bool = True) -> bytes:
    """A file (version 2) of one variable over ``axes`` (name -> values and
    attributes); the first axis grows if asked for."""
    word = lambda n: struct.pack(">i", n)
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    named = lambda s: word(len(s.encode())) + padded(s.encode())
    listed = lambda tag, parts: (word(tag) if parts else word(0)) + word(len(parts)) + b"".join(parts)
    number = {np.dtype(t): k for k, t in TYPES.items() if k < 7}

    def noted(values: dict[str, object]) -> bytes:
        parts = []
        for key, value in values.items():
            if isinstance(value, str):
                parts.append(named(key) + word(2) + word(len(value.encode())) + padded(value.encode()))
            else:
                own = np.atleast_1d(value).astype(data.dtype.newbyteorder(">") if key in ("_FillValue", "missing_value") else ">f8")
                parts.append(named(key) + word(number[own.dtype]) + word(own.size) + padded(own.tobytes()))
        return listed(ATTRIBUTES, parts)

    data = np.asarray(data)
    dims = list(axes)
    held = [(d, [i], np.asarray(v, ">f8"), a) for i, (d, (v, a)) in enumerate(axes.items())]
    held.append((name, list(range(len(dims))), data.astype(data.dtype.newbyteorder(">")), attributes or {}))
    grows = [growing and ids[0] == 0 for _, ids, _, _ in held]
    record = sum(len(padded(v[0].tobytes())) for g, (_, _, v, _) in zip(grows, held, strict=True) if g)

    def head(begins: list[int]) -> bytes:
        sizes = [0 if growing and i == 0 else len(axes[d][0]) for i, d in enumerate(dims)]
        variables = []
        for (own, ids, v, notes), g, begin in zip(held, grows, begins, strict=True):
            size = len(padded((v[0] if g else v).tobytes()))
            variables.append(named(own) + word(len(ids)) + b"".join(map(word, ids)) + noted(notes) + word(number[v.dtype]) + word(size) + struct.pack(">q", begin))
        return b"CDF\2" + word(len(data) if growing else 0) + listed(DIMENSIONS, [named(d) + word(n) for d, n in zip(dims, sizes, strict=True)]) + listed(ATTRIBUTES, []) + listed(VARIABLES, variables)

    at, begins = len(head([0] * len(held))), [0] * len(held)
    for grown in (False, True):
        for k, ((_, _, v, _), g) in enumerate(zip(held, grows, strict=True)):
            if g == grown:
                begins[k] = at
                at += len(padded((v[0] if g else v).tobytes()))
    whole = head(begins) + b"".join(padded(v.tobytes()) for (_, _, v, _), g in zip(held, grows, strict=True) if not g)
    records = (b"".join(padded(v[i : i + 1].tobytes()) for (_, _, v, _), g in zip(held, grows, strict=True) if g) for i in range(len(data) if growing else 0))
    return whole + b"".join(records) if record else whole
