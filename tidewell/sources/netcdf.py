"""NetCDF classic files as tidy rows.

Files are read whole by Spark's binary reader, so any file system that Spark reaches will
do, and each is unfolded by one task in batches of ``ROWS`` rows.  Grids of this format
come as many files (by month, say), which is what spreads the work.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 65_536
HEADER_BYTES = 1 << 20
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dims: list[str]
    attrs: dict[str, Any]
    kind: int
    size: int
    begin: int


@dataclass
class Header:
    dims: dict[str, int] = field(default_factory=dict)
    record: str | None = None
    records: int = 0
    attrs: dict[str, Any] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4

    def number(self, fmt: str = ">I") -> int:
        (value,) = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return value

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n + -n % 4
        return out

    def name(self) -> str:
        return self.raw(self.number()).decode()

    def attributes(self) -> dict[str, Any]:
        _, count = self.number(), self.number()
        found = {}
        for _ in range(count):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.raw(n * np.dtype(TYPES[kind]).itemsize)
            found[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
            if kind != 2 and n == 1:
                found[name] = found[name][0]
        return found


def parse_header(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    r, out = _Reader(data), Header()
    out.records = r.number()
    _, count = r.number(), r.number()
    for _ in range(count):
        name, size = r.name(), r.number()
        if size == 0:
            out.record, size = name, out.records
        out.dims[name] = size
    out.attrs = r.attributes()
    names = list(out.dims)
    _, count = r.number(), r.number()
    for _ in range(count):
        name = r.name()
        dims = [names[r.number()] for _ in range(r.number())]
        attrs = r.attributes()
        kind, size = r.number(), r.number()
        out.variables[name] = Variable(name, dims, attrs, kind, size, r.number(">I" if data[3] == 1 else ">Q"))
    return out


def values(data: bytes, head: Header, v: Variable) -> np.ndarray:
    """Values as float64 with NaN for missing ones; scale and offset are applied."""
    shape = [head.dims[d] for d in v.dims]
    kind = np.dtype(TYPES[v.kind])
    if v.dims and v.dims[0] == head.record:
        every = [x for x in head.variables.values() if x.dims and x.dims[0] == head.record]
        n = int(np.prod(shape[1:], dtype=int))
        stride = n * kind.itemsize if len(every) == 1 else sum(x.size for x in every)
        raw = np.concatenate([np.frombuffer(data, kind, n, v.begin + i * stride) for i in range(shape[0])] or [np.zeros(0, kind)])
    else:
        raw = np.frombuffer(data, kind, int(np.prod(shape, dtype=int)), v.begin)
    x = raw.astype(np.float64).reshape(shape)
    for key in ("_FillValue", "missing_value"):
        if key in v.attrs:
            x = np.where(x == v.attrs[key], np.nan, x)
    return x * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0)


def _clock(v: Variable) -> tuple[dt.datetime, int] | None:
    """Epoch and seconds per unit of a time coordinate."""
    found = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", str(v.attrs.get("units", "")))
    if not found:
        return None
    unit, *parts = found.groups()
    return dt.datetime(*(int(p or 0) for p in parts)), SECONDS[unit]


def layout(head: Header) -> tuple[list[str], list[str]]:
    """Dims of the widest variable, and the variables that fit on them; text variables are left out."""
    data = [v for v in head.variables.values() if v.name not in head.dims and v.kind != 2]
    dims = max((v.dims for v in data), key=len, default=list(head.dims))
    return dims, [v.name for v in data if set(v.dims) <= set(dims)]


def axis(data: bytes, head: Header, dim: str) -> np.ndarray | list[str]:
    v = head.variables.get(dim)
    if v is None or v.dims != [dim]:
        return np.arange(head.dims[dim], dtype=float)
    if "labels" in v.attrs:
        return v.attrs["labels"].split(",")
    x = values(data, head, v)
    if clock := _clock(v):
        start = np.datetime64(clock[0], "us")
        return start + np.round(x * clock[1] * 1e6).astype("timedelta64[us]")
    return x


def _kind(head: Header, dim: str) -> str:
    v = head.variables.get(dim)
    if v is None or v.dims != [dim]:
        return "double"
    return "string" if "labels" in v.attrs else "timestamp_ntz" if _clock(v) else "double"


def read_netcdf(spark: SparkSession, path: str) -> DataFrame:
    """All files of ``path`` (a file, a folder or a pattern) with the layout of the first."""
    files = spark.read.format("binaryFile").load(path)
    # Paths alone are listed and put in order; of one file the header is read.
    name = files.select("path").orderBy("path").first()
    if name is None:
        raise FileNotFoundError(path)
    first = files.where(F.col("path") == name.path).select(F.substring("content", 1, HEADER_BYTES).alias("c")).first()
    head = parse_header(bytes(first.c))
    dims, names = layout(head)
    schema = ", ".join([*(f"`{d}` {_kind(head, d)}" for d in dims), *(f"`{n}` double" for n in names)])

    def unfold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                own = parse_header(data)
                shape = [own.dims[d] for d in dims]
                axes = [axis(data, own, d) for d in dims]
                axes = [pa.array(a) if isinstance(a, list) else pa.array(a, pa.timestamp("us")) if a.dtype.kind == "M" else pa.array(a) for a in axes]
                spread = {}
                for n in names:
                    v = own.variables[n]
                    x = values(data, own, v)
                    x = x.transpose(np.argsort([dims.index(d) for d in v.dims])) if v.dims else x
                    spread[n] = np.broadcast_to(x.reshape([own.dims[d] if d in v.dims else 1 for d in dims]), shape)
                for a in range(0, int(np.prod(shape, dtype=int)), ROWS):
                    at = np.unravel_index(np.arange(a, min(a + ROWS, int(np.prod(shape, dtype=int)))), shape)
                    cols = [x.take(pa.array(i)) for x, i in zip(axes, at, strict=True)] + [pa.array(x[at], from_pandas=True) for x in spread.values()]
                    yield pa.RecordBatch.from_arrays(cols, names=[*dims, *names])

    return files.select("content").mapInArrow(unfold, schema)
