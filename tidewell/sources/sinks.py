"""Writers of results: a Zarr store, a store with one Parquet table per variable, or classic NetCDF."""

from __future__ import annotations

import datetime as dt
import json
import struct
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.model import ResultSet, named
from tidewell.sources.zarr import Store, write_zarr

SIDECAR = "attributes.json"
FILL = 9.96921e36
#: Values of a NetCDF file at most; larger results belong in a store.
NETCDF_VALUES = 50_000_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def write_store(spark: SparkSession, results: ResultSet, path: str, attrs: dict[str, Any], append: bool = False) -> None:
    """One folder ``{path}/{variable}`` per variable, and attributes beside them.

    Without ``append`` the store is replaced; with it, variables of the same name are
    replaced and all others stay.  Variables have files of their own, so writers that
    add different variables do not meet.  Results with the same dims are computed once,
    as one wide table that is then split and dropped.
    """
    fs, root = _fs(spark, path)
    if not append and fs.exists(root):
        fs.delete(root, True)
    known = _read_json(spark, f"{path}/{SIDECAR}") if append else {}
    variables = dict(known.get("variables", {}))
    passing = f"{path}.writing-{uuid.uuid4().hex}"
    try:
        for i, result in enumerate(results.values()):
            (result.df.orderBy(*map(named, result.dims)) if result.dims else result.df).write.parquet(f"{passing}/{i}")
            wide = spark.read.schema(result.df.schema).parquet(f"{passing}/{i}")
            for name in result.variables:
                wide.select(*map(named, result.dims), named(name)).write.mode("overwrite").parquet(f"{path}/{name}")
                variables[name] = {"dims": list(result.dims), "attrs": dict(result.df.schema[name].metadata or {})}
    finally:
        fs.delete(_fs(spark, passing)[1], True)
    _write_bytes(spark, f"{path}/{SIDECAR}", json.dumps({"attrs": attrs, "variables": variables}, indent=1, default=str).encode())


def read_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def store_info(spark: SparkSession, path: str) -> dict:
    return _read_json(spark, f"{path}/{SIDECAR}")


def consolidate(spark: SparkSession, path: str) -> None:
    """Gather the metadata of a Zarr store, or rebuild the attribute file from the variables that are there."""
    if (zarr := Store(spark, path)).exists(".zgroup"):
        zarr.consolidate()
        return
    info = store_info(spark, path)
    fs, root = _fs(spark, path)
    there = {s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()}
    kept = {k: v for k, v in info.get("variables", {}).items() if k in there}
    for name in sorted(there - set(kept)):
        cols = spark.read.parquet(f"{path}/{name}").columns
        kept[name] = {"dims": [c for c in cols if c != name], "attrs": {}}
    _write_bytes(spark, f"{path}/{SIDECAR}", json.dumps({"attrs": info.get("attrs", {}), "variables": kept}, indent=1).encode())


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + _padded(raw)


def _attributes(attrs: dict[str, Any]) -> bytes:
    if not attrs:
        return struct.pack(">II", 0, 0)
    out = struct.pack(">II", 12, len(attrs))
    for k, v in attrs.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out += _name(k) + struct.pack(">IId", 6, 1, float(v))
        else:
            raw = str(v).encode()
            out += _name(k) + struct.pack(">II", 2, len(raw)) + _padded(raw)
    return out


def write_netcdf(spark: SparkSession, results: ResultSet, path: str, attrs: dict[str, Any]) -> None:
    """A NetCDF classic file (64-bit offsets) of at most NETCDF_VALUES values, made on the driver.

    String labels become positions, with the labels in the attribute ``labels``.
    """
    import numpy as np

    labels: dict[str, list] = {}
    for dims, result in results.items():
        for d in dims:
            found = [r[0] for r in result.df.select(d).distinct().orderBy(d).collect()]
            if labels.setdefault(d, found) != found:
                labels[d] = sorted({*labels[d], *found})
    total = sum(len(r.variables) * int(np.prod([len(labels[d]) for d in dims] or [1])) for dims, r in results.items())
    if total > NETCDF_VALUES:
        raise ValueError(f"{total} values are too many for a NetCDF file; write a .zarr store")
    order = {d: i for i, d in enumerate(labels)}
    found: list[tuple[str, tuple[str, ...], dict, np.ndarray]] = []
    for d, values in labels.items():
        extra: dict[str, Any] = {}
        if values and isinstance(values[0], (int, float)):
            axis = np.array(values, float)
        elif values and isinstance(values[0], (dt.date, dt.datetime)):
            axis, extra = np.array([(dt.datetime(*v.timetuple()[:6]) - dt.datetime(1970, 1, 1)).total_seconds() for v in values]), {"units": "seconds since 1970-01-01"}
        else:
            axis, extra = np.arange(len(values), dtype=float), {"labels": ",".join(map(str, values))}
        found.append((d, (d,), extra, axis))
    for dims, result in results.items():
        shape = [len(labels[d]) for d in dims]
        at = {d: {v: i for i, v in enumerate(labels[d])} for d in dims}
        arrays = {v: np.full(shape, FILL, dtype=float) for v in result.variables}
        for row in result.df.toLocalIterator(prefetchPartitions=True):
            where = tuple(at[d][row[d]] for d in dims)
            for v, a in arrays.items():
                if row[v] is not None:
                    a[where] = float(row[v])
        found += [(v, dims, {**(result.df.schema[v].metadata or {}), "_FillValue": FILL}, a) for v, a in arrays.items()]
    head = b"CDF\x02" + struct.pack(">I", 0)
    head += struct.pack(">II", 10, len(labels)) if labels else struct.pack(">II", 0, 0)
    head += b"".join(_name(d) + struct.pack(">I", len(v)) for d, v in labels.items())
    head += _attributes(attrs) + struct.pack(">II", 11, len(found))
    entries = [_name(v) + struct.pack(">I", len(dims)) + b"".join(struct.pack(">I", order[d]) for d in dims) + _attributes(extra) + struct.pack(">II", 6, a.size * 8) for v, dims, extra, a in found]
    begin = len(head) + sum(len(e) + 8 for e in entries)
    bodies = []
    for e, (_, _, _, a) in zip(entries, found, strict=True):
        head += e + struct.pack(">Q", begin)
        bodies.append(a.astype(">f8").tobytes())
        begin += len(bodies[-1])
    _write_bytes(spark, path, b"".join([head, *bodies]))


def write(spark: SparkSession, results: ResultSet, path: str, attrs: dict[str, Any], append: bool = False, chunks: dict[str, int] | None = None) -> None:
    """By extension: ``.nc`` is a NetCDF file, ``.zarr`` a Zarr store, ``.parquet`` a store of Parquet tables."""
    if path.endswith(".nc"):
        write_netcdf(spark, results, path, attrs)
    elif path.rstrip("/").endswith(".zarr"):
        write_zarr(spark, results, path.rstrip("/"), attrs, append, chunks)
    elif path.rstrip("/").endswith(".parquet"):
        write_store(spark, results, path.rstrip("/"), attrs, append)
    else:
        raise ValueError(f"cannot tell the format of {path!r}; use .nc, .zarr or .parquet")


def upload(spark: SparkSession, path: str, folder: str) -> str:
    """Copy an output under its own name into ``folder``; an output that is remote already stays."""
    if "://" in path and not path.startswith("file:"):
        return path
    fs, source = _fs(spark, path)
    if not fs.exists(source):
        raise FileNotFoundError(path)
    target = f"{folder.rstrip('/')}/{path.rstrip('/').rpartition('/')[2]}"
    to_fs, to = _fs(spark, target)
    jvm = spark.sparkContext._jvm
    if to_fs.exists(to):
        to_fs.delete(to, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to_fs, to, False, spark.sparkContext._jsc.hadoopConfiguration())
    return target


def as_float(df: DataFrame, names: list[str]) -> DataFrame:
    """Doubles as floats, for storage; attributes stay."""
    doubles = {n for n in names if df.schema[n].dataType.typeName() == "double"}
    return df.select(*(named(c).cast("float").alias(c, metadata=df.schema[c].metadata or {}) if c in doubles else named(c) for c in df.columns))
