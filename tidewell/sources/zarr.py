"""Zarr stores (format 2) of gridded variables, with raw, zlib, gzip or zstd chunks.

A chunk is read and written by one task: reading groups the files of variables that share
a chunk grid by chunk, and unfolds each chunk to tidy rows; writing groups rows by chunk
and packs them, and the driver passes one packed chunk after the other to the file system.
A chunk that holds nothing but missing values has no file.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import re
import uuid
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import ResultSet, named

#: Values of a chunk at most, where no chunk sizes are asked for.
CHUNK_VALUES = 1 << 20
LEVEL = 5
EPOCH = "seconds since 1970-01-01"
_UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}
_SINCE = re.compile(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?")


def _unpack(data: bytes, meta: dict[str, Any]) -> bytes:
    codec = (meta.get("compressor") or {}).get("id")
    if codec is None:
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _check(name: str, meta: dict[str, Any]) -> None:
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip", "zstd") or meta.get("filters") or meta.get("zarr_format") != 2:
        raise ValueError(f"{name}: chunks coded by {codec or meta.get('filters') or 'another format'} cannot be read here; write the store with zlib, gzip, zstd or no compressor")


def _fill(meta: dict[str, Any]) -> Any:
    given = meta.get("fill_value")
    return {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(given, given) if isinstance(given, str) else given


def _array(data: bytes | None, meta: dict[str, Any]) -> np.ndarray:
    """Values of a chunk, at the full size of a chunk; without data all are the fill value."""
    kind, shape = np.dtype(meta["dtype"]), tuple(meta["chunks"])
    if data is None:
        fill = _fill(meta)
        return np.full(shape, 0 if fill is None else fill, dtype=kind)
    return np.frombuffer(_unpack(data, meta), kind).reshape(shape, order=meta.get("order", "C"))


def _numbers(x: np.ndarray, meta: dict[str, Any], attrs: dict[str, Any]) -> np.ndarray:
    """As float64 with NaN for missing values; scale and offset are applied."""
    y = x.astype(np.float64)
    for missing in {_fill(meta) if x.dtype.kind == "f" or "_FillValue" in attrs else None, attrs.get("_FillValue"), attrs.get("missing_value")}:
        if isinstance(missing, (int, float)):
            y[x == missing] = np.nan
    return y * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)


class Store:
    """Metadata of a store, and its files through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.fs.getScheme() == "file":
            self.fs = self.fs.getRawFileSystem()  # without files of checksums beside a store's own

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}" if name else self.path))

    def remove(self, name: str = "") -> None:
        self.fs.delete(self._path(f"{self.path}/{name}" if name else self.path), True)

    def write(self, name: str, data: bytes) -> None:
        out = self.fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            out.write(data)
        finally:
            out.close()

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_json(self, name: str) -> dict[str, Any]:
        found = self.read(name)
        return json.loads(found) if found else {}

    def write_json(self, name: str, what: dict[str, Any]) -> None:
        self.write(name, json.dumps(what, indent=1, default=str).encode())

    def arrays(self) -> dict[str, tuple[dict, dict]]:
        """(array metadata, attributes) by name, from the files themselves."""
        if not self.exists():
            raise FileNotFoundError(self.path)
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)) if s.isDirectory())
        return {n: (meta, self.read_json(f"{n}/.zattrs")) for n in names if (meta := self.read_json(f"{n}/.zarray"))}

    def consolidate(self) -> None:
        """Gather all metadata in one file."""
        files = {".zgroup": {"zarr_format": 2}, ".zattrs": self.read_json(".zattrs")}
        for name, (meta, attrs) in self.arrays().items():
            files |= {f"{name}/.zarray": meta, f"{name}/.zattrs": attrs}
        self.write_json(".zmetadata", {"metadata": files, "zarr_consolidated_format": 1})

    def known(self) -> dict[str, tuple[dict, dict]]:
        """As ``arrays``, from the gathered metadata where there is some."""
        gathered = self.read_json(".zmetadata").get("metadata")
        if gathered is None:
            return self.arrays()
        return {k.removesuffix("/.zarray"): (v, gathered.get(k.replace(".zarray", ".zattrs"), {})) for k, v in gathered.items() if k.endswith("/.zarray")}

    def whole(self, name: str, meta: dict[str, Any]) -> np.ndarray:
        """A one-dimensional array on the driver: the labels of a dimension."""
        _check(name, meta)
        n, step = meta["shape"][0], meta["chunks"][0]
        parts = [_array(self.read(f"{name}/{i}"), meta) for i in range(-(-n // step))]
        return np.concatenate(parts or [np.zeros(0, meta["dtype"])])[:n]


def _labels(x: np.ndarray, attrs: dict[str, Any]) -> tuple[list, str]:
    """Labels of a dimension and their type in Spark."""
    if found := _SINCE.match(str(attrs.get("units", ""))):
        start = dt.datetime(*(int(p or 0) for p in found.groups()[1:]))
        return [start + dt.timedelta(seconds=round(float(v) * _UNITS[found.group(1) + "s"], 6)) for v in x], "timestamp_ntz"
    if x.dtype.kind in "US":
        return [v.decode() if isinstance(v, bytes) else str(v) for v in x.tolist()], "string"
    return (x.tolist(), "long") if x.dtype.kind in "iu" else (x.astype(float).tolist(), "double")


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """Tidy rows over the dims of the widest variables; variables over fewer dims are joined to them.

    Labels of dims (one-dimensional arrays named like them) are read on the driver; a
    dim without labels counts from 0.
    """
    store = Store(spark, path)
    known = store.known()
    dims_of = {n: list(attrs.get("_ARRAY_DIMENSIONS", [])) for n, (_, attrs) in known.items()}
    variables = [n for n, d in dims_of.items() if d != [n] and known[n][0]["dtype"][1] in "fiub"]
    if not variables:
        raise ValueError(f"{path} holds no variable")
    labels: dict[str, tuple[list, str]] = {}
    for name in variables:
        _check(name, known[name][0])
        for d, size in zip(dims_of[name], known[name][0]["shape"], strict=True):
            if d not in labels:
                labels[d] = _labels(store.whole(d, known[d][0]), known[d][1]) if d in known and dims_of[d] == [d] else (list(range(size)), "long")
    grids: dict[str, list[str]] = {}
    for name in variables:
        meta = known[name][0]
        grids.setdefault(json.dumps([dims_of[name], meta["shape"], meta["chunks"]]), []).append(name)
    frames = sorted(((dims_of[names[0]], _read_grid(store, names, known, dims_of[names[0]], labels)) for names in grids.values()), key=lambda f: -len(f[0]))
    dims, out = frames[0]
    for d, frame in frames[1:]:
        if not set(d) <= set(dims):
            raise ValueError(f"variables over {d} do not fit on those over {dims}; read them from stores of their own")
        out = out.join(frame, d, "left") if d else out.crossJoin(F.broadcast(frame))  # one row
    return out.select(*dims, *variables)


def _read_grid(store: Store, names: list[str], known: dict, dims: list[str], labels: dict) -> DataFrame:
    """Rows of variables that share dims, shape and chunks."""
    spark, meta = store.spark, known[names[0]][0]
    shape, chunks = meta["shape"], meta["chunks"]
    counts = [-(-s // c) for s, c in zip(shape, chunks, strict=True)]
    schema = ", ".join([*(f"`{d}` {labels[d][1]}" for d in dims), *(f"`{n}` double" for n in names)])
    separators = {n: known[n][0].get("dimension_separator", ".") for n in names}
    total = int(np.prod(counts, dtype=np.int64))
    # Every chunk has a row, so that one without files gives its missing values.
    at = spark.range(0, total, 1, max(1, min(total, 10_000))).withColumnRenamed("id", "chunk")
    files = [f"{store.path}/{n}" for n in names]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "content")
    # The name comes last but the key's parts, each of them a number; hidden files are not listed.
    parts = max(1, len(dims))
    tail = F.expr("split(path, '/')")

    def key_of(name: str):
        if separators[name] == "/" and parts > 1:
            return F.slice(tail, -parts, parts), F.element_at(tail, -parts - 1)
        return F.split(F.element_at(tail, -1), r"\."), F.element_at(tail, -2)

    rows = None
    for n in names:
        key, owner = key_of(n)
        index = F.lit(0).cast("long")
        for i, c in enumerate(counts):
            index = index * c + F.get(key, F.lit(i)).cast("long")
        mine = found.where(owner == n).select(F.lit(n).alias("name"), index.alias("chunk"), "content")
        rows = mine if rows is None else rows.union(mine)
    rows = rows.where("chunk IS NOT NULL").select("chunk", F.struct("name", "content").alias("file")).groupBy("chunk").agg(F.collect_list("file").alias("files"))
    metas = {n: known[n] for n in names}

    def unfold(batches):
        import pandas as pd

        for batch in batches:
            for chunk, held in zip(batch["chunk"], batch["files"], strict=True):
                data = {f["name"]: f["content"] for f in ([] if held is None else held)}
                where = np.unravel_index(int(chunk), counts) if counts else ()
                first = [w * c for w, c in zip(where, chunks, strict=True)]
                size = [min(c, s - a) for a, c, s in zip(first, chunks, shape, strict=True)]
                inside = tuple(slice(0, n) for n in size)
                made = {}
                for i, (d, a, n) in enumerate(zip(dims, first, size, strict=True)):
                    axis = np.arange(n).reshape([-1 if j == i else 1 for j in range(len(dims))])
                    values = pd.Series(labels[d][0][a : a + n])
                    made[d] = values.to_numpy()[np.broadcast_to(axis, size).ravel()]
                for n in names:
                    made[n] = _numbers(_array(data.get(n), metas[n][0])[inside], *metas[n]).ravel()
                yield pd.DataFrame(made)

    return at.join(rows, "chunk", "left").select("chunk", "files").mapInPandas(unfold, schema)


def _coordinate(values: list) -> tuple[np.ndarray, dict[str, Any]]:
    if values and isinstance(values[0], (dt.date, dt.datetime)):
        seconds = [(dt.datetime(*v.timetuple()[:6]) - dt.datetime(1970, 1, 1)).total_seconds() for v in values]
        return np.array(seconds, dtype="<i8"), {"units": EPOCH, "calendar": "proleptic_gregorian"}
    if values and isinstance(values[0], str):
        return np.array(values, dtype=f"<U{max(map(len, values))}"), {}
    return np.array(values, dtype="<i8" if all(isinstance(v, int) for v in values) else "<f8"), {}


def _meta(kind: str, shape: list[int], chunks: list[int], fill: Any) -> dict[str, Any]:
    return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": {"id": "zlib", "level": LEVEL}, "fill_value": fill, "order": "C", "filters": None}


def chunk_sizes(shape: list[int], dims: tuple[str, ...], asked: dict[str, int]) -> list[int]:
    """Sizes as asked (-1 or none: the whole dim); without any, leading dims are cut until a chunk holds CHUNK_VALUES at most."""
    sizes = [min(n, asked[d]) if asked.get(d, -1) > 0 else n for d, n in zip(dims, shape, strict=True)]
    if not any(d in asked for d in dims):
        for i in range(len(sizes)):
            rest = int(np.prod(sizes[i + 1 :], dtype=np.int64))
            sizes[i] = max(1, min(sizes[i], CHUNK_VALUES // max(1, rest)))
    return [max(1, n) for n in sizes]


def write_zarr(spark: SparkSession, results: ResultSet, path: str, attrs: dict[str, Any], append: bool = False, chunks: dict[str, int] | None = None) -> None:
    """All results as one store; each set of results with the same dims is computed once.

    Without ``append`` the store is replaced, and its metadata gathered; with it,
    variables of the same name are replaced, others stay, and gathering is left to
    ``Store.consolidate``, so that writers of different variables do not meet.  The labels
    of a dim that is there already must be the same.
    """
    store = Store(spark, path)
    if not append and store.exists():
        store.remove()
    store.write_json(".zgroup", {"zarr_format": 2})
    store.write_json(".zattrs", {**(store.read_json(".zattrs") if append else {}), **attrs})
    passing = f"{store.path}.writing-{uuid.uuid4().hex}"
    try:
        for i, (dims, result) in enumerate(results.items()):
            names, kinds = result.variables, {v: "<f8" if result.df.schema[v].dataType.typeName() == "double" else "<f4" for v in result.variables}
            about = {c: dict(result.df.schema[c].metadata or {}) for c in result.df.columns}
            # Numbered columns, as names may hold dots; written once, read for the labels and for the chunks.
            plain = result.df.select(*(named(d).alias(f"d{k}") for k, d in enumerate(dims)), *(named(v).cast("double").alias(f"v{k}") for k, v in enumerate(names)))
            plain.write.parquet(f"{passing}/{i}")
            rows = spark.read.schema(plain.schema).parquet(f"{passing}/{i}")
            shape = []
            for k, d in enumerate(dims):
                found = [r[0] for r in rows.select(f"d{k}").distinct().where(f"d{k} IS NOT NULL").orderBy(f"d{k}").collect()]
                shape.append(len(found))
                axis, extra = _coordinate(found)
                _write_labels(store, d, axis, {**about[d], **extra})
                numbers = spark.createDataFrame([(v, n) for n, v in enumerate(found)], rows.select(F.col(f"d{k}"), F.lit(0).alias(f"i{k}")).schema)
                rows = rows.join(numbers, f"d{k}")
            sizes = chunk_sizes(shape, dims, chunks or {})
            for v in names:
                store.remove(v)
                store.write_json(f"{v}/.zarray", _meta(kinds[v], shape, sizes, "NaN"))
                store.write_json(f"{v}/.zattrs", {**about[v], "_ARRAY_DIMENSIONS": list(dims)})
            keys = [F.expr(f"i{k} div {n}").alias(f"c{k}") for k, n in enumerate(sizes)]
            inside = [F.col(f"i{k}") % n for k, n in enumerate(sizes)]
            placed = rows.select(F.concat_ws(".", *keys).alias("key") if keys else F.lit("0").alias("key"), *(c.alias(f"i{k}") for k, c in enumerate(inside)), *(f"v{k}" for k in range(len(names))))
            for r in placed.groupBy("key").applyInPandas(_packer(sizes, kinds), "file string, data binary").toLocalIterator():
                store.write(r["file"], bytes(r["data"]))
        if not append:
            store.consolidate()
    finally:
        store.fs.delete(store._path(passing), True)


def _packer(sizes: list[int], kinds: dict[str, str]):
    """Rows of a chunk to one packed chunk for each variable that has a value there."""

    def pack(key, part):
        import pandas as pd

        made = []
        at = tuple(part[f"i{k}"].to_numpy() for k in range(len(sizes)))
        for k, (name, kind) in enumerate(kinds.items()):
            values = part[f"v{k}"].to_numpy(dtype=float, na_value=np.nan)
            if not np.isnan(values).all():
                x = np.full(sizes, np.nan, dtype=kind)
                x[at if sizes else ...] = values if sizes else values[0]
                made.append((f"{name}/{key[0]}", zlib.compress(x.tobytes(), LEVEL)))
        return pd.DataFrame(made, columns=["file", "data"])

    return pack


def _write_labels(store: Store, dim: str, axis: np.ndarray, attrs: dict[str, Any]) -> None:
    if store.exists(f"{dim}/.zarray"):
        there = store.whole(dim, store.read_json(f"{dim}/.zarray"))
        if len(there) != len(axis) or (there != axis).any():
            raise ValueError(f"the store has other labels of {dim}")
        return
    store.write_json(f"{dim}/.zarray", _meta(axis.dtype.str, [len(axis)], [max(1, len(axis))], None))
    store.write_json(f"{dim}/.zattrs", {**attrs, "_ARRAY_DIMENSIONS": [dim]})
    store.write(f"{dim}/0", zlib.compress(axis.tobytes(), LEVEL))
