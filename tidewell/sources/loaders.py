"""Loaders: files of any Spark format, and entries of a catalog."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from tidewell.model import missing_to_null
from tidewell.registry import register_loader
from tidewell.sources.netcdf import read_netcdf
from tidewell.sources.select import prepare
from tidewell.sources.zarr import read_zarr

#: Engines for NetCDF files, of which the classic format can be read.
NETCDF = {"scipy", "netcdf3", "netcdf4", "h5netcdf"}
#: Engines without a reader here.
ABSENT = {"cfgrib", "rasterio", "pydap", "tiledb"}


def read(spark: SparkSession, path: str, engine: str = "parquet", options: dict[str, Any] | None = None) -> DataFrame:
    """A grid as tidy rows: ``zarr``, NetCDF classic, or any format that Spark reads."""
    if engine == "zarr":
        return read_zarr(spark, path)
    if engine in NETCDF:
        return read_netcdf(spark, path)
    if engine in ABSENT:
        raise ValueError(f"there is no reader for {engine!r}; convert {path} to Zarr, NetCDF classic or Parquet")
    return spark.read.format(engine).options(**(options or {})).load(path)


def _finish(df: DataFrame, config: Any) -> DataFrame:
    df = missing_to_null(prepare(df, config.mapping, config.sel, config.isel))
    if config.chunks:
        # Chunks of a grid become partitions by the chunked dims; sizes are left to adaptive execution.
        dims = [d for d, n in config.chunks.items() if d in df.columns and n != -1]
        df = df.repartition(*dims) if dims else df
    return df


@register_loader("xarray")
class FileLoader:
    """``urlpath`` as ``engine`` reads it."""

    def load(self, spark: SparkSession, config: Any) -> DataFrame:
        return _finish(read(spark, config.urlpath, config.engine, config.open_kwargs), config)


@register_loader("intake")
class CatalogLoader:
    """An entry of a YAML catalog, or a table of Spark's catalog if there is no such file.

    Catalog files hold ``sources: {name: {driver, args: {urlpath, ...}}}``; an entry whose
    driver is a catalog file leads on to it, and ``a.b`` names entry b of catalog a.
    ``{{ CATALOG_DIR }}`` in a path stands for the folder of its catalog file.
    """

    def load(self, spark: SparkSession, config: Any) -> DataFrame:
        if not Path(config.catalog).is_file():
            return _finish(spark.table(f"{config.catalog}.{config.dataset_id}"), config)
        path, engine, options = self.resolve(Path(config.catalog), config.dataset_id)
        return _finish(read(spark, path, engine, options), config)

    def resolve(self, catalog: Path, name: str) -> tuple[str, str, dict]:
        entries = (yaml.safe_load(catalog.read_text()) or {}).get("sources", {})
        head, _, rest = name.partition(".")
        if name in entries:
            entry, rest = entries[name], ""
        elif head in entries and rest:
            entry = entries[head]
        else:
            raise KeyError(f"{name!r} is not in {catalog}; it has: {', '.join(sorted(entries))}")
        args = dict(entry.get("args", {}))
        path = str(args.pop("urlpath", args.pop("path", ""))).replace("{{ CATALOG_DIR }}", str(catalog.parent)).replace("{{CATALOG_DIR}}", str(catalog.parent))
        if "catalog" in entry.get("driver", "") or rest:
            return self.resolve(Path(path), rest)
        engine = args.pop("engine", None) or entry.get("driver", "parquet")
        by_name = {".zarr": "zarr", ".nc": "netcdf4"}.get(Path(path.rstrip("/")).suffix, "parquet")
        return path, {"xarray": by_name, "netcdf": "netcdf4"}.get(engine, engine), args.get("open_kwargs", {})
