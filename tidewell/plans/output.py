"""Finishing results: attributes, masks, storage types, order."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result, ResultSet, named
from tidewell.sources.select import by_position
from tidewell.sources.sinks import as_float


@lru_cache(maxsize=1)
def _tables() -> dict[str, dict]:
    return yaml.safe_load((Path(__file__).parent / "attributes.yml").read_text())


def tables(extra: dict[str, Any] | None = None) -> dict[str, dict]:
    """Name tables, with entries of ``extra`` added or replaced."""
    return {k: {**v, **((extra or {}).get(k) or {})} for k, v in _tables().items()}


def _with_metadata(df: DataFrame, name: str, attrs: dict[str, Any]) -> DataFrame:
    return df.select(*(named(c).alias(c, metadata=attrs) if c == name else named(c) for c in df.columns))


def describe(result: Result, origin: dict[str, tuple[str, str, str | None]], extra: dict[str, Any] | None = None) -> Result:
    """Attach attributes; ``origin`` gives each output's source variable, statistic and group."""
    known = tables(extra)
    df = result.df
    for name, (variable, stat, group) in origin.items():
        base = known["data_vars"].get(variable)
        word = known["stats"].get(stat)
        if name not in df.columns or base is None or word is None:
            continue
        attrs = dict(base)
        attrs["standard_name"] = f"{base['standard_name']}_{word}"
        attrs["long_name"] = (f"{group}ly " if group in ("month", "year", "season") else "") + f"{word} {base.get('long_name', base['standard_name'].replace('_', ' '))}"
        df = _with_metadata(df, name, attrs)
    for dim in result.dims:
        if dim in known["coords"]:
            df = _with_metadata(df, dim, {**known["coords"][dim], **(df.schema[dim].metadata or {})})
    return Result(df, result.dims)


def _iso(span: dt.timedelta) -> str:
    seconds = int(span.total_seconds())
    days, rest = divmod(seconds, 86400)
    h, rest = divmod(rest, 3600)
    m, s = divmod(rest, 60)
    return f"P{days}DT{h}H{m}M{s}S"


def global_attributes(source: GridFrame, extra: dict[str, Any] | None = None) -> dict[str, Any]:
    """Title, date and time coverage; time coverage needs at least two times."""
    attrs: dict[str, Any] = {"title": "Data stats", "source": "tidewell", "date_created": f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%d}"}
    kind = source.df.schema[source.dim].dataType.typeName() if source.dim in source.df.columns else ""
    if kind.startswith("timestamp"):
        first = [r[0] for r in source.df.select(source.dim).distinct().orderBy(source.dim).limit(2).collect()]
        if len(first) == 2:
            last = source.df.agg(F.max(source.dim)).first()[0]
            attrs |= {
                "time_coverage_start": f"{first[0]:%Y-%m-%d %Hz}", "time_coverage_end": f"{last:%Y-%m-%d %Hz}",
                "time_coverage_duration": _iso(last - first[0]), "time_coverage_resolution": _iso(first[1] - first[0]),
            }
    return {**attrs, **(extra or {})}


def mask_frame(source: DataFrame, spec: Any, dims: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows of (dims, ``_keep``) where the source is to be kept, over the dims that ``isel`` leaves."""
    df = by_position(source, spec.isel)
    dims = [d for d in dims if d in df.columns]
    x = F.col(spec.var)
    if spec.type == "notnull":
        keep: Column = x.isNotNull()
    else:
        keep = {"gt": x > spec.value, "lt": x < spec.value, "ge": x >= spec.value, "le": x <= spec.value}[spec.operator]
    return df.groupBy(*dims).agg(F.max(F.coalesce(keep, F.lit(False))).alias("_keep")), dims


def apply_mask(result: Result, mask: DataFrame, dims: list[str]) -> Result:
    """Null where the mask does not keep; a dim that only the mask has is added to the result."""
    shared = [d for d in dims if d in result.dims]
    joined = result.df.join(mask, shared, "left") if shared else result.df.crossJoin(mask)
    keep, attrs = F.coalesce("_keep", F.lit(False)), {v: result.df.schema[v].metadata or {} for v in result.variables}
    kept = joined.select(*(F.when(keep, named(c)).alias(c, metadata=attrs[c]) if c in attrs else named(c) for c in joined.columns if c != "_keep"))
    return Result(kept, (*result.dims, *(d for d in dims if d not in shared)))


def finish(results: ResultSet, source: GridFrame, mask: Any = None) -> ResultSet:
    """Floats for storage, then the mask; ``quantile`` comes first among the dims."""
    out = ResultSet()
    held = mask_frame(source.df, mask, [d for d in (source.dim, *source.cells) if d]) if mask else None
    for result in results.values():
        result = Result(as_float(result.df, result.variables), result.dims)
        if held:
            result = apply_mask(result, *held)
        if "quantile" in result.dims:
            dims = ("quantile", *(d for d in result.dims if d != "quantile"))
            result = Result(result.df.select(*dims, *map(named, result.variables)), dims)
        out[result.dims] = result
    return out
