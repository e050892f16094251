"""Renaming and selection by label or position, as predicates that reach the scan."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY = re.compile(r"\d{4}(-\d{2}(-\d{2})?)?$")


def _label(df: DataFrame, dim: str, value: Any) -> Column:
    return F.lit(value).cast(df.schema[dim].dataType)


def _upper(df: DataFrame, dim: str, stop: Any) -> Column:
    """``dim`` up to and with ``stop``; a time given as a day, month or year covers it all."""
    kind = df.schema[dim].dataType.typeName()
    text = stop.isoformat() if isinstance(stop, dt.date) and not isinstance(stop, dt.datetime) else str(stop)
    if kind.startswith("timestamp") and _DAY.match(text):
        parts = [int(x) for x in text.split("-")]
        year, month, day = (parts + [0, 0])[:3]
        if day:
            after = dt.datetime(year, month, day) + dt.timedelta(days=1)
        else:
            after = dt.datetime(year + (month in (0, 12)), month % 12 + 1 if month else 1, 1)
        return F.col(dim) < F.lit(after).cast(df.schema[dim].dataType)
    return F.col(dim) <= _label(df, dim, stop)


def _check(df: DataFrame, dim: str) -> None:
    if dim not in df.columns:
        raise ValueError(f"no such dimension: {dim}")


def by_label(df: DataFrame, sel: dict[str, Any]) -> DataFrame:
    """Ranges {start, stop} keep both ends, lists keep exactly their labels, a scalar drops the dimension.

    ``method: nearest`` (with an optional ``tolerance``) takes the closest labels instead.
    """
    sel = dict(sel)
    method, tolerance = sel.pop("method", None), sel.pop("tolerance", None)
    for dim, what in sel.items():
        _check(df, dim)
        if isinstance(what, dict):
            if what.get("start") is not None:
                df = df.where(F.col(dim) >= _label(df, dim, what["start"]))
            if what.get("stop") is not None:
                df = df.where(_upper(df, dim, what["stop"]))
            continue
        wanted = list(what) if isinstance(what, (list, tuple)) else [what]
        if method == "nearest":
            wanted = [_nearest(df, dim, v, tolerance) for v in wanted]
        else:
            there = {r[0] for r in df.select(dim).where(F.col(dim).isin([_label(df, dim, v) for v in wanted])).distinct().collect()}
            if len(there) < len(set(map(str, wanted))):
                raise KeyError(f"not all of {wanted} are labels of {dim}")
        df = df.where(F.col(dim).isin([_label(df, dim, v) for v in wanted]))
        if not isinstance(what, (list, tuple)):
            df = df.drop(dim)
    return df


def _nearest(df: DataFrame, dim: str, value: Any, tolerance: float | None) -> Any:
    numeric = F.col(dim).cast("timestamp").cast("double") if df.schema[dim].dataType.typeName().startswith("timestamp") else F.col(dim).cast("double")
    target = _label(df, dim, value)
    target = target.cast("timestamp").cast("double") if df.schema[dim].dataType.typeName().startswith("timestamp") else target.cast("double")
    away = F.abs(numeric - target)
    found, distance = df.agg(F.min_by(dim, F.struct(away, F.col(dim))), F.min(away)).first()
    if found is None or tolerance is not None and distance > tolerance:
        raise KeyError(f"no label of {dim} near {value}")
    return found


def by_position(df: DataFrame, isel: dict[str, Any]) -> DataFrame:
    """Positions from 0 in the order of labels: int (drops the dimension), list, or {start, stop} half open.

    Positions become labels by ranking the dimension's distinct labels, so the fact table
    itself is only filtered.
    """
    for dim, what in isel.items():
        _check(df, dim)
        labels = [r[0] for r in df.select(dim).distinct().orderBy(dim).collect()]
        if isinstance(what, dict):
            chosen = labels[what.get("start") : what.get("stop") : what.get("step")]
        else:
            chosen = [labels[i] for i in (what if isinstance(what, (list, tuple)) else [what])]
        if isinstance(what, dict) and what.get("step") in (None, 1) and chosen:
            df = df.where(F.col(dim).between(F.lit(chosen[0]), F.lit(chosen[-1])))
        else:
            df = df.where(F.col(dim).isin(chosen))
        if isinstance(what, int):
            df = df.drop(dim)
    return df


def prepare(df: DataFrame, mapping: dict[str, str] | None = None, sel: dict | None = None, isel: dict | None = None) -> DataFrame:
    """Rename (absent names are ignored), then select by label, then by position; an empty selection is an error."""
    df = df.withColumnsRenamed({a: b for a, b in (mapping or {}).items() if a in df.columns})
    df = by_label(df, sel or {})
    df = by_position(df, isel or {})
    if (sel or isel) and df.isEmpty():
        raise ValueError("the selection is empty")
    return df
