"""Exceedance and non-exceedance, with persistence."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import AggregateStat, Value, aggregate, melt, spread
from tidewell.registry import register_stat

UNITS = {"s": 1 / 3600, "sec": 1 / 3600, "min": 1 / 60, "m": 1 / 60, "t": 1 / 60, "h": 1.0, "hr": 1.0, "hour": 1.0, "hours": 1.0, "d": 24.0, "day": 24.0, "days": 24.0, "w": 168.0}


def hours(duration: str | float) -> float:
    """Hours of a duration such as ``12h``, ``1d`` or ``1d 6h``; a number is in hours."""
    if isinstance(duration, (int, float)):
        return float(duration)
    parts = re.findall(r"([0-9.]+)\s*([A-Za-z]+)", duration)
    if not parts or re.sub(r"[0-9.]+\s*[A-Za-z]+", "", duration).strip():
        raise ValueError(f"not a duration: {duration!r}")
    try:
        return sum(float(n) * UNITS[u.lower()] for n, u in parts)
    except KeyError:
        raise ValueError(f"not a duration: {duration!r}") from None


def step_hours(frame: GridFrame) -> float:
    """Length of the first time step, from the two smallest times."""
    first = frame.df.select(frame.dim).distinct().orderBy(frame.dim).limit(2).collect()
    if len(first) < 2:
        return 0.0
    a, b = first[0][0], first[1][0]
    return (b - a) / 3600 if isinstance(a, (int, float)) else (b - a).total_seconds() / 3600


def _label(x: float) -> str:
    return f"{x:g}"


def _above(value: Value, threshold: float, maxval: float, inclusive: bool):
    def met(v: str) -> Column:
        x = value(v)
        low = x >= threshold if inclusive else x > threshold
        high = x <= maxval if not math.isinf(maxval) else F.lit(True)
        return F.coalesce(low & high, F.lit(False))

    return met


def _below(value: Value, threshold: float, inclusive: bool):
    def met(v: str) -> Column:
        x = value(v)
        return F.coalesce(x <= threshold if inclusive else x < threshold, F.lit(False))

    return met


def _persistent(frame: GridFrame, met, names: dict[str, str], duration: str | float | Sequence, group: str | None, edge_runs: bool) -> Result:
    """Share of all samples in runs of at least each duration.

    Runs are found once for all durations and variables.  A run that touches the first
    or last sample of the record does not count, unless ``edge_runs``.  With a group,
    runs are those of the whole record and each sample counts for its own group.
    """
    if isinstance(duration, (str, int, float)):
        durations, several = [duration], False
    else:
        durations, several = list(duration), len(duration) > 1
    dt = step_hours(frame)
    df, keys = frame.keyed(group)
    cells = list(frame.cells)
    rows = melt(df, [*keys, frame.dim], {v: met(v) for v in names})
    series = Window.partitionBy(*cells, "_var").orderBy(frame.dim)
    alike = Window.partitionBy(*cells, "_var", "_v").orderBy(frame.dim)
    rows = rows.withColumn("_i", F.row_number().over(series)).withColumn("_run", F.col("_i") - F.row_number().over(alike))
    run = Window.partitionBy(*cells, "_var", "_v", "_run")
    record = Window.partitionBy(*cells, "_var")
    rows = rows.withColumn("_len", F.count(F.lit(1)).over(run)).withColumn("_a", F.min("_i").over(run)).withColumn("_b", F.max("_i").over(run)).withColumn("_n", F.count(F.lit(1)).over(record))
    whole = F.lit(True) if edge_runs else (F.col("_a") > 1) & (F.col("_b") < F.col("_n"))

    def share(d: str | float) -> Column:
        if hours(d) <= 0:
            return F.avg(F.when(F.col("_v"), 1.0).otherwise(0.0))
        return F.avg(F.when(F.col("_v") & whole & (F.col("_len") * dt >= hours(d)), 1.0).otherwise(0.0))

    each = F.array(*(F.struct(F.lit(str(d)).alias("duration"), share(d).alias("_p")) for d in durations))
    out = aggregate(rows, [*keys, "_var"], {"_d": each}).select(*keys, "_var", F.inline("_d"))
    dims = [*keys, "duration"] if several else keys
    return Result(spread(out, dims, names, F.col("_p")), tuple(dims))


class _Exceedance(AggregateStat):
    def __call__(self, frame: GridFrame, group: str | None = None, duration: str | float | Sequence = "0h", edge_runs: bool = False, **options) -> Result:
        if not isinstance(duration, (str, int, float)) and len(duration) == 0:
            raise ValueError("no duration")
        single = duration if isinstance(duration, (str, int, float)) else duration[0] if len(duration) == 1 else None
        if single is not None and hours(single) <= 0:
            return super().__call__(frame, group, **options)
        threshold = options["threshold"]
        met = self.met(frame.number, **options)
        return _persistent(frame, met, {v: f"{v}_{_label(threshold)}" for v in frame.variables}, duration, group, edge_runs)


def _stat(name: str, met) -> _Exceedance:
    def columns(frame: GridFrame, value: Value, threshold: float, **options) -> dict[str, Column]:
        condition = met(value, threshold=threshold, **options)
        return {f"{v}_{_label(threshold)}": F.avg(condition(v).cast("int").cast("double")) for v in frame.variables}

    stat = _Exceedance(name, columns)
    stat.met = met
    return register_stat(name)(stat)


def _exceeds(value: Value, threshold: float, maxval: float = math.inf, inclusive: bool = True, **_):
    return _above(value, threshold, maxval, inclusive)


def _falls_short(value: Value, threshold: float, inclusive: bool = True, **_):
    return _below(value, threshold, inclusive)


#: Share of all samples with threshold <= v <= maxval; missing samples do not exceed but are counted.
exceedance = _stat("exceedance", _exceeds)
#: Share of all samples with v <= threshold.
nonexceedance = _stat("nonexceedance", _falls_short)
