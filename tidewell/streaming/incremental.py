"""Plain aggregates kept up to date as samples arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import GridFrame, calendar
from tidewell.operators.base import AggregateStat, aggregate
from tidewell.registry import get_stat


def samples(stream: DataFrame, time: str = "time", late: str = "10 days") -> DataFrame:
    """A stream with a watermark on its time, which is read as UTC if it has no zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def incremental(frame: GridFrame, stats: dict[str, dict], group: str | None = None, window: str | None = None) -> DataFrame:
    """Columns {variable}_{stat} per cell, calendar group and time window of a stream or table.

    ``stats`` maps names of plain aggregates to their options.  With ``window`` (such as
    ``30 days``) closed windows can be appended; without it the result is for update or
    complete mode.
    """
    df, keys = frame.df, list(frame.cells)
    if group:
        df = df.withColumn(group, calendar(group, F.col(frame.dim)))
        keys.append(group)
    if window:
        df = df.withColumn("window", F.window(frame.dim, window))
        keys.append("window")
    made = {}
    for name, options in stats.items():
        stat = get_stat(name)
        if not isinstance(stat, AggregateStat):
            raise ValueError(f"{name!r} needs whole series and cannot follow a stream")
        made |= {f"{v}_{name}": c for v, c in stat.columns(frame, frame.number, **options).items()}
    return aggregate(df, keys, made)
