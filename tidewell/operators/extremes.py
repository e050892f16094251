"""Return period values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import melt, spread
from tidewell.operators.exceedance import step_hours
from tidewell.operators.kernels import DISTRIBUTIONS, return_values
from tidewell.registry import register_stat

RETURN_PERIODS = (1, 5, 10, 20, 50, 100, 1000, 10000)


@register_stat("rpv")
def rpv(
    frame: GridFrame, return_periods: Sequence[float] = RETURN_PERIODS, percentile: float = 95.0, distribution: str = "gumbel_r", duration: float = 24.0, group: str | None = None, **_
) -> Result:
    """Values at ``return_periods`` (years) over a new dim ``period``, per cell and group.

    The series of a cell, a variable and a group is one pandas group: its peaks are thinned
    in order of height, which no built-in expression does.
    """
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {distribution!r}; one of {', '.join(DISTRIBUTIONS)}")
    dt = step_hours(frame)
    if dt > duration:
        raise ValueError(f"the time step ({dt:g} h) is longer than the duration ({duration:g} h)")
    periods = [float(p) for p in return_periods]
    df, keys = frame.keyed(group)
    rows = melt(df, keys, {v: frame.number(v) for v in frame.variables}, [F.col(frame.dim).alias("_t")])
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, "_var"]), "period double", "_p double"])

    def kernel(key, part):
        import numpy as np
        import pandas as pd

        x = part.sort_values("_t")["_v"].to_numpy(dtype=float, na_value=np.nan)
        made = return_values(x, dt, periods, percentile, distribution, duration)
        return pd.DataFrame([(*key, p, None if np.isnan(v) else v) for p, v in zip(periods, made, strict=True)], columns=[*keys, "_var", "period", "_p"])

    out = rows.groupBy(*keys, "_var").applyInPandas(kernel, schema)
    return Result(spread(out, [*keys, "period"], {v: v for v in frame.variables}, F.col("_p")), (*keys, "period"))
