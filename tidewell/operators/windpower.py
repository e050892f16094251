"""Wind power from a turbine's power curve."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import AggregateStat
from tidewell.registry import get_stat, register_stat

# Reference wind speeds in m/s and powers in kW below rated speed.
REFERENCE_SPEED = (3.0, 3.6, 4.32, 5.06, 6.2, 7.05, 8.83, 10.61)
REFERENCE_POWER = (1500, 1915, 2719, 3872, 6110, 7963, 13490, 16000)


@lru_cache(maxsize=1)
def curve() -> tuple[float, float, float, float]:
    """Cubic of least squares through the reference points, constant first."""
    x = np.array(REFERENCE_SPEED)
    fit, *_ = np.linalg.lstsq(np.stack([x**k for k in range(4)], axis=1), np.array(REFERENCE_POWER, float), rcond=None)
    return tuple(float(c) for c in fit)


def power(speed: Column, turbine_power: float, cutin: float, rated: float, cutout: float) -> Column:
    """Steps in order, so that later ones win; a missing speed gives no power."""
    c0, c1, c2, c3 = curve()
    p = F.when(speed > cutin, c1 * speed + c2 * speed * speed + c3 * speed * speed * speed + c0).otherwise(0.0)
    p = F.when(speed < rated, p).otherwise(F.lit(float(turbine_power)))
    return F.when(speed < cutout, p).otherwise(0.0)


@register_stat("winpow")
class WindPower:
    """Power of each variable, reduced by the statistic ``agg`` or, with None, as a series."""

    def __new__(cls, frame: GridFrame, turbine_power: float = 16000.0, cutin: float = 3.0, rated: float = 10.61, cutout: float = 25.0, agg: str | None = "mean", group: str | None = None, **options) -> Result:
        if agg is None and group is not None:
            raise NotImplementedError("a group needs agg")
        made = {v: power(frame.number(v), turbine_power, cutin, rated, cutout) for v in frame.variables}
        keep = [c for c in (frame.dim, *frame.cells) if c]
        powered = frame.with_df(frame.df.select(*[c for c in frame.df.columns if c not in made], *(c.alias(v) for v, c in made.items())))
        if agg is None:
            return Result(powered.df.select(*keep, *frame.variables), tuple(keep))
        stat = get_stat(agg)
        if not isinstance(stat, AggregateStat):
            raise ValueError(f"agg must be a plain aggregate, not {agg!r}")
        return stat(powered, group=group, **options)
