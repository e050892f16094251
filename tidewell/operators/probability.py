"""Probability of ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import GridFrame
from tidewell.operators.base import Value, aggregate_stat


def _label(spec: dict) -> str:
    start, stop = spec.get("start"), spec.get("stop")
    low = "min" if start is None else f"{start:g}"
    high = "max" if stop is None else f"{stop:g}"
    return spec.get("label") or f"{spec['var']}_{low}_to_{high}"


@aggregate_stat("range_probability")
def range_probability(frame: GridFrame, value: Value, data_ranges: dict | list[dict], **_) -> dict[str, Column]:
    """Share of the valid samples inside each range {var, start, stop, left, right, label}.

    ``left`` and ``right`` are ``closed`` (default) or ``open``.
    """
    made = {}
    for spec in [data_ranges] if isinstance(data_ranges, dict) else data_ranges:
        x = value(spec["var"])
        inside = F.lit(True)
        if spec.get("start") is not None:
            inside = inside & (x >= spec["start"] if spec.get("left", "closed") == "closed" else x > spec["start"])
        if spec.get("stop") is not None:
            inside = inside & (x <= spec["stop"] if spec.get("right", "closed") == "closed" else x < spec["stop"])
        made[_label(spec)] = F.try_divide(F.count(F.when(inside & x.isNotNull(), 1)).cast("double"), F.count(x).cast("double"))
    return made
