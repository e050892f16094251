"""Histogram bins: edges, centres and the bin of a value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import GridFrame


def edges_of(bins: dict | Sequence[float], frame: GridFrame, variable: str) -> list[float]:
    """Edges from a list, or from {start 0, stop, step}; a missing stop is the largest value plus a step.

    That largest value is one number, found by a job over the variable's column alone.
    """
    if not isinstance(bins, dict):
        edges = [float(x) for x in bins]
    else:
        if "step" not in bins:
            raise KeyError("bins need a step")
        step = float(bins["step"])
        stop = bins.get("stop")
        if stop is None:
            stop = (frame.df.agg(F.max(frame.number(variable))).first()[0] or 0.0) + step
        edges = np.arange(float(bins.get("start", 0.0)), float(stop) + step, step).tolist()
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("bins need at least two increasing edges")
    return edges


def centres(edges: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Bin k holds edges[k] <= x < edges[k + 1], the last one its upper edge too; NULL outside.

    A binary tree of comparisons with the edges themselves: exact, and a few levels deep
    for hundreds of bins.
    """
    n = len(edges) - 1

    def find(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < edges[mid], find(lo, mid)).otherwise(find(mid, hi))

    return F.when((x >= edges[0]) & (x <= edges[n]), find(0, n))
