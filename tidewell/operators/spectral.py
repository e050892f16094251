"""Significant wave height by frequency band."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import melt, spread
from tidewell.operators.kernels import band_heights
from tidewell.registry import register_stat

# Default bands in Hz; None is the end of the spectrum.
BANDS = {"0_25": [None, 0.25], "8_25": [0.08, 0.25], "25_120": [0.25, 1.2], "25_300": [0.25, 3.0], "tot": [None, None]}


def sampling_frequency(frame: GridFrame, digits: int = 3) -> float:
    """1 over the mean time step, in seconds and rounded to ``digits``, of the distinct times."""
    t = F.col(frame.dim)
    kind = frame.df.schema[frame.dim].dataType.typeName()
    seconds = t.cast("timestamp").cast("double") if kind.startswith("timestamp") else t.cast("double")
    n, low, high = frame.df.select(seconds.alias("s")).agg(F.count_distinct("s"), F.min("s"), F.max("s")).first()
    step = round((high - low) / (n - 1), digits) if n and n > 1 else 0.0
    if step <= 0:
        raise ValueError("the sampling frequency cannot be told from the times; give fs")
    return 1.0 / step


@register_stat("hmo")
def hmo(frame: GridFrame, segsec: float = 256.0, bands: dict | None = None, fs: float | None = None, group: str | None = None, **_) -> Result:
    """Spectral significant wave height hs_{variable} over a new dim ``band``; NULL for a series with a gap."""
    bands = BANDS if bands is None else bands
    fs = sampling_frequency(frame) if fs is None else float(fs)
    df, keys = frame.keyed(group)
    rows = melt(df, keys, {v: frame.number(v) for v in frame.variables}, [F.col(frame.dim).alias("_t")])
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, "_var"]), "band string", "_p double"])

    def kernel(key, part):
        import numpy as np
        import pandas as pd

        x = part.sort_values("_t")["_v"].to_numpy(dtype=float, na_value=np.nan)
        made = band_heights(x, fs, segsec, list(bands.values()))
        return pd.DataFrame([(*key, b, None if np.isnan(v) else v) for b, v in zip(bands, made, strict=True)], columns=[*keys, "_var", "band", "_p"])

    out = rows.groupBy(*keys, "_var").applyInPandas(kernel, schema)
    return Result(spread(out, [*keys, "band"], {v: f"hs_{v}" for v in frame.variables}, F.col("_p")), (*keys, "band"))
