"""Joint histograms over two or three variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import aggregate
from tidewell.operators.binning import bin_index, centres, edges_of
from tidewell.registry import register_stat

Bins = dict | Sequence[float]


def _joint(frame: GridFrame, names: list[str], bins: list[Bins], isdir: list[bool], group: str | None, out: str, sparse: bool) -> Result:
    """Counts over all bins of all variables, empty ones too unless ``sparse``.

    Bins number all their combinations; a cell's counts gather in a map with at most
    one entry per combination, from which the dense output unfolds without a join.
    """
    if len(set(names)) < len(names):
        raise ValueError("the variables of a distribution must differ")
    df, keys = frame.keyed(group)
    edges = [edges_of(b, frame, v) for b, v in zip(bins, names, strict=True)]
    flat: Column = F.lit(0)
    total = 1
    for v, e, circular in zip(names, edges, isdir, strict=True):
        x = frame.number(v)
        if circular:
            x = F.when(x > e[-1], x - 360.0).otherwise(x)
        flat = flat * (len(e) - 1) + bin_index(x, e)
        total *= len(e) - 1
    counts = df.withColumn("_b", flat).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if sparse:
        rows = counts.where("_b IS NOT NULL").select(*keys, "_b", F.col("_n").alias(out))
    else:
        held = F.filter(F.collect_list(F.struct("_b", "_n")), lambda s: s["_b"].isNotNull())
        rows = aggregate(counts, keys, {"_m": F.map_from_entries(held)})
        rows = rows.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("_b"))
        rows = rows.select(*keys, "_b", F.coalesce(F.try_element_at("_m", F.col("_b")), F.lit(0)).alias(out))
    axes, rest = [], F.col("_b")
    for v, e in reversed(list(zip(names, edges, strict=True))):
        n = len(e) - 1
        axes.append(F.get(F.array(*map(F.lit, centres(e))), (rest % n).cast("int")).alias(v))
        rest = F.floor(rest / n)
    return Result(rows.select(*keys, *reversed(axes), F.col(out).cast("double").alias(out)), (*keys, *names))


@register_stat("distribution2")
def distribution2(
    frame: GridFrame, bins1: Bins, bins2: Bins, var1: str = "wspd", var2: str = "wdir", isdir1: bool = False, isdir2: bool = True, group: str | None = None, sparse: bool = False, **_
) -> Result:
    """Joint counts ``dist2`` of two variables; directions above the last edge are turned back by 360."""
    return _joint(frame, [var1, var2], [bins1, bins2], [isdir1, isdir2], group, "dist2", sparse)


@register_stat("distribution3")
def distribution3(
    frame: GridFrame, bins1: Bins, bins2: Bins, bins3: Bins, var1: str = "hs", var2: str = "tp", var3: str = "dpm",
    isdir1: bool = False, isdir2: bool = False, isdir3: bool = True, group: str | None = None, sparse: bool = False, **_,
) -> Result:
    """Joint counts ``dist`` of three variables."""
    return _joint(frame, [var1, var2, var3], [bins1, bins2, bins3], [isdir1, isdir2, isdir3], group, "dist", sparse)


@register_stat("distribution3_timestep")
def distribution3_timestep(frame: GridFrame, bins1: Bins, bins2: Bins, bins3: Bins, freq: str = "30d", group: str | None = None, **options) -> Result:
    """``distribution3``; partial aggregation already works through time bit by bit, so ``freq`` changes nothing.

    Each sample counts once, also on a boundary between time windows.
    """
    return distribution3(frame, bins1, bins2, bins3, group=group, **options)
