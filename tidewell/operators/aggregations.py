"""Simple reductions, quantiles and the histogram mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import Value, aggregate, aggregate_stat, melt, spread
from tidewell.operators.binning import bin_index, centres, edges_of
from tidewell.registry import register_stat


def _skip(made: Column, value: Column, skipna: bool) -> Column:
    return made if skipna else F.when(F.count(value) == F.count(F.lit(1)), made)


@aggregate_stat("mean")
def mean(frame: GridFrame, value: Value, skipna: bool = True, **_) -> dict[str, Column]:
    return {v: _skip(F.avg(value(v)), value(v), skipna) for v in frame.variables}


@aggregate_stat("max")
def maximum(frame: GridFrame, value: Value, skipna: bool = True, **_) -> dict[str, Column]:
    return {v: _skip(F.max(value(v)), value(v), skipna) for v in frame.variables}


@aggregate_stat("min")
def minimum(frame: GridFrame, value: Value, skipna: bool = True, **_) -> dict[str, Column]:
    return {v: _skip(F.min(value(v)), value(v), skipna) for v in frame.variables}


@aggregate_stat("std")
def std(frame: GridFrame, value: Value, ddof: int = 0, skipna: bool = True, **_) -> dict[str, Column]:
    """Standard deviation with divisor n - ddof; NULL where that is not positive."""

    def one(x: Column) -> Column:
        if ddof == 0:
            return F.stddev_pop(x)
        n = F.count(x).cast("double")
        return F.when(n > ddof, F.sqrt(F.var_pop(x) * n / (n - ddof)))

    return {v: _skip(one(value(v)), value(v), skipna) for v in frame.variables}


@aggregate_stat("count")
def count(frame: GridFrame, value: Value, **_) -> dict[str, Column]:
    return {v: F.count(value(v)) for v in frame.variables}


@aggregate_stat("pcount")
def pcount(frame: GridFrame, value: Value, **_) -> dict[str, Column]:
    """Valid samples as a percentage of all samples."""
    return {v: 100.0 * F.count(value(v)) / F.count(F.lit(1)) for v in frame.variables}


@register_stat("quantile")
def quantile(frame: GridFrame, q: Sequence[float] | float, group: str | None = None, approximate: bool = False, accuracy: int = 10_000, method: str = "linear", **_) -> Result:
    """Exact quantiles, linear between samples, over a new dim ``quantile``; ``approximate`` trades exactness for bounded state.

    Other methods (``lower``, ``higher``, ``nearest``, ``midpoint``) sort a cell's samples as an array.
    """
    q = [q] if isinstance(q, (int, float)) else list(q)
    df, keys = frame.keyed(group)

    def one(x: Column) -> Column:
        if approximate:
            return F.percentile_approx(x, q, accuracy)
        if method == "linear":
            return F.percentile(x, F.array(*map(F.lit, q)))
        return F.array(*(_order_statistic(F.sort_array(F.collect_list(x)), p, method) for p in q))

    nothing = F.array(*(F.lit(None).cast("double") for _ in q))
    made = {v: F.coalesce(one(frame.number(v)), nothing) for v in frame.variables}
    rows = aggregate(df, keys, {"_q": F.arrays_zip(F.array(*map(F.lit, q)).alias("quantile"), *(c.alias(v) for v, c in made.items()))})
    return Result(rows.select(*keys, F.inline("_q")), (*keys, "quantile"))


def _order_statistic(x: Column, p: float, method: str) -> Column:
    at = p * (F.size(x) - 1)
    low, high = F.get(x, F.floor(at).cast("int")), F.get(x, F.ceil(at).cast("int"))
    picks = {"lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": F.get(x, F.bround(at).cast("int"))}
    if method not in picks:
        raise ValueError(f"unknown quantile method {method!r}")
    return F.when(F.size(x) > 0, picks[method])


@register_stat("mode")
def mode(frame: GridFrame, bins: dict | Sequence[float], weight_var: str | None = None, group: str | None = None, **_) -> Result:
    """Centre of the fullest bin, the lowest one on a tie; NULL without a finite sample or weight in the bins.

    ``bins`` are edges or {start, stop, step}, or either for each variable by name.
    ``weight_var`` weighs the samples and is no output; weights are not negative.
    """
    df, keys = frame.keyed(group)
    variables = [v for v in frame.variables if v != weight_var]
    edges = {v: edges_of(bins[v] if isinstance(bins, dict) and v in bins else bins, frame, v) for v in variables}
    weight = frame.number(weight_var) if weight_var else F.lit(1.0)
    if weight_var and weight_var not in frame.df.columns:
        raise ValueError(f"no such variable: {weight_var}")

    def placed(v: str) -> Column:
        x = frame.number(v)
        finite = x.isNotNull() & (F.abs(x) < float("inf")) & weight.isNotNull() & (F.abs(weight) < float("inf"))
        return F.struct(F.when(finite, bin_index(x, edges[v])).alias("b"), F.when(finite, weight).alias("w"))

    rows = melt(df, keys, {v: placed(v) for v in variables})
    per_bin = rows.groupBy(*keys, "_var", F.col("_v.b").alias("b")).agg(F.sum("_v.w").alias("w"))
    real = F.col("b").isNotNull()
    best = per_bin.groupBy(*keys, "_var").agg(
        F.max_by(F.when(real, F.col("b")), F.when(real, F.struct("w", (-F.col("b")).alias("low")))).alias("b"), F.sum(F.when(real, F.col("w"))).alias("w")
    )
    centre = F.lit(None).cast("double")
    for v in variables:
        values = F.array(*map(F.lit, centres(edges[v])))
        centre = F.when(F.col("_var") == v, F.get(values, F.col("b"))).otherwise(centre)
    best = best.withColumn("c", F.when(F.col("w") > 0, centre))
    return Result(spread(best, keys, {v: v for v in variables}, F.col("c")), tuple(keys))
