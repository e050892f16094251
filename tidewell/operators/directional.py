"""Statistics by directional sector and the modal direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.operators.base import AggregateStat, melt, sector, spread
from tidewell.registry import get_stat, register_stat


def in_sectors(frame: GridFrame, stat, group: str | None, dir_var: str, nsector: int, **options) -> Result:
    """Any statistic by sector of ``dir_var``; dim ``direction`` holds the sector centres.

    Plain aggregates take all sectors in one pass.  For others the sector is one more
    cell dim: each row stands once in every sector, as missing in all but its own, so
    the source is read once and every sector holds all samples.
    """
    if dir_var not in frame.df.columns:
        raise ValueError(f"no such variable: {dir_var}")
    duration = options.get("duration", "0h")
    if isinstance(stat, AggregateStat) and duration in ("0h", 0, ["0h"]):
        options.pop("duration", None)
        return stat.by_sector(frame, group, dir_var, nsector, **options)
    at = sector(F.col(dir_var), nsector)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(i * 360.0 / nsector).alias("direction")) for i in range(nsector)))
    rows = frame.df.withColumn("_own", at).withColumn("_sector", F.explode(each))
    rows = rows.withColumns({"direction": F.col("_sector.direction"), **{v: F.when(F.col("_own") == F.col("_sector.i"), frame.number(v)) for v in frame.variables}})
    made = stat(frame.with_df(rows.drop("_own", "_sector"), cells=(*frame.cells, "direction")), group=group, **options)
    return Result(made.df, (*(d for d in made.dims if d != "direction"), "direction"))


@register_stat("statdir")
def statdir(frame: GridFrame, funcs: Sequence[str], dir_var: str = "dpm", nsector: int = 4, group: str | None = None, **options) -> Result:
    """Several statistics by sector, named {variable}_{statistic}; plain aggregates share one pass.

    Statistics with dims of their own (quantiles, periods) are to be asked for on their own.
    """
    variables = tuple(v for v in frame.variables if v != dir_var)
    frame = frame.pick(variables, [dir_var])

    plain = [name for name in funcs if isinstance(get_stat(name), AggregateStat)]

    def columns(frame: GridFrame, value, **given):
        return {f"{v}_{name}": c for name in plain for v, c in get_stat(name).columns(frame, value, **given).items()}

    out = AggregateStat("statdir", columns).by_sector(frame, group, dir_var, nsector, **options) if plain else None
    for name in funcs:
        if name in plain:
            continue
        made = in_sectors(frame, get_stat(name), group, dir_var, nsector, **options)
        made = made.rename({v: f"{v}_{name}" for v in made.variables})
        if out is None:
            out = made
        elif made.dims == out.dims:
            out = Result(out.df.join(made.df, list(out.dims), "full_outer"), out.dims)
        else:
            raise ValueError(f"{name!r} gives results over {made.dims}, the others over {out.dims}; make it a call of its own")
    return out


@register_stat("modal_direction")
def modal_direction(frame: GridFrame, weight_var: str | None = None, bin_width_deg: float = 10.0, smooth: bool = True, group: str | None = None, **_) -> Result:
    """Centre of the fullest bin of the circular histogram, after a circular mean over three bins.

    The lowest bin wins a tie; NULL without valid samples or weight.
    """
    n = round(360 / bin_width_deg)
    if abs(n * bin_width_deg - 360) > 1e-9:
        raise ValueError("bin_width_deg must divide 360")
    df, keys = frame.keyed(group)
    variables = [v for v in frame.variables if v != weight_var]
    weight = frame.number(weight_var) if weight_var else F.lit(1.0)

    def placed(v: str):
        x = frame.number(v)
        valid = x.isNotNull() & weight.isNotNull()
        at = F.least(F.floor(F.pmod(x, F.lit(360.0)) / bin_width_deg), F.lit(n - 1)).cast("int")
        return F.struct(F.when(valid, at).alias("b"), F.when(valid, weight).alias("w"))

    rows = melt(df, keys, {v: placed(v) for v in variables})
    per_bin = rows.groupBy(*keys, "_var", F.col("_v.b").alias("b")).agg(F.sum("_v.w").alias("w"))
    held = F.filter(F.collect_list(F.struct("b", "w")), lambda s: s["b"].isNotNull())
    full = per_bin.groupBy(*keys, "_var").agg(F.map_from_entries(held).alias("m"))
    full = full.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))))
    full = full.withColumn("total", F.aggregate("h", F.lit(0.0), lambda a, x: a + x))
    if smooth and n > 1:
        around = F.transform("h", lambda x, i: (F.get("h", (i + n - 1) % n) + x + F.get("h", (i + 1) % n)) / 3)
        full = full.withColumn("h", around)
    best = full.withColumn("c", F.when(F.col("total") > 0, (F.array_position("h", F.array_max("h")) - 0.5) * bin_width_deg))
    return Result(spread(best, keys, {v: v for v in variables}, F.col("c")), tuple(keys))
