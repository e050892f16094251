"""Statistics that are plain aggregates, which lets calls with the same keys run as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import GridFrame, Result
from tidewell.registry import register_stat

#: value(name) gives a variable's column, masked by sector where asked.
Value = Callable[[str], Column]


class AggregateStat:
    """A statistic given by aggregate columns; ``columns(frame, value, **options)`` makes them."""

    def __init__(self, name: str, columns: Callable[..., dict[str, Column]]) -> None:
        self.name, self.columns = name, columns
        self.__doc__ = columns.__doc__

    def __call__(self, frame: GridFrame, group: str | None = None, **options) -> Result:
        df, keys = frame.keyed(group)
        made = self.columns(frame, frame.number, **options)
        return Result(aggregate(df, keys, made), tuple(keys))

    def by_sector(self, frame: GridFrame, group: str | None, dir_var: str, nsector: int, **options) -> Result:
        """All sectors in one pass: each sector has its own conditional aggregates.

        Samples of other sectors count as missing, so statistics over all samples keep
        their denominator, and empty sectors are present.
        """
        df, keys = frame.keyed(group)
        df = df.withColumn("_sector", sector(F.col(dir_var), nsector))
        per = []
        for i in range(nsector):
            made = self.columns(frame, lambda name, i=i: F.when(F.col("_sector") == i, frame.number(name)), **options)
            per.append(F.struct(F.lit(i * 360.0 / nsector).alias("direction"), *(c.alias(k) for k, c in made.items())))
        rows = aggregate(df, keys, {"_s": F.array(*per)}).select(*keys, F.inline("_s"))
        return Result(rows, (*keys, "direction"))


def aggregate(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    columns = [c.alias(k) for k, c in made.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def aggregate_stat(name: str):
    """Register a function that makes aggregate columns."""

    def add(columns: Callable[..., dict[str, Column]]) -> AggregateStat:
        return register_stat(name)(AggregateStat(name, columns))

    return add


def sector(direction: Column, n: int) -> Column:
    """Number of the sector, centred on 0, 360/n ... degrees; the first one wraps around north.

    Directions outside 0 to 360 are not turned back; they belong to the wrapping sector.
    """
    if n < 1:
        raise ValueError("nsector must be 1 or more")
    width = 360.0 / n
    inside = (direction >= width / 2) & (direction < 360.0 - width / 2)
    at = F.when(inside, F.floor((direction + width / 2) / width)).otherwise(0)
    if n == 1:
        at = F.lit(0)
    return F.when(direction.isNotNull(), at.cast("int"))


def melt(df: DataFrame, keys: list[str], values: dict[str, Column], extra: list[Column] | None = None) -> DataFrame:
    """Variables as rows: keys, ``_var``, ``_v`` and what ``extra`` names."""
    pairs = F.array(*(F.struct(F.lit(k).alias("_var"), v.alias("_v")) for k, v in values.items()))
    return df.select(*keys, *(extra or []), F.explode(pairs).alias("_x")).select("*", "_x._var", "_x._v").drop("_x")


def spread(df: DataFrame, keys: list[str], names: dict[str, str], value: Column) -> DataFrame:
    """Rows of variables back to columns; ``names`` gives the output name of each variable."""
    made = {out: F.max(F.when(F.col("_var") == var, value)) for var, out in names.items()}
    return aggregate(df, keys, made)
