"""The tidy grid: one row per time step and cell, one column per variable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

def _season(t: Column) -> Column:
    m = F.month(t)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")


#: Names that are dimensions even where their labels are fractional.
COORDINATES = frozenset({"latitude", "longitude", "lat", "lon", "x", "y", "site", "point", "station", "cycle", "lev", "alt"})

CALENDAR: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "season": _season,
    "week": F.weekofyear,
    "dayofyear": F.dayofyear,
    "dayofweek": lambda t: F.weekday(t),
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "date": F.to_date,
}


def calendar(component: str, time: Column) -> Column:
    """Calendar component of a time column, such as ``month`` or ``season``."""
    if component not in CALENDAR:
        raise ValueError(f"unknown calendar component {component!r}; one of {sorted(CALENDAR)}")
    return CALENDAR[component](time)


def named(name: str) -> Column:
    """A column by its whole name, which may hold dots, as in ``hs_0.5``."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_to_null(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """NaN is the missing value of gridded data; Spark would count and order it, so it becomes NULL.

    Columns of ``keep`` (dimensions) stay bare, so that predicates on them reach the scan.
    """
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType)) and f.name not in keep]
    return df.withColumns({c: F.when(~F.isnan(named(c)), named(c)) for c in floats}) if floats else df


@dataclass(frozen=True)
class GridFrame:
    """A DataFrame with the roles of its columns.

    ``dim`` is the dimension that statistics reduce, ``cells`` the dimensions they
    keep, ``variables`` the columns with data.  A missing sample is a row with NULL,
    not an absent row.
    """

    df: DataFrame
    cells: tuple[str, ...]
    variables: tuple[str, ...]
    dim: str | None = "time"
    attrs: dict = field(default_factory=dict)
    #: Columns that masks and weights may use although they are not variables.
    extra: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, dim: str = "time", cells: Sequence[str] | None = None, variables: Sequence[str] | None = None) -> GridFrame:
        """Roles from the schema: fractional and boolean columns are variables, other columns and COORDINATES cells."""
        if variables is None:
            taken = {*(COORDINATES if cells is None else cells), dim}
            kinds = (FloatType, DoubleType) if cells is None else NumericType
            variables = [f.name for f in df.schema.fields if f.name not in taken and (isinstance(f.dataType, kinds) or f.dataType.typeName() == "boolean")]
        if cells is None:
            cells = [c for c in df.columns if c != dim and c not in variables]
        return cls(missing_to_null(df, (*cells, dim)), tuple(cells), tuple(variables), dim)

    def with_df(self, df: DataFrame, **changes) -> GridFrame:
        return replace(self, df=df, **changes)

    def pick(self, variables: Sequence[str], extra: Sequence[str] = ()) -> GridFrame:
        """Keep dims, ``variables`` and ``extra``; Catalyst prunes the scan to them."""
        wanted = dict.fromkeys([*([self.dim] if self.dim else []), *self.cells, *variables, *extra])
        unknown = [c for c in wanted if c not in self.df.columns]
        if unknown:
            raise ValueError(f"no such variable: {', '.join(unknown)}")
        return replace(self, df=self.df.select(*map(named, wanted)), variables=tuple(variables), extra=tuple(c for c in extra if c not in variables))

    def keyed(self, group: str | None) -> tuple[DataFrame, list[str]]:
        """The rows with the group column added, and the columns to group by."""
        if group is None:
            return self.df, list(self.cells)
        return self.df.withColumn(group, calendar(group, F.col(self.dim))), [*self.cells, group]

    def number(self, name: str) -> Column:
        """A variable as double; booleans count as 0 and 1."""
        kind = self.df.schema[name].dataType.typeName()
        return named(name).cast("int").cast("double") if kind == "boolean" else named(name).cast("double")

    def dimension(self, name: str) -> DataFrame:
        """The labels of a dimension in order."""
        return self.df.select(name).distinct().orderBy(name)


@dataclass(frozen=True)
class Result:
    """Values of a statistic: a DataFrame keyed by ``dims``."""

    df: DataFrame
    dims: tuple[str, ...]

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims]

    def rename(self, names: dict[str, str]) -> Result:
        return Result(self.df.withColumnsRenamed(names), self.dims)


class ResultSet(dict):
    """Results by their dims: values over different dims cannot share a table."""

    def add(self, result: Result) -> None:
        """Join by dims with what is there; the same name over the same dims is an error."""
        if result.dims not in self:
            self[result.dims] = result
            return
        here = self[result.dims]
        if both := set(here.variables) & set(result.variables):
            raise ValueError(f"two calls give {sorted(both)} over {result.dims}; set a suffix")
        if result.dims:
            joined = here.df.join(result.df, list(result.dims), "full_outer")
        else:
            joined = here.df.crossJoin(result.df)  # one row each
        self[result.dims] = Result(joined, result.dims)

    def variable(self, name: str) -> DataFrame:
        for result in self.values():
            if name in result.variables:
                return result.df.select(*result.dims, named(name))
        raise KeyError(name)
