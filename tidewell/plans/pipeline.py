"""Planning and running a pipeline.

Calls that share source, derived variables, grouping and sectors, and whose statistics
are plain aggregates, become one aggregation, so they scan the source once.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewell import functions, operators, sources  # noqa: F401 - registration
from tidewell.model import GridFrame, Result, ResultSet
from tidewell.operators.base import AggregateStat
from tidewell.operators.directional import in_sectors
from tidewell.plans.config import Call, PipelineConfig, parse
from tidewell.plans.output import describe, finish, global_attributes
from tidewell.registry import get_derived, get_loader, get_stat
from tidewell.sources import sinks

log = logging.getLogger(__name__)


def derived_of(given: str | dict[str, Any]) -> tuple[str, str, dict[str, Any]]:
    """Name, function and inputs of a derived variable; one word stands for both name and function."""
    if isinstance(given, str):
        return given, given, {}
    name, func = given.get("name"), given.get("func")
    if not (name or func):
        raise ValueError(f"a derived variable needs a name or a func: {given}")
    return name or func, func or name, {k: v for k, v in given.items() if k not in ("name", "func")}


def derive(frame: GridFrame, wanted: list[str | dict[str, Any]]) -> GridFrame:
    """Add derived variables in order, so later ones may use earlier ones.

    An input that is a string and names a column is that column; by default the column has
    the input's own name.
    """
    import inspect

    for new, func, inputs in map(derived_of, wanted):
        function = get_derived(func)
        given: dict[str, Any] = {}
        for name, parameter in inspect.signature(function).parameters.items():
            value = inputs.get(name, name if parameter.default is inspect.Parameter.empty else parameter.default)
            if isinstance(value, str) and value in frame.df.columns:
                value = frame.number(value) if value in frame.variables else F.col(value)
            elif parameter.default is inspect.Parameter.empty and isinstance(value, str):
                raise ValueError(f"{new}: no variable {value!r} for input {name!r}")
            given[name] = value
        made: Column = function(**given)
        variables = (*(v for v in frame.variables if v != new), new)
        frame = frame.with_df(frame.df.withColumn(new, made), variables=variables)
    return frame


def suffix_of(call: Call) -> str:
    if call.suffix is not None:
        return call.suffix
    return "_".join(["", call.func, *([call.group] if call.group else []), *(["direc"] if call.nsector else [])])


@dataclass
class Planned:
    """A call with its frame and statistic resolved."""

    call: Call
    frame: GridFrame
    stat: Any

    @property
    def fusible(self) -> bool:
        duration = self.call.options.get("duration", "0h")
        return isinstance(self.stat, AggregateStat) and not self.call.tiles and duration in ("0h", 0)

    @property
    def key(self) -> str:
        c = self.call
        return json.dumps([c.dim, c.group, c.nsector, c.dir_var if c.nsector else None, c.derived_vars], sort_keys=True, default=str)


class Pipeline:
    """A configured pipeline on a Spark session."""

    def __init__(self, config: PipelineConfig | dict, spark: SparkSession | None = None) -> None:
        self.config = config if isinstance(config, PipelineConfig) else PipelineConfig.model_validate(config)
        self.spark = spark or SparkSession.builder.getOrCreate()

    @classmethod
    def from_yaml(cls, path: str | Path, spark: SparkSession | None = None) -> Pipeline:
        return cls(parse(Path(path).read_text()), spark)

    @classmethod
    def from_yaml_string(cls, text: str, spark: SparkSession | None = None) -> Pipeline:
        return cls(parse(text), spark)

    def load(self, dim: str = "time") -> GridFrame:
        if self.config.sources is not None:
            raise NotImplementedError("several sources are not supported yet")
        source = self.config.source
        df = get_loader(source.type)().load(self.spark, source)
        cells = getattr(source, "cells", None)
        return GridFrame.of(df, dim, cells)

    def plan(self, call: Call, grid: GridFrame | None = None) -> Planned:
        frame = derive(grid or self.load(call.dim), call.derived_vars)
        extra = [c for c in (call.dir_var,) if c in frame.df.columns and (call.nsector or call.func == "statdir")]
        if call.nsector and not extra:
            raise ValueError(f"no such variable: {call.dir_var}")
        if call.data_vars == "all":
            variables = list(frame.variables)
        else:
            variables = list(dict.fromkeys([*call.data_vars, *(derived_of(d)[0] for d in call.derived_vars)]))
        frame = frame.pick(variables, [*extra, *(v for v in [call.options.get("weight_var")] if v)])
        if call.chunks or call.tiles:
            dims = [d for d, n in {**call.chunks, **call.tiles}.items() if d in frame.cells and n != -1]
            frame = frame.with_df(frame.df.repartition(*dims)) if dims else frame
        return Planned(call, frame, get_stat(call.func))

    def one(self, planned: Planned) -> Result:
        call, options = planned.call, planned.call.options
        if call.func == "statdir":
            return planned.stat(planned.frame, group=call.group, dir_var=call.dir_var, **({"nsector": call.nsector} if call.nsector else {}), **options)
        if call.nsector:
            return in_sectors(planned.frame, planned.stat, call.group, call.dir_var, call.nsector, **options)
        return planned.stat(planned.frame, group=call.group, **options)

    def compute(self) -> tuple[ResultSet, GridFrame | None]:
        """Results of all calls under their output names."""
        grids: dict[str, GridFrame] = {}
        planned = []
        for call in self.config.calls:
            if call.dim not in grids:
                grids[call.dim] = self.load(call.dim)
            planned.append(self.plan(call, grids[call.dim]))
        results, fused = ResultSet(), {}
        for p in planned:
            if p.fusible:
                fused.setdefault(p.key, []).append(p)
        done = set()
        for p in planned:
            if p.fusible:
                if p.key in done:
                    continue
                done.add(p.key)
                self._add(results, self._fuse(fused[p.key], grids[p.call.dim]), fused[p.key])
            else:
                suffix = suffix_of(p.call)
                made = self.one(p)
                names = {v: v + suffix for v in made.variables}
                origin = {names[v]: (self._variable(p, v), p.call.func, p.call.group) for v in names}
                results.add(describe(made.rename(names), origin, self.config.metadata))
        return results, next(iter(grids.values()), None)

    @staticmethod
    def _variable(p: Planned, output: str) -> str:
        fits = [v for v in p.frame.variables if output == v or output.startswith(f"{v}_")]
        return max(fits, key=len, default=output)

    def _fuse(self, calls: list[Planned], grid: GridFrame) -> Result:
        """One aggregation for calls with the same rows and keys."""
        first = calls[0]
        variables = tuple(dict.fromkeys(v for p in calls for v in p.frame.variables))
        wide = derive(grid, first.call.derived_vars) if len(calls) > 1 else first.frame
        wide = wide.pick(variables, tuple(dict.fromkeys(e for p in calls for e in p.frame.extra)))

        def columns(frame: GridFrame, value, **_) -> dict[str, Column]:
            made: dict[str, Column] = {}
            for p in calls:
                for v, c in p.stat.columns(p.frame, value, **{k: o for k, o in p.call.options.items() if k != "duration"}).items():
                    name = v + suffix_of(p.call)
                    if name in made:
                        raise ValueError(f"two calls give {name!r}; set a suffix")
                    made[name] = c
            return made

        fused, call = AggregateStat("fused", columns), first.call
        return fused.by_sector(wide, call.group, call.dir_var, call.nsector) if call.nsector else fused(wide, group=call.group)

    def _add(self, results: ResultSet, made: Result, calls: list[Planned]) -> None:
        origin = {}
        for p in calls:
            suffix = suffix_of(p.call)
            origin |= {n: (self._variable(p, n.removesuffix(suffix)), p.call.func, p.call.group) for n in made.variables if n.endswith(suffix)}
        results.add(describe(made, origin, self.config.metadata))

    def run(self) -> ResultSet:
        """Compute, finish, write, and upload if asked; returns the finished results."""
        results, source = self.compute()
        out = self.config.output
        if source is None:
            return results
        finished = finish(results, source, out.mask)
        sinks.write(self.spark, finished, out.outfile, global_attributes(source, out.global_attrs), out.append, out.chunks)
        if out.consolidate and not out.outfile.endswith(".nc"):
            sinks.consolidate(self.spark, out.outfile.rstrip("/"))
        if out.updir:
            log.info("uploaded to %s", sinks.upload(self.spark, out.outfile, out.updir))
        return finished
