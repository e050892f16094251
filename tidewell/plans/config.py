"""What a pipeline file may say: tables of fields, from which the checking models are made."""

from __future__ import annotations

from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, create_model, model_validator

Names, Sizes, Free = list[str], dict[str, int], dict[str, Any]

# Names and defaults of the fields that pipeline files use (... marks a field that must be given).
SOURCE = {"type": (str, ...), "mapping": (dict[str, str], {}), "sel": (Free, {}), "isel": (Free, {}), "chunks": (Sizes, {}), "engine": (str, "zarr"), "open_kwargs": (Free, {})}
MASK = {"type": (Literal["notnull", "threshold"], ...), "var": (str, ...), "isel": (Free, {}), "operator": (Literal["gt", "lt", "ge", "le"] | None, None), "value": (float | None, None)}
OUTPUT = {"outfile": (str, ...), "updir": (str | None, None), "append": (bool, False), "consolidate": (bool, False), "global_attrs": (Free, {}), "chunks": (Sizes, {})}
CALL = {"func": (str, ...), "data_vars": (Names | Literal["all"], "all"), "derived_vars": (list[str | Free], []), "dim": (str, "time"), "group": (str | None, None), "chunks": (Sizes, {}), "tiles": (Sizes, {}), "nsector": (int | None, None), "dir_var": (str, "dpm"), "suffix": (str | None, None)}
# What sources and masks need beyond that, by type, and fields about execution elsewhere, which Spark has no use for.
NEEDED = {"xarray": ("urlpath",), "intake": ("catalog", "dataset_id"), "threshold": ("operator", "value")}
UNUSED = ("use_dask_cluster", "use_flox")


class _Checked(BaseModel):
    """Fields beyond the table are kept as options; what the ``type`` needs must be there."""

    model_config = ConfigDict(extra="allow")

    @model_validator(mode="after")
    def _whole(self):
        kind = getattr(self, "type", None)
        lacking = [f for f in NEEDED.get(kind, ()) if getattr(self, f, None) is None]
        if lacking:
            raise ValueError(f"type {kind!r} needs {' and '.join(lacking)}")
        sectors = getattr(self, "nsector", None)
        if sectors is not None and sectors < 1:
            raise ValueError("nsector must be 1 or more")
        return self

    @property
    def options(self) -> dict[str, Any]:
        return {k: v for k, v in (self.model_extra or {}).items() if k not in UNUSED}


Source = create_model("Source", __base__=_Checked, **SOURCE)
Mask = create_model("Mask", __base__=_Checked, **MASK)
Output = create_model("Output", __base__=_Checked, mask=(Mask | None, None), **OUTPUT)
Call = create_model("Call", __base__=_Checked, **CALL)


class PipelineConfig(BaseModel):
    """A whole pipeline; sections about execution elsewhere are passed over."""

    output: Output
    calls: list[Call]
    source: Source | None = None
    sources: dict[str, Source] | None = None
    metadata: Free = {}

    @model_validator(mode="after")
    def _whole(self):
        if sum(x is not None for x in (self.source, self.sources)) != 1:
            raise ValueError("a pipeline has a source or sources, and one of them only")
        return self


def parse(text: str) -> PipelineConfig:
    """The configuration that a YAML text holds."""
    return PipelineConfig(**yaml.safe_load(text))
