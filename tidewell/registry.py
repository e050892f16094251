"""Names for statistics, derived variables and loaders, and plugins that add more."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable
from importlib.metadata import entry_points

log = logging.getLogger(__name__)
GROUPS = {"tidewell.stats": "stat", "tidewell.derived": "derived", "tidewell.loaders": "loader"}
_TABLES: dict[str, dict[str, Callable]] = {"stat": {}, "derived": {}, "loader": {}}


def _register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def add(item: Callable) -> Callable:
        if name in _TABLES[kind]:
            warnings.warn(f"{kind} {name!r} is registered again; the new one counts", stacklevel=2)
        _TABLES[kind][name] = item
        return item

    return add


def _get(kind: str, name: str) -> Callable:
    try:
        return _TABLES[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are: {', '.join(sorted(_TABLES[kind]))}") from None


def register_stat(name: str):
    """Register ``stat(frame, group=None, **options) -> Result``."""
    return _register("stat", name)


def register_derived(name: str):
    """Register ``derived(**inputs) -> Column``, whose inputs are columns or scalars."""
    return _register("derived", name)


def register_loader(name: str):
    """Register a class whose ``load(spark, config)`` returns a DataFrame."""
    return _register("loader", name)


def get_stat(name: str) -> Callable:
    return _get("stat", name)


def get_derived(name: str) -> Callable:
    return _get("derived", name)


def get_loader(name: str) -> Callable:
    return _get("loader", name)


def list_stats() -> list[str]:
    return sorted(_TABLES["stat"])


def list_derived() -> list[str]:
    return sorted(_TABLES["derived"])


def list_loaders() -> list[str]:
    return sorted(_TABLES["loader"])


def load_plugins() -> list[str]:
    """Import the entry points of installed plugins; one that fails is logged and passed over."""
    done = []
    for group in GROUPS:
        for point in entry_points(group=group):
            try:
                point.load()
                done.append(f"{group}:{point.name}")
            except Exception:  # noqa: BLE001 - a plugin may raise anything
                log.exception("plugin %s of %s failed", point.name, group)
    return done
