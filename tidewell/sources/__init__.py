"""Readers of grids, selections on them, and writers of results."""

from tidewell.sources import loaders, select, sinks

__all__ = ["loaders", "select", "sinks"]
