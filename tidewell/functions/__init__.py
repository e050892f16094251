"""Derived variables: each builds a Column from Columns, so they stay inside code generation."""

from tidewell.functions import orbital, sky, waves, wind

__all__ = ["orbital", "sky", "waves", "wind"]
