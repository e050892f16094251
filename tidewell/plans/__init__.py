"""Declared pipelines: configuration, planning and output."""

from tidewell.plans.config import PipelineConfig
from tidewell.plans.pipeline import Pipeline

__all__ = ["Pipeline", "PipelineConfig"]
