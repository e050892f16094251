"""Sky conditions from cloud cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.registry import register_derived


@register_derived("clear_sky")
def clear_sky(cloud_cover: Column, cover_threshold: float = 0.0) -> Column:
    return F.coalesce(cloud_cover <= cover_threshold, F.lit(False))


@register_derived("covered_sky")
def covered_sky(cloud_cover: Column, cover_threshold: float = 1.0) -> Column:
    return F.coalesce(cloud_cover >= cover_threshold, F.lit(False))
