"""Wave period, sea state scales and crossing seas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.registry import register_derived

# Upper bounds in metres of the Douglas sea degrees 0 to 8, degree 9 above.
SEA_BOUNDS = (0.0, 0.1, 0.5, 1.25, 2.5, 4.0, 6.0, 9.0, 14.0)
# Douglas swell degrees by height up to 2 m, up to 4 m, above; and length up to 100 m, up to 200 m, above.
SWELL_DEGREES = ((1, 1, 2), (3, 4, 5), (6, 7, 8))


@register_derived("tp")
def tp(fp: Column) -> Column:
    """Peak period; NULL where the frequency is 0."""
    return F.try_divide(F.lit(1.0), fp)


@register_derived("douglas_sea")
def douglas_sea(hs_sea: Column) -> Column:
    """Degree 0 to 9 by height, bounds belonging to the lower degree; missing height gives 0."""
    degree = F.lit(len(SEA_BOUNDS))
    for k in reversed(range(len(SEA_BOUNDS))):
        degree = F.when(hs_sea <= SEA_BOUNDS[k], k).otherwise(degree)
    return F.when(hs_sea.isNull(), 0).otherwise(degree).cast("double")


@register_derived("douglas_swell")
def douglas_swell(hs_sw1: Column, lp_sw1: Column) -> Column:
    """Degree 0 to 8 by height and wave length; missing or non-positive input gives 0."""

    def by_length(row: tuple[int, int, int]) -> Column:
        return F.when(lp_sw1 <= 100, row[0]).when(lp_sw1 <= 200, row[1]).otherwise(row[2])

    low, moderate, high = map(by_length, SWELL_DEGREES)
    real = (hs_sw1 > 0) & (lp_sw1 > 0)
    return F.when(real, F.when(hs_sw1 <= 2, low).when(hs_sw1 <= 4, moderate).otherwise(high)).otherwise(0).cast("double")


@register_derived("crossing_seas")
def crossing_seas(
    hs: Column, hs_sea: Column, hs_sw1: Column, dir_sea: Column, dir_sw1: Column, hs_sw2: Column | None = None, dir_sw2: Column | None = None,
    hs_threshold: float = 0.5, angle_threshold: float = 40.0, energy_fraction: float = 0.2,
) -> Column:
    """Two systems that each carry enough energy and come from directions far enough apart."""
    floor = F.when(hs > hs_threshold, hs) * math.sqrt(energy_fraction)

    def cross(h1: Column, d1: Column, h2: Column, d2: Column) -> Column:
        apart = F.abs(F.pmod(d1 - d2 + 180.0, F.lit(360.0)) - 180.0)
        return F.coalesce((h1 > floor) & (h2 > floor) & (apart > angle_threshold), F.lit(False))

    found = cross(hs_sea, dir_sea, hs_sw1, dir_sw1)
    if hs_sw2 is not None and dir_sw2 is not None:
        found = found | cross(hs_sea, dir_sea, hs_sw2, dir_sw2) | cross(hs_sw1, dir_sw1, hs_sw2, dir_sw2)
    return found
