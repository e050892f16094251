"""Speed and direction of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.registry import register_derived


def _speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


@register_derived("wspd")
def wspd(uwnd: Column, vwnd: Column) -> Column:
    return _speed(uwnd, vwnd)


@register_derived("wdir")
def wdir(uwnd: Column, vwnd: Column) -> Column:
    """Direction the wind comes from, degrees clockwise from north."""
    return F.pmod(270 - F.degrees(F.atan2(vwnd, uwnd)), F.lit(360.0))


@register_derived("cspd")
def cspd(ucur: Column, vcur: Column) -> Column:
    return _speed(ucur, vcur)


@register_derived("cdir")
def cdir(ucur: Column, vcur: Column) -> Column:
    """Direction the current goes to, degrees clockwise from north."""
    return F.pmod(90 - F.degrees(F.atan2(vcur, ucur)), F.lit(360.0))
