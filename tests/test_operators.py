"""Semantics that the SQL comparison cannot show: missing values, ties, edges, ends of records."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewell.plans  # noqa: F401 - registration
from tidewell.functions.orbital import wavenumber_exact
from tidewell.model import GridFrame
from tidewell.operators import kernels
from tidewell.operators.binning import bin_index, edges_of
from tidewell.operators.directional import in_sectors
from tidewell.operators.exceedance import hours
from tidewell.plans.pipeline import derive
from tidewell.registry import get_derived, get_stat, list_derived, list_loaders, list_stats, load_plugins, register_derived

T0 = dt.datetime(2020, 1, 1)


def grid(spark, columns, step=1.0, cell="a"):
    n = len(next(iter(columns.values())))
    rows = [(T0 + dt.timedelta(hours=step * i), cell, *(None if v[i] is None else float(v[i]) for v in columns.values())) for i in range(n)]
    schema = "time timestamp_ntz, cell string, " + ", ".join(f"{c} double" for c in columns)
    return GridFrame.of(spark.createDataFrame(rows, schema), "time", ("cell",))


def only(result, name):
    rows = result.df.collect()
    assert len(rows) == 1
    return rows[0][name]


def test_registered_names():
    assert set(list_stats()) >= set(
        "mean max min std count quantile pcount mode exceedance nonexceedance range_probability rpv distribution2 distribution3 distribution3_timestep statdir modal_direction hmo winpow".split()
    )
    assert set(list_derived()) >= set("wspd wdir cspd cdir tp douglas_sea douglas_swell crossing_seas uorb clear_sky covered_sky".split())
    assert set(list_loaders()) >= {"xarray", "intake"}
    with pytest.raises(KeyError, match="there are"):
        get_stat("nothing")
    assert load_plugins() == []


def test_registering_again_warns():
    with pytest.warns(UserWarning):
        register_derived("tp")(get_derived("tp"))


def test_nan_is_missing(spark):
    g = grid(spark, {"x": [1, math.nan, None, 3]})
    assert only(get_stat("mean")(g), "x") == 2
    assert only(get_stat("max")(g), "x") == 3
    assert only(get_stat("count")(g), "x") == 2
    assert only(get_stat("pcount")(g), "x") == 50
    assert only(get_stat("exceedance")(g, threshold=1), "x_1") == 0.5
    assert only(get_stat("range_probability")(g, data_ranges={"var": "x", "start": 2}), "x_2_to_max") == 0.5
    assert only(get_stat("mean")(g, skipna=False), "x") is None


def test_all_missing(spark):
    g = grid(spark, {"x": [None, math.nan]})
    assert only(get_stat("mean")(g), "x") is None
    assert only(get_stat("mode")(g, bins=[0, 1, 2]), "x") is None
    assert only(get_stat("modal_direction")(g), "x") is None
    assert only(get_stat("range_probability")(g, data_ranges=[{"var": "x", "start": 2}]), "x_2_to_max") is None
    assert [r.x for r in get_stat("quantile")(g, q=[0.1, 0.9]).df.collect()] == [None, None]


def test_threshold_is_in_both_sides(spark):
    g = grid(spark, {"x": [1, 2, 3]})
    up, down = only(get_stat("exceedance")(g, threshold=2), "x_2"), only(get_stat("nonexceedance")(g, threshold=2), "x_2")
    assert up + down == pytest.approx(4 / 3)
    assert only(get_stat("exceedance")(g, threshold=2, inclusive=False), "x_2") == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("values", "duration", "want"),
    [
        ([0, 1, 1, 0, 1, 0], "2h", 2 / 6),
        ([1, 1, 0, 0, 0, 0], "2h", 0.0),
        ([0, 0, 0, 0, 1, 1], "2h", 0.0),
        ([1, 1, 1, 1, 1, 1], "2h", 0.0),
        ([0, 1, 1, 1, 0, 0], "3h", 3 / 6),
        ([0, 1, 1, None, 1, 0], "2h", 2 / 6),
    ],
)
def test_persistence(spark, values, duration, want):
    assert only(get_stat("exceedance")(grid(spark, {"x": values}), threshold=1, duration=duration), "x_1") == pytest.approx(want)


def test_persistence_of_ends_on_request(spark):
    assert only(get_stat("exceedance")(grid(spark, {"x": [1, 1, 0, 0]}), threshold=1, duration="2h", edge_runs=True), "x_1") == 0.5


def test_several_durations(spark):
    out = get_stat("exceedance")(grid(spark, {"x": [0, 1, 1, 0, 1, 0]}), threshold=1, duration=["1h", "2h"])
    assert {r.duration: r.x_1 for r in out.df.collect()} == {"1h": 0.5, "2h": pytest.approx(1 / 3)}
    assert out.dims == ("cell", "duration")


def test_durations():
    assert [hours(x) for x in ("90min", "1d", "1d 6h", 3, "0h")] == [1.5, 24, 30, 3, 0]
    with pytest.raises(ValueError):
        hours("soon")


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.99, 1.0, 2.0, 2.01, None)], "v double")
    assert [r[0] for r in df.select(bin_index(F.col("v"), [0, 1, 2])).collect()] == [None, 0, 0, 1, 1, None, None]
    g = grid(spark, {"x": [0.5, 3.2]})
    assert edges_of({"start": 0, "step": 1}, g, "x")[-1] == pytest.approx(5.0)
    with pytest.raises(KeyError):
        edges_of({"start": 0}, g, "x")
    with pytest.raises(ValueError):
        edges_of([2, 1], g, "x")


def test_mode_ties_and_weights(spark):
    g = grid(spark, {"x": [0.5, 0.5, 1.5, 1.5, 9.0], "w": [1, 1, 1, 1, 9]})
    assert only(get_stat("mode")(g.pick(["x"]), bins=[0, 1, 2]), "x") == 0.5
    heavy = grid(spark, {"x": [0.5] * 6 + [1.5] * 4, "w": [0.1] * 6 + [10] * 4})
    out = get_stat("mode")(heavy, bins=[0, 1, 2], weight_var="w")
    assert only(out, "x") == 1.5 and out.variables == ["x"]


def test_distribution_is_dense(spark):
    g = grid(spark, {"wspd": [1, 1, 3], "wdir": [350, 10, 90]})
    rows = get_stat("distribution2")(g, bins1=[0, 2, 4], bins2=[-45, 45, 135]).df.collect()
    assert {(r.wspd, r.wdir): r.dist2 for r in rows} == {(1, 0): 2, (1, 90): 0, (3, 0): 0, (3, 90): 1}


def test_sectors(spark):
    g = grid(spark, {"hs": [1, 2, 3, 4, 5], "dpm": [0, 359.9, 90, -10, 370]}).pick(["hs"], ["dpm"])
    rows = {r.direction: r.hs for r in in_sectors(g, get_stat("count"), None, "dpm", 4).df.collect()}
    assert rows == {0: 4, 90: 1, 180: 0, 270: 0}
    joint = {r.direction: r.hs_3 for r in in_sectors(g, get_stat("exceedance"), None, "dpm", 4, threshold=3).df.collect()}
    assert joint == {0: 0.4, 90: 0.2, 180: 0, 270: 0}
    with pytest.raises(ValueError):
        in_sectors(g, get_stat("mean"), None, "nothing", 4)


def test_modal_direction_smooths_over_north(spark):
    g = grid(spark, {"d": [355, 356, 5, 6, 100, 101, 102]})
    assert only(get_stat("modal_direction")(g, bin_width_deg=10, smooth=False), "d") == 105
    assert only(get_stat("modal_direction")(g, bin_width_deg=10), "d") == 5
    with pytest.raises(ValueError):
        get_stat("modal_direction")(g, bin_width_deg=7)


def test_wind_power(spark):
    out = get_stat("winpow")(grid(spark, {"w": [None, 3, 8, 10.61, 24.9, 25]}), agg=None)
    got = [r.w for r in out.df.orderBy("time").collect()]
    assert got[:2] == [0, 0] and 8000 < got[2] < 13490 and got[3:] == [16000, 16000, 0]
    with pytest.raises(NotImplementedError):
        get_stat("winpow")(grid(spark, {"w": [1]}), agg=None, group="month")


def test_douglas_bounds(spark):
    heights = [None, 0, 0.1, 0.11, 0.5, 1.25, 2.5, 4, 6, 9, 14, 14.01]
    g = derive(grid(spark, {"hs_sea": heights}), [dict(name="d", func="douglas_sea")])
    assert [r.d for r in g.df.orderBy("time").collect()] == [0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    g = derive(grid(spark, {"hs_sw1": [0, 1, 1, 3, 3, 3, 5, 5, 5, None], "lp_sw1": [50, 150, 201, 100, 200, 201, 100, 200, 300, 5]}), [dict(name="d", func="douglas_swell")])
    assert [r.d for r in g.df.orderBy("time").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 0]


def test_crossing_seas_needs_more_than_the_bounds(spark):
    g = grid(spark, {"hs": [2, 2, 0.5, 2], "hs_sea": [1, 1, 1, 1], "hs_sw1": [1, 1, 1, 0.5], "dir_sea": [350, 350, 350, 350], "dir_sw1": [30, 31, 31, 31]})
    g = derive(g, [dict(name="c", func="crossing_seas")])
    assert [r.c for r in g.df.orderBy("time").collect()] == [False, True, False, False]


def test_orbital_velocity(spark):
    one = grid(spark, {"hs": [2.0], "tp": [10.0], "dry": [-1.0]})

    def value(**inputs):
        return derive(one, [dict(name="u", func="uorb", **inputs)]).df.first().u

    k = (2 * math.pi / 10) ** 2 / 9.81
    for _ in range(200):
        k = (2 * math.pi / 10) ** 2 / 9.81 / math.tanh(k * 25)
    assert value(depth=25, solver="exact") == pytest.approx(math.pi * 2 / 10 / math.sinh(k * 25), rel=1e-4)
    assert value(depth=25) == pytest.approx(value(depth=25, solver="exact"), rel=2e-3)
    assert value(depth=25, z=20, reference="surface") == pytest.approx(value(depth=25, z=5), rel=1e-6)
    assert value(depth="dry") is None
    assert value(depth=5000) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        value(depth=25, solver="guess")
    with pytest.raises(ValueError):
        value(depth=25, reference="sky")


def test_exact_wavenumber_from_shallow_to_deep_water(spark):
    ys = [10.0 ** (k / 20) for k in range(-120, 61)]
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "i int, y double")
    got = rows.select("i", wavenumber_exact(F.sqrt("y"), F.lit(1.0), 1.0).alias("x")).orderBy("i").toPandas()["x"]
    x, y = np.maximum(np.array(ys), np.sqrt(ys)), np.array(ys)
    for _ in range(100):
        t = np.tanh(x)
        x = x - (x * t - y) / (t + x * (1 - t * t))
    assert np.abs(got / x - 1).max() < 1e-10


def test_quantile_methods(spark):
    g = grid(spark, {"x": [1, 2, 3, 4]})
    want = {"linear": 2.5, "lower": 2, "higher": 3, "midpoint": 2.5}
    assert {m: only(get_stat("quantile")(g, q=0.5, method=m), "x") for m in want} == want


def test_statdir_takes_any_statistic(spark):
    g = grid(spark, {"x": [1, 1, 2, 9, 9, 8, None, 5], "dpm": [0, 10, 350, 180, 170, 190, 0, 90]})
    out = get_stat("statdir")(g, funcs=["mean", "modal_direction"], nsector=2)
    assert out.dims == ("cell", "direction") and set(out.variables) == {"x_mean", "x_modal_direction"}
    alone = get_stat("modal_direction")(g.with_df(g.df.where("dpm BETWEEN 90 AND 269")).pick(["x"]))
    rows = {r.direction: r for r in out.df.collect()}
    assert rows[180.0].x_modal_direction == only(alone, "x") and rows[0.0].x_mean == pytest.approx(4 / 3)
    with pytest.raises(ValueError, match="call of its own"):
        get_stat("statdir")(g, funcs=["mean", "quantile"], nsector=2, q=[0.5])


def test_statdir_names(spark):
    g = grid(spark, {"hs": [1, 3], "dpm": [0, 0]})
    out = get_stat("statdir")(g, funcs=["mean", "max"], nsector=2)
    assert out.variables == ["hs_mean", "hs_max"]
    assert {r.direction: r.hs_mean for r in out.df.collect()} == {0: 2, 180: None}


def test_peaks():
    x = np.array([0, 5, 1, 5, 0, 2, 2, 0, 9.0])
    assert kernels.local_peaks(x, 0, 1).tolist() == [1, 3, 5]
    assert kernels.local_peaks(x, 0, 3).tolist() == [3, ] + ([] if 5 - 3 < 3 else [5])
    assert kernels.local_peaks(np.array([1.0, 2.0]), 0, 1).tolist() == []


def test_gumbel_fit_and_return_values(spark):
    rng = np.random.default_rng(1)
    loc, scale = kernels.fit("gumbel_r", 5 - 2 * np.log(-np.log(rng.random(20_000))))
    assert loc == pytest.approx(5, abs=0.05) and scale == pytest.approx(2, abs=0.05)
    for name in kernels.DISTRIBUTIONS:
        x = rng.gumbel(5, 1, 300) if name != "lognorm" else rng.lognormal(1, 0.3, 300)
        got = kernels.return_values(np.insert(np.repeat(x, 2), 0, 0), 1.0, [1, 10, 100], 50, name, 1)
        assert not np.isnan(got).any() and got[0] <= got[1] <= got[2], name
    g = grid(spark, {"x": list(rng.gumbel(5, 1, 500))})
    out = {r.period: r.x for r in get_stat("rpv")(g, return_periods=[10, 100]).df.collect()}
    assert out[100] >= out[10]
    with pytest.raises(ValueError):
        get_stat("rpv")(g, distribution="nothing")
    with pytest.raises(ValueError):
        get_stat("rpv")(grid(spark, {"x": [1, 2, 3]}, step=48), duration=24)
    assert {r.x for r in get_stat("rpv")(grid(spark, {"x": [1, 2]})).df.collect()} == {None}


def test_spectral_height_of_a_sine(spark):
    t = np.arange(4096)
    x = np.sin(2 * np.pi * t / 16)
    low, total = kernels.band_heights(x, 1.0, 256, [(None, 0.03), (None, None)])
    assert total == pytest.approx(4 * math.sqrt(0.5), rel=0.1) and low < 0.05 * total
    rows = [(float(i), 0, float(v)) for i, v in enumerate(x)]
    g = GridFrame.of(spark.createDataFrame(rows, "time double, cell int, eta double"), "time", ("cell",), ("eta",))
    out = {r.band: r.hs_eta for r in get_stat("hmo")(g).df.collect()}
    assert set(out) == {"0_25", "8_25", "25_120", "25_300", "tot"} and out["tot"] == pytest.approx(4 * math.sqrt(0.5), rel=0.1)


def test_simpson_is_exact_for_cubics():
    x = np.array([0, 0.5, 1.0, 2.0, 3.0, 3.5, 4.0])
    assert kernels.simpson(x**2, x) == pytest.approx(64 / 3)
    assert kernels.simpson(x[:6] ** 2, x[:6]) == pytest.approx(3.5**3 / 3)
