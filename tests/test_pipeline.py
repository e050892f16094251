"""Configuration, selection, pipelines, writers, masks and the command line."""

import datetime as dt
import json

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from tidewell.cli import main
from tidewell.model import GridFrame, Result, ResultSet
from tidewell.plans import Pipeline, PipelineConfig
from tidewell.plans.config import Call, Mask, Source, parse
from tidewell.plans.pipeline import derived_of
from tidewell.registry import register_loader
from tidewell.sources import sinks
from tidewell.sources.loaders import read
from tidewell.sources.select import prepare
from tidewell.sources.zarr import Store
from tidewell.streaming import incremental, samples


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid") / "in.parquet")
    rows = [
        (dt.datetime(2020, 1, 1) + dt.timedelta(hours=12 * t), lat, lon, None if lat == -40.0 else 1.0 + t % 5, 10.0, float(t * 45 % 360))
        for t in range(120) for lat in (-40.0, -39.0) for lon in (170.0, 171.0)
    ]
    spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, hs double, tp double, dpm double").write.parquet(path)
    return path


CELLS = ["latitude", "longitude"]


def config(data, out, calls, **output):
    return {"source": {"type": "xarray", "urlpath": data, "engine": "parquet", "cells": CELLS}, "output": {"outfile": str(out), **output}, "calls": calls}


def test_config_rules():
    with pytest.raises(ValidationError):
        PipelineConfig.model_validate({"output": {"outfile": "x.zarr"}, "calls": []})
    with pytest.raises(ValidationError):
        Source(type="xarray")
    with pytest.raises(ValidationError):
        Mask(type="threshold", var="hs")
    with pytest.raises(ValidationError):
        Call(func="mean", nsector=0)
    assert derived_of("wspd") == ("wspd", "wspd", {}) == derived_of({"func": "wspd"}) == derived_of({"name": "wspd"})
    assert derived_of({"name": "x", "func": "wspd", "uwnd": "u10"}) == ("x", "wspd", {"uwnd": "u10"})
    with pytest.raises(ValueError):
        derived_of({"uwnd": "u10"})
    text = "source: {type: xarray, urlpath: x}\noutput: {outfile: y.zarr}\ncalls: [{func: mean, use_flox: false}]\ncluster: {enabled: true, n_workers: 3}\n"
    assert parse(text).source.engine == "zarr" and parse(text).calls[0].options == {}
    call = Call(func="quantile", q=[0.5])
    assert call.options == {"q": [0.5]} and call.dim == "time" and call.dir_var == "dpm"


def test_run_writes_and_names(spark, data, tmp_path):
    calls = [
        {"func": "mean", "data_vars": ["hs", "tp"]}, {"func": "max", "data_vars": ["hs"], "group": "month"}, {"func": "exceedance", "data_vars": ["hs"], "threshold": 2.5},
        {"func": "quantile", "data_vars": ["hs"], "q": [0.5, 0.9]}, {"func": "mean", "data_vars": ["hs"], "nsector": 4}, {"func": "count", "data_vars": ["hs"], "suffix": "_n"},
    ]
    out = Pipeline(config(data, tmp_path / "out.zarr", calls), spark).run()
    names = {v for r in out.values() for v in r.variables}
    assert names == {"hs_mean", "tp_mean", "hs_max_month", "hs_2.5_exceedance", "hs_quantile", "hs_mean_direc", "hs_n"}
    assert ("quantile", *CELLS) in out
    info = Store(spark, str(tmp_path / "out.zarr"))
    assert info.read_json(".zattrs")["time_coverage_resolution"] == "P0DT12H0M0S"
    known = info.known()
    assert known["hs_max_month"][1]["long_name"] == "monthly maximum significant wave height" and known["hs_max_month"][1]["_ARRAY_DIMENSIONS"] == [*CELLS, "month"]
    assert known["hs_mean"][0]["dtype"] == "<f4" and known["hs_quantile"][0]["shape"] == [2, 2, 2] and set(known) == names | {*CELLS, "month", "quantile", "direction"}
    Pipeline(config(data, tmp_path / "out.parquet", calls), spark).run()
    info = sinks.store_info(spark, str(tmp_path / "out.parquet"))
    assert info["attrs"]["time_coverage_resolution"] == "P0DT12H0M0S"
    assert info["variables"]["hs_max_month"]["attrs"]["long_name"] == "monthly maximum significant wave height"
    assert sinks.read_store(spark, str(tmp_path / "out.parquet"), "hs_2.5_exceedance").count() == 4
    stored = sinks.read_store(spark, str(tmp_path / "out.parquet"), "hs_mean")
    assert dict(stored.dtypes)["hs_mean"] == "float" and stored.where("hs_mean IS NULL").count() == 2
    assert not list(tmp_path.glob("*.writing-*"))


def test_zarr_round_trip(spark, data, tmp_path):
    df = spark.read.parquet(data)
    results = ResultSet()
    results.add(Result(df, ("time", "latitude", "longitude")))
    results.add(Result(df.groupBy("latitude").agg(F.max("tp").alias("depth")), ("latitude",)))
    path = str(tmp_path / "grid.zarr")
    for chunks in ({}, {"time": 50, "longitude": 1}):
        sinks.write(spark, results, path, {"title": "x"}, chunks=chunks)
        back = read(spark, path, "zarr")
        assert dict(back.dtypes)["time"] == "timestamp_ntz" and back.columns[:3] == ["time", "latitude", "longitude"]
        assert sorted(map(repr, back.drop("depth").select(*df.columns).collect())) == sorted(map(repr, df.collect()))
        assert back.select("depth").distinct().collect()[0].depth == 10
    meta = json.loads((tmp_path / "grid.zarr" / ".zmetadata").read_text())["metadata"]
    assert meta["hs/.zarray"]["chunks"] == [50, 2, 1] and meta["time/.zattrs"]["units"] == "seconds since 1970-01-01"
    # The cells without a value have no files: hs is missing at one latitude only, tp nowhere.
    assert {p.name for p in (tmp_path / "grid.zarr" / "tp").glob("[0-9]*")} == {f"{a}.0.{b}" for a in range(3) for b in range(2)}
    for codec in (None, {"id": "gzip"}, {"id": "zstd"}):
        recode(tmp_path / "grid.zarr" / "hs", codec)
        assert read(spark, path, "zarr").agg(F.sum("hs")).first()[0] == df.agg(F.sum("hs")).first()[0]
    c = config(path, tmp_path / "m.zarr", [{"func": "mean", "data_vars": ["hs"]}])
    c["source"] |= {"engine": "zarr"}
    del c["source"]["cells"]
    assert Pipeline(c, spark).compute()[0][tuple(CELLS)].df.count() == 4
    (tmp_path / "grid.zarr" / "hs" / ".zarray").write_text(json.dumps({**meta["hs/.zarray"], "compressor": {"id": "blosc"}}))
    (tmp_path / "grid.zarr" / ".zmetadata").unlink()
    with pytest.raises(ValueError, match="blosc"):
        read(spark, path, "zarr")
    for engine in ("cfgrib",):
        with pytest.raises(ValueError, match=engine):
            read(spark, path, engine)


def recode(array, codec):
    import gzip
    import zlib

    import zstandard

    meta = json.loads((array / ".zarray").read_text())
    unpack = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[(meta["compressor"] or {}).get("id")]
    pack = {None: bytes, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[(codec or {}).get("id")]
    for chunk in array.glob("[0-9]*"):
        chunk.write_bytes(pack(unpack(chunk.read_bytes())))
    meta["compressor"] = codec
    for place, name in ((array / ".zarray", None), (array.parent / ".zmetadata", f"{array.name}/.zarray")):
        whole = json.loads(place.read_text())
        if name:
            whole["metadata"][name] = meta
        place.write_text(json.dumps(whole if name else meta))


def test_run_computes_results_once(spark, data, tmp_path):
    """The source is scanned once for a set of fused results, however many variables they hold."""
    calls = [{"func": f, "data_vars": ["hs", "tp"]} for f in ("mean", "max", "min", "std", "count")] + [{"func": f, "data_vars": ["hs"], "nsector": 4} for f in ("mean", "max")]
    made, _ = Pipeline(config(data, tmp_path / "o.parquet", calls), spark).compute()
    assert set(made) == {tuple(CELLS), (*CELLS, "direction")}
    for result in made.values():
        plan = result.df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("once", "write")
    sinks.write(spark, made, str(tmp_path / "o.parquet"), {})
    scans = 0
    for job in jobs.getJobIdsForGroup("once"):
        scans += len(jobs.getJobInfo(job).stageIds)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Two results, aggregated and sorted once each, and one short copy for each of 12 variables.
    assert scans <= 30


def test_plain_calls_share_one_scan(spark, data, tmp_path):
    calls = [{"func": f, "data_vars": ["hs"]} for f in ("mean", "max", "min", "std", "count")]
    out, _ = Pipeline(config(data, tmp_path / "x.zarr", calls), spark).compute()
    plan = out[tuple(CELLS)].df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "dpm" not in plan.split("Relation")[0]


def test_roles_from_the_schema(spark, data):
    grid = GridFrame.of(spark.read.parquet(data))
    assert grid.cells == ("latitude", "longitude") and grid.variables == ("hs", "tp", "dpm") and grid.dim == "time"


def test_same_name_twice_is_an_error(spark, data, tmp_path):
    calls = [{"func": "mean", "data_vars": ["hs"]}, {"func": "mean", "data_vars": ["hs"]}]
    with pytest.raises(ValueError, match="suffix"):
        Pipeline(config(data, tmp_path / "x.zarr", calls), spark).compute()


def test_append_keeps_other_variables(spark, data, tmp_path):
    path = tmp_path / "a.zarr"
    Pipeline(config(data, path, [{"func": "mean", "data_vars": ["hs"]}]), spark).run()
    Pipeline(config(data, path, [{"func": "max", "data_vars": ["hs"]}], append=True, consolidate=True), spark).run()
    assert set(Store(spark, str(path)).known()) == {"hs_mean", "hs_max", *CELLS} and Store(spark, str(path)).exists(".zmetadata")
    with pytest.raises(ValueError, match="labels"):
        Pipeline(config(data, path, [{"func": "min", "data_vars": ["hs"]}], append=True) | {"source": {"type": "xarray", "urlpath": data, "engine": "parquet", "cells": CELLS, "sel": {"latitude": [-40.0]}}}, spark).run()
    Pipeline(config(data, path, [{"func": "min", "data_vars": ["hs"]}]), spark).run()
    assert set(Store(spark, str(path)).known()) == {"hs_min", *CELLS}
    path = tmp_path / "a.parquet"
    Pipeline(config(data, path, [{"func": "mean", "data_vars": ["hs"]}]), spark).run()
    Pipeline(config(data, path, [{"func": "max", "data_vars": ["hs"]}], append=True, consolidate=True), spark).run()
    assert set(sinks.store_info(spark, str(path))["variables"]) == {"hs_mean", "hs_max"}
    Pipeline(config(data, path, [{"func": "min", "data_vars": ["hs"]}]), spark).run()
    assert set(sinks.store_info(spark, str(path))["variables"]) == {"hs_min"}


def test_mask_and_derived(spark, data, tmp_path):
    calls = [{"func": "mean", "data_vars": [], "derived_vars": [{"name": "f", "func": "tp", "fp": "tp"}]}]
    out = Pipeline(config(data, tmp_path / "m.zarr", calls, mask={"type": "notnull", "var": "hs", "isel": {"time": 0}}), spark).run()
    got = {(r.latitude, r.longitude): r.f_mean for r in out[tuple(CELLS)].df.collect()}
    assert got == {(-40, 170): None, (-40, 171): None, (-39, 170): pytest.approx(0.1), (-39, 171): pytest.approx(0.1)}


def test_netcdf_header(spark, data, tmp_path):
    path = tmp_path / "out.nc"
    Pipeline(config(data, path, [{"func": "mean", "data_vars": ["hs"]}]), spark).run()
    raw = path.read_bytes()
    assert raw[:4] == b"CDF\x02" and b"hs_mean" in raw and b"latitude" in raw
    with pytest.raises(ValueError):
        Pipeline(config(data, tmp_path / "out.txt", [{"func": "mean", "data_vars": ["hs"]}]), spark).run()


def test_netcdf_round_trip(spark, data, tmp_path):
    path = tmp_path / "grid.nc"
    df = spark.read.parquet(data)
    results = ResultSet()
    results.add(Result(df, ("time", "latitude", "longitude")))
    results.add(Result(df.groupBy("latitude").agg(F.max("tp").alias("depth")), ("latitude",)))
    sinks.write(spark, results, str(path), {})
    back = read(spark, str(path), "scipy")
    assert back.columns == ["time", "latitude", "longitude", "hs", "tp", "dpm", "depth"] and dict(back.dtypes)["time"] == "timestamp_ntz"
    assert sorted(back.drop("depth").collect(), key=repr) == sorted(df.collect(), key=repr)
    assert back.select("depth").distinct().collect()[0].depth == 10
    c = config(str(path), tmp_path / "n.zarr", [{"func": "mean", "data_vars": ["hs"]}])
    c["source"] |= {"engine": "netcdf4"}
    assert Pipeline(c, spark).compute()[0][tuple(CELLS)].df.count() == 4


def test_netcdf_records_and_packing(spark, tmp_path):
    import struct

    def text(x):
        return struct.pack(">I", len(x)) + x.encode() + b"\0" * (-len(x) % 4)

    head = b"CDF\x01" + struct.pack(">I", 2) + struct.pack(">II", 10, 2) + text("time") + struct.pack(">I", 0) + text("x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    packed = struct.pack(">II", 12, 2) + text("scale_factor") + struct.pack(">IId", 6, 1, 0.5) + text("_FillValue") + struct.pack(">IIhh", 3, 1, -9, 0)
    units = struct.pack(">II", 12, 1) + text("units") + struct.pack(">II", 2, 22) + b"hours since 2020-01-01\0\0"
    one = text("time") + struct.pack(">II", 1, 0) + units + struct.pack(">II", 6, 8)
    two = text("v") + struct.pack(">III", 2, 0, 1) + packed + struct.pack(">II", 3, 8)
    begin = len(head) + 8 + len(one) + 4 + len(two) + 4
    body = struct.pack(">d3hh", 0.0, 2, 4, -9, 0) + struct.pack(">d3hh", 6.0, 1, 3, 5, 0)
    (tmp_path / "r.nc").write_bytes(head + struct.pack(">II", 11, 2) + one + struct.pack(">I", begin) + two + struct.pack(">I", begin + 8) + body)
    rows = read(spark, str(tmp_path / "r.nc"), "netcdf3").orderBy("time", "x").collect()
    assert [r.v for r in rows] == [1, 2, None, 0.5, 1.5, 2.5] and rows[3].time == dt.datetime(2020, 1, 1, 6)


def test_upload(spark, data, tmp_path):
    Pipeline(config(data, tmp_path / "u.zarr", [{"func": "mean", "data_vars": ["hs"]}], updir=str(tmp_path / "up")), spark).run()
    assert json.loads((tmp_path / "up" / "u.zarr" / ".zmetadata").read_text())["metadata"]
    with pytest.raises(FileNotFoundError):
        sinks.upload(spark, str(tmp_path / "none.zarr"), str(tmp_path / "up"))
    assert sinks.upload(spark, "gs://bucket/x.zarr", "gs://other") == "gs://bucket/x.zarr"


def test_selection(spark, data):
    df = spark.read.parquet(data)
    assert prepare(df, sel={"latitude": {"start": -39.5}}).select("latitude").distinct().count() == 1
    assert prepare(df, sel={"time": {"stop": "2020-01-01"}}).select("time").distinct().count() == 2
    assert prepare(df, sel={"time": {"start": "2020-01", "stop": "2020-01"}}).select("time").distinct().count() == 62
    one = prepare(df, sel={"latitude": -40.0}, isel={"time": [0, -1]})
    assert "latitude" not in one.columns and one.count() == 4
    assert prepare(df, isel={"longitude": 1}).columns == [c for c in df.columns if c != "longitude"]
    assert prepare(df, isel={"time": {"start": 2, "stop": 4}}).select("time").distinct().count() == 2
    assert prepare(df, sel={"latitude": [-39.2], "method": "nearest"}).first().latitude == -39
    with pytest.raises(KeyError):
        prepare(df, sel={"latitude": [-39.2], "method": "nearest", "tolerance": 0.1})
    with pytest.raises(KeyError):
        prepare(df, sel={"latitude": [1.0]})
    with pytest.raises(ValueError):
        prepare(df, sel={"latitude": {"start": 10}})
    assert "Hs" in prepare(df, mapping={"hs": "Hs", "none": "x"}).columns
    plan = prepare(df, sel={"latitude": {"start": -39.5}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude,-39.5)" in plan


def test_catalog_and_plugin_loader(spark, data, tmp_path):
    (tmp_path / "inner.yml").write_text(f"sources:\n  waves:\n    driver: parquet\n    args:\n      urlpath: '{data}'\n")
    (tmp_path / "outer.yml").write_text("sources:\n  hindcast:\n    driver: yaml_file_catalog\n    args:\n      path: '{{ CATALOG_DIR }}/inner.yml'\n")
    c = config(data, tmp_path / "c.zarr", [{"func": "mean", "data_vars": ["hs"]}])
    c["source"] = {"type": "intake", "catalog": str(tmp_path / "outer.yml"), "dataset_id": "hindcast.waves", "cells": CELLS}
    assert Pipeline(c, spark).compute()[0][tuple(CELLS)].df.count() == 4

    @register_loader("mine")
    class Mine:
        def load(self, spark, config):
            return spark.read.parquet(config.where)

    c["source"] = {"type": "mine", "where": data, "cells": CELLS}
    assert Pipeline(c, spark).compute()[0][tuple(CELLS)].df.count() == 4
    c["source"] = None
    c["sources"] = {"a": {"type": "mine", "where": data}}
    with pytest.raises(NotImplementedError):
        Pipeline(c, spark).compute()


def test_command_line(spark, data, tmp_path, capsys, monkeypatch):
    assert main(["list-stats"]) == 0 and "modal_direction" in capsys.readouterr().out
    text = json.dumps(config(data, tmp_path / "cli.zarr", [{"func": "mean", "data_vars": ["hs"]}]))
    (tmp_path / "c.yml").write_text(text)
    assert main(["run", str(tmp_path / "c.yml")]) == 0
    monkeypatch.setenv("CONFIG", text)
    assert main(["run"]) == 0
    monkeypatch.delenv("CONFIG")
    assert main(["run"]) == 2


def test_stream_equals_batch(spark, data, tmp_path):
    stream = samples(spark.readStream.schema(spark.read.parquet(data).schema).parquet(data))
    grid = GridFrame.of(stream, "time", CELLS, ["hs"])
    out = incremental(grid, {"mean": {}, "count": {}, "exceedance": {"threshold": 2}}, group="month")
    query = out.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = incremental(GridFrame.of(spark.read.parquet(data), "time", CELLS, ["hs"]), {"mean": {}, "count": {}, "exceedance": {"threshold": 2}}, group="month")
    assert sorted(map(tuple, spark.table("running").collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
