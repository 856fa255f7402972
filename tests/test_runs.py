"""The log of a run, archives, runtime configurations, exit codes and the status of townships."""

import json

import numpy as np
import pytest
import yaml
from test_full_run import settings

from parcelspark import config, pipeline, prepare
from parcelspark.__main__ import main
from parcelspark.operators import graph
from parcelspark.runlog import RunLog
from parcelspark.sources import arrays


def test_log(spark, tmp_path, capsys):
    log = RunLog(spark, f"file://{tmp_path}/logs", "r1", "run", pipeline.put_text)
    log.start()
    with log.stage("one"):
        spark.range(100).repartition(3).count()
    log.warning("odd", "something odd", n=1)
    with pytest.raises(KeyError), log.stage("two"):
        raise KeyError("lost")
    log.finish("failed")
    events = [json.loads(x) for x in (tmp_path / "logs/run-r1.jsonl").read_text().splitlines()]
    assert [e["event"] for e in events] == ["run_start", "stage_start", "stage_end", "odd", "stage_start", "stage_failed", "run_end"]
    assert events[2]["details"]["jobs"] >= 1 and events[2]["details"]["tasks"] >= 3 and events[0]["details"]["runtime"]["spark"] == spark.version
    assert events[5]["details"]["exception_type"] == "KeyError" and events[6]["details"]["timings"].keys() == {"one", "two"} and events[6]["details"]["warning_count"] == 1
    assert (tmp_path / "logs/run-latest.log").read_text() == (tmp_path / "logs/run-r1.log").read_text()
    assert len((tmp_path / "logs/run-latest.log").read_text().splitlines()) == 7 and "level=WARNING" in capsys.readouterr().err
    assert json.loads(log.failure(ValueError("x"), a=1))["arguments"] == {"a": 1}


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    given = {"block_features": rng.random((50, 4, 3)), "actions": np.arange(50, dtype=np.int32), "done": np.arange(50) % 2 == 0, "rewards": rng.random(50).astype(np.float32)}
    np.savez_compressed(tmp_path / "t.npz", **given)
    rows = arrays.read_npz(spark, str(tmp_path / "t.npz")).orderBy("row").collect()
    assert len(rows) == 50 and arrays.shape_of(spark, str(tmp_path / "t.npz"))["block_features"][1] == (50, 4, 3)
    for i, r in enumerate(rows):
        assert r.block_features == given["block_features"][i].ravel().tolist() and (r.actions, r.done) == (i, i % 2 == 0) and r.rewards == pytest.approx(given["rewards"][i])
    np.save(tmp_path / "x.npy", np.arange(6).reshape(3, 2))
    assert [r.value for r in arrays.read_npz(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    np.savez(tmp_path / "bad.npz", a=np.arange(3), b=np.arange(4))
    with pytest.raises(ValueError, match="unlike"):
        arrays.read_npz(spark, str(tmp_path / "bad.npz"))


def test_runtime_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(settings()))
    assert main(["render-runtime", str(tmp_path / "c.yaml"), str(tmp_path / "out.yaml"), str(tmp_path / "data"), "--run-name", "test"]) == 0
    got = yaml.safe_load((tmp_path / "out.yaml").read_text())
    assert got["data"]["dltb"] == f"{tmp_path}/data/input/DLTB_with_authority_slope.gpkg" and got["runtime"]["data_root"] == f"{tmp_path}/data"
    assert got["outputs"]["optimized_vector"].startswith(f"{tmp_path}/data/outputs/") and config.runtime_config(settings(), "s3://b/x/")["data"]["dem"] == "s3://b/x/input/DEM_placeholder.tif"


def test_errors_of_sources_have_an_exit_code(spark, tmp_path, capsys):
    assert main(["fuse", str(tmp_path / "none.gpkg"), str(tmp_path / "none.tif"), str(tmp_path / "o.gpkg"), "--epsg", "32648", "--pdt", "x"]) == 2
    assert "error:" in capsys.readouterr().err


def test_status_of_townships(spark):
    rows = [(i, "A" if i < 6 else "B" if i < 8 else "C", i // 3) for i in range(12)]
    own = spark.createDataFrame(rows, "bsm long, township string, block long")
    got = {r.township: (r.n_parcels, r.n_blocks, r.status) for r in prepare.township_status(own, own.where("township = 'A'"), 3).collect()}
    assert got == {"A": (6, 2, "ok"), "B": (2, 0, "too_small"), "C": (4, 0, "empty")}


def test_pairs_come_once_from_their_corners(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 6, (2, 120)), *rng.integers(0, 3, (2, 120)), strict=True))]
    df = spark.createDataFrame(rows, "bsm long, type_code int, x0 long, y0 long, x1 long, y1 long")
    corners = {r[0]: {(x, y) for x in (r[2], r[4]) for y in (r[3], r[5])} for r in rows}
    got = [(r.src, r.dst) for r in graph.queen_edges(df).collect()]
    assert sorted(got) == sorted((a, b) for a in corners for b in corners if a != b and corners[a] & corners[b])


def test_block_files(spark, tmp_path):
    rows = [(i, i // 3, 1 + i % 2, 2.0 * i, 10.0) for i in range(9)]
    own = spark.createDataFrame(rows, "bsm long, block long, type_code int, slope_mean double, area_m2 double")
    prepare.block_outputs(own, str(tmp_path))
    mapping = spark.read.csv(f"{tmp_path}/parcel_block_mapping", header=True, inferSchema=True)
    assert {(r.original_index, r.block_id) for r in mapping.collect()} == {(i, i // 3) for i in range(9)}
    members = {r.block_id: r.parcels for r in spark.read.json(f"{tmp_path}/block_compositions").collect()}
    assert members == {b: [3 * b, 3 * b + 1, 3 * b + 2] for b in range(3)}
    assert {r.block_id: r.n for r in spark.read.json(f"{tmp_path}/block_features").collect()} == {0: 3, 1: 3, 2: 3}


def test_slopes_in_tiles_equal_whole_arrays(spark):
    from parcelspark.operators import overlay

    rng = np.random.default_rng(3)
    z = rng.uniform(1, 50, (21, 17))
    z[rng.random(z.shape) < 0.05] = -1
    df = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(z)], "row long, col long, z double").repartition(3)
    masked = np.where(z > 0, z, np.nan)
    gy, gx = np.gradient(masked, 30.0, 28.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    got = np.full(z.shape, np.nan)
    for r in overlay.gradient_slope(df, 28.0, 30.0, tile=8).collect():
        got[r.row, r.col] = np.nan if r.slope is None else r.slope
    assert np.allclose(got, want, equal_nan=True)


def test_reference_units_of_one_county(spark):
    from test_fusion import box

    from parcelspark.operators import polygons

    parcels = spark.createDataFrame([(1, "511011001001", "v", box(0, 0, 4, 4)), (2, "511011002001", "w", box(4, 0, 6, 4)), (3, "500120001001", "x", box(50, 50, 51, 51))], "bsm long, qsdwdm string, qsdwmc string, geometry binary")
    layer = spark.createDataFrame([(1, "511011.0", " A ", box(0, 0, 5, 4)), (2, "511011", "B", box(20, 20, 21, 21)), (3, "500120", "C", box(50, 50, 52, 52))], "unit_id long, county_code string, XZQMC string, geometry binary")
    got = {r.unit_id: (r.XZQMC, r.XZQDM, r.code_source) for r in polygons.build_admin_units(parcels, layer).collect()}
    assert got == {1: ("A", "511011001", "DLTB_DOMINANT_OVERLAP"), 2: ("B", "", "UNAVAILABLE")}
    assert [r.XZQDM for r in polygons.build_admin_units(parcels, layer, "500120").collect()] == ["500120001"]
    with pytest.raises(ValueError, match="no units of county"):
        polygons.build_admin_units(parcels, layer, "999999")
    with pytest.raises(ValueError, match="without a name"):
        polygons.build_admin_units(parcels, layer.selectExpr("unit_id", "county_code", "' ' AS XZQMC", "geometry"))
    assert polygons.build_admin_units(parcels).count() == 3
