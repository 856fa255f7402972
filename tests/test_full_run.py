"""A run from files: configuration, preparation over polygons, sampling, training, planning, write-back, audit."""

import json
import math
import os
from pathlib import Path

import numpy as np
import pytest

from parcelspark import config, pipeline, prepare
from parcelspark.__main__ import main
from parcelspark.functions import geometry as G
from parcelspark.operators import polygons
from parcelspark.sources import files, writers

#: YAML files of a folder named by the environment, besides the ones made here.
PUBLISHED = sorted(Path(os.environ.get("PUBLISHED_CONFIGS", "none")).glob("*.yml"))


def settings(**changes):
    base = {
        "project": {"name": "test"},
        "crs": "EPSG:32648",
        "data": {"dltb": "none.gpkg", "dem": "none.tif", "prepared_dir": "prepared"},
        "fields": {"dlbm": "DLBM", "qsdwdm": "QSDWDM", "bsm": "BSM", "admin_name": "XZQMC"},
        "slope": {"source": "field", "field": "slope_mean"},
        "preparation": {"min_parcels": 3, "min_area_ha": 0.5, "max_parcels": 30, "min_parcels_per_township": 20},
        "outputs": {"plan_dir": "plan", "optimized_vector": "plan/optimized.shp"},
        "sampling": {"n_episodes": 2, "n_states": 3, "n_actions": 3, "seed": 0},
        "training": {"n_members": 2, "epochs": 2, "patience": 1, "lambda_rank": 5.0},
        "planning": {"horizon": 2, "top_k": 4, "n_episodes": 2, "constraints": {"cultivated_area_floor_delta_ha": 0}},
        "reward": {"slope_weight": 4100.0, "cont_weight": 600.0, "baimu_weight": 2300.0, "baimu_bonus": 9.0, "baimu_area_penalty": 3100.0},
        "workflow": {"force_resample_and_retrain_on_reward_change": True},
    }
    return base | changes


def square(x, y, w=100.0):
    return G.to_wkb([[np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]], float)]])


def land(spark, n=12):
    """A grid of n x n parcels; the last column is no farmland, one parcel is locked, one township is too small."""
    rng, rows = np.random.default_rng(4), []
    for i in range(n * n):
        r, c = divmod(i, n)
        code = "1104" if c == n - 1 else "0101" if rng.random() < 0.5 else "0301"
        town = "511011003" if r == n - 1 and c < 3 else "511011001" if r < n // 2 else "511011002"
        rows.append((1000 + i, code, town + "001", float(rng.random() * 30), "1" if i == 5 else "0", bytearray(square(100.0 * c, 100.0 * r))))
    return spark.createDataFrame(rows, "BSM long, DLBM string, QSDWDM string, slope_mean double, EXCH_LOCK string, geometry binary")


@pytest.mark.parametrize("path", PUBLISHED, ids=lambda p: p.stem)
def test_published_configurations_are_accepted(path):
    s = config.run_settings(config.load(str(path)))
    assert s.samples["episodes"] >= 1 and s.search["horizon"] >= 1 and s.sampling.slope > 0


def test_versions_and_input_profiles_are_accepted():
    v2 = {"planning": {"horizon": 5, "top_k": 50, "n_episodes": 1, "constraints": {"cultivated_area_floor_delta_ha": 0, "baimu_area_floor_delta_ha": 0}}}
    for version in ("2.1.0", "2.2.3"):
        assert config.problems(settings(algorithm={"name": "any-v2", "version": version}, **v2)) == []
    limited = {"mode": "dltb_dem_only", "evidence_tier": "exploratory_data_limited", "decision_use": "exploratory_technical_validation_only", "unavailable_authority_data": dict.fromkeys(["pdt", "eco_redline", "permanent_basic_farmland"], "not_provided_not_evaluated")}
    s = config.run_settings(settings(algorithm={"name": "any-v2", "version": "2.3.0"}, input_profile=limited, **v2))
    assert s.limited and s.planning.area_floor_delta_ha == 0 and s.planning.baimu_floor and not s.sampling.baimu_floor
    assert not config.run_settings(settings(algorithm={"name": "any-v2", "version": "2.3.0"}, input_profile={"mode": "authority_four_source"}, **v2)).limited


def test_broken_configurations_are_refused():
    assert config.problems(settings()) == []
    v2 = {"algorithm": {"name": "anything-v2", "version": "2.2.3"}}
    broken = [
        ({"slope": {"source": "dem", "field": "x"}}, "slope.source"),
        ({"workflow": {}}, "workflow.force"),
        ({"sampling": {"n_episodes": "two", "n_states": 1, "n_actions": 1, "seed": 0}}, "sampling.n_episodes"),
        ({"data": {"dltb": "", "dem": "x", "prepared_dir": "y"}}, "missing data.dltb"),
        ({"reward_profiles": {"a": {"requires_resample_train": False}}}, "reward_profiles.a"),
        ({"algorithm": {"name": "anything-v2", "version": "9"}}, "algorithm.version"),
        (v2 | {"planning": {"horizon": 1, "top_k": 1, "n_episodes": 1}}, "floor_delta_ha"),
        (v2 | {"planning": {"horizon": 1, "top_k": 1, "n_episodes": 1, "constraints": {"cultivated_area_floor_delta_ha": True}}}, "floor_delta_ha"),
        (v2 | {"planning": {"horizon": 1, "top_k": 1, "n_episodes": 1, "constraints": {"cultivated_area_floor_delta_ha": -1}}}, "floor_delta_ha"),
        (v2 | {"outputs": {"plan_dir": "p", "optimized_vector": "a.gpkg"}}, ".shp"),
        ({"algorithm": {"name": "anything-v2", "version": "2.3.0"}}, "input_profile.mode"),
        ({"algorithm": {"name": "anything-v2", "version": "2.3.0"}, "input_profile": {"mode": "dltb_dem_only"}}, "evidence_tier"),
    ]
    for change, word in broken:
        with pytest.raises(config.ConfigError, match=word.replace(".", r"\.")):
            config.validate(settings(**change))
    assert config.problems([]) and config.problems({})
    assert config.reward_change_requires_resampling(settings())
    other = settings(workflow={}, reward_profiles={"a": {"requires_resample_train": True}})
    assert config.reward_change_requires_resampling(other, "a") and not config.reward_change_requires_resampling(other, "b")
    assert config.rendered(settings(), {"sampling.seed": 7, "new.key": 1})["sampling"]["seed"] == 7
    profile = {"a": {"requires_resample_train": True, "reward": {"slope_weight": 1.0}}}
    assert config.run_settings(settings(reward_profiles=profile), "a").sampling.slope == 1.0


def test_full_run_from_files(spark, tmp_path):
    source = land(spark)
    writers.write_gpkg({"dltb": source}, str(tmp_path / "land.gpkg"), 32648)
    units = spark.createDataFrame([("West", bytearray(square(0.0, 0.0, 600.0))), ("East", bytearray(square(600.0, 0.0, 1200.0)))], "XZQMC string, geometry binary")
    writers.write_geojson(units, str(tmp_path / "units.geojson"), 32648)
    c = settings(data={"dltb": str(tmp_path / "land.gpkg"), "dem": "none.tif", "prepared_dir": "p", "admin_units": str(tmp_path / "units.geojson")})
    out = str(tmp_path / "run")
    run = pipeline.Run(spark, c, out)
    manifest = run.full()
    assert manifest["status"] == "ok" and [s["stage"] for s in manifest["stages"]] == config.STAGES
    assert pipeline.latest_manifest(spark, str(tmp_path))["status"] == "ok"
    parcels = spark.read.parquet(f"{out}/parcels")
    assert parcels.where("type_code = 0 OR township = '511011003'").count() == 0 and parcels.where("locked").count() <= 1
    assert {r.area_m2 for r in parcels.collect()} == {10_000.0} and parcels.where("township_name IN ('West', 'East')").count() == parcels.count()
    result = json.loads((tmp_path / "run/summary.json").read_text())["results"]
    assert len(result) == 2 and all(r["n_swaps"] > 0 and r["slope_change_pct"] < 0 and r["cultivated_area_change_ha"] >= 0 for r in result)
    for r in result:
        done = spark.read.parquet(f"{out}/optimized/episode={r['episode']}")
        assert done.count() == 144 and done.where("chg_flag > 0").count() == 2 * r["n_swaps"] and done.where("chg_flag > 0 AND locked").count() == 0
    shapes = files.read_shapefile(spark, f"{out}/plan").collect()
    assert len(shapes) == 144 and {r.attrs["CHG_FLAG"] for r in shapes} == {"0", "1", "2"}
    # one stage by itself, from what the others have written
    assert pipeline.Run(spark, c, out).stage("audit")["result"] == {"passed": manifest["stages"][-1]["result"]["passed"]}
    assert pipeline.Run(spark, c, str(tmp_path / "dry")).full(dry_run=True)["stages"][0]["status"] == "dry-run"


def test_a_failed_stage_is_in_the_manifest(spark, tmp_path):
    c = settings(data={"dltb": str(tmp_path / "none.txt"), "dem": "x", "prepared_dir": "p"})
    with pytest.raises(ValueError, match="no reader"):
        pipeline.Run(spark, c, str(tmp_path)).full()
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert manifest["status"] == "failed" and manifest["stages"][-1]["stage"] == "prepare"
    assert json.loads((tmp_path / "failure.json").read_text())["stage"] == "prepare"


def test_command_line(tmp_path, capsys):
    yaml = pytest.importorskip("yaml")
    good, bad = tmp_path / "good.yml", tmp_path / "bad.yml"
    good.write_text(yaml.safe_dump(settings()))
    bad.write_text(yaml.safe_dump(settings(slope={"source": "dem", "field": "x"})))
    assert main(["check-config", str(good)]) == 0 and main(["check-config", str(bad)]) == 2
    assert main(["print-plan", str(good)]) == 0 and [x.split(":")[0] for x in capsys.readouterr().out.splitlines()] == config.STAGES
    assert main(["render", str(good), '{"sampling.seed": 3}']) == 0 and json.loads(capsys.readouterr().out)["sampling"]["seed"] == 3


def test_slope_from_elevation_where_the_attribute_is_missing(spark, tmp_path):
    from test_files import tiff

    (tmp_path / "dem.tif").write_bytes(tiff(np.tile(100 + 0.1 * np.arange(50), (20, 1)), True))  # cells of 2 m from (100, 200) down
    rows = [(1, "0101", 1, None, bytearray(square(110, 170, 16.0))), (2, "0301", 2, 7.0, bytearray(square(130, 170, 16.0)))]
    own = spark.createDataFrame(rows, "bsm long, dlbm string, type_code int, slope_mean double, geometry binary")
    s = config.run_settings(settings(data={"dltb": "x", "dem": str(tmp_path / "dem.tif"), "prepared_dir": "p"}))
    got = {r.bsm: r.slope_mean for r in prepare.with_slope(spark, own, s).collect()}
    assert got[1] == pytest.approx(math.degrees(math.atan(0.05)), abs=1e-3) and got[2] == 7.0


def test_polygon_contiguity_compactness_and_labels(spark):
    own = land(spark, 4).withColumnRenamed("BSM", "bsm").select("bsm", "geometry")
    edges = {(r.src, r.dst) for r in polygons.contiguity(own).collect()}
    grid = {1000 + i: divmod(i, 4) for i in range(16)}
    assert edges == {(a, b) for a in grid for b in grid if a != b and max(abs(grid[a][0] - grid[b][0]), abs(grid[a][1] - grid[b][1])) == 1}
    blocks = own.selectExpr("bsm", "geometry", "IF(bsm < 1008, 1, 2) AS block")
    assert {r.block: round(r.compactness, 6) for r in polygons.block_compactness(blocks).collect()} == {k: round(4 * math.pi * 80_000 / 1200**2, 6) for k in (1, 2)}
    ring = G.to_wkb([[np.array([[0, 0], [400, 0], [400, 400], [0, 400], [0, 0]], float), np.array([[100, 100], [100, 200], [200, 200], [200, 100], [100, 100]], float)]])
    zones = spark.createDataFrame([(1, "ring", bytearray(ring)), (2, "all", bytearray(square(0, 0, 300.0)))], "zone_id long, name string, geometry binary")
    got = {r.bsm: r.name for r in polygons.labels(own, zones, "name", 150.0).collect()}
    assert got == {1000 + i: "all" if i == 5 else "ring" for i in range(16)}
    units = spark.createDataFrame([(1, "a", bytearray(square(-10, -10, 160.0))), (2, "b", bytearray(square(150, -10, 600.0)))], "unit_id long, name string, geometry binary")
    found = {r.unit_id: (r.n, r.area_m2) for r in polygons.admin_units(own, units, ["name"], 150.0).collect()}
    # half of the parcel at row 0, column 1 lies in each unit: the smaller number takes it; two parcels lie in none
    assert found == {1: (3, 30_000.0), 2: (11, 110_000.0)}


def test_vector_files_are_read_back(spark, tmp_path):
    own = land(spark, 3).selectExpr("BSM", "DLBM", "slope_mean", "concat('名', BSM) AS a_long_field_name", "geometry").unionByName(spark.createDataFrame([(9, None, None, None, None)], "BSM long, DLBM string, slope_mean double, a_long_field_name string, geometry binary"))
    writers.write_shapefile(own, str(tmp_path / "a/land.shp") if (tmp_path / "a").mkdir() is None else "")
    writers.write_geojson(own, str(tmp_path / "land.geojson"))
    writers.write_gpkg({"one": own}, str(tmp_path / "land.gpkg"), 32648)
    writers.write_gpkg({"two": own.limit(2)}, str(tmp_path / "land.gpkg"), 32648, append=True)
    want = {r.BSM: (bytes(r.geometry) if r.geometry else None, r.DLBM) for r in own.collect()}
    read = {"shp": files.read_shapefile(spark, str(tmp_path / "a")), "geojson": files.read_geojson(spark, str(tmp_path / "land.geojson")), "gpkg": files.read_gpkg(spark, str(tmp_path / "land.gpkg"), "one")}
    for kind, layer in read.items():
        got = {int(r.attrs["BSM"]): (G.to_wkb(G.repair(G.from_wkb(bytes(r.geometry)))) if r.geometry else None, r.attrs["DLBM"]) for r in layer.collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}, kind
        assert all((v[0] is None) == (want[k][0] is None) and (v[0] is None or G.area(G.from_wkb(v[0])) == 10_000) for k, v in got.items()), kind
    assert writers.field_names(["a_long_field_name", "a_long_field_other", "b"]) == ["A_LONG_FIE", "A_LONG_FI1", "B"]
    assert {r.layer for r in files.list_layers(spark, str(tmp_path)).collect()} == {"one", "two"}
