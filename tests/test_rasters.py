"""Coordinate systems against published values, resampling against whole-array kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import crs as C
from parcelspark.functions import geometry as G
from parcelspark.operators import resample as R

UTM48 = 'PROJCS["WGS 84 / UTM zone 48N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",105],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]{code}]'
NEWER = 'PROJCRS["own",BASEGEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]]],CONVERSION["UTM zone 48N",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0],PARAMETER["Longitude of natural origin",105],PARAMETER["Scale factor at natural origin",0.9996],PARAMETER["False easting",500000],PARAMETER["False northing",0]],CS[Cartesian,2],AXIS["(E)",east,ORDER[1]],AXIS["(N)",north,ORDER[2]],LENGTHUNIT["metre",1]]'


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_lengths_on_the_ellipsoid(spark):
    """A degree of latitude and of longitude at the equator, and the published line of 54 972.271 m."""
    line = degrees(144, 25, 29.52440), degrees(-37, 57, 3.72030), degrees(143, 55, 35.38390), degrees(-37, 39, 10.15610)
    assert C.metres(0, 0, 1, 0) == pytest.approx(111319.4908, abs=1e-3) and C.metres(0, 0, 0, 1) == pytest.approx(110574.389, abs=1e-3)
    assert C.metres(*line) == pytest.approx(54972.271, abs=1e-3) and C.metres(1, 2, 1, 2) == 0
    rows = [line, (0.0, 0.0, 1.0, 0.0), (3.0, 3.0, 3.0, 3.0), (10.0, 60.0, -70.0, -20.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(C.geodesic(*map(F.col, "abcd"))).collect()]
    assert got == pytest.approx([C.metres(*r) for r in rows], abs=1e-6)


def test_systems_from_text_and_codes():
    utm = C.parse("EPSG:32648")
    assert C.parse(UTM48.format(code="")).same(utm) and C.parse(NEWER).same(utm) and C.parse(NEWER).epsg is None
    assert C.parse(UTM48.format(code=',AUTHORITY["EPSG","32648"]')).epsg == 32648
    assert not C.parse(UTM48.format(code="").replace("105", "111")).same(utm) and C.parse(4326).geographic
    assert C.from_epsg(4523).east == 35_500_000 and C.from_epsg(4544).lon0 == 105 and C.from_epsg(4502).lon0 == 75 and C.from_epsg(4491).lon0 == 75
    for bad in ("EPSG:x", "EPSG:999999", 'LOCAL_CS["a"]', 'PROJCS["a",GEOGCS["b",DATUM["c",SPHEROID["d",1,2]]],PROJECTION["Mercator_1SP"]]', 'GEOGCS["a"'):
        with pytest.raises(C.CrsError):
            C.parse(bad)
    assert C.parse_epsg(" epsg:4326 ") == 4326


def test_choice_of_a_metric_system():
    chengdu = (103.0, 30.0, 105.0, 31.0)
    assert C.choose_metric(None, 4326, chengdu).epsg == 32648 and C.choose_metric(None, 4326, (-71.0, -34.0, -70.0, -33.0)).epsg == 32719
    assert C.choose_metric(None, "EPSG:4523", chengdu).epsg == 4523 and C.choose_metric("EPSG:32649", 4326, chengdu).epsg == 32649
    feet = UTM48.format(code="").replace('UNIT["metre",1]', 'UNIT["foot",0.3048]')
    for explicit, source in (("EPSG:4326", 4326), (None, feet)):
        with pytest.raises(C.CrsError):
            C.choose_metric(explicit, source, chengdu)


def test_projections_both_ways():
    lon, lat = np.meshgrid(np.linspace(103, 108, 9), np.linspace(-5, 62, 12))
    for c in (C.from_epsg(32648), C.from_epsg(32748), C.from_epsg(4523), C.Crs(False, C.GRS80, 105.0, 30.0, 0.9999, 1000.0, -500.0, 0.3048)):
        back = C.unproject(c, *C.project(c, lon, lat))
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    assert np.allclose(C.project(C.from_epsg(32648), lon, lat), G.to_utm(lon, lat, 32648), atol=1e-3)
    # on the central meridian the northing is the scaled length of the meridian
    assert C.project(C.from_epsg(32648), np.array([105.0]), np.array([1.0]))[1][0] == pytest.approx(0.9996 * C.metres(105, 0, 105, 1), abs=1e-4)


def test_cells_in_metres():
    dx, dy, how = C.cell_metres((0.0002, 0, 105.0, 0, -0.0002, 30.0), C.parse(4326), 1000)
    assert how == "horn_geographic_centre_latitude" and dx == pytest.approx(C.metres(104.9999, 29.9, 105.0001, 29.9), abs=1e-6) and dy == pytest.approx(22.171, abs=1e-2)
    assert C.cell_metres((30.0, 0, 0, 0, -30.0, 0), C.parse(32648), 10) == (30.0, 30.0, "horn_projected")
    with pytest.raises(C.CrsError):
        C.cell_metres((30.0, 1.0, 0, 0, -30.0, 0), C.parse(32648), 10)


def pixels(spark, z):
    return spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row long, col long, z double").repartition(3)


@pytest.mark.parametrize("method", R.METHODS)
def test_tiles_give_what_the_whole_array_gives(spark, method):
    rng = np.random.default_rng(6)
    z = rng.uniform(0, 100, (37, 29))
    z[rng.random(z.shape) < 0.1] = np.nan
    source, target = R.Grid(100.0, 2.0, 500.0, -2.0, 37, 29), R.Grid(97.3, 1.3, 503.1, -1.7, 50, 52)
    got = {(r.row, r.col): r.z for r in R.resample(pixels(spark, z), source, target, method, tile=8).collect()}
    wide = np.pad(z, 2, constant_values=np.nan)
    n = 0
    for r in range(50):
        for c in range(52):
            u, v = (97.3 + (c + 0.5) * 1.3 - 100) / 2, (503.1 - (r + 0.5) * 1.7 - 500) / -2
            if not (0 <= u < 29 and 0 <= v < 37):
                assert (r, c) not in got
                continue
            want = R.kernel(wide, np.array([u + 2]), np.array([v + 2]), method)[0]
            n += 1
            assert got.get((r, c)) is None if math.isnan(want) else got[r, c] == pytest.approx(want)
    assert n > 1000
    with pytest.raises(ValueError):
        R.resample(pixels(spark, z), source, target, "lanczos")


def test_kernels_reproduce_what_they_can():
    """A plane by both kernels, a parabola by the cubic one, and shared weights next to missing cells."""
    r, c = np.mgrid[0:9, 0:9].astype(float)
    u, v = np.array([3.2, 4.9, 5.5]), np.array([4.4, 3.3, 5.5])
    for method in ("bilinear", "cubic"):
        assert R.kernel(2 * (r + 0.5) - 3 * (c + 0.5) + 1, u, v, method) == pytest.approx(2 * v - 3 * u + 1)
    assert R.kernel((r + 0.5) ** 2, u, v, "cubic") == pytest.approx(v**2)
    holed = np.ones((9, 9))
    holed[4, 4] = np.nan
    assert R.kernel(holed, np.array([4.6]), np.array([4.6]), "bilinear") == pytest.approx(1) and math.isnan(R.kernel(holed, np.array([4.5]), np.array([4.5]), "bilinear")[0])


def test_reprojection_to_metres_and_zonal_means_in_degrees(spark):
    """A plane over longitude and latitude keeps its values after reprojection; parcels in metres meet a raster in degrees."""
    wgs, utm = C.parse(4326), C.parse(32648)
    n = 40
    grid = R.Grid(105.0, 0.001, 30.0, -0.001, n, n)
    lon, lat = 105.0 + (np.arange(n) + 0.5) * 0.001, 30.0 - (np.arange(n) + 0.5) * 0.001
    z = 1000 * (lon[None, :] - 105) + 500 * (30 - lat[:, None])
    df = pixels(spark, z)
    moved, target = R.reproject(df, grid, wgs, utm)
    assert R.reproject(df, grid, wgs, C.parse(4326))[1] == grid and 90 < target.dx < 115 and target.dy == -target.dx
    inner = [r for r in moved.collect() if r.z is not None and 2 < r.row < target.rows - 3 and 2 < r.col < target.cols - 3]
    x, y = (np.array(v) for v in zip(*((target.x0 + (r.col + 0.5) * target.dx, target.y0 + (r.row + 0.5) * target.dy) for r in inner), strict=True))
    a, b = C.unproject(utm, x, y)
    assert len(inner) > 800 and np.abs(np.array([r.z for r in inner]) - (1000 * (a - 105) + 500 * (30 - b))).max() < 1e-6
    corners = C.project(utm, np.array([105.0100, 105.0200, 105.0200, 105.0100, 105.0100]), np.array([29.9700, 29.9700, 29.9800, 29.9800, 29.9700]))
    shapes = spark.createDataFrame([(1, bytearray(G.to_wkb([[np.stack(corners, 1)]]))), (2, None)], "bsm long, geometry binary")
    (r,) = R.zonal_in_raster_crs(shapes, "bsm", utm, df, grid, wgs).collect()
    assert (r.bsm, r.n) == (1, 100) and r["mean"] == pytest.approx(z[20:30, 10:20].mean()) and r["max"] == pytest.approx(z[20:30, 10:20].max())
