"""Raster export against a stand-in for the missing library, and the metadata by itself."""

import json
import sys
import types
from xml.etree import ElementTree

import numpy as np
import pytest

from leadline.grid import create_grid
from leadline.sources import export as X


class Band:
    def __init__(self):
        self.name = self.nodata = self.data = None

    def SetDescription(self, name):
        self.name = name

    def SetNoDataValue(self, v):
        self.nodata = v

    def WriteArray(self, a):
        self.data = a


class Raster:
    def __init__(self, cols, rows, n):
        self.shape, self.bands, self.geo, self.crs = (rows, cols), [Band() for _ in range(n)], None, None

    def SetGeoTransform(self, g):
        self.geo = g

    def SetProjection(self, p):
        self.crs = p

    def GetRasterBand(self, i):
        return self.bands[i - 1]


@pytest.fixture
def written(monkeypatch):
    files = {}

    class Driver:
        def __init__(self, name):
            self.name = name

        def Create(self, path, cols, rows, n, kind):
            return Raster(cols, rows, n)

        def CreateCopy(self, path, raster, strict, options):
            files[path] = (self.name, raster, options)

    class Reference:
        def ImportFromEPSG(self, n):
            self.text = f"epsg {n}"
            return 0

        def ImportFromProj4(self, t):
            return 1

        def ImportFromWkt(self, t):
            return 1

        def ExportToWkt(self):
            return self.text

    gdal = types.SimpleNamespace(GetDriverByName=Driver, GDT_Float32=6, VersionInfo=lambda _: "3.9")
    osr = types.SimpleNamespace(SpatialReference=Reference)
    monkeypatch.setitem(sys.modules, "osgeo", types.SimpleNamespace(gdal=gdal, osr=osr))
    return files


def small(spark):
    g = create_grid(spark)
    g.add_points({"x": np.array([10.0, 1500.0, 100.0]), "y": np.array([10.0, 20.0, 1000.0]), "z": np.array([5.0, 7.0, 9.0]), "tvu": np.ones(3), "thu": np.ones(3)}, "a", crs=26917, min_time=1.0, max_time=5.0)
    g.grid(resolution=256.0)
    return g


def recorder():
    """A writer for the executors that keeps what it is given beside the path."""

    def write(path, bands, geotransform, crs=None, driver="GTiff", options=()):
        import json

        import numpy

        numpy.savez(path + ".npz", **bands)
        with open(path + ".json", "w") as f:
            json.dump({"bands": list(bands), "geo": geotransform, "crs": crs, "driver": driver, "options": list(options)}, f)
        return path

    return write


def recorded(path):
    with open(path + ".json") as f:
        return json.load(f), dict(np.load(path + ".npz"))


def test_geotiff(spark, tmp_path):
    g = small(spark)
    (path,) = g.export(str(tmp_path / "out.tif"), "GeoTIFF", writer=recorder())
    told, bands = recorded(path)
    elevation = bands["Elevation"]
    assert path.endswith("out_256.0_1.tif") and told["driver"] == "GTiff" and told["geo"] == [0.0, 256.0, 0, 1024.0, 0, -256.0] and told["crs"] == 26917 and elevation.shape == (4, 8)
    assert told["bands"] == ["Elevation", "Vertical Uncertainty"] and (bands["Vertical Uncertainty"][~np.isnan(elevation)] == 1.0).all()
    assert elevation[3, 0] == -5.0 and elevation[3, 5] == -7.0 and elevation[0, 0] == -9.0 and np.isnan(elevation).sum() == 29
    two = g.export(str(tmp_path / "b.tif"), "geotiff", z_positive_up=False, override_maximum_chunk_dimension=1024, writer=recorder())
    assert len(two) == 2 and [recorded(p)[0]["bands"][0] for p in two] == ["Depth", "Depth"] and [recorded(p)[1]["Depth"].shape for p in two] == [(4, 4), (4, 4)]


def test_raster_bands_and_nodata(written, tmp_path):
    path = X.write_raster(str(tmp_path / "a.tif"), {"Depth": np.array([[1.0, np.nan]]), "Total Uncertainty": np.array([[0.5, np.nan]])}, [0, 1, 0, 1, 0, -1], 26917)
    driver, raster, _ = written[path]
    assert driver == "GTiff" and raster.crs == "epsg 26917" and [b.name for b in raster.bands] == ["Depth", "Total Uncertainty"]
    assert all(b.nodata == X.NODATA and b.data[0, 1] == X.NODATA for b in raster.bands)


def test_bag(spark, written, tmp_path):
    (path,) = small(spark).export(str(tmp_path / "out.bag"), "bag", writer=recorder(), individual_name="me", organizational_name="us", attr_date="2020-01-01", attr_datetime="2020-01-01T00:00:00", vert_crs='VERT_CS["MLLW","Depth",DOWN]')
    told, bands = recorded(path)
    options = told["options"]
    assert told["driver"] == "BAG" and list(bands) == ["Elevation", "Uncertainty"] and len(options) == 12
    assert {"VAR_INDIVIDUAL_NAME=me", "VAR_ORGANISATION_NAME=us", "VAR_DATE=2020-01-01", "VAR_DATETIME=2020-01-01T00:00:00", 'VAR_VERT_WKT=VERT_CS["MLLW","Gravity-related height",UP]'} <= set(options)
    with pytest.raises(ValueError):
        X.bag_options(nonsense="x")
    with pytest.raises(ValueError):
        X.spatial_reference("nowhere")
    assert X.gdal_version() == "3.9"


class Dataset:
    def __init__(self, data, most=None):
        self.data, self.maxshape = data, (most,)

    def __getitem__(self, _):
        return self.data

    def __setitem__(self, _, v):
        assert len(v) == len(self.data)
        self.data = v

    def resize(self, shape):
        self.data = np.resize(self.data, shape)


def test_finished_bag(written, monkeypatch, tmp_path):
    xml = '<gmi:MI_Metadata xmlns:gmi="http://www.isotc211.org/2005/gmi"/>'
    group = lambda: types.SimpleNamespace(attrs={})
    root = {"metadata": Dataset(np.frombuffer(xml.encode() + b"\0", "S1")), "elevation": group(), "uncertainty": group()}

    class File(dict):
        def __init__(self, *_):
            super().__init__(BAG_root=root)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    bands = {"Elevation": np.array([[-5.0, np.nan, -9.0]]), "Uncertainty": np.array([[1.0, np.nan, 2.0]])}
    X.finish_bag(str(tmp_path / "out.bag"), bands, "2018-06-29T07:20:48", "2018-07-06T21:54:43", 26917)
    assert root["elevation"].attrs == {"Maximum Elevation Value": -5.0, "Minimum Elevation Value": -9.0} and root["uncertainty"].attrs["Maximum Uncertainty Value"] == 2.0
    told = b"".join(root["metadata"].data.tolist()).decode()
    assert "2018-06-29T07:20:48" in told and told.startswith("<gmi:MI_Metadata") and "<wkt>epsg 26917</wkt>" in (tmp_path / "out.bag_rxl").read_text()
    root["metadata"] = Dataset(np.frombuffer(xml.encode(), "S1"), len(xml))
    with pytest.raises(ValueError):
        X.finish_bag(str(tmp_path / "out.bag"), bands, "2018-06-29T07:20:48", "2018-07-06T21:54:43")
    root["metadata"] = Dataset(np.frombuffer(CRS.encode(), "S1"))
    assert X.bag_vertical_wkt("any.bag") == 'VERT_CS["MLLW", 1]'


def test_without_the_library(spark, tmp_path):
    if "osgeo" in sys.modules:
        pytest.skip("it is there")
    with pytest.raises(RuntimeError):
        small(spark).export(str(tmp_path / "out.tif"), "geotiff")


def _system(wkt):
    return "<gmd:referenceSystemInfo><gmd:MD_ReferenceSystem><gmd:referenceSystemIdentifier><gmd:RS_Identifier><gmd:code><gco:CharacterString>" + wkt + "</gco:CharacterString></gmd:code></gmd:RS_Identifier></gmd:referenceSystemIdentifier></gmd:MD_ReferenceSystem></gmd:referenceSystemInfo>"


def _document(*systems):
    spaces = 'xmlns:gmi="http://www.isotc211.org/2005/gmi" xmlns:gmd="http://www.isotc211.org/2005/gmd" xmlns:gco="http://www.isotc211.org/2005/gco"'
    return f"<gmi:MI_Metadata {spaces}>" + "".join(map(_system, systems)) + "</gmi:MI_Metadata>"


CRS = _document('PROJCS["UTM", 1]', 'VERT_CS["MLLW", 1]')


def test_metadata():
    once = X.with_time_period(CRS, "2018-06-29T07:20:48", "2018-07-06T21:54:43")
    twice = X.with_time_period(once, "2019-01-01T00:00:00", "2019-01-02T00:00:00")
    periods = [e for e in ElementTree.fromstring(twice).iter() if e.tag.endswith("TimePeriod")]
    assert len(periods) == 1 and [e.text for e in periods[0]] == ["2019-01-01T00:00:00", "2019-01-02T00:00:00"]
    assert X.vertical_wkt(CRS) == X.vertical_wkt(twice) == 'VERT_CS["MLLW", 1]'
    for bad in ("<a>none</a>", _document('VERT_CS["MLLW", 1]'), _document('PROJCS["a", 1]', 'PROJCS["b", 1]')):
        with pytest.raises(ValueError):
            X.vertical_wkt(bad)


def test_charts(spark, monkeypatch):
    g = small(spark)
    with pytest.raises(RuntimeError):
        g.plot_z_histogram()
    drawn = []
    plt = types.ModuleType("matplotlib.pyplot")
    for name in ("bar", "plot", "xlabel", "ylabel", "title", "figure", "pcolormesh"):
        setattr(plt, name, lambda *a, name=name, **_: drawn.append(name))
    top = types.ModuleType("matplotlib")
    top.pyplot = plt
    monkeypatch.setitem(sys.modules, "matplotlib", top)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", plt)
    assert g.plot_z_histogram(4)["n"].sum() == 3 and g.plot_density_histogram(2)["n"].sum() == 3 and g.plot_density_per_square_meter_histogram(2)["n"].sum() == 3
    assert g.plot_vertical_uncertainty_histogram(2)["n"].sum() == 3 == g.plot_horizontal_uncertainty_histogram(2)["n"].sum() and g.plot_total_uncertainty_histogram() is None
    assert len(g.plot_density_vs_depth(5)) == len(g.plot_density_per_square_meter_vs_depth(5)) == 3
    g.plot("depth")
    assert drawn.count("bar") == 5 and drawn.count("plot") == 2 and drawn.count("pcolormesh") == 1
