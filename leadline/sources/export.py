"""Files for other programs: CSV, and rasters where a writer is installed."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, remove

NODATA = 1_000_000.0


def free_name(path: str, taken: bool) -> str:
    """``path``, with the time in its name if that is taken."""
    if not taken:
        return path
    base, ext = os.path.splitext(path)
    return f"{base}_{datetime.now(UTC):%Y%m%d_%H%M%S}{ext}"


def write_csv(rows: DataFrame, base: str, resolutions: list[float], single_file: bool = True) -> list[str]:
    """``base_{resolution}.csv`` for each resolution, its rows in order of x and y, divided by blanks, under a header.

    The rows are sorted in ranges by the executors.  One file is their parts
    one after the other, streamed together; ``single_file=False`` leaves a
    folder of parts that follow each other by name, each with the header.
    """
    spark, out = rows.sparkSession, []
    for res in resolutions:
        path = f"{base}_{res}.csv"
        one = rows.where(F.col("resolution") == F.lit(float(res))).drop("resolution")
        order = [F.col("x").cast("double"), F.col("y").cast("double")]
        parts = path if not single_file else f"{path}-parts-{uuid.uuid4().hex}"
        one.orderBy(*order).write.option("sep", " ").option("header", not single_file).option("quote", "").csv(parts)
        if single_file:
            _join(spark, parts, path, " ".join(one.columns))
            remove(spark, parts)
        out.append(path)
    return out


def _join(spark: SparkSession, folder: str, path: str, header: str) -> None:
    """The parts of a folder, in order of their names, as one file."""
    fs, at = filesystem(spark, path)
    _, parts = filesystem(spark, folder)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    target = fs.create(at, False)
    try:
        target.write(bytearray(f"{header}\n".encode()))
        for p in sorted((s.getPath() for s in fs.listStatus(parts)), key=lambda p: p.getName()):
            if p.getName().startswith("part-"):
                source = fs.open(p)
                try:
                    copy(source, target, 1 << 20, False)
                finally:
                    source.close()
    finally:
        target.close()


#: Names of raster bands, and where a BAG differs.
BANDS = {"depth": "Depth", "intensity": "Intensity", "density": "Density", "vertical_uncertainty": "Vertical Uncertainty", "total_uncertainty": "Total Uncertainty", "horizontal_uncertainty": "Horizontal Uncertainty"}
BAG_BANDS = BANDS | {"vertical_uncertainty": "Uncertainty", "total_uncertainty": "Uncertainty"}

#: What a BAG's metadata says where nothing is given.
BAG_DEFAULTS = {
    "individual_name": "unknown", "organisation_name": "unknown", "position_name": "unknown", "date": None, "vert_wkt": 'VERT_CS["unknown", VERT_DATUM["unknown", 2000]]',
    "abstract": "", "process_step_description": "Generated by GDAL", "datetime": None, "restriction_code": "otherRestrictions", "other_constraints": "unknown", "classification": "unclassified", "security_user_note": "none",
}

#: Namespaces of a BAG's metadata, and the path to its time period.
_NS = {"gmi": "http://www.isotc211.org/2005/gmi", "gmd": "http://www.isotc211.org/2005/gmd", "gml": "http://www.opengis.net/gml/3.2", "xsi": "http://www.w3.org/2001/XMLSchema-instance", "gco": "http://www.isotc211.org/2005/gco", "xlink": "http://www.w3.org/1999/xlink", "bag": "http://www.opennavsurf.org/schema/bag"}
_TIME_PATH = ("gmd:identificationInfo", "bag:BAG_DataIdentification", "gmd:extent", "gmd:EX_Extent", "gmd:temporalElement", "gmd:EX_TemporalExtent", "gmd:extent", "gml:TimePeriod")


def _gdal():
    try:
        from osgeo import gdal, osr

        return gdal, osr
    except ImportError as e:
        raise RuntimeError("writing rasters needs GDAL's Python bindings") from e


def check_gdal() -> None:
    """Raise if rasters can't be written here."""
    _gdal()


def gdal_version() -> str:
    """The version of GDAL, or an empty text where it isn't installed."""
    try:
        return str(_gdal()[0].VersionInfo("RELEASE_NAME"))
    except RuntimeError:
        return ""


def spatial_reference(crs):
    """GDAL's spatial reference of an EPSG number, a WKT or a proj4 string."""
    _, osr = _gdal()
    out = osr.SpatialReference()
    text = str(crs).strip()
    failed = out.ImportFromEPSG(int(text)) if text.isdigit() else out.ImportFromProj4(text) if text.startswith("+") else out.ImportFromWkt(text)
    if failed:
        raise ValueError(f"no coordinate system in {crs!r}")
    return out


def write_raster(path: str, bands: dict[str, np.ndarray], geotransform: list[float], crs=None, driver: str = "GTiff", options: tuple[str, ...] = ()) -> str:
    """One raster of float bands, north up, with ``NODATA`` where empty; needs GDAL."""
    gdal, _ = _gdal()
    rows, cols = next(iter(bands.values())).shape
    memory = gdal.GetDriverByName("MEM").Create("", cols, rows, len(bands), gdal.GDT_Float32)
    memory.SetGeoTransform(geotransform)
    if crs:
        memory.SetProjection(spatial_reference(crs).ExportToWkt())
    for i, (name, data) in enumerate(bands.items(), 1):
        band = memory.GetRasterBand(i)
        band.SetDescription(name)
        band.SetNoDataValue(NODATA)
        band.WriteArray(np.where(np.isnan(data), NODATA, data).astype(np.float32))
    gdal.GetDriverByName(driver).CreateCopy(path, memory, 0, list(options))
    return path


def write_blocks(rows: DataFrame, resolution: float, bands: dict[str, str], paths: dict[int, str], crs, driver: str, options: tuple[str, ...], times: tuple | None, writer: Callable) -> None:
    """Write the raster of each block of tiles in the executors, a block a task.

    ``rows`` has the cells with ``chunk`` and its box ``x0, y0, x1, y1``;
    ``bands`` names the layers' bands and ``paths`` the block's files.  With
    ``times``, each is finished as a BAG.  A block's raster is what a task holds.
    """
    res = float(resolution)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        row = np.rint((pdf["tile_y"] - f["y0"]) / res).astype(np.int64) + pdf["row"]
        col = np.rint((pdf["tile_x"] - f["x0"]) / res).astype(np.int64) + pdf["col"]
        n_rows, n_cols = round((f["y1"] - f["y0"]) / res), round((f["x1"] - f["x0"]) / res)
        out = {}
        for layer, name in bands.items():
            a = np.full((n_rows, n_cols), np.nan, np.float32)
            a[n_rows - 1 - row.to_numpy(), col.to_numpy()] = pdf[layer].to_numpy(np.float32)
            out[name] = a
        path = paths[int(f["chunk"])]
        writer(path, out, [float(np.float32(f["x0"])), res, 0, float(np.float32(f["y1"])), 0, -res], crs, driver, options)
        if times is not None and writer is write_raster:
            finish_bag(path, out, *times, crs)
        return pd.DataFrame({"path": [path]})

    rows.groupBy("chunk").applyInPandas(one, "path string").foreach(lambda _: None)


#: The names some callers use for a BAG's metadata, beside its own.
_ALSO = {"organizational_name": "organisation_name", "attr_date": "date", "vert_crs": "vert_wkt", "attr_datetime": "datetime"}


def bag_options(**given: str) -> tuple[str, ...]:
    """Creation options of a BAG from its metadata; dates default to now, a depth datum is turned to heights."""
    given = {_ALSO.get(k, k): v for k, v in given.items() if v not in ("", None)}
    unknown = set(given) - set(BAG_DEFAULTS)
    if unknown:
        raise ValueError(f"a BAG has no {sorted(unknown)}")
    now = datetime.now(UTC)
    values = BAG_DEFAULTS | {"process_step_description": f"{BAG_DEFAULTS['process_step_description']} {gdal_version()}".strip()} | {"date": f"{now:%Y-%m-%d}", "datetime": f"{now:%Y-%m-%dT%H:%M:%S}"} | given
    values["vert_wkt"] = values["vert_wkt"].replace('"depth (D)",down', '"gravity-related height (H)",up').replace('"Depth",DOWN', '"Gravity-related height",UP')
    return tuple(f"VAR_{k.upper()}={v}" for k, v in values.items())


def with_time_period(metadata_xml: str, begin: str, end: str) -> str:
    """A BAG's metadata with its time period set, the elements on the way added where they lack."""
    for prefix, uri in _NS.items():
        ElementTree.register_namespace(prefix, uri)
    full = lambda tag: "{%s}%s" % (_NS[tag.split(":")[0]], tag.split(":")[1])  # noqa: E731, UP031
    at = root = ElementTree.fromstring(metadata_xml)

    def below(parent, tag):
        found = parent.find(full(tag))
        return ElementTree.SubElement(parent, full(tag)) if found is None else found

    for tag in _TIME_PATH:
        at = below(at, tag)
    if full("gml:id") not in at.attrib:
        at.attrib |= {full("gml:id"): "temporal-extent-1", full("xsi:type"): "gml:TimePeriodType"}
    below(at, "gml:beginPosition").text, below(at, "gml:endPosition").text = begin, end
    return ElementTree.tostring(root, encoding="unicode")


def registration_sidecar(wkt: str) -> str:
    """The registration file that some programs want beside a BAG."""
    top = ElementTree.Element("caris_registration", version="4.0", generation="USER")
    ElementTree.SubElement(ElementTree.SubElement(top, "coordinate_system"), "wkt").text = wkt
    ElementTree.indent(top)
    return ElementTree.tostring(top, encoding="unicode", xml_declaration=True)


def _metadata(stored) -> str:
    """The XML in a BAG's metadata, an array of single characters."""
    return b"".join(np.asarray(stored[()]).astype("S1").tolist()).decode()


def finish_bag(path: str, bands: dict[str, np.ndarray], begin: str | None, end: str | None, crs=None) -> None:
    """Put right what the BAG driver leaves: ranges without the empty value, the time period, the sidecar; needs h5py for the first two."""
    try:
        import h5py
    except ImportError:
        h5py = None
    if h5py is not None:
        with h5py.File(path, "r+") as f:
            root = f["BAG_root"]
            for band, group in (("Elevation", "elevation"), ("Uncertainty", "uncertainty")):
                if band in bands and not np.isnan(bands[band]).all():
                    root[group].attrs[f"Maximum {band} Value"], root[group].attrs[f"Minimum {band} Value"] = np.float32(np.nanmax(bands[band])), np.float32(np.nanmin(bands[band]))
            if begin and end:
                stored = root["metadata"]
                text = with_time_period(_metadata(stored), begin, end)
                cells = np.frombuffer(text.encode(), "S1")
                if stored.maxshape[0] is not None and len(cells) > stored.maxshape[0]:
                    raise ValueError("the metadata of this BAG can't grow")
                stored.resize((len(cells),))
                stored[...] = cells
    if crs:
        with open(f"{os.path.splitext(path)[0]}.bag_rxl", "w", encoding="utf-8") as f:
            f.write(registration_sidecar(spatial_reference(crs).ExportToWkt()))


#: Where a BAG's metadata names its reference systems.
_CRS_PATH = ("gmd:referenceSystemInfo", "gmd:MD_ReferenceSystem", "gmd:referenceSystemIdentifier", "gmd:RS_Identifier", "gmd:code", "gco:CharacterString")


def vertical_wkt(metadata_xml: str) -> str:
    """The vertical one of the two reference systems, horizontal and vertical, that a BAG's metadata must name."""
    found = ElementTree.fromstring(metadata_xml).findall("/".join(_CRS_PATH), _NS)
    if len(found) != 2:
        raise ValueError(f"expected a horizontal and a vertical reference system in the metadata, found {len(found)}")
    for node in found:
        text = (node.text or "").strip()
        if text.upper().startswith(("VERT_CS", "VERTCRS", "VERTICALCRS")):
            return text
    raise ValueError("no vertical reference system in the metadata")


def bag_vertical_wkt(path: str) -> str:
    """The same of a BAG file; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading a BAG needs h5py") from e
    with h5py.File(path, "r") as f:
        return vertical_wkt(_metadata(f["BAG_root"]["metadata"]))
