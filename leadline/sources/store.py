"""A grid on disk: points by batch and block, cells by version and block, and a manifest that names what holds.

``points/batch=…/block=…`` and ``cells/version=…/block=…/resolution=…``; a
block is a square of tiles.  Nothing is written over: an update writes the
blocks it touches as a new version, and the manifest, written last under the
next number, makes them count.  A job that fails leaves the grid as it was.
All batches are one scan, and so are all cells.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import filesystem, remove

ROOTS = {"single_resolution": "single_resolution_grid", "variable_resolution_tile": "variable_resolution_grid"}
#: Tiles a side of a block, the unit that is read and rewritten.
BLOCK_TILES = 16
#: Beyond so many blocks a scan is not restricted to them by name: they are most of what there is.
_MOST_NAMED = 5_000


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    fs, at = filesystem(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Read a small file."""
    fs, at = filesystem(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path."""
    fs, at = filesystem(spark, path)
    return bool(fs.exists(at))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, at = filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def has_content(spark: SparkSession, path: str) -> bool:
    """Whether there is anything in a folder."""
    return bool(names_in(spark, path))


def find_root(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The grid type and the folder of the one grid in ``folder``."""
    found = [(kind, f"{folder}/{name}") for kind, name in ROOTS.items() if _numbers(names_in(spark, f"{folder}/{name}"))]
    if len(found) != 1:
        raise ValueError(f"expected one grid in {folder}, found {len(found)}")
    return found[0]


def _numbers(names: list[str]) -> list[int]:
    """Numbers of the manifests among file names."""
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def scan(spark: SparkSession, schema: T.StructType | str, paths: list[str], base: str) -> DataFrame:
    """One scan of many folders.

    They are listed in a few tasks for each core: by default Spark starts a
    task for every folder, which takes far longer than the listing.
    """
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(*paths)
    finally:
        spark.conf.set(_LISTING, before)


def block_of(x: Column, y: Column, side: float) -> Column:
    """The name of the block a place lies in; null coordinates have a block of their own."""
    place = lambda c: F.floor(c / F.lit(float(side))).cast("bigint").cast("string")
    return F.coalesce(F.concat(place(x), F.lit("_"), place(y)), F.lit("none"))


class Store:
    """The folder of one grid."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._number = 0

    # The manifest.

    def save_manifest(self, manifest: dict) -> None:
        """Write the next manifest beside the others, then give it its number; the one before is kept, older ones go.

        Someone else's manifest of that number is not replaced: that is an error.
        """
        to = self._number + 1
        new, at = f"{self.root}/writing-{uuid.uuid4().hex}", f"{self.root}/manifest-{to:010d}.json"
        write_text(self.spark, new, json.dumps(manifest, default=str))
        fs, source = filesystem(self.spark, new)
        _, target = filesystem(self.spark, at)
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, False)
            raise OSError(f"can't write {at}: was the grid changed by someone else?")
        self._number = to
        for n in _numbers(names_in(self.spark, self.root)):
            if n < to - 1:
                remove(self.spark, f"{self.root}/manifest-{n:010d}.json")

    def load_manifest(self) -> dict:
        self._number = _numbers(names_in(self.spark, self.root))[-1]
        return json.loads(read_text(self.spark, f"{self.root}/manifest-{self._number:010d}.json"))

    # Points.

    def write_points(self, points: DataFrame, batch: str | None) -> None:
        """Write points that have ``block``; without ``batch`` they bring a column of that name.

        Small blocks of a batch end in one file, large ones are dealt out to
        several tasks; rows of a tile stay together, so that a reader skips
        row groups by the tiles' corners.
        """
        by = ["block"] if batch else ["batch", "block"]
        spread = points.hint("rebalance", *by).sortWithinPartitions(*by, "tile_y", "tile_x")
        spread.write.partitionBy(*by).parquet(f"{self.root}/points" + (f"/batch={batch}" if batch else ""))

    def keep_folders(self, batches: list[str]) -> None:
        """See to it that batches without points have a folder, too."""
        for b in batches:
            fs, at = filesystem(self.spark, f"{self.root}/points/batch={b}")
            fs.mkdirs(at)

    def points(self, batches: list[str], schema: T.StructType) -> DataFrame:
        """All points of these batches with ``tile_x``, ``tile_y``, ``batch`` and ``block``: one scan."""
        whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("block", T.StringType())])
        if not batches:
            return self.spark.createDataFrame([], whole)
        return scan(self.spark, whole, [f"{self.root}/points/batch={b}" for b in batches], f"{self.root}/points")

    # Tiles of a batch.

    def write_tiles(self, tiles: DataFrame, batch: str) -> DataFrame:
        tiles.write.parquet(f"{self.root}/tiles/batch={batch}")
        return self.tiles([batch])

    def tiles(self, batches: list[str]) -> DataFrame:
        """What is known of each tile of these batches."""
        fields = "tile_x double, tile_y double, n bigint, n_z bigint, sum_z double, nonzero boolean, min_x double, min_y double, max_x double, max_y double"
        if not batches:
            return self.spark.createDataFrame([], fields)
        return scan(self.spark, fields, [f"{self.root}/tiles/batch={b}" for b in batches], f"{self.root}/tiles")

    # Cells.

    def write_cells(self, cells: DataFrame, version: str) -> None:
        """Add cells that have ``block`` to a version."""
        by = ["block", "resolution"]
        cells.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(f"{self.root}/cells/version={version}")

    def blocks_of(self, version: str) -> dict[str, list[float]]:
        """The blocks of a version and the resolutions in each, from the names of folders."""
        fs, at = filesystem(self.spark, f"{self.root}/cells/version={version}/block=*/resolution=*")
        out: dict[str, list[float]] = {}
        for s in fs.globStatus(at) or []:
            path = s.getPath()
            out.setdefault(path.getParent().getName()[6:], []).append(float(path.getName()[11:]))
        return {b: sorted(r) for b, r in out.items()}

    def cells(self, versions: dict[str, dict], schema: T.StructType, blocks: set[str] | None = None) -> DataFrame:
        """The cells of these blocks of these versions, with ``block``; of ``blocks`` only, if given."""
        paths = [f"{self.root}/cells/version={v}/block={b}" for v, have in versions.items() for b in have if blocks is None or b in blocks]
        whole = T.StructType([*schema.fields, T.StructField("block", T.StringType())])
        if not paths:
            return self.spark.createDataFrame([], whole)
        return scan(self.spark, whole, paths, f"{self.root}/cells").select(*whole.fieldNames())

    def names(self, kind: str) -> list[str]:
        return names_in(self.spark, f"{self.root}/{kind}")

    def drop(self, names: list[str]) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def named_blocks(tiles: DataFrame, side: float) -> tuple[set[str] | None, list[float] | None]:
    """The blocks of some tiles by name, or ``None`` if they are too many to name, and the box of the tiles' corners."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("tile_x", "tile_y")]
    found = tiles.groupBy(block_of(F.col("tile_x"), F.col("tile_y"), side).alias("block")).agg(*ends).limit(_MOST_NAMED + 1).collect()
    if len(found) > _MOST_NAMED:
        return None, None
    box = [min(r.min_tile_x for r in found), min(r.min_tile_y for r in found), max(r.max_tile_x for r in found), max(r.max_tile_y for r in found)] if found else None
    return {r.block for r in found}, box
