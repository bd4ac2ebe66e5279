"""Raster tiles as a Spark data source: one partition for each block of a tile, read once for all of its points.

A tile is a raw array on disk (name.u8: rows of unsigned bytes from the north-west corner) with a note
beside it (name.json: rows, cols, origin_lon, origin_lat, px, py). Spark deals points out by tile and block
of BLOCK x BLOCK pixels, into a folder for each (dealt()); the source lists those folders, so no point passes
the driver. A block's partition reads the rows that its points' windows need, in one range, and
cuts each window from them. A window that would not fit with the others (more than MOST_PIXELS together) is
read on its own; both ways give the same bytes.

    spark.dataSource.register(TileSource)
    spark.read.format("cindertrace_tiles").option("folder", ...).option("points", dealt(points, folder, path)).load()

Rows: id, status (OK, NO_TILE, RADIUS, LATITUDE, WINDOW_TOO_LARGE), chip, rows, cols, origin_lon, origin_lat,
px, py, clipped (the window passes the tile's edge; what lies beyond is no data), reads (1 in the row of
the first point that a range was read for, else 0). Every point has one row; repeated ids have theirs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cindertrace.functions.geo import A, E2, tile_id
from cindertrace.operators.landcover import MOST_LAT, MOST_RADIUS_M, NODATA

#: Pixels along a block's side, and pixels that one range of rows may hold.
BLOCK, MOST_PIXELS, MOST_WINDOW = 2048, 1 << 26, 1 << 22
NO_TILE = "none"
SCHEMA = "id long, status string, chip binary, rows int, cols int, origin_lon double, origin_lat double, px double, py double, clipped boolean, reads int"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def dealt(points: DataFrame, folder: str, path: str) -> str:
    """Writes points(id, lon, lat, radius_m) by tile and block of the tiles in a folder; returns the path.

    Points that no tile has, or that cannot be asked for, lie in blocks of their own.
    """
    spark = points.sparkSession
    note = "rows int, cols int, origin_lon double, origin_lat double, px double, py double"
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    notes = spark.read.schema(note).json(f"{folder.rstrip('/')}/*.json").select(name.alias("tile"), "origin_lon", "origin_lat", "px", "py")
    known = F.coalesce(F.col("radius_m").between(0, MOST_RADIUS_M) & (F.col("radius_m") > 0) & (F.abs("lat") < MOST_LAT) & F.col("lon").isNotNull(), F.lit(False))
    rows = points.select("id", "lon", "lat", "radius_m", F.when(known, tile_id(F.col("lon"), F.col("lat"))).alias("tile")).join(notes, "tile", "left")
    down, along = F.floor((F.col("origin_lat") - F.col("lat")) / F.col("py") / BLOCK), F.floor((F.col("lon") - F.col("origin_lon")) / F.col("px") / BLOCK)
    block = F.when(F.col("px").isNotNull(), F.concat_ws("-", down, along))
    out = rows.select("id", "lon", "lat", "radius_m", F.when(block.isNotNull(), F.col("tile")).otherwise(NO_TILE).alias("tile"), F.coalesce(block, F.pmod(F.xxhash64("id"), F.lit(64)).cast("string")).alias("block"))
    out.repartition("tile", "block").write.partitionBy("tile", "block").parquet(path)
    return path


@dataclass
class Tile:
    """What the note beside a tile says."""

    rows: int
    cols: int
    origin_lon: float
    origin_lat: float
    px: float
    py: float

    def window(self, lon: float, lat: float, radius_m: float) -> tuple[int, int, int, int]:
        """First row, end row, first column, end column of the pixels around a circle a twentieth wider."""
        phi = math.radians(lat)
        w = math.sqrt(1 - E2 * math.sin(phi) ** 2)
        dy = 1.05 * radius_m / (math.pi / 180 * A * (1 - E2) / w**3)
        dx = 1.05 * radius_m / (math.pi / 180 * A * math.cos(phi) / w)
        top, bottom = math.floor((self.origin_lat - lat - dy) / self.py), math.ceil((self.origin_lat - lat + dy) / self.py)
        left, right = math.floor((lon - dx - self.origin_lon) / self.px), math.ceil((lon + dx - self.origin_lon) / self.px)
        return top, bottom, left, right


@dataclass
class Block(InputPartition):
    """A tile's name, and the folder of the points whose centres lie in one block of it."""

    tile: str | None
    points: str


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cindertrace_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TileReader(self.options)


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.points = options["folder"].rstrip("/"), options["points"]
        self.most = int(options.get("mostpixels", MOST_PIXELS))

    def partitions(self) -> list[Block]:
        """One for each folder of points."""
        store, path = place(self.points)
        found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.Directory and f.base_name.startswith("block=")]
        names = [f.path.rsplit("/", 2)[-2].removeprefix("tile=") for f in found]
        scheme = self.points.split(":", 1)[0] + "://" if "://" in self.points else ""
        return [Block(None if n == NO_TILE else n, scheme + f.path) for n, f in zip(names, found, strict=True)]

    def note(self, name: str) -> Tile | None:
        store, path = place(f"{self.folder}/{name}.json")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return Tile(**json.loads(f.read()))

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("status", pa.string()), ("chip", pa.binary()), ("rows", pa.int32()), ("cols", pa.int32()), ("origin_lon", pa.float64()), ("origin_lat", pa.float64()), ("px", pa.float64()), ("py", pa.float64()), ("clipped", pa.bool_()), ("reads", pa.int32())])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        store, path = place(partition.points)
        own = dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=["id", "lon", "lat", "radius_m"])
        points = list(zip(*(own.column(c).to_pylist() for c in own.column_names), strict=True))
        none = (None,) * 8
        if partition.tile is None:
            for id_, lon, lat, radius in points:
                bad = "RADIUS" if radius is None or not 0 < radius <= MOST_RADIUS_M else "LATITUDE" if lat is None or lon is None or abs(lat) >= MOST_LAT else "NO_TILE"
                yield out([(id_, bad, *none, 0)])
            return
        tile = self.note(partition.tile)
        windows = [(p[0], tile.window(*p[1:])) for p in points]
        fit = [(i, w) for i, w in windows if (w[1] - w[0]) * (w[3] - w[2]) <= MOST_WINDOW]
        for i, w in windows:
            if (i, w) not in fit:
                yield out([(i, "WINDOW_TOO_LARGE", *none, 0)])
        if not fit:
            return
        top, bottom = max(0, min(w[0] for _, w in fit)), min(tile.rows, max(w[1] for _, w in fit))
        together = (bottom - top) * tile.cols <= self.most
        store, path = place(f"{self.folder}/{partition.tile}.u8")
        with store.open_input_file(path) as f:

            def lines(a: int, z: int) -> np.ndarray:
                if z <= a:
                    return np.zeros((0, tile.cols), np.uint8)
                return np.frombuffer(f.read_at((z - a) * tile.cols, a * tile.cols), np.uint8).reshape(z - a, tile.cols)

            shared = lines(top, bottom) if together else None
            for k, (id_, (r0, r1, c0, c1)) in enumerate(fit):
                a, z = max(r0, 0), min(r1, tile.rows)
                held = shared[a - top : z - top] if together else lines(a, z)
                chip = np.full((r1 - r0, c1 - c0), NODATA, np.uint8)
                left, right = max(c0, 0), min(c1, tile.cols)
                if z > a and right > left:
                    chip[a - r0 : z - r0, left - c0 : right - c0] = held[:, left:right]
                clipped = r0 < 0 or c0 < 0 or r1 > tile.rows or c1 > tile.cols
                yield out([(id_, "OK", chip.tobytes(), *chip.shape, tile.origin_lon + c0 * tile.px, tile.origin_lat - r0 * tile.py, tile.px, tile.py, clipped, int(not together or k == 0))])


def write_tile(folder: str, name: str, pixels: np.ndarray, origin_lon: float, origin_lat: float, px: float, py: float) -> None:
    """Saves an array of unsigned bytes as a tile."""
    store, path = place(folder.rstrip("/"))
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}.u8") as f:
        f.write(np.ascontiguousarray(pixels, np.uint8).tobytes())
    with store.open_output_stream(f"{path}/{name}.json") as f:
        f.write(json.dumps({"rows": pixels.shape[0], "cols": pixels.shape[1], "origin_lon": origin_lon, "origin_lat": origin_lat, "px": px, "py": py}).encode())
