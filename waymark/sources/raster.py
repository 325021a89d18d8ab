"""Elevation tiles: reader of square 16-bit grids, interpolation, and sample windows.

A tile covers one degree and has `dim` x `dim` big-endian signed samples, north row
first; its edges are shared with the neighbours. -32768 is void and reads as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import tile_name
from waymark.sources.tables import importable
from waymark.sources.versions import checkpointed

DIM = 3601
VOID = -32768
#: Points of one tile that one task looks up.
POINTS = 2_000_000
NAME = re.compile(r"([NS])(\d{2})([EW])(\d{3})\.hgt$")
SAMPLE = "tile_lat int, tile_lng int, row int, col int, ele int"


def corner(path: str) -> tuple[int, int] | None:
    """South-west corner that a file name gives."""
    m = NAME.search(path)
    return None if m is None else ((1 if m[1] == "N" else -1) * int(m[2]), (1 if m[3] == "E" else -1) * int(m[4]))


def decode(content: bytes, dim: int = DIM) -> np.ndarray:
    grid = np.frombuffer(content, ">i2")
    if grid.size != dim * dim:
        raise ValueError(f"a tile of {dim} x {dim} samples has {grid.size}")
    return grid.reshape(dim, dim).astype(np.int32)


def samples(spark: SparkSession, path: str, dim: int = DIM) -> DataFrame:
    """All samples of the tiles below `path`, one task per file, a row per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at = corner(name)
                if at is None:
                    continue
                grid = decode(content, dim)
                for row in range(dim):
                    ele = grid[row]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(dim, at[0], np.int32)),
                            pa.array(np.full(dim, at[1], np.int32)),
                            pa.array(np.full(dim, row, np.int32)),
                            pa.array(np.arange(dim, dtype=np.int32)),
                            pa.array(ele, mask=ele == VOID),
                        ],
                        names=["tile_lat", "tile_lng", "row", "col", "ele"],
                    )

    importable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content")
    return files.mapInArrow(run, SAMPLE)


def plane(tiles: DataFrame, dim: int) -> DataFrame:
    """Samples 3 row + 5 col of the tiles (tile_lat, tile_lng): interpolation of it is exact."""
    n = F.sequence(F.lit(0), F.lit(dim - 1))
    rows = tiles.select("tile_lat", "tile_lng", F.explode(n).alias("row"))
    return rows.select("*", F.explode(n).alias("col")).withColumn("ele", (3 * F.col("row") + 5 * F.col("col")).cast("int"))


def place(lat: Column, lng: Column, dim: int) -> dict[str, Column]:
    """Tile, the cell's upper-left sample (row, col), and offsets in the cell: x east, y south."""
    steps = dim - 1
    down, across = (1 - (lat - F.floor(lat))) * steps, (lng - F.floor(lng)) * steps
    row, col = F.least(F.floor(down), F.lit(steps - 1)), F.least(F.floor(across), F.lit(steps - 1))
    return {
        "tile_lat": F.floor(lat).cast("int"),
        "tile_lng": F.floor(lng).cast("int"),
        "row": row.cast("int"),
        "col": col.cast("int"),
        "oy": down - row,
        "ox": across - col,
    }


def bilinear(ul: Column, ur: Column, ll: Column, lr: Column, x: Column, y: Column) -> Column:
    return ul * (1 - x) * (1 - y) + ur * x * (1 - y) + ll * (1 - x) * y + lr * x * y


def elevations(points: DataFrame, grid: DataFrame, dim: int = DIM, missing: float | None = None) -> DataFrame:
    """`points` (lat, lng, more) with `ele`: the cells that they lie in are put together once, then joined to them.

    Cells are written first, so that the join knows their size and does not move points to
    few cells; there are no more of them than samples. A point without a tile, or next to a
    void, gets `missing`.
    """
    cell = ["tile_lat", "tile_lng", "row", "col"]
    where = {k: v for k, v in place(F.col("lat"), F.col("lng"), dim).items()}
    asked = points.select(*(where[c].alias(c) for c in cell)).distinct()
    four = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (0, 1) for c in (0, 1)))).alias("d")
    asked = asked.select("tile_lat", "tile_lng", F.col("row").alias("__row"), F.col("col").alias("__col"), four)
    asked = asked.withColumns({"row": F.col("__row") + F.col("d.dr"), "col": F.col("__col") + F.col("d.dc")})
    got = asked.join(grid, cell).groupBy("tile_lat", "tile_lng", "__row", "__col").agg(
        *(F.max(F.when((F.col("d.dr") == r) & (F.col("d.dc") == c), F.col("ele"))).alias(f"__e{r}{c}") for r in (0, 1) for c in (0, 1)),
    )
    cells = checkpointed(got.toDF(*(f"__{c}" for c in cell), *(f"__e{r}{c}" for r in (0, 1) for c in (0, 1))))
    at = points.withColumns({f"__{c}": v for c, v in where.items()})
    value = bilinear(F.col("__e00"), F.col("__e01"), F.col("__e10"), F.col("__e11"), F.col("__ox"), F.col("__oy"))
    out = at.join(cells, [f"__{c}" for c in cell], "left").select(*points.columns, value.alias("ele"))
    return out if missing is None else out.withColumn("ele", F.coalesce("ele", F.lit(missing)))


def written(grid: DataFrame, path: str, dim: int = DIM) -> DataFrame:
    """Writes samples (of whole tiles) as tile files below `path`, one task a tile; gives tile, bytes.

    A sample that is missing or null is written as void.
    """

    def run(key, rows):
        lat, lng = (x.as_py() for x in key)
        ele = np.full((dim, dim), VOID, ">i2")
        row, col, value = (rows.column(c).to_numpy() for c in ("row", "col", "ele"))
        held = ~np.isnan(value.astype(float))
        ele[row[held], col[held]] = value[held]
        name = f"{'N' if lat >= 0 else 'S'}{abs(lat):02d}{'E' if lng >= 0 else 'W'}{abs(lng):03d}.hgt"
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{name}.part") as f:
            f.write(ele.tobytes())
        store.move(f"{at}/{name}.part", f"{at}/{name}")  # whole or not there, also when the task runs twice
        return pa.table({"tile": [name[:-4]], "bytes": [ele.nbytes]})

    importable(grid.sparkSession)
    return grid.groupBy("tile_lat", "tile_lng").applyInArrow(run, "tile string, bytes long")


def tile_files(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """tile_lat, tile_lng, content of the files below `path` that `wanted` names; no other file is opened."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = {f.getPath().getName(): f.getPath().toString() for f in store.listStatus(at)} if store.exists(at) else {}
    chosen = [have[f"{w}.hgt"] for w in wanted if f"{w}.hgt" in have]
    name = F.regexp_extract("path", "([NS]\\d{2}[EW]\\d{3})\\.hgt$", 1)
    sign = lambda i, letter, n: F.when(F.substring(name, i, 1) == letter, -1).otherwise(1) * F.substring(name, i + 1, n).cast("int")
    if not chosen:
        return spark.createDataFrame([], "tile_lat int, tile_lng int, content binary")
    files = spark.read.format("binaryFile").load(chosen)
    return files.select(sign(1, "S", 2).cast("int").alias("tile_lat"), sign(4, "W", 3).cast("int").alias("tile_lng"), "content")


def elevations_in_files(points: DataFrame, path: str, dim: int = DIM, missing: float | None = None) -> DataFrame:
    """`points` (point_id, lat, lng) with `ele`, looked up in the tile files below `path`.

    The names of the tiles that the points need (64,800 at most) choose the files. A tile
    and its points meet in one task, as one array and by index; a tile of more than
    `POINTS` points is sent to several tasks. A point without a tile, or next to a void,
    gets `missing`.
    """
    spark = points.sparkSession
    importable(spark)
    own = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    at = own.select("point_id", *(v.alias(k) for k, v in place(F.col("lat"), F.col("lng"), dim).items()))
    counts = {(r.tile_lat, r.tile_lng): r.n for r in at.groupBy("tile_lat", "tile_lng").agg(F.count("*").alias("n")).collect()}
    names = [r.tile for r in own.select(tile_name(F.col("lat"), F.col("lng")).alias("tile")).distinct().collect() if r.tile]
    shares = spark.createDataFrame([(*k, -(-n // POINTS)) for k, n in counts.items() if n > POINTS], "tile_lat int, tile_lng int, parts int")
    key = ["tile_lat", "tile_lng"]

    def dealt(df: DataFrame, salt: Column) -> DataFrame:
        return df.join(F.broadcast(shares), key, "left").withColumn("salt", salt).drop("parts")

    parts = F.coalesce("parts", F.lit(1))
    asked = dealt(at, F.pmod(F.xxhash64("point_id"), parts).cast("int"))
    tiles = dealt(tile_files(spark, path, names), F.explode(F.sequence(F.lit(0), parts - 1)))
    kind = points.schema["point_id"].dataType.simpleString()

    def run(tile: pa.Table, asked: pa.Table) -> pa.Table:
        ids, value = asked.column("point_id"), np.full(asked.num_rows, np.nan)
        if tile.num_rows and asked.num_rows:
            grid = decode(tile.column("content")[0].as_py(), dim).astype(float)
            grid[grid == VOID] = np.nan
            r, c, x, y = (asked.column(n).to_numpy() for n in ("row", "col", "ox", "oy"))
            value = grid[r, c] * (1 - x) * (1 - y) + grid[r, c + 1] * x * (1 - y) + grid[r + 1, c] * (1 - x) * y + grid[r + 1, c + 1] * x * y
        return pa.table({"point_id": ids, "ele": pa.array(value, mask=np.isnan(value))})

    got = tiles.groupBy(*key, "salt").cogroup(asked.groupBy(*key, "salt")).applyInArrow(run, f"point_id {kind}, ele double")
    out = points.join(got, "point_id", "left")
    return out if missing is None else out.withColumn("ele", F.coalesce("ele", F.lit(missing)))


def filled(vertices: DataFrame, path: str, dim: int = DIM, unknown: float = -1.0) -> DataFrame:
    """`vertices` (lat, lng, ele, more) where elevations that are null or `unknown` come from the tile files below `path`.

    Each place is looked up once, however many vertices it has; vertices with an elevation
    are not moved. Where no tile tells either, the elevation is null.
    """
    lacking = F.col("ele").isNull() | (F.col("ele") == unknown)
    without = vertices.where(lacking).drop("ele")
    asked = checkpointed(without.select("lat", "lng").distinct().select(F.struct("lat", "lng").alias("point_id"), "lat", "lng"))
    got = elevations_in_files(asked, path, dim).where("ele is not null").select("lat", "lng", "ele")
    known = vertices.where(~lacking).withColumn("ele", F.col("ele").cast("double"))
    return known.unionByName(without.join(got, ["lat", "lng"], "left")).select(*vertices.columns)


def continuous(grid: DataFrame, dim: int) -> DataFrame:
    """Samples by row and column of one grid over the globe; shared edges count once."""
    steps = dim - 1
    gy, gx = (F.col("tile_lat") + 181) * steps - F.col("row"), (F.col("tile_lng") + 180) * steps + F.col("col")
    return grid.select(gy.alias("gy"), gx.alias("gx"), "ele").groupBy("gy", "gx").agg(F.max("ele").alias("ele"))


def with_centers(grid: DataFrame) -> DataFrame:
    """gy, gx, ele of `continuous` samples with `center`: the mean of the sample and its three neighbours to the north-east, null where one is missing."""
    # each sample serves the four cells around it
    spread = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    cells = grid.withColumn("d", F.explode(spread)).select((F.col("gy") - F.col("d.a")).alias("gy"), (F.col("gx") - F.col("d.b")).alias("gx"), "ele")
    means = cells.groupBy("gy", "gx").agg(F.count("ele").alias("n"), F.avg("ele").alias("m")).where("n = 4")
    return grid.join(means.select("gy", "gx", F.col("m").alias("center")), ["gy", "gx"], "left")


def window(grid: DataFrame, requests: DataFrame, size: int, dim: int = DIM) -> DataFrame:
    """request_id, i (south to north), j, ele and center of (size + 1)^2 samples.

    `requests` have the south-west sample (gy0, gx0) on the global grid, so windows cross
    tile borders; samples that do not exist are left out. `center` is the mean of the
    four samples of the cell to the north-east, null where one is missing or outside the
    window. Centers are made once, on the grid of the tiles asked for (64,800 at most), so
    requests are joined to it and never among themselves. That grid is written once, so
    that the join knows its size.
    """
    steps = dim - 1
    reached = lambda c: F.sequence(F.ceil(F.col(c) / steps) - 181, F.floor((F.col(c) + size) / steps) - 180).cast("array<int>")
    tiles = requests.select("gx0", F.explode(reached("gy0")).alias("tile_lat")).select("tile_lat", F.explode(reached("gx0")).alias("tile_lng")).distinct()
    centered = checkpointed(with_centers(continuous(grid.join(F.broadcast(tiles), ["tile_lat", "tile_lng"], "left_semi"), dim)))
    n = F.sequence(F.lit(0), F.lit(size))
    asked = requests.select("request_id", "gy0", "gx0", F.explode(n).alias("i")).select("*", F.explode(n).alias("j"))
    asked = asked.select("request_id", "i", "j", (F.col("gy0") + F.col("i")).alias("gy"), (F.col("gx0") + F.col("j")).alias("gx"))
    got = asked.join(centered, ["gy", "gx"])
    inside = (F.col("i") < size) & (F.col("j") < size)
    return got.select("request_id", "i", "j", "ele", F.when(inside, F.col("center")).alias("center"))


def around(lat: Column, lng: Column, size: int, dim: int = DIM) -> dict[str, Column]:
    """South-west sample of a window of `size` cells centred at a point, its northern half rounded down."""
    steps = dim - 1
    return {"gy0": (F.floor((lat + 180) * steps) - (size - size // 2)).cast("int"), "gx0": (F.floor((lng + 180) * steps) - size // 2).cast("int")}


def tile_window(x: Column, y: Column, dimension: int) -> dict[str, Column]:
    """South-west sample of tile (x, y) of `dimension` samples a side, the last shared with the next tile.

    Both axes count from -180.
    """
    return {"gy0": (y * (dimension - 1)).cast("int"), "gx0": (x * (dimension - 1)).cast("int")}


def window_corners(size: int, dim: int = DIM) -> dict[str, Column]:
    """South-west and north-east corners of windows of `size` cells with their first sample at (gy0, gx0)."""
    at = lambda c, more: (F.col(c) + more) / (dim - 1) - 180
    return {"sw": F.struct(at("gy0", 0).alias("lat"), at("gx0", 0).alias("lng")), "ne": F.struct(at("gy0", size).alias("lat"), at("gx0", size).alias("lng"))}


def cell_position(row: Column, col: Column, tile_lat: Column, tile_lng: Column, dim: int) -> tuple[Column, Column]:
    """Latitude and longitude of a sample."""
    steps = dim - 1
    return tile_lat + 1 - row / steps, tile_lng + col / steps


def required_tiles(points: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """tile, points: names of tiles that positions (lat, lng) need, without those in `have` (tile)."""
    needed = points.groupBy(tile_name(F.col("lat"), F.col("lng")).alias("tile")).agg(F.count("*").alias("points")).where("tile is not null")
    return needed if have is None else needed.join(have, "tile", "left_anti")
