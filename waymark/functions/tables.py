"""Table functions for SQL: a query's rows, partitioned, in; rows out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from waymark.operators.search import Graph, one_way
from waymark.sources.raster import VOID, decode
from waymark.sources.tables import importable


@udtf
class ShortestPath:
    """shortest_path(TABLE(...) PARTITION BY region): arcs and requests of a region in, ways out.

    The table has src, dst and cost, and further columns, such as the one that it is
    partitioned by. Rows of null cost are requests. Each gives src, dst, cost (null: no
    way within the region) and path. A partition's arcs are held by one task, so a region
    is what fits there.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("shortest_path takes a table: TABLE(...) PARTITION BY a region")
        missing = {"src", "dst", "cost"} - set(rows.dataType.fieldNames())
        if missing:
            raise ValueError(f"shortest_path needs the columns {', '.join(sorted(missing))}")
        return AnalyzeResult(StructType().add("src", LongType()).add("dst", LongType()).add("cost", DoubleType()).add("path", ArrayType(LongType())))

    def __init__(self) -> None:
        self.arcs: list[tuple[int, int, float]] = []
        self.asked: list[tuple[int, int]] = []

    def eval(self, rows: Row) -> None:
        if rows["cost"] is None:
            self.asked.append((rows["src"], rows["dst"]))
        else:
            self.arcs.append((rows["src"], rows["dst"], rows["cost"]))

    def terminate(self) -> Iterator[tuple]:
        columns = list(zip(*self.arcs)) or [(), (), ()]
        graph = Graph(*(np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, float))))
        for src, dst in self.asked:
            cost, path = one_way(graph, src, dst, False)
            yield src, dst, cost, path


@udtf
class ElevationPatch:
    """elevation_patch(TABLE(...), size): samples around places, from the tiles that hold them.

    The table has tile_lat, tile_lng, part, content, request_id, row and col: a row with
    content is a tile (square, big-endian 16-bit), one without is a request for the samples
    up to `size` from (row, col). The function partitions and sorts its input itself, so
    tiles come first and requests stream past them; `part` deals a tile of many requests
    to several tasks, each of which needs the tile's row. A request gives request_id,
    row, col (of the first sample), width, and ele, row by row (null: void). Samples
    beyond the tile's edge are left out; a request outside the tile, or without one,
    has width 0 and no samples.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("elevation_patch takes a table and a size")
        missing = {"tile_lat", "tile_lng", "part", "content", "request_id", "row", "col"} - set(rows.dataType.fieldNames())
        if missing:
            raise ValueError(f"elevation_patch needs the columns {', '.join(sorted(missing))}")
        if not isinstance(size.value, int) or size.value < 0:
            raise ValueError("elevation_patch takes a whole number, 0 or more, as size")
        out = StructType().add("request_id", LongType()).add("row", IntegerType()).add("col", IntegerType()).add("width", IntegerType()).add("ele", ArrayType(IntegerType()))
        return AnalyzeResult(
            out,
            partitionBy=[PartitioningColumn(c) for c in ("tile_lat", "tile_lng", "part")],
            orderBy=[OrderingColumn("content", ascending=True, overrideNullsFirst=False)],
        )

    def __init__(self) -> None:
        self.grid: np.ndarray | None = None

    def eval(self, rows: Row, size: int) -> Iterator[tuple]:
        if rows["content"] is not None:
            content = bytes(rows["content"])
            self.grid = decode(content, math.isqrt(len(content) // 2))
            return
        row, col = rows["row"], rows["col"]
        dim = 0 if self.grid is None else len(self.grid)
        if row is None or col is None or not (0 <= row < dim and 0 <= col < dim):
            yield rows["request_id"], row, col, 0, []
            return
        top, left = max(0, row - size), max(0, col - size)
        patch = self.grid[top : row + size + 1, left : col + size + 1]
        yield rows["request_id"], top, left, patch.shape[1], [None if v == VOID else v for v in patch.ravel().tolist()]


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    importable(spark)
    spark.udtf.register("shortest_path", ShortestPath)
    spark.udtf.register("elevation_patch", ElevationPatch)
