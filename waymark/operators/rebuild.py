"""Rebuilding the graph of an area: ids kept, edges compared, a version written when complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import graph, lines
from waymark.operators.overlay import TILE
from waymark.sources.versions import Versions, checkpointed, dropped
from waymark.streaming.requests import UPDATED, UPDATING, Cancelled

#: What identifies a half-edge and what a rebuild may change in it.
EDGE = ["line_id", "idx"]
EDGE_VALUES = ["edge_id", "node_id", "fraction", "forward_edge_id", "reverse_edge_id", "forward_cost", "reverse_cost", "forward_node_id", "forward_fraction", "back_cost"]


def with_node_ids(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """`proposed` nodes (gx, gy, node_id) with the least id that `existing` has at their place; their own without one."""
    own = existing.groupBy("gx", "gy").agg(F.min("node_id").alias("__own"))
    return proposed.join(own, ["gx", "gy"], "left").withColumn("node_id", F.coalesce("__own", "node_id")).drop("__own")


def area_lines(vertices: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """line_id of lines whose extent meets the box, and of those that share a point with them.

    Points are joined, not lines: a shared point has one row here however many lines meet there.
    """
    extent = vertices.groupBy("line_id").agg(F.min("lat").alias("s"), F.min("lng").alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))
    inside = extent.where((F.col("s") <= north) & (F.col("n") >= south) & (F.col("w") <= east) & (F.col("e") >= west)).select("line_id")
    points = vertices.join(inside, "line_id", "left_semi").select("gx", "gy").distinct()
    return vertices.join(points, ["gx", "gy"], "left_semi").select("line_id").distinct()


def area_edges(vertices: DataFrame, own: DataFrame) -> DataFrame:
    """Half-edges of the lines `own` (line_id); all lines count where a point is shared."""
    mine = vertices.join(own, "line_id", "left_semi")
    points = mine.select("gx", "gy").distinct()
    nodes = graph.intersections(vertices.join(points, ["gx", "gy"], "left_semi"))
    return graph.half_edges(lines.measured(mine), nodes)


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """line_id, idx, old, new and op of each half-edge that either side has."""
    return graph.diff(old, new, EDGE, EDGE_VALUES)


def rebuilt(edges: DataFrame, vertices: DataFrame, own: DataFrame) -> DataFrame:
    """All half-edges after those of the lines `own` were made anew."""
    others = edges.join(own, "line_id", "left_anti").select(*EDGE, *EDGE_VALUES)
    changes = edge_changes(edges.join(own, "line_id", "left_semi"), area_edges(vertices, own))
    return others.unionByName(graph.apply_diff(changes, EDGE, EDGE_VALUES))


class EdgeStore:
    """Half-edges in a folder by tile: an edit replaces the tiles that it touches, and no other file.

    A half-edge lies in the tile of its vertex. Readers of an untouched tile are not
    disturbed; a reader of several tiles may see some of them before and some after an edit.
    """

    SCHEMA = (
        "line_id long, idx long, edge_id long, node_id long, fraction double, forward_edge_id long, reverse_edge_id long, forward_cost double, "
        "reverse_cost double, forward_node_id long, forward_fraction double, back_cost double, tile string"
    )

    def __init__(self, spark: SparkSession, path: str, tile: float = TILE) -> None:
        self.spark, self.path, self.tile = spark, path.rstrip("/"), tile

    def placed(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        """`edges` with the tile of each one's vertex."""
        name = F.concat_ws("_", F.floor(F.col("lng") / self.tile), F.floor(F.col("lat") / self.tile)).alias("tile")
        return edges.join(vertices.select(*EDGE, name), EDGE)

    def write(self, edges: DataFrame) -> None:
        """All tiles anew. `edges` have `tile`."""
        self._rows(edges).write.mode("overwrite").partitionBy("tile").parquet(self.path)

    def _rows(self, edges: DataFrame) -> DataFrame:
        return edges.select(*EDGE, *EDGE_VALUES, "tile").repartition("tile")

    def read(self) -> DataFrame | None:
        """All half-edges with their tile; null where nothing was written yet."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self.exists() else None

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def replace(self, lines_: DataFrame, fresh: DataFrame) -> list[str]:
        """Takes out the half-edges of `lines_` (line_id), puts in `fresh` (with tile); gives the tiles touched.

        Their names come to the driver: as many as the edit's area has tiles.
        """
        old = self.read()
        touched = fresh.select("tile")
        if old is not None:
            touched = touched.unionByName(old.join(lines_, "line_id", "left_semi").select("tile"))
        names = sorted(r.tile for r in touched.distinct().collect())
        rows = fresh.select(*EDGE, *EDGE_VALUES, "tile")
        if old is not None:
            kept = old.where(F.col("tile").isin(names)).join(lines_, "line_id", "left_anti")
            rows = kept.select(*rows.columns).unionByName(rows)
        rows = checkpointed(rows)
        self._rows(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(self.path)
        left = {r.tile for r in rows.select("tile").distinct().collect()}
        for name in set(names) - left:  # nothing was written where nothing is left
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tile={name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        dropped(rows)
        return names


def build_area(
    vertices: DataFrame,
    target: Versions | EdgeStore,
    box: tuple[float, float, float, float],
    report: Callable[[str, dict], None] = lambda name, values: None,
    cancelled: Callable[[], bool] = lambda: False,
) -> int | list[str]:
    """Rebuilds the half-edges of a box (south, west, north, east).

    In a store by tiles it replaces those that it touches and gives their names; of a
    versioned table it writes a new version and gives its number. Between its steps it
    reports progress and asks whether the request was cancelled (`Cancelled` is raised then).
    """
    steps = 3

    def step(done: int) -> None:
        if cancelled():
            raise Cancelled(f"area {box}")
        report(UPDATING, {"done": done, "of": steps})

    step(0)
    own = checkpointed(area_lines(vertices, *box))
    step(1)
    if isinstance(target, EdgeStore):
        edges = checkpointed(target.placed(area_edges(vertices, own), vertices))
    else:
        edges = checkpointed(rebuilt(target.read(), vertices, own) if target.versions() else area_edges(vertices, own).select(*EDGE, *EDGE_VALUES))
    step(2)
    done = target.replace(own, edges) if isinstance(target, EdgeStore) else target.write(edges)
    report(UPDATED, {"done": steps, "of": steps})
    dropped(own, edges)
    return done
