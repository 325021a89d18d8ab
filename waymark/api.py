"""The public calls of the trail service over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import latitude, longitude, mercator_x, mercator_y
from waymark.operators import catalog, graph, lines, rebuild, routes, search, snap
from waymark.operators.overlay import TILE
from waymark.sources import raster
from waymark.sources.network import ROWS, by_line
from waymark.sources.versions import checkpointed
from waymark.streaming.requests import queue_state


def area_of(lat: int, lng: int) -> int:
    """The number of a one-degree cell by its south-west corner."""
    return (lat + 90) * 360 + lng + 180


def area_box(area: int) -> tuple[float, float, float, float]:
    """South, west, north, east of a cell."""
    lat, lng = area // 360 - 90, area % 360 - 180
    return float(lat), float(lng), lat + 1.0, lng + 1.0


@dataclass
class Finder:
    """State as DataFrames: vertices and attributes of lines, samples of elevation, and
    the small tables of cells, groups, saved routes and requests. Calls return
    DataFrames; those that change a table replace the attribute."""

    spark: SparkSession
    vertices: DataFrame
    attributes: DataFrame
    samples: DataFrame | None = None
    dim: int = raster.DIM
    quads: DataFrame | None = None
    groups: DataFrame | None = None
    members: DataFrame | None = None
    route_points: DataFrame | None = None
    requests: DataFrame | None = None
    logs: list = field(default_factory=list)
    _names: DataFrame | None = None

    def __post_init__(self) -> None:
        """Measured vertices, half-edges and nodes are made once and written."""
        self.measured = checkpointed(lines.measured(self.vertices))
        dealt = by_line(self.measured)
        at = self.measured.groupBy("gx", "gy").agg(*(F.min(F.struct("lat", "lng", "ele"))[c].alias(c) for c in ("lat", "lng", "ele")))
        self.nodes = checkpointed(graph.intersections(dealt).join(at, ["gx", "gy"]))
        self.edges = checkpointed(graph.half_edges(dealt, self.nodes))

    def _points(self, points: list[tuple[float, float]]) -> DataFrame:
        df = self.spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "point_id long, lat double, lng double")
        return df.withColumns({"x": mercator_x(F.col("lng")), "y": mercator_y(F.col("lat"))})

    def what_is_here(self, lat: float, lng: float) -> DataFrame:
        got = snap.nearest(self._points([(lat, lng)]), self.measured).join(self.attributes, "line_id", "left")
        if self.samples is None:
            return got.withColumn("ele", F.lit(None).cast("double"))
        return got.join(self.elevation(lat, lng).select("point_id", "ele"), "point_id", "left")

    def trail_info(self, lat: float, lng: float) -> DataFrame:
        return snap.bracketed(snap.nearest(self._points([(lat, lng)]), self.measured), self.edges)

    def elevation(self, lat: float, lng: float) -> DataFrame:
        return raster.elevations(self._points([(lat, lng)]), self.samples, self.dim)

    def elevation_area(self, lat: float, lng: float, size: int) -> DataFrame:
        at = raster.around(F.lit(lat), F.lit(lng), size, self.dim)
        return raster.window(self.samples, self.spark.range(1).select(F.col("id").alias("request_id"), *(v.alias(k) for k, v in at.items())), size, self.dim)

    def elevation_tile(self, x: int, y: int, dimension: int) -> DataFrame:
        """The samples of a tile of `dimension` samples a side, so `dimension` - 1 cells."""
        at = raster.tile_window(F.lit(x), F.lit(y), dimension)
        return raster.window(self.samples, self.spark.range(1).select(F.col("id").alias("request_id"), *(v.alias(k) for k, v in at.items())), dimension - 1, self.dim)

    def generate_paths_queue(self) -> DataFrame:
        return queue_state(self.requests).where("waiting > 0")

    def _request(self, kind: str, area: int) -> None:
        row = self.spark.range(1).select(
            F.expr("unix_micros(current_timestamp())").alias("event_id"), F.expr("cast(current_timestamp() as timestamp_ntz)").alias("ts"), F.lit(kind).alias("kind"), F.lit(area).cast("long").alias("area")
        )
        self.requests = row if self.requests is None else self.requests.unionByName(row)

    def generate_paths(self, area: int | None = None, bounds: tuple[float, ...] | None = None) -> list[int]:
        """Asks for builds of an area, or of every cell of bounds (lat1, lng1[, lat2, lng2]); gives the areas."""
        areas = [area] if bounds is None else sorted(area_of(r.lat, r.lng) for r in self._cells(*bounds).collect())
        for a in areas:
            self._request("enqueue", a)
        return areas

    def build_paths(self, store, report=lambda name, values: None) -> int:
        """Builds the areas that wait, one after the other, into a store of half-edges; gives their number."""
        waiting = self.generate_paths_queue().select("area").orderBy("area").collect()  # small: one row an area that waits
        for r in waiting:
            rebuild.build_area(self.vertices, store, area_box(r.area), report)
            self.requests = self.requests.where(F.col("area") != r.area)
        return len(waiting)

    def delete_generate_path_request(self, area: int) -> None:
        self._request("cancel", area)

    def hike_distance(self, hike_id: int, mode: str = "full") -> DataFrame:
        return routes.saved_distance(self.route_points.where(F.col("hike_id") == hike_id), self.measured, mode)

    def find_route(self, points: list[tuple[float, float]], algorithm: str = "bidi_astar", preferred_lines: DataFrame | None = None, tile: float = TILE) -> DataFrame:
        """Anchors of each leg between consecutive points (query_id from 0), with `error`.

        Points at one place are one virtual node, so a route may come back to where it was.
        A leg without a way, or with a point that meets no line, is one row of null cost
        that says so; a leg between equal places is one row of cost 0 without a line.
        """
        asked = self._points(points)
        at = checkpointed(snap.bracketed(snap.nearest(asked, self.measured), self.edges))
        inside = F.col("snap_fraction") > F.col("edge_fraction")
        node = F.when(inside, F.max(-2 - F.col("point_id")).over(Window.partitionBy("line_id", "snap_fraction"))).otherwise(F.col("node_id"))
        placed = checkpointed(at.withColumn("node", node))
        virtual = placed.where(inside).select("line_id", "snap_fraction", F.col("node").alias("virtual_id")).distinct()
        split = checkpointed(routes.split_edges(self.edges, self.measured, virtual))
        arcs = routes.overridden(graph.arcs(self.edges), split)
        if preferred_lines is not None:
            arcs = routes.with_preference(arcs, preferred_lines)
        arcs = checkpointed(arcs)
        node = asked.join(placed.select("point_id", "node"), "point_id", "left")
        legs = node.select(F.col("point_id").alias("query_id"), F.col("node").alias("src")).join(
            node.select((F.col("point_id") - 1).alias("query_id"), F.col("node").alias("dst")), "query_id"
        )
        places = self.nodes.select("node_id", "lat", "lng").unionByName(
            placed.where(inside).select(F.col("node").alias("node_id"), latitude(F.col("sy")).alias("lat"), longitude(F.col("sx")).alias("lng"))
        )
        legs = checkpointed(legs)
        found = search.routes(legs, arcs, places, algorithm, preferred_lines is not None, tile)
        self.logs = [found.select("query_id", "log")]
        told = routes.anchors(routes.legs(found.where("cost is not null"), arcs))
        error = F.when(F.col("src").isNull() | F.col("dst").isNull(), "no line near a point").when(F.col("whole").isNull(), "no way")
        whole = legs.join(found.select("query_id", F.col("cost").alias("whole")), "query_id").select("query_id", "src", "dst", "whole", error.alias("error"))
        out = whole.join(told, "query_id", "left")
        return out.withColumns(
            {
                "from_node": F.coalesce("from_node", "src"), "to_node": F.coalesce("to_node", "dst"), "cost": F.coalesce("cost", "whole"),
                "legs": F.coalesce("legs", F.lit(0)), "seq": F.coalesce("seq", F.lit(1)),
            }
        ).select(*told.columns, "error")

    def search_log_entry(self, index: int) -> DataFrame:
        return self.logs[-1].select("query_id", F.get("log", F.lit(index)).alias("entry"))

    def update_route_elevations(self, line_ids: list[int] | None = None) -> DataFrame:
        """Vertices with elevations sampled anew (of some lines, or all)."""
        asked = F.lit(True) if line_ids is None else F.col("line_id").isin(line_ids)
        sampled = raster.elevations(self.vertices.withColumnRenamed("ele", "__old"), self.samples, self.dim)
        new = F.coalesce(F.when(asked, F.col("ele")), "__old")
        self.vertices = checkpointed(sampled.withColumn("ele", new).select(self.vertices.columns))
        self.measured = checkpointed(lines.measured(by_line(self.vertices)))
        return self.vertices

    def update_nav_node_elevations(self) -> DataFrame:
        sampled = raster.elevations(self.nodes.select(F.col("node_id").alias("point_id"), "lat", "lng").distinct(), self.samples, self.dim)
        self.nodes = checkpointed(self.nodes.drop("ele").join(sampled.select(F.col("point_id").alias("node_id"), "ele"), "node_id", "left"))
        return self.nodes

    def update_nav_edge_costs(self, areas: DataFrame) -> DataFrame:
        """Costs again for edges of lines with a vertex in one of the cells (lat, lng)."""
        parts = -(-self.edges.count() // ROWS)
        touched = areas.select(F.col("lat").alias("__lat"), F.col("lng").alias("__lng"), F.lit(True).alias("__in")).distinct()
        cell = by_line(self.vertices).withColumns({"__lat": F.floor("lat"), "__lng": F.floor("lng")}).join(touched, ["__lat", "__lng"], "left")
        # a window over the line instead of a join by it: lines stay where they are
        own = cell.withColumn("__in", F.max("__in").over(Window.partitionBy("line_id"))).where("__in").select(self.vertices.columns)
        fresh = graph.half_edges(lines.measured(own))
        at_edges = lambda df: df.repartition(max(parts, 1), "edge_id")
        self.edges = checkpointed(graph.updated(at_edges(self.edges), at_edges(fresh), "edge_id", ["forward_cost", "reverse_cost", "back_cost"]))
        return self.edges

    def node_counts(self) -> DataFrame:
        cell = self.nodes.select("node_id", F.floor("lat").alias("lat"), F.floor("lng").alias("lng")).distinct()
        return catalog.node_counts(self.quads, cell, ["lat", "lng"])

    def update_intersection_counts(self) -> DataFrame:
        cell = self.vertices.withColumns({"clat": F.floor("lat"), "clng": F.floor("lng")})
        fresh = catalog.intersection_counts(cell, ["clat", "clng"]).toDF("lat", "lng", "intersection_count")
        self.quads = graph.upsert(self.quads.select("lat", "lng", "intersection_count"), fresh, ["lat", "lng"])
        return self.quads

    def _cells(self, lat1, lng1, lat2=None, lng2=None) -> DataFrame:
        values = [F.lit(float(v)) if v is not None else None for v in (lat1, lng1, lat2, lng2)]
        return catalog.cells(self.spark.range(1).select(*(v.alias(k) for k, v in catalog.normalised(*values).items())))

    def add_quadrangle(self, lat1, lng1, lat2=None, lng2=None) -> DataFrame:
        rows = self._cells(lat1, lng1, lat2, lng2).withColumn("intersection_count", F.lit(None).cast("long"))
        self.quads = rows if self.quads is None else graph.insert_absent(self.quads, rows, ["lat", "lng"])
        return self.quads

    def remove_quadrangle(self, lat1, lng1, lat2=None, lng2=None) -> DataFrame:
        self.quads = self.quads.join(self._cells(lat1, lng1, lat2, lng2), ["lat", "lng"], "left_anti")
        return self.quads

    def search(self, query: str) -> DataFrame:
        """Names with their walkable lines, grouped by category within a name; the index is made by the first call."""
        if self._names is None:
            self._names = catalog.text_index(self.attributes)
        found = catalog.search(self.attributes, query, index=self._names)
        return catalog.by_name_and_kind(found, ["line_id", "surface"])

    def get_routes(self, line_ids: list[int]) -> DataFrame:
        points = self.vertices.where(F.col("line_id").isin(line_ids)).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng"))).alias("points"))
        return points.join(self.attributes, "line_id", "left")

    def add_route_group(self, group_id: int, name: str) -> DataFrame:
        row = self.spark.createDataFrame([(group_id, name)], "group_id long, name string")
        self.groups = row if self.groups is None else self.groups.unionByName(row)
        return self.groups

    def add_route_group_routes(self, group_id: int, line_ids: list[int]) -> bool:
        rows = self.spark.createDataFrame([(group_id, line_ids)], "group_id long, ids array<long>").select("group_id", F.explode("ids").alias("line_id"))
        self.members = rows if self.members is None else self.members.unionByName(rows)
        return True

    def route_group_routes(self, group_id: int, geometry: bool = False) -> DataFrame:
        own = self.members.where(F.col("group_id") == group_id).join(self.attributes, "line_id")
        if not geometry:
            return catalog.by_name(own, ["line_id"])
        points = self.vertices.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lng"))).alias("points"))
        return catalog.by_name(own.join(points, "line_id"), ["line_id", "points"])

    def route_groups(self) -> DataFrame:
        return self.groups.select("group_id", "name", F.lit(None).cast("string").alias("subgroups"))
