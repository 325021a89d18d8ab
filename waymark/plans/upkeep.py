"""Registered queries of the graph's upkeep: rebuilds, overrides, updates from tiles, lookups and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.api import Finder
from waymark.operators import catalog, graph, lines, rebuild, routes
from waymark.plans.queries import BOX, COUNTS, DIM, OLD, QUADS, arcs, blocks, edges, measured, quads, query, r, tiles
from waymark.plans.sql import sql
from waymark.sources import network, raster
from waymark.sources.tables import table
from waymark.sources.versions import checkpointed

#: The network before its last lines came, as the half-edges that a rebuild finds.
OLD_EDGES = """old_he AS (SELECT line_id * 1000 + idx AS edge_id, node_id, line_id, idx, lead(line_id * 1000 + idx) OVER l AS forward_edge_id, lag(line_id * 1000 + idx) OVER l AS reverse_edge_id,
  lead(cum_fwd) OVER l - cum_fwd AS forward_cost FROM m JOIN (SELECT gx, gy, gx * 1000 + gy AS node_id FROM v WHERE line_id % 10 <> 3 GROUP BY gx, gy HAVING count(*) > 1 OR max(CASE WHEN idx = 1 OR idx = n THEN 1 ELSE 0 END) = 1) o USING (gx, gy)
  WHERE line_id % 10 <> 3 WINDOW l AS (PARTITION BY line_id ORDER BY idx))"""


def old_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.half_edges(lines.measured(network.vertices(spark, d).where("line_id % 10 <> 3")))


@query(sql("""SELECT coalesce(o.line_id, n.line_id) AS line_id, coalesce(o.idx, n.idx) AS point_index, CASE WHEN o.line_id IS NULL THEN 'insert' WHEN n.line_id IS NULL THEN 'delete'
WHEN o.node_id = n.node_id AND o.forward_edge_id IS NOT DISTINCT FROM n.forward_edge_id AND o.reverse_edge_id IS NOT DISTINCT FROM n.reverse_edge_id THEN 'keep' ELSE 'update' END AS op
FROM old_he o FULL JOIN he n ON o.line_id = n.line_id AND o.idx = n.idx""", OLD_EDGES))
def edge_diff(spark, d):
    changes = rebuild.edge_changes(old_edges(spark, d), edges(spark, d))
    return changes.select("line_id", F.col("idx").alias("point_index"), "op")


@query(sql(f"""SELECT edge_id, node_id, line_id, forward_edge_id, round(forward_cost, 6) AS forward_cost FROM he WHERE line_id IN (SELECT line_id FROM own)
UNION ALL SELECT edge_id, node_id, line_id, forward_edge_id, round(forward_cost, 6) FROM old_he WHERE line_id NOT IN (SELECT line_id FROM own)""",
    OLD_EDGES + f""", inside AS (SELECT line_id FROM v GROUP BY line_id HAVING min(lat) <= {BOX[2]} AND max(lat) >= {BOX[0]} AND min(lng) <= {BOX[3]} AND max(lng) >= {BOX[1]}),
own AS MATERIALIZED (SELECT DISTINCT line_id FROM v JOIN (SELECT DISTINCT gx, gy FROM v JOIN inside USING (line_id)) p USING (gx, gy))"""))
def area_rebuild(spark, d):
    v = network.vertices(spark, d)
    out = rebuild.rebuilt(old_edges(spark, d), v, rebuild.area_lines(v, *BOX))
    return out.select("edge_id", "node_id", "line_id", "forward_edge_id", r("forward_cost").alias("forward_cost"))


@query(sql("SELECT n.gx, n.gy, coalesce(o.node_id + 2000000000, n.node_id) AS node_id FROM nodes n LEFT JOIN old_nodes o ON o.node_id = n.node_id", OLD))
def node_id_reuse(spark, d):
    """Each old node stands twice under other ids; the lesser of them is taken over."""
    v = network.vertices(spark, d)
    old = graph.intersections(v.where("line_id % 10 <> 3"))
    existing = old.select("gx", "gy", F.explode(F.array(F.col("node_id") + 3_000_000_000, F.col("node_id") + 2_000_000_000)).alias("node_id"))
    return rebuild.with_node_ids(graph.intersections(v), existing).select("gx", "gy", "node_id")


@query(sql("SELECT node_id, string_agg(DISTINCT line_id || ':' || idx || ':' || CAST(round(fraction * 1000000) AS BIGINT), ',' ORDER BY line_id || ':' || idx || ':' || CAST(round(fraction * 1000000) AS BIGINT)) AS incidences FROM he GROUP BY node_id"))
def node_incidences(spark, d):
    sets = graph.incidences(edges(spark, d))
    shown = F.transform("incidences", lambda s: F.concat_ws(":", s["line_id"], s["idx"], F.round(s["fraction"] * 1000000).cast("long")))
    return sets.select("node_id", F.array_join(F.array_sort(shown), ",").alias("incidences"))


@query(sql("SELECT node_id, CAST(to_json(list(struct_pack(line_id := line_id, idx := idx, edge_id := edge_id) ORDER BY line_id, idx)) AS VARCHAR) AS objects FROM he GROUP BY node_id"))
def node_objects_json(spark, d):
    listed = edges(spark, d).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "idx", "edge_id"))).alias("a"))
    return listed.select("node_id", F.to_json("a").alias("objects"))


ANCHORS = """moved AS (SELECT line_id // 5 AS query_id, line_id, count(*) AS legs, min_by(node_id, idx) AS from_node, max_by(forward_node_id, idx) AS to_node FROM he WHERE forward_edge_id IS NOT NULL GROUP BY line_id),
numbered AS (SELECT *, row_number() OVER w AS seq, lag(line_id) OVER w AS prev, lead(line_id) OVER w AS next FROM moved WINDOW w AS (PARTITION BY query_id ORDER BY line_id))"""


def walked(spark: SparkSession, d: str) -> DataFrame:
    """Legs of walks that take five lines by number, each from its first node to its last."""
    e = edges(spark, d).where("forward_edge_id is not null")
    return e.select(
        F.floor(F.col("line_id") / 5).alias("query_id"), F.col("edge_id").alias("leg"), F.col("node_id").alias("src"), F.col("forward_node_id").alias("dst"),
        "line_id", F.col("fraction").alias("f0"), F.col("forward_fraction").alias("f1"), F.col("forward_cost").alias("cost"),
    )


@query(sql("SELECT query_id, seq, CASE WHEN seq = 1 THEN 'start' WHEN next IS NULL THEN 'end' END AS type, line_id, from_node, to_node, legs, prev, next, (CASE WHEN seq = 1 OR next IS NULL THEN 1 ELSE 0 END) + (prev IS NOT NULL)::INTEGER + (next IS NOT NULL)::INTEGER + 7 AS members FROM numbered", ANCHORS))
def anchors_json(spark, d):
    made = routes.anchors_json(routes.anchors(walked(spark, d)))
    part = lambda name: F.get_json_object("anchor", f"$.{name}")
    numbers = [part(c).cast("long").alias(c) for c in ("line_id", "from_node", "to_node", "legs", "prev", "next")]
    return made.select("query_id", "seq", part("type").alias("type"), *numbers, F.size(F.json_object_keys("anchor")).alias("members"))


@query(sql("SELECT line_id // 5 AS query_id, edge_id AS leg FROM (SELECT *, lag(forward_node_id) OVER (PARTITION BY line_id // 5 ORDER BY edge_id) AS before FROM he WHERE forward_edge_id IS NOT NULL) WHERE before <> node_id"))
def leg_gaps(spark, d):
    return routes.gaps(walked(spark, d))


@query(sql("SELECT line_id, count(*)::BIGINT * 4 AS arcs, round(sum(forward_cost + back_cost), 4) AS hours FROM he WHERE forward_edge_id IS NOT NULL GROUP BY line_id"))
def overridden_arcs(spark, d):
    """Every linked half-edge is cut at its middle: four arcs stand for two, at the same cost together."""
    m = measured(spark, d)
    e = graph.half_edges(m)
    middle = ((F.col("fraction") + F.col("forward_fraction")) / 2).alias("snap_fraction")
    snaps = e.where("forward_edge_id is not null").select("line_id", middle, (-2 - F.col("edge_id")).alias("virtual_id"))
    out = routes.overridden(graph.arcs(e), routes.split_edges(e, m, snaps))
    return out.groupBy("line_id").agg(F.count("*").alias("arcs"), r(F.sum("cost"), 4).alias("hours"))


GROUND = "3 * 36 * (1 - (lat - 39)) + 5 * 36 * (lng + 110)"


def finder(spark: SparkSession, d: str, vertices: DataFrame | None = None) -> Finder:
    v = network.vertices(spark, d) if vertices is None else vertices
    return Finder(spark, v, network.attributes(spark, d), samples=tiles(spark), dim=DIM)


@query(sql(f"SELECT line_id, idx, round({GROUND}, 6) AS ele FROM v"))
def line_elevation_update(spark, d):
    return finder(spark, d).update_route_elevations().select("line_id", "idx", r("ele").alias("ele"))


@query(sql(f"SELECT node_id, round({GROUND}, 6) AS ele FROM (SELECT node_id, 39 + gy / 1000e0 AS lat, -110 + gx / 1000e0 AS lng FROM nodes)"))
def node_elevation_update(spark, d):
    return finder(spark, d).update_nav_node_elevations().select("node_id", r("ele").alias("ele"))


@query(sql("SELECT edge_id, round(forward_cost, 6) AS forward_cost, round(reverse_cost, 6) AS reverse_cost FROM he"))
def edge_cost_update(spark, d):
    """Costs of flat ground, made anew once the vertices have their elevations."""
    real = network.vertices(spark, d)
    f = finder(spark, d, real.withColumn("ele", F.lit(0.0)))
    f.vertices = real
    areas = spark.sql("SELECT 39L AS lat, -110L AS lng")
    return f.update_nav_edge_costs(areas).select("edge_id", r("forward_cost").alias("forward_cost"), r("reverse_cost").alias("reverse_cost"))


@query("""SELECT (CASE WHEN a >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(a) AS VARCHAR), 2, '0') || (CASE WHEN b >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(b) AS VARCHAR), 3, '0') AS tile, count(*) AS points
FROM (SELECT CAST(floor(event_id * 37 % 1200 / 10e0 - 60) AS BIGINT) AS a, CAST(floor(event_id * 91 % 3600 / 10e0 - 180) AS BIGINT) AS b FROM events) GROUP BY a, b HAVING NOT (a = 39 AND b IN (-110, -109))""")
def required_tiles(spark, d):
    e = F.col("event_id")
    at = table(spark, d, "events").select((e * 37 % 1200 / 10.0 - 60).alias("lat"), (e * 91 % 3600 / 10.0 - 180).alias("lng"))
    return raster.required_tiles(at, spark.sql("SELECT tile FROM VALUES ('N39W110'), ('N39W109') AS t(tile)"))


@query(sql("SELECT event_id, p.node_id, round(39 + gy / 1000e0, 6) AS lat, round(-110 + gx / 1000e0, 6) AS lng FROM (SELECT event_id, event_id % 97 * 1000 + event_id % 89 AS node_id FROM events) p LEFT JOIN nodes USING (node_id)"))
def node_lookup(spark, d):
    asked = table(spark, d, "events").select("event_id", (F.col("event_id") % 97 * 1000 + F.col("event_id") % 89).alias("node_id"))
    at = network.placed(graph.intersections(network.vertices(spark, d))).select("node_id", "lat", "lng")
    return asked.join(at, "node_id", "left").select("event_id", "node_id", r("lat").alias("lat"), r("lng").alias("lng"))


@query(sql("""SELECT DISTINCT a.src AS node_id, a.line_id, a.dst AS other_id, h.edge_id FROM arcs a JOIN he h ON h.node_id = a.src AND h.line_id = a.line_id LEFT JOIN he b ON b.edge_id = h.reverse_edge_id
WHERE h.forward_node_id = a.dst OR b.node_id = a.dst"""))
def edge_by_other_node(spark, d):
    asked = arcs(spark, d).select(F.col("src").alias("node_id"), "line_id", F.col("dst").alias("other_id"))
    return graph.edges_between(edges(spark, d), asked)


@query(sql("SELECT q.cx, q.cy, CASE WHEN (q.cx + q.cy) % 2 = 0 THEN coalesce(c.intersections, 0) ELSE 7 END AS intersections FROM quads q LEFT JOIN counted c ON c.cx = q.cx AND c.cy = q.cy", QUADS + ", " + COUNTS))
def lazy_counts(spark, d):
    have = quads(spark).withColumn("intersections", F.when((F.col("cx") + F.col("cy")) % 2 != 0, 7).cast("long"))
    return catalog.filled_counts(have, catalog.intersection_counts(blocks(network.vertices(spark, d)), ["cx", "cy"]), ["cx", "cy"], "intersections")
