"""The registered queries of the network, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.operators import catalog, graph, lines, routes, search, snap
from waymark.plans.sql import distances, hav, hrs, sql
from waymark.sources import config, network, raster
from waymark.sources.tables import table
from waymark.sources.versions import checkpointed, new_path
from waymark.streaming import requests as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 37


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(r(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def measured(spark: SparkSession, d: str) -> DataFrame:
    return lines.measured(network.vertices(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.half_edges(measured(spark, d))


def arcs(spark: SparkSession, d: str) -> DataFrame:
    return graph.arcs(edges(spark, d))


def asked(at: DataFrame) -> DataFrame:
    """A request from every node whose id is divisible by 50, to the node that a rule names, where there is one."""
    other = (F.col("gx") * 37 + 11) % 97 * 1000 + (F.col("gy") * 29 + 7) % 89
    own = at.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("node_id").alias("src"), other.alias("dst"))
    return own.join(at.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("query_id", "src", "dst")


@query(sql("SELECT line_id, count(*) AS half_edges, count(forward_edge_id) AS linked, round(coalesce(sum(forward_cost), 0), 6) AS forward_h, round(coalesce(sum(reverse_cost), 0), 6) AS reverse_h FROM he GROUP BY line_id"))
def network_summary(spark, d):
    return edges(spark, d).groupBy("line_id").agg(
        F.count("*").alias("half_edges"),
        F.count("forward_edge_id").alias("linked"),
        r(F.coalesce(F.sum("forward_cost"), F.lit(0.0))).alias("forward_h"),
        r(F.coalesce(F.sum("reverse_cost"), F.lit(0.0))).alias("reverse_h"),
    )


@query(sql("SELECT line_id, idx, n, gx, gy, round(lat, 6) AS lat, round(lng, 6) AS lng, ele, round(x, 4) AS x, round(y, 4) AS y FROM v"))
def vertices(spark, d):
    df = network.vertices(spark, d)
    return df.select("line_id", "idx", "n", "gx", "gy", r("lat").alias("lat"), r("lng").alias("lng"), "ele", r("x", 4).alias("x"), r("y", 4).alias("y"))


@query(sql("SELECT line_id, idx, round(lat, 6) AS lat, round(lng, 6) AS lng FROM v"))
def mercator_roundtrip(spark, d):
    return network.vertices(spark, d).select("line_id", "idx", r(geo.latitude(F.col("y"))).alias("lat"), r(geo.longitude(F.col("x"))).alias("lng"))


@query(sql("SELECT line_id, idx, round(len_m, 6) AS len_m, round(len_merc, 4) AS len_merc FROM s WHERE idx > 1"))
def haversine_segments(spark, d):
    return lines.segments(network.vertices(spark, d)).where("idx > 1").select("line_id", "idx", r("len_m").alias("len_m"), r("len_merc", 4).alias("len_merc"))


@query(sql("SELECT line_id, round(sum(fwd_h), 6) AS forward_h, round(sum(rev_h), 6) AS reverse_h FROM s GROUP BY line_id"))
def tobler_costs(spark, d):
    return lines.segments(network.vertices(spark, d)).groupBy("line_id").agg(r(F.sum("fwd_h")).alias("forward_h"), r(F.sum("rev_h")).alias("reverse_h"))


@query(sql("SELECT line_id, round(sum(len_m), 6) AS metres, round(sum(len_merc), 4) AS planar FROM s GROUP BY line_id"))
def line_lengths(spark, d):
    return lines.segments(network.vertices(spark, d)).groupBy("line_id").agg(r(F.sum("len_m")).alias("metres"), r(F.sum("len_merc"), 4).alias("planar"))


@query(sql("SELECT line_id, idx, round(fraction, 6) AS fraction FROM m"))
def vertex_fractions(spark, d):
    return measured(spark, d).select("line_id", "idx", r("fraction", 6).alias("fraction"))


@query(sql("SELECT node_id, uses, lines, CAST(is_end AS INTEGER) AS is_end FROM nodes"))
def intersections(spark, d):
    return graph.intersections(network.vertices(spark, d)).select("node_id", "uses", "lines", F.col("is_end").cast("int"))


@query(sql("SELECT a.line_id AS line_id, a.idx AS idx, count(*) AS others, count(DISTINCT b.line_id) AS other_lines FROM v a JOIN v b ON a.gx = b.gx AND a.gy = b.gy AND (a.line_id <> b.line_id OR a.idx <> b.idx) GROUP BY 1, 2"))
def intersection_self_join(spark, d):
    """Vertices that meet others, from sums per point: pairs are never made.

    A vertex meets (uses of its point - 1) others, of as many lines as the point has,
    less its own unless that passes again.
    """
    here = Window.partitionBy("line_id", "gx", "gy")
    v = network.vertices(spark, d).select("line_id", "idx", "gx", "gy", F.count("*").over(here).alias("own"), F.row_number().over(here.orderBy("idx")).alias("nth"))
    per_point = v.groupBy("gx", "gy").agg(F.count("*").alias("uses"), F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).alias("lines")).where("uses > 1")
    met = v.drop("nth").join(checkpointed(per_point), ["gx", "gy"])
    return met.select("line_id", "idx", (F.col("uses") - 1).alias("others"), (F.col("lines") - F.when(F.col("own") == 1, 1).otherwise(0)).alias("other_lines"))


@query(sql("SELECT edge_id, node_id, line_id, idx AS point_index, round(fraction, 6) AS fraction, forward_edge_id, reverse_edge_id, round(forward_cost, 6) AS forward_cost, round(reverse_cost, 6) AS reverse_cost FROM he"))
def half_edges(spark, d):
    return edges(spark, d).select("edge_id", "node_id", "line_id", F.col("idx").alias("point_index"), r("fraction", 6).alias("fraction"), "forward_edge_id", "reverse_edge_id", r("forward_cost").alias("forward_cost"), r("reverse_cost").alias("reverse_cost"))


@query(sql("SELECT DISTINCT node_id, round(39 + gy / 1000e0, 6) AS lat, round(-110 + gx / 1000e0, 6) AS lng FROM nodes"))
def nodes(spark, d):
    return network.placed(graph.intersections(network.vertices(spark, d))).select("node_id", r("lat").alias("lat"), r("lng").alias("lng"))


@query(sql("SELECT line_id, edge_id, src, dst, round(cost, 6) AS cost FROM arcs"))
def directed_arcs(spark, d):
    return arcs(spark, d).select("line_id", "edge_id", "src", "dst", r("cost").alias("cost"))


@query(sql("SELECT e1.line_id AS line_id, e1.edge_id AS a, e2.edge_id AS b, round(e1.forward_cost, 6) AS cost FROM he e1 JOIN he e2 ON e1.forward_edge_id = e2.edge_id AND e2.reverse_edge_id = e1.edge_id"))
def linked_edge_pairs(spark, d):
    e = edges(spark, d)
    other = e.select(F.col("edge_id").alias("b"), F.col("reverse_edge_id").alias("back"))
    return e.join(other, (e["forward_edge_id"] == other["b"]) & (other["back"] == e["edge_id"])).select("line_id", F.col("edge_id").alias("a"), "b", r("forward_cost").alias("cost"))


BOX = (39.02, -109.97, 39.05, -109.93)


@query(sql(f"SELECT e.edge_id, e.node_id FROM he e JOIN m ON m.line_id = e.line_id AND m.idx = e.idx WHERE m.lat BETWEEN {BOX[0]} AND {BOX[2]} AND m.lng BETWEEN {BOX[1]} AND {BOX[3]}"))
def edges_in_bbox(spark, d):
    at = network.placed(edges(spark, d).withColumns({"gx": F.floor(F.col("node_id") / 1000), "gy": F.col("node_id") % 1000}))
    return at.where(F.col("lat").between(BOX[0], BOX[2]) & F.col("lng").between(BOX[1], BOX[3])).select("edge_id", "node_id")


@query(sql(f"SELECT line_id FROM v GROUP BY line_id HAVING min(lat) <= {BOX[2]} AND max(lat) >= {BOX[0]} AND min(lng) <= {BOX[3]} AND max(lng) >= {BOX[1]}"))
def lines_in_bbox(spark, d):
    ext = network.vertices(spark, d).groupBy("line_id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("lat", "lng")))
    return ext.where((F.col("lo_lat") <= BOX[2]) & (F.col("hi_lat") >= BOX[0]) & (F.col("lo_lng") <= BOX[3]) & (F.col("hi_lng") >= BOX[1])).select("line_id")


QUADS = "quads AS (SELECT cx, cy FROM range(0, 12) a(cx), range(0, 11) b(cy))"


def quads(spark: SparkSession) -> DataFrame:
    return spark.range(12 * 11).select(F.expr("id div 11").alias("cx"), F.expr("id % 11").alias("cy"))


def blocks(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("gx") / 10), "cy": F.floor(F.col("gy") / 10)})


@query(sql("SELECT q.cx, q.cy, count(n.node_id) AS node_count FROM quads q LEFT JOIN nodes n ON n.gx // 10 = q.cx AND n.gy // 10 = q.cy GROUP BY ALL", QUADS))
def node_counts_by_quad(spark, d):
    return catalog.node_counts(quads(spark), blocks(graph.intersections(network.vertices(spark, d))), ["cx", "cy"])


@query(sql("SELECT count(*) AS node_count FROM nodes WHERE gx // 10 = 3 AND gy // 10 = 4"))
def node_count_one_quad(spark, d):
    return blocks(graph.intersections(network.vertices(spark, d))).where("cx = 3 and cy = 4").agg(F.count("*").alias("node_count"))


COUNTS = """counted AS (SELECT gx // 10 AS cx, gy // 10 AS cy, count(*) AS intersections FROM (
  SELECT gx, gy FROM (SELECT gx, gy FROM v UNION ALL SELECT gx, gy FROM v WHERE idx = 1 UNION ALL SELECT gx, gy FROM v WHERE idx = n) GROUP BY gx, gy HAVING count(*) > 1) GROUP BY 1, 2)"""


@query(sql("SELECT cx, cy, intersections FROM counted", COUNTS))
def intersection_counts(spark, d):
    return catalog.intersection_counts(blocks(network.vertices(spark, d)), ["cx", "cy"])


@query(sql("SELECT coalesce(c.cx, o.cx) AS cx, coalesce(c.cy, o.cy) AS cy, coalesce(c.intersections, o.intersections) AS intersections FROM counted c FULL JOIN (SELECT cx, cy, -1 AS intersections FROM quads WHERE (cx + cy) % 2 = 0) o ON c.cx = o.cx AND c.cy = o.cy", QUADS + ", " + COUNTS))
def quad_upsert(spark, d):
    old = quads(spark).where("(cx + cy) % 2 = 0").withColumn("intersections", F.lit(-1).cast("long"))
    return graph.upsert(old, catalog.intersection_counts(blocks(network.vertices(spark, d)), ["cx", "cy"]), ["cx", "cy"])


EVENT_CELLS = "SELECT DISTINCT CAST(floor(event_id * 37 % 1200 / 10e0 - 60) AS BIGINT) AS lat, CAST(floor(event_id * 91 % 3600 / 10e0 - 180) AS BIGINT) AS lng FROM events"


def event_cells(events: DataFrame) -> DataFrame:
    """The cells of the events' places, as ranges of one point each."""
    e = F.col("event_id")
    at = catalog.normalised(e * 37 % 1200 / 10.0 - 60, e * 91 % 3600 / 10.0 - 180)
    return catalog.cells(events.select(*(v.alias(k) for k, v in at.items())))


@query(f"SELECT lat, lng, CASE WHEN (lat + lng) % 2 = 0 THEN 7 END AS intersection_count FROM ({EVENT_CELLS})")
def quad_insert_absent(spark, d):
    wanted = event_cells(table(spark, d, "events")).withColumn("intersection_count", F.lit(None).cast("int"))
    have = wanted.where("(lat + lng) % 2 = 0").withColumn("intersection_count", F.lit(7))
    return graph.insert_absent(have, wanted, ["lat", "lng"])


@query(f"SELECT lat, lng FROM ({EVENT_CELLS}) EXCEPT SELECT lat, lng FROM ({EVENT_CELLS} WHERE event_type = 'error')")
def quad_delete(spark, d):
    events = table(spark, d, "events")
    return event_cells(events).join(event_cells(events.where("event_type = 'error'")), ["lat", "lng"], "left_anti")


@query("""SELECT event_id, CAST(floor(least(a, b)) AS BIGINT) AS min_lat, CAST(ceil(greatest(a, b)) AS BIGINT) AS max_lat, CAST(floor(least(p, q)) AS BIGINT) AS min_lng, CAST(ceil(greatest(p, q)) AS BIGINT) AS max_lng
FROM (SELECT event_id, 39 + value / 10 AS a, 45 - value / 10 AS b, -110 + value / 7 AS p, -100 - value / 7 AS q FROM events)""")
def bounds_normalise(spark, d):
    e = table(spark, d, "events").select("event_id", *(x.alias(k) for k, x in zip("abpq", (39 + F.col("value") / 10, 45 - F.col("value") / 10, -110 + F.col("value") / 7, -100 - F.col("value") / 7))))
    return e.select("event_id", *(x.alias(k) for k, x in catalog.normalised(F.col("a"), F.col("p"), F.col("b"), F.col("q")).items()))


@query(sql("SELECT e.edge_id, e.node_id, e.line_id FROM he e WHERE e.node_id IN (SELECT h.node_id FROM he h JOIN attrs a USING (line_id) WHERE a.name = 'red plate')"))
def nodes_touching_line(spark, d):
    e = edges(spark, d)
    named = network.attributes(spark, d).where("name = 'red plate'").select("line_id")
    touched = e.join(named, "line_id", "left_semi").select("node_id").distinct()
    return e.join(touched, "node_id", "left_semi").select("edge_id", "node_id", "line_id")


@query(sql("SELECT node_id, count(DISTINCT line_id) AS lines, min(line_id) AS first_line, max(line_id) AS last_line, sum(DISTINCT line_id)::BIGINT AS line_sum, count(DISTINCT forward_edge_id) AS forward_links FROM he GROUP BY node_id"))
def incidence_id_sets(spark, d):
    sets = edges(spark, d).groupBy("node_id").agg(F.array_sort(F.collect_set("line_id")).alias("s"), F.countDistinct("forward_edge_id").alias("forward_links"))
    return sets.select("node_id", F.size("s").cast("long").alias("lines"), F.array_min("s").alias("first_line"), F.array_max("s").alias("last_line"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("line_sum"), "forward_links")


@query(sql("SELECT DISTINCT line_id, point_index FROM (SELECT line_id, idx AS point_index FROM he UNION ALL SELECT line_id, idx FROM he)"))
def incidence_dedupe(spark, d):
    e = edges(spark, d).select("line_id", F.col("idx").alias("point_index"))
    return e.unionByName(e).dropDuplicates(["line_id", "point_index"])


@query(sql("SELECT src, dst, round(cost, 6) AS cost FROM best"))
def parallel_arc_min(spark, d):
    return rounded(graph.cheapest(arcs(spark, d)), "cost")


OLD = """old_nodes AS (SELECT gx * 1000 + gy AS node_id, count(*) AS uses FROM v WHERE line_id % 10 <> 3 GROUP BY gx, gy HAVING count(*) > 1 OR max(CASE WHEN idx = 1 OR idx = n THEN 1 ELSE 0 END) = 1)"""


@query(sql("""SELECT coalesce(o.node_id, n.node_id) AS node_id, CASE WHEN o.node_id IS NULL THEN 'insert' WHEN n.node_id IS NULL THEN 'delete' WHEN o.uses = n.uses THEN 'keep' ELSE 'update' END AS op
FROM old_nodes o FULL JOIN nodes n ON o.node_id = n.node_id""", OLD))
def graph_diff(spark, d):
    v = network.vertices(spark, d)
    old = graph.intersections(v.where("line_id % 10 <> 3"))
    return graph.diff(old, graph.intersections(v), ["node_id"], ["uses"]).select("node_id", "op")


@query(sql("SELECT node_id, uses FROM nodes"))
def graph_diff_apply(spark, d):
    v = network.vertices(spark, d)
    changes = graph.diff(graph.intersections(v.where("line_id % 10 <> 3")), graph.intersections(v), ["node_id"], ["uses"])
    return graph.apply_diff(changes, ["node_id"], ["uses"])


@query(sql("SELECT edge_id, round(CASE WHEN line_id % 2 = 0 THEN reverse_cost ELSE forward_cost END, 6) AS forward_cost FROM he"))
def edge_update_apply(spark, d):
    e = edges(spark, d)
    new = e.where("line_id % 2 = 0").select("edge_id", F.col("reverse_cost").alias("forward_cost"))
    return graph.updated(e.select("edge_id", "forward_cost"), new, "edge_id", ["forward_cost"]).select("edge_id", r("forward_cost").alias("forward_cost"))


@query(sql("SELECT edge_id FROM he WHERE forward_edge_id IS NOT NULL"))
def edge_delete_apply(spark, d):
    e = edges(spark, d)
    return graph.without(e.select("edge_id"), e.where("forward_edge_id is null"), "edge_id")


@query(sql("SELECT line_id, idx AS point_index, row_number() OVER (PARTITION BY line_id ORDER BY idx) AS seq FROM he"))
def node_insert_ids(spark, d):
    return edges(spark, d).select("line_id", F.col("idx").alias("point_index"), F.row_number().over(Window.partitionBy("line_id").orderBy("idx")).cast("long").alias("seq"))


@query(sql("SELECT gx, gy, min(line_id * 1000 + idx) AS node_id, count(*) AS copies FROM v GROUP BY gx, gy"))
def duplicate_node_removal(spark, d):
    return network.vertices(spark, d).groupBy("gx", "gy").agg(F.min(F.col("line_id") * 1000 + F.col("idx")).alias("node_id"), F.count("*").alias("copies"))


NEAR = """seg AS (SELECT line_id, idx, px, py, x, y, len_merc, cum_merc, total_merc, floor((px + x) / 2 / 500) AS cx, floor((py + y) / 2 / 500) AS cy FROM m WHERE px IS NOT NULL),
pt AS (SELECT point_id, p.x AS qx, p.y AS qy, floor(p.x / 500) + i AS cx, floor(p.y / 500) + j AS cy FROM points p, range(-1, 2) a(i), range(-1, 2) b(j)),
met AS (SELECT point_id, line_id, idx, qx, qy, px, py, x, y, len_merc, cum_merc, total_merc,
  CASE WHEN (x - px) * (x - px) + (y - py) * (y - py) > 0 THEN least(greatest(((qx - px) * (x - px) + (qy - py) * (y - py)) / ((x - px) * (x - px) + (y - py) * (y - py)), 0), 1) ELSE 0 END AS t FROM pt JOIN seg USING (cx, cy)),
near AS (SELECT point_id, line_id, idx, round(sqrt(pow(qx - px - t * (x - px), 2) + pow(qy - py - t * (y - py), 2)), 4) AS dist_merc, (cum_merc - len_merc + t * len_merc) / total_merc AS snap_fraction FROM met),
snapped AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist_merc, line_id, idx) = 1)"""
#: Fixed value: lines that a place is offered.
NEAREST = 10


def snapped(spark: SparkSession, d: str) -> DataFrame:
    return snap.nearest(network.points(spark, d), measured(spark, d))


@query(sql("SELECT point_id, line_id, dist_merc, round(snap_fraction, 6) AS snap_fraction FROM snapped", NEAR))
def snap_nearest_line(spark, d):
    return snapped(spark, d).select("point_id", "line_id", "dist_merc", r("snap_fraction").alias("snap_fraction"))


@query(sql(f"""SELECT point_id, line_id, dist_merc, row_number() OVER (PARTITION BY point_id ORDER BY dist_merc, line_id) AS rank FROM (SELECT point_id, line_id, min(dist_merc) AS dist_merc FROM near GROUP BY ALL)
QUALIFY rank <= {NEAREST}""", NEAR.replace("/ 500", "/ 2000")))
def snap_ten_lines(spark, d):
    return snap.nearest(network.points(spark, d), measured(spark, d), NEAREST).select("point_id", "line_id", "dist_merc", F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT s.point_id, s.line_id, e.edge_id, e.node_id, e.forward_edge_id FROM snapped s ASOF JOIN (SELECT * FROM he) e ON s.line_id = e.line_id AND s.snap_fraction + 1e-9 >= e.fraction", NEAR))
def snap_asof_edge(spark, d):
    return snap.bracketed(snapped(spark, d), edges(spark, d)).select("point_id", "line_id", "edge_id", "node_id", "forward_edge_id")


CUTS = """cuts AS (SELECT line_id, 0.2 + (line_id % 5) / 20e0 AS f0, 0.6 + (line_id % 7) / 20e0 AS f1 FROM (SELECT DISTINCT line_id FROM v)),
nx AS (SELECT *, lead(x) OVER l AS nx, lead(y) OVER l AS ny, lead(lat) OVER l AS nlat, lead(lng) OVER l AS nlng, lead(ele) OVER l AS nele, lead(fraction) OVER l AS nf FROM m WINDOW l AS (PARTITION BY line_id ORDER BY idx)),
sub AS (
  SELECT line_id, 0 AS part, idx, x + t * (nx - x) AS x, y + t * (ny - y) AS y, lat + t * (nlat - lat) AS lat, lng + t * (nlng - lng) AS lng, ele + t * (nele - ele) AS ele, f0 AS fraction
  FROM (SELECT nx.*, f0, (f0 - fraction) / (nf - fraction) AS t FROM nx JOIN cuts USING (line_id) WHERE fraction <= f0 AND nf > f0)
  UNION ALL SELECT line_id, 1, idx, x, y, lat, lng, ele, fraction FROM m JOIN cuts USING (line_id) WHERE fraction > f0 AND fraction < f1
  UNION ALL SELECT line_id, 2, idx, x + t * (nx - x), y + t * (ny - y), lat + t * (nlat - lat), lng + t * (nlng - lng), ele + t * (nele - ele), f1
  FROM (SELECT nx.*, f1, (f1 - fraction) / (nf - fraction) AS t FROM nx JOIN cuts USING (line_id) WHERE fraction < f1 AND nf >= f1))"""


def cuts(v: DataFrame) -> DataFrame:
    return v.where("idx = 1").select("line_id", (0.2 + F.col("line_id") % 5 / 20.0).alias("f0"), (0.6 + F.col("line_id") % 7 / 20.0).alias("f1"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    return lines.substring(m, cuts(m))


@query(sql("SELECT line_id, part, idx, round(x, 3) AS x, round(y, 3) AS y, round(ele, 5) AS ele, round(fraction, 6) AS fraction FROM sub", CUTS))
def line_substring(spark, d):
    return parts(spark, d).select("line_id", "part", "idx", r("x", 3).alias("x"), r("y", 3).alias("y"), r("ele", 5).alias("ele"), r("fraction", 6).alias("fraction"))


@query(sql(f"""SELECT line_id, round(coalesce(sum({hrs('ele - pele', 'run')}), 0), 6) AS forward_h, round(coalesce(sum({hrs('pele - ele', 'run')}), 0), 6) AS reverse_h, round(sum(run), 4) AS metres, count(*) AS points
FROM (SELECT *, coalesce({hav('p', '')}, 0) AS run FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(ele) OVER w AS pele FROM sub WINDOW w AS (PARTITION BY line_id ORDER BY part, idx))) GROUP BY line_id""", CUTS))
def substring_cost(spark, d):
    c = lines.cost_of(parts(spark, d), ["line_id"])
    return c.select("line_id", r("forward_h").alias("forward_h"), r("reverse_h").alias("reverse_h"), r("metres", 4).alias("metres"), "points")


@query(sql("SELECT line_id, n + 1 - idx AS idx, round(1 - fraction, 6) AS fraction, round(max(cum_rev) OVER p - cum_rev, 6) AS cum_fwd, round(max(cum_fwd) OVER p - cum_fwd, 6) AS cum_rev FROM m WINDOW p AS (PARTITION BY line_id)"))
def line_reverse(spark, d):
    back = lines.reverse(measured(spark, d))
    return back.select("line_id", "idx", r("fraction", 6).alias("fraction"), r(F.abs("cum_fwd")).alias("cum_fwd"), r(F.abs("cum_rev")).alias("cum_rev"))


@query(sql("SELECT name, count(*) AS lines, string_agg(CAST(line_id AS VARCHAR), ',' ORDER BY line_id) AS members FROM attrs WHERE highway IN ('path', 'footway', 'track', 'bridleway', 'steps') OR foot IN ('designated', 'yes') GROUP BY name"))
def group_lines_by_name(spark, d):
    g = catalog.by_name(catalog.walkable(network.attributes(spark, d)), ["line_id"])
    return g.select("name", "lines", F.array_join(F.transform("members", lambda x: x["line_id"].cast("string")), ",").alias("members"))


@query(sql("SELECT v.line_id, a.name, a.highway, count(*) AS points, round(min(lat), 6) AS south, round(max(lng), 6) AS east FROM v JOIN attrs a USING (line_id) WHERE line_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) GROUP BY ALL"))
def routes_by_ids(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)))).alias("line_id"))
    got = network.vertices(spark, d).join(asked, "line_id", "left_semi").join(network.attributes(spark, d), "line_id")
    return got.groupBy("line_id", "name", "highway").agg(F.count("*").alias("points"), r(F.min("lat")).alias("south"), r(F.max("lng")).alias("east"))


@query(sql("SELECT line_id % 5 AS group_id, name, count(*) AS lines FROM attrs WHERE line_id % 11 = 0 GROUP BY ALL"))
def route_group_routes(spark, d):
    a = network.attributes(spark, d)
    members = a.select((F.col("line_id") % 5).alias("group_id"), "line_id").where("line_id % 11 = 0")
    groups = spark.range(5).select(F.col("id").alias("group_id"))
    return catalog.group_members(groups, members, a).groupBy("group_id", "name").agg(F.count("*").alias("lines"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS name, CAST(NULL AS VARCHAR) AS subgroups FROM nation")
def route_groups(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("subgroups"))


@query(sql("SELECT line_id, name FROM attrs WHERE (list_contains(string_split(lower(name), ' '), 'red') AND NOT list_contains(string_split(lower(name), ' '), 'plate') OR lower(name) LIKE 'small g%') AND (highway IN ('path', 'footway', 'track', 'bridleway', 'steps') OR foot IN ('designated', 'yes'))"))
def text_search(spark, d):
    return catalog.search(network.attributes(spark, d), "red & !plates | small <-> g:*").select("line_id", "name")


@query(sql("SELECT name, highway, count(*) AS lines, min(line_id) AS first_line, max(line_id) AS last_line, CAST(sum(count(*)) OVER (PARTITION BY name) AS BIGINT) AS of_name FROM attrs WHERE list_contains(string_split(lower(name), ' '), 'red') AND (highway IN ('path', 'footway', 'track', 'bridleway', 'steps') OR foot IN ('designated', 'yes')) GROUP BY name, highway"))
def search_by_name_and_kind(spark, d):
    """The two-level result of a name search, its inner lists opened again."""
    found = catalog.by_name_and_kind(catalog.search(network.attributes(spark, d), "reds"), ["line_id", "surface"])
    opened = found.select("name", F.col("lines").alias("of_name"), F.explode("kinds").alias("k"))
    ids = F.transform("k.members", lambda m: m["line_id"])
    return opened.select("name", F.col("k.kind").alias("highway"), "k.lines", F.array_min(ids).alias("first_line"), F.array_max(ids).alias("last_line"), "of_name")


@query(sql("SELECT line_id, name, highway FROM attrs WHERE line_id > 1000 ORDER BY line_id LIMIT 1000"))
def lines_page(spark, d):
    return catalog.page(network.attributes(spark, d), "line_id", 1000, 1000).select("line_id", "name", "highway")


PREFERRED = "chosen AS MATERIALIZED (SELECT src, dst, min(CASE WHEN line_id % 11 = 0 THEN 0 ELSE cost END) AS cost FROM arcs GROUP BY src, dst)"


def preferred(spark: SparkSession, d: str, a: DataFrame) -> DataFrame:
    """Arcs with every eleventh line preferred; the ids come from the items, so arcs are not derived twice."""
    return routes.with_preference(a, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line_id")).where("line_id % 11 = 0"))


@query(sql("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, line_id FROM arcs WHERE line_id % 11 = 0"))
def preferred_edges(spark, d):
    a = arcs(spark, d)
    pairs = a.where("line_id % 11 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    marked = routes.with_preference(a, pairs=pairs).where("preferred and line_id % 11 = 0")
    return marked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "line_id").distinct()


PATHS = sql("SELECT q.query_id, q.src, q.dst, round(d.cost, 6) AS cost FROM requests q LEFT JOIN dist d ON d.query_id = q.query_id AND d.node = q.dst", distances())


#: The derived network is a tenth of a degree wide: some 16 tiles of it.
TILE = 0.03


def asked_and_places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The requests and the nodes (node_id, gx, gy, lat, lng), from one derivation of the nodes."""
    at = checkpointed(graph.intersections(network.vertices(spark, d)).select("node_id", "gx", "gy"))
    return checkpointed(asked(at)), network.placed(at).select("node_id", "gx", "gy", "lat", "lng")


def least_arcs(spark: SparkSession, d: str, nodes: DataFrame, prefer: bool = False) -> DataFrame:
    """src, dst, cost, line_id, f0, f1 of the cheapest arc of each pair between given nodes, written once.

    Arcs combine before the exchange, so what is written does not grow with parallel lines.
    """
    a = graph.arcs(graph.half_edges(measured(spark, d), nodes))
    return checkpointed(routes.least_rows(preferred(spark, d, a) if prefer else a))


def found(spark: SparkSession, d: str, algorithm: str, prefer: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, at = asked_and_places(spark, d)
    a = least_arcs(spark, d, at, prefer)
    return search.routes(q, a, at, algorithm, prefer, TILE), q, a


def costs(spark: SparkSession, d: str, algorithm: str, prefer: bool = False) -> DataFrame:
    got, q, _ = found(spark, d, algorithm, prefer)
    return q.join(got, "query_id").select("query_id", "src", "dst", r("cost").alias("cost"))


@query(PATHS)
def shortest_path_dijkstra(spark, d):
    return costs(spark, d, "dijkstra")


@query(PATHS)
def shortest_path_bidi_dijkstra(spark, d):
    return costs(spark, d, "bidi_dijkstra")


@query(PATHS)
def shortest_path_astar(spark, d):
    return costs(spark, d, "astar")


@query(PATHS)
def shortest_path_bidi_astar(spark, d):
    return costs(spark, d, "bidi_astar")


@query(sql("SELECT q.query_id, q.src, q.dst, round(d.cost, 6) AS cost FROM requests q LEFT JOIN dist d ON d.query_id = q.query_id AND d.node = q.dst", PREFERRED + ", " + distances("chosen")))
def shortest_path_preferred(spark, d):
    return costs(spark, d, "bidi_astar", True)


@query(sql("SELECT q.query_id, round(a.cost + b.cost, 6) AS cost, 2::BIGINT AS legs FROM requests q JOIN dist a ON a.query_id = q.query_id AND a.node = q.dst JOIN back b ON b.query_id = q.query_id AND b.node = q.src", distances() + ", " + distances(seeds="SELECT query_id, dst AS src FROM requests").replace("dist", "back")))
def multi_leg_route(spark, d):
    """Round trips: there, and back to the start by the next leg."""
    q, at = asked_and_places(spark, d)
    legs = q.select((F.col("query_id") * 2).alias("query_id"), "src", "dst").unionByName(q.select((F.col("query_id") * 2 + 1).alias("query_id"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = search.routes(legs, least_arcs(spark, d, at), at, "bidi_dijkstra", tile=TILE)
    return got.where("cost is not null").groupBy(F.floor(F.col("query_id") / 2).alias("query_id")).agg(r(F.sum("cost")).alias("cost"), F.count("*").alias("legs")).where("legs = 2")


@query(sql("SELECT f.query_id, round(min(f.cost + b.cost), 6) AS cost FROM dist f JOIN back b ON b.query_id = f.query_id AND b.node = f.node GROUP BY f.query_id", distances() + ", " + distances("(SELECT dst AS src, src AS dst, cost FROM best)", "SELECT query_id, dst AS src FROM requests").replace("dist", "back")))
def best_meeting_node(spark, d):
    """Two cost tables, from the starts and back from the ends, joined; the least sum."""
    q, at = asked_and_places(spark, d)
    best = least_arcs(spark, d, at).select("src", "dst", "cost")
    there = search.reach(q.select("query_id", F.col("src").alias("node")), best, at, TILE)
    back = search.reach(q.select("query_id", F.col("dst").alias("node")), best.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"), at, TILE)
    return there.join(back.withColumnRenamed("cost", "rest"), ["query_id", "node"]).groupBy("query_id").agg(r(F.min(F.col("cost") + F.col("rest"))).alias("cost"))


@query()
def route_anchors(spark, d):
    got, _, a = found(spark, d, "dijkstra")
    out = routes.anchors(routes.legs(got.where("cost is not null"), a))
    return rounded(out, "f_from", "f_to", "cost")


@query()
def search_log(spark, d):
    got, _, _ = found(spark, d, "bidi_astar")
    return got.select("query_id", F.posexplode("log").alias("step", "e")).select("query_id", "step", "e.closed", F.size("e.opened").alias("opened"), F.to_json("e").alias("entry"))


REGIONS = """placed AS (SELECT *, gx // 30 * 100 + gy // 30 AS region FROM nodes),
inside AS (SELECT b.* FROM best b JOIN placed x ON x.node_id = b.src JOIN placed y ON y.node_id = b.dst WHERE x.region = y.region),
asked AS (SELECT node_id AS query_id, node_id AS src, min(node_id) OVER (PARTITION BY region) AS dst FROM placed QUALIFY node_id % 50 = 0)"""


@query(sql("SELECT a.src, a.dst, round(d.cost, 6) AS cost FROM asked a LEFT JOIN dist d ON d.query_id = a.query_id AND d.node = a.dst", REGIONS + ", " + distances("inside", "SELECT query_id, src FROM asked")))
def path_table_function(spark, d):
    """Ways within regions, by a table function called from SQL, its paths opened by LATERAL."""
    tables.register(spark)
    at = graph.intersections(network.vertices(spark, d)).withColumn("region", F.floor(F.col("gx") / 30) * 100 + F.floor(F.col("gy") / 30))
    return spark.sql(
        """
        WITH inside AS (SELECT x.region, a.src, a.dst, a.cost FROM {arcs} a JOIN {nodes} x ON x.node_id = a.src JOIN {nodes} y ON y.node_id = a.dst AND y.region = x.region),
        least AS (SELECT region, min(node_id) AS dst FROM {nodes} GROUP BY region),
        asked AS (SELECT region, node_id AS src, dst, CAST(NULL AS DOUBLE) AS cost FROM {nodes} JOIN least USING (region) WHERE node_id % 50 = 0),
        found AS (SELECT * FROM shortest_path(TABLE(SELECT * FROM inside UNION ALL SELECT * FROM asked) PARTITION BY region)),
        steps AS (SELECT src, dst, cost, count(node) AS nodes FROM found, LATERAL explode_outer(path) AS p(node) GROUP BY src, dst, cost)
        SELECT src, dst, round(cost, 6) AS cost FROM steps WHERE (cost IS NULL) = (nodes = 0)
        """,
        arcs=graph.cheapest(arcs(spark, d)),
        nodes=checkpointed(at.select("node_id", "region")),
    )


SAVED = """rp AS (SELECT line_id AS hike_id, line_id, idx AS sort_order, fraction FROM he),
leg AS (SELECT *, lead(fraction) OVER (PARTITION BY hike_id ORDER BY sort_order) AS g FROM rp)"""


def route_points(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(F.col("line_id").alias("hike_id"), "line_id", F.col("idx").alias("sort_order"), "fraction")


@query(sql("SELECT hike_id, sort_order, line_id, round(fraction, 6) AS fraction, 'node' AS type FROM rp", SAVED))
def saved_route_rows(spark, d):
    return route_points(spark, d).select("hike_id", "sort_order", "line_id", r("fraction", 6).alias("fraction"), F.coalesce(F.lit(None).cast("string"), F.lit("node")).alias("type"))


@query(sql("SELECT e.line_id AS hike_id, round(max(m.cum_m) - min(m.cum_m), 4) AS metres FROM he e JOIN m ON m.line_id = e.line_id AND m.idx = e.idx GROUP BY 1"))
def saved_route_distance(spark, d):
    m = measured(spark, d)
    rp = graph.half_edges(m).select(F.col("line_id").alias("hike_id"), "line_id", F.col("idx").alias("sort_order"), "fraction")
    return routes.saved_distance(rp, m).select("hike_id", r("metres", 4).alias("metres"))


SPLITS = f"""sp AS (SELECT he.*, fraction + (forward_fraction - fraction) / 4 AS fa, fraction + (forward_fraction - fraction) * 3 / 4 AS fb FROM he WHERE forward_edge_id IS NOT NULL AND forward_fraction > fraction),
piece AS (SELECT edge_id, line_id, fraction AS f0, fa AS f1, node_id AS from_node, -2 AS to_node FROM sp UNION ALL SELECT edge_id, line_id, fa, fb, -2, -3 FROM sp UNION ALL SELECT edge_id, line_id, fb, forward_fraction, -3, forward_node_id FROM sp),
nx AS (SELECT *, lead(lat) OVER l AS nlat, lead(lng) OVER l AS nlng, lead(ele) OVER l AS nele, lead(fraction) OVER l AS nf FROM m WINDOW l AS (PARTITION BY line_id ORDER BY idx)),
cutp AS (SELECT p.edge_id, p.line_id, p.f0, p.f1, p.from_node, p.to_node, 0 AS part, idx, lat + t * (nlat - lat) AS lat, lng + t * (nlng - lng) AS lng, ele + t * (nele - ele) AS ele FROM (SELECT p.*, nx.idx, nx.lat, nx.lng, nx.ele, nlat, nlng, nele, (p.f0 - fraction) / (nf - fraction) AS t FROM piece p JOIN nx USING (line_id) WHERE fraction <= p.f0 AND nf > p.f0) p
  UNION ALL SELECT p.edge_id, line_id, p.f0, p.f1, p.from_node, p.to_node, 1, m.idx, lat, lng, ele FROM piece p JOIN m USING (line_id) WHERE fraction > p.f0 AND fraction < p.f1
  UNION ALL SELECT p.edge_id, p.line_id, p.f0, p.f1, p.from_node, p.to_node, 2, idx, lat + t * (nlat - lat), lng + t * (nlng - lng), ele + t * (nele - ele) FROM (SELECT p.*, nx.idx, nx.lat, nx.lng, nx.ele, nlat, nlng, nele, (p.f1 - fraction) / (nf - fraction) AS t FROM piece p JOIN nx USING (line_id) WHERE fraction < p.f1 AND nf >= p.f1) p)"""


@query(sql(f"""SELECT edge_id, line_id, from_node, to_node, round(coalesce(sum({hrs('ele - pele', 'run')}), 0), 6) AS forward_h, round(coalesce(sum({hrs('pele - ele', 'run')}), 0), 6) AS reverse_h FROM (
SELECT *, coalesce({hav('p', '')}, 0) AS run FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(ele) OVER w AS pele FROM cutp WINDOW w AS (PARTITION BY edge_id, f0 ORDER BY part, idx))) GROUP BY ALL""", SPLITS).replace("GROUP BY ALL", "GROUP BY edge_id, line_id, from_node, to_node, f0"))
def split_edge_costs(spark, d):
    """Every linked half-edge that has a length is cut at its quarters.

    Vertices lie by line from the first exchange on; written, they would have to be moved again.
    """
    m = measured(spark, d)
    e = graph.half_edges(m)
    own = e.where("forward_edge_id is not null and forward_fraction > fraction")
    width = F.col("forward_fraction") - F.col("fraction")
    snaps = own.select("line_id", F.explode(F.array(F.struct((F.col("fraction") + width / 4).alias("f"), F.lit(-2).cast("long").alias("i")), F.struct((F.col("fraction") + width * 3 / 4).alias("f"), F.lit(-3).cast("long").alias("i")))).alias("s"))
    got = routes.split_edges(e, m, snaps.select("line_id", F.col("s.f").alias("snap_fraction"), F.col("s.i").alias("virtual_id")))
    return got.select("edge_id", "line_id", "from_node", "to_node", r("forward_h").alias("forward_h"), r("reverse_h").alias("reverse_h"))


@query(sql("SELECT CAST(floor(min(lat)) AS BIGINT) AS south, CAST(floor(min(lng)) AS BIGINT) AS west, CAST(ceil(max(lat)) AS BIGINT) AS north, CAST(ceil(max(lng)) AS BIGINT) AS east FROM v"))
def map_extents(spark, d):
    return network.vertices(spark, d).agg(F.floor(F.min("lat")).alias("south"), F.floor(F.min("lng")).alias("west"), F.ceil(F.max("lat")).alias("north"), F.ceil(F.max("lng")).alias("east"))


@query(sql("SELECT q.cx, q.cy FROM quads q WHERE EXISTS (SELECT 1 FROM v WHERE v.gx // 10 = q.cx AND v.gy // 10 = q.cy)", QUADS))
def cells_with_lines(spark, d):
    return quads(spark).join(blocks(network.vertices(spark, d)).select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")


@query("""SELECT event_id, (CASE WHEN a >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(a) AS VARCHAR), 2, '0') || (CASE WHEN b >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(b) AS VARCHAR), 3, '0') AS tile
FROM (SELECT event_id, CAST(floor(event_id * 37 % 1200 / 10e0 - 60) AS BIGINT) AS a, CAST(floor(event_id * 91 % 3600 / 10e0 - 180) AS BIGINT) AS b FROM events)""")
def tile_names(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", geo.tile_name(e * 37 % 1200 / 10.0 - 60, e * 91 % 3600 / 10.0 - 180).alias("tile"))


def tiles(spark: SparkSession) -> DataFrame:
    return raster.plane(spark.sql("SELECT 39 AS tile_lat, t AS tile_lng FROM VALUES (-110), (-109) AS t(t)"), DIM)


@query(sql("SELECT point_id, round(3 * 36 * (1 - (lat - 39)) + 5 * 36 * (lng + 110), 6) AS ele FROM points"))
def elevation_point(spark, d):
    return raster.elevations(network.points(spark, d), tiles(spark), DIM).select("point_id", r("ele").alias("ele"))


@query(sql("SELECT p.tile, count(*) AS points, round(avg(p.ele), 4) AS mean, round(min(p.ele), 6) AS low, round(max(p.ele), 6) AS high FROM (SELECT printf('N%02dW%03d', CAST(floor(lat) AS BIGINT), CAST(-floor(lng) AS BIGINT)) AS tile, 3 * 36 * (1 - (lat - floor(lat))) + 5 * 36 * (lng - floor(lng)) AS ele FROM (SELECT 39 + event_id * 7 % 8900 / 6000e0 AS lat, -110 + event_id % 9700 / 7000e0 AS lng FROM events)) p GROUP BY tile"))
def elevation_from_files(spark, d):
    """Elevations of all events' places, from the tile files that the places name."""
    e = F.col("event_id")
    at = table(spark, d, "events").select(e.alias("point_id"), (39 + (e * 7) % 8900 / 6000.0).alias("lat"), (-110 + e % 9700 / 7000.0).alias("lng"))
    path = new_path(spark, "tiles")
    cells = at.select(F.floor("lat").cast("int").alias("tile_lat"), F.floor("lng").cast("int").alias("tile_lng")).distinct()
    raster.written(raster.plane(cells, DIM), path, DIM).collect()  # a row a tile
    got = raster.elevations_in_files(at, path, DIM)
    return got.groupBy(geo.tile_name(F.col("lat"), F.col("lng")).alias("tile")).agg(F.count("*").alias("points"), r(F.avg("ele"), 4).alias("mean"), r(F.min("ele")).alias("low"), r(F.max("ele")).alias("high"))


@query(sql(f"""SELECT line_id, round(coalesce(sum({hrs('ele - pele', 'run')}), 0), 6) AS forward_h, round(coalesce(sum({hrs('pele - ele', 'run')}), 0), 6) AS reverse_h, sum(lacked)::BIGINT AS lacked FROM (
SELECT *, coalesce({hav('p', '')}, 0) AS run FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(ele) OVER w AS pele FROM told WINDOW w AS (PARTITION BY line_id ORDER BY idx))) GROUP BY line_id""",
"""told AS (SELECT line_id, idx, lat, lng, CASE WHEN gone THEN 108 * (1 - (lat - floor(lat))) + 180 * (lng - floor(lng)) ELSE ele END AS ele, gone::INT AS lacked FROM (
SELECT *, (line_id + idx) % 3 = 0 OR (line_id + idx) % 7 = 3 AS gone FROM v))"""))
def filled_line_times(spark, d):
    """Times of all lines; the elevations that a third of the vertices (-1) and a seventh (null) lack come from tile files."""
    at = F.col("line_id") + F.col("idx")
    v = network.vertices(spark, d).withColumn("ele", F.when(at % 3 == 0, -1.0).when(at % 7 != 3, F.col("ele"))).withColumn("lacked", ((at % 3 == 0) | (at % 7 == 3)).cast("int"))
    v, path = checkpointed(v), new_path(spark, "tiles")
    cells = v.select(F.floor("lat").cast("int").alias("tile_lat"), F.floor("lng").cast("int").alias("tile_lng")).distinct()
    raster.written(raster.plane(cells, DIM), path, DIM).collect()  # a row a tile
    m = lines.segments(raster.filled(v, path, DIM))
    return m.groupBy("line_id").agg(r(F.sum("fwd_h")).alias("forward_h"), r(F.sum("rev_h")).alias("reverse_h"), F.sum("lacked").alias("lacked"))


#: Tasks that a tile's patches are dealt to in `elevation_patches`.
PATCH_PARTS = 4


@query("""SELECT event_id AS request_id, count(*) AS samples, min(3 * r + 5 * c)::BIGINT AS low, max(3 * r + 5 * c)::BIGINT AS high, sum(3 * r + 5 * c)::BIGINT AS total
FROM (SELECT event_id, event_id % 37 + a AS r, event_id * 7 % 37 + b AS c FROM events, range(-2, 3) x(a), range(-2, 3) y(b))
WHERE r BETWEEN 0 AND 36 AND c BETWEEN 0 AND 36 GROUP BY event_id""")
def elevation_patches(spark, d):
    """Samples around a place in one of six tiles for every event, by a table function over tile files, opened by LATERAL."""
    tables.register(spark)
    e = F.col("event_id")
    asked = table(spark, d, "events").select(
        (39 + e % 3).cast("int").alias("tile_lat"), (-110 + e % 2).cast("int").alias("tile_lng"), F.pmod(F.xxhash64(e), F.lit(PATCH_PARTS)).cast("int").alias("part"),
        e.cast("long").alias("request_id"), (e % DIM).cast("int").alias("row"), (e * 7 % DIM).cast("int").alias("col"),
    )
    path = new_path(spark, "tiles")
    cells = asked.select("tile_lat", "tile_lng").distinct()
    made = [w.tile for w in raster.written(raster.plane(cells, DIM), path, DIM).collect()]  # a row a tile
    files = raster.tile_files(spark, path, made).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PATCH_PARTS - 1))))
    return spark.sql(
        """
        WITH given AS (
          SELECT tile_lat, tile_lng, part, content, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS INT) AS row, CAST(NULL AS INT) AS col FROM {files}
          UNION ALL SELECT tile_lat, tile_lng, part, CAST(NULL AS BINARY), request_id, row, col FROM {asked})
        SELECT request_id, count(v) AS samples, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high, sum(v) AS total
        FROM elevation_patch(TABLE(SELECT * FROM given), 2), LATERAL explode(ele) AS s(v) GROUP BY request_id
        """,
        files=files,
        asked=asked,
    )


WINDOWED = """SELECT q AS request_id, i, j, max(3 * (36 - (gy - 219 * 36)) + 5 * CASE WHEN gx > 71 * 36 THEN gx - 71 * 36 WHEN gx = 71 * 36 THEN 36 ELSE gx - 70 * 36 END) AS ele FROM (
  SELECT q, i, j, {gy} + i AS gy, {gx} + j AS gx FROM (SELECT CAST(c_custkey AS BIGINT) AS q FROM customer) a, range(0, {size} + 1) b(i), range(0, {size} + 1) c(j))
WHERE gy BETWEEN 219 * 36 AND 220 * 36 AND gx BETWEEN 70 * 36 AND 72 * 36 GROUP BY ALL"""


def with_centers(spark: SparkSession, d: str, at: dict[str, Column], size: int) -> DataFrame:
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id")).select(F.col("id").alias("request_id"), *(v.alias(k) for k, v in at.items()))
    return raster.window(tiles(spark), asked, size, DIM).select("request_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("ele").cast("long").alias("ele"), r("center").alias("center"))


def centered(cells: str) -> str:
    return f"""WITH g AS ({cells}), c AS (SELECT request_id, i - a AS i, j - b AS j, count(*) AS n, avg(ele) AS m FROM g, range(2) x(a), range(2) y(b) GROUP BY ALL HAVING count(*) = 4)
SELECT g.request_id, CAST(g.i AS BIGINT) AS i, CAST(g.j AS BIGINT) AS j, CAST(g.ele AS BIGINT) AS ele, round(c.m, 6) AS center FROM g LEFT JOIN c USING (request_id, i, j)"""


@query(centered(WINDOWED.format(gy="(CAST(floor((39.5 + q % 3 / 10e0 + 180) * 36) AS BIGINT) - 4)", gx="(CAST(floor((-109.5 + q % 3 / 4e0 + 180) * 36) AS BIGINT) - 4)", size=8)))
def elevation_area(spark, d):
    q = F.col("id") % 3
    return with_centers(spark, d, raster.around(39.5 + q / 10.0, -109.5 + q / 4.0, 8, DIM), 8)


@query(centered(WINDOWED.format(gy="985 * 8", gx="(315 + q % 3 * 4) * 8", size=8)))
def elevation_tile(spark, d):
    return with_centers(spark, d, raster.tile_window(315 + F.col("id") % 3 * 4, F.lit(985), 9), 8)


@query("SELECT event_id, round(40 - event_id % 37 / 36e0, 6) AS lat, round(-110 + event_id * 7 % 37 / 36e0, 6) AS lng FROM events")
def raster_cell_to_latlng(spark, d):
    e = F.col("event_id")
    lat, lng = raster.cell_position(e % 37, e * 7 % 37, F.lit(39), F.lit(-110), DIM)
    return table(spark, d, "events").select("event_id", r(lat).alias("lat"), r(lng).alias("lng"))


@query("""SELECT area, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END)::BIGINT AS enqueued, sum(CASE WHEN kind = -1 THEN 1 ELSE 0 END)::BIGINT AS cancelled, (arg_max(run, rn) - least(0, min(run)))::BIGINT AS waiting FROM (
SELECT area, kind, sum(kind) OVER w AS run, row_number() OVER w AS rn FROM (SELECT event_id, ts, user_id % 25 AS area, CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END AS kind FROM events WHERE event_type IN ('signup', 'view', 'error'))
WINDOW w AS (PARTITION BY area ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) GROUP BY area""")
def request_queue_state(spark, d):
    return stream.queue_state(stream.as_events(table(spark, d, "events")))


@query("SELECT name, sum(n)::BIGINT AS events FROM (SELECT unnest(CASE WHEN event_type = 'error' THEN ['genRequestRemoved'] ELSE ['updatingRoutes', 'routesUpdated'] END) AS name, 1 AS n FROM events WHERE event_type IN ('signup', 'view', 'error')) GROUP BY name")
def status_event_counts(spark, d):
    return stream.status_counts(stream.as_events(table(spark, d, "events")))


@query(r"""SELECT n, nullif(regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 1), '') AS key, CASE WHEN regexp_matches(line, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=') THEN regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 2) END AS value
FROM (SELECT o_orderkey AS n, CASE o_custkey % 4 WHEN 0 THEN '# ' || o_orderpriority WHEN 1 THEN '  KEY_' || o_orderkey || ' = ' || o_orderpriority || '  ' WHEN 2 THEN o_orderstatus || '=' || o_orderpriority ELSE o_orderpriority END AS line FROM orders)""")
def config_parse(spark, d):
    """Settings lines made of the orders: comments, spaced and tight ones, and lines without a sign."""
    kind, text = F.col("o_custkey") % 4, F.col("o_orderpriority")
    spaced = F.concat(F.lit("  KEY_"), F.col("o_orderkey").cast("string"), F.lit(" = "), text, F.lit("  "))
    line = F.when(kind == 0, F.concat(F.lit("# "), text)).when(kind == 1, spaced).when(kind == 2, F.concat("o_orderstatus", F.lit("="), text)).otherwise(text)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), line.alias("line"))
    return rows.select("n", *(v.alias(k) for k, v in config.parsed_columns(F.col("line")).items()))


@query(sql("SELECT CAST(floor(lng * 8) AS BIGINT) AS tile_x, CAST(floor(lat * 8) AS BIGINT) AS tile_y, count(*) AS nodes, min(node_id) AS first_node FROM (SELECT node_id, 39 + gy / 1000e0 AS lat, -110 + gx / 1000e0 AS lng FROM nodes) GROUP BY ALL"))
def tile_nodes(spark, d):
    at = network.placed(graph.intersections(network.vertices(spark, d)))
    return at.groupBy(F.floor(F.col("lng") * 8).alias("tile_x"), F.floor(F.col("lat") * 8).alias("tile_y")).agg(F.count("*").alias("nodes"), F.min("node_id").alias("first_node"))


@query(sql(f"SELECT point_id FROM points WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lng BETWEEN {BOX[1]} AND {BOX[3]}"))
def points_in_bounds(spark, d):
    return network.points(spark, d).where(F.col("lat").between(BOX[0], BOX[2]) & F.col("lng").between(BOX[1], BOX[3])).select("point_id")


@query(sql("SELECT line_id, count(*) AS points, min(CASE WHEN idx = 1 THEN gx * 1000 + gy END) AS first_point, min(CASE WHEN idx = n THEN gx * 1000 + gy END) AS last_point FROM v GROUP BY line_id"))
def vertex_dump_first_last(spark, d):
    v = network.vertices(spark, d)
    key = graph.node_key()
    dumped = v.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("idx", key.alias("k")))).alias("a"))
    return dumped.select("line_id", F.size("a").cast("long").alias("points"), F.element_at("a", 1)["k"].alias("first_point"), F.element_at("a", -1)["k"].alias("last_point"))


TWO = "SELECT edge_id, 39 + node_id % 1000 / 1000e0 AS alat, -110 + node_id // 1000 / 1000e0 AS alng, 39 + forward_node_id % 1000 / 1000e0 AS blat, -110 + forward_node_id // 1000 / 1000e0 AS blng FROM he WHERE forward_edge_id IS NOT NULL"


def two_ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every linked half-edge and the metres between them."""
    linked = edges(spark, d).where("forward_edge_id is not null")
    at = {f"{p}{c}": v for p, n in (("a", "node_id"), ("b", "forward_node_id")) for c, v in (("lat", 39 + F.col(n) % 1000 / 1000.0), ("lng", -110 + F.floor(F.col(n) / 1000) / 1000.0))}
    return linked.withColumns(at).withColumn("m", geo.haversine(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng")))


@query(sql(f"SELECT edge_id, round({hav('a', 'b')} / 6000, 6) AS bound_h FROM ({TWO})"))
def straight_line_heuristic(spark, d):
    return two_ends(spark, d).select("edge_id", r(F.col("m") / 6000).alias("bound_h"))


@query(sql(f"SELECT edge_id, round(CASE WHEN m > 0 THEN m / (6000 * pow(2.71828, -3.5 * 0.05)) ELSE 0 END, 6) AS flat_h FROM (SELECT edge_id, {hav('a', 'b')} AS m FROM ({TWO}))"))
def straight_line_flat_time(spark, d):
    return two_ends(spark, d).select("edge_id", r(geo.hours(F.lit(0.0), F.col("m"))).alias("flat_h"))


@query("SELECT event_id, round(event_id % 16 / 16e0 * 360 - 180, 6) AS lng, round(degrees(atan((exp(pi() * (1 - user_id % 16 / 8e0)) - exp(-pi() * (1 - user_id % 16 / 8e0))) / 2)), 6) AS lat FROM events")
def slippy_tile_corner(spark, d):
    xy = table(spark, d, "events").select("event_id", (F.col("event_id") % 16).alias("x"), (F.col("user_id") % 16).alias("y"))
    lng, lat = geo.slippy_corner(F.col("x"), F.col("y"), 4)
    return xy.select("event_id", r(lng).alias("lng"), r(lat).alias("lat"))


@query(sql("SELECT line_id, round(min(lat), 6) AS south, round(min(lng), 6) AS west, round(max(lat), 6) AS north, round(max(lng), 6) AS east, CAST(floor(min(lat)) AS BIGINT) AS cell_lat, CAST(floor(min(lng)) AS BIGINT) AS cell_lng FROM v GROUP BY line_id"))
def line_extents(spark, d):
    e = network.vertices(spark, d).groupBy("line_id").agg(F.min("lat").alias("s"), F.min("lng").alias("w"), F.max("lat").alias("n"), F.max("lng").alias("e"))
    return e.select("line_id", r("s").alias("south"), r("w").alias("west"), r("n").alias("north"), r("e").alias("east"), F.floor("s").alias("cell_lat"), F.floor("w").alias("cell_lng"))


CLIP = (39.0205, -109.9695, 39.0505, -109.9295)
CLIPPED = f"""edge AS (SELECT line_id, idx, plng AS x0, plat AS y0, lng - plng AS dx, lat - plat AS dy FROM s WHERE plat IS NOT NULL),
cl AS (SELECT line_id, idx, greatest(0, CASE WHEN dx > 0 THEN ({CLIP[1]} - x0) / dx WHEN dx < 0 THEN ({CLIP[3]} - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN ({CLIP[0]} - y0) / dy WHEN dy < 0 THEN ({CLIP[2]} - y0) / dy ELSE 0 END) AS t0,
  least(1, CASE WHEN dx > 0 THEN ({CLIP[3]} - x0) / dx WHEN dx < 0 THEN ({CLIP[1]} - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ({CLIP[2]} - y0) / dy WHEN dy < 0 THEN ({CLIP[0]} - y0) / dy ELSE 1 END) AS t1
  FROM edge WHERE (dx <> 0 OR x0 BETWEEN {CLIP[1]} AND {CLIP[3]}) AND (dy <> 0 OR y0 BETWEEN {CLIP[0]} AND {CLIP[2]}))"""


@query(sql("SELECT line_id, idx, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM cl WHERE t0 <= t1", CLIPPED))
def clip_line_to_box(spark, d):
    return lines.clip(lines.segments(network.vertices(spark, d)), *CLIP).select("line_id", "idx", r("t0").alias("t0"), r("t1").alias("t1"))
