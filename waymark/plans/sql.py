"""SQL of the derived network, shared by the oracle queries: a chain of CTEs."""

HOURS = "CASE WHEN {run} > 0 THEN {run} / greatest(6000 * pow(2.71828, -3.5 * abs(({rise}) / {run} + 0.05)), 500) ELSE 0 END"
HAVERSINE = (
    "2 * 6378137e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
    "+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2)))"
)


def hav(a: str, b: str) -> str:
    """Metres between points whose columns have prefixes a and b."""
    return HAVERSINE.format(lat1=f"{a}lat", lng1=f"{a}lng", lat2=f"{b}lat", lng2=f"{b}lng")


def hrs(rise: str, run: str) -> str:
    return HOURS.format(rise=rise, run=run)


NETWORK = f"""
vraw AS (SELECT l_orderkey AS line_id, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2),
vidx AS (SELECT line_id, pk, row_number() OVER (PARTITION BY line_id ORDER BY l_linenumber) AS idx, count(*) OVER (PARTITION BY line_id) AS n FROM vraw),
vgrid AS (SELECT line_id, idx, n,
  (line_id * 31) % 97 + CAST(sum(CASE WHEN idx > 1 AND pk % 2 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gx,
  (line_id * 17) % 89 + CAST(sum(CASE WHEN idx > 1 AND pk % 2 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gy
  FROM vidx WINDOW w AS (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
v AS MATERIALIZED (SELECT *, 6378137e0 * radians(lng) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM (
  SELECT line_id, idx, n, gx, gy, 39 + gy / 1000e0 AS lat, -110 + gx / 1000e0 AS lng, CAST(1000 + 2 * ((gx * gx + 3 * gy) % 37) AS DOUBLE) AS ele FROM vgrid WHERE n >= 2)),
s0 AS (SELECT *, lag(x) OVER l AS px, lag(y) OVER l AS py, lag(lat) OVER l AS plat, lag(lng) OVER l AS plng, lag(ele) OVER l AS pele
  FROM v WINDOW l AS (PARTITION BY line_id ORDER BY idx)),
s1 AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS len_merc, coalesce({hav('p', '')}, 0) AS len_m FROM s0),
s AS (SELECT *, {hrs('ele - pele', 'len_m')} AS fwd_h, {hrs('pele - ele', 'len_m')} AS rev_h FROM s1),
m0 AS (SELECT *, sum(len_merc) OVER c AS cum_merc, sum(len_m) OVER c AS cum_m, sum(fwd_h) OVER c AS cum_fwd, sum(rev_h) OVER c AS cum_rev,
  sum(len_merc) OVER (PARTITION BY line_id) AS total_merc FROM s WINDOW c AS (PARTITION BY line_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
m AS MATERIALIZED (SELECT *, CASE WHEN idx = n THEN 1 WHEN total_merc > 0 THEN cum_merc / total_merc ELSE 0 END AS fraction FROM m0),
nodes AS MATERIALIZED (SELECT gx, gy, gx * 1000 + gy AS node_id, count(*) AS uses, count(DISTINCT line_id) AS lines,
  max(CASE WHEN idx = 1 OR idx = n THEN 1 ELSE 0 END) AS is_end FROM v GROUP BY gx, gy
  HAVING count(*) > 1 OR max(CASE WHEN idx = 1 OR idx = n THEN 1 ELSE 0 END) = 1),
he AS MATERIALIZED (SELECT line_id * 1000 + idx AS edge_id, node_id, line_id, idx, fraction, cum_fwd, cum_rev,
  lead(line_id * 1000 + idx) OVER l AS forward_edge_id, lag(line_id * 1000 + idx) OVER l AS reverse_edge_id,
  lead(cum_fwd) OVER l - cum_fwd AS forward_cost, cum_rev - lag(cum_rev) OVER l AS reverse_cost,
  lead(node_id) OVER l AS forward_node_id, lead(fraction) OVER l AS forward_fraction, lead(cum_rev) OVER l - cum_rev AS back_cost
  FROM m JOIN nodes USING (gx, gy) WINDOW l AS (PARTITION BY line_id ORDER BY idx)),
arcs AS (SELECT line_id, edge_id, node_id AS src, forward_node_id AS dst, forward_cost AS cost, fraction AS f0, forward_fraction AS f1
  FROM he WHERE forward_edge_id IS NOT NULL AND node_id <> forward_node_id
  UNION ALL SELECT line_id, edge_id, forward_node_id, node_id, back_cost, forward_fraction, fraction
  FROM he WHERE forward_edge_id IS NOT NULL AND node_id <> forward_node_id),
best AS MATERIALIZED (SELECT src, dst, min(cost) AS cost FROM arcs GROUP BY src, dst),
attrs AS (SELECT o_orderkey AS line_id, p_name AS name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'path' WHEN '2' THEN 'footway' WHEN '3' THEN 'track' WHEN '4' THEN CASE WHEN o_custkey % 2 = 0 THEN 'residential' ELSE 'bridleway' END WHEN '5' THEN 'steps' END AS highway,
  CASE o_orderstatus WHEN 'F' THEN 'designated' WHEN 'O' THEN 'yes' ELSE 'no' END AS foot, c_mktsegment AS surface
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1) f ON o_orderkey = l_orderkey
  JOIN part USING (p_partkey) LEFT JOIN customer ON o_custkey = c_custkey),
points AS (SELECT *, 6378137e0 * radians(lng) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM (
  SELECT event_id AS point_id, 39 + event_id * 7 % 8900 / 100000e0 AS lat, -110 + event_id % 9700 / 100000e0 AS lng FROM events)),
requests AS MATERIALIZED (SELECT a.node_id AS query_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON b.node_id = (a.gx * 37 + 11) % 97 * 1000 + (a.gy * 29 + 7) % 89 WHERE a.node_id % 50 = 0)
"""


def sql(body: str, extra: str = "") -> str:
    """A query over the network; `extra` are more CTEs."""
    return f"WITH RECURSIVE {NETWORK.strip()}{', ' + extra.strip() if extra else ''}\n{body.strip()}"


def distances(arcs: str = "best", seeds: str = "SELECT query_id, src FROM requests") -> str:
    """Least costs from the seeds, by recursion with a key."""
    return f"""
dist(query_id, node, cost) USING KEY (query_id, node) AS (
  SELECT query_id, src, 0e0 FROM ({seeds})
  UNION
  SELECT d.query_id, a.dst, min(d.cost + a.cost) FROM dist d JOIN {arcs} a ON a.src = d.node
  LEFT JOIN recurring.dist r ON r.query_id = d.query_id AND r.node = a.dst
  WHERE r.cost IS NULL OR d.cost + a.cost < r.cost GROUP BY d.query_id, a.dst)
"""
