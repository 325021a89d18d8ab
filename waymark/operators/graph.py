"""From measured vertices to nodes, half-edges and arcs; diffs and edits of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.sources.versions import checkpointed

#: Up to this index, vertices of a line have ids line_id * LINE_SPAN + idx; nodes of gy below it gx * LINE_SPAN + gy.
LINE_SPAN = 1000
#: Ids of later vertices start here, LONG_SPAN to a line.
LONG_BASE, LONG_SPAN = 1 << 62, 1 << 24
#: Largest gx and gy, either sign, of other nodes: degrees of longitude and latitude x 1e7. Their ids are far below virtual ones.
MOST_GX, MOST_GY = 1_800_000_000, 900_000_000


def by_line() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("idx")


def edge_key() -> Column:
    """An id of (line_id, idx) that no other vertex has; raises outside its range."""
    line, idx = F.col("line_id").cast("long"), F.col("idx").cast("long")
    short = line.between(0, LONG_BASE // LINE_SPAN - 1) & idx.between(0, LINE_SPAN - 1)
    long = line.between(0, (1 << 37) - 1) & idx.between(LINE_SPAN, LONG_SPAN - 1)
    error = F.raise_error(F.lit("no edge id for this line_id and idx")).cast("long")
    key = F.when(short, line * LINE_SPAN + idx).when(long, F.lit(LONG_BASE) + line * LONG_SPAN + idx).otherwise(error)
    return F.when(line.isNotNull() & idx.isNotNull(), key)


def node_key(gx: str = "gx", gy: str = "gy") -> Column:
    """An id of (gx, gy) that no other point has; raises outside its range."""
    x, y = F.col(gx).cast("long"), F.col(gy).cast("long")
    short = x.between(0, LONG_BASE // LINE_SPAN - 1) & y.between(0, LINE_SPAN - 1)
    wide = x.between(-MOST_GX, MOST_GX) & y.between(-MOST_GY, MOST_GY)
    error = F.raise_error(F.lit("no node id for this gx and gy")).cast("long")
    key = F.when(short, x * LINE_SPAN + y).when(wide, F.lit(-(1 << 63)) + (x + MOST_GX) * (2 * MOST_GY + 1) + (y + MOST_GY)).otherwise(error)
    return F.when(x.isNotNull() & y.isNotNull(), key)


def intersections(vertices: DataFrame) -> DataFrame:
    """Point keys that two vertices share or where a line ends, with their incidences.

    A line counts at its first vertex on a point, which needs no exchange where vertices lie
    by line; counts combine before the exchange by point.
    """
    first = F.row_number().over(Window.partitionBy("line_id", "gx", "gy").orderBy("idx")) == 1
    vertices = vertices.select("gx", "gy", "idx", "n", (first & F.col("line_id").isNotNull()).cast("long").alias("first"))
    ends = F.max(F.when((F.col("idx") == 1) | (F.col("idx") == F.col("n")), 1).otherwise(0))
    grouped = vertices.groupBy("gx", "gy").agg(F.count("*").alias("uses"), F.sum("first").alias("lines"), ends.alias("is_end"))
    return grouped.where((F.col("uses") > 1) | (F.col("is_end") == 1)).withColumn("node_id", node_key())


def half_edges(measured: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per node incidence, linked along its line, with costs to both neighbours.

    `nodes` (node_id, gx, gy) are those of `measured` alone unless given; they are written
    first, so that the join knows their size and does not move the vertices to few nodes.
    """
    nodes = (checkpointed(intersections(measured).select("node_id", "gx", "gy")) if nodes is None else nodes).select("node_id", "gx", "gy")
    on = measured.join(nodes, ["gx", "gy"])
    edge = edge_key().alias("edge_id")
    on = on.select(edge, "node_id", "line_id", F.col("idx").alias("idx"), "fraction", "cum_fwd", "cum_rev")
    return on.withColumns(
        {
            "forward_edge_id": F.lead("edge_id").over(by_line()),
            "reverse_edge_id": F.lag("edge_id").over(by_line()),
            "forward_cost": F.lead("cum_fwd").over(by_line()) - F.col("cum_fwd"),
            "reverse_cost": F.col("cum_rev") - F.lag("cum_rev").over(by_line()),
            "forward_node_id": F.lead("node_id").over(by_line()),
            "forward_fraction": F.lead("fraction").over(by_line()),
            "back_cost": F.lead("cum_rev").over(by_line()) - F.col("cum_rev"),
        }
    )


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each linked pair; loops are dropped, parallel arcs stay."""
    linked = edges.where(F.col("forward_edge_id").isNotNull() & (F.col("node_id") != F.col("forward_node_id")))
    there = F.struct(F.col("node_id").alias("src"), F.col("forward_node_id").alias("dst"), F.col("forward_cost").alias("cost"), F.col("fraction").alias("f0"), F.col("forward_fraction").alias("f1"))
    back = F.struct(F.col("forward_node_id").alias("src"), F.col("node_id").alias("dst"), F.col("back_cost").alias("cost"), F.col("forward_fraction").alias("f0"), F.col("fraction").alias("f1"))
    return linked.select("line_id", F.col("edge_id"), F.explode(F.array(there, back)).alias("a")).select("line_id", "edge_id", "a.*")


def cheapest(arcs_: DataFrame) -> DataFrame:
    return arcs_.groupBy("src", "dst").agg(F.min("cost").alias("cost"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, op (insert, update, delete, keep) of two keyed tables; null-safe comparison."""
    a = old.select(*keys, F.struct(*values).alias("old"))
    b = new.select(*keys, F.struct(*values).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return a.join(b, keys, "full_outer").withColumn("op", op)


def apply_diff(changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The new table of a diff: inserts and updates taken, deletes left out."""
    return changes.where("op <> 'delete'").select(*keys, *(F.col(f"new.{v}").alias(v) for v in values))


def updated(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`table` with values of `updates` where it has a row of the key."""
    marked = updates.select(key, F.lit(True).alias("__u"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(marked, key, "left")
    return out.select(*(F.when(F.col("__u"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of their keys; the others stay."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def edges_between(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The half-edges at node_id on line_id that lead to other_id, for rows (node_id, line_id, other_id).

    Both directions of a line are met by one equi-join: each link is listed at both of its ends.
    """
    linked = edges.where("forward_edge_id is not null")
    there = F.struct(F.col("node_id"), F.col("forward_node_id").alias("other_id"), F.col("edge_id"))
    back = F.struct(F.col("forward_node_id").alias("node_id"), F.col("node_id").alias("other_id"), F.col("forward_edge_id").alias("edge_id"))
    ends = linked.select("line_id", F.explode(F.array(there, back)).alias("e")).select("line_id", "e.*")
    return asked.select("node_id", "line_id", "other_id").distinct().join(ends, ["node_id", "line_id", "other_id"])


def incidences(edges: DataFrame) -> DataFrame:
    """node_id and its distinct incidences (line_id, idx, fraction), sorted."""
    return edges.groupBy("node_id").agg(F.array_sort(F.collect_set(F.struct("line_id", "idx", "fraction"))).alias("incidences"))
