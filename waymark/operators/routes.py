"""Virtual nodes, preferences, anchors and saved routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.asof import last_before
from waymark.operators.lines import part_sums


def split_edges(edges: DataFrame, measured: DataFrame, snaps: DataFrame) -> DataFrame:
    """Half-edges cut at snapped places (line_id, snap_fraction, virtual_id < 0).

    Break points of an edge are its start, the places strictly inside and its end;
    consecutive ones are new arcs, each with the costs of its own part of the line. Places
    that coincide are joined by parts of no length and no cost.
    Gives edge_id, line_id, from_node, to_node, f0, f1, forward_h, reverse_h.
    """
    whole = edges.where(F.col("forward_edge_id").isNotNull())
    e = whole.select("line_id", "edge_id", F.col("fraction").alias("f"), F.struct("edge_id", "node_id", "forward_node_id", "fraction", "forward_fraction").alias("e"))
    placed = snaps.select("line_id", F.col("snap_fraction").alias("f"), "virtual_id", F.lit(True).alias("strict"))
    hit = last_before(placed, e, "line_id", "f", "e", "edge_id").where(F.col("f") < F.col("e.forward_fraction"))
    place = lambda f, node: F.struct(F.col(f).alias("f"), F.col(node).alias("node"))
    broken = F.array(place("f", "virtual_id"), place("e.fraction", "e.node_id"), place("e.forward_fraction", "e.forward_node_id"))
    points = hit.select("line_id", "e.edge_id", F.explode(broken).alias("p")).select("line_id", "edge_id", "p.*").distinct()
    w = Window.partitionBy("line_id", "edge_id").orderBy("f", "node")
    points = points.withColumns({"f1": F.lead("f").over(w), "to_node": F.lead("node").over(w)})
    parts = points.where(F.col("f1").isNotNull()).select("line_id", "edge_id", F.col("f").alias("f0"), "f1", F.col("node").alias("from_node"), "to_node")
    return part_sums(measured, parts).select("edge_id", "line_id", "from_node", "to_node", "f0", "f1", "forward_h", "reverse_h")


def overridden(arcs: DataFrame, split: DataFrame) -> DataFrame:
    """Arcs with those of split edges replaced by both directions of their parts."""
    kept = arcs.select("line_id", "edge_id", "src", "dst", "cost", "f0", "f1")
    way = lambda *cs: F.struct(*(F.col(c).alias(n) for c, n in zip(cs, ("src", "dst", "cost", "f0", "f1"))))
    both = F.array(way("from_node", "to_node", "forward_h", "f0", "f1"), way("to_node", "from_node", "reverse_h", "f1", "f0"))
    made = split.select("line_id", "edge_id", F.explode(both).alias("a")).select("line_id", "edge_id", "a.*")
    every = kept.withColumn("__s", F.lit(0)).unionByName(made.withColumn("__s", F.lit(1)))
    # a window by line and edge instead of a join: what lies by line is not moved
    own = F.max("__s").over(Window.partitionBy("line_id", "edge_id"))
    return every.withColumn("__m", own).where("__s = __m").drop("__s", "__m")


def with_preference(arcs: DataFrame, lines: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Arcs of preferred lines (line_id), or of unordered node pairs (a, b), cost nothing."""
    flag = F.lit(False)
    if lines is not None:
        arcs = arcs.join(lines.select("line_id", F.lit(True).alias("__l")).distinct(), "line_id", "left")
        flag = flag | F.coalesce("__l", F.lit(False))
    if pairs is not None:
        key = pairs.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"), F.lit(True).alias("__p")).distinct()
        arcs = arcs.join(key, (F.least("src", "dst") == F.col("__a")) & (F.greatest("src", "dst") == F.col("__b")), "left")
        flag = flag | F.coalesce("__p", F.lit(False))
    out = arcs.withColumn("preferred", flag)
    return out.withColumn("cost", F.when(F.col("preferred"), F.lit(0.0)).otherwise(F.col("cost"))).drop("__l", "__p", "__a", "__b")


def least_rows(arcs: DataFrame) -> DataFrame:
    """src, dst and cost, line_id, f0, f1 of the cheapest arc of each pair; of equal ones that with the least line and fractions."""
    return arcs.groupBy("src", "dst").agg(F.min(F.struct("cost", "line_id", "f0", "f1")).alias("a")).select("src", "dst", "a.*")


def legs(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """query_id, leg (from 0), src, dst and the cheapest arc's line and fractions of each step of a path."""
    steps = paths.select("query_id", F.posexplode(F.expr("transform(sequence(1, greatest(size(path) - 1, 1)), i -> struct(get(path, i - 1) as src, get(path, i) as dst))")).alias("leg", "s")).where("s.dst is not null")
    return steps.select("query_id", "leg", "s.src", "s.dst").join(least_rows(arcs), ["src", "dst"]).select("query_id", "leg", "src", "dst", "line_id", "f0", "f1", "cost")


def anchors(legs_: DataFrame) -> DataFrame:
    """Legs compacted: an island per run of one line in one direction.

    query_id, seq, line_id, from_node, to_node, f_from, f_to, legs, cost, kind.
    """
    w = Window.partitionBy("query_id").orderBy("leg")
    way = F.signum(F.col("f1") - F.col("f0"))
    moved = legs_.where(F.col("src") != F.col("dst")).withColumn("way", way)
    new = (F.col("line_id") != F.lag("line_id").over(w)) | (F.col("way") != F.lag("way").over(w))
    island = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = moved.withColumn("seq", island).groupBy("query_id", "seq").agg(
        F.first("line_id").alias("line_id"),
        F.min_by("src", "leg").alias("from_node"),
        F.max_by("dst", "leg").alias("to_node"),
        F.min_by("f0", "leg").alias("f_from"),
        F.max_by("f1", "leg").alias("f_to"),
        F.count("*").alias("legs"),
        F.sum("cost").alias("cost"),
    )
    last = F.max("seq").over(Window.partitionBy("query_id"))
    return out.withColumn("kind", F.when(F.col("seq") == 1, "start").when(F.col("seq") == last, "end"))


def anchors_json(anchors_: DataFrame) -> DataFrame:
    """query_id, seq and the anchor as JSON: unset type and neighbours are left out."""
    w = Window.partitionBy("query_id").orderBy("seq")
    shown = anchors_.withColumns({"type": F.col("kind"), "prev": F.lag("line_id").over(w), "next": F.lead("line_id").over(w)})
    return shown.select("query_id", "seq", F.to_json(F.struct("type", "line_id", "from_node", "to_node", "f_from", "f_to", "legs", "cost", "prev", "next")).alias("anchor"))


def gaps(legs_: DataFrame) -> DataFrame:
    """query_id, leg of legs that do not start where the one before ends: none in a valid route."""
    w = Window.partitionBy("query_id").orderBy("leg")
    return legs_.withColumn("before", F.lag("dst").over(w)).where("before <> src").select("query_id", "leg")


def saved_distance(route_points: DataFrame, measured: DataFrame, mode: str = "full") -> DataFrame:
    """hike_id, metres of saved routes: points (hike_id, sort_order, line_id, fraction).

    Consecutive points are joined by the part of the line between them. `full` measures
    all of it; `literal` measures interior vertices and then hops from the last of them
    to the next point, and counts nothing for a part without interior vertices. Both come
    from running sums, whatever the number of vertices.
    """
    w = Window.partitionBy("hike_id").orderBy("sort_order")
    nxt = route_points.withColumns({"g": F.lead("fraction").over(w), "other": F.lead("line_id").over(w)}).where("g is not null and line_id = other")
    parts = nxt.where("g <> fraction").select("line_id", "hike_id", "sort_order", F.least("fraction", "g").alias("f0"), F.greatest("fraction", "g").alias("f1"), (F.col("g") < F.col("fraction")).alias("back"))
    sums = part_sums(measured, parts)
    if mode == "full":
        per = sums.select("hike_id", "metres")
    elif mode == "literal":
        hop = F.when(F.col("back"), F.col("head_metres")).otherwise(F.col("tail_metres"))
        per = sums.where("inner > 0").select("hike_id", (F.col("mid_metres") + hop).alias("metres"))
    else:
        raise ValueError(f"unknown mode {mode}")
    sums = per.groupBy("hike_id").agg(F.sum("metres").alias("metres"))
    return route_points.select("hike_id").distinct().join(sums, "hike_id", "left").withColumn("metres", F.coalesce("metres", F.lit(0.0)))
