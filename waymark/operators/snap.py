"""Nearest lines to points, and the half-edges that bracket a place on a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import planar, position
from waymark.operators.asof import last_before
from waymark.sources.versions import checkpointed, dropped

#: Side of the least grid blocks in Mercator units; blocks of the next level are four times as wide.
BLOCK = 150.0


def least_lines(segments: DataFrame, k: int) -> DataFrame:
    """px, py, x, y, len_merc, lines: the distinct segments, each with its k least lines.

    Lines that share a segment are equally far from every point, so of each distinct
    segment only the k least line ids (line_id, idx, cum_merc, total_merc) can be among the
    k nearest lines of any point. All but k a segment and task are left out before the exchange.
    """
    ends = ["px", "py", "x", "y"]
    once = segments.where(F.col("px").isNotNull()).groupBy(*ends, "line_id").agg(F.min(F.struct("idx", "len_merc", "cum_merc", "total_merc")).alias("s"))
    place = F.row_number().over(Window.partitionBy(*ends).orderBy("line_id"))
    kept = once.withColumn("__k", place).where(F.col("__k") <= k)
    return kept.groupBy(*ends).agg(F.min("s.len_merc").alias("len_merc"), F.collect_list(F.struct("line_id", "s.idx", "s.cum_merc", "s.total_merc")).alias("lines"))


def _blocks(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def with_level(segments: DataFrame, block: float = BLOCK) -> DataFrame:
    """Adds `level`: blocks of side block x 4^level are as long as the segment, or longer."""
    return segments.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("len_merc"), F.lit(block)) / block) / F.log(F.lit(4.0)))).cast("int"))


def listed(segments: DataFrame, reach: float, block: float = BLOCK) -> DataFrame:
    """Segments (with `level`) by the blocks that they may touch: four or so, however long they are.

    A block's side is that of the segment's level, and not below `reach`.
    """
    size = F.greatest(F.lit(float(reach)), F.lit(block) * F.pow(F.lit(4.0), F.col("level")))
    by_x = segments.withColumn("size", size).withColumn("bx", F.explode(_blocks(F.least("px", "x"), F.greatest("px", "x"), F.col("size"))))
    return by_x.withColumn("by", F.explode(_blocks(F.least("py", "y"), F.greatest("py", "y"), F.col("size"))))


def candidates(places: DataFrame, segments: DataFrame, reach: float, levels: list[int], block: float = BLOCK) -> DataFrame:
    """Rounded distances (d) of places (x, y) to the segments in reach: an equi-join on blocks of every level.

    Complete within `reach`, or within `most` where places have that column and it is less. A place looks at one neighbourhood for each of `levels`, the distinct
    levels of the segments.
    """
    more = [c for c in places.columns if c == "most"]
    own = F.least(F.lit(float(reach)), F.lit(float(reach)), *(F.col(c) + 0.001 for c in more))  # distances are rounded to 4 decimals
    sizes = sorted({max(float(reach), block * 4.0**v) for v in levels})
    near = places.select(F.col("x").alias("qx"), F.col("y").alias("qy"), *more, own.alias("reach")).withColumn("size", F.explode(F.array(*(F.lit(v) for v in sizes)).cast("array<double>")))
    for axis in "xy":
        near = near.withColumn(f"b{axis}", F.explode(_blocks(F.col(f"q{axis}") - F.col("reach"), F.col(f"q{axis}") + F.col("reach"), F.col("size"))))
    kept = listed(segments, reach, block)
    met = near.join(kept, ["size", "bx", "by"]).withColumn("t", position(*(F.col(c) for c in ("qx", "qy", "px", "py", "x", "y"))))
    spot = {"sx": F.col("px") + F.col("t") * (F.col("x") - F.col("px")), "sy": F.col("py") + F.col("t") * (F.col("y") - F.col("py"))}
    return met.withColumns(spot).withColumn("d", F.round(planar(F.col("qx"), F.col("qy"), F.col("sx"), F.col("sy")), 4))


def nearest(points: DataFrame, segments: DataFrame, k: int = 1, block: float = BLOCK) -> DataFrame:
    """The k nearest lines of each point, ties by line id; each line once, at its closest place.

    Of fewer than k lines, all. Points at one place are searched once. The nearest of the
    segments that k lines share bounds a place's search: it is an aggregate (combined
    before the exchange) over distances alone, and lines are opened only within it. Segments
    are listed in blocks of about their own length, so a long one has no more rows than a
    short one. Places whose k-th line is not within reach are searched again four times as
    far, until the reach holds all segments, so no point is too far from the network. Each
    round is written before the next reads it.
    """
    kept = checkpointed(with_level(least_lines(segments, k), block))
    levels, side = [r.level for r in kept.select("level").distinct().collect()], block  # some 15 for all lengths on Earth
    corners = [f(c) for f, own in ((F.min, ("px", "x")), (F.max, ("px", "x")), (F.min, ("py", "y")), (F.max, ("py", "y"))) for c in own]
    box = kept.agg(*corners).first()
    place, per_place = ["qx", "qy"], Window.partitionBy("qx", "qy")
    shared = kept.where(F.size("lines") >= k).drop("lines")
    out, rest = None, checkpointed(points.select("x", "y").distinct())
    while True:
        # no segment beyond the nearest one of k lines counts; a place without such a one takes all
        dealt = rest.repartition("x", "y")
        bound = candidates(dealt, shared, block, levels, side).groupBy(*place).agg(F.min("d").alias("most"))
        bounded = dealt.join(bound.select(F.col("qx").alias("x"), F.col("qy").alias("y"), "most"), ["x", "y"], "left")
        met = candidates(bounded, kept, block, levels, side).where(F.col("most").isNull() | (F.col("d") <= F.col("most")))
        met = met.select(*place, "d", "t", "sx", "sy", "len_merc", F.explode("lines").alias("l"))
        along = F.when(F.col("l.total_merc") > 0, (F.col("l.cum_merc") - F.col("len_merc") + F.col("t") * F.col("len_merc")) / F.col("l.total_merc")).otherwise(F.lit(0.0))
        best = met.groupBy(*place, F.col("l.line_id").alias("line_id")).agg(F.min(F.struct("d", F.col("l.idx").alias("idx"), along.alias("snap_fraction"), "sx", "sy")).alias("b"))
        ranked = best.withColumn("rank", F.row_number().over(per_place.orderBy("b.d", "line_id"))).where(F.col("rank") <= k)
        ranked = ranked.select(*place, "line_id", F.col("b.d").alias("dist_merc"), "b.snap_fraction", "b.sx", "b.sy", "rank")
        if box[0] is None:
            break
        ranked = checkpointed(ranked.withColumn("of", F.struct(F.max("dist_merc").over(per_place).alias("far"), F.count("*").over(per_place).alias("found"))))
        sure = (F.col("of.found") == k) & (F.col("of.far") <= block)
        settled = ranked.where(sure).select(F.col("qx").alias("x"), F.col("qy").alias("y")).distinct()
        left = checkpointed(rest.join(settled, ["x", "y"], "left_anti"))
        x0, x1, y0, y1 = min(box[0], box[1]), max(box[2], box[3]), min(box[4], box[5]), max(box[6], box[7])
        span = left.agg(F.max(F.greatest(F.abs(F.col("x") - x0), F.abs(F.col("x") - x1), F.abs(F.col("y") - y0), F.abs(F.col("y") - y1)))).first()[0]
        last = span is None or block >= span
        done = (ranked if last else ranked.where(sure)).drop("of")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rest, block = left, block * 4
    found = ranked if out is None else out
    own = points.select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    return own.join(found, place).select("point_id", "line_id", "dist_merc", "snap_fraction", "sx", "sy", "rank")


def bracketed(snapped: DataFrame, edges: DataFrame) -> DataFrame:
    """As-of join: the half-edge at or before each snapped fraction of its line, and the one after.

    One sort of places and half-edges together (`asof`); a line of any length is spread.
    Only half-edges of lines that have a place take part.
    """
    keys = snapped.columns
    lines = checkpointed(snapped.select("line_id").distinct())
    edges = edges.join(lines, "line_id", "left_semi")
    e = edges.select("line_id", F.col("fraction").alias("__f"), "edge_id", F.struct("fraction", "edge_id", "node_id", "forward_edge_id", "forward_node_id", "forward_fraction").alias("e"))
    got = last_before(snapped.withColumn("__f", F.col("snap_fraction") + 1e-9), e, "line_id", "__f", "e", "edge_id")
    return got.select(*keys, "e.edge_id", "e.node_id", F.col("e.fraction").alias("edge_fraction"), "e.forward_edge_id", "e.forward_node_id")
