"""Searches over tiles against plain ones; as-of joins and costs of parts against products; round trips."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.api import Finder
from waymark.operators import graph, lines, routes, search, snap
from waymark.operators.asof import last_before
from waymark.operators.overlay import Overlay
from waymark.plans import queries
from waymark.sources import network

from .test_network import floyd

SF = "/root/testdata/sf0.001"


def placed_graph(seed, n=60):
    """Nodes on a 4 x 4 square of unit tiles (some nowhere), arcs mostly between near ones; some cost nothing."""
    rng = random.Random(seed)
    at = [(rng.uniform(0, 4), rng.uniform(0, 4)) if rng.random() > 0.05 else None for _ in range(n)]
    arcs = []
    for a in range(n):
        for b in range(n):
            d = 1.0 if at[a] is None or at[b] is None else ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
            if a != b and rng.random() < (0.35 if d < 1 else 0.01):
                arcs.append((a, b, 0.0 if rng.random() < 0.15 else round(rng.uniform(0.5, 2) * d, 3)))
    return n, at, arcs


@pytest.mark.parametrize(("seed", "algorithm"), [(1, "dijkstra"), (2, "bidi_dijkstra"), (3, "bidi_dijkstra")])
def test_overlay_equals_plain_costs(spark, seed, algorithm):
    n, at, arcs = placed_graph(seed)
    want, least = floyd(n, arcs), {}
    for a, b, c in arcs:
        least[a, b] = min(least.get((a, b), 9e9), c)
    rng = random.Random(seed)
    asked = [(i, rng.randrange(n), rng.randrange(n)) for i in range(60)] + [(60, 3, 3), (61, None, 1), (62, 1, 999), (63, 999, 999), (64, 0, 7), (65, 0, 7)]
    df = spark.createDataFrame(arcs, "src long, dst long, cost double")
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(at) if p], "node_id long, lat double, lng double")
    overlay = Overlay(df, nodes, 1.0)
    assert overlay.tiles.select("tile").distinct().count() > 8
    got = {r.query_id: r for r in overlay.routes(spark.createDataFrame(asked, "query_id long, src long, dst long"), algorithm).collect()}
    assert len(got) == len(asked)
    for q, a, b in asked:
        if a is None or a != b and (b >= n or np.isinf(want[a, b])):
            assert got[q].cost is None and got[q].path == [] and got[q].log == []
        else:
            path = got[q].path
            assert path[0] == a and path[-1] == b and got[q].cost == pytest.approx(0 if a == b else want[a, b])
            assert sum(least[x] for x in zip(path, path[1:])) == pytest.approx(got[q].cost)
    assert any(r.log for r in got.values())
    sources = [(0, 0), (1, 17), (2, 17), (3, 999)]
    reached = {(r.query_id, r.node): r.cost for r in overlay.reach(spark.createDataFrame(sources, "query_id long, node long")).collect()}
    plain = {(q, b): want[s, b] for q, s in sources if s < n for b in range(n) if np.isfinite(want[s, b])} | {(3, 999): 0.0}
    own = {k: v for k, v in plain.items() if k[0] == 3 or any(k[1] in a[:2] for a in arcs)}
    assert reached == pytest.approx(own)


def test_negative_costs_raise(spark):
    with pytest.raises(Exception, match="negative"):
        Overlay(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, cost double"))


def test_an_empty_graph(spark):
    overlay = Overlay(spark.createDataFrame([], "src long, dst long, cost double"))
    got = overlay.routes(spark.createDataFrame([(0, 1, 2), (1, 5, 5)], "query_id long, src long, dst long")).collect()
    assert {(r.query_id, r.cost, tuple(r.path)) for r in got} == {(0, None, ()), (1, 0.0, (5,))}


@pytest.mark.parametrize("hot_rows", [10**9, 20, 3])
def test_last_before_is_the_plain_as_of(spark, hot_rows):
    rng = random.Random(3)
    rows = [(k, round(rng.random() ** 2, 2), i) for i, k in enumerate([1] * 150 + [2] * 10 + [3])]
    places = [(rng.randrange(6), round(rng.random(), 2), rng.random() < 0.5, i) for i in range(300)] + [(1, 0.0, False, 300), (1, 1.0, True, 301), (None, 0.5, False, 302)]
    right = spark.createDataFrame(rows, "k long, p double, t long").withColumn("e", F.struct("p", "t"))
    left = spark.createDataFrame(places, "k long, p double, strict boolean, i long")
    got = {r.i: r.e and r.e.t for r in last_before(left, right, "k", "p", "e", "t", hot_rows).collect()}
    for k, p, strict, i in places:
        own = [(q, t) for kk, q, t in rows if kk == k and (q < p or q == p and not strict)]
        assert got[i] == (max(own)[1] if own else None)
    assert len(got) == len(places)


def test_as_of_on_a_line_of_a_million_half_edges(spark):
    n = 1_000_000
    e = spark.range(n).select(F.lit(7).cast("long").alias("line_id"), F.col("id").alias("edge_id"), F.col("id").alias("node_id"), (F.col("id") / n).alias("fraction"), (F.col("id") + 1).alias("forward_edge_id"), (F.col("id") + 1).alias("forward_node_id"), ((F.col("id") + 1) / n).alias("forward_fraction"))
    at = spark.range(1000).select(F.col("id").alias("point_id"), F.lit(7).cast("long").alias("line_id"), ((F.col("id") * 977 + 0.5) / n).alias("snap_fraction"))
    got = snap.bracketed(at, e).where(F.col("edge_id") == F.col("point_id") * 977)
    assert got.count() == 1000


def test_costs_of_parts_equal_those_of_their_points(spark):
    m = lines.measured(network.vertices(spark, SF).where("line_id < 300"))
    rng = random.Random(5)
    parts = [(line, f0, f1, i) for i, (line, f0, f1) in enumerate((rng.randrange(300), *sorted((rng.choice([0.0, 0.25, rng.random()]), rng.choice([1.0, rng.random()])))) for _ in range(300)) if f0 < f1]
    cuts = spark.createDataFrame(parts, "line_id long, f0 double, f1 double, i long")
    keys = ["line_id", "i"]
    want = {(r.line_id, r.i): (r.metres, r.forward_h, r.reverse_h, r.points) for r in lines.cost_of(lines.substring(m, cuts), keys).collect()}
    got = {(r.line_id, r.i): (r.metres, r.forward_h, r.reverse_h, r.inner + 2) for r in lines.part_sums(m, cuts).join(m.select("line_id").distinct(), "line_id").collect()}
    assert set(got) == set(want) and len(want) > 50
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    none = lines.part_sums(m, spark.createDataFrame([(1, 0.5, 0.5)], "line_id long, f0 double, f1 double")).first()
    assert (none.metres, none.forward_h, none.reverse_h) == (0.0, 0.0, 0.0)


def test_long_segments_have_few_rows(spark):
    """A segment of 1,000 km, one of 30 km and many short ones: all found, none listed often."""
    own = [(1, 1, 2, 0.0, 0.0), (1, 2, 2, 700_000.0, 714_000.0), (2, 1, 2, 300_000.0, 250_000.0), (2, 2, 2, 330_000.0, 250_100.0)]
    own += [(10 + i, j + 1, 2, 500_000.0 + 40 * i + 10 * j, 400_000.0 + 25 * i) for i in range(50) for j in range(2)]
    v = spark.createDataFrame(own, "line_id long, idx long, n long, x double, y double").withColumns({c: F.lit(0.0) for c in ("lat", "lng", "ele")})
    m = lines.measured(v)
    rows = snap.listed(snap.with_level(m.where("px is not null")), snap.BLOCK).groupBy("line_id", "idx").count()
    assert rows.agg(F.max("count")).first()[0] <= 6
    rng = random.Random(1)
    at = [(i, rng.uniform(-9e4, 8e5), rng.uniform(-9e4, 8e5)) for i in range(40)] + [(100 + i, 500_000.0 + rng.uniform(-500, 2500), 400_000.0 + rng.uniform(-500, 1500)) for i in range(40)]
    points = spark.createDataFrame(at, "point_id long, x double, y double")
    by = {}
    for line_id, idx, _, x, y in own:
        by.setdefault(line_id, []).append((x, y))

    def far(p, q, a, b):
        (x0, y0), (x1, y1) = a, b
        t = min(1, max(0, ((p - x0) * (x1 - x0) + (q - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
        return ((p - x0 - t * (x1 - x0)) ** 2 + (q - y0 - t * (y1 - y0)) ** 2) ** 0.5

    for k in (1, 3):
        got = {}
        for r in snap.nearest(points, m, k).collect():
            got.setdefault(r.point_id, []).append((r.rank, r.line_id, r.dist_merc))
        for i, p, q in at:
            want = sorted((round(far(p, q, *s), 4), line) for line, s in by.items())[:k]
            assert [(d, x) for _, x, d in sorted(got[i])] == [(pytest.approx(d, abs=2e-4), x) for d, x in want]


@pytest.fixture(scope="module")
def line(spark):
    rows = [(1, i + 1, 4, 10 * i, 0, 39.0, -110.0 + 0.01 * i, 1000.0 + 5 * i) for i in range(4)] + [(2, i + 1, 2, 500 + i, 9, 39.5, -109.5 + 0.01 * i, 1000.0) for i in range(2)]
    v = spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long, lat double, lng double, ele double")
    from waymark.functions.geo import mercator_x, mercator_y

    v = v.withColumns({"x": mercator_x(F.col("lng")), "y": mercator_y(F.col("lat"))})
    return Finder(spark, v, spark.createDataFrame([(1, "a"), (2, "b")], "line_id long, name string"))


A, B, C = (39.0, -109.995), (39.0, -109.978), (39.5, -109.495)


def test_round_trips_keep_all_legs(line):
    got = line.find_route([A, B, A]).orderBy("query_id", "seq").collect()
    there, back = got
    assert (there.query_id, back.query_id) == (0, 1) and there.from_node == back.to_node and there.to_node == back.from_node
    assert there.cost > 0 and back.cost > 0 and there.cost != pytest.approx(back.cost)  # up, then down
    assert there.f_from == pytest.approx(back.f_to) and [r.error for r in got] == [None, None]


def test_equal_points_unreached_points_and_errors(line):
    got = line.find_route([A, A, C, C, B]).orderBy("query_id").collect()
    assert [(r.query_id, r.cost, r.error, r.legs) for r in got] == [(0, 0.0, None, 0), (1, None, "no way", 0), (2, 0.0, None, 0), (3, None, "no way", 0)]


def test_coinciding_places_are_joined(line):
    at = line.spark.createDataFrame([(1, 0.5, -2), (1, 0.5, -3), (1, 0.75, -4)], "line_id long, snap_fraction double, virtual_id long")
    parts = routes.split_edges(line.edges, line.measured, at).collect()
    assert {(r.from_node, r.to_node) for r in parts if r.f0 == r.f1} == {(-3, -2)} and len(parts) == 4
    arcs = routes.overridden(line.spark.createDataFrame([], "line_id long, edge_id long, src long, dst long, cost double, f0 double, f1 double"), routes.split_edges(line.edges, line.measured, at))
    got = search.routes(line.spark.createDataFrame([(0, -2, -3), (1, -2, -4), (2, -3, -4)], "query_id long, src long, dst long"), arcs, algorithm="dijkstra").collect()
    costs = {r.query_id: r.cost for r in got}
    assert costs[0] == 0 and costs[1] == costs[2] > 0


def test_updates_keep_one_another(line):
    line.samples = line.spark.createDataFrame([], "tile_lat int, tile_lng int, row int, col int, ele int")
    before = line.nodes.count()
    line.update_nav_node_elevations()
    line.update_route_elevations()
    assert line.nodes.where("ele is null").count() == before  # no tile: the update of the nodes still stands


def test_places_are_searched_once_and_shared_segments_listed_once(spark):
    # 40 lines on one segment, 3 further away; 50 points at each of two places
    rows = [(i, j + 1, 2, 111.0 * j, 0.0) for i in range(40) for j in (0, 1)] + [(i, j + 1, 2, 111.0 * j, 60.0) for i in range(40, 43) for j in (0, 1)]
    v = spark.createDataFrame(rows, "line_id long, idx long, n long, x double, y double").withColumns({c: F.lit(0.0) for c in ("lat", "lng", "ele")})
    m = lines.measured(v)
    least = {r.y: [x.line_id for x in r.lines] for r in snap.least_lines(m, 5).collect()}
    assert {k: sorted(x) for k, x in least.items()} == {0.0: [0, 1, 2, 3, 4], 60.0: [40, 41, 42]}
    points = spark.createDataFrame([(i, 10.0, 20.0 if i % 2 else 55.0) for i in range(100)], "point_id long, x double, y double")
    got: dict = {}
    for r in snap.nearest(points, m, 5).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.line_id, r.dist_merc))
    near = [(i + 1, i, 20.0) for i in range(5)]
    far = [(i + 1, 40 + i, 5.0) for i in range(3)] + [(4, 0, 55.0), (5, 1, 55.0)]
    assert {k: sorted(x) for k, x in got.items()} == {i: near if i % 2 else far for i in range(100)}


def test_splits_of_lines_that_lie_by_line_move_nothing(spark):
    rows = [(i, j + 1, 3, 10 * i + j, 0, 39.0, -110 + 0.001 * (10 * i + j), 1000.0 + j, 111.0 * (10 * i + j), 0.0) for i in range(20) for j in range(3)]
    v = spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long, lat double, lng double, ele double, x double, y double")
    m = lines.measured(network.by_line(v, 2))
    e = graph.half_edges(m)
    middle = ((F.col("fraction") + F.col("forward_fraction")) / 2).alias("snap_fraction")
    snaps = e.where("forward_edge_id is not null").select("line_id", middle, (-2 - F.col("edge_id")).alias("virtual_id"))
    out = routes.overridden(graph.arcs(e), routes.split_edges(e, m, snaps)).groupBy("line_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    want = {r.line_id: r.cost for r in graph.arcs(e).groupBy("line_id").agg(F.sum("cost").alias("cost")).collect()}
    assert {r.line_id: (r.n, round(r.cost, 5)) for r in out.collect()} == {k: (4, round(c, 5)) for k, c in want.items()}


def test_many_items_are_not_merged_into_few_tasks(spark):
    v = network.by_line(spark.range(5000).withColumnRenamed("id", "line_id"), 100)
    assert v.groupBy("line_id").count().rdd.getNumPartitions() == 50


def line_exchanges(df):
    """Origin of each exchange by line alone in a plan, as it is before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\((?:line_id|l_orderkey)#\d+L?, \d+\), (\w+)", plan)


@pytest.mark.parametrize("name", ["intersection_self_join", "substring_cost", "intersections", "saved_route_distance"])
def test_lines_of_a_query_lie_by_number_of_items(spark, monkeypatch, name):
    monkeypatch.setattr(network, "by_line", functools.partial(network.by_line, rows=100))
    moved = line_exchanges(queries.QUERIES[name](spark, SF))
    assert moved and set(moved) == {"REPARTITION_BY_NUM"}


@pytest.mark.parametrize("name", ["shortest_path_astar", "shortest_path_bidi_astar", "shortest_path_bidi_dijkstra", "shortest_path_dijkstra"])
def test_lines_of_a_route_query_lie_by_number_of_items(spark, monkeypatch, name):
    monkeypatch.setattr(network, "by_line", functools.partial(network.by_line, rows=100))
    write, written = queries.checkpointed, []
    monkeypatch.setattr(queries, "checkpointed", lambda df: written.append(df) or write(df))
    searched = []
    monkeypatch.setattr(search, "routes", lambda q, *rest: searched.append(rest) or q.select("query_id", F.lit(0.0).alias("cost")))
    queries.QUERIES[name](spark, SF)
    moved = [m for df in written for m in line_exchanges(df)]
    assert moved and set(moved) == {"REPARTITION_BY_NUM"}
    assert [r[2] for r in searched] == [name.removeprefix("shortest_path_")]


def test_a_line_that_meets_itself_counts_once_at_a_point(spark):
    rows = [(1, i + 1, 3, x, 0) for i, x in enumerate((0, 1, 0))] + [(2, i + 1, 2, x, 0) for i, x in enumerate((0, 5))]
    got = graph.intersections(spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long"))
    assert {r.gx: (r.uses, r.lines) for r in got.collect()} == {0: (3, 2), 5: (1, 1)}


def test_routes_are_searched_on_the_cheapest_arc_of_each_pair(spark):
    _, at = queries.asked_and_places(spark, SF)
    every = queries.arcs(spark, SF).select("src", "dst", "cost", "line_id", "f0", "f1").collect()
    for prefer in (False, True):
        want = {}
        for a in every:
            row = (0.0 if prefer and a.line_id % 11 == 0 else a.cost, a.line_id, a.f0, a.f1)
            want[a.src, a.dst] = min(row, want.get((a.src, a.dst), row))
        got = queries.least_arcs(spark, SF, at, prefer).collect()
        assert len(got) == len(want) < len(every)
        assert {(a.src, a.dst): (a.cost, a.line_id, a.f0, a.f1) for a in got} == want
