"""Searches, diffs, rasters, text queries, queues, versions and calls of the service."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.api import Finder
from waymark.operators import catalog, graph, routes, search, snap
from waymark.operators.lines import measured
from waymark.sources import config, network, raster
from waymark.sources.versions import Versions
from waymark.streaming import requests as stream

SF = "/root/testdata/sf0.001"


def random_graph(seed):
    rng = random.Random(seed)
    n = 40
    arcs = [(rng.randrange(n), rng.randrange(n), round(rng.uniform(0.1, 3), 3)) for _ in range(130)]
    return n, [a for a in arcs if a[0] != a[1]]


def floyd(n, arcs):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, c in arcs:
        d[a, b] = min(d[a, b], c)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d


@pytest.mark.parametrize("algorithm", sorted(search.ALGORITHMS))
def test_searches_are_exact(algorithm):
    for seed in range(6):
        n, arcs = random_graph(seed)
        want = floyd(n, arcs)
        g = search.Graph(*(np.array(x) for x in zip(*arcs)))
        least = {}
        for a, b, c in arcs:
            least[a, b] = min(least.get((a, b), 9e9), c)
        for a in range(0, n, 3):
            for b in range(n):
                cost, path = search.ALGORITHMS[algorithm](g, a, b, [])
                if np.isinf(want[a, b]):
                    assert cost is None and path == []
                else:
                    assert cost == pytest.approx(want[a, b]) and path[0] == a and path[-1] == b
                    assert sum(least[x] for x in zip(path, path[1:])) == pytest.approx(cost)


def test_frontier_equals_heap_search(spark):
    n, arcs = random_graph(3)
    want = floyd(n, arcs)
    df = spark.createDataFrame(arcs, "src long, dst long, cost double")
    sources = spark.createDataFrame([(0, 0), (1, 5)], "query_id long, node long")
    for got in (search.frontier(sources, df).collect(), search.reach(sources, df).collect()):
        for r in got:
            assert r.cost == pytest.approx(want[(0, 5)[r.query_id], r.node])
        assert len(got) == int(np.isfinite(want[[0, 5]]).sum())


def test_routes_without_places_keep_their_paths(spark):
    n, arcs = random_graph(3)
    want, least = floyd(n, arcs), {}
    for a, b, c in arcs:
        least[a, b] = min(least.get((a, b), 9e9), c)
    asked = [(0, 0, 7), (1, 0, 0), (2, 5, 12), (3, None, 4), (4, 0, 99)]
    df = spark.createDataFrame(arcs, "src long, dst long, cost double")
    found = search.routes(spark.createDataFrame(asked, "query_id long, src long, dst long"), df)
    got = {r.query_id: r for r in found.select("query_id", "cost", "path").collect()}
    for q, a, b in asked:
        if a is None or b >= n or np.isinf(want[a, b]):
            assert got[q].cost is None and got[q].path == []
        else:
            path = got[q].path
            assert path[0] == a and path[-1] == b and got[q].cost == pytest.approx(want[a, b])
            assert sum(least[x] for x in zip(path, path[1:])) == pytest.approx(want[a, b])
    assert all(bool(r.log) == (r.cost is not None and r.cost > 0) for r in found.collect())  # one tile: one search a request
    with pytest.raises(RuntimeError, match="still fall"):
        search.frontier(spark.createDataFrame([(0, 0)], "query_id long, node long"), df, max_rounds=1)


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError, match="unknown"):
        search.routes(spark.range(1), spark.range(1), algorithm="none")


def test_diff_of_equal_graphs_is_empty_and_applies(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id long, v double")
    b = spark.createDataFrame([(1, 2.0), (2, 5.0), (4, 1.0)], "id long, v double")
    assert {r.op for r in graph.diff(a, a, ["id"], ["v"]).collect()} == {"keep"}
    changes = graph.diff(a, b, ["id"], ["v"])
    assert {r.id: r.op for r in changes.collect()} == {1: "keep", 2: "update", 3: "delete", 4: "insert"}
    assert sorted(map(tuple, graph.apply_diff(changes, ["id"], ["v"]).collect())) == sorted(map(tuple, b.collect()))


def test_ids_of_long_lines_and_wide_grids_are_distinct(spark):
    places = [(1, 999), (1, 1000), (1, 1001), (2, 1), (2, 0), (0, 2001), (17000, 5_000_000)]
    got = [r[0] for r in spark.createDataFrame(places, "line_id long, idx long").select(graph.edge_key()).collect()]
    assert len(set(got)) == len(places) and got[0] == 1999 and got[3] == 2001
    points = [(3, 4), (2, 1004), (3, -996), (-1, 7), (4, -996), (-1_100_000_000, 390_000_000), (-1_100_000_001, 390_000_000), (1_800_000_000, 900_000_000), (-1_800_000_000, -900_000_000)]
    got = [r[0] for r in spark.createDataFrame(points, "gx long, gy long").select(graph.node_key()).collect()]
    assert len(set(got)) == len(points) and got[0] == 3004 and all(k > 0 or k < -(1 << 60) for k in got)
    for key, row, names in ((graph.edge_key, (1, 1 << 24), "line_id long, idx long"), (graph.node_key, (1 << 40, 1000), "gx long, gy long")):
        with pytest.raises(Exception, match="no (edge|node) id"):
            spark.createDataFrame([row], names).select(key()).collect()


def test_updates_take_nulls(spark):
    t = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double")
    got = graph.updated(t, spark.createDataFrame([(1, None)], "id long, v double"), "id", ["v"])
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, 3.0)]


def test_snap_equals_brute_force(spark):
    m = measured(network.vertices(spark, SF)).where("line_id % 40 = 0").cache()
    points = network.points(spark, SF).where("point_id < 25").cache()
    got = {r.point_id: r for r in snap.nearest(points, m).collect()}
    pairs = points.select("point_id", F.col("x").alias("qx"), F.col("y").alias("qy")).collect()
    segs = [r for r in m.collect() if r.px is not None]
    for p in pairs:
        best = min((round(distance(p.qx, p.qy, s), 4), s.line_id) for s in segs)
        assert (got[p.point_id].dist_merc, got[p.point_id].line_id) == (pytest.approx(best[0], abs=2e-4), best[1])


def distance(x, y, s):
    dx, dy = s.x - s.px, s.y - s.py
    t = min(max(((x - s.px) * dx + (y - s.py) * dy) / (dx * dx + dy * dy), 0), 1)
    return float(np.hypot(x - s.px - t * dx, y - s.py - t * dy))


def test_anchors_join_runs(spark):
    legs = spark.createDataFrame([(1, 0, 1, 2, 7, 0.0, 0.5, 1.0), (1, 1, 2, 3, 7, 0.5, 1.0, 1.0), (1, 2, 3, 4, 8, 0.2, 0.1, 1.0), (1, 3, 4, 3, 8, 0.1, 0.2, 1.0)], "query_id long, leg int, src long, dst long, line_id long, f0 double, f1 double, cost double")
    got = routes.anchors(legs).orderBy("seq").collect()
    assert [(r.line_id, r.from_node, r.to_node, r.legs, r.kind) for r in got] == [(7, 1, 3, 2, "start"), (8, 3, 4, 1, None), (8, 4, 3, 1, "end")]


def test_tiles_are_read_and_interpolated(spark, tmp_path):
    dim = 37
    row, col = np.mgrid[0:dim, 0:dim]
    grid = (3 * row + 5 * col).astype(">i2")
    grid[20, 20] = raster.VOID
    grid[0, 0] = -5
    (tmp_path / "N39W110.hgt").write_bytes(grid.tobytes())
    (tmp_path / "notes.hgt").write_bytes(b"")
    samples = raster.samples(spark, f"file://{tmp_path}", dim)
    assert samples.count() == dim * dim and samples.where("ele is null").count() == 1 and samples.where("row = 0 and col = 0").first().ele == -5
    points = spark.createDataFrame([(1, 39.31, -109.93), (2, 39.0, -109.0 - 1e-9), (3, 50.0, 0.0), (4, 40 - 20.2 / 36, -110 + 19.6 / 36)], "point_id long, lat double, lng double")
    got = {r.point_id: r.ele for r in raster.elevations(points, samples, dim).collect()}
    assert got[1] == pytest.approx(3 * 36 * 0.69 + 5 * 36 * 0.07) and got[2] == pytest.approx(3 * 36 + 5 * 36, abs=1e-3) and got[3] is None and got[4] is None
    assert raster.elevations(points.where("point_id = 3"), samples, dim, 0.0).first().ele == 0.0
    with pytest.raises(ValueError):
        raster.decode(b"123", dim)


@pytest.mark.parametrize(
    ("query", "names"),
    [
        ("lake", {"Lake Trail", "The Lakes"}),
        ("lake & trail", {"Lake Trail"}),
        ("lake & !trail", {"The Lakes"}),
        ("trail <-> lake", set()),
        ("lake <-> trail", {"Lake Trail"}),
        ("(pine | oak) & rid:*", {"Pine Ridges"}),
        ("hiking", {"Hiked Way"}),
    ],
)
def test_text_queries(spark, query, names):
    df = spark.createDataFrame(list(enumerate(("Lake Trail", "The Lakes", "Pine Ridges", "Hiked Way", None))), "line_id long, name string")
    assert {r.name for r in catalog.search(df, query, walk_only=False).collect()} == names


@pytest.mark.parametrize("query", ["", "a &", "(a", "a b", "?"])
def test_bad_text_queries(spark, query):
    index = spark.createDataFrame([], "term string, key long, position int")
    with pytest.raises(ValueError):
        catalog.matching(index, index, query)


def request_file(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, kind string, area long")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


def test_a_cancel_of_a_later_file_takes_out_an_earlier_request(spark, tmp_path):
    source, done, told = str(tmp_path / "in"), [], []

    def build(_, area, report, cancelled):
        if area == 3:
            raise RuntimeError("no such area")
        if area == 5:  # a cancel comes while it is built
            request_file(spark, source, [(9, "2024-01-02 00:00:00", "cancel", 5)])
            if cancelled():
                raise stream.Cancelled("area 5")
        done.append(area)

    queue = stream.BuildQueue(spark, source, str(tmp_path / "cp"), build, lambda name, data: told.append((name, data)))
    request_file(spark, source, [(1, "2024-01-01 00:00:00", "enqueue", 1), (2, "2024-01-01 00:00:01", "enqueue", 2), (3, "2024-01-01 00:00:02", "enqueue", 1), (4, "2024-01-01 00:00:03", "enqueue", 3), (5, "2024-01-01 00:00:04", "cancel", 4)])
    queue.start().awaitTermination()
    assert sorted(map(tuple, queue.waiting().select("area", "request").collect())) == [(1, 1), (1, 3), (2, 2), (3, 4)]
    request_file(spark, source, [(6, "2024-01-01 00:00:05", "cancel", 1), (7, "2024-01-01 00:00:06", "enqueue", 5)])
    queue.start().awaitTermination()
    assert (stream.REMOVED, {"area": 1, "request": 1}) in told  # the earliest of the area, from the first file
    again = stream.BuildQueue(spark, source, str(tmp_path / "cp"), build, lambda name, data: told.append((name, data)))
    assert again.run() == 2 and done == [2, 1]
    assert any(n == stream.UPDATED and d.get("error") == "no such area" for n, d in told)
    assert (stream.REMOVED, {"area": 5, "request": 7}) in told and again.waiting().isEmpty()
    assert again.run() == 0  # nothing is built twice


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        v.read()
    v.write(spark.range(3))
    with pytest.raises(Exception):
        v.write(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")))
    assert v.read().count() == 3 and v.versions() == [1]
    assert v.write(spark.range(5)) == 2 and v.read().count() == 5 and v.read(1).count() == 3


def test_parameters_are_bound(spark):
    text = "x' OR '1'='1"
    assert config.execute_one(spark, "SELECT :a AS a", a=text).a == text
    assert config.Prepared(spark, "SELECT id FROM range(:n)").execute(n=4).count() == 4
    with pytest.raises(ValueError):
        config.execute_one(spark, "SELECT id FROM range(2)")


def test_settings():
    got, warnings = config.parse("# c\n\nHOST = h \nNOPE=1\nrubbish")
    assert got == config.DEFAULTS | {"HOST": "h"} and len(warnings) == 2
    assert config.env("WAYMARK_NOT_SET", "d") == "d"


@pytest.fixture(scope="module")
def finder(spark):
    v = network.vertices(spark, SF).where("line_id < 400").cache()
    tiles = spark.sql("SELECT 39 AS tile_lat, -110 AS tile_lng")
    return Finder(spark, v, network.attributes(spark, SF), raster.plane(tiles, 37), 37)


def test_service_calls(finder):
    assert finder.elevation(39.5, -109.5).first().ele == pytest.approx(144)
    here = finder.what_is_here(39.02, -109.97).first()
    assert here.line_id is not None and here.ele is not None
    assert finder.trail_info(39.02, -109.97).first().edge_id is not None
    assert finder.elevation_area(39.5, -109.5, 4).count() == 25
    assert finder.add_quadrangle(39.5, -109.5).count() == 1 and finder.node_counts().first().node_count > 0
    assert finder.update_intersection_counts().where("intersection_count > 0").count() == 1
    assert finder.remove_quadrangle(39.5, -109.5).count() == 0
    finder.add_route_group(1, "one")
    assert finder.add_route_group_routes(1, [1, 2]) and finder.route_group_routes(1).count() >= 1
    assert finder.route_groups().first().subgroups is None
    assert finder.get_routes([1, 2]).count() == 2
    finder.generate_paths(5)
    finder.generate_paths(5)
    finder.delete_generate_path_request(5)
    assert finder.generate_paths_queue().first().waiting == 1
    assert finder.search("red").count() >= 1


def test_route_between_points_of_one_line(finder):
    own = finder.vertices.where("line_id = 1").orderBy("idx").collect()
    got = finder.find_route([(own[0].lat, own[0].lng), (own[-1].lat, own[-1].lng)]).orderBy("seq").collect()
    assert got and got[0].kind == "start" and sum(r.cost for r in got) > 0
    assert finder.search_log_entry(0).count() == 1


def test_points_far_from_a_small_network(spark):
    line = spark.createDataFrame([(1, i, 2, i, 0, 39.0, -110.0 + i / 1000, 0.0, 100.0 * i, 0.0) for i in (1, 2)], "line_id long, idx long, n long, gx long, gy long, lat double, lng double, ele double, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 7000.0), (2, -90_000.0, 0.0), (3, 150.0, 1.0)], "point_id long, x double, y double")
    got = {r.point_id: (r.line_id, r.dist_merc, r.rank) for r in snap.nearest(points, measured(line), k=3).collect()}
    assert got == {1: (1, round((7000.0**2 + 100.0**2) ** 0.5, 4), 1), 2: (1, 90_100.0, 1), 3: (1, 1.0, 1)}


def test_lines_on_one_segment_rank_by_id(spark):
    rows = [(k, i, 2, i, 0, 39.0, -110.0, 0.0, 100.0 * i, 10.0 * (k == 9)) for k in (5, 3, 9, 4) for i in (1, 2)]
    m = measured(spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long, lat double, lng double, ele double, x double, y double"))
    points = spark.createDataFrame([(1, 150.0, 0.0)], "point_id long, x double, y double")
    for k, want in ((1, [3]), (2, [3, 4]), (4, [3, 4, 5, 9]), (10, [3, 4, 5, 9])):
        assert [r.line_id for r in snap.nearest(points, m, k).orderBy("rank").collect()] == want


def test_windows_of_odd_size_reach_further_south(spark):
    from waymark.sources import raster

    at = raster.around(F.lit(39.5), F.lit(-110.0), 5, 3601)
    r = spark.range(1).select(*(v.alias(k) for k, v in at.items())).withColumns(raster.window_corners(5, 3601)).first()
    assert r.gy0 == 790_197 and r.ne.lat - r.sw.lat == pytest.approx(5 / 3600)
