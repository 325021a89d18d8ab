"""Rebuilds of an area as versions: progress, cancelling, and the edges that result."""

import pytest
from pyspark.sql import functions as F

from waymark.api import area_box, area_of
from waymark.operators import graph, lines, rebuild, routes
from waymark.sources import network
from waymark.sources.versions import Versions
from waymark.streaming.requests import UPDATED, UPDATING, BuildQueue

SF = "/root/testdata/sf0.001"


def vertices(spark, rows):
    """rows of (line_id, idx, n, gx, gy), ten metres or so apart."""
    df = spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long")
    df = df.withColumns({"lat": 39 + F.col("gy") / 10000.0, "lng": -110 + F.col("gx") / 10000.0, "ele": F.lit(0.0)})
    return df.withColumns({"x": F.col("lng") * 111000, "y": F.col("lat") * 111000})


def line(line_id, *points):
    return [(line_id, i, len(points), *p) for i, p in enumerate(points, 1)]


CROSS = line(1, (0, 0), (1, 0), (2, 0)) + line(2, (1, -1), (1, 0), (1, 1))
FAR = line(3, (900, 900), (901, 900))
BOX = (38.9, -110.1, 39.01, -109.99)


def shown(df):
    return sorted((r.line_id, r.idx, r.forward_edge_id) for r in df.collect())


def test_build_area_reports_and_writes_a_version(spark, tmp_path):
    versions, heard = Versions(spark, str(tmp_path / "edges")), []
    all_lines = vertices(spark, CROSS + FAR)
    versions.write(graph.half_edges(lines.measured(vertices(spark, CROSS[:3] + FAR))).select(*rebuild.EDGE, *rebuild.EDGE_VALUES))
    assert rebuild.build_area(all_lines, versions, BOX, lambda name, values: heard.append((name, values["done"]))) == 2
    assert heard == [(UPDATING, 0), (UPDATING, 1), (UPDATING, 2), (UPDATED, 3)]
    assert shown(versions.read()) == shown(graph.half_edges(lines.measured(all_lines)))
    assert shown(versions.read(1)) != shown(versions.read())


def test_cancelled_build_leaves_the_version(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "edges"))
    v = vertices(spark, CROSS)
    assert rebuild.build_area(v, versions, BOX) == 1
    answers = iter([False, False, True])
    with pytest.raises(rebuild.Cancelled):
        rebuild.build_area(v, versions, BOX, cancelled=lambda: next(answers))
    assert versions.versions() == [1]


def test_area_without_lines(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "edges"))
    rebuild.build_area(vertices(spark, CROSS), versions, BOX)
    rebuild.build_area(vertices(spark, CROSS), versions, (10.0, 10.0, 11.0, 11.0))
    assert shown(versions.read()) == shown(versions.read(1))


def test_removed_line_loses_its_edges_and_its_neighbours_relink(spark):
    old = graph.half_edges(lines.measured(vertices(spark, CROSS)))
    changes = {(r.line_id, r.idx): r.op for r in rebuild.edge_changes(old, graph.half_edges(lines.measured(vertices(spark, CROSS[:3])))).collect()}
    assert changes == {(1, 1): "update", (1, 2): "delete", (1, 3): "update", (2, 1): "delete", (2, 2): "delete", (2, 3): "delete"}


def test_node_ids_are_taken_over_by_the_least(spark):
    proposed = spark.createDataFrame([(0, 0, 7), (1, 0, 8)], "gx long, gy long, node_id long")
    existing = spark.createDataFrame([(0, 0, 50), (0, 0, 40), (5, 5, 60)], "gx long, gy long, node_id long")
    assert {(r.gx, r.node_id) for r in rebuild.with_node_ids(proposed, existing).collect()} == {(0, 40), (1, 8)}


def test_gaps_and_json_without_unset_members(spark):
    legs = spark.createDataFrame([(1, 0, 10, 11, 5, 0.0, 0.5, 1.0), (1, 1, 11, 12, 6, 0.0, 0.5, 1.0), (1, 2, 13, 14, 6, 0.5, 1.0, 1.0)], "query_id long, leg long, src long, dst long, line_id long, f0 double, f1 double, cost double")
    assert [tuple(r) for r in routes.gaps(legs).collect()] == [(1, 2)]
    made = {r.seq: r.anchor for r in routes.anchors_json(routes.anchors(legs)).collect()}
    assert '"prev"' not in made[1] and '"next":6' in made[1] and '"type":"start"' in made[1]
    assert '"next"' not in made[2] and '"prev":5' in made[2]


def test_an_edit_keeps_the_files_of_other_tiles(spark, tmp_path):
    """The rebuild of a box by tiles equals one of everything; untouched partitions keep their files."""
    v = network.vertices(spark, SF).where("line_id < 600").cache()
    store = rebuild.EdgeStore(spark, f"file://{tmp_path}/edges", 0.02)
    old = graph.half_edges(lines.measured(v.where("line_id % 10 <> 3")))
    store.write(store.placed(old, v))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "edges").rglob("*.parquet")}
    told = []
    touched = rebuild.build_area(v, store, (39.0, -110.0, 39.001, -109.999), lambda name, values: told.append(name))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "edges").rglob("*.parquet")}
    tile = lambda p: p.parent.name.removeprefix("tile=")
    assert 0 < len(touched) < len({tile(p) for p in before}) and len(told) == 4
    assert {p: t for p, t in before.items() if tile(p) not in touched} == {p: t for p, t in after.items() if tile(p) not in touched}
    assert not {p for p in before if tile(p) in touched} & set(after)
    want = rebuild.rebuilt(old, v, rebuild.area_lines(v, 39.0, -110.0, 39.001, -109.999))
    key = lambda df: sorted(map(tuple, df.select("line_id", "idx", "edge_id", "node_id", "forward_edge_id").collect()))
    assert key(store.read()) == key(want)
    # a tile that loses its last half-edge goes
    gone = store.read().select("line_id").distinct()
    store.replace(gone, store.placed(old.limit(0), v))
    assert not list((tmp_path / "edges").rglob("*.parquet"))


def test_a_queue_drives_the_rebuild_and_a_cancel_stops_it(spark, tmp_path):
    v = network.vertices(spark, SF).where("line_id < 200").cache()
    store = rebuild.EdgeStore(spark, f"file://{tmp_path}/edges")
    source, told = str(tmp_path / "in"), []
    schema = "event_id long, ts string, kind string, area long"

    def ask(*rows):
        spark.createDataFrame(list(rows), schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)

    def build(_, area, report, cancelled):
        if not store.exists():
            ask((2, "2024-01-01 00:00:09", "cancel", area))
        return rebuild.build_area(v, store, area_box(area), report, cancelled)

    queue = BuildQueue(spark, source, str(tmp_path / "cp"), build, lambda name, data: told.append((name, data)))
    area = area_of(39, -110)
    ask((1, "2024-01-01 00:00:00", "enqueue", area))
    assert queue.run() == 0 and not store.exists() and ("genRequestRemoved", {"area": area, "request": 1}) in told
    store.write(store.placed(graph.half_edges(lines.measured(v.limit(0))), v))
    ask((3, "2024-01-01 00:01:00", "enqueue", area))
    assert queue.run() == 1 and store.read().count() == graph.half_edges(lines.measured(v)).count()
    assert {n for n, _ in told} >= {"genRequestQueued", "updatingRoutes", "routesUpdated"}


def test_bounds_ask_for_cells():
    assert area_box(area_of(39, -110)) == (39.0, -110.0, 40.0, -109.0) and area_box(area_of(-1, 0)) == (-1.0, 0.0, 0.0, 1.0)
