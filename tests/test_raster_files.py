"""Elevations from whole tile files: equal to those of samples, files without points never opened."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waymark.sources import raster

DIM = 13


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tiles')}"
    at = spark.createDataFrame([(39, -110), (-1, 0), (0, -1)], "tile_lat int, tile_lng int")
    grid = raster.plane(at, DIM).withColumn("ele", F.when((F.col("row") == 3) & (F.col("col") == 4), None).otherwise(F.col("ele") * 7 % 101).cast("int"))
    names = {r.tile for r in raster.written(grid, path, DIM).collect()}
    assert names == {"N39W110", "S01E000", "N00W001"}
    return path, grid


@pytest.mark.parametrize("points", [10**6, 7])
def test_files_equal_samples(spark, tiles, points, monkeypatch):
    monkeypatch.setattr(raster, "POINTS", points)
    path, grid = tiles
    rng = random.Random(3)
    corners = [(39, -110), (-1, 0), (0, -1), (50, 50)]
    rows = [(i, a + rng.random(), b + rng.random()) for i, (a, b) in enumerate(corners * 15)] + [(100, 39.0, -110.0), (101, 39.999999, -109.000001), (102, None, 5.0), (103, 39 + 8.5 / 12, -110 + 3.5 / 12)]
    at = spark.createDataFrame(rows, "point_id long, lat double, lng double")
    want = {r.point_id: r.ele for r in raster.elevations(at, raster.samples(spark, path, DIM), DIM).collect()}
    got = {r.point_id: r.ele for r in raster.elevations_in_files(at, path, DIM).collect()}
    assert got == pytest.approx(want) and got[103] is None and got[3] is None and sum(v is not None for v in got.values()) > 40
    assert raster.samples(spark, path, DIM).where("ele is null").count() == 3
    filled = raster.elevations_in_files(at, path, DIM, missing=-1.0).where("point_id in (3, 102)").collect()
    assert [r.ele for r in filled] == [-1.0, -1.0]


def test_files_without_points_are_not_opened(spark, tiles):
    path, _ = tiles
    (open(path.removeprefix("file://") + "/N10E010.hgt", "wb")).write(b"not a tile")
    at = spark.createDataFrame([(1, 39.5, -109.5)], "point_id long, lat double, lng double")
    assert raster.elevations_in_files(at, path, DIM).first().ele is not None
    with pytest.raises(Exception, match="has 5"):
        raster.elevations_in_files(spark.createDataFrame([(1, 10.5, 10.5)], "point_id long, lat double, lng double"), path, DIM).collect()
    assert raster.elevations_in_files(at.limit(0), path, DIM).collect() == []


def test_missing_elevations_are_filled(spark, tiles):
    path, _ = tiles
    rows = [(1, 39.3, -109.6, -1.0), (2, 39.3, -109.6, None), (3, 39.3, -109.6, 7.0), (4, 50.5, 50.5, -1.0), (5, None, -109.6, None), (6, 39.7, -109.2, -1.0), (6, 39.7, -109.2, -1.0)]
    v = spark.createDataFrame(rows, "i int, lat double, lng double, ele double")
    at = spark.createDataFrame([(1, 39.3, -109.6), (6, 39.7, -109.2)], "point_id long, lat double, lng double")
    want = {r.point_id: r.ele for r in raster.elevations_in_files(at, path, DIM).collect()}
    got = raster.filled(v, path, DIM)
    assert got.columns == v.columns
    assert sorted(((r.i, r.ele) for r in got.collect()), key=repr) == sorted([(1, want[1]), (2, want[1]), (3, 7.0), (4, None), (5, None), (6, want[6]), (6, want[6])], key=repr)
    assert raster.filled(v.limit(0), path, DIM).collect() == []


def test_windows_read_requests_once_and_have_centers(spark, tmp_path):
    dim, size = 5, 3
    grid = raster.plane(spark.createDataFrame([(0, 0), (0, 1), (7, 7)], "tile_lat int, tile_lng int"), dim).where("not (tile_lng = 0 and row = 2 and col = 2)")
    # within a tile beside the sample that is not there, across two tiles, beyond both
    corners = {1: (180 * 4, 180 * 4), 2: (180 * 4 + 1, 180 * 4 + 3), 3: (180 * 4 + 3, 180 * 4 + 7), 4: (5, 5)}
    spark.createDataFrame([(k, *v) for k, v in corners.items()], "request_id long, gy0 int, gx0 int").write.parquet(f"{tmp_path}/asked")
    held = {}
    for t in (0, 1):
        for row in range(dim):
            for col in range(dim):
                if not (t == 0 and row == col == 2):
                    at = (181 * 4 - row, (t + 180) * 4 + col)
                    held[at] = max(held.get(at, -1), 3 * row + 5 * col)
    want = {}
    for k, (gy, gx) in corners.items():
        own = {(i, j): held[gy + i, gx + j] for i in range(size + 1) for j in range(size + 1) if (gy + i, gx + j) in held}
        for (i, j), ele in own.items():
            four = [own[i + a, j + b] for a in (0, 1) for b in (0, 1) if (i + a, j + b) in own]
            want[k, i, j] = (ele, sum(four) / 4 if len(four) == 4 else None)
    df = raster.window(grid, spark.read.parquet(f"{tmp_path}/asked"), size, dim)
    assert {(r.request_id, r.i, r.j): (r.ele, r.center) for r in df.collect()} == want
    # a join of the requests' samples with themselves was broadcast whole
    assert df._jdf.queryExecution().sparkPlan().toString().count("gy0:int") == 1


def test_elevations_of_rows_without_a_key(spark):
    """Rows are not told apart by ids, and cells are joined to them where they lie, also many of one cell."""
    rows = [(39.5, -109.5, "a"), (39.5, -109.5, "b"), (39.26, -109.77, "a"), (12.0, 3.0, "c"), (None, -109.5, "d")]
    grid = raster.plane(spark.sql("SELECT 39 AS tile_lat, -110 AS tile_lng"), 37)
    got = raster.elevations(spark.createDataFrame(rows, "lat double, lng double, name string"), grid, 37).collect()
    at = lambda lat, lng: 3 * 36 * (1 - (lat - 39)) + 5 * 36 * (lng + 110)
    assert [r.name for r in sorted(got, key=lambda r: r.name)] == ["a", "a", "b", "c", "d"]
    for r in got:
        assert r.ele is None if r.name in "cd" else r.ele == pytest.approx(at(r.lat, r.lng))
