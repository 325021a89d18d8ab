"""The table functions: regions and tiles apart, errors from their analysis."""

import numpy as np
import pytest

from waymark.functions import tables

PATCH = "SELECT 1 AS tile_lat, 1 AS tile_lng, 0 AS part, CAST(NULL AS BINARY) AS content, 1 AS request_id, 1 AS row, 1 AS col"


def test_regions_are_searched_apart(spark):
    tables.register(spark)
    rows = [("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("b", 3, 4, 1.0), ("b", 1, 4, 5.0), ("a", 1, 3, None), ("a", 1, 4, None), ("b", 1, 4, None), ("b", 9, 9, None), ("c", 1, 2, None)]
    df = spark.createDataFrame(rows, "region string, src long, dst long, cost double")
    got = spark.sql("SELECT * FROM shortest_path(TABLE(SELECT * FROM {t}) PARTITION BY region)", t=df).collect()
    key = lambda r: (r[0], r[1], r[2] is None, r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted([(1, 3, 2.0, [1, 2, 3]), (1, 4, None, []), (1, 4, 5.0, [1, 4]), (9, 9, 0.0, [9]), (1, 2, None, [])], key=key)


@pytest.mark.parametrize("sql", ["SELECT * FROM shortest_path(5)", "SELECT * FROM shortest_path(TABLE(SELECT 1 AS src))", "SELECT * FROM elevation_patch(TABLE(SELECT 1 AS row), 2)", f"SELECT * FROM elevation_patch(TABLE({PATCH}), -1)"])
def test_wrong_arguments_are_named(spark, sql):
    tables.register(spark)
    with pytest.raises(Exception, match="shortest_path|elevation_patch"):
        spark.sql(sql).collect()


def test_patches_are_cut_from_their_tiles(spark):
    tables.register(spark)
    grids = {lat: (np.arange(25).reshape(5, 5) + 100 * lat).astype(">i2") for lat in (1, 2)}
    grids[2][1, 1] = -32768
    tiles = [(lat, 7, 0, g.tobytes(), None, None, None) for lat, g in grids.items()]
    asked = [(1, 0, 0), (1, 2, 2), (1, 4, 3), (2, 1, 2), (2, 5, 0), (2, None, 1), (3, 1, 1)]
    rows = tiles + [(lat, 7, 0, None, i, r, c) for i, (lat, r, c) in enumerate(asked)]
    df = spark.createDataFrame(rows, "tile_lat int, tile_lng int, part int, content binary, request_id long, row int, col int").repartition(3)
    got = {r.request_id: r for r in spark.sql("SELECT * FROM elevation_patch(TABLE(SELECT * FROM {t}), 1)", t=df).collect()}
    assert len(got) == len(asked)
    for i, (lat, r, c) in enumerate(asked):
        inside = lat in grids and r is not None and r < 5
        places = [(y, x) for y in range(max(0, r - 1), min(5, r + 2)) for x in range(max(0, c - 1), min(5, c + 2))] if inside else []
        want = [int(grids[lat][p]) for p in places]
        assert got[i].ele == [None if v == -32768 else v for v in want]
        assert got[i].width == len({x for _, x in places})
        assert not inside or (got[i]["row"], got[i]["col"]) == places[0]
