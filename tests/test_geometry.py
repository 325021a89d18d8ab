"""Golden values and properties of geometry and linear referencing."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import lines

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_walking_speed(spark):
    flat, top, steep, none = one(spark, *(geo.walking_speed(F.lit(a), F.lit(b)) for a, b in ((0.0, 10.0), (-0.5, 10.0), (100.0, 10.0), (1.0, 0.0))))
    assert flat == pytest.approx(6000 * 2.71828**-0.175) and top == pytest.approx(6000) and steep == 500 and none == 500


def test_no_run_takes_no_time(spark):
    assert one(spark, geo.hours(F.lit(5.0), F.lit(0.0))) == (0.0,)


def test_haversine(spark):
    (d,) = one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert d == pytest.approx(6378137 * math.pi / 180)


def test_mercator_round_trip(spark):
    for lat, lng in ((0.0, 0.0), (60.5, -120.25), (-45.0, 179.0)):
        x, y = geo.mercator_x(F.lit(lng)), geo.mercator_y(F.lit(lat))
        assert one(spark, geo.latitude(y), geo.longitude(x)) == (pytest.approx(lat, abs=1e-9), pytest.approx(lng))


def test_position_on_segment(spark):
    at = lambda x, y, *s: geo.position(*(F.lit(float(v)) for v in (x, y, *s)))
    assert one(spark, at(5, 3, 0, 0, 10, 0), at(-4, 0, 0, 0, 10, 0), at(99, 0, 0, 0, 10, 0), at(1, 1, 2, 2, 2, 2)) == (0.5, 0.0, 1.0, 0.0)


def test_tile_names(spark):
    assert one(spark, geo.tile_name(F.lit(39.5), F.lit(-109.2)), geo.tile_name(F.lit(-0.1), F.lit(7.0))) == ("N39W110", "S01E007")


def test_geojson_round_trip(spark):
    df = spark.sql("SELECT array(named_struct('lat', 1D, 'lng', 2D, 'ele', 3D), named_struct('lat', 4D, 'lng', 5D, 'ele', 6D)) AS p")
    back, pairs = df.select(geo.from_geojson(geo.geojson(F.col("p"))).alias("b"), geo.as_lat_lng(F.col("p")).alias("q")).first()
    assert [tuple(v) for v in back] == [(1, 2, 3), (4, 5, 6)] and pairs == [[1, 2], [4, 5]]


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(1, i + 1, 4, x, y, float(y), float(x), float(10 * i), float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (3, 4), (3, 4), (3, 10)])]
    return lines.measured(spark.createDataFrame(rows, "line_id long, idx long, n long, gx long, gy long, lat double, lng double, ele double, x double, y double")).cache()


def test_fractions_rise_from_0_to_1(measured):
    assert [r.fraction for r in measured.orderBy("idx").collect()] == [0.0, pytest.approx(5 / 11), pytest.approx(5 / 11), 1.0]


def test_whole_substring_is_the_line(spark, measured):
    cut = spark.createDataFrame([(1, 0.0, 1.0)], "line_id long, f0 double, f1 double")
    whole = lines.cost_of(lines.substring(measured, cut), ["line_id"]).first()
    last = measured.where("idx = 4").first()
    assert whole.metres == pytest.approx(last.cum_m) and whole.forward_h == pytest.approx(last.cum_fwd) and whole.reverse_h == pytest.approx(last.cum_rev)


def test_substring_interpolates_elevation(spark, measured):
    cut = spark.createDataFrame([(1, 2.5 / 11, 8 / 11)], "line_id long, f0 double, f1 double")
    got = lines.substring(measured, cut).orderBy("part", "idx").collect()
    assert (got[0].x, got[0].y, got[0].ele) == (pytest.approx(1.5), pytest.approx(2.0), pytest.approx(5.0))
    assert (got[-1].y, got[-1].ele) == (pytest.approx(7.0), pytest.approx(25.0))


def test_reversed_line_swaps_costs(measured):
    back = lines.reverse(measured).where("idx = 4").first()
    last = measured.where("idx = 4").first()
    assert back.cum_fwd == pytest.approx(last.cum_rev) and back.cum_rev == pytest.approx(last.cum_fwd)
