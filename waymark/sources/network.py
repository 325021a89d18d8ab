"""A trail network derived from the order tables, which hold no geometry.

A line is an order; its vertices walk an integer grid, one step per item, so that many
lines share vertices. The grid gives positions, elevations and point keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import mercator_x, mercator_y
from waymark.sources.tables import table

ORIGIN_LAT, ORIGIN_LNG, STEP = 39, -110, 1000.0
#: Items whose lines one task walks.
ROWS = 100_000


def by_line(items: DataFrame, rows: int = ROWS) -> DataFrame:
    """`items` dealt by line_id; many go to tasks of about `rows`, which are not merged by their bytes."""
    parts = -(-items.count() // rows)
    return items.repartition(parts, "line_id") if parts > items.sparkSession.sparkContext.defaultParallelism else items.repartition("line_id")


def placed(df: DataFrame) -> DataFrame:
    """Adds position, elevation and Mercator coordinates of grid columns gx and gy."""
    df = df.withColumns(
        {
            "lat": ORIGIN_LAT + F.col("gy") / STEP,
            "lng": ORIGIN_LNG + F.col("gx") / STEP,
            "ele": (1000 + 2 * ((F.col("gx") * F.col("gx") + 3 * F.col("gy")) % 37)).cast("double"),
        }
    )
    return df.withColumns({"x": mercator_x(F.col("lng")), "y": mercator_y(F.col("lat"))})


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, idx (from 1), n, gx, gy, lat, lng, ele, x, y of lines with two vertices or more.

    One exchange by line serves the grouping and every window over a line.
    """
    items = by_line(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), "l_linenumber", "l_partkey"))
    steps = items.groupBy("line_id", "l_linenumber").agg(F.min("l_partkey").alias("pk"))
    by = Window.partitionBy("line_id")
    steps = steps.withColumn("idx", F.row_number().over(by.orderBy("l_linenumber")).cast("long")).withColumn("n", F.count("*").over(by))
    walk = by.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)

    def moved(parity: int) -> F.Column:
        return F.sum(F.when((F.col("idx") > 1) & (F.col("pk") % 2 == parity), 1).otherwise(0)).over(walk)

    grid = steps.withColumns({"gx": (F.col("line_id") * 31) % 97 + moved(0), "gy": (F.col("line_id") * 17) % 89 + moved(1)})
    return placed(grid.where("n >= 2").select("line_id", "idx", "n", "gx", "gy"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, name, highway, foot, surface of every order that is a line."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    first = item.groupBy(F.col("l_orderkey").alias("line_id")).agg(F.min("l_partkey").alias("p_partkey"))
    named = first.join(part.select("p_partkey", F.col("p_name").alias("name")), "p_partkey").drop("p_partkey")
    kinds = {"1": "path", "2": "footway", "3": "track", "4": "residential", "5": "steps"}
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_id"),
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderpriority").startswith("4") & (F.col("o_custkey") % 2 != 0), "bridleway")
        .otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.substring("o_orderpriority", 1, 1)))
        .alias("highway"),
        F.when(F.col("o_orderstatus") == "F", "designated").when(F.col("o_orderstatus") == "O", "yes").otherwise("no").alias("foot"),
    )
    surface = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("surface"))
    return named.join(orders, "line_id").join(surface, "c_custkey", "left").drop("c_custkey")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, lat, lng, x, y: one point per event."""
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select(e.alias("point_id"), (39 + (e * 7) % 8900 / 100000.0).alias("lat"), (-110 + e % 9700 / 100000.0).alias("lng"))
    return df.withColumns({"x": mercator_x(F.col("lng")), "y": mercator_y(F.col("lat"))})
