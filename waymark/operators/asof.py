"""As-of joins in one sort: the last row at or before each place of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which on its positions are dealt to ranges, of about so many rows each.
HOT_ROWS = 200_000


def last_before(places: DataFrame, rows: DataFrame, key: str, position: str, at: str, ties: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`places` with `at`, the last of `rows` (struct column `at`) of its key at or before its position.

    Positions are numbers from 0 to 1. A place with a true column `strict` takes only rows
    before its position. Of rows at one position the last by `ties` counts; a place without
    any row before it gets null.

    Both sides meet in one union that is sorted once by key and position. A key of more
    than `hot_rows` rows is dealt to ranges of positions, which are sorted apart; the last
    row of each range goes on, as a row at its start, to the ranges up to the next one that
    has rows. Only keys of that size get such rows, at most one a range. Where both sides
    lie by key and no key is hot, nothing is moved, and the result lies by key too.
    """
    kind, ordered = rows.schema[at].dataType, rows.schema[ties].dataType
    own = F.struct(*places.columns)
    strict = F.col("strict") if "strict" in places.columns else F.lit(False)
    left = places.select(
        F.col(key).alias("__key"), F.col(position).cast("double").alias("__p"), F.when(strict, 0).otherwise(2).alias("__tag"),
        F.lit(None).cast(ordered).alias("__t"), own.alias("__own"), F.lit(None).cast(kind).alias("__at"),
    )
    right = rows.select(
        F.col(key).alias("__key"), F.col(position).cast("double").alias("__p"), F.lit(1).alias("__tag"),
        F.col(ties).alias("__t"), F.lit(None).cast(left.schema["__own"].dataType).alias("__own"), F.col(at).alias("__at"),
    )
    sizes = right.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = sizes.select("__key", F.ceil(F.col("n") / hot_rows).cast("int").alias("__r"))
    dealt = ["__key"]
    if hot.isEmpty():
        both = left.unionByName(right)
    else:
        bucket = F.least(F.greatest(F.floor(F.col("__p") * F.col("__r")), F.lit(0)), F.col("__r") - 1).cast("int")
        ranged = left.unionByName(right).join(hot, "__key", "left").withColumn("__b", F.coalesce(bucket, F.lit(0)))
        ends = right.join(hot, "__key").withColumn("__b", bucket).groupBy("__key", "__r", "__b").agg(F.max(F.struct("__p", "__t", "__at")).alias("__e"))
        following = F.coalesce(F.lead("__b").over(Window.partitionBy("__key").orderBy("__b")), F.col("__r") - 1)
        seeds = ends.withColumn("__n", following).where(F.col("__n") > F.col("__b")).select("__key", F.explode(F.sequence(F.col("__b") + 1, F.col("__n"))).alias("__b"), "__e.*")
        seeds = seeds.select("__key", "__b", F.lit(float("-inf")).alias("__p"), F.lit(1).alias("__tag"), "__t", F.lit(None).cast(left.schema["__own"].dataType).alias("__own"), "__at")
        both, dealt = ranged.drop("__r").unionByName(seeds), ["__key", "__b"]
    order = Window.partitionBy(*dealt).orderBy("__p", "__tag", "__t").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__at", F.last("__at", ignorenulls=True).over(order)).where(F.col("__own").isNotNull())
    return met.select(*(F.col("__key").alias(c) if c == key else F.col(f"__own.{c}") for c in places.columns), F.col("__at").alias(at))
